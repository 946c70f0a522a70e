"""The corpus pipeline: five stages, each an operator of tablesync.llm applied to all that is left.

Stages 1 to 4 return the columns of documents. Between stages the documents are written to the
shared folder. Defined cases: a null or letterless text has no language and goes; of a group of near
duplicates one row stays; rows that share an id are documents of their own, of which one stays where
their texts are near duplicates or have no words; rows of null id are no one's duplicate; a text of
which no byte is left goes, as do the fragments of a character that a cut splits; further columns are
carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesync.llm.byte_bpe import encode_decode
from tablesync.llm.common import discard, durable, small_side
from tablesync.llm.language_id import identify
from tablesync.llm.minmax_dedup import near_duplicates
from tablesync.llm.queries import table, tokenizer_file
from tablesync.llm.string_tiling import clean
from tablesync.llm.substring_dedup import cut_repeats

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... that clash with nothing a stage adds; and those by their own names."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def named(rows: DataFrame, own: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in own.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language; lang becomes the language found."""
    rows, own = plain(docs)
    found = identify(rows, key=own["doc_id"], text=own["text"], lang=own["lang"], keep=tuple(own.values())).where("lang_pred <> 'und'")
    return named(found.withColumn(own["lang"], F.col("lang_pred")), own)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the smallest id."""
    docs, own = plain(docs)
    doc_id, text = own["doc_id"], own["text"]
    again = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1")
    key, rows = doc_id, docs
    if not again.isEmpty():
        # ids don't tell rows apart: each row gets a key of its own, in the order of ids
        key, number = "_key", F.when(F.col(doc_id).isNotNull(), F.monotonically_increasing_id())
        rows = durable(docs.orderBy(doc_id, *docs.columns).withColumn(key, number), "near", lasts=True)
    found = near_duplicates(rows, key=key, text=text, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    gone = found.where("not kept").select(key).distinct()
    if key == "_key":
        # texts without words have equal sets, too; those of one id are one
        bare = rows.select(doc_id, key).join(found.where("n_shingles = 0").select(key), key)
        bare = bare.withColumn("_first", F.min(key).over(Window.partitionBy(doc_id))).where(f"{key} > _first").select(key)
        gone = gone.unionByName(bare)
    return named(rows.join(small_side(gone), key, "left_anti"), own)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; n_chars follows."""
    docs, own = plain(docs)
    text, size = own["text"], own["n_chars"]
    rows = cut_repeats(docs, key=own["doc_id"], text=text).where(f"not cut or {text} <> ''")
    return named(rows.withColumn(size, F.when(F.col("cut"), F.length(text).cast("bigint")).otherwise(F.col(size))), own)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item leaked."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    import public_tokenizers

    return encode_decode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("near_dedup", near), ("suffix_dedup", repeats), ("decontamination", leaks), ("byte_bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage reads is deleted when it has written what it keeps."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        if read is not None:
            discard(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
