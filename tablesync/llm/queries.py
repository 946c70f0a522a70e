"""The dealt operators as driver queries; ORACLES where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that leaked into it."""
    from .string_tiling import tiles

    return tiles(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("leaked")


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .posting_lists import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minmax_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_crf import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document of the same number: bad if its quality is 0 or it is toxic."""
    from .host_reputation import judge

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 or toxic = 1").alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels).drop("bad_rate")


QUERIES = {f.__name__: f for f in (op1_string_tiling, op2_posting_lists, op3_minmax_dedup, op4_line_crf, op5_token_counts, op6_warc, op7_language_id, op8_suffix_dedup, op9_byte_bpe, op10_host_reputation)}


def strength_sql(rows: str) -> str:
    return f"""(SELECT CASE WHEN sum(n) IS NULL OR sum(n * above * (1 - above)) <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0,
    CASE WHEN sum(n * above * (1 - above)) > sum(above * (1 - above)) AND sum(n * pow(bad / n - above, 2)) > sum(above * (1 - above))
    THEN (sum(n * above * (1 - above)) - sum(above * (1 - above))) / (sum(n * pow(bad / n - above, 2)) - sum(above * (1 - above))) - 1 ELSE 1000.0 END)) END FROM {rows} WHERE n > 0)"""


ORACLES: dict[str, str] = {
    "op3_minmax_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s0 AS (SELECT DISTINCT doc_id, unnest(CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
    s AS (SELECT doc_id, sh, count(*) OVER (PARTITION BY doc_id) AS n FROM s0),
    l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    r(x, y) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id, n FROM s) n ON n.doc_id = d.doc_id""",
    "op8_suffix_dedup": """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS p FROM t WHERE length(h) >= 100)),
    g AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
    m AS (SELECT doc_id, p FROM w JOIN g USING (s) WHERE low < doc_id),
    i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM m),
    k AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM i),
    r AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY doc_id, span),
    c AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start, a AS stop FROM r UNION ALL SELECT doc_id, max(b), NULL FROM r GROUP BY doc_id),
    kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * start + 1, coalesce(2 * (stop - start), length(h))), '' ORDER BY start) AS h FROM c JOIN t USING (doc_id) GROUP BY c.doc_id),
    n AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
    SELECT t.doc_id, CAST(length(t.h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256
    FROM t LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op6_warc": """SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id <> newest THEN newest END AS refers_to
    FROM (SELECT page_id, payload, CAST(octet_length(encode(payload)) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY payload) AS newest FROM (SELECT page_id, coalesce(html, '') AS payload FROM pages))""",
    "op10_host_reputation": f"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    o AS (SELECT host, (quality = 0 OR toxic = 1) AS bad FROM p JOIN labels ON doc_id = page_id WHERE host <> ''),
    l AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(bad AS INTEGER)) AS DOUBLE) AS bad FROM o WHERE bad IS NOT NULL GROUP BY host),
    h AS (SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM (SELECT DISTINCT host FROM p WHERE host <> '') LEFT JOIN l USING (host)),
    g AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5) / (sum(n) + 1) ELSE 0.5 END AS rate FROM h),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS above FROM h, g GROUP BY suffix),
    s AS (SELECT suffix, (m * above + bad) / (m + n) AS above FROM s0, (SELECT {strength_sql("s0")} AS m)),
    d0 AS (SELECT domain, h.suffix, sum(n) AS n, sum(bad) AS bad, any_value(above) AS above FROM h JOIN s USING (suffix) GROUP BY domain, h.suffix),
    d AS (SELECT domain, (m * above + bad) / (m + n) AS above FROM d0, (SELECT {strength_sql("d0")} AS m)),
    h0 AS (SELECT host, n, bad, above FROM h JOIN d USING (domain)),
    r AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (m + n + 1)) AS low FROM (SELECT host, n, m, (m * above + bad) / (m + n) AS mean FROM h0, (SELECT {strength_sql("h0")} AS m)))
    SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
    ELSE CASE WHEN coalesce(low, CASE WHEN rate < 0.5 THEN rate ELSE 1.0 END) >= 0.5 THEN 'block' ELSE 'allow' END END AS verdict
    FROM (SELECT p.*, r.low, g.rate, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p LEFT JOIN r USING (host), g)""",
}
