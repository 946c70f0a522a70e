"""Row changes as DataFrames.

A typed change log has the columns lsn BIGINT, seq BIGINT, op INT and the table's own columns.
op: 0 insert, 1 update, 2 delete, 3 truncate barrier, 4 schema barrier. (lsn, seq) is its total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE, TRUNCATE, SCHEMA = 0, 1, 2, 3, 4
#: Columns that the engine adds to target tables.
SOURCE, OP, LSN, SEQ = "_source", "_op", "_lsn", "_seq"
SYSTEM = (SOURCE, OP, LSN, SEQ)


def op_label(op: Column) -> Column:
    return F.when(op == UPDATE, "U").when(op == DELETE, "D").otherwise("I")


def live(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("op").isin(INSERT, UPDATE))


def fill_unchanged(new: Column, old: Column, unchanged: Column) -> Column:
    """An array of values where those marked unchanged come from the old image."""
    return F.transform(new, lambda v, i: F.when(F.coalesce(F.get(unchanged, i), F.lit(False)), F.get(old, i)).otherwise(v))


def guard_unchanged(changes: DataFrame, unchanged: str = "unchanged", old: str = "old") -> DataFrame:
    """Fails on a value that is marked unchanged where no old image was sent."""
    lost = F.exists(F.coalesce(F.col(unchanged), F.array().cast("array<boolean>")), lambda u: u) & F.col(old).isNull()
    return changes.withColumn(unchanged, F.when(lost, F.raise_error(F.lit("unchanged column without an old value: the source table needs REPLICA IDENTITY FULL"))).otherwise(F.col(unchanged)))


def delete_image(changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Deletes keep their key columns alone; without a key they keep the whole old row."""
    if not keys:
        return changes
    gone = F.col("op") == DELETE
    return changes.select(*[c if c not in columns or c in keys else F.when(~gone, F.col(c)).alias(c) for c in changes.columns])


def split_updates(changes: DataFrame, keys: list[str], columns: list[str], old_prefix: str = "old_") -> DataFrame:
    """Each update as a delete of the old key and an insert of the new row, in this order and at one position.

    Old keys stand in columns with old_prefix; a null one means that the key did not change. Positions
    are doubled, so that the two halves have places of their own.
    """
    rest = [c for c in changes.columns if c not in ("op", "seq", *columns) and not c.startswith(old_prefix)]
    old_key = lambda k: F.coalesce(F.col(old_prefix + k), F.col(k)) if old_prefix + k in changes.columns else F.col(k)
    kinds = dict(changes.dtypes)
    gone = F.struct(F.lit(DELETE).alias("op"), (F.col("seq") * 2).alias("seq"), *[(old_key(c) if c in keys else F.lit(None).cast(kinds[c])).alias(c) for c in columns])
    come = F.struct(F.when(F.col("op") == UPDATE, INSERT).otherwise(F.col("op")).alias("op"), (F.col("seq") * 2 + 1).alias("seq"), *columns)
    return changes.select(*rest, F.explode(F.when(F.col("op") == UPDATE, F.array(gone, come)).otherwise(F.array(come))).alias("_c")).select(*rest, "_c.*")


def skip_filter(changes: DataFrame, mappings: DataFrame) -> DataFrame:
    """Drops changes of tables that are disabled or errored, that a snapshot already holds, or that an append table already has.

    mappings: mapping_id, enabled, state, sync_mode, snapshot_lsn, applied_lsn, applied_seq; one row a
    table, broadcast as it is bounded by the catalog. Positions are compared as (lsn, seq).
    """
    m = mappings.select("mapping_id", "enabled", "state", "sync_mode", "snapshot_lsn", "applied_lsn", "applied_seq")
    known = F.coalesce("snapshot_lsn", F.lit(-1))
    seen = F.struct("lsn", "seq") <= F.struct(F.coalesce("applied_lsn", F.lit(-1).cast("bigint")).alias("lsn"), F.coalesce("applied_seq", F.lit(2**62).cast("bigint")).alias("seq"))
    drop = ~F.col("enabled") | (F.col("state") == "ERRORED") | ((F.col("state") == "CATCHUP") & (F.col("lsn") <= known)) | ((F.col("state") == "STREAMING") & (F.col("sync_mode") == "append") & seen)
    return changes.join(F.broadcast(m), "mapping_id").where(~drop).drop(*m.columns[1:])


def above(changes: DataFrame, lsn: int, seq: int | None = None) -> DataFrame:
    """Changes behind a high-water mark; without seq the whole position counts as applied."""
    if seq is None:
        return changes.where(F.col("lsn") > lsn)
    return changes.where((F.col("lsn") > lsn) | ((F.col("lsn") == lsn) & (F.col("seq") > seq)))


def append_rows(changes: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Rows of an append target: the table's columns and the source, operation and position of each change."""
    return changes.where(F.col("op") <= DELETE).select(*columns, F.lit(label).alias(SOURCE), op_label(F.col("op")).alias(OP), F.col("lsn").alias(LSN), F.col("seq").alias(SEQ))


def batches(changes: DataFrame, size: int) -> DataFrame:
    """Which batch each change drains in when batches take `size` changes in order.

    Positions are numbered without one global sort task: rows are dealt by range and sorted, each gets its
    place within its partition, and the partitions' sizes are summed up. The dealt rows are written first,
    as ranges are drawn from a sample and would differ from run to run.
    """
    from ..sources.shared import written

    rows = changes.repartitionByRange("lsn", "seq").sortWithinPartitions("lsn", "seq").withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_nth", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "batches")
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, before = {}, 0
    for part in sorted(sizes):
        starts[part] = before
        before += sizes[part]
    if not starts:
        return rows.withColumn("batch", F.lit(0).cast("bigint")).drop("_part", "_nth")
    start = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in starts.items() for x in pair]), F.col("_part"))
    return rows.withColumn("batch", F.floor((start + F.col("_nth")) / size).cast("bigint")).drop("_part", "_nth")
