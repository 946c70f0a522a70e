"""The engine's operators as queries over the driver's tables, each with the same result in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import lsn as L
from .functions import pgtypes, scalar
from .operators import changes as C
from .operators.barriers import since_truncate
from .operators.compact import last_per_key, upserted
from .operators.consistency import counts, differences
from .operators.schema import schema_diff
from .operators.stats import nearest_ranks
from .plans.routing import Router, Target, view_name
from .sources.lake import LakeTable
from .sources.shared import new_folder

COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The orders change log in SQL, for the oracles.
CH = """WITH ch AS (
SELECT CAST(o_orderkey AS BIGINT) AS lsn, CAST(1 AS BIGINT) AS seq, 0 AS op, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
UNION ALL SELECT CAST(1000000000 + o_orderkey AS BIGINT), CAST(1 AS BIGINT), 1, o_orderkey, o_custkey, 'U', o_totalprice * 2 FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT CAST(2000000000 + o_orderkey AS BIGINT), CAST(1 AS BIGINT), 2, o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT CAST(3000000000 + o_orderkey AS BIGINT), CAST(1 AS BIGINT), 0, o_orderkey, o_custkey, 'R', o_totalprice FROM orders WHERE o_orderkey % 21 = 0)
"""
LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY lsn DESC, seq DESC) AS rn FROM ch) WHERE rn = 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*COLUMNS)


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders change log: each order is inserted; every third updated, every seventh deleted, every 21st inserted anew.

    One scan: an order's changes are exploded from its row.
    """
    k = F.col("o_orderkey")

    def change(base: int, op: int, status, price, customer):
        return F.struct((k + F.lit(base)).cast("bigint").alias("lsn"), F.lit(1).cast("bigint").alias("seq"), F.lit(op).alias("op"), k.alias("o_orderkey"), customer.alias("o_custkey"), status.alias("o_orderstatus"), price.alias("o_totalprice"))

    own, none = F.col("o_custkey"), lambda t: F.lit(None).cast(t)
    every = [
        change(0, C.INSERT, F.col("o_orderstatus"), F.col("o_totalprice"), own),
        F.when(k % 3 == 0, change(1_000_000_000, C.UPDATE, F.lit("U"), F.col("o_totalprice") * 2, own)),
        F.when(k % 7 == 0, change(2_000_000_000, C.DELETE, none("string"), none("double"), none("bigint"))),
        F.when(k % 21 == 0, change(3_000_000_000, C.INSERT, F.lit("R"), F.col("o_totalprice"), own)),
    ]
    return orders(spark, sf_dir).select(F.explode(F.filter(F.array(*every), lambda c: c.isNotNull())).alias("c")).select("c.*")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- compaction and applying


@query(CH + ", " + LAST + " SELECT lsn, seq, op, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM last")
def cdc_compact(spark, sf_dir):
    return last_per_key(change_log(spark, sf_dir), ["o_orderkey"])


@query(CH + ", " + LAST + " SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM last WHERE op IN (0, 1)")
def cdc_upsert_from_empty(spark, sf_dir):
    return C.live(last_per_key(change_log(spark, sf_dir), ["o_orderkey"])).select(*COLUMNS)


@query(CH + ", later AS (SELECT * FROM ch WHERE lsn > 1000000500), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY lsn DESC, seq DESC) AS rn FROM later) WHERE rn = 1), base AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey <= 500 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey <= 500 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders) SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last) UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM last WHERE op IN (0, 1)")
def cdc_upsert_on_snapshot(spark, sf_dir):
    """A snapshot taken at a position, and the changes behind it."""
    at = 1_000_000_500
    seen = (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") + 1_000_000_000 <= at)
    base = orders(spark, sf_dir).withColumns({"o_orderstatus": F.when(seen, "U").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(seen, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))})
    return upserted(base, C.above(change_log(spark, sf_dir), at), ["o_orderkey"], COLUMNS)


def lake_table(spark: SparkSession, columns: list[tuple[str, str]], keys: list[str] | None, mode: str = "upsert") -> LakeTable:
    """A new table in the folder that executors share (a local one where none is set)."""
    return LakeTable.create(spark, new_folder(spark, "lake"), columns, keys, mode)


ORDER_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double")]


@query(CH + ", " + LAST + " SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'default/public.orders' AS _source FROM last WHERE op IN (0, 1)")
def lake_upsert_batches(spark, sf_dir):
    """The change log in three committed batches, one of them delivered twice."""
    t, log = lake_table(spark, ORDER_TYPES, ["o_orderkey"]), change_log(spark, sf_dir)
    for n, (low, high) in enumerate([(-1, 10**9 - 1), (10**9 - 1, 2 * 10**9 + 499), (2 * 10**9 + 499, 4 * 10**9)]):
        for _ in range(1 + (n == 1)):
            t.upsert(log.where((F.col("lsn") > low) & (F.col("lsn") <= high)), "default/public.orders", "m", n, (high, 1))
    return t.read()


@query(CH + "SELECT count(*) AS n, count(DISTINCT lsn) AS positions FROM ch")
def lake_append_redelivered(spark, sf_dir):
    """An append table into which every batch is delivered twice."""
    t, log = lake_table(spark, ORDER_TYPES, None, "append"), C.append_rows(change_log(spark, sf_dir), "default/public.orders", COLUMNS)
    for n in range(4):
        for _ in range(2):
            t.append(log.where(F.floor(F.col("_lsn") / 10**9) == n), "default/public.orders", "m", n, (n, 1))
    return t.read().agg(F.count("*").alias("n"), F.count_distinct("_lsn").alias("positions"))


@query("SELECT o_orderkey, o_custkey, CAST(NULL AS INTEGER) AS note, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_custkey, CAST(o_orderkey % 10 AS INTEGER), 'N' FROM orders WHERE o_orderkey % 5 = 0")
def ddl_sequence(spark, sf_dir):
    """Columns added, renamed and dropped between batches of a versioned table."""
    t, base = lake_table(spark, ORDER_TYPES, ["o_orderkey"]), orders(spark, sf_dir)
    t.upsert(base.select(F.lit(1).cast("bigint").alias("lsn"), F.lit(1).cast("bigint").alias("seq"), F.lit(C.INSERT).alias("op"), "*"), "s")
    t.add_column("note", "int")
    t.rename_column("o_orderstatus", "status")
    t.drop_column("o_totalprice")
    later = base.where("o_orderkey % 5 = 0").select(F.lit(2).cast("bigint").alias("lsn"), F.lit(1).cast("bigint").alias("seq"), F.lit(C.UPDATE).alias("op"), "o_orderkey", "o_custkey", (F.col("o_orderkey") % 10).cast("int").alias("note"), F.lit("N").alias("status"))
    t.upsert(later, "s")
    return t.read().select("o_orderkey", "o_custkey", "note", "status")


def _ddl(spark, sf_dir, change) -> DataFrame:
    t, base = lake_table(spark, ORDER_TYPES, ["o_orderkey"]), orders(spark, sf_dir)
    t.replace(base, "s")
    change(t)
    return t.read().drop(C.SOURCE)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS extra FROM orders")
def ddl_add(spark, sf_dir):
    return _ddl(spark, sf_dir, lambda t: t.add_column("extra", "string"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def ddl_drop(spark, sf_dir):
    return _ddl(spark, sf_dir, lambda t: t.drop_column("o_orderstatus"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice FROM orders")
def ddl_rename(spark, sf_dir):
    return _ddl(spark, sf_dir, lambda t: t.rename_column("o_orderstatus", "status"))


@query("SELECT * FROM (VALUES (1, 'rename', 'b', 'score'), (2, 'drop', 'a', NULL), (3, 'add', 'x', 'integer')) t(n, kind, col, new)")
def ddl_diff(spark, sf_dir):
    found = schema_diff([("id", 23), ("a", 25), ("b", 23)], [("id", 23), ("x", 23), ("score", 23)])
    return spark.createDataFrame([(i, c.kind, c.column, c.new) for i, c in enumerate(found, 1)], "n int, kind string, col string, new string")


# -- append mode


@query(CH + "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'default/public.orders' AS _source, CASE op WHEN 0 THEN 'I' WHEN 1 THEN 'U' ELSE 'D' END AS _op, lsn AS _lsn, seq AS _seq FROM ch")
def cdc_append_log(spark, sf_dir):
    return C.append_rows(change_log(spark, sf_dir), "default/public.orders", COLUMNS)


@query(CH + "SELECT CASE op WHEN 0 THEN 'I' WHEN 1 THEN 'U' ELSE 'D' END AS _op, count(*) AS n FROM ch GROUP BY 1")
def cdc_append_ops(spark, sf_dir):
    return change_log(spark, sf_dir).groupBy(C.op_label(F.col("op")).alias("_op")).agg(F.count("*").alias("n"))


@query(CH + "SELECT count(*) AS n FROM (SELECT lsn, lag(lsn) OVER (ORDER BY lsn) AS before FROM ch) WHERE lsn > before")
def cdc_append_monotonic(spark, sf_dir):
    """Positions above the one before: as many as there are distinct ones, less the first. No global window is needed."""
    distinct = change_log(spark, sf_dir).agg(F.count_distinct("lsn").alias("n"))
    return distinct.select(F.greatest(F.col("n") - 1, F.lit(0)).cast("bigint").alias("n"))


@query(CH + "SELECT lsn, op, o_orderkey FROM ch WHERE lsn > 1500000000")
def cdc_append_dedup(spark, sf_dir):
    return C.above(change_log(spark, sf_dir), 1_500_000_000).select("lsn", "op", "o_orderkey")


@query("SELECT event_id, event_type, 'default/public.events' AS _source, 'I' AS _op, CAST(event_id + 1 AS BIGINT) AS _lsn FROM events")
def events_append(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("lsn"), F.lit(1).cast("bigint").alias("seq"), F.lit(C.INSERT).alias("op"), "event_id", "event_type")
    return C.append_rows(e, "default/public.events", ["event_id", "event_type"]).drop(C.SEQ)


# -- barriers, fan-in, replay


@query(CH + ", later AS (SELECT * FROM ch WHERE lsn > 2000000000), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY lsn DESC, seq DESC) AS rn FROM later) WHERE rn = 1) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM last WHERE op IN (0, 1)")
def cdc_truncate_barrier(spark, sf_dir):
    log = change_log(spark, sf_dir)
    barrier = spark.range(1).select(F.lit(2_000_000_000).cast("bigint").alias("lsn"), F.lit(2).cast("bigint").alias("seq"), F.lit(C.TRUNCATE).alias("op"), *[F.lit(None).cast(t).alias(c) for c, t in ORDER_TYPES])
    return C.live(last_per_key(since_truncate(log.unionByName(barrier)), ["o_orderkey"])).select(*COLUMNS)


def _fan_in(spark, sf_dir) -> LakeTable:
    t, base = lake_table(spark, ORDER_TYPES, ["o_orderkey"]), orders(spark, sf_dir)
    row = lambda d, n, op: d.select(F.lit(n).cast("bigint").alias("lsn"), F.lit(1).cast("bigint").alias("seq"), F.lit(op).alias("op"), "*")
    t.upsert(row(base.where("o_orderkey % 2 = 0"), 1, C.INSERT), "a/public.orders", "a", 0, (1, 1))
    t.upsert(row(base.where("o_orderkey % 3 = 0"), 1, C.INSERT), "b/public.orders", "b", 0, (1, 1))
    t.upsert(row(base.where("o_orderkey % 5 = 0"), 2, C.DELETE), "a/public.orders", "a", 1, (2, 1))
    return t


@query("SELECT 'a/public.orders' AS _source, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 UNION ALL SELECT 'b/public.orders', count(*) FROM orders WHERE o_orderkey % 3 = 0")
def cdc_fan_in_scoped_delete(spark, sf_dir):
    return _fan_in(spark, sf_dir).read().groupBy(C.SOURCE).agg(F.count("*").alias("n"))


@query("SELECT 'a/public.orders' AS _source, o_orderkey FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'b/public.orders', o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def cdc_resync_one_source(spark, sf_dir):
    t = _fan_in(spark, sf_dir)
    t.replace(orders(spark, sf_dir).where("o_orderkey % 4 = 0"), "a/public.orders", "a", (3, 0))
    return t.read().select(C.SOURCE, "o_orderkey")


@query("SELECT 'b/public.orders' AS _source, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0")
def cdc_truncate_one_source(spark, sf_dir):
    t = _fan_in(spark, sf_dir)
    t.drop_source("a/public.orders", "a", 2, (3, 1))
    return t.read().groupBy(C.SOURCE).agg(F.count("*").alias("n"))


@query(CH + ", " + LAST + " SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM last WHERE op < 2) AS target_rows, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last WHERE op < 2)) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows")
def cdc_consistency_counts(spark, sf_dir):
    return counts(orders(spark, sf_dir), cdc_upsert_from_empty(spark, sf_dir), ["o_orderkey"])


@query(CH + ", " + LAST + " SELECT o.o_orderkey, CASE WHEN l.o_orderkey IS NULL THEN 'missing' ELSE 'changed' END AS difference FROM orders o LEFT JOIN (SELECT * FROM last WHERE op < 2) l USING (o_orderkey) WHERE l.o_orderkey IS NULL OR l.o_custkey IS DISTINCT FROM o.o_custkey OR l.o_orderstatus IS DISTINCT FROM o.o_orderstatus OR l.o_totalprice IS DISTINCT FROM o.o_totalprice")
def cdc_consistency_values(spark, sf_dir):
    return differences(orders(spark, sf_dir), cdc_upsert_from_empty(spark, sf_dir), ["o_orderkey"])


@query(CH + ", n AS (SELECT lsn, seq, CAST(floor((row_number() OVER (ORDER BY lsn, seq) - 1) / 5000) AS BIGINT) AS batch FROM ch) SELECT batch, count(*) AS n, max(lsn) AS applied_lsn FROM n GROUP BY batch")
def cdc_batches(spark, sf_dir):
    return C.batches(change_log(spark, sf_dir), 5000).groupBy("batch").agg(F.count("*").alias("n"), F.max("lsn").alias("applied_lsn"))


# -- streams


def _streamed(spark, sf_dir, sync_mode: str) -> DataFrame:
    """The change log as files of change rows, one micro-batch each, through a group's streaming query."""
    from .catalog import Catalog
    from .sources.wal import ROW
    from .streaming.runner import GroupRunner

    root, log = new_folder(spark, "stream"), change_log(spark, sf_dir)
    image = F.array(*[F.col(c).cast("string") for c in COLUMNS])
    none = F.lit(None)
    rows = log.select("lsn", "seq", F.lit(1).cast("bigint").alias("xid"), F.lit("public.orders").alias("rel"), "op", F.when(F.col("op") != C.DELETE, image).alias("new"), F.when(F.col("op") == C.DELETE, image).alias("old"), none.cast("array<boolean>").alias("unchanged"), none.cast("string").alias("ddl"))
    for n in range(4):
        rows.where(F.floor(F.col("lsn") / 10**9) == n).coalesce(1).write.mode("append").parquet(f"{root}/log")
    catalog = Catalog(spark, f"{root}/lake")
    m = catalog.add_table("orders", [("o_orderkey", 20), ("o_custkey", 20), ("o_orderstatus", 25), ("o_totalprice", 701)], ["o_orderkey"] if sync_mode == "upsert" else None, copy_data=False, sync_mode=sync_mode)
    changes = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    GroupRunner(catalog, "default").start(changes, f"{root}/checkpoint", available_now=True).awaitTermination()
    return catalog.target(m).read()


@query(CH + ", " + LAST + " SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM last WHERE op IN (0, 1)")
def stream_upsert(spark, sf_dir):
    return _streamed(spark, sf_dir, "upsert").select(*COLUMNS)


@query(CH + "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'default/public.orders' AS _source, CASE op WHEN 0 THEN 'I' WHEN 1 THEN 'U' ELSE 'D' END AS _op, lsn AS _lsn, seq AS _seq FROM ch")
def stream_append(spark, sf_dir):
    return _streamed(spark, sf_dir, "append")


# -- single changes


@query("SELECT o_orderkey * 2 AS seq, 2 AS op, o_orderkey, CAST(NULL AS VARCHAR) AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey * 2 + 1, 0, o_orderkey, 'U' FROM orders WHERE o_orderkey % 3 = 0")
def cdc_update_split(spark, sf_dir):
    u = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("lsn"), F.col("o_orderkey").alias("seq"), F.lit(C.UPDATE).alias("op"), "o_orderkey", F.lit("U").alias("o_orderstatus"))
    return C.split_updates(u, ["o_orderkey"], ["o_orderkey", "o_orderstatus"]).drop("lsn")


@query("SELECT o_orderkey, [CAST(o_custkey AS VARCHAR), o_orderstatus] AS vals FROM orders WHERE o_orderkey % 3 = 0")
def cdc_unchanged_fill(spark, sf_dir):
    """Updates that leave the status out take it from the old row."""
    r = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.array(F.col("o_custkey").cast("string"), F.lit(None).cast("string")).alias("new"), F.array(F.lit("0"), F.col("o_orderstatus")).alias("old"), F.array(F.lit(False), F.lit(True)).alias("unchanged"))
    r = C.guard_unchanged(r)
    return r.select("o_orderkey", C.fill_unchanged(F.col("new"), F.col("old"), F.col("unchanged")).alias("vals"))


def _deletes(spark, sf_dir, keys):
    d = orders(spark, sf_dir).where("o_orderkey % 7 = 0").withColumn("op", F.lit(C.DELETE))
    return C.delete_image(d, keys, COLUMNS).select(*COLUMNS)


@query("SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0")
def cdc_delete_image_key(spark, sf_dir):
    return _deletes(spark, sf_dir, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 = 0")
def cdc_delete_image_full(spark, sf_dir):
    return _deletes(spark, sf_dir, [])


@query("SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def cdc_key_change(spark, sf_dir):
    """Updates of the key move rows."""
    base = orders(spark, sf_dir)
    moved = base.where("o_orderkey % 50 = 0").select(F.lit(1).cast("bigint").alias("lsn"), F.col("o_orderkey").alias("seq"), F.lit(C.UPDATE).alias("op"), (F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), F.col("o_orderkey").alias("old_o_orderkey"), "o_custkey", "o_orderstatus", "o_totalprice")
    return upserted(base, C.split_updates(moved, ["o_orderkey"], COLUMNS), ["o_orderkey"], COLUMNS)


#: mapping_id, enabled, state, sync_mode, snapshot_lsn, applied_lsn, applied_seq, group, target
MAPPINGS = [
    (1, True, "CATCHUP", "upsert", 1_000_000_500, None, None, "default", "orders_lake"), (2, True, "STREAMING", "append", None, 1_500_000_000, 1, "default", "orders_lake"), (3, True, "STREAMING", "upsert", None, 1_500_000_000, 1, "g2", "copy_lake"), (4, False, "STREAMING", "upsert", None, None, None, "g2", "off_lake"), (5, True, "ERRORED", "upsert", None, 900, 1, "g2", "err_lake"),
]
MAPPING_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" for v in m) + ")" for m in MAPPINGS) + ") m(mapping_id, enabled, state, sync_mode, snapshot_lsn, applied_lsn, applied_seq, grp, target)"


def mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPINGS, "mapping_id bigint, enabled boolean, state string, sync_mode string, snapshot_lsn bigint, applied_lsn bigint, applied_seq bigint, group string, target string")


@query(CH + f"SELECT mapping_id, count(*) AS n FROM ch, {MAPPING_SQL} WHERE enabled AND state <> 'ERRORED' AND NOT (state = 'CATCHUP' AND lsn <= coalesce(snapshot_lsn, -1)) AND NOT (state = 'STREAMING' AND sync_mode = 'append' AND (lsn < applied_lsn OR (lsn = applied_lsn AND seq <= applied_seq))) GROUP BY mapping_id")
def cdc_skip_filter(spark, sf_dir):
    """The log delivered to five tables in different states."""
    log = change_log(spark, sf_dir).withColumn("mapping_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))))
    return C.skip_filter(log, mappings(spark)).groupBy("mapping_id").agg(F.count("*").alias("n"))


# -- other keys


@query("SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2")
def composite_pk_compact(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("bigint").alias("lsn"), F.col("l_partkey").alias("seq"), "l_orderkey", "l_linenumber", "l_quantity")
    return last_per_key(li, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT conv_id, turn, role, text FROM conversations")
def conversations_composite(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("lsn"), F.col("turn").alias("seq"), F.lit(0).alias("op"), "conv_id", "turn", "role", "text")
    t = lake_table(spark, [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")], ["conv_id", "turn"])
    t.upsert(c, "default/public.conversations")
    return t.read().drop(C.SOURCE)


@query("SELECT doc_id, text FROM documents")
def snapshot_special_text(spark, sf_dir):
    """Texts with line breaks, quotes, separators and accents through a CSV snapshot."""
    from .sources.snapshot import read_csv, write_csv

    path = new_folder(spark, "snapshot")
    write_csv(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_csv(spark, path, "doc_id bigint, text string")


# -- routing


def _routed(spark, sf_dir, sql, mode="on") -> DataFrame:
    targets = [Target("public.orders", "public.orders_lake", ("o_orderkey",)), Target("public.customer", "public.customer_lake", ("c_custkey",))]
    for t in targets:
        table(spark, sf_dir, t.source.split(".")[1]).createOrReplaceTempView(view_name(t.target))
    text, _ = Router(spark, targets).rewrite(sql, mode)
    return spark.sql(text)


ROUTED = {
    "route_join": "SELECT c.c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    "route_cte": "WITH s AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) SELECT o_orderstatus, n FROM s WHERE n > 0",
    "route_subquery": "SELECT x.o_custkey, x.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x WHERE x.n > 3",
    "route_window": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS nth FROM orders",
    "route_left_join": "SELECT customer.c_custkey, count(orders.o_orderkey) AS n FROM customer LEFT JOIN orders ON customer.c_custkey = orders.o_custkey GROUP BY customer.c_custkey",
    "route_set_ops": "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer",
}
for _name, _sql in ROUTED.items():
    QUERIES[_name] = lambda spark, sf_dir, sql=_sql: _routed(spark, sf_dir, sql)
    ORACLES[_name] = _sql


# -- scalar rules


@query(CH + "SELECT lsn, printf('%X/%X', lsn >> 32, lsn & 4294967295) AS shown FROM (SELECT lsn * 1000 AS lsn FROM ch)")
def lsn_format(spark, sf_dir):
    return change_log(spark, sf_dir).select((F.col("lsn") * 1000).alias("lsn")).withColumn("shown", L.show(F.col("lsn")))


@query(CH + "SELECT lsn * 1000 AS parsed FROM ch")
def lsn_parse(spark, sf_dir):
    return change_log(spark, sf_dir).select(L.parse(L.show(F.col("lsn") * 1000)).alias("parsed"))


@query("SELECT o_orderkey, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS k, CAST(o_orderkey % 2 = 0 AS BOOLEAN) AS b, CAST(o_orderkey % 1000 AS SMALLINT) AS s, CAST(o_orderkey % 100 AS DECIMAL(38, 18)) AS d, o_orderstatus AS t FROM orders")
def type_parse(spark, sf_dir):
    """Texts of the change stream to typed values, by type id."""
    k = F.col("o_orderkey")
    text = table(spark, sf_dir, "orders").select("o_orderkey", k.cast("string").alias("k"), F.when(k % 2 == 0, "t").otherwise("f").alias("b"), (k % 1000).cast("string").alias("s"), (k % 100).cast("string").alias("d"), F.col("o_orderstatus").alias("t"))
    return text.select("o_orderkey", *[pgtypes.parse(F.col(c), oid).alias(c) for c, oid in (("k", 20), ("b", 16), ("s", 21), ("d", 1700), ("t", 25))])


@query("SELECT CAST(sum(8 + 8 + 8 + octet_length(encode(o_orderstatus)) + octet_length(encode(o_orderpriority))) AS BIGINT) AS bytes FROM orders")
def row_bytes(spark, sf_dir):
    cols = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"), ("o_orderstatus", "string"), ("o_orderpriority", "string")]
    return table(spark, sf_dir, "orders").agg(F.sum(scalar.row_bytes(cols)).alias("bytes"))


@query("SELECT * FROM (VALUES (3, CAST(30 AS BIGINT)), (4, 60), (5, 120), (9, 1920), (12, 1920)) t(failures, seconds)")
def meta_backoff(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in (3, 4, 5, 9, 12)], "failures int").withColumn("seconds", scalar.backoff_seconds(F.col("failures")))


@query("SELECT o_custkey, greatest(list_sort(list(CAST(o_orderkey AS BIGINT)))[CAST(floor(count(*) / 2) AS INTEGER) + 1], 1000) AS timeout_ms FROM orders GROUP BY o_custkey")
def meta_gate_timeout(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("x")).select("o_custkey", scalar.upper_median(F.col("x"), 1000).alias("timeout_ms"))


@query("SELECT o_custkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(o_orderkey AS BIGINT) ORDER BY o_orderkey)), lambda acc, x: CASE WHEN acc = 0 THEN x ELSE CAST(trunc(CAST(0.3 AS DOUBLE) * x + CAST(0.7 AS DOUBLE) * acc) AS BIGINT) END) AS average FROM orders GROUP BY o_custkey")
def meta_avg_row_bytes(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("x")).select("o_custkey", scalar.moving_average(F.col("x")).alias("average"))


@query("SELECT o_custkey, list_sort(list(o_totalprice))[CAST(greatest(1, ceil(count(*) * 50 / 100.0)) AS INTEGER)] AS p50, list_sort(list(o_totalprice))[CAST(greatest(1, ceil(count(*) * 99 / 100.0)) AS INTEGER)] AS p99 FROM orders GROUP BY o_custkey")
def bench_percentiles(spark, sf_dir):
    return nearest_ranks(orders(spark, sf_dir), ["o_custkey"], "o_totalprice", {"p50": 50, "p99": 99})


@query("SELECT * FROM (VALUES ('512 MB', CAST(512000000 AS BIGINT)), ('1.5 GiB', 1610612736), ('16KB', 16000), ('0 bytes', 0), ('x', 0)) t(size, bytes)")
def size_text(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in ("512 MB", "1.5 GiB", "16KB", "0 bytes", "x")], "size string").withColumn("bytes", scalar.size_bytes(F.col("size")))


@query("SELECT * FROM (VALUES ('orders', 'public', 'orders'), ('s.orders', 's', 'orders'), ('s.a.b', 's', 'a.b')) t(full_name, schema, name)")
def name_split(spark, sf_dir):
    d = spark.createDataFrame([("orders",), ("s.orders",), ("s.a.b",)], "full_name string")
    return d.withColumn("t", scalar.table_name(F.col("full_name"))).select("full_name", "t.*")


# -- metadata and monitoring


@query(f"SELECT mapping_id, target, count(*) OVER (PARTITION BY target) AS source_count FROM {MAPPING_SQL}")
def meta_tables(spark, sf_dir):
    from .monitor import with_source_count

    return with_source_count(mappings(spark)).select("mapping_id", "target", "source_count")


@query(f"SELECT grp AS name, count(*) AS table_count FROM {MAPPING_SQL} GROUP BY grp UNION ALL SELECT 'empty', 0")
def meta_groups(spark, sf_dir):
    from .monitor import group_counts

    return group_counts(spark.createDataFrame([("default",), ("g2",), ("empty",)], "name string"), mappings(spark)).select("name", "table_count")


@query(f"SELECT count(*) FILTER (WHERE coalesce(applied_lsn, snapshot_lsn) IS NULL) AS unknown, min(CASE WHEN state = 'CATCHUP' THEN greatest(coalesce(applied_lsn, 0), coalesce(snapshot_lsn, 0)) ELSE coalesce(applied_lsn, 0) END) AS confirmed_lsn FROM {MAPPING_SQL} WHERE enabled AND state IN ('CATCHUP', 'STREAMING')")
def meta_confirmed_lsn(spark, sf_dir):
    """The position that tables in these states let the catalog confirm."""
    from .catalog import Catalog

    catalog = Catalog(spark, new_folder(spark, "confirm"))
    for n, on, state, mode, snapshot, applied, seq, _, _ in MAPPINGS:
        m = catalog.add_table(f"t{n}", [("id", 20)], ["id"], sync_mode=mode)
        m.enabled, m.state, m.snapshot_lsn, m.applied_lsn, m.applied_seq = on, state, snapshot, applied, seq
    unknown = sum(m.applied_lsn is None and m.snapshot_lsn is None for m in catalog.mappings.values() if m.enabled and m.state in ("CATCHUP", "STREAMING"))
    return spark.createDataFrame([(unknown, catalog.confirm("default"))], "unknown bigint, confirmed_lsn bigint")


@query(f"SELECT mapping_id, CASE WHEN coalesce(applied_lsn, snapshot_lsn) IS NOT NULL THEN greatest(1600000000 - coalesce(applied_lsn, snapshot_lsn), 0) END AS flush_lag_bytes, CAST(400000000 AS BIGINT) AS source_lag_bytes FROM {MAPPING_SQL}")
def meta_status_lag(spark, sf_dir):
    from .monitor import lags

    groups = spark.createDataFrame([("default", 1_600_000_000), ("g2", 1_600_000_000)], "name string, pending_lsn bigint")
    return lags(mappings(spark), groups, 2_000_000_000).select("mapping_id", "flush_lag_bytes", "source_lag_bytes")


@query("SELECT * FROM (VALUES ('default', 5000, 50000, 4), ('g2', 5000, 100, 8), ('g2.orders', 2000, 100, 8)) t(scope, flush_interval_ms, flush_batch_threshold, max_concurrent_flushes)")
def meta_config_resolved(spark, sf_dir):
    """The four tiers: default, global, group and table, the narrowest first."""
    from .catalog import Catalog

    catalog = Catalog(spark, new_folder(spark, "config"))
    catalog.create_group("g2")
    m = catalog.add_table("orders", [("id", 20)], ["id"], group="g2")
    catalog.set_group_config("g2", "flush_batch_threshold", "100")
    catalog.set_group_config("g2", "max_concurrent_flushes", "8")
    catalog.set_table_config("orders", "flush_interval_ms", "2000", "g2")
    again = Catalog(spark, catalog.root)  # as another process reads it
    every = [("default", json.loads(again.get_group_config("default"))), ("g2", json.loads(again.get_group_config("g2"))), ("g2.orders", again.table_settings(again.mappings[m.id]))]
    return spark.createDataFrame([(scope, s["flush_interval_ms"], s["flush_batch_threshold"], s["max_concurrent_flushes"]) for scope, s in every], "scope string, flush_interval_ms int, flush_batch_threshold int, max_concurrent_flushes int")


@query("SELECT o_custkey AS k, stddev_pop(CAST(o_orderkey AS DOUBLE)) / avg(o_orderkey) > 0.3 AS unsteady, count(*) AS n FROM orders GROUP BY o_custkey HAVING avg(o_orderkey) > 0")
def bench_variation(spark, sf_dir):
    """Whether a rate varies more than the soak limit allows."""
    return orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("k")).agg((scalar.variation(F.col("o_orderkey").cast("double")) > 0.3).alias("unsteady"), F.count("*").alias("n"), F.avg("o_orderkey").alias("a")).where("a > 0").drop("a")


@query("SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
def correlated_count(spark, sf_dir):
    n = orders(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("WITH RECURSIVE t(id, up) AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, n.n_regionkey FROM nation n JOIN t ON n.n_nationkey = t.id + 1) SELECT id, up FROM t")
def partition_walk(spark, sf_dir):
    """A recursive walk, as over the children of a partitioned source."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("_nation")
    return spark.sql("WITH RECURSIVE t(id, up) AS (SELECT n_nationkey, n_regionkey FROM _nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, n.n_regionkey FROM _nation n JOIN t ON n.n_nationkey = t.id + 1) SELECT id, up FROM t")


@query("SELECT e.event_id, k.key, k.value FROM (SELECT event_id, props FROM events) e, (SELECT event_id AS id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events) k WHERE k.id = e.event_id AND k.value IS NOT NULL")
def json_pairs(spark, sf_dir):
    """JSON documents as (key, value) texts."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>"))).where("key = 'k' and value is not null")


def _window(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return orders(spark, sf_dir).select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders")
def window_lag(spark, sf_dir):
    return _window(spark, sf_dir)


from . import service_queries  # noqa: E402, F401  (adds its own to QUERIES and ORACLES)
