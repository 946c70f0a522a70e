"""The service around the operators as queries: log, runner, catalog, settings, monitoring, routing; each with its result in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions import pgtypes, scalar
from .monitor import groups, lags, metrics, status, tables, worker_status
from .operators import changes as C
from .plans.routing import Router, Target
from .queries import CH, COLUMNS, LAST, MAPPING_SQL, ORDER_TYPES, change_log, lake_table, mappings, orders, query, table
from .sources import wal
from .sources.shared import new_folder
from .streaming.gate import FlushGate
from .streaming.runner import GroupRunner

PG_COLUMNS = [("o_orderkey", 20), ("o_custkey", 20), ("o_orderstatus", 25), ("o_totalprice", 701)]


def change_rows(log: DataFrame, rel: str = "public.orders", columns: list[str] = COLUMNS) -> DataFrame:
    """A typed change log as rows of the replication source."""
    image, none = F.array(*[F.col(c).cast("string") for c in columns]), F.lit(None)
    return log.select("lsn", "seq", F.lit(1).cast("bigint").alias("xid"), F.lit(rel).alias("rel"), "op", F.when(F.col("op") != C.DELETE, image).alias("new"), F.when(F.col("op") == C.DELETE, image).alias("old"), none.cast("array<boolean>").alias("unchanged"), none.cast("string").alias("ddl"))


def barrier(spark: SparkSession, lsn: int, op: int, rel: str, ddl: str | None = None) -> DataFrame:
    return spark.createDataFrame([(lsn, 1, 1, rel, op, None, None, None, ddl)], wal.ROW)


def failure(work) -> str:
    """Kind and text of what work raises; `done` if nothing."""
    try:
        work()
    except ValueError as e:
        return f"{type(e).__name__}: {e}"
    return "done"


# -- the replication log


@query("SELECT n_nationkey AS id, n_name AS name, 0 AS op FROM nation UNION ALL SELECT n_nationkey, 'new ' || n_name, 1 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, NULL, 2 FROM nation WHERE n_nationkey % 5 = 0")
def wal_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the replication protocol, decoded: one insert, update or delete a message."""
    rel = wal.Relation(7, "public", "nation", [("id", 23), ("name", 25)], key=[0])
    names = {r.n_nationkey: r.n_name for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()}
    messages = [wal.encode_relation(rel), *[wal.encode_insert(7, [k, v]) for k, v in names.items()], *[wal.encode_update(7, [k, f"new {v}"], [k, v]) for k, v in names.items() if k % 2 == 0], *[wal.encode_delete(7, [k, None]) for k in names if k % 5 == 0]]
    decoder, rows = wal.Decoder(), []
    for n, m in enumerate([wal.encode_begin(1, 1), *messages, wal.encode_commit(500, 501)]):
        rows += decoder.feed(n, m)
    d = spark.createDataFrame([r for r in rows if r[4] <= C.DELETE], wal.ROW)
    image = F.when(F.col("op") == C.DELETE, F.col("old")).otherwise(F.col("new"))
    return d.select(F.get(image, F.lit(0)).cast("bigint").alias("id"), F.get(image, F.lit(1)).alias("name"), "op")


@query("SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name FROM nation WHERE n_nationkey % 3 <> 0")
def wal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log folder read in bounded batches of whole transactions by the streaming source, applied to a table."""
    root = new_folder(spark, "wal").removeprefix("file://")
    spark.dataSource.register(wal.WalSource)
    rel, writer = wal.Relation(7, "public", "nation", [("id", 23), ("name", 25)], key=[0]), wal.LogWriter(f"{root}/log")
    rows = [(r.n_nationkey, r.n_name) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]
    for i in range(0, len(rows), 4):
        writer.transaction(*([wal.encode_relation(rel)] if not i else []), *[wal.encode_insert(7, list(r)) for r in rows[i : i + 4]])
    writer.transaction(*[wal.encode_delete(7, [k, None]) for k, _ in rows if k % 3 == 0])
    catalog = Catalog(spark, f"{root}/lake")
    catalog.set_config("flush_batch_threshold", "9")
    m = catalog.add_table("nation", rel.columns, ["id"], copy_data=False)
    runner = GroupRunner(catalog, "default")
    runner.start(runner.changes(f"{root}/log"), f"{root}/checkpoint").processAllAvailable()
    catalog.stop_worker("default")
    return catalog.target(m).read().select("id", "name")


# -- the runner


@query(CH + ", later AS (SELECT * FROM ch WHERE lsn > 1000000500), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY lsn DESC, seq DESC) AS rn FROM later) WHERE rn = 1), base AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey <= 500 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey <= 500 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders) SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last) UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM last WHERE op IN (0, 1)")
def runner_snapshot_catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes held while a table waits for its snapshot; then what the snapshot holds is passed over, the rest applied."""
    at, log = 1_000_000_500, change_log(spark, sf_dir)
    seen = (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") + 1_000_000_000 <= at)
    base = orders(spark, sf_dir).withColumns({"o_orderstatus": F.when(seen, "U").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(seen, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))})
    catalog = Catalog(spark, new_folder(spark, "catchup"))
    m, runner = catalog.add_table("orders", PG_COLUMNS, ["o_orderkey"]), GroupRunner(catalog, "default")
    for n in range(4):
        if n == 2:
            runner.snapshot = lambda _: (base, at)
        runner.apply(change_rows(log.where(F.floor(F.col("lsn") / 10**9) == n)), n)
    return catalog.target(m).read().select(*COLUMNS)


@query("SELECT 'SNAPSHOT' AS waiting, true AS held, 'CATCHUP' AS loaded, 'STREAMING' AS passed, CAST(0 AS BIGINT) AS left_over")
def runner_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that a table passes from waiting for its snapshot to streaming."""
    catalog, log = Catalog(spark, new_folder(spark, "states")), change_log(spark, sf_dir).where("o_orderkey < 50")
    m, runner = catalog.add_table("orders", PG_COLUMNS, ["o_orderkey"]), GroupRunner(catalog, "default")
    runner.apply(change_rows(log.where("lsn < 1000000000")), 0)
    waiting, held = m.state, m.queued_changes > 0
    runner.snapshot = lambda _: (orders(spark, sf_dir).where("o_orderkey < 50"), 1_500_000_000)
    runner.take_snapshot(m)
    loaded = m.state
    runner.apply(change_rows(log.where("lsn > 2000000000")), 1)
    return spark.createDataFrame([(waiting, held, loaded, m.state, m.queued_changes)], "waiting string, held boolean, loaded string, passed string, left_over bigint")


@query(CH + "SELECT o_orderkey, CASE op WHEN 0 THEN 'I' WHEN 1 THEN 'U' ELSE 'D' END AS _op, lsn AS _lsn FROM ch")
def runner_append_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truncate in the log leaves an append table as it is, and a batch that comes again adds nothing."""
    catalog, log = Catalog(spark, new_folder(spark, "truncated")), change_log(spark, sf_dir)
    m, runner = catalog.add_table("orders", PG_COLUMNS, None, copy_data=False, sync_mode="append"), GroupRunner(catalog, "default")
    for n in range(4):
        rows = change_rows(log.where(F.floor(F.col("lsn") / 10**9) == n))
        for _ in range(1 + (n == 1)):
            runner.apply(rows.unionByName(barrier(spark, 2_500_000_000, C.TRUNCATE, "public.orders")) if n == 2 else rows, n)
    return catalog.target(m).read().select("o_orderkey", "_op", "_lsn")


@query("SELECT o_orderkey, o_custkey AS customer, o_totalprice FROM orders WHERE o_orderkey < 1000")
def runner_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A renamed table and column and a dropped column: the mapping and the target follow."""
    catalog, rows = Catalog(spark, new_folder(spark, "renamed")), change_log(spark, sf_dir).where("lsn < 1000")
    m, runner = catalog.add_table("orders", PG_COLUMNS, ["o_orderkey"], copy_data=False), GroupRunner(catalog, "default")
    new = [("o_orderkey", 20), ("customer", 20), ("o_totalprice", 701)]
    ddl = json.dumps({"id": 1, "was": "public.orders", "old": PG_COLUMNS, "new": new})
    runner.apply(change_rows(rows.where("o_orderkey % 2 = 0")), 0)
    late = change_rows(rows.where("o_orderkey % 2 = 1").withColumn("lsn", F.col("lsn") + 5000), "public.purchases", ["o_orderkey", "o_custkey", "o_totalprice"])
    runner.apply(late.unionByName(barrier(spark, 4000, C.SCHEMA, "public.purchases", ddl)), 1)
    found = catalog.find("purchases")
    return catalog.target(found).read().where(F.lit(found.id == m.id)).select("o_orderkey", "customer", "o_totalprice")


@query("SELECT * FROM (VALUES (1, 'STREAMING', 1, CAST(NULL AS DOUBLE)), (2, 'STREAMING', 2, NULL), (3, 'ERRORED', 3, 1030.0), (4, 'ERRORED', 3, 1030.0), (5, 'STREAMING', 3, NULL)) t(step, state, failures, retry_at)")
def runner_failure_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three failures in a row stop a table, and it is tried again when its wait is over."""
    now = [1000.0]
    catalog = Catalog(spark, new_folder(spark, "failing"), clock=lambda: now[0])
    m, rows = catalog.add_table("orders", PG_COLUMNS, ["o_orderkey"], copy_data=False), []
    m.applied_lsn = 5
    for step in range(1, 6):
        if step <= 3:
            catalog.failed(m, "source is down")
        else:
            now[0] = 1029.0 if step == 4 else 1030.0
            catalog.retry_due()
        rows.append((step, m.state, m.failures, m.retry_at))
    return spark.createDataFrame(rows, "step int, state string, failures int, retry_at double")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def lake_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table emptied in whole, then filled again."""
    t, rows = lake_table(spark, ORDER_TYPES, ["o_orderkey"]), orders(spark, sf_dir)
    t.replace(rows, "a")
    t.truncate()
    t.replace(rows.where("o_orderkey % 5 = 0"), "a")
    return t.read().select("o_orderkey")


@query(CH + ", " + LAST + " SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM last WHERE op IN (0, 1)")
def lake_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several commits, compacted and cleaned up: the rows are the same."""
    t, log = lake_table(spark, ORDER_TYPES, ["o_orderkey"]), change_log(spark, sf_dir)
    first = log.where("lsn < 1000000000")
    edges = first.agg(F.percentile_approx("o_orderkey", [0.25, 0.5, 0.75])).first()[0]
    for n, (low, high) in enumerate(zip([-1, *edges], [*edges, 2**60], strict=True)):
        t.upsert(first.where((F.col("o_orderkey") > low) & (F.col("o_orderkey") <= high)), "a", "m", n, (n, 0))
    t.upsert(log.where("lsn >= 1000000000"), "a", "m", 9, (9, 0))
    t.compact(1)
    t.vacuum()
    return t.read().select(*COLUMNS)


@query("SELECT o_orderkey, [o_orderkey % 2 = 0] AS unchanged FROM orders WHERE o_orderkey % 3 = 0")
def cdc_unchanged_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass the guard, as their old image is there."""
    d = orders(spark, sf_dir).where("o_orderkey % 3 = 0").withColumns({"old": F.array(F.col("o_orderstatus")), "unchanged": F.array(F.col("o_orderkey") % 2 == 0)})
    return C.guard_unchanged(d).select("o_orderkey", "unchanged")


# -- scalars


@query("SELECT o_orderkey, CAST(least(greatest(o_orderkey // 2, 100), 2000) AS BIGINT) AS wait_ms FROM orders")
def poll_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", scalar.poll_wait_ms(F.col("o_orderkey")).alias("wait_ms"))


@query("""SELECT n_name, 'default/public.' || n_name AS label, '"' || replace(n_name || '"', '"', '""') || '"' AS ident, '''' || replace('it''s ' || n_name, '''', '''''') || '''' AS literal FROM nation""")
def names_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r.n_name for r in table(spark, sf_dir, "nation").select("n_name").collect()]
    return spark.createDataFrame([(n, scalar.source_label("default", "public", n), scalar.quote_ident(n + '"'), scalar.quote_literal(f"it's {n}")) for n in rows], "n_name string, label string, ident string, literal string")


@query("SELECT * FROM (VALUES ('host=h password=*** user=u'), ('postgres://u:***@h/db'), ('password=***'), ('host=h')) t(shown)")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ["host=h password=secret user=u", "postgres://u:secret@h/db", "password='se cret'", "host=h"]
    return spark.createDataFrame([(scalar.redact(x),) for x in given], "shown string")


@query("SELECT * FROM (VALUES (16, 'boolean'), (20, 'bigint'), (21, 'smallint'), (23, 'integer'), (25, 'text'), (701, 'double precision'), (1082, 'date'), (1114, 'timestamp'), (1700, 'numeric'), (2950, 'uuid'), (1007, 'integer[]'), (1009, 'text[]'), (99999, 'text')) t(oid, name)")
def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(oid, pgtypes.type_name(oid)) for oid in (16, 20, 21, 23, 25, 701, 1082, 1114, 1700, 2950, 1007, 1009, 99999)], "oid int, name string")


@query("SELECT o_custkey AS k, CAST(round(regr_slope(o_totalprice, CAST(o_orderkey AS DOUBLE)) * 1000) AS BIGINT) AS slope FROM orders GROUP BY o_custkey HAVING count(*) > 5 AND max(o_orderkey) > min(o_orderkey)")
def bench_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("k"))
    d = g.agg(F.round(scalar.slope(F.col("o_totalprice"), F.col("o_orderkey").cast("double")) * 1000).cast("bigint").alias("slope"), F.count("*").alias("n"), F.max("o_orderkey").alias("b"), F.min("o_orderkey").alias("a"))
    return d.where("n > 5 and b > a").select("k", "slope")


@query("SELECT CAST(20 AS INTEGER) AS average_ms, CAST(2000 AS INTEGER) AS timeout_ms, CAST(1 AS INTEGER) AS refused")
def gate_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average wait, timeout from the last flushes, and one that was not admitted in time."""
    gate = FlushGate(1)
    gate.waits, gate.waited_ms = 3, 60.0
    average = gate.average_wait_ms()
    for ms in (500.0, 3000.0, 2000.0):
        gate.acquire()
        gate.release(ms)
    gate.acquire()
    gate.acquire(0.01)
    return spark.createDataFrame([(average, gate.timeout_ms(), gate.timeouts)], "average_ms int, timeout_ms int, refused int")


# -- catalog


@query("SELECT * FROM (VALUES ('default', 'sync_pub_default', true, 'bgworker', CAST(0 AS BIGINT)), ('g2', 'my_pub', false, 'daemon', 1)) t(name, publication, enabled, mode, table_count)")
def catalog_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups created, disabled, enabled and dropped, as another process reads them."""
    c = Catalog(spark, new_folder(spark, "groups"))
    c.create_group("g2", "my_pub", mode="daemon")
    c.create_group("g3")
    c.add_table("orders", PG_COLUMNS, ["o_orderkey"], group="g2")
    c.add_table("customer", [("id", 20)], ["id"], group="g3")
    c.disable_group("default")
    c.disable_group("g2")
    c.enable_group("default")
    c.drop_group("g3")
    return groups(Catalog(spark, c.root)).select("name", "publication", "enabled", "mode", "table_count")


@query("""SELECT * FROM (VALUES ('public.a', 'public.a_lake', 'g2', 'default/public.a', CAST(1 AS BIGINT)), ('s.b', 's.shared', 'default', 'default/s.b', 2), ('s.c', 's.shared', 'default', 'default/s.x', 2)) t(source, target, grp, label, source_count)""")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables added, moved, renamed and removed; two that share a target. Labels stay."""
    c = Catalog(spark, new_folder(spark, "tables"))
    c.create_group("g2")
    for name, target, fan_in in (("a", None, False), ("s.b", "s.shared", False), ("s.x", "s.shared", True), ("gone", None, False)):
        c.add_table(name, PG_COLUMNS, ["o_orderkey"], target, fan_in=fan_in)
    c.move_table("a", "g2")
    c.rename_source(c.find("s.x").id, "s.c")
    c.remove_table("gone", drop_target=True)
    return tables(c).select("source", "target", F.col("group").alias("grp"), "label", "source_count")


@query("""SELECT * FROM (VALUES ('no group', 'NotFound: Sync group ''nope'' not found'), ('no key', 'CatalogError: table public.t has no primary key; upsert needs one, use sync_mode => ''append'''), ('twice', 'Conflict: table public.orders is already in group ''default'''),
    ('same target', 'Conflict: target table public.orders_lake already has an active source (source: public.orders); set fan_in => true to add another'), ('fan-in', 'CatalogError: fan-in schema mismatch: source public.t has 1 columns, target public.orders_lake has 4'),
    ('unknown key', 'ConfigError: unknown table config key: ''x''. Valid keys: duckdb_flush_memory_mb, duckdb_threads, flush_batch_threshold, flush_interval_ms, routing_enabled'), ('negative', 'ConfigError: ''flush_interval_ms'' must be positive, got -5'), ('not a number', 'ConfigError: ''duckdb_threads'' must be an integer, got ''many''')) t(attempt, answer)""")
def catalog_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog refuses, and in which words."""
    c = Catalog(spark, new_folder(spark, "guards"))
    c.add_table("orders", PG_COLUMNS, ["o_orderkey"])
    attempts = {
        "no group": lambda: c.add_table("t", PG_COLUMNS, ["o_orderkey"], group="nope"), "no key": lambda: c.add_table("t", PG_COLUMNS), "twice": lambda: c.add_table("orders", PG_COLUMNS, ["o_orderkey"]), "same target": lambda: c.add_table("t", PG_COLUMNS, ["o_orderkey"], "orders_lake"),
        "fan-in": lambda: c.add_table("t", [("id", 20)], ["id"], "orders_lake", fan_in=True), "unknown key": lambda: c.set_table_config("orders", "x", "1"), "negative": lambda: c.set_config("flush_interval_ms", "-5"), "not a number": lambda: c.set_config("duckdb_threads", "many"),
    }
    return spark.createDataFrame([(k, failure(f)) for k, f in attempts.items()], "attempt string, answer string")


@query("SELECT * FROM (VALUES ('global', '7000'), ('group', '300'), ('table', '2000'), ('routing', 'false'), ('set twice', '9')) t(what, value)")
def catalog_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings written by two processes by turns: those of both are kept."""
    one = Catalog(spark, new_folder(spark, "settings"))
    one.add_table("orders", PG_COLUMNS, ["o_orderkey"])
    two = Catalog(spark, one.root)
    one.set_config("flush_interval_ms", "7000")
    two.set_group_config("default", "flush_batch_threshold", "300")
    one.set_config("duckdb_threads", "8")
    one.set_config("duckdb_threads", "9")
    two.set_table_config("orders", "routing_enabled", "false")
    two.set_table_config("orders", "flush_interval_ms", "2000")
    c = Catalog(spark, one.root)
    return spark.createDataFrame([("global", c.get_config("flush_interval_ms")), ("group", c.get_group_config("default", "flush_batch_threshold")), ("table", c.get_table_config("orders", "flush_interval_ms")), ("routing", c.get_table_config("orders", "routing_enabled")), ("set twice", c.get_config("duckdb_threads"))], "what string, value string")


@query("SELECT * FROM (VALUES ('before', CAST(0 AS BIGINT), 'SNAPSHOT', CAST(NULL AS BIGINT)), ('snapshot', 0, 'CATCHUP', NULL), ('passed', 700, 'STREAMING', 700), ('resync', 700, 'SNAPSHOT', NULL)) t(step, confirmed, state, applied)")
def catalog_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmed position follows what is durable and never goes back; a resync starts the table anew."""
    c = Catalog(spark, new_folder(spark, "progress"))
    m, rows, g = c.add_table("orders", PG_COLUMNS, ["o_orderkey"]), [], c.group("default")

    def step(name: str) -> None:
        rows.append((name, g.confirmed_lsn, m.state, m.applied_lsn))

    step("before")
    c.snapshotted(m, 500, 10, 5)
    step("snapshot")
    g.pending_lsn = 700
    c.caught_up("default")
    c.applied(m, (700, 1), 3, 2)
    c.confirm("default")
    step("passed")
    c.resync_table("orders")
    c.confirm("default")
    step("resync")
    return spark.createDataFrame(rows, "step string, confirmed bigint, state string, applied bigint")


# -- monitoring


@query("""SELECT * FROM (VALUES ('default', true, CAST(7 AS BIGINT), CAST(2000 AS BIGINT), CAST(1000 AS BIGINT), true, CAST(0 AS BIGINT)), ('g2', false, 0, 0, 1000000000, false, 1)) t(grp, running, queued_changes, queued_bytes, max_queued_bytes, backpressure, errored_tables)""")
def meta_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, new_folder(spark, "workers"))
    c.create_group("g2")
    a, b = c.add_table("orders", PG_COLUMNS, ["o_orderkey"]), c.add_table("t", PG_COLUMNS, ["o_orderkey"], group="g2")
    a.queued_changes, a.queued_bytes, b.state = 7, 2000, "ERRORED"
    c.set_group_config("default", "max_queued_bytes", "1000")
    c.start_worker()
    c.stop_worker("g2")
    return worker_status(c).select(F.col("group").alias("grp"), "running", "queued_changes", "queued_bytes", "max_queued_bytes", "backpressure", "errored_tables")


@query("SELECT 'public.orders' AS source, 'STREAMING' AS state, CAST(12 AS BIGINT) AS rows_synced, CAST(300 AS BIGINT) AS flush_lag_bytes, CAST(1000 AS BIGINT) AS source_lag_bytes")
def meta_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics document, read back, where the status says the same."""
    c = Catalog(spark, new_folder(spark, "metrics"))
    m = c.add_table("orders", PG_COLUMNS, ["o_orderkey"], copy_data=False)
    c.applied(m, (700, 1), 12, 5)
    c.group("default").pending_lsn = 1000
    kind = "array<struct<source: string, state: string, rows_synced: bigint, flush_lag_bytes: bigint, source_lag_bytes: bigint>>"
    read = spark.range(1).select(F.explode(F.from_json(F.get_json_object(F.lit(metrics(c, 2000)), "$.tables"), kind)).alias("t")).select("t.*")
    return read.intersect(status(c, 2000).select(*read.columns))


@query(f"""SELECT grp, CAST(sum(CASE WHEN coalesce(applied_lsn, snapshot_lsn) IS NOT NULL THEN greatest(1600000000 - coalesce(applied_lsn, snapshot_lsn), 0) ELSE 0 END) AS BIGINT) AS lag_bytes FROM {MAPPING_SQL} GROUP BY grp""")
def meta_lag_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = spark.createDataFrame([("default", 1_600_000_000), ("g2", 1_600_000_000)], "name string, pending_lsn bigint")
    return lags(mappings(spark), by, 2_000_000_000).groupBy(F.col("group").alias("grp")).agg(F.coalesce(F.sum("flush_lag_bytes"), F.lit(0)).cast("bigint").alias("lag_bytes"))


# -- routing


@query("SELECT * FROM (VALUES ('off', 0), ('on', 1), ('auto, scan', 1), ('auto, point', 0), ('auto, point reversed', 0), ('auto, aggregate of a point', 1), ('auto, half a key', 1), ('insert', 0), ('in a subquery', 0), ('alias', 1)) t(statement, routed)")
def route_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements are routed in which mode."""
    router = Router(spark, [Target("public.orders", "public.orders_lake", ("o_orderkey",)), Target("public.lineitem", "public.lineitem_lake", ("l_orderkey", "l_linenumber"))])
    asked = [
        ("off", "SELECT * FROM orders", "off"), ("on", "SELECT * FROM orders WHERE o_orderkey = 5", "on"), ("auto, scan", "SELECT * FROM orders", "auto"), ("auto, point", "SELECT * FROM orders WHERE o_orderkey = 5", "auto"), ("auto, point reversed", "SELECT * FROM public.orders WHERE 5 = o_orderkey AND o_custkey > 2", "auto"),
        ("auto, aggregate of a point", "SELECT count(*) FROM orders WHERE o_orderkey = 5", "auto"), ("auto, half a key", "SELECT * FROM lineitem WHERE l_orderkey = 5", "auto"), ("insert", "INSERT INTO x SELECT * FROM orders", "on"), ("in a subquery", "SELECT 1 WHERE 1 IN (SELECT o_orderkey FROM orders)", "on"), ("alias", "SELECT a.o_orderkey FROM orders AS a", "on"),
    ]
    return spark.createDataFrame([(name, len(router.decisions(sql, mode))) for name, sql, mode in asked], "statement string, routed int")
