"""The sync engine on small inputs: logs, tables, catalog, runner, routing."""

import json

import pytest

from tablesync.catalog import Catalog, CatalogError, Conflict, NotFound
from tablesync.monitor import groups, metrics, status, tables, worker_status
from tablesync.operators import changes as C
from tablesync.plans.routing import CatalogRouter, Router, Target
from tablesync.sources import wal
from tablesync.sources.lake import LakeTable
from tablesync.streaming.gate import FlushGate
from tablesync.streaming.runner import GroupRunner

COLS = [("id", 23), ("val", 25)]
R = wal.Relation(1, "public", "t", COLS, key=[0])


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


class World:
    def __init__(self, spark, root, snapshot=None):
        self.spark, self.root = spark, root
        spark.dataSource.register(wal.WalSource)
        self.catalog, self.log = Catalog(spark, f"{root}/lake"), wal.LogWriter(f"{root}/wal")
        self.runner = GroupRunner(self.catalog, "default", snapshot)

    def go(self, most=100):
        stream = self.spark.readStream.format("tablesync_wal").option("path", f"{self.root}/wal").option("maxMessages", most).load()
        q = self.runner.start(stream, f"{self.root}/checkpoint")
        q.processAllAvailable()
        q.stop()

    def read(self, source="t"):
        return self.catalog.target(self.catalog.find(source)).read()


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, str(tmp_path))


def test_stream(world):
    world.catalog.add_table("t", COLS, ["id"], copy_data=False)
    world.log.transaction(wal.encode_relation(R), wal.encode_insert(1, [1, "one"]), wal.encode_insert(1, [2, "two"]))
    world.log.transaction(wal.encode_update(1, [2, "updated_two"], [2, "two"]), wal.encode_delete(1, [1, "one"]))
    world.go(3)
    assert rows(world.read(), "id", "val") == [(2, "updated_two")]
    m = world.catalog.find("t")
    assert (m.state, m.rows_synced, m.failures) == ("STREAMING", 4, 0)
    assert world.catalog.group("default").confirmed_lsn == world.log.lsn
    world.log.transaction(wal.encode_insert(1, [3, None]), wal.encode_insert(1, [4, ""]))
    world.go()  # restarts from the checkpoint
    assert rows(world.read(), "id", "val") == [(2, "updated_two"), (3, None), (4, "")]


def test_mixed_changes_in_one_transaction(world):
    world.catalog.add_table("t", [*COLS, ("num", 23)], ["id"], copy_data=False)
    r = wal.Relation(1, "public", "t", [*COLS, ("num", 23)], key=[0])
    world.log.transaction(wal.encode_relation(r), *[wal.encode_insert(1, [i, f"v{i}", i]) for i in range(1, 201)])
    world.log.transaction(*[wal.encode_update(1, [i, f"v{i}", i * 10], [i, f"v{i}", i]) for i in range(1, 101)])
    world.log.transaction(*[wal.encode_delete(1, [i, f"v{i}", i]) for i in range(151, 201)])
    world.log.transaction(*[wal.encode_insert(1, [i, "n", 0]) for i in range(201, 251)], *[wal.encode_update(1, [i, "u", 1], [i, "", 0]) for i in range(50, 71)], *[wal.encode_delete(1, [i, "", 0]) for i in range(140, 151)])
    world.go()
    assert world.read().count() == 189


def test_snapshot_then_stream_without_overlap(spark, tmp_path):
    w = World(spark, str(tmp_path), lambda m: (spark.createDataFrame([(1, "snap"), (2, "snap")], "id int, val string"), 5))
    w.catalog.add_table("t", COLS, ["id"])
    w.log.transaction(wal.encode_relation(R), wal.encode_insert(1, [1, "old"]))  # ends at 5: the snapshot has it
    w.log.transaction(wal.encode_update(1, [2, "new"], [2, "snap"]))
    w.go()
    assert rows(w.read(), "id", "val") == [(1, "snap"), (2, "new")]
    assert w.catalog.find("t").state == "STREAMING"


def test_changes_wait_for_a_snapshot(spark, tmp_path):
    w = World(spark, str(tmp_path))
    w.catalog.add_table("t", COLS, ["id"])
    w.log.transaction(wal.encode_relation(R), wal.encode_insert(1, [1, "a"]))
    w.go()
    assert w.read().count() == 0 and w.catalog.find("t").queued_changes == 2
    w.runner.snapshot = lambda m: (spark.createDataFrame([], "id int, val string"), 0)
    w.log.transaction(wal.encode_insert(1, [2, "b"]))
    w.go()
    assert rows(w.read(), "id") == [(1,), (2,)]


def test_failure_is_held_and_retried(spark, tmp_path):
    def broken(m):
        raise RuntimeError("source is down")

    w = World(spark, str(tmp_path), broken)
    now = [1000.0]
    w.catalog.clock = lambda: now[0]
    w.catalog.add_table("t", COLS, ["id"])
    for i in range(3):
        w.log.transaction(*([wal.encode_relation(R)] if not i else []), wal.encode_insert(1, [i, "x"]))
        w.go()
    m = w.catalog.find("t")
    assert (m.state, m.failures, m.error, m.retry_at) == ("ERRORED", 3, "source is down", 1030.0)
    w.runner.snapshot = lambda m: (spark.createDataFrame([], "id int, val string"), 0)
    now[0] = 1031.0
    w.log.transaction(wal.encode_insert(1, [9, "x"]))
    w.go()
    assert rows(w.read(), "id") == [(0,), (1,), (2,), (9,)] and m.failures == 0


def test_schema_barriers(world):
    world.catalog.add_table("t", [("id", 23), ("a", 25)], ["id"], copy_data=False)
    rel = lambda *c: wal.encode_relation(wal.Relation(1, "public", "t", [("id", 23), *c], key=[0]))
    world.log.transaction(rel(("a", 25)), wal.encode_insert(1, [1, "a1"]))
    world.log.transaction(rel(("a", 25), ("b", 23)), wal.encode_insert(1, [2, "a2", 2]))
    world.log.transaction(rel(("b", 23)), wal.encode_insert(1, [3, 3]))
    world.log.transaction(rel(("score", 23)), wal.encode_insert(1, [4, 4]), wal.encode_update(1, [2, 20], [2, 2]))
    world.go()
    assert rows(world.read(), "id", "score") == [(1, None), (2, 20), (3, 3), (4, 4)]
    world.log.transaction(rel(("score", 25)), wal.encode_insert(1, [5, "x"]))
    world.go()
    m = world.catalog.find("t")
    assert m.state == "ERRORED" and "changed its type" in m.error


def test_truncate_and_append_mode(world):
    world.catalog.add_table("t", COLS, ["id"], copy_data=False)
    world.catalog.add_table("log", COLS, None, copy_data=False, sync_mode="append")
    log = wal.Relation(2, "public", "log", COLS)
    world.log.transaction(wal.encode_relation(R), wal.encode_relation(log), *[wal.encode_insert(k, [1, "a"]) for k in (1, 2)], wal.encode_insert(2, [1, "b"]))
    world.log.transaction(wal.encode_truncate([1, 2]), *[wal.encode_insert(k, [2, "c"]) for k in (1, 2)], wal.encode_update(2, [2, "d"], [2, "c"]), wal.encode_delete(2, [2, "d"]))
    world.go()
    assert rows(world.read("t"), "id") == [(2,)]
    assert rows(world.read("log"), "id", "val", "_op") == [(1, "a", "I"), (1, "b", "I"), (2, "c", "I"), (2, "d", "D"), (2, "d", "U")]
    before = world.read("log").count()
    world.runner.apply(world.spark.createDataFrame([(99, 1, 1, "public.log", 0, ["7", "z"], None, [False, False], None)], wal.ROW), 0)  # an old batch again
    assert world.read("log").count() == before


def test_rename_and_unchanged_columns(world):
    world.catalog.add_table("t", COLS, ["id"], copy_data=False)
    world.log.transaction(wal.encode_relation(R), wal.encode_insert(1, [1, "x" * 10000]))
    world.log.transaction(wal.encode_relation(wal.Relation(1, "public", "t2", COLS, key=[0])), wal.encode_update(1, [5, None], [1, "x" * 10000], [False, True]))
    world.go()
    assert [(i, len(v)) for i, v in rows(world.read("t2"), "id", "val")] == [(5, 10000)]
    world.log.transaction(wal.encode_update(1, [5, None], None, [False, True]))
    world.go()
    assert "REPLICA IDENTITY FULL" in world.catalog.find("t2").error


def test_fan_in(world, spark):
    c = world.catalog
    c.create_group("a"), c.create_group("b")
    c.add_table("orders_a", COLS, ["id"], "orders_lake", "a", copy_data=False)
    with pytest.raises(Conflict, match="already has an active source"):
        c.add_table("orders_b", COLS, ["id"], "orders_lake", "b")
    with pytest.raises(CatalogError, match="schema mismatch"):
        c.add_table("orders_bad", [("id", 23), ("price", 1700)], ["id"], "orders_lake", "b", fan_in=True)
    with pytest.raises(CatalogError, match="schema mismatch"):
        c.add_table("orders_bad", [("id", 20), ("val", 25)], ["id"], "orders_lake", "b", fan_in=True)
    c.add_table("orders_b", COLS, ["id"], "orders_lake", "b", copy_data=False, fan_in=True)
    t = c.target(c.find("orders_a"))
    for name, group in (("orders_a", "a"), ("orders_b", "b")):
        t.upsert(spark.createDataFrame([(1, 1, 0, 1, name), (1, 2, 0, 2, name)], "lsn bigint, seq bigint, op int, id int, val string"), c.find(name).label)
    assert t.read().count() == 4 and {r.source_count for r in tables(c).collect()} == {2}
    c.resync_table("orders_a")
    assert rows(t.read(), "val") == [("orders_b",), ("orders_b",)]
    c.remove_table("orders_a", drop_target=True)
    assert t.read().count() == 2  # the other source still feeds it
    c.find("orders_b").state = "STREAMING"
    assert [x.source for x in CatalogRouter(c).targets()] == ["public.orders_b"]


def test_catalog_rules(world):
    c = world.catalog
    with pytest.raises(CatalogError, match="no primary key"):
        c.add_table("nopk", COLS)
    with pytest.raises(NotFound, match="Sync group 'zz' not found"):
        c.add_table("t", COLS, ["id"], group="zz")
    with pytest.raises(CatalogError, match="invalid sync_mode"):
        c.add_table("t", COLS, ["id"], sync_mode="x")
    with pytest.raises(NotFound, match="sync group 'nonexistent' does not exist"):
        c.set_group_config("nonexistent", "duckdb_threads", "2")
    c.create_group("g2")
    c.add_table("t", COLS, ["id"])
    c.add_table("t", COLS, ["id"], "other", "g2")
    with pytest.raises(CatalogError, match="in several groups"):
        c.find("t")
    with pytest.raises(Conflict):
        c.move_table("t", "g2", "default")
    c.set_config("duckdb_threads", "4"), c.set_group_config("g2", "duckdb_threads", "8"), c.set_table_config("t", "duckdb_threads", "2", "default")
    assert (c.get_table_config("t", "duckdb_threads", "default"), c.get_table_config("t", "duckdb_threads", "g2"), c.get_config("duckdb_threads")) == ("2", "8", "4")
    assert c.get_table_config("t", "routing_enabled", "g2") == "true" and c.get_config("nonexistent_key") is None
    again = Catalog(world.spark, c.root)
    assert again.groups.keys() == c.groups.keys() and again.find("t", "g2").label == "g2/public.t"
    assert c.start_worker() == 2 and c.stop_worker("g2") == 1
    c.drop_group("g2")
    assert c.find("t").group == "default"


def test_monitoring(world):
    c = world.catalog
    c.add_table("t", COLS, ["id"])
    c.find("t").applied_lsn, c.group("default").pending_lsn = 100, 150
    s = status(c, 200).first()
    assert (s.flush_lag_bytes, s.source_lag_bytes, s.source_count) == (50, 50, 1)
    assert groups(c).first().table_count == 1 and worker_status(c).count() == 1
    m = json.loads(metrics(c, 200))
    assert m["tables"][0]["source"] == "public.t" and m["groups"][0]["name"] == "default"


def test_routing(spark):
    r = Router(spark, [Target("public.orders", "public.orders_lake", ("id",)), Target("public.cust", "public.cust_lake", ("id",))])
    n = lambda sql, mode="on": len(r.decisions(sql, mode))
    assert n("SELECT * FROM orders", "off") == 0 and n("SELECT * FROM orders") == 1
    assert n("INSERT INTO x SELECT * FROM orders") == 0
    assert n("WITH orders AS (SELECT 1 AS id) SELECT * FROM orders") == 0
    assert n("WITH a AS (SELECT * FROM orders) SELECT * FROM a JOIN cust c ON a.id = c.id") == 2
    assert n("SELECT * FROM other WHERE id IN (SELECT id FROM orders)") == 0
    assert n("SELECT * FROM (SELECT * FROM orders WHERE id = 1) x", "auto") == 0
    assert n("SELECT * FROM orders WHERE id = 1", "auto") == 0 and n("SELECT * FROM orders WHERE id IN (1, 2)", "auto") == 0
    assert n("SELECT count(*) FROM orders WHERE id = 1", "auto") == 1 and n("SELECT * FROM orders WHERE total = 1", "auto") == 1
    assert n("SELECT * FROM orders o, cust c WHERE o.id = c.id", "auto") == 2 and n("SELECT * FROM orders o, cust c WHERE o.id = 3", "auto") == 0
    assert n("SELECT DISTINCT id FROM orders WHERE id = 1", "auto") == 1
    text, _ = r.rewrite("SELECT orders.id FROM public.orders WHERE orders.id > 1", "on")
    assert text == "SELECT orders.id FROM `public__orders_lake` AS `orders` WHERE orders.id > 1"


def test_lake_versions(spark, tmp_path):
    t = LakeTable.create(spark, f"{tmp_path}/t", [("id", "int"), ("val", "string")], ["id"], buckets=4)
    ch = lambda *r: spark.createDataFrame(list(r), "lsn bigint, seq bigint, op int, id int, val string")
    t.upsert(ch(*[(1, i, 0, i, "a") for i in range(50)]), "s", "m", 0, (1, 50))
    t.upsert(ch((2, 1, 2, 7, None), (2, 2, 1, 8, "b")), "s", "m", 1, (2, 2))
    before = t.version()
    t.upsert(ch((2, 1, 2, 9, None)), "s", "m", 1, (2, 2))  # the same batch number again
    assert t.version().number == before.number and t.read().count() == 49 and t.read(1).count() == 50
    for n in range(2, 6):
        t.upsert(ch((n + 1, 1, 0, 100 + n, "c")), "s", "m", n, (n + 1, 1))
    assert t.read().count() == 53
    want = rows(t.read(), "id", "val")
    t.rebucket(7)
    assert rows(t.read(), "id", "val") == want and t.version().buckets == 7
    t.upsert(ch((50, 1, 1, 8, "again")), "s", "m", 50, (50, 1))
    want = [(i, "again" if i == 8 else v) for i, v in want]
    t.compact(0)
    assert rows(t.read(), "id", "val") == want and t.vacuum() > 0 and rows(t.read(), "id", "val") == want
    with pytest.raises(ValueError, match="primary key"):
        LakeTable.create(spark, f"{tmp_path}/n", [("id", "int")])
    with pytest.raises(ValueError, match="key column"):
        t.drop_column("id")


def test_deltas_against_a_dictionary(spark, tmp_path, monkeypatch):
    """Batches of random changes, compacted in between, against a dictionary; two sources of one target."""
    import random

    from tablesync.sources import lake

    monkeypatch.setattr(lake, "FOLD_BYTES", 0)
    draw = random.Random(7)
    t = LakeTable.create(spark, f"{tmp_path}/t", [("id", "bigint"), ("val", "string")], ["id"], buckets=4)
    t.replace(spark.range(300).selectExpr("id", "'x' val"), "a", "a", (0, 0))
    want = {("a", i): "x" for i in range(300)}
    seen = []
    for n in range(12):
        monkeypatch.setattr(lake, "FOLD_SHARE", 1 if n == 8 else 0)
        label, batch = draw.choice("aab"), []
        for seq in range(draw.randrange(1, 30)):
            op, key = draw.choice((0, 1, 2)), draw.randrange(330)
            batch.append((n, seq, op, key, f"{n}.{seq}"))
            if op == 2:
                want.pop((label, key), None)
            else:
                want[label, key] = f"{n}.{seq}"
        t.upsert(spark.createDataFrame(batch, "lsn bigint, seq bigint, op int, id int, val string"), label, label, n, (n, 99))
        seen.append((t.version().number, dict(want)))
        if n in (5, 8, 10):
            t.compact(1)
    for number, then in [*seen[::4], (None, want)]:
        assert rows(t.read(number), "_source", "id", "val") == sorted((s, i, v) for (s, i), v in then.items())
    one = rows(t.read(source="a", buckets=[2]), "id") + rows(t.read(source="a", buckets=[0, 1, 3]), "id")
    assert sorted(one) == [(i,) for s, i in sorted(want) if s == "a"]
    assert {"fold", "merge deltas"} <= {r.operation for r in t.history().collect()}
    t.rename_column("val", "value")
    t.add_column("more", "int")
    t.upsert(spark.createDataFrame([(50, 1, 1, 3, "z", 5), (50, 2, 0, 1000, "y", 6)], "lsn bigint, seq bigint, op int, id int, value string, more int"), "a", "a", 50, (50, 2))
    assert t.read(source="a").where("id = 3 OR id = 1000").selectExpr("sum(more) s", "max(value) v").first() == (11, "z")
    t.upsert(spark.createDataFrame([], "lsn bigint, seq bigint, op int, id int, value string, more int"), "a", "a", 51, (51, 0))
    assert t.version().txn["a"]["batch"] == 51
    t.drop_source("a")
    assert t.read(source="a").count() == 0 and t.read().count() == sum(s == "b" for s, _ in want)
    t.truncate()
    assert t.read().count() == 0


def test_a_flush_costs_its_batch(spark, tmp_path):
    """Updates of random keys write bytes in proportion to the batch and rewrite no bucket."""
    t = LakeTable.create(spark, f"{tmp_path}/t", [("id", "bigint"), ("val", "string")], ["id"])
    t.replace(spark.range(400_000).selectExpr("id", "sha2(cast(id AS string), 256) val"), "a", "a", (0, 0))
    base = t.version()
    changes = spark.range(1000).selectExpr("1L lsn", "id seq", "1 op", "id * 397 AS id", "'new' val")
    t.upsert(changes, "a", "a", 1, (1, 1))
    t.compact()
    now = t.version()
    assert now.parts == base.parts and sum(n for _, n in now.deltas["a"]) * 100 < base.size["a"]
    assert t.read().where("val = 'new'").count() == 1000 and t.read().count() == 400_000


def test_key_change_and_shared_position(spark):
    log = spark.createDataFrame([(1, 1, 0, 1, None, "a"), (2, 1, 1, 5, 1, "b"), (2, 2, 1, 5, None, "c")], "lsn bigint, seq bigint, op int, id int, old_id int, val string")
    from tablesync.operators.compact import last_per_key

    got = C.live(last_per_key(C.split_updates(log, ["id"], ["id", "val"]), ["id"]))
    assert rows(got, "id", "val") == [(5, "c")]


def test_gate():
    g = FlushGate(1)
    assert g.timeout_ms() == 1000 and g.acquire()
    assert not g.acquire(0.05) and g.timeouts == 1
    g.release(5000)
    assert g.timeout_ms() == 5000 and g.acquire(0.05)


def test_decoder_errors():
    d = wal.Decoder()
    with pytest.raises(wal.WalError):
        d.feed(1, wal.encode_insert(9, [1]))
    with pytest.raises(wal.WalError):
        d.feed(1, b"I\0")
    assert d.feed(1, b"") == []


def test_two_processes_keep_each_others_changes(spark, tmp_path):
    one = Catalog(spark, str(tmp_path))
    m = one.add_table("t", COLS, ["id"], copy_data=False)
    two = Catalog(spark, str(tmp_path))
    two.create_group("g2")
    one.applied(m, (70, 1), 5, 1)
    two.set_table_config("t", "flush_interval_ms", "300")
    two.set_config("duckdb_threads", "3")
    one.failed(m, "x")
    again = Catalog(spark, str(tmp_path))
    t = again.find("t")
    assert (t.applied_lsn, t.failures, t.config, again.get_config("duckdb_threads")) == (70, 1, {"flush_interval_ms": 300}, "3") and "g2" in again.groups
    two.drop_group("g2")
    one.set_config("duckdb_threads", "4")
    assert "g2" not in one.groups and Catalog(spark, str(tmp_path)).get_config("duckdb_threads") == "4"
    assert one.find("t") is m


def test_reading_waits_while_what_is_held_is_too_much(spark, tmp_path):
    import threading

    w = World(spark, str(tmp_path))
    w.catalog.set_config("max_queued_bytes", "5")
    w.catalog.set_config("drain_poll_ms", "20")
    w.catalog.add_table("t", COLS, ["id"])
    batch = lambda i, lsn: spark.createDataFrame([(lsn, 1, 1, "public.t", C.INSERT, [str(i), "long enough"], None, None, None)], wal.ROW)
    w.runner.apply(batch(1, 10), 0)
    assert w.runner.full()
    waiting = threading.Thread(target=w.runner.apply, args=(batch(2, 20), 1))
    waiting.start()
    waiting.join(1)
    assert waiting.is_alive() and w.read().count() == 0
    w.runner.snapshot = lambda m: (spark.createDataFrame([], "id int, val string"), 0)
    waiting.join(60)
    assert not waiting.is_alive() and w.runner.pauses == 1 and rows(w.read(), "id") == [(1,), (2,)] and not w.runner.full()


def test_worker_is_stopped_and_started(world):
    world.catalog.add_table("t", COLS, ["id"], copy_data=False)
    world.log.transaction(wal.encode_relation(R), wal.encode_insert(1, [1, "one"]))
    q = world.runner.start(world.runner.changes(f"{world.root}/wal"), f"{world.root}/checkpoint")
    q.processAllAvailable()
    assert world.catalog.stop_worker("default") == 1 and not q.isActive and world.runner.query is None
    world.log.transaction(wal.encode_insert(1, [2, "two"]))
    assert world.catalog.start_worker("default") == 1
    world.runner.query.processAllAvailable()
    assert rows(world.read(), "id") == [(1,), (2,)]
    world.catalog.stop_worker("default")
