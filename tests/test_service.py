"""The REST surface, background snapshots, and plans."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from tablesync import queries
from tablesync.catalog import Catalog
from tablesync.monitor import worker_status
from tablesync.rest import Service, serve
from tablesync.sources import wal
from tests.test_engine import COLS, World, R, rows


def call(server, method, path, body=None):
    host, port = server.server_address
    r = urllib.request.Request(f"http://{host}:{port}{path}", json.dumps(body).encode() if body is not None else None, method=method)
    try:
        with urllib.request.urlopen(r) as got:
            return got.status, json.loads(got.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_rest(spark, tmp_path):
    c = Catalog(spark, f"{tmp_path}/lake")
    service = Service(c)
    server = serve(service)
    try:
        assert call(server, "GET", "/health") == (200, {"status": "ok", "group": None})
        assert call(server, "POST", "/tables", {})[0] == 400 and call(server, "GET", "/status")[0] == 400
        assert call(server, "POST", "/groups", {"name": "g"})[0] == 200
        assert call(server, "POST", "/groups", {"name": "h"})[0] == 409
        with pytest.raises(Exception, match="another server"):
            Service(c, "g")
        table = {"source_table": "t", "columns": [["id", 23], ["val", 25]], "keys": ["id"]}
        assert call(server, "POST", "/tables", table)[0] == 200 and call(server, "POST", "/tables", table)[0] == 409
        assert call(server, "POST", "/tables", {**table, "source_table": "u", "keys": []})[0] == 400
        assert call(server, "GET", "/tables")[1][0]["source"] == "public.t" and call(server, "GET", "/status")[1][0]["state"] == "SNAPSHOT"
        assert call(server, "GET", "/metrics")[1]["tables"][0]["source"] == "public.t"
        assert call(server, "POST", "/groups/disable")[1]["enabled"] is False and not c.group("g").enabled
        assert call(server, "POST", "/groups/enable")[0] == 200
        assert call(server, "POST", "/tables/t/resync")[0] == 200 and call(server, "POST", "/tables/zz/resync")[0] == 404
        assert call(server, "DELETE", "/tables/t?drop_target=true")[0] == 200 and not c.store.exists("public.t_lake")
        assert call(server, "DELETE", "/groups")[0] == 200 and call(server, "GET", "/nowhere")[0] == 404
    finally:
        server.shutdown()


def test_background_snapshot_holds_only_its_table(spark, tmp_path):
    go = threading.Event()

    def snapshot(m):
        if m.source == "public.slow":
            go.wait(60)
        return spark.createDataFrame([(100, "snap")], "id int, val string"), 0

    w = World(spark, str(tmp_path))
    w.runner = type(w.runner)(w.catalog, "default", snapshot, background=True)
    w.catalog.add_table("slow", COLS, ["id"])
    w.catalog.add_table("t", COLS, ["id"], copy_data=False)
    slow = wal.Relation(2, "public", "slow", COLS, key=[0])
    w.log.transaction(wal.encode_relation(R), wal.encode_relation(slow), wal.encode_insert(1, [1, "a"]), wal.encode_insert(2, [1, "a"]))
    w.go()
    assert rows(w.read("t"), "id") == [(1,)] and w.catalog.find("slow").state == "SNAPSHOT"
    held = worker_status(w.catalog).first()
    assert held.queued_changes == 2 and held.queued_bytes == 2 and not held.backpressure
    go.set()
    w.runner.snapshots.wait()
    w.log.transaction(wal.encode_insert(2, [2, "b"]))
    w.go()
    assert rows(w.read("slow"), "id") == [(1,), (2,), (100,)] and w.catalog.find("slow").state == "STREAMING"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """What the plans of the main queries must show: pruned scans, pushed filters, no needless shuffle."""
    data = "/root/testdata/sf0.001"
    log = plan(queries.change_log(spark, data))
    assert "o_orderdate" not in log and "Exchange" not in log
    compact = plan(queries.QUERIES["cdc_compact"](spark, data))
    assert compact.count("hashpartitioning") == 1 and "WindowGroupLimit" in compact
    dedup = plan(queries.QUERIES["cdc_append_dedup"](spark, data))
    assert "Exchange" not in dedup
    deletes = plan(queries.QUERIES["cdc_delete_image_key"](spark, data))
    assert "Exchange" not in deletes


def test_lake_scan_is_pruned(spark, tmp_path):
    from tablesync.sources.lake import LakeTable

    t = LakeTable.create(spark, f"{tmp_path}/t", [("id", "int"), ("val", "string"), ("n", "int")], ["id"])
    t.replace(spark.createDataFrame([(i, "x", i) for i in range(100)], "id int, val string, n int"), "a")
    p = plan(t.read().where("n > 50").select("id"))
    assert "GreaterThan(c3,50)" in p and "c2" not in p.split("ReadSchema")[1]
