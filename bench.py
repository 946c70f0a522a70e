"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is written to Spark's noop sink: once to warm up, then the faster of two runs. Rates that
compare with a row store's snapshots and flushes are given beside them: medians of five flushes of a size, then
a read that merges their deltas, the compaction and a read behind it.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tablesync import queries as engine

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Rows of the flushes that are timed.
FLUSHES = (500, 1_750, 4_250, 50_000)
HEADLINE = [
    "cdc_compact", "cdc_upsert_from_empty", "cdc_upsert_on_snapshot", "lake_upsert_batches", "lake_append_redelivered", "cdc_append_log", "cdc_append_dedup", "cdc_truncate_barrier", "cdc_fan_in_scoped_delete", "cdc_resync_one_source", "cdc_key_change", "cdc_skip_filter", "cdc_consistency_values", "cdc_batches", "composite_pk_compact", "ddl_sequence", "route_join", "route_cte",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            engine.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        taken[name] = round(min(times[1:]), 3)
    rates = {}
    orders = engine.orders(spark, SF_DIR)  # not cached: reading the source counts
    n = orders.count()
    table = engine.lake_table(spark, engine.ORDER_TYPES, ["o_orderkey"])
    table.replace(orders, "a", "a", (0, 0))
    began = time.perf_counter()
    table.replace(orders, "a", "a", (1, 0))
    rates["snapshot_s"] = round(time.perf_counter() - began, 3)
    rates["snapshot_rows_per_s"] = round(n / (time.perf_counter() - began))
    for rows in FLUSHES:
        # updates spread over all keys, read from files, as many as the baseline's flushes have
        step = max(1, n // rows)
        folder = engine.new_folder(spark, "bench")
        orders.selectExpr("cast(1 as bigint) lsn", "o_orderkey seq", "1 op", "*").where(f"pmod(xxhash64(o_orderkey), {step}) = 0").limit(rows).write.parquet(folder)
        changes = spark.read.parquet(folder)
        size = changes.count()
        times = []
        for k in range(5):
            began = time.perf_counter()
            table.upsert(changes, "a", "a", 10 * rows + k, (1, 1))
            times.append(time.perf_counter() - began)
        median = sorted(times)[2]
        rates[f"flush_{rows}_s"] = round(median, 3)
        rates[f"flush_{rows}_rows_per_s"] = round(size / median)
    for what, step in (("merged", table.read), ("compact", table.compact), ("read_after_compact", table.read)):
        began = time.perf_counter()
        got = step()
        if what != "compact":
            got.write.format("noop").mode("overwrite").save()
        rates[f"{what}_s"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds_of_headline_queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "rates": rates, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
