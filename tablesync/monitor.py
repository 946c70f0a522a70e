"""Monitoring frames: groups, tables, status, workers, and metrics as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions.lsn import behind


def groups(catalog: Catalog) -> DataFrame:
    return group_counts(catalog.groups_frame(), catalog.mappings_frame())


def group_counts(groups: DataFrame, mappings: DataFrame) -> DataFrame:
    """Groups with their number of tables."""
    n = mappings.groupBy(F.col("group").alias("name")).agg(F.count("*").alias("table_count"))
    return groups.join(n, "name", "left").withColumn("table_count", F.coalesce("table_count", F.lit(0).cast("bigint")))


def with_source_count(mappings: DataFrame) -> DataFrame:
    """Mappings with the number of sources of their target."""
    return mappings.withColumn("source_count", F.count("*").over(Window.partitionBy("target")))


def tables(catalog: Catalog) -> DataFrame:
    m = with_source_count(catalog.mappings_frame())
    return m.select("source", "target", "group", "enabled", "rows_synced", F.timestamp_seconds("last_sync_at").alias("last_sync_at"), "label", "source_count")


def lags(mappings: DataFrame, groups: DataFrame, source_lsn: int) -> DataFrame:
    """Mappings with flush_lag_bytes (group read, table not yet applied) and source_lag_bytes (source written, group not yet read)."""
    g = groups.select(F.col("name").alias("group"), "pending_lsn")
    known = F.coalesce("applied_lsn", "snapshot_lsn")
    return mappings.join(F.broadcast(g), "group").withColumns({
        "flush_lag_bytes": F.when(known.isNotNull() & (F.col("pending_lsn") > 0), behind(F.col("pending_lsn"), known)),
        "source_lag_bytes": F.when(F.col("pending_lsn") > 0, behind(F.lit(source_lsn).cast("bigint"), F.col("pending_lsn"))),
    })


def status(catalog: Catalog, source_lsn: int = 0) -> DataFrame:
    m = with_source_count(lags(catalog.mappings_frame(), catalog.groups_frame(), source_lsn))
    return m.select("source", "target", "group", "label", "sync_mode", "state", "enabled", "rows_synced", "queued_changes", "snapshot_lsn", "applied_lsn", "failures", "error", "flush_lag_bytes", "source_lag_bytes", F.timestamp_seconds("last_sync_at").alias("last_sync_at"), "source_count")


def worker_status(catalog: Catalog) -> DataFrame:
    """Groups with what they hold back; backpressure: that reaches the group's limit."""
    m = catalog.mappings_frame().groupBy(F.col("group").alias("name")).agg(F.sum("queued_changes").alias("queued_changes"), F.sum("queued_bytes").alias("queued_bytes"), F.count_if(F.col("state") == "ERRORED").alias("errored_tables"))
    running = catalog.spark.createDataFrame([(g.name, g.running, g.mode, int(catalog.get_group_config(g.name, "max_queued_bytes"))) for g in catalog.groups.values()], "name string, running boolean, mode string, max_queued_bytes bigint")
    sums = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("queued_changes", "queued_bytes", "errored_tables")]
    return running.join(m, "name", "left").select(F.col("name").alias("group"), "running", "mode", *sums, "max_queued_bytes").withColumn("backpressure", F.col("queued_bytes") >= F.col("max_queued_bytes"))


def metrics(catalog: Catalog, source_lsn: int = 0) -> str:
    """{"tables": [...], "groups": [...]}"""
    per_table = status(catalog, source_lsn).select(F.to_json(F.collect_list(F.struct("source", "target", "group", "state", "rows_synced", "queued_changes", "failures", "flush_lag_bytes", "source_lag_bytes"))).alias("j")) if catalog.mappings else None
    per_group = groups(catalog).select(F.to_json(F.collect_list(F.struct("name", "enabled", "table_count", "pending_lsn", "confirmed_lsn"))).alias("j"))
    return '{"tables":%s,"groups":%s}' % (per_table.first().j if per_table is not None else "[]", per_group.first().j)
