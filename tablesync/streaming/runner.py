"""One streaming query per sync group: each micro-batch of the change log is applied to the group's tables.

Tables of a batch are flushed side by side, as many as the gate admits. A table's commit holds the
batch number, so a batch that is delivered again changes nothing. Changes of a table that can't take
them now (it waits for a snapshot or a retry) are written to `_held/<mapping>/<batch>` and applied in
order before anything newer, so the stream needn't wait and nothing is lost. Where what is held
reaches `max_queued_bytes`, the stream waits before its next batch until a table can go on.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog, Mapping
from ..functions.pgtypes import UnsupportedType, parse, spark_type
from ..operators.barriers import segments
from ..operators.changes import DELETE, SCHEMA, TRUNCATE, UPDATE, append_rows, delete_image, fill_unchanged, guard_unchanged, split_updates
from ..operators.schema import schema_diff
from ..state import CATCHUP, ERRORED, SNAPSHOT, STREAMING
from .gate import FlushGate
from .snapshots import SnapshotManager

#: Commits that one batch of one table may make: two per segment between barriers.
STEPS = 1_000_000


class UnsupportedChange(ValueError):
    """A schema change that needs a resync."""


class GroupRunner:
    """snapshot: gives a table's rows and the position they are of; columns as in the mapping.

    background: snapshots run beside the stream, and a table's changes are held until its own is in.
    """

    def __init__(self, catalog: Catalog, group: str, snapshot: Callable[[Mapping], tuple[DataFrame, int]] | None = None, background: bool = False):
        self.catalog, self.group, self.snapshot, self.spark = catalog, group, snapshot, catalog.spark
        self.gate = FlushGate(int(catalog.get_group_config(group, "max_concurrent_flushes")))
        self.snapshots = SnapshotManager() if background else None
        self.ready: dict[str, tuple[int, int, int]] = {}
        self.query: StreamingQuery | None = None
        self.pauses, self._stopped, self._again = 0, threading.Event(), None

    def changes(self, folder: str) -> DataFrame:
        """The log in a folder as a stream; a batch ends with the transaction that passes `flush_batch_threshold` messages."""
        most = self.catalog.get_group_config(self.group, "flush_batch_threshold")
        return self.spark.readStream.format("tablesync_wal").option("path", folder).option("maxMessages", most).load()

    def start(self, changes: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Runs over a streaming DataFrame of change rows (wal.ROW)."""
        group = self.catalog.group(self.group)
        if not group.enabled:
            raise RuntimeError(f"sync group '{self.group}' is disabled")
        writer = changes.writeStream.queryName(f"tablesync_{self.group}").foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        every = self.catalog.get_group_config(self.group, "flush_interval_ms")
        self._again = (changes, checkpoint, available_now)
        self._stopped.clear()
        self.catalog.workers[self.group], group.running = self, True
        self.query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{every} milliseconds")).start()
        return self.query

    def halt(self) -> None:
        """Stops the query; what its last batch left undone is done by the next start from the checkpoint."""
        self._stopped.set()
        if self.query is not None:
            self.query.stop()
            self.query = None

    def resume(self) -> None:
        """Starts the query again as it was started last."""
        if self.query is None and self._again is not None:
            self.start(*self._again)

    def _mine(self) -> list[Mapping]:
        return [m for m in self.catalog.mappings.values() if m.group == self.group and m.enabled]

    def full(self) -> bool:
        """Whether what the group's tables hold back has reached its limit."""
        return sum(m.queued_bytes for m in self._mine()) >= int(self.catalog.get_group_config(self.group, "max_queued_bytes"))

    def _wait(self) -> None:
        """Backpressure: reads no further while the group is full, but for tables that can go on."""
        if self.full():
            self.pauses += 1
        while self.full() and not self._stopped.is_set():
            self.catalog.retry_due()
            for m in self._mine():
                if m.queued_bytes:
                    try:
                        self._advance(m, None)
                    except Exception as e:
                        self._fail(m, e)
            if self.full():
                self._stopped.wait(int(self.catalog.get_group_config(self.group, "drain_poll_ms")) / 1000)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Applies one batch of change rows."""
        self.gate.resize(int(self.catalog.get_group_config(self.group, "max_concurrent_flushes")))
        self._wait()
        if self._stopped.is_set():
            raise RuntimeError(f"sync group '{self.group}' was stopped")
        batch = batch.persist()
        try:
            stats = batch.groupBy("rel").agg(F.count("*").alias("n"), F.max(F.struct("lsn", "seq")).alias("at")).collect()
            renames = [json.loads(r.ddl) | {"rel": r.rel} for r in batch.where(F.col("op") == SCHEMA).orderBy("lsn", "seq").collect()]
            self.catalog.retry_due()
            mine = self._mine()
            names = {m.id: {m.source} for m in mine}
            for ddl in renames:
                for m in mine:
                    if ddl["was"] in names[m.id] and ddl["rel"] != ddl["was"]:
                        names[m.id].add(ddl["rel"])
                        self.catalog.rename_source(m.id, ddl["rel"])
            end = max((r["at"]["lsn"] for r in stats), default=None)
            there = {m.id: [r for r in stats if r.rel in names[m.id]] for m in mine}
            with ThreadPoolExecutor(max_workers=max(1, min(16, len(mine)))) as pool:
                list(pool.map(lambda m: self._table(m, batch, names[m.id], there[m.id], number, end), mine))
            if end is not None:
                g = self.catalog.group(self.group)
                g.pending_lsn = max(g.pending_lsn, end)
            self.catalog.caught_up(self.group)
            self.catalog.confirm(self.group)
        finally:
            batch.unpersist()

    # -- one table

    def _held(self, m: Mapping) -> list[int]:
        return sorted(int(n) for n in self.catalog.store.names(f"_held/{m.id}") if n.isdigit())

    def _hold(self, m: Mapping, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(self.catalog.store.path(f"_held/{m.id}/{number:020d}"))
        texts = F.aggregate(F.concat(F.coalesce("new", F.array()), F.coalesce("old", F.array())), F.lit(0), lambda a, v: a + F.coalesce(F.octet_length(v), F.lit(0)))
        got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(texts), F.lit(0)).alias("b")).first()
        m.queued_changes += got.n
        m.queued_bytes += got.b

    def _table(self, m: Mapping, batch: DataFrame, names: set[str], stats: list, number: int, end: int | None) -> None:
        rows = batch.where(F.col("rel").isin(*names))
        with self.gate.flush():
            try:
                if not self._advance(m, number):
                    if stats:
                        self._hold(m, rows, number)
                    return
                if stats:
                    self._flush(m, rows, number)
                elif end is not None and m.state == STREAMING:
                    self.catalog.applied(m, (end, 2**62), 0, 0)  # an idle table doesn't hold the group back
            except Exception as e:
                self._fail(m, e)
                if stats:
                    self._hold(m, rows, number)

    def _fail(self, m: Mapping, e: Exception) -> None:
        self.catalog.failed(m, str(e)[:2000], 1 if isinstance(e, UnsupportedChange | UnsupportedType) else 3)

    def _advance(self, m: Mapping, number: int | None) -> bool:
        """Takes a table's snapshot if it waits for one, and applies what it holds from before batch `number`. Whether it can take more."""
        if m.state == SNAPSHOT and self.snapshot is not None:
            if self.snapshots is None:
                self.take_snapshot(m)
            elif done := self.snapshots.harvest(m.id):
                done.result()
            else:
                self.snapshots.kick(m.id, lambda: self.load_snapshot(m))
        if self.snapshots is not None and m.id in self.ready:
            self.catalog.snapshotted(m, *self.ready.pop(m.id))
        if m.state not in (CATCHUP, STREAMING):
            return False
        for old in self._held(m):
            if number is None or old < number:
                self._flush(m, self.spark.read.parquet(self.catalog.store.path(f"_held/{m.id}/{old:020d}")), old)
            self.catalog.store.delete(f"_held/{m.id}/{old:020d}")
        m.queued_changes = m.queued_bytes = 0
        return True

    def take_snapshot(self, m: Mapping) -> None:
        self.load_snapshot(m)
        self.catalog.snapshotted(m, *self.ready.pop(m.id))

    def load_snapshot(self, m: Mapping) -> None:
        """Puts a snapshot in the place of the table's share of the target."""
        began = time.monotonic()
        rows, lsn = self.snapshot(m)
        table = self.catalog.target(m)
        table.replace(rows, m.label, m.id, (lsn, 0))
        n = table.read(source=m.label).count()
        self.ready[m.id] = (lsn, n, int(1000 * (time.monotonic() - began)))

    def typed(self, m: Mapping, rows: DataFrame) -> DataFrame:
        """Change rows in the table's own columns; old_<key> holds an update's old key."""
        rows = guard_unchanged(rows).withColumn("new", fill_unchanged(F.col("new"), F.col("old"), F.col("unchanged")))
        image = F.when(F.col("op") == DELETE, F.col("old")).otherwise(F.col("new"))
        rows = rows.withColumn("_image", image)
        cols = [parse(F.get("_image", F.lit(i)), oid).cast(spark_type(oid)).alias(name) for i, (name, oid) in enumerate(m.columns)]
        olds = [F.when(F.col("op") == UPDATE, parse(F.get("old", F.lit(i)), oid)).alias(f"old_{name}") for i, (name, oid) in enumerate(m.columns) if name in m.keys]
        return delete_image(rows.select("lsn", "seq", "op", *cols, *olds), m.keys, [c for c, _ in m.columns])

    def _flush(self, m: Mapping, rows: DataFrame, number: int) -> None:
        table, began = self.catalog.target(m), time.monotonic()
        done = table.applied(m.id)
        if done and done["batch"] >= (number + 1) * STEPS - 1:
            return
        if m.snapshot_lsn is not None:
            rows = rows.where((F.col("lsn") > m.snapshot_lsn) | (F.col("op") == SCHEMA))
        names, total, position = [c for c, _ in m.columns], 0, None
        for k, (part, barrier) in enumerate(segments(rows)):
            step = number * STEPS + 2 * k  # the barrier behind it has the next number
            got = part.agg(F.count("*").alias("n"), F.max(F.struct("lsn", "seq")).alias("at")).first()
            if got.n:
                position = (got["at"]["lsn"], got["at"]["seq"])
                typed = self.typed(m, part)
                if m.sync_mode == "append":
                    table.append(append_rows(typed, m.label, names), m.label, m.id, step, position)
                else:
                    table.upsert(split_updates(typed, m.keys, names), m.label, m.id, step, position)
                total += got.n
            if barrier is None:
                break
            position = (barrier.lsn, barrier.seq)
            if barrier.op == TRUNCATE and m.sync_mode == "upsert":
                table.drop_source(m.label, m.id, step + 1, position)
            elif barrier.op == SCHEMA:
                self._columns(m, table, [(n, int(t)) for n, t in json.loads(barrier.ddl)["new"]])
                names = [c for c, _ in m.columns]
        table.note(m.id, (number + 1) * STEPS - 1, position)
        table.compact()  # only buckets of too many folders are rewritten
        self.catalog.applied(m, position, total, int(1000 * (time.monotonic() - began)))

    def _columns(self, m: Mapping, table, new: list[tuple[str, int]]) -> None:
        """Follows a schema change; one that was followed already changes nothing."""
        for c in schema_diff(m.columns, new):
            if c.kind == "retype":
                raise UnsupportedChange(f"column {c.column} changed its type from {c.old} to {c.new}; use resync_table('{m.source}') after adjusting the target")
            if c.kind == "add":
                table.add_column(c.column, spark_type(dict(new)[c.column]))
            elif c.kind == "drop":
                table.drop_column(c.column)
            else:
                table.rename_column(c.column, c.new)
                m.keys = [c.new if k == c.column else k for k in m.keys]
        m.columns = new
        self.catalog.save()


def errored(catalog: Catalog) -> list[Mapping]:
    return [m for m in catalog.mappings.values() if m.state == ERRORED]
