"""Groups, table mappings and settings, and the functions that manage them.

They are kept as one JSON document in numbered files that are created exclusively. Who finds the next
number taken merges field by field (own changes since the last file win over what the other left as
it was) and tries again, so a server and a runner don't lose each other's updates.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import config as settings
from .functions.scalar import ERROR_LIMIT, backoff, redact, source_label, split_name
from .sources.lake import BUCKETS, LakeTable
from .sources.store import Store
from .state import CATCHUP, ERRORED, SNAPSHOT, STREAMING, move

MODES = ("upsert", "append")
#: Tries to write a file, and older files that are kept for readers.
TRIES, KEPT = 20, 20


class CatalogError(ValueError):
    status = 400


class NotFound(CatalogError):
    status = 404


class Conflict(CatalogError):
    status = 409


@dataclass
class Group:
    name: str
    publication: str
    slot: str
    conninfo: str | None = None
    mode: str = "bgworker"
    enabled: bool = True
    pending_lsn: int = 0
    confirmed_lsn: int = 0
    config: dict = field(default_factory=dict)
    running: bool = False


@dataclass
class Mapping:
    id: str
    group: str
    source: str
    target: str
    label: str
    columns: list[tuple[str, int]]
    keys: list[str]
    sync_mode: str = "upsert"
    state: str = SNAPSHOT
    enabled: bool = True
    fan_in: bool = False
    snapshot_lsn: int | None = None
    applied_lsn: int | None = None
    applied_seq: int | None = None
    error: str | None = None
    failures: int = 0
    retry_at: float | None = None
    rows_synced: int = 0
    queued_changes: int = 0
    queued_bytes: int = 0
    snapshot_rows: int | None = None
    snapshot_ms: int | None = None
    flush_count: int = 0
    flush_ms: int = 0
    last_sync_at: float | None = None
    config: dict = field(default_factory=dict)


class Catalog:
    """root: folder of the catalog and of the target tables, in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, clock=time.time):
        self.spark, self.root, self.store, self.clock = spark, root.rstrip("/"), Store(spark, root), clock
        self._lock = threading.RLock()
        self.groups: dict[str, Group] = {}
        self.mappings: dict[str, Mapping] = {}
        self.config: dict = {k: d for k, (_, d) in settings.KEYS.items() if d is not None}
        #: What runs a group's stream here: anything with resume() and halt().
        self.workers: dict[str, object] = {}
        self.number, self._base = -1, self._document()
        if self._latest() >= 0:
            self.load()
        else:
            self.create_group("default")

    def _latest(self) -> int:
        return max((int(n[:-5]) for n in self.store.names("_catalog") if n.endswith(".json")), default=-1)

    def _document(self) -> dict:
        return json.loads(json.dumps({"groups": {g.name: asdict(g) for g in self.groups.values()}, "mappings": {m.id: asdict(m) for m in self.mappings.values()}, "config": self.config}))

    def load(self) -> None:
        """What the newest file says, for what isn't changed here since the last one; objects that are held stay the same ones."""
        with self._lock:
            self.number = self._latest()
            raw = self.store.read(f"_catalog/{self.number:020d}.json")
            text = json.loads(raw)
            mine, base = self._document(), self._base
            for kind, held, make in (("groups", self.groups, Group), ("mappings", self.mappings, Mapping)):
                for key in {*mine[kind], *text[kind]}:
                    was, own, other = (d[kind].get(key) for d in (base, mine, text))
                    if other is None:
                        if was is not None:  # dropped there
                            held.pop(key)
                    elif own is None:
                        if was is None:
                            held[key] = make(**other)
                    else:
                        for field_, value in other.items():
                            if was is None or own[field_] == was.get(field_):
                                setattr(held[key], field_, value)
            for m in self.mappings.values():
                m.columns = [tuple(c) for c in m.columns]
            self.config = {k: v for k, v in {**text["config"], **{k: v for k, v in mine["config"].items() if v != base["config"].get(k)}}.items() if k in text["config"] or mine["config"].get(k) != base["config"].get(k)}
            self._base = json.loads(raw)  # nothing that is held here is part of it

    def save(self) -> None:
        with self._lock:
            for _ in range(TRIES):
                text = self._document()
                if text == self._base and self.number >= 0:
                    return
                if self.store.create(f"_catalog/{self.number + 1:020d}.json", json.dumps(text)):
                    self.number, self._base = self.number + 1, text
                    if self.number >= KEPT:
                        self.store.delete(f"_catalog/{self.number - KEPT:020d}.json")
                    return
                self.load()
            raise Conflict(f"the catalog at {self.root} keeps changing")

    # -- groups

    def group(self, name: str) -> Group:
        if name not in self.groups:
            raise NotFound(f"sync group '{name}' does not exist")
        return self.groups[name]

    def create_group(self, name: str, publication: str | None = None, slot: str | None = None, conninfo: str | None = None, mode: str = "bgworker") -> str:
        if not name:
            raise CatalogError("a group needs a name")
        if mode not in ("bgworker", "daemon"):
            raise CatalogError(f"unknown mode '{mode}'")
        with self._lock:
            if name in self.groups:
                raise Conflict(f"sync group '{name}' already exists")
            self.groups[name] = Group(name, publication or f"sync_pub_{name}", slot or f"sync_slot_{name}", conninfo, mode)
            self.save()
        return name

    def drop_group(self, name: str, drop_targets: bool = False) -> None:
        """Drops a group and its mappings; targets stay unless asked for."""
        with self._lock:
            self.group(name)
            for m in [m for m in self.mappings.values() if m.group == name]:
                self.remove_table(m.source, drop_targets, name)
            del self.groups[name]
            self.save()

    def _enable(self, name: str, enabled: bool) -> None:
        with self._lock:
            self.group(name).enabled = enabled
            self.save()

    def enable_group(self, name: str) -> None:
        self._enable(name, True)

    def disable_group(self, name: str) -> None:
        self._enable(name, False)

    def start_worker(self, group: str | None = None) -> int:
        return self._run(group, True)

    def stop_worker(self, group: str | None = None) -> int:
        return self._run(group, False)

    def _run(self, group: str | None, running: bool) -> int:
        with self._lock:
            chosen = [self.group(group)] if group else [g for g in self.groups.values() if g.enabled or not running]
            changed = [g for g in chosen if g.running != running]
            for g in changed:
                g.running = running
            self.save()
        for g in changed:
            if worker := self.workers.get(g.name):
                worker.resume() if running else worker.halt()
        return len(changed)

    # -- tables

    @staticmethod
    def full(source: str) -> str:
        return ".".join(split_name(source))

    def find(self, source: str, group: str | None = None) -> Mapping:
        """The one mapping of a source; which group must be said where several have it."""
        found = [m for m in self.mappings.values() if m.source == self.full(source) and group in (None, m.group)]
        if not found:
            raise NotFound(f"table {self.full(source)} is not synced" + (f" in group '{group}'" if group else ""))
        if len(found) > 1:
            raise CatalogError(f"table {self.full(source)} is in several groups ({', '.join(sorted(m.group for m in found))}); name one")
        return found[0]

    def target(self, m: Mapping) -> LakeTable:
        return LakeTable(self.spark, f"{self.root}/{m.target}")

    def add_table(self, source: str, columns: list[tuple[str, int]], keys: list[str] | None = None, target: str | None = None, group: str = "default", copy_data: bool = True, fan_in: bool = False, sync_mode: str = "upsert", modifiers: dict[str, int] | None = None, buckets: int = BUCKETS) -> Mapping:
        """Starts syncing a source table: columns are (name, type id) pairs, keys its primary key; buckets: of a new upsert target."""
        from .functions.pgtypes import spark_type

        if sync_mode not in MODES:
            raise CatalogError(f"invalid sync_mode '{sync_mode}': must be 'upsert' or 'append'")
        with self._lock:
            if group not in self.groups:
                raise NotFound(f"Sync group '{group}' not found")
            schema, name = split_name(source)
            full = f"{schema}.{name}"
            if not columns:
                raise CatalogError(f"no columns found for {full}")
            if sync_mode == "upsert" and not keys:
                raise CatalogError(f"table {full} has no primary key; upsert needs one, use sync_mode => 'append'")
            missing = [k for k in keys or [] if k not in dict(columns)]
            if missing:
                raise CatalogError(f"key columns {', '.join(missing)} are not columns of {full}")
            if any(m.source == full and m.group == group for m in self.mappings.values()):
                raise Conflict(f"table {full} is already in group '{group}'")
            target = ".".join(split_name(target or f"{name}_lake", schema))
            types = [(n, spark_type(oid, (modifiers or {}).get(n, -1))) for n, oid in columns]
            label = source_label(group, schema, name)
            others = [m for m in self.mappings.values() if m.target == target]
            table = LakeTable(self.spark, f"{self.root}/{target}")
            if others and not fan_in:
                raise Conflict(f"target table {target} already has an active source (source: {others[0].source}); set fan_in => true to add another")
            if others:
                if others[0].sync_mode != sync_mode:
                    raise Conflict(f"target table {target} is synced in {others[0].sync_mode} mode")
                held = [(c["name"], c["type"]) for c in table.version().columns]
                if len(held) != len(types):
                    raise CatalogError(f"fan-in schema mismatch: source {full} has {len(types)} columns, target {target} has {len(held)}")
                for (a, ka), (b, kb) in zip(types, held, strict=True):
                    if a != b or ka != kb:
                        raise CatalogError(f"fan-in schema mismatch: source column {a} {ka}, target column {b} {kb}")
            LakeTable.create(self.spark, table.root, types, keys, sync_mode, buckets)
            m = Mapping(uuid.uuid4().hex, group, full, target, label, list(columns), list(keys or []), sync_mode, SNAPSHOT if copy_data else STREAMING, fan_in=fan_in)
            self.mappings[m.id] = m
            self.save()
            return m

    def remove_table(self, source: str, drop_target: bool = False, group: str | None = None) -> None:
        """Stops syncing a source. Its rows stay; the target is dropped only if asked for and nothing else feeds it."""
        with self._lock:
            m = self.find(source, group)
            del self.mappings[m.id]
            if drop_target and not any(o.target == m.target for o in self.mappings.values()):
                self.store.delete(m.target)
            self.save()

    def move_table(self, source: str, new_group: str, group: str | None = None) -> Mapping:
        """Moves a mapping to another group. The label stays: it names the rows that are already in the target."""
        with self._lock:
            m = self.find(source, group)
            if new_group not in self.groups:
                raise NotFound(f"Table mapping or target group '{new_group}' not found")
            if any(o.source == m.source and o.group == new_group for o in self.mappings.values()):
                raise Conflict(f"table {m.source} is already in group '{new_group}'")
            m.group = new_group
            self.save()
            return m

    def resync_table(self, source: str, group: str | None = None) -> Mapping:
        """Empties the source's share of the target and starts again from a snapshot."""
        with self._lock:
            m = self.find(source, group)
            table = self.target(m)
            if any(o.target == m.target and o.id != m.id for o in self.mappings.values()):
                table.drop_source(m.label, m.id, forget=True)
            else:
                table.truncate()
            m.state = move(m.state if m.state != CATCHUP else ERRORED, SNAPSHOT)
            m.snapshot_lsn = m.applied_lsn = m.applied_seq = m.error = m.retry_at = m.snapshot_rows = m.snapshot_ms = None
            m.failures = m.rows_synced = 0
            self.save()
            return m

    def rename_source(self, mapping_id: str, name: str) -> None:
        with self._lock:
            self.mappings[mapping_id].source = self.full(name)
            self.save()

    # -- progress

    def failed(self, m: Mapping, error: str, limit: int = ERROR_LIMIT) -> None:
        """Counts a failure; at the limit the table is ERRORED and waits longer each time."""
        with self._lock:
            m.failures, m.error = m.failures + 1, error
            if m.failures >= limit:
                m.state = move(m.state, ERRORED)
                m.retry_at = self.clock() + backoff(max(m.failures, ERROR_LIMIT))
            self.save()

    def retry_due(self) -> list[Mapping]:
        """Moves errored tables whose wait is over: to a snapshot if they never had one, else on with the stream."""
        with self._lock:
            due = [m for m in self.mappings.values() if m.state == ERRORED and m.retry_at is not None and m.retry_at <= self.clock()]
            for m in due:
                m.state = move(ERRORED, SNAPSHOT if m.snapshot_lsn is None and m.applied_lsn is None else STREAMING)
                m.retry_at = None
            if due:
                self.save()
            return due

    def snapshotted(self, m: Mapping, lsn: int, rows: int, ms: int) -> None:
        with self._lock:
            m.state = move(m.state, CATCHUP)
            m.snapshot_lsn, m.snapshot_rows, m.snapshot_ms, m.rows_synced, m.last_sync_at = lsn, rows, ms, m.rows_synced + rows, self.clock()
            m.failures, m.error = 0, None
            self.save()

    def applied(self, m: Mapping, position: tuple[int, int] | None, rows: int, ms: int) -> None:
        with self._lock:
            if position:
                m.applied_lsn, m.applied_seq = position
            m.rows_synced, m.flush_count, m.flush_ms, m.last_sync_at = m.rows_synced + rows, m.flush_count + bool(rows), m.flush_ms + ms, self.clock()
            m.failures, m.error = 0, None
            self.save()

    def caught_up(self, group: str) -> list[Mapping]:
        """CATCHUP tables whose snapshot the stream has passed go on as STREAMING."""
        with self._lock:
            done = [m for m in self.mappings.values() if m.group == group and m.state == CATCHUP and (m.snapshot_lsn or 0) <= self.groups[group].pending_lsn]
            for m in done:
                m.state = move(CATCHUP, STREAMING)
            self.save()
            return done

    def confirm(self, group: str) -> int:
        """The position up to which all of a group's active tables are durable; never goes back, and 0 if one is unknown."""
        with self._lock:
            active = [m for m in self.mappings.values() if m.group == group and m.enabled and m.state in (CATCHUP, STREAMING)]
            positions = [max(m.applied_lsn or 0, (m.snapshot_lsn or 0) if m.state == CATCHUP else 0) for m in active]
            g = self.groups[group]
            low = min(positions, default=g.pending_lsn)
            g.confirmed_lsn = max(g.confirmed_lsn, low)
            self.save()
            return low

    # -- settings

    def set_config(self, key: str, value: str) -> None:
        with self._lock:
            self.config[key] = settings.checked(key, value)
            self.save()

    def get_config(self, key: str | None = None) -> str | None:
        return self._config(settings.resolved(self.config), key)

    def set_group_config(self, group: str, key: str, value: str) -> None:
        with self._lock:
            self.group(group).config[key] = settings.checked(key, value)
            self.save()

    def get_group_config(self, group: str, key: str | None = None) -> str | None:
        return self._config(settings.resolved(self.config, self.group(group).config), key)

    def set_table_config(self, source: str, key: str, value: str, group: str | None = None) -> None:
        value = settings.checked(key, value, table=True)
        with self._lock:
            self.find(source, group).config[key] = value
            self.save()

    def table_settings(self, m: Mapping) -> dict:
        return settings.for_table(settings.resolved(self.config, self.group(m.group).config), m.config)

    def get_table_config(self, source: str, key: str | None = None, group: str | None = None) -> str | None:
        every = self.table_settings(self.find(source, group))
        return self._config({k: every[k] for k in settings.TABLE_KEYS}, key)

    @staticmethod
    def _config(values: dict, key: str | None) -> str | None:
        return json.dumps({k: v for k, v in values.items() if v is not None}) if key is None else settings.shown(values.get(key))

    # -- frames

    def groups_frame(self) -> DataFrame:
        rows = [(g.name, g.publication, g.slot, g.enabled, g.mode, g.pending_lsn, g.confirmed_lsn, redact(g.conninfo) if g.conninfo else None) for g in self.groups.values()]
        return self.spark.createDataFrame(rows, "name string, publication string, slot string, enabled boolean, mode string, pending_lsn bigint, confirmed_lsn bigint, conninfo string")

    def mappings_frame(self) -> DataFrame:
        rows = [(m.id, m.group, m.source, m.target, m.label, m.sync_mode, m.state, m.enabled, m.snapshot_lsn, m.applied_lsn, m.applied_seq, m.rows_synced, m.queued_changes, m.queued_bytes, m.failures, m.error, m.flush_count, m.flush_ms, m.last_sync_at, m.snapshot_rows, m.snapshot_ms) for m in self.mappings.values()]
        return self.spark.createDataFrame(rows, "mapping_id string, group string, source string, target string, label string, sync_mode string, state string, enabled boolean, snapshot_lsn bigint, applied_lsn bigint, applied_seq bigint, rows_synced bigint, queued_changes bigint, queued_bytes bigint, failures int, error string, flush_count int, flush_ms bigint, last_sync_at double, snapshot_rows bigint, snapshot_ms bigint")
