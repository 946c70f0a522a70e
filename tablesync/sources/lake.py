"""Versioned Parquet tables: a commit log over immutable folders of files.

`<root>/_log/<version>.json` is created exclusively, so of two writers of one version one loses and
tries again on top of the winner. A commit names the columns (with ids that never change and are the
physical names in the files), the folders of each source and bucket, and how far each mapping has
got. A reader takes one version, so it sees all of a commit or nothing. Renaming or dropping a column,
truncating or dropping a source only write a commit.

Rows are dealt to buckets by a hash of the key. An upsert into a source that has rows writes a delta:
the last change of each of the batch's keys, deletes marked. So it costs the batch and not the table,
and reads no rows. Insert-only batches whose keys are all above the source's greatest one add files to
the buckets instead. Readers take the newest row of each key from the deltas and the rest from the
buckets, by an anti join on the key. `compact` bounds what they merge: runs of deltas of like size
become one, and deltas that together reach a share of the source are folded into the buckets that
their keys fall into, so a row is rewritten once per that share of changes and not once a batch.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import INSERT, LSN, OP, SEQ, SOURCE, UPDATE, live
from ..operators.compact import last_per_key
from .store import Store

BUCKETS = 16
TRIES = 10
FIRST_WAIT_S = 0.1
#: Folders of one bucket above which `compact` rewrites it, and deltas of a source above which it merges some.
MOST_FOLDERS = 8
#: Fewest deltas that are merged into one.
RUN = 4
#: `compact` folds a source's deltas once they hold a 1/FOLD_SHARE of its bytes, and FOLD_BYTES at least.
FOLD_SHARE = 10
FOLD_BYTES = 16 << 20
#: Marks a delta's rows that are deletes.
GONE = "_gone"


class CommitConflict(RuntimeError):
    pass


@dataclass
class Version:
    """What one commit says. parts: source, bucket, folders; deltas: source to folders and their bytes, oldest first; size: source to the bytes of its buckets, about; txn: mapping to batch, lsn, seq; top: source to its greatest single key."""

    number: int
    columns: list[dict]
    keys: list[str] = field(default_factory=list)
    mode: str = "upsert"
    buckets: int = BUCKETS
    next_id: int = 1
    parts: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    deltas: dict[str, list[list]] = field(default_factory=dict)
    size: dict[str, int] = field(default_factory=dict)
    txn: dict[str, dict] = field(default_factory=dict)
    top: dict[str, object] = field(default_factory=dict)
    what: str = "create"
    at: float = 0.0

    @property
    def names(self) -> list[str]:
        return [c["name"] for c in self.columns]

    @property
    def physical_keys(self) -> list[str]:
        return [f"c{c['id']}" for k in self.keys for c in self.columns if c["name"] == k]

    def holds(self, source: str) -> bool:
        return bool(self.parts.get(source) or self.deltas.get(source))

    def set_rows(self, source: str, parts: dict[str, list[str]], size: int) -> None:
        """All rows of a source are those in these folders."""
        self.parts[source], self.size[source] = parts, size
        self.deltas.pop(source, None)

    def drop_rows(self, source: str) -> None:
        for of in (self.parts, self.deltas, self.size, self.top):
            of.pop(source, None)

    def folders(self) -> list[str]:
        return [f for by in self.parts.values() for fs in by.values() for f in fs] + [f for ds in self.deltas.values() for f, _ in ds]


class LakeTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    # -- versions

    @staticmethod
    def create(spark: SparkSession, root: str, columns: list[tuple[str, str]], keys: list[str] | None = None, mode: str = "upsert", buckets: int = BUCKETS) -> LakeTable:
        """Version 0, unless the table is there already. An upsert table needs a key."""
        if mode == "upsert" and not keys:
            raise ValueError("an upsert table needs a primary key")
        table = LakeTable(spark, root)
        first = Version(0, [{"id": i, "name": n, "type": t} for i, (n, t) in enumerate(columns, 1)], list(keys or []), mode, buckets if mode == "upsert" else 1, len(columns) + 1, at=time.time())
        table.store.create("_log/" + f"{0:020d}.json", json.dumps(asdict(first)))
        return table

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.store.names("_log") if n.endswith(".json")]

    def exists(self) -> bool:
        return bool(self.versions())

    def version(self, number: int | None = None) -> Version:
        """A version; the latest complete one by default (a commit that is still being written doesn't count)."""
        for n in [number] if number is not None else sorted(self.versions(), reverse=True):
            try:
                return Version(**json.loads(self.store.read(f"_log/{n:020d}.json")))
            except json.JSONDecodeError:
                if number is not None:
                    raise
        raise FileNotFoundError(f"no table at {self.root}")

    def commit(self, change: Callable[[Version], Version | None]) -> Version:
        """Commits what change makes of the latest version; tried again on conflict. None from change commits nothing."""
        wait = FIRST_WAIT_S
        for _ in range(TRIES):
            now = self.version()
            new = change(Version(**json.loads(json.dumps(asdict(now)))))
            if new is None:
                return now
            new.number, new.at = now.number + 1, time.time()
            if self.store.create(f"_log/{new.number:020d}.json", json.dumps(asdict(new))):
                return new
            time.sleep(wait)
            wait *= 2
        raise CommitConflict(f"{self.root}: {TRIES} commits lost to other writers")

    def history(self) -> DataFrame:
        rows = [(v.number, v.what, len(v.folders()), json.dumps(v.txn)) for v in map(self.version, self.versions())]
        return self.spark.createDataFrame(rows, "version bigint, operation string, folders bigint, txn string")

    # -- reading

    def schema(self, v: Version, physical: bool = False) -> T.StructType:
        own = [f"`c{c['id']}` {c['type']}" if physical else f"`{c['name']}` {c['type']}" for c in v.columns]
        system = [f"{SOURCE} string"] + ([f"{OP} string", f"{LSN} bigint", f"{SEQ} bigint"] if v.mode == "append" else [])
        return T.StructType.fromDDL(", ".join(own + system))

    def _raw(self, v: Version, folders: list[str], marked: bool = False) -> DataFrame:
        """Rows of folders under physical names."""
        schema = self.schema(v, True)
        if marked:
            schema = schema.add(GONE, "boolean")
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _named(self, v: Version, raw: DataFrame) -> DataFrame:
        return raw.select(*[F.col(f"c{c['id']}").alias(c["name"]) for c in v.columns], *[c for c in self.schema(v).names if c not in v.names])

    def _bucket(self, v: Version, physical: bool = False) -> F.Column:
        kinds = {c["name"]: (f"c{c['id']}" if physical else c["name"], c["type"]) for c in v.columns}
        return F.pmod(F.xxhash64(*[F.col(f"`{kinds[k][0]}`").cast(kinds[k][1]) for k in v.keys]), F.lit(v.buckets)).cast("int")

    def _newest(self, v: Version, deltas: list[list]) -> DataFrame:
        """The newest change of each key of some deltas of one source, under physical names."""
        if len(deltas) == 1:
            return self._raw(v, [deltas[0][0]], True)
        rows = reduce(DataFrame.unionByName, [self._raw(v, [f], True).withColumn("_age", F.lit(i)) for i, (f, _) in enumerate(deltas)])
        turn = F.row_number().over(Window.partitionBy(*v.physical_keys).orderBy(F.desc("_age")))
        return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_age")

    def _merged(self, v: Version, folders: list[str], deltas: list[list], buckets: list[int] | None = None) -> DataFrame:
        """Rows of one source after its deltas, under physical names."""
        newest = self._newest(v, deltas)
        if buckets is not None:
            newest = newest.where(self._bucket(v, True).isin(buckets))
        fresh = newest.where(~F.col(GONE)).drop(GONE)
        return self._raw(v, folders).join(newest.select(*v.physical_keys), v.physical_keys, "left_anti").unionByName(fresh) if folders else fresh

    def read(self, version: int | None = None, source: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (time travel), of one source or bucket if asked: other folders aren't opened."""
        v = self.version(version)
        wanted = lambda s: [f for b, fs in v.parts.get(s, {}).items() if buckets is None or int(b) in buckets for f in fs]
        sources = [s for s in sorted({*v.parts, *v.deltas}) if source is None or s == source]
        plain = [f for s in sources if not v.deltas.get(s) for f in wanted(s)]
        merged = [self._merged(v, wanted(s), v.deltas[s], buckets) for s in sources if v.deltas.get(s)]
        return self._named(v, reduce(DataFrame.unionByName, ([self._raw(v, plain)] if plain or not merged else []) + merged))

    # -- writing

    def _write(self, v: Version, rows: DataFrame, label: str, split: bool) -> dict[str, list[str]]:
        """Writes rows under physical names and returns the folders by bucket."""
        name = uuid.uuid4().hex
        out = rows.select(*[F.col(f"`{c['name']}`").cast(c["type"]).alias(f"c{c['id']}") for c in v.columns], *[F.lit(label).alias(SOURCE) if c == SOURCE else F.col(c) for c in self.schema(v).names if c not in v.names], *(["_bucket"] if split else []))
        path = f"{self.root}/data/{name}"
        if split:
            # rebalanced, so that a large bucket is several tasks' work and files
            out.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
            return {n.split("=")[1]: [f"{name}/{n}"] for n in self.store.names(f"data/{name}") if n.startswith("_bucket=")}
        out.write.parquet(path)
        return {"0": [name]}

    def _write_delta(self, v: Version, raw: DataFrame) -> list:
        """Writes the newest change of each key, under physical names; the folder and its bytes."""
        name = uuid.uuid4().hex
        raw.write.parquet(f"{self.root}/data/{name}")
        return [name, self.store.size(f"data/{name}")]

    def _delta(self, v: Version, last: DataFrame, label: str) -> tuple[list, int]:
        """Writes a batch's last changes; the folder and its bytes, and how many changes there are."""
        seen = Observation()
        gone = ~F.col("op").isin(INSERT, UPDATE)
        raw = last.select(*[F.col(f"`{c['name']}`").cast(c["type"]).alias(f"c{c['id']}") for c in v.columns], F.lit(label).alias(SOURCE), gone.alias(GONE))
        made = self._write_delta(v, raw.observe(seen, F.count(F.lit(1)).alias("n")))
        return made, seen.get["n"]

    def _size(self, parts: dict[str, list[str]]) -> int:
        return sum(self.store.size(f"data/{n}") for n in {f.split("/")[0] for fs in parts.values() for f in fs})

    def _bucketed(self, v: Version, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", self._bucket(v))

    def applied(self, mapping: str) -> dict | None:
        return self.version().txn.get(mapping)

    @staticmethod
    def _done(v: Version, mapping: str | None, batch: int | None) -> bool:
        return mapping is not None and batch is not None and mapping in v.txn and v.txn[mapping].get("batch", -1) >= batch

    @staticmethod
    def _note(v: Version, mapping: str | None, batch: int | None, position: tuple[int, int] | None) -> None:
        if mapping is not None:
            old = v.txn.get(mapping, {})
            v.txn[mapping] = {"batch": old.get("batch", -1) if batch is None else batch, "lsn": position[0] if position else old.get("lsn", 0), "seq": position[1] if position else old.get("seq", 0)}

    def replace(self, rows: DataFrame, label: str, mapping: str | None = None, position: tuple[int, int] | None = None) -> Version:
        """Puts rows in the place of all rows of one source: a snapshot or a resync."""
        v = self.version()
        if v.mode == "append":
            for c, kind in ((OP, "string"), (LSN, "bigint"), (SEQ, "bigint")):
                if c not in rows.columns:
                    rows = rows.withColumn(c, {OP: F.lit("I"), LSN: F.lit(position[0] if position else 0), SEQ: F.lit(0)}[c].cast(kind))
        parts = self._write(v, self._bucketed(v, rows) if v.mode == "upsert" else rows, label, v.mode == "upsert")
        size = self._size(parts)

        def change(new: Version) -> Version:
            new.set_rows(label, parts, size)
            new.what = "replace"
            new.top.pop(label, None)
            self._note(new, mapping, None, position)
            return new

        return self.commit(change)

    def append(self, rows: DataFrame, label: str, mapping: str | None = None, batch: int | None = None, position: tuple[int, int] | None = None) -> Version:
        """Adds rows; a batch that the table already has adds nothing."""
        v = self.version()
        if self._done(v, mapping, batch):
            return v
        parts = self._write(v, rows.sortWithinPartitions(LSN, SEQ) if LSN in rows.columns else rows, label, False)

        def change(new: Version) -> Version | None:
            if self._done(new, mapping, batch):
                return None
            new.parts.setdefault(label, {}).setdefault("0", []).extend(parts["0"])
            new.what = "append"
            self._note(new, mapping, batch, position)
            return new

        return self.commit(change)

    def upsert(self, changes: DataFrame, label: str, mapping: str | None = None, batch: int | None = None, position: tuple[int, int] | None = None) -> Version:
        """Applies a batch of changes (lsn, seq, op and the table's columns) to one source, once."""
        for _ in range(TRIES):
            v = self.version()
            if self._done(v, mapping, batch):
                return v
            held, parts, delta, high, low, other = v.holds(label), {}, None, None, None, 0
            last = last_per_key(changes, v.keys)
            if held and (len(v.keys) > 1 or label not in v.top):
                delta, n = self._delta(v, last, label)
            else:
                last = last.persist()
                try:
                    n, other, low, high = last.agg(F.count("*"), F.count_if(F.col("op") != INSERT), F.min(v.keys[0]), F.max(v.keys[0])).first()
                    if len(v.keys) > 1 or not isinstance(high, int):
                        low = high = None
                    if n and (not held or (high is not None and not other and low > v.top[label])):
                        parts = self._write(v, self._bucketed(v, live(last).select(*v.names)), label, True)
                    elif n:
                        delta, _ = self._delta(v, last, label)
                finally:
                    last.unpersist()
            size = self._size(parts)

            def change(new: Version, v=v, parts=parts, delta=delta, n=n, high=high, size=size) -> Version | None:
                if self._done(new, mapping, batch):
                    return None
                if new.columns != v.columns or (not delta and new.parts.get(label) != v.parts.get(label)) or (not delta and new.deltas.get(label) != v.deltas.get(label)):
                    raise CommitConflict  # another writer of the same source: read again
                if delta and n:
                    new.deltas.setdefault(label, []).append(delta)
                for b, folders in parts.items():
                    new.parts.setdefault(label, {}).setdefault(b, []).extend(folders)
                new.size[label] = new.size.get(label, 0) + size
                if not v.holds(label):
                    new.top[label] = high
                elif label in new.top and n:
                    new.top[label] = None if high is None else max(new.top[label], high)
                if new.top.get(label, 0) is None:
                    del new.top[label]
                new.what = "upsert"
                self._note(new, mapping, batch, position)
                return new

            try:
                return self.commit(change)
            except CommitConflict as e:
                if e.args:
                    raise
        raise CommitConflict(f"{self.root}: source {label} keeps changing")

    def note(self, mapping: str, batch: int, position: tuple[int, int] | None = None) -> Version:
        """Records progress without rows, as for a table that a batch doesn't touch."""

        def change(new: Version) -> Version | None:
            if self._done(new, mapping, batch):
                return None
            self._note(new, mapping, batch, position)
            new.what = "progress"
            return new

        return self.commit(change)

    def drop_source(self, label: str, mapping: str | None = None, batch: int | None = None, position: tuple[int, int] | None = None, forget: bool = False) -> Version:
        """Takes all rows of one source away: a truncate. No file is read. forget: the mapping's progress goes too."""

        def change(new: Version) -> Version | None:
            if self._done(new, mapping, batch):
                return None
            new.drop_rows(label)
            if forget:
                new.txn.pop(mapping, None)
            else:
                self._note(new, mapping, batch, position)
            new.what = "drop source"
            return new

        return self.commit(change)

    def truncate(self) -> Version:
        def change(new: Version) -> Version:
            new.parts, new.deltas, new.size, new.top, new.txn, new.what = {}, {}, {}, {}, {}, "truncate"
            return new

        return self.commit(change)

    def add_column(self, name: str, kind: str) -> Version:
        def change(new: Version) -> Version | None:
            if name in new.names:
                return None
            new.columns.append({"id": new.next_id, "name": name, "type": kind})
            new.next_id, new.what = new.next_id + 1, f"add {name}"
            return new

        return self.commit(change)

    def drop_column(self, name: str) -> Version:
        def change(new: Version) -> Version | None:
            if name in new.keys:
                raise ValueError(f"{name} is a key column")
            if name not in new.names:
                return None
            new.columns, new.what = [c for c in new.columns if c["name"] != name], f"drop {name}"
            return new

        return self.commit(change)

    def rename_column(self, old: str, name: str) -> Version:
        def change(new: Version) -> Version | None:
            if old not in new.names and name in new.names:
                return None
            for c in new.columns:
                if c["name"] == old:
                    c["name"] = name
            new.keys, new.what = [name if k == old else k for k in new.keys], f"rename {old}"
            return new

        return self.commit(change)

    def _fold(self, v: Version, label: str) -> None:
        """Puts a source's deltas into the buckets that their keys fall into."""
        deltas, parts = v.deltas[label], v.parts.get(label, {})
        touched = [str(r[0]) for r in self._newest(v, deltas).select(self._bucket(v, True)).distinct().collect()]
        was = {b: parts.get(b, []) for b in touched}
        rows = self._named(v, self._merged(v, [f for fs in was.values() for f in fs], deltas))
        made = self._write(v, self._bucketed(v, rows), label, True)
        size = int(v.size.get(label, 0) * (1 - len(touched) / v.buckets)) + self._size(made)

        def change(new: Version) -> Version | None:
            now = new.parts.setdefault(label, {})
            if new.deltas.get(label, [])[: len(deltas)] != deltas or new.buckets != v.buckets or any(now.get(b, [])[: len(fs)] != fs for b, fs in was.items()):
                return None
            for b, fs in was.items():
                now[b] = made.get(b, []) + now.get(b, [])[len(fs) :]
                if not now[b]:
                    del now[b]
            new.deltas[label] = new.deltas[label][len(deltas) :]
            new.size[label], new.what = size, "fold"
            return new

        self.commit(change)

    def _merge_run(self, v: Version, label: str) -> None:
        """Makes one delta of the newest ones that are of like size."""
        deltas = v.deltas[label]
        at, total = len(deltas) - 1, deltas[-1][1]
        while at and (len(deltas) - at < RUN or deltas[at - 1][1] <= 2 * total):
            at -= 1
            total += deltas[at][1]
        run = deltas[at:]
        if len(run) < 2:
            return
        made = self._write_delta(v, self._newest(v, run))

        def change(new: Version) -> Version | None:
            now = new.deltas.get(label, [])
            if now[: len(deltas)] != deltas or new.columns != v.columns:
                return None
            new.deltas[label] = now[:at] + [made] + now[len(deltas) :]
            new.what = "merge deltas"
            return new

        self.commit(change)

    def compact(self, most: int = MOST_FOLDERS) -> Version:
        """Folds a source's deltas once they are a share of it, else merges some if they are more than `most`;
        rewrites buckets of more than `most` folders into one folder each."""
        v = self.version()
        for label, deltas in v.deltas.items():
            size = sum(n for _, n in deltas)
            if size >= FOLD_BYTES and size * FOLD_SHARE >= v.size.get(label, 0):
                self._fold(v, label)
            elif len(deltas) > most:
                self._merge_run(v, label)
        v = self.version()
        made: dict[tuple[str, str], tuple[list[str], list[str]]] = {}
        for label, by in v.parts.items():
            crowded = {b: fs for b, fs in by.items() if len(fs) > most}
            if crowded and v.mode == "upsert":
                new = self._write(v, self._bucketed(v, self._named(v, self._raw(v, [f for fs in crowded.values() for f in fs]))), label, True)
                made |= {(label, b): (fs, new.get(b, [])) for b, fs in crowded.items()}
            elif crowded:
                made[label, "0"] = (crowded["0"], self._write(v, self._named(v, self._raw(v, crowded["0"])), label, False)["0"])

        def change(new: Version) -> Version | None:
            for (label, b), (was, now) in made.items():
                held = new.parts.get(label, {}).get(b, [])
                if held[: len(was)] != was:
                    return None
                new.parts[label][b] = now + held[len(was) :]
            new.what = "compact"
            return new if made else None

        return self.commit(change)

    def rebucket(self, buckets: int) -> Version:
        """Deals all rows anew; for tables that have outgrown their buckets (a gigabyte a bucket is a good size)."""
        v = self.version()
        if v.mode != "upsert":
            raise ValueError("append tables have no buckets")
        v.buckets = buckets
        parts = {label: self._write(v, self._bucketed(v, self.read(v.number, label)), label, True) for label in {*v.parts, *v.deltas}}

        def change(new: Version) -> Version:
            if new.number != v.number:
                raise CommitConflict(f"{self.root} was written while its buckets were dealt anew")
            for label, made in parts.items():
                new.set_rows(label, made, self._size(made))
            new.buckets, new.what = buckets, "rebucket"
            return new

        return self.commit(change)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes folders that none of the last versions names; returns how many."""
        named = {f.split("/")[0] for n in self.versions()[-keep_versions:] for f in self.version(n).folders()}
        gone = [n for n in self.store.names("data") if n not in named]
        for n in gone:
            self.store.delete(f"data/{n}")
        return len(gone)

