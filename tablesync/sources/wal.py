"""The logical-replication message format, log folders, and a streaming source over them.

Messages: R relation, B begin, C commit, I insert, U update, D delete, T truncate, big-endian. Rows of
a transaction are given out with its commit only. A log folder holds files `<first lsn, 16 hex
digits>.wal` of frames (lsn 8 bytes, length 4 bytes, message), which must be closed before they get
that name. The source's offset is the position behind the last commit read and the relations known
there, so a restart decodes on without reading back.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators.changes import DELETE, INSERT, SCHEMA, TRUNCATE, UPDATE

ROW = "lsn bigint, seq bigint, xid bigint, rel string, op int, new array<string>, old array<string>, unchanged array<boolean>, ddl string"


class WalError(ValueError):
    pass


class Reader:
    """A cursor over a message."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, fmt: str) -> int:
        size = struct.calcsize(">" + fmt)
        if self.at + size > len(self.data):
            raise WalError("message ends early")
        (value,) = struct.unpack_from(">" + fmt, self.data, self.at)
        self.at += size
        return value

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise WalError("text without an end")
        value = self.data[self.at : end].decode("utf-8")
        self.at = end + 1
        return value

    def byte(self) -> str:
        return chr(self.number("B"))

    def row(self) -> tuple[list[str | None], list[bool]]:
        """Values of a tuple and which of them are marked unchanged."""
        values, same = [], []
        for _ in range(self.number("H")):
            kind = self.byte()
            if kind in "nu":
                values.append(None)
            elif kind in "tb":
                n = self.number("i")
                if self.at + n > len(self.data):
                    raise WalError("message ends early")
                values.append(self.data[self.at : self.at + n].decode("utf-8"))
                self.at += n
            else:
                raise WalError(f"unknown kind of value {kind!r}")
            same.append(kind == "u")
        return values, same


@dataclass
class Relation:
    id: int
    schema: str
    name: str
    columns: list[tuple[str, int]]
    identity: str = "f"
    key: list[int] = field(default_factory=list)

    @property
    def full(self) -> str:
        return f"{self.schema}.{self.name}"


def read_relation(r: Reader) -> Relation:
    rel, schema, name, identity = r.number("I"), r.text(), r.text(), r.byte()
    columns, key = [], []
    for i in range(r.number("H")):
        if r.number("B") & 1:
            key.append(i)
        column, oid = r.text(), r.number("I")
        r.number("i")
        columns.append((column, oid))
    return Relation(rel, schema or "pg_catalog", name, columns, identity, key)


class Decoder:
    """Turns messages into change rows; holds the relations and the open transaction."""

    def __init__(self, relations: dict[int, Relation] | None = None):
        self.relations = relations or {}
        self.open: list[tuple] = []
        self.xid, self.seq = 0, 0

    def state(self) -> list:
        return [[r.id, r.schema, r.name, r.columns, r.identity, r.key] for r in self.relations.values()]

    @classmethod
    def of(cls, state: list) -> Decoder:
        return cls({r[0]: Relation(r[0], r[1], r[2], [tuple(c) for c in r[3]], r[4], r[5]) for r in state})

    def _add(self, lsn: int, rel: str, op: int, new=None, old=None, same=None, ddl=None) -> None:
        self.seq += 1
        self.open.append((lsn, self.seq, self.xid, rel, op, new, old, same, ddl))

    def _relation(self, rel: int) -> Relation:
        if rel not in self.relations:
            raise WalError(f"relation {rel} was not described")
        return self.relations[rel]

    def feed(self, lsn: int, message: bytes) -> list[tuple]:
        """Rows that this message completes: those of a transaction at its commit."""
        if not message:
            return []
        r = Reader(message)
        kind = r.byte()
        if kind == "B":
            r.number("Q"), r.number("q")
            self.xid, self.open, self.seq = r.number("I"), [], 0
        elif kind == "C":
            r.number("B")
            r.number("Q")
            end = r.number("Q")
            rows = [(end, *row[1:]) for row in self.open]  # a transaction's rows share its end position; seq orders them
            self.open = []
            return rows
        elif kind == "R":
            new = read_relation(r)
            old = self.relations.get(new.id)
            self.relations[new.id] = new
            if old is None or old.columns != new.columns or old.full != new.full:
                self._add(lsn, new.full, SCHEMA, ddl=json.dumps({"id": new.id, "was": old.full if old else None, "old": old.columns if old else None, "new": new.columns}))
        elif kind == "I":
            rel = self._relation(r.number("I"))
            r.byte()
            values, same = r.row()
            self._add(lsn, rel.full, INSERT, values, None, same)
        elif kind == "U":
            rel, old = self._relation(r.number("I")), None
            tag = r.byte()
            if tag in "KO":
                old, _ = r.row()
                tag = r.byte()
            if tag != "N":
                raise WalError("update without a new row")
            values, same = r.row()
            self._add(lsn, rel.full, UPDATE, values, old, same)
        elif kind == "D":
            rel = self._relation(r.number("I"))
            r.byte()
            old, _ = r.row()
            self._add(lsn, rel.full, DELETE, None, old, None)
        elif kind == "T":
            n = r.number("I")
            r.number("B")
            for rel in [self._relation(r.number("I")) for _ in range(n)]:
                self._add(lsn, rel.full, TRUNCATE)
        return []  # other kinds (origin, type, logical message) carry no rows


# -- encoding, for tests and for writing logs


def _text(s: str) -> bytes:
    return s.encode() + b"\0"


def _row(values: list, same: list[bool] | None = None) -> bytes:
    out = struct.pack(">H", len(values))
    for i, v in enumerate(values):
        if same and same[i]:
            out += b"u"
        elif v is None:
            out += b"n"
        else:
            raw = str(v).encode()
            out += b"t" + struct.pack(">i", len(raw)) + raw
    return out


def encode_begin(lsn: int, xid: int) -> bytes:
    return b"B" + struct.pack(">QqI", lsn, 0, xid)


def encode_commit(lsn: int, end: int) -> bytes:
    return b"C" + struct.pack(">BQQq", 0, lsn, end, 0)


def encode_relation(r: Relation) -> bytes:
    out = b"R" + struct.pack(">I", r.id) + _text(r.schema) + _text(r.name) + r.identity.encode() + struct.pack(">H", len(r.columns))
    for i, (name, oid) in enumerate(r.columns):
        out += struct.pack(">B", i in r.key) + _text(name) + struct.pack(">Ii", oid, -1)
    return out


def encode_insert(rel: int, values: list) -> bytes:
    return b"I" + struct.pack(">I", rel) + b"N" + _row(values)


def encode_update(rel: int, values: list, old: list | None = None, same: list[bool] | None = None) -> bytes:
    return b"U" + struct.pack(">I", rel) + (b"O" + _row(old) if old is not None else b"") + b"N" + _row(values, same)


def encode_delete(rel: int, old: list) -> bytes:
    return b"D" + struct.pack(">I", rel) + b"O" + _row(old)


def encode_truncate(rels: list[int]) -> bytes:
    return b"T" + struct.pack(">IB", len(rels), 0) + b"".join(struct.pack(">I", r) for r in rels)


class LogWriter:
    """Writes transactions into a log folder, one file each."""

    def __init__(self, folder: str, lsn: int = 1):
        self.folder, self.lsn, self.xid = folder, lsn, 0
        os.makedirs(folder, exist_ok=True)

    def transaction(self, *messages: bytes) -> int:
        """Returns the position behind the commit."""
        self.xid += 1
        first = self.lsn
        frames = [encode_begin(first, self.xid), *messages]
        end = first + len(frames) + 1
        frames.append(encode_commit(end - 1, end))
        path = os.path.join(self.folder, f"{first:016x}.wal")
        with open(path + ".new", "wb") as f:
            for i, m in enumerate(frames):
                f.write(struct.pack(">QI", first + i, len(m)) + m)
        os.rename(path + ".new", path)
        self.lsn = end
        return end


def frames(folder: str, start: int) -> Iterator[tuple[int, bytes]]:
    """Messages at or behind a position; files that end before it aren't opened."""
    names = sorted(n for n in os.listdir(folder) if n.endswith(".wal"))
    firsts = [int(n[:16], 16) for n in names]
    for k, name in enumerate(names):
        if k + 1 < len(names) and firsts[k + 1] <= start:
            continue
        with open(os.path.join(folder, name), "rb") as f:
            while head := f.read(12):
                lsn, n = struct.unpack(">QI", head)
                message = f.read(n)
                if len(head) < 12 or len(message) < n:
                    raise WalError(f"{name} ends early")
                if lsn >= start:
                    yield lsn, message


class WalReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options.get("maxMessages", "100000"))

    def initialOffset(self) -> dict:
        return {"lsn": 0, "relations": "[]"}

    def _decode(self, start: dict, stop: int | None) -> tuple[list[tuple], dict]:
        """Whole transactions from start: up to stop, or until the bound on messages is passed."""
        decoder = Decoder.of(json.loads(start["relations"]))
        at, rows, seen, known = start["lsn"], [], 0, start["relations"]
        for lsn, message in frames(self.folder, start["lsn"]):
            if stop is not None and lsn >= stop:
                break
            done = decoder.feed(lsn, message)
            rows += done
            seen += 1
            if message[:1] == b"C":
                at, known = lsn + 1, json.dumps(decoder.state())
                if stop is None and seen >= self.most:
                    break
        return rows, {"lsn": at, "relations": known}

    def read(self, start: dict):
        rows, end = self._decode(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._decode(start, end["lsn"])[0])

    def commit(self, end: dict) -> None:
        """Nothing to acknowledge: who keeps the log reads the confirmed position from the catalog."""


class WalSource(DataSource):
    """spark.readStream.format("tablesync_wal").option("path", folder).option("maxMessages", n)"""

    @classmethod
    def name(cls) -> str:
        return "tablesync_wal"

    def schema(self) -> str:
        return ROW

    def simpleStreamReader(self, schema) -> WalReader:
        return WalReader(self.options)
