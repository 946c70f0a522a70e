"""Exact substring deduplication across documents, by suffix arrays of content-aligned shards.

A byte goes if a `window`-byte string that covers it also starts in a document of smaller id.

1. Texts are dealt into groups of bounded size. Every window is anchored at the least hash among its
   GRAM-byte grams (leftmost on ties), so equal windows have equal anchors wherever they stand. A group
   sends each of its anchor grams once, and learns which of them other documents have, too.
2. Segments, the windows of one shared anchor, go to a shard by the anchor gram, each distinct one of a
   group once, with its least document. A gram with more than HOT_SEGMENTS occurrences has its segments
   cut into single windows, which go to shards by their own hash: no gram fills a shard. Each shard's
   distinct segments are suffix-sorted by external induced sorting; neighbours with a common prefix of
   `window` bytes are one string, and the smallest document of its segments decides for all others.
3. What is smaller goes back to the groups that asked, which find the segments anew in their texts,
   in the same order, and merge the removed windows into runs.

Rows travel as packed columns: one row per group and target, so what a hot gram or segment costs grows
with the groups and not with its occurrences. Copies of one text are sent once per task; of equal texts
only the smallest id is judged by its windows, the others are covered whole. Long texts are anchored
in slices.

Defined cases: null text is empty; texts below the window lose nothing; repeated ids are no smaller
than each other; a null id counts as larger than all others; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_rows, durable, lean, mix64, powers, text_slices
from .induced_sort import suffix_buckets

WINDOW = 50
#: Bytes of an anchor gram: longer ones are rarer by chance, shorter ones make fewer anchors.
GRAM = 18
#: Text bytes whose anchors meet in one task, of a group of documents, and of a shard's share of the text.
MARK_BYTES, GROUP_BYTES, SHARD_BYTES = 4 << 20, 4 << 20, 2 << 20
#: Occurrences of a gram above which its windows go to shards by their own hash: they would fill a shard.
HOT_SEGMENTS = SHARD_BYTES // (WINDOW + GRAM)
#: Bytes of segments that a group compares at once.
BLOCK_BYTES = 4 << 20
#: Most shuffle partitions that targets are dealt into; a partition works off its targets one by one.
MOST_PARTITIONS = 20_000
#: Text bytes whose anchors are found at once; the temporaries take about 70 times that, and should fit a core's cache.
SLICE = 1 << 16
#: Bytes of queue entries that a shard's sort holds before it goes to disk.
SORT_MEMORY = 64 << 20
_PLACE = np.uint64((1 << 28) - 1)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one compressed block behind a line that says what they are."""
    raw = b"".join(a.tobytes() for a in arrays.values())
    head = json.dumps([len(raw), [[n, a.dtype.str, a.nbytes] for n, a in arrays.items()]])
    return head.encode() + b"\n" + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    head, _, body = blob.partition(b"\n")
    size, what = json.loads(head)
    raw, at, out = pa.decompress(body, size, codec="zstd", asbytes=True) if size else b"", 0, {}
    for name, kind, n in what:
        out[name] = np.frombuffer(raw, np.dtype(kind), n // np.dtype(kind).itemsize, at)
        at += n
    return out


def stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def join(blobs: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """The arrays of many packs end to end; other columns of rows (rest) are left out."""
    parts = [{k: v for k, v in unpack(b).items() if k != "rest"} for b in blobs.to_pylist()]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def by_target(target: np.ndarray, source: int, cols: dict[str, np.ndarray], ends: np.ndarray | None = None) -> pa.Table:
    """One row per run of equal targets: target, source, and each column's part as bytes; ends: where each entry's `bytes` end. No loop over the rows."""
    at = np.flatnonzero(np.diff(target, prepend=target[0] - 1)) if len(target) else np.zeros(0, np.int64)
    cuts = np.append(at, len(target))
    arrays = [pa.array(target[at].astype(np.int32)), pa.array(np.full(len(at), source, np.int32))]
    for name, v in cols.items():
        off = np.append(0, ends)[cuts] if name == "bytes" else cuts * v.dtype.itemsize
        arrays.append(pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(v))]).cast(pa.binary()))
    return pa.table(arrays, names=["target", "source", *cols])


def flat(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a column's rows hold as bytes, end to end, and how many each row has."""
    values, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for chunk in column.chunks:
        if len(chunk):
            cells = chunk.cast(pa.large_binary())
            _, off, data = cells.buffers()
            off = np.frombuffer(off, np.int64)[cells.offset : cells.offset + len(cells) + 1]
            raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
            values.append(np.frombuffer(raw.tobytes(), kind))
            sizes.append(np.diff(off) // np.dtype(kind).itemsize)
    return np.concatenate(values), np.concatenate(sizes)


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor in its text: the text's row, 48 bits of its gram's hash, its first window's start, its number of windows."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < window:
        return none, none.view(np.uint64), none, none
    up, down = powers(n + 1)
    x = data.astype(np.uint64)
    x += np.uint64(1)
    x *= up[:-1]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    h = sums[gram:] - sums[:-gram]
    h *= down[: n - gram + 1]
    h = mix64(h)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, reach = window - gram + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = low & _PLACE
    # an anchor's windows end where the next one's begin, or where windows would leave the text
    new = np.ones(len(at) + 1, bool)
    np.not_equal(at[1:], at[:-1], out=new[1:-1])
    for edge in (offsets[:-1], np.maximum(offsets[1:] - window + 1, offsets[:-1])):
        new[edge[edge <= len(at)]] = True
    begin = np.flatnonzero(new)
    begin, size = begin[:-1], np.diff(begin)
    rows = np.searchsorted(offsets, begin, "right") - 1
    inside = begin + window <= offsets[rows + 1]
    begin, size, rows = begin[inside], size[inside], rows[inside]
    return rows, h[at[begin].astype(np.int64)] >> np.uint64(16), begin, size


def packs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["target", "pack"])


def cuts_of(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal values of a sorted array."""
    at = np.flatnonzero(np.diff(x, prepend=x[0] - 1)) if len(x) else []
    yield from zip(at, [*at[1:], len(x)], strict=True)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def small_order(x: np.ndarray, most: int) -> np.ndarray:
    """The stable order of numbers up to `most`; numpy counts those of at most 16 bits."""
    return np.argsort(x.astype(np.min_scalar_type(most)), kind="stable")


def least_of(data: np.ndarray, length: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Strings that lie side by side: the kind of each, in order of first appearance; a string of each kind; the bytes of all kinds; the least of the values by kind."""
    bounds = np.append(0, np.cumsum(length)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    kind = np.asarray(coded.indices).astype(np.int64)
    pick = np.full(len(coded.dictionary), -1, np.int64)
    pick[kind[::-1]] = np.arange(len(kind))[::-1]
    out = []
    for v in values:
        low = np.full(len(pick), np.iinfo(np.int64).max)
        np.minimum.at(low, kind, v)
        out.append(low)
    distinct = coded.dictionary.buffers()[2]
    return kind, pick, np.frombuffer(distinct, np.uint8)[: int(length[pick].sum())] if distinct else data[:0], out


class Group:
    """A group of texts in an order of their own, whatever order their packs come in."""

    def __init__(self, blobs: pa.ChunkedArray, window: int):
        x, self.window = join(blobs), window
        begin = np.cumsum(x["size"]) - x["size"]
        part = lambda r: x["bytes"][begin[r] : begin[r] + x["size"][r]]
        order = np.lexsort((x["size"], x["tid"], x["doc"]))
        same = np.flatnonzero((np.diff(x["doc"][order]) == 0) & (np.diff(x["tid"][order]) == 0))
        if len(same):
            order = np.array(sorted(order.tolist(), key=lambda r: (x["doc"][r], x["tid"][r], part(r).tobytes())), np.int64)
        self.order, self.doc, self.tid, self.size = order, x["doc"][order], x["tid"][order], x["size"][order]
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.concatenate([x["bytes"][:0], *map(part, order)])

    def raw(self, r: int) -> bytes:
        return self.bytes[self.begin[r] : self.begin[r] + self.size[r]].tobytes()

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, gram, first window's place in the group's bytes, and number of windows of each anchor, in order."""
        got: list[tuple] = []
        r = 0
        while r < len(self.size):
            if self.size[r] > SLICE:  # in slices that share a window less a byte
                for at in range(0, int(self.size[r]) - self.window + 1, SLICE):
                    data = self.bytes[self.begin[r] + at : self.begin[r] + min(int(self.size[r]), at + SLICE + self.window - 1)]
                    _, name, start, n = anchors(data, np.array([0, len(data)]), self.window, GRAM)
                    got.append((np.full(len(n), r), name, start + self.begin[r] + at, n))
                r += 1
                continue
            e = r + max(1, int(np.searchsorted(np.cumsum(self.size[r:]), SLICE, "right")))
            off = np.append(self.begin[r:e], self.begin[e - 1] + self.size[e - 1]) - self.begin[r]
            row, name, start, n = anchors(self.bytes[self.begin[r] : self.begin[r] + off[-1]], off, self.window, GRAM)
            got.append((row + r, name, start + self.begin[r], n))
            r = e
        return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))

    def marks(self) -> dict[str, np.ndarray]:
        """The group's distinct grams: key, least document, whether another one has it, occurrences; in order of documents."""
        row, name, _, _ = self.anchors()
        order = np.argsort(name)
        at = np.flatnonzero(np.diff(name[order], prepend=name[order[:1]] - np.uint64(1))) if len(name) else np.zeros(0, np.int64)
        first, last = (least.reduceat(row[order], at) if len(name) else row for least in (np.minimum, np.maximum))  # rows are in order of documents
        low, high, times = self.doc[first], self.doc[last], np.diff(np.append(at, len(name)))
        by = small_order(first, len(self.size))
        return {"key": name[order[at]][by], "doc": low[by], "many": (low != high)[by].astype(np.uint8), "times": np.minimum(times, 65535)[by].astype(np.uint16)}

    def pieces(self, keys: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
        """Row, place and kind of each piece, in order of shards; of each kind, in the same order: shard, windows, least and largest document, where its bytes end; and the bytes of all kinds.

        keys: the shared grams, sorted; hot: which are cut into windows.
        """
        row, name, place, n = self.anchors()
        bits = np.zeros(1 << 22, bool)  # most grams are no one else's, and most of these end here
        bits[keys & np.uint64(len(bits) - 1)] = True
        row, name, place, n = (v[maybe] for maybe in [bits[name & np.uint64(len(bits) - 1)]] for v in (row, name, place, n))
        at = np.searchsorted(keys, name)
        at[at == len(keys)] = 0
        keep = keys[at] == name if len(keys) else np.zeros(len(name), bool)
        row, name, place, n, at = (v[keep] for v in (row, name, place, n, at))
        many = hot[at] if len(keys) else np.zeros(0, bool)
        target = (name % np.uint64(shards)).astype(np.int64)
        # windows of hot grams, by their own hash
        w, of = ranges(place[many], n[many]), np.repeat(row[many], n[many])
        if len(w):
            up, down = powers(len(self.bytes) + 1)
            sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            own = (mix64((sums[w + self.window] - sums[w]) * down[w]) % np.uint64(shards)).astype(np.int64)
            row, place, n, target = (np.concatenate(v) for v in ((row[~many], of), (place[~many], w), (n[~many], np.ones(len(w), np.int64)), (target[~many], own)))
        order = np.argsort((target << 32) | place)  # a place has one piece
        row, place, n, target = row[order], place[order], n[order], target[order]
        size = n + self.window - 1
        ends = np.cumsum(size)
        heads = np.append(np.flatnonzero(np.diff(target, prepend=-1)), len(target))
        kinds: list[tuple] = []
        a = got = 0
        kind = np.zeros(len(row), np.int64)
        while a < len(row):  # blocks of whole targets, so that not all bytes are held beside their places
            b = int(heads[max(np.searchsorted(heads, a, "right"), np.searchsorted(heads, np.searchsorted(ends, ends[a] + BLOCK_BYTES), "right") - 1)])
            data = self.bytes[ranges(place[a:b], size[a:b])]
            own, pick, distinct, (low, high) = least_of(data, size[a:b], self.doc[row[a:b]], -self.doc[row[a:b]])
            kind[a:b] = own + got
            got += len(pick)
            kinds.append((target[a:b][pick], n[a:b][pick], low, -high, size[a:b][pick], distinct))
            a = b
        if not kinds:
            kinds = [tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, np.uint8),)]
        shard, windows, low, high, length, data = (np.concatenate(c) for c in zip(*kinds, strict=True))
        return row, place, kind, shard, windows, low, high, np.cumsum(length), data

    def copies(self) -> np.ndarray:
        """Which rows are of a text that a smaller id has, too (texts that came from several tasks)."""
        out, low = np.zeros(len(self.doc), bool), {}
        tids, times = np.unique(self.tid, return_counts=True)
        for r in np.flatnonzero(np.isin(self.tid, tids[times > 1])):  # in order of documents
            out[r] = low.setdefault((int(self.tid[r]), self.raw(r)), self.doc[r]) < self.doc[r]
        return out


def smallest_documents(data: np.ndarray, windows: np.ndarray, least: np.ndarray, window: int, folder: str, memory: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments that lie side by side, each with a document: the kind of each; for all kinds one after another, where their windows begin; and the smallest document of each window."""
    kind, pick, distinct, (least,) = least_of(data, windows + window - 1, least)
    # the text: distinct segments, each followed by a 0; bytes are shifted by one (UTF-8 has no 0xFF)
    w = windows[pick]
    place = np.cumsum(w) - w
    inside = np.ones(len(distinct) + len(pick), bool)
    inside[np.cumsum(w + window) - 1] = False
    text = np.zeros(len(inside), np.uint8)
    text[inside] = distinct + np.uint8(1)
    # the segment of a window's start; behind a segment's starts come `window` places without
    owner = np.repeat(np.column_stack([np.arange(len(pick), dtype=np.int32), np.full(len(pick), -1, np.int32)]).ravel(), np.column_stack([w, np.full(len(pick), window)]).ravel())
    smallest = np.empty(int(w.sum()), np.int64)
    for pos, common in suffix_buckets(text, window, folder, memory):
        own = owner[pos]
        live = own >= 0
        group = np.cumsum(common < window)[live]
        pos, own = pos[live], own[live]
        if not len(pos):
            continue
        head = np.flatnonzero(np.diff(group, prepend=-1))
        low = np.minimum.reduceat(least[own], head)
        smallest[pos - window * own] = np.repeat(low, np.diff(np.append(head, len(pos))))
    return kind, place, smallest


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with doc (its id; null is the largest), sha (of its text) and tid (28 bits of that)."""
    rows = docs.withColumns({"doc": F.coalesce(F.col(key).cast("bigint"), F.lit(2**63 - 1)), "sha": F.sha2(F.coalesce(text, F.lit("")), 256)})
    return rows.withColumn("tid", F.conv(F.substring("sha", 1, 7), 16, 10).cast("int"))


def find_repeats(docs: DataFrame, key: str, text: str, window: int, with_rows: bool = False, most: int = HOT_SEGMENTS) -> DataFrame:
    """(doc, tid, n_removed, n_spans, kept_sha256) of texts that lose bytes, each under its smallest id; larger ids of a text are covered whole.

    with_rows: instead, the rows of docs with texts of at least `window` bytes, but for those that are
    covered whole by a smaller id's copy, with what is left of their texts and whether that is less (cut).
    """
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    rest = [c for c in docs.columns if c != text] if with_rows else []
    whole = named(docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("t"), *[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rest)]), "_key", "t")
    total = whole.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    mark_tasks, groups, shards = (max(8, -(-total // n)) for n in (MARK_BYTES, GROUP_BYTES, SHARD_BYTES))
    ours = whole.select("doc", "tid", "sha", "t", *[f"r{i}" for i in range(len(rest))]).where(F.octet_length("t") >= window).sortWithinPartitions("sha", "doc")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each text's smallest id in a task; with_rows: all rows of that id, else one."""
        last = low = None
        for batch in batches:
            keep = []
            for i, (sha, doc) in enumerate(zip(batch.column("sha").to_pylist(), batch.column("doc").to_pylist(), strict=True)):
                if sha != last:
                    keep.append(i)
                    last, low = sha, doc
                elif with_rows and doc == low:
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))
            lean()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts, packed by group."""
        for batch in firsts(batches):
            doc, tid = np.asarray(batch.column("doc")), np.asarray(batch.column("tid"))
            for i, j, data, off in text_slices(batch, "t", 8 << 20):
                group = tid[i:j] % groups
                order = np.argsort(group, kind="stable")
                rows = []
                for a, b in cuts_of(group[order]):
                    part = order[a:b]
                    what = {"doc": doc[i + part], "tid": tid[i + part], "size": (off[part + 1] - off[part]).astype(np.int64), "bytes": np.concatenate([data[off[r] : off[r + 1]] for r in part])}
                    if rest:
                        own = batch.select([f"r{k}" for k in range(len(rest))]).take(pa.array(i + part))
                        what["rest"] = np.frombuffer(stream(own), np.uint8)
                    rows.append((int(group[part[0]]), pack(what)))
                yield packs(rows)

    def find(key_: tuple, texts: pa.Table) -> pa.Table:
        """The grams of a group, by key."""
        x = Group(texts["pack"], window).marks()
        target = (x["key"] % np.uint64(mark_tasks)).astype(np.int64)
        order = small_order(target, mark_tasks)
        out = by_target(target[order], key_[0].as_py(), {k: v[order] for k, v in x.items()})
        lean()
        return out

    def share(key_: tuple, table: pa.Table) -> pa.Table:
        """For each group, those of its grams that several documents have."""
        key, sizes = flat(table["key"], np.uint64)
        doc, many, times = (flat(table[c], t)[0] for c, t in (("doc", np.int64), ("many", np.uint8), ("times", np.uint16)))
        group = np.repeat(table["source"].to_numpy(), sizes)
        order = np.argsort(key)
        at = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - np.uint64(1)))
        of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
        low, high = np.minimum.reduceat(doc[order], at), np.maximum.reduceat(doc[order], at)
        both = (low != high) | (np.maximum.reduceat(many[order], at) > 0)
        hot = np.add.reduceat(times[order].astype(np.int64), at) > most
        keep, hot_of = np.zeros(len(key), bool), np.zeros(len(key), np.uint8)
        keep[order], hot_of[order] = both[of], hot[of]
        keep = np.flatnonzero(keep)
        keep = keep[small_order(group[keep], groups)]
        out = by_target(group[keep], key_[0].as_py(), {"key": key[keep], "hot": hot_of[keep]})
        lean()
        return out

    def told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The shared grams of a group, sorted, and which are hot."""
        key, hot = flat(table["key"], np.uint64)[0], flat(table["hot"], np.uint8)[0]
        order = np.argsort(key)
        return key[order], hot[order].astype(bool)

    def cut(key_: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        """A group's distinct segments, by shard."""
        none = np.zeros(0, np.int64)
        shard, windows, low, high, ends, data = none, none, none, none, none, none.astype(np.uint8)
        if texts.num_rows and marks.num_rows:
            _, _, _, shard, windows, low, high, ends, data = Group(texts["pack"], window).pieces(*told(marks), shards)
        out = by_target(shard, key_[0].as_py(), {"windows": windows.astype(np.uint8), "low": low, "high": high, "bytes": data}, ends)
        lean()
        return out

    def sort(key_: tuple, table: pa.Table) -> pa.Table:
        """Back to each group: runs of its segments' windows that a smaller document than the largest of the group's has, too."""
        windows, sizes = flat(table["windows"], np.uint8)
        windows = windows.astype(np.int64)
        low, high, data = flat(table["low"], np.int64)[0], flat(table["high"], np.int64)[0], flat(table["bytes"], np.uint8)[0]
        group = np.repeat(table["source"].to_numpy(), sizes)
        piece = ranges(np.zeros(len(sizes), np.int64), sizes)  # within its group and shard
        with tempfile.TemporaryDirectory() as folder:  # scratch of this task alone
            kind, place, smallest = smallest_documents(data, windows, low, window, folder, SORT_MEMORY)
        entry = np.repeat(np.arange(len(windows)), windows)
        inside = ranges(np.zeros(len(windows), np.int64), windows)
        by = smallest[np.repeat(place[kind], windows) + inside]
        less = by < high[entry]
        same = (entry[1:] == entry[:-1]) & (by[1:] == by[:-1])
        new, stop = less.copy(), less.copy()
        new[1:] &= ~(less[:-1] & same)
        stop[:-1] &= ~(less[1:] & same)
        p, q = np.flatnonzero(new), np.flatnonzero(stop)
        order = small_order(group[entry[p]], groups)
        p, q = p[order], q[order]
        out = by_target(group[entry[p]], key_[0].as_py(), {"piece": piece[entry[p]].astype(np.int32), "first": inside[p].astype(np.uint8), "n": (q - p + 1).astype(np.uint8), "low": by[p]})
        lean()
        return out

    def spans(group: Group, marks: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Rows of a group that lose bytes: row, starts and ends of what goes."""
        replies = marks.filter(pc.is_valid(marks["piece"]))
        if not replies.num_rows:
            return
        piece, sizes = flat(replies["piece"], np.int32)
        first, n, low = (flat(replies[c], t)[0] for c, t in (("first", np.uint8), ("n", np.uint8), ("low", np.int64)))
        row, place, kind, shard, *_ = group.pieces(*told(marks.filter(pc.is_valid(marks["key"]))), shards)
        mine = np.searchsorted(shard, np.repeat(replies["source"].to_numpy(), sizes)) + piece  # pieces count from their shard's first
        order, times = np.argsort(kind), np.bincount(kind)
        begin, size = (np.cumsum(times) - times)[mine], times[mine]
        run, entry = np.repeat(np.arange(len(size)), size), order[ranges(begin, size)]
        gone = low[run] < group.doc[row[entry]]
        run, entry = run[gone], entry[gone]
        row, a = row[entry], place[entry] - group.begin[row[entry]] + first[run]
        b = a + n[run].astype(np.int64) + window - 1
        by = np.lexsort((a, row))
        row, a, b = row[by], a[by], b[by]
        for c, d in cuts_of(row):
            stop = np.maximum.accumulate(b[c:d])
            new = np.append(True, a[c + 1 : d] > stop[:-1])
            yield int(row[c]), a[c:d][new], stop[np.append(np.flatnonzero(new)[1:] - 1, d - c - 1)]

    def kept(raw: bytes, first: np.ndarray, last: np.ndarray) -> bytes:
        return b"".join([raw[p:q] for p, q in zip([0, *last], [*first, len(raw)], strict=True)])

    def finish(texts: pa.Table, marks: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        if texts.num_rows and marks.num_rows:
            group = Group(texts["pack"], window)
            copy, before = group.copies(), None
            for r, first, last in spans(group, marks):
                if not copy[r] and before != (now := (int(group.doc[r]), int(group.tid[r]))):  # repeated rows lie together
                    before = now
                    for into, v in zip(cols, (*now, int((last - first).sum()), len(first), hashlib.sha256(kept(group.raw(r), first, last)).hexdigest()), strict=True):
                        into.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        lean()
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "tid", "n_removed", "n_spans", "kept_sha256"])

    def rewrite(texts: pa.Table, marks: pa.Table) -> pa.Table:
        """All rows of a group but the copies, with what is left of their texts."""
        empty = pa.schema([(f"r{i}", t) for i, t in enumerate(kinds_of_rest)] + [("t", pa.string()), ("cut", pa.bool_())])
        if not texts.num_rows:
            return empty.empty_table()
        group = Group(texts["pack"], window)
        own = pa.concat_tables([pa.ipc.open_stream(unpack(b)["rest"].tobytes()).read_all() for b in texts["pack"].to_pylist()]) if rest else None
        left = {r: kept(group.raw(r), first, last) for r, first, last in spans(group, marks)} if marks.num_rows else {}
        live = np.flatnonzero(~group.copies())
        out = [left.get(int(r), group.raw(r) if int(r) not in left else b"").decode("utf-8", "ignore") for r in live]
        arrays = [own[f"r{i}"].combine_chunks().take(pa.array(group.order[live])) for i in range(len(rest))]
        lean()
        return pa.table([*arrays, pa.array(out, pa.string()), pa.array([int(r) in left for r in live], pa.bool_())], names=empty.names)

    packed = "target int, pack binary"
    marked, shared = "target int, source int, key binary, doc binary, many binary, times binary", "target int, source int, key binary, hot binary"
    sent, back = "target int, source int, windows binary, low binary, high binary, bytes binary", "target int, source int, piece binary, first binary, n binary, low binary"

    def dealt(rows: DataFrame, targets: int) -> DataFrame:
        """A partition for each target, as far as that goes, so that no task gets many of them by chance."""
        return rows.repartition(min(targets, MOST_PARTITIONS), "target")

    once = dealt(ours.mapInArrow(send, packed), groups)
    marks = dealt(once.groupBy("target").applyInArrow(find, marked), mark_tasks).groupBy("target").applyInArrow(share, shared)
    segments = once.groupBy("target").cogroup(dealt(marks, groups).groupBy("target")).applyInArrow(cut, sent)
    runs = dealt(segments, shards).groupBy("target").applyInArrow(sort, back)
    both = once.groupBy("target").cogroup(dealt(marks.unionByName(runs, allowMissingColumns=True), groups).groupBy("target"))
    if not with_rows:
        return both.applyInArrow(finish, "doc bigint, tid int, n_removed bigint, n_spans bigint, kept_sha256 string")
    kinds_of_rest = [f.type for f in to_arrow_schema(docs.select(*[f"`{c}`" for c in rest]).schema)] if rest else []
    out = ", ".join([*[f"r{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)], "t string, cut boolean"])
    return both.applyInArrow(rewrite, out).select(*[F.col(f"r{rest.index(c)}").alias(c) if c != text else F.col("t").alias(c) for c in docs.columns], "cut")


def copies(rows: DataFrame, first: DataFrame, window: int) -> DataFrame:
    """rows (with sha, doc, n_bytes) with copy: whether a smaller id has the whole text."""
    return rows.join(first, "sha", "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= window))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, most: int = HOT_SEGMENTS) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row; most: occurrences above which a gram is hot."""
    changed = find_repeats(docs, key, text, window, most=most)
    light = named(docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("t")), "_key", "t").select("doc", "_key", "tid", "sha", F.octet_length("t").cast("bigint").alias("n_bytes"))
    # only texts that stand in several rows, written first: a join with it can split a text that many rows share
    first = durable(light.groupBy("sha").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "substring-first", few=True)
    rows = copies(light, first, window).join(changed, ["doc", "tid"], "left")
    return rows.select(
        F.col("_key").alias(key), "n_bytes", F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated passages taken out of the texts, and a column `cut`: whether a text lost some.

    Rows whose whole text a smaller id has are left out; fragments of a character that a cut splits go.
    Rows travel with their texts, so nothing is joined back.
    """
    short_ = F.octet_length(F.coalesce(text, F.lit(""))) < window
    return find_repeats(docs, key, text, window, with_rows=True).unionByName(docs.where(short_).withColumn("cut", F.lit(False)))
