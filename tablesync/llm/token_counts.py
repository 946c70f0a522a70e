"""Token counts by a compiled finite-state tokenizer.

The vocabulary is compiled, state by state and on demand, into a deterministic transducer over
bytes. A state stands for all that decides the future of a BPE run: the longest suffix that can
still grow into a token, with the last token and the relative count at each place in it. By the
pair property of BPE (an encoding is right exactly if each adjacent pair of tokens re-encodes to
itself) the last token of every prefix is unique, so each transition carries one number: the change
of the token count. Pieces of the split pattern are found by classes of characters; a piece begins
in the start state. Long pieces are cut into chunks: each chunk has a map from incoming state to end
state and count, and a scan over the levels of a tree composes neighbouring maps, as many passes as
there are levels (see ChunkMaps). Runs are vectorised: all distinct pieces advance one byte at a time.

Defined cases: null text is empty and has 0 tokens; strings of special tokens in a text count as
the library's default does (one token each); repeated rows give repeated results; a kept column
named as one of MADE gets `_kept` behind its name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, carry, text_slices
from .pieces import byte_table, part_bounds, piece_starts

#: Bytes of a chunk of a long piece.
CHUNK = 64
#: A text above this many bytes is counted in parts.
PART_BYTES = 4 << 20
#: Compiled states that a worker keeps; beyond that it starts anew between two batches, so memory stays bounded.
MOST_STATES = 250_000
MADE = ("n_bytes", "n_tokens", "over_limit")


class CountingTransducer:
    """Lazily determinised transducer of one vocabulary; `counts` runs it over pieces."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], int], specials: list[bytes]):
        self.ids, self.merges, self.specials = tokens, merges, specials
        self.by_id = {i: t for t, i in tokens.items()}
        self.prefixes = {t[:k] for t in tokens for k in range(1, len(t) + 1)} | {b""}
        self.reset()

    def reset(self) -> None:
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, int] = {}
        self.what: list[tuple] = []
        self.size = 1 << 16
        self.keys, self.next, self.out, self.used = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32), np.zeros(self.size, np.int32), 0
        self.start = self.state((b"", (-1,), (0,)))

    def state(self, what: tuple) -> int:
        if (s := self.states.get(what)) is None:
            s = self.states[what] = len(self.what)
            self.what.append(what)
        return s

    def encode(self, piece: bytes) -> list[int]:
        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            best = min((self.merges.get(p, 1 << 40) for p in zip(ids, ids[1:], strict=False)))
            if best == 1 << 40:
                break
            joined, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.merges.get((ids[i], ids[i + 1])) == best:
                    joined.append(best)
                    i += 2
                else:
                    joined.append(ids[i])
                    i += 1
            ids = joined
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a within a piece."""
        if (ok := self.pairs.get((a, b))) is None:
            ok = self.pairs[a, b] = self.encode(self.by_id[a] + self.by_id[b]) == [a, b]
        return ok

    def step(self, s: int, byte: int) -> tuple[int, int]:
        """The transition of state s: the next state, and the change of the count."""
        suffix, last, count = self.what[s]
        grown = suffix + bytes((byte,))
        found = None
        for k in range(len(grown)):
            t = self.ids.get(grown[k:])
            if t is not None and (last[k] == -1 or self.fits(last[k], t)):
                found = (t, count[k] + 1)
                break
        if found is None:
            raise ValueError("no token ends here; the vocabulary has no proper merges")
        k = 0
        while grown[k:] not in self.prefixes:
            k += 1
        delta, left = found[1], grown[k:]
        grows = [left[i:] in self.prefixes for i in range(len(left))]  # only there a token can begin that ends later
        last = (*(a if g else -2 for a, g in zip(last[k:], grows, strict=True)), found[0])
        return self.state((left, last, (*(c - delta if g else 0 for c, g in zip(count[k:], grows, strict=True)), 0))), delta

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and whether it holds it; else the free slot where it belongs."""
        mask = self.size - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask
        held = self.keys[at]
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            h = self.keys[at[todo]]
            todo = todo[(h != keys[todo]) & (h != -1)]
        return at, self.keys[at] == keys

    def _fill(self, keys: np.ndarray, nxt: np.ndarray, out: np.ndarray) -> None:
        """Puts transitions that are not held yet into their slots."""
        todo = np.arange(len(keys))
        while len(todo):
            at, _ = self._slots(keys[todo])
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.next[at[first]], self.out[at[first]] = keys[todo[first]], nxt[todo[first]], out[todo[first]]
            todo = np.delete(todo, first)

    def _put(self, keys: np.ndarray, nxt: np.ndarray, out: np.ndarray) -> None:
        self.used += len(keys)
        if 2 * self.used > self.size:
            keep = np.flatnonzero(self.keys != -1)
            held = self.keys[keep], self.next[keep], self.out[keep]
            while 2 * self.used > self.size:
                self.size *= 2
            self.keys, self.next, self.out = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32), np.zeros(self.size, np.int32)
            self._fill(*held)
        self._fill(keys, nxt, out)

    def advance(self, states: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of each lane; missing ones are compiled."""
        keys = states.astype(np.int64) * 256 + bytes_
        at, ok = self._slots(keys)
        if not ok.all():
            new = np.unique(keys[~ok])
            self._put(new, *np.array([self.step(key >> 8, key & 255) for key in new.tolist()]).T)
            at, _ = self._slots(keys)
        return self.next[at], self.out[at]

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End state and count of each lane data[start:end] from its state."""
        order = np.argsort(-(ends - starts), kind="stable")
        at, length, s = starts[order], (ends - starts)[order], states[order].copy()
        total, alive, k = np.zeros(len(s), np.int64), len(s), 0
        while True:
            alive = int(np.searchsorted(-length[:alive], -k, "left"))
            if not alive:
                break
            s[:alive], d = self.advance(s[:alive], data[at[:alive] + k])
            total[:alive] += d
            k += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return s[back], total[back]

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The token count of each piece data[start:end]. Pieces above CHUNK bytes go through the maps of their chunks."""
        n = ends - starts
        short = n <= CHUNK
        total = np.zeros(len(starts), np.int64)
        _, total[short] = self.run(data, starts[short], ends[short], np.full(int(short.sum()), self.start, np.int64))
        if len(long := np.flatnonzero(~short)):
            total[long] = ChunkMaps(self, data, starts[long], ends[long]).counts()
        return total

    def text_counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The token count of each text data[offsets[i]:offsets[i + 1]] (UTF-8)."""
        if len(offsets) == 2 and len(data) > PART_BYTES:
            bounds = part_bounds(data, PART_BYTES)
            if len(bounds) > 2:
                return sum(self.text_counts(data[a:b], np.array([0, b - a])) for a, b in zip(bounds, bounds[1:], strict=False))
        if len(self.what) > MOST_STATES:
            self.reset()
        blob, extra, cuts = data.tobytes(), np.zeros(len(offsets) - 1, np.int64), []
        for special in self.specials:  # a special token ends what stands before it and starts what follows
            at = blob.find(special)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(special) <= offsets[row + 1]:
                    cuts.append((at, at + len(special)))
                    extra[row] += 1
                at = blob.find(special, at + (len(special) if cuts and cuts[-1][0] == at else 1))
        if cuts:
            cuts.sort()
            keep = np.ones(len(data), bool)
            for a, b in cuts:
                keep[a:b] = False
            gone = np.concatenate(([0], np.cumsum(~keep)))
            breaks = np.unique(np.concatenate((offsets, [a for a, _ in cuts])))
            rows = np.searchsorted(offsets, breaks[:-1], "right") - 1
            inner = self._counts(data[keep], breaks - gone[breaks])
            np.add.at(extra, rows, inner)
            return extra
        return self._counts(data, offsets)

    def _counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        edges = piece_starts(data, offsets)
        bounds = np.append(edges, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = pieces.dictionary
        off = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
        n = self.counts(np.frombuffer(words.buffers()[2], np.uint8), off[:-1], off[1:])
        sums = np.concatenate(([0], np.cumsum(n[np.asarray(pieces.indices)])))
        at = np.searchsorted(edges, offsets, "left")
        return sums[at[1:]] - sums[at[:-1]]


class ChunkMaps:
    """The maps of the chunks of long pieces, and of runs of chunks, from incoming state to end state and count.

    A piece's chunks fill an aligned block of a power of two, so a run of level k is 2**k chunks and the
    composition of two runs of level k - 1. Maps are partial: the scan goes up the levels and asks each
    run for the states that most texts bring there (those of starts one to ROUNDS chunks earlier, as most
    chunks forget what came before); where the run on its left ends in another, the map on the right is
    extended by that state, down to the chunks that don't know it. All runs of a level are composed at
    once, and runs of equal bytes are one run.
    """

    ROUNDS = 3

    def __init__(self, machine: CountingTransducer, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.machine, self.data = machine, data
        chunks = -(-(ends - starts) // CHUNK)
        self.height = np.array([int(c - 1).bit_length() for c in chunks.tolist()])
        self.order = np.argsort(-self.height, kind="stable")  # larger blocks first, so all are aligned
        starts, ends, chunks, self.height = starts[self.order], ends[self.order], chunks[self.order], self.height[self.order]
        size = 1 << self.height
        self.block = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(size)), size)
        nth = np.arange(len(piece)) - self.block[piece]
        # chunks behind a piece's end are empty: their map is the identity
        self.a = np.minimum(starts[piece] + nth * CHUNK, ends[piece])
        self.b = np.minimum(self.a + CHUNK, ends[piece])
        self.first, self.piece, self.real = nth == 0, piece, nth < chunks[piece]
        cells = np.zeros((len(self.a), CHUNK + 1), np.uint8)
        inside = np.arange(CHUNK)
        there = self.a[:, None] + inside < self.b[:, None]
        cells[:, :CHUNK][there] = data[(self.a[:, None] + inside)[there]]
        cells[:, CHUNK] = self.b - self.a
        _, pick, kind = np.unique(cells.view(np.dtype((np.void, CHUNK + 1))).ravel(), return_index=True, return_inverse=True)
        self.a0, self.b0 = self.a[pick], self.b[pick]
        self.kind, self.parts = [kind], [np.zeros((0, 2), np.int64)]
        for _ in range(int(self.height.max())):  # a run's kind: the kinds of its halves
            low = np.append(self.kind[-1], np.zeros(len(self.kind[-1]) % 2, np.int64))
            pairs, _kind = np.unique(low[::2] << 32 | low[1::2], return_inverse=True)
            self.kind.append(_kind)
            self.parts.append(np.column_stack([pairs >> 32, pairs & 0xFFFFFFFF]))
        self.maps = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(int(self.height.max()) + 1)]
        self.passes = 0

    def apply(self, level: int, kind: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End state and count of each kind of run of 2**level chunks from a state; what its map lacks is composed and kept."""
        keys, back = np.unique(kind << 32 | state, return_inverse=True)
        known, end, count = self.maps[level]
        at = np.searchsorted(known, keys)
        lacks = np.ones(len(keys), bool)
        lacks[at < len(known)] = known[at[at < len(known)]] != keys[at < len(known)]
        if lacks.any():
            new = keys[lacks]
            kind, state = new >> 32, new & 0xFFFFFFFF
            if level:
                left, right = self.parts[level][kind].T
                middle, n = self.apply(level - 1, left, state)
                last, more = self.apply(level - 1, right, middle)
                n = n + more
            else:
                last, n = self.machine.run(self.data, self.a0[kind], self.b0[kind], state)
                self.passes += 1
            known, end, count = np.concatenate([known, new]), np.concatenate([end, last]), np.concatenate([count, n])
            by = np.argsort(known)
            self.maps[level] = known, end, count = known[by], end[by], count[by]
            at = np.searchsorted(known, keys)
        return end[at][back], count[at][back]

    def counts(self) -> np.ndarray:
        """The token count of each piece."""
        start = np.full(len(self.a), self.machine.start, np.int64)
        comes, later = start.copy(), np.flatnonzero(~self.first)
        for _ in range(self.ROUNDS):
            end, _ = self.apply(0, self.kind[0], comes)
            comes[later] = end[later - 1]
        for level in range(len(self.maps)):
            head = np.arange(0, len(self.a), 1 << level)
            head = head[self.real[head] & (self.height[self.piece[head]] >= level)]
            self.apply(level, self.kind[level][head >> level], comes[head])
        out = np.empty(len(self.block), np.int64)
        for level in np.unique(self.height).tolist():
            at = np.flatnonzero(self.height == level)
            _, out[self.order[at]] = self.apply(level, self.kind[level][self.block[at] >> level], start[at])
        return out


@lru_cache(maxsize=2)
def transducer(path: str) -> CountingTransducer:
    """Compiled from a byte-level BPE file of the tokenizers library that splits by the common pattern."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    back = {c: b for b, c in enumerate(byte_table())}
    raw = lambda t: bytes(back[c] for c in t)
    vocab = spec["model"]["vocab"]
    merges = {}
    for m in spec["model"]["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        merges[vocab[a], vocab[b]] = vocab[a + b]
    special = [t["content"].encode() for t in spec["added_tokens"]]
    return CountingTransducer({raw(t): i for t, i in vocab.items() if t.encode() not in special}, merges, special)


def count_tokens(docs: DataFrame, path: str, limit: int, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, n_bytes, n_tokens, over_limit of every row."""
    arrow_rows(docs.sparkSession)
    cols, names = carry(docs, keep, MADE)
    src = docs.select(*cols, F.col(text).alias("_text"))
    schema = ", ".join([f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, src.schema.fields, strict=False)] + ["n_bytes bigint", "n_tokens bigint", "over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            for i, j, data, off in text_slices(batch, "_text"):
                n, part = machine.text_counts(data, off), batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{k}") for k in range(len(names))), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=[*names, *MADE])

    return src.mapInArrow(run, schema)
