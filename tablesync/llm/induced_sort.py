"""External induced sorting of suffixes, with common-prefix values.

The text is bytes with segments that each end in a 0; order and common prefixes count up to `depth`
symbols and never reach past a segment's end. S* suffixes (those at a descent's end) are sorted as
tuples of words of 8 symbols or a few less; they induce the L suffixes in one ascending scan, and these the S suffixes
in one descending scan. Scans work on queues keyed by first symbol whose entries come in order:
suffix positions with the common prefix to the entry before. The common prefix of two suffixes
induced one after another is one more than the least value scanned between the inducing ones.

All queues are disk-backed: above `memory` bytes their entries go to files in `folder` and are read
back bucket by bucket. What must fit in memory is one symbol's bucket and the (memory-mapped) text.
The recursion is cut at `depth`: S* tuples are compared by words up to it, which gives the order that
named and recursively sorted S* strings have to that depth.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

NONE = 255


class DiskQueue:
    """Queues of (positions, common prefixes) by symbol, in order of insertion, spilled to files above a bound."""

    def __init__(self, folder: str, name: str, memory: int):
        self.folder, self.name, self.memory = folder, name, memory
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.files: dict[int, list[str]] = {}
        self.bytes, self.written = 0, 0

    def push(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.held.setdefault(symbol, []).append((positions, common))
        self.bytes += positions.nbytes + common.nbytes
        if self.bytes > self.memory:
            for s, parts in self.held.items():
                path = os.path.join(self.folder, f"{self.name}-{self.written}.npz")
                self.written += 1
                np.savez(path, p=np.concatenate([p for p, _ in parts]), c=np.concatenate([c for _, c in parts]))
                self.files.setdefault(s, []).append(path)
            self.held, self.bytes = {}, 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All entries of the symbol so far; None if there are none."""
        parts = []
        for path in self.files.pop(symbol, []):
            with np.load(path) as f:
                parts.append((f["p"], f["c"]))
            os.remove(path)
        held = self.held.pop(symbol, [])
        self.bytes -= sum(p.nbytes + c.nbytes for p, c in held)
        parts += held
        if not parts:
            return None
        return (parts[0][0], parts[0][1]) if len(parts) == 1 else (np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))


class RangeMin:
    """Minima of ranges of a uint8 array, by a sparse table; `longest` is the longest range that is asked for."""

    def __init__(self, a: np.ndarray, longest: int):
        self.width, levels = len(a), max(1, int(longest).bit_length())
        self.table = np.full(levels * len(a), NONE, np.uint8)  # level after level
        self.table[: len(a)] = a
        for k in range(1, levels):
            n, half, at = len(a) - (1 << k) + 1, 1 << (k - 1), k * len(a)
            low = self.table[at - len(a) : at]
            np.minimum(low[:n], low[half : half + n], out=self.table[at : at + n])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """min a[lo:hi] for each pair; none of them empty."""
        level = ((hi - lo).astype(np.float64).view(np.int64) >> 52) - 1023  # a double's exponent
        at = level * self.width
        return np.minimum(self.table.take(at + lo), self.table.take(at + hi - (1 << level)))


class Inducer:
    """Receives scanned entries and pushes what they induce, with common prefixes."""

    def __init__(self, queue: DiskQueue, depth: int):
        self.queue, self.depth = queue, depth
        self.carry = np.zeros(256, np.uint8)  # least value scanned since the last push to a symbol

    def scan(self, common: np.ndarray, at: np.ndarray, positions: np.ndarray, symbols: np.ndarray) -> None:
        """common: of each scanned entry to the one before; entry at[k] induces positions[k] of first symbol symbols[k]."""
        m = len(common)
        if not m:
            return
        low = common.min()
        if not len(at):
            np.minimum(self.carry, low, out=self.carry)
            return
        order = np.argsort(symbols, kind="stable")
        at, positions, symbols = at[order], positions[order], symbols[order]
        first = np.ones(len(at), bool)
        first[1:] = symbols[1:] != symbols[:-1]
        starts = np.flatnonzero(first)
        lo = np.empty_like(at)
        lo[1:] = at[:-1] + 1
        lo[starts] = 0
        ends = np.append(starts[1:], len(at))
        tails = at[ends - 1] + 1
        # a value that is never the least stands behind the last, so that no range is empty
        ranges = RangeMin(np.append(common, np.uint8(NONE)), max(int((at + 1 - lo).max()), m + 1 - int(tails.min())))
        value = ranges(lo, at + 1)
        value[starts] = np.minimum(value[starts], self.carry[symbols[starts]])
        value = np.minimum(value, np.uint8(self.depth - 1)) + np.uint8(1)
        np.minimum(self.carry, low, out=self.carry)
        self.carry[symbols[starts]] = ranges(tails, np.full(len(ends), m + 1))
        for a, b in zip(starts, ends, strict=True):
            self.queue.push(int(symbols[a]), positions[a:b], value[a:b])


_mask = np.array([0] + [((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(1, 8)] + [(1 << 64) - 1], np.uint64)
_above = np.array([1 << 8 * k for k in range(8)], np.uint64)  # the least number of more than k bytes


def sort_tuples(words: np.ndarray, left: np.ndarray, positions: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their next `depth` symbols (within segments), and common prefixes to the one before; words: the 8 symbols from each place, as one number.

    What is equal so far is a group. A round orders all groups by one number an entry: the group's, and
    behind it as many of the next symbols as there is room for.
    """
    out, common = positions.copy(), np.zeros(len(positions), np.uint8)
    pos, place = positions, np.arange(len(positions))  # still to be ordered, and where they go
    group, groups, k = np.zeros(len(positions), np.uint64), 1, 0
    while len(pos):
        take = (64 - (groups - 1).bit_length()) // 8
        key = words[np.minimum(pos + k, len(words) - 1)].astype(np.uint64)
        key &= _mask[np.clip(left[pos] - k, 0, 8)]
        if take < 8:
            key >>= np.uint64(64 - 8 * take)
            key |= group << np.uint64(8 * take)
        by = np.argsort(key)
        pos, key = pos[by], key[by]
        out[place] = pos
        x = key[1:] ^ key[:-1]
        settled = np.flatnonzero((x != 0) & (x < _above[take]) if take < 8 else x) + 1  # differ within their group
        common[place[settled]] = np.minimum(k + take - np.searchsorted(_above[:take], x[settled - 1], "right"), depth)
        tie = np.flatnonzero(x == 0) + 1
        k += take
        rest = left[pos[tie]]
        over = (rest < k) | (k >= depth)  # equal words with an end in them stay tied
        common[place[tie[over]]] = np.minimum(rest[over], depth)
        more = np.zeros(len(pos), bool)
        more[tie[~over]] = True
        head = ~more
        more[tie[~over] - 1] = True
        group = np.cumsum(head[more]).astype(np.uint64)
        groups = int(group[-1]) + 1 if len(group) else 1
        pos, place = pos[more], place[more]
    return out, common


def suffix_buckets(text: np.ndarray, depth: int, folder: str, memory: int = 64 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each first symbol, from the largest down, its suffixes in order and their common prefixes to the one before (0 for a bucket's first).

    text: uint8, segments that are not empty, each followed by a 0.
    """
    n = len(text)
    if not n:
        return
    last_of_run = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    run_of = np.repeat(np.arange(len(last_of_run)), np.diff(last_of_run, prepend=-1))
    after = np.zeros(len(last_of_run), np.int16)
    after[:-1] = text[last_of_run[:-1] + 1]
    small = (text[last_of_run] < after)[run_of]  # S type: what follows the run is larger
    small[text == 0] = True
    runs = (last_of_run[run_of] - np.arange(n) + 1).astype(np.int32)
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)).astype(np.int32) - np.arange(n, dtype=np.int32)
    star = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    symbols = np.flatnonzero(np.bincount(text, minlength=256))

    padded = np.append(text, np.zeros(8, np.uint8))
    words = np.ndarray((n + 1,), ">u8", padded, strides=(1,))  # overlapping reads, no copy

    stars = DiskQueue(folder, "star", memory)
    by = np.argsort(text[star], kind="stable")
    star = star[by]
    cuts = np.searchsorted(text[star], symbols)
    for s, a, b in zip(symbols, cuts, np.append(cuts[1:], len(star)), strict=True):
        if b > a:
            stars.push(int(s), star[a:b], np.zeros(b - a, np.uint8))

    def boundary(a: int, b: int) -> int:
        return int(min(runs[a], runs[b], depth))

    larges, queue = DiskQueue(folder, "large", memory), DiskQueue(folder, "l", memory)
    up = Inducer(queue, depth)
    for s in symbols.tolist():
        seen = None
        while (batch := queue.pop(s)) is not None:
            pos, common = batch
            if seen is None:
                common = common.copy()
                common[0] = 0
            larges.push(s, pos, common)
            seen = pos[-1]
            prev = pos - 1
            sym = text[prev]  # before the first stands the last, which is a 0
            at = np.flatnonzero(sym >= max(s, 1))
            up.scan(common, at, prev[at], sym[at])
        if (batch := stars.pop(s)) is not None:
            pos, common = sort_tuples(words, left, batch[0], depth) if s else batch
            common = common.copy()
            common[0] = boundary(seen, pos[0]) if seen is not None else 0
            prev = pos - 1  # of L type, so there is one and it's no 0
            up.scan(common, np.arange(len(pos)), prev, text[prev])

    queue = DiskQueue(folder, "s", memory)
    down = Inducer(queue, depth)
    for s in symbols[::-1].tolist():
        got: list[tuple[np.ndarray, np.ndarray]] = []
        while (batch := queue.pop(s)) is not None:
            pos, common = batch
            if not got:
                common = common.copy()
                common[0] = 0
            got.append((pos, common))
            prev = pos - 1
            sym = text[prev]
            at = np.flatnonzero(sym - np.uint8(1) < s)  # from 1 to s: 0 wraps to 255
            down.scan(common, at, prev[at], sym[at])
        small_pos = np.concatenate([p for p, _ in got]) if got else np.zeros(0, np.int64)
        small_common = np.concatenate([c for _, c in got]) if got else np.zeros(0, np.uint8)
        large = larges.pop(s)
        if large is None:
            large_pos, large_common = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        else:
            large_pos, large_common = large
            # scanned downwards: an entry's value is to the one above it
            common = np.append(large_common[1:], boundary(large_pos[-1], small_pos[-1]) if len(small_pos) else 0)[::-1].astype(np.uint8)
            pos = large_pos[::-1]
            prev = pos - 1
            sym = text[prev]
            at = np.flatnonzero(sym - np.uint8(1) < s - 1)
            down.scan(common, at, prev[at], sym[at])
        if s:
            # upwards: the value of a small entry is to the one below it
            below = np.append(small_common[1:], boundary(large_pos[-1], small_pos[-1]) if len(large_pos) and len(small_pos) else 0)[: len(small_pos)][::-1].astype(np.uint8)
            yield np.concatenate([large_pos, small_pos[::-1]]), np.concatenate([large_common, below])
