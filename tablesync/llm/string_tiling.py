"""Benchmark decontamination by greedy string tiling.

Words of a document and of a test item are compared by Karp-Rabin hashes. Documents that share a seed
(SEED words in a row) with an item are tiled against it: again and again the longest matches that
overlap no earlier one are marked, down to the seed length, so passages that were reordered are still
covered. An item leaks into a document if the tiles cover at least COVERAGE of its words.

Items are handled in blocks of ITEM_WORDS words; each block's index is broadcast (its size is bounded
by that), and documents are read once a block. Words are runs of letters and digits, in lower case.

Defined cases: null or empty texts, and texts without a shared seed, have no row in `tiles`; items of
fewer than SEED words are matched only as a whole; a null item is skipped; repeated rows give
repeated results; ties of longest matches go to the earliest place in the document, then in the
item; a kept column named as one of MADE gets `_kept` behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, carry, mix64, span_hashes, text_slices
from .language_id import lowered
from .pieces import LETTER, NUMBER, char_classes

SEED = 5
COVERAGE = 0.5
ITEM_WORDS = 2_000_000
MADE = ("item_id", "item_words", "covered", "longest", "coverage", "leaked")


class TextWords:
    """The words of texts that lie side by side: hashes, where each text's begin (and the end), and the words themselves."""

    def __init__(self, texts: list[str]):
        low = [lowered(t) for t in texts]
        self.text = "".join(low)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        edge = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
        kind = char_classes()[points]
        word = (kind == LETTER) | (kind == NUMBER)
        new = np.zeros(len(points) + 1, bool)
        new[edge] = True
        before = np.concatenate(([False], word[:-1])) if len(word) else word
        self.start = np.flatnonzero(word & (~before | new[:-1]))
        after = np.concatenate((word[1:], [False])) if len(word) else word
        self.end = np.flatnonzero(word & (~after | new[1:])) + 1
        self.hashes, self.begin = span_hashes(points, self.start, self.end), np.searchsorted(self.start, edge, "left")

    def of(self, row: int) -> list[str]:
        a, b = self.begin[row], self.begin[row + 1]
        return [self.text[p:q] for p, q in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin (and the end)."""
    words = TextWords(texts)
    return words.hashes, words.begin


def numbered(doc: list[str], item: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers that are equal for equal words only; -1 for words of doc that item lacks."""
    number = {w: k for k, w in enumerate(dict.fromkeys(item))}
    return np.array([number.get(w, -1) for w in doc], np.int64), np.array([number[w] for w in item], np.int64)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of size words."""
    n = len(words) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix64(h)


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length): longest first, none shorter than `least`, none overlapping.

    Each round walks the item backwards and holds, for every place of the document that a seed covers,
    the length of the free match that begins there and at the item's word: array operations over the
    document, no pairs of places. Only the longest matches are listed, and a tile that is marked takes
    those that overlap it off the list at once.
    """
    doc, item = doc.astype(np.int64), item.astype(np.int64)
    seeds = np.flatnonzero(np.isin(grams(doc.astype(np.uint64), least), grams(item.astype(np.uint64), least)))
    if not len(seeds):
        return []
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, seeds, 1)
    np.add.at(cover, seeds + least, -1)
    at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    place, words = np.insert(at, gaps, -1), np.insert(doc[at], gaps, -2)  # a break between stretches
    free = np.ones(len(item), bool)
    doc_free = place >= 0
    tiles: list[tuple[int, int, int]] = []
    while True:
        best, found = least, []
        run = np.zeros(len(words) + 1, np.int32)
        for j in range(len(item) - 1, -1, -1):
            if not free[j]:
                run[:] = 0
                continue
            run[:-1] = np.where((words == item[j]) & doc_free, run[1:] + 1, 0)
            top = int(run.max())
            if top >= best:
                found = found if top == best else []
                best = top
                found.append((j, np.flatnonzero(run[:-1] == top).astype(np.int32)))
        if not found:
            return tiles
        i = np.concatenate([x for _, x in found])
        j = np.repeat(np.array([k for k, _ in found], np.int32), [len(x) for _, x in found])
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        while len(i):
            a, b = int(i[0]), int(j[0])
            doc_free[a : a + best] = free[b : b + best] = False
            tiles.append((int(place[a]), b, best))
            apart = (i >= a + best) & (np.abs(j - b) >= best)  # in order of i, so none begins earlier
            i, j = i[apart], j[apart]


class ItemIndex:
    """Seeds of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], seed: int):
        found = TextWords(texts)
        self.ids, self.seed = ids, seed
        self.words = [found.of(k) for k in range(len(ids))]
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (a, b) in enumerate(zip(found.begin[:-1], found.begin[1:], strict=True)):
            w = found.hashes[a:b]
            if len(w):
                size = min(seed, len(w))
                g = grams(w, size)
                by.setdefault(size, []).append((g, np.full(len(g), k)))
        self.sizes = {}
        for size, parts in by.items():
            g, k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((k, g))
            g, k = g[order], k[order]
            once = np.ones(len(g), bool)
            once[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
            g, k = g[once], k[once]
            bits = np.zeros(1 << 20, bool)
            bits[g >> np.uint64(44)] = True
            self.sizes[size] = (g, k, bits)

    def candidates(self, words: np.ndarray, begin: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) pairs that share a seed, in order; a seed that a text repeats is looked up once."""
        found = [np.zeros((0, 2), np.int64)]
        for size, (g, k, bits) in self.sizes.items():
            h = grams(words, size)
            at = np.flatnonzero(bits[h >> np.uint64(44)])
            lo, hi = np.searchsorted(g, h[at], "left"), np.searchsorted(g, h[at], "right")
            row = np.searchsorted(begin, at, "right") - 1
            ok = (hi > lo) & (at + size <= begin[row + 1])
            pairs = np.unique(np.column_stack([row[ok], lo[ok], hi[ok]]), axis=0)
            n = pairs[:, 2] - pairs[:, 1]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(pairs[:, 1], n)
            found.append(np.unique(np.column_stack([np.repeat(pairs[:, 0], n), k[place]]), axis=0))
        return [(r, k) for r, k in np.unique(np.concatenate(found), axis=0).tolist()]

    def tiles(self, words: TextWords, row: int, k: int) -> list[tuple[int, int, int]]:
        """Tiles of a text and an item; what seeds found by hashes is compared by the words themselves."""
        doc, item = numbered(words.of(row), self.words[k])
        return tile(doc, item, min(self.seed, len(item)))


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of at most about ITEM_WORDS words (bytes / 4), streamed to the driver one by one."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(key).cast("bigint"), text).where(F.col(text).isNotNull()).orderBy(key, text).toLocalIterator():
        if ids and size + len(row[1]) // 4 > ITEM_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) // 4
    if ids:
        yield ids, texts


def tiles(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, item_id, item_words, covered, longest, coverage, leaked of every pair that shares a seed."""
    spark = docs.sparkSession
    arrow_rows(spark)
    cols, names = carry(docs, keep, MADE)
    src = docs.select(*cols, F.col(text).alias("_text"))
    kinds = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, src.schema.fields, strict=False)]
    schema = ", ".join([*kinds, "item_id bigint, item_words bigint, covered bigint, longest bigint, coverage double, leaked boolean"])
    out = None
    for ids, texts in item_blocks(items, item_key, item_text):
        index = spark.sparkContext.broadcast(ItemIndex(ids, texts, seed))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, off in text_slices(batch, "_text"):
                    blob = data.tobytes()
                    words = TextWords([blob[a:b].decode("utf-8") for a, b in zip(off[:-1], off[1:], strict=True)])
                    rows: list[tuple] = []
                    for r, k in index.value.candidates(words.hashes, words.begin):
                        item, found = index.value.words[k], index.value.tiles(words, r, k)
                        covered = sum(n for _, _, n in found)
                        rows.append((r, index.value.ids[k], len(item), covered, max((n for _, _, n in found), default=0), covered / len(item), covered >= coverage * len(item)))
                    if rows:
                        r, *made = zip(*rows, strict=True)
                        part = batch.slice(i, j - i).take(pa.array(r, pa.int64()))
                        arrays = [pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)]
                        yield pa.RecordBatch.from_arrays([*(part.column(f"k{x}") for x in range(len(names))), *arrays], names=[*names, *MADE])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, into which no item leaks. One pass: rows of leaks are dropped where they are read."""
    spark = docs.sparkSession
    arrow_rows(spark)
    out, names = docs, docs.columns
    for ids, texts in item_blocks(items, item_key, item_text):
        index = spark.sparkContext.broadcast(ItemIndex(ids, texts, seed))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = set()
                for i, _, data, off in text_slices(batch, text):
                    blob = data.tobytes()
                    words = TextWords([blob[a:b].decode("utf-8") for a, b in zip(off[:-1], off[1:], strict=True)])
                    for r, k in index.value.candidates(words.hashes, words.begin):
                        if i + r not in bad and sum(n for _, _, n in index.value.tiles(words, r, k)) >= coverage * len(index.value.words[k]):
                            bad.add(i + r)
                yield batch.filter(pa.array([r not in bad for r in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)).select(*names)
    return out
