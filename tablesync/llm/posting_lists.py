"""Approximate nearest neighbours by balanced posting lists.

Largest inner product becomes smallest distance by one added dimension (vectors get
sqrt(M^2 - |x|^2), queries 0). Centroids are fitted on a bounded sample by k-means with a price on
crowded lists; a vector goes to its nearest centroid and to all within a distance ratio of it
(boundary vectors are replicated); centroids are found by best-first search of an in-memory
neighbour graph. A query reads all lists within a wider ratio of its nearest centroid; it is measured
against all centroids, and the number of lists has no ceiling. That ratio is calibrated on the input
itself: the true neighbours of up to PROBES queries are found by one pass over all rows, and the ratio
is the least at which the lists read hold the share RECALL of them.
Scores of what the lists give are exact, in double precision on the original vectors.

Bounds: SAMPLE vectors to fit, MOST_LISTS centroids (which are broadcast). All rows are indexed. Where
vectors are evenly spread, RECALL takes a fixed share of all lists, so work grows with rows x queries.
Lists are read in blocks of BLOCK vectors by BLOCK queries, so a crowded list is many small tasks' work.

Defined cases: null, zero, non-finite and holed vectors take no part, nor do those whose length is
not the commonest one (ties: the longer), nor rows of null id; rows that share an id are one
candidate with the better score, and each distinct query id is answered once, from the smallest of
its vectors; ties go to smaller ids; without any candidate a query has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows

SAMPLE = 20_000
LIST_SIZE = 400
MOST_LISTS = 4096
BLOCK = 4000
#: Distance ratio within which a vector is replicated.
REPLICATE = 1.05
#: Share of the true neighbours that the lists read must hold, and queries on which that is calibrated.
RECALL, PROBES = 0.98, 256
#: Most copies of a vector.
COPIES = 4
LINKS, FAR_LINKS = 16, 8
#: List reads of queries whose finds are merged in one task.
MERGED_QUERIES = 50_000


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means whose assignment adds a price to lists above the mean size."""
    x = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    lists = min(lists, len(x))
    c = x[rng.choice(len(x), lists, replace=False)]
    price = np.zeros(lists)
    for _ in range(rounds):
        own = np.concatenate([(distances(part, c) + price).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        size = np.bincount(own, minlength=lists)
        spread = np.median(((x - c[own]) ** 2).sum(1))
        price = np.maximum(0, price + 0.1 * spread * (size / max(1, len(x) / lists) - 1))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = size > 0
        c[full] = sums[full] / size[full, None]
        c[~full] = x[rng.choice(len(x), (~full).sum())]
    return c


class CentroidGraph:
    """Neighbour graph of the centroids: nearest ones and a few far ones; searched best first for many queries at once."""

    def __init__(self, centroids: np.ndarray, seed: int = 11):
        self.c = np.ascontiguousarray(centroids, np.float32)
        k = len(self.c)
        rng = np.random.default_rng(seed)
        near = min(LINKS, k - 1)
        rows = []
        for part in np.array_split(np.arange(k), max(1, k // 512)):
            d = distances(self.c[part], self.c)
            d[np.arange(len(part)), part] = np.inf
            rows.append(np.argpartition(d, near - 1, 1)[:, :near] if near else np.zeros((len(part), 0), np.int64))
        self.links = np.column_stack([np.concatenate(rows), rng.integers(0, k, (k, FAR_LINKS))])
        self.entries = rng.choice(k, min(k, max(8, int(k**0.5))), replace=False)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query up to `width` centroids, nearest first, and their squared distances (inf: none)."""
        q = q.astype(np.float32)
        n, width = len(q), min(width, len(self.c))
        d = distances(q, self.c[self.entries])
        ids = np.broadcast_to(self.entries, d.shape)
        if d.shape[1] < width:
            ids = np.pad(ids, ((0, 0), (0, width - d.shape[1])), constant_values=-1)
            d = np.pad(d, ((0, 0), (0, width - d.shape[1])), constant_values=np.inf)
        order = np.argsort(d, 1, kind="stable")[:, :width]
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        seen = np.zeros((n, len(self.c)), bool)
        seen[:, self.entries] = True
        done = ids < 0
        squares = (self.c * self.c).sum(1)
        while len(rows := np.flatnonzero((~done).any(1))):
            first = (~done[rows]).argmax(1)
            done[rows, first] = True
            new = self.links[ids[rows, first]]
            fresh = ~seen[rows[:, None], new]
            seen[rows[:, None], new] = True
            nd = np.maximum((q[rows] ** 2).sum(1)[:, None] + squares[new] - 2 * np.einsum("nd,nmd->nm", q[rows], self.c[new]), 0)
            srt = np.sort(new, 1)  # the same neighbour may be linked twice
            if (srt[:, 1:] == srt[:, :-1]).any():
                o = np.argsort(new, 1, kind="stable")
                twice = np.zeros_like(fresh)
                np.put_along_axis(twice, o[:, 1:], srt[:, 1:] == srt[:, :-1], 1)
                fresh &= ~twice
            nd[~fresh] = np.inf
            all_ids, all_d = np.concatenate([ids[rows], np.where(fresh, new, -1)], 1), np.concatenate([d[rows], nd], 1)
            all_done = np.concatenate([done[rows], ~fresh], 1)
            order = np.argsort(all_d, 1, kind="stable")[:, :width]
            ids[rows], d[rows], done[rows] = (np.take_along_axis(z, order, 1) for z in (all_ids, all_d, all_done))
        return ids, d


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def least_ratio(found: np.ndarray, centroids: np.ndarray, probe: np.ndarray, lists: list[list[int]]) -> float:
    """The least distance ratio at which reading gives the share RECALL of neighbours: found are the probes (lifted), probe and lists those of each neighbour."""
    d = distances(found, centroids)
    at = np.maximum(0, np.array([d[p, own].min() for p, own in zip(probe, lists, strict=True)]) - 1e-12)
    nearest = d.min(1)[probe]
    ratios = np.sort(np.divide(at, nearest, out=np.where(at > 0, np.inf, 0.0), where=nearest > 0))
    return float(np.sqrt(ratios[int(np.ceil(RECALL * len(ratios))) - 1])) * (1 + 1e-9) if len(ratios) else np.inf


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", read: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that is_query marks, against all other rows.

    read: the distance ratio within which lists are read; calibrated where it is None.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 2000)
    raw = vectors.select(F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    bad = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = raw.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda v: v != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v))
    stats = ok.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), F.desc("dim")).first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if stats is None:
        return spark.createDataFrame([], out)
    dim, n, top = stats.dim, stats.n, float(stats.norm)
    ok = ok.where(F.size("v") == dim)
    lists = int(max(1, min(MOST_LISTS, n // LIST_SIZE, SAMPLE // 8)))

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / top, np.sqrt(np.maximum(0, 1 - (x * x).sum(1) / top**2))])

    chance = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < 1e6 * min(1.0, 0.9 * SAMPLE / n)
    sample = ok.where(chance).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = matrix(sample, dim) if len(sample) else matrix(ok.limit(1).select("v").toArrow()["v"].combine_chunks(), dim)
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(lifted(sample), lists)))

    def copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of each row, and which of them count."""
        ids, d = graph.value.search(lifted(x), COPIES * 4)
        return ids[:, :COPIES], (d[:, :COPIES] <= REPLICATE**2 * d[:, :1] + 1e-12) & (ids[:, :COPIES] >= 0)

    def direction(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros(len(x))])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), dim)
            ids, keep = copies(x)
            row, at = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row, at].astype(np.int32)), batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row))], names=["list", "id", "v"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                d = distances(direction(matrix(part.column("v"), dim)), graph.value.c)
                row, at = np.nonzero(d <= read**2 * d.min(1, keepdims=True) + 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), part.column("id").take(pa.array(row)), part.column("v").take(pa.array(row))], names=["list", "id", "v"])

    queries = ok.where("q").groupBy("id").agg(F.min("v").alias("v"))
    if read is None:
        probes = queries.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(PROBES).toArrow()
        if not probes.num_rows:
            return spark.createDataFrame([], out)
        probe_ids, probe_vectors = probes["id"].to_numpy(), matrix(probes["v"].combine_chunks(), dim)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The k best of a task's rows for each probe, and the lists that hold them."""
            n = len(probe_ids)
            score, vid, x = np.full((n, 0), -np.inf), np.zeros((n, 0), np.int64), np.zeros((n, 0, dim))
            for batch in batches:
                if not batch.num_rows:
                    continue
                new, ids = matrix(batch.column("v"), dim), batch.column("id").to_numpy()
                near = probe_vectors @ new.T
                near[ids[None, :] == probe_ids[:, None]] = -np.inf
                best = np.argpartition(near, -min(k, len(ids)), 1)[:, -min(k, len(ids)) :]
                score, vid, x = np.concatenate([score, np.take_along_axis(near, best, 1)], 1), np.concatenate([vid, ids[best]], 1), np.concatenate([x, new[best]], 1)
                best = np.argsort(-score, 1, kind="stable")[:, :k]
                score, vid, x = np.take_along_axis(score, best, 1), np.take_along_axis(vid, best, 1), np.take_along_axis(x, best[:, :, None], 1)
            row, at = np.nonzero(score > -np.inf)
            if len(row):
                ids, keep = copies(x[row, at])
                lists = [i[c].tolist() for i, c in zip(ids, keep, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(vid[row, at]), pa.array(score[row, at]), pa.array(lists, pa.list_(pa.int32()))], names=["probe", "id", "score", "lists"])

        true = ok.select("id", "v").mapInArrow(nearest, "probe int, id bigint, score double, lists array<int>")
        turn = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))
        true = true.withColumn("turn", turn).where(F.col("turn") <= k).select("probe", "lists").collect()
        read = least_ratio(direction(probe_vectors), graph.value.c, np.array([r.probe for r in true], np.int64), [r.lists for r in true])

    placed = "list int, id bigint, v array<double>"
    posted = ok.select("id", "v").mapInArrow(post, placed)
    asked = queries.mapInArrow(route, placed)

    def blocks(rows: DataFrame) -> tuple[Column, int]:
        """An array column: how many blocks each list's rows make (at most MOST_LISTS numbers); and the rows."""
        there = {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}
        return F.element_at(F.array([F.lit(max(1, -(-there.get(i, 0) // BLOCK))) for i in range(lists)]), F.col("list") + 1), sum(there.values())

    (vector_blocks, _), (query_blocks, asked_rows) = blocks(posted.drop("v")), blocks(asked.drop("v"))
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = posted.withColumn("vb", spread(vector_blocks)).withColumn("qb", every(query_blocks))
    right = asked.withColumn("qb", spread(query_blocks)).withColumn("vb", every(vector_blocks))

    def best(mine: pa.Table, queries: pa.Table) -> pa.Table:
        """One row per query: its k nearest of this block."""
        qs, ids, scores = [], [], []
        if mine.num_rows and queries.num_rows:
            x, vid = matrix(mine["v"].combine_chunks(), dim), mine["id"].to_numpy()
            y, qid = matrix(queries["v"].combine_chunks(), dim), queries["id"].to_numpy()
            for part in np.array_split(np.arange(len(y)), max(1, len(y) // 256)):
                near = y[part] @ x.T
                near[vid[None, :] == qid[part][:, None]] = -np.inf
                kth = np.partition(near, -min(k, len(x)), 1)[:, -min(k, len(x))]
                for r, q in enumerate(part):
                    some = np.flatnonzero((near[r] >= kth[r] - 1e-9 * top * np.sqrt((y[q] ** 2).sum())) & (vid != qid[q]))
                    score = (x[some] * y[q]).sum(1)
                    order = np.lexsort((vid[some], -score))
                    _, once = np.unique(vid[some][order], return_index=True)
                    order = order[np.sort(once)][:k]
                    if len(order):
                        qs.append(qid[q])
                        ids.append(vid[some][order])
                        scores.append(score[order])
        return pa.table([pa.array(qs, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    def merge(key_: tuple, table: pa.Table) -> pa.Table:
        lists = table["ids"].combine_chunks()
        q = np.repeat(table["query_id"].to_numpy(), np.diff(np.asarray(lists.offsets)))
        v, s = np.asarray(lists.flatten()), np.asarray(table["scores"].combine_chunks().flatten())
        o = np.lexsort((-s, v, q))
        q, v, s = q[o], v[o], s[o]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
        q, v, s = q[new], v[new], s[new]
        o = np.lexsort((v, -s, q))
        q, v, s = q[o], v[o], s[o]
        first = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) + 1
        keep = rank <= k
        return pa.table([pa.array(q[keep]), pa.array(rank[keep].astype(np.int32)), pa.array(v[keep]), pa.array(s[keep])], names=["query_id", "rank", "vec_id", "score"])

    found = left.groupBy("list", "vb", "qb").cogroup(right.groupBy("list", "vb", "qb")).applyInArrow(best, "query_id bigint, ids array<bigint>, scores array<double>")
    parts = int(max(8, asked_rows // MERGED_QUERIES + 1))
    return found.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).groupBy("part").applyInArrow(merge, out)
