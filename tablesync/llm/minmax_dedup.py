"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Every text becomes the set of its distinct word shingles (64-bit hashes). Documents of equal sets are
one class. A class gets, under each of PERMUTATIONS, both the least and the largest hash; bands of
ROWS of these values are its bucket keys. Classes that share a bucket are candidates; candidates are
confirmed on their full sets, and confirmed links are joined into components.

Pairs within a bucket are never all emitted: each round compares every member with one hub (the class
that meets most others in its buckets; in odd rounds, one by hash), components are contracted, and
only pairs that still lie in different components go on. What is left is compared in full inside its
bucket's tasks, unless sizes or signatures rule a link out. At a similarity of 0.8 a pair shares no bucket with a chance of
(1 - 0.8^ROWS)^BANDS, about 5e-8, and signatures rule out a pair that does with one of about 9e-9
(binomial, as if the values were independent); no other link is lost.

Defined cases: null or empty texts, and texts without words, have an empty set and are alone; a text
with fewer words than a shingle has its whole sequence as its one shingle; a null id is a document
of its own that is kept and linked with nothing; repeated ids are one document per row, with the
same component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_rows, components, discard, durable, lean, mix64, scratch, small_side, span_hashes, text_slices

PERMUTATIONS, ROWS, BANDS = 64, 4, 32
#: Rounds of comparing with hubs before the rest is compared in full.
HUB_ROUNDS = 4
#: A round that confirms less than this share of its edges is the last.
HUB_YIELD = 0.1
#: Rows of a bucket that one task compares with as many others.
BLOCK = 1024
#: Standard deviations below the mean at which two signatures can't belong to linked sets any more (binomial chance 9e-9 at 80 percent).
SURE = 6.0
#: Most edges of a hub in one block.
HUB_BLOCK = 512
_rng = np.random.default_rng(20240229)
_mult = _rng.integers(1, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_add = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin (and the end)."""
    low = _lower[data]
    blank = np.ones(len(low) + 1, bool)
    blank[:-1] = _space[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(~blank[:-1] & (np.concatenate(([True], blank[:-2])) | first[:-1])) if len(low) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~blank[:-1] & (blank[1:] | first[1:])) + 1 if len(low) else np.zeros(0, np.int64)
    words = span_hashes(low, starts, ends) if len(low) else np.zeros(0, np.uint64)
    row = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.concatenate(([0], np.cumsum(n)))
    # a shingle begins at every word that has size - 1 words after it, and at the first word of a shorter text
    at = np.arange(len(words))
    left = begin[row + 1] - at
    opens = (left >= size) | ((at == begin[row]) & (n[row] < size))
    at, left, row = at[opens], np.minimum(left[opens], size), row[opens]
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        there = left > k
        h[there] = mix64(h[there] * np.uint64(0x9E3779B97F4A7C15) + words[at[there] + k])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(offsets) - 1))))


def band_keys(sets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of each non-empty set, BANDS a set; and 16 bits of each of its min-max values."""
    where = begin[:-1][np.diff(begin) > 0]
    values = np.empty((len(where), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        h = sets * _mult[k] + _add[k]
        values[:, 2 * k], values[:, 2 * k + 1] = np.minimum.reduceat(h, where), np.maximum.reduceat(h, where)
    keys = np.zeros((len(where), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r * BANDS : (r + 1) * BANDS])
    return mix64(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64), mix64(values).astype(np.uint16).view(np.int16)


def least_agreeing(percent: int) -> int:
    """Equal min-max values that sets of that similarity have at least."""
    values = 2 * PERMUTATIONS
    share = percent / 100
    return int(values * share - SURE * (values * share * (1 - share)) ** 0.5)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches percent."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum()) if len(a) else 0
    return 100 * common >= percent * (len(a) + len(b) - common) and common > 0


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """id, n, same (digest of the set; null for an empty one), bands, sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_slices(batch, "t"):
                sets, begin = shingle_sets(data, off, size)
                n = np.diff(begin)
                keys, values = (iter(x) for x in band_keys(sets, begin))
                same = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(n), pa.array(same, pa.binary()), pa.array([next(keys) if x else None for x in n], pa.list_(pa.int64())), pa.array([next(values) if x else None for x in n], pa.list_(pa.int16()))], names=["id", "n", "same", "bands", "sig"])
            lean()

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id bigint, n bigint, same binary, bands array<bigint>, sig array<smallint>")


def confirm(edges: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Those of edges (hub, member) whose full sets reach the similarity.

    A hub's edges are dealt out in blocks of about HUB_BLOCK; each block gets the hub's text once and
    streams the members' texts past it.
    """
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where("id is not null")
    degree = edges.groupBy("hub").agg(F.count("*").alias("degree"))
    blocks = F.ceil(F.col("degree") / HUB_BLOCK).cast("int")
    members = edges.join(degree, "hub").select("hub", F.pmod(F.xxhash64("member"), blocks).cast("int").alias("block"), F.col("member").alias("id"), F.lit(1).alias("part"))
    hubs = degree.select("hub", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("hub").alias("id"), F.lit(0).alias("part"))
    rows = small_side(durable(members.unionByName(hubs), "minmax", few=True)).join(texts, "id").repartition("hub", "block").sortWithinPartitions("hub", "block", "part", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            for i, j, data, off in text_slices(batch, "t"):
                sets, begin = shingle_sets(data, off, size)
                part = batch.slice(i, j - i)
                found: list[tuple[int, int]] = []
                for r, (h, block, doc, kind) in enumerate(zip(*(part.column(c).to_pylist() for c in ("hub", "block", "id", "part")), strict=True)):
                    own = sets[begin[r] : begin[r + 1]]
                    if kind == 0:
                        at, hub = (h, block), own.copy()
                    elif at == (h, block) and linked(hub, own, percent):
                        found.append((h, doc))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([m for _, m in found], pa.int64())], names=["a", "b"])
            lean()

    return rows.select("hub", "block", "id", "part", "t").mapInArrow(run, "a bigint, b bigint")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each group, from batches in which groups lie together."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with bi, bj: a bucket's pairs in tasks of at most about two BLOCKs of rows; part 0 rows are compared with part 1 rows where bi <> bj."""
    sizes = durable(rows.groupBy("bucket").agg(F.count("*").alias("_s"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket", F.ceil(F.col("_s") / BLOCK).cast("int").alias("_nb")), "minmax", few=True)
    rows = rows.join(sizes, "bucket").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return rows.withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o")).withColumn("part", (F.col("_b") > F.col("bi")).cast("int")).drop("_nb", "_b", "_o")


def compare_rest(labelled: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between classes that share a bucket and still lie in different components.

    Pairs are looked at inside the tasks and not emitted. First by signatures: rows that have no partner
    left go, and a pair counts in the first bucket that it shares only, by the bucket keys themselves. Then by full sets, as bitmaps.
    """
    least = least_agreeing(percent)

    def pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Rows of different components and fitting sizes, compared once."""
        n, c, part = (t[k].to_numpy() for k in ("n", "c", "part"))
        fits = (c[:, None] != c[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
        fits &= (part[:, None] == 0) & (part[None, :] == 1) if part.any() else np.tri(len(n), k=-1, dtype=bool).T
        return np.nonzero(fits)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ("bucket", "bi", "bj")):
            i, j = pairs(t)
            if not len(i):
                continue
            sig = np.asarray(t["sig"].combine_chunks().flatten()).reshape(t.num_rows, -1)
            bands = np.asarray(t["bands"].combine_chunks().flatten()).reshape(t.num_rows, -1)
            band, keep = int(t["band"][0].as_py()), np.zeros(t.num_rows, bool)
            for a in range(0, len(i), 1 << 15):
                x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
                same = sig[x] == sig[y]
                live = np.flatnonzero(same.sum(1) >= least)
                live = live[(bands[x[live]] == bands[y[live]]).argmax(1) == band]
                keep[x[live]] = keep[y[live]] = True
            if keep.any():
                yield t.drop_columns(["sig", "band", "bands"]).filter(pa.array(keep)).combine_chunks().to_batches()[0]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ("bucket", "bi", "bj")):
            i, j = pairs(t)
            if not len(i):
                continue
            sets = []
            for batch in t.combine_chunks().to_batches():
                for _, _, data, off in text_slices(batch, "t"):
                    h, begin = shingle_sets(data, off, size)
                    sets += [h[p:q] for p, q in zip(begin[:-1], begin[1:], strict=True)]
            flat = np.concatenate(sets)
            _, word, times = np.unique(flat, return_inverse=True, return_counts=True)
            shared = times[word] > 1
            number = np.cumsum(times > 1) - 1
            width = int(number[-1]) + 1 if len(number) else 0
            bits = np.zeros((len(sets), -(-width // 64)), np.uint64)
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[shared]
            place = number[word[shared]]
            np.bitwise_or.at(bits, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
            n, ids, found = np.array([len(s) for s in sets]), t["id"].to_numpy(), []
            step = max(1, (1 << 21) // max(1, bits.shape[1]))
            for a in range(0, len(i), step):
                x, y = i[a : a + step], j[a : a + step]
                common = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64)
                ok = (100 * common >= percent * (n[x] + n[y] - common)) & (common > 0)
                found.append(np.column_stack([ids[x[ok]], ids[y[ok]]]))
            found = np.concatenate(found)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
        lean()

    keys = ["bucket", "bi", "bj"]
    rows = in_blocks(labelled.select("bucket", "band", "id", "n", "c")).join(reps.select("id", "sig", "bands").dropDuplicates(["id"]), "id")
    rows = rows.select(*keys, "part", "id", "n", "c", "band", "sig", "bands").repartition(*keys).sortWithinPartitions(*keys, "part", "id")
    left = durable(rows.mapInArrow(near, "bucket bigint, bi int, bj int, part int, id bigint, n bigint, c bigint"), "minmax", few=True)
    rows = small_side(left).join(texts, "id").select(*keys, "part", "id", "n", "c", "t").repartition(*keys).sortWithinPartitions(*keys, "part", "id")
    return rows.mapInArrow(exact, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id, kept of every row; written to the shared folder, which keeps nothing else of the work."""
    arrow_rows(docs.sparkSession)
    with scratch(docs.sparkSession):
        return durable(labelled_rows(docs, key, text, size, percent), "near-duplicates", lasts=True, few=True)


def labelled_rows(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    signed = durable(signatures(docs, key, text, size), "minmax")
    live = signed.where("same is not null and id is not null")
    # only sets that several rows have, written first: a join with it can split a set that many rows share
    classes = durable(live.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k"), "minmax", few=True)
    others = durable(live.select("id", "same").join(classes, "same").where("id <> rep").select("id", "same"), "minmax", few=True)
    reps = live.join(small_side(others), ["id", "same"], "left_anti").select("id", "n", "bands", "sig")
    placed = reps.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    # sums by bucket are written before they are joined with rows, so that a crowded bucket's rows can be split
    crowded = durable(placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("bucket", "size"), "minmax", few=True)
    buckets = placed.join(crowded, "bucket")
    # how much of the crowd a class meets: the text that near copies were made from meets more than each copy
    weight = buckets.groupBy("id").agg(F.sum("size").alias("weight"))
    buckets = durable(buckets.select("id", "n", "band", "bucket").join(weight, "id"), "minmax", few=True)
    texts = durable(docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).join(small_side(buckets.select("id").distinct()), "id", "left_semi"), "minmax")
    links, tried = None, None
    labelled = buckets.withColumn("c", F.col("id"))
    nodes = None

    def confirmed(found: DataFrame) -> int:
        """Adds links; labels what is still open by component. Returns their number."""
        nonlocal links, labelled, nodes
        links = found if links is None else links.unionByName(found)
        joined, old = components(links), nodes
        nodes = joined.source
        joined = joined.withColumnRenamed("node", "id")
        few = joined.count() <= BROADCAST_ROWS
        rows = buckets.join(F.broadcast(joined) if few else joined, "id", "left").select("id", "n", "band", "bucket", "weight", F.coalesce("component", "id").alias("c"))
        # labels that can be broadcast are joined where they are read; else the rows are written with them
        labelled = rows if few else durable(rows, "minmax")
        if old is not None:
            discard(old)
        return found.count()

    for turn in range(HUB_ROUNDS):
        order = F.struct("weight", -F.col("id"), "id", "c", "n") if turn % 2 == 0 else F.struct(F.xxhash64("id", F.lit(turn)), F.col("weight"), "id", "c", "n")
        hub = labelled.groupBy("bucket").agg(F.max(order).alias("h"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        hub = durable(hub.select("bucket", F.col("h.weight").alias("hw"), F.col("h.id").alias("hub"), F.col("h.c").alias("hc"), F.col("h.n").alias("hn")), "minmax", few=True)
        edges = labelled.join(hub, "bucket").where(f"c <> hc and 100 * least(n, hn) >= {percent} * greatest(n, hn)").select("hw", "hub", F.col("id").alias("member"))
        if tried is not None:
            edges = edges.join(tried.select(F.col("hub").alias("x"), F.col("member").alias("y")).unionByName(tried.select(F.col("member").alias("x"), F.col("hub").alias("y"))).distinct(), F.expr("hub = x and member = y"), "left_anti")
        # one hub a member and round
        edges = edges.groupBy("member").agg(F.max(F.struct("hw", -F.col("hub"), "hub")).alias("h")).select(F.col("h.hub").alias("hub"), "member")
        edges = durable(edges, "minmax", few=True)
        n = edges.count()
        if not n:
            break
        tried = edges if tried is None else tried.unionByName(edges)
        if confirmed(durable(confirm(edges, texts, "id", "t", size, percent), "minmax", few=True)) < HUB_YIELD * n:
            break
    confirmed(durable(compare_rest(labelled, reps, texts, size, percent), "minmax", few=True))
    label = labelled.select(F.col("id").alias("rep"), "c").distinct()
    of = signed.join(classes, "same", "left").withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))).join(label, "rep", "left")
    component = F.coalesce("c", "rep")
    return of.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
