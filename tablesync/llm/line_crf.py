"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is a feature vector of the line and of the lines beside it;
neighbouring labels are tied by transition weights. Forward-backward gives each line's marginal, and
a text's score is the mean marginal weighted by line length.

Only documents are labelled; the labels of lines are hidden. The weights are fitted on the driver by
expectation maximisation with a constraint: the expected lines of a document, given its label, are
those of the chain under the least shift of its evidence at which their length-weighted mean is at
least GOOD_SHARE (at most 1 - GOOD_SHARE for label 0); gradient ascent then fits weights and ties to
them. So a good document may have bad lines, and ties are learned from where lines differ.

Bound: at most about SAMPLE labelled rows are learned from, chosen by a hash of the id; of a text of
more than FIT_LINES lines one run of that many, from a place that a hash of the text chooses, is
fitted. Scores are of whole texts.

Defined cases: null text is empty, and an empty text is one empty line; without labelled rows of
both classes every score is their rate (0.5 without any); a null label isn't learned; repeated rows
give repeated results; a document with several labels counts once for each; a kept column named as
one of MADE gets `_kept` behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, carry, span_hashes, text_slices
from .language_id import held_out

SAMPLE = 6000
FIT_LINES = 200
#: Rounds of expectation, gradient steps of each, and the share of a labelled document's lines that its label claims.
ROUNDS, STEPS, GOOD_SHARE = 4, 75, 0.9
PREDICT = 0.3
MADE = ("held_out", "score", "predicted")
#: Weight of the squared length of the weights, per sequence.
RIDGE = 0.02
#: Classes of bytes whose shares are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n", b".,;:?", b"!", b"|", b"#$%&*@^~=+_`", b"()[]{}<>\"'/\\-", bytes(range(0x80, 0x100)))
_class = np.full(256, len(CLASSES), np.uint8)
for _k, _chars in enumerate(CLASSES):
    _class[list(_chars)] = _k
OWN = 2 * len(CLASSES) + 9


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its length, and its text's number; every text has a line at least."""
    brk = np.flatnonzero(data == 10)
    # A line ends at its break or at its text's end; a break that ends a text opens no further line.
    brk = brk[~np.isin(brk + 1, offsets)]
    start = np.sort(np.concatenate((offsets[:-1], brk + 1)), kind="stable")
    rows = np.sort(np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, brk, "right") - 1)), kind="stable")
    end = np.append(start[1:], len(data))
    n = (end - start).astype(np.float64)
    some = np.maximum(n, 1)
    kind = _class[data]
    share = np.empty((len(start), len(CLASSES)))
    for k in range(len(CLASSES)):
        sums = np.concatenate(([0], np.cumsum(kind == k)))
        share[:, k] = (sums[end] - sums[start]) / some
    letters = share[:, 0] + share[:, 1] + share[:, 9]
    hashes = span_hashes(data, start, end)
    _, inverse, times = np.unique(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    lines = np.bincount(rows)[rows]
    last = np.where(n > 0, data[np.maximum(end - 1, 0)], 0) if len(data) else np.zeros(len(start))
    last = np.where((last == 10) & (n > 1), data[np.maximum(end - 2, 0)], last) if len(data) else last
    first = np.where(n > 0, data[np.minimum(start, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(len(start))
    words = share[:, 3] * some + 1
    blank = np.concatenate(([True], kind == 3, [True]))
    opens, closes = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    word = span_hashes(data, opens, closes)
    line = np.searchsorted(start, opens, "right") - 1
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    stutter = np.bincount(line, again, len(start)) / np.maximum(np.bincount(line, minlength=len(start)), 1)
    own = np.column_stack([
        np.ones(len(start)), np.log1p(n) / 5, share[:, 0] / np.maximum(letters, 1e-9) * (letters > 0), np.minimum(n / words / 8, 3), np.isin(last, list(b".!?")), (first >= 65) & (first <= 90), (times[inverse] > 1) & (n > 1), np.log1p(lines) / 4, stutter, share, share > 0.02,
    ])
    return own, n, rows


def chain_features(own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A line's own features and those of the lines before and after it in its text (zeros at the ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = rows[1:] == rows[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    return np.column_stack([own, before[:, 1:], after[:, 1:]])


class Chains:
    """Lines of many sequences, walked side by side."""

    def __init__(self, rows: np.ndarray):
        _, first, length = np.unique(rows, return_index=True, return_counts=True)
        order = np.argsort(-length, kind="stable")
        self.first, self.length = first[order], length[order]
        self.alive = np.searchsorted(-self.length, -np.arange(self.length[0] if len(length) else 0), "left")
        self.begins = np.zeros(len(rows), bool)
        self.begins[first] = True

    def marginals(self, u: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the summed P of each pair of labels of neighbours; u: evidence of good, tie: 2 x 2."""
        e = np.column_stack([np.exp(-np.maximum(u, 0)), np.exp(np.minimum(u, 0))])
        t = np.exp(tie - tie.max())
        f = np.empty_like(e)
        cur = np.ones((len(self.first), 2))
        for k, n in enumerate(self.alive):
            at = self.first[:n] + k
            cur = (cur[:n] @ t if k else cur[:n]) * e[at]
            cur /= cur.sum(1, keepdims=True)
            f[at] = cur
        b = np.ones_like(e)
        pairs = np.zeros((2, 2))
        for k in range(len(self.alive) - 1, 0, -1):
            n = self.alive[k]
            at = self.first[:n] + k
            right = e[at] * b[at]
            left = right @ t.T
            both = f[at - 1][:, :, None] * t * right[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
            b[at - 1] = left / left.sum(1, keepdims=True)
        p = f * b
        return p[:, 1] / p.sum(1), pairs


class LineCRF:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, tie: np.ndarray, rate: float):
        self.mean, self.scale, self.weights, self.tie, self.rate = mean, scale, weights, tie, rate

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        own, n, rows = line_features(data, offsets)
        if self.weights is None:
            return np.full(len(offsets) - 1, self.rate)
        good, _ = Chains(rows).marginals((chain_features(own, rows) - self.mean) / self.scale @ self.weights, self.tie)
        weight = n + 1
        return np.clip(np.bincount(rows, good * weight) / np.bincount(rows, weight), 0, 1)


def expected(chains: Chains, u: np.ndarray, tie: np.ndarray, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and summed P of neighbours' labels, given the documents' labels: the evidence of each is shifted until the weighted mean fits its label."""
    sign = np.where(label > 0, 1.0, -1.0)
    shift, total = np.where(np.bincount(rows) == 1, 6.0, 0.0) * sign, np.bincount(rows, weight)  # a single line is what its document is
    for _ in range(8):
        p, pairs = chains.marginals(u + shift[rows], tie)
        mean = np.bincount(rows, p * weight) / total
        lacks = GOOD_SHARE - np.where(label > 0, mean, 1 - mean)
        if (lacks <= 0.005).all():
            break
        odds = np.log(GOOD_SHARE / (1 - GOOD_SHARE)) - sign * np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1))
        shift += sign * np.where(lacks > 0.005, np.maximum(odds, 0.1), 0)
    return p, pairs


def fit(own: np.ndarray, rows: np.ndarray, label: np.ndarray, size: np.ndarray) -> LineCRF:
    """own: features of the lines of all sequences; rows: their sequence; label: by sequence; size: of each line."""
    rate = float(label.mean()) if len(label) else 0.5
    if not 0 < rate < 1:
        return LineCRF(None, None, None, None, rate)
    x = chain_features(own, rows)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[0], scale[0] = 0, 1
    x = (x - mean) / scale
    chains, count, weight = Chains(rows), len(label), size + 1
    w, tie = np.zeros(x.shape[1]), np.zeros((2, 2))
    tie[0, 0] = tie[1, 1] = 0.5
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    step, steps = 0, ROUNDS * STEPS
    for turn in range(ROUNDS):
        # the first time every line is taken for what its document is
        q, seen = expected(chains, x @ w if turn else np.where(label > 0, 6.0, -6.0)[rows], tie, rows, label, weight)
        for _ in range(STEPS):
            step += 1
            p, pairs = chains.marginals(x @ w, tie)
            g = np.concatenate([(x.T @ (q - p)) / count - RIDGE * w, ((seen - pairs) / count - RIDGE * tie).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, tie = w + move[: len(w)], tie + move[len(w) :].reshape(2, 2)
    return LineCRF(mean, scale, w, tie, rate)


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> LineCRF:
    pool = labels.where(~held_out(F.col(key)) & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    there = pool.count()
    chosen = pool.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < 1e6 * min(1.0, SAMPLE / max(there, 1)))
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(chosen, "k").select("t", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_slices(batch, "t"):
                own, n, rows = line_features(data, off)
                count = np.bincount(rows, minlength=j - i)
                a = np.cumsum(count) - count
                place = span_hashes(data, off[:-1], off[1:]) if len(data) else np.zeros(j - i, np.uint64)
                a += (place % (np.maximum(count - FIT_LINES, 0) + 1).astype(np.uint64)).astype(np.int64)
                b = a + np.minimum(count, FIT_LINES)
                cells = [np.column_stack([n[p:q], own[p:q]]).astype(np.float32).tobytes() for p, q in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), batch.column("y").slice(i, j - i)], names=["f", "y"])

    found = sample.mapInArrow(features, "f binary, y int").toArrow()
    # in an order of their content: the same rows give the same weights however they are dealt out
    found = sorted(zip(found["f"].to_pylist(), found["y"].to_pylist(), strict=True))
    if not found:
        return LineCRF(None, None, None, None, 0.5)
    lines = [np.frombuffer(f, np.float32).reshape(-1, OWN + 1) for f, _ in found]
    rows, all_ = np.repeat(np.arange(len(lines)), [len(x) for x in lines]), np.concatenate(lines).astype(np.float64)
    return fit(all_[:, 1:], rows, np.array([int(y > 0) for _, y in found]), all_[:, 0])


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, held_out, score, predicted of every row."""
    arrow_rows(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, key, text, label))
    cols, names = carry(docs, keep, MADE)
    src = docs.select(*cols, held_out(F.col(key)).alias("_held"), F.col(text).alias("_text"))
    kinds = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, src.schema.fields, strict=False)] + ["held_out boolean", "score double", "predicted int"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_slices(batch, "_text"):
                s, part = model.value.scores(data, off), batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{x}") for x in range(len(names))), part.column("_held"), pa.array(s), pa.array((s >= PREDICT).astype(np.int32))], names=[*names, *MADE])

    return src.mapInArrow(run, ", ".join(kinds))
