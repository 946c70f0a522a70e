"""Language identification with spans of mixed-language text.

Script ranges narrow the candidate languages of each word; the word is scored under each of them by
hashed character trigrams; Viterbi with a switching penalty labels the words of a text, and runs of
one label are its spans. The trigram and script counts are learned from labelled rows.

Bound: at most about PER_LANGUAGE labelled rows of each language are learned from, chosen by a hash
of the id; the model has BUCKETS numbers a language. Everything else covers all rows.

Defined cases: a null text, or one without a letter, is `und` with score 0; with no labelled row
every text is; a null lang isn't learned; ties go to the smaller language name; repeated rows give
repeated results; a null id is held in and learned from; a kept column named as one of the result
gets `_kept` behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, carry, lean, mix64, text_slices
from .pieces import LETTER, char_classes

PER_LANGUAGE = 2000
BUCKETS = 1 << 16
#: Log-likelihood that a change of language within a text costs.
SWITCH = 12.0
#: A language is a candidate for a script that at least this share of its words use.
SCRIPT_SHARE = 0.01
#: First code points of ranges and the script that begins there.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0x10000, "Other"), (0x20000, "Han"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_firsts = np.array([a for a, _ in SCRIPTS], np.uint32)
_script = np.array([NAMES.index(n) for _, n in SCRIPTS])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Words:
    """The letter runs of a slice of texts: distinct words, their trigram buckets, and where each word stands."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        blob = data.tobytes()
        texts = [lowered(blob[a:b].decode("utf-8")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        letter = char_classes()[points] == LETTER
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = letter[1:] != letter[:-1]
        edge[self.first] = True
        cuts = np.flatnonzero(edge)
        starts = cuts[:-1]
        is_word = letter[starts] if len(points) else np.zeros(0, bool)
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(points.tobytes())]).dictionary_encode() if len(starts) else pa.array([], pa.binary()).dictionary_encode()
        self.start, self.end = starts[is_word], cuts[1:][is_word]
        self.word = np.asarray(runs.indices)[is_word].astype(np.int64)
        self.row = np.searchsorted(self.first, self.start, "right") - 1
        known = runs.dictionary
        off = np.frombuffer(known.buffers()[1], np.int32)[: len(known) + 1].astype(np.int64) // 4 if len(known) else np.zeros(1, np.int64)
        chars = np.frombuffer(known.buffers()[2], np.uint32)[: off[-1]] if len(known) and off[-1] else np.zeros(0, np.uint32)
        # each word gets a mark before and after it; trigrams are taken around each of its characters
        n = np.diff(off)
        at = np.arange(len(chars)) + 2 * np.repeat(np.arange(len(n)), n) + 1
        padded = np.zeros(len(chars) + 2 * len(n), np.uint64)
        padded[at] = chars
        self.bucket = (mix64(padded[at - 1] * np.uint64(0x1F123BB5) + padded[at] * np.uint64(0x2545F491) * np.uint64(0x10001) + padded[at + 1] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BUCKETS)).astype(np.int64)
        self.off = off
        self.script = _script[np.searchsorted(_firsts, chars[off[:-1]], "right") - 1] if len(n) else np.zeros(0, np.int64)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: for each language its trigram buckets, then its words by script."""
        self.languages = languages
        grams, scripts = counts[:, :BUCKETS] + 0.05, counts[:, BUCKETS:]
        self.logp = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32).copy()
        allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed[:, ~allowed.any(0)] = True
        self.barred = np.where(allowed.T, 0, -1e4).astype(np.float32)

    def scores(self, w: Words) -> np.ndarray:
        """The score of each distinct word under each language."""
        if not len(w.bucket):
            return np.zeros((len(w.off) - 1, len(self.languages)), np.float32)
        return np.add.reduceat(self.logp[w.bucket], w.off[:-1], axis=0) + self.barred[w.script]

    def label(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The language of each word in place, and the scores of the words in place."""
        s = self.scores(w)[w.word]
        first = np.searchsorted(w.row, np.arange(len(w.first) - 1), "left")
        length = np.bincount(w.row, minlength=len(w.first) - 1)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        steps = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(steps), "left")  # texts longer than k
        label, best = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        moved = np.zeros(s.shape, bool)
        v = np.zeros((len(length), s.shape[1]), np.float32)
        for k in range(steps):
            n = alive[k]
            at, now = first[:n] + k, v[:n]
            top = now.argmax(1)
            jump = now[np.arange(n), top][:, None] - np.float32(SWITCH)
            best[at], moved[at] = top, now < jump
            v[:n] = np.maximum(now, jump) + s[at]
            if k % 64 == 63:
                v[:n] -= v[:n].max(1, keepdims=True)
        final = v.argmax(1)
        for k in range(steps - 1, -1, -1):
            n = alive[k]
            at, cur = first[:n] + k, final[:n]
            label[at] = cur
            final[:n] = np.where(moved[at, cur], best[at], cur)
        return label, s


def learn(docs: DataFrame, key: str, text: str, lang: str) -> Model:
    pool = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    there = {r[lang]: r["count"] for r in pool.groupBy(lang).count().collect()}
    languages = sorted(there)
    if not languages:
        return Model([], np.zeros((0, BUCKETS + len(NAMES))))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, PER_LANGUAGE / there[name]))])
    chance = F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(1_000_000)) / 1e6
    rows = pool.where(chance < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, j, data, off in text_slices(batch, "text"):
                w, names = Words(data, off), batch.column("lang").slice(i, j - i).to_pylist()
                for name in set(names):
                    mine = np.array([x == name for x in names])[w.row]
                    times = np.bincount(w.word[mine], minlength=len(w.off) - 1)
                    total = found.setdefault(name, np.zeros(BUCKETS + len(NAMES)))
                    total[:BUCKETS] += np.bincount(w.bucket, np.repeat(times, np.diff(w.off)), BUCKETS)
                    total[BUCKETS:] += np.bincount(w.script, times, len(NAMES))
        for name, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    summed = rows.mapInArrow(count, "lang string, bucket bigint, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS + len(NAMES)))
    row = np.array([languages.index(x) for x in summed["lang"].to_pylist()], np.int64)
    counts[row, summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), with_spans: bool = False) -> DataFrame:
    """keep, held_out, lang_pred, score of every row; with_spans: also (start, end, lang) in characters."""
    arrow_rows(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, key, text, lang))
    cols, kept = carry(docs, keep, ("held_out", "lang_pred", "score", "spans"))
    src = docs.select(*cols, held_out(F.col(key)).alias("_held"), F.col(text).alias("_text"))
    names = [*kept, "held_out", "lang_pred", "score", *["spans"] * with_spans]
    kinds = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(kept, src.schema.fields, strict=False)] + ["held_out boolean", "lang_pred string", "score double"] + ["spans array<struct<start:int,end:int,lang:string>>"] * with_spans
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i, j, data, off in text_slices(batch, "_text"):
                part, rows = batch.slice(i, j - i), j - i
                spans: list[list] = [[] for _ in range(rows)]
                pred, score = np.full(rows, "und", object), np.zeros(rows)
                if m.languages and len((w := Words(data, off)).word):
                    label, s = m.label(w)
                    size, k = w.end - w.start, len(m.languages)
                    letters = np.bincount(w.row * k + label, size, rows * k).reshape(rows, k)
                    total = np.stack([np.bincount(w.row, s[:, x], rows) for x in range(k)], 1)
                    some, top = letters.sum(1) > 0, letters.argmax(1)
                    pred[some] = np.array(m.languages, object)[top[some]]
                    margin = total - total[np.arange(rows), top][:, None]
                    sure = 1 / np.exp(np.clip(margin, -50, 50)).sum(1)
                    score[some] = (letters[np.arange(rows), top] / np.maximum(letters.sum(1), 1) * np.where(letters.max(1) < letters.sum(1), 1, np.minimum(1, sure)))[some]
                    if with_spans:
                        new = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(w.row, prepend=-1) != 0))
                        for a, b in zip(new, [*new[1:], len(label)], strict=True):
                            r = w.row[a]
                            spans[r].append({"start": int(w.start[a] - w.first[r]), "end": int(w.end[b - 1] - w.first[r]), "lang": m.languages[label[a]]})
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{x}") for x in range(len(kept))), part.column("_held"), pa.array(pred, pa.string()), pa.array(score), *[pa.array(spans, span)] * with_spans], names=names)
            lean()

    return src.mapInArrow(run, ", ".join(kinds))
