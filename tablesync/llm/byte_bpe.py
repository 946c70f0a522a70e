"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file is compiled into a tokenizers BPE model: every byte is mapped to a printable
character, every token's possible splits become merges in rank order, and each match of the
split pattern is a piece of its own. Decoding reverses the byte table; an id sequence may end in
the middle of a character, which `decode_text` shows as U+FFFD and `decode_bytes` keeps as bytes.

Defined cases: null text is empty (no ids, hash of the empty string); repeated rows give repeated
results; other columns of the input are not read; a kept column named as one of the result gets
`_kept` behind its name.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, carry, lean, text_slices
from .pieces import byte_table, part_bounds, piece_starts

#: A text above this many bytes is split into pieces in parts.
PART_BYTES = 4 << 20
#: Distinct pieces that a task keeps with their ids; beyond that it starts anew between two slices.
MOST_PIECES = 150_000
#: Fixed value: the usual split pattern of byte-level BPE, for which pieces are found without a regular expression.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_table()
        shown = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(shown[a], shown[b]) for a, b in sorted(splits, key=lambda s: (ranks[s[0]], ranks[s[1]]))]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        size = max(ranks.values(), default=-1) + 1
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of: list[bytes] = [b""] * size
        for r in ranks.values():
            self.bytes_of[r] = bytes(back[c] for c in self.tokenizer.id_to_token(r))
        self.decimal = [str(i) for i in range(size)]
        self.common, self.split = pattern == COMMON_PATTERN, regex.compile(pattern)
        self.forget()

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes pieces that aren't known yet; what they give is kept by piece."""
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            for piece, found in zip(part, self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in part], add_special_tokens=False), strict=True):
                ids = found.ids
                self.known[piece] = len(self.ids)
                self.ids.append(ids)
                self.sizes.append(len(ids))
                self.shown.append(",".join(map(self.decimal.__getitem__, ids)))
                self.raw.append(self.decode_bytes(ids))

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        self.sizes: list[int] = []
        self.shown: list[str] = []
        self.raw: list[bytes] = []

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """For each text data[offsets[i]:offsets[i + 1]] the numbers of its pieces; distinct pieces are encoded once."""
        if len(self.known) > MOST_PIECES:
            self.forget()
        if self.common and len(offsets) == 2 and len(data) > PART_BYTES:
            bounds = part_bounds(data, PART_BYTES)
            parts = [self._pieces(data[a:b], np.array([0, b - a])) for a, b in zip(bounds, bounds[1:], strict=False)]
            return [[k for p in parts for k in p[0]]]
        return self._pieces(data, offsets)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        if not len(data):
            return [[] for _ in offsets[1:]]
        if self.common:
            starts = piece_starts(data, offsets)
        else:
            blob = data.tobytes()
            starts = np.array([a + len(t[: m.start()].encode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True) for t in [blob[a:b].decode()] for m in self.split.finditer(t)], np.int64)
        bounds = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.known])
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[np.asarray(coded.indices)]
        at = np.searchsorted(starts, offsets, "left")
        return [number[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        raw = [t.encode("utf-8") for t in texts]
        rows = self.pieces(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
        return [[i for k in row for i in self.ids[k]] for row in rows]

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of each token of text."""
        out, at = [], 0
        for i in self.encode([text])[0]:
            out.append((i, at, at := at + len(self.bytes_of[i])))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_text(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded bytes if with_ids) of every row."""
    arrow_rows(docs.sparkSession)
    cols, names = carry(docs, keep, ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"))
    src = docs.select(*cols, F.col(text).alias("_text"))
    out = [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    out += [("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.binary(), "binary")] if with_ids else []
    schema = ", ".join([f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, src.schema.fields, strict=False)] + [f"{n} {t}" for n, _, t in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path, pattern)
        for batch in batches:
            for i, j, data, off in text_slices(batch, "_text"):
                cols: list[list] = [[] for _ in out]
                for row in model.pieces(data, off):
                    whole = b"".join([model.raw[k] for k in row])
                    shown = ",".join([model.shown[k] for k in row])
                    cells = (sum([model.sizes[k] for k in row]), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(whole).hexdigest())
                    cells += ([i for k in row for i in model.ids[k]], whole) if with_ids else ()
                    for col, x in zip(cols, cells, strict=True):
                        col.append(x)
                part = batch.slice(i, j - i)
                arrays = [part.column(f"k{k}") for k in range(len(names))] + [pa.array(c, t) for c, (_, t, _) in zip(cols, out, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(n for n, _, _ in out)])
        model.forget()  # a worker lives on for other work
        lean()

    return src.mapInArrow(run, schema)
