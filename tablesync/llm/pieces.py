"""The byte table of byte-level BPE, classes of characters, and the pieces of the usual split pattern."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point under the split pattern."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


#: The contractions of the split pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_table() -> list[str]:
    """The printable character of each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the matches of the split pattern, over texts that lie side by side."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = char_classes()[points]
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    byte = np.concatenate(([0], np.cumsum(width)))
    n = len(points)
    opens = np.zeros(n + 1, bool)  # a text begins here
    opens[np.searchsorted(byte, offsets)] = True
    opens[n] = True
    prev = np.concatenate(([0], kind[:-1]))
    new = opens[:n] | (kind != prev)  # a run of one class begins here
    space = kind == SPACE
    ends = np.concatenate((new[1:] | opens[1:n], [True]))  # a run ends with this character
    before = space & ends & ~opens[1:]  # the last whitespace before a visible character
    start = new.copy()
    start |= before
    joins = before & (points == 32)  # it belongs to the next piece
    start[1:][joins[:-1]] = False
    quotes = np.flatnonzero((points == 39) & start & ~opens[1:])
    if len(quotes):
        padded = np.concatenate((points, [0, 0]))
        for tail in CONTRACTIONS:
            q = quotes[quotes + len(tail) < n + 1]
            ok = np.ones(len(q), bool)
            for k, c in enumerate(tail, 1):
                ok &= (padded[q + k] == ord(c)) & ~opens[np.minimum(q + k, n)]
            for at in q[ok]:
                if not start[at]:
                    continue
                start[at + 1] = False
                stop = at + 1 + len(tail)
                if stop < n:
                    start[stop] = True
    return byte[:n][start]


def part_bounds(data: np.ndarray, size: int) -> list[int]:
    """Cuts of one long text into parts of about `size` bytes, where a piece begins whatever stands around: at a space behind a visible ASCII character."""
    bounds = [0]
    while len(data) - bounds[-1] > size:
        at, found = bounds[-1] + size, None
        while found is None and at < len(data):
            near = data[at - 1 : at + (1 << 16)]
            ok = np.flatnonzero((near[1:] == 0x20) & (near[:-1] > 0x20) & (near[:-1] < 0x7F))
            found = at + int(ok[0]) if len(ok) else None
            at += 1 << 16
        if found is None:
            break
        bounds.append(found)
    return [*bounds, len(data)]
