"""Vectorised splitting of texts by the public byte-level BPE pattern.

The pattern is a list of alternatives over four classes of characters (letters,
numbers, white space, others), so its matches follow from class changes between
neighbouring characters plus two rules: the last white space before a word is
split off, and a single blank joins the word; an apostrophe that starts a run of
others may take a contraction's letters. ``tests/llm`` compares this with the
pattern itself.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, points):
            a, b = ord(points[found.start()]), ord(points[found.end() - 1])
            if a < 0xD800 <= b:
                out[a:0xD800] = out[0xE000:b + 1] = kind
            else:
                out[a:b + 1] = kind
    return out


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of the texts as one binary array, and the first pre-token of each text (one more entry)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    n = len(points)
    row_ends = np.cumsum([0, *map(len, texts)])
    if n == 0:
        return pa.array([], pa.binary()), np.zeros(len(row_ends), dtype=np.int64)
    kind = np.empty(n + 3, dtype=np.uint8)
    kind[:n] = classes()[points]
    kind[n:] = 255
    fresh = np.zeros(n + 3, dtype=bool)
    fresh[row_ends] = True
    start = fresh.copy()
    start[1:n] |= kind[1:n] != kind[:n - 1]
    # Position b follows white space and begins a word of the same text.
    b = np.flatnonzero(start[1:n] & ~fresh[1:n] & (kind[:n - 1] == SPACE)) + 1
    start[b - 1] = True
    start[b] = points[b - 1] != 32
    # Contractions, where an apostrophe begins a pre-token and its letters are of the same text.
    padded = np.zeros(n + 3, dtype=np.uint32)
    padded[:n] = points
    at = np.flatnonzero(start[:n] & (points == 39))
    one, two = padded[at + 1], padded[at + 2]
    same1, same2 = ~fresh[at + 1], ~fresh[at + 1] & ~fresh[at + 2]
    short = same1 & np.isin(one, [115, 116, 109, 100])  # s t m d
    long = same2 & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))  # re ve ll
    for chosen, length in ((at[short], 2), (at[long & ~short], 3)):
        for k in range(1, length):
            start[chosen + k] = False
        start[chosen + length] = True
    starts = np.flatnonzero(start[:n])
    width = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(width, out=byte_at[1:])
    bounds = np.append(byte_at[starts], byte_at[n]).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(joined.encode())])
    return tokens, np.searchsorted(starts, row_ends)


class Cached:
    """Ids of whole arrays of pre-tokens: each distinct one is encoded once per worker.

    ``encode`` maps a list of byte strings to a list of uint32 id arrays. A cache that
    would pass ``limit`` entries keeps those in use, so memory is bounded and frequent
    pre-tokens stay.
    """

    def __init__(self, encode, limit: int = 300_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def ids(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each pre-token."""
        if len(tokens) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        coded = tokens.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.known
        new = [x for x in distinct if x not in known]
        if new:
            if len(known) + len(new) > self.limit:
                known = self.known = {x: known[x] for x in distinct if x in known}
            for x, found in zip(new, self.encode(new)):
                known[x] = np.asarray(found, dtype=np.uint32).tobytes()
        parts = [known[x] for x in distinct]
        flat = np.frombuffer(b"".join(parts), dtype=np.uint32)
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        which = coded.indices.to_numpy(zero_copy_only=False)
        per = lengths[which]
        first = (np.cumsum(lengths) - lengths)[which]
        before = np.cumsum(per) - per
        return flat[np.arange(int(per.sum())) + np.repeat(first - before, per)], per
