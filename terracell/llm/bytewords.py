"""Vectorised word splitting and hashing over UTF-8 buffers.

Words are maximal runs of "word bytes". Every byte of a multi-byte code point is
a word byte in both alphabets below, so splitting bytes equals splitting code
points, and lower-casing A-Z is a byte table. Hashes are only ever used to find
candidates or as set elements of 64 mixed bits; see each operator for what it
verifies afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE = 1 << 20  # bytes hashed at once; bounds the temporaries of a call
_BASE = U64(0x9E3779B97F4A7C15)


def _byte_table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: letters a-z (either case), digits and everything beyond ASCII
ALNUM = _byte_table(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
#: everything but space and the five ASCII line and tab controls
NONSPACE = _byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD_BYTES = FOLD.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_FOLDED_VALUE = _BYTE_VALUE[FOLD]


def _powers(n: int) -> np.ndarray:
    return np.concatenate(([U64(1)], np.cumprod(np.full(max(n - 1, 0), _BASE, dtype=np.uint64))))[:n]


_POWERS = _powers(64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls become empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def chunks(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _hash_slice(data: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = table[data]
    if not m.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    edge = np.empty(len(m) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(m[1:], m[:-1], out=edge[1:-1])
    edge[breaks] = True
    starts = np.flatnonzero(edge[:-1] & m)
    ends = np.flatnonzero(edge[1:] & m) + 1
    lens = ends - starts
    where = np.flatnonzero(m)
    first = np.cumsum(lens) - lens
    inside = np.arange(len(where)) - np.repeat(first, lens)
    longest = int(lens.max())
    power = _POWERS if longest <= len(_POWERS) else _powers(longest)
    h = np.add.reduceat(_FOLDED_VALUE[data[where]] * power[inside], first)
    return mix(h + lens.astype(np.uint64)), starts, ends


def hash_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, A-Z folded.

    Returns (hashes, starts, ends, bounds): word ``w`` is bytes starts[w]:ends[w],
    row ``r`` owns words bounds[r]:bounds[r + 1]. Long inputs are hashed in
    slices cut between words.
    """
    n, at, parts = len(data), 0, []
    while at < n:
        end = min(at + 4 * SLICE, n)
        if end < n:
            gaps = np.flatnonzero(~table[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(~table[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else n
        lo, hi = np.searchsorted(offsets, [at, end])
        h, s, e = _hash_slice(data[at:end], offsets[lo:hi] - at, table)
        parts.append((h, s + at, e + at))
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    h, s, e = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
    return h, s, e, np.searchsorted(s, offsets)


_GRAM = mix(np.arange(11, 75, dtype=np.uint64) * _BASE) | U64(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (fewer than k words: none)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = words[:n] * _GRAM[0]
    for j in range(1, k):
        g = g + words[j : j + n] * _GRAM[j % 64]
    return mix(g + U64(k))


def word_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The folded words themselves."""
    return [data[a:b].tobytes().translate(FOLD_BYTES).decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]
