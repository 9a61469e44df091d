"""Word shingles of whole texts as 64-bit hashes, computed for a batch of Arrow strings at once.

Words are the runs of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only. The set of a text is
its distinct five-word shingles; a text with fewer words has its whole word sequence as the one
shingle; a null text, or one without words, has the empty set. A shingle is identified by a
64-bit hash: within one comparison of two sets of a million shingles a clash has a chance of
about 5e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 3, np.uint8)  # marks
_KIND[_SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
# Each byte gets a random odd-looking 64-bit value, so that a word's hash isn't linear in its bytes.
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = [np.uint64(x | 1) for x in np.random.default_rng(20240502).integers(1, 2**63, WIDTH, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over all output bits."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, modulo 2**64."""
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, np.uint64(pow(int(_BASE), -1, 2**64)), dtype=np.uint64)
    if n:
        up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(1 << 16)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and for n texts n+1 offsets into them."""
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0 or column.null_count == n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    start = int(at[0])
    raw = np.frombuffer(data, np.uint8, int(at[-1]) - start, start) if data is not None else np.zeros(0, np.uint8)
    at = at - start
    if column.null_count:  # a null's bytes, if there are any, aren't text
        raw = raw.copy()
        for i in np.flatnonzero(np.asarray(column.is_null())):
            raw[at[i] : at[i + 1]] = 0x20
    return raw, at


def _runs(kinds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes of one kind within one text, but for kind 0."""
    first = np.empty(len(kinds), bool)
    first[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    edges = at[1:-1]
    first[edges[(edges > 0) & (edges < len(kinds))]] = True
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(kinds))
    keep = kinds[begin] > 0
    return begin[keep], end[keep]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, A-Z lower-cased, and for n texts n+1 offsets."""
    raw, at = _bytes(column)
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    begin, end = _runs((~_SPACE[raw]).view(np.uint8), at)
    return _hashes(_LOWER[raw], begin, end), np.searchsorted(begin, at).astype(np.int64)


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of runs of letters, of digits and of marks, in their own case; bytes of characters
    beyond ASCII count as letters. Last the kind of each, from 0 to 63: a run of what, and its
    number of bytes, up to 15."""
    raw, at = _bytes(column)
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int32)
    begin, end = _runs(_KIND[raw], at)
    kinds = _KIND[raw[begin]].astype(np.int32) * 16 + np.minimum(end - begin, 15).astype(np.int32)
    return _hashes(raw, begin, end), np.searchsorted(begin, at).astype(np.int64), kinds


def _hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = len(raw)
    # Rolling hash in blocks of 2**16 bytes: the sum of value * BASE**(place in its block).
    block = len(_UP)
    sums = np.zeros(size + 1, np.uint64)
    values = _BYTE[raw]
    for a in range(0, size, block):
        b = min(size, a + block)
        np.cumsum(values[a:b] * _UP[: b - a], out=sums[a + 1 : b + 1])
    out = np.empty(len(begin), np.uint64)
    one = begin // block == (end - 1) // block
    k = begin[one] % block
    low = sums[begin[one]].copy()
    low[k == 0] = 0
    out[one] = (sums[end[one]] - low) * _DOWN[k]
    for i in np.flatnonzero(~one):  # a word over a block's edge is hashed by itself
        total, v = 0, values[begin[i] : end[i]]
        for a in range(0, len(v), block):
            part = v[a : a + block]
            total += int((part * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), a, 2**64)
        out[i] = total % 2**64
    out ^= (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(column)
    grams = np.zeros(0, np.uint64)
    if len(words) >= WIDTH:
        m = len(words) - WIDTH + 1
        grams = np.zeros(m, np.uint64)
        for j, c in enumerate(_PLACE):
            grams += words[j : j + m] * c
        grams = mix(grams)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            s = np.sort(grams[a : b - WIDTH + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif b > a:  # the count keeps a short text apart from a shingle with the same words
            h = np.array([b - a], np.uint64)
            for j in range(a, b):
                h = mix(h ^ words[j]) * _PLACE[0]
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
