"""Words, word hashes and shingles of many texts at once, in numpy over the bytes of an Arrow column.

Hashes of all substrings come from one running sum: with an odd multiplier P, sum(byte * P**i) over a span, times the
inverse of P**start modulo 2**64, depends on the span's bytes alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (nulls: empty) and the offsets of its rows, from 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_table(extra: bytes = b"") -> np.ndarray:
    """For each byte, whether it belongs to a word: ASCII digits and letters, all of non-ASCII characters, and ``extra``."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    t[list(extra)] = True
    return t


def ascii_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def spans(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of True that stay within a row; per row, the index of its first run."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _powers(n: int, of: np.uint64) -> np.ndarray:
    import sys

    store = sys.__dict__.setdefault("_sluice_powers", {})
    have = store.get(int(of))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, of, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 21:
            store[int(of)] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n, _P), out=run[1:])
    return mix((run[ends] - run[starts]) * _powers(n + 1, _P_INV)[starts])


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``k`` words, and the rows they are of; a row of 1 to k-1 words has its words as one
    shingle. ``first``: per row the index of its first word, and the number of words at the end."""
    rows, count = len(first) - 1, np.diff(first)
    n = len(words)
    row_of = np.repeat(np.arange(rows), count)
    out = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        m = n - k + 1
        total = np.zeros(m, np.uint64)
        factor = np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(k):
                total += words[j : j + m] * factor
                factor = factor * _Q
        ok = np.arange(m) + k <= first[1:][row_of[:m]]
        out = mix(total[ok]), row_of[:m][ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = []
        for r in short:
            h = 0
            for w in words[first[r] : first[r + 1]]:
                h = (h * int(_Q) + int(w)) & (1 << 64) - 1
            own.append(h ^ int(count[r]))
        out = np.concatenate([out[0], mix(np.array(own, np.uint64))]), np.concatenate([out[1], short])
    return out


def set_bits(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per row, how many of its positions are True."""
    run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return run[offs[1:]] - run[offs[:-1]]
