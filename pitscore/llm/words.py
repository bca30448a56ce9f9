"""Vectorised words and shingles over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15 | 5)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words separated by ASCII white space.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Words of ASCII letters, digits and all code points beyond ASCII.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``p**i`` and ``p**-i`` modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_P, _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(arr: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (no nulls) and the n+1 offsets of the texts in them."""
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64) if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(arr: pa.StringArray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and text number of every maximal run without ``gap`` bytes."""
    raw, off = text_bytes(arr)
    low = LOWER[raw]
    inside = ~gap[low]
    if not inside.any():
        z = np.zeros(0, np.int64)
        return low, z, z, z
    cut = np.zeros(len(low) + 1, bool)
    cut[off] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return low, starts, ends, off.searchsorted(starts, "right") - 1


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs ``low[start:end]``, equal for equal runs."""
    p, inv = powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_TABLE[low] * p[: len(low)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of the distinct runs of ``k`` words, sorted by both.

    A text of fewer words, but not none, has its whole sequence as one.
    """
    count = np.bincount(doc, minlength=n_docs)
    at, of = [], []
    if len(hashes) >= k:
        runs = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            runs = mix(runs * _P + hashes[j : j + len(runs)])
        same = doc[: len(runs)] == doc[k - 1 :]
        at.append(runs[same])
        of.append(doc[: len(runs)][same])
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    short = np.flatnonzero((count > 0) & (count < k))
    whole = count[short].astype(np.uint64)
    for j in range(k - 1 if len(short) else 0):
        more = j < count[short]
        word = hashes[np.minimum(first[short] + j, len(hashes) - 1)]
        whole = np.where(more, mix(whole * _P + word), whole)
    at.append(whole)
    of.append(short)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, d = np.concatenate(at), np.concatenate(of)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]
