"""Numpy helpers that run inside tasks on Arrow batches: words of many texts at once, without a Python object for each.

A word's hash is a polynomial over a random value for each byte, modulo 2**64, taken as the
difference of two prefix sums; so words of any length cost the same.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Texts are taken so many bytes at a time (one longer text alone).
CHUNK_BYTES = 1 << 20
#: Values that go through several steps at a time, so that they stay in a core's cache.
STEP = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    out = x.astype(np.uint64, order="C", copy=True)
    flat = out.reshape(-1)
    shifted = np.empty(min(STEP, len(flat)), dtype=np.uint64)
    for at in range(0, len(flat), STEP):
        x = flat[at : at + STEP]
        t = shifted[: len(x)]
        x ^= np.right_shift(x, np.uint64(30), out=t)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= np.right_shift(x, np.uint64(27), out=t)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= np.right_shift(x, np.uint64(31), out=t)
    return out


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


BASE = 0xD6E8FEB86659FD93
UNBASE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, UNBASE):
        powers = np.full(n, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def byte_table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word byte or not, value in the hash) for each byte; A-Z count as a-z if ``lower``."""
    is_word = np.ones(256, dtype=bool)
    is_word[list(separators)] = False
    values = randoms(256, 7)
    if lower:
        values[65:91] = values[97:123]
        is_word[65:91] = is_word[97:123]
    return is_word, values


def chunks(texts, max_bytes: int = CHUNK_BYTES):
    """For an Arrow string column: (first row, bytes, start and end of each text in them) for runs of rows."""
    import pyarrow as pa

    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + max_bytes, side="right")) - 1)
        yield row, data[at[row] : at[end]], at[row:end] - at[row], at[row + 1 : end + 1] - at[row]
        row = end


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
    """Words of texts that lie side by side in ``data``: hashes, byte starts and ends, and how many words each text has."""
    is_word, values = table
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(starts), dtype=np.int64)
    w = is_word[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = w[0], False
    np.greater(w[1:], w[:-1], out=edge[1:n])
    full = starts[starts < ends]
    edge[full] = w[full]
    first = np.flatnonzero(edge[:n])
    np.greater(w[:-1], w[1:], out=edge[1:n])
    edge[0], edge[n] = False, w[n - 1]
    last = ends[starts < ends]
    edge[last] = w[last - 1]
    end = np.flatnonzero(edge)
    powers, unpowers = _powers(1 << max(20, int(n).bit_length()))
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    v = values[data]
    v *= powers[:n]
    np.cumsum(v, out=sums[1:])
    h = mix((sums[end] - sums[first]) * unpowers[first] + (end - first).astype(np.uint64))
    return h, first, end, np.searchsorted(first, ends) - np.searchsorted(first, starts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = randoms(k, 11) | np.uint64(1)
    out, part = np.empty(n, dtype=np.uint64), np.empty(min(STEP, n), dtype=np.uint64)
    for at in range(0, n, STEP):
        x = out[at : at + STEP]
        t = part[: len(x)]
        np.multiply(hashes[at : at + len(x)], factors[0], out=x)
        for j in range(1, k):
            x += np.multiply(hashes[at + j : at + j + len(x)], factors[j], out=t)
    return mix(out)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole sequence of word hashes, none for an empty one."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    factors = randoms(len(hashes), 13) | np.uint64(1)
    return mix(np.array([(hashes * factors).sum(dtype=np.uint64) + np.uint64(len(hashes))], dtype=np.uint64))


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, the bytes of one weight side by side: the high ones are mostly 0 and compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def cut_points(parts: int) -> np.ndarray:
    """Where 64-bit keys are cut into equal ranges: the least key of each part but the first."""
    return np.array([-(-(b << 64) // parts) for b in range(1, parts)], dtype=np.uint64)
