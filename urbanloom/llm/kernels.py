"""Vectorised text kernels over Arrow batches: bytes, word borders, polynomial hashes.

A batch of texts is handled as one byte array with offsets. Work is cut into chunks of about
``CHUNK`` bytes at row borders, so memory follows the chunk (or the longest single text), not the batch.
Null texts are empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
#: Spans are hashed by a polynomial over their bytes modulo the prime 2^61 - 1: two different spans of n bytes agree with
#: probability n / 2^61 at most over the choice of the base, whatever their structure.
PRIME = (1 << 61) - 1
BASE = int(np.random.Generator(np.random.PCG64(20240607)).integers(1 << 58, 1 << 60))
BASE_INV = pow(BASE, -1, PRIME)
_P, _LOW31 = _U(PRIME), _U((1 << 31) - 1)
#: Bytes that are hashed at a time: their 39-bit products can be summed in 64 bits, and the work fits a core's cache.
_SUMMED = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x mod PRIME for any 64-bit x."""
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b mod PRIME, both below it, by 32-bit halves: 2^61 counts as 1 and 2^64 as 8."""
    a0, a1, b0, b1 = a & _U(0xFFFFFFFF), a >> _U(32), b & _U(0xFFFFFFFF), b >> _U(32)
    low, middle = a0 * b0, a0 * b1 + a1 * b0
    return reduced((low & _P) + (low >> _U(61)) + ((a1 * b1) << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32)))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod PRIME, kept and grown for each base."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        known = 1 if have is None else len(have)
        have = np.concatenate([np.ones(1, np.uint64) if have is None else have, np.empty(size - known, np.uint64)])
        while known < size:
            have[known : 2 * known] = times(have[:known], _U(pow(base, known, PRIME)))
            known *= 2
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers (xor-shift-multiply); seeds give different ones."""
    x = x ^ _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(29)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of a string or binary column; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_binary(), pa.binary()):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    wide = column.type == pa.large_binary()
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    data, offs = buffers(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Words of the n-gram operators: runs without white space.
SPACE = table(bytes([0x20, *range(9, 14)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(is_in: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True, cut at row borders, and for each row the first run's index (n+1 values)."""
    n = len(is_in)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_in[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(is_in & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_in[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(is_in & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _folded(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low + 2^31 * high mod PRIME for sums of products; the upper sum's bits above the 30th come round at the bottom."""
    high = (high & _P) + (high >> _U(61))
    return reduced((low & _P) + (low >> _U(61)) + ((high & _U((1 << 30) - 1)) << _U(31)) + (high >> _U(30)))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), none of which is empty: sum of (byte + 1) * BASE^place mod PRIME, mixed
    with the length. The work follows the spans' bytes, some of them at a time."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    upto = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + _SUMMED, "right")) - 1)
        begin = upto[a:b] - upto[a]
        place = np.arange(upto[b] - upto[a]) - np.repeat(begin, size[a:b])
        value = data[np.repeat(starts[a:b], size[a:b]) + place].astype(np.uint64) + _U(1)
        power = powers(BASE, int(size[a:b].max()))[place]
        out[a:b] = _folded(np.add.reduceat(value * (power & _LOW31), begin), np.add.reduceat(value * (power >> _U(31)), begin))
        a = b
    return mix(out ^ (size.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))


def prefix_hash(data: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """H[i] = sum of (b[j] + 1) * BASE^place[j] over j < i, mod PRIME; a byte's place is its index unless given."""
    out = np.zeros(len(data) + 1, np.uint64)
    power = powers(BASE, int(place.max(initial=0)) + 1 if place is not None else len(data))
    for a in range(0, len(data), _SUMMED):
        part = data[a : a + _SUMMED].astype(np.uint64) + _U(1)
        p = power[a : a + len(part)] if place is None else power[place[a : a + len(part)]]
        total = _folded(np.cumsum(part * (p & _LOW31), dtype=np.uint64), np.cumsum(part * (p >> _U(31)), dtype=np.uint64))
        out[a + 1 : a + 1 + len(part)] = reduced(total + out[a])
    return out


def between(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """The polynomials of [start, end) mod PRIME, that don't depend on where the span stands (``place`` of its start)."""
    place = starts if place is None else place
    return times(reduced(prefix[ends] + _P - prefix[starts]), powers(BASE_INV, int(place.max(initial=0)) + 1)[place])


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal exactly for spans of equal bytes.

    Hashes propose which spans are equal; the bytes of each are compared with those of the first of its number, and
    if hashes collided, all are numbered by their bytes. No span is empty.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    _, first, ids = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    ids = ids.astype(np.int64)
    same = np.array_equal(size, size[first][ids])
    own = np.flatnonzero(first[ids] != np.arange(len(ids)))
    for a in range(0, len(own) if same else 0, 1 << 16):
        rows = own[a : a + (1 << 16)]
        n = size[rows]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(data[np.repeat(starts[rows], n) + step], data[np.repeat(starts[first[ids[rows]]], n) + step]):
            same = False
            break
    if not same:
        raw, seen = data.tobytes(), {}
        ids = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    return ids


_ODD = [0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0x91E10DA5C79E7B1D, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03]


def window_hash(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes (len - k + 1 values; rows are the caller's business)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k * 0x51ED270B + seed, np.uint64)
    for i in range(k):
        total += words[i : i + n] * _U(_ODD[i % 6] + 2 * (i // 6))
        if i >= 6:
            total = mix(total)
    return mix(total)
