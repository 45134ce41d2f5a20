"""XXH64 over many slices of one buffer at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Slices longer than this are hashed one at a time.
LONG = 256
#: Bytes that a buffer needs after its last slice.
SPARE = 8

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of many slices of ``data`` (which has 8 spare bytes at its end), equal lengths together."""
    out = np.empty(len(starts), dtype=np.uint64)
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    u8 = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    u4 = np.ndarray((len(data) - 3,), dtype="<u4", buffer=data, strides=(1,))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for size, lanes in zip(sizes.tolist(), np.split(order, first[1:])):
            at = starts[lanes]
            if size > LONG:
                out[lanes] = [xxhash.xxh64_intdigest(data[a : a + size].tobytes(), seed) for a in at.tolist()]
                continue
            o = 0
            if size >= 32:
                v = [np.full(len(at), x, dtype=np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
                while o + 32 <= size:
                    for i in range(4):
                        v[i] = _rotl(v[i] + u8[at + (o + 8 * i)] * P2, 31) * P1
                    o += 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ (_rotl(x * P2, 31) * P1)) * P1 + P4
            else:
                h = np.full(len(at), s + P5, dtype=np.uint64)
            h = h + np.uint64(size)
            while o + 8 <= size:
                h = _rotl(h ^ (_rotl(u8[at + o] * P2, 31) * P1), 27) * P1 + P4
                o += 8
            if o + 4 <= size:
                h = _rotl(h ^ (u4[at + o].astype(np.uint64) * P1), 23) * P2 + P3
                o += 4
            while o < size:
                h = _rotl(h ^ (data[at + o].astype(np.uint64) * P5), 11) * P1
                o += 1
            h ^= h >> np.uint64(33)
            h *= P2
            h ^= h >> np.uint64(29)
            h *= P3
            h ^= h >> np.uint64(32)
            out[lanes] = h
    return out
