"""Static three-wise binary fuse filters over 64-bit keys, built and probed with numpy."""

from __future__ import annotations

import struct

import numpy as np

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_HEAD = struct.Struct("<QIII")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(33))) * _C2
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, seg: int, count: int) -> np.ndarray:
    """Three slots of each key, in three consecutive segments."""
    with np.errstate(over="ignore"):
        first = ((h >> np.uint64(32)) * np.uint64(count * seg)) >> np.uint64(32)
        mask = np.uint64(seg - 1)
        a = first
        b = first + np.uint64(seg)
        c = first + np.uint64(2 * seg)
        b = b ^ ((h >> np.uint64(18)) & mask)
        c = c ^ (h & mask)
    return np.stack([a, b, c]).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter of 16-bit fingerprints for the distinct keys; about 18 bits a key, one false positive in 65,536."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    seg = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    count = max(1, -(-int(n * factor) // seg) - 2) if n > 1 else 1
    seed = 1
    while True:
        h = _mix(keys, seed)
        slots = _slots(h, seg, count)
        order = _peel(slots, (count + 2) * seg)
        if order is not None:
            break
        seed += 0x9E3779B9
        if seed > 0x9E3779B9 * 64:
            count, seed = count + max(1, count // 8), 1
    table = np.zeros((count + 2) * seg, np.uint16)
    prints = _print(h)
    for ids, at in reversed(order):
        table[at] = 0
        s = slots[:, ids]
        table[at] = prints[ids] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
    return _HEAD.pack(seed, seg, count, n) + table.tobytes()


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Waves of (keys, the slot that each has alone), or None where a core is left."""
    n = slots.shape[1]
    deg = np.bincount(slots.ravel(), minlength=size)
    xor = np.zeros(size, np.int64)
    ids = np.arange(n)
    for s in slots:
        np.bitwise_xor.at(xor, s, ids)
    front, waves, done = np.flatnonzero(deg == 1), [], 0
    while len(front):
        front = front[deg[front] == 1]
        keys, first = np.unique(xor[front], return_index=True)
        if not len(keys):
            break
        waves.append((keys, front[first]))
        done += len(keys)
        touched = slots[:, keys]
        for s in touched:
            np.subtract.at(deg, s, 1)
            np.bitwise_xor.at(xor, s, keys)
        front = np.unique(touched)
        front = front[deg[front] == 1]
    return waves if done == n else None


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter: always true for its own keys."""
    seed, seg, count, n = _HEAD.unpack_from(filter_bytes)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(filter_bytes, np.uint16, offset=_HEAD.size)
    h = _mix(keys.astype(np.uint64), seed)
    s = _slots(h, seg, count)
    return (table[s[0]] ^ table[s[1]] ^ table[s[2]]) == _print(h)
