"""A minimal perfect hash over whole-number keys, built and read in numpy.

Keys that are alone at their place of a level's bit array stay there, the others go on to the
next level; a key's slot is the number of bits set before its own. The key of each slot is
stored, and a look-up compares it, so keys outside the set are always told apart.
"""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Places a key at each level.
ROOM = 2
#: Levels after which keys of one 64-bit hash are taken for a clash, and another seed is tried.
LEVELS = 60


def mix(h: np.ndarray, more) -> np.ndarray:
    """64-bit hashes with further whole numbers mixed in."""
    h = (h ^ np.asarray(more).astype(np.uint64)) * MIX
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def key_hash(keys: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of keys of shape (n, width)."""
    h = np.full(len(keys), seed + 1, np.uint64)
    for c in range(keys.shape[1]):
        h = mix(h, keys[:, c])
    return h


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h, level + 1) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> dict:
    """The hash of distinct keys, shape (n, width), as plain arrays that can be broadcast:
    seed, levels of (bits, ranks), and the stored keys in slot order."""
    n = len(keys)
    for seed in range(100):
        h, left, levels, slots, used = key_hash(keys, seed), np.arange(n), [], np.zeros(n, np.int64), 0
        while len(left) and len(levels) < LEVELS:
            size = -(-max(64, ROOM * len(left)) // 64) * 64
            at = _place(h[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(bits).astype(np.int64)
            ranks = used + np.concatenate([[0], np.cumsum(counts)[:-1]])
            levels.append((bits, ranks))
            stays = alone[at]
            slots[left[stays]] = _slot(bits, ranks, at[stays])
            used += int(counts.sum())
            left = left[~stays]
        if not len(left):
            stored = np.empty_like(keys)
            stored[slots] = keys
            return {"seed": seed, "levels": levels, "keys": stored}
    raise ValueError("repeated keys")


def _slot(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    before = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
    return ranks[word] + np.bitwise_count(before).astype(np.int64)


def look_up(table: dict, keys: np.ndarray) -> np.ndarray:
    """Slots of keys, shape (n, width); -1 for those that the table doesn't store."""
    out = np.full(len(keys), -1, np.int64)
    h, left = key_hash(keys, table["seed"]), np.arange(len(keys))
    for level, (bits, ranks) in enumerate(table["levels"]):
        if not len(left):
            break
        at = _place(h[left], level, len(bits) * 64)
        here = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        out[left[here]] = _slot(bits, ranks, at[here])
        left = left[~here]
    found = np.flatnonzero(out >= 0)
    wrong = (table["keys"][out[found]] != keys[found]).any(axis=1)
    out[found[wrong]] = -1
    return out
