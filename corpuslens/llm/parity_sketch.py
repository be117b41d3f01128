"""Parity sketches of token sets and the keys that join them.

A sketch holds, for every bit, whether an odd number of a set's tokens hash to
it. Each token in one set only flips one bit, so two sketches' Hamming distance
is at most the size of the symmetric difference. A similarity of t or more
between sets of at most u tokens leaves a symmetric difference of at most
d = 2u(1-t)/(1+t); cut into d+1+e parts, two such sketches agree on at least
1+e parts. Parts almost without bits would agree between any sets, so they give
no key: if either sketch has no more than e of them, a part that gives a key
still agrees. (Very frequent keys can be left out by the same argument.) A set whose sketch has more of them is also sketched by another
hash function, and so on; the last level gives keys for all its parts. No pair
is lost.

Bits are kept sparse: a part's value is the exclusive or of the codes of its
bits, 2**64 of them.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .common import mix

LEVELS = 4
#: Spares are below this.
SPARES = 1 << 16
#: Growth of the size bands.
BAND = 1.25


@lru_cache(maxsize=None)
def band_limits(i: int) -> tuple[int, int]:
    """The smallest and largest set size of band ``i``."""
    low = 1 if i == 0 else band_limits(i - 1)[1] + 1
    return low, max(low, math.floor(low * BAND))


@lru_cache(maxsize=None)
def band_of(size: int) -> int:
    i = 0
    while band_limits(i)[1] < size:
        i += 1
    return i


@lru_cache(maxsize=None)
def layout(i: int, num: int, den: int) -> tuple[int, int, int]:
    """For band ``i`` and the threshold num/den: (most symmetric difference, parts, slack e)."""
    low, high = band_limits(i)
    d = 2 * high * (den - num) // (den + num)
    least = max(1, -(-low * num // den))
    e = 0
    while e < 2 * d + 4:
        empty = (d + 1 + e) * math.exp(-least / (d + 1 + e))
        want = math.ceil(empty + 2 * math.sqrt(empty)) + 1  # one to spare for a frequent key
        if want <= e:
            break
        e += 1
    return d, d + 1 + e, e


def keys(sets: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join keys of sets given one after another (distinct token hashes; set k is first[k]:first[k+1]).

    Returns (keys, set numbers, spares). Sets of a similarity of num/den or more
    share a key unless they are equal, in which case they may have none. A spare
    is ``SPARES * context + s``: in its context (band and level) the set could do
    without ``s`` more keys, if all sets that have those do without them too.
    """
    sizes = np.diff(first)
    bands = np.array([band_of(int(n)) if n else -1 for n in sizes], np.int64)
    top = np.array([band_of(int(n) * den // num) if n else -2 for n in sizes], np.int64)
    out_key, out_set, out_spare = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for band in range(int(bands.max(initial=-1) >= 0) * max(0, int(bands[bands >= 0].min(initial=1 << 30))), int(top.max(initial=-1)) + 1):
        d, parts, e = layout(band, num, den)
        if not d:
            continue
        members = np.flatnonzero((bands <= band) & (band <= top) & (sizes > 0))
        for level in range(LEVELS):
            if not len(members):
                break
            n = sizes[members]
            owner = np.repeat(np.arange(len(members)), n)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[members], n)
            bits = mix(sets[at] + np.uint64(0x632BE59BD9B4E019 * (level + 1) % 2**64))
            cell = owner * parts + ((bits >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            value = np.zeros(len(members) * parts, np.uint64)
            np.bitwise_xor.at(value, cell, mix(bits))
            low = np.bincount(cell, minlength=len(value)) == 0
            empty = low.reshape(-1, parts).sum(1)
            over = empty > e
            last = level == LEVELS - 1
            give = np.flatnonzero(~low | np.repeat(over, parts) if last else ~low)
            spare = np.where(over, 0, e - empty) if last else np.maximum(e - empty, 0)
            tag = mix(np.uint64(band << 32 | level << 24) + np.arange(parts, dtype=np.uint64))
            out_key.append(mix(value[give] ^ tag[give % parts]))
            out_set.append(members[give // parts])
            out_spare.append((band * LEVELS + level) * SPARES + np.minimum(spare, SPARES - 1)[give // parts])
            members = members[over]
    return np.concatenate(out_key), np.concatenate(out_set), np.concatenate(out_spare)


def bitmap_bits(size: int) -> int:
    """Bits of the dense sketch of a set: a power of two, as many as tokens at least."""
    return max(256, 1 << max(0, size - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    """A dense parity sketch."""
    bits = bitmap_bits(len(tokens))
    return np.packbits((np.bincount((mix(tokens + np.uint64(77)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of dense sketches, the longer folded to the shorter: no more than the symmetric difference."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
