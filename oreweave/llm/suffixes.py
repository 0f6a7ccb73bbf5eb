"""Suffix sorting in two stages, and common prefixes of neighbours.

A suffix that is smaller than its successor is sorted directly; the others are induced. Buckets
of first bytes are finished in ascending order: when a bucket is final, every suffix one place
before a member that begins with a larger byte belongs, in that order, to the front of its own
bucket. Orders and prefixes are exact for the first `DEPTH` bytes, equal ones stand together.
The end of the buffer counts as larger than any byte.
"""

from __future__ import annotations

import numpy as np

DEPTH = 56  # bytes; a multiple of 8


def words_at(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place as one number, with 0xFF behind the end."""
    padded = np.concatenate([data, np.full(16, 255, np.uint8)]).tobytes()
    out = np.empty(len(data) + 8, np.uint64)
    for o in range(8):
        part = out[o::8]
        part[:] = np.frombuffer(padded, f"{order}u8", len(part), o)
    return out


def _sorted(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places by their next DEPTH bytes; ties keep their order."""
    last = len(words) - 1
    places = places[np.argsort(words[places], kind="stable")]
    tied = np.arange(len(places))
    group = np.cumsum(np.r_[False, words[places[1:]] != words[places[:-1]]]) if len(places) else tied
    for at in range(8, DEPTH, 8):
        many = np.bincount(group) > 1 if len(group) else np.empty(0, bool)
        keep = many[group]
        tied, group = tied[keep], group[keep]
        if not len(tied):
            break
        key = words[np.minimum(places[tied] + at, last)]
        order = np.lexsort((key, group))
        places[tied] = places[tied][order]
        key, group = key[order], group[order]
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    return places


def suffix_array(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """All suffixes of a buffer in order; `words` are its big-endian words_at."""
    size = len(data)
    if not size:
        return np.empty(0, np.int64)
    after = np.r_[data[1:].astype(np.int16), np.int16(256)]
    rises = after > data
    change = np.flatnonzero(after != data)  # runs of one byte share the type of their last place
    small = np.repeat(rises[change], np.diff(change, prepend=-1))
    del after, rises, change
    direct = _sorted(np.flatnonzero(small).astype(np.int32 if size < 1 << 31 else np.int64), words)
    cuts = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        bucket = waiting[byte]
        fresh = np.concatenate(bucket) if bucket else np.empty(0, direct.dtype)
        while len(fresh):  # a run of this byte: each place brings the one before it
            fresh = fresh[fresh > 0] - 1
            fresh = fresh[(data[fresh] == byte) & ~small[fresh]]
            if len(fresh):
                bucket.append(fresh)
        bucket.append(direct[cuts[byte] : cuts[byte + 1]])
        done = np.concatenate(bucket)
        waiting[byte] = []
        out.append(done)
        before = done[done > 0] - 1
        first = data[before]
        before, first = before[first > byte], first[first > byte]
        before = before[np.argsort(first, kind="stable")]
        spread = np.bincount(first, minlength=256)
        for other, part in zip(np.flatnonzero(spread).tolist(), np.split(before, np.cumsum(spread[spread > 0])[:-1])):
            waiting[other].append(part)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bytes, DEPTH at most, that each place in an order shares with the next one."""
    a, b, last = order[:-1], order[1:], len(words) - 1
    shared = np.zeros(len(a), np.uint8)
    live = np.arange(len(a), dtype=order.dtype)
    for at in range(0, DEPTH, 8):
        differ = words[np.minimum(a[live] + at, last)] ^ words[np.minimum(b[live] + at, last)]
        equal = np.zeros(len(live), np.uint8)
        for k in range(8):
            equal += differ < np.uint64(1 << (56 - 8 * k))
        shared[live] += equal
        live = live[differ == 0]
        if not len(live):
            break
    return shared
