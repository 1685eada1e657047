"""Two-stage suffix sorting of one block of bytes, and the strings in it that start more than once."""

from __future__ import annotations

import numpy as np


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the empty suffix is the smallest."""
    step = np.sign(np.diff(data.astype(np.int16), append=-1))
    step[-1:] = -1
    differs = np.where(step != 0, np.arange(len(data)), len(data))
    return step[np.minimum.accumulate(differs[::-1])[::-1]] > 0


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``data`` (bytes), ordered by their first ``depth`` bytes at least.

    Only suffixes smaller than their successors are compared. Every other suffix is its first byte
    before a smaller suffix, so a scan of the buckets of first bytes, from the least on, puts each
    at the end of what its bucket holds so far: first those led there by smaller buckets, then,
    within the bucket, those that repeat the byte, then the sorted ones.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    direct = np.flatnonzero(smaller_than_next(data))
    rows = np.ndarray((n, depth), np.uint8, padded, strides=(1, 1))[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"V{depth}").ravel(), kind="stable")]
    of_byte = np.searchsorted(data[direct], np.arange(257))
    led: list[list[np.ndarray]] = [[] for _ in range(256)]
    led[data[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        bucket = led[byte]
        last = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        bucket = [last]
        while len(last):
            last = last[last > 0] - 1
            last = last[data[last] == byte]
            bucket.append(last)
        bucket.append(direct[of_byte[byte] : of_byte[byte + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        ahead = whole[whole > 0] - 1
        ahead = ahead[data[ahead] > byte]
        if len(ahead):
            ahead = ahead[np.argsort(data[ahead], kind="stable")]
            for some in np.split(ahead, np.flatnonzero(np.diff(data[ahead])) + 1):
                led[data[some[0]]].append(some)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, in whole steps of eight bytes up to ``depth``."""
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    eights = np.ndarray((len(data) + depth,), "<u8", padded, strides=(1,))
    found = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        alive = alive[eights[order[alive] + at] == eights[order[alive - 1] + at]]
        found[alive] = at + 8
    return found


def repeated_starts(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``valid`` starts have a string of ``length`` bytes that starts at another one too."""
    order = suffix_array(data, length)
    order = order[valid[order]]
    same = np.flatnonzero(common_prefixes(data, order, length) >= length)
    out = np.zeros(len(data), bool)
    out[order[same]] = True
    out[order[same - 1]] = True
    return out
