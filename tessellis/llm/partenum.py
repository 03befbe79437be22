"""PartEnum signatures of sets for a Jaccard similarity of at least 4/5.

Two sets of a and b elements that reach it differ in at most (a + b) // 9 elements. Sizes fall into bands; the
instance of a band takes the sets of the band and the smaller ones that still may reach its sets, so every linked
pair meets in the instance of the larger set. An instance partitions the feature domain by a hash:

* small bands (at most SUBSET_DIFF differences): into groups of five parts, few enough that some group has at most two
  differences. Every choice of three parts of a group is a signature, and one choice has no difference.
* other bands: into K + 1 + M parts, of which a set takes the first k + 1 + M, k being the most differences that it can
  have there. At least 1 + M of these parts agree. A part is light if it has no feature or only common ones. A set
  with at most M light parts leaves them out: it still agrees in one. A set with more gives all its parts, and
  so does its partner, because the agreeing parts are then light for both.

Any set of common features gives the same links; a good one only keeps unlike sets apart.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import ceil, exp, sqrt

import numpy as np

from tessellis.llm.shingles import mixed

SUBSET_DIFF, PARTS, CHOSEN, PER_GROUP = 8, 5, 3, 3
GROWTH = 1.5


@cache
def bands(most: int) -> list[tuple[int, int]]:
    """First and last size of every band up to the one that has ``most``."""
    found, low = [], 1
    while low <= most or not found:
        high = max(low, int(low * GROWTH))
        found.append((low, high))
        low = high + 1
    return found


@cache
def allowance(low: int, high: int) -> int:
    """M of a band: the light parts that a set of the smallest size in the instance has, and some more."""
    parts, most = 2 * high // 9 + 1, 0
    for _ in range(8):
        share = exp(-0.8 * low / (parts + most))
        most = ceil((parts + most) * share + 2.5 * sqrt((parts + most) * share * (1 - share)) + 0.04 * parts)
    return most


@cache
def instances(size: int) -> list[tuple[int, int, int]]:
    """(number, first, last size of the band) of the instances that take a set of this size."""
    return [(k, low, high) for k, (low, high) in enumerate(bands(ceil(size * 5 / 4))) if low * 4 <= size * 5 and size <= high]


_CHOICES = np.array(list(combinations(range(PARTS), CHOSEN)))


def _signed(sums: np.ndarray, number: int, which: np.ndarray) -> np.ndarray:
    tags = (np.uint64(number + 1) << np.uint64(40)) + which.astype(np.uint64)
    return mixed(sums + mixed(tags)).view(np.int64)


def signatures(values: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The signatures of a set of hashes; common: the sorted common hashes."""
    size, found = len(values), []
    weights = mixed(values ^ np.uint64(0x5851F42D4C957F2D))
    rare = None
    for number, low, high in instances(size):
        diff = 2 * high // 9
        if diff == 0:
            continue  # only equal sets reach it
        spread = mixed(values + np.uint64(number * 2 + 1)) >> np.uint64(32)
        if diff <= SUBSET_DIFF:
            groups = -(-(diff + 1) // PER_GROUP)
            part = (spread * np.uint64(groups * PARTS) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(groups * PARTS, np.uint64)
            np.add.at(sums, part, weights)
            sums = sums.reshape(groups, PARTS) * (np.arange(PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            chosen = sums[:, _CHOICES].sum(axis=2, dtype=np.uint64).ravel()
            found.append(_signed(chosen, number, np.arange(len(chosen))))
            continue
        spare = allowance(low, high)
        parts = diff + 1 + spare
        part = (spread * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        taken = min(parts, (size + min(high, size * 5 // 4)) // 9 + 1 + spare)
        if rare is None:
            at = np.searchsorted(common, values)
            rare = (common[np.minimum(at, len(common) - 1)] != values) if len(common) else np.ones(size, bool)
        light = np.bincount(part[rare], minlength=parts)[:taken] == 0
        inside = part < taken
        sums = np.zeros(taken, np.uint64)
        np.add.at(sums, part[inside], weights[inside])
        which = np.arange(taken) if light.sum() > spare else np.flatnonzero(~light)
        found.append(_signed(sums[which], number, which))
    return np.concatenate(found) if found else np.empty(0, np.int64)
