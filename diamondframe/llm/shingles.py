"""Sets of word shingles as sorted hashes, their count vectors, and keys that near sets share."""

from __future__ import annotations

import math

import numpy as np

from diamondframe.llm.text_statistics import window_hashes

_U = np.uint64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Coordinates of a count vector.
GROUPS = 128


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; the whole sequence if it is shorter; empty if empty."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = window_hashes(words, width)
    if len(words) < width:  # a shorter sequence is no shingle of a longer one
        hashes = hashes * _U(0xA24BAED4963EE407) + _U(len(words))
    return np.unique(hashes)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U(salt)) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(31)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(30))


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that equal sets share."""
    return tuple(int(np.sum(_mixed(hashes, s), dtype=np.uint64).view(np.int64)) for s in (11, 13))


def count_vector(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((_mixed(hashes, 17) % _U(groups)).astype(np.int64), minlength=groups)


def least_common(a, b, percent: int):
    """The least size of the intersection of sets of a and b elements that link."""
    # 100 i >= p (a + b - i)
    return -(-percent * (a + b) // (100 + percent))


def band(size: int, percent: int) -> int:
    """Sets that link are in the same band of sizes or in neighbouring ones."""
    return math.floor(math.log(size) / math.log(100 / percent) + 1e-9)


def n_groups(of_band: int, percent: int) -> tuple[int, int]:
    """Groups for the sets up to a band, and how many of them linked sets have equal at least.

    Linked sets differ in at most ``differ`` elements, so all groups but as many are equal. There
    are enough groups that some equal one has elements, unless a set has very many without, and
    a twelfth more, as texts with a passage in common are most often alike in a group of one.
    """
    largest = (100 / percent) ** (of_band + 1)
    differ = math.floor(2 * largest * (100 - percent) / (100 + percent) + 1e-9)
    spare = 3 + differ // 12
    groups = differ + spare
    for _ in range(3):
        groups = differ + spare + math.ceil(1.5 * groups * math.exp(-largest * percent / 100 / groups))
    return groups, groups - differ


def shared_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set; sets that link have one in common.

    The shingles are dealt over groups by a hash. A key is a group with all of its elements. Sets
    of two bands meet in the groups of the larger one, so a set has keys for two numbers of groups.
    Of linked sets ``equal`` groups are equal. The largest of them is larger, in an order of the
    groups' contents, than ``equal - 1`` others, so each set may go without as many smallest groups.
    """
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    own, keys = band(len(hashes), percent), []
    dealt, value = _mixed(hashes, 23), _mixed(hashes, 29)
    for of_band in (own, own + 1):
        groups, equal = n_groups(of_band, percent)
        group = (dealt % _U(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group = group[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        found = np.add.reduceat(value[order], first)
        number = group[first].astype(np.uint64)
        sizes = np.diff(first, append=len(group))
        wanted = groups - equal + 1
        if len(first) < wanted:  # so many groups without elements that these count too
            empty = np.setdiff1d(np.arange(groups), group[first])[: wanted - len(first)].astype(np.uint64)
            found = np.concatenate([found, np.zeros(len(empty), dtype=np.uint64)])
            number = np.concatenate([number, empty])
        else:
            largest = np.lexsort((number, found, sizes))[len(first) - wanted :]
            found, number = found[largest], number[largest]
        salt = _U((of_band * 1_000_003 + 7) * 0x9E3779B97F4A7C15 % 2**64)
        keys.append(_mixed(found ^ _mixed(number ^ salt, 31), 37))
    return np.concatenate(keys).view(np.int64)
