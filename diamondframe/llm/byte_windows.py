"""Windows of a fixed number of bytes: their hashes, and the runs that share an anchor.

The anchor of a window is the place, inside it, of the ``GRAM`` bytes with the smallest hash,
the leftmost one if there are several. It follows from the window's bytes alone, so equal
windows have equal anchors, wherever they stand. Neighbouring windows mostly share theirs:
a run of them is described by its anchor and its first and last start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GRAM = 24
#: Window starts of a text that are worked on at once.
SEGMENT = 1 << 19
_U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20_240_601))
_BYTES = [_RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03]
_INVERSES = [pow(b, -1, 2**64) for b in _BASES]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xCF1BBCDCB7A56463)
    return x ^ (x >> _U(29))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the bases and of their inverses, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 4096)
        _powers[:] = [
            np.concatenate([[_U(1)], np.cumprod(np.full(size, b, dtype=np.uint64))]) for b in _BASES + _INVERSES
        ]
    return _powers


class Hashes:
    """64-bit hashes of any stretches of some bytes, of two independent kinds."""

    def __init__(self, data: np.ndarray):
        tables = _power_tables(len(data) + 1)
        self.sums = []
        for kind in range(2):
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[kind][data] * tables[kind][: len(data)], out=sums[1:])
            self.sums.append(sums)
        self.inverse = tables[2:]

    def all(self, length: int, kind: int) -> np.ndarray:
        """Of every stretch of a length."""
        sums = self.sums[kind]
        n = len(sums) - length
        return mix((sums[length:] - sums[:n]) * self.inverse[kind][:n])

    def some(self, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        sums = self.sums[kind]
        return mix((sums[ends] - sums[starts]) * self.inverse[kind][starts])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by least values from block ends inwards."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def segments(text: bytes, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, bytes) of overlapping parts; each window starts in exactly one of them."""
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(data) - window + 1, SEGMENT):
        yield at, data[at : at + SEGMENT + window - 1]


def runs(data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(gram hash, hash of all bytes of the run, anchor, first start, last start) of every run."""
    hashes = Hashes(data)
    gram = hashes.all(GRAM, 0)
    places = np.arange(len(gram), dtype=np.uint64)
    least = _sliding_least((gram >> _U(20) << _U(20)) | places, window - GRAM + 1)
    anchors = (least & _U((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(anchors) - 1]])
    anchor = anchors[first]
    extent = ((anchor - first) << 8 | (anchor - last)).astype(np.uint64)
    whole = mix(hashes.some(first, last + window, 1) ^ mix(extent))
    return gram[anchor], whole, anchor, first, last

