"""Statistics of one text, over all of it. Words are runs without ASCII blanks."""

from __future__ import annotations

import numpy as np
import xxhash

SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"


def _ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number per pair; equal pairs get equal numbers."""
    pairs = left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right
    return np.unique(pairs, return_inverse=True)[1]


def window_numbers(words: list, width: int = 5) -> np.ndarray:
    """A number per window of ``width`` words; equal numbers exactly for equal windows."""
    if len(words) < width:
        return np.empty(0, dtype=np.int64)
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n = len(numbers)
    if n**width < 2**63:
        out = np.zeros(len(words) - width + 1, dtype=np.int64)
        for k in range(width):
            out *= n
            out += ids[k : len(ids) - width + 1 + k]
        return out
    out = ids
    for k in range(1, width):
        out = _ranks(out[:-1], ids[k:])
    return out


def window_hashes(words: list, width: int) -> np.ndarray:
    """A 64-bit hash per window of words; the whole text is one window if it is shorter."""
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))[ids]
    width = max(1, min(width, len(words)))
    out = np.zeros(max(1, len(words) - width + 1), dtype=np.uint64)
    for k in range(width if len(words) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - width + 1 + k]
        out ^= out >> np.uint64(29)
    return out


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows that are found twice or more."""
    windows = window_numbers(words, width)
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    word_chars = len(text.translate(None, _BLANKS).decode("utf-8", "replace"))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words)
