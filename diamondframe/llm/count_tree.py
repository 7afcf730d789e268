"""An R-tree over count vectors, packed bottom-up, and the join of two of them.

A point is the count vector of a set: how many of its shingles fall into each group. The sum of
the smaller coordinates of two points is at least the size of the sets' intersection; the sum of
the smaller coordinates of two boxes' upper corners is at least that of any two points in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from diamondframe.llm.shingles import count_vector, least_common

NODE = 32


class CountTree:
    """Nodes of up to ``NODE`` sets that are alike in size and then in their first coordinates."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        vectors = np.array([count_vector(s) for s in sets], dtype=np.int64)
        # Slabs by size, in them by the first coordinate, in them by the second.
        order = np.argsort(sizes, kind="stable")
        slab = max(NODE, int(len(sets) ** 0.67))
        order = np.concatenate([
            part[np.lexsort((vectors[part, 1], vectors[part, 0] // 4))]
            for part in np.split(order, range(slab, len(order), slab))
        ])
        self.order, self.sizes, self.vectors = order, sizes[order], vectors[order]
        self.sets = [sets[i] for i in order]
        self.starts = np.arange(0, len(order), NODE)
        self.ends = np.minimum(self.starts + NODE, len(order))
        self.corners = np.maximum.reduceat(self.vectors, self.starts, axis=0)
        self.least = np.minimum.reduceat(self.sizes, self.starts)


def _common(left: list[np.ndarray], right: list[np.ndarray], n_ids: int) -> np.ndarray:
    """Sizes of all intersections; sets as numbers below ``n_ids``."""
    held = np.zeros((len(left), n_ids), dtype=bool)
    for row, ids in enumerate(left):
        held[row, ids] = True
    lengths = np.array([len(ids) for ids in right])
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    some = np.flatnonzero(lengths)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
        found = held[:, np.concatenate([right[i] for i in some])]
        out[:, some] = np.add.reduceat(found, starts, axis=1, dtype=np.int32)
    return out


def links(a: CountTree, b: CountTree, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (position in a's sets, position in b's sets) that link; with itself, each pair once."""
    same = a is b
    bound = np.minimum(a.corners[:, None, :], b.corners[None, :, :]).sum(axis=2)
    need = least_common(a.least[:, None], b.least[None, :], percent)
    for i in range(len(a.starts)):
        left = slice(a.starts[i], a.ends[i])
        for j in np.flatnonzero(bound[i] >= need[i]):
            if same and j < i:
                continue
            right = slice(b.starts[j], b.ends[j])
            least = np.minimum(a.vectors[left, None, :], b.vectors[None, right, :]).sum(axis=2)
            wanted = least_common(a.sizes[left, None], b.sizes[None, right], percent)
            live = least >= wanted
            if same and i == j:
                live &= np.triu(np.ones_like(live), 1)
            rows, columns = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
            if not len(rows):
                continue
            left_sets = [a.sets[left.start + r] for r in rows]
            right_sets = [b.sets[right.start + c] for c in columns]
            # Numbers for the left shingles; those of the right that are not among them are left out.
            ids = np.unique(np.concatenate(left_sets))
            numbered = []
            for s in right_sets:
                at = np.searchsorted(ids, s)
                at[at == len(ids)] = 0
                numbered.append(at[ids[at] == s])
            sizes = _common([np.searchsorted(ids, s) for s in left_sets], numbered, len(ids))
            linked = live[np.ix_(rows, columns)] & (sizes >= wanted[np.ix_(rows, columns)])
            for r, c in zip(*np.nonzero(linked)):
                yield int(a.order[left.start + rows[r]]), int(b.order[right.start + columns[c]])
