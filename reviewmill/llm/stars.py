"""Connected groups among the few rows that one task holds."""

from __future__ import annotations

import numpy as np


class Stars:
    """Union of linked numbers; ``root`` is the smallest number each can reach."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def lowest_ids(ids: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each number the smallest id of its star."""
    lowest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(lowest, root, ids)
    return lowest[root]
