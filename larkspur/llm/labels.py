"""Components of links inside one task."""

from __future__ import annotations

import numpy as np


class Labels:
    """The least index that each index is linked to so far."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.of[a], self.of[b]
        odd = a != b
        if not odd.any():
            return
        pairs = np.unique(np.stack([np.minimum(a[odd], b[odd]), np.maximum(a[odd], b[odd])], 1), axis=0)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        old = np.array(sorted(parent))
        new = np.array([root(x) for x in old.tolist()])
        table = np.arange(len(self.of))
        table[old] = new
        self.of = table[self.of]
