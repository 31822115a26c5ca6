"""Exact nearest earlier rows of one entity on real-valued features (MDL-5)."""

from __future__ import annotations

import numpy as np


class GrowingIndex:
    """Rows in blocks sorted by one column; a day's rows are added as a block, and blocks of like size are merged.

    So there are as many blocks as the logarithm of the rows, and a row is sorted again as often. The difference in the sorting column, which
    should spread widest, is a lower bound of a distance: a search compares the rows around its own place in the largest block first, and
    then only rows within the distance of the k-th best. ``compared`` counts the distances.
    """

    def __init__(self, column: int) -> None:
        self.column = column
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # features, labels, numbers
        self.rows = self.compared = 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Add rows; they are numbered in the order in which they come."""
        if not len(x):
            return
        block = (x, y, np.arange(self.rows, self.rows + len(x)))
        self.rows += len(x)
        while self.blocks and len(self.blocks[-1][0]) <= 2 * len(block[0]):
            block = tuple(np.concatenate(parts) for parts in zip(self.blocks.pop(), block, strict=True))
        order = np.argsort(block[0][:, self.column], kind="stable")
        self.blocks.append(tuple(part[order] for part in block))

    def _distances(self, block: tuple, low: int, high: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, number = (part[low:high] for part in block)
        self.compared += len(x)
        return ((x - row) ** 2).sum(axis=1), number, y

    def share(self, row: np.ndarray, k: int) -> float:
        """Share of ones among the ``k`` nearest rows, the earlier one of equals."""
        k = min(k, self.rows)
        at = row[self.column]
        x = self.blocks[0][0][:, self.column]
        place = int(np.searchsorted(x, at))
        low, high = max(0, place - k), min(len(x), place + k)
        near = self._distances(self.blocks[0], low, high, row)
        reach = np.sqrt(np.partition(near[0], k - 1)[k - 1]) if len(near[0]) >= k else np.inf
        found = [near]
        for i, block in enumerate(self.blocks):
            values = block[0][:, self.column]
            # a little wider than the bound, for rounding
            wide = reach * (1 + 1e-9) + 1e-12
            a, b = int(np.searchsorted(values, at - wide, "left")), int(np.searchsorted(values, at + wide, "right"))
            parts = [(a, b)] if i else [(a, min(b, low)), (max(a, high), b)]
            found += [self._distances(block, c, d, row) for c, d in parts if c < d]
            distance = np.concatenate([f[0] for f in found])
            if len(distance) >= k:
                reach = min(reach, float(np.sqrt(np.partition(distance, k - 1)[k - 1])))
        distance, number, label = (np.concatenate(parts) for parts in zip(*found, strict=True))
        best = np.lexsort((number, distance))[:k]
        return float(label[best].sum() / k)
