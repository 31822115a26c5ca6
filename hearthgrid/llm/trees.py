"""Complete binary trees grown on feature histograms and flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class FlatTrees:
    """``feature`` and ``threshold`` by tree and inner node, ``leaf`` by tree and leaf; children of i are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> FlatTrees:
        """Trees that send every row to the first leaf."""
        inner = 2**depth - 1
        return cls(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))

    def totals(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of ``x`` reaches; all rows go down all trees at once."""
        trees, inner = self.feature.shape
        if not trees:
            return np.zeros(len(x))
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), np.int64)
        while inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            inner //= 2
        return self.leaf[tree, node - self.feature.shape[1]].sum(axis=1)


class Histograms:
    """Rows of features as histogram cells, to grow trees on."""

    def __init__(self, x: np.ndarray, bins: int = BINS) -> None:
        self.x, self.bins = x, bins
        self.width = x.shape[1]
        cuts = np.linspace(0, 1, bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], cuts)) for j in range(self.width)]
        binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])
        self.cells = binned + np.arange(self.width) * bins

    def grow(
        self, trees: FlatTrees, t: int, grad: np.ndarray, hess: np.ndarray, l2: float, least: float,
        columns: np.ndarray | None = None,
    ) -> np.ndarray:
        """Grow tree ``t`` by the second-order gain; returns each row's leaf.

        A side of a split needs a sum of ``hess`` of ``least``. ``columns`` limits each inner node to some features.
        """
        rows, width, bins = len(self.x), self.width, self.bins
        inner = trees.feature.shape[1]
        node, first = np.zeros(rows, np.int64), 0
        while first < inner:
            nodes = first + 1
            at = ((node - first)[:, None] * (width * bins) + self.cells).ravel()
            g, h = (
                np.bincount(at, np.repeat(w, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2)
                for w in (grad, hess)
            )
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
            gain[(h < least) | (h_all - h < least)] = 0
            if columns is not None:
                gain[~columns[first : first + nodes]] = 0
            for i, b in enumerate(gain.reshape(nodes, -1).argmax(axis=1)):
                j, cut = divmod(int(b), bins)
                # a node without a gain sends all rows to the left
                if gain[i, j, cut] > 1e-9 and cut < len(self.edges[j]):
                    trees.feature[t, first + i], trees.threshold[t, first + i] = j, self.edges[j][cut]
            node = 2 * node + 1 + (self.x[np.arange(rows), trees.feature[t, node]] > trees.threshold[t, node])
            first = 2 * first + 1
        return node - inner
