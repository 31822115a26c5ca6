"""Trees grown on counted feature cells, many at once (MDL-2, MDL-3, MDL-4, MDL-6).

Rows whose features fall into the same bins are one cell with a number of rows and of ones. Everything a tree needs of the rows are
sums over cells, so a model is grown on the cells, and the days of a walk-forward, the trees of a forest and the parameter sets
of a search are further axes of the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bins of a feature; a feature with no more different values is not rounded.
MAX_BINS = 256
#: Entries that one histogram of a level may hold.
MAX_ENTRIES = 4_000_000
#: Drawn cells of a forest that grow at once: they stay in a processor's cache.
DRAWN_AT_ONCE = 60_000
#: Numbers of rows below this and of ones share one sum.
PACKED = 1 << 26


@dataclass
class Bins:
    """Thresholds of every feature: a value belongs to the first bin whose threshold is not below it."""

    thresholds: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray, most: int = MAX_BINS) -> Bins:
        """Thresholds halfway between neighbouring values, or between quantiles of them."""
        return cls([thresholds_of(np.unique(x[:, j]), x[:, j], most) for j in range(x.shape[1])])

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(t, x[:, j], "left") for j, t in enumerate(self.thresholds)])

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(t) + 1 for t in self.thresholds])


def thresholds_of(values: np.ndarray, every: np.ndarray, most: int) -> np.ndarray:
    if len(values) > most:
        values = np.unique(np.quantile(every, np.linspace(0, 1, most), method="nearest"))
    return (values[:-1] + values[1:]) / 2


@dataclass
class Trees:
    """Trees as flat arrays; the right child follows the left one, a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray  # last bin that goes left
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    roots: np.ndarray

    def leaves(self, codes: np.ndarray, tree: int) -> np.ndarray:
        """Leaf that each row of bins reaches."""
        node = np.full(len(codes), self.roots[tree])
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = self.left[at] + (codes[inner, self.feature[at]] > self.cut[at])

    def values(self, codes: np.ndarray) -> np.ndarray:
        """Value of each tree (columns) for each row of bins."""
        return np.column_stack([self.value[self.leaves(codes, t)] for t in range(len(self.roots))])

    def upto(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """Node (tree, row) that each row of bins reaches within the first ``depth`` levels of splits."""
        node = np.repeat(self.roots[:, None], len(codes), axis=1)
        flat, row = node.ravel(), np.tile(np.arange(len(codes)), len(self.roots))
        moving = np.arange(len(flat))
        for _ in range(depth):
            moving = moving[self.feature[flat[moving]] >= 0]
            at = flat[moving]
            flat[moving] = self.left[at] + (codes[row[moving], self.feature[at]] > self.cut[at])
        return node

    def scaled(self, factor: float) -> Trees:
        """The same trees with their values times ``factor``."""
        return Trees(self.feature, self.cut, self.left, self.value * factor, self.cover, self.roots)


def joined(parts: list[Trees]) -> Trees:
    """All trees of several bundles, in order."""
    starts = np.cumsum([0, *(len(p.feature) for p in parts)])[:-1]
    cat = lambda name: np.concatenate([getattr(p, name) for p in parts])
    left = np.concatenate([np.where(p.feature >= 0, p.left + s, -1) for p, s in zip(parts, starts, strict=True)])
    roots = np.concatenate([p.roots + s for p, s in zip(parts, starts, strict=True)])
    return Trees(cat("feature"), cat("cut"), left, cat("value"), cat("cover"), roots)


def shrunk(g: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Sums of gradients less the absolute penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def weight(g: np.ndarray, h: np.ndarray, lam: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Best value of a leaf."""
    total = h + lam
    return np.where(total > 0, -shrunk(g, alpha) / np.where(total > 0, total, 1), 0.0)


def quality(g: np.ndarray, h: np.ndarray, lam: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Twice what the best value of a leaf takes off the loss."""
    total = h + lam
    left = shrunk(g, alpha) if np.any(alpha) else g
    out = np.zeros(total.shape)
    return np.divide(left * left, total, out=out, where=total > 0)


def best_splits(g, h, sizes, lam, alpha, least):
    """``gain, slot, g, h`` of the best split of each node from its histograms ``g, h`` (node, slot).

    Slots are the bins of all features in turn. A side needs a sum of ``least``, above 0, of ``h``. The first of equal splits wins.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left_g, left_h = (a.cumsum(axis=1) for a in (g, h))
    for a in (left_g, left_h):
        before = np.concatenate([np.zeros((len(a), 1)), a[:, starts[1:] - 1]], axis=1)
        a -= before[:, owner]
    ends = starts + sizes - 1
    all_g, all_h = left_g[:, ends[:1]], left_h[:, ends[:1]]
    lam, alpha = (np.broadcast_to(np.asarray(v, float), (len(g),))[:, None] for v in (lam, alpha))
    right_g, right_h = all_g - left_g, all_h - left_h
    none = (left_h < least) | (right_h < least)
    with np.errstate(divide="ignore", invalid="ignore"):  # where a side has no rows
        gain, other = (part * part / (total + lam) for part, total in (
            (shrunk(v, alpha) if np.any(alpha) else v, t) for v, t in ((left_g, left_h), (right_g, right_h))
        ))
        gain += other
    gain -= quality(all_g, all_h, lam, alpha)
    gain[none] = -np.inf
    gain[:, ends] = -np.inf
    slot = gain.argmax(axis=1)
    return gain[np.arange(len(g)), slot], slot, all_g[:, 0], all_h[:, 0]


def grow(
    codes: np.ndarray, sizes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: np.ndarray | int, lam: np.ndarray | float = 0.0,
    alpha: np.ndarray | float = 0.0, least: float = 1.0,
) -> tuple[Trees, np.ndarray]:
    """Grow one tree for each row of ``g, h`` (tree, cell) level by level; also the node that each cell reaches in each tree.

    ``depth, lam, alpha`` may differ by tree. Cells without weight are sent down as well. Histograms are made of nodes that may be parted:
    the sums of the others need one feature only.
    """
    trees, cells = g.shape
    depth, lam, alpha = (np.broadcast_to(v, (trees,)) for v in (np.asarray(depth), np.asarray(lam, float), np.asarray(alpha, float)))
    slots = int(sizes.sum())
    widest = min(2 ** int(depth.max()), cells) if trees else 1
    at_once = max(1, MAX_ENTRIES // max(widest * slots, cells * len(sizes)))
    if trees > at_once:
        parts, reached, nodes = [], [], 0
        for a in range(0, trees, at_once):
            part = slice(a, a + at_once)
            tree, node = grow(codes, sizes, g[part], h[part], depth[part], lam[part], alpha[part], least)
            parts.append(tree)
            reached.append(node + nodes)
            nodes += len(tree.feature)
        return joined(parts), np.concatenate(reached)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place, width = codes + starts, int(sizes[0])
    flat = np.ascontiguousarray(codes).ravel()
    # places in (tree, cell) and nodes of what may still move, and of those with weight
    moving, live = np.arange(trees * cells), np.flatnonzero(h.ravel() > 0)
    cell, at, live_cell, live_at = moving % cells, moving // cells, live % cells, live // cells
    weights = [w.ravel()[live] for w in (g, h)]
    node = np.repeat(np.arange(trees)[:, None], cells, axis=1)
    of_tree = np.arange(trees)
    feature, cut, left = ([np.full(trees, -1)] for _ in range(3))
    value, cover = [], []
    first, count, level = 0, trees, 0
    while count:
        slot = live_at * width + place[live_cell, 0]
        all_g, all_h = (np.bincount(slot, w, count * width).reshape(count, width).cumsum(axis=1)[:, -1] for w in weights)
        value.append(weight(all_g, all_h, lam[of_tree], alpha[of_tree]))
        cover.append(all_h)
        # two sides need more than this
        is_open = (depth[of_tree] > level) & (all_h > 2 * least * (1 - 1e-9))
        own = np.flatnonzero(is_open)
        if not len(own):
            break
        if len(own) < count:
            stay = is_open[live_at]
            live_cell, live_at, weights = live_cell[stay], (np.cumsum(is_open) - 1)[live_at[stay]], [w[stay] for w in weights]
        slot = (live_at[:, None] * slots + place[live_cell]).ravel()
        hist_g, hist_h = (np.bincount(slot, np.repeat(w, len(sizes)), len(own) * slots).reshape(len(own), slots) for w in weights)
        gain, best, _, _ = best_splits(hist_g, hist_h, sizes, lam[of_tree[own]], alpha[of_tree[own]], least)
        good = np.flatnonzero(gain > 1e-9)
        if not len(good):
            break
        parted, by = own[good], owner[best[good]]
        feature[-1][parted], cut[-1][parted] = by, best[good] - starts[by]
        following = first + count
        left[-1][parted] = following + 2 * np.arange(len(parted))
        child = np.full(count, -1)
        child[parted] = 2 * np.arange(len(parted))
        below = cut[-1], feature[-1]
        stay = np.flatnonzero(child[at] >= 0)
        moving, cell, at = moving[stay], cell[stay], at[stay]
        at = child[at] + (flat[cell * len(sizes) + below[1][at]] > below[0][at])
        node.ravel()[moving] = following + at
        child, below = child[own], [v[own] for v in below]
        stay = np.flatnonzero(child[live_at] >= 0)
        live_cell, live_at, weights = live_cell[stay], live_at[stay], [w[stay] for w in weights]
        live_at = child[live_at] + (flat[live_cell * len(sizes) + below[1][live_at]] > below[0][live_at])
        of_tree = np.repeat(of_tree[parted], 2)
        first, count, level = following, 2 * len(parted), level + 1
        for a in (feature, cut, left):
            a.append(np.full(count, -1))
    cat = np.concatenate
    return Trees(cat(feature), cat(cut), cat(left), cat(value), cat(cover), np.arange(trees)), node


def present(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, np.uint64]]]:
    """Bins of each cell as bits of words, and where each feature has its own: in a part of one word, or in several words."""
    words, used, places, bits = 0, 64, [], []
    for f, size in enumerate(sizes.tolist()):
        if size > 64 or used + size > 64:
            words, used = words + 1, 0
        first, count = words - 1, -(-size // 64)
        words += count - 1
        at = used + codes[:, f]
        bits.append((first + at // 64, np.uint64(1) << (at % 64).astype(np.uint64)))
        own = ((1 << size) - 1) << used if size <= 64 else (1 << 64) - 1
        places.append((slice(first, first + count), np.uint64(own & (1 << 64) - 1)))
        used = used + size if size <= 64 else 64
    out = np.zeros((len(codes), words), np.uint64)
    for word, bit in bits:
        out[np.arange(len(codes)), word] |= bit
    return out, places


def grow_drawn(
    codes: np.ndarray, sizes: np.ndarray, ones: np.ndarray, n: np.ndarray, depth: int, per_node: int, numbers: np.ndarray
) -> tuple[Trees, np.ndarray]:
    """:func:`grow` for whole numbers of rows ``n`` and of ones (tree, cell), where each node looks at a few features only.

    ``per_node`` features are drawn for a node by a hash of the tree's number and the node's path among those that can part it, so a tree does
    not depend on those that grow beside it. A feature can part a node in which two of its bins have rows. Only drawn
    features are counted, in nodes that have rows of both classes; drawn cells lie by their nodes.
    """
    trees, cells = n.shape
    width = len(sizes)
    widest = min(2**depth, cells)
    at_once = max(1, min(MAX_ENTRIES // max(widest * per_node * int(sizes.max()), cells * per_node), DRAWN_AT_ONCE // cells))
    if trees > at_once:
        parts, reached, nodes = [], [], 0
        for a in range(0, trees, at_once):
            part = slice(a, a + at_once)
            tree, node = grow_drawn(codes, sizes, ones[part], n[part], depth, per_node, numbers[part])
            parts.append(tree)
            reached.append(node + nodes)
            nodes += len(tree.feature)
        return joined(parts), np.concatenate(reached)
    bits, places = present(codes, sizes)
    flat = np.ascontiguousarray(codes).ravel()
    entry = np.flatnonzero(n.ravel())
    at, cell = entry // cells, entry % cells
    rows, positive = n.ravel()[entry].astype(float), ones.ravel()[entry].astype(float)
    packed = float(rows.sum()) < PACKED
    if packed:
        rows = rows * PACKED + positive

    def sums(place: np.ndarray, weight: np.ndarray, other: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        if not packed:
            return np.bincount(place, weight, count), np.bincount(place, other, count)
        both = np.bincount(place, weight, count)
        high = np.floor(both / PACKED)
        return high, both - high * PACKED

    node = np.empty(trees * cells, np.int64)
    of_tree, path = np.arange(trees), np.ones(trees, np.uint64)
    feature, cut, left = ([np.full(trees, -1)] for _ in range(3))
    value, cover = [], []
    first, count, level = 0, trees, 0
    while True:
        all_n, all_1 = sums(at, rows, positive, count)
        value.append(weight(-all_1, all_n, 0.0, 0.0))
        cover.append(all_n)
        node[entry] = first + at
        is_open = (all_1 > 0) & (all_1 < all_n) & (level < depth)
        stay = is_open[at]
        entry, cell, at, rows, positive = (v[stay] for v in (entry, cell, at, rows, positive))
        if not len(at):
            break
        own = np.flatnonzero(is_open)
        at = (np.cumsum(is_open) - 1)[at]
        starts = np.searchsorted(at, np.arange(len(own)))
        seen = np.bitwise_or.reduceat(bits[cell], starts, axis=0)
        can = np.column_stack([np.bitwise_count(seen[:, word] & mask).sum(axis=1) > 1 for word, mask in places])
        order = np.argsort(np.where(can, uniform(numbers[of_tree[own]], path[own], width), 2.0), axis=1)
        drawn = np.zeros_like(can)
        np.put_along_axis(drawn, order[:, :per_node], True, axis=1)
        drawn &= can
        of_pair, what = np.nonzero(drawn)
        if not len(what):
            break
        size = sizes[what]
        ends = np.cumsum(size)
        total, taken = int(ends[-1]), drawn.sum(axis=1)
        begin = ends - size
        # the pairs of each node, filled up by one whose bins are not looked at
        rank = np.arange(len(what)) - np.repeat(np.cumsum(taken) - taken, taken)
        offset, drawn_feature = np.full((per_node, len(own)), total), np.zeros((per_node, len(own)), np.int64)
        offset[rank, of_pair], drawn_feature[rank, of_pair] = begin, what
        base = cell * width
        place = np.concatenate([o[at] + flat[base + f[at]] for o, f in zip(offset, drawn_feature, strict=True)])
        left_n, left_1 = (
            v[:total].cumsum() for v in sums(place, np.tile(rows, per_node), positive if packed else np.tile(positive, per_node), total + int(sizes[0]))
        )
        pair = np.repeat(np.arange(len(what)), size)
        for v in (left_n, left_1):
            v -= np.concatenate([[0.0], v[ends[:-1] - 1]])[pair]
        whole_n, whole_1 = all_n[own], all_1[own]
        of_slot = of_pair[pair]
        right_n, right_1 = whole_n[of_slot] - left_n, whole_1[of_slot] - left_1
        none = (left_n < 1) | (right_n < 1)
        left_n[none] = right_n[none] = 1.0
        gain = left_1 * left_1 / left_n + right_1 * right_1 / right_n - (whole_1 * whole_1 / whole_n)[of_slot]
        gain[none] = -np.inf
        some = np.flatnonzero(taken)
        best = np.full(len(own), -np.inf)
        best[some] = np.maximum.reduceat(gain, begin[(np.cumsum(taken) - taken)[some]])
        slot = np.flatnonzero(gain == best[of_slot])
        holder = of_slot[slot]
        slot = slot[np.concatenate([[True], holder[1:] != holder[:-1]])]  # the first of equal splits
        good = best[some] > 1e-9
        parted, slot = some[good], slot[good]
        if not len(parted):
            break
        by, upto = what[pair[slot]], slot - begin[pair[slot]]
        following = first + count
        feature[-1][own[parted]], cut[-1][own[parted]] = by, upto
        left[-1][own[parted]] = following + 2 * np.arange(len(parted))
        where = np.full(len(own), -1)
        where[parted] = np.arange(len(parted))
        stay = where[at] >= 0
        entry, cell, at, rows, positive = (v[stay] for v in (entry, cell, where[at], rows, positive))
        upper = flat[cell * width + by[at]] > upto[at]
        low, high = np.flatnonzero(~upper), np.flatnonzero(upper)
        # cells of the left child, then those of the right one, node after node
        many = np.bincount(at[high], minlength=len(parted)).cumsum(), np.bincount(at[low], minlength=len(parted)).cumsum()
        sequence = np.empty(len(at), np.int64)
        sequence[np.arange(len(low)) + np.concatenate([[0], many[0][:-1]])[at[low]]] = low
        sequence[np.arange(len(high)) + many[1][at[high]]] = high
        at = 2 * at + upper
        entry, cell, at, rows, positive = (v[sequence] for v in (entry, cell, at, rows, positive))
        of_tree, path = np.repeat(of_tree[own[parted]], 2), np.repeat(2 * path[own[parted]], 2)
        path[1::2] += np.uint64(1)
        first, count, level = following, 2 * len(parted), level + 1
        for a in (feature, cut, left):
            a.append(np.full(count, -1))
    cat = np.concatenate
    grown = Trees(cat(feature), cat(cut), cat(left), cat(value), cat(cover), np.arange(trees))
    # cells that were not drawn are sent down as well
    rest = np.flatnonzero(n.ravel() == 0)
    reached, moving = rest // cells, np.arange(len(rest))
    while len(moving):
        moving = moving[grown.feature[reached[moving]] >= 0]
        a = reached[moving]
        reached[moving] = grown.left[a] + (flat[rest[moving] % cells * width + grown.feature[a]] > grown.cut[a])
    node[rest] = reached
    return grown, node.reshape(trees, cells)


def uniform(tree: np.ndarray, path: np.ndarray, width: int) -> np.ndarray:
    """Numbers from 0 to 1 for each node and feature, from the tree's number and the node's path."""
    x = (tree.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ path * np.uint64(0xBF58476D1CE4E5B9))[:, None]
    x = x + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def features_per_node(rule: str, width: int) -> int:
    """Number of features drawn for a node; ``auto`` is the square root."""
    return max(1, int(np.log2(width) if rule == "log2" else np.sqrt(width)))


def forest(
    codes: np.ndarray, sizes: np.ndarray, n: np.ndarray, ones: np.ndarray, max_depth: int = 10, n_estimators: int = 500,
    max_features: str = "sqrt", seed: int = 0,
) -> tuple[Trees, np.ndarray]:
    """Random forest on cells with ``n`` rows and ``ones``; values are shares of ones, one row of nodes for each tree.

    A row of a cell is drawn as often as a Poisson number of mean one, which the counts of the cell add up. A tree depends
    on its number only: the first trees of a forest are the smaller forest.
    """
    drawn = np.empty((2, n_estimators, len(n)))
    for t in range(n_estimators):
        rng = np.random.default_rng([seed, t])
        drawn[0, t], drawn[1, t] = rng.poisson(ones), rng.poisson(n - ones)
    per_node = features_per_node(max_features, codes.shape[1])
    numbers = np.arange(n_estimators) + seed * 1_000_003
    return grow_drawn(codes, sizes, drawn[0], drawn.sum(axis=0), max_depth, per_node, numbers)


def boost(
    codes: np.ndarray, sizes: np.ndarray, n: np.ndarray, ones: np.ndarray, rounds: int = 100, max_depth: np.ndarray | int = 6,
    learning_rate: np.ndarray | float = 0.1, reg_lambda: np.ndarray | float = 1.0, reg_alpha: np.ndarray | float = 0.0,
    least: float = 1.0,
) -> tuple[list[Trees], np.ndarray]:
    """Second-order boosting of the logistic loss with penalties on leaf values, of several models at once.

    ``n, ones`` (model, cell) are the training rows of each model. Returns the trees of each round, one for each model with its rate in
    the values, and the margins of all cells. A leaf needs a sum of second derivatives of ``least``; scores start at 0.5.
    """
    models = len(n)
    rate = np.broadcast_to(np.asarray(learning_rate, float), (models,))
    margin, out = np.zeros(n.shape), []
    for _ in range(rounds):
        p = logistic(margin)
        trees, node = grow(codes, sizes, n * p - ones, n * p * (1 - p), max_depth, reg_lambda, reg_alpha, least)
        of_node = np.empty(len(trees.feature))
        of_node[node.ravel()] = np.repeat(rate, n.shape[1])
        trees.value = trees.value * np.where(trees.feature < 0, of_node, 1.0)
        margin += trees.value[node]
        out.append(trees)
    return out, margin


def half_log_odds(p: np.ndarray) -> np.ndarray:
    eps = np.finfo(float).eps
    p = np.clip(p, eps, 1 - eps)
    return (np.log(p) - np.log(1 - p)) / 2


def ada_weights(n: np.ndarray, ones: np.ndarray, margin: np.ndarray, rate: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the ones and zeros of cells: a row weighs ``exp(-rate * y * margin)`` with y = +1 or -1."""
    scaled = np.clip(rate * margin, -300, 300)
    return ones * np.exp(-scaled), (n - ones) * np.exp(scaled)


def ada(
    codes: np.ndarray, sizes: np.ndarray, n: np.ndarray, ones: np.ndarray, rounds: int = 100, learning_rate: np.ndarray | float = 0.1
) -> Iterator[tuple[Trees, np.ndarray]]:
    """Real-valued AdaBoost over stumps, of several models at once: the stumps (values: half log odds) and all margins after each round."""
    margin = np.zeros(n.shape)
    rate = np.broadcast_to(np.asarray(learning_rate, float), (len(n),))[:, None]
    for _ in range(rounds):
        w1, w0 = ada_weights(n, ones, margin, rate)
        # weights add up to the number of rows
        share = n.sum(axis=1, keepdims=True) / np.maximum((w1 + w0).sum(axis=1, keepdims=True), 1e-300)
        trees, node = grow(codes, sizes, -w1 * share, (w1 + w0) * share, 1, least=1e-9)
        trees.value = half_log_odds(trees.value)
        margin += trees.value[node]
        yield trees, margin
