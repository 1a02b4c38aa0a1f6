"""Models fitted in numpy on a bounded sample: boosted trees, isotonic steps, additive lookup tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of at most ``bins`` bins with about equal numbers of rows; a value on an edge goes up."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(column) else np.zeros(0)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


@dataclass
class BoostedTrees:
    """Logistic gradient-boosted trees of fixed depth over binned features; Newton leaf values."""

    edges: list[np.ndarray]
    prior: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin limit, leaf values

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0):
        edges = [bin_edges(x[:, j], bins) for j in range(x.shape[1])]
        q = binned(x, edges)
        p = (y.sum() + 0.5) / (len(y) + 1)
        model = cls(edges, float(np.log(p / (1 - p))))
        margin = np.full(len(y), model.prior)
        for _ in range(trees if 0 < y.sum() < len(y) else 0):
            p = sigmoid(margin)
            g, h = y - p, p * (1 - p)
            feature, limit = np.zeros(2**depth - 1, int), np.full(2**depth - 1, bins + 1)
            node = np.zeros(len(y), int)
            for level in range(depth):
                first, nodes = 2**level - 1, 2**level
                best = np.full(nodes, 1e-6)
                for j in range(x.shape[1]):
                    n_bins = len(edges[j]) + 1
                    if n_bins == 1:
                        continue
                    cell = node * n_bins + q[:, j]
                    left_g = np.bincount(cell, g, nodes * n_bins).reshape(nodes, n_bins).cumsum(1)
                    left_h = np.bincount(cell, h, nodes * n_bins).reshape(nodes, n_bins).cumsum(1)
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                    gain[(left_h < 0.5) | (all_h - left_h < 0.5)] = 0
                    at = gain.argmax(1)
                    value = gain[np.arange(nodes), at]
                    better = value > best
                    best[better], feature[first:][:nodes][better], limit[first:][:nodes][better] = value[better], j, at[better]
                index = first + node
                node = 2 * node + (q[np.arange(len(y)), feature[index]] > limit[index])
            sum_g, sum_h = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            leaves = rate * sum_g / (sum_h + ridge)
            margin += leaves[node]
            model.trees.append((feature, limit, leaves))
        return model

    def margin(self, x: np.ndarray) -> np.ndarray:
        q = binned(x, self.edges)
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, limit, leaves in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(int(np.log2(len(leaves)))):
                node = 2 * node + 1 + (q[rows, feature[node]] > limit[node])
            out += leaves[node - len(feature)]
        return out


@dataclass
class Isotonic:
    """Non-decreasing steps from score to share of ones (pool adjacent violators), linear between them."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, score: np.ndarray, y: np.ndarray):
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of scores, ones, rows
        for s, v in zip(score[order], y[order].astype(float)):
            blocks.append([s, v, 1.0])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                s2, v2, n2 = blocks.pop()
                blocks[-1][0] += s2
                blocks[-1][1] += v2
                blocks[-1][2] += n2
        b = np.array(blocks).reshape(-1, 3)
        # one pseudo-row of the overall share keeps the ends off 0 and 1
        share = y.mean() if len(y) else 0.0
        return cls(b[:, 0] / b[:, 2], (b[:, 1] + share) / (b[:, 2] + 1)) if len(b) else cls(np.zeros(1), np.zeros(1))

    def apply(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, np.maximum.accumulate(self.value))


@dataclass
class AdditiveTables:
    """Additive model with pairwise interactions; every term is a lookup table over bins.

    Terms are learned by cyclic boosting: round after round, each feature in turn gets a shallow tree on the
    current residual, whose step function is added to its table. Then the pairs of features whose cells explain
    most of what is left get tables on a coarser grid, boosted in the same cyclic way.
    """

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    prior: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.12, bins: int = 64, grid: int = 8, n_pairs: int = 8, leaves: int = 3, ridge: float = 2.0):
        d = x.shape[1]
        edges, coarse = [bin_edges(x[:, j], bins) for j in range(d)], [bin_edges(x[:, j], grid) for j in range(d)]
        q, c = binned(x, edges), binned(x, coarse)
        p = (y.sum() + 0.5) / (len(y) + 1)
        prior = float(np.log(p / (1 - p)))
        margin, single = np.full(len(y), prior), [np.zeros(len(e) + 1) for e in edges]
        pairs: list[tuple[int, int, np.ndarray]] = []
        if not 0 < y.sum() < len(y):
            return cls(edges, coarse, prior, single, pairs)

        def steps(g: np.ndarray, h: np.ndarray) -> np.ndarray:
            """A tree of ``leaves`` leaves over ordered bins, grown best split first."""
            parts = [(0, len(g))]
            while len(parts) < leaves:
                best, cut_at = 1e-9, None
                for k, (a, b) in enumerate(parts):
                    if b - a < 2:
                        continue
                    lg, lh = g[a:b].cumsum(), h[a:b].cumsum()
                    gain = lg**2 / (lh + ridge) + (lg[-1] - lg) ** 2 / (lh[-1] - lh + ridge) - lg[-1] ** 2 / (lh[-1] + ridge)
                    at = int(gain[:-1].argmax())
                    if gain[at] > best:
                        best, cut_at = gain[at], (k, a + at + 1)
                if cut_at is None:
                    break
                k, at = cut_at
                a, b = parts[k]
                parts[k : k + 1] = [(a, at), (at, b)]
            out = np.zeros(len(g))
            for a, b in parts:
                out[a:b] = rate * g[a:b].sum() / (h[a:b].sum() + ridge)
            return out

        for _ in range(rounds):
            for j in range(d):
                if len(edges[j]):
                    p = sigmoid(margin)
                    n = len(edges[j]) + 1
                    add = steps(np.bincount(q[:, j], y - p, n), np.bincount(q[:, j], p * (1 - p), n))
                    single[j] += add
                    margin += add[q[:, j]]
        p = sigmoid(margin)
        g, h = y - p, p * (1 - p)
        gains = []
        for i in range(d):
            for j in range(i + 1, d):
                n = (len(coarse[i]) + 1) * (len(coarse[j]) + 1)
                cell = c[:, i] * (len(coarse[j]) + 1) + c[:, j]
                gains.append((float((np.bincount(cell, g, n) ** 2 / (np.bincount(cell, h, n) + ridge)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
            pairs.append((i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
        for _ in range(rounds // 3):
            for i, j, grid_table in pairs:
                p = sigmoid(margin)
                cell = c[:, i] * grid_table.shape[1] + c[:, j]
                g2 = np.bincount(cell, y - p, grid_table.size).reshape(grid_table.shape)
                h2 = np.bincount(cell, p * (1 - p), grid_table.size).reshape(grid_table.shape)
                # a tree of depth two: one cut of each axis, four cells
                gi, hi = g2.sum(1), h2.sum(1)
                best, cuts = -1.0, (0, 0)
                for a in range(1, grid_table.shape[0]):
                    top_g, top_h = g2[:a].sum(0).cumsum(), h2[:a].sum(0).cumsum()
                    low_g, low_h = g2[a:].sum(0).cumsum(), h2[a:].sum(0).cumsum()
                    value = top_g**2 / (top_h + ridge) + (top_g[-1] - top_g) ** 2 / (top_h[-1] - top_h + ridge)
                    value = value + low_g**2 / (low_h + ridge) + (low_g[-1] - low_g) ** 2 / (low_h[-1] - low_h + ridge)
                    at = int(value.argmax())
                    if value[at] > best:
                        best, cuts = float(value[at]), (a, at + 1)
                if best < 0 or len(gi) < 2:
                    continue
                add = np.zeros_like(grid_table)
                for rows in (slice(0, cuts[0]), slice(cuts[0], None)):
                    for cols in (slice(0, cuts[1]), slice(cuts[1], None)):
                        add[rows, cols] = rate * g2[rows, cols].sum() / (h2[rows, cols].sum() + ridge)
                grid_table += add
                margin += add[c[:, i], c[:, j]]
        return cls(edges, coarse, prior, single, pairs)

    def margin(self, x: np.ndarray) -> np.ndarray:
        q, c = binned(x, self.edges), binned(x, self.coarse)
        out = np.full(len(x), self.prior)
        for j, values in enumerate(self.single):
            out += values[q[:, j]]
        for i, j, values in self.pairs:
            out += values[c[:, i], c[:, j]]
        return out
