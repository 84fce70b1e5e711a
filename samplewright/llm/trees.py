"""Histogram gradient-boosted trees for a binary label: fitted in numpy on a bounded sample, applied as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees side by side: node ``i`` has the children ``2i + 1`` and ``2i + 2``; a row goes right above the cut."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray      # trees x inner nodes
    leaf: np.ndarray     # trees x leaves
    base: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the leaves each row ends in: all rows and trees advance one level a step."""
        out = np.full(len(rows), self.base)
        count, inner = self.feature.shape
        depth = int(np.log2(inner + 1))
        tree = np.arange(count)[None, :]
        for first in range(0, len(rows), 2048):
            part = rows[first:first + 2048]
            at, line = np.zeros((len(part), count), dtype=np.int64), np.arange(len(part))[:, None]
            for _ in range(depth):
                at = 2 * at + 1 + (part[line, self.feature[tree, at]] > self.cut[tree, at])
            out[first:first + 2048] += self.leaf[tree, at - inner].sum(axis=1)
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def fit(rows: np.ndarray, label: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.15,
        shrink: float = 1.0, least: float = 1.0) -> Trees:
    """Boosting on the logistic loss. Without rows or with one class only, every score is the (smoothed) share of ones."""
    n, width = rows.shape
    share = (label.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    if n == 0 or label.min() == label.max():
        return Trees(np.zeros((1, inner), np.int64), np.zeros((1, inner)), np.zeros((1, inner + 1)), base)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1)
    offset = binned + np.arange(width) * bins
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = label - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            count = 1 << level
            key = (node[:, None] * (width * bins) + offset).ravel()
            size = count * width * bins
            g = np.bincount(key, np.repeat(slope, width), size).reshape(count, width, bins).cumsum(axis=2)
            h = np.bincount(key, np.repeat(bend, width), size).reshape(count, width, bins).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + shrink) + (all_g - g) ** 2 / (all_h - h + shrink) - all_g ** 2 / (all_h + shrink)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            feature, place = best // bins, best % bins
            split = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            first = count - 1
            out.feature[t, first:first + count] = feature
            for k in np.flatnonzero(split):
                out.cut[t, first + k] = edges[feature[k]][place[k]] if place[k] < len(edges[feature[k]]) else np.inf
            right = split[node] & (binned[np.arange(n), feature[node]] > place[node])
            node = 2 * node + right
        g, h = np.bincount(node, slope, inner + 1), np.bincount(node, bend, inner + 1)
        out.leaf[t] = rate * g / (h + shrink)
        raw += out.leaf[t][node]
    return out
