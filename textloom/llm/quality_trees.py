"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for numpy traversal.

Training (on the driver) takes a bounded sample of labelled rows (``SAMPLE_ROWS``) outside the held-out fold, bins each
feature once by quantiles, and grows trees of fixed depth by gradient histograms. The model is a few small arrays that
travel with the function. Scoring reads every whole text once.

Null and empty texts have the statistics of an empty text and a score like any other. Without labels every score is 0.5.
Rows without an id teach nothing, are scored like any other, and aren't held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import stats

SAMPLE_ROWS, FOLDS, BINS, TREES, DEPTH, RATE, L2, LEAST_ROWS = 20_000, 5, 64, 60, 4, 0.15, 1.0, 10


@dataclass
class Trees:
    """Node i of a tree has children 2i + 1 and 2i + 2; a node that doesn't split sends all to the left."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])) for v in x.T]
    binned = np.stack([np.searchsorted(e, v, "left") for e, v in zip(edges, x.T)], 1)
    width = BINS
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), start)
    features, cuts, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            local = node - first
            best, which, where = np.full(many, 1e-6), np.full(many, -1), np.zeros(many, np.int64)
            for f in range(x.shape[1]):
                key = local * width + binned[:, f]
                g, h, c = (np.bincount(key, w, many * width).reshape(many, width).cumsum(1) for w in (grad, hess, None))
                tg, th, tc = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + L2) + (tg - g) ** 2 / (th - h + L2) - tg**2 / (th + L2)
                gain[(c < LEAST_ROWS) | (tc - c < LEAST_ROWS)] = -1
                gain[:, len(edges[f]) :] = -1
                at = gain.argmax(1)
                top = gain[np.arange(many), at]
                better = top > best
                best[better], which[better], where[better] = top[better], f, at[better]
            for i in np.flatnonzero(which >= 0):
                feature[first + i], cut[first + i] = which[i], edges[which[i]][where[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        g, h = (np.bincount(node - inner, w, leaves) for w in (grad, hess))
        leaf = -RATE * g / (h + L2)
        margin += leaf[node - inner]
        features.append(feature), cuts.append(cut), values.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(values), start)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ids: str = "doc_id", label: str = "quality") -> Trees:
    counts, y = stats.labelled_sample(docs, labels, text, ids, label, SAMPLE_ROWS, FOLDS)
    return train(stats.features(counts), y)


def score(docs: DataFrame, trees: Trees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and a score from 0 to 1 for each whole text."""

    def make(column: pa.Array) -> list[pa.Array]:
        return [pa.array(trees.score(stats.features(stats.count_batch(column))), pa.float64())]

    return stats.map_text(docs, text, keep or ["doc_id"], make, "score double")
