"""Labelled samples and small numpy learners that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_fold


def labelled(labels: DataFrame, label: str, held_out_fold: int, folds: int, id_col: str = "doc_id") -> DataFrame:
    """(_id, _y) of the labelled rows outside the held-out fold; the majority of repeated labels."""
    rows = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc_fold(id_col, folds) != held_out_fold))
    return rows.groupBy(F.col(id_col).alias("_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_y"))


def sample(rows: DataFrame, most: int, seed: int = 0, id_col: str = "_id") -> DataFrame:
    """At most ``most`` rows, by a hash of the identifier, so that reruns take the same ones."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(most)


def with_text(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One text (the least) of each row of a sample, however often its identifier stands in ``docs``; the
    sample's bound makes the broadcast safe."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    return texts.groupBy(*picked.columns).agg(F.min("_text").alias("_text"))


class Trees:
    """Gradient-boosted trees for the logistic loss, on features binned by quantiles.

    Trees are grown level by level to a fixed depth and kept as arrays: split feature and bin per inner
    node, value per leaf.
    """

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, cuts)) for c in x.T]
        b, (n, f) = self._binned(x), x.shape
        share = float(np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4))
        self.base, self.trees = float(np.log(share / (1 - share))), []
        raw = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = w * (y - p), w * p * (1 - p)
            node, splits = np.zeros(n, np.int64), []
            for level in range(self.depth):
                m, size = 1 << level, self.bins + 1
                feat, cut = np.zeros(m, np.int64), np.full(m, size, np.int64)
                best = np.full(m, 1e-9)
                for k in range(f):
                    at = node * size + b[:, k]
                    gs = np.bincount(at, g, m * size).reshape(m, size).cumsum(1)
                    hs = np.bincount(at, h, m * size).reshape(m, size).cumsum(1)
                    gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                    gain = gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    gain[(hs < self.least / 4) | (hr < self.least / 4)] = 0
                    at_best = gain.argmax(1)
                    top = gain[np.arange(m), at_best]
                    better = top > best
                    feat[better], cut[better], best[better] = k, at_best[better], top[better]
                splits.append((feat, cut))
                node = node * 2 + (b[np.arange(n), feat[node]] > cut[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            raw += value[node]
            self.trees.append((splits, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        b, rows = self._binned(x), np.arange(len(x))
        raw = np.full(len(x), self.base)
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feat, cut in splits:
                node = node * 2 + (b[rows, feat[node]] > cut[node])
            raw += value[node]
        return raw


class Isotonic:
    """Monotone calibration by pooling adjacent violators; linear between the pooled blocks."""

    def fit(self, s: np.ndarray, y: np.ndarray, w: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # sum of w*y, sum of w, lowest and highest score
        for v, t, u in zip(s[order], y[order], w[order], strict=True):
            blocks.append([t * u, u, v, v])
            while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
                a = blocks.pop()
                blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
        self.x = np.array([v for b in blocks for v in b[2:]])
        self.y = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
        return self

    def predict(self, s: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(s, self.x, self.y), 0.0, 1.0)


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
