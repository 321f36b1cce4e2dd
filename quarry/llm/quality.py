"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows of quality 1; the unlabelled set is web text whose labels are not
looked at. The class prior is estimated from how first classifiers, positives against unlabelled, rank
rows that they were not trained on (cross-fitting over parts of the identifiers, so that a row which is in
both sets is held back from both): the least ratio of the two tail shares, with a margin for its error. A
small network over dense text statistics then minimises prior * R+(positives) + max(0, R-(unlabelled) -
prior * R-(positives)); where the second term turns negative, a step of ``BACK`` of its reversed gradient
is taken instead. The same is done at every size of the tables.

The fit sees at most ``MOST`` positives and ``MOST_UNLABELLED`` unlabelled rows, outside the held-out fold
(hash samples); scoring covers every whole text. Nulls: a null text counts as empty, null identifiers are
allowed. Without positives (an empty table of labels among them) every score is 0.5. Repeated rows are
scored each, and a repeated identifier counts once in the fit; extra columns are ignored; an empty table
of documents gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_fold, lean, slices
from ._training import Adam, labelled, sample, with_text

#: Positives and unlabelled rows that the fit may see.
MOST, MOST_UNLABELLED = 6000, 6000
HIDDEN, STEPS, BATCH, RATE = 16, 400, 512, 0.01
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Parts of the cross-fitted prior, and the size of a step back.
PARTS, BACK = 5, 0.1


def features(text: str | None) -> list[float]:
    """Statistics of a whole text that do not depend on its language."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    tokens = text.split()
    n = max(1, len(tokens))
    count = Counter(tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    upper, lower, digits, high = by[65:91].sum(), by[97:123].sum(), by[48:58].sum(), by[128:].sum()
    marks = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    common = count.most_common(1)[0][1] if count else 0
    return [
        np.log1p(len(text)), np.log1p(n), upper / size, lower / size, digits / size, high / size, marks / size,
        (by[46] + by[44]) / size, (by[33] + by[63]) / size, by[124] / size, (by[35:39].sum() + by[42]) / size,
        (by[60] + by[62] + by[123] + by[125] + by[61]) / size, by[10] / size,
        sum(map(eq, tokens, tokens[1:])) / n, len(count) / n, len(count) / n**0.7, common / n,
        sum(map(len, count)) / max(1, len(count)), sum(len(w) * k for w, k in count.items()) / n,
        1 - len(set(lines)) / m, np.log1p(size / m), sum(x.rstrip()[-1:] in ".!?" for x in lines) / m,
        sum(k for w, k in count.items() if len(w) <= 3) / n,
    ]


def _many(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), -1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


@dataclass
class Net:
    """One hidden layer over standardised features; ``out`` is the log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]

    @classmethod
    def new(cls, x: np.ndarray, hidden: int, rng: np.random.Generator) -> Net:
        f = x.shape[1]
        w = [rng.normal(0, f**-0.5, (f, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
        return cls(x.mean(0), x.std(0) + 1e-6, w)

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return z, np.tanh(z @ self.w[0] + self.w[1])

    def out(self, x: np.ndarray) -> np.ndarray:
        return (self._hidden(x)[1] @ self.w[2] + self.w[3])[:, 0]

    def grads(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients of sum(slope * out)."""
        z, h = self._hidden(x)
        d = slope[:, None]
        dh = (d @ self.w[2].T) * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ d, d.sum(0)]


def _train(net: Net, pos: np.ndarray, unl: np.ndarray, prior: float | None, rng: np.random.Generator, steps: int = STEPS) -> Net:
    """Logistic loss. prior None: plain positives against unlabelled; else the non-negative risk."""
    adam = Adam(net.w, RATE)
    for _ in range(steps):
        p, u = pos[rng.integers(0, len(pos), BATCH)], unl[rng.integers(0, len(unl), BATCH)]
        x, s = np.vstack([p, u]), None
        z = net.out(x)
        sp, su = _sigmoid(z[:BATCH]), _sigmoid(z[BATCH:])
        if prior is None:
            s = np.concatenate([sp - 1, su]) / BATCH
        else:
            negative = np.logaddexp(0, z[BATCH:]).mean() - prior * np.logaddexp(0, z[:BATCH]).mean()
            if negative >= 0:
                s = np.concatenate([prior * (sp - 1) - prior * sp, su]) / BATCH
            else:
                s = -BACK * np.concatenate([-prior * sp, su]) / BATCH
        adam.step([g + 1e-4 * w for g, w in zip(net.grads(x, s), net.w, strict=True)])
    return net


def margin(n_pos: int, n_unl: int, delta: float = 0.1) -> float:
    return float(np.sqrt(np.log(4 / delta) / 2) * (n_pos**-0.5 + n_unl**-0.5))


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled from held-back scores of both."""
    pos, unl = np.sort(pos), np.sort(unl)
    qp = 1 - np.searchsorted(pos, pos) / len(pos)
    qu = 1 - np.searchsorted(unl, pos) / len(unl)
    at = np.argmin((qu + margin(len(pos), len(unl))) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[at] / qp[at], 0.02, 0.98))


def cross_fit(pos: np.ndarray, unl: np.ndarray, part: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Scores of both sets by classifiers that saw no row of the same part."""
    both, out = np.vstack([pos, unl]), [np.zeros(len(pos)), np.zeros(len(unl))]
    for k in range(PARTS):
        p, u = part[0] != k, part[1] != k
        net = Net.new(both, HIDDEN, rng)
        if p.any() and u.any():
            net = _train(net, pos[p], unl[u], None, rng)
        for o, x, seen in zip(out, (pos, unl), (p, u), strict=True):
            o[~seen] = net.out(x[~seen])
    return out[0], out[1]


def train(pos: np.ndarray, unl: np.ndarray, part: tuple[np.ndarray, np.ndarray] | None = None, seed: int = 5) -> tuple[Net, float]:
    """The network and its prior. ``part``: the part of each row for the prior; rows in turn if not given."""
    rng = np.random.default_rng(seed)
    part = part or (np.arange(len(pos)) % PARTS, np.arange(len(unl)) % PARTS)
    prior = class_prior(*cross_fit(pos, unl, part, rng))
    return _train(Net.new(np.vstack([pos, unl]), HIDDEN, rng), pos, unl, prior, rng), prior


def _featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = _many(b.column("_text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(list(x), pa.list_(pa.float64()))], names=["_id", "_y", "_x"])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MOST, most_unlabelled: int = MOST_UNLABELLED
) -> tuple[Net, float] | None:
    """(network, estimated prior), or None without positives."""
    lean(docs.sparkSession)
    rows = labelled(labels, label, HELD_OUT, FOLDS)
    pos = sample(rows.filter("_y = 1"), most)
    ids = docs.filter(F.col(id_col).isNotNull() & (crc_fold(id_col, FOLDS) != HELD_OUT)).select(F.col(id_col).alias("_id"))
    unl = sample(ids.distinct(), most_unlabelled, seed=1).withColumn("_y", F.lit(0))
    texts = with_text(docs, pos.unionByName(unl), id_col, text_col).select(F.col("_id").cast("long").alias("_id"), "_y", "_text")
    got = texts.mapInArrow(_featurise, "_id long, _y int, _x array<double>")
    got = got.withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(PARTS))).toPandas().sort_values(["_y", "_id"], kind="stable")
    x, y, part = np.array(got._x.tolist()), got._y.to_numpy(), got._part.to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return None
    return train(x[y == 1], x[y == 0], (part[y == 1], part[y == 0]))


def _score(net: Net | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = _sigmoid(net.out(_many(b.column("_text").to_pylist()))) if net and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "held_out")), pa.array(s, pa.float64())], names=["_id", "held_out", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: ``id_col``, held_out, score, predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **kw)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), (crc_fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(_score(model[0] if model else None), "_id long, held_out boolean, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
