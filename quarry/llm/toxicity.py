"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon of abusive words and word beginnings is learned from labelled rows by smoothed log-odds; the
trees see, for each half of the sample, the lexicon of the other half. A document's features are the
densities of both, how closely hits stand together and to words of address, and the rates of capitals,
punctuation and obfuscation (also after undoing common obfuscations). Trees are fitted on the whole
sample and calibrated on scores that trees of the other parts give each part (cross-fitting), alike at
every size.

The fit sees at most ``MOST`` labelled rows per class outside the held-out fold (a hash sample); scoring
covers every whole text. A lexicon holds every term that enough labelled documents share. Nulls: a null
text counts as empty, null identifiers are scored as held out or not by the crc of the empty string.
Without labels of both classes every score is 0 and no row is dropped. Repeated rows are scored each, and
a repeated identifier counts once in the fit; extra columns are ignored, or carried through whole by
``clean_rows``; empty tables give empty ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_fold, lean, materialize, slices
from ._training import Isotonic, Trees, labelled, sample, with_text

#: Labelled rows per class that the fit may see, and parts of the calibration.
MOST, PARTS = 4000, 4
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Lengths of the word beginnings that are counted, toxic documents that must hold a term (and the share of
#: them that must), and its log-odds.
STEMS, SUPPORT, SHARE, ODDS = (4, 5, 6), 4, 0.002, 2.5

#: Words of address in the languages covered.
ADDRESS = frozenset(
    "you your yours yourself u ur du dein deine dich dir ihr euch tu te toi ton ta vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Characters that stand for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = ".,;:!?\"'()[]{}<>*%&#$|-_/\\"


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    trees: Trees
    scale: Isotonic


class Features:
    """Dense features of whole texts under a lexicon."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self.seen = words, stems, {}

    def _word(self, raw: str) -> tuple[float, float, float, bool, bool]:
        """(lexicon weight, stem weight, weight after undoing obfuscation, obfuscated, address)."""
        w = raw.lower().strip(_EDGE)
        own = self.words.get(w, 0.0)
        stem = max((self.stems.get(w[:n], 0.0) for n in STEMS if len(w) >= n), default=0.0)
        odd = any(c.isalpha() for c in w) and not w.isalpha()
        undone = 0.0
        if odd and not own:
            undone = self.words.get("".join(c for c in w.translate(LEET) if c.isalpha()), 0.0)
        return own, stem, undone, odd, w in ADDRESS

    def one(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = text.split()
        n = max(1, len(tokens))
        if len(self.seen) > 100_000:
            self.seen = {}
        seen = self.seen
        hits = distinct = weight = stems = stem_weight = undone = odd = address = best = single = caps = 0.0
        marked, spoken = set(), set()
        for w, k in Counter(tokens).items():
            info = seen.get(w)
            if info is None:
                info = seen[w] = self._word(w)
            own, stem, un, o, a = info
            if own:
                hits += k
                distinct += 1
                weight += k * own
                best = max(best, own)
                marked.add(w)
            if stem:
                stems += k
                stem_weight += k * stem
                marked.add(w)
            if un:
                undone += k
                marked.add(w)
            odd += k * o
            if a:
                address += k
                spoken.add(w)
            if len(w) == 1:
                single += k
            elif w.isupper():
                caps += k
        near = dense = 0.0
        if marked:
            at = np.array([i for i, w in enumerate(tokens) if w in marked])
            dense = float((np.searchsorted(at, at + 50) - np.arange(len(at))).max())
            if spoken:
                said = np.array([i for i, w in enumerate(tokens) if w in spoken])
                near = float((np.searchsorted(said, at + 6) > np.searchsorted(said, at - 5)).sum())
        raw = text.encode("utf-8", "replace")
        size = max(1, len(raw))
        by = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
        return [
            hits / n, np.log1p(hits), weight / n, distinct, best,
            stems / n, np.log1p(stems), stem_weight / n, dense,
            near / n, near, address / n,
            by[65:91].sum() / size, caps / n,
            (by[33] + by[63]) / size, (by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()) / size,
            odd / n, undone / n, undone, single / n, np.log1p(n),
        ]

    def many(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.one(t) for t in texts], float).reshape(len(texts), -1)


def lexicons(texts: DataFrame, sizes: dict[tuple[int, bool], int]) -> list[tuple[dict[str, float], dict[str, float]]]:
    """(words, stems) with their log-odds for label 1, from (_y, _half, _text): learned from the rows
    with _half, from those without, and from all. ``sizes`` counts the rows by (_y, _half)."""
    edge = re.escape(_EDGE)
    words = F.array_distinct(F.transform(F.split(F.lower("_text"), r"\s+"), lambda w: F.regexp_replace(w, rf"^[{edge}]+|[{edge}]+$", "")))

    def begins(n: int) -> Column:
        return F.transform(F.filter("_w", lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))

    tagged = lambda kind, c: F.transform(c, lambda t: F.struct(F.lit(kind).alias("k"), t.alias("t")))
    terms = F.concat(tagged("w", F.col("_w")), tagged("s", F.array_distinct(F.flatten(F.array(*map(begins, STEMS))))))
    held = texts.select("_y", "_half", words.alias("_w")).select("_y", "_half", F.explode(terms).alias("_t"))
    count = lambda y, h: F.count_if((F.col("_y") == y) & (F.col("_half") == F.lit(h))).alias(f"n{y}{int(h)}")
    counts = held.groupBy("_t.k", "_t.t").agg(*[count(y, h) for y in (0, 1) for h in (True, False)])
    counts = materialize(counts.filter((F.col("n11") + F.col("n10") >= SUPPORT) & (F.length("t") > 1)), "terms")
    out = []
    for halves in ((True,), (False,), (True, False)):
        p, q = (sum((F.col(f"n{y}{int(h)}") for h in halves), F.lit(0)) for y in (1, 0))
        n1, n0 = (sum(sizes.get((y, h), 0) for h in halves) for y in (1, 0))
        odds = F.log((p + 0.5) / (n1 + 1.0)) - F.log((q + 0.5) / (n0 + 1.0))
        some = counts.filter(p >= max(SUPPORT, SHARE * n1)).select("k", "t", odds.alias("o")).filter(F.col("o") >= ODDS).collect()
        out.append(tuple({r.t: r.o for r in some if r.k == k} for k in "ws"))
    return out


def _featurise(by_half: dict[bool, tuple[dict[str, float], dict[str, float]]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = {h: Features(*lex) for h, lex in by_half.items()}
        for b in slices(batches):
            x = [f[h].one(t) for h, t in zip(b.column("_half").to_pylist(), b.column("_text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(x, pa.list_(pa.float64()))], names=["_id", "_y", "_x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> Model | None:
    lean(docs.sparkSession)
    rows = labelled(labels, label, HELD_OUT, FOLDS)
    sizes = {r._y: r["count"] for r in rows.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return None
    picked = sample(rows.filter("_y = 1"), most).unionByName(sample(rows.filter("_y = 0"), most))
    half = (F.pmod(F.xxhash64(F.col("_id"), F.lit(11)), F.lit(2)) == 0).alias("_half")
    texts = with_text(docs, picked, id_col, text_col).select(F.col("_id").cast("long").alias("_id"), "_y", half, F.coalesce("_text", F.lit("")).alias("_text"))
    parts = {(r._y, r._half): r["count"] for r in texts.groupBy("_y", "_half").count().collect()}
    one, two, whole = lexicons(texts, parts)
    got = texts.mapInArrow(_featurise({True: two, False: one}), "_id long, _y int, _x array<double>")
    p = got.withColumn("_part", F.pmod(F.xxhash64(F.col("_id"), F.lit(12)), F.lit(PARTS))).toPandas().sort_values("_id", kind="stable")
    if p._y.nunique() < 2:
        return None
    x, y, part = np.array(p._x.tolist()), p._y.to_numpy(float), p._part.to_numpy()
    seen = p._y.value_counts()
    w = np.array([sizes[int(v)] / seen[int(v)] for v in y])
    w *= len(w) / w.sum()
    raw = np.zeros(len(p))
    for k in range(PARTS):
        held = part == k
        if held.any() and not held.all():
            raw[held] = Trees().fit(x[~held], y[~held], w[~held]).predict(x[held])
    return Model(*whole, Trees().fit(x, y, w), Isotonic().fit(raw, y, w))


def _score(model: Model | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(model.words, model.stems) if model else None
        for b in slices(batches):
            s = model.scale.predict(model.trees.predict(f.many(b.column("_text").to_pylist()))) if model and b.num_rows else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "held_out")), pa.array(s, pa.float64())], names=["_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, held_out, score, predicted."""
    lean(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), (crc_fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(_score(model), "_id long, held_out boolean, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    return score(docs, fit(docs, labels, **kw))


def clean_rows(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, as they are: all columns, null and repeated
    identifiers, null and empty texts (which score like a text without words) included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(model.words, model.stems)
        for b in slices(batches):
            text = b.column(0).flatten()[b.column(0).type.get_field_index(text_col)]
            s = model.scale.predict(model.trees.predict(f.many(text.to_pylist())))
            yield b.filter(pa.array(s < THRESHOLD))

    lean(docs.sparkSession)
    if not model:
        return docs
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("_all"))
    return rows.mapInArrow(run, rows.schema).select(*[F.col("_all").getField(c).alias(c) for c in docs.columns])
