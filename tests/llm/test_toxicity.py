import zlib

import numpy as np

from quarry.llm._training import Isotonic, Trees
from quarry.llm.toxicity import clean_rows, fit, score, toxicity

DOCS = "doc_id long, text string, lang string, score string, _id int"
BAD = "zorgon blatfink krumpel snivod".split()


def corpus(n=500, seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"{a}{b}" for a in "ba de ki lo mu na".split() for b in "ra so tu ve wi xo".split()]
    docs, labels = [], []
    for k in range(n):
        words = list(rng.choice(vocab, int(rng.integers(8, 80))))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for at in rng.integers(0, len(words), 3):
                words[at] = f"you {rng.choice(BAD)}"
        docs.append((k, " ".join(words) + "."))
        labels.append((k, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(*r, "en", "clash", 1) for r in docs], DOCS)
    got = toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_cases(spark):
    docs, labels = corpus(300, 1)
    more = [(1000, None), (1001, ""), (1002, "zorgon " * 30_000), (1003, "ba ra"), (1003, "ba ra"), (None, "zorgon you zorgon")]
    d = spark.createDataFrame([(*r, "en", "clash", 1) for r in docs + more], DOCS)
    odd = [*labels, (1, None), (None, 1), (5, labels[5][1])]
    model = fit(d, spark.createDataFrame(odd, "doc_id long, toxic int"))
    got = score(d, model).collect()
    assert len(got) == 306
    by = {r.doc_id: r for r in got}
    assert by[1000].predicted == by[1001].predicted == by[1003].predicted == 0 and by[1002].predicted == 1
    kept = clean_rows(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit(d, none) is None and {r.score for r in toxicity(d, none).collect()} == {0.0}
    assert score(d.limit(0), model).count() == 0


def test_one_path_at_every_size(spark):
    """Few labels of a class are cross-fitted like many."""
    for n in (100, 4000):
        docs, labels = corpus(n, n)
        d = spark.createDataFrame([(*r, "en", "clash", 1) for r in docs + docs[:1] * 50], DOCS)
        got = {r.doc_id: r.predicted for r in toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
        assert np.mean([got[i] == y for i, y in labels]) > 0.93, n


def test_learners():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = Trees(rounds=60).fit(x[:1500], y[:1500], np.ones(1500)).predict(x[1500:])
    assert np.mean((p > 0) == y[1500:]) > 0.95
    s = rng.random(4000)
    iso = Isotonic().fit(s, (rng.random(4000) < s**2).astype(float), np.ones(4000))
    at = np.linspace(0.05, 0.95, 10)
    got = iso.predict(at)
    assert (np.diff(got) >= 0).all() and np.abs(got - at**2).mean() < 0.06
    assert Isotonic().fit(np.ones(5), np.array([0, 1, 0, 1, 1.0]), np.ones(5)).predict(np.array([1.0]))[0] == 0.6
