import numpy as np

from quarry.llm.quality import PARTS, class_prior, fit, quality, train

DOCS = "doc_id long, text string, lang string, score string, _id int"


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"{a}{b}" for a in "ba de ki lo mu na".split() for b in "ra so tu ve wi xo".split()]
    docs, labels = [], []
    for k in range(n):
        words = list(rng.choice(vocab, int(rng.integers(15, 80))))
        good = int(rng.random() < 0.8)
        text = " ".join(words).capitalize() + "."
        if not good:
            text = [" | ".join(words), "!! ".join(w.upper() for w in words), " ".join([words[0]] * 40)][k % 3]
        docs.append((k, text))
        labels.append((k, good))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(*r, "en", "clash", 1) for r in docs], DOCS)
    got = quality(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.95


def test_cases(spark):
    docs, labels = corpus(300, 1)
    more = [(1000, None), (1001, ""), (1002, "ba ra. " * 30_000), (1003, "x"), (1003, "x"), (None, "y")]
    d = spark.createDataFrame([(*r, "en", "clash", 1) for r in docs + more], DOCS)
    labels = [*labels, (1, None), (None, 1)]
    assert quality(d, spark.createDataFrame(labels, "doc_id long, quality int")).count() == 306
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert fit(d, none) is None and {r.score for r in quality(d, none).collect()} == {0.5}
    assert quality(d.limit(0), none).count() == 0


def test_one_path_at_every_size():
    """The estimated prior serves small samples as large ones."""
    for n in (100, 1000, 10_000):
        rng = np.random.default_rng(n)
        good = rng.random(n) < 0.85
        x = np.where(good[:, None], rng.normal(1, 1, (n, 4)), rng.normal(-3, 1, (n, 4)))
        trusted = good & (rng.random(n) < 0.35)
        ids = np.arange(n)
        net, prior = train(x[trusted], x, (ids[trusted] % PARTS, ids % PARTS))
        assert abs(prior - good.mean()) < 0.12, (n, prior)
        right = (net.out(x) > np.log(0.3 / 0.7)) == good
        assert right[good].mean() > 0.95 and right[~good].mean() > 0.9, n


def test_repeated_identifiers_count_once(spark):
    docs, labels = corpus(200, 2)
    many = spark.createDataFrame([(*r, "en", "clash", 1) for r in docs + docs[:1] * 500], DOCS)
    once = spark.createDataFrame([(*r, "en", "clash", 1) for r in docs], DOCS)
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in quality(d, y).collect()} for d in (many, once))
    assert a == b


def test_risk_and_prior():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    unl = np.vstack([pos[2000:], neg[:1000]])
    net, prior = train(pos[:2000], unl)
    assert abs(prior - 2 / 3) < 0.1
    assert np.mean(net.out(pos[2000:]) > 0) > 0.95 and np.mean(net.out(neg[1000:]) < 0) > 0.9
    s = rng.normal(size=5000)
    assert class_prior(s[:2500], s[2500:]) > 0.9
