import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import minhash
from quarry.llm._common import RANKED, components, rank_of, ranked
from quarry.llm.minhash import Minima, Shingler, near_duplicates

SCHEMA = "doc_id long, text string, n_shingles string, _cls int"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, share, of):
    sets = [shingles(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and of * both >= share * (len(sets[i]) + len(sets[j]) - both):
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(rng, n=120):
    vocab = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(n // 8):
        base = list(rng.choice(vocab, int(rng.integers(20, 120))))
        for _ in range(8):
            own = base.copy()
            for _ in range(int(rng.integers(0, 6))):
                own[rng.integers(len(own))] = f"x{rng.integers(1000)}"
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("k", "share", "of", "rounds"), [(3, 85, 100, 3), (5, 80, 100, 3), (3, 85, 100, 1), (3, 85, 100, 0)])
def test_against_all_pairs(spark, monkeypatch, k, share, of, rounds):
    monkeypatch.setattr(minhash, "ROUNDS", max(1, rounds))
    monkeypatch.setattr(minhash, "BLOCK", 512 if rounds else 3)
    monkeypatch.setattr(minhash, "HOT", 2000 if rounds > 1 else 3)
    rng = np.random.default_rng(k + rounds)
    rows = [(int(i), t) for i, t in zip(rng.permutation(1000), corpus(rng), strict=False)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, near_duplicates(docs, k=k, share=share, of=of).collect()), key=str) == brute(rows, k, share, of)


def test_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (6, "a"), (7, "É a b"), (8, "é a b"), (9, "a b c"), (9, "a b c"),
        (None, "q r s t"), (10, "q r s t"), (11, "z " * 50_000), (12, "z z z"), (13, "a b c"),
    ]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == brute(rows, 3, 85, 100)
    assert near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAb \n\x1cé", max_size=14), max_size=6))
def test_shingles_are_exact(texts):
    got = [list(s) for s in Shingler(3).batches(texts, 8)]
    sets = [shingles(t, 3) for t in texts]
    assert [len(g) for g in got] == [len(s) for s in sets]
    for g, s in zip(got, sets, strict=True):
        for h, t in zip(got, sets, strict=True):
            assert len(set(g) & set(h)) == len(s & t)


def test_estimate_is_near(spark):
    rng = np.random.default_rng(5)
    minima, rows = Minima(minhash.BANDS * minhash.ROWS), []
    for share in (0.3, 0.6, 0.85, 1.0):
        a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        b = np.concatenate([a[: int(2000 * share)], rng.integers(0, 1 << 63, 2000 - int(2000 * share), dtype=np.uint64)])
        rows.append((share / (2 - share), minhash.packed(minima.of(np.unique(a))).tolist(), minhash.packed(minima.of(np.unique(b))).tolist()))
    got = spark.createDataFrame(rows, "j double, x array<long>, y array<long>").select("j", minhash.estimate(minhash.F.col("x"), minhash.F.col("y")).alias("e"))
    assert all(abs(r.j - r.e) < 0.13 for r in got.collect())


def test_ranked_keys(spark):
    ranks = [None, -(1 << 63), -1, 0, 7, (1 << 63) - 1]
    rows = spark.createDataFrame([(r, bytes([k]) * 16) for k, r in enumerate(ranks)], "r long, c binary")
    got = rows.select("r", ranked("r", "c").alias("k")).select("r", "k", rank_of(F.col("k")).alias("back")).collect()
    assert all(r.r == r.back and len(r.k) == RANKED for r in got)
    by = [r.r for r in sorted(got, key=lambda r: bytes(r.k))]
    assert by == [*ranks[1:], None]


@pytest.mark.parametrize("chunk", [1_000_000, 40])
def test_components_of_a_long_chain(spark, chunk):
    rng = np.random.default_rng(0)
    at = rng.permutation(300).tolist()
    edges = [(at[k], at[k + 1]) for k in range(299) if k != 150] + [(7000, 7000), (8001, 8000), (8000, 8001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), chunk=chunk).collect()}
    assert {got[x] for x in at[:151]} == {min(at[:151])} and {got[x] for x in at[151:]} == {min(at[151:])}
    assert got[8000] == got[8001] == 8000 and 7000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
