import numpy as np
import pytest

from quarry.llm.mixing import meet, mix

SCHEMA = "doc_id long, text string, source string, size string, _mass int"


def water(sizes, weights=(5, 2, 1), cap=3.0):
    """Targets by resharing the excess source by source."""
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(keys)}
    out, open_, left = {}, set(keys), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("case", ["even", "skewed", "tiny"])
def test_targets_and_totals(spark, case):
    rng = np.random.default_rng(3)
    names = ["b", "a", None, "é", "Z", ""]
    n = {"even": [60] * 6, "skewed": [5, 2, 900, 1, 3, 40], "tiny": [1, 0, 1, 0, 0, 2]}[case]
    rows, k = [], 0
    for s, m in zip(names, n, strict=True):
        for _ in range(m):
            words = int(rng.integers(0, 30))
            rows.append((k, "  w\t" * words if words else None, s, "x", 1))
            k += 1
    got = mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert sorted(got.doc_id) == list(range(k))
    sizes, source = {}, {r[0]: r[2] for r in rows}
    for r in got.itertuples():
        assert r.size == len((rows[r.doc_id][1] or "").split())
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
    want = water(sizes)
    for r in got.itertuples():
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
    for s, t in want.items():
        took = sum(r.taken for r in got.itertuples() if source[r.doc_id] == s)
        assert abs(took - t) <= max(r.size for r in got.itertuples() if source[r.doc_id] == s)


def test_empty_nulls_and_reruns(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b", None, "", 0), (1, None, None, "", 0), (2, "", "x", "", 0), (3, "q" * 100_000, "x", "", 0), (4, "a b c", "y", "", 0), (4, "a b c", "y", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, mix(docs).collect()), key=str)
    assert len(one) == 6 and one == sorted(map(tuple, mix(docs.repartition(3)).collect()), key=str)


def test_meeting_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s, t = rng.integers(1, 50, 2).astype(float)
        x, y = rng.uniform(0.01, 0.99, 2) * (s, t)
        a, b, done = meet(s, x, t, y, rng.random())
        assert abs(a + b - x - y) < 1e-9 and done and 0 <= a <= s and 0 <= b <= t
    took = [meet(3.0, 1.0, 5.0, 2.0, u)[0] for u in np.linspace(0, 1, 20001)[:-1]]
    assert abs(np.mean(took) - 1.0) < 1e-3
