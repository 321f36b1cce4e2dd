from math import sqrt, sumprod

import numpy as np

from quarry.llm import embedding_join
from quarry.llm.embedding_join import Joiner, _forest, near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, _cls int"


def brute(rows, least=0.95):
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.ldexp(rows[k][1], -np.frexp(np.abs(rows[k][1]).max())[1]).tolist() for k in (i, j))
                if sumprod(a, b) / sqrt(sumprod(a, a) * sumprod(b, b)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    out, comp = [], {}
    for k in range(len(rows)):
        if k in comp:
            continue
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = min((rows[i][0] for i in seen if rows[i][0] is not None), default=None)
        comp |= dict.fromkeys(seen, low)
    for k, (i, _) in enumerate(rows):
        out.append((i, len(links[k]), comp[k], i == comp[k]))
    return sorted(out, key=str)


def clusters(n, d, rng):
    mids = rng.normal(size=(6, d))
    x = np.vstack([rng.normal(size=(n, d)), *[m + rng.normal(size=(n // 6, d)) * s for m, s in zip(mids, (0.05, 0.15, 0.2, 0.22, 0.25, 0.0), strict=True)]])
    return [(int(i), list(map(float, v))) for i, v in zip(rng.permutation(len(x)), x, strict=True)]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 40)
    monkeypatch.setattr(embedding_join, "LEAF", 8)
    rows = clusters(150, 16, np.random.default_rng(0))
    docs = spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, near_vectors(docs).collect()), key=str) == brute(rows)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (None, [1.0, 0.1]), (8, None), (9, []), (10, [0.0, 0.0]), (11, [nan, 1.0]), (12, [inf, 1.0]),
        (13, [None, 1.0]), (14, [1.0, 0.0, 0.0]), (15, [1e200, 0.0]), (16, [1e-200, 0.0]), (17, [-1.0, 0.0]), (18, [0.0]), (19, [5.0]), (20, [0.95, (1 - 0.95**2) ** 0.5]),
    ]
    docs = spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, near_vectors(docs).collect()), key=str)
    assert got == brute(rows) and next(r for r in got if r[0] == 8)[1] == 0
    assert near_vectors(docs.limit(0)).count() == 0


def test_cosines_at_the_threshold(spark):
    """Pairs whose cosine is 0.95 up to the last bits."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        a, b = np.linalg.qr(rng.normal(size=(6, 2)))[0].T
        at = float(np.nextafter(0.95, 0.95 + (k % 3 - 1)))
        rows += [(2 * k, (a * 3).tolist()), (2 * k + 1, ((at * a + (1 - at * at) ** 0.5 * b) * rng.uniform(0.1, 9)).tolist())]
    docs = spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, near_vectors(docs).collect()), key=str) == brute(rows)


def test_join_and_forest():
    rng = np.random.default_rng(1)
    u = embedding_join.unit(rng.normal(size=(700, 3)))
    w = rng.integers(1, 4, 700)
    n, _, edges = Joiner(0.95).join(u, w, u, w, embedding_join.directions(u), True)
    m = u @ u.T >= 0.95
    np.fill_diagonal(m, False)
    assert (n == m @ w).all() and all(m[a, b] for a, b in edges)
    for _ in range(50):
        m = rng.random((20, 30)) < 0.05
        got = list(_forest(m))
        assert all(m[a, b] for a, b in got) and len(got) <= 50
        parent = list(range(50))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in got:
            parent[find(a)] = find(20 + b)
        assert all(find(a) == find(20 + b) for a, b in zip(*np.nonzero(m), strict=True))
