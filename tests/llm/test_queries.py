"""The registered queries against their oracle SQL, or their contract where SQL cannot say the result."""

import os
import zlib

import duckdb
import pytest

from quarry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_html_text": ["page_id", "url", "text", "n_chars"],
    "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    if name == "op10_chat_format":
        assert [r for r in want if r[0] == -7][0][1] == 2


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contracts(spark, db, name):
    got = QUERIES[name](spark, SF)
    assert set(COLUMNS[name]) <= set(got.columns)
    rows = got.collect()
    table = "pages" if name == "op7_html_text" else "documents"
    ids = [r[0] for r in db.sql(f"SELECT {COLUMNS[name][0]} FROM {table}").fetchall()]
    if name == "op5_packing":
        assert {r.doc_id for r in rows} == set(ids)
    else:
        assert sorted(r[COLUMNS[name][0]] for r in rows) == sorted(ids)
    folds = {"op1_quality": (5, 0), "op6_toxicity": (5, 0), "op9_language_id": (4, 2)}.get(name)
    if folds:
        assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds[0] == folds[1]) for r in rows)


def test_mixing_against_a_plain_count(db, spark):
    """Sizes and targets as the contract words them."""
    import re

    docs = db.sql("SELECT doc_id, text, source FROM documents").fetchall()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    of: dict = {}
    for i, _, s in docs:
        of[s] = of.get(s, 0) + size[i]
    order = sorted(of, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(of.values()) - sum(3 * of[s] for s in full)
        rest = [s for s in order if s not in full]
        target = {s: 3.0 * of[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in order}
        over = {s for s in rest if target[s] > 3 * of[s]}
        if not over:
            break
        full |= over
    took: dict = {}
    source = {i: s for i, _, s in docs}
    for r in QUERIES["op4_mixing"](spark, SF).collect():
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == of[s] and abs(r.target - target[s]) < 1e-6 and r.taken <= 3 * r.size
        took[s] = took.get(s, 0) + r.taken
    longest = max(size.values())
    assert all(abs(took[s] - target[s]) <= longest for s in order)
