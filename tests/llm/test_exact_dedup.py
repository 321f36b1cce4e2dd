import hashlib
import re
import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.exact_dedup import PatriciaTrie, _reduce, exact_dedup, keep_rows, normalise

SCHEMA = "doc_id long, text string, keep_id string, _key int"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        done = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, low, len(ids), i == low and not done, hashlib.sha256(t.encode()).hexdigest()))
            done = done or i == low
    return sorted(out, key=str)


def test_cases(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (7, " "), (8, "x" * 300_000), (4, "x" * 300_000), (4, "x" * 300_000), (None, "n"), (6, "n"), (10, "ab")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, exact_dedup(docs).collect()), key=str) == brute(rows)
    kept = keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 9, 10]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(docs).count() == 0 and keep_rows(docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=60), st.sampled_from([None, 400, 1500]))
def test_trie_is_a_map(keys, limit):
    assert_map(keys, limit)


def assert_map(keys, limit):
    trie, plain = PatriciaTrie(lambda a, b: a.extend(b), limit), {}
    for k in keys:
        trie.insert(k, [1])
        plain[k] = plain.get(k, 0) + 1
    got = list(trie.items())
    assert len(got) == len(plain) and {k: len(v) for k, v in got} == plain


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([b"", b"x" * 3000, b"x" * 3000 + b"y" * 4000]), st.binary(max_size=4)), max_size=60), st.sampled_from([1500, 9000, 40_000]))
def test_trie_with_long_beginnings(parts, limit):
    assert_map([a + b for a, b in parts], limit)


def test_trie_spills_below_a_long_prefix():
    start = time.perf_counter()
    head = b"licence " * 1250  # 10,000 bytes
    assert_map([head + str(k % 700).encode() for k in range(2000)], 20_000)
    assert_map([b"a" * k for k in range(1500)], 20_000)  # every key begins the next
    assert time.perf_counter() - start < 20


def test_trie_takes_many_equal_texts():
    start = time.perf_counter()
    reduce = _reduce(12 << 20, pa.schema([("_id", pa.int64()), ("_text", pa.string())]))
    n = 300_000
    rows = pa.StructArray.from_arrays([pa.array(range(n), pa.int64()), pa.array(["same"] * n)], names=["_id", "_text"])
    (out,) = reduce([pa.RecordBatch.from_arrays([rows], names=["_row"])])
    assert out.num_rows == 1 and len(out.column("_ids")[0]) == n
    assert time.perf_counter() - start < 10


def test_texts_of_many_partitions(spark):
    rows = [(k, "hot text" if k % 3 else f"text {k % 50}") for k in range(3000)] + [(None, "hot  text"), (2, None), (2, None)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(40)
    assert sorted(map(tuple, exact_dedup(docs, hot=4).collect()), key=str) == brute(rows)
    assert sorted(map(tuple, exact_dedup(docs, hot=10_000).collect()), key=str) == brute(rows)
    kept = sorted((r.doc_id, r.text) for r in keep_rows(docs).collect())
    assert [i for i, _ in kept] == sorted(i for i, _, _, k, _ in brute(rows) if k)


@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1cab ", max_size=12))
def test_normalise(t):
    assert normalise(t).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", t)
