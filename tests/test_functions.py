import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import hashing as H
from quarry.functions import query as Q
from quarry.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("getUserName", "get User Name"), ("HTTPServer2", "HTTP Server 2"), ("parse_v2_file", "parse v2 file"), ("a::b->c", "a b c"), ("f(x)", "f ( x )"),
        ('say "keepThis" nowThat', 'say "keepThis" now That'), ("x1y", "x 1 y"), ('open "notClosed', 'open "notClosed'), ("", ""), ("a  b\tc", "a b c"), ("src/lib.rs", "src lib rs"),
    ],
)
def test_normalize(spark, text, want):
    assert value(spark, T.normalize_query(F.lit(text))) == want


def test_words(spark):
    assert value(spark, T.tokens(F.lit("getHTTPResponse_code"))) == ["get", "http", "response", "code"]
    assert value(spark, T.ngrams(F.lit("abcd"))) == ["abc", "bcd", "abcd"] and value(spark, T.ngrams(F.lit("ab"))) == ["ab"]
    for w, s in {"testing": "test", "boxes": "box", "cats": "cat", "bing": None, "as": None, "used": None, "singing": "s"}.items():
        assert value(spark, T.stem(F.lit(w))) == (s if s and len(s) >= 3 else None), w
    assert value(spark, T.plain_query(F.lit("db testingThings or"))) == "db database testing test Things thing or"
    assert "database" in value(spark, T.expand_query(F.lit("db error"))).split()
    assert value(spark, T.expand_acronyms(F.lit("the jwt"))) == "the jwt json web token"


def test_scanners(spark):
    text = "function f() { if (a) { g (1); return h(2) } }"
    assert value(spark, T.callees(F.lit(text))) == ["f", "g", "h"]
    rel = value(spark, T.type_relations(F.lit("class A extends B implements C { x = D }")))
    assert rel.extends == ["B"] and rel.implements == ["C"] and rel.aliases == ["D"]
    assert value(spark, T.usage_line(F.lit("a\n  call(b)  \nb"), F.lit("b"))) == "call(b)"
    assert value(spark, T.usage_line(F.lit("a"), F.lit("zz"))) is None
    for path, source in {"a/x.test.ts": "a/x.ts", "a/x.spec.ts": "a/x.ts", "x_test.rs": "x.rs", "a/test/b.ts": "a/b.ts", "a/tests/b.ts": "a/b.ts", "a/__tests__/b.ts": "a/b.ts", "a/b.ts": None}.items():
        assert value(spark, T.tested_source(F.lit(path))) == source


def test_controls():
    c = Q.parse_controls('find lang:ts kind:class,enum path:"src" foo:bar x: file:*.rs pkg:core')
    assert (c.lang, c.kinds, c.path, c.file, c.package, c.text) == ("typescript", ["class", "enum"], "src", "*.rs", "core", "find foo:bar x:")


@pytest.mark.parametrize(
    ("text", "want"),
    [("who calls testIt", "callers"), ("verify it", "test"), ("migration plan", "migration"), ("the db", "schema"), ("how does it", "implementation"), ("env", "config"),
     ("catch it", "error"), ("api", "api"), ("useEffect", "hook"), ("interceptor", "middleware"), ("struct x", "definition"), ("where is foo used", "callers"), ("hello", None)],
)
def test_intent(spark, text, want):
    assert Q.intent_of(text) == want
    if text != "who calls testIt":
        assert value(spark, Q.intent(F.lit(text))) == want


def test_query_parts(spark):
    assert Q.decompose("auth and db and cache") == ["auth", "db", "cache"] and Q.decompose("a & b") == ["a", "b"] and Q.decompose("plain") == ["plain"] and Q.decompose(" ") == []
    assert Q.callers_target("Callers of fooBar") == "fooBar"
    for text, code in {"fn main": True, "getUser": True, "snake_case": True, "find the user": False, "a.b(c);": True, "": False}.items():
        assert Q.is_code(text) is code and value(spark, Q.looks_like_code(F.lit(text))) is code
    assert Q.pool_size("find things", 5) == 40 and Q.pool_size("f()", 5) == 20
    assert Q.hypothetical("x", lambda q, lang: "```ts\ncode\n```") == "code" and Q.hypothetical("x", lambda q, lang: 1 / 0) is None


@given(st.text(max_size=20), st.text(max_size=20), st.integers(0, 10**6))
def test_symbol_ids(path, name, start):
    a = H.symbol_id(path, name, start)
    assert re.fullmatch("[0-9a-f]{16}", a) and a == H.symbol_id(path, name, start)
    assert a != H.symbol_id(path, name + "x", start) and a != H.symbol_id(path, name, start + 1)


def test_known_hash():
    assert H.fnv1a(b"") == 0xCBF29CE484222325 and H.fnv1a(b"a") == 0xAF63DC4C8601EC8C


@given(st.text(max_size=60), st.integers(8, 40))
def test_embedding(text, dim):
    v = H.embed(text, dim)
    assert len(v) == dim and (abs(np.linalg.norm(v) - 1) < 1e-9 or not any(v))


def test_columns_equal_plain(spark):
    rows = [("a.ts", "f", 7, False), ("a.ts", "f", 7, True), ("é/b.rs", "gG", 123, False)]
    df = spark.createDataFrame(rows, "p string, n string, s int, e boolean")
    got = [r.i for r in df.select(H.symbol_ids(F.col("p"), F.col("n"), F.col("s"), F.col("e")).alias("i")).collect()]
    assert got == [H.symbol_id(p, n, 0 if e else s) for p, n, s, e in rows]
    v = df.select(H.hash_embedding(16)(F.col("n")).alias("v")).collect()
    assert [r.v for r in v] == [H.embed(n, 16) for _, n, _, _ in rows]


def test_hash_embedding_against_a_plain_one(spark):
    """The column function and the function of one string against words counted one by one."""
    from quarry.functions.hashing import embed, fnv1a, hash_embedding

    texts = ["alpha beta alpha", "", None, "snake_case $x café ß1 x-y", "ünï " * 50, "один два ٣ ½"]

    def plain(text, dim=64):
        v = [0.0] * dim
        for w in "".join(c if c.isalnum() or c in "_$" else " " for c in text or "").split():
            h = fnv1a(w.encode())
            v[h % dim] += -1.0 if h >> 63 else 1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n if n else 0.0 for x in v]

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", "t", hash_embedding(64)(F.col("t")).alias("v")).collect()
    for r in rows:
        assert max(abs(a - b) for a, b in zip(r.v, plain(r.t), strict=True)) < 1e-12
        assert max(abs(a - b) for a, b in zip(embed(r.t or ""), plain(r.t), strict=True)) < 1e-12
