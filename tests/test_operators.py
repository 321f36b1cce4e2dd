import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.functions import text as T
from quarry.operators import context as C
from quarry.operators import edges as E
from quarry.operators import fulltext as FT
from quarry.operators import graph as G
from quarry.operators import ranking as K
from quarry.operators import relational as R
from quarry.operators import vector as V


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


EDGE = "src string, dst string, type string"


def test_graph_walks(spark):
    e = frame(spark, EDGE, ("a", "b", "call"), ("b", "c", "call"), ("c", "a", "call"), ("a", "x", "extends"), ("x", "y", "implements"), ("y", "z", "alias"))
    seed, end = frame(spark, "id string", ("a",)), frame(spark, "id string", ("c",))
    assert {(r.src, r.dst) for r in G.call_hierarchy(e, seed).collect()} == {("a", "b"), ("b", "c")}
    assert {(r.src, r.dst) for r in G.call_hierarchy(e, end, "callers").collect()} == {("a", "b"), ("b", "c")}
    types = G.type_graph(e, seed, depth=3)
    assert types.count() == 3 and {r.id for r in G.nodes(types, seed).collect()} == {"a", "x", "y", "z"}
    assert G.call_hierarchy(e, seed, depth=9).count() == 3  # the cycle ends it
    assert G.dependencies(e, seed, "both", 1).count() == 2
    flow = {r.id: (r.depth, r.path) for r in G.data_flow(e.filter("type = 'call'"), seed, 5).collect()}
    assert flow == {"b": (1, ["a", "b"]), "c": (2, ["a", "b", "c"])}


def test_pagerank(spark):
    v = frame(spark, "id string, kind string", ("a", "f"), ("b", "f"), ("c", "f"), ("r", "file"))
    e = frame(spark, EDGE, ("a", "b", "call"), ("b", "c", "call"), ("r", "a", "call"), ("a", "ghost", "call"))
    pr = {r.id: r.pagerank for r in G.pagerank(v, e, rounds=5, damping=0.5).collect()}
    assert set(pr) == {"a", "b", "c"} and pr["a"] < pr["b"] < pr["c"] and sum(pr.values()) <= 1
    assert abs(pr["a"] - 0.5 / 3) < 1e-12 and abs(pr["b"] - (0.5 / 3 + 0.5 * pr["a"])) < 1e-12
    assert G.pagerank(v.limit(0), e).count() == 0
    assert {(r.id, r.in_degree, r.out_degree) for r in G.degrees(v, e).collect()} == {("a", 1, 2), ("b", 1, 1), ("c", 1, 0), ("r", 0, 1)}


def test_fusion(spark):
    a, b = frame(spark, "id string, rank long", ("x", 1), ("y", 2)), frame(spark, "id string, rank long", ("y", 1), ("z", 2))
    got = {r.id: r.score for r in K.rrf([(a, 1.0), (b, 0.5)]).collect()}
    assert got == {"x": round(1 / 61, 9), "y": round(1 / 62 + 0.5 / 61, 9), "z": round(0.5 / 62, 9)}
    assert K.rrf([(a, 1.0), (b.limit(0), 1.0)]).count() == 2


HIT = "id string, score double, name string, kind string, file_path string, exported boolean, language string"


def hits(spark, n=9):
    return frame(spark, HIT, *[(f"i{k}", 1.0 / (k + 1), f"n{k}", ("function", "class", "const")[k % 3], f"f{k % 2}.ts" if k else "x/tests/a.ts", k % 2 == 0, "rust") for k in range(n)])


def test_signals(spark):
    h = hits(spark)
    pop = {r.id: r.popularity_boost for r in K.popularity(h, frame(spark, "id string, pagerank double", ("i1", 0.2), ("i2", 0.1))).collect()}
    assert pop["i1"] == 0.05 and pop["i2"] == 0.025 and pop["i3"] == 0
    factor = {r.id: r.f for r in h.select("id", K.intent_factor("definition").alias("f")).collect()}
    assert factor["i0"] == 0.3 and factor["i4"] == 1.5 and factor["i3"] == 1.0
    bias = {r.id: r.b for r in h.select("id", K.definition_bias("n1").alias("b")).collect()}
    assert bias["i1"] == 10 and bias["i2"] == 0
    pk = frame(spark, "id string, package string", *[(f"i{k}", "p" if k < 3 else "q") for k in range(9)])
    boosted = {r.id: r.package_boost for r in K.same_package(h, pk, "error").collect()}
    assert abs(boosted["i0"] - 0.1) < 1e-6 and boosted["i5"] == 0
    texts = frame(spark, "id string, text string", ("i3", "alpha beta"), ("i1", "alpha"))
    top = K.with_rank(K.rerank(h, "alpha beta", texts)).orderBy("rank").first()
    assert top.id == "i3"
    few = h.limit(2)
    assert {r.score for r in K.rerank(few, "alpha", texts).collect()} == {r.score for r in few.collect()}


def test_diversity(spark):
    h = K.with_rank(hits(spark)).withColumn("cluster_key", F.when(F.col("rank") <= 4, "k"))
    assert [r.id for r in K.by_cluster(h, 5).orderBy("rank").collect()] == ["i0", "i1", "i4", "i5", "i6"]
    assert K.by_file(h, 6).count() == 6
    kinds = [r.id for r in K.by_kind(h, 3).orderBy("rank").collect()]
    assert kinds[0] == "i1" and "i0" in kinds
    assert K.unique(h.unionByName(h.withColumn("rank", F.col("rank") + 50))).count() == 9


def test_fulltext(spark):
    docs = frame(spark, "id string, t array<string>", ("1", ["red", "fox"]), ("2", ["fox", "red", "fox"]), ("3", ["blue"]), ("4", []))
    index = FT.Index.build(docs, "id", {"text": F.col("t")})
    one = {"text": 1.0}
    assert [r.doc for r in FT.search(index, "fox", 5, one).collect()][0] in ("1", "2")
    assert {r.doc for r in FT.search(index, '"red fox"', 5, one).collect()} == {"1", "2"}
    assert {r.doc for r in FT.search(index, '"fox red"', 5, one).collect()} == {"2"}
    assert {r.doc for r in FT.search(index, "fox -red", 5, one).collect()} == set()
    assert {r.doc for r in FT.search(index, "red NOT blue", 5, one).collect()} == {"1", "2"}
    assert FT.search(index, '((" - AND :', 5, one).count() == 0 and FT.search(index, "-fox", 5, one).count() == 0
    assert {r.doc for r in FT.search(index, '"fox red" blue', 5, one).collect()} == {"2", "3"}  # any clause will do
    assert {r.doc for r in FT.search(index, '+"fox red" blue', 5, one).collect()} == {"2"}
    assert {r.doc for r in FT.search(index, 'fox -"fox red"', 5, one).collect()} == {"1"}
    assert {r.doc for r in FT.search(index, "title:red blue", 5, one).collect()} == {"3"}
    c = FT.Clause
    want = [c(("a",), None, "must"), c(("b",)), c(("c",), None, "never"), c(("d", "e")), c(("f",), "name"), c(("x",), None, "must"), c(("y",), None, "must")]
    assert FT.parse('+a b -c "d e" name:f x AND y') == want
    assert FT.parse('"parse_file" readHTTP', T.code_words) == [c(("parse", "file")), c(("read", "http"))]
    words = frame(spark, "id string, t array<string>", ("1", ["controller"]), ("2", ["troll"]), ("3", ["tro"]))
    i, g = FT.Index.build(words, "id", {"text": F.col("t")}), FT.gram_index(words, "id", {"text": F.col("t")})
    got = {r.doc: r.tier for r in FT.search_partial(i, g, "troll", 5).collect()}
    assert got["2"] == 0 and got["1"] == 1


def test_small_vectors_keep_their_order(spark):
    v = frame(spark, "id string, vector array<double>", ("a", [0.0, 2e-4]), ("b", [0.0, 1e-4]))
    assert [r.id for r in V.knn(v, [0.0, 0.0], 5).orderBy("rank").collect()] == ["b", "a"]


def test_context_expansion(spark):
    ddl = "src string, dst string, type string, confidence double, evidence_count int, resolution string"
    e = frame(spark, ddl, ("a", "b", "call", 1.0, 0, "local"), ("a", "c", "extends", 0.5, 0, "import"), ("b", "d", "reference", 1.0, 1, "odd"), ("d", "z", "call", 1.0, 0, "local"), ("b", "a", "call", 1.0, 0, "local"))
    got = {r.id: r.score for r in G.expand_context(e, frame(spark, "id string", ("a",))).collect()}
    boost = 1 + 0.25 * 0.6931471805599453
    assert got == {"b": 1.0, "c": round(1.5 * 0.5 * 0.9, 6), "d": round(0.5 * 0.8 * 0.8 * boost, 6), "a": 0.5}
    assert G.expand_context(e, frame(spark, "id string", ("a",)), explored=2).count() == 2
    some = frame(spark, "id string", ("b",), ("d",))
    assert {r.id for r in G.expand_context(e, frame(spark, "id string", ("a",)), known=some).collect()} == {"b", "d"}


def test_budget_of_a_whole_table(spark):
    items = frame(spark, "id int, tokens long", *[(k, (k * 7) % 5) for k in range(50)])
    for budget in (1, 9, 30, 10_000):
        got = [(r.id, r.total) for r in C.within_budget(items, budget, ["id"]).orderBy("id").collect()]
        want, total = [], 0
        for k in range(50):
            if total < budget:
                want.append((k, total + (k * 7) % 5))
            total += (k * 7) % 5
        assert got == want, budget


def test_queries_as_columns(spark):
    asked = ["lang:ts kind:class,struct find it", "path:'a b' pkg:x x:y", "", " id:7  file:f.ts lang:rust language:JS", "kind: and", "a AND b & c and ", "one & two"]
    rows = frame(spark, "q string", *[(q,) for q in asked]).select("q", Q.controls(F.col("q")).alias("c"), Q.decomposed(F.col("q")).alias("parts")).collect()
    for r in rows:
        c = Q.parse_controls(r.q)
        assert (r.c.text, r.c.id, r.c.file, r.c.path, r.c.lang, r.c.kind, r.c.package) == (c.text, c.id, c.file, c.path, c.lang, c.kind, c.package), r.q
        assert r.parts == Q.decompose(r.q), r.q


def test_words_of_one_string(spark):
    texts = ["parseHTTPFile foo_bar v1", "server2 A.b::C->d (x)", "éÉa ß9b", "", 'say "quoted words"', "aBC D-e"]
    rows = frame(spark, "t string", *[(t,) for t in texts]).select("t", T.tokens(F.col("t")).alias("code"), T.plain_tokens(F.col("t")).alias("plain")).collect()
    for r in rows:
        assert r.plain == T.plain_words(r.t) and ('"' in r.t or r.code == T.code_words(r.t)), r.t


def test_auto_include():
    item = lambda i, n: C.Item(i, i, "class", "f", " ".join(["w"] * n))
    related = [(item("p", 3), "extends"), (item("t", 4), "type"), (item("u", 9), "reference"), (item("t", 4), "type"), (item("s", 1), "type")]
    assert [i.id for i in C.auto_include(related, {"s"}, 8)] == ["t", "p"]
    long = C.Item("l", "l", "function", "f", "\n".join(f"line {k}" + (" needle" if k == 30 else "") for k in range(60)))
    assert "needle" in C.pack([long], 60, relevance=lambda x: "needle" in x)[0].text


def test_rerank_remembers(spark):
    h, asked = hits(spark), []
    texts = frame(spark, "id string, text string", ("i3", "alpha beta"), ("i1", "alpha"))
    known: dict = {}
    for _ in range(2):
        out = K.rerank(h, "alpha", texts, lambda q, t: asked.append(t) or 0.5, judged_before=known)
        assert out.count() == 9
    assert len(asked) == len(set(asked)) == 3


def test_vectors(spark):
    v = frame(spark, "id string, vector array<float>", ("id1", [1.0, 0.0, 0.0]), ("id2", [0.0, 1.0, 0.0]), ("bad", [1.0]))
    assert [r.id for r in V.knn(v, [0.9, 0.1, 0.0], 5).orderBy("rank").collect()] == ["id1", "id2"]
    assert [r.id for r in V.similar(v, [1.0, 0.0, 0.0], 5, 0.5, self_id="id1").collect()] == []
    with pytest.raises(KeyError):
        V.vector_of(v, "none")
    key = frame(spark, "v array<double>", ([1.0, -1.0] * 32,), ([-1.0] * 63 + [0.0],)).select(V.cluster_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in key] == ["5" * 16, "8" + "0" * 15]
    with pytest.raises(Exception, match="not true"):
        V.checked(v, 3).collect()
    assert V.migrated(v.filter("id <> 'bad'"), 3)[1] is False and V.migrated(v, 3)[1] is True
    cache = frame(spark, "cache_key string, embedding array<double>, last_accessed_at long", *[(str(k), [0.0] * 8, k) for k in range(20)])
    assert V.trim_cache(cache, 10**9).count() == 20 and V.trim_cache(cache, 10).count() == 18


def test_trim_cache_is_exact(spark):
    """percentile_approx misses the rank on long columns and reads whole numbers as doubles."""
    long = spark.range(0, 250_000, 1, 6).select(F.col("id").alias("last_accessed_at"), F.array(F.lit(0.0)).alias("embedding"))
    kept = V.trim_cache(long, 10).agg(F.count("*").alias("n"), F.min("last_accessed_at").alias("least")).first()
    assert tuple(kept) == (225_000, 25_000)
    top, rng = 2**63 - 1, random.Random(5)
    cases = [([2**53 + k for k in range(1, 21)], 0.05), ([-top - 1, top], 0.1), ([1] * 10 + [2] * 90, 0.1), ([None, 3, None, 4], 0.1), ([rng.randint(-top, top) for _ in range(500)], 0.3)]
    for values, share in cases:
        known = sorted(v for v in values if v is not None)
        cut = known[math.ceil(len(known) * Fraction(str(share))) - 1]
        cache = frame(spark, "last_accessed_at long, embedding array<double>", *[(v, [0.0] * 8) for v in values])
        assert sorted(r.last_accessed_at for r in V.trim_cache(cache, 10, share).collect()) == [v for v in known if v > cut]
    empty = frame(spark, "last_accessed_at long, embedding array<double>", (None, [0.0] * 8))
    assert V.quantile(empty, "last_accessed_at", 0.1) is None and V.trim_cache(empty, 10).count() == 0


def test_tables(spark):
    rows = frame(spark, "src string, dst string, type string, at_file string, at_line int, confidence double, evidence_count int, resolution string, seq int",
                 ("a", "b", "call", None, None, 0.5, 1, "unknown", 1), ("a", "b", "call", "f", 3, 0.9, 4, "import", 2), ("a", "b", "call", "g", 9, 0.1, 2, "import", 3))
    r = R.merge_edges(rows).collect()
    assert len(r) == 1 and tuple(r[0]) == ("a", "b", "call", "f", 3, 0.9, 4, "import", 2)
    files = frame(spark, "file_path string", ("a/b/x.ts",), ("a/bb/y.ts",), ("z.ts",), ("c/d.ts",))
    roots = frame(spark, "id string, root string", ("1", "a/b"), ("2", "a"), ("3", ""), ("4", "c/d"))
    assert {r.file_path: r.root_key for r in R.longest_prefix(files, roots).collect()} == {"a/b/x.ts": "1", "a/bb/y.ts": "2", "z.ts": "3", "c/d.ts": "3"}
    t = frame(spark, "id int, v string", (1, "a"), (2, "b"))
    assert {tuple(r) for r in R.upsert(t, frame(spark, "id int, v string", (2, "c"), (3, "d")), ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert R.insert_new(t, frame(spark, "id int, v string", (2, "c"), (3, "d")), ["id"]).count() == 3


def test_edge_resolution(spark):
    ddl = "id string, file_path string, name string, kind string, exported boolean, start_byte int, start_line int, text string"
    syms = frame(spark, ddl, ("1", "p/a.ts", "f", "function", True, 0, 1, "function f() { g(); h() }"), ("2", "p/a.ts", "g", "function", False, 9, 2, "function g() {}"),
                 ("3", "q/b.ts", "h", "function", True, 0, 1, "function h() {\n h2() }"), ("4", "p/c.ts", "k", "function", True, 0, 1, "function k() { f() }"))
    imports = E.resolve_imports(frame(spark, "file_path string, name string, source string, alias string, seq int", ("p/c.ts", "f", "./a", None, 0), ("p/a.ts", "zz", "lib", "q", 1)), syms)
    assert {(r.file_path, r.local, r.via) for r in imports.collect()} == {("p/c.ts", "f", "file"), ("p/a.ts", "q", "made")}
    owners = frame(spark, "file_path string, package string", ("p/a.ts", "P"), ("p/c.ts", "P"), ("q/b.ts", "Q"))
    built = E.build(syms, E.candidates(syms), imports, owners)
    got = {(r.src, r.dst, r.type): r.resolution for r in built.collect()}
    assert got[("1", "2", "call")] == "local" and got[("1", "3", "call")] == "cross-package" and got[("4", "1", "call")] == "package-import"
    edges, evidence = E.with_evidence(built, syms)
    assert {(r.src, r.dst, r.evidence_count) for r in edges.filter("type = 'call'").collect()} >= {("1", "2", 1)} and evidence.count() > 0
    path = frame(spark, "a string, b string", ("x/y/a.ts", "../z/m"), ("x/a.ts", "./m.rs"), ("x/a.ts", "lib")).select(E.resolve_path(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in path.collect()] == ["x/z/m.ts", "x/m.rs", None]


def test_context(spark):
    items = [C.Item(str(k), f"n{k}", "function", "f", "a b c d", role) for k, role in enumerate(["root", "root", "extra", "expanded", "expanded"])]
    assert [i.id for i in C.pack(items, 10)] == ["0", "1", "2", "3"]
    assert [i.id for i in C.pack(items, 1)] == ["0", "2", "3"]
    assert "## Definitions" in C.render(items) and "## Related" in C.render(items)
    text = "\n".join(f"line {k}" + (" needle" if k == 20 else "") for k in range(40))
    short = C.smart_truncate(text, 40, lambda x: "needle" in x)
    assert "needle" in short and short.startswith("line 0") and short.endswith("line 39")
    assert C.smart_truncate("a\nb", 1, lambda x: 0) == "a\nb"
