"""Queries: vectors, graph, fusion, ranking, context, streams, and the flagship search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import cache_key, hash_embedding
from ..operators import context as C
from ..operators import fulltext as FT
from ..operators import graph as G
from ..operators import ranking as K
from ..operators import vector as V
from ..operators.cut import cut, small
from ..session import table
from ..streaming import watch as W
from .bindings import AFFINITY, CLUSTERS, EDGES, NOW, SELECTIONS, SYMBOLS, TREE, affinity, clusters, edges, query, selections, symbols, tree, vectors, with_
from . import stored
from .text_queries import _DOCS, _bm25_sql

# Vectors.

_DIST = """dist AS (SELECT e.vec_id AS id, e.label, e.embedding,
    round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 6) AS distance
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"""


def _knn(where: str = "true", k: int = 20) -> str:
    return f"SELECT row_number() OVER (ORDER BY distance, id) AS rank, id, distance FROM (SELECT * FROM dist WHERE {where}) ORDER BY distance, id LIMIT {k}"


@query("knn_l2", f"WITH {_DIST} {_knn()}")
def knn_l2(spark, d):
    v = vectors(spark, d)
    return V.knn(v, V.vector_of(v, 7), 20, digits=6)


@query("knn_filtered", f"WITH {_DIST} {_knn('label IN (1, 2)', 10)}")
def knn_filtered(spark, d):
    v = vectors(spark, d)
    return V.knn(v, V.vector_of(v, 7), 10, digits=6, where=F.col("label").isin(1, 2))


@query("similar_above_threshold", f"WITH {_DIST}, k AS ({_knn('true', 40)}) SELECT id, round(1 / (1 + greatest(distance, 0.0E0)), 6) AS similarity FROM k WHERE round(1 / (1 + greatest(distance, 0.0E0)), 6) >= 0.38 AND id <> 7 ORDER BY similarity DESC, id LIMIT 20")
def similar_above_threshold(spark, d):
    v = vectors(spark, d)
    return V.similar(v, V.vector_of(v, 7), 20, 0.38, self_id=7, digits=6)


_KEYS = "keys AS (SELECT vec_id AS id, array_to_string(list_transform(range(16), lambda g: substr('0123456789abcdef', 1 + CAST(list_sum(list_transform(range(4), lambda b: CASE WHEN embedding[64 - g * 4 - b] >= 0 THEN [8, 4, 2, 1][b + 1] ELSE 0 END)) AS INTEGER), 1)), '') AS cluster_key FROM embeddings)"


@query("lsh_cluster_key", f"WITH {_KEYS} SELECT id, cluster_key FROM keys")
def lsh_cluster_key(spark, d):
    return vectors(spark, d).select("id", V.cluster_key(F.col("vector")).alias("cluster_key"))


@query("lsh_cluster_members", "WITH k AS (SELECT vec_id AS id, list_transform(embedding[1:3], lambda x: x >= 0) AS k FROM embeddings) SELECT id FROM k WHERE k = (SELECT k FROM k WHERE id = 7) AND id <> 7 ORDER BY id LIMIT 20")
def lsh_cluster_members(spark, d):
    """Rows of a row's cluster, by the first three components: a short key, so that there are members."""
    short = vectors(spark, d).select("id", F.slice("vector", 1, 3).alias("vector"))
    return V.cluster_members(short, 7, 20).select("id")


# The hash embedder: 64-bit hashes of words, byte by byte in wider integers, then signed counts by place.
_FNV = """list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(0, length(x) // 2), lambda i: CAST((instr('0123456789ABCDEF', substr(x, CAST(2 * i + 1 AS INTEGER), 1)) - 1) * 16
    + instr('0123456789ABCDEF', substr(x, CAST(2 * i + 2 AS INTEGER), 1)) - 1 AS UHUGEINT))), lambda h, b: xor(h, b) * CAST(1099511628211 AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT))"""


def _embed_sql(texts: str) -> str:
    """CTEs up to ``parts`` (id, place, v): the components that are not 0, of texts (id, text)."""
    return rf"""texts AS ({texts}), words AS (SELECT id, unnest(regexp_extract_all(text, '([\p{{L}}\p{{N}}_$]+)', 1)) AS w FROM texts),
      hashed AS (SELECT w, {_FNV} AS h FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words))),
      counts AS (SELECT id, CAST(h % 64 AS INTEGER) AS place, sum(CASE WHEN h >= CAST(9223372036854775808 AS UHUGEINT) THEN -1.0E0 ELSE 1.0E0 END) AS v FROM words JOIN hashed USING (w) GROUP BY ALL),
      parts AS (SELECT id, place, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM counts WHERE v <> 0)"""


@query(
    "hash_embed_documents",
    "WITH "
    + _embed_sql("SELECT doc_id AS id, text FROM documents")
    + " SELECT id AS doc_id, place, round(v, 6) AS value FROM parts",
)
def hash_embed_documents(spark, d):
    """The components of all embeddings that are not 0."""
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(hash_embedding(64)(F.col("text"))).alias("place", "value"))
    return parts.filter("value <> 0").select("doc_id", "place", F.round("value", 6).alias("value"))


@query("embedding_cache_misses", "SELECT DISTINCT sha256('m|' || sha256(text)) AS cache_key FROM documents WHERE sha256('m|' || sha256(text)) NOT IN (SELECT sha256('m|' || sha256(text)) FROM documents WHERE doc_id % 2 = 0)")
def embedding_cache_misses(spark, d):
    docs = table(spark, d, "documents")
    cached = docs.filter("doc_id % 2 = 0").select(cache_key("m", F.col("text")).alias("cache_key"))
    return V.missing(docs, cached, "m").select("cache_key")


# Graph.


def _walk(spark, d) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges for PageRank: customers and suppliers, linked both ways."""
    e = cut(edges(spark, d).select("src", "dst", "type"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
    return both.select(F.col("src").alias("id")).distinct(), both


def _pagerank_sql(rounds: int, links: str = EDGES) -> str:
    out = f"{with_(links)}, b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), v AS (SELECT DISTINCT src AS id FROM b), o AS (SELECT src, count(*) AS n FROM b GROUP BY src), c AS (SELECT count(*) AS n FROM v), r0 AS (SELECT id, 1.0E0 / n AS pr FROM v, c)"
    for k in range(1, rounds + 1):
        out += f", r{k} AS (SELECT v.id, 0.15E0 / any_value(c.n) + 0.85E0 * coalesce(sum(r.pr / o.n), 0) AS pr FROM v CROSS JOIN c LEFT JOIN b ON b.dst = v.id LEFT JOIN r{k - 1} r ON r.id = b.src LEFT JOIN o ON o.src = b.src GROUP BY v.id)"
    return out


@query("pagerank_k5", _pagerank_sql(5) + " SELECT id, round(pr, 9) AS pagerank FROM r5")
def pagerank_k5(spark, d):
    v, e = _walk(spark, d)
    return G.pagerank(v, e, rounds=5, kind_col=None).select("id", F.round("pagerank", 9).alias("pagerank"))


@query("pagerank_top", _pagerank_sql(20) + " SELECT id, round(pr, 9) AS pagerank FROM r20 ORDER BY 2 DESC, id LIMIT 25")
def pagerank_top(spark, d):
    v, e = _walk(spark, d)
    return G.pagerank(v, e, rounds=20, kind_col=None).select("id", F.round("pagerank", 9).alias("pagerank")).orderBy(F.desc("pagerank"), "id").limit(25)


@query("degree_metrics", with_(EDGES) + "SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id")
def degree_metrics(spark, d):
    e = edges(spark, d)
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return G.degrees(v, e)


def _reach_sql(seed: str, types: str, depth: int, up: bool = False, both: bool = False) -> str:
    """Walks by level; a node's edges are met when it is first reached."""
    to, at = ("src", "dst") if up else ("dst", "src")
    step = f"step AS (SELECT {at} AS a, {to} AS b, src, dst, type FROM tree WHERE type IN ({types})"
    step += f" UNION ALL SELECT {to}, {at}, src, dst, type FROM tree WHERE type IN ({types}))" if both else ")"
    out = with_(TREE, step, f"f0 AS (SELECT '{seed}' AS id)")
    seen = "SELECT id FROM f0"
    for k in range(1, depth + 1):
        out += f", e{k} AS (SELECT {k} AS depth, b, src, dst, type FROM step JOIN f{k - 1} ON a = id), f{k} AS (SELECT DISTINCT b AS id FROM e{k} WHERE b NOT IN ({seen}))"
        seen += f" UNION ALL SELECT id FROM f{k}"
    union = " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(1, depth + 1))
    return out + f" SELECT min(depth) AS depth, src, dst, type FROM ({union}) GROUP BY src, dst, type"


def _seed(spark: SparkSession, name: str) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("id"))


@query("call_hierarchy_d2", _reach_sql("r1", "'call'", 2))
def call_hierarchy_d2(spark, d):
    return G.call_hierarchy(tree(spark, d), _seed(spark, "r1"), "callees", 2, None)


@query("call_hierarchy_callers", _reach_sql("c7", "'call'", 3, up=True))
def call_hierarchy_callers(spark, d):
    return G.call_hierarchy(tree(spark, d), _seed(spark, "c7"), "callers", 3, None)


@query("dependency_d3_limited", "SELECT * FROM (" + _reach_sql("r1", "'call', 'reference'", 3) + ") ORDER BY depth, src, type, dst LIMIT 200")
def dependency_d3_limited(spark, d):
    return G.dependencies(tree(spark, d), _seed(spark, "r1"), "downstream", 3, 200)


@query("dependency_bidirectional", _reach_sql("n3", "'call', 'reference'", 2, both=True))
def dependency_bidirectional(spark, d):
    return G.dependencies(tree(spark, d), _seed(spark, "n3"), "bidirectional", 2, None)


@query("type_graph", _reach_sql("n3", "'extends', 'implements', 'alias'", 2))
def type_graph(spark, d):
    return G.type_graph(tree(spark, d), _seed(spark, "n3"), 2, None)


@query(
    "affected_code",
    f"""WITH w AS ({_reach_sql("o5", "'call', 'reference'", 3, up=True)}), n AS (SELECT src AS id, min(depth) AS depth FROM w GROUP BY src)
      SELECT id, 'name ' || id AS name, substr(id, 1, 1) AS file_path, 'node' AS kind, CASE WHEN length(id) = 2 THEN 'high' ELSE 'medium' END AS impact, depth FROM n WHERE NOT starts_with(id, 'r')""",
)
def affected_code(spark, d):
    t = tree(spark, d)
    nodes = t.select(F.col("src").alias("id")).union(t.select("dst")).distinct()
    syms = nodes.select("id", F.concat(F.lit("name "), "id").alias("name"), F.substring("id", 1, 1).alias("file_path"), F.lit("node").alias("kind"), (F.length("id") == 2).alias("exported"))
    return G.affected(t, syms, _seed(spark, "o5"), 3, None, tests=F.col("id").startswith("r"))


@query(
    "data_flow_paths",
    with_(TREE)
    + """, w AS (SELECT dst AS id, 1 AS depth, type, [src, dst] AS path FROM tree WHERE src = 'n3'),
      w2 AS (SELECT t.dst AS id, 2 AS depth, t.type, list_append(w.path, t.dst) AS path FROM w JOIN tree t ON t.src = w.id)
      SELECT id, depth, 'read' AS flow, array_to_string(path, '>') AS path FROM (SELECT * FROM w UNION ALL SELECT * FROM w2)""",
)
def data_flow_paths(spark, d):
    return G.data_flow(tree(spark, d), _seed(spark, "n3"), 2, None).select("id", "depth", "flow", F.array_join("path", ">").alias("path"))


@query("references_by_type", with_(EDGES) + "SELECT dst, type, src FROM edges WHERE dst IN ('p1', 'p2') AND type = 'reference' ORDER BY dst, type, src LIMIT 200")
def references_by_type(spark, d):
    roots = spark.createDataFrame([("p1",), ("p2",)], "id string")
    return G.references(edges(spark, d), roots, ["reference"])


@query("callers_of", with_(EDGES) + "SELECT DISTINCT src AS id FROM edges WHERE dst = 'p3' AND type IN ('call', 'reference') ORDER BY id LIMIT 200")
def callers_of(spark, d):
    return G.callers(edges(spark, d), "p3")


_PULL = "confidence * CASE type WHEN 'extends' THEN 1.5E0 WHEN 'call' THEN 1.0E0 ELSE 0.8E0 END * least(greatest(1 + ln(1 + evidence_count) * 0.25E0, 1.0E0), 1.75E0) * CASE resolution WHEN 'local' THEN 1.0E0 WHEN 'import' THEN 0.9E0 ELSE 0.8E0 END"


@query(
    "context_expansion_scored",
    with_(EDGES)
    + f""", b AS (SELECT src, dst, type, confidence, evidence_count, resolution FROM edges UNION ALL SELECT dst, src, type, confidence, evidence_count, resolution FROM edges),
      e AS (SELECT src, dst, {_PULL} AS pull FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY type, dst) <= 4),
      s(id) AS (VALUES ('c1'), ('c2'), ('c4')), one AS (SELECT dst AS id, max(pull) AS score FROM e JOIN s ON src = s.id GROUP BY dst),
      two AS (SELECT dst AS id, max(pull / 2) AS score FROM e JOIN one ON src = one.id WHERE one.id NOT IN (SELECT id FROM s) GROUP BY dst)
      SELECT id, round(max(score), 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY id ORDER BY 2 DESC, 1 LIMIT 50""",
)
def context_expansion_scored(spark, d):
    """Two levels from three nodes, over edges both ways."""
    e = cut(edges(spark, d))  # read at each level
    rest = ["type", "confidence", "evidence_count", "resolution"]
    both = e.select("src", "dst", *rest).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))
    return G.expand_context(both, spark.createDataFrame([("c1",), ("c2",), ("c4",)], "id string"), depth=2, per_node=4)


# Fusion and ranking.

_LISTS = f"""{_DOCS}, {_bm25_sql(["idiot", "moron", "the"])}, kw AS (SELECT row_number() OVER (ORDER BY round(raw, 6) DESC, doc_id) AS rank, doc_id AS id, round(raw, 6) AS score FROM b QUALIFY rank <= 40),
  {_DIST}, vec AS (SELECT row_number() OVER (ORDER BY distance, id) AS rank, id, distance FROM dist QUALIFY rank <= 40)"""


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    terms = ["idiot", "moron", "the"]
    kw = FT.ranked(FT.bm25(stored.words(spark, d), terms), 40, digits=6).withColumnRenamed("doc", "id")
    v = vectors(spark, d)
    return small(kw), small(V.knn(v, V.vector_of(v, 7), 40, digits=6))


@query("rrf_fusion", f"WITH {_LISTS} SELECT id, round(sum(1.0E0 / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM kw UNION ALL SELECT id, rank FROM vec) GROUP BY id")
def rrf_fusion(spark, d):
    kw, vec = _lists(spark, d)
    return K.rrf([(kw, 1.0), (vec, 1.0)])


@query("rrf_weighted", f"WITH {_LISTS} SELECT id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT id, rank, 1.0E0 AS w FROM kw UNION ALL SELECT id, rank, 0.5E0 FROM vec) GROUP BY id")
def rrf_weighted(spark, d):
    kw, vec = _lists(spark, d)
    return K.rrf([(kw, 1.0), (vec, 0.5)])


@query("graph_rerank_list", f"WITH {_LISTS} SELECT id, score, (id % 17) / 100.0E0 AS pagerank, row_number() OVER (ORDER BY (id % 17) / 100.0E0 DESC, rank) AS rank FROM kw")
def graph_rerank_list(spark, d):
    kw, _vec = _lists(spark, d)
    ranks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 17 / 100.0).alias("pagerank"))
    return K.graph_list(kw, ranks).select("id", "score", "pagerank", "rank")


_BASE = f"""{_LISTS}, k AS (SELECT id, score / max(score) OVER () AS ks FROM kw), v AS (SELECT id, (1 / (1 + distance)) / max(1 / (1 + distance)) OVER () AS vs FROM vec),
  base AS (SELECT id, coalesce(ks, 0) AS keyword_score, coalesce(vs, 0) AS vector_score, 0.7E0 * coalesce(vs, 0) + 0.3E0 * coalesce(ks, 0) AS base_score FROM k FULL JOIN v USING (id))"""


@query("weighted_score_fusion", f"WITH {_BASE} SELECT id, round(keyword_score, 6) AS keyword_score, round(vector_score, 6) AS vector_score, round(base_score, 6) AS base_score FROM base")
def weighted_score_fusion(spark, d):
    kw, vec = _lists(spark, d)
    return K.weighted(kw, vec).select("id", *[F.round(c, 6).alias(c) for c in ("keyword_score", "vector_score", "base_score")])


_ADJUST = """CASE WHEN exported THEN 0.1E0 ELSE 0.0E0 END - CASE WHEN kind = 'module' THEN 5.0E0 ELSE 0.0E0 END
  + CASE WHEN len(list_filter(string_split(lower(file_path), '/'), lambda p: regexp_replace(p, '\\.[^.]*$', '') = 'src1' OR starts_with(p, 'src1') OR starts_with('src1', p))) > 0 THEN 2.0E0 ELSE 0.0E0 END"""


@query("structural_adjust", with_(SYMBOLS) + f"SELECT id, round({_ADJUST}, 6) AS adjust FROM symbols")
def structural_adjust(spark, d):
    return symbols(spark, d).select("id", F.round(K.structural("src1 en"), 6).alias("adjust"))


_FACTOR = "CASE WHEN kind IN ('class', 'struct', 'const') AND exported THEN 1.5E0 ELSE 1.0E0 END"


@query("intent_multiplier", with_(SYMBOLS) + f"SELECT id, {_FACTOR} AS definition, CASE WHEN kind = 'function' THEN 1.5E0 WHEN kind IN ('class', 'struct') THEN 1.3E0 ELSE 1.0E0 END AS implementation, CASE WHEN kind = 'const' THEN 1.5E0 ELSE 0.8E0 END AS config, 0.5E0 AS test FROM symbols")
def intent_multiplier(spark, d):
    return symbols(spark, d).select("id", *[K.intent_factor(i).alias(i) for i in ("definition", "implementation", "config", "test")])


def _hits(spark, d) -> DataFrame:
    """The hundred longest symbols, scored by their length; some are tests, some define nothing."""
    n = F.col("start_byte")
    s = symbols(spark, d).withColumn("score", F.round(F.col("n_chars") / 30000.0, 5)).orderBy(F.desc("score"), "id").limit(100)
    s = s.withColumn("kind", F.when(n % 5 == 0, "variable").otherwise(F.col("kind")))
    s = s.withColumn("file_path", F.when(n % 7 == 0, F.regexp_replace("file_path", "/f", "/tests/f")).otherwise(F.col("file_path")))
    return small(s.drop("text", "n_chars"))


_HITS = SYMBOLS + """, hits AS (SELECT id, CASE WHEN start_byte % 7 = 0 THEN regexp_replace(file_path, '/f', '/tests/f') ELSE file_path END AS file_path, language,
    CASE WHEN start_byte % 5 = 0 THEN 'variable' ELSE kind END AS kind, name, exported, start_byte, round(n_chars / 30000.0E0, 5) AS score FROM symbols ORDER BY score DESC, id LIMIT 100)"""


@query("popularity_boost", with_(_HITS) + "SELECT id, round((start_byte % 17) / 16.0E0 * 0.05E0, 6) AS popularity_boost, round(score + round((start_byte % 17) / 16.0E0 * 0.05E0, 6), 6) AS score FROM hits")
def popularity_boost(spark, d):
    metrics = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 17 / 100.0).alias("pagerank"))
    return K.popularity(_hits(spark, d), metrics).select("id", "popularity_boost", "score")


@query("docstring_boost", with_(_HITS) + "SELECT id, CASE WHEN start_byte % 3 = 0 THEN round(score * 0.5E0, 6) ELSE 0.0E0 END AS docstring_boost, round(score + CASE WHEN start_byte % 3 = 0 THEN round(score * 0.5E0, 6) ELSE 0.0E0 END, 6) AS score FROM hits")
def docstring_boost(spark, d):
    docs = table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"))
    return K.docstrings(_hits(spark, d), docs).select("id", "docstring_boost", "score")


@query("selection_boost_decay", with_(SELECTIONS) + f"SELECT id, round(sum(1 / ln(position + 2) * exp(-0.1E0 * ({NOW} - created_at) / 86400.0E0)), 6) AS selections FROM selections WHERE query = 'click' GROUP BY id")
def selection_boost_decay(spark, d):
    return K.selection_scores(selections(spark, d), "click", F.lit(float(NOW))).select("id", F.round("selections", 6).alias("selections"))


@query("affinity_boost_decay", with_(AFFINITY) + f"SELECT file_path, round((view_count + 2 * edit_count) * exp(-0.05E0 * ({NOW} - last_accessed_at) / 86400.0E0), 6) AS affinity FROM affinity")
def affinity_boost_decay(spark, d):
    return K.affinity_scores(affinity(spark, d), F.lit(float(NOW))).select("file_path", F.round("affinity", 6).alias("affinity"))


@query("package_boost", with_(_HITS) + "SELECT id, CASE WHEN split_part(file_path, '/', 1) = 'src3' THEN round(score * 0.2E0, 6) ELSE 0.0E0 END AS package_boost FROM hits")
def package_boost(spark, d):
    h = _hits(spark, d)
    packages = h.select("id", F.substring_index("file_path", "/", 1).alias("package"))
    out = K.same_package(h, packages, "definition", "src3")
    return out.select("id", F.when(F.col("package_boost") > 0, F.round(F.col("package_boost"), 6)).otherwise(0.0).alias("package_boost"))


_RANKED = _HITS + ", ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, exported DESC, name, file_path, kind, id) AS rank FROM hits)"


@query("diversify_by_cluster", with_(_RANKED, CLUSTERS) + """SELECT id, r AS rank FROM (SELECT id, row_number() OVER (ORDER BY o, rank) AS r FROM (SELECT id, rank, CASE WHEN row_number() OVER (PARTITION BY cluster_key ORDER BY rank) > 2 THEN 1 ELSE 0 END AS o FROM ranked JOIN clusters USING (id))) WHERE r <= 10""")
def diversify_by_cluster(spark, d):
    h = K.with_rank(_hits(spark, d)).join(clusters(spark, d), "id")
    return K.by_cluster(h, 10).select("id", "rank")


@query("diversify_by_file", with_(_RANKED) + "SELECT id, r AS rank FROM (SELECT id, row_number() OVER (ORDER BY o, rank) AS r FROM (SELECT id, rank, CASE WHEN row_number() OVER (PARTITION BY file_path ORDER BY rank) > 3 THEN 1 ELSE 0 END AS o FROM ranked)) WHERE r <= 10")
def diversify_by_file(spark, d):
    return K.by_file(K.with_rank(_hits(spark, d)), 10).select("id", "rank")


@query("diversify_by_kind", with_(_RANKED) + """SELECT id, r AS rank FROM (SELECT id, row_number() OVER (ORDER BY lead, rank) AS r FROM (SELECT id, rank, CASE WHEN row_number() OVER (PARTITION BY c ORDER BY rank) = 1 THEN c ELSE 3 END AS lead
    FROM (SELECT *, CASE WHEN contains(file_path, '.test.') OR contains(file_path, '.spec.') OR contains(file_path, '/tests/') OR contains(file_path, '/__tests__/') THEN 2 WHEN kind = 'variable' THEN 1 ELSE 0 END AS c FROM ranked))) WHERE r <= 10""")
def diversify_by_kind(spark, d):
    return K.by_kind(K.with_rank(_hits(spark, d)), 10).select("id", "rank")


@query("neighbour_expansion", with_(EDGES) + """, h(id, kind, score) AS (VALUES ('c1', 'function', 3.0E0), ('p2', 'class', 2.0E0), ('c4', 'function', 1.5E0), ('c5', 'function', 0.01E0)),
  n AS (SELECT h.id AS hit, h.score, e.*, CASE WHEN kind = 'class' THEN e.src ELSE e.dst END AS nb FROM h JOIN edges e ON (kind <> 'class' AND e.src = h.id AND type = 'call') OR (kind = 'class' AND e.dst = h.id AND type IN ('reference', 'extends')) WHERE h.score > 1),
  t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY hit ORDER BY type, nb) <= 5),
  m AS (SELECT nb AS id, round(max(score * 0.8E0 * confidence * least(greatest(1 + ln(1 + evidence_count) * 0.25E0, 1.0E0), 1.75E0) * CASE resolution WHEN 'local' THEN 1.0E0 ELSE 0.9E0 END), 6) AS score FROM t WHERE nb NOT IN (SELECT id FROM h) GROUP BY nb)
  SELECT id, score FROM (SELECT id, score FROM h UNION ALL SELECT id, score FROM m) ORDER BY score DESC, id LIMIT 12""")
def neighbour_expansion(spark, d):
    e = edges(spark, d)
    syms = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    syms = syms.select("id", F.lit("").alias("name"), F.lit("").alias("kind"), F.lit("").alias("file_path"), F.lit(False).alias("exported"), F.lit("").alias("language"))
    rows = [("c1", 3.0, "", "function", "", False, ""), ("p2", 2.0, "", "class", "", False, ""), ("c4", 1.5, "", "function", "", False, ""), ("c5", 0.01, "", "function", "", False, "")]
    hits = spark.createDataFrame(rows, "id string, score double, name string, kind string, file_path string, exported boolean, language string")
    return K.neighbours(hits.withColumn("name", F.lit("")), e, syms, 12).select("id", "score").orderBy(F.desc("score"), "id")


# Context.


@query(
    "token_budget_context",
    r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS tokens FROM documents),
      r AS (SELECT doc_id, tokens, CAST(sum(tokens) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM t) SELECT doc_id, tokens, total FROM r WHERE total - tokens < 8192""",
)
def token_budget_context(spark, d):
    items = table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"))
    return C.within_budget(items, 8192, order=["doc_id"]).select("doc_id", "tokens", "total")


@query(
    "head_tail_truncate",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
      SELECT doc_id, CASE WHEN len(ls) <= 10 THEN array_to_string(ls, chr(10)) ELSE array_to_string(ls[1:3], chr(10)) || chr(10) || '... ' || (len(ls) - 5) || ' lines omitted ...' || chr(10) || array_to_string(ls[len(ls) - 1:], chr(10)) END AS text FROM l""",
)
def head_tail_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", C.head_tail(F.col("text"), most=10, head=3, tail=2).alias("text"))


# Streams, checked as batches.


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return W.tumbling(table(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query(
    "events_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id, min(ts) AS session_start, count(*) AS n FROM n GROUP BY user_id, k""",
)
def events_session(spark, d):
    return W.sessions(table(spark, d, "events"), gap="6 hours").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("incremental_equals_full", with_(SYMBOLS) + "SELECT file_path, kind, count(*) AS n FROM symbols GROUP BY file_path, kind")
def incremental_equals_full(spark, d):
    """Tables refreshed after changes to some files are those of a full build."""
    s = symbols(spark, d).select("id", "file_path", "kind")
    stale = s.filter("file_path NOT LIKE 'src2/%'").withColumn("kind", F.when(F.col("file_path").like("src1/%"), "stale").otherwise(F.col("kind")))
    now = s.select("file_path").distinct().withColumn("size_bytes", F.lit(1))
    before = stale.select("file_path").distinct().withColumn("size_bytes", F.when(F.col("file_path").like("src1/%"), 0).otherwise(1))
    changes = W.compare(before, now, ["size_bytes"])
    fresh = W.refresh({"symbols": stale}, changes, lambda files: {"symbols": s.join(files, "file_path", "left_semi")})
    return fresh["symbols"].groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("n"))


# The flagship: hybrid search.


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over the documents: BM25, hash-embedding neighbours and link popularity, fused, at
    most three hits of a source, ten in all. Postings, vectors and ranks are stored; each list is short and
    held once."""
    from ..functions.hashing import embed

    asked = "the clown and the moron"
    terms = sorted(set(asked.split()))
    kw = small(FT.ranked(FT.bm25(stored.words(spark, d), terms), 40, digits=6).withColumnRenamed("doc", "id"))
    vec = small(V.knn(stored.document_vectors(spark, d), embed(asked), 40, digits=6))
    listed = [r.id for r in kw.select("id").collect()]  # local rows
    graph = small(K.graph_list(kw, stored.document_ranks(spark, d).filter(F.col("id").isin(*listed))))
    fused = small(K.rrf([(kw, 1.0), (vec, 1.0), (graph, 0.5)]))
    ids = [r.id for r in fused.select("id").collect()]  # at most 80
    docs = table(spark, d, "documents").filter(F.col("doc_id").isin(*ids)).select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"))
    top = K.by_file(K.with_rank(fused.join(docs, "id")), 10)
    for name, df in (("kw_rank", kw), ("vec_rank", vec), ("graph_rank", graph)):
        top = top.join(df.select("id", F.col("rank").alias(name)), "id", "left")
    return top.select("rank", F.col("id").alias("doc_id"), "score", "kw_rank", "vec_rank", "graph_rank").orderBy("rank")


_LINKS = "edges AS (SELECT 's' || source AS src, CAST(doc_id AS VARCHAR) AS dst FROM documents)"
_ASKED = ["and", "clown", "moron", "the"]

query(
    "hybrid_search_e2e",
    _pagerank_sql(5, _LINKS)
    + f""", ranks AS (SELECT TRY_CAST(id AS BIGINT) AS id, round(pr, 12) AS pagerank FROM r5 WHERE TRY_CAST(id AS BIGINT) IS NOT NULL),
      {_DOCS.replace("s AS (", "st AS (")}, {_bm25_sql(_ASKED).replace(", s GROUP", ", st GROUP")}, kw AS (SELECT row_number() OVER (ORDER BY round(raw, 6) DESC, doc_id) AS rank, doc_id AS id FROM b_ QUALIFY rank <= 40),
      {_embed_sql("SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1, 'the clown and the moron'")}, asked AS (SELECT place, v FROM parts WHERE id = -1),
      near AS (SELECT d.doc_id AS id, CASE WHEN count(p.place) = 0 THEN 1.0E0 ELSE 2 - 2 * coalesce(sum(p.v * a.v), 0) END AS distance FROM documents d LEFT JOIN parts p ON p.id = d.doc_id LEFT JOIN asked a USING (place) GROUP BY d.doc_id),
      vec AS (SELECT row_number() OVER (ORDER BY round(distance, 6), id) AS rank, id FROM near QUALIFY rank <= 40),
      graph AS (SELECT id, row_number() OVER (ORDER BY coalesce(pagerank, 0) DESC, rank) AS rank FROM kw LEFT JOIN ranks USING (id)),
      fused AS (SELECT id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT id, rank, 1.0E0 AS w FROM kw UNION ALL SELECT id, rank, 1.0E0 FROM vec UNION ALL SELECT id, rank, 0.5E0 FROM graph) GROUP BY id),
      listed AS (SELECT id, score, source, row_number() OVER (ORDER BY score DESC, source, id) AS rank FROM fused JOIN documents ON doc_id = id),
      spread AS (SELECT id, score, row_number() OVER (ORDER BY o, rank) AS rank FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY rank) > 3 THEN 1 ELSE 0 END AS o FROM listed))
      SELECT spread.rank, spread.id AS doc_id, score, kw.rank AS kw_rank, vec.rank AS vec_rank, graph.rank AS graph_rank
      FROM spread LEFT JOIN kw USING (id) LEFT JOIN vec USING (id) LEFT JOIN graph USING (id) WHERE spread.rank <= 10""".replace("b AS (SELECT p.doc_id", "b_ AS (SELECT p.doc_id"),
)(flagship)


@query(
    "explain_search",
    with_(SYMBOLS, SELECTIONS, f"x AS (WITH {_BASE} SELECT CAST(id AS VARCHAR) AS id, keyword_score, vector_score, base_score FROM base)")
    + f""", chosen AS (SELECT id, sum(1 / ln(position + 2) * exp(-0.1E0 * greatest(({NOW} - created_at) / 86400.0E0, 0))) AS c FROM selections GROUP BY id),
      h AS (SELECT x.*, name, kind, file_path, exported, language, CASE WHEN exported THEN 0.1E0 ELSE 0.0E0 END - CASE WHEN kind = 'module' THEN 5.0E0 ELSE 0.0E0 END AS structural_adjust, round(coalesce(c, 0) * 0.1E0, 6) AS learning_boost
            FROM x JOIN symbols USING (id) LEFT JOIN chosen USING (id)),
      r AS (SELECT id, round(keyword_score, 6) AS keyword_score, round(vector_score, 6) AS vector_score, round(base_score, 6) AS base_score, name, kind, file_path, exported, language, round(structural_adjust, 6) AS structural_adjust,
            1.0E0 AS intent_mult, 0.0E0 AS definition_bias, round(round(base_score + structural_adjust, 6) + learning_boost, 6) AS score, learning_boost FROM h)
      SELECT *, row_number() OVER (ORDER BY score DESC, exported DESC, name, file_path, kind, id) AS rank FROM r QUALIFY rank <= 20""",
)
def explain_search(spark, d):
    """Every signal of a weighted search, hit by hit."""
    kw, vec = _lists(spark, d)
    base = small(K.weighted(kw, vec).withColumn("id", F.col("id").cast("string")))
    hits = base.join(F.broadcast(base.select("id")), "id").join(symbols(spark, d).select("id", "name", "kind", "file_path", "exported", "language"), "id")
    hits = K.score_hits(hits, "the idiot moron", None)
    hits = K.selected(hits, K.selection_scores(selections(spark, d), None, F.lit(float(NOW))))
    shown = [F.round(c, 6).alias(c) if c in ("keyword_score", "vector_score", "base_score", "structural_adjust") else c for c in hits.columns]
    return K.with_rank(hits).filter("rank <= 20").select(*shown, "rank")


__all__ = ["flagship"]
