"""Queries: the smaller lookups, predicates, mutations and list operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.query import Controls
from ..operators import context as C
from ..operators import edges as E
from ..operators import ranking as K
from ..operators import relational as R
from ..operators import vector as V
from ..session import table
from ..sources import files as S
from .bindings import AFFINITY, EDGES, SELECTIONS, SYMBOLS, affinity, edges, query, selections, symbols, with_
from .search_queries import _HITS, _RANKED, _hits

_EXT = ["ts", "tsx", "rs", "py", "go", "java", "jsx", "hpp", "txt", "test.ts"]
_DIR = ["src", "lib/dist", "node_modules/x", "a/build", "distant"]
_PATHS = f"paths AS (SELECT page_id, [{', '.join(repr(x) for x in _DIR)}][CAST(page_id % 5 AS INTEGER) + 1] || '/f' || page_id || '.' || [{', '.join(repr(x) for x in _EXT)}][CAST(page_id % 10 AS INTEGER) + 1] AS path FROM pages)"


def _paths(spark, d):
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("page_id") % n).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(pick(_DIR, 5), F.lit("/f"), F.col("page_id").cast("string"), F.lit("."), pick(_EXT, 10)).alias("path"))


@query(
    "source_eligibility",
    with_(_PATHS)
    + """SELECT page_id, path, CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go'
        WHEN 'java' THEN 'java' WHEN 'jsx' THEN 'javascript' WHEN 'hpp' THEN 'cpp' END AS language,
        NOT (path LIKE '%.txt' OR path LIKE '%.test.%' OR path LIKE '%dist/%' OR path LIKE '%/build/%' OR path LIKE 'node_modules/%') AS eligible FROM paths""",
)
def source_eligibility(spark, d):
    p = _paths(spark, d)
    return p.select("page_id", "path", S.language(F.col("path")).alias("language"), F.coalesce(S.eligible(F.col("path")), F.lit(False)).alias("eligible"))


@query("test_file_predicates", with_(_PATHS) + "SELECT page_id, contains(path, '.test.') AS ranked, contains(path, '.test.') AS linked FROM paths")
def test_file_predicates(spark, d):
    return _paths(spark, d).select("page_id", T.is_ranked_test(F.col("path")).alias("ranked"), T.is_linked_test(F.col("path")).alias("linked"))


@query("path_match_filter", with_(_PATHS) + "SELECT page_id, path FROM paths WHERE starts_with(path, 'src/f1')")
def path_match_filter(spark, d):
    return _paths(spark, d).filter(T.path_matches(F.col("path"), "src/f1*"))


@query("path_ancestors", with_(_PATHS) + "SELECT page_id, path, '' AS dir FROM paths UNION ALL SELECT page_id, path, array_to_string(string_split(path, '/')[:n], '/') || '/' FROM paths, range(1, 9) r(n) WHERE n < len(string_split(path, '/'))")
def path_ancestors(spark, d):
    return _paths(spark, d).select("page_id", "path", F.explode(R.ancestors(F.col("path"))).alias("dir"))


@query("resolve_relative_path", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/b/m' || page_id || '.ts' WHEN 1 THEN 'a/m' || page_id || '.ts' WHEN 2 THEN 'a/b/c/m' || page_id || '.rs' END AS path FROM pages")
def resolve_relative_path(spark, d):
    n = F.col("page_id").cast("string")
    rel = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("./m"), n)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("../m"), n)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("./c/./m"), n, F.lit(".rs"))).otherwise(F.concat(F.lit("lib"), n))
    return table(spark, d, "pages").select("page_id", E.resolve_path(F.lit("a/b/x.ts"), rel).alias("path"))


@query("name_to_id", with_(SYMBOLS) + "SELECT name, id, file_path FROM symbols QUALIFY row_number() OVER (PARTITION BY name ORDER BY exported DESC, file_path, start_byte, id) = 1")
def name_to_id(spark, d):
    return E.names(symbols(spark, d))


_SIG = "substr(array_to_string(list_filter(list_transform(string_split(text, chr(10))[1:3], lambda x: trim(x)), lambda x: x <> ''), ' '), 1, 200)"


@query("signature_extract", f"SELECT doc_id, {_SIG} AS signature FROM documents")
def signature_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", T.signature(F.col("text")).alias("signature"))


@query("type_relations", r"""SELECT page_id, regexp_extract_all(t, 'extends[^\p{L}_$]*([\p{L}_$][\p{L}\p{N}_$]*)', 1)[1] AS extended, regexp_extract(t, '^[^=]*=[^\p{L}_$]*([\p{L}_$][\p{L}\p{N}_$]*)', 1) AS alias
      FROM (SELECT page_id, 'class A' || page_id || ' extends B' || page_id || ' { x = ' || html || '}' AS t FROM pages)""")
def type_relations(spark, d):
    t = F.concat(F.lit("class A"), F.col("page_id").cast("string"), F.lit(" extends B"), F.col("page_id").cast("string"), F.lit(" { x = "), "html", F.lit("}"))
    rel = table(spark, d, "pages").select("page_id", T.type_relations(t).alias("r"))
    return rel.select("page_id", F.get("r.extends", F.lit(0)).alias("extended"), F.get("r.aliases", F.lit(0)).alias("alias"))


@query("selection_counts", with_(SELECTIONS) + "SELECT id, count(*) AS n FROM selections GROUP BY id")
def selection_counts(spark, d):
    return R.counted(selections(spark, d), "id")


@query("recent_selections", with_(SELECTIONS) + "SELECT query, id, position, created_at FROM selections ORDER BY created_at DESC, id, query, position LIMIT 25")
def recent_selections(spark, d):
    return R.recent(selections(spark, d), 25)


@query("affinity_counters", with_(AFFINITY) + "SELECT file_path, view_count, edit_count FROM affinity")
def affinity_counters(spark, d):
    e = table(spark, d, "events").withColumn("file_path", F.col("user_id").cast("string"))
    return R.count_up(e, "file_path", {"view_count": "view", "edit_count": "purchase"}, "ts").select("file_path", "view_count", "edit_count")


@query("affinity_top_files", with_(AFFINITY) + "SELECT file_path, view_count + 2 * edit_count AS touched FROM affinity ORDER BY touched DESC, file_path LIMIT 10")
def affinity_top_files(spark, d):
    return R.most_touched(affinity(spark, d), 10)


@query("metric_lookup", with_(SYMBOLS, EDGES) + ", deg AS (SELECT src AS id, count(*) AS out_degree FROM edges GROUP BY src) SELECT c.c, coalesce(out_degree, 0) AS out_degree FROM (SELECT 'c' || c_custkey AS c FROM customer) c LEFT JOIN deg ON deg.id = c.c")
def metric_lookup(spark, d):
    deg = R.counted(edges(spark, d).withColumnRenamed("src", "id"), "id").withColumnRenamed("n", "out_degree")
    ids = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return R.metrics_of(ids, deg, ["out_degree"]).withColumnRenamed("id", "c")


@query("docstring_flags", with_(SYMBOLS) + "SELECT s.id, l.doc_id IS NOT NULL AS documented FROM symbols s LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = s.id")
def docstring_flags(spark, d):
    return R.documented(symbols(spark, d), table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")))


@query("control_filters", with_(_RANKED) + "SELECT id, rank FROM ranked WHERE lower(language) = 'en' AND kind IN ('class', 'struct') AND contains(file_path, 'src1') AND exported")
def control_filters(spark, d):
    c = Controls(lang="en", kind="class,struct", path="src1", kinds=["class", "struct"])
    return K.controlled(K.with_rank(_hits(spark, d)), c, exported_only=True).select("id", "rank")


@query("definition_bias", with_(_HITS) + "SELECT id, CASE WHEN kind = 'variable' THEN 0.0E0 WHEN lower(name) = 'the' THEN 10.0E0 WHEN contains(lower(name), 'the') THEN 1.0E0 ELSE 0.0E0 END AS bias FROM hits")
def definition_bias(spark, d):
    return _hits(spark, d).select("id", K.definition_bias("The").alias("bias"))


@query("stable_dedupe", with_(_RANKED) + "SELECT id, min(rank) AS rank FROM (SELECT id, rank FROM ranked UNION ALL SELECT id, rank + 1000 FROM ranked) GROUP BY id")
def stable_dedupe(spark, d):
    h = K.with_rank(_hits(spark, d))
    return K.unique(h.unionByName(h.withColumn("rank", F.col("rank") + 1000))).select("id", "rank")


@query("context_order", with_(_RANKED) + "SELECT id, CASE WHEN rank <= 10 THEN 0 WHEN rank <= 20 THEN 1 ELSE 2 END AS tier FROM ranked WHERE rank <= 30")
def context_order(spark, d):
    h = K.with_rank(_hits(spark, d))
    upto = lambda a, b: h.filter((F.col("rank") > a) & (F.col("rank") <= b))
    return C.ordered(upto(0, 10), upto(5, 20), upto(0, 30)).select("id", "tier")


@query("context_role_caps", with_(_RANKED) + """, r AS (SELECT id, rank, CASE WHEN rank <= 20 THEN 0 ELSE 2 END AS tier, kind FROM ranked WHERE rank <= 50)
      SELECT id, tier FROM r QUALIFY row_number() OVER (PARTITION BY tier, kind ORDER BY rank) <= CASE WHEN tier = 0 THEN 2 ELSE 1 END""")
def context_role_caps(spark, d):
    h = K.with_rank(_hits(spark, d)).filter("rank <= 50").withColumn("tier", F.when(F.col("rank") <= 20, 0).otherwise(2))
    return C.capped_roles(h, "kind").select("id", "tier")


@query("context_budget_by_role", r"""WITH t AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS tokens FROM documents),
      r AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM t) SELECT doc_id, lang, tokens, total FROM r WHERE total - tokens < 4096""")
def context_budget_by_role(spark, d):
    items = table(spark, d, "documents").select("doc_id", "lang", T.token_count(F.col("text")).cast("long").alias("tokens"))
    return C.within_budget(items, 4096, ["doc_id"], by=["lang"]).select("doc_id", "lang", "tokens", "total")


@query("insert_new_rows", "SELECT doc_id, lang FROM documents")
def insert_new_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return R.insert_new(docs.filter("doc_id % 2 = 0"), docs, ["doc_id"])


@query("symbol_tests_join", with_(SYMBOLS) + "SELECT s.id, s.name, s.file_path FROM symbols s WHERE s.file_path IN (SELECT file_path FROM symbols WHERE start_byte % 9 = 0) AND starts_with(s.file_path, 'src1/') ORDER BY name, id LIMIT 50")
def symbol_tests_join(spark, d):
    s = symbols(spark, d)
    links = s.filter("start_byte % 9 = 0").select(F.col("file_path").alias("test_file_path")).distinct()
    hit = s.join(links, F.col("file_path") == F.col("test_file_path")).filter(F.col("file_path").startswith("src1/"))
    return hit.select("id", "name", "file_path").orderBy("name", "id").limit(50)


@query("cluster_keys_shared", "SELECT label AS cluster_key, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY label HAVING count(*) > 1")
def cluster_keys_shared(spark, d):
    return R.shared_clusters(table(spark, d, "embeddings").select(F.col("label").alias("cluster_key"), F.col("vec_id").alias("id")))


@query("embedding_cache_trim", "SELECT vec_id FROM embeddings WHERE vec_id > (SELECT quantile_disc(vec_id, 0.1) FROM embeddings)")
def embedding_cache_trim(spark, d):
    cache = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("vec_id").alias("last_accessed_at"))
    return V.trim_cache(cache, 1000).select("vec_id")
