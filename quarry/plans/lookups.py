"""Queries: relational lookups, mutations, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..session import table
from .bindings import CLUSTERS, EDGES, SYMBOLS, clusters, edges, query, symbols, with_

HEAD = ["id", "name", "kind", "file_path", "exported"]
_HEAD = "id, name, kind, file_path, exported"


@query("symbol_point_lookup", with_(SYMBOLS) + f"SELECT {_HEAD} FROM symbols WHERE id IN ('7', '42', '99')")
def symbol_point_lookup(spark, d):
    return R.by_id(symbols(spark, d), ["7", "42", "99"]).select(*HEAD)


@query("symbol_exact_name", with_(SYMBOLS) + f"SELECT {_HEAD} FROM symbols WHERE name = 'The' ORDER BY exported DESC, file_path, start_byte, id LIMIT 10")
def symbol_exact_name(spark, d):
    return R.named(symbols(spark, d), "The").select(*HEAD)


@query("file_symbols_header", with_(SYMBOLS) + f"SELECT {_HEAD} FROM symbols WHERE file_path = 'src3/en/f3.ts' AND exported")
def file_symbols_header(spark, d):
    return R.in_file(symbols(spark, d), "src3/en/f3.ts", exported_only=True).select(*HEAD)


@query("file_symbols_full", with_(SYMBOLS) + f"SELECT {_HEAD}, text FROM symbols WHERE file_path = 'src3/en/f3.ts'")
def file_symbols_full(spark, d):
    return R.in_file(symbols(spark, d), "src3/en/f3.ts").select(*HEAD, "text")


@query("substring_search", with_(SYMBOLS) + f"SELECT {_HEAD} FROM symbols WHERE contains(text, 'idiot') ORDER BY exported DESC, file_path, start_byte, id LIMIT 50")
def substring_search(spark, d):
    return R.containing(symbols(spark, d), "idiot").select(*HEAD)


@query("name_substring_search", with_(SYMBOLS) + f"SELECT {_HEAD} FROM symbols WHERE contains(name, 'ha') ORDER BY exported DESC, file_path, start_byte, id LIMIT 50")
def name_substring_search(spark, d):
    return R.containing(symbols(spark, d), "ha", "name").select(*HEAD)


@query("prefix_search", with_(SYMBOLS) + f"SELECT {_HEAD} FROM symbols WHERE starts_with(lower(name), 'th') ORDER BY exported DESC, file_path, start_byte, id LIMIT 50")
def prefix_search(spark, d):
    return R.prefixed(symbols(spark, d), "Th").select(*HEAD)


@query("dynamic_filter_search", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE starts_with(lower(p_brand), 'brand#1') AND p_size IN (5, 10, 15, 20)")
def dynamic_filter_search(spark, d):
    hit = R.matching(table(spark, d, "part"), p_brand__prefix="Brand#1", p_size__in=[5, 10, 15, 20], p_name__contains=None)
    return hit.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("kind_counts", with_(SYMBOLS) + "SELECT kind, count(*) AS n, count(*) FILTER (exported) AS n_exported FROM symbols GROUP BY kind")
def kind_counts(spark, d):
    return R.kinds(symbols(spark, d))


@query("index_stats", with_(SYMBOLS, EDGES) + "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT file_path) FROM symbols) AS files")
def index_stats(spark, d):
    return R.index_counts(symbols(spark, d), edges(spark, d))


@query("latest_run", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_run(spark, d):
    return R.latest(table(spark, d, "events"), ["ts", "event_id"]).select("event_id", "event_type")


@query("cache_stats", "SELECT count(*) AS entries, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes FROM embeddings")
def cache_stats(spark, d):
    return R.cache_size(table(spark, d, "embeddings"))


@query(
    "file_summary",
    with_(SYMBOLS)
    + """SELECT file_path, count(*) AS n, round(count(*) FILTER (exported) / count(*), 6) AS export_ratio,
        concat_ws(' | ', CASE WHEN count(*) FILTER (exported) / count(*) > 0.8 THEN 'module' WHEN count(*) FILTER (exported) > 0 THEN 'mixed-exports' ELSE 'internal' END,
          CASE WHEN count(*) FILTER (kind IN ('interface', 'type')) > 0 THEN 'type-defs' END, CASE WHEN count(*) FILTER (kind IN ('function', 'method')) > 0 THEN 'functions' END,
          CASE WHEN count(*) FILTER (kind = 'class') > 0 THEN 'classes' END) AS purpose
      FROM symbols GROUP BY file_path""",
)
def file_summary(spark, d):
    return R.summaries(symbols(spark, d))


@query(
    "module_summary_grouped",
    with_(SYMBOLS)
    + """SELECT file_path, kind, count(*) AS n, min(name) AS first_name,
        min(substr(array_to_string(list_filter(list_transform(string_split(text, chr(10))[1:3], lambda x: trim(x)), lambda x: x <> ''), ' '), 1, 200)) AS least_signature
      FROM symbols WHERE exported GROUP BY file_path, kind""",
)
def module_summary_grouped(spark, d):
    return R.signatures(symbols(spark, d))


@query(
    "edge_upsert_merge",
    """WITH r AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src, 's' || CAST(l_suppkey AS VARCHAR) AS dst, l_returnflag AS type,
        CASE WHEN l_linenumber > 1 THEN l_linestatus END AS at_file, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS at_line, l_discount AS confidence,
        CAST(l_quantity AS BIGINT) AS evidence_count, CASE l_linenumber % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'import' WHEN 2 THEN 'heuristic' ELSE 'unknown' END AS resolution,
        (l_orderkey * 10 + l_linenumber) * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      k AS (SELECT *, CASE resolution WHEN 'local' THEN 3 WHEN 'import' THEN 2 WHEN 'heuristic' THEN 1 ELSE 0 END AS rk FROM r)
      SELECT src, dst, type, arg_min(at_file, seq) FILTER (at_file IS NOT NULL) AS at_file, arg_min(at_line, seq) FILTER (at_line IS NOT NULL) AS at_line,
        max(confidence) AS confidence, max(evidence_count) AS evidence_count, arg_max(resolution, rk * 1000000000000000000 - seq) AS resolution, max(rk) AS resolution_rank
      FROM k GROUP BY src, dst, type""",
)
def edge_upsert_merge(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    n = F.col("l_linenumber")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.col("l_returnflag").alias("type"),
        F.when(n > 1, F.col("l_linestatus")).alias("at_file"),
        F.when(n > 2, n).alias("at_line"),
        F.col("l_discount").alias("confidence"),
        F.col("l_quantity").cast("long").alias("evidence_count"),
        F.when(n % 4 == 0, "local").when(n % 4 == 1, "import").when(n % 4 == 2, "heuristic").otherwise("unknown").alias("resolution"),
        ((F.col("l_orderkey") * 10 + n) * F.lit(10_000_000_000) + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("seq"),
    )
    return R.merge_edges(rows)


@query(
    "evidence_top3",
    """WITH e AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src, 's' || CAST(l_suppkey AS VARCHAR) AS dst, l_returnflag AS type, l_linestatus AS at_file, l_linenumber AS at_line, count(*) AS count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
      SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, dst, type ORDER BY count DESC, at_file, at_line) <= 3""",
)
def evidence_top3(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("at_file"), F.col("l_linenumber").alias("at_line"),
    )
    return R.top_evidence(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("count")))


@query("unclustered_symbols", with_(SYMBOLS, CLUSTERS) + f"SELECT {_HEAD} FROM symbols WHERE id NOT IN (SELECT id FROM clusters) ORDER BY start_byte DESC, id LIMIT 1000")
def unclustered_symbols(spark, d):
    return R.unclustered(symbols(spark, d), clusters(spark, d), newest="start_byte").select(*HEAD)


@query("cluster_members", with_(SYMBOLS, CLUSTERS) + f"SELECT {_HEAD} FROM symbols WHERE id IN (SELECT id FROM clusters WHERE cluster_key = 'k3') ORDER BY name, file_path, kind, id LIMIT 20")
def cluster_members(spark, d):
    return R.in_cluster(symbols(spark, d), clusters(spark, d), "k3").select(*HEAD)


@query("orphan_edge_drop", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def orphan_edge_drop(spark, d):
    kept = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return R.cascade(kept, table(spark, d, "labels"), ["doc_id"])


@query("edges_from_capped", with_(EDGES) + "SELECT src, dst, type FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY type, dst) <= 5")
def edges_from_capped(spark, d):
    e = edges(spark, d)
    return R.first_per(e, ["src"], ["type", "dst"], 5).select("src", "dst", "type")


@query(
    "upsert_latest",
    """WITH old AS (SELECT user_id, event_id, event_type FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
      new AS (SELECT user_id, event_id, event_type FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
      SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT * FROM new""",
)
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    old = R.first_per(e.filter("event_id % 2 = 0"), ["user_id"], [F.desc("event_id")], 1)
    return R.upsert(old, e.filter("event_id % 2 = 1 AND user_id % 3 = 0"), ["user_id"], "event_id")


@query("delete_by_file", with_(SYMBOLS) + "SELECT id, file_path FROM symbols WHERE file_path NOT LIKE 'src1/%'")
def delete_by_file(spark, d):
    s = symbols(spark, d).select("id", "file_path")
    gone = s.filter(F.col("file_path").startswith("src1/")).select("file_path")
    return R.delete_files({"symbols": s}, gone)["symbols"]


@query(
    "longest_prefix_package",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', '') AS file_path FROM pages),
      r AS (SELECT DISTINCT regexp_extract(file_path, '^[^/]+', 0) AS root FROM p UNION SELECT DISTINCT regexp_extract(file_path, '^[^/]+/[^/]+', 0) FROM p WHERE page_id % 3 = 0),
      m AS (SELECT page_id, file_path, root FROM p JOIN r ON root <> '' AND starts_with(file_path, root || '/') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(root) DESC) = 1)
      SELECT p.page_id, p.file_path, m.root AS root_path FROM p LEFT JOIN m USING (page_id)""",
)
def longest_prefix_package(spark, d):
    pages = table(spark, d, "pages")
    files = pages.select("page_id", F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/$", "").alias("file_path"))
    roots = files.select(F.regexp_extract("file_path", "^[^/]+", 0).alias("root")).union(files.filter("page_id % 3 = 0").select(F.regexp_extract("file_path", "^[^/]+/[^/]+", 0)))
    roots = roots.distinct().filter("root <> ''").withColumn("id", F.col("root"))
    return R.longest_prefix(files, roots).select("page_id", "file_path", "root_path")


@query(
    "test_source_links",
    r"""WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'src/a' || page_id || '.test.ts' WHEN 1 THEN 'src/b' || page_id || '_test.rs' WHEN 2 THEN 'pkg/tests/c' || page_id || '.py'
        WHEN 3 THEN 'pkg/__tests__/d' || page_id || '.js' WHEN 4 THEN 'x/e' || page_id || '.spec.ts' ELSE 'src/plain' || page_id || '.ts' END AS test FROM pages)
      SELECT page_id, test, CASE page_id % 6 WHEN 0 THEN 'src/a' || page_id || '.ts' WHEN 1 THEN 'src/b' || page_id || '.rs' WHEN 2 THEN 'pkg/c' || page_id || '.py'
        WHEN 3 THEN 'pkg/d' || page_id || '.js' WHEN 4 THEN 'x/e' || page_id || '.ts' END AS source, page_id % 6 <> 5 AS is_test FROM f""",
)
def test_source_links(spark, d):
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 6
    shape = [("src/a", ".test.ts"), ("src/b", "_test.rs"), ("pkg/tests/c", ".py"), ("pkg/__tests__/d", ".js"), ("x/e", ".spec.ts")]
    path = F.concat(F.lit("src/plain"), n, F.lit(".ts"))
    for j, (a, b) in enumerate(shape):
        path = F.when(k == j, F.concat(F.lit(a), n, F.lit(b))).otherwise(path)
    rows = table(spark, d, "pages").select("page_id", path.alias("test"))
    return rows.select("page_id", "test", T.tested_source(F.col("test")).alias("source"), T.is_linked_test(F.col("test")).alias("is_test"))


@query(
    "incremental_diff",
    """WITH a AS (SELECT doc_id, n_chars FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 7 <> 0
        UNION ALL SELECT doc_id + 1000000, n_chars FROM documents WHERE doc_id % 13 = 0)
      SELECT CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.n_chars <> b.n_chars THEN 'changed' ELSE 'unchanged' END AS state, count(*) AS n
      FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1""",
)
def incremental_diff(spark, d):
    from ..streaming.watch import compare

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_path"), F.col("n_chars").alias("size_bytes"))
    moved = F.when(F.col("file_path") % 11 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    now = docs.filter("file_path % 7 <> 0").withColumn("size_bytes", moved).union(docs.filter("file_path % 13 = 0").withColumn("file_path", F.col("file_path") + 1000000))
    return compare(docs, now, ["size_bytes"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


