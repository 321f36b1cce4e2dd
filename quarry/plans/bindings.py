"""How the driver's tables stand in for the engine's relations, in Spark and in the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query, with the SQL that must give the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def symbols(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    n = F.col("n_chars")
    kind = F.when(n < 800, "const").when(n < 1500, "function").when(n < 3000, "class").when(n < 6000, "struct").otherwise("module")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat("source", F.lit("/"), "lang", F.lit("/f"), (F.col("doc_id") % 5).cast("string"), F.lit(".ts")).alias("file_path"),
        F.col("lang").alias("language"),
        kind.alias("kind"),
        F.regexp_extract("text", "[A-Za-z]+", 0).alias("name"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("exported"),
        F.col("doc_id").alias("start_byte"),
        F.col("n_chars").alias("n_chars"),
        "text",
    )


SYMBOLS = """symbols AS (
    SELECT CAST(d.doc_id AS VARCHAR) AS id, d.source || '/' || d.lang || '/f' || CAST(d.doc_id % 5 AS VARCHAR) || '.ts' AS file_path, d.lang AS language,
        CASE WHEN n_chars < 800 THEN 'const' WHEN n_chars < 1500 THEN 'function' WHEN n_chars < 3000 THEN 'class' WHEN n_chars < 6000 THEN 'struct' ELSE 'module' END AS kind,
        regexp_extract(d.text, '[A-Za-z]+', 0) AS name, coalesce(l.quality, 0) = 1 AS exported, d.doc_id AS start_byte, d.n_chars, d.text
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "call").when(F.col("l_returnflag") == "R", "reference").otherwise("extends")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("dst"), kind.alias("type"), "l_linestatus"
    )
    out = rows.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("evidence_count"), F.when(F.min("l_linestatus") == "F", "local").otherwise("import").alias("resolution"))
    sure = F.when(F.col("type") == "call", 1.0).when(F.col("type") == "reference", 0.8).otherwise(0.95)
    return out.withColumn("confidence", sure)


EDGES = """edges AS (
    SELECT src, dst, type, count(*) AS evidence_count, CASE WHEN min(s) = 'F' THEN 'local' ELSE 'import' END AS resolution,
        CASE WHEN type = 'call' THEN 1.0E0 WHEN type = 'reference' THEN 0.8E0 ELSE 0.95E0 END AS confidence
    FROM (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src, 'p' || CAST(l_suppkey AS VARCHAR) AS dst, l_linestatus AS s,
            CASE l_returnflag WHEN 'N' THEN 'call' WHEN 'R' THEN 'reference' ELSE 'extends' END AS type
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY src, dst, type)"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Containment: region, nation, customer, order; nation, supplier."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        table(spark, d, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"), F.lit("call").alias("type")),
        table(spark, d, "customer").select(key("n", "c_nationkey"), key("c", "c_custkey"), F.lit("call")),
        table(spark, d, "orders").select(key("c", "o_custkey"), key("o", "o_orderkey"), F.lit("reference")),
        table(spark, d, "supplier").select(key("n", "s_nationkey"), key("s", "s_suppkey"), F.lit("extends")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


TREE = """tree AS (
    SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS src, 'n' || CAST(n_nationkey AS VARCHAR) AS dst, 'call' AS type FROM nation
    UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR), 'call' FROM customer
    UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'o' || CAST(o_orderkey AS VARCHAR), 'reference' FROM orders
    UNION ALL SELECT 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR), 'extends' FROM supplier)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Cluster keys of the symbols that have a vector: the vector of their number, its label as key."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("k"), F.col("label").cast("string")).alias("cluster_key"))


CLUSTERS = "clusters AS (SELECT CAST(vec_id AS VARCHAR) AS id, 'k' || CAST(label AS VARCHAR) AS cluster_key FROM embeddings)"

#: The moment that feedback is scored at: 2024-02-01, in seconds.
NOW = 1706745600


def selections(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, d, "events").select(F.col("event_type").alias("query"), F.col("user_id").cast("string").alias("id"), (F.col("event_id") % 10).alias("position"), at.alias("created_at"))


SELECTIONS = "selections AS (SELECT event_type AS query, CAST(user_id AS VARCHAR) AS id, event_id % 10 AS position, floor(epoch(ts)) AS created_at FROM events)"


def affinity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    at = F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).cast("double").alias("last_accessed_at")
    counts = [F.count_if(F.col("event_type") == t).alias(n) for t, n in (("view", "view_count"), ("purchase", "edit_count"))]
    return e.groupBy(F.col("user_id").cast("string").alias("file_path")).agg(*counts, at)


AFFINITY = """affinity AS (SELECT CAST(user_id AS VARCHAR) AS file_path, count(*) FILTER (event_type = 'view') AS view_count,
    count(*) FILTER (event_type = 'purchase') AS edit_count, max(floor(epoch(ts))) AS last_accessed_at FROM events GROUP BY 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
