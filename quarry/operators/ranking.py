"""Fusion, ranking signals and diversification of hit lists.

A list is a DataFrame with an explicit rank from 1; a hit has id, score, name, kind, file_path, exported
and language. Signals are kept as columns of their own, so that a ranking explains itself. Lists are at
most a few hundred rows by the time they come here; the tables they are joined with are not, and are read
through those joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.lexicon import DEFINITION_KINDS, RESOLUTION_PULL
from .graph import _lookup, boost

ORDER = ("exported", "name", "file_path", "kind", "id")


def order(df: DataFrame, score: str = "score") -> list[Column]:
    """Score descending, exported first, then name, file, kind, id: whatever of these there is."""
    out = [F.desc(score)]
    for c in ORDER:
        if c in df.columns:
            out.append(F.desc(c) if c == "exported" else F.asc(c))
    return out


def with_rank(df: DataFrame, score: str = "score", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order(df, score))).cast("long"))


def rrf(lists: list[tuple[DataFrame, float]], k: int = 60, id_col: str = "id") -> DataFrame:
    """(id, score): reciprocal rank fusion, each list a frame with ``id_col`` and rank, and its weight.
    An id that a list holds twice counts twice."""
    rows = None
    for df, w in lists:
        part = df.select(F.col(id_col).alias("id"), (F.lit(float(w)) / (k + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.round(F.sum("s"), 9).alias("score"))


def graph_list(keyword: DataFrame, ranks: DataFrame) -> DataFrame:
    """The keyword list again, by PageRank descending; ties and unknown ids in keyword order."""
    joined = keyword.join(ranks.select("id", "pagerank"), "id", "left").fillna(0.0, ["pagerank"])
    return joined.withColumn("graph_rank", F.row_number().over(Window.orderBy(F.desc("pagerank"), "rank")).cast("long")).drop("rank").withColumnRenamed("graph_rank", "rank")


def weighted(keyword: DataFrame, vector: DataFrame, keyword_weight: float = 0.3, vector_weight: float = 0.7) -> DataFrame:
    """(id, keyword_score, vector_score, base_score): keyword (id, score) and vector (id, distance)
    lists, each divided by its best, with weights that sum to 1."""
    total = keyword_weight + vector_weight
    kw, vw = (keyword_weight / total, vector_weight / total) if total > 0 else (0.5, 0.5)
    best = Window.partitionBy()
    k = keyword.select("id", "score").withColumn("top", F.max("score").over(best))
    k = k.select("id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("keyword_score"))
    v = vector.select("id", (1 / (1 + F.greatest(F.coalesce("distance", F.lit(1.0)), F.lit(0.0)))).alias("sim"))
    v = v.withColumn("top", F.max("sim").over(best)).select("id", (F.col("sim") / F.col("top")).alias("vector_score"))
    both = k.join(v, "id", "full_outer").fillna(0.0, ["keyword_score", "vector_score"])
    return both.withColumn("base_score", F.lit(vw) * F.col("vector_score") + F.lit(kw) * F.col("keyword_score"))


# Parts of paths that push a hit down or up.
_AWAY = ("/node_modules/", "/target/", "/dist/", "/build/", "/vendor/", "/generated/", "/gen/", ".min.")
_HOME = ("/src/", "/lib/", "/app/", "/packages/")


def _any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def structural(query: str, exported_boost: float = 0.1) -> Column:
    """What kind, path and export say about a hit, and 2 for each query word that a path segment meets."""
    path, low = F.col("file_path"), F.lower("file_path")
    out = F.when(F.col("exported"), exported_boost).otherwise(0.0)
    out = out - F.when(F.col("kind") == "module", 5.0).otherwise(0.0)
    out = out - F.when(path.endswith("index.ts") | path.endswith("index.tsx"), 5.0).otherwise(0.0)
    out = out - F.when(_any(low, _AWAY), 15.0).otherwise(0.0) + F.when(_any(low, _HOME), 1.0).otherwise(0.0)
    parts = F.split(low, "/")
    for term in [t.lower() for t in query.split() if len(t) > 2]:
        t = F.lit(term)
        meets = lambda p, t=t: (F.regexp_replace(p, r"\.[^.]*$", "") == t) | F.startswith(p, t) | F.startswith(t, p)
        out = out + F.when(F.exists(parts, _one(meets)), 2.0).otherwise(0.0)
    return out


def _one(f: Callable) -> Callable[[Column], Column]:
    return lambda x: f(x)


# Per intent, factors by parts of the path, then by kind, then for all others.
_BY_INTENT: dict[str, tuple[list[tuple[tuple[str, ...], float]], list[tuple[tuple[str, ...], float]], float]] = {
    "schema": ([(("schema",), 75.0), (("model", "entity", "entities"), 50.0), (("db/", "database/", "migrations/", "sql/"), 25.0)], [], 0.5),
    "implementation": ([], [(("function", "method", "impl"), 1.5), (("class", "struct", "trait"), 1.3)], 1.0),
    "config": ([(("config", "settings", ".env", "options"), 3.0)], [(("const", "variable"), 1.5)], 0.8),
    "error": ([(("error", "exception"), 3.0)], [(("class", "enum", "type_alias"), 1.3)], 1.0),
    "api": ([(("handler", "route", "controller", "endpoint", "api"), 3.0), (("server", "service"), 1.5)], [], 0.8),
    "hook": ([(("hook", "use"), 2.0)], [(("function",), 1.3)], 1.0),
    "middleware": ([(("middleware", "interceptor", "guard"), 3.0), (("plugin",), 1.5)], [], 0.8),
    "migration": ([(("migration", "migrate"), 5.0), (("schema", "sql"), 2.0)], [], 0.5),
}


def intent_factor(intent: str | None) -> Column:
    """Factor of a hit under an intent; tests weigh little unless they are asked for."""
    test, low, kind = T.is_ranked_test(F.col("file_path")), F.lower("file_path"), F.col("kind")
    if intent == "test":
        return F.when(test, 2.0).otherwise(0.5)
    out = F.when(test, 0.3)
    if intent == "definition":
        defines = kind.isin("class", "interface", "type_alias", "struct", "enum", "const")
        return out.when(defines & F.col("exported"), 1.5).otherwise(1.0)
    paths, kinds, other = _BY_INTENT.get(intent or "", ([], [], 1.0))
    for parts, f in paths:
        out = out.when(_any(low, parts), f)
    for names, f in kinds:
        out = out.when(kind.isin(*names), f)
    return out.otherwise(other)


def definition_bias(query: str, intent: str | None = None) -> Column:
    """10 for a definition of the very name that a query of one or two words gives, 1 for one whose name
    contains it."""
    q = query.strip().lower()
    if intent == "callers" or not q or len(q.split()) > 2:
        return F.lit(0.0)
    name, defines = F.lower("name"), F.col("kind").isin(*DEFINITION_KINDS)
    return F.when(defines & name.isin(q, q.replace(" ", "")), 10.0).when(defines & F.contains(name, F.lit(q)), 1.0).otherwise(0.0)


def score_hits(hits: DataFrame, query: str, intent: str | None = None) -> DataFrame:
    """Hits with base_score get structural_adjust, intent_mult, definition_bias and their score."""
    out = hits.withColumn("structural_adjust", structural(query)).withColumn("intent_mult", intent_factor(intent)).withColumn("definition_bias", definition_bias(query, intent))
    return out.withColumn("score", F.round((F.col("base_score") + F.col("structural_adjust")) * F.col("intent_mult") + F.col("definition_bias"), 6))


def _added(hits: DataFrame, name: str, amount: Column) -> DataFrame:
    return hits.withColumn(name, F.round(amount, 6)).withColumn("score", F.round(F.col("score") + F.col(name), 6))


def popularity(hits: DataFrame, metrics: DataFrame, weight: float = 0.05) -> DataFrame:
    """Adds weight times PageRank over the best of the hits."""
    j = hits.join(metrics.select("id", "pagerank"), "id", "left").withColumn("top", F.max("pagerank").over(Window.partitionBy()))
    return _added(j, "popularity_boost", F.when(F.col("top") > 0, F.coalesce("pagerank", F.lit(0.0)) / F.col("top") * weight).otherwise(0.0)).drop("pagerank", "top")


def docstrings(hits: DataFrame, docs: DataFrame, factor: float = 1.5) -> DataFrame:
    """Multiplies the scores of documented hits. ``docs`` has their ids."""
    j = hits.join(docs.select("id").distinct().withColumn("_d", F.lit(True)), "id", "left")
    return _added(j, "docstring_boost", F.when(F.col("_d"), F.col("score") * (factor - 1)).otherwise(0.0)).drop("_d")


def selection_scores(selections: DataFrame, query: str | None, now: Column, rate: float = 0.1) -> DataFrame:
    """(id, selections): sum over chosen results of 1 / ln(position + 2), fading by the day. Columns:
    query, id, position, created_at (seconds); ``now`` in seconds."""
    s = selections if query is None else selections.filter(F.col("query") == query)
    age = F.greatest((now - F.col("created_at")) / 86400.0, F.lit(0.0))
    return s.groupBy("id").agg(F.sum(1 / F.log(F.col("position") + 2.0) * F.exp(-rate * age)).alias("selections"))


def affinity_scores(affinity: DataFrame, now: Column, rate: float = 0.05) -> DataFrame:
    """(file_path, affinity): views and twice the edits, fading by the day."""
    age = F.greatest((now - F.col("last_accessed_at")) / 86400.0, F.lit(0.0))
    return affinity.select("file_path", ((F.col("view_count") + 2 * F.col("edit_count")) * F.exp(-rate * age)).alias("affinity"))


def selected(hits: DataFrame, scores: DataFrame, weight: float = 0.1) -> DataFrame:
    j = hits.join(scores, "id", "left")
    return _added(j, "learning_boost", F.coalesce("selections", F.lit(0.0)) * weight).drop("selections")


def familiar(hits: DataFrame, scores: DataFrame, weight: float = 0.05) -> DataFrame:
    j = hits.join(scores, "file_path", "left").withColumn("top", F.max("affinity").over(Window.partitionBy()))
    return _added(j, "affinity_boost", F.when(F.col("top") > 0, F.coalesce("affinity", F.lit(0.0)) / F.col("top") * weight).otherwise(0.0)).drop("affinity", "top")


def package_factor(intent: str | None) -> float:
    return {"definition": 1.2, "implementation": 1.2, "callers": 1.2, "error": 1.1}.get(intent or "definition", 1.15)


def same_package(hits: DataFrame, packages: DataFrame, intent: str | None = None, package: str | None = None) -> DataFrame:
    """Multiplies hits of the context package: the one named, or the top hit's. ``packages``: (id,
    package) of the hits."""
    j = hits.join(packages.select("id", "package"), "id", "left")
    if package is None:
        top = F.first("package").over(Window.orderBy(*order(hits)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        j = j.withColumn("_context", top)
    else:
        j = j.withColumn("_context", F.lit(package))
    return _added(j, "package_boost", F.when(F.col("package") == F.col("_context"), F.col("score") * (package_factor(intent) - 1)).otherwise(0.0)).drop("_context", "package")


def unique(hits: DataFrame) -> DataFrame:
    """The first of each id by rank."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).filter("_n = 1").drop("_n")


def controlled(hits: DataFrame, controls, exported_only: bool = False) -> DataFrame:
    """Hits that a query's controls let through."""
    if controls.lang:
        hits = hits.filter(F.lower("language") == controls.lang)
    if controls.kinds:
        hits = hits.filter(F.lower("kind").isin(*controls.kinds))
    if controls.path:
        hits = hits.filter(F.contains(F.col("file_path"), F.lit(controls.path)))
    if controls.file:
        hits = hits.filter(T.path_matches(F.col("file_path"), controls.file))
    return hits.filter("exported") if exported_only else hits


def capped(hits: DataFrame, group: str, most: int, limit: int) -> DataFrame:
    """At most ``most`` hits of a group first, the others after them, by rank; null groups are free."""
    n = F.row_number().over(Window.partitionBy(group).orderBy("rank"))
    over = F.when(F.col(group).isNull(), False).otherwise(n > most)
    rows = hits.withColumn("_over", over).orderBy("_over", "rank").limit(limit)
    again = F.row_number().over(Window.orderBy("_over", "rank")).cast("long")
    return rows.withColumn("_new", again).drop("rank", "_over").withColumnRenamed("_new", "rank")


def by_cluster(hits: DataFrame, limit: int, most: int = 2) -> DataFrame:
    return capped(hits, "cluster_key", most, limit)


def by_file(hits: DataFrame, limit: int) -> DataFrame:
    return capped(hits, "file_path", max(limit // 3, 2), limit)


def by_kind(hits: DataFrame, limit: int) -> DataFrame:
    """If more than ``limit``: the best definition, the best other and the best test first, then all
    else by rank."""
    cls = F.when(T.is_diverse_test(F.col("file_path")), 2).when(F.col("kind").isin(*DEFINITION_KINDS), 0).otherwise(1)
    rows = hits.withColumn("_cls", cls).withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy()))
    first = F.row_number().over(Window.partitionBy("_cls").orderBy("rank")) == 1
    lead = F.when(F.col("_total") <= limit, 3).when(first, F.col("_cls")).otherwise(3)
    rows = rows.withColumn("_lead", lead).orderBy("_lead", "rank").limit(limit)
    return rows.withColumn("_new", F.row_number().over(Window.orderBy("_lead", "rank")).cast("long")).drop("rank", "_cls", "_total", "_lead").withColumnRenamed("_new", "rank")


def neighbours(hits: DataFrame, edges: DataFrame, symbols: DataFrame, limit: int, top: int = 3, each: int = 5) -> DataFrame:
    """The hits and what the first of them lead to: callees of functions, what refers to types. Score:
    0.8 of the hit's, times confidence, evidence and resolution; the best ``limit`` stay."""
    lead = with_rank(hits, name="_r").filter(F.col("_r") <= top).select(F.col("id").alias("_hit"), "kind", F.col("score").alias("_s"))
    is_type = F.col("kind").isin("class", "interface", "struct", "trait", "enum", "type_alias")
    out = edges.join(F.broadcast(lead.filter(~is_type)), F.col("src") == F.col("_hit")).filter(F.col("type") == "call").withColumn("_to", F.col("dst"))
    back = edges.join(F.broadcast(lead.filter(is_type)), F.col("dst") == F.col("_hit")).filter(F.col("type").isin("reference", "type", "extends", "implements", "alias")).withColumn("_to", F.col("src"))
    w = Window.partitionBy("_hit").orderBy("type", "_to")
    near = out.unionByName(back).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= each)
    score = F.col("_s") * 0.8 * F.col("confidence") * boost(F.col("evidence_count")) * _lookup(F.col("resolution"), RESOLUTION_PULL, 0.8)
    more = near.groupBy(F.col("_to").alias("id")).agg(F.round(F.max(score), 6).alias("score")).join(hits.select("id"), "id", "left_anti")
    cols = ["id", "score", "name", "kind", "file_path", "exported", "language"]
    more = more.join(symbols.select("id", "name", "kind", "file_path", "exported", "language"), "id").select(*cols)
    both = hits.select(*cols).unionByName(more)
    return with_rank(both.orderBy(*order(both)).limit(limit))


def rerank(hits: DataFrame, query: str, texts: DataFrame, scorer: Callable[[str, str], float] | None = None, top: int = 20, weight: float = 0.3, judged_before: dict | None = None) -> DataFrame:
    """Blends 0.7 of the score with 3 times a reader's judgement (0 to 1) of the first hits' texts, of
    three hits and more. The default judge is the share of query words that a text holds. A scorer reads
    a pair of query and text once: ``judged_before`` keeps what it said."""
    judged = with_rank(hits, name="_r")
    if judged.limit(3).count() < 3:
        return judged.drop("_r").withColumn("rerank_score", F.lit(None).cast("double"))
    first = judged.filter(F.col("_r") <= top).join(texts.select("id", F.substring("text", 1, 400).alias("_t")), "id", "left")
    if scorer is None:
        words = sorted(set(query.lower().split()))
        held = F.array_distinct(T.plain_tokens(F.coalesce("_t", F.lit(""))))
        s = F.size(F.array_intersect(held, F.array(*map(F.lit, words)))) / F.lit(max(1, len(words)))
        scored = first.withColumn("rerank_score", s)
    else:
        known, rows = judged_before if judged_before is not None else {}, []
        for r in first.select("id", "_t").collect():  # at most ``top`` rows
            text = r._t or ""
            if (query, text) not in known:
                known[query, text] = float(scorer(query, text))
            rows.append((r.id, known[query, text]))
        scored = hits.sparkSession.createDataFrame(rows, hits.select("id").schema.add("rerank_score", "double"))
    out = judged.join(scored.select("id", "rerank_score"), "id", "left")
    blend = (1 - weight) * F.col("score") + weight * 10 * F.col("rerank_score")
    return out.withColumn("score", F.round(F.when(F.col("rerank_score").isNull(), F.col("score")).otherwise(blend), 6)).drop("_r")


