"""Lookups and mutations over the metadata tables.

Lookups are filters, joins and top-k that Catalyst pushes to the scan. A mutation returns the new table:
the caller writes it, by partition where the table is partitioned by file.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.lexicon import RESOLUTION_RANK
from .graph import _lookup

HEADER = ["id", "name", "kind", "file_path", "exported"]


def by_id(symbols: DataFrame, ids: Iterable) -> DataFrame:
    return symbols.filter(F.col("id").isin(*ids))


def named(symbols: DataFrame, name: str, file: str | None = None, limit: int = 10) -> DataFrame:
    """Exact name; exported first, then by file and start."""
    hit = symbols.filter(F.col("name") == name)
    hit = hit if file is None else hit.filter(F.col("file_path") == file)
    return hit.orderBy(F.desc("exported"), "file_path", "start_byte", "id").limit(limit)


def containing(symbols: DataFrame, needle: str, column: str = "text", limit: int = 50) -> DataFrame:
    hit = symbols.filter(F.contains(F.col(column), F.lit(needle)))
    return hit.orderBy(F.desc("exported"), "file_path", "start_byte", "id").limit(limit)


def prefixed(symbols: DataFrame, prefix: str, column: str = "name", limit: int = 50) -> DataFrame:
    """Names that begin so, whatever their letter case."""
    hit = symbols.filter(F.lower(column).startswith(prefix.lower()))
    return hit.orderBy(F.desc("exported"), "file_path", "start_byte", "id").limit(limit)


def in_file(symbols: DataFrame, path: str, exported_only: bool = False) -> DataFrame:
    hit = symbols.filter(F.col("file_path") == path)
    return (hit.filter("exported") if exported_only else hit).orderBy("start_byte", "id")


def first_per(df: DataFrame, key: list[str], by: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    return rows.filter(F.col("_n") <= n).drop("_n")


def edges_of(edges: DataFrame, ids: DataFrame, side: str = "src", limit: int = 200) -> DataFrame:
    """Edges of each id, by type and other end, up to a limit each."""
    other = "dst" if side == "src" else "src"
    hit = edges.join(ids.select(F.col(ids.columns[0]).alias(side)).distinct(), side)
    return first_per(hit, [side], ["type", other], limit)


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Filters composed of what is asked for: column=value, column__prefix, column__contains (both
    without regard to letter case), column__upper, column__in; None asks for nothing."""
    for key, v in wanted.items():
        if v is None:
            continue
        c, _, how = key.partition("__")
        col = F.col(c)
        p = {"": lambda: col == v, "prefix": lambda: F.lower(col).startswith(v.lower()), "contains": lambda: F.contains(F.lower(col), F.lit(v.lower())),
             "upper": lambda: F.upper(col) == v.upper(), "in": lambda: col.isin(*v)}[how]()
        df = df.filter(p)
    return df


def latest(df: DataFrame, by: list[str]) -> DataFrame:
    """The one latest row."""
    return df.orderBy(*[F.desc(c) for c in by]).limit(1)


def unclustered(symbols: DataFrame, clusters: DataFrame, limit: int = 1000, newest: str = "updated_at") -> DataFrame:
    return symbols.join(clusters.select("id"), "id", "left_anti").orderBy(F.desc(newest), "id").limit(limit)


def in_cluster(symbols: DataFrame, clusters: DataFrame, key: str, limit: int = 20) -> DataFrame:
    hit = clusters.filter(F.col("cluster_key") == key).select("id")
    return symbols.join(hit, "id").orderBy("name", "file_path", "kind", "id").limit(limit)


def ancestors(path: Column) -> Column:
    """All directories of a path, the longest last, each with its closing slash; '' for the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def longest_prefix(files: DataFrame, roots: DataFrame, path: str = "file_path", root: str = "root", key: str = "id") -> DataFrame:
    """Files with the root (and its key) that is their longest enclosing directory, or nulls.

    Each path is exploded into its directories and joined on equality: no range or nested-loop join, and
    no directory matches as the beginning of another's name.
    """
    r = roots.select(F.when(F.col(root) == "", "").when(F.col(root).endswith("/"), F.col(root)).otherwise(F.concat(F.col(root), F.lit("/"))).alias("_dir"), F.col(key).alias("_key"), F.col(root).alias("_root"))
    near = files.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias("_dir")).join(r, "_dir")
    best = near.groupBy(path).agg(F.max_by(F.struct("_key", "_root"), F.struct(F.length("_dir"), "_key")).alias("_b"))
    return files.join(best, path, "left").withColumn("root_key", F.col("_b._key")).withColumn("root_path", F.col("_b._root")).drop("_b")


# Counts, listings and summaries.


def counted(df: DataFrame, key: str) -> DataFrame:
    """(key, n): rows of each key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def recent(selections: DataFrame, limit: int = 25) -> DataFrame:
    """The last selections, the newest first."""
    return selections.orderBy(F.desc("created_at"), "id", "query", "position").limit(limit)


def most_touched(affinity: DataFrame, limit: int = 10) -> DataFrame:
    """(file_path, touched): files by views and twice their edits."""
    touched = (F.col("view_count") + 2 * F.col("edit_count")).alias("touched")
    return affinity.select("file_path", touched).orderBy(F.desc("touched"), "file_path").limit(limit)


def metrics_of(ids: DataFrame, metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Metrics of ids, 0 where there are none."""
    return ids.select("id").join(metrics.select("id", *columns), "id", "left").fillna(0, columns)


def documented(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, documented): whether each symbol has documentation."""
    has = docs.select("id").distinct().withColumn("documented", F.lit(True))
    return symbols.select("id").join(has, "id", "left").fillna(False, ["documented"])


def shared_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster_key, n, first_id) of the keys that several symbols have."""
    rows = clusters.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return rows.filter("n > 1")


def cache_size(cache: DataFrame) -> DataFrame:
    """(entries, bytes) of an embedding cache."""
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0)).cast("long").alias("bytes"))


def kinds(symbols: DataFrame) -> DataFrame:
    """(kind, n, n_exported)."""
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("exported").alias("n_exported"))


def index_counts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbols, edges, files): one row."""
    s = symbols.agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file_path").alias("files"))
    return s.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).select("symbols", "edges", "files")  # one row each


def last_updated(symbols: DataFrame, column: str = "updated_at"):
    """When a symbol was last written, or None."""
    return symbols.agg(F.max(column)).first()[0] if column in symbols.columns else None


def summaries(symbols: DataFrame) -> DataFrame:
    """(file_path, n, export_ratio, purpose) of each file. The purpose names how much is exported, then
    whether there are types, functions and classes."""
    n, exported = F.count(F.lit(1)), F.count_if("exported")
    has = lambda *kinds: F.count_if(F.col("kind").isin(*kinds)) > 0
    share = F.when(exported / n > 0.8, "module").when(exported > 0, "mixed-exports").otherwise("internal")
    tags = [share, F.when(has("interface", "type"), "type-defs"), F.when(has("function", "method"), "functions"), F.when(has("class"), "classes")]
    return symbols.groupBy("file_path").agg(n.alias("n"), F.round(exported / n, 6).alias("export_ratio"), F.concat_ws(" | ", *tags).alias("purpose"))


def signatures(symbols: DataFrame) -> DataFrame:
    """(file_path, kind, n, first_name, least_signature) of what files export, by kind."""
    rows = symbols.filter("exported").withColumn("sig", T.signature(F.col("text")))
    return rows.groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"), F.min("sig").alias("least_signature"))


def similar_paths(files: DataFrame, path: str, limit: int = 5) -> DataFrame:
    """(file_path): known files that are named like one that is not there."""
    name = path.rpartition("/")[2].lower()
    hit = files.select("file_path").distinct().withColumn("_d", F.levenshtein(F.lower(F.element_at(F.split("file_path", "/"), -1)), F.lit(name)))
    return hit.filter(F.col("_d") <= max(2, len(name) // 3)).orderBy("_d", "file_path").limit(limit).select("file_path")


# Mutations: each returns the table as it is afterwards.


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """Rows replace those of the same key; of several new rows the last by ``order_by``."""
    if order_by is not None:
        rows = first_per(rows, keys, [F.desc(order_by)], 1)
    else:
        rows = rows.dropDuplicates(keys)
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def merge_edges(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per (src, dst, type): the first location known, the greatest confidence and evidence, and
    the resolution of the highest rank, the first of equals."""
    rank = _lookup(F.col("resolution"), {k: float(v) for k, v in RESOLUTION_RANK.items()}, 0.0).cast("int")
    r = rows.withColumn("_rank", rank)
    return r.groupBy("src", "dst", "type").agg(
        F.min_by("at_file", F.when(F.col("at_file").isNotNull(), F.col(seq))).alias("at_file"),
        F.min_by("at_line", F.when(F.col("at_line").isNotNull(), F.col(seq))).alias("at_line"),
        F.max("confidence").alias("confidence"),
        F.max("evidence_count").alias("evidence_count"),
        F.max_by("resolution", F.struct("_rank", -F.col(seq))).alias("resolution"),
        F.max("_rank").alias("resolution_rank"),
    )


def merge_evidence(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src", "dst", "type", "at_file", "at_line").agg(F.max("count").alias("count"))


def top_evidence(evidence: DataFrame, n: int = 3) -> DataFrame:
    return first_per(evidence, ["src", "dst", "type"], [F.desc("count"), "at_file", "at_line"], n)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new are added."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def delete_files(tables: dict[str, DataFrame], files: DataFrame, column: str = "file_path") -> dict[str, DataFrame]:
    """Every table without the rows of the files."""
    gone = files.select(F.col(files.columns[0]).alias(column)).distinct()
    return {k: t.join(gone, column, "left_anti") if column in t.columns else t for k, t in tables.items()}


def cascade(symbols: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose symbols all exist still."""
    for c in columns:
        table = table.join(symbols.select(F.col("id").alias(c)), c, "left_semi")
    return table


def count_up(events: DataFrame, key: str, kinds: dict[str, str], at: str) -> DataFrame:
    """Counters from an event log: one column per kind of event, and the time of the last."""
    sums = [F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()]
    return events.groupBy(key).agg(*sums, F.max(at).alias("last_accessed_at"))
