"""Building and refreshing the tables of a workspace."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .extract import run as extraction
from .functions import text as T
from .operators import edges as E
from .operators import graph as G
from .operators import vector as V
from .operators.cut import cut
from .operators.fulltext import Index, gram_index
from .plugins import HASH, Embedder
from .sources import files as S
from .sources import manifests as M
from .streaming.watch import compare, counters

#: Tables that a refresh leaves as they are.
KEPT = ("query_selections", "search_runs", "index_runs", "user_file_affinity")
#: Bytes of cached embeddings, and files that a refresh opens one by one.
CACHE_BYTES, MOST_PATHS = 1 << 30, 10_000
#: Tables whose rows belong to a file and are refreshed with it.
BY_FILE = ("symbols", "imports", "types", "flows", "todos", "docstrings", "decorators", "framework_patterns")


@dataclass
class Store:
    """The tables of a workspace. ``facts`` are extracted per file; the rest is derived from them."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    embedder: Embedder = HASH

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables and name in schema.TABLES:
            return schema.empty(self.spark, name)
        return self.tables[name]

    def save(self, path: str) -> Store:
        """Writes every table below a path and returns the store that reads them; derived tables are
        then computed once."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
        return Store.load(self.spark, path, list(self.tables), self.embedder)

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: list[str], embedder: Embedder = HASH) -> Store:
        return cls(spark, {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}, embedder)

    def index(self) -> Index:
        return Index(self["postings"], self["lengths"])

    def grams(self) -> Index:
        return Index(self["gram_postings"], self["gram_lengths"])


def facts(files: DataFrame) -> dict[str, DataFrame]:
    """Extracted tables of files (file_path, language, text)."""
    return extraction.tables(cut(extraction.extract_files(files)))


def _texts(symbols: DataFrame) -> DataFrame:
    """What is indexed of symbols: (id, name, text, own)."""
    text = T.index_text(F.col("text"), F.col("name"), F.col("file_path"))
    return symbols.select("id", "name", text.alias("text"), F.concat_ws(" ", "name", "text").alias("own"))


def _searchable(store: Store | None, symbols: DataFrame, stale: DataFrame | None, embedder: Embedder) -> dict[str, DataFrame]:
    """Postings, vectors and the embedding cache. With a store, rows of ``stale`` ids go and only
    ``symbols`` are analyzed; texts that the cache knows are not embedded again."""
    texts, fields = _texts(symbols), {"name": T.tokens(F.col("name")), "text": T.tokens(F.col("text"))}
    words, grams = Index.build(texts, "id", fields), gram_index(texts, "id", fields)
    spark = symbols.sparkSession
    cache = schema.empty(spark, "embedding_cache") if store is None else store["embedding_cache"]
    found, new = V.embed_cached(texts, cache.select("cache_key", "embedding"), embedder.name, lambda c: embedder.column(c).cast("array<float>"), "own")
    new = cut(new.dropDuplicates(["cache_key"]))
    now = F.unix_timestamp()
    rows = new.select(
        "cache_key", F.lit(embedder.name).alias("model_name"), F.lit(None).cast("string").alias("text_hash"), "embedding", F.size("embedding").alias("vector_dim"),
        now.alias("created_at"), now.alias("last_accessed_at"), F.lit(1).cast("long").alias("access_count"),
    )
    out = {
        "postings": words.postings, "lengths": words.lengths, "gram_postings": grams.postings.drop("positions"), "gram_lengths": grams.lengths,
        "vectors": V.checked(found.select("id", F.col("embedding").cast("array<double>").alias("vector")), embedder.dim),
    }
    if store is not None:
        gone = {"vectors": "id"}
        for name, t in out.items():
            key = gone.get(name, "doc")
            kept = store[name].join(stale.select(F.col("id").alias(key)), key, "left_anti")
            out[name] = kept.unionByName(t.select(*kept.columns))
    out["embedding_cache"] = V.trim_cache(cache.unionByName(rows), CACHE_BYTES)
    out["similarity_clusters"] = out["vectors"].select("id", V.cluster_key(F.col("vector")).alias("cluster_key"))
    return out


def derive(spark: SparkSession, base: dict[str, DataFrame], packages: DataFrame | None = None, embedder: Embedder = HASH, rounds: int = 20, store: Store | None = None, stale: DataFrame | None = None, fresh: DataFrame | None = None) -> Store:
    """The store of extracted tables: edges, evidence, usages, tests, ranks, postings, vectors. With the
    ``store`` of before, postings and vectors of ``stale`` ids go and those of ``fresh`` symbols come; edges
    and ranks are derived anew, as a changed file may be the end of any other's."""
    symbols = base["symbols"]
    real = symbols.filter("kind <> 'file'")
    imports = cut(E.resolve_imports(base["imports"], real))
    found = E.candidates(real, base["types"].select("file_path", "parent", "type"), base["flows"].select("file_path", "owner", "target", "flow"))
    owners = M.of_files(symbols.select("file_path"), packages) if packages is not None else None
    named = cut(E.build(real, found, imports, owners))
    edges, evidence = E.with_evidence(named, real)
    edges, evidence = cut(edges), cut(evidence)
    ranks = G.pagerank(symbols, edges, rounds).join(G.degrees(symbols, edges), "id", "right").fillna(0.0, ["pagerank"])
    tests = symbols.select("file_path").distinct().filter(T.is_linked_test(F.col("file_path")))
    links = tests.select(F.col("file_path").alias("test_file_path"), T.tested_source(F.col("file_path")).alias("source_file_path"), F.lit("bidirectional").alias("link_direction")).filter("source_file_path IS NOT NULL")
    if store is not None and ("vectors" not in store.tables or V.migrated(store["vectors"], embedder.dim)[1]):
        store = None  # vectors of another dimension: everything is embedded anew
    searched = _searchable(None, real, None, embedder) if store is None else _searchable(store, fresh.filter("kind <> 'file'"), stale, embedder)
    tables = dict(base) | searched | {
        "resolved_imports": imports,
        "edges": edges,
        "edge_evidence": evidence,
        "usage_examples": E.usage_examples(named, real, imports),
        "symbol_metrics": ranks,
        "test_links": links,
        "symbol_packages": real.select("id", "file_path").join(owners, "file_path", "left").select("id", "package") if owners is not None else real.select("id", F.lit(None).cast("string").alias("package")),
    }
    if packages is not None:
        tables["packages"] = packages
    return Store(spark, tables, embedder)


def workspaces(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(packages with their repository, repositories) of all roots."""
    held = cut(M.read(spark, roots, roots[0]).unionByName(M.enclosing(spark, roots[0])))
    repositories = cut(M.repositories(held))
    return cut(M.in_repositories(M.packages(M.discover(held)), repositories)), repositories


def build(spark: SparkSession, roots: list[str], excluded: Iterable[str] = (), embedder: Embedder = HASH) -> Store:
    """The store of source trees."""
    files = cut(S.scan(spark, roots, excluded=excluded))
    packages, repositories = workspaces(spark, roots)
    store = derive(spark, facts(files), packages, embedder)
    store.tables["repositories"] = repositories
    store.tables["file_fingerprints"] = files.select("file_path", "mtime_ns", "size_bytes")
    return store


def _changed(spark: SparkSession, roots: list[str], files: DataFrame) -> DataFrame:
    """Sources (with text) of the listed files; few are opened by path, many by a scan of the roots."""
    paths = [r.path for r in files.select("path").limit(MOST_PATHS + 1).collect()]
    if len(paths) <= MOST_PATHS and not any(set(p) & set("*?[]{}\\") for p in paths):
        return S.scan(spark, roots, paths=paths) if paths else S.scan(spark, roots).limit(0)
    return S.scan(spark, roots).join(files.select("file_path"), "file_path", "left_semi")


def refresh(store: Store, roots: list[str], files: list[str] | None = None, excluded: Iterable[str] = ()) -> tuple[Store, dict[str, int]]:
    """The store after changes to the trees, and what changed. Only new and changed files are read,
    extracted, analyzed and embedded; without any change the store stays as it is. ``files``: paths to look
    at, files or directories; others keep their state. Feedback, run history and the embedding cache are
    carried over, manifests are read again."""
    spark = store.spark
    before, now = store["file_fingerprints"], S.scan(spark, roots, content=False, excluded=excluded)
    looked = (before, now) if files is None else (S.only(before, files), S.only(now, files))
    now = cut(looked[1])
    changes = cut(compare(looked[0], now))
    done = counters(changes)
    packages, repositories = workspaces(spark, roots)
    moved = packages.select("id", "name", "root").exceptAll(store["packages"].select("id", "name", "root")).isEmpty() if "packages" in store.tables else False
    if not done["indexed"] and not done["deleted"] and moved:
        return Store(spark, dict(store.tables), store.embedder), done
    todo = cut(now.join(changes.filter(F.col("state").isin("new", "changed")).select("file_path"), "file_path", "left_semi"))
    gone = changes.filter(F.col("state").isin("deleted", "changed")).select("file_path")
    fresh = {n: cut(t) if n == "symbols" else t for n, t in facts(_changed(spark, roots, todo)).items()}
    stale = cut(store["symbols"].join(gone, "file_path", "left_semi").select("id").unionByName(fresh["symbols"].select("id")).distinct())
    base = {n: store[n].join(gone, "file_path", "left_anti").unionByName(fresh[n].select(*store[n].columns)) for n in BY_FILE}
    out = derive(spark, base, packages, store.embedder, store=store, stale=stale, fresh=fresh["symbols"])
    rest = looked[0].select("file_path")
    out.tables["file_fingerprints"] = before.join(rest, "file_path", "left_anti").unionByName(now.select("file_path", "mtime_ns", "size_bytes"))
    out.tables["repositories"] = repositories
    out.tables.update({n: store[n] for n in KEPT if n in store.tables})
    return out, done
