"""The requests that a workspace answers. Each returns a DataFrame, or plain values for one thing."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import index
from .functions import text as T
from .index import Store
from .metrics import Metrics
from .operators import graph as G
from .operators import ranking as K
from .operators import relational as R
from .operators import vector as V
from .operators.context import render
from .operators.cut import cut
from .plugins import HASH, Embedder
from .search import Answer, Settings, assemble, search
from .sources.files import normalise, scan
from .streaming import watch as W


#: Answers kept for repeated searches.
ANSWERS = 64
#: Rows appended to a table between two cuts of its lineage.
APPENDS = 16


class Workspace:
    """A store and the requests over it."""

    def __init__(self, store: Store, roots: list[str] | None = None, settings: Settings | None = None, excluded: list[str] | None = None):
        self.store, self.roots, self.settings, self.excluded = store, roots or [], settings or Settings(), excluded or []
        self._answers: OrderedDict[tuple, Answer] = OrderedDict()
        self._appended: dict[str, int] = {}
        self.metrics = Metrics()

    # Search.

    def search_code(self, query: str, limit: int = 5, exported_only: bool = False) -> Answer:
        key, began = (query, limit, exported_only, repr(self.settings)), time.time()
        if key in self._answers:  # until the index or the feedback changes
            self._answers.move_to_end(key)
            return self._answers[key]
        out = self._answers[key] = search(self.store, query, limit, exported_only, self.settings)
        while len(self._answers) > ANSWERS:
            self._answers.popitem(last=False)
        self.metrics.count("searches")
        self.metrics.observe("search", time.time() - began)
        self._append("search_runs", {"started_at": int(began), "duration_ms": int(1000 * (time.time() - began)), "query": query, "query_limit": limit, "exported_only": exported_only})
        return out

    def explain_search(self, query: str, limit: int = 10, exported_only: bool = False, verbose: bool = True) -> DataFrame:
        """Hits with every signal that made their score, or only those that changed some score."""
        hits = search(self.store, query, limit, exported_only, self.settings, context=False).hits
        if verbose:
            return hits
        rows = hits.collect()  # at most ``limit`` rows
        idle = [c for c in hits.columns if c.endswith("_boost") and not any(r[c] for r in rows)]
        return hits.drop(*idle)

    def hydrate_symbols(self, ids: list[str], mode: str = "default"):
        return assemble(self.store, ids, self.settings.budget, full=mode == "full")

    def report_selection(self, query: str, selected_symbol_id: str, position: int, now: int | None = None) -> None:
        q = query.strip().lower()
        self._answers.clear()
        self._append("query_selections", {"query": q, "query_normalized": q, "id": selected_symbol_id, "position": position, "created_at": now if now is not None else int(time.time())})

    def _append(self, name: str, row: dict) -> None:
        t = self.store[name]
        new = self.store.spark.createDataFrame([tuple(row.get(c) for c in t.columns)], t.schema)
        self._appended[name] = self._appended.get(name, 0) + 1
        both = t.unionByName(new)
        self.store.tables[name] = cut(both) if self._appended[name] % APPENDS == 0 else both

    # Definitions and references.

    def _roots(self, name: str, file: str | None = None, limit: int = 20) -> DataFrame:
        return R.named(self.store["symbols"].filter("kind <> 'file'"), name, file and self._path(file), limit)

    def _root(self, name: str, file: str | None = None) -> DataFrame:
        return self._roots(name, file, 1).select("id")

    def _path(self, path: str) -> str:
        return normalise(path, self.roots[0]) if self.roots else path

    def get_definition(self, symbol_name: str, file: str | None = None, limit: int = 10) -> DataFrame:
        return self._roots(symbol_name, file, limit)

    def show_definition(self, symbol_name: str, file: str | None = None, limit: int = 10) -> str:
        """Definitions of a name, examples of their use and what they lead to, as Markdown."""
        ids = [r.id for r in self._roots(symbol_name, file, limit).select("id").collect()]  # at most ``limit``
        return render(assemble(self.store, ids, self.settings.budget))

    def find_references(self, symbol_name: str, file: str | None = None, reference_type: str = "all", limit: int = 200) -> DataFrame:
        types = None if reference_type == "all" else [reference_type]
        hits = G.references(self.store["edges"], self._roots(symbol_name, file).select("id"), types, limit)
        who = self.store["symbols"].select(F.col("id").alias("src"), "name", "kind", "file_path", "start_line")
        return hits.join(who, "src")

    def similar_paths(self, file_path: str) -> DataFrame:
        """Files named like one that is not indexed."""
        return R.similar_paths(self.store["symbols"].filter("kind = 'file'"), self._path(file_path))

    def get_file_symbols(self, file_path: str, exported_only: bool = False) -> DataFrame:
        return R.in_file(self.store["symbols"].filter("kind <> 'file'"), self._path(file_path), exported_only).drop("text")

    def get_usage_examples(self, symbol_name: str, limit: int = 20) -> DataFrame:
        """Stored examples; for a symbol without any, its incoming edges."""
        roots = self._roots(symbol_name).select(F.col("id").alias("to_id"))
        stored = self.store["usage_examples"].join(roots, "to_id")
        bare = roots.join(stored.select("to_id"), "to_id", "left_anti")
        e = self.store["edges"].filter(F.col("type").isin("call", "import", "reference")).withColumnRenamed("dst", "to_id").join(bare, "to_id")
        texts = self.store["symbols"].select(F.col("id").alias("src"), "file_path", F.col("start_line").cast("long").alias("line"), "text")
        lines = e.join(texts, "src").select("to_id", "type", "file_path", "line", T.usage_line(F.col("text"), F.lit(symbol_name)).alias("snippet"), F.col("src").alias("from_id"))
        return stored.select(*lines.columns).unionByName(lines).orderBy("type", "file_path", "line").limit(limit)

    # Graph.

    def _walk(self, edges: DataFrame) -> DataFrame:
        """Edges of a walk with the names of both ends and their best evidence."""
        s = self.store["symbols"]
        out = edges
        for end in ("src", "dst"):
            out = out.join(s.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"), F.col("file_path").alias(f"{end}_file")), end)
        top = R.top_evidence(self.store["edge_evidence"].select("src", "dst", "type", F.lit("").alias("at_file"), "at_line", "count"))
        lines = top.groupBy("src", "dst", "type").agg(F.array_sort(F.collect_list("at_line")).alias("lines"))
        return out.join(lines, ["src", "dst", "type"], "left")

    def get_call_hierarchy(self, symbol_name: str, direction: str = "callees", depth: int = 2, limit: int = 200) -> DataFrame:
        return self._walk(G.call_hierarchy(self.store["edges"], self._root(symbol_name), direction, depth, limit))

    def get_type_graph(self, symbol_name: str, depth: int = 2, limit: int = 200) -> DataFrame:
        return self._walk(G.type_graph(self.store["edges"], self._root(symbol_name), depth, limit))

    def explore_dependency_graph(self, symbol_name: str, direction: str = "downstream", depth: int = 2, limit: int = 200) -> DataFrame:
        return self._walk(G.dependencies(self.store["edges"], self._root(symbol_name), direction, depth, limit))

    def trace_data_flow(self, symbol_name: str, file_path: str | None = None, direction: str = "both", depth: int = 3, limit: int = 50) -> DataFrame:
        flows = G.data_flow(self.store["edges"], self._root(symbol_name, file_path), depth, None)
        if direction in ("reads", "writes"):
            flows = flows.filter(F.col("flow") == direction.rstrip("s"))
        names = self.store["symbols"].select("id", "name", "kind", "file_path")
        return flows.join(names, "id").orderBy("depth", "id").limit(limit)

    def find_affected_code(self, symbol_name: str, file_path: str | None = None, depth: int = 3, limit: int = 100, include_tests: bool = False) -> DataFrame:
        tests = None if include_tests else T.is_linked_test(F.col("file_path"))
        return G.affected(self.store["edges"], self.store["symbols"], self._root(symbol_name, file_path), depth, limit, tests)

    # Similarity.

    def get_similarity_cluster(self, symbol_name: str, limit: int = 20) -> DataFrame:
        root, clusters = self._root(symbol_name), self.store["similarity_clusters"]
        key = clusters.join(root, "id").select("cluster_key")
        members = clusters.join(key, "cluster_key").join(root, "id", "left_anti").select("id", "cluster_key")
        return members.join(self.store["symbols"].select("id", "name", "kind", "file_path"), "id").orderBy("name", "file_path", "kind", "id").limit(limit)

    def find_similar_code(self, symbol_name: str | None = None, code_snippet: str | None = None, file_path: str | None = None, limit: int = 20, threshold: float = 0.5, include_self: bool = False) -> DataFrame:
        own = None
        if symbol_name is not None:
            row = self._root(symbol_name, file_path).head()
            if row is None:
                raise KeyError(symbol_name)
            own, query = row.id, V.vector_of(self.store["vectors"], row.id)
        else:
            query = self.store.embedder.one(code_snippet or "")
        hits = V.similar(self.store["vectors"], query, limit, threshold, None if include_self else own)
        names = self.store["symbols"].select("id", "name", "kind", "file_path", "exported")
        joined = hits.join(names, "id")
        return joined.orderBy(*K.order(joined, "similarity"))

    # Summaries.

    def summarize_file(self, file_path: str, include_signatures: bool = True, verbose: bool = False) -> DataFrame:
        """Symbols of a file by kind: count, exported, the file's purpose, signatures of what is exported
        (with ``verbose`` of all)."""
        rows = R.in_file(self.store["symbols"].filter("kind <> 'file'"), self._path(file_path))
        sig = F.array_sort(F.collect_list(F.when(F.col("exported") | F.lit(verbose), T.signature(F.col("text"), 1, 100)))).alias("signatures")
        counts = [F.count(F.lit(1)).alias("n"), F.count_if("exported").alias("exported")]
        by_kind = rows.groupBy("file_path", "kind").agg(*counts, *([sig] if include_signatures else []))
        return by_kind.join(R.summaries(rows).select("file_path", "purpose"), "file_path").drop("file_path").orderBy("kind")

    def render_summary(self, file_path: str) -> str:
        """The summary of a file as Markdown."""
        rows = self.summarize_file(file_path).collect()  # a row per kind
        if not rows:
            return f"No indexed symbols found for `{file_path}`."
        out = [f"## {file_path}", "", f"**Purpose:** {rows[0].purpose}", f"**Exports:** {sum(r.exported for r in rows)} of {sum(r.n for r in rows)} symbols", ""]
        for r in rows:
            out += [f"### {r.kind} ({r.n})", *(f"- `{s}`" for s in r.signatures)]
        return "\n".join(out)

    def get_module_summary(self, file_path: str, group_by_kind: bool = True) -> DataFrame:
        rows = R.in_file(self.store["symbols"].filter("kind <> 'file'"), self._path(file_path), True).select("kind", "name", T.signature(F.col("text")).alias("signature"), "start_line")
        return rows.orderBy(*(["kind"] if group_by_kind else []), "start_line", "name")

    # Annotations.

    def search_todos(self, query: str | None = None, file_path: str | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
        hit = R.matching(self.store["todos"], text__contains=query, file_path=file_path and self._path(file_path), kind=kind and kind.lower())
        return hit.orderBy("file_path", "line").limit(limit)

    def find_tests_for_symbol(self, symbol_name: str, file_path: str | None = None, limit: int = 20) -> DataFrame:
        files = self._roots(symbol_name, file_path).select(F.col("file_path").alias("source_file_path")).distinct()
        tests = self.store["test_links"].join(files, "source_file_path").select(F.col("test_file_path").alias("file_path")).distinct()
        return self.store["symbols"].filter("kind <> 'file'").join(tests, "file_path").select("id", "name", "kind", "file_path", "start_line").orderBy("name", "id").limit(limit)

    def search_decorators(self, name: str | None = None, decorator_type: str | None = None, limit: int = 50) -> DataFrame:
        hit = R.matching(self.store["decorators"].drop("file_path"), name__prefix=name, decorator_type=decorator_type)
        named = hit.withColumnRenamed("name", "decorator").join(self.store["symbols"].select("id", "name", "file_path"), "id")
        return named.orderBy("file_path", "target_line", "decorator").limit(min(max(limit, 1), 500))

    def search_framework_patterns(self, framework: str | None = None, kind: str | None = None, http_method: str | None = None, path: str | None = None, limit: int = 50) -> DataFrame:
        hit = R.matching(self.store["framework_patterns"], framework=framework, kind=kind, http_method__upper=http_method, path__contains=path)
        return hit.orderBy("file_path", "line").limit(min(max(limit, 1), 500))

    # The index.

    def refresh_index(self, files: Iterable[str] | None = None) -> dict[str, int]:
        some = None if files is None else [self._path(f) for f in files]  # rejects paths outside the workspace
        began = time.time()
        self._answers.clear()
        self.store, done = index.refresh(self.store, self.roots, some, self.excluded)
        row = {"started_at": int(began), "duration_ms": int(1000 * (time.time() - began)), "files_scanned": done["scanned"], "files_indexed": done["indexed"], "files_unchanged": done["unchanged"], "files_deleted": done["deleted"]}
        self.metrics.observe("index", time.time() - began)
        self._append("index_runs", row)
        return done

    def watch(self, rounds: int, interval: float = 0.25, least: float = 5.0, **kw) -> list[dict[str, int]]:
        """Looks for changes so many times and refreshes after each, at most every ``least`` seconds; a
        failed refresh is tried again. Returns what each refresh did."""
        return W.watch(lambda: cut(scan(self.store.spark, self.roots, content=False, excluded=self.excluded)), lambda _: self.refresh_index(), rounds, interval, least, **kw)

    def follow_selections(self, folder: str, checkpoint: str) -> None:
        """Takes up the selections that arrive in a folder as JSON lines, each file once."""
        schema = self.store["query_selections"].schema.simpleString()[len("struct<") : -1].replace(":", " ")

        def each(rows: DataFrame, _: int) -> None:
            q = F.lower(F.trim("query"))
            new = cut(rows.withColumn("query", q).withColumn("query_normalized", q))
            self.store.tables["query_selections"] = self.store["query_selections"].unionByName(new)
            self._answers.clear()

        W.arrivals(self.store.spark, folder, schema, each, checkpoint).awaitTermination()

    def clear(self) -> None:
        """Empties every table."""
        self._answers.clear()
        self.store.tables = {name: t.limit(0) for name, t in self.store.tables.items()}

    def get_index_stats(self) -> dict:
        s, e = self.store["symbols"], self.store["edges"]
        last = R.latest(self.store["index_runs"], ["started_at"]).head()
        of = lambda name, key: {r[key]: r.n for r in R.counted(self.store[name], key).collect()}
        return {
            "symbols": s.filter("kind <> 'file'").count(), "files": s.filter("kind = 'file'").count(), "edges": e.count(), "last_run": last.asDict() if last else None,
            "last_updated": R.last_updated(self.store["file_fingerprints"], "mtime_ns"), "todos": of("todos", "kind"), "packages": of("packages", "repository_id"),
        }

    def list_packages(self, repository_id: str | None = None) -> DataFrame:
        return R.matching(self.store["packages"], repository_id=repository_id).orderBy("manifest_path")

    def list_repositories(self) -> DataFrame:
        return self.store["repositories"].orderBy("root_path")


def open_workspace(spark, roots: list[str], settings: Settings | None = None, embedder: Embedder = HASH, excluded: Iterable[str] = ()) -> Workspace:
    """Indexes source trees, but for what the globs ``excluded`` match, and opens them."""
    return Workspace(index.build(spark, roots, excluded, embedder), roots, settings, list(excluded))
