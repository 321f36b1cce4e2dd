"""Hybrid search over a store: understanding, retrieval, fusion, signals, diversity, neighbours, context."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import query as Q
from .functions import text as T
from .index import Store
from .operators import context as C
from .operators import fulltext as FT
from .operators import graph as G
from .operators import ranking as K
from .operators import relational as R
from .operators import vector as V
from .operators.cut import small

HIT = ["id", "name", "kind", "file_path", "exported", "language"]


@dataclass
class Settings:
    mode: str = "rrf"  # or "weighted": scores, structure and intent instead of ranks
    keyword_weight: float = 0.3
    vector_weight: float = 0.7
    rrf_k: int = 60
    rrf_weights: tuple[float, float, float] = (1.0, 1.0, 0.5)
    vector_limit: int = 20
    budget: int = 8192
    synonyms: bool = True
    acronyms: bool = True
    learning: bool = True
    write_code: object = None  # callback of hypothetical code: (query, language) -> str
    scorer: object = None  # callback of a reranker: (query, text) -> 0..1
    rerank: bool = False
    counter: object = C.count_tokens  # callback that counts a text's model tokens: str -> int
    now: float | None = None  # seconds that feedback is aged to; the clock if not given
    judged: dict = field(default_factory=dict)  # what the scorer said of pairs of query and text


@dataclass
class Answer:
    query: str
    intent: str | None
    hits: DataFrame
    context: str = ""
    items: list[C.Item] = field(default_factory=list)


def _keyword(store: Store, text: str, k: int) -> DataFrame:
    words = [w for w in text.lower().split() if w]
    hits = FT.search_partial(store.index(), store.grams(), " ".join(words), k, analyze=T.code_words, digits=6).drop("tier")
    return small(hits.withColumnRenamed("doc", "id"))


def _vectors(store: Store, text: str, k: int, settings: Settings) -> DataFrame:
    near = V.knn(store["vectors"], store.embedder.one(text), k)
    made = Q.hypothetical(text, settings.write_code) if settings.write_code else None
    if made:
        more = V.knn(store["vectors"], store.embedder.one(made), max(1, k // 2))
        near = near.unionByName(more.withColumn("rank", F.col("rank") + k))
    return small(near)


def candidates(store: Store, asked: str, limit: int, settings: Settings) -> tuple[DataFrame, str | None]:
    """Hits with their score and rank before filters, and the intent."""
    intent = Q.intent_of(asked)
    expanded = expand(asked, settings)
    parts = [expand(p, settings) for p in Q.decompose(asked)] or [expanded]
    k = Q.pool_size(asked, limit, settings.vector_limit, len(parts))
    kw = vec = None
    for n, p in enumerate(parts):  # later parts rank behind earlier ones
        a, b = (x.withColumn("rank", F.col("rank") + n * k) for x in (_keyword(store, p, k), _vectors(store, p, k, settings)))
        kw, vec = (a, b) if kw is None else (kw.unionByName(a), vec.unionByName(b))
    wanted = sorted({r.id for r in [*kw.select("id").collect(), *vec.select("id").collect()]})  # local rows
    symbols = small(store["symbols"].filter(F.col("id").isin(*wanted)).select(*HIT)) if wanted else store["symbols"].select(*HIT).limit(0)
    metrics = small(store["symbol_metrics"].filter(F.col("id").isin(*wanted))) if wanted else store["symbol_metrics"].limit(0)
    if settings.mode == "weighted" and len(parts) == 1:
        base = K.weighted(kw, vec, settings.keyword_weight, settings.vector_weight)
        hits = K.score_hits(base.join(symbols, "id"), asked, intent)
    else:
        graph = K.graph_list(kw, metrics)
        a, b, c = settings.rrf_weights
        hits = K.rrf([(kw, a), (vec, b), (graph, c)], settings.rrf_k).join(symbols, "id")
    return small(K.popularity(K.with_rank(hits), metrics)), intent


def expand(text: str, settings: Settings) -> str:
    """One string through the query expander (the same expression that tables of queries use)."""
    from pyspark.sql import SparkSession

    row = SparkSession.active().range(1).select(T.expand_query(F.lit(text), settings.synonyms, settings.acronyms).alias("q")).head()
    return row.q


def search(store: Store, query: str, limit: int = 5, exported_only: bool = False, settings: Settings | None = None, context: bool = True) -> Answer:
    settings, limit = settings or Settings(), max(limit, 1)
    controls = Q.parse_controls(query)
    symbols = store["symbols"]
    if controls.id:
        hits = K.with_rank(symbols.filter(F.col("id") == controls.id).select(*HIT).withColumn("score", F.lit(1.0)))
        return _answer(store, query, None, hits, settings, context)
    asked = controls.text
    target = Q.callers_target(asked)
    if target:
        root = R.named(symbols, target, limit=1).head()
        if root:
            who = G.callers(store["edges"], root.id, limit).join(symbols.select(*HIT), "id").withColumn("score", F.lit(1.0))
            return _answer(store, query, "callers", K.with_rank(K.controlled(who, controls, exported_only)), settings, context)
    hits, intent = candidates(store, asked, limit, settings)
    hits = K.controlled(K.unique(hits), controls, exported_only)
    hits = small(K.docstrings(hits, store["docstrings"]))
    if settings.learning:
        now = F.lit(float(time.time() if settings.now is None else settings.now))
        hits = K.selected(hits, K.selection_scores(store["query_selections"], asked.strip().lower(), now))
        hits = K.familiar(hits, K.affinity_scores(store["user_file_affinity"], now))
    hits = small(K.same_package(small(hits), store["symbol_packages"], intent, _package(store, controls.package)))
    if settings.rerank:
        hits = K.rerank(hits, asked, symbols.select("id", "text"), settings.scorer, judged_before=settings.judged)
    hits = small(K.with_rank(hits.drop("rank")).join(store["similarity_clusters"], "id", "left"))
    pool = 4 * limit
    hits = small(K.by_kind(small(K.by_cluster(K.by_file(hits, pool), pool)), limit))
    hits = small(K.neighbours(hits, store["edges"], symbols, limit)) if context else hits
    return _answer(store, query, intent, hits, settings, context)


def _package(store: Store, wanted: str | None) -> str | None:
    """Identifier of a package that is given by identifier or name."""
    if wanted is None or "packages" not in store.tables:
        return None
    row = store["packages"].filter((F.col("id") == wanted) | (F.col("name") == wanted)).select("id").head()
    return row.id if row else None


def _answer(store: Store, query: str, intent: str | None, hits: DataFrame, settings: Settings, context: bool) -> Answer:
    if not context:
        return Answer(query, intent, hits)
    rows = hits.select("rank", "id").collect()  # at most ``limit`` rows
    items = assemble(store, [r.id for r in sorted(rows)], settings.budget, query=Q.parse_controls(query).text, counter=settings.counter)
    return Answer(query, intent, hits, C.render(items), items)


def assemble(store: Store, ids: list[str], budget: int = 8192, full: bool = False, examples: int = 5, related: int = 50, query: str = "", counter=C.count_tokens) -> list[C.Item]:
    """Items of a context: the symbols, examples of their use, the types and parents they name, and what
    they lead to. Of an item too long for what is left of its share, the lines nearest to ``query`` stay."""
    if not ids:
        return []
    place = {i: k for k, i in enumerate(ids)}
    symbols = store["symbols"]
    seeds = store.spark.createDataFrame([(i, 1.0) for i in ids], "id string, score double")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("id"))
    cap = F.when(F.col("kind") == "file", C.head_tail(F.col("text"), C.FILE_LINES)).otherwise(C.head_tail(F.col("text"), C.FULL_LINES if full else C.LINES, 50 if not full else 15))
    cols = ["id", "name", "kind", "file_path", cap.alias("text")]
    roots = symbols.filter(F.col("id").isin(*ids)).select(*cols).withColumn("rank", rank)
    near = small(G.expand_context(store["edges"], seeds, most=related, known=symbols))
    around = symbols.join(near, "id").select(*cols, F.row_number().over(_by_score()).alias("rank"))
    empty = roots.limit(0)
    rows = C.ordered(roots, empty, around).join(store["similarity_clusters"], "id", "left")
    docs = store["docstrings"].select("id", "summary").dropDuplicates(["id"])
    got = C.capped_roles(rows).join(docs, "id", "left").orderBy("tier", "rank").collect()  # a few hundred rows
    items = [C.Item(r.id, r.name, r.kind, r.file_path, r.text, "root" if r.tier == 0 else "expanded", docstring=r.summary) for r in got]
    uses = R.first_per(store["usage_examples"].filter(F.col("to_id").isin(*ids)), ["to_id"], ["type", "file_path", "line"], examples).collect()
    items += [C.Item(f"usage:{u.to_id}:{k}", u.type, "usage", u.file_path, u.snippet, "extra") for k, u in enumerate(sorted(uses, key=lambda u: (place[u.to_id], u.type, u.file_path)))]
    items = _with_types(store, ids, items, symbols.select(*cols), budget // 10, counter)
    return C.pack(items, budget, counter, _relevance(query) if query else None)


def _with_types(store: Store, ids: list[str], items: list[C.Item], symbols: DataFrame, budget: int, counter) -> list[C.Item]:
    """Items with the types and parents that the first ones name, as far as a budget goes."""
    place = {i: k for k, i in enumerate(ids)}
    e = store["edges"].filter(F.col("src").isin(*ids) & F.col("type").isin("type", "reference", "extends", "implements"))
    e = R.first_per(e, ["src"], ["type", "dst"], 20).select("src", F.col("type").alias("_type"), F.col("dst").alias("id"))
    rows = e.join(symbols, "id").collect()  # at most 20 a root
    found = [(C.Item(r.id, r.name, r.kind, r.file_path, r.text, "extra"), r._type) for r in sorted(rows, key=lambda r: (place[r.src], r._type, r.id))]
    more = C.auto_include(found, {i.id for i in items if i.role == "root"}, budget, counter)
    taken = {i.id for i in more}
    return [i for i in items if i.id not in taken or i.role == "root"] + more


def _relevance(query: str):
    """How near a line is to a query: the words they share, by twos, and the query itself."""
    words, whole = set(T.code_words(query)), query.lower()
    return lambda line: 2.0 * len(words & set(T.code_words(line))) + (1.0 if whole in line.lower() else 0.0)


def _by_score():
    from pyspark.sql.window import Window

    return Window.orderBy(F.desc("score"), "id")
