"""Graph operators over an edge table (src, dst, type, ...).

Traversals advance a frontier by one join per level; visited nodes leave by an anti-join. Iterations cut
their lineage by writing to the checkpoint folder of the session, never to executors' own disks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cut import cut


def degrees(vertices: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, in_degree, out_degree) of every vertex."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return vertices.select(F.col(id_col).alias("id")).join(sums, "id", "left").fillna(0, ["in_degree", "out_degree"])


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, id_col: str = "id", kind_col: str | None = "kind", every: int = 5, dedupe: bool = False) -> DataFrame:
    """(id, pagerank): start 1/N, (1-d)/N plus d times what comes in, mass of sinks dropped.

    Vertices of kind 'file' and edges that touch none or unknown vertices are left out; edges of several
    types between two vertices count each unless ``dedupe``.
    """
    v = vertices if kind_col is None else vertices.filter(F.col(kind_col) != "file")
    v = v.select(F.col(id_col).alias("id")).distinct()
    e = edges.select("src", "dst")
    e = cut(e.distinct() if dedupe else e)  # read several times below
    e = e.join(v.select(F.col("id").alias("src")), "src", "left_semi").join(v.select(F.col("id").alias("dst")), "dst", "left_semi")
    v = cut(v)
    n = v.count()
    if not n:
        return v.withColumn("pagerank", F.lit(0.0))
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")).join(out, "src").select("src", "dst", (F.col("times") / F.col("out")).alias("share"))
    # dealt by source once: the rounds join on it and shuffle only ranks and what they pass on
    links = cut(links.repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src"))
    base = (1 - damping) / n
    ranks = v.withColumn("pagerank", F.lit(1.0 / n))
    for k in range(1, rounds + 1):
        came = links.join(ranks, links.src == ranks.id).select(F.col("dst").alias("id"), (F.col("pagerank") * F.col("share")).alias("came"))
        came = came.unionAll(v.select("id", F.lit(0.0).alias("came")))  # one shuffle a round, by the key of the next join
        ranks = came.groupBy("id").agg((F.lit(base) + damping * F.sum("came")).alias("pagerank"))
        if k % every == 0 and k < rounds:
            ranks = cut(ranks)
    return ranks


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "down", types: Iterable[str] | None = None, depth: int = 2, limit: int | None = None) -> DataFrame:
    """Edges met by a breadth-first walk: (depth, src, dst, type). ``direction``: down along edges, up
    against them, both. A limit keeps the first by (depth, src, type, dst)."""
    e = edges if types is None else edges.filter(F.col("type").isin(*types))
    e = e.select("src", "dst", "type")
    steps = []
    if direction in ("down", "both"):
        steps.append(e.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "dst", "type"))
    if direction in ("up", "both"):
        steps.append(e.select(F.col("dst").alias("at"), F.col("src").alias("to"), "src", "dst", "type"))
    step = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    front = seeds.select(F.col(seeds.columns[0]).alias("at")).distinct()
    seen, met = front, None
    for k in range(1, depth + 1):
        now = cut(step.join(front, "at").select(F.lit(k).alias("depth"), "to", "src", "dst", "type"))
        met = now if met is None else met.unionByName(now)
        front = cut(now.select(F.col("to").alias("at")).distinct().join(seen, "at", "left_anti"))
        if k < depth:
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
    out = met.groupBy("src", "dst", "type").agg(F.min("depth").alias("depth")).select("depth", "src", "dst", "type")
    return out if limit is None else out.orderBy("depth", "src", "type", "dst").limit(limit)


def nodes(walk: DataFrame, seeds: DataFrame, direction: str = "down") -> DataFrame:
    """(id, depth) of the nodes of a walk, seeds at 0."""
    ends = {"down": ["dst"], "up": ["src"], "both": ["src", "dst"]}[direction]
    out = seeds.select(F.col(seeds.columns[0]).alias("id"), F.lit(0).alias("depth"))
    for c in ends:
        out = out.unionByName(walk.select(F.col(c).alias("id"), "depth"))
    return out.groupBy("id").agg(F.min("depth").alias("depth"))


def call_hierarchy(edges: DataFrame, seeds: DataFrame, direction: str = "callees", depth: int = 2, limit: int | None = 200) -> DataFrame:
    return reach(edges, seeds, {"callees": "down", "callers": "up"}.get(direction, "both"), ["call"], depth, limit)


def type_graph(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int | None = 200) -> DataFrame:
    return reach(edges, seeds, "down", ["extends", "implements", "alias"], depth, limit)


def dependencies(edges: DataFrame, seeds: DataFrame, direction: str = "downstream", depth: int = 2, limit: int | None = 200) -> DataFrame:
    way = {"downstream": "down", "upstream": "up"}.get(direction, "both")
    return reach(edges, seeds, way, ["call", "reference"], depth, limit)


def data_flow(edges: DataFrame, seeds: DataFrame, depth: int = 3, limit: int | None = 50, reads: Iterable[str] = ("call", "reference", "extends", "implements", "reads"), writes: Iterable[str] = ("writes",)) -> DataFrame:
    """(id, depth, flow, path): for each node first met, the shortest path from a seed, the least by
    its nodes; flow is read or write by the type of the last edge."""
    kinds = [*reads, *writes]
    e = edges.filter(F.col("type").isin(*kinds)).select("src", "dst", F.when(F.col("type").isin(*writes), "write").otherwise("read").alias("flow"))
    front = seeds.select(F.col(seeds.columns[0]).alias("id")).distinct().withColumn("path", F.array("id"))
    seen, out = front.select("id"), None
    for k in range(1, depth + 1):
        step = front.withColumnRenamed("id", "src").join(e, "src").select(F.col("dst").alias("id"), "flow", F.array_append("path", F.col("dst")).alias("path"))
        step = step.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("path", "flow")).alias("p")).select("id", "p.path", "p.flow")
        step = cut(step)
        now = step.select("id", F.lit(k).alias("depth"), "flow", "path")
        out = now if out is None else out.unionByName(now)
        front = step.select("id", "path")
        seen = seen.unionByName(step.select("id"))
    return out if limit is None else out.orderBy("depth", "id").limit(limit)


def affected(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int = 3, limit: int | None = 100, tests: Column | None = None) -> DataFrame:
    """What depends on the seeds: (id, name, file_path, kind, impact, depth), exported ones of high
    impact first. ``tests``: a predicate over symbols to leave out."""
    walk = dependencies(edges, seeds, "upstream", depth, None)
    found = nodes(walk, seeds, "up").filter("depth > 0").join(symbols, "id")
    if tests is not None:
        found = found.filter(~tests)
    out = found.select("id", "name", "file_path", "kind", F.when(F.col("exported"), "high").otherwise("medium").alias("impact"), "depth")
    out = out.orderBy("impact", "file_path", "name", "id")
    return out if limit is None else out.limit(limit)


def boost(count: Column) -> Column:
    """How strongly evidence speaks for an edge."""
    return F.least(F.greatest(1 + F.log1p(count) * 0.25, F.lit(1.0)), F.lit(1.75))


def expand_context(edges: DataFrame, seeds: DataFrame, depth: int = 2, per_node: int = 20, most: int = 50, explored: int = 100, known: DataFrame | None = None, kinds: dict[str, float] | None = None, resolutions: dict[str, float] | None = None) -> DataFrame:
    """(id, score): what seeds (id) lead to along edges, the best score of each: 1 / level, times the
    pulls of type and resolution, confidence and evidence. Each node's first ``per_node`` edges count, by
    type and other end; no further node is opened once ``explored`` are found. ``known``: ids that may be
    found.

    The frontier is joined before its edges are ranked. What comes of a level is bounded by the nodes
    opened, ``per_node`` edges each, so the walk itself is on the driver.
    """
    from ..functions.lexicon import EDGE_PULL, RESOLUTION_PULL

    pull = _lookup(F.col("type"), kinds or EDGE_PULL, 1.0)
    held = _lookup(F.col("resolution"), resolutions or RESOLUTION_PULL, 0.8)
    w = Window.partitionBy("src").orderBy("type", "dst")
    kind, spark = seeds.schema["id"].dataType.simpleString(), seeds.sparkSession
    front = [r.id for r in seeds.select("id").collect()]
    opened, best = set(front), {}
    for level in range(1, depth + 1):
        if not front or len(best) >= explored:
            break
        at = spark.createDataFrame([(i,) for i in front], f"src {kind}")
        e = edges.join(F.broadcast(at), "src").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_node)
        e = e if known is None else e.join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
        score = F.col("confidence") * pull * boost(F.col("evidence_count")) * held / level
        out: dict = {}
        for r in e.select("src", "dst", "_n", score.alias("score")).orderBy("src", "_n").collect():
            out.setdefault(r.src, []).append((r.dst, r.score))
        now, front = front, []
        for i in now:
            if len(best) >= explored:
                break
            for to, s in out.get(i, ()):
                if to not in best and to not in opened:
                    opened.add(to)
                    front.append(to)
                best[to] = max(s, best.get(to, s))
    top = sorted(((i, round(s, 6)) for i, s in best.items()), key=lambda x: (-x[1], x[0]))[:most]
    return spark.createDataFrame(top, f"id {kind}, score double")


def _lookup(c: Column, values: dict[str, float], other: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), F.lit(other))


def references(edges: DataFrame, roots: DataFrame, types: Iterable[str] | None = None, limit: int = 200) -> DataFrame:
    """Incoming edges of the roots."""
    e = edges if types is None else edges.filter(F.col("type").isin(*types))
    hit = e.join(roots.select(F.col(roots.columns[0]).alias("dst")), "dst")
    return hit.select("dst", "type", "src").orderBy("dst", "type", "src").limit(limit)


def callers(edges: DataFrame, root, limit: int = 200) -> DataFrame:
    """Distinct sources of calls and references of one node."""
    e = edges.filter((F.col("dst") == root) & F.col("type").isin("call", "reference"))
    return e.select(F.col("src").alias("id")).distinct().orderBy("id").limit(limit)
