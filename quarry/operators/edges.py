"""Edges between symbols, built by joins over what extraction found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.lexicon import EDGE_CONFIDENCE
from .relational import first_per


def evidence(rows: DataFrame, lines: int = 5) -> DataFrame:
    """Where targets stand in texts: rows (id, text, targets, start_line) give (id, target, line_no, n,
    total, first_line), the lines with most occurrences first. Each text is read once, for all targets."""
    each = rows.select("id", "targets", "start_line", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = F.filter(F.regexp_extract_all("line", F.lit(f"({T.IDENTIFIER})"), F.lit(1)), lambda x: F.array_contains(F.col("targets"), x))
    hits = each.select("id", (F.col("start_line") + F.col("pos")).cast("long").alias("line_no"), F.explode(found).alias("target"))
    hits = hits.groupBy("id", "target", "line_no").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("id", "target")
    hits = hits.withColumn("total", F.sum("n").over(w)).withColumn("first_line", F.min("line_no").over(w))
    return first_per(hits, ["id", "target"], [F.desc("n"), "line_no"], lines)


def names(symbols: DataFrame) -> DataFrame:
    """(name, id, file_path): the symbol that a bare name means; exported ones before others, then by
    file and start."""
    best = F.min_by(F.struct("id", "file_path"), F.struct((~F.col("exported")).alias("x"), "file_path", "start_byte", "id")).alias("s")
    return symbols.groupBy("name").agg(best).select("name", "s.id", "s.file_path")


def resolve_path(base: Column, relative: Column) -> Column:
    """A relative import from the file ``base``, as a path: '.' and '..' taken out, .ts appended to what
    has none of the known endings; null for imports that are not relative."""
    folder = F.slice(F.split(base, "/"), 1, F.greatest(F.size(F.split(base, "/")) - 1, F.lit(0)))
    parts = F.concat(folder, F.split(relative, "/"))
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda s, p: F.when(p.isin(".", ""), s).when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p)),
    )
    path = F.array_join(walked, "/")
    return F.when(relative.startswith("."), F.when(path.rlike(r"\.(ts|tsx|rs)$"), path).otherwise(F.concat(path, F.lit(".ts"))))


def resolve_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, local, id, via): each import's symbol. The exported symbol of the resolved file comes
    first, then that of its alternative spellings, then any exported one of the name, then an id made of
    the path and name. Imports: file_path, source, name, alias (the last of one local name counts)."""
    local = F.coalesce("alias", "name")
    one = imports.withColumn("local", local).withColumn("path", resolve_path(F.col("file_path"), F.col("source")))
    one = first_per(one, ["file_path", "local"], [F.desc("seq")], 1)
    stem = F.regexp_replace("path", r"\.ts$", "")
    spelled = F.array("path", *[F.concat(stem, F.lit(x)) for x in (".tsx", "/index.ts", "/index.tsx")])
    tries = one.select("*", F.posexplode_outer(spelled).alias("at", "try"))
    exported = symbols.filter("exported").select(F.col("file_path").alias("try"), F.col("name"), F.col("id").alias("hit"), "start_byte")
    exported = exported.groupBy("try", "name").agg(F.min_by("hit", F.struct("start_byte", "hit")).alias("hit"))
    found = tries.join(exported, ["try", "name"], "left").groupBy("file_path", "local", "name", "path").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("at"))).alias("hit"))
    anywhere = names(symbols.filter("exported")).select("name", F.col("id").alias("any"))
    out = found.join(anywhere, "name", "left")
    made = F.sha2(F.concat_ws(":", F.coalesce("path", F.lit("")), "name"), 256)
    via = F.when(F.col("hit").isNotNull(), "file").when(F.col("any").isNotNull(), "name").otherwise("made")
    return out.select("file_path", "local", F.coalesce("hit", "any", made).alias("id"), via.alias("via"))


def candidates(symbols: DataFrame, type_edges: DataFrame | None = None, data_flow: DataFrame | None = None, most_names: int = 20) -> DataFrame:
    """(id, file_path, type, target): what symbols mention, each target once per type. Calls, extends,
    implements, alias and references come from the text; types (parent, type) and reads and writes (owner,
    name, kind) from extraction."""
    rel = T.type_relations(F.col("text"))
    each = F.array(
        F.struct(F.lit("call").alias("type"), T.callees(F.col("text")).alias("targets")),
        F.struct(F.lit("extends").alias("type"), rel["extends"].alias("targets")),
        F.struct(F.lit("implements").alias("type"), rel["implements"].alias("targets")),
        F.struct(F.lit("alias").alias("type"), F.when(F.col("kind") == "type_alias", rel["aliases"]).otherwise(F.array().cast("array<string>")).alias("targets")),
        F.struct(F.lit("reference").alias("type"), F.slice(T.identifiers(F.col("text")), 1, most_names).alias("targets")),
    )
    rows = symbols.filter(F.col("kind") != "file").select("id", "file_path", "name", F.explode(each).alias("e"))
    out = rows.select("id", "file_path", "name", F.col("e.type").alias("type"), F.explode(F.array_distinct("e.targets")).alias("target"))
    own = symbols.select("id", "file_path", "name")
    if type_edges is not None:
        t = type_edges.withColumnRenamed("parent", "name").join(own, ["file_path", "name"])
        out = out.unionByName(t.select("id", "file_path", "name", F.lit("type").alias("type"), F.col("type").alias("target")))
    if data_flow is not None:
        f = data_flow.withColumnRenamed("owner", "name").join(own, ["file_path", "name"])
        out = out.unionByName(f.select("id", "file_path", "name", F.col("flow").alias("type"), "target"))
    return out.filter("target <> name").select("id", "file_path", "type", "target").distinct()


def build(symbols: DataFrame, found: DataFrame, imports: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """Edges of the candidates: (src, dst, type, confidence, evidence_count, resolution).

    A target is a symbol of the file, else what the file imports under that name, else the symbol that the
    bare name means. Targets that are no symbols are dropped. ``packages``: (file_path, package).
    """
    here = symbols.groupBy("file_path", F.col("name").alias("target")).agg(F.min_by("id", F.struct((~F.col("exported")).alias("x"), "start_byte", "id")).alias("own"))
    e = found.join(here, ["file_path", "target"], "left")
    if imports is not None:
        e = e.join(imports.select("file_path", F.col("local").alias("target"), F.col("id").alias("imported")), ["file_path", "target"], "left")
    else:
        e = e.withColumn("imported", F.lit(None).cast("string"))
    e = e.join(names(symbols).select(F.col("name").alias("target"), F.col("id").alias("any")), "target", "left")
    e = e.withColumn("dst", F.coalesce("own", "imported", "any")).filter(F.col("dst").isNotNull() & (F.col("dst") != F.col("id")))
    where = symbols.select(F.col("id").alias("dst"), F.col("file_path").alias("dst_file"))
    e = e.join(where, "dst")  # drops ends that do not exist
    by_import = F.col("own").isNull() & F.col("imported").isNotNull()
    if packages is not None:
        p = packages.select("file_path", "package")
        e = e.join(p, "file_path", "left").join(p.withColumnsRenamed({"file_path": "dst_file", "package": "dst_package"}), "dst_file", "left")
        same = F.when(F.col("package").isNull() | F.col("dst_package").isNull(), F.lit("")).when(F.col("package") == F.col("dst_package"), "package").otherwise("cross-package")
    else:
        same = F.lit("")
    plain = F.when(same != "", same).otherwise("unknown")
    imported = F.when(same != "", F.concat(same, F.lit("-import"))).otherwise("import")
    resolution = F.when(F.col("own").isNotNull(), "local").when(by_import, imported).otherwise(plain)
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_CONFIDENCE.items() for x in kv]), F.col("type"))
    return e.select(F.col("id").alias("src"), "dst", "type", "target", sure.alias("confidence"), resolution.alias("resolution")).dropDuplicates(["src", "dst", "type"])


def with_evidence(edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with evidence_count and at_line, evidence rows) from the texts of their sources."""
    lines = symbols.select("id", "text", "start_line")
    named = edges.filter(~F.col("type").isin("reads", "writes")).groupBy(F.col("src").alias("id")).agg(F.collect_set("target").alias("targets"))
    rows = named.join(lines, "id")
    ev = evidence(rows)
    tops = ev.groupBy(F.col("id").alias("src"), "target").agg(F.first("total").alias("evidence_count"), F.first("first_line").alias("at_line"))
    out = edges.join(tops, ["src", "target"], "left").fillna(1, ["evidence_count"])
    detail = edges.join(ev.withColumnRenamed("id", "src"), ["src", "target"]).select("src", "dst", "type", F.col("line_no").alias("at_line"), F.col("n").alias("count"))
    return out.drop("target"), detail


def usage_examples(edges: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(to_id, type, file_path, line, snippet, from_id): lines that call or refer to a symbol, a limited
    number of references each, and import it; each once."""
    texts = symbols.select(F.col("id").alias("src"), "text", "file_path", "start_line")
    e = edges.filter(F.col("type").isin("call", "reference")).join(texts, "src")
    snippet = T.usage_line(F.col("text"), F.col("target"))
    rows = e.select(F.col("dst").alias("to_id"), "type", "file_path", F.col("start_line").cast("long").alias("line"), snippet.alias("snippet"), F.col("src").alias("from_id")).filter("snippet IS NOT NULL")
    refs = first_per(rows.filter("type = 'reference'"), ["to_id"], ["file_path", "line", "from_id"], most)
    out = rows.filter("type = 'call'").unionByName(refs)
    if imports is not None:
        i = imports.select(F.col("id").alias("to_id"), F.lit("import").alias("type"), "file_path", F.lit(None).cast("long").alias("line"), F.concat(F.lit("import "), "local").alias("snippet"), F.lit(None).cast("string").alias("from_id"))
        out = out.unionByName(i)
    return out.dropDuplicates(["to_id", "type", "file_path", "line", "snippet"])
