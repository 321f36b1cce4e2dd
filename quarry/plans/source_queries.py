"""Queries: extraction, import resolution, edges and packages, over one generated source file per document.

A template is a source file in which § stands for the number of its document and ¤ for that of the next
document of its language. What it holds is listed beside it, by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract.run import extract_files, tables
from ..functions import text as T
from ..operators import edges as E
from ..operators import ranking as K
from ..operators import relational as R
from ..operators.cut import cut
from ..session import table
from ..sources import files as S
from ..sources import manifests as M
from .bindings import SYMBOLS, query, symbols, with_
from .more_queries import _PATHS, _paths
from .search_queries import _RANKED, _hits
from .text_queries import _ACR, _ADD, _SYN, _queries, _split, _with_words

#: (language, extension, text, symbols (name, kind, exported), imports (name, source, alias)).
FILES = (
    (
        "typescript", "ts",
        """import { f¤ as g§ } from "./s¤";
/** Adds §.
 * @param {number} x - one
 * @returns the sum
 */
export function f§(x: T§): number { return g§(x); }
// TODO: check §
class C§ extends B§ implements T§ {
  @Get("/p§")
  run§(y: T§) { return f§(y); }
}
export interface T§ { a: U§ }
export type A§ = B§;
export enum E§ { X }
const k§ = f§(1);
export class B§ {}
export const app§ = new Elysia().get("/r§", h§);
""",
        [("f§", "function", True), ("C§", "class", False), ("run§", "function", False), ("T§", "interface", True), ("A§", "type_alias", True),
         ("E§", "enum", True), ("k§", "const", False), ("B§", "class", True), ("app§", "const", True)],
        [("f¤", "./s¤", "g§")],
    ),
    (
        "javascript", "js",
        'import z§ from "./z§";\nfunction a§() { return b§(); }\nclass J§ { go§() { return 1; } }\nlet v§ = 2;\nexport const w§ = 3;\n',
        [("a§", "function", False), ("J§", "class", False), ("go§", "function", False), ("v§", "const", False), ("w§", "const", True)],
        [("z§", "./z§", "default")],
    ),
    (
        "rust", "rs",
        "pub struct P§ { x: Q§ }\nimpl P§ {\n    pub fn d§(&self, o: P§) -> R§ { n§() }\n}\npub enum E§ { A }\npub trait T§ { fn h§(&self); }\n/* a /* b */ fn not§() {} */\nmod m§ { }\nfn n§() -> R§ { R§ }\n",
        [("P§", "struct", True), ("impl P§", "impl", False), ("d§", "function", True), ("E§", "enum", True), ("T§", "trait", True), ("h§", "function", False),
         ("m§", "module", False), ("n§", "function", False)],
        [],
    ),
    (
        "python", "py",
        "import os§\nfrom a§.b import c§ as d§\n\nclass K§:\n    def run§(self):\n        return helper§()\n\ndef _p§():\n    pass\n\nasync def q§():\n    pass\n",
        [("K§", "class", True), ("run§", "function", True), ("_p§", "function", False), ("q§", "function", True)],
        [("os§", "os§", None), ("c§", "a§.b", "d§")],
    ),
    (
        "go", "go",
        'package x\n\nimport (\n\tb "lib/a§"\n)\n\ntype S§ struct { A int }\n\ntype (\n\ti§ interface { M() }\n\tL§ = string\n)\n\nfunc (s S§) Do§() int { return 1 }\n\nfunc low§() {}\n',
        [("S§", "struct", True), ("i§", "interface", False), ("L§", "type_alias", True), ("Do§", "function", True), ("low§", "function", False)],
        [("a§", "lib/a§", "b")],
    ),
    (
        "java", "java",
        "package p;\nimport java.util.L§;\npublic class A§ {\n    private int f;\n    public int get§(int x) { return x; }\n    void low§() { }\n}\ninterface I§ { }\nenum E§ { X }\n",
        [("A§", "class", True), ("get§", "function", True), ("low§", "function", False), ("I§", "interface", False), ("E§", "enum", False)],
        [("L§", "java.util.L§", None)],
    ),
    (
        "c", "c",
        '#include "h§.h"\nstruct s§ { int a; };\nenum e§ { X };\ntypedef int t§;\nint f§(int a) { return a; }\n',
        [("s§", "struct", True), ("e§", "enum", True), ("t§", "type_alias", True), ("f§", "function", True)],
        [("h§.h", "h§.h", None)],
    ),
    (
        "cpp", "cpp",
        "#include <vector§>\nnamespace n§ {\nclass K§ {\n public:\n  int go§() { return 1; }\n};\n}\nusing u§ = int;\nint main§() { return 0; }\n",
        [("n§", "module", True), ("K§", "class", True), ("go§", "function", True), ("u§", "type_alias", True), ("main§", "function", True)],
        [("vector§", "vector§", None)],
    ),
)


def _files(spark, d) -> DataFrame:
    """(file_path, language, text): document i is a file of the language i modulo 8."""
    i = F.col("doc_id")
    pick = lambda k: F.get(F.array(*[F.lit(f[k]) for f in FILES]), (i % len(FILES)).cast("int"))
    text = F.replace(F.replace(pick(2), F.lit("§"), i.cast("string")), F.lit("¤"), (i + len(FILES)).cast("string"))
    path = F.concat(F.lit("src/s"), i.cast("string"), F.lit("."), pick(1))
    return table(spark, d, "documents").select(path.alias("file_path"), pick(0).alias("language"), text.alias("text"))


def _extracted(spark, d) -> dict[str, DataFrame]:
    return tables(cut(extract_files(_files(spark, d))))


def _quoted(v) -> str:
    if v is None:
        return "NULL"
    return str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


def _listed(rows: dict[int, list[tuple]], columns: str, only: str = "true") -> str:
    """SQL of what the templates list: rows by number of the language, § and ¤ filled in."""
    names = columns.split(", ")
    values = ", ".join(f"({k}, '{FILES[k][1]}', {', '.join(map(_quoted, r))})" for k, some in rows.items() for r in some)
    fill = lambda c: f"replace(replace(x.\"{c}\", '§', CAST(doc_id AS VARCHAR)), '¤', CAST(doc_id + {len(FILES)} AS VARCHAR)) AS \"{c}\""
    first = next(iter(next(iter(s for s in rows.values() if s))))
    cols = ", ".join(f'x."{c}"' if isinstance(v, bool | int) else fill(c) for c, v in zip(names, first, strict=True))
    given = ", ".join(f'"{c}"' for c in names)
    return f"SELECT 'src/s' || doc_id || '.' || ext AS file_path, {cols} FROM documents JOIN (VALUES {values}) x(k, ext, {given}) ON doc_id % {len(FILES)} = k WHERE {only}"


@query("extract_symbols", _listed({k: f[3] for k, f in enumerate(FILES)}, "name, kind, exported"))
def extract_symbols(spark, d):
    return _extracted(spark, d)["symbols"].filter("kind <> 'file'").select("file_path", "name", "kind", "exported")


@query("extract_imports", _listed({k: f[4] for k, f in enumerate(FILES)}, "name, source, alias"))
def extract_imports(spark, d):
    return _extracted(spark, d)["imports"].select("file_path", "name", "source", "alias")


@query("extract_types", _listed({0: [("f§", "T§"), ("run§", "T§"), ("T§", "U§"), ("A§", "B§")], 2: [("d§", "P§"), ("d§", "R§"), ("n§", "R§"), ("P§", "Q§")]}, "parent, type"))
def extract_types(spark, d):
    return _extracted(spark, d)["types"].select("file_path", "parent", "type").distinct()


@query("extract_flows", _listed({0: [("f§", "g§", "reads"), ("f§", "x", "reads"), ("run§", "f§", "reads"), ("run§", "y", "reads")]}, "owner, target, flow"))
def extract_flows(spark, d):
    return _extracted(spark, d)["flows"].select("file_path", "owner", "target", "flow").distinct()


@query("extract_docs", _listed({0: [("f§", "Adds §.", "the sum")]}, "name, summary, returns_text"))
def extract_docs(spark, d):
    t = _extracted(spark, d)
    return t["docstrings"].join(t["symbols"].select("id", "name"), "id").select("file_path", "name", "summary", "returns_text")


@query("extract_decorators", _listed({0: [("run§", "Get", "get")]}, "symbol, name, decorator_type"))
def extract_decorators(spark, d):
    """Decorators found by the beginning of their name and their type."""
    t = _extracted(spark, d)
    hit = R.matching(t["decorators"], name__prefix="ge", decorator_type="get")
    return hit.join(t["symbols"].select("id", F.col("name").alias("symbol")), "id").select("file_path", "symbol", "name", "decorator_type")


@query("extract_routes", _listed({0: [("GET", "/r§", "h§")]}, "http_method, path, handler"))
def extract_routes(spark, d):
    """Routes of web frameworks found by method and path."""
    hit = R.matching(_extracted(spark, d)["framework_patterns"], kind="route", http_method__upper="get", path__contains="/r")
    return hit.select("file_path", "http_method", "path", "handler")


@query("symbol_slices", _listed({0: [("A§", "export type A§ = B§;"), ("k§", "const k§ = f§(1);")], 3: [("_p§", "def _p§():\n    pass")], 4: [("low§", "func low§() {}")], 6: [("s§", "struct s§ { int a; }")]}, "name, text"))
def symbol_slices(spark, d):
    """Texts of symbols, cut from their files by their spans."""
    t = _extracted(spark, d)["symbols"]
    some = F.regexp_replace("name", "[0-9]+$", "")
    hit = ((F.col("language") == "typescript") & some.isin("A", "k")) | ((F.col("language") == "python") & (some == "_p")) | ((F.col("language") == "go") & (some == "low")) | ((F.col("language") == "c") & (some == "s"))
    whole = t.filter("kind = 'file'").select("file_path", F.col("text").alias("_whole"))
    part = F.substring("_whole", F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))  # the templates' texts are ASCII
    return t.filter(hit).join(whole, "file_path").select("file_path", "name", part.alias("text"))


def _typescript(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, resolved imports, edges with their target's name in the text) of the TypeScript files."""
    t = _extracted(spark, d)
    real = cut(t["symbols"].filter("kind <> 'file' AND language = 'typescript'"))
    imports = cut(E.resolve_imports(t["imports"].filter("file_path LIKE '%.ts'"), real))
    return real, imports, cut(E.build(real, E.candidates(real), imports))


@query("import_resolution", "SELECT 'src/s' || a.doc_id || '.ts' AS file_path, 'g' || a.doc_id AS local, 'f' || b.doc_id AS name, CASE WHEN b.doc_id IS NULL THEN 'made' ELSE 'file' END AS via FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 8 WHERE a.doc_id % 8 = 0")
def import_resolution(spark, d):
    real, imports, _ = _typescript(spark, d)
    return imports.join(real.select("id", "name"), "id", "left").select("file_path", "local", "name", "via")


_EDGES = [("C§", "B§", "extends"), ("C§", "T§", "implements"), ("C§", "run§", "call"), ("C§", "f§", "call"), ("run§", "f§", "call"), ("k§", "f§", "call"), ("A§", "B§", "alias")]


@query(
    "edge_build",
    "WITH l AS (" + _listed({0: _EDGES}, "src, dst, type") + """)
      SELECT src, dst, type, CASE type WHEN 'call' THEN 1.0E0 WHEN 'alias' THEN 0.9E0 ELSE 0.95E0 END AS confidence, 'local' AS resolution FROM l
      UNION ALL SELECT 'f' || a.doc_id, 'f' || b.doc_id, 'call', 1.0E0, 'import' FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 8 WHERE a.doc_id % 8 = 0""",
)
def edge_build(spark, d):
    """Calls, inheritance and aliases within files and across an import."""
    real, _, e = _typescript(spark, d)
    name = lambda end: real.select(F.col("id").alias(end), F.col("name").alias(f"_{end}"))
    e = e.filter(F.col("type").isin("call", "extends", "implements", "alias")).join(name("src"), "src").join(name("dst"), "dst")
    return e.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "type", "confidence", "resolution")


_USES = [("f§", "run§", "run§(y: T§) { return f§(y); }"), ("f§", "C§", "run§(y: T§) { return f§(y); }"), ("f§", "k§", "const k§ = f§(1);"), ("run§", "C§", "run§(y: T§) { return f§(y); }")]


@query(
    "usage_example_build",
    "SELECT target, snippet FROM (" + _listed({0: _USES}, "target, by, snippet") + """)
      UNION ALL SELECT 'f' || b.doc_id, 'export function f' || a.doc_id || '(x: T' || a.doc_id || '): number { return g' || a.doc_id || '(x); }' FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 8 WHERE a.doc_id % 8 = 0""",
)
def usage_example_build(spark, d):
    """Lines that call a symbol, one for each caller."""
    real, imports, e = _typescript(spark, d)
    uses = E.usage_examples(e, real, imports).filter("type = 'call'")
    return uses.join(real.select(F.col("id").alias("to_id"), F.col("name").alias("target")), "to_id").select("target", "snippet")


# Manifests and repositories.

_KINDS = (
    ("package.json", "npm", '{"name": "n§", "version": "1.§"}', "n§", "1.§"),
    ("Cargo.toml", "cargo", '[package]\nname = "c§"\nversion = "0.§"\n', "c§", "0.§"),
    ("go.mod", "go", "module example.com/g§\n\ngo 1.2\n", "g§", "1.2"),
    ("pyproject.toml", "python", '[project]\nname = "p§"\nversion = "3.§"\n', "p§", "3.§"),
    ("pom.xml", "maven", "<project/>", None, None),
)


def _manifests(spark, d) -> DataFrame:
    """A manifest per page, one in seven below a vendor directory, in two repositories and outside."""
    i = F.col("page_id")
    n = i.cast("string")
    pick = lambda k: F.get(F.array(*[F.lit(m[k]) for m in _KINDS]), (i % len(_KINDS)).cast("int"))
    folder = F.concat(F.lit("r"), (i % 3).cast("string"), F.when(i % 7 == 0, "/node_modules/d").otherwise("/d"), n, F.lit("/"))
    rows = table(spark, d, "pages").select(F.concat(folder, pick(0)).alias("file_path"), F.replace(pick(2), F.lit("§"), n).alias("text"))
    git = '[core]\n\tbare = false\n[remote "origin"]\n\turl = https://example.com/{}.git\n'
    return rows.union(spark.createDataFrame([(f"{r}/.git/config", git.format(r)) for r in ("r0", "r1")], "file_path string, text string"))


_MANIFESTS = (
    "m AS (SELECT page_id, 'r' || page_id % 3 || CASE WHEN page_id % 7 = 0 THEN '/node_modules/d' ELSE '/d' END || page_id || '/' || file AS manifest_path, kind AS package_type, "
    + "replace(name, '§', CAST(page_id AS VARCHAR)) AS name, replace(version, '§', CAST(page_id AS VARCHAR)) AS version FROM pages JOIN (VALUES "
    + ", ".join(f"({k}, '{m[0]}', '{m[1]}', {_quoted(m[3])}, {_quoted(m[4])})" for k, m in enumerate(_KINDS))
    + f") x(k, file, kind, name, version) ON page_id % {len(_KINDS)} = k WHERE page_id % 7 <> 0)"
)


@query("manifest_packages", with_(_MANIFESTS) + "SELECT sha256(manifest_path) AS id, name, version, manifest_path, package_type FROM m")
def manifest_packages(spark, d):
    return M.packages(M.discover(_manifests(spark, d))).drop("root")


@query("manifest_excluded", with_(_MANIFESTS) + "SELECT manifest_path AS file_path FROM m WHERE page_id % 3 <> 1 AND NOT manifest_path LIKE '%.toml'")
def manifest_excluded(spark, d):
    return M.discover(_manifests(spark, d), ["r1/", "**/*.toml"]).select("file_path")


@query("repository_listing", "SELECT sha256(r) AS id, r AS name, r AS root_path, 'git' AS vcs_type, 'https://example.com/' || r || '.git' AS remote_url FROM (VALUES ('r0'), ('r1')) x(r)")
def repository_listing(spark, d):
    return M.repositories(_manifests(spark, d))


@query("package_repositories", with_(_MANIFESTS) + "SELECT manifest_path, CASE WHEN page_id % 3 < 2 THEN sha256('r' || page_id % 3) END AS repository_id FROM m")
def package_repositories(spark, d):
    held = _manifests(spark, d)
    return M.in_repositories(M.packages(M.discover(held)), M.repositories(held)).select("manifest_path", "repository_id")


@query("file_packages", with_(_MANIFESTS) + "SELECT regexp_replace(manifest_path, '/[^/]*$', '') || '/src/x.ts' AS file_path, sha256(manifest_path) AS package FROM m UNION ALL SELECT 'r9/y.ts', NULL")
def file_packages(spark, d):
    packages = M.packages(M.discover(_manifests(spark, d)))
    files = packages.select(F.concat("root", F.lit("/src/x.ts")).alias("file_path")).union(spark.createDataFrame([("r9/y.ts",)], "file_path string"))
    return M.of_files(files, packages)


@query("path_globs", with_(_PATHS) + "SELECT page_id, path LIKE 'lib/%' AS folder, path LIKE 'src/%.ts' AS direct, path LIKE '%/build/%' OR path LIKE '%/dist/%' AS deep FROM paths")
def path_globs(spark, d):
    is_ = lambda p: F.col("path").rlike(S.glob_regex(p))
    return _paths(spark, d).select("page_id", is_("lib/").alias("folder"), is_("src/*.ts").alias("direct"), (is_("**/build/**") | is_("**/dist/**")).alias("deep"))


@query("path_subset", with_(_PATHS) + "SELECT page_id, path AS file_path FROM paths WHERE path LIKE 'src/%' OR path LIKE 'lib/dist/%' OR path = 'distant/f4.go'")
def path_subset(spark, d):
    return S.only(_paths(spark, d).withColumnRenamed("path", "file_path"), ["src", "lib/dist/", "distant/f4.go"])


@query("relative_paths", with_(_PATHS) + "SELECT page_id, path AS inside, '/other/' || path AS outside FROM paths")
def relative_paths(spark, d):
    p = _paths(spark, d)
    return p.select("page_id", S.relative(F.concat(F.lit("file:///base/dir/"), "path"), "/base/dir").alias("inside"), S.relative(F.concat(F.lit("file:/other/"), "path"), "/base/dir").alias("outside"))


# Mutations, expansion and reranking.


@query("evidence_upsert", "SELECT l_returnflag AS src, l_linestatus AS dst, 'call' AS type, CAST(l_suppkey AS VARCHAR) AS at_file, l_linenumber AS at_line, max(CAST(l_quantity AS BIGINT)) AS count FROM lineitem GROUP BY ALL")
def evidence_upsert(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("dst"), F.lit("call").alias("type"), F.col("l_suppkey").cast("string").alias("at_file"), F.col("l_linenumber").alias("at_line"), F.col("l_quantity").cast("long").alias("count"))
    return R.merge_evidence(rows)


@query(
    "query_expand",
    f"WITH {_queries(_ADD)}, a AS (SELECT item_id, {_split('text')} AS text FROM q), b AS (SELECT *, regexp_split_to_array(lower(text), '\\s+') AS w FROM a), c AS (SELECT item_id, {_SYN} AS text FROM b), "
    f"e AS (SELECT *, regexp_split_to_array(lower(text), '\\s+') AS w FROM c) SELECT item_id, {_ACR} AS expanded FROM e",
)
def query_expand(spark, d):
    return _with_words(spark, d).select("item_id", T.expand_query(F.col("text")).alias("expanded"))


_STEM = """CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN regexp_replace(w, '(ing)+$', '') WHEN length(w) > 4 AND w LIKE '%ed' THEN regexp_replace(w, '(ed)+$', '')
    WHEN length(w) > 4 AND w LIKE '%es' THEN regexp_replace(w, '(es)+$', '') WHEN length(w) > 3 AND w LIKE '%s' THEN regexp_replace(w, 's+$', '') END"""


@query(
    "query_plain",
    f"""WITH {_queries("' Nav listing configs ed'")}, a AS (SELECT item_id, string_split({_split('text')}, ' ') AS ws FROM q), b AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM a),
      c AS (SELECT *, lower(word) AS w FROM b), e AS (SELECT *, CASE w WHEN 'db' THEN 'database' WHEN 'auth' THEN 'authentication' WHEN 'nav' THEN 'navigation' WHEN 'config' THEN 'configuration' END AS long,
        CASE WHEN regexp_full_match(w, '[a-z]{{5,}}') THEN {_STEM} END AS stem FROM c)
      SELECT item_id, string_agg(concat_ws(' ', word, long, CASE WHEN length(stem) >= 3 THEN stem END), ' ' ORDER BY k) AS plain FROM e GROUP BY item_id""",
)
def query_plain(spark, d):
    text = F.concat_ws(" ", "text", F.lit(" Nav listing configs ed"))
    return table(spark, d, "benchmark").select("item_id", T.plain_query(text).alias("plain"))


@query(
    "index_text_build",
    with_(SYMBOLS)
    + f"""SELECT id, text || coalesce((SELECT string_agg(' ' || m, '' ORDER BY k) FROM (SELECT unnest(list_concat([{_split('name')}], list_transform(list_filter(string_split(regexp_replace(file_path, '\\.[^./]+$', ''), '/'), lambda p: p NOT IN ('', 'mod', 'index', 'lib')),
        lambda p: {_split('p')}))) AS m, generate_subscripts(list_concat([name], list_filter(string_split(regexp_replace(file_path, '\\.[^./]+$', ''), '/'), lambda p: p NOT IN ('', 'mod', 'index', 'lib'))), 1) AS k) WHERE NOT contains(lower(text), lower(m))), '') AS indexed FROM symbols""",
)
def index_text_build(spark, d):
    return symbols(spark, d).select("id", T.index_text(F.col("text"), F.col("name"), F.col("file_path")).alias("indexed"))


@query(
    "rerank_blend",
    with_(_RANKED)
    + r""", j AS (SELECT r.id, rank, score, list_distinct(regexp_extract_all(lower(substr(text, 1, 400)), '([\p{L}\p{N}]+)', 1)) AS w FROM ranked r JOIN symbols s ON s.id = r.id),
      k AS (SELECT id, score, CASE WHEN rank <= 20 THEN len(list_filter(['and', 'of', 'the'], lambda x: list_contains(w, x))) / 3.0E0 END AS rerank_score FROM j)
      SELECT id, round(rerank_score, 6) AS rerank_score, round(CASE WHEN rerank_score IS NULL THEN score ELSE 0.7E0 * score + 3 * rerank_score END, 6) AS score FROM k""",
)
def rerank_blend(spark, d):
    out = K.rerank(_hits(spark, d), "the and of", symbols(spark, d).select("id", "text"))
    return out.select("id", F.round("rerank_score", 6).alias("rerank_score"), "score")
