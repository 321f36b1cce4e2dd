"""Queries: analyzers, scanners, query understanding, full text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..functions.lexicon import ACRONYMS, CALL_STOP, CODE_STRONG, CODE_WEAK, INTENTS, NAME_STOP, SYNONYMS
from ..operators import fulltext as FT
from ..session import table
from . import stored
from .bindings import query

# The splitter for engines without look-around: pairs of characters, captured and put back apart.
_SPLIT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '([()])', ' \1 ', 'g'),
    '::|->|[_./\\:\-]', ' ', 'g'), '([A-UW-Za-uw-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'),
    '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '\s+', ' ', 'g'))"""
_NAMES = "names AS (SELECT DISTINCT regexp_extract(html, 'track\\([0-9]+\\)', 0) AS a, url, page_id FROM pages)"


def _split(c: str) -> str:
    return _SPLIT.format(c=c)


def _list(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


@query("identifier_split", f"SELECT page_id, {_split('url')} AS split_url FROM pages")
def identifier_split(spark, d):
    return table(spark, d, "pages").select("page_id", T.split_identifiers(F.col("url")).alias("split_url"))


@query("normalize_query_text", f"SELECT p_partkey, {_split('p_type || p_brand || p_name')} AS words FROM part")
def normalize_query_text(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalize_query(F.concat("p_type", "p_brand", "p_name")).alias("words"))


@query("tokenize_code", f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower({_split('url')}), '[ \\t\\n\\x0c\\r]+')) AS token FROM pages) WHERE token <> '' GROUP BY token")
def tokenize_code(spark, d):
    rows = table(spark, d, "pages").select(F.explode(T.tokens(F.col("url"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ngram_tokens",
    """WITH w AS (SELECT DISTINCT lower(o_orderpriority) AS w FROM orders),
      g AS (SELECT w, unnest(CASE WHEN length(w) < 3 THEN [w] ELSE flatten(list_transform(range(3, least(5, length(w)) + 1), lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n)))) END) AS gram FROM w)
      SELECT w, gram, count(*) AS n FROM g GROUP BY w, gram""",
)
def ngram_tokens(spark, d):
    words = table(spark, d, "orders").select(F.lower("o_orderpriority").alias("w")).distinct()
    return words.select("w", F.explode(T.ngrams(F.col("w"))).alias("gram")).groupBy("w", "gram").agg(F.count(F.lit(1)).alias("n"))


_TOK = r"unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1))"


@query(
    "stem_tokens",
    rf"""WITH t AS (SELECT DISTINCT {_TOK} AS token FROM documents),
      s AS (SELECT token, CASE WHEN length(token) > 5 AND token LIKE '%ing' THEN regexp_replace(token, '(ing)+$', '') WHEN length(token) > 4 AND token LIKE '%ed' THEN regexp_replace(token, '(ed)+$', '')
        WHEN length(token) > 4 AND token LIKE '%es' THEN regexp_replace(token, '(es)+$', '') WHEN length(token) > 3 AND token LIKE '%s' THEN regexp_replace(token, 's+$', '') END AS stem FROM t)
      SELECT token, CASE WHEN length(stem) >= 3 THEN stem END AS stem FROM s""",
)
def stem_tokens(spark, d):
    tok = table(spark, d, "documents").select(F.explode(T.plain_tokens(F.col("text"))).alias("token")).distinct()
    return tok.select("token", T.stem(F.col("token")).alias("stem"))


def _queries(words: str) -> str:
    return f"q AS (SELECT item_id, text || ' ' || {words} AS text FROM benchmark)"


_ADD = "CASE item_id % 4 WHEN 0 THEN 'class error' WHEN 1 THEN 'db api' WHEN 2 THEN 'remove http request' ELSE 'json sql ui' END"


def _with_words(spark, d):
    n = F.col("item_id") % 4
    words = F.when(n == 0, "class error").when(n == 1, "db api").when(n == 2, "remove http request").otherwise("json sql ui")
    return table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", "text", words).alias("text"))


_SYN = "text" + "".join(
    "".join(f" || CASE WHEN list_contains(w, '{t}') AND NOT contains(lower(text), '{s}') THEN ' {s}' ELSE '' END" for s in SYNONYMS[t])
    + f" || CASE WHEN list_has_any(w, [{_list(SYNONYMS[t])}]) AND NOT contains(lower(text), '{t}') THEN ' {t}' ELSE '' END"
    for t in sorted(SYNONYMS)
)
_ACR = "text" + "".join(f" || CASE WHEN list_contains(w, '{a}') AND NOT contains(lower(text), '{e}') THEN ' {e}' ELSE '' END" for a, e in sorted(ACRONYMS.items()))


@query("synonym_expand", f"WITH {_queries(_ADD)}, v AS (SELECT *, regexp_split_to_array(lower(text), '\\s+') AS w FROM q) SELECT item_id, {_SYN} AS expanded FROM v")
def synonym_expand(spark, d):
    return _with_words(spark, d).select("item_id", T.expand_synonyms(F.col("text")).alias("expanded"))


@query("acronym_expand", f"WITH {_queries(_ADD)}, v AS (SELECT *, regexp_split_to_array(lower(text), '\\s+') AS w FROM q) SELECT item_id, {_ACR} AS expanded FROM v")
def acronym_expand(spark, d):
    return _with_words(spark, d).select("item_id", T.expand_acronyms(F.col("text")).alias("expanded"))


_IDENT = "[A-Za-z_$][A-Za-z0-9_$]*"


@query("callee_scan", f"SELECT page_id, name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '({_IDENT})[ \\t\\n\\x0c\\r]*\\(', 1)) AS name FROM pages) WHERE name NOT IN ({_list(CALL_STOP)}) GROUP BY ALL")
def callee_scan(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(T.callees(F.col("html"))).alias("name"))
    return rows.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("identifier_scan", f"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '({_IDENT})', 1)) AS name FROM pages) WHERE name NOT IN ({_list(NAME_STOP)}) GROUP BY name")
def identifier_scan(spark, d):
    return table(spark, d, "pages").select(F.explode(T.identifiers(F.col("html"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "identifier_evidence",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
      c AS (SELECT doc_id, no AS line_no, len(list_filter(regexp_extract_all(line, '({_IDENT})', 1), lambda x: x = 'the')) AS n FROM l),
      t AS (SELECT doc_id, line_no, n, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total, min(line_no) OVER (PARTITION BY doc_id) AS first_line FROM c WHERE n > 0)
      SELECT doc_id, line_no, n, total, first_line FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line_no) <= 5""",
)
def identifier_evidence(spark, d):
    from ..operators.edges import evidence

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.array(F.lit("the")).alias("targets"), F.lit(1).alias("start_line"))
    e = evidence(docs)
    return e.select(F.col("id").alias("doc_id"), "line_no", "n", "total", "first_line")


@query("usage_line", "SELECT doc_id, substr(trim(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'and'))[1]), 1, 200) AS line FROM documents")
def usage_line(spark, d):
    return table(spark, d, "documents").select("doc_id", T.usage_line(F.col("text"), F.lit("and")).alias("line"))


@query(
    "todo_scan",
    """SELECT 'd' || doc_id || '.ts' AS file_path, CASE WHEN doc_id % 2 = 0 THEN 'todo' ELSE 'fixme' END AS kind, 'check ' || lang || ' ' || doc_id AS text, CAST(doc_id % 3 AS INTEGER) AS line, 'f' || doc_id AS symbol
      FROM documents WHERE lang IS NOT NULL""",
)
def todo_scan(spark, d):
    """Tasks of one source file per document: blank lines, a comment, a function."""
    from ..extract.run import extract_files

    i = F.col("doc_id").cast("string")
    word = F.when(F.col("doc_id") % 2 == 0, "TODO: ").otherwise("FIXME ")
    text = F.concat(F.repeat(F.lit("\n"), (F.col("doc_id") % 3).cast("int")), F.lit("// "), word, F.lit("check "), "lang", F.lit(" "), i, F.lit("\nfunction f"), i, F.lit("() { return 1; }\n"))
    files = table(spark, d, "documents").filter("lang IS NOT NULL").select(F.concat(F.lit("d"), i, F.lit(".ts")).alias("file_path"), F.lit("typescript").alias("language"), text.alias("text"))
    return extract_files(files).select("file_path", F.inline("todos"))


@query(
    "line_relevance",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
      w AS (SELECT doc_id, no, lower(line) AS low, string_split(regexp_replace(lower(line), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ') AS ws FROM l)
      SELECT doc_id, no AS line_no, CASE WHEN contains(low, 'the and') THEN 1.0E0 ELSE 0.0E0 END + CASE WHEN list_contains(ws, 'the') THEN 2.0E0 ELSE 0.0E0 END + CASE WHEN list_contains(ws, 'and') THEN 2.0E0 ELSE 0.0E0 END
        + CASE WHEN regexp_matches(low, '\b(fn|function|class|struct|interface|impl|trait|enum|def)\b') THEN 0.5E0 ELSE 0.0E0 END + CASE WHEN regexp_matches(low, '\b(return|pub|export)\b') THEN 0.3E0 ELSE 0.0E0 END AS relevance FROM w""",
)
def line_relevance(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), T.line_relevance(F.col("line"), "the and").alias("relevance"))


def _intent_sql() -> str:
    cases = []
    for name, parts, whole, starts in INTENTS:
        tests = [f"contains(q, '{p}')" for p in parts] + [f"list_contains(w, '{x}')" for x in whole] + [f"starts_with(q, '{s}')" for s in starts]
        if name == "callers":
            tests.append("(starts_with(q, 'where is ') AND ends_with(q, ' used'))")
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return "CASE " + " ".join(cases) + " END"


_CHAT = "SELECT conv_id, turn, text, lower(trim(text)) AS q, regexp_split_to_array(lower(trim(text)), '\\s+') AS w FROM (SELECT conv_id, turn, CASE conv_id % 7 WHEN 0 THEN 'who calls ' WHEN 1 THEN 'how does ' WHEN 2 THEN 'api ' WHEN 3 THEN 'fn ' WHEN 4 THEN 'snake_' ELSE '' END || text AS text FROM conversations)"


def _chat(spark, d):
    n = F.col("conv_id") % 7
    head = F.when(n == 0, "who calls ").when(n == 1, "how does ").when(n == 2, "api ").when(n == 3, "fn ").when(n == 4, "snake_").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(head, "text").alias("text"))


@query("intent_classify", f"SELECT conv_id, turn, {_intent_sql()} AS intent FROM ({_CHAT})")
def intent_classify(spark, d):
    return _chat(spark, d).select("conv_id", "turn", Q.intent(F.col("text")).alias("intent"))


_strong = " OR ".join(f"contains(t, '{s}')" for s in CODE_STRONG)
_weak = " + ".join(f"CAST(contains(t, '{s}') AS INTEGER)" for s in CODE_WEAK)


@query(
    "code_snippet_detect",
    f"""SELECT conv_id, turn, t <> '' AND (({_strong}) OR ({_weak}) >= 3 OR (NOT contains(t, ' ') AND regexp_matches(t, '\\p{{Ll}}\\p{{Lu}}'))
        OR (NOT contains(t, ' ') AND contains(t, '_') AND regexp_matches(t, '^[\\p{{L}}\\p{{N}}_]+$'))) AS is_code FROM (SELECT conv_id, turn, trim(text) AS t FROM ({_CHAT}))""",
)
def code_snippet_detect(spark, d):
    return _chat(spark, d).select("conv_id", "turn", Q.looks_like_code(F.col("text")).alias("is_code"))


@query("query_decompose", "SELECT item_id, part FROM (SELECT item_id, trim(unnest(string_split(p, ' & '))) AS part FROM (SELECT item_id, trim(unnest(regexp_split_to_array(text || ' AND a & b', '(?i) and '))) AS p FROM benchmark)) WHERE part <> ''")
def query_decompose(spark, d):
    text = F.concat("text", F.lit(" AND a & b"))
    return table(spark, d, "benchmark").select("item_id", F.explode(Q.decomposed(text)).alias("part"))


@query(
    "query_controls",
    """SELECT item_id, text || ' other:x' AS text, CASE WHEN item_id % 2 = 0 THEN 'typescript' ELSE 'rust' END AS lang, 'class,struct' AS kind, 'src/f' || item_id AS path, 'pkg' || item_id AS package
      FROM (SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' ') AS text FROM benchmark)""",
)
def query_controls(spark, d):
    """Queries of the benchmark's texts with controls around them, an unknown one among them."""
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("language:js kind:class,struct "), "text", F.lit(" lang:"), F.when(F.col("item_id") % 2 == 0, "TS").otherwise("rust"), F.lit(' path:"src/f'), i, F.lit('" pkg:pkg'), i, F.lit(" other:x"))
    c = table(spark, d, "benchmark").select("item_id", Q.controls(text).alias("c"))
    return c.select("item_id", "c.text", "c.lang", "c.kind", "c.path", "c.package")


# Full text: BM25 over the documents.

_DOCS = rf"t AS (SELECT doc_id, {_TOK} AS term FROM documents), l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}]+)', 1)) AS n FROM documents), s AS (SELECT count(*) AS n_docs, avg(n) AS mean FROM l)"


def _bm25_sql(terms, boost: str = "1.0E0") -> str:
    return f"""p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ({_list(terms)}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
      b AS (SELECT p.doc_id, sum({boost} * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)))) AS raw FROM p JOIN df USING (term) JOIN l USING (doc_id), s GROUP BY p.doc_id)"""


def _ranked_sql(limit: int, source: str = "SELECT doc_id, round(raw, 6) AS score FROM b") -> str:
    return f"SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id AS doc, score FROM ({source}) ORDER BY score DESC, doc_id LIMIT {limit}"


@query("bm25_single", f"WITH {_DOCS}, {_bm25_sql(['stupid'])} {_ranked_sql(20)}")
def bm25_single(spark, d):
    return FT.ranked(FT.bm25(stored.words(spark, d), ["stupid"]), 20, digits=6)


_TERMS = ["the", "and", "idiot", "moron"]


@query("bm25_multi_boosted", f"WITH {_DOCS}, {_bm25_sql(_TERMS, '2.0E0')} {_ranked_sql(50)}")
def bm25_multi_boosted(spark, d):
    return FT.ranked(FT.bm25(stored.words(spark, d), _TERMS, {"text": 2.0}), 50, digits=6)


@query(
    "bm25_phrase",
    rf"""WITH {_DOCS}, w AS (SELECT doc_id, regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}]+)', 1) AS w FROM documents),
      f AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS tf FROM w),
      df AS (SELECT term, count(DISTINCT doc_id) AS df FROM t WHERE term IN ('of', 'the', 'idiot') GROUP BY term), i AS (SELECT term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM df, s),
      c AS (SELECT doc_id, tf, (SELECT sum(idf) FROM i WHERE term IN ('of', 'the')) AS idf FROM f WHERE tf > 0
            UNION ALL SELECT doc_id, count(*), any_value(idf) FROM t JOIN i USING (term) WHERE term = 'idiot' GROUP BY doc_id),
      b AS (SELECT doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS raw FROM c JOIN l USING (doc_id), s GROUP BY doc_id)
      {_ranked_sql(40)}""",
)
def bm25_phrase(spark, d):
    """A phrase or a word: documents that hold either, by the weight of both."""
    return FT.search(stored.words(spark, d), '"of the" idiot', 40, {"text": 1.0}, digits=6)


@query(
    "bm25_must_not",
    f"""WITH {_DOCS}, {_bm25_sql(['idiot', 'moron'])}, m AS (SELECT DISTINCT doc_id FROM t WHERE term = 'idiot'), x AS (SELECT DISTINCT doc_id FROM t WHERE term = 'clown')
      {_ranked_sql(20, 'SELECT doc_id, round(raw, 6) AS score FROM b WHERE doc_id IN (SELECT doc_id FROM m) AND doc_id NOT IN (SELECT doc_id FROM x)')}""",
)
def bm25_must_not(spark, d):
    return FT.search(stored.words(spark, d), "+idiot moron -clown", 20, {"text": 1.0}, digits=6)


@query(
    "bm25_ngram_fallback",
    r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1))) AS word FROM documents),
      g AS (SELECT doc_id, word, CASE WHEN length(word) < 3 THEN 1 ELSE greatest(length(word) - 2, 0) + greatest(length(word) - 3, 0) + greatest(length(word) - 4, 0) END AS n FROM w),
      l AS (SELECT d.doc_id, coalesce(sum(n), 0) AS n FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id), s AS (SELECT count(*) AS n_docs, avg(n) AS mean FROM l),
      q AS (SELECT doc_id, p AS term, sum(len(list_filter(range(1, length(word) - length(p) + 2), lambda i: substr(word, i, length(p)) = p))) AS tf FROM g, unnest(['mor', 'oro', 'moro']) AS x(p) WHERE contains(word, p) GROUP BY doc_id, p),
      df AS (SELECT term, count(*) AS df FROM q GROUP BY term),
      b AS (SELECT doc_id AS doc, round(0.35E0 * sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM q JOIN df USING (term) JOIN l USING (doc_id), s GROUP BY doc_id)
      SELECT row_number() OVER (ORDER BY score DESC, doc) AS rank, doc, score, 1 AS tier FROM b ORDER BY score DESC, doc LIMIT 20""",
)
def bm25_ngram_fallback(spark, d):
    """A part of a word that stands nowhere by itself: all hits come from the n-grams."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    grams = FT.Index.slim_grams(docs, "doc_id", F.array_distinct(T.plain_tokens(F.col("text"))), FT.pieces("moro"))
    return FT.search_partial(stored.words(spark, d), grams, "moro", 20, digits=6)
