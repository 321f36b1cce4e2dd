"""Full-text search over postings tables.

An index is two tables: ``postings`` (term, doc, field, tf, positions) and ``lengths`` (doc, field, n). At
scale both are written once, bucketed or partitioned by term, so that a query reads only its terms'
postings: they are few, and the joins of a query are against its terms and the matched documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

K1, B = 1.2, 0.75


@dataclass
class Index:
    postings: DataFrame  # doc, field, term, tf, positions
    lengths: DataFrame  # doc, field, n

    @classmethod
    def build(cls, docs: DataFrame, doc: str, fields: dict[str, Column]) -> Index:
        """Index of analyzed fields: each column an array of terms in order."""
        each = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("terms")) for n, c in fields.items()])
        rows = docs.select(F.col(doc).alias("doc"), F.explode(each).alias("f")).select("doc", "f.field", "f.terms")
        hits = rows.select("doc", "field", F.posexplode("terms").alias("pos", "term"))
        postings = hits.groupBy("doc", "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
        return cls(postings, rows.select("doc", "field", F.size("terms").cast("long").alias("n")))

    @classmethod
    def slim(cls, docs: DataFrame, doc: str, terms: Column, wanted: list[str], name: str = "text") -> Index:
        """Index of one field that holds only the wanted terms, for a single query: the filter runs
        inside each document, so that no other posting is ever made. Lengths cover all documents."""
        rows = docs.select(F.col(doc).alias("doc"), terms.alias("terms"))
        placed = F.filter(F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), lambda x: x["term"].isin(*wanted))
        hits = rows.select("doc", F.inline(placed))
        postings = hits.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
        lengths = rows.select("doc", F.lit(name).alias("field"), F.size("terms").cast("long").alias("n"))
        return cls(postings.select("doc", F.lit(name).alias("field"), "term", "tf", "positions"), lengths)

    @classmethod
    def slim_grams(cls, docs: DataFrame, doc: str, words: Column, wanted: list[str], name: str = "text") -> Index:
        """Index of the n-grams of words (an array column) that holds only the wanted ones, likewise;
        lengths are worked out from the words' without making their n-grams."""
        rows = docs.select(F.col(doc).alias("doc"), words.alias("words"))
        some = F.filter("words", lambda w: F.exists(F.array(*map(F.lit, wanted)), lambda p: F.contains(w, p)))
        hits = rows.select("doc", F.explode(F.flatten(F.transform(some, lambda w: F.filter(T.ngrams(w), lambda g: g.isin(*wanted))))).alias("term"))
        postings = hits.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")).select("doc", F.lit(name).alias("field"), "term", "tf")
        each = lambda w: F.when(F.length(w) < 3, 1).otherwise(sum((F.greatest(F.length(w) - k, F.lit(0)) for k in (2, 3, 4)), F.lit(0)))
        n = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + each(w))
        return cls(postings, rows.select("doc", F.lit(name).alias("field"), n.alias("n")))

    def stored(self, path: str) -> Index:
        """The index written below a path and read back: postings sorted by term, so that a query reads
        the row groups of its terms only."""
        spark = self.postings.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.postings.repartition(n, "term").sortWithinPartitions("term", "field", "doc").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


@dataclass(frozen=True)
class Clause:
    """A word, or words in a row, in one field or any; ``occur``: should, must or never."""

    words: tuple[str, ...]
    field: str | None = None
    occur: str = "should"


def parse(query: str, analyze: Callable[[str], list[str]] = T.plain_words) -> list[Clause]:
    """Words, "phrases", +must, -never, NOT x, a AND b, field:word. Clauses without a sign are optional.
    What the analyzer cuts into several words is a phrase. Anything else is read as words; no string is an
    error."""
    out: list[Clause] = []
    pending = None
    for sign, name, phrase, word in re.findall(r'([+-]?)(?:(\w+):)?"([^"]*)"?|(\S+)', query):
        if word in ("AND", "OR", "NOT"):
            if word == "AND" and out and out[-1].occur == "should" and not pending:
                out[-1] = replace(out[-1], occur="must")
            pending = None if word == "OR" else word
            continue
        field_ = name or None
        if word:
            sign = word[0] if word[0] in "+-" and len(word) > 1 else ""
            phrase = word[1:] if sign else word
            head, colon, rest = phrase.partition(":")
            if colon and rest and head in ("name", "text"):
                field_, phrase = head, rest
        words = tuple(analyze(phrase))
        if words:
            occur = "never" if sign == "-" or pending == "NOT" else "must" if sign == "+" or pending == "AND" else "should"
            out.append(Clause(words, field_, occur))
        pending = None
    return out


def _stats(index: Index) -> DataFrame:
    return index.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean"))


def bm25(index: Index, terms: list[str], boosts: dict[str, float] | None = None) -> DataFrame:
    """(doc, score) of every document that holds a term, summed over terms and fields."""
    boosts = boosts or {"text": 1.0}
    hits = index.postings.filter(F.col("term").isin(*terms) & F.col("field").isin(*boosts))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    joined = hits.join(F.broadcast(df.join(_stats(index), "field")), ["field", "term"]).join(index.lengths, ["doc", "field"])  # one row per query term and field
    return joined.groupBy("doc").agg(F.sum(weight * idf * tf).alias("score"))


def phrase_hits(index: Index, words: list[str]) -> DataFrame:
    """(doc, field, tf): how often the words stand in a row in a field."""
    rows = index.postings.filter(F.col("term").isin(*words)).groupBy("doc", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    rows = rows.filter(F.size("at") == len(set(words)))
    starts = F.element_at("at", F.lit(words[0]))
    for k, w in enumerate(words[1:], 1):
        starts = F.array_intersect(starts, _shifted(w, k))
    return rows.select("doc", "field", F.size(starts).cast("long").alias("tf")).filter("tf > 0")


def _shifted(word: str, k: int) -> Column:
    return F.transform(F.element_at("at", F.lit(word)), lambda p: p - k)


def matches(index: Index, clauses: list[Clause], boosts: dict[str, float]) -> DataFrame:
    """(doc, score): documents that hold a clause, all that must occur and none that must not. A word
    scores by BM25; a phrase likewise, by its own count and the sum of its words' weights."""
    terms = sorted({w for c in clauses for w in c.words})
    hits = index.postings.filter(F.col("term").isin(*terms) & F.col("field").isin(*boosts))
    found = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).collect()  # a row per query term and field
    stats = {r.field: (r.n_docs, r.mean) for r in _stats(index).collect()}  # a row per field
    idf = {(r.field, r.term): log(1 + (stats[r.field][0] - r.df + 0.5) / (r.df + 0.5)) for r in found}
    rows = None
    for k, c in enumerate(clauses):
        if len(c.words) == 1:
            part = hits.filter(F.col("term") == c.words[0]).select("doc", "field", "tf")
        else:
            part = phrase_hits(index, list(c.words))
        fields = {f: sum(idf.get((f, w), 0.0) for w in c.words) for f in boosts if c.field in (None, f) and f in stats}
        part = part.filter(F.col("field").isin(*fields)).withColumn("clause", F.lit(k)).withColumn("idf", _pick("field", fields))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return index.lengths.select("doc", F.lit(0.0).alias("score")).limit(0)
    score = F.lit(0.0)
    if stats:
        norm = F.col("tf") + K1 * (1 - B + B * F.col("n") / _pick("field", {f: m or 1.0 for f, (_, m) in stats.items()}))
        score = _pick("field", boosts) * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    of = {occur: [k for k, c in enumerate(clauses) if c.occur == occur] for occur in ("should", "must", "never")}
    scored = rows.join(index.lengths, ["doc", "field"]).withColumn("s", F.when(F.col("clause").isin(*of["never"]), 0.0).otherwise(score))
    out = scored.groupBy("doc").agg(F.sum("s").alias("score"), F.collect_set("clause").alias("held"))
    for k in of["must"]:
        out = out.filter(F.array_contains("held", k))
    if of["never"]:
        out = out.filter(~F.arrays_overlap("held", F.array(*map(F.lit, of["never"]))))
    if of["should"] and not of["must"]:
        out = out.filter(F.arrays_overlap("held", F.array(*map(F.lit, of["should"]))))
    return (out if of["should"] or of["must"] else out.limit(0)).select("doc", "score")


def _pick(column: str, values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, v in values.items():
        out = F.when(F.col(column) == name, F.lit(float(v))).otherwise(out)
    return out


def search(
    index: Index, query: str, limit: int, boosts: dict[str, float] | None = None, analyze: Callable[[str], list[str]] = T.plain_words, digits: int | None = None
) -> DataFrame:
    """(rank, doc, score): the best documents of a parsed query. Names weigh less than texts in queries
    of two words and more."""
    if boosts is None:
        boosts = {"name": 1.0, "text": 1.0} if len(query.split()) < 2 else {"name": 0.5, "text": 2.0}
    return ranked(matches(index, parse(query, analyze), boosts), limit, digits=digits)


def ranked(hits: DataFrame, limit: int, score: str = "score", digits: int | None = None) -> DataFrame:
    """The best rows by score (rounded where ``digits`` is given), ties by doc, with a rank from 1."""
    hits = hits if digits is None else hits.withColumn(score, F.round(score, digits))
    top = hits.orderBy(F.desc(score), "doc").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "doc")).cast("long")).select("rank", "doc", score)


def wants_ngrams(query: str) -> bool:
    """Whether a query is one bare word of 3 to 12 bytes, which may be part of a longer one."""
    return '"' not in query and len(query.split()) == 1 and 3 <= len(query.strip().encode()) <= 12


def pieces(word: str) -> list[str]:
    """The n-grams of 3 to 5 characters of a word, each once."""
    return list(dict.fromkeys(word[i : i + n] for n in range(3, min(5, len(word)) + 1) for i in range(len(word) - n + 1)))


def search_partial(
    index: Index, grams: Index, query: str, limit: int, share: float = 0.35, analyze: Callable[[str], list[str]] = T.plain_words, digits: int | None = None
) -> DataFrame:
    """Search that fills up with documents holding the word as part of longer ones, at a share of their
    score and after all whole-word hits."""
    first = search(index, query, limit, analyze=analyze, digits=digits).withColumn("tier", F.lit(0))
    if not wants_ngrams(query):
        return first
    more = bm25(grams, pieces(query.strip().lower()), dict.fromkeys(("name", "text"), 1.0)).withColumn("score", F.col("score") * share)
    more = ranked(more, 2 * limit, digits=digits).join(first, "doc", "left_anti").select("doc", "score", F.lit(1).alias("tier"))
    both = first.select("doc", "score", "tier").unionByName(more).orderBy("tier", F.desc("score"), "doc").limit(limit)
    return both.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), "doc")).cast("long")).select("rank", "doc", "score", "tier")


def gram_index(docs: DataFrame, doc: str, fields: dict[str, Column]) -> Index:
    """Index of the n-grams of analyzed fields."""
    return Index.build(docs, doc, {n: F.flatten(F.transform(c, lambda w: T.ngrams(w))) for n, c in fields.items()})
