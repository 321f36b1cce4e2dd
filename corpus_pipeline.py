"""A training corpus from the raw documents: toxic documents go, then copies, then near-copies; sources
are mixed to their target weights, and the mix is packed into fixed windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the next stage's docs. All but the last return the columns of documents, whatever those are named. A stage
deletes the intermediate tables of the stage before it, whose result has been written by then, and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, minhash, mixing, packing, toxicity
from quarry.llm._common import Tables, materialize, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the last stage, by application.
_before: dict[str, Tables] = {}


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if app in _before:
            _before.pop(app).delete()
        with Tables(spark) as tables:
            out = f(spark, docs, sf_dir)
        _before[app] = tables
        return out

    return run


def _whole(docs: DataFrame) -> Column:
    """All columns as one, so that no name of theirs meets one of ours."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("_all")


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("_all").getField(c).alias(c) for c in docs.columns])


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Null and empty texts score like a text without words and stay; rows with null or repeated identifiers
    are judged each by its text; long texts are scored whole; without labels, and from an empty table,
    every row stays. Extra columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.clean_rows(docs, toxicity.fit(docs, labels))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id.

    A null text equals an empty one; null identifiers yield to others; of rows that repeat an identifier
    and a text one stays; long texts are compared whole; an empty table stays empty. Extra columns are
    those of the row that stays.
    """
    return exact_dedup.keep_rows(docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """(_all, _row): rows with a number of their own, made of file and place in it where they are read from
    files, and stored with them otherwise."""
    try:
        at = docs.select(_whole(docs), docs.metadataColumn("_metadata").alias("_at")).select("_all", "_at.file_path", "_at.row_index")
    except AnalysisException:
        return materialize(docs.select(_whole(docs), F.monotonically_increasing_id().alias("_row")), "rows")
    files = at.select("file_path").distinct().orderBy("file_path").collect()  # one row a file
    known = docs.sparkSession.createDataFrame([(k, r.file_path) for k, r in enumerate(files)], "_file long, file_path string")
    return at.join(F.broadcast(known), "file_path").select("_all", (F.shiftleft("_file", 40) + F.col("row_index")).alias("_row"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five-word shingles, similarity 0.8 or more. The row with
    the smallest doc_id stays.

    Null and empty texts are near to nothing and stay, each; rows are judged by themselves, so a null or
    repeated identifier neither saves nor drops another row; null identifiers yield to others, ties go by
    text hash and place. Long texts are compared whole; an empty table stays empty; extra columns pass through.
    """
    rows = _numbered(docs)
    plain = rows.select("_row", F.col("_all.doc_id").alias("doc_id"), F.col("_all.text").alias("text"))
    found = minhash.near_duplicates(plain, "_row", k=5, share=80, of=100).select("_row", "component_id")
    found = found.join(plain.select("_row", "doc_id", F.xxhash64("text").alias("_h")), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h", "_row"))
    kept = materialize(found.groupBy("component_id").agg(first.alias("_first")).select("_first._row"), "kept")
    return _unpacked(rows.join(kept, "_row", "left_semi"), docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; those it does not take go.

    Null and empty texts add no words and stay, once; a null source is a source of its own. Rows
    are told apart by all their values, so repeated identifiers do not share their copies; equal rows are
    taken as often as all of them together. Long texts count whole; an empty table stays empty; extra
    columns pass through.
    """
    text = F.md5(F.coalesce(F.col("_all.text"), F.lit("")))
    rest = F.to_json(F.struct(F.col("_all.text").isNull().alias("none"), F.col("_all").dropFields("text").alias("rest")))
    rows = docs.select(_whole(docs)).withColumn("_key", F.md5(F.concat(text, rest)))
    plain = rows.select("_key", F.col("_all.text").alias("text"), F.col("_all.source").alias("source"))
    taken = mixing.mix(plain, "_key").filter("copies > 0").groupBy("_key").agg(F.sum("copies").cast("int").alias("_copies"))
    rows = rows.join(taken, "_key").dropDuplicates(["_key"])  # of equal rows one stands for all
    return _unpacked(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs)


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens.

    Null and empty texts hold their end token alone; rows with null or repeated identifiers are packed
    each; long texts span windows; an empty table gives no pieces. Extra columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Learned models, hashed signatures and a tokenizer: no SQL says what comes out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
