"""Indexes that the registered queries share: built once per application and input, read after that.

They lie in the checkpoint folder, which driver and executors share, as a search engine's index would.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import hash_embedding
from ..operators import graph as G
from ..operators.cut import folder
from ..operators.fulltext import Index
from ..session import table

_paths: dict[tuple[str, str], str] = {}


def _path(spark: SparkSession, d: str, what: str) -> tuple[str, bool]:
    """(where the thing of an input lies, whether it is still to be written)."""
    key = (spark.sparkContext.applicationId, f"{what}:{d.rstrip('/')}")
    new = key not in _paths
    if new:
        _paths[key] = f"{folder(spark)}/quarry-{what}-{uuid.uuid4().hex}"
    return _paths[key], new


def words(spark: SparkSession, d: str) -> Index:
    """Postings, with positions, of the words of all documents."""
    path, new = _path(spark, d, "words")
    if new:
        docs = table(spark, d, "documents").select("doc_id", "text")
        return Index.build(docs, "doc_id", {"text": T.plain_tokens(F.col("text"))}).stored(path)
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def _table(spark: SparkSession, d: str, what: str, build) -> DataFrame:
    path, new = _path(spark, d, what)
    if new:
        build().write.parquet(path)
    return spark.read.parquet(path)


def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vector): hash embeddings of all documents."""
    docs = table(spark, d, "documents")
    return _table(spark, d, "vectors", lambda: docs.select(F.col("doc_id").alias("id"), hash_embedding(64)(F.col("text")).alias("vector")))


def document_ranks(spark: SparkSession, d: str) -> DataFrame:
    """(id, pagerank) of documents linked both ways with their source."""

    def build() -> DataFrame:
        docs = table(spark, d, "documents")
        links = docs.select(F.concat(F.lit("s"), "source").alias("src"), F.col("doc_id").cast("string").alias("dst"))
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        ranks = G.pagerank(both.select(F.col("src").alias("id")).distinct(), both, rounds=5, kind_col=None)
        return ranks.select(F.col("id").try_cast("long").alias("id"), F.round("pagerank", 12).alias("pagerank")).filter("id IS NOT NULL")

    return _table(spark, d, "ranks", build)


def prepare(spark: SparkSession, d: str) -> None:
    """Builds all of them."""
    for f in (words, document_vectors, document_ranks):
        f(spark, d)
