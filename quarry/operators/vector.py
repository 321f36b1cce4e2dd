"""Vector search: exact nearest neighbours, sign-bit clusters, content-keyed embedding cache.

Distances are higher-order functions over array columns and stay in generated code; a query vector is a
literal, so a search is one scan with a partial top-k and no shuffle of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import cache_key


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences, in double precision and in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def similarity(distance: Column, clamp: bool = True) -> Column:
    return 1 / (1 + (F.greatest(distance, F.lit(0.0)) if clamp else distance))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "vector", where: Column | None = None, digits: int | None = None) -> DataFrame:
    """(rank, id, distance) of the k nearest rows, ties by id; ``where`` filters before. Distances are
    rounded where ``digits`` is given."""
    rows = vectors if where is None else vectors.filter(where)
    d = squared_l2(F.col(vec_col), literal(query))
    d = d if digits is None else F.round(d, digits)
    top = rows.filter(F.size(vec_col) == len(query)).select(F.col(id_col).alias("id"), d.alias("distance")).orderBy("distance", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")).cast("long")).select("rank", "id", "distance")


def vector_of(vectors: DataFrame, value, id_col: str = "id", vec_col: str = "vector") -> list[float]:
    got = vectors.filter(F.col(id_col) == value).select(vec_col).head()
    if got is None:
        raise KeyError(f"no vector {value!r}")
    return list(got[0])


def similar(vectors: DataFrame, query: list[float], limit: int = 20, threshold: float = 0.5, self_id=None, digits: int | None = None, **cols) -> DataFrame:
    """(id, similarity) above a threshold, of the 2 * limit nearest. ``self_id`` leaves one row out."""
    limit = min(max(limit, 1), 100)
    s = similarity(F.col("distance"))
    hits = knn(vectors, query, 2 * limit, digits=digits, **cols).withColumn("similarity", s if digits is None else F.round(s, digits))
    hits = hits.filter(F.col("similarity") >= threshold)
    if self_id is not None:
        hits = hits.filter(F.col("id") != self_id)
    return hits.orderBy(F.desc("similarity"), "id").limit(limit).select("id", "similarity")


def cluster_key(v: Column) -> Column:
    """16 hexadecimal digits of the signs of the first 64 components (bit i set: component i >= 0)."""
    bits = F.transform(F.slice(v, 1, 64), lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")))
    packed = F.aggregate(
        F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i)), F.expr("0L"), lambda s, b: s.bitwiseOR(b)
    )
    return F.lpad(F.lower(F.hex(packed)), 16, "0")


def cluster_members(vectors: DataFrame, value, limit: int = 20, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Other rows with the cluster key of a row."""
    keyed = vectors.select(F.col(id_col).alias("id"), cluster_key(F.col(vec_col)).alias("cluster_key"))
    own = keyed.filter(F.col("id") == value).select("cluster_key")
    return keyed.join(own, "cluster_key").filter(F.col("id") != value).orderBy("id").limit(limit)


def missing(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Distinct texts that the cache lacks, with their keys."""
    keyed = texts.select(cache_key(model, F.col(text_col)).alias("cache_key"), F.col(text_col).alias("text")).dropDuplicates(["cache_key"])
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def embed_cached(texts: DataFrame, cache: DataFrame, model: str, embed: Callable[[Column], Column], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with their vectors, rows to append to the cache): only texts never seen are embedded."""
    fresh = missing(texts, cache, model, text_col).select("cache_key", embed(F.col("text")).alias("embedding"))
    known = cache.select("cache_key", "embedding").unionByName(fresh)
    keyed = texts.withColumn("cache_key", cache_key(model, F.col(text_col)))
    return keyed.join(known, "cache_key"), fresh


def trim_cache(cache: DataFrame, most_bytes: int, share: float = 0.1) -> DataFrame:
    """The cache without its least recently used share, if its vectors exceed a size."""
    size = cache.agg(F.sum(F.size("embedding") * 4)).first()[0] or 0
    if size <= most_bytes:
        return cache
    return cache.filter(F.col("last_accessed_at") > quantile(cache, "last_accessed_at", share))


def quantile(rows: DataFrame, col: str, share: float) -> int | None:
    """The least value of a column of whole numbers that a share of its values does not exceed, exact at any
    size (quantile_disc in SQL); None without values. Each round counts at most 4,097 ranges of equal width
    and goes on in the one that holds the rank: three rounds for a hundred million successive numbers, six at most."""
    x = F.col(col)
    n, low, high = rows.agg(F.count(x), F.min(x), F.max(x)).first()
    rank = max(1, math.ceil(n * Fraction(str(share))))
    while n and low < high:
        shift = max(0, (high - low).bit_length() - 12)
        counts = rows.filter(x.between(low, high)).groupBy(F.shiftright(x, shift).alias("range")).agg(F.count(F.lit(1)).alias("n"))
        for at, here in sorted(tuple(r) for r in counts.collect()):
            if rank <= here:
                break
            rank -= here
        low, high = max(low, at << shift), min(high, ((at + 1) << shift) - 1)
    return low


def checked(batch: DataFrame, dim: int, vec_col: str = "vector") -> DataFrame:
    """Rows to append, failing on a vector of another dimension."""
    return batch.filter(F.assert_true(F.size(vec_col) == dim).isNull())


def migrated(vectors: DataFrame, dim: int, vec_col: str = "vector") -> tuple[DataFrame, bool]:
    """(the table, False) if its vectors have the dimension; else (no rows, True): embed anew."""
    other = vectors.filter(F.size(vec_col) != dim).limit(1).count()
    return (vectors.limit(0), True) if other else (vectors, False)
