"""Near-duplicate embeddings by the epsilon grid order join.

Cosine at least c between unit vectors is a distance of at most eps = sqrt(2 - 2c). Vectors are turned
onto the principal directions of a bounded sample (any rotation keeps distances, so the fit touches only
speed), put into grid cells of side eps on the leading directions, and sorted by cell. The sorted sequence
is cut into blocks. Pairs of blocks with neighbouring cells whose bounding boxes lie within eps are joined
recursively: intervals are halved until they are small, and every pair of intervals whose boxes, over all
directions, are provably further apart than eps is skipped. What remains is compared in double precision
with the unturned vectors.

The sequence is cut into stripes of a few blocks, and a block is sent once to each stripe that holds blocks
near it, however many those are. A joined pair of blocks returns the number of links of each vector and a spanning forest of the links, at
most one edge per vector, so that a dense cluster never lists its pairs. Equal vectors form one class with
a weight and are compared once.

Nulls: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do
vectors of different lengths. A null identifier yields to any other as component_id. Rows repeated with
one identifier count as links of each other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import sqrt, sumprod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import RANKED, components, lean, materialize, partitions, rank_of, ranked

#: How close to the threshold a product of unit vectors is settled by sums rounded once.
CLOSE = 1e-12
#: Vectors the directions are fitted on, leading directions with a grid, vectors of a block and of an
#: interval that is compared outright.
SAMPLE, GRID, BLOCK, LEAF = 2048, 3, 2048, 256
#: Blocks of a stripe on average: what a task holds of one side.
STRIPE = 8
_CELLS = ["_c0", "_c1", "_c2"]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which rounds nothing, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two scaled vectors with sums that are rounded once."""
    a, b = a.tolist(), b.tolist()
    return sumprod(a, b) / sqrt(sumprod(a, a) * sumprod(b, b))


def directions(x: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the directions of greatest variance first."""
    full = np.linalg.svd(x - x.mean(0), full_matrices=True)[2] if len(x) > 1 else np.eye(x.shape[1])
    return np.ascontiguousarray(full.T)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), d)


def _cells(bases: dict[int, np.ndarray], eps: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("_d").to_numpy()
            cells = np.zeros((b.num_rows, GRID), np.int32)
            lead = np.zeros(b.num_rows)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                basis = bases.get(int(d))
                u = unit(_matrix(b.column("_v").take(pa.array(rows)), d))
                p = u @ basis if basis is not None else u
                k = min(GRID, int(d))
                cells[rows, :k] = np.floor(p[:, :k] / eps)
                lead[rows] = p[:, k] if d > k else 0.0
            cols = [*(b.column(c) for c in b.schema.names), *(pa.array(cells[:, k], pa.int32()) for k in range(GRID)), pa.array(lead)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *_CELLS, "_lead"])

    return run


def _blocks(size: int, bases: dict[int, np.ndarray]):
    """Blocks of the sorted sequence: identifiers, weights and vectors as bytes, cells, bounding box."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, weights, vectors, cells, dim = [], [], [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, weights, vectors, cells, number
            if not ids:
                return
            x = np.array(vectors, float)
            p = unit(x) @ bases[dim] if dim in bases else unit(x)
            lo, hi = p[:, :GRID].min(0), p[:, :GRID].max(0)
            row = {
                "block": pa.array([number], pa.int64()), "d": pa.array([dim], pa.int32()), "ids": pa.array([b"".join(ids)], pa.binary()),
                "weights": pa.array([np.array(weights, np.int64).tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()),
                "cells": pa.array([[dict(zip("xyz", c, strict=True)) for c in sorted(set(cells))]], pa.list_(pa.struct([(n, pa.int32()) for n in "xyz"]))),
                "lo": pa.array([lo.tolist()], pa.list_(pa.float64())), "hi": pa.array([hi.tolist()], pa.list_(pa.float64())),
            }
            number += 1
            ids, weights, vectors, cells = [], [], [], []
            yield pa.RecordBatch.from_pydict(row)

        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("_d", "_cls", "_w", "_v", *_CELLS))
            for d, i, w, v, *c in zip(*cols, strict=True):
                if d != dim or len(ids) >= size:
                    yield from flush()
                    dim = d
                ids.append(i)
                weights.append(w)
                vectors.append(v)
                cells.append(tuple(c))
        yield from flush()

    return run


def _forest(m: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges (row, column) that connect what the links m connect, one per row or column reached."""
    rows_left, cols_left = m.any(1), m.any(0)
    while rows_left.any():
        front = np.array([int(rows_left.argmax())])
        rows_left[front] = False
        while len(front):
            part = m[front] & cols_left
            cols = np.flatnonzero(part.any(0))
            if not len(cols):
                break
            yield from zip(front[part[:, cols].argmax(0)].tolist(), cols.tolist(), strict=True)
            cols_left[cols] = False
            part = m[:, cols] & rows_left[:, None]
            front = np.flatnonzero(part.any(1))
            yield from zip(front.tolist(), cols[part[front].argmax(1)].tolist(), strict=True)
            rows_left[front] = False


class Joiner:
    """Joins two blocks, or a block with itself, by halving intervals."""

    def __init__(self, least: float):
        self.least = least
        self.reach = 2 - 2 * least + 1e-9  # squared distance, with room for rounding

    def join(self, x: np.ndarray, wu: np.ndarray, y: np.ndarray, wv: np.ndarray, basis: np.ndarray | None, same: bool, units: tuple | None = None):
        """(links of x's rows, links of y's rows, edges). ``units``: both at length 1, if at hand."""
        u, v = units or (unit(x), unit(y))
        self.x, self.y, self.u, self.v, self.wu, self.wv, self.same = x, y, u, v, wu, wv, same
        self.pu = u if basis is None else u @ basis
        self.pv = self.pu if same else (v if basis is None else v @ basis)
        self.nu, self.nv, self.edges = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64), []
        self.boxes: dict = {}
        self._go(0, len(u), 0, len(v))
        return self.nu, self.nv, self.edges

    def _box(self, right: bool, a: int, b: int):
        got = self.boxes.get((right, a, b))
        if got is None:
            p = (self.pv if right else self.pu)[a:b]
            got = self.boxes[right, a, b] = (p.min(0), p.max(0))
        return got

    def _go(self, a: int, b: int, c: int, d: int) -> None:
        if a >= b or c >= d or (self.same and a > c):
            return
        mirror = self.same and a == c and b == d
        if not mirror:
            (lo, hi), (lo2, hi2) = self._box(False, a, b), self._box(not self.same, c, d)
            gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
            if gap @ gap > self.reach:
                return
        if max(b - a, d - c) > LEAF:
            mid, mid2 = (a + b) // 2, (c + d) // 2
            if b - a > LEAF and d - c > LEAF:
                for x, y in ((a, mid), (mid, b)):
                    for z, w in ((c, mid2), (mid2, d)):
                        self._go(x, y, z, w)
            elif b - a > LEAF:
                self._go(a, mid, c, d)
                self._go(mid, b, c, d)
            else:
                self._go(a, b, c, mid2)
                self._go(a, b, mid2, d)
            return
        product = self.u[a:b] @ self.v[c:d].T
        m = product >= self.least
        near = np.abs(product - self.least) < CLOSE
        if near.any():
            for i, j in np.argwhere(near).tolist():
                m[i, j] = cosine(*scaled(np.stack([self.x[a + i], self.y[c + j]]))) >= self.least
        if mirror:
            np.fill_diagonal(m, False)
        if not m.any():
            return
        self.nu[a:b] += m @ self.wv[c:d]
        if not mirror:
            (self.nu if self.same else self.nv)[c:d] += self.wu[a:b] @ m
        self.edges += [(a + i, c + j) for i, j in _forest(m)]


def _joined(least: float, bases: dict[int, np.ndarray]):
    """For blocks dealt by stripe, a stripe's own ones first, each with the numbers of its partners among
    those: (class, links) rows, and (class, class) rows of the forest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, stripe, own = Joiner(least), None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r]  # noqa: B023, E731
                if get("_stripe").as_py() != stripe:
                    stripe, own = get("_stripe").as_py(), {}
                d, number, raw = get("d").as_py(), get("block").as_py(), get("ids").as_py()
                y = np.frombuffer(get("vectors").as_buffer(), float).reshape(-1, d)
                block = ([raw[i : i + RANKED] for i in range(0, len(raw), RANKED)], y, unit(y), np.frombuffer(get("weights").as_buffer(), np.int64).copy())
                if number >> 32 == stripe:
                    own[number] = (block[0], y.copy(), *block[2:])
                iv, y, v, wv = block
                for other in get("_with").as_py():
                    iu, x, u, wu = own[other]
                    nu, nv, edges = joiner.join(x, wu, y, wv, bases.get(d), other == number, (u, v))
                    out: list[tuple] = [(iu[k], None, int(nu[k])) for k in np.flatnonzero(nu)]
                    out += [(iv[k], None, int(nv[k])) for k in np.flatnonzero(nv)]
                    out += [(iu[i], iv[j], 0) for i, j in edges]
                    if out:
                        p, q, n = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(p, pa.binary()), pa.array(q, pa.binary()), pa.array(n, pa.int64())], names=["x", "y", "n"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept. Links have cosine >= ``least``."""
    spark = vectors.sparkSession
    lean(spark)
    eps = sqrt(2 - 2 * least)
    v = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    sound = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    v = v.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    key = F.unhex(F.md5(F.concat(F.to_binary(F.hex(F.xxhash64("_v")), F.lit("hex")), F.to_binary(F.hex(F.xxhash64(F.lit(1), "_v")), F.lit("hex")))))
    v = v.withColumn("_cls", F.when(F.col("_ok"), key))
    classes = v.filter("_ok").groupBy("_cls").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_w"), F.any_value("_v").alias("_v"))
    classes = materialize(classes.withColumn("_d", F.size("_v")).withColumn("_key", ranked("_rep", "_cls")), "classes")
    n = classes.count()

    some = classes.orderBy(F.xxhash64("_cls")).limit(SAMPLE).select("_d", "_v").collect()
    bases = {}
    for d in {r._d for r in some}:
        bases[d] = directions(unit(np.array([r._v for r in some if r._d == d], float)))

    celled = classes.select(F.col("_key").alias("_cls"), "_w", "_d", "_v").mapInArrow(
        _cells(bases, eps), "_cls binary, _w long, _d int, _v array<double>, " + ", ".join(f"{c} int" for c in _CELLS) + ", _lead double"
    )
    order = ["_d", *_CELLS, "_lead", "_cls"]
    stripes = partitions(spark, n, STRIPE * BLOCK)
    dealt = celled.repartitionByRange(stripes, *order).sortWithinPartitions(*order)
    blocks = materialize(
        dealt.mapInArrow(
            _blocks(BLOCK, bases),
            "block long, d int, ids binary, weights binary, vectors binary, cells array<struct<x int, y int, z int>>, lo array<double>, hi array<double>",
        ),
        "blocks",
    )
    meta = blocks.select("block", "d", "lo", "hi", F.explode("cells").alias("c")).select("block", "d", "lo", "hi", "c.*")
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    near = meta.select(F.col("block").alias("b"), "d", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), *"xyz")
    for c in "xyz":
        near = near.withColumn("_s", F.explode(steps)).withColumn(c, F.col(c) + F.col("_s")).drop("_s")
    near = near.distinct()
    apart = F.zip_with(F.zip_with("lo", "hi2", lambda p, q: p - q), F.zip_with("lo2", "hi", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    close = F.aggregate(apart, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps + 1e-9
    pairs = (
        meta.withColumnRenamed("block", "a").join(near, ["d", *"xyz"]).filter((F.col("a") <= F.col("b")) & close)
        .select("a", "b").distinct()
    )
    # a partition of the sorted sequence is a stripe; a block goes once to each stripe that it is near to
    to = pairs.groupBy(F.shiftright("a", 32).alias("_stripe"), F.col("b").alias("block")).agg(F.collect_list("a").alias("_with"))
    sent = blocks.select("block", "d", "ids", "weights", "vectors").join(to, "block").withColumn("_far", F.shiftright("block", 32) != F.col("_stripe"))
    sent = sent.repartition(stripes, "_stripe").sortWithinPartitions("_stripe", "_far", "block")
    found = materialize(sent.mapInArrow(_joined(least, bases), "x binary, y binary, n long"), "found")

    counts = found.filter("y IS NULL").groupBy("x").agg(F.sum("n").alias("_n"))
    roots = components(found.filter("y IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    of_class = classes.select("_cls", "_key", "_w").join(roots, F.col("_key") == F.col("node"), "left").join(counts, F.col("_key") == F.col("x"), "left")
    links = (F.coalesce("_n", F.lit(0)) + F.col("_w") - 1).alias("n_links")
    result = materialize(of_class.select("_cls", links, rank_of(F.coalesce("root", "_key")).alias("_least")), "members")
    component = F.when(F.col("_cls").isNull(), F.col("_id")).otherwise(F.col("_least"))
    return (
        v.select("_id", "_cls").join(result, "_cls", "left")
        .select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
    )
