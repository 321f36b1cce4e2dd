"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words. A document of the source is to be taken target / source size
times on average: the whole part is certain, the fractional part is rounded by the pivotal method. Two
documents with fractional probabilities meet, and probability mass, counted in words, moves randomly
from one to the other until one of them is 0 or 1. Words are conserved in each meeting, so the total of
a source moves only when its very last fraction is rounded, by less than one document.

The rounding runs as a reduction tree: hashed buckets of each source are rounded in parallel down to one
open document each, the open documents of ``FAN`` buckets meet next, and so on to one per source. Random
numbers derive from the source, the bucket and a seed. Documents meet by falling size, ties in hash order:
reruns agree however the input is partitioned, and the document left open at the end is a short one.

Nulls: a null text has size 0, a null source is a source of its own (last in order), null identifiers
are allowed. A document of size 0 adds no word to any total and has one copy. Repeated rows are separate
documents. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, numbered

#: Documents of a bucket on average, and buckets that meet in the next level of the tree.
BUCKET, FAN = 4096, 64


def words(col: str) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(_src, source_size, n_docs, target) of each source of ``sizes`` (source, size).

    Sources in code-point order, null last, get the weights in turn and share the total of all sizes.
    No target exceeds ``cap`` times its source; what is above is shared again by weight among the rest.
    Each round of sharing is one aggregate over the sources, which stay distributed.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    src = numbered(src, [F.col("source").isNull(), F.col("source")], "_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_no") % len(weights) + 1).cast("int"))
    src = materialize(src.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap))), "sources")
    total = float(src.agg(F.sum("source_size")).first()[0] or 0)
    level, seen = 0.0, -1
    while True:
        full = F.col("_cap") <= F.col("_w") * F.lit(level)
        held, w, n = src.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w"))), F.count(F.when(full, 1))).first()
        if n == seen or not w:
            break
        level, seen = (total - (held or 0.0)) / w, n
    return src.select(_key("source").alias("_src"), "source_size", "n_docs", F.least("_cap", F.col("_w") * F.lit(level)).alias("target"))


def _key(col: str) -> Column:
    return F.when(F.col(col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(col)))


def meet(s: float, x: float, t: float, y: float, u: float) -> tuple[float, float, int]:
    """One pivotal meeting of documents of sizes s and t that hold x and y words of mass, on the random
    number u. Returns the new masses and which is settled: 1 the first, 2 the second, 3 both."""
    up, down = min(s - x, y), min(x, t - y)
    if u * (up + down) < down:
        full, gone = up == s - x, up == y
        return (s if full else x + up), (0.0 if gone else y - up), full + 2 * gone
    gone, full = down == x, down == t - y
    return (0.0 if gone else x - down), (t if full else y + down), gone + 2 * full


class _Round:
    """Rounds the documents of one group in sequence; at most one stays open."""

    def __init__(self, seed: str):
        self.rng = np.random.default_rng(xxhash.xxh64_intdigest(seed))
        self.open = None  # (row, size, mass)
        self.took: dict[int, float] = {}

    def add(self, row: int, size: float, mass: float) -> None:
        if mass <= 0 or mass >= size:
            self.took[row] = float(mass >= size)
        elif self.open is None:
            self.open = (row, size, mass)
        else:
            r, s, x = self.open
            a, b, done = meet(s, x, size, mass, self.rng.random())
            self.open = None
            for k, row_, size_, mass_ in ((1, r, s, a), (2, row, size, b)):
                if done & k:
                    self.took[row_] = float(mass_ > 0)
                else:
                    self.open = (row_, size_, mass_)


def _rounded(seed: int, level: int, last: bool):
    """Streams rows sorted by (_src, _up); adds _take (1, 0, or null if open) and the open _mass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, rnd, base = None, None, 0
        takes: dict[int, float] = {}
        masses: dict[int, float] = {}

        def close():
            if rnd is None:
                return
            takes.update(rnd.took)
            if rnd.open is not None:
                row, size, mass = rnd.open
                if last:
                    takes[row] = float(rnd.rng.random() * size < mass)
                else:
                    masses[row] = mass

        def flush(upto: int):
            nonlocal held, base, takes, masses
            out = pa.Table.from_batches(held)
            out = out.append_column("_take", pa.array([takes.get(base + k) for k in range(upto - base)], pa.float64()))
            out = out.drop_columns(["_mass"]).append_column("_mass", pa.array([masses.get(base + k) for k in range(upto - base)], pa.float64()))
            yield from out.to_batches()
            held, base, takes, masses = [], upto, {}, {}

        row = 0
        for b in batches:
            cut = 0
            for k, (src, up, size, mass) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_src", "_up", "size", "_mass")), strict=True)):
                if (src, up) != group:
                    close()
                    if row + k - base >= 20_000:
                        held.append(b.slice(cut, k - cut))
                        yield from flush(row + k)
                        cut = k
                    group, rnd = (src, up), _Round(f"{seed}/{level}/{up}/{src}")
                rnd.add(row + k, size, mass)
            held.append(b.slice(cut))
            row += b.num_rows
        close()
        if row > base:
            yield from flush(row)

    return run


def _level(df: DataFrame, seed: int, level: int, last: bool, *order: str) -> DataFrame:
    dealt = df.repartition("_src", "_up").sortWithinPartitions("_src", "_up", F.col("size").desc(), *order)
    fields = [f for f in df.schema.fields if f.name != "_mass"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _take double, _mass double"
    return materialize(dealt.mapInArrow(_rounded(seed, level, last), schema), "round")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """One row per document: ``id_col``, size, source_size, target (of its source), copies, taken."""
    sizes = materialize(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words(text_col).alias("size"), F.xxhash64(id_col, text_col).alias("_h")),
        "sizes",
    )
    targets = materialize(source_targets(sizes, weights, cap), "targets")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sizes.withColumn("_src", _key("source"))
        .join(targets, "_src")
        .withColumn("_whole", F.floor(rate).cast("long"))
        .withColumn("_mass", (rate - F.floor(rate)) * F.col("size"))
        .withColumn("_up", F.pmod(F.col("_h"), F.ceil(F.col("n_docs") / BUCKET)).cast("long"))
        .withColumn("_leaf", F.col("_up"))
        .select("_id", "size", "source_size", "target", "_src", "_leaf", "_up", "_whole", "_mass", "_h")
    )
    leaves = _level(rows, seed, 0, False, "_h", "_id")
    levels = leaves.agg(F.max("_up")).first()[0]
    open_ = leaves.filter("_take IS NULL").select("_src", "_leaf", "_up", "size", "_mass")
    settled, level = None, 0
    while level == 0 or levels > 0:
        level += 1
        levels = (levels or 0) // FAN
        up = open_.withColumn("_up", F.floor(F.col("_up") / FAN).cast("long"))
        done = _level(up, seed, level, levels == 0, "_leaf")
        now = done.filter("_take IS NOT NULL").select("_src", "_leaf", F.col("_take").alias("_late"))
        settled = now if settled is None else settled.unionByName(now)
        open_ = done.filter("_take IS NULL").drop("_take")
    late = leaves.filter("_take IS NULL").join(settled, ["_src", "_leaf"], "left").select(*leaves.columns, "_late")
    out = leaves.filter("_take IS NOT NULL").withColumn("_late", F.col("_take")).unionByName(late)
    copies = F.col("_whole") + F.coalesce("_late", F.lit(0.0)).cast("long")
    return out.select(
        F.col("_id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
