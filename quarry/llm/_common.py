"""What the operators share: shared-folder tables, row numbering, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from ctypes import CDLL
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
_LIBC = CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a temporary folder set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="quarry-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Collects the tables that ``materialize`` writes while it is entered, so that whoever needs their
    frames no longer can delete exactly those: other frames of the application keep theirs."""

    _open: ClassVar[list[Tables]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        Tables._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Tables._open.remove(self)

    def delete(self) -> None:
        while self.paths:
            _delete(self.spark, self.paths.pop())


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts lineage so that a lost executor costs only re-reading, and keeps values that two later
    branches must agree on from being computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{what}-{uuid.uuid4().hex}"
    for tables in Tables._open:
        tables.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a key of ``ranked`` over 16 bytes.
RANKED = 25


def ranked(rank: str, of: str) -> Column:
    """A key that sorts by the long ``rank``, null last, and then by the 16 bytes ``of``: the least key of a
    component names its least rank, which saves a join on the component."""
    sign = F.col(rank).bitwiseXOR(F.lit(-(1 << 63)))
    front = F.when(F.col(rank).isNull(), F.lit("01" + "00" * 8)).otherwise(F.concat(F.lit("00"), F.lpad(F.hex(sign), 16, "0")))
    return F.concat(F.unhex(front), of)


def rank_of(key: Column) -> Column:
    """The rank in a key of ``ranked``."""
    low = F.conv(F.hex(F.substring(key, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", low.cast("long"))


def partitions(spark: SparkSession, amount: float, each: float) -> int:
    """A partition count that follows the data: one per ``each`` of ``amount``, never fewer than
    the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(amount // each) + 1)


def lean(spark: SparkSession) -> None:
    """Keeps Arrow batches of the session to a few MB: texts are long, and each task holds several batches
    in the JVM and in Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 300) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so that Python holds few texts at a time. What a task took goes back to
    the system at its end: workers live on and would keep it while the next stages run."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(_LIBC, "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def crc_fold(col: str | Column, folds: int) -> Column:
    """crc32 of an identifier's decimal text, modulo ``folds`` (null identifiers: fold of '')."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def numbered(df: DataFrame, order: list[Column], to: str, n: int | None = None) -> DataFrame:
    """Adds a gapless global row number from 0 in the given order without a single-task sort.

    Rows are range-partitioned by ``order``, numbered within each range, and shifted by the counts of
    the ranges before; only one row per partition is gathered for the shifts.
    """
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    held = materialize(
        ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "numbered"
    )
    counts = held.groupBy("_part").count()
    before = counts.select(
        "_part",
        (F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
    )
    return (
        held.join(before, "_part")
        .withColumn(to, (F.coalesce("_before", F.lit(0)) + F.col("_rank") - 1).cast("long"))
        .drop("_part", "_rank", "_before")
    )


#: Edges that one task contracts at a time.
CHUNK = 300_000


def _contract(chunk: int):
    """Edges (a, b) to (node, least node of its component), for each run of ``chunk`` edges by itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict = {}
        held, kind = 0, None

        def find(x):
            root = x
            while top[root] != root:
                root = top[root]
            while top[x] != root:
                top[x], x = root, top[x]
            return root

        def flush() -> Iterator[pa.RecordBatch]:
            nodes = list(top)
            for at in range(0, len(nodes), 50_000):
                some = nodes[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([find(x) for x in some], kind)], names=["a", "b"])

        for b in slices(batches, 20_000):
            kind = b.schema.field("a").type
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                top.setdefault(x, x)
                top.setdefault(y, y)
                x, y = find(x), find(y)
                if x < y:
                    top[y] = x
                elif y < x:
                    top[x] = y
            held += b.num_rows
            if held >= chunk:
                yield from flush()
                top, held = {}, 0
        yield from flush()

    return run


def components(edges: DataFrame, what: str = "cc", max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): one row (node, root) per node with an
    edge to another, ``root`` being the least node of its component.

    Runs of at most ``chunk`` edges are contracted each by one task to stars around their least nodes. If
    there is but one run, that is all. Otherwise large-star and small-star rounds join the stars; they
    converge in a logarithmic number of rounds whatever the diameter. Every step is a partial aggregate
    and a join against one row per node; the neighbours of a node are never gathered. Edges are written to
    the shared folder in each round.
    """
    a, b = F.col("a"), F.col("b")

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    kind = edges.schema["a"].dataType.simpleString()
    e = materialize(edges.filter(a != b).select("a", "b"), what)
    n = e.count()
    stars = e.coalesce(n // chunk + 1).mapInArrow(_contract(chunk), f"a {kind}, b {kind}")
    if n < chunk:
        return materialize(stars.select(a.alias("node"), b.alias("root")), what)
    e = materialize(tidy(stars), what)
    seen = mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = tidy(both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        e = materialize(tidy(small), what)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(e.select(b.alias("node"), b.alias("root")).distinct())
