"""Change detection and continuous indexing.

A snapshot is a table of file_path and fingerprint columns. ``compare`` finds what changed between two of
them in one full outer join; ``refresh`` applies a change set to stored tables by anti-joins; ``watch``
runs it on a schedule; ``arrivals`` does the same for files that arrive in a folder, as a stream.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def compare(before: DataFrame, now: DataFrame, prints: list[str] | None = None, key: str = "file_path") -> DataFrame:
    """(key, state): new, changed, deleted or unchanged."""
    prints = prints or ["mtime_ns", "size_bytes"]
    a = before.select(F.col(key), *[F.col(c).alias(f"_a_{c}") for c in prints], F.lit(True).alias("_a"))
    b = now.select(F.col(key), *[F.col(c).alias(f"_b_{c}") for c in prints], F.lit(True).alias("_b"))
    same = F.lit(True)
    for c in prints:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def counters(changes: DataFrame) -> dict[str, int]:
    """scanned, indexed, unchanged, deleted of a change set."""
    n = {r.state: r["count"] for r in changes.groupBy("state").count().collect()}
    indexed = n.get("new", 0) + n.get("changed", 0)
    return {"scanned": indexed + n.get("unchanged", 0), "indexed": indexed, "unchanged": n.get("unchanged", 0), "deleted": n.get("deleted", 0)}


def refresh(tables: dict[str, DataFrame], changes: DataFrame, extract: Callable[[DataFrame], dict[str, DataFrame]], key: str = "file_path") -> dict[str, DataFrame]:
    """The tables after a change set: rows of deleted and changed files go, what ``extract`` reads from
    new and changed files comes. The same as extracting everything anew."""
    gone = changes.filter(F.col("state").isin("deleted", "changed")).select(key)
    fresh = extract(changes.filter(F.col("state").isin("new", "changed")).select(key))
    out = {}
    for name, t in tables.items():
        kept = t.join(gone, key, "left_anti") if key in t.columns else t
        out[name] = kept.unionByName(fresh[name].select(*t.columns)) if name in fresh else kept
    return out


def backoff(failures: int, interval: float = 0.25, most: float = 5.0) -> float:
    """Seconds to wait after so many failures in a row."""
    return min(interval * 2**failures, most)


def watch(scan: Callable[[], DataFrame], apply: Callable[[DataFrame], None], rounds: int, interval: float = 0.25, least: float = 5.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> list[dict[str, int]]:
    """Polls snapshots and applies what changed, at most every ``least`` seconds; failures back off.

    Returns the counters of each change set applied."""
    interval, before, last, failures, done = max(interval, 0.05), None, None, 0, []
    for _ in range(rounds):
        sleep(backoff(failures, interval))
        try:
            now = scan()
            changes = compare(before if before is not None else now.limit(0), now)
            moved = changes.filter("state <> 'unchanged'")
            if moved.isEmpty() or (last is not None and clock() - last < least):
                before = before if before is not None else now
                continue
            apply(changes)
            done.append(counters(changes))
            before, last, failures = now, clock(), 0
        except Exception:  # the next round tries again
            failures += 1
    return done


def arrivals(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Applies each batch of files that arrive in a folder once, then stops (availableNow)."""
    rows = spark.readStream.schema(schema).format(fmt).load(folder)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, at: str = "ts", width: str = "1 day", late: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts and sums per window; works on streams (with a watermark) and on tables."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, at: str = "ts", gap: str = "30 minutes", late: str = "1 day", by: str = "user_id") -> DataFrame:
    """Runs of events of one key with no longer gap."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("session_start"), "n")
