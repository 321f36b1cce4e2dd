import json

from pyspark.sql import functions as F

from quarry.streaming import watch as W

SNAP = "file_path string, mtime_ns long, size_bytes long"


def test_compare_and_refresh(spark):
    a = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], SNAP)
    b = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], SNAP)
    changes = W.compare(a, b)
    assert {tuple(r) for r in changes.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")}
    assert W.counters(changes) == {"scanned": 3, "indexed": 2, "unchanged": 1, "deleted": 1}
    table = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "file_path string, v string")
    out = W.refresh({"t": table}, changes, lambda files: {"t": files.withColumn("v", F.lit("new"))})
    assert {tuple(r) for r in out["t"].collect()} == {("a", "old"), ("b", "new"), ("d", "new")}


def test_watch(spark):
    snaps = [[("a", 1, 1)], [("a", 1, 1)], [("a", 2, 1)], [("a", 2, 1), ("b", 1, 1)]]
    turn = iter(snaps)
    applied, waits, now = [], [], iter(range(0, 1000, 10))
    done = W.watch(lambda: spark.createDataFrame(next(turn), SNAP), lambda c: applied.append(c.count()), 4, sleep=waits.append, clock=lambda: next(now))
    assert [d["indexed"] for d in done] == [1, 1, 1] and len(waits) == 4

    def broken():
        raise OSError

    waits.clear()
    assert W.watch(broken, lambda c: None, 3, sleep=waits.append) == [] and waits == [0.25, 0.5, 1.0]
    assert W.backoff(20) == 5.0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ts": f"2024-01-0{d} 0{h}:00:00", "event_type": t, "user_id": 1, "value": 1.5} for d, h, t in ((1, 1, "view"), (1, 2, "view"), (2, 3, "click"))]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    schema = "ts timestamp, event_type string, user_id long, value double"
    q = W.arrivals(spark, str(tmp_path / "in"), schema, lambda df, n: seen.extend(tuple(r) for r in W.tumbling(df).select("event_type", "n", "total").collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == [("click", 1, 1.5), ("view", 2, 3.0)]
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out = W.sessions(stream, gap="90 minutes").writeStream.format("memory").queryName("held").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    out.awaitTermination(60)
    batch = W.sessions(spark.read.schema(schema).json(str(tmp_path / "in")), gap="90 minutes")
    assert batch.count() == 2 and spark.table("held").count() <= 2
