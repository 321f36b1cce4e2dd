import numpy as np
import pytest

import corpus_pipeline
from quarry.llm.packing import Ids, default_tokenizer

from .test_minhash import shingles
from .test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs, labels = corpus(300, 3)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in docs]
    long = [" ".join(f"w{k}{j}" for j in range(120)) for k in range(5)]
    rows += [(1000 + k, t, "en", "s9", len(t)) for k, t in enumerate(long)]
    rows += [(1100 + k, t.replace(" ", "  ", 3), "en", "s9", len(t)) for k, t in enumerate(long)]  # equal after white space
    rows += [(1200 + k, t + " more", "en", "s1", len(t)) for k, t in enumerate(long)]  # near copies
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == names
            kept.append({r.doc_id for r in docs.collect()})
        if name == "mixing":
            counts = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert set(counts) <= kept[-2] and max(counts.values()) <= 3
            texts = {r.doc_id: r.text for r in before.collect()}
    toxic, exact, near, mixed = kept
    assert {1000, 1100, 1200, 2000, 2001} <= toxic and len(toxic) < 317
    assert {1000, 1200, 2000} <= exact and not {1100, 1101, 2001} & exact
    assert not {1200, 1201, 1202, 1203, 1204} & near and {1000, 2000} <= near
    sets = {r.doc_id: shingles(r.text, 5) for r in spark.read.parquet(f"{folder}/2-minhash").collect()}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                assert 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)
    ids = Ids(default_tokenizer())
    pieces = docs.toPandas()
    total = {i: len(ids.batch([texts[i]])[0]) // np.dtype(ids.kind).itemsize + 1 for i in counts}
    assert pieces.length.sum() == sum(total[i] * n for i, n in counts.items())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def stored(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return spark.read.parquet(path)


def test_near_copies_go_by_row(spark, tmp_path):
    long = [" ".join(f"w{k}{j}" for j in range(120)) for k in range(4)]
    rows = [(1, long[0]), (7, long[0] + " more"), (7, long[1]), (None, long[2]), (None, long[1] + " more"), (3, long[2] + " more"), (None, long[3]), (None, None)]
    docs = stored(spark, [(i, t, "en", "s", 0) for i, t in rows], f"{tmp_path}/docs")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {(1, long[0]), (7, long[1]), (3, long[2] + " more"), (None, long[3]), (None, None)}


def test_mix_takes_by_row(spark, tmp_path):
    from quarry.llm import mixing

    rows = [(None if k % 3 else k % 5, f"a{k} " * (1 + k % 7), "en", f"s{k % 3}", 0) for k in range(240)]
    rows += [(9, "same words here", "en", "s0", 0)] * 6
    docs = stored(spark, rows, f"{tmp_path}/docs")
    targets = {r.source_size: r.target for r in mixing.mix(docs).collect()}
    sizes: dict = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    assert len(targets) == len(sizes) == 3
    got: dict = {}
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    for s, n in sizes.items():
        assert abs(got.get(s, 0) - targets[n]) <= 7, (s, got, targets)


CLASH = "_all string, _row long, _key string, _copies int, _copy int, _kept int, _doc long, _metadata string, `a.b` string, _h long"


def clashing(spark, rows, path):
    """Documents with columns named like those that the stages use."""
    kind = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
    spark.createDataFrame([(i, t, "en", f"s{k % 2}", 0, "x", 1, "y", 2, 7, 3, 4, "z", "w", k) for k, (i, t) in enumerate(rows)], kind).write.parquet(path)
    return spark.read.parquet(path)


def test_extra_columns_and_repeated_identifiers(spark, folder, tmp_path):
    long = [" ".join(f"w{k}{j}" for j in range(120)) for k in range(3)]
    rows = [(1, long[0]), (1, long[0]), (1, long[1]), (2, long[1] + " more"), (None, long[2]), (None, None), (5, ""), (5, None)]
    docs = clashing(spark, rows, f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        got = out.collect()
        assert {(r._all, r._copy, r._metadata, r["a.b"]) for r in got} <= {("x", 7, "z", "w")}, name
        texts = sorted((r.text or "") for r in got)
        if name == "toxicity":
            assert len(got) == len(rows)
        elif name == "exact_dedup":
            assert texts == sorted(["", long[0], long[1], long[1] + " more", long[2]])
        elif name == "minhash":
            assert texts == sorted([long[0], long[0], long[1], long[2], "", "", ""][1:]) or texts == sorted([long[0], long[1], long[2], "", "", ""])
        else:
            sizes = {}
            for r in got:
                sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
            whole = {s: sum(len((t or "").split()) for k, (_, t) in enumerate(rows) if f"s{k % 2}" == s) for s in sizes}
            assert sizes["s0"] <= 3 * whole["s0"] + 120 and abs(sum(sizes.values()) - sum(whole.values())) <= 240
    assert corpus_pipeline.pack_windows(spark, docs, folder).select("doc_id", "start").distinct().count() >= 4


def test_empty_tables(spark, folder, tmp_path):
    docs = clashing(spark, [(1, "a")], f"{tmp_path}/one").limit(0)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


def test_stages_delete_only_their_own_tables(spark, folder, tmp_path):
    from quarry.llm import minhash

    docs = stored(spark, [(k, f"some text {k}", "en", "s", 0) for k in range(20)], f"{tmp_path}/docs")
    held = minhash.near_duplicates(docs)
    for _, stage in corpus_pipeline.STAGES[:2]:
        stage(spark, docs, folder).count()
    assert held.count() == 20
