"""Plans are those wanted: pruned scans, top-k without full sorts, no nested loops."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.operators import vector as V
from quarry.plans.catalogue import QUERIES
from quarry.session import table

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark):
    p = plan(R.matching(table(spark, DATA, "part"), p_size__in=[5, 10]).select("p_partkey"))
    assert re.search(r"PushedFilters: \[[^\]]*In\(p_size", p) and "p_name" not in p


def test_top_k(spark):
    v = table(spark, DATA, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    p = plan(V.knn(v, [0.0] * 64, 5))
    assert "TakeOrderedAndProject" in p and "Exchange hashpartitioning" not in p


@pytest.mark.parametrize("name", ["longest_prefix_package", "edge_upsert_merge", "context_expansion_scored", "name_to_id", "unclustered_symbols"])
def test_no_nested_loops(spark, name):
    assert "NestedLoop" not in plan(QUERIES[name](spark, DATA))


@pytest.mark.parametrize("name", ["bm25_multi_boosted", "rrf_fusion", "weighted_score_fusion", "longest_prefix_package", "identifier_evidence", "tokenize_code"])
def test_rows_stay_in_the_jvm(spark, name):
    """The one nested loop of BM25 joins a row per query term with a row per field."""
    p = plan(QUERIES[name](spark, DATA))
    assert "Cartesian" not in p and "EvalPython" not in p and "InPandas" not in p and p.count("BroadcastNestedLoopJoin") <= 1
