"""Shapes of plans and spread of rows, where a larger input would meet the limits of one task."""

import pytest
from pyspark.sql import functions as F

from engram.operators import graph as G
from engram.operators import vector as V
from engram.plans import everything as catalogue
from engram.sources import proxies as P

DATA = "/root/testdata/sf0.001"
SEARCHES = ["episodes_context", "semantic_nodes", "semantic_node_hits", "episodes_browse", "episodes_search", "facts_search_bump", "near_duplicate_classify", "facts_search_text", "facts_text", "facts_find_duplicate", "facts_retrieve"]


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_are_no_nested_loop_and_deal_the_store(spark, name, monkeypatch):
    seen, best = [], V.topk_per_key
    monkeypatch.setattr(V, "topk_per_key", lambda df, *a: seen.append(df._jdf.queryExecution().analyzed().toString()) or best(df, *a))
    catalogue.QUERIES[name](spark, DATA)
    assert seen and all("MapInArrow" in plan and "RepartitionByExpression" in plan for plan in seen)


def test_operations_with_null_keys_go_to_many_tasks(spark):
    ops = spark.range(4000).select(F.col("id").alias("op_id"), F.lit("add_alias").alias("op_type"), *(F.lit(None).cast("string").alias(c) for c in ("source_id", "target_id", "relation", "edge_id")), F.lit(0.9).alias("confidence"), F.lit("n").alias("node_id"), F.col("id").cast("string").alias("alias"))
    nodes = spark.createDataFrame([("n",)], "id string")
    edges = spark.createDataFrame([], "id string, source_id string, target_id string, relation string, weight double, confidence double, active boolean")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        checked = G.validate_operations(ops, nodes, edges)
        held = [r["count"] for r in checked.where("is_valid").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(held) == 4000 and max(held) < 2000


def test_operations_are_checked_once_and_met_with_edges_once(spark):
    after = catalogue.QUERIES["ops_edges_after"](spark, DATA)
    assert not any("lineitem" in f for f in after.inputFiles())
    assert after._jdf.queryExecution().analyzed().toString().count("Join LeftOuter") == 1


def test_operations_with_null_keys_keep_their_reasons(spark):
    rows = [(1, "insert_edge", None, "n", "uses", None, None), (2, "insert_edge", "n", "m", None, None, None), (3, "deactivate_edge", None, None, None, None, None), (4, "add_alias", None, None, None, None, None), (5, None, "n", "m", "uses", "e", "n"), (6, "insert_edge", "n", "m", "uses", None, None), (7, "insert_edge", "n", "m", "uses", None, None)]
    ops = spark.createDataFrame(rows, "op_id int, op_type string, source_id string, target_id string, relation string, edge_id string, node_id string").withColumns({"confidence": F.lit(0.9), "alias": F.lit("a")})
    nodes = spark.createDataFrame([("n",), ("m",)], "id string")
    edges = spark.createDataFrame([], "id string, source_id string, target_id string, relation string, weight double, confidence double, active boolean")
    got = {r.op_id: r.reason for r in G.validate_operations(ops, nodes, edges).collect()}
    assert got == {1: "node missing", 2: "unknown relation", 3: "edge missing", 4: "node missing", 5: "unknown operation", 6: None, 7: "duplicate"}


def test_edges_are_dealt_before_they_are_summed(spark):
    assert "REPARTITION_BY_COL" in P.edges(spark, DATA)._jdf.queryExecution().executedPlan().toString()
