"""Memory tables as projections of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.lower("p_type").alias("heading"), (F.col("p_size") / 50.0).alias("importance"),
        ((F.col("p_retailprice") - 900) / 100.0).alias("confidence"), F.col("p_size").alias("access_count"), (F.col("p_partkey") % 50).alias("traversal_count"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.lower("p_brand").alias("alias"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    # few rows share a pair, so they are dealt before they are summed: a task sorts a part of a shuffle and not a whole file split
    g = table(spark, sf_dir, "lineitem").repartition("l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(
        F.round(F.avg("l_discount") * 10, 6).alias("weight"), F.round(F.avg("l_quantity") / 50, 6).alias("confidence"), (F.max("l_linestatus") == "O").alias("active"), F.max("l_returnflag").alias("flag")
    )
    s, t = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    relation = F.when(F.col("flag") == "A", "uses").when(F.col("flag") == "N", "related_to").otherwise("mentions")
    return g.select(F.concat_ws("-", s, t).alias("id"), s.alias("source_id"), t.alias("target_id"), relation.alias("relation"), "weight", "confidence", "active")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max("l_discount").alias("d"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"))
    return g.select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("memory_id"), F.when(F.col("r") == 1, "semantic").otherwise("episodic").alias("memory_type"), F.round(1 - F.col("d"), 6).alias("relevance"))


def working_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "click", 10).otherwise(20)
    e = table(spark, sf_dir, "events").where("event_id is not null")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("memory_type"), F.get_json_object("props", "$.k").alias("key"), F.least(F.lit(1.0), F.col("value") / 500).alias("priority"),
        F.col("ts").alias("created_at"), F.when(F.col("event_type") != "signup", F.col("ts") + F.make_dt_interval(days)).alias("expires_at"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("queued_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("processed_at"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), (F.col("o_custkey") % 8).alias("owner"), F.col("o_orderdate").alias("start_time"), F.col("o_orderdate").alias("end_time"),
        (F.col("o_orderkey") % 12).alias("turn_count"), (F.col("o_orderkey") % 100 / 100.0).alias("importance"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("decay_count"),
    )
