"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts are one atomic group. Groups are ordered by the hash of the text and gathered into at most
2**BITS atomic units by its leading bits, so the sizes that the driver works on have a fixed bound at every scale. The
smallest capacity for which a greedy pass over the units needs no more than the allowed shards is found by binary
search, and the units are cut there. Equal texts always share a shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

BITS = 16
OVERHEAD = 16
SUB_ROWS, SUBS = 512, 1 << 16


def greedy(sizes: np.ndarray, capacity: int, most: int) -> list[int] | None:
    """Starts of the shards that a greedy pass makes, or None if it needs more than most."""
    ends = np.cumsum(sizes)
    starts, at = [], 0
    while at < len(sizes):
        if len(starts) == most:
            return None
        starts.append(at)
        at = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + capacity, "right"))
        if at == starts[-1]:
            return None
    return starts


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which contiguous runs of the sizes fit in so many shards, and where the runs start."""
    if not len(sizes):
        return 0, []
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(sizes, middle, shards) is not None else (middle + 1, high)
    return low, greedy(sizes, low, shards)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row of docs(doc_id, text).

    Size is the UTF-8 bytes of the text and 16; null text counts as empty and is in the group of empty texts. Repeated
    rows, null ids and ties get slots of their own (their order among themselves is free). A shard holds contiguous
    units; slots run from 0 without gaps. An empty table gives no rows, other columns are ignored.

    A unit with very many rows (copies of one text) is numbered in sub-units by a hash of doc_id, so no task holds it
    whole: there are at most 2**16 sub-units to a unit, and rows are counted before they are numbered."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", raw.alias("b")).select("doc_id", (F.length("b") + OVERHEAD).cast("long").alias("size"), F.crc32("b").alias("text_crc32"), F.xxhash64("b").alias("h"))
    rows = rows.withColumn("unit", F.shiftrightunsigned("h", 64 - BITS).cast("int"))
    units = rows.groupBy("unit").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).orderBy("unit").limit(1 << BITS).collect()
    sizes, counts = (np.array([u[c] for u in units], np.int64) for c in ("size", "rows"))
    _, starts = minimax_cuts(sizes, shards)
    of = np.searchsorted(starts, np.arange(len(units)), "right") - 1 if units else []
    before = np.cumsum(counts) - counts
    table = spark.createDataFrame(
        [(u.unit, int(k), int(before[i] - before[starts[k]]), int(min(SUBS, -(-u.rows // SUB_ROWS)))) for i, (u, k) in enumerate(zip(units, of))],
        T.StructType([T.StructField(n, t) for n, t in (("unit", T.IntegerType()), ("shard", T.IntegerType()), ("base", T.LongType()), ("subs", T.LongType()))]),
    )  # 2**16 rows at most
    rows = rows.join(F.broadcast(table), "unit").withColumn("sub", F.when(F.col("subs") == 1, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(F.lit(1), "doc_id"), "subs")))
    order = W.Window.partitionBy("unit").orderBy("sub")
    heads = rows.where("subs > 1").groupBy("unit", "sub").agg(F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(order) - F.col("n")).drop("n")
    place = F.row_number().over(W.Window.partitionBy("unit", "sub").orderBy("h", F.col("doc_id").asc_nulls_last())) - 1
    placed = rows.select("*", place.cast("long").alias("place"))
    few, many = placed.where("subs = 1").withColumn("ahead", F.lit(0).cast("long")), placed.where("subs > 1").join(heads, ["unit", "sub"])
    columns = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("ahead") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return few.select(*columns).unionAll(many.select(*columns))
