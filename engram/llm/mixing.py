"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by a seeded hash into blocks. A source is taken in passes: blocks are drawn in a
permuted order until the pass's share of the target is met; the one block in which the target falls is filled document
by document, first fit, and counts as a block of the quota. The quotas (blocks to take per source) are split down a
binary tree over the output shards: at each node the left half's vector is a multivariate hypergeometric draw, seeded
by the node, so every shard gets its exact number of blocks and a random, unbiased share of each source. A shard takes
disjoint runs of each source's permuted blocks, and its documents are shuffled locally: their order in it is that of a
seeded hash of the copy, which write_mix and shuffled sort by within a task of each shard.

Words are counted once, into a table of sizes and hashes; texts are not moved before the last step. Everything follows
from seeds and hashes of the rows, so reruns agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from engram.llm.common import WORD, cut, drop

BLOCK_ROWS, BLOCKS = 256, 1 << 16
#: Words of an output shard, if the number of shards isn't given; there are LEAST_SHARDS at least.
SHARD_WORDS, LEAST_SHARDS = 1 << 24, 16
#: Rows of the plan (a block of a source each) up to which it is broadcast; beyond, rows are joined with it by shuffle.
BROADCAST_BLOCKS = 1 << 20


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source: sources by code point, null last, weigh in turn; what is above most times a
    source's words is shared again by weight until none is above."""
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    weight = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[x] for x in open_)
        full = [x for x in names if x in open_ and share * weight[x] >= most * sizes[x]]
        if not full:
            out |= {x: share * weight[x] for x in open_}
            break
        for x in full:
            out[x] = most * sizes[x]
            left -= out[x]
            open_.discard(x)
    return out


def split_quotas(quotas: list[int], shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs [start, end) of each source's permuted blocks that a shard takes: the tree's path from root to leaf.

    A node over shards [lo, hi) owns a run of every source; its left half takes the front of each run. A quota is BLOCKS
    at most, and sources fit on the driver, so totals stay below the 10**9 that an exact draw takes; more is an error."""
    start, quota, lo, hi = np.zeros(len(quotas), np.int64), np.array(quotas, np.int64), 0, shards
    while hi - lo > 1:
        mid, total = (lo + hi) // 2, int(quota.sum())
        want = total * (mid - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi])
        left, rest, still = np.zeros_like(quota), total, want
        for i, q in enumerate(quota):  # a chain of hypergeometric draws is the multivariate one
            rest -= int(q)
            left[i] = draw.hypergeometric(int(q), rest, still) if still else 0
            still -= int(left[i])
        if shard < mid:
            quota, hi = left, mid
        else:
            start, quota, lo = start + left, quota - left, mid
    return start, start + quota


def first_fit(sizes: np.ndarray, room: int, again: bool) -> np.ndarray:
    """Which of a block's rows, in their order, fill the room: those that fit, and one more that overshoots by less than
    what is missing. Empty rows are taken in the first pass only."""
    took = np.zeros(len(sizes), bool)
    for i, n in enumerate(sizes):
        if n <= room and (n or not again):
            took[i] = True
            room -= int(n)
    best = np.where(~took & (sizes < 2 * room))[0]
    if room and len(best):
        took[best[np.argmin(sizes[best])]] = True
    return took


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2, shards: int | None = None, seed: int = 17, keep: bool = False) -> DataFrame:
    """Every row of docs(doc_id, text, source): doc_id, source, size (words), source_size, target (its source's), copies,
    taken (words) and spots, for each copy its output shard and its place in the shuffled order; with keep also row, a
    struct of all columns of docs.

    Null text has size 0; a null source is a source of its own. Repeated rows and null ids are rows like others, and their
    order among themselves is free. Documents are taken whole, so a source's words are off its target by less than its
    smallest document that was left out of the last block. Rows of size 0 are taken once. Texts of any length are counted
    whole; other columns keep out of the way, whatever their names; an empty table gives no rows. The driver holds one number
    per source, as the weights are given per source."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep else []
    base = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), F.monotonically_increasing_id().alias("no"), *kept)
    base, base_path = cut(base, "sizes")
    totals = {r.source: (r.words, r.n) for r in base.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()}
    goal = targets({k: v[0] for k, v in totals.items()}, weights, budget, most)
    shards = shards or max(LEAST_SHARDS, -(-int(sum(goal.values())) // SHARD_WORDS))
    table = spark.createDataFrame(
        [(k, int(w), float(goal[k]), int(min(BLOCKS, -(-n // BLOCK_ROWS)))) for k, (w, n) in totals.items()],
        T.StructType([T.StructField(n, t) for n, t in (("s", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("blocks", T.LongType()))]),
    )
    rows = base.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod("h", "blocks"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))).drop("s", "blocks")  # never null
    words = rows.groupBy("key", "source_size", "target", "block").agg(F.sum("size").alias("words"))
    plans = []
    for p in range(most):
        turn = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1 + p), "block"), "block")  # a source's blocks, BLOCKS at most
        share = F.least(F.greatest(F.floor("target") - p * F.col("source_size"), F.lit(0)), F.col("source_size"))
        plan = words.withColumn("after", F.sum("words").over(turn)).withColumn("place", F.row_number().over(turn) - 1).withColumn("share", share)
        room = F.col("share") - F.col("after") + F.col("words")
        plans.append(plan.select("key", "block", "place", F.lit(p).alias("pass"), F.when(F.col("after") <= F.col("share"), F.lit(-1)).when(room > 0, room).alias("room")).where("room is not null"))
    plan = plans[0]
    for x in plans[1:]:
        plan = plan.unionAll(x)
    plan, plan_path = cut(plan, "plan")
    shard_of = _shard_of(spark, plan, shards, seed)
    plan = plan.join(shard_of, ["key", "pass", "place"], "left") if shard_of is not None else plan.withColumn("shard", F.lit(0))
    # a row per block with what each pass takes of it; -1 is all, else so many words
    by_block = plan.groupBy("key", "block").agg(
        *(F.max(F.when(F.col("pass") == p, F.col("room"))).alias(f"room{p}") for p in range(most)), *(F.max(F.when(F.col("pass") == p, F.col("shard"))).alias(f"shard{p}") for p in range(most))
    )
    by_block, block_path = cut(by_block, "blocks")
    small = F.broadcast if by_block.count() <= BROADCAST_BLOCKS else (lambda df: df)
    joined = rows.join(small(by_block), ["key", "block"], "left")
    partial = " or ".join(f"coalesce(room{p}, -1) > 0" for p in range(most))
    takes = [f"take{p}" for p in range(most)]
    whole = joined.where(f"not ({partial})").select("*", *((F.coalesce(F.col(f"room{p}") == -1, F.lit(False)) & ((F.col("size") > 0) | F.lit(p == 0))).alias(takes[p]) for p in range(most)))
    filled_schema = T.StructType([T.StructField("no", T.LongType()), *(T.StructField(t, T.BooleanType()) for t in takes)])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "size", "no"], kind="stable").reset_index(drop=True)
        for p in range(most):
            room, size = pdf[f"room{p}"].iloc[0], pdf["size"].to_numpy()
            if pd.isna(room) or room == -1:
                pdf[takes[p]] = (not pd.isna(room)) & ((size > 0) | (p == 0))
            else:
                pdf[takes[p]] = first_fit(size, int(room), p > 0)
        return pdf[filled_schema.names]

    # sizes and hashes of a few blocks of each source go to tasks, texts don't
    filled = joined.where(partial).select("key", "block", "no", "h", "size", *(f"room{p}" for p in range(most))).groupBy("key", "block").applyInPandas(fill, filled_schema)
    filled, filled_path = cut(filled, "filled")
    taken = whole.unionByName(joined.where(partial).join(filled, "no"))
    copies = sum((F.col(t).cast("int") for t in takes[1:]), F.col(takes[0]).cast("int"))
    spot = lambda p: F.struct(F.coalesce(F.col(f"shard{p}"), F.lit(0)).cast("int").alias("shard"), F.xxhash64(F.lit(seed + 99 + p), "h").alias("place"))
    spots = F.array_compact(F.array(*(F.when(F.col(takes[p]), spot(p)) for p in range(most))))
    drop(spark, plan_path)
    return taken.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), spots.alias("spots"), *(["row"] if keep else []))


def _shard_of(spark, plan: DataFrame, shards: int, seed: int) -> DataFrame | None:
    """The shard of each taken block: (key, pass, place) -> shard. Quotas are a number per source and pass."""
    quotas = sorted((r.key, r["pass"], r.n) for r in plan.groupBy("key", "pass").agg(F.count("*").alias("n")).collect())
    if not quotas:
        return None
    counts = [q[2] for q in quotas]

    def runs(batches):
        for pdf in batches:
            for shard in pdf["id"]:
                lo, hi = split_quotas(counts, shards, int(shard), seed)
                out = [(quotas[i][0], quotas[i][1], int(a), int(b), int(shard)) for i, (a, b) in enumerate(zip(lo, hi)) if b > a]
                yield pd.DataFrame(out, columns=["key", "pass", "lo", "hi", "shard"])

    pieces = spark.range(shards).mapInPandas(runs, "key string, pass int, lo long, hi long, shard int")
    return pieces.select("key", "pass", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("place"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """A row per copy of mix(keep=True): shard and row; a task has whole shards, each in its shuffled order."""
    copies = mixed.select("row", F.explode("spots").alias("spot")).select("spot.shard", "spot.place", "row")
    return copies.repartition("shard").sortWithinPartitions("shard", "place").select("shard", "row")


def write_mix(mixed: DataFrame, path: str) -> None:
    """The mix as files, one folder per shard (mix_shard=n): the rows of its copies, in the shuffled order."""
    shuffled(mixed).select(F.col("shard").alias("mix_shard"), "row.*").write.partitionBy("mix_shard").parquet(path)
