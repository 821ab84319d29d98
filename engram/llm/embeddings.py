"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to unit length, so a cosine of at least c is a distance of at most eps = sqrt(2 - 2c). Leading
principal directions are fitted on a bounded sample; projecting on them never lengthens a distance. Cells of width eps on
those directions order the vectors (per label), the order is cut into blocks and runs of blocks, each with the box of its
projections. The join recurses from runs to blocks: intervals are paired if their first cells are at most one apart and
their boxes at most eps; blocks of paired runs if their boxes are; only then are vectors compared, a block against a
block, in double precision. Equal vectors of a label are one class with a count, so a frequent vector is compared once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import connected_components, cut, drop

DIRECTIONS, SAMPLE, BLOCK, RUN = 6, 4096, 256, 16


def principal(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """Leading principal directions of unit vectors, per length of vector."""
    out = {}
    for n in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == n], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[n] = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:DIRECTIONS].T
    return out


def compare(ids_a, n_a, a, ids_b, n_b, b, least: float, same: bool):
    """Links between two blocks of unit vectors: (id, number of linked vectors), and edges that connect what is linked."""
    near = a @ b.T >= least
    if same:
        np.fill_diagonal(near, False)
    counts = list(zip(ids_a, (near @ n_b).tolist())) + ([] if same else list(zip(ids_b, (near.T @ n_a).tolist())))
    big = np.iinfo(np.int64).max
    la, lb = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    start = la.copy(), lb.copy()
    while True:
        na = np.minimum(la, np.where(near, lb, big).min(axis=1, initial=big))
        nb = na if same else np.minimum(lb, np.where(near.T, na, big).min(axis=1, initial=big))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    edges = {(int(x), int(r)) for ids, ls in zip(start, (la, lb)) for x, r in zip(ids, ls) if x != r}
    return [c for c in counts if c[1]], edges


def linked_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """A row per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows with a null id or label, or a vector that is null, empty, zero or has null or non-finite components, link with
    nothing and are kept; so do vectors of different lengths. Repeated rows are vectors of their own with the same id.
    Other columns are ignored; an empty table gives no rows."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * least)) + 1e-9
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False)))
    good = rows.where("ok").withColumn("h", F.xxhash64("v"))
    classes, classes_path = cut(good.groupBy("label", "h", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    axes = principal([r.v for r in classes.orderBy("h", "label").limit(SAMPLE).select("v").collect()])
    schema = "label long, dim int, cells array<int>, at array<double>, id long, n long, unit binary"

    def place(batches):
        for b in batches:
            out = []
            for label, v, i, n in zip(*(b.column(c).to_pylist() for c in ("label", "v", "id", "n"))):
                x = np.array(v)
                x = x / np.abs(x).max()
                x /= np.linalg.norm(x)
                at = x @ axes[len(x)] if len(x) in axes else np.zeros(0)
                at = np.pad(at, (0, DIRECTIONS - len(at)))
                out.append((label, len(x), np.floor(at / eps).astype(int).tolist(), at.tolist(), i, n, x.tobytes()))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["label", "dim", "cells", "at", "id", "n", "unit"])

    order = ["label", "dim", "cells", "id"]
    ordered = classes.select("label", "v", "id", "n").mapInArrow(place, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    block_schema = "block long, run long, label long, dim int, lo array<double>, hi array<double>, c_lo int, c_hi int, ids array<long>, ns array<long>, units binary"

    def block_up(batches):
        from pyspark import TaskContext

        part, no, held = TaskContext.get().partitionId() << 32, 0, []

        def done():
            at = np.array([h[3] for h in held])
            lo, hi = at.min(axis=0), at.max(axis=0)
            row = {"block": part + no, "run": part + no // RUN, "label": held[0][0], "dim": held[0][1], "lo": lo.tolist(), "hi": hi.tolist()}
            row |= {"c_lo": int(np.floor(lo[0] / eps)), "c_hi": int(np.floor(hi[0] / eps)), "ids": [h[4] for h in held], "ns": [h[5] for h in held], "units": b"".join(h[6] for h in held)}
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("label", "dim", "cells", "at", "id", "n", "unit"))):
                if held and (len(held) == BLOCK or held[0][:2] != r[:2]):
                    yield done()
                    no = no + 1 if held[0][:2] == r[:2] else (no // RUN + 1) * RUN  # a run has one label
                    held = []
                held.append(r)
        if held:
            yield done()

    blocks, blocks_path = cut(ordered.mapInArrow(block_up, block_schema), "blocks")
    boxes = blocks.select("block", "run", "label", "dim", "lo", "hi", "c_lo", "c_hi")
    corner = lambda c, f: F.array(*(f(F.get(c, i)) for i in range(DIRECTIONS)))
    runs = boxes.groupBy("run", "label", "dim").agg(corner("lo", F.min).alias("lo"), corner("hi", F.max).alias("hi"), F.min("c_lo").alias("c_lo"), F.max("c_hi").alias("c_hi"))

    def close(x: str, y: str):
        gaps = (F.greatest(F.lit(0.0), F.get(f"{x}.lo", i) - F.get(f"{y}.hi", i), F.get(f"{y}.lo", i) - F.get(f"{x}.hi", i)) for i in range(DIRECTIONS))
        return sum((g * g for g in gaps), F.lit(0.0)) <= eps * eps

    left = runs.select("*", F.explode(F.sequence("c_lo", "c_hi")).alias("cell")).alias("a")
    right = runs.select("*", F.explode(F.sequence(F.col("c_lo") - 1, F.col("c_hi") + 1)).alias("cell")).alias("b")
    run_pairs = left.join(right, ["label", "dim", "cell"]).where(F.col("a.run") <= F.col("b.run")).where(close("a", "b")).select(F.col("a.run").alias("ra"), F.col("b.run").alias("rb")).distinct()
    pairs = run_pairs.join(boxes.alias("a"), F.col("a.run") == F.col("ra")).join(boxes.alias("b"), F.col("b.run") == F.col("rb"))
    pairs = pairs.where(F.col("a.block") <= F.col("b.block")).where(close("a", "b")).select(F.col("a.block").alias("ba"), F.col("b.block").alias("bb")).distinct()
    side = lambda s: blocks.select(F.col("block").alias(f"b{s}"), F.col("ids").alias(f"ids_{s}"), F.col("ns").alias(f"ns_{s}"), F.col("units").alias(f"units_{s}"))
    work = pairs.join(side("a"), "ba").join(side("b"), "bb")

    def join_blocks(batches):
        for b in batches:
            out = []
            for x, y, ids_a, ns_a, ua, ids_b, ns_b, ub in zip(*(b.column(c).to_pylist() for c in ("ba", "bb", "ids_a", "ns_a", "units_a", "ids_b", "ns_b", "units_b"))):
                va, vb = (np.frombuffer(u, np.float64).reshape(len(i), -1) for u, i in ((ua, ids_a), (ub, ids_b)))
                counts, edges = compare(ids_a, np.array(ns_a), va, ids_b, np.array(ns_b), vb, least, x == y)
                out += [(i, None, c) for i, c in counts] + [(i, r, None) for i, r in edges]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], names=["a", "b", "links"])

    found, found_path = cut(work.mapInArrow(join_blocks, "a long, b long, links long"), "found")
    comps, paths = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("links is not null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    known, known_path = cut(
        classes.join(links, "id", "left").join(comps, "id", "left").select("label", "h", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "known"
    )
    drop(spark, classes_path, blocks_path, found_path, *paths)
    linked = good.join(known, ["label", "h", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
