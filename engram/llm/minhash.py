"""Near-duplicates of documents by b-bit MinHash.

1. Each text gives the set of its word shingles (64-bit hashes), a digest of that set, full minima of K hash functions,
   hashes of bands of minima, and a packed signature of the low B bits of each minimum.
2. Equal sets collapse to one class with a number of its own; copies are not compared again.
3. Representatives that share a band hash are candidates. In each bucket every member is paired with the bucket's
   smallest member, so pairs grow with the rows and not with the square of a bucket.
4. Bit counts of the packed signatures estimate the similarity, corrected for chance agreement of low bits; pairs far
   below the threshold go. The rest are confirmed on the full sets.
5. Links give components. Buckets whose members are still in several components are compared across components, in
   blocks spread over tasks, by bit counts; texts that pass are confirmed on full sets within the blocks, and a forest of
   what is linked joins the links."""

from __future__ import annotations

from collections import OrderedDict
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import WordHashes, connected_components, cut, drop, forest, join_counted, shingles, words

K, BAND_ROWS, B = 96, 4, 4
BANDS = K // BAND_ROWS
#: Estimated similarity below which a candidate goes: five standard errors under 0.75 for K minima of B bits.
LEAST_ESTIMATE = 0.5
BLOCK = 256

_draw = np.random.default_rng(20240229)
MULTIPLIERS = _draw.integers(1, 2**63, K, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draw.integers(0, 2**63, K, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of each of the K functions over the set, 32 bits."""
    out = np.full(K, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(out, (hashes[i : i + 2048, None] * MULTIPLIERS + OFFSETS).min(axis=0), out)
    return (out >> np.uint64(32)).astype(np.uint32)


def packed(mins: np.ndarray) -> bytes:
    """The low 4 bits of each minimum, two to a byte."""
    low = (mins & np.uint32(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (last axis: bytes), corrected for agreement by chance."""
    x = a ^ b
    x = x | (x >> 2)
    x = (x | (x >> 1)) & 0x11  # a bit per unequal pair of 4-bit values
    agree = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int32) / K
    return (agree - 2.0**-B) / (1 - 2.0**-B)


PROFILE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def profile(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                s = shingles(words(text.as_py()), k, hashes)
                row = {"doc_id": doc_id.as_py(), "n_shingles": len(s)}
                if len(s):
                    m = minima(s)
                    row |= {"c1": _digest(s), "c2": _digest(s, 7), "sig": packed(m)}
                    row["bands"] = [xxhash.xxh64_intdigest(m[i : i + BAND_ROWS].tobytes(), i) - 2**63 for i in range(0, K, BAND_ROWS)]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    from pyspark.sql.pandas.types import to_arrow_schema

    ARROW = to_arrow_schema(PROFILE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PROFILE)


def _estimated(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, K // 2) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(estimates(sa, sb) >= LEAST_ESTIMATE))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _digest(hashes: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), seed) - 2**63


def _texts(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, c1, text): a text for each class; where rows share the class's doc_id, one of other texts too, told by c1."""
    return reps.select("id", "doc", "c1").join(docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), "doc").select("id", "c1", "text")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, str]:
    """The pairs(a, b) whose full sets are as similar as asked for, written, and their path.

    The first of a bucket may stand in very many pairs, so its text is sent once per BLOCK pairs."""
    degrees = pairs.groupBy("a").agg(F.count("*").alias("n"))
    degrees, path = cut(degrees, "degrees")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    split = join_counted(pairs, degrees, ["a"], pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    texts = _texts(reps, docs)
    of_a = degrees.join(texts.select(F.col("id").alias("a"), F.col("c1").alias("ca"), F.col("text").alias("ta")), "a").select("a", "ca", "ta", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    sides = split.join(texts.select(F.col("id").alias("b"), F.col("c1").alias("cb"), F.col("text").alias("tb")), "b").join(of_a, ["a", "part"])

    def run(batches):
        hashes, recent = WordHashes(), OrderedDict()

        def of(i, digest, text):
            if (i, len(text)) not in recent:
                s = shingles(words(text), k, hashes)
                recent[i, len(text)] = s if _digest(s) == digest else None
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[i, len(text)]

        for batch in batches:
            keep = []
            for a, b, ca, cb, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ca", "cb")), batch.column("ta"), batch.column("tb")):
                x, y = of(a, ca, ta.as_py() or ""), of(b, cb, tb.as_py() or "")
                far = x is None or y is None or 100 * min(len(x), len(y)) < percent * max(len(x), len(y))
                both = 0 if far else len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    done, done_path = cut(sides.select("a", "b", "ca", "cb", "ta", "tb").mapInArrow(run, "a long, b long"), "links")
    drop(docs.sparkSession, path)
    return done, done_path


def _groups(batches, columns: list[str]):
    """The rows of each (key, lo, hi), which come together, as tuples of the columns."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in columns)))
    return (list(g) for _, g in groupby(rows, key=lambda r: r[:3]))


def _candidates(group):
    """(row, rows it is a candidate with): other components, near by estimate, not tested with the bucket's first member.

    A pair of several common buckets is a candidate in the one of its first common band only."""
    ids, comps, right = (np.array([g[c] for g in group]) for c in (4, 5, 3))
    sigs = np.frombuffer(b"".join(g[8] for g in group), np.uint8).reshape(-1, K // 2)
    bands, band, first = np.array([g[9] for g in group], np.int64), group[0][6], group[0][7]
    same = group[0][1] == group[0][2]
    left = np.arange(len(ids)) if same else np.flatnonzero(~right)
    other = np.arange(len(ids)) if same else np.flatnonzero(right)
    other = other[ids[other] != first]
    for i in left[ids[left] != first]:
        near = other[(comps[other] != comps[i]) & (ids[other] > ids[i] if same else True)]
        near = near[estimates(sigs[near], sigs[i]) >= LEAST_ESTIMATE]
        near = near[(bands[near] == bands[i]).argmax(axis=1) == band]
        if len(near):
            yield i, near


def linked(sets: list[np.ndarray], candidates, percent: int):
    """The candidates (row, rows) whose sets, none of them empty, are as similar as asked for, as pairs of rows."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    for i, near in candidates:
        mine = np.zeros(len(known), np.int64)
        mine[place[starts[i] : starts[i] + sizes[i]]] = 1
        near = near[100 * np.minimum(sizes[near], sizes[i]) >= percent * np.maximum(sizes[near], sizes[i])]
        both = np.array([mine[place[starts[j] : starts[j] + sizes[j]]].sum() for j in near], np.int64)
        yield from ((i, j) for j in near[(both > 0) & (100 * both >= percent * (sizes[near] + sizes[i] - both))])


MEMBER = "key long, lo int, hi int, right boolean, id long, comp long, band int, first long, sig binary, bands array<long>"


def _across(rows: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between rows(key, n, top, n_top, band, first, id, comp, sig, bands) of one bucket but other components.

    Members of a bucket's largest component top are not compared with each other: they and the other members are cut into
    blocks of their own, and a task compares a block of others with a block of either, so a bucket that hangs together but
    for a few rows costs in proportion to its rows, and no task holds a large bucket. Only members with a candidate are sent
    on with their texts, a row each; pairs are made and confirmed on the full sets within a task, which gives a forest of
    links: fewer rows than members."""
    blocks = rows.withColumn("others", F.ceil((F.col("n") - F.col("n_top")) / BLOCK).cast("int")).withColumn("main", F.col("comp") == F.col("top"))
    blocks = blocks.withColumn("k", F.when(F.col("main"), F.col("others") + F.pmod(F.xxhash64("id"), F.ceil(F.col("n_top") / BLOCK)).cast("int")).otherwise(F.pmod(F.xxhash64("id"), "others").cast("int")))
    last = F.col("others") + F.when(F.col("main"), 0).otherwise(F.ceil(F.col("n_top") / BLOCK)).cast("int") - 1
    spread = blocks.select("*", F.explode(F.sequence(F.lit(0), last)).alias("j"))
    spread = spread.select("key", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi"), (F.col("k") > F.col("j")).alias("right"), "id", "comp", "band", "first", "sig", "bands")
    together = lambda df: df.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    from pyspark.sql.pandas.types import to_arrow_schema

    members = T.StructType.fromDDL(MEMBER)
    names, arrow = members.names, to_arrow_schema(members)

    def pick(batches):
        for group in _groups(batches, names):
            used = np.zeros(len(group), bool)
            for i, near in _candidates(group):
                used[i] = True
                used[near] = True
            if used.any():
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(group[x] for x in np.flatnonzero(used))), arrow)], schema=arrow)

    def confirm(batches):
        hashes = WordHashes()
        for group in _groups(batches, [*names, "text", "c1"]):
            sets = [shingles(words(g[10]), k, hashes) for g in group]
            sound = [len(s) > 0 and _digest(s) == g[11] for g, s in zip(group, sets)]
            group, sets = ([x for x, ok in zip(xs, sound) if ok] for xs in (group, sets))
            if len(group) > 1:
                links = forest((group[i][4], group[j][4]) for i, j in linked(sets, _candidates(group), percent))
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    picked = together(spread).mapInArrow(pick, MEMBER)
    return together(picked.join(_texts(reps, docs), "id").select(*names, "text", "c1")).mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """A row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts that are null, empty or without words have no shingles and are their own component. Rows with a null doc_id
    can't be linked: component_id is null and they are kept. Repeated rows share a component, and each is kept if its
    doc_id is the component's; rows of one doc_id with different texts are compared each. Texts of any length are read
    whole. Other columns are ignored, whatever their names; an empty table gives no rows."""
    spark = docs.sparkSession
    prof, prof_path = cut(profile(docs, k), "profile")
    linkable = prof.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps, reps_path = cut(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "reps")  # a class by its set, whatever the ids of its rows
    banded = reps.select("id", F.posexplode("bands").alias("band", "hash")).select("id", "band", F.xxhash64("band", "hash").alias("key"))
    buckets, buckets_path = cut(banded.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members, members_path = cut(join_counted(banded, buckets, ["key"], reps.count() * BANDS).select("id", "band", "key", "first", "n"), "members")
    sig = reps.select("id", "sig")
    stars, stars_path = cut(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    centres, centres_path = cut(stars.groupBy("a").agg(F.count("*").alias("n")).join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a"), "centres")
    signed = join_counted(stars, centres, ["a"], stars.count()).join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    near, near_path = cut(_estimated(signed), "near")
    links, links_path = _confirmed(near, reps, docs, k, percent)
    comps, comp_paths = connected_components(links)
    drop(spark, buckets_path, stars_path, centres_path, near_path)
    now = members.where("n > 2").drop("n").join(comps, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")
    parts = now.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.max("m").alias("n_top"), F.max_by("comp", F.struct("m", "comp")).alias("top"))
    mixed, mixed_path = cut(parts.where("n > n_top"), "mixed")
    rows = join_counted(now, mixed, ["key"], members.count()).join(reps.select("id", "sig", "bands"), "id")
    more, more_path = cut(_across(rows, reps, docs, k, percent), "links")
    paths = [links_path, more_path, members_path, mixed_path]
    if not more.isEmpty():
        joined = more.join(comps.select(F.col("id").alias("a"), F.col("component_id").alias("ca")), "a", "left").join(comps.select(F.col("id").alias("b"), F.col("component_id").alias("cb")), "b", "left")
        merged, merged_paths = connected_components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).unionAll(comps.select(F.col("id").alias("a"), F.col("component_id").alias("b"))))
        comps, paths, comp_paths = merged, paths + comp_paths, merged_paths
    linked = reps.select("id", "doc").join(comps, "id")
    least, least_path = cut(linked.groupBy("component_id").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "least")
    named = join_counted(linked, least, ["component_id"], linked.count()).select("id", "least")
    known, known_path = cut(reps.select("id", "c1", "c2", "doc", "n").join(named, "id", "left").select("c1", "c2", "n", F.coalesce("least", "doc").alias("component_id")), "known")
    total = prof.count()
    found, _ = cut(
        join_counted(linkable.select("doc_id", "n_shingles", "c1", "c2"), known, ["c1", "c2"], total).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
        .unionAll(prof.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", "doc_id", F.lit(True))),
        "components",
    )
    drop(spark, *paths, *comp_paths, prof_path, reps_path, least_path, known_path)
    return found
