"""Line dedup over the suffix array of line-ID sequences, in DataFrame functions only.

Lines get order-preserving ids. Ranks of runs come from distributed prefix doubling: the pair of ranks of a run's halves is
sorted over the cluster, and its place in that order is the rank of the longer run. The spans grow 1, 2, 3, then by two;
a span that is not double the last is ranked by its first and last halves, which overlap. Runs that occur once leave after
each round, since nothing longer that starts there can repeat, and rounds end when no rank repeats: the suffix array is
then complete as far as it has ties.

Places of equal rank are an interval of the suffix array with a common prefix of the span at least. In each interval
the first place by (doc_id, line) is kept and the places behind it are later copies, unless they overlap it: a run is
never a copy of itself, so "a a a a" has one later copy of "a a" and the first copy stays whole. The longest span in
which a place is a later copy, and those of the places next to it, overlap to a maximal repeated run; adjoining runs that
no repeat bridges stay two. The lines of the later runs are deleted. What a first copy may lose are lines that are copies
of a still earlier run, so each distinct line, and each run that nothing earlier shares lines with, stays whole once.

From one line on, a run of blank lines only is no copy before it has MIN_LINES of them: they are layout, and part of a
longer run when that repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import BIG_ID, cut, drop, join_counted

MIN_LINES = 3
KEY = ["d", "th"]


def _interval_ranks(rows: DataFrame, halves: list[str], total: int, what: str) -> tuple[DataFrame, str]:
    """rows(d, th, i, blank, *halves) of runs that occur again, with their rank and first place in place of halves."""
    groups = rows.groupBy(*halves).agg(F.count("*").alias("n"), F.min(F.struct("d", "th", "i")).alias("first")).where("n > 1")
    names, path = cut(groups.orderBy(*halves).select(*halves, "n", "first", F.monotonically_increasing_id().alias("no")), "ranks")
    out, out_path = cut(join_counted(rows, names, halves, total).select(*KEY, "i", "blank", F.col("no").alias("rank"), "first"), what)
    drop(rows.sparkSession, path)
    return out, out_path


def _later(level: DataFrame, span: int) -> DataFrame:
    """(d, th, i, until): the runs of the level that are later copies of their interval's first, without overlap."""
    runs = level if span >= MIN_LINES else level.where("not blank")
    other = (F.col("first.d") != F.col("d")) | (F.col("first.th") != F.col("th"))
    return runs.where(other | (F.col("i") - F.col("first.i") >= span)).select(*KEY, "i", (F.col("i") + span).alias("until"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> tuple[DataFrame, list[str]]:
    """(d, th, runs): the maximal later runs [lo, hi) of each text that has some; d is doc_id with null as the largest, th
    the text's hash. And the paths to drop after use."""
    spark = docs.sparkSession
    lines = docs.select(F.coalesce("doc_id", F.lit(BIG_ID)).alias("d"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hashed = lines.select("d", "th", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), (~F.col("line").rlike(r"\S")).alias("blank")).distinct()
    base, base_path = cut(hashed, "lines")
    level, path = _interval_ranks(base, ["h1", "h2"], base.count(), "level")
    drop(spark, base_path)
    span, later, paths = 1, [], [path]
    while total := level.count():
        if span >= min_lines:
            later.append(_later(level, span))
        step = min(span, MIN_LINES - span) if span < MIN_LINES else min(span, min_lines - span) if span < min_lines else span
        ahead = Window.partitionBy(*KEY).orderBy("i").rangeBetween(step, step)  # a text's own lines only, as many as its row holds
        pairs = level.select(*KEY, "i", "rank", F.first("rank").over(ahead).alias("next"), (F.col("blank") & F.first("blank").over(ahead)).alias("blank"))
        pairs, pairs_path = cut(pairs.where("next is not null"), "pairs")
        level, path = _interval_ranks(pairs, ["rank", "next"], total, "level")
        drop(spark, pairs_path)
        paths.append(path)
        span += step
    if not later:
        return docs.select(F.lit(BIG_ID).alias("d"), F.xxhash64("text").alias("th"), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))).alias("runs")).limit(0), paths
    found = later[0]
    for x in later[1:]:
        found = found.unionAll(x)
    along = Window.partitionBy(*KEY).orderBy("i", "until")
    starts = F.col("i") >= F.coalesce(F.max("until").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = found.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(along))
    islands = islands.groupBy(*KEY, "run").agg(F.min("i").alias("lo"), F.max("until").alias("hi"))
    return islands.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs")), paths


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs and text (what is left) of every row of docs(doc_id, text).

    n_runs counts maximal later runs. A null text has no lines and stays null; an empty one has one empty line. Rows with
    the same id and text are one text and get the same result; equal texts with other ids are copies of the smallest id,
    null ids last. A text may have as many lines as fit in a row. Other columns are ignored, whatever their names; an empty
    table gives no rows."""
    gone, paths = repeated_runs(docs, min_lines)
    gone, gone_path = cut(gone, "gone")
    drop(docs.sparkSession, *paths)
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(BIG_ID)).alias("d"), F.xxhash64("text").alias("th"))
    # gone has a row for each text that shares a line with another, so it grows like the texts: sorted, not broadcast
    rows = rows.join(gone.hint("merge"), KEY, "left")
    parts = F.split("text", "\n")
    lines = F.flatten(F.transform("runs", lambda r: F.sequence(r["lo"], r["hi"] - 1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lines), lambda i: F.get(parts, i))
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r["hi"] - r["lo"]), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long").alias("n_runs"),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
