"""Table changes as pure functions of the old table and a table of changes, and row selection by key.

Nothing here updates in place: each function returns the new table, to be published as a new version
(engram.sources.store). Keys are unique after every insert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order(*columns: Column | str) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def topk_per_key(df: DataFrame, keys: list[str], by: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_rn") <= k).drop("_rn")


def latest_per_key(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    return topk_per_key(df, keys, by, 1)


keep_first = latest_per_key


def topk(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Optional conjuncts: those that are None are left out."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def predicate(spec: dict) -> Column:
    """A metadata filter: equality, $eq, $gte, $lt and $and."""
    parts = []
    for name, want in spec.items():
        if name == "$and":
            parts += [predicate(x) for x in want]
        elif isinstance(want, dict):
            parts += [{"$eq": F.col(name) == v, "$gte": F.col(name) >= v, "$lt": F.col(name) < v}[op] for op, v in want.items()]
        else:
            parts.append(F.col(name) == want)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str], by: list[Column] | None = None) -> DataFrame:
    """Rows whose key is new; the first of equal keys wins."""
    first = keep_first(rows, keys, by) if by else rows.dropDuplicates(keys)
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """Rows replace those with their key; of several, the first by order."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(latest_per_key(rows, keys, by), allowMissingColumns=True)


def patch(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of changes replace those of the table where they aren't null. Of several changes of a key the greatest value
    of each column counts, so a row never becomes two."""
    fields = [c for c in changes.columns if c != key and c in table.columns]
    renamed = changes.groupBy(key).agg(*(F.max(c).alias(f"_new_{c}") for c in fields))
    out = table.join(renamed, key, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns))


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on), on, "left_anti")


def delete_cascade(nodes: DataFrame, ids: DataFrame, edges: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """Nodes without the ids(id), edges without those that touch them, and child tables (node_id) without theirs."""
    cut_edges = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return [nodes.join(ids.select("id"), "id", "left_anti"), cut_edges, *(c.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti") for c in children)]


def add_hits(table: DataFrame, hits: DataFrame, key: str, counter: str) -> DataFrame:
    """A counter raised by the rows of a hit log; reads log hits and never write."""
    n = hits.groupBy(key).agg(F.count("*").alias("_n"))
    return table.join(n, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_n", F.lit(0))).drop("_n")


def append_distinct(current: Column, new: Column) -> Column:
    return F.array_union(F.coalesce(current, F.array().cast("array<string>")), new)


def tumbling(df: DataFrame, keys: list[str], by: list[Column], n: int) -> DataFrame:
    """Full groups of n rows per key in order, numbered from 0; a remainder is left out."""
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("_rn", F.row_number().over(w.orderBy(*by))).withColumn("_n", F.count("*").over(w))
    return numbered.where(F.col("_rn") <= F.col("_n") - F.col("_n") % n).withColumn("batch", F.floor((F.col("_rn") - 1) / n)).drop("_rn", "_n")


def merge_decisions(ids: DataFrame, decisions: DataFrame) -> DataFrame:
    """One bucket per id of ids(session_id, id): an id in one bucket stays there, else 'keep'; unknown ids go."""
    one = decisions.groupBy("session_id", "id").agg(F.collect_set("bucket").alias("b")).where(F.size("b") == 1).select("session_id", "id", F.get("b", F.lit(0)).alias("bucket"))
    return ids.join(one, ["session_id", "id"], "left").select("session_id", "id", F.coalesce("bucket", F.lit("keep")).alias("bucket"))
