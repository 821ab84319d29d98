"""Edits of the graph's tables, checked as they are made: what is invalid is left out, keys stay unique, ends exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.exprs import NODE_TYPES, RELATIONS, STOPWORDS, clamp, keywords
from engram.operators.tables import append_distinct, delete, insert_new

LOG = ["operation", "entity_type", "entity_id", "details", "source"]


def insert_nodes(nodes: DataFrame, rows: DataFrame, by: list[Column]) -> DataFrame:
    """rows(id, name, ...) with a name that is not blank and not there yet; of equal names the first. Counters start at 0."""
    named = rows.withColumn("name", F.trim("name")).where(F.col("name") != "").withColumns({"access_count": F.lit(0), "traversal_count": F.lit(0)})
    return insert_new(nodes, named, ["name"], by)


def update_nodes(nodes: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """changes(id, name, type, heading, importance, confidence), a row a node: what is not null replaces, scores are
    clamped; a change to a blank name or unknown type is refused whole. updated_at is set."""
    sound = changes.where(F.col("name").isNull() | (F.trim("name") != "")).where(F.col("type").isNull() | F.col("type").isin(NODE_TYPES))
    new = {"name": F.trim("name"), "type": F.col("type"), "heading": F.col("heading"), "importance": F.when(F.col("importance").isNotNull(), clamp("importance")), "confidence": F.when(F.col("confidence").isNotNull(), clamp("confidence"))}
    renamed = sound.select("id", F.lit(True).alias("_hit"), *(c.alias(f"_{n}") for n, c in new.items()))
    j = nodes.join(renamed, "id", "left").withColumns({n: F.coalesce(f"_{n}", n) for n in new if n in nodes.columns})
    return j.withColumn("updated_at", F.when(F.col("_hit"), at).otherwise(F.col("updated_at") if "updated_at" in nodes.columns else F.lit(None))).drop("_hit", *(f"_{n}" for n in new))


def keyword_rows(nodes: DataFrame) -> DataFrame:
    """The keywords of nodes as they are: the table follows from names and headings and is made anew after changes."""
    return nodes.select(F.col("id").alias("node_id"), F.explode(keywords("name", "heading")).alias("keyword"))


def add_keywords(table: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(node_id, keyword) in lower case; single letters and stop words are refused."""
    clean = rows.select("node_id", F.lower(F.trim("keyword")).alias("keyword")).where((F.length("keyword") > 1) & ~F.col("keyword").isin(STOPWORDS))
    return insert_new(table, clean, ["node_id", "keyword"])


def add_aliases(table: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(node_id, alias), trimmed and in lower case, each once for a node; blank ones are refused."""
    clean = rows.select("node_id", F.lower(F.trim("alias")).alias("alias")).where(F.col("alias") != "")
    return insert_new(table, clean, ["node_id", "alias"])


def delete_aliases(table: DataFrame, rows: DataFrame) -> DataFrame:
    return delete(table, rows.select("node_id", F.lower(F.trim("alias")).alias("alias")), ["node_id", "alias"])


def insert_edges(edges: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows(id, source_id, target_id, relation, confidence, weight) with known, different ends and a known relation; scores
    are clamped. Two edges of one pair and relation may stand side by side."""
    ids = nodes.select("id").distinct()
    sound = rows.where(F.col("relation").isin(*RELATIONS) & (F.col("source_id") != F.col("target_id")))
    for end in ("source_id", "target_id"):
        sound = sound.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    made = sound.withColumns({"confidence": clamp("confidence"), "weight": clamp("weight"), "active": F.lit(True)})
    return edges.unionByName(made, allowMissingColumns=True)


def edge_between(edges: DataFrame, pairs: DataFrame, relation: str | None = None, active_only: bool = True) -> DataFrame:
    """The strongest edge of each of pairs(source_id, target_id), in this direction only."""
    rows = edges.where("active") if active_only else edges
    rows = rows if relation is None else rows.where(F.col("relation") == relation)
    near = rows.join(pairs.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_semi")
    best = near.groupBy("source_id", "target_id").agg(F.min_by(F.struct("*"), F.struct((-F.col("weight")).alias("w"), (-F.col("confidence")).alias("c"), "id")).alias("best"))
    return best.select("best.*")


def set_active(edges: DataFrame, ids: DataFrame, active: bool) -> DataFrame:
    """The edges of ids(id) switched; changed says which were not in that state already."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    j = edges.join(hit, "id", "left").withColumn("changed", F.coalesce(F.col("_hit") & (F.col("active") != active), F.lit(False)))
    return j.withColumn("active", F.when(F.col("changed"), F.lit(active)).otherwise(F.col("active"))).drop("_hit")


def add_evidence(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(id, seq, memory_id): memories behind an edge, each once, in the order they came."""
    new = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "memory_id"))), lambda x: x["memory_id"]).alias("_new"))
    return edges.join(new, "id", "left").withColumn("evidence_memory_ids", append_distinct(F.col("evidence_memory_ids"), F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")


def link_memories(links: DataFrame, rows: DataFrame, by: list[Column]) -> DataFrame:
    """rows(node_id, memory_id, memory_type, relevance): unknown types are refused, relevance is clamped, and a node has one
    link to a memory, the first."""
    sound = rows.where(F.col("memory_type").isin("episodic", "semantic")).withColumn("relevance", clamp("relevance"))
    return insert_new(links, sound, ["node_id", "memory_id"], by)


def append_log(log: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """rows(operation, entity_type, entity_id, details, source) behind the log; nothing there is ever changed."""
    return log.unionByName(rows.select(*LOG).withColumn("created_at", at), allowMissingColumns=True)


def insert_working_memory(table: DataFrame, rows: DataFrame, days: int = 60) -> DataFrame:
    """rows without an expiry live so many days from created_at; tags that are a list in one text become a list."""
    tags = F.filter(F.transform(F.split("tags", ","), lambda t: F.trim(t)), lambda t: t != "")
    made = rows.withColumns({"expires_at": F.coalesce("expires_at", F.col("created_at") + F.make_dt_interval(F.lit(days))), "tags": tags})
    return table.unionByName(made, allowMissingColumns=True)


def update_working_memory(table: DataFrame, changes: DataFrame, at: Column, days: int = 60) -> DataFrame:
    """changes(id, value, priority, relevance, expires_at), a row each: what is not null replaces. Any change refreshes the
    expiry, unless it names one; a row without a field changes nothing."""
    fields = [c for c in ("value", "priority", "relevance") if c in table.columns and c in changes.columns]
    given = F.coalesce(*(F.col(c).cast("string") for c in [*fields, "expires_at"])).isNotNull()
    new = changes.where(given).select("id", F.lit(True).alias("_hit"), F.col("expires_at").alias("_expires"), *(F.col(c).alias(f"_{c}") for c in fields))
    j = table.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    fresh = F.when(F.col("_hit"), F.coalesce("_expires", at + F.make_dt_interval(F.lit(days)))).otherwise(F.col("expires_at"))
    return j.withColumn("expires_at", fresh).drop("_hit", "_expires", *(f"_{c}" for c in fields))
