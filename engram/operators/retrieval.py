"""What a question finds in memory, as text for a prompt: facts, episodes with their facts, and both together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions.exprs import NEGATIONS
from engram.operators.tables import delete, insert_new, patch, predicate, topk, topk_per_key
from engram.operators.vector import knn
from engram.sources.store import settled

FURTHEST, FACTS_PER_EPISODE = 0.5, 5
NO_FACTS, NO_SESSIONS, NO_EPISODES = "No relevant long-term memories found.", "No relevant past sessions found.", "No matching episodes found."


def by_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the ids there are; the others are left out."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def by_metadata(table: DataFrame, where: dict, limit: int | None = None, key: str = "id") -> DataFrame:
    """Rows that meet a metadata filter; a limit takes the smallest keys, before any later sort."""
    found = table.where(predicate(where))
    return found if limit is None else topk(found, [F.col(key)], limit)


def fact_filter(min_importance: float | None = None, category: str | None = None) -> dict:
    parts = ([{"importance": {"$gte": min_importance}}] if min_importance is not None else []) + ([{"category": category}] if category is not None else [])
    return {"$and": parts} if len(parts) > 1 else parts[0] if parts else {}


def facts_near(facts: DataFrame, queries: DataFrame, k: int = 5, min_importance: float | None = None, category: str | None = None) -> DataFrame:
    """The k nearest facts that meet the filter, per query, with distance and rank from 1."""
    near = knn(facts, queries, k, where=predicate(fact_filter(min_importance, category)))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))


def _lines(rows: DataFrame, line: Column) -> DataFrame:
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def facts_text(near: DataFrame, furthest: float = FURTHEST) -> DataFrame:
    """(query_id, text) for a prompt: hits beyond the distance go after the k best are taken, the rest are numbered anew."""
    kept = near.where(F.col("distance") <= furthest).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    texts = _lines(kept, F.format_string("  %d. [%s] %s  (importance: %s)", "rank", "category", "text", F.col("importance").cast("string")))
    return texts.select("query_id", F.concat(F.lit("LONG-TERM MEMORY (semantic):\n"), "text").alias("text"))


def search_text(near: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, text) as an explicit search shows it: all k hits, or a fixed text without any."""
    texts = _lines(near, F.format_string("%d. [%s] %s (importance: %s)", "rank", "category", "text", F.col("importance").cast("string")))
    return queries.select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce("text", F.lit(NO_FACTS)).alias("text"))


def episodes_near(episodes: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    near = knn(episodes, queries, k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))


def with_facts(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """episodes(id, title, summary, start_time, related_semantic_memory_ids, ...) with a block of text: what it was, when,
    and the first linked facts there are."""
    links = episodes.select(F.col("id").alias("episode_id"), F.posexplode(F.slice("related_semantic_memory_ids", 1, FACTS_PER_EPISODE)).alias("pos", "id")).distinct()
    found = links.join(facts.select("id", F.col("text").alias("fact")), "id")
    lists = found.groupBy(F.col("episode_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact"))), lambda x: F.concat(F.lit("    - "), x["fact"])).alias("_facts"))
    head = F.array(F.concat(F.lit("Episode: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)"))), F.concat(F.lit("  When: "), F.date_format("start_time", "yyyy-MM-dd")), F.concat(F.lit("  Summary: "), F.coalesce("summary", F.lit(""))))
    lines = F.concat(F.array_compact(head), F.when(F.col("_facts").isNotNull(), F.concat(F.array(F.lit("  Related facts:")), F.col("_facts"))).otherwise(F.array().cast("array<string>")))
    return episodes.join(lists, "id", "left").withColumn("block", F.array_join(lines, "\n")).drop("_facts")


def episodes_text(hits: DataFrame, facts: DataFrame, queries: DataFrame, nothing: str = NO_SESSIONS) -> DataFrame:
    """(query_id, text): blocks of the hits(query_id, rank, id, ...) in order, a blank line apart, or a fixed text."""
    hits = settled(hits.select("query_id", "rank", "id", "title", "summary", "start_time", "related_semantic_memory_ids"), "hits")  # read twice, searched once
    blocks = with_facts(hits.drop("query_id", "rank").dropDuplicates(["id"]), facts).select("id", "block")
    rows = hits.select("query_id", "rank", "id").join(blocks, "id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("text"))
    return queries.select("query_id").join(rows, "query_id", "left").select("query_id", F.coalesce("text", F.lit(nothing)).alias("text"))


def browse(episodes: DataFrame, asked: DataFrame, as_of: Column, mode: str = "recent", limit: int = 5, within_days: int | None = None) -> DataFrame:
    """asked(query_id[, q][, session_id]) -> (query_id, rank, *episodes) by mode: semantic, by_session, oldest, else recent.

    A cut of days is made after the k hits of a semantic search, and before the limit in the other modes."""
    recent = F.lit(True) if not within_days or within_days < 0 else F.col("start_time") >= as_of - F.make_dt_interval(F.lit(within_days))
    if mode == "semantic":
        return episodes_near(episodes, asked, limit).where(recent)
    if mode == "by_session":
        rows, by = episodes.where(recent).join(F.broadcast(asked.select("query_id", "session_id")), "session_id"), [F.desc("start_time"), F.col("id")]
        rows = topk_per_key(rows, ["query_id"], by, limit)
    else:
        by = [F.col("start_time") if mode == "oldest" else F.desc("start_time"), F.col("id")]
        rows = topk(episodes.where(recent), by, limit).join(F.broadcast(asked.select("query_id")), F.lit(True))  # limit rows
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))


def context(queries: DataFrame, pads: DataFrame, facts_texts: DataFrame) -> DataFrame:
    """(query_id, text): the scratchpad of pads(query_id, text), then the facts found, a blank line apart."""
    j = queries.select("query_id").join(pads.select("query_id", F.nullif(F.trim("text"), F.lit("")).alias("_t"), F.col("text").alias("pad")), "query_id", "left").join(facts_texts.select("query_id", F.nullif("text", F.lit("")).alias("found")), "query_id", "left")
    return j.select("query_id", F.concat_ws("\n\n", F.when(F.col("_t").isNotNull(), F.col("pad")), "found").alias("text"))


def semantic_nodes(fact_hits: DataFrame, episode_hits: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, node_id, place): nodes linked to the facts found, then to the episodes found, each once where it is first."""
    hits = fact_hits.select("query_id", F.lit(0).alias("kind"), "rank", F.col("id").cast("string").alias("memory_id")).unionByName(episode_hits.select("query_id", F.lit(1).alias("kind"), "rank", F.col("id").cast("string").alias("memory_id")))
    hits = settled(hits, "hits")  # few rows: only their links are looked at
    own = links.select(F.col("memory_id").cast("string").alias("memory_id"), "node_id", "relevance").join(hits.select("memory_id"), "memory_id", "left_semi")
    linked = hits.join(own, "memory_id")
    first = linked.groupBy("query_id", "node_id").agg(F.min(F.struct("kind", "rank", (-F.col("relevance")).alias("r"))).alias("at"))
    return first.select("query_id", "node_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "node_id")).alias("place"))


def recalled(table: DataFrame, hits: DataFrame, at: Column) -> DataFrame:
    """Explicit searches are noted: hits(id) raise access_count and set last_accessed."""
    n = hits.groupBy("id").agg(F.count("*").alias("_n"))
    return table.join(n, "id", "left").withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.when(F.col("_n").isNotNull(), at).otherwise(F.col("last_accessed"))}).drop("_n")


FACTS = "owner long, id string, text string, embedding array<double>, importance double, category string, polarity string, access_count long, created boolean"


def store_in_order(store: DataFrame, new: DataFrame, near: float = 0.08, paraphrase: float = 0.35, cap: int = 500, target: int = 400, floor: float = 0.15) -> DataFrame:
    """The facts of each owner after new(owner, seq, id, text, embedding, importance, category, polarity) are stored one by
    one on store(owner, id, text, embedding, importance, category, polarity, access_count); created marks new ones.

    Each new fact sees what those before it left: within near of the closest it counts as a hit and importance is the larger; within
    paraphrase, with the same category and polarity and no negation on one side only, the more important wording stays and
    the other way it is a hit; else it is stored. An owner with more than cap facts is pruned to target first. The order matters,
    so an owner is one task; it holds cap facts at most and its own new ones, whatever the number of owners."""
    negated = lambda text: any(m in text.lower() for m in NEGATIONS)

    def run(key: tuple, old: pd.DataFrame, added: pd.DataFrame) -> pd.DataFrame:
        held = [{**r, "created": False} for r in old.sort_values("id").to_dict("records")]
        unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1.0)
        vectors = np.zeros((len(held) + 1, len(held[0]["embedding"]) if held else 0))
        for i, h in enumerate(held):
            vectors[i] = unit(h["embedding"])
        for r in added.rename(columns=lambda c: c.removeprefix("n_")).sort_values(["seq", "id"]).to_dict("records"):
            if not (r["text"] or "").strip():
                continue
            if len(held) > cap:
                alive = [i for i, h in enumerate(held) if h["importance"] >= floor]
                if len(alive) > cap:
                    best = sorted(alive, key=lambda i: (-round(0.7 * held[i]["importance"] + 0.03 * min(held[i]["access_count"], 10), 6), held[i]["id"]))
                    alive = sorted(best[:target])
                vectors[: len(alive)], held = vectors[alive], [held[i] for i in alive]
            v, h, distance = unit(r["embedding"]), None, np.inf
            if held:
                d = np.round(1 - vectors[: len(held)] @ v, 6)
                at = min(np.flatnonzero(d == d.min()), key=lambda i: held[i]["id"])
                h, distance = held[at], d[at]
            if distance <= near:
                h["access_count"], h["importance"] = h["access_count"] + 1, max(h["importance"], r["importance"])
            elif distance <= paraphrase and (h["category"], h["polarity"]) == (r["category"], r["polarity"]) and negated(h["text"]) == negated(r["text"]):
                if r["importance"] > h["importance"]:
                    h["text"], h["importance"], h["embedding"], vectors[at] = r["text"], r["importance"], r["embedding"], v
                else:
                    h["access_count"] += 1
            else:
                held.append({"owner": key[0], **{c: r[c] for c in ("id", "text", "embedding", "importance", "category", "polarity")}, "access_count": 0, "created": True})
                if len(held) > len(vectors) or not vectors.shape[1]:  # twice the room when it is full
                    vectors = np.concatenate([vectors.reshape(-1, len(v)), np.zeros((max(64, len(vectors)), len(v)))])
                vectors[len(held) - 1] = v
        return pd.DataFrame(held, columns=[x.split()[0] for x in FACTS.split(", ")])

    vector = F.col("embedding").cast("array<double>").alias("embedding")
    a = store.select("owner", F.col("id").cast("string").alias("id"), "text", vector, "importance", "category", "polarity", F.col("access_count").cast("long").alias("access_count"))
    # other names than the store's: both sides may come from one table
    b = new.select(F.col("owner").alias("n_owner"), F.col("seq").alias("n_seq"), F.col("id").cast("string").alias("n_id"), F.col("text").alias("n_text"), vector.alias("n_embedding"), *(F.col(c).alias(f"n_{c}") for c in ("importance", "category", "polarity")))
    return a.groupBy("owner").cogroup(b.groupBy("n_owner")).applyInPandas(run, FACTS)


def near_memories(store: DataFrame, asked: DataFrame, threshold: float = 0.08) -> DataFrame:
    """The nearest stored row of each of asked(query_id, q), if it is within the threshold."""
    return knn(store, asked, 1).where(F.col("distance") <= threshold)


class MemoryTable:
    """One interface for facts and episodes as tables: every change gives a new one."""

    def __init__(self, rows: DataFrame, key: str = "id"):
        self.rows, self.key = rows, key

    def add(self, new: DataFrame) -> MemoryTable:
        return MemoryTable(insert_new(self.rows, new.where(F.trim("text") != ""), [self.key]), self.key)

    def get(self, ids: DataFrame) -> DataFrame:
        return by_ids(self.rows, ids, self.key)

    def search(self, queries: DataFrame, k: int = 5, where: dict | None = None) -> DataFrame:
        return knn(self.rows, queries, k, where=predicate(where) if where else None, id_=self.key)

    def update(self, changes: DataFrame) -> MemoryTable:
        return MemoryTable(patch(self.rows, changes, self.key), self.key)

    def delete(self, ids: DataFrame) -> MemoryTable:
        return MemoryTable(delete(self.rows, ids, [self.key]), self.key)

    def count(self) -> int:
        return self.rows.count()

