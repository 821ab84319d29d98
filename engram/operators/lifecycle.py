"""Ageing of facts, episodes, working memory and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions.exprs import age_days, decayed, reflection_days, retention
from engram.operators.tables import tumbling
from engram.sources.store import settled

EPISODE_DAYS = {0: 180, 1: 365, 2: 730}


def decay(facts: DataFrame, as_of: Column) -> DataFrame:
    """Importance after whole 30-day periods since creation, from the importance as stored; rows without a date stay."""
    return facts.withColumn("importance", F.when(F.col("created_at").isNull(), F.col("importance")).otherwise(decayed("importance", age_days("created_at", as_of))))


def prune(facts: DataFrame, owner: list[str], floor: float = 0.15, cap: int = 500, target: int = 400) -> DataFrame:
    """Facts at or above the floor; of an owner with more than cap, the target best by retention."""
    w = Window.partitionBy(*owner)
    kept = facts.where(F.col("importance") >= floor).withColumn("_n", F.count("*").over(w))
    ranked = kept.withColumn("_rn", F.row_number().over(w.orderBy(F.desc(F.round(retention(), 6)), F.col("id"))))
    return ranked.where((F.col("_n") <= cap) | (F.col("_rn") <= target)).drop("_n", "_rn")


def refresh_expiry(rows: DataFrame, touches: DataFrame, days: int = 60) -> DataFrame:
    """A touch moves expiry to its time plus so many days."""
    last = touches.groupBy("id").agg(F.max("at").alias("_at"))
    return rows.join(last, "id", "left").withColumn("expires_at", F.coalesce(F.col("_at") + F.make_dt_interval(F.lit(days)), "expires_at")).drop("_at")


def merge_episodes(episodes: DataFrame, as_of: Column, level: int, batch: int = 20, by: str = "id") -> DataFrame:
    """One row per full batch of the oldest aged episodes of a level: times, turns, importance, the first one's session, topics
    (six at most) and linked facts if there are such columns, and the sources in order."""
    aged = episodes.where((F.col("decay_count") == level) & (F.col("start_time") < as_of - F.make_dt_interval(F.lit(EPISODE_DAYS.get(level, 730)))))
    groups = tumbling(aged, ["owner"], [F.col("start_time"), F.col(by)], batch)
    more = []
    if "key_topics" in episodes.columns:
        more.append(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("key_topics")))), 1, 6).alias("key_topics"))
    if "related_semantic_memory_ids" in episodes.columns:
        linked = F.transform(F.array_sort(F.collect_list(F.struct("start_time", by, "related_semantic_memory_ids"))), lambda x: x["related_semantic_memory_ids"])
        more.append(F.array_distinct(F.flatten(linked)).alias("related_semantic_memory_ids"))
    return groups.groupBy("owner", "batch").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("turn_count").alias("turn_count"), F.max("importance").alias("importance"), F.min_by("session_id", F.struct("start_time", by)).alias("session_id"),
        F.transform(F.array_sort(F.collect_list(F.struct("start_time", by, F.col("id").alias("source")))), lambda x: x["source"]).alias("merged_from"), F.lit(level + 1).alias("decay_count"), *more,
    )


def decay_pass(episodes: DataFrame, as_of: Column, levels: int = 6, by: str = "id") -> DataFrame:
    """All levels in turn; what a level makes is seen by the next. Ids are text."""
    for level in range(levels):
        merged = merge_episodes(episodes, as_of, level, by=by)
        gone = merged.select(F.explode("merged_from").alias("id"))
        new = merged.drop("merged_from").withColumn("id", F.concat_ws("-", F.lit("m"), F.col("owner").cast("string"), F.lit(level).cast("string"), F.col("batch").cast("string"))).drop("batch")
        episodes = settled(episodes.join(gone, "id", "left_anti").unionByName(new, allowMissingColumns=True), "episodes")
    return episodes


def reflection_expiry(reflections: DataFrame) -> DataFrame:
    days = reflection_days("scope", "specificity", "confidence", "actionable", "novel")
    return reflections.where(F.trim("directive") != "").withColumn("days", days).withColumn("priority", F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("confidence"))))


def stale_sessions(turns: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Sessions whose last turn is older than the gap."""
    last = turns.groupBy("session_id").agg(F.max("ts").alias("last_turn_at"), F.count("*").alias("turn_count"))
    return last.where(F.col("last_turn_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))


def promotions(pads: DataFrame) -> DataFrame:
    """Facts from scratchpads(session_id, goal, subtasks, updates, error): a goal of over ten characters .75, the first three
    done subtasks of over five .6, updates (what follows the first colon) .65, an error .5."""
    fact = lambda text, kind, importance, category: [text.alias("text"), F.lit(kind).alias("kind"), F.lit(importance).alias("importance"), F.lit(category).alias("category")]
    goal = pads.where(F.length("goal") > 10).select("session_id", *fact(F.concat(F.lit("User was working on: "), "goal"), "goal", 0.75, "goals"))
    tasks = pads.select("session_id", F.explode(F.slice("subtasks", 1, 3)).alias("t")).where(F.length("t") > 5).select("session_id", *fact(F.concat(F.lit("User completed task: "), "t"), "subtask", 0.6, "experience"))
    notes = pads.select("session_id", F.explode("updates").alias("u")).where(F.col("u").contains(":")).select("session_id", F.trim(F.regexp_replace("u", "(?s)^[^:]*:", "")).alias("t"))
    error = pads.where(F.coalesce("error", F.lit("")) != "").select("session_id", *fact(F.concat(F.lit("User encountered an issue last session: "), F.substring("error", 1, 200)), "error", 0.5, "experience"))
    return goal.unionByName(tasks).unionByName(notes.where("t <> ''").select("session_id", *fact(F.col("t"), "update", 0.65, "other"))).unionByName(error)
