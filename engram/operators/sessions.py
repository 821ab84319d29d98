"""Sessions from start to end: live state, clean ends, crashes, and what each leaves for later.

Tables: sessions(session_id, started_at, last_turn_at, turn_count, status, chunk_summaries, full_conversation,
related_semantic_memory_ids). Everything is for all sessions of a table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.lifecycle import promotions
from engram.operators.tables import append_distinct, delete, insert_new, upsert

MESSAGE = "array<struct<role:string,content:string>>"
SNIPPET_CHARS, CRASH_CHARS, CRASH_CHUNK_CHARS = 8000, 4000, 2000


def _blank(ids: DataFrame, at: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    return ids.select(
        "session_id", at.alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("last_turn_at"), F.lit(0).cast("long").alias("turn_count"), F.lit("in_progress").alias("status"),
        none.alias("chunk_summaries"), F.array().cast(MESSAGE).alias("full_conversation"), none.alias("related_semantic_memory_ids"),
    )


def start(sessions: DataFrame, starts: DataFrame) -> DataFrame:
    """starts(session_id, at): rows for sessions that have none; the others stay as they are."""
    first = starts.groupBy("session_id").agg(F.min("at").alias("at"))
    return insert_new(sessions, _blank(first, F.col("at")), ["session_id"], [F.col("started_at")])


def heartbeat(sessions: DataFrame, beats: DataFrame) -> DataFrame:
    """beats(session_id, at), one per turn: turns are counted, the latest is kept, and a session without a row gets one."""
    n = beats.groupBy("session_id").agg(F.count("*").alias("_n"), F.min("at").alias("_first"), F.max("at").alias("_last"))
    whole = start(sessions, n.select("session_id", F.col("_first").alias("at")))
    seen = F.col("_n").isNotNull()
    return whole.join(n, "session_id", "left").withColumns({"turn_count": F.when(seen, F.col("turn_count") + F.col("_n")).otherwise(F.col("turn_count")), "last_turn_at": F.when(seen, F.greatest("last_turn_at", "_last")).otherwise(F.col("last_turn_at"))}).drop("_n", "_first", "_last")


def _gathered(rows: DataFrame, order: str, value: Column) -> DataFrame:
    return rows.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]).alias("_new"))


def append_summaries(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks(session_id, seq, text) behind those a session has, in order; blank ones are left out."""
    new = _gathered(chunks.where(F.trim("text") != ""), "seq", F.col("text"))
    return sessions.join(new, "session_id", "left").withColumn("chunk_summaries", F.concat("chunk_summaries", F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")


def save_conversations(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """The snapshot of turns(session_id, turn, role, text) replaces the one a session has."""
    new = _gathered(turns, "turn", F.struct("role", F.col("text").alias("content")))
    return sessions.join(new, "session_id", "left").withColumn("full_conversation", F.coalesce("_new", "full_conversation")).drop("_new")


def append_memory_ids(sessions: DataFrame, made: DataFrame) -> DataFrame:
    """made(session_id, seq, memory_id): new facts of a session, each once, in the order they came."""
    new = _gathered(made, "seq", F.col("memory_id"))
    return sessions.join(new, "session_id", "left").withColumn("related_semantic_memory_ids", append_distinct(F.col("related_semantic_memory_ids"), F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")


def close(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return delete(sessions, ids, ["session_id"])


def state_of(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """asked(session_id) with turn_count (0 without a row), started_at, active, and the lists (empty without a row)."""
    j = asked.join(sessions, "session_id", "left")
    return j.select(
        "session_id", F.coalesce("turn_count", F.lit(0)).alias("turn_count"), "started_at", F.coalesce(F.col("status") == "in_progress", F.lit(False)).alias("active"),
        *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("chunk_summaries", "array<string>"), ("full_conversation", MESSAGE), ("related_semantic_memory_ids", "array<string>"))),
    )


def snippet_of(messages: Column, chars: int = SNIPPET_CHARS) -> Column:
    said = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    return F.substring(F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"), -chars, chars)


def worth_keeping(turn_count: Column, goal: Column, completed: Column) -> Column:
    """The gate of a clean end: two turns, a goal or a completed subtask."""
    return ~((turn_count < 2) & (F.coalesce(goal, F.lit("")) == "") & (F.size(completed) == 0))


def fallback_summary(goal: Column, completed: Column, updates: Column, error: Column, turn_count: Column, chunks: Column) -> tuple[Column, Column]:
    """Title and summary of a session from its own state, when no model's is at hand."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    listed = F.transform(chunks, lambda x, i: F.format_string("  %d. %s", i + 1, x))
    none = F.array().cast("array<string>")
    parts = [
        F.when(F.size(chunks) > 0, F.concat(F.array(F.lit("Session narrative (in order):")), listed)).otherwise(none), F.when(has(goal), F.array(F.concat(F.lit("Goal: "), goal))).otherwise(none),
        F.when(F.size(completed) > 0, F.array(F.concat(F.lit("Completed: "), F.array_join(F.slice(completed, 1, 5), "; ")))).otherwise(none),
        F.when(F.size(updates) > 0, F.array(F.concat(F.lit("Notable updates: "), F.array_join(F.slice(updates, 1, 5), "; ")))).otherwise(none),
        F.when(has(error), F.array(F.concat(F.lit("Last error: "), F.substring(error, 1, 200)))).otherwise(none), F.array(F.concat(F.lit("Turn count: "), turn_count.cast("string"))),
    ]
    return F.when(has(goal), F.substring(goal, 1, 60)).otherwise(F.lit("Session summary")), F.array_join(F.concat(*parts), " | ")


EPISODE = ["id", "session_id", "title", "summary", "start_time", "end_time", "turn_count", "outcome", "related_semantic_memory_ids", "importance"]


def _queue(episodes: DataFrame, text: Column, at: Column) -> DataFrame:
    return episodes.select("session_id", F.col("id").alias("episodic_memory_id"), F.col("related_semantic_memory_ids").alias("semantic_memory_ids"), text.alias("conversation_text"), at.alias("queued_at"), F.lit(None).cast("timestamp_ntz").alias("processed_at"))


def end(sessions: DataFrame, pads: DataFrame, at: Column) -> dict[str, DataFrame]:
    """What the clean end of the sessions in pads(session_id, goal, subtasks (completed), updates, error) makes: facts to
    store, a working-memory summary, an episode and a queue entry for sessions worth keeping, and the sessions left.

    A session that has no live row was ended before, and gives nothing."""
    live = pads.join(sessions.where("status = 'in_progress'"), "session_id")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    said = F.filter(
        F.array(
            F.when(has("goal"), F.concat(F.lit("Goal: "), "goal")), F.when(F.size("subtasks") > 0, F.concat(F.lit("Completed: "), F.array_join(F.slice("subtasks", 1, 5), "; "))),
            F.when(has("error"), F.concat(F.lit("Last error: "), F.substring("error", 1, 200))),
        ), lambda x: x.isNotNull(),
    )
    notes = live.where(F.size(said) > 0).select("session_id", F.lit("session_summary").alias("memory_type"), F.array_join(said, " | ").alias("value"), F.lit(0.6).alias("priority"), F.lit(0.6).alias("relevance"))
    title, summary = fallback_summary(F.col("goal"), F.col("subtasks"), F.col("updates"), F.col("error"), F.col("turn_count"), F.col("chunk_summaries"))
    kept = live.where(worth_keeping(F.col("turn_count"), F.col("goal"), F.col("subtasks")))
    made = kept.select("*", F.concat(F.lit("ep_"), F.col("session_id").cast("string")).alias("id"), title.alias("title"), summary.alias("summary"), F.coalesce("started_at", at).alias("start_time"), at.alias("end_time"), F.lit(None).cast("string").alias("outcome"), F.lit(0.5).alias("importance"))
    text = F.when(F.size("chunk_summaries") > 0, F.array_join("chunk_summaries", "\n\n")).otherwise(snippet_of(F.col("full_conversation")))
    return {"facts": promotions(live), "working_memory": notes, "episodes": made.select(*EPISODE), "queue": _queue(made, text, at), "sessions": close(sessions, live)}


def recover(sessions: DataFrame, current: Column, at: Column) -> dict[str, DataFrame]:
    """Sessions that were never ended, but for the current one: an interrupted episode and a queue entry for each with a
    turn, a chunk summary or a conversation; all leave the table."""
    stale = sessions.where((F.col("status") == "in_progress") & (F.col("session_id") != current))
    chunks, raw = F.size("chunk_summaries") > 0, snippet_of(F.col("full_conversation"))
    stale = stale.withColumn("snippet", F.when(chunks, F.lit("")).otherwise(raw))
    known = stale.where((F.col("turn_count") >= 1) | chunks | (F.col("snippet") != ""))
    state = F.when(chunks, F.concat(F.lit("Recovered narrative: "), F.substring(F.array_join("chunk_summaries", " "), 1, CRASH_CHUNK_CHARS))).when(F.col("snippet") != "", F.concat(F.lit("Last known state: "), F.substring("snippet", 1, CRASH_CHARS))).otherwise(F.lit("No recoverable state."))
    summary = F.concat(F.lit("Session "), F.col("session_id").cast("string"), F.lit(" ended without a clean shutdown after "), F.col("turn_count").cast("string"), F.lit(" turn(s). "), state)
    made = known.select(
        "*", F.concat(F.lit("ep_"), F.col("session_id").cast("string")).alias("id"), F.lit("Interrupted session").alias("title"), summary.alias("summary"), F.coalesce("started_at", at).alias("start_time"),
        F.coalesce("last_turn_at", "started_at", at).alias("end_time"), F.lit("interrupted").alias("outcome"), F.lit(0.4).alias("importance"),
    )
    text = F.when(chunks, F.array_join("chunk_summaries", "\n\n")).otherwise(F.col("snippet"))
    return {"episodes": made.select(*EPISODE), "queue": _queue(made, text, at), "sessions": close(sessions, stale)}


def digest(episodes: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """(keys, text): the n latest episodes as the lines that a new session starts with."""
    latest = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("start_time", "id", F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"))))), 1, n)
    lines = F.transform("rows", lambda e: F.concat(F.lit("  - "), e["title"], F.lit(": "), e["summary"]))
    return episodes.groupBy(*keys).agg(latest.alias("rows")).select(*keys, F.concat(F.lit("RECENT SESSIONS:\n"), F.array_join(lines, "\n")).alias("text"))


def start_context(starts: DataFrame, goals: DataFrame, experience: DataFrame, recent: DataFrame, keys: list[str]) -> DataFrame:
    """starts(keys) with context: the texts there are of goals, experience and recent sessions, a line apart."""
    j = starts
    for name, t in (("_goals", goals), ("_experience", experience), ("_recent", recent)):
        j = j.join(t.select(*keys, F.nullif("text", F.lit("")).alias(name)), keys, "left")
    return j.select(*starts.columns, F.concat_ws("\n", "_goals", "_experience", "_recent").alias("context"))


def enqueue(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """Sessions queued anew take the place of their old entry and are pending again."""
    return upsert(queue, rows.withColumn("processed_at", F.lit(None).cast("timestamp_ntz")), ["session_id"], [F.desc("queued_at")])


def drop_processed(queue: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Entries processed longer ago than so many days go; pending ones never do."""
    return queue.where(F.col("processed_at").isNull() | (F.col("processed_at") >= as_of - F.make_dt_interval(F.lit(days))))
