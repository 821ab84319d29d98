"""Texts that a language model is given, put together from tables; one row, one prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASK = "Extract all entities and relationships present in this session. Use the CONVERSATION NARRATIVE as the primary signal. Semantic facts confirm and reinforce — do not treat them as the only source."


def _numbered(items: Column, form: str = "  %d. %s") -> Column:
    return F.transform(items, lambda x, i: F.format_string(form, i + 1, F.trim(x)))


def _filled(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def extraction(bundles: DataFrame) -> DataFrame:
    """bundles(session_id, conversation_text, episode_text, semantic_texts) -> (session_id, prompt)."""
    none = F.array().cast("array<string>")
    told = F.when(_filled("conversation_text"), F.array(F.lit("CONVERSATION NARRATIVE (chunk summaries — primary extraction signal):"), F.trim("conversation_text"))).otherwise(F.array(F.lit("CONVERSATION NARRATIVE: (not available for this session)")))
    episode = F.when(_filled("episode_text"), F.array(F.lit("EPISODE SUMMARY (title and overview):"), F.trim("episode_text"), F.lit(""))).otherwise(none)
    n = F.size("semantic_texts")
    facts = F.when(n > 0, F.concat(F.array(F.format_string("SEMANTIC FACTS FROM THIS SESSION (%d):", n)), _numbered(F.col("semantic_texts")), F.array(F.lit("")))).otherwise(none)
    lines = F.concat(F.array(F.concat(F.lit("SESSION: "), F.col("session_id").cast("string")), F.lit("")), told, F.array(F.lit("")), episode, facts, F.array(F.lit(TASK)))
    return bundles.select("session_id", F.array_join(lines, "\n").alias("prompt"))


def memories(texts: Column) -> Column:
    body = F.flatten(F.transform(texts, lambda x, i: F.array(F.format_string("[Memory %d]", i + 1), F.trim(x), F.lit(""))))
    return F.when(F.size(texts) > 0, F.array_join(F.concat(F.array(F.format_string("MEMORIES TO PROCESS (%d total):", F.size(texts)), F.lit("")), body), "\n")).otherwise(F.lit("No memories provided."))


def proposal(rows: DataFrame) -> DataFrame:
    """rows(session_id, entities array<struct<name, node_id, type, is_new>>, subgraph, memories array<struct<id, text>>, hints array<string>) -> (session_id, prompt)."""
    known = F.transform("entities", lambda e: F.format_string("  name=%s  node_id=%s  type=%s  (%s)", e["name"], e["node_id"], e["type"], F.when(e["is_new"], "NEW NODE").otherwise("existing node")))
    told = F.transform("memories", lambda m: F.format_string("  [%s]: %s", m["id"], F.trim(m["text"])))
    line = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    lines = F.concat(
        line("RESOLVED ENTITIES (matched to graph nodes):"), known, line("", "CURRENT SUBGRAPH (existing nodes and edges near resolved entities):"), F.array(F.when(_filled("subgraph"), F.col("subgraph")).otherwise("  (no existing connections)")),
        line("", F.format_string("MEMORIES (%d total):", F.size("memories"))), told,
        line("", "Propose the minimum graph operations that accurately reflect the relationships in these memories given the existing subgraph above.", "", "\n\nCANDIDATE RELATIONS (hints from initial extraction, verify against memories):\n"), F.coalesce("hints", F.array().cast("array<string>")),
    )
    return rows.select("session_id", F.array_join(lines, "\n").alias("prompt"))


def reflection(jobs: DataFrame) -> DataFrame:
    """jobs(session_id, turn_count, trigger, goal, chunk_summaries, last_error) -> (session_id, prompt)."""
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.concat(F.lit("Turn count: "), F.col("turn_count").cast("string")), F.concat(F.lit("Trigger: "), "trigger")), F.when(F.coalesce("goal", F.lit("")) != "", F.array(F.concat(F.lit("Goal: "), "goal"))).otherwise(none),
        F.when(F.size("chunk_summaries") > 0, F.concat(F.array(F.lit("Session narrative so far (in order):")), F.transform("chunk_summaries", lambda x, i: F.format_string("  %d. %s", i + 1, x)))).otherwise(none),
        F.when(F.coalesce("last_error", F.lit("")) != "", F.array(F.concat(F.lit("Last error: "), F.substring("last_error", 1, 300)))).otherwise(none),
    )
    return jobs.select("session_id", F.array_join(lines, "\n").alias("prompt"))


def consolidation(reflections: DataFrame) -> DataFrame:
    """reflections(session_id, seq, id, directive, scope, specificity, confidence, actionable, novel) -> (session_id, prompt)."""
    shown = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    body = F.concat_ws("\n", F.concat(F.lit("   directive:   "), shown("directive", "")), F.concat(F.lit("   scope:       "), shown("scope", "?")), F.concat(F.lit("   specificity: "), shown("specificity", "?")), F.concat(F.lit("   confidence:  "), shown("confidence", "?")), F.concat(F.lit("   actionable:  "), shown("actionable", "?")), F.concat(F.lit("   novel:       "), shown("novel", "?")))
    rows = reflections.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id", body.alias("body")))).alias("rows"))
    lines = F.transform("rows", lambda r, i: F.concat(F.format_string("%d. id=%s\n", i + 1, r["id"].cast("string")), r["body"]))
    return rows.select("session_id", F.concat(F.format_string("Total directives to review: %d\n\n", F.size("rows")), F.array_join(lines, "\n")).alias("prompt"))
