"""Stored rows and what language models return, as typed columns: malformed JSON gives an empty value, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions.exprs import C, clamp, col, strip_fences

NO_STRINGS = "array<string>"


def json_list(c: C) -> Column:
    return F.coalesce(F.from_json(col(c), NO_STRINGS), F.array().cast(NO_STRINGS))


def json_map(c: C) -> Column:
    return F.coalesce(F.from_json(col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def score(c: Column, default: float = 0.5) -> Column:
    """A number of 0..1 from text; what is no number gives the default."""
    return clamp(F.coalesce(c.try_cast("double"), F.lit(default)))


def nodes(raw: DataFrame) -> DataFrame:
    return raw.withColumn("attributes", json_map("attributes"))


def edges(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"evidence_memory_ids": json_list("evidence_memory_ids"), "active": col("active") != 0})


def log_entries(raw: DataFrame) -> DataFrame:
    return raw.withColumn("details", json_map("details"))


def queue_entries(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"semantic_memory_ids": json_list("semantic_memory_ids"), "conversation_text": F.coalesce("conversation_text", F.lit(""))})


def iso_epoch(text: C, now: Column) -> Column:
    """Seconds since 1970 of an ISO time; what is no time counts as now."""
    return F.unix_timestamp(F.coalesce(F.try_to_timestamp(col(text)), now))


def episode_metadata(fields: DataFrame, now: Column) -> DataFrame:
    """The stored form of episodes: defaults for what is missing, lists as JSON, times also in seconds."""
    text = lambda c: F.coalesce(c, F.lit(""))
    listed = lambda c: F.to_json(F.coalesce(c, F.array().cast(NO_STRINGS)))
    return fields.select(
        "id", text("session_id").alias("session_id"), text("title").alias("title"), listed("key_topics").alias("key_topics"), "start_time_iso", "end_time_iso",
        iso_epoch("start_time_iso", now).alias("start_time_epoch"), iso_epoch("end_time_iso", now).alias("end_time_epoch"), F.coalesce("turn_count", F.lit(0)).alias("turn_count"),
        text("outcome").alias("outcome"), listed("related_semantic_memory_ids").alias("related_semantic_memory_ids"), F.coalesce("importance", F.lit(0.5)).alias("importance"),
        F.coalesce("decay_count", F.lit(0)).alias("decay_count"), F.when(F.size("merged_from") > 0, F.to_json("merged_from")).otherwise(F.lit("")).alias("merged_from"),
        F.concat_ws("\n", text("title"), text("summary")).alias("document"),
    )


def episodes(stored: DataFrame) -> DataFrame:
    """Episodes from their stored form: the summary is what follows the first line of the document, or all of a single line."""
    lines = F.split("document", "\n", 2)
    return stored.withColumns({
        "summary": F.coalesce(F.get(lines, F.lit(1)), F.col("document")), "key_topics": json_list("key_topics"), "related_semantic_memory_ids": json_list("related_semantic_memory_ids"),
        "outcome": F.nullif("outcome", F.lit("")), "merged_from": F.when(F.col("merged_from") != "", json_list("merged_from")),
    })


def sanitised(df: DataFrame) -> DataFrame:
    """Flat metadata: numbers and flags stay, null text is empty, anything nested is text."""
    def flat(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            return c
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*(flat(f) for f in df.schema.fields))


FACT = "array<struct<memory:string,importance:string,category:string,polarity:string>>"


def facts(raw: DataFrame) -> DataFrame:
    """raw(session_id, json) -> (session_id, pos, text, importance, category, polarity) of the JSON array's objects; blank facts are dropped."""
    rows = raw.select("session_id", F.posexplode(F.from_json(strip_fences("json"), FACT)).alias("pos", "f"))
    text = F.trim(F.coalesce("f.memory", F.lit("")))
    return rows.where(text != "").select("session_id", "pos", text.alias("text"), F.coalesce(F.col("f.importance").try_cast("double"), F.lit(0.5)).alias("importance"), F.coalesce("f.category", F.lit("other")).alias("category"), F.coalesce("f.polarity", F.lit("neutral")).alias("polarity"))


def summaries(raw: DataFrame) -> DataFrame:
    """raw(session_id, json, title, summary, key_topics) -> the JSON object's title (120 characters at most), summary and six
    topics at most; the given values stand in for what is missing or blank."""
    o = F.from_json(strip_fences("json"), "title string, summary string, key_topics array<string>")
    parsed = raw.withColumn("o", o)
    said = lambda c: F.nullif(F.trim(F.col(f"o.{c}")), F.lit(""))
    topics = F.slice(F.filter(F.transform("o.key_topics", lambda t: F.trim(t)), lambda t: t != ""), 1, 6)
    return parsed.select("session_id", F.substring(F.coalesce(said("title"), "title"), 1, 120).alias("title"), F.coalesce(said("summary"), "summary").alias("summary"), F.coalesce(topics, "key_topics").alias("key_topics"))


OPERATION = "type:string,source_id:string,target_id:string,relation:string,confidence:string,evidence_memory_ids:array<string>,edge_id:string,reasoning:string,node_id:string,alias:string"
# The fields that an operation of each type must have.
REQUIRED = {"insert_edge": ["source_id", "target_id", "relation", "confidence"], "update_edge_confidence": ["edge_id", "confidence"], "deactivate_edge": ["edge_id"], "add_alias": ["node_id", "alias"]}


def proposals(raw: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw(session_id, json) -> operations that are whole, and (session_id, status): retry if no object with a list
    operations, else done. The ends of an inserted edge must be among resolved(session_id, node_id)."""
    parsed = raw.select("session_id", F.from_json(strip_fences("json"), f"operations array<struct<{OPERATION}>>").alias("p"))
    status = parsed.select("session_id", F.when(F.col("p.operations").isNull(), "retry").otherwise("done").alias("status"))
    ops = parsed.select("session_id", F.posexplode("p.operations").alias("pos", "o")).select("session_id", "pos", "o.*")
    full = F.lit(False)
    for kind, names in REQUIRED.items():
        has = F.lit(True)
        for n in names:
            has = has & (F.coalesce(n, F.lit("")) != "")
        full = full | ((F.col("type") == kind) & has)
    ends = resolved.select("session_id", "node_id").distinct()
    ops = ops.where(full).withColumns({c: F.trim(c) for c in ("source_id", "target_id", "relation", "edge_id", "node_id")})
    known = lambda c: ends.select("session_id", F.col("node_id").alias(c), F.lit(True).alias(f"{c}_known"))
    ops = ops.join(known("source_id"), ["session_id", "source_id"], "left").join(known("target_id"), ["session_id", "target_id"], "left")
    ops = ops.where((F.col("type") != "insert_edge") | (F.col("source_id_known") & F.col("target_id_known")))
    evidence = F.filter(F.coalesce("evidence_memory_ids", F.array().cast(NO_STRINGS)), lambda m: F.coalesce(m, F.lit("")) != "")
    return ops.select(
        F.concat_ws("-", "session_id", F.format_string("%06d", "pos")).alias("op_id"), "session_id", F.col("type").alias("op_type"), "source_id", "target_id", "relation",
        F.when(F.col("type").isin("insert_edge", "update_edge_confidence"), score(F.col("confidence"))).alias("confidence"), evidence.alias("evidence_memory_ids"), "edge_id", "node_id", F.lower(F.trim("alias")).alias("alias"), "reasoning",
    ), status


def native_calls(calls: DataFrame) -> DataFrame:
    """calls(id, finish_reason, tool_calls): a list that was cut off by length is dropped whole."""
    return calls.withColumn("tool_calls", F.when(F.coalesce("finish_reason", F.lit("")) != "length", F.col("tool_calls")))


