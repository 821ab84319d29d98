"""Conversation text and the JSON that language models return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions.exprs import RELATIONS, clamp, entity_name, first_sentence, repaired_json, strip_fences, strip_tool_calls


def ordered_text(turns: DataFrame, line, sep: str = "\n") -> DataFrame:
    """turns(session_id, turn, role, text) joined in order, a session per row."""
    rows = turns.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("rows"))
    return rows.select("session_id", F.array_join(F.transform("rows", lambda r: r["line"]), sep).alias("text"))


def snippet(turns: DataFrame, chars: int = 8000) -> DataFrame:
    said = turns.where(F.col("role").isin("user", "assistant"))
    return ordered_text(said, F.concat("role", F.lit(": "), "text")).select("session_id", F.expr(f"right(text, {chars})").alias("text"))


def extractive_fallback(turns: DataFrame, chars: int = 1500) -> DataFrame:
    """The first sentences (200 characters at most) of what users and assistants said, with the speaker."""
    said = turns.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return ordered_text(said, F.concat(F.initcap("role"), F.lit(": "), first_sentence("text")), " ").select("session_id", F.substring("text", 1, chars).alias("text"))


def trimmed_history(turns: DataFrame, pairs: int = 4) -> DataFrame:
    """System turns and the last pairs of others."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("role")))
    rest = turns.where("role <> 'system'").withColumn("_rn", back).where(F.col("_rn") <= 2 * pairs).drop("_rn")
    return turns.where("role = 'system'").unionByName(rest)


def narrative_chunks(chunks: DataFrame, budget: int = 12000) -> DataFrame:
    """The latest chunks(session_id, idx, text) within a budget of characters, one at least; omitted counts those left out."""
    back = Window.partitionBy("session_id").orderBy(F.desc("idx"))
    used = chunks.withColumn("used", F.sum(F.length("text")).over(back)).withColumn("rn", F.row_number().over(back)).withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    kept = used.where((F.col("used") <= budget) | (F.col("rn") == 1))
    return kept.withColumn("omitted", F.col("n") - F.max("rn").over(Window.partitionBy("session_id"))).select("session_id", "idx", "text", "omitted")


def narrative_text(chunks: DataFrame, budget: int = 12000) -> DataFrame:
    """(session_id, text) of chunks(session_id, idx, text) within the budget, with their own numbers from 1, and a line on those left out."""
    kept = narrative_chunks(chunks, budget)
    rows = kept.groupBy("session_id", "omitted").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("rows"))
    head = F.when(F.col("omitted") > 0, F.format_string("  (earliest %d chunk note(s) omitted — over length budget)\n", "omitted")).otherwise(F.lit(""))
    return rows.select("session_id", F.concat(head, F.array_join(F.transform("rows", lambda r, i: F.format_string("  %d. %s", i + F.col("omitted") + 1, r["text"])), "\n")).alias("text"))


def extraction_snippet(turns: DataFrame, chars: int = 6000) -> DataFrame:
    """(session_id, text): pairs(session_id, pos, user, assistant) one after the other without tool calls, the last characters."""
    said = turns.where((F.coalesce("user", F.lit("")) != "") | (F.coalesce("assistant", F.lit("")) != ""))
    line = F.concat(F.lit("User: "), F.coalesce("user", F.lit("")), F.lit("\nAssistant: "), strip_tool_calls(F.coalesce("assistant", F.lit(""))))
    rows = said.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    return rows.select("session_id", F.expr(f"right(array_join(transform(rows, r -> r.line), '\n'), {chars})").alias("text"))


def parse_tool_calls(texts: DataFrame) -> DataFrame:
    """texts(id, text) -> (id, pos, tool, arguments); malformed calls are dropped, arguments default to {}."""
    found = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<\s*tool[_-]?call\s*>(.*?)<\s*/\s*tool[_-]?call\s*>"), F.lit(1))).alias("pos", "raw"))
    tool = F.get_json_object("raw", "$.tool")
    return found.where(tool.isNotNull()).select("id", "pos", tool.alias("tool"), F.coalesce(F.get_json_object("raw", "$.arguments"), F.lit("{}")).alias("arguments"))


EXTRACTION = "entities array<struct<name:string,type:string,heading:string,aliases:array<string>,confidence:string>>, candidate_relations array<struct<source:string,target:string,relation:string,confidence:string,reasoning:string>>"


def parse_extractions(raw: DataFrame) -> DataFrame:
    """raw(session_id, json) -> session_id, parsed, status: ok, repaired or retry."""
    plain, fixed = F.from_json(strip_fences("json"), EXTRACTION, {"mode": "PERMISSIVE"}), F.from_json(repaired_json("json"), EXTRACTION, {"mode": "PERMISSIVE"})
    good = lambda c: F.coalesce(c["entities"].isNotNull() | c["candidate_relations"].isNotNull(), F.lit(False))
    both = raw.select("session_id", plain.alias("p"), fixed.alias("f"))
    return both.select("session_id", F.when(good(F.col("p")), F.col("p")).when(good(F.col("f")), F.col("f")).alias("parsed"), F.when(good(F.col("p")), "ok").when(good(F.col("f")), "repaired").otherwise("retry").alias("status"))


def _score(c):
    return clamp(F.coalesce(c.try_cast("double"), F.lit(0.5)))


def parsed_entities(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("session_id", F.posexplode("parsed.entities").alias("pos", "e"))
    named = rows.withColumn("name", entity_name("e.name")).where(F.coalesce(F.length("name"), F.lit(0)) > 0)
    first = F.row_number().over(Window.partitionBy("session_id", F.lower("name")).orderBy("pos"))
    aliases = F.array_distinct(F.filter(F.transform(F.coalesce("e.aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a))), lambda a: (a != "") & (a != F.lower("name"))))
    return named.withColumn("_rn", first).where("_rn = 1").select("session_id", "pos", "name", F.coalesce("e.type", F.lit("Concept")).alias("type"), F.coalesce("e.heading", F.lit("")).alias("heading"), aliases.alias("aliases"), _score(F.col("e.confidence")).alias("confidence"))


def parsed_relations(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    rows = parsed.select("session_id", F.posexplode("parsed.candidate_relations").alias("pos", "r")).select("session_id", "pos", F.lower(F.trim("r.source")).alias("s"), F.lower(F.trim("r.target")).alias("t"), "r.relation", _score(F.col("r.confidence")).alias("confidence"))
    known = entities.select("session_id", F.lower("name").alias("low"), "name").distinct()
    ends = rows.join(known.toDF("session_id", "s", "source"), ["session_id", "s"]).join(known.toDF("session_id", "t", "target"), ["session_id", "t"])
    return ends.where(F.col("relation").isin(*RELATIONS) & (F.col("s") != F.col("t"))).select("session_id", "pos", "source", "target", "relation", "confidence")
