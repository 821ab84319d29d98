"""The engine's operators by the names that a model calls: ten tools, calls from text or as they come, results as text.

A call is (tool, arguments) against a Memory, which holds the tables; tools that change something give a Memory back."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import graph as G
from engram.operators import retrieval as R
from engram.operators import scratchpad as PAD
from engram.operators import text as X
from engram.plans import registry

MOST_CHARS = 2000


@dataclass(frozen=True)
class Memory:
    """Tables of one session's view: its facts, episodes and graph, and the log of its scratchpad. embed turns texts into vectors."""

    spark: SparkSession
    facts: DataFrame
    episodes: DataFrame
    nodes: DataFrame
    aliases: DataFrame
    edges: DataFrame
    pad_log: DataFrame
    now: str
    embed: object
    session_id: int = 0

    def asked(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query, [float(x) for x in self.embed(query)])], "query_id long, text string, q array<double>")

    def noted(self, op: str, key: str, value: str) -> Memory:
        seq = self.pad_log.count()  # one session's log
        row = self.spark.createDataFrame([(self.session_id, seq, op, key, value)], "session_id long, seq long, op string, key string, value string")
        return replace(self, pad_log=self.pad_log.unionByName(row))

    def state(self) -> DataFrame:
        empty = self.spark.createDataFrame([(self.session_id,)], "session_id long")
        folded = PAD.fold(self.pad_log)
        return empty.join(folded, "session_id", "left").select("session_id", F.coalesce("state", PAD._empty()).alias("state"))


def _one(df: DataFrame) -> str:
    row = df.first()  # a row per question, and there is one
    return row.text if row else ""


def update_scratchpad_summary(memory: Memory, summary_text: str):
    m = memory.noted("add_summary", "", summary_text).noted("tool_output", "update_scratchpad_summary", "Updated scratchpad summary")
    return m, None


def update_scratchpad_state(memory: Memory, section: str, key: str, value: str):
    if section != "tool_outputs" and key not in PAD.SECTIONS.get(section, []):
        raise ValueError(f"section {section!r} has no key {key!r}")
    row = memory.spark.createDataFrame([(memory.session_id, memory.pad_log.count(), section, key, value)], "session_id long, seq long, section string, key string, value string")
    log = PAD.updates_as_log(row)
    return replace(memory, pad_log=memory.pad_log.unionByName(log)), None


def get_scratchpad_state(memory: Memory):
    return memory, memory.state().select(F.to_json("state").alias("text")).first().text


def add_scratchpad_memory_update(memory: Memory, memory_type: str, data: str, update: bool = False):
    return memory.noted("memory_update" if update else "memory_insert", memory_type, data), None


def get_scratchpad_retrieved_context(memory: Memory):
    return memory, memory.state().select(F.to_json(F.col("state.outputs")).alias("text")).first().text


def store_semantic_memory(memory: Memory, text: str, importance: float = 0.5, category: str = "other", polarity: str = "neutral"):
    owner = memory.facts.select(F.max("owner").alias("o")).first().o or 0
    new = memory.asked(text).select(F.lit(owner).cast("long").alias("owner"), F.lit(0).alias("seq"), F.concat(F.lit("m_"), F.substring(F.md5("text"), 1, 12)).alias("id"), F.trim("text").alias("text"), F.col("q").alias("embedding"), F.lit(float(importance)).alias("importance"), F.lit(category).alias("category"), F.lit(polarity).alias("polarity"))
    return replace(memory, facts=R.store_in_order(memory.facts, new).drop("created")), None


def search_semantic_memory(memory: Memory, query: str, k: int = 5):
    asked = memory.asked(query)
    out = _one(R.search_text(R.facts_near(memory.facts, asked, int(k)), asked))
    return memory.noted("tool_output", "search_semantic_memory", out), out


def search_episodic_memory(memory: Memory, query: str, k: int = 3):
    asked = memory.asked(query)
    out = R.NO_SESSIONS if not query.strip() else _one(R.episodes_text(R.episodes_near(memory.episodes, asked, int(k)), memory.facts, asked))
    return memory.noted("tool_output", "search_episodic_memory", out), out


def browse_episodic_memory(memory: Memory, mode: str = "recent", query: str = "", limit: int = 5, session_id: int | None = None, within_days: int | None = None):
    asked = memory.asked(query or "").withColumn("session_id", F.lit(session_id).cast("long"))
    nothing = (mode == "semantic" and not (query or "").strip()) or (mode == "by_session" and session_id is None)
    hits = R.browse(memory.episodes, asked, F.lit(memory.now).cast("timestamp_ntz"), mode, int(limit), within_days)
    out = R.NO_EPISODES if nothing else _one(R.episodes_text(hits, memory.facts, asked, R.NO_EPISODES))
    return memory.noted("tool_output", "browse_episodic_memory", out), out


def query_knowledge_graph(memory: Memory, query: str, top_n: int = 5):
    if not query or not query.strip():
        return memory, G.NO_MATCH
    asked = memory.asked(query)
    tier1, hits = G.candidates(asked, memory.nodes, memory.aliases)
    found = G.seeds(tier1, G.fused(hits, memory.nodes), memory.nodes, int(top_n))
    return memory, _one(G.answer(asked, found, memory.nodes, memory.edges))


TOOLS = [
    update_scratchpad_summary, update_scratchpad_state, get_scratchpad_state, add_scratchpad_memory_update, get_scratchpad_retrieved_context,
    store_semantic_memory, search_semantic_memory, search_episodic_memory, browse_episodic_memory, query_knowledge_graph,
]
for _tool in TOOLS:
    registry.register(_tool.__name__, _tool)


def run_call(memory: Memory, tool: str, arguments: dict | None) -> tuple[Memory, str]:
    """The memory after a call and its result as text, MOST_CHARS at most; unknown tools and unfit arguments say so."""
    if registry.get(tool) is None:
        return memory, f"Unknown tool: {tool}"
    try:
        memory, out = registry.call(tool, memory=memory, **(arguments if isinstance(arguments, dict) else {}))
    except TypeError:
        return memory, f"Failed to call {tool}."
    return memory, "Done." if out is None else str(out)[:MOST_CHARS]


def execute(memory: Memory, text: str = "", calls: list[dict] | None = None) -> tuple[Memory, dict[str, str]]:
    """Calls within the text run first, then those given as {id, function: {name, arguments}}; results by the latter's ids."""
    results: dict[str, str] = {}
    if text:
        said = memory.spark.createDataFrame([(0, text)], "id long, text string")
        for r in X.parse_tool_calls(said).orderBy("pos").collect():  # the calls of one message
            memory, _ = run_call(memory, r.tool, _arguments(r.arguments))
    for c in calls or []:
        name = c.get("function", {}).get("name")
        if name:
            memory, out = run_call(memory, name, _arguments(c["function"].get("arguments", "{}")))
            if c.get("id"):
                results[c["id"]] = out
    return memory, results


def _arguments(raw: object) -> dict:
    try:
        got = json.loads(raw) if isinstance(raw, str) else raw
    except json.JSONDecodeError:
        return {}
    return got if isinstance(got, dict) else {}
