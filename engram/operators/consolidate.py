"""The consolidation pass: pending sessions, their entities and proposed edits, into the graph.

A pass takes the oldest pending sessions together. What a model said about them comes as tables of JSON texts; a session
whose texts can't be read stays pending, and so do the ones behind it, as a later session may build on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators import decode, edits
from engram.operators import graph as G
from engram.operators import text as X
from engram.operators.tables import patch, topk
from engram.sources.store import settled

MOST_SESSIONS = 20


def next_batch(queue: DataFrame, episodes: DataFrame, facts: DataFrame, n: int = MOST_SESSIONS) -> DataFrame:
    """The n oldest pending sessions with the text of their latest episode and of their facts, in the order of the ids; what
    is missing is empty."""
    if n <= 0:
        return queue.limit(0).withColumns({"episode_text": F.lit(""), "semantic_texts": F.array().cast("array<string>")})
    pending = topk(queue.where("processed_at is null"), [F.col("queued_at"), F.col("session_id")], n)
    told = episodes.groupBy("session_id").agg(F.max_by(F.concat_ws("\n", "title", "summary"), F.struct("start_time", "id")).alias("episode_text"))
    links = pending.select("session_id", F.posexplode("semantic_memory_ids").alias("pos", "id"))
    texts = links.join(facts.select("id", "text"), "id").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("semantic_texts"))
    j = pending.join(told, "session_id", "left").join(texts, "session_id", "left")
    return j.withColumns({"episode_text": F.coalesce("episode_text", F.lit("")), "semantic_texts": F.coalesce("semantic_texts", F.array().cast("array<string>"))})


def side_effects(resolved: DataFrame, entities: DataFrame, nodes: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and aliases after entities were resolved: new nodes, the larger confidence of old ones, all aliases of an entity,
    and its name if keywords matched it."""
    met = resolved.where(F.col("node_id").isNotNull()).join(entities, "entity_id")
    made = met.where("method = 'created'").select(F.col("node_id").alias("id"), F.trim("name").alias("name"), "type", "heading", F.least(F.col("confidence"), F.lit(0.6)).alias("importance"), "confidence")
    best = met.where("method <> 'created'").groupBy(F.col("node_id").alias("id")).agg(F.max("confidence").alias("_c"))
    old = nodes.join(best, "id", "left").withColumn("confidence", F.greatest("confidence", "_c")).drop("_c")
    named = met.select("node_id", F.explode("aliases").alias("alias")).unionByName(met.where("method = 'keyword'").select("node_id", F.col("name").alias("alias")))
    return edits.insert_nodes(old, made, [F.col("id")]), edits.add_aliases(aliases, named)


def memory_links(resolved: DataFrame, entities: DataFrame, bundles: DataFrame) -> DataFrame:
    """Every resolved node of a session with every memory of it: (session_id, node_id, memory_id, memory_type, relevance)."""
    none = F.array().cast("array<string>")
    own = F.when(F.coalesce("episodic_memory_id", F.lit("")) != "", F.array("episodic_memory_id")).otherwise(none)
    held = bundles.select("session_id", "episodic_memory_id", F.posexplode(F.concat(own, F.coalesce("semantic_memory_ids", none))).alias("pos", "memory_id"))
    rows = resolved.where(F.col("node_id").isNotNull()).join(entities.select("entity_id", "session_id", "confidence"), "entity_id").join(held, "session_id")
    kind = F.when(F.col("memory_id") == F.col("episodic_memory_id"), "episodic").otherwise("semantic")
    return rows.select("session_id", "entity_id", "pos", "node_id", "memory_id", kind.alias("memory_type"), F.col("confidence").alias("relevance"))


def cycle(queue: DataFrame, bundles: DataFrame, extracted: DataFrame, proposed: DataFrame, graph: dict[str, DataFrame], at) -> dict[str, DataFrame]:
    """Tables after a pass over bundles (next_batch): nodes, aliases, edges, links, log, queue, and a one-row report.

    extracted(session_id, json) and proposed(session_id, json) are a model's answers; graph holds nodes, aliases, edges,
    links and log. A session without entities is done without a proposal."""
    parsed = X.parse_extractions(extracted)
    found = X.parsed_entities(parsed)
    asked = bundles.select("session_id", "queued_at").join(parsed.select("session_id", "status"), "session_id", "left")
    told = found.groupBy("session_id").agg(F.count("*").alias("n"))
    # ends are checked against the session's resolved nodes below; here only whether the answer can be read
    answer = decode.proposals(proposed, found.select("session_id", F.col("name").alias("node_id")).limit(0))[1].withColumnRenamed("status", "answer")
    asked = asked.join(told, "session_id", "left").join(answer, "session_id", "left")
    broken = (F.coalesce("status", F.lit("retry")) == "retry") | ((F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("answer", F.lit("retry")) == "retry"))
    turn = Window.partitionBy(F.lit(0)).orderBy("queued_at", "session_id")  # a batch, MOST_SESSIONS rows
    stuck = F.max(broken.cast("int")).over(turn)
    state = asked.withColumns({"broken": broken, "stuck": stuck}).select("session_id", "queued_at", "broken", (F.col("stuck") == 0).alias("done"), (F.lag("stuck", 1, 0).over(turn) == 0).alias("tried"))
    state = settled(state, "state")
    done = state.where("done").select("session_id", "queued_at")
    entities = found.join(done, "session_id").withColumn("entity_id", F.concat_ws("-", F.date_format("queued_at", "yyyyMMddHHmmss"), F.col("session_id").cast("string"), F.format_string("%06d", "pos")))
    entities = settled(entities, "entities")
    resolved = settled(G.resolve_entities(entities, graph["nodes"], graph["aliases"]), "resolved")
    nodes, aliases = side_effects(resolved, entities, graph["nodes"], graph["aliases"])
    ends = resolved.where(F.col("node_id").isNotNull()).join(entities.select("entity_id", "session_id"), "entity_id")
    ops = decode.proposals(proposed.join(done, "session_id", "left_semi"), ends)[0]
    order = done.select("session_id", F.date_format("queued_at", "yyyyMMddHHmmss").alias("_q"))
    ops = ops.join(order, "session_id").withColumn("op_id", F.concat_ws("-", "_q", "op_id")).drop("_q")
    checked = settled(G.validate_operations(settled(ops, "ops"), nodes, graph["edges"]), "checked")
    edges, aliases, report = G.apply_operations(graph["edges"], aliases, checked)
    wanted = memory_links(resolved, entities, bundles.join(done, "session_id", "left_semi"))
    links = edits.link_memories(graph["links"], wanted.select("node_id", "memory_id", "memory_type", "relevance", "entity_id", "pos"), [F.col("entity_id"), F.col("pos")]).select(*graph["links"].columns)
    made = resolved.where("method = 'created'").join(entities.select("entity_id", "name", "type", "session_id"), "entity_id")
    detail = lambda **c: F.to_json(F.struct(*(v.alias(k) for k, v in c.items())))
    notes = made.select(F.lit("insert_node").alias("operation"), F.lit("node").alias("entity_type"), F.col("node_id").alias("entity_id"), detail(name=F.col("name"), type=F.col("type"), session_id=F.col("session_id").cast("string")).alias("details"), F.lit("sleep_pipeline").alias("source"))
    new_edges = checked.where("is_valid and op_type = 'insert_edge'").select(F.lit("insert_edge").alias("operation"), F.lit("edge").alias("entity_type"), G.edge_id_of("source_id", "target_id").alias("entity_id"), detail(relation=F.col("relation"), confidence=F.col("confidence")).alias("details"), F.lit("sleep_pipeline").alias("source"))
    off = checked.where("is_valid and op_type = 'deactivate_edge'").select(F.lit("deactivate_edge").alias("operation"), F.lit("edge").alias("entity_type"), F.col("edge_id").alias("entity_id"), detail(reasoning=F.col("reasoning")).alias("details"), F.lit("sleep_pipeline").alias("source"))
    log = edits.append_log(graph["log"], notes.unionByName(new_edges).unionByName(off), at)
    stamped = patch(queue, done.select("session_id", at.alias("processed_at")), "session_id")
    counts = state.agg(F.count_if("tried").alias("batches_attempted"), F.count_if("done").alias("batches_completed"), F.count_if(F.col("tried") & ~F.col("done")).alias("batches_skipped"))
    people = resolved.agg(F.count_if(F.col("method") == "created").alias("nodes_created"), F.count_if(F.col("node_id").isNotNull() & (F.col("method") != "created")).alias("nodes_matched"))
    edited = report.select(F.col("inserted").alias("edges_inserted"), F.col("updated").alias("edges_updated"), F.col("deactivated").alias("edges_deactivated"), F.col("aliased").alias("aliases_added"), F.col("rejected").alias("ops_rejected"), F.col("converted").alias("ops_converted"))
    linked = links.join(graph["links"].select("node_id", "memory_id"), ["node_id", "memory_id"], "left_anti").agg(F.count("*").alias("memories_linked"))
    summary = counts.withColumn("sessions_processed", F.col("batches_completed"))
    for one in (people, edited, linked):  # a row each
        summary = summary.join(one, F.lit(True))
    return {"nodes": nodes, "aliases": aliases, "edges": edges, "links": links, "log": log, "queue": stamped, "report": summary}


def report_lines(report: DataFrame) -> DataFrame:
    """The report as lines of text."""
    c = lambda name: F.col(name).cast("string")
    lines = [
        F.concat(F.lit("Batches:   "), c("batches_completed"), F.lit("/"), c("batches_attempted"), F.lit(" completed, "), c("batches_skipped"), F.lit(" skipped")), F.concat(F.lit("Sessions:  "), c("sessions_processed"), F.lit(" processed")),
        F.concat(F.lit("Nodes:     "), c("nodes_created"), F.lit(" created, "), c("nodes_matched"), F.lit(" matched")), F.concat(F.lit("Edges:     "), c("edges_inserted"), F.lit(" inserted, "), c("edges_updated"), F.lit(" updated, "), c("edges_deactivated"), F.lit(" deactivated")),
        F.concat(F.lit("Aliases:   "), c("aliases_added"), F.lit(" added")), F.concat(F.lit("Rejected:  "), c("ops_rejected"), F.lit(" ops ("), c("ops_converted"), F.lit(" auto-converted duplicates)")),
    ]
    return report.select(F.posexplode(F.array(*lines)).alias("line", "text"))
