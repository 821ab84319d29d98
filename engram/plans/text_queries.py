"""Queries of texts: what models return, what they are given, and cleaning; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import exprs as E
from engram.operators import consolidate as K
from engram.operators import decode
from engram.operators import prompts
from engram.operators import text as X
from engram.plans.base import query, r6
from engram.sources import proxies as P


def _k(s, d):
    return P.table(s, d, "events").select(F.col("event_id").alias("session_id"))


@query("select event_id as id, case event_id % 3 when 0 then 'kept '||event_id when 1 then 'a  b' else 'left <think>open' end as text from events")
def strip_hidden_reasoning(s, d):
    i = F.col("session_id")
    t = F.when(i % 3 == 0, F.concat(F.lit("<Think>x\ny</think> kept "), i.cast("string"))).when(i % 3 == 1, " a <reasoning>r</reasoning> b ").otherwise("left <think>open")
    return _k(s, d).select(i.alias("id"), E.strip_reasoning(t).alias("text"))


@query("select event_id as id, case event_id % 3 when 0 then '{}' when 1 then 'plain ```' else 'a'||chr(10)||'b' end as text from events")
def strip_fences(s, d):
    i = F.col("session_id")
    t = F.when(i % 3 == 0, "```json\n{}\n```").when(i % 3 == 1, "plain ```").otherwise("```\na\n ```\nb")
    return _k(s, d).select(i.alias("id"), E.strip_fences(t).alias("text"))


@query("select event_id as id, case event_id % 5 when 0 then 'Do x|Do y' when 1 then 'one|two' when 2 then 'only one.' when 3 then '' else '1. alone' end as items from events")
def subtask_lists(s, d):
    i = F.col("session_id")
    t = F.when(i % 5 == 0, "1. Do x. 2. Do y.").when(i % 5 == 1, "one\n\n two ").when(i % 5 == 2, " only one. ").when(i % 5 == 3, "  ").otherwise("1. alone")
    return _k(s, d).select(i.alias("id"), F.array_join(E.subtask_list(t), "|").alias("items"))


@query("select doc_id, ceil(length(text) / 4)::int as tokens, substr(text, 1, 80) as head from documents")
def token_estimates(s, d):
    return P.table(s, d, "documents").select("doc_id", E.token_estimate("text").alias("tokens"), F.substring("text", 1, 80).alias("head"))


@query("select event_id as id, ['boolean', 'integer', 'number', 'string', 'string'][1 + event_id % 5] as type from events")
def tool_schema_types(s, d):
    said = F.get(F.array(*map(F.lit, ["bool - yes or no", "int - how many", "float - how much", "str - what", "The integer"])), (F.col("session_id") % 5).cast("int"))
    return _k(s, d).select(F.col("session_id").alias("id"), E.schema_type(said).alias("type"))


@query("select event_id as session_id, 'likes tea '||event_id as text, case when event_id % 2 = 0 then 0.8 else 0.5 end as importance, case when event_id % 2 = 0 then 'preferences' else 'other' end as category from events where event_id % 4 <> 3")
def parse_facts(s, d):
    """Facts of an array; blank ones go, what is no number counts as .5, and no array gives none."""
    i = F.col("session_id")
    told = F.concat(F.lit("likes tea "), i.cast("string"))
    good = F.concat(F.lit('[{"memory": " '), told, F.lit(' ", "importance": '), F.when(i % 2 == 0, '0.8, "category": "preferences"').otherwise('"high"'), F.lit('}, {"memory": " "}, {"importance": 1}]'))
    raw = _k(s, d).select("session_id", F.when(i % 4 == 3, '{"memory": ').when(i % 4 == 2, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(good).alias("json"))
    return decode.facts(raw).select("session_id", "text", "importance", "category")


@query("select event_id as session_id, case event_id % 3 when 0 then repeat('x', 120) when 1 then 'Own title' else 'Fallback' end as title, case event_id % 3 when 0 then 'told' else 'plain' end as summary, case event_id % 3 when 0 then 'a|b|c|d|e|f' else 'z' end as topics from events")
def parse_summaries(s, d):
    i = F.col("session_id")
    text = F.when(i % 3 == 0, F.concat(F.lit('{"title": "'), F.repeat(F.lit("x"), F.lit(200)), F.lit('", "summary": " told ", "key_topics": ["a", " b ", "", "c", "d", "e", "f", "g"]}'))).when(i % 3 == 1, '{"title": "Own title", "summary": "  "}').otherwise("none at all")
    raw = _k(s, d).select("session_id", text.alias("json"), F.lit("Fallback").alias("title"), F.lit("plain").alias("summary"), F.array(F.lit("z")).alias("key_topics"))
    return decode.summaries(raw).select("session_id", "title", "summary", F.array_join("key_topics", "|").alias("topics"))


@query("""select event_id as session_id, op, round(c, 6) as confidence, coalesce(a, '') as alias, st as status from (select event_id, unnest([{'op': 'insert_edge', 'c': 1.0, 'a': null::varchar}, {'op': 'update_edge_confidence', 'c': 0.5, 'a': null}, {'op': 'deactivate_edge', 'c': -1.0, 'a': null}, {'op': 'add_alias', 'c': -1.0, 'a': 'bb'}], recursive := true), 'done' as st from events where event_id % 3 = 0)
 union all select event_id, '', -1.0, '', case event_id % 3 when 1 then 'retry' else 'done' end from events where event_id % 3 <> 0""")
def parse_operations(s, d):
    """Whole operations with known ends; an empty list is done, what can't be read is tried again."""
    i = F.col("session_id")
    ops = '{"operations": [{"type": "insert_edge", "source_id": "a", "target_id": "b", "relation": "uses", "confidence": 1.02}, {"type": "insert_edge", "source_id": "a", "target_id": "zz", "relation": "uses", "confidence": 0.9}, {"type": "update_edge_confidence", "edge_id": "e", "confidence": "many"}, {"type": "update_edge_confidence", "edge_id": ""}, {"type": "deactivate_edge", "edge_id": "e"}, {"type": "add_alias", "node_id": "a", "alias": " BB "}, {"type": "merge", "edge_id": "e"}]}'
    raw = _k(s, d).select("session_id", F.when(i % 3 == 0, ops).when(i % 3 == 1, "[1, 2").otherwise('{"operations": []}').alias("json"))
    ends = raw.select("session_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("node_id"))
    found, status = decode.proposals(raw, ends)
    return status.join(found, "session_id", "left").select("session_id", F.coalesce("op_type", F.lit("")).alias("op"), F.round(F.coalesce("confidence", F.lit(-1.0)), 6).alias("confidence"), F.coalesce("alias", F.lit("")).alias("alias"), "status")


@query("with u as (select conv_id, turn, text, length(text) l, sum(length(text)) over (partition by conv_id order by turn desc) used, row_number() over (partition by conv_id order by turn desc) rn, row_number() over (partition by conv_id order by turn) n from conversations), k as (select *, min(n) over (partition by conv_id) - 1 as omitted from u where used <= 3000 or rn = 1) select conv_id as session_id, md5(case when max(omitted) > 0 then '  (earliest '||max(omitted)||' chunk note(s) omitted — over length budget)'||chr(10) else '' end||string_agg('  '||n||'. '||text, chr(10) order by n)) as digest from k group by 1")
def narrative_text(s, d):
    """The latest notes within the budget, with their own numbers and a line on those left out."""
    return X.narrative_text(P.turns(s, d).select("session_id", F.col("turn").alias("idx"), "text"), 3000).select("session_id", F.md5("text").alias("digest"))


@query("with p as (select conv_id, turn // 2 as pos, coalesce(max(text) filter (role = 'user'), '') as u, coalesce(max(text) filter (role = 'assistant'), '') as a from conversations where role <> 'system' group by 1, 2) select conv_id as session_id, md5(right(string_agg('User: '||u||chr(10)||'Assistant: '||trim(a), chr(10) order by pos), 6000)) as digest from p where u <> '' or a <> '' group by 1")
def extraction_snippet(s, d):
    """Pairs of turns as one text for fact extraction, the last 6,000 characters."""
    t = P.turns(s, d).where("role <> 'system'").withColumn("pos", F.floor(F.col("turn") / 2))
    said = lambda role: F.max(F.when(F.col("role") == role, F.col("text"))).alias(role)
    return X.extraction_snippet(t.groupBy("session_id", "pos").agg(said("user"), said("assistant"))).select("session_id", F.md5("text").alias("digest"))


TASK = prompts.TASK.replace("'", "''")


@query(f"""select event_id as session_id, md5(array_to_string(list_filter(['SESSION: '||event_id, '', case when event_id % 2 = 0 then 'CONVERSATION NARRATIVE (chunk summaries — primary extraction signal):'||chr(10)||'said' else 'CONVERSATION NARRATIVE: (not available for this session)' end, '',
 case when event_id % 3 = 0 then 'EPISODE SUMMARY (title and overview):'||chr(10)||'t'||chr(10)||'s'||chr(10) end, case when event_id % 5 <> 0 then 'SEMANTIC FACTS FROM THIS SESSION (2):'||chr(10)||'  1. f'||chr(10)||'  2. g'||chr(10) end, '{TASK}'], lambda x: x is not null), chr(10))) as digest from events""")
def extraction_prompts(s, d):
    i = F.col("session_id")
    b = _k(s, d).select("session_id", F.when(i % 2 == 0, " said ").alias("conversation_text"), F.when(i % 3 == 0, "t\ns").otherwise("").alias("episode_text"), F.when(i % 5 != 0, F.array(F.lit("f "), F.lit("g"))).otherwise(F.array().cast("array<string>")).alias("semantic_texts"))
    return prompts.extraction(b).select("session_id", F.md5("prompt").alias("digest"))


@query("select event_id as id, case when event_id % 2 = 0 then 'No memories provided.' else 'MEMORIES TO PROCESS (2 total):'||chr(10)||chr(10)||'[Memory 1]'||chr(10)||'a'||chr(10)||chr(10)||'[Memory 2]'||chr(10)||'b'||chr(10) end as text from events")
def memory_prompts(s, d):
    texts = F.when(F.col("session_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" a"), F.lit("b ")))
    return _k(s, d).select(F.col("session_id").alias("id"), prompts.memories(texts).alias("text"))


@query("""select event_id as session_id, md5('RESOLVED ENTITIES (matched to graph nodes):'||n||'  name=A  node_id=a'||event_id||'  type=Concept  ('||case when event_id % 2 = 0 then 'NEW NODE' else 'existing node' end||')'||n||n||'CURRENT SUBGRAPH (existing nodes and edges near resolved entities):'||n||case when event_id % 3 = 0 then 'edges' else '  (no existing connections)' end||n||n||'MEMORIES (1 total):'||n||'  [m]: text'||n||n
 ||'Propose the minimum graph operations that accurately reflect the relationships in these memories given the existing subgraph above.'||n||n||n||n||'CANDIDATE RELATIONS (hints from initial extraction, verify against memories):'||n||case when event_id % 5 = 0 then n||'A uses B' else '' end) as digest from events, (select chr(10) as n)""")
def proposal_prompts(s, d):
    i = F.col("session_id")
    rows = _k(s, d).select(
        "session_id", F.array(F.struct(F.lit("A").alias("name"), F.concat(F.lit("a"), i.cast("string")).alias("node_id"), F.lit("Concept").alias("type"), (i % 2 == 0).alias("is_new"))).alias("entities"), F.when(i % 3 == 0, "edges").otherwise(" ").alias("subgraph"),
        F.array(F.struct(F.lit("m").alias("id"), F.lit(" text ").alias("text"))).alias("memories"), F.when(i % 5 == 0, F.array(F.lit("A uses B"))).alias("hints"),
    )
    return prompts.proposal(rows).select("session_id", F.md5("prompt").alias("digest"))


@query("select event_id as session_id, 'Turn count: '||(event_id % 9)||chr(10)||'Trigger: '||event_type||case when event_id % 2 = 0 then chr(10)||'Goal: go' else '' end||case when event_id % 3 = 0 then chr(10)||'Session narrative so far (in order):'||chr(10)||'  1. x'||chr(10)||'  2. y' else '' end||case when event_id % 5 = 0 then chr(10)||'Last error: '||repeat('e', 300) else '' end as prompt from events")
def reflection_prompts(s, d):
    i = F.col("event_id")
    jobs = P.table(s, d, "events").select(i.alias("session_id"), (i % 9).alias("turn_count"), F.col("event_type").alias("trigger"), F.when(i % 2 == 0, "go").otherwise("").alias("goal"), F.when(i % 3 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("chunk_summaries"), F.when(i % 5 == 0, F.repeat(F.lit("e"), F.lit(400))).alias("last_error"))
    return prompts.reflection(jobs)


@query("select user_id as session_id, md5('Total directives to review: '||count(*)||chr(10)||chr(10)||string_agg(rn||'. id='||event_id||chr(10)||'   directive:   d'||event_id||chr(10)||'   scope:       user'||chr(10)||'   specificity: ?'||chr(10)||'   confidence:  0.5'||chr(10)||'   actionable:  true'||chr(10)||'   novel:       false', chr(10) order by event_id)) as digest from (select *, row_number() over (partition by user_id order by event_id) rn from events) group by 1")
def consolidation_prompts(s, d):
    i = F.col("event_id")
    r = P.table(s, d, "events").select(F.col("user_id").alias("session_id"), i.alias("seq"), i.alias("id"), F.concat(F.lit("d"), i.cast("string")).alias("directive"), F.lit("user").alias("scope"), F.lit(None).cast("string").alias("specificity"), F.lit(0.5).alias("confidence"), F.lit(True).alias("actionable"), F.lit(False).alias("novel"))
    return prompts.consolidation(r).select("session_id", F.md5("prompt").alias("digest"))


@query("select conv_id as session_id, md5(string_agg(text, chr(10)||chr(10) order by turn, role)) as digest from conversations group by 1")
def narrative_concat(s, d):
    return X.ordered_text(P.turns(s, d), F.col("text"), "\n\n").select("session_id", F.md5("text").alias("digest"))


@query("select event_id as id, 'a' as part from events where event_type = 'click' union all select event_id, 'b' from events where event_type = 'view'")
def turn_batches_concat(s, d):
    """Batches of turns one behind the other."""
    e = P.table(s, d, "events")
    return e.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.lit("a").alias("part")).unionByName(e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.lit("b").alias("part")))


@query("select user_id as session_id, round(max(least(1.0, value/500)), 6) as importance from events group by 1")
def largest_importance(s, d):
    return P.working_memory(s, d).groupBy("session_id").agg(r6(F.max("priority"), "importance"))


def resolved_nodes(s, d):
    """Ids of nodes that names make are the same in every run."""
    return P.nodes(s, d).select("name").distinct().select("name", K.G.node_id_of(F.col("name")).alias("node_id"))


query("select distinct p_name as name, 'n_'||md5(p_name) as node_id from part")(resolved_nodes)
