"""Queries of graph look-ups, edits, answers and the consolidation pass, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import exprs as E
from engram.operators import consolidate as K
from engram.operators import edits as D
from engram.operators import graph as G
from engram.operators import tables as T
from engram.plans.base import EDGES, KEYWORDS, LINKS, NODES, as_of, query, r6
from engram.plans.catalogue import QUESTIONS, SEEDS, _named, _seeds
from engram.sources import proxies as P

WORDS = KEYWORDS.format("name||' '||heading")
WANTED = "w(id) as (values (3), (17), (64), (100000000))"
PER_RELATION = """re as (select 'S'||l_suppkey||'-P'||l_partkey||'-'||l_returnflag as id, 'S'||l_suppkey as source_id, 'P'||l_partkey as target_id, case l_returnflag when 'A' then 'uses' when 'N' then 'related_to' else 'mentions' end as relation,
 round(avg(l_discount)*10,6) as weight, round(avg(l_quantity)/50,6) as confidence, max(l_linestatus)='O' as active from lineitem group by l_suppkey, l_partkey, l_returnflag)"""


def _wanted(s):
    return s.createDataFrame([(3,), (17,), (64,), (100000000,)], "id long")


def _relation_edges(s, d):
    """Edges by pair and relation, so that a pair may have several."""
    g = P.table(s, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.round(F.avg("l_discount") * 10, 6).alias("weight"), F.round(F.avg("l_quantity") / 50, 6).alias("confidence"), (F.max("l_linestatus") == "O").alias("active"))
    a, b = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    return g.select(F.concat_ws("-", a, b, "l_returnflag").alias("id"), a.alias("source_id"), b.alias("target_id"), F.when(F.col("l_returnflag") == "A", "uses").when(F.col("l_returnflag") == "N", "related_to").otherwise("mentions").alias("relation"), "weight", "confidence", "active")


@query(f"with {NODES}, {WANTED} select id, name, type from nodes join w using (id)")
def node_lookup_by_id(s, d):
    return P.nodes(s, d).join(F.broadcast(_wanted(s)), "id").select("id", "name", "type")


@query(f"with {EDGES} select id, relation, weight, active from edges where id in ('S1-P1', 'S2-P3', 'S3-P17', 'none') or id like 'S5-P1%'")
def edge_lookup_by_id(s, d):
    e = P.edges(s, d)
    wanted = s.createDataFrame([("S1-P1",), ("S2-P3",), ("S3-P17",), ("none",)], "id string").unionByName(e.where("id like 'S5-P1%'").select("id")).distinct()
    return e.join(wanted, "id", "left_semi").select("id", "relation", "weight", "active")


BETWEEN = "select source_id, target_id, id, relation, weight from (select *, row_number() over (partition by source_id, target_id order by weight desc, confidence desc, id) rn from re {}) where rn = 1"


@query(f"with {PER_RELATION} {BETWEEN.format('where active')}")
def edge_between_any(s, d):
    e = _relation_edges(s, d)
    return D.edge_between(e, e).select("source_id", "target_id", "id", "relation", "weight")


@query(f"""with {PER_RELATION} {BETWEEN.format("where relation = 'related_to'")}""")
def edge_between_relation(s, d):
    e = _relation_edges(s, d)
    return D.edge_between(e, e, "related_to", active_only=False).select("source_id", "target_id", "id", "relation", "weight")


@query("select p_partkey as node_id, string_agg(distinct a, ',' order by a) as aliases from (select p_partkey, unnest([lower(p_brand), lower(p_name), lower(p_brand)]) as a from part) group by 1")
def aliases_of_node(s, d):
    n = P.table(s, d, "part").select(F.col("p_partkey").alias("node_id"), F.explode(F.array(F.lower("p_brand"), F.lower("p_name"), F.lower("p_brand"))).alias("alias"))
    return n.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


@query(f"with {NODES}, k as (select distinct id as node_id, unnest({WORDS}) as keyword from nodes) select node_id, string_agg(keyword, ',' order by keyword) as keywords from k group by 1")
def keywords_of_node(s, d):
    return D.keyword_rows(P.nodes(s, d)).groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("keywords"))


CHANGES = "select id, case when id % 4 = 0 then '  new name '||id||' ' when id % 4 = 1 then ' ' end as name, case when id % 5 = 0 then 'Concept' when id % 5 = 1 then 'Nothing' end as type, id % 30 / 10.0 as importance from nodes where id % 2 = 0 or id % 5 = 1"
AFTER = f"ch as ({CHANGES}), ok as (select * from ch where (name is null or trim(name) <> '') and (type is null or type = 'Concept')), up as (select n.id, coalesce(trim(ok.name), n.name) as name, coalesce(ok.type, n.type) as type, n.heading, case when ok.importance is null then n.importance else least(1.0, ok.importance) end as importance, ok.id is not null as touched from nodes n left join ok using (id))"


def _updated(s, d):
    i = F.col("id")
    n = P.nodes(s, d)
    ch = n.where("id % 2 = 0 or id % 5 = 1").select("id", F.when(i % 4 == 0, F.concat(F.lit("  new name "), i.cast("string"), F.lit(" "))).when(i % 4 == 1, " ").alias("name"), F.when(i % 5 == 0, "Concept").when(i % 5 == 1, "Nothing").alias("type"), F.lit(None).cast("string").alias("heading"), (i % 30 / 10.0).alias("importance"), F.lit(None).cast("double").alias("confidence"))
    return D.update_nodes(n, ch, as_of())


@query(f"with {NODES}, {AFTER} select id, name, type, round(importance, 6) as importance, touched from up")
def node_update(s, d):
    """Partial updates: scores are clamped, blank names and unknown types refused."""
    return _updated(s, d).select("id", "name", "type", r6("importance", "importance"), F.col("updated_at").isNotNull().alias("touched"))


@query(f"with {NODES}, {AFTER} select distinct id as node_id, unnest({WORDS}) as keyword from up")
def node_update_reindex(s, d):
    """Keywords after the update, made anew from names and headings."""
    return D.keyword_rows(_updated(s, d)).distinct()


@query(f"with {NODES}, {LINKS}, k as (select distinct id as node_id, unnest({WORDS}) as keyword from nodes), a as (select p_partkey as node_id, lower(p_brand) as alias from part) select 'alias' as child, node_id::bigint as node_id, alias as value from a where node_id % 10 <> 0 union all select 'keyword', node_id, keyword from k where node_id % 10 <> 0 union all select 'link', node_id, memory_id::varchar from links where node_id % 10 <> 0")
def node_delete_children(s, d):
    """What is left of aliases, keywords and links when every tenth node is deleted."""
    n = P.nodes(s, d)
    e = P.edges(s, d)
    left = T.delete_cascade(n, n.where("id % 10 = 0"), e, P.aliases(s, d), D.keyword_rows(n), P.links(s, d).withColumn("memory_id", F.col("memory_id").cast("string")))
    parts = [t.select(F.lit(c).alias("child"), "node_id", F.col(v).alias("value")) for t, c, v in zip(left[2:], ("alias", "keyword", "link"), ("alias", "keyword", "memory_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


NEW_EDGES = """ne as (select 'new-'||l_orderkey||'-'||l_linenumber as id, 'S'||l_suppkey as source_id, case when l_orderkey % 6 = 0 then 'S'||l_suppkey when l_orderkey % 6 = 1 then 'P'||(l_partkey + 10000000) else 'P'||l_partkey end as target_id, case when l_orderkey % 5 = 0 then 'hates' else 'part_of' end as relation, l_quantity/40 as confidence, l_discount*20 - 0.2 as weight from (select distinct l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_discount from lineitem where l_orderkey % 10 < 7))"""


@query(f"with {NEW_EDGES} select id, source_id, target_id, round(least(1.0, greatest(0.0, confidence)), 6) as confidence, round(least(1.0, greatest(0.0, weight)), 6) as weight from ne where relation = 'part_of' and source_id <> target_id and target_id in (select 'P'||p_partkey from part)")
def edge_insert(s, d):
    """Edges with an unknown relation, one end twice, or an end that is no node are refused; scores are clamped."""
    li = P.table(s, d, "lineitem").where("l_orderkey % 10 < 7").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount").distinct()
    k, src = F.col("l_orderkey"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    part = lambda c: F.concat(F.lit("P"), c.cast("string"))
    new = li.select(F.concat_ws("-", F.lit("new"), "l_orderkey", "l_linenumber").alias("id"), src.alias("source_id"), F.when(k % 6 == 0, src).when(k % 6 == 1, part(F.col("l_partkey") + 10000000)).otherwise(part(F.col("l_partkey"))).alias("target_id"), F.when(k % 5 == 0, "hates").otherwise("part_of").alias("relation"), (F.col("l_quantity") / 40).alias("confidence"), (F.col("l_discount") * 20 - 0.2).alias("weight"))
    known = P.table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id")).unionAll(P.table(s, d, "part").select(part(F.col("p_partkey")).alias("id")))
    e = P.edges(s, d)
    return D.insert_edges(e.limit(0), new, known).select("id", "source_id", "target_id", r6("confidence", "confidence"), r6("weight", "weight"))


@query(f"with {EDGES} select id, case when weight >= 0.5 then false else active end as active, weight >= 0.5 and active as changed from edges")
def edge_deactivate(s, d):
    e = P.edges(s, d)
    return D.set_active(e, e.where("weight >= 0.5"), False).select("id", "active", "changed")


@query(f"with {EDGES} select id, case when weight < 0.5 then true else active end as active, weight < 0.5 and not active as changed from edges")
def edge_reactivate(s, d):
    e = P.edges(s, d)
    return D.set_active(e, e.where("weight < 0.5"), True).select("id", "active", "changed")


@query(f"with {EDGES} select id from edges where weight >= 0.3")
def edge_delete(s, d):
    e = P.edges(s, d)
    return T.delete(e, e.where("weight < 0.3"), ["id"]).select("id")


@query("select 'S'||l_suppkey||'-P'||l_partkey as id, list_aggregate(list_prepend('m0', list_filter(list_sort(list(distinct 'm'||l_orderkey)), lambda x: x <> 'm0')), 'string_agg', ',') as evidence from lineitem group by 1")
def edge_evidence(s, d):
    """Memories behind an edge, each once: what it has first, then the new ones in order."""
    li = P.table(s, d, "lineitem").select(F.concat_ws("-", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("id"), F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("memory_id"))
    e = P.edges(s, d).withColumn("evidence_memory_ids", F.array(F.lit("m0")))
    return D.add_evidence(e, li.withColumn("seq", F.col("memory_id"))).select("id", F.array_join("evidence_memory_ids", ",").alias("evidence"))


@query("select node_id, alias from (select p_partkey as node_id, lower(p_brand) as alias from part union select p_partkey, lower(p_name) from part union select p_partkey, 'x' from part where p_partkey % 3 = 0)")
def alias_add(s, d):
    part = P.table(s, d, "part")
    new = part.select(F.col("p_partkey").alias("node_id"), F.explode(F.array(F.upper("p_name"), F.concat(F.lit("  "), "p_name"), F.when(F.col("p_partkey") % 3 == 0, " X ").otherwise("  "), F.col("p_brand"))).alias("alias"))
    return D.add_aliases(P.aliases(s, d), new).select("node_id", "alias")


@query("select p_partkey as node_id, lower(p_brand) as alias from part where p_brand <> 'Brand#1'")
def alias_delete(s, d):
    a = P.aliases(s, d)
    return D.delete_aliases(a, a.where("alias = 'brand#1'").withColumn("alias", F.upper("alias"))).select("node_id", "alias")


@query(f"with {NODES}, k as (select distinct id as node_id, unnest({WORDS}) as keyword from nodes) select node_id, keyword from k union select id, 'zebra' from nodes")
def keyword_add(s, d):
    """Stop words and single letters are refused, and what is there stays once."""
    n = P.nodes(s, d)
    new = n.select(F.col("id").alias("node_id"), F.explode(F.array(F.lit(" Zebra"), F.lit("The"), F.lit("q"), F.get(F.split("name", " "), F.lit(0)))).alias("keyword"))
    return D.add_keywords(D.keyword_rows(n), new).select("node_id", "keyword").distinct()


@query(f"with {NODES}, k as (select distinct id as node_id, unnest({WORDS}) as keyword from nodes) select node_id, keyword from k where node_id % 3 <> 0")
def keyword_delete(s, d):
    n = P.nodes(s, d)
    return T.delete(D.keyword_rows(n), n.where("id % 3 = 0").select(F.col("id").alias("node_id")), ["node_id"]).distinct()


@query("""select l_partkey as node_id, l_orderkey as memory_id, kind as memory_type, round(least(1.0, rel), 6) as relevance from (select l_partkey, l_orderkey, rel, kind, row_number() over (partition by l_partkey, l_orderkey order by l_linenumber, rel, kind) rn
 from (select l_partkey, l_orderkey, l_linenumber, l_quantity/30 as rel, case l_linestatus when 'O' then 'semantic' else 'episodic' end as kind from lineitem where l_returnflag <> 'R')) where rn = 1""")
def memory_link_insert(s, d):
    """A node has one link to a memory, the first; a third type is refused, relevance is clamped."""
    kind = F.when(F.col("l_returnflag") == "R", "other").when(F.col("l_linestatus") == "O", "semantic").otherwise("episodic")
    new = P.table(s, d, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("memory_id"), kind.alias("memory_type"), (F.col("l_quantity") / 30).alias("relevance"), "l_linenumber")
    made = D.link_memories(P.links(s, d).limit(0), new.withColumn("raw", F.col("relevance")), [F.col("l_linenumber"), F.col("raw"), F.col("memory_type")])
    return made.select("node_id", "memory_id", "memory_type", r6("relevance", "relevance"))


@query(f"with {LINKS} select node_id, memory_id from links where (node_id + memory_id) % 4 <> 0")
def memory_unlink(s, d):
    k = P.links(s, d)
    return T.delete(k, k.where("(node_id + memory_id) % 4 = 0"), ["node_id", "memory_id"]).select("node_id", "memory_id")


@query(f"select event_type as operation, 'event' as entity_type, event_id::varchar as entity_id, '{{\"k\":'||json_extract_string(props, '$.k')||'}}' as details, 'old' as source from events union all select 'strange', 'node', p_partkey::varchar, '{{}}', 'new' from part")
def log_append(s, d):
    """New entries behind the old ones; an unknown operation is written too."""
    e = P.table(s, d, "events")
    old = e.select(F.col("event_type").alias("operation"), F.lit("event").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"), F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("details"), F.lit("old").alias("source"), F.col("ts").alias("created_at"))
    new = P.table(s, d, "part").select(F.lit("strange").alias("operation"), F.lit("node").alias("entity_type"), F.col("p_partkey").cast("string").alias("entity_id"), F.lit("{}").alias("details"), F.lit("new").alias("source"))
    return D.append_log(old, new, as_of()).select("operation", "entity_type", "entity_id", "details", "source")


def _answer_tables(s, d):
    found, named = _seeds(s, d)
    p = F.concat(F.lit("P"), F.col("id").cast("string"))
    supplier = P.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("Organization").alias("type"), F.lit(0.5).alias("confidence"))
    nodes = named.select(p.alias("id"), "name", "type", "confidence").unionByName(supplier)
    return found.select("query_id", F.concat(F.lit("P"), F.col("node_id").cast("string")).alias("node_id")), nodes, P.edges(s, d)


AROUND = f"""{SEEDS}, {EDGES}, gn as (select 'P'||id as id, name, type, confidence from named union all select 'S'||s_suppkey, s_name, 'Organization', 0.5 from supplier where s_suppkey % 2 = 0), live as (select * from edges where active),
 ends as (select source_id as a, target_id as b, * from (select *, row_number() over (partition by source_id order by weight desc, confidence desc, id) rn from live) where rn <= 5 union all select target_id, source_id, * from (select *, row_number() over (partition by target_id order by weight desc, confidence desc, id) rn from live) where rn <= 5),
 h0 as (select query_id, 'P'||node_id as n, 0 as hop from seeds), h1 as (select distinct h0.query_id, b as n, 1 as hop from h0 join ends on a = n where (h0.query_id, b) not in (select query_id, n from h0)),
 kn as (select * from (select * from h0 union all select * from h1) where n in (select id from gn)), ex as (select * from (select *, row_number() over (partition by query_id order by hop, n) rn from kn) where rn <= 15),
 se as (select distinct ex.query_id, e.id, e.source_id, e.target_id, e.relation, e.weight, e.confidence from ex join ends e on e.a = ex.n)"""


@query(f"with {AROUND} select query_id, 'node' as part, n as id, hop from kn union all select query_id, 'edge', id, -1 from se")
def subgraph_fetch(s, d):
    """Nodes and edges around the seeds of each question; ends that are no node have edges but are none."""
    start, nodes, edges = _answer_tables(s, d)
    found, around = G.subgraph(start, nodes, edges)
    return found.select("query_id", F.lit("node").alias("part"), F.col("node_id").alias("id"), "hop").unionByName(around.select("query_id", F.lit("edge").alias("part"), "id", F.lit(-1).alias("hop")))


@query(f"""with {AROUND}, hd as (select query_id, string_agg(format('  {{}} ({{}}) type={{}} conf={{}}', name, n, type, (cast(confidence as decimal(18,6))::decimal(18,2))::varchar), chr(10) order by n) as t from h0 join gn on gn.id = n group by 1),
 nm as (select kn.query_id, n, name||' ('||n||')' as label from kn join gn on gn.id = n), el as (select se.query_id, string_agg(format('  [{{}}]  {{}} --{{}}--> {{}}  conf={{}}', se.id, coalesce(a.label, source_id), relation, coalesce(b.label, target_id), (cast(confidence as decimal(18,6))::decimal(18,2))::varchar), chr(10) order by -weight, se.id) as t from se left join nm a on a.query_id = se.query_id and a.n = source_id left join nm b on b.query_id = se.query_id and b.n = target_id group by 1)
 select q.query_id, md5(coalesce('Seed nodes (resolved this batch):'||chr(10)||hd.t||coalesce(chr(10)||chr(10)||'Active edges:'||chr(10)||el.t, ''), 'No relevant knowledge graph entries were found for this query.')) as digest from q left join hd using (query_id) left join el using (query_id)""")
def graph_answer(s, d):
    """Questions to prompt text, from tokens to the lines of the neighbourhood."""
    start, nodes, edges = _answer_tables(s, d)
    return G.answer(s.createDataFrame(QUESTIONS, "query_id int, text string"), start, nodes, edges).select("query_id", F.md5("text").alias("digest"))


TALKS = "c as (select distinct conv_id as k from conversations), late as (select k, k % 13 = 12 as bad from c), st as (select min(k) as k from late where bad and k in (select k from c order by k limit 20)), ok as (select k from c where k < coalesce((select k from st), 1000000000) order by k limit 20)"


def _cycle(s, d):
    """Sessions are conversations, the oldest first. Every 13th answer can't be read, which ends the pass before it."""
    k = F.col("session_id")
    queue = P.table(s, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct().select(
        "session_id", F.concat(F.lit("ep"), k.cast("string")).alias("episodic_memory_id"), F.array(F.concat(F.lit("f"), k.cast("string")), F.lit("f0")).alias("semantic_memory_ids"), F.lit("").alias("conversation_text"),
        (as_of() + F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int"))).alias("queued_at"), F.lit(None).cast("timestamp_ntz").alias("processed_at"),
    )
    facts = queue.select(F.concat(F.lit("f"), k.cast("string")).alias("id"), F.concat(F.lit("fact "), k.cast("string")).alias("text"))
    episodes = queue.select(k, F.col("episodic_memory_id").alias("id"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.col("queued_at").alias("start_time"))
    bundles = K.next_batch(queue, episodes, facts)
    topic = F.concat(F.lit("Topic "), (k % 4).cast("string"))
    said = F.to_json(F.struct(F.array(F.struct(topic.alias("name"), F.lit("Concept").alias("type"), F.lit("").alias("heading"), F.array(F.concat(F.lit("T"), (k % 4).cast("string"))).alias("aliases"), F.lit("0.9").alias("confidence")), F.struct(F.lit("Gamma").alias("name"), F.lit("Concept").alias("type"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("aliases"), F.lit("0.7").alias("confidence"))).alias("entities")))
    extracted = queue.select("session_id", F.when(k % 13 == 12, "no answer").otherwise(said).alias("json"))
    op = lambda **c: F.struct(*(v.alias(n) for n, v in c.items()))
    none = F.lit(None).cast("string")
    insert = op(type=F.lit("insert_edge"), source_id=G.node_id_of(topic), target_id=F.lit("g"), relation=F.lit("uses"), confidence=(F.lit(0.6) + k % 3 / 10.0).cast("string"), edge_id=none, node_id=none, alias=none)
    weak = op(type=F.lit("insert_edge"), source_id=G.node_id_of(topic), target_id=F.lit("g"), relation=F.lit("knows"), confidence=F.lit("0.1"), edge_id=none, node_id=none, alias=none)
    alien = op(type=F.lit("insert_edge"), source_id=F.lit("alien"), target_id=F.lit("g"), relation=F.lit("uses"), confidence=F.lit("0.9"), edge_id=none, node_id=none, alias=none)
    named = op(type=F.lit("add_alias"), source_id=none, target_id=none, relation=none, confidence=none, edge_id=none, node_id=F.lit("g"), alias=F.concat(F.lit("Third Letter "), (k % 2).cast("string")))
    gone = op(type=F.lit("deactivate_edge"), source_id=none, target_id=none, relation=none, confidence=none, edge_id=F.lit("e1"), node_id=none, alias=none)
    proposed = queue.select("session_id", F.to_json(F.struct(F.array(insert, weak, alien, named, gone).alias("operations"))).alias("json"))
    graph = {
        "nodes": s.createDataFrame([("g", "Gamma", "Concept", "", 0.5, 0.5, 0, 0), ("h", "Delta", "Concept", "", 0.5, 0.5, 0, 0)], "id string, name string, type string, heading string, importance double, confidence double, access_count int, traversal_count int"),
        "aliases": s.createDataFrame([("g", "gam")], "node_id string, alias string"),
        "edges": s.createDataFrame([("e1", "g", "h", "uses", 0.5, 0.7, True)], "id string, source_id string, target_id string, relation string, confidence double, weight double, active boolean"),
        "links": s.createDataFrame([], "node_id string, memory_id string, memory_type string, relevance double"),
        "log": s.createDataFrame([], "operation string, entity_type string, entity_id string, details string, source string, created_at timestamp_ntz"),
    }
    return K.cycle(queue, bundles, extracted, proposed, graph, as_of("2024-02-01 00:00:00")), bundles


@query("with c as (select distinct conv_id as k from conversations order by k limit 20) select k as session_id, 't'||chr(10)||'s' as episode_text, case when k = 0 then 'fact 0,fact 0' else 'fact '||k||',fact 0' end as texts from c")
def sleep_next_batch(s, d):
    return _cycle(s, d)[1].select("session_id", "episode_text", F.array_join("semantic_texts", ",").alias("texts"))


@query(f"""with {TALKS}, n as (select (select count(*) from ok) as n, (select count(distinct k % 4) from ok) as t)
 select n + (select count(*) from st) as batches_attempted, n as batches_completed, (select count(*) from st) as batches_skipped, n as sessions_processed, t as nodes_created, 2*n - t as nodes_matched, t as edges_inserted, n - t as edges_updated, 1 as edges_deactivated,
  (select count(distinct k % 2) from ok) as aliases_added, 2*n - t as ops_rejected, n - t as ops_converted, (select count(*) from (select distinct n, m from (select k, unnest(['g', 't'||(k % 4)]) as n from ok) join (select k, unnest(['ep'||k, 'f'||k, 'f0']) as m from ok) using (k))) as memories_linked from n""")
def sleep_cycle_report(s, d):
    """The counters of a pass; it stops before the first session whose answer can't be read."""
    return _cycle(s, d)[0]["report"]


@query(f"with {TALKS} select id, name, round(importance, 6) as importance, round(confidence, 6) as confidence from (select 'n_'||md5('Topic '||(k % 4)) as id, 'Topic '||(k % 4) as name, 0.6 as importance, 0.9 as confidence from ok group by k % 4 union all select 'g', 'Gamma', 0.5, 0.7 union all select 'h', 'Delta', 0.5, 0.5)")
def sleep_cycle_nodes(s, d):
    return _cycle(s, d)[0]["nodes"].select("id", "name", r6("importance", "importance"), r6("confidence", "confidence"))


@query(f"with {TALKS} select 'n_'||md5('Topic '||(k % 4))||'|g|uses' as id, round(max_by(0.6 + k % 3 / 10.0, k), 6) as confidence, true as active from ok group by k % 4 union all select 'e1', 0.5, false")
def sleep_cycle_edges(s, d):
    return _cycle(s, d)[0]["edges"].select("id", r6("confidence", "confidence"), "active")


@query(f"with {TALKS} select distinct n as node_id, m as memory_id, case when m[1] = 'e' then 'episodic' else 'semantic' end as memory_type from (select k, unnest(['g', 'n_'||md5('Topic '||(k % 4))]) as n from ok) join (select k, unnest(['ep'||k, 'f'||k, 'f0']) as m from ok) using (k)")
def sleep_cycle_links(s, d):
    return _cycle(s, d)[0]["links"].select("node_id", "memory_id", "memory_type")


@query(f"with {TALKS} select 'insert_node' as operation, 'n_'||md5('Topic '||(k % 4)) as entity_id, count(*) > 0 as whole from ok group by k % 4 union all select 'insert_edge', 'n_'||md5('Topic '||(k % 4))||'|g|uses', true from ok group by k % 4 union all select 'deactivate_edge', 'e1', true from ok")
def sleep_cycle_log(s, d):
    """Audit entries of the pass."""
    return _cycle(s, d)[0]["log"].select("operation", "entity_id", (F.col("source") == "sleep_pipeline").alias("whole"))


@query(f"with {TALKS} select c.k as session_id, c.k in (select k from ok) as processed from c")
def sleep_cycle_queue(s, d):
    return _cycle(s, d)[0]["queue"].select("session_id", F.col("processed_at").isNotNull().alias("processed"))


@query(f"with {TALKS} select g as node_id, a as alias from (select 'g' as g, 'gam' as a union select 'g', 'third letter '||(k % 2) from ok union select 'n_'||md5('Topic '||(k % 4)), 't'||(k % 4) from ok)")
def sleep_cycle_aliases(s, d):
    return _cycle(s, d)[0]["aliases"].select("node_id", "alias")


@query(f"with {TALKS}, n as (select (select count(*) from ok) as n, (select count(distinct k % 4) from ok) as t, (select count(*) from st) as b) select 0 as line, 'Batches:   '||n||'/'||(n+b)||' completed, '||b||' skipped' as text from n union all select 2, 'Nodes:     '||t||' created, '||(2*n-t)||' matched' from n")
def sleep_report_lines(s, d):
    return K.report_lines(_cycle(s, d)[0]["report"]).where("line in (0, 2)").select("line", "text")


@query(f"with {NODES} select id from nodes where type in ('ECONOMY') and confidence >= 0.5 and id in (3, 17, 64)")
def node_filtered_semi(s, d):
    rows = T.where_all(P.nodes(s, d), F.col("type") == "ECONOMY", F.col("confidence") >= 0.5, None)
    return rows.join(F.broadcast(_wanted(s)), "id", "left_semi").select("id")


@query("select count(*) as n from events")
def log_count(s, d):
    return P.table(s, d, "events").agg(F.count("*").alias("n"))


@query(f"with {LINKS} select distinct memory_id from links")
def linked_memories_distinct(s, d):
    return P.links(s, d).select("memory_id").distinct()


@query(f"with {NODES}, w as (select distinct name, {KEYWORDS.format('name')} as k from nodes) select a.name as a, b.name as b, round(len(list_intersect(a.k,b.k))/len(list_distinct(a.k||b.k))::double, 6) as score from w a join w b on a.name <> b.name and a.k[1] = b.k[1]")
def keyword_scores(s, d):
    """Similarity of names that share their first word."""
    w = _named(s, d)[0].where("id < 1000000").select("name").distinct().select("name", E.keywords("name").alias("k"), F.get(E.keywords("name"), F.lit(0)).alias("head"))
    one, two = w.select(F.col("name").alias("a"), F.col("k").alias("ka"), "head"), w.select(F.col("name").alias("b"), F.col("k").alias("kb"), "head")
    return one.join(two, "head").where("a <> b").select("a", "b", r6(E.jaccard("ka", "kb"), "score"))


