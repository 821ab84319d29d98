"""The queries of the engine's own operators on the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import exprs as E
from engram.operators import graph as G
from engram.operators import lifecycle as L
from engram.operators import tables as T
from engram.operators import text as X
from engram.operators import vector as V
from engram.plans.base import AS_OF, EDGES, KEYWORDS, LINKS, MEMORY, NODES, ORACLE, PRIOR, QUERIES, as_of, query, r6
from engram.sources import proxies as P
from engram.sources.store import settled

@query("select p_name as name, min(p_partkey) as id, count(*) as n from part where p_name in ('red widget', 'small ring', 'blue gear') group by p_name")
def node_lookup_by_name(s, d):
    wanted = s.createDataFrame([(" red widget",), ("small ring",), ("blue gear",)], "q string").select(F.trim("q").alias("name"))
    return P.nodes(s, d).join(F.broadcast(wanted), "name").groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("select name, id from (select p_name as name, min(p_partkey) as id from part group by p_name)")
def node_insert_unique(s, d):
    """Inserts with a unique name: of rows with one name the smallest id wins."""
    n = P.nodes(s, d)
    return T.insert_new(n.limit(0), n, ["name"], [F.col("id")]).select("name", "id")


@query(f"with {NODES} select type, id, name, round(importance,6) as importance from (select *, row_number() over (partition by type order by importance desc, name, id) as rn from nodes) where rn <= 50")
def nodes_by_type_topk(s, d):
    return T.topk_per_key(P.nodes(s, d), ["type"], [F.desc("importance"), F.col("name"), F.col("id")], 50).select("type", "id", "name", r6("importance", "importance"))


@query(f"with {NODES} select id, name from nodes where name ilike 're%' order by importance desc, name, id limit 10")
def name_prefix_search(s, d):
    return T.topk(P.nodes(s, d).where(F.lower("name").startswith("re")), [F.desc("importance"), F.col("name"), F.col("id")], 10).select("id", "name")


@query(f"with {EDGES} select source_id, id, weight from (select *, row_number() over (partition by source_id order by weight desc, confidence desc, id) rn from edges where active) where rn<=5")
def edges_from_topk(s, d):
    return T.topk_per_key(P.edges(s, d).where("active"), ["source_id"], [F.desc("weight"), F.desc("confidence"), F.col("id")], 5).select("source_id", "id", "weight")


@query(f"with {EDGES} select target_id, id, weight from (select *, row_number() over (partition by target_id order by weight desc, confidence desc, id) rn from edges where active) where rn<=5")
def edges_to_topk(s, d):
    return T.topk_per_key(P.edges(s, d).where("active"), ["target_id"], [F.desc("weight"), F.desc("confidence"), F.col("id")], 5).select("target_id", "id", "weight")


@query(f"with {NODES}, a as (select distinct lower(p_brand) as alias, p_partkey as node_id from part) select alias, node_id from (select a.alias, a.node_id, row_number() over (partition by alias order by importance desc, node_id) rn from a join nodes on id=node_id) where rn=1")
def node_by_alias_best(s, d):
    j = P.aliases(s, d).distinct().join(P.nodes(s, d).select(F.col("id").alias("node_id"), "importance"), "node_id")
    return T.latest_per_key(j, ["alias"], [F.desc("importance"), F.col("node_id")]).select("alias", "node_id")


@query(f"with {NODES}, k as (select distinct id as node_id, unnest({KEYWORDS.format("name||' '||heading")}) as keyword from nodes) select keyword, node_id from (select k.*, row_number() over (partition by keyword order by importance desc, name, node_id) rn from k join nodes on id=node_id) where rn<=20")
def nodes_by_keyword_topk(s, d):
    n = P.nodes(s, d)
    j = G.keyword_index(n).join(n.select(F.col("id").alias("node_id"), "importance", "name"), "node_id")
    return T.topk_per_key(j, ["keyword"], [F.desc("importance"), F.col("name"), F.col("node_id")], 20).select("keyword", "node_id")


@query(f"with {NODES}, {LINKS} select memory_id, node_id, name, relevance from links join nodes on id=node_id")
def nodes_for_memory(s, d):
    return P.links(s, d).join(P.nodes(s, d).select(F.col("id").alias("node_id"), "name"), "node_id").select("memory_id", "node_id", "name", "relevance")


@query("select o_orderkey as memory_id from orders where o_orderkey not in (select l_orderkey from lineitem)")
def unprocessed_memories_anti(s, d):
    return P.table(s, d, "orders").select(F.col("o_orderkey").alias("memory_id")).join(P.links(s, d).select("memory_id"), "memory_id", "left_anti")


@query(f"with {LINKS} select node_id, memory_id, relevance from (select *, row_number() over (partition by node_id order by relevance desc, memory_id) rn from links where memory_type='semantic' and relevance>=0.95) where rn<=50")
def evidence_for_node(s, d):
    rows = T.where_all(P.links(s, d), F.col("memory_type") == "semantic", F.col("relevance") >= 0.95)
    return T.topk_per_key(rows, ["node_id"], [F.desc("relevance"), F.col("memory_id")], 50).select("node_id", "memory_id", "relevance")


@query("select user_id as entity_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id) rn from events) where rn<=50")
def log_history(s, d):
    return T.topk_per_key(P.table(s, d, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 50).select(F.col("user_id").alias("entity_id"), "event_id")


@query("select event_id, cast(json_extract_string(props,'$.k') as bigint) as k from events where event_type='click' and cast(json_extract_string(props,'$.k') as bigint)>50 order by ts desc, event_id limit 100")
def log_recent_filtered(s, d):
    e = P.table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return T.topk(T.where_all(e, F.col("event_type") == "click", F.col("k") > 50), [F.desc("ts"), F.col("event_id")], 100).select("event_id", "k")


@query("select o_orderkey as session_id from orders where o_orderstatus='P' order by o_orderdate, o_orderkey limit 10")
def queue_pending_topk(s, d):
    return T.topk(P.queue(s, d).where("processed_at is null"), [F.col("queued_at"), F.col("session_id")], 10).select("session_id")


@query("select count(*) as total, count(*) filter (o_orderstatus='P') as pending from orders")
def queue_counts(s, d):
    return P.queue(s, d).agg(F.count("*").alias("total"), F.count_if(F.col("processed_at").isNull()).alias("pending"))


@query("select o_orderkey as session_id, (o_orderstatus='P' or o_orderkey % 3 = 0) as pending from orders")
def queue_upsert(s, d):
    """Every third session is queued again, which reopens it."""
    q = P.queue(s, d)
    again = q.where("session_id % 3 = 0").withColumn("processed_at", F.lit(None).cast("timestamp_ntz"))
    return T.upsert(q, again, ["session_id"], [F.col("queued_at")]).select("session_id", F.col("processed_at").isNull().alias("pending"))


@query(f"with {MEMORY} select id, session_id from wm where expires_at is null or expires_at > timestamp '{AS_OF}'")
def live_working_memory(s, d):
    return P.working_memory(s, d).where(E.is_live("expires_at", as_of())).select("id", "session_id")


@query(f"with {MEMORY} select session_id, id from (select *, row_number() over (partition by session_id order by created_at desc, id desc) rn from wm where expires_at is null or expires_at > timestamp '{AS_OF}') where rn=1")
def latest_per_session(s, d):
    live = P.working_memory(s, d).where(E.is_live("expires_at", as_of()))
    return T.latest_per_key(live, ["session_id"], [F.desc("created_at"), F.desc("id")]).select("session_id", "id")


@query(f"with {MEMORY} select id, round(priority,6) as priority from wm where memory_type='view' and expires_at > timestamp '{AS_OF}' order by wm.priority desc, created_at desc, id limit 10")
def reflections_topk(s, d):
    rows = P.working_memory(s, d).where((F.col("memory_type") == "view") & (F.col("expires_at") > as_of()))
    return T.topk(rows, [F.desc("priority"), F.desc("created_at"), F.col("id")], 10).select("id", r6("priority", "priority"))


@query(f"with {MEMORY} select memory_type, count(*) as kept from wm where expires_at is null or expires_at > timestamp '{AS_OF}' group by 1")
def ttl_prune(s, d):
    return P.working_memory(s, d).where(E.is_live("expires_at", as_of())).groupBy("memory_type").agg(F.count("*").alias("kept"))


@query(f"with {MEMORY} select id, date_diff('day', date_trunc('day', created_at), date_trunc('day', case when id % 4 = 0 then created_at + to_days(61) else expires_at end)) as days from wm where id % 4 = 0 or expires_at is not null")
def ttl_refresh(s, d):
    """Every fourth row is touched a day after it was made; a touch sets expiry 60 days on."""
    wm = P.working_memory(s, d)
    touched = wm.where("id % 4 = 0").select("id", (F.col("created_at") + F.make_dt_interval(F.lit(1))).alias("at"))
    return L.refresh_expiry(wm, touched).where("expires_at is not null").select("id", F.datediff("expires_at", "created_at").cast("long").alias("days"))


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) > interval 12 hours then 1 else 0 end as b from events), n as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id as session_id, k::bigint as k, count(*) as n_turns from n group by 1, 2")
def session_activity(s, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.when(F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) >= 43200, F.when(F.col("ts") - F.lag("ts").over(w) > F.expr("interval '12' hour"), 1).otherwise(0)).otherwise(0)
    e = P.table(s, d, "events").withColumn("b", gap)
    return e.withColumn("k", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(F.col("user_id").alias("session_id"), "k").agg(F.count("*").alias("n_turns"))


@query(f"select user_id as session_id, count(*) as turn_count from events group by 1 having max(ts) < timestamp '2024-01-28 00:00:00' - interval 30 minutes")
def stale_sessions(s, d):
    return L.stale_sessions(P.table(s, d, "events").select(F.col("user_id").alias("session_id"), "ts"), as_of("2024-01-28 00:00:00")).select("session_id", "turn_count")


@query("with n as (select conv_id, turn, length(text) as c, row_number() over (partition by conv_id order by turn) rn, count(*) over (partition by conv_id) n from conversations) select conv_id as session_id, (rn-1)//5 as chunk, min(turn) as first_turn, max(turn) as last_turn, sum(c)::bigint as n_chars from n where rn <= n - n % 5 group by 1, 2")
def turn_chunks_of_5(s, d):
    g = T.tumbling(P.turns(s, d), ["session_id"], [F.col("turn")], 5).groupBy("session_id", F.col("batch").alias("chunk"))
    return g.agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("n_chars"))


def stream_chunks_equals_batch(s, d):
    """The streamed chunks; tests hold them against turn_chunks_of_5."""
    from engram.streaming.turns import run_once, turn_chunks

    stream = s.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{d}/conversations.parquet*")
    return run_once(turn_chunks(stream.withColumnRenamed("conv_id", "session_id")), "chunks")


QUERIES["stream_chunks_equals_batch"] = stream_chunks_equals_batch
ORACLE["stream_chunks_equals_batch"] = ORACLE["turn_chunks_of_5"]


@query("select conv_id as session_id, turn, role from (select *, row_number() over (partition by conv_id, role='system' order by turn desc, role desc) rn from conversations) where role='system' or rn<=8")
def history_last_pairs(s, d):
    return X.trimmed_history(P.turns(s, d)).select("session_id", "turn", "role")


@query("select conv_id as session_id, md5(right(string_agg(role||': '||text, chr(10) order by turn, role), 8000)) as digest from conversations where role in ('user','assistant') group by 1")
def conversation_snippet(s, d):
    return X.snippet(P.turns(s, d)).select("session_id", F.md5("text").alias("digest"))


@query("with u as (select conv_id, turn, length(text) l, sum(length(text)) over (partition by conv_id order by turn desc) used, row_number() over (partition by conv_id order by turn desc) rn from conversations) select conv_id as session_id, turn as idx from u where used <= 3000 or rn = 1")
def chunk_narrative_budget(s, d):
    return X.narrative_chunks(P.turns(s, d).select("session_id", F.col("turn").alias("idx"), "text"), 3000).select("session_id", "idx")


@query("""with t as (select conv_id, turn, role, trim(text) as t from conversations where role in ('user','assistant') and trim(text) <> ''),
 f as (select *, upper(role[1])||role[2:]||': '||substr(regexp_extract(t, '(?s)^(.*?[.!?])\\s', 1), 1, 200) as cut, upper(role[1])||role[2:]||': '||substr(t, 1, 200) as whole, regexp_matches(t, '[.!?]\\s') as more from t)
 select conv_id as session_id, md5(substr(string_agg(case when more then cut else whole end, ' ' order by turn, role), 1, 1500)) as digest from f group by 1""")
def extractive_fallback(s, d):
    return X.extractive_fallback(P.turns(s, d)).select("session_id", F.md5("text").alias("digest"))


@query("select doc_id, len(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>'')) < 25 as thin from documents")
def thin_summary_flag(s, d):
    return P.table(s, d, "documents").select("doc_id", E.too_thin("text", F.repeat(F.lit("w "), F.lit(40))).alias("thin"))


@query("select conv_id as session_id, turn from conversations where turn % 3 = 0")
def recall_trigger(s, d):
    said = P.turns(s, d).withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Last time we decided "), "text")).otherwise(F.col("text")))
    return said.where(E.recalls("text")).select("session_id", "turn")


NEGATED = "(" + " or ".join(f"contains(lower(text), '{m.replace(chr(39), chr(39) * 2)}')" for m in E.NEGATIONS) + ")"


@query(f"select doc_id, {NEGATED} <> false as mismatch from documents")
def negation_mismatch(s, d):
    return P.table(s, d, "documents").select("doc_id", E.negation_mismatch("text", F.lit("plain")).alias("mismatch"))


KNN = "select q.vec_id as query_id, e.vec_id as id, round(list_cosine_distance(e.embedding::double[], q.embedding::double[]), 6) as distance from embeddings e, (select * from embeddings where vec_id % 100 = 0) q"


def _asked(s, d):
    return P.table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"select query_id, id, distance from (select *, row_number() over (partition by query_id order by distance, id) rn from ({KNN})) where rn<=5")
def knn_cosine(s, d):
    return V.knn(P.table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), _asked(s, d), 5).select("query_id", "id", "distance")


@query(f"select query_id, id, distance from (select *, row_number() over (partition by query_id order by distance, id) rn from ({KNN} where e.label < 3)) where rn<=5")
def knn_filtered(s, d):
    return V.knn(P.table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), _asked(s, d), 5, where=T.predicate({"label": {"$lt": 3}})).select("query_id", "id", "distance")


@query(f"""with n as (select * from (select *, row_number() over (partition by query_id order by distance, id) rn from ({KNN} where e.vec_id <> q.vec_id)) where rn=1)
select query_id, case when distance <= 0.6 then 'touch' when distance <= 0.8 and query_id % 3 = id % 3 then 'touch' else 'insert' end as action from n""")
def near_duplicate_classify(s, d):
    """Every stored fact is searched but the one that is asked about. Thresholds fit the random test vectors; the defaults are
    tested on small tables."""
    near = V.knn(P.table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), _asked(s, d), 2).where("id <> query_id")
    near = T.topk_per_key(near, ["query_id"], [F.col("distance"), F.col("id")], 1)
    facts = near.select("query_id", "distance", F.lit(0.5).alias("new_importance"), F.lit(0.5).alias("old_importance"), (F.col("query_id") % 3).alias("new_category"), (F.col("id") % 3).alias("old_category"), F.lit("neutral").alias("new_polarity"), F.lit("neutral").alias("old_polarity"), F.lit("a").alias("new_text"), F.lit("a").alias("old_text"))
    return V.classify_facts(facts, 0.6, 0.8).select("query_id", "action")


@query(f"""with {LINKS}, h as (select query_id, id, row_number() over (partition by query_id order by distance, id) rn from ({KNN})) , j as (select h.query_id, node_id, min(rn) as pos from h join links on memory_id = id where rn<=5 group by 1,2) select query_id, node_id, pos from j""")
def semantic_node_hits(s, d):
    near = V.knn(P.table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), _asked(s, d), 5).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    near = settled(near.select("query_id", "id", "pos"), "hits")  # few rows: only their links are looked at
    links = P.links(s, d).withColumnRenamed("memory_id", "id").join(near.select("id"), "id", "left_semi")
    return near.join(links, "id").groupBy("query_id", "node_id").agg(F.min("pos").alias("pos"))


@query(f"with {NODES} select id, round({PRIOR},6) as prior from nodes")
def graph_prior(s, d):
    return P.nodes(s, d).select("id", r6(E.graph_prior(), "prior"))


ASKED = "q as (select * from (values (1,'red widget for the small gear'), (2,'blue bolt brand#3'), (3,'the and of'), (4,'promo ring economy'), (5, 'small')) t(query_id, text))"
QUESTIONS = [(1, "red widget for the small gear"), (2, "blue bolt brand#3"), (3, "the and of"), (4, "promo ring economy"), (5, "small")]
NAMED = f"""{NODES}, named as (select id, name, type, heading, importance, confidence, access_count, traversal_count from nodes union all select 1000000 + row_number() over (order by w), w, 'Concept', '', 0.5, 0.5, 3, 1 from (select distinct split_part(p_name, ' ', 2) as w from part)),
 alias as (select distinct 'brand'||substr(p_brand, 7) as alias, p_partkey as node_id from part union all select 'bolt', id from named where name = 'gear')"""
HITS = f"""{NAMED}, {ASKED}, k as (select distinct id as node_id, unnest({KEYWORDS.format("name||' '||heading")}) as keyword from named),
 t0 as (select query_id, {KEYWORDS.format("text")} as ws from q), t as (select query_id, w as token, list_position(ws, w) - 1 as pos from (select query_id, ws, unnest(list_distinct(ws)) as w from t0)),
 h as (select query_id, pos, token, node_id, importance, name from (select t.query_id, pos, token, node_id, importance, name, row_number() over (partition by query_id, token order by importance desc, name, node_id) rn from t join k on token=keyword join named on id=node_id) where rn<=20),
 pre as (select * from (select t.query_id, pos, token, id as node_id, importance, name, lower(name) = token as exact, row_number() over (partition by query_id, token order by importance desc, name, id) rn from t join named on length(token) >= 3 and starts_with(lower(name), token)) where rn <= 5),
 al as (select * from (select t.query_id, a.node_id, row_number() over (partition by query_id, token order by importance desc, a.node_id) rn from t join alias a on a.alias = token join named on id = a.node_id) where rn = 1),
 t1 as (select query_id, node_id from pre where exact union select query_id, node_id from al),
 p1 as (select query_id, node_id, row_number() over (partition by query_id order by pos, importance desc, name, node_id) as place from (select *, row_number() over (partition by query_id, node_id order by pos, importance desc, name) n from pre where not exact) where n = 1 and (query_id, node_id) not in (select query_id, node_id from t1)),
 p2 as (select query_id, node_id, row_number() over (partition by query_id order by pos, importance desc, name, node_id) as place from h where (query_id, node_id) not in (select query_id, node_id from t1)),
 s as (select query_id, node_id, sum(1.0/(60+place)) as s from (select * from p1 union all select * from p2) group by 1,2),
 f as (select query_id, node_id, case when max(s) over (partition by query_id) > min(s) over (partition by query_id) then (s - min(s) over (partition by query_id))/(max(s) over (partition by query_id)-min(s) over (partition by query_id)) else 1.0 end as rrf from s),
 z as (select query_id, node_id, rrf, 0.75*rrf + 0.25*{PRIOR} as score from f join named on id=node_id)"""


def _named(s, d):
    """Nodes, and one more for each second word of a name, so that a token can be a whole name; aliases of brands, and one of 'gear'."""
    n = P.nodes(s, d)
    words = n.select(F.get(F.split("name", " "), F.lit(1)).alias("name")).distinct()  # a vocabulary of a few words
    words = words.withColumn("id", F.row_number().over(Window.orderBy("name")) + 1000000)
    more = words.select("id", "name", F.lit("Concept").alias("type"), F.lit("").alias("heading"), F.lit(0.5).alias("importance"), F.lit(0.5).alias("confidence"), F.lit(3).alias("access_count"), F.lit(1).alias("traversal_count"))
    named = n.unionByName(more)
    aliases = P.aliases(s, d).select("node_id", F.concat(F.lit("brand"), F.substring("alias", 7, 9)).alias("alias")).distinct()
    return named, aliases.unionByName(more.where("name = 'gear'").select(F.col("id").alias("node_id"), F.lit("bolt").alias("alias")))


def _fused(s, d):
    named, aliases = _named(s, d)
    tier1, hits = G.candidates(s.createDataFrame(QUESTIONS, "query_id int, text string"), named, aliases)
    return tier1, G.fused(hits, named), named


@query(f"with {HITS} select query_id, node_id from t1")
def tier1_hits(s, d):
    """Nodes that a question names: a token is their name or an alias."""
    return _fused(s, d)[0]


@query(f"with {HITS} select query_id, node_id, round(rrf,6) as rrf, round(score,6) as score from z")
def rrf_fusion(s, d):
    return _fused(s, d)[1].select("query_id", "node_id", r6("rrf", "rrf"), r6("score", "score"))


SEEDS = f"""{HITS}, r1 as (select query_id, node_id, 1 as tier, row_number() over (partition by query_id order by {PRIOR} desc, node_id) rn, count(*) over (partition by query_id) as n from t1 join named on id=node_id),
 r2 as (select query_id, node_id, 2 as tier, row_number() over (partition by query_id order by score desc, node_id) rn from z),
 u as (select query_id, node_id, tier, rn from r1 where rn <= case when n >= 5 then 2 else n end union all select * from r2), seeds as (select query_id, node_id, tier from (select *, row_number() over (partition by query_id order by tier, rn) k from u) where k<=5)"""


def _seeds(s, d):
    tier1, ranked, named = _fused(s, d)
    return settled(G.seeds(tier1, ranked, named), "seeds"), named


@query(f"with {SEEDS} select query_id, node_id, tier from seeds")
def seed_selection(s, d):
    return _seeds(s, d)[0].select("query_id", "node_id", "tier")


@query(f"with {SEEDS}, c as (select node_id, count(*) as n from seeds group by 1) select id, traversal_count + coalesce(n, 0) as traversal_count from named left join c on node_id = id")
def seed_traversal_bump(s, d):
    """Nodes that became seeds are counted."""
    found, named = _seeds(s, d)
    return T.add_hits(named, found.select(F.col("node_id").alias("id")), "id", "traversal_count").select("id", "traversal_count")


BFS = f"""{EDGES}, live as (select * from edges where active), o as (select source_id as a, target_id as b, row_number() over (partition by source_id order by weight desc, confidence desc, id) rn from live),
 i as (select target_id as a, source_id as b, row_number() over (partition by target_id order by weight desc, confidence desc, id) rn from live), e as (select a, b from o where rn<=5 union select a, b from i where rn<=5),
 h0 as (select 'S'||s_suppkey as n from supplier where s_suppkey % 10 = 0), h1 as (select distinct h0.n as q, b as n from h0 join e on a=n)"""


def _starts(s, d):
    ids = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    return P.table(s, d, "supplier").where("s_suppkey % 10 = 0").select(ids.alias("query_id"), ids.alias("node_id"))


@query(f"with {BFS} select n as query_id, n as node_id, 0 as hop from h0 union all select q, n, 1 from h1 where n<>q")
def bfs_one_hop(s, d):
    return G.bfs(_starts(s, d), P.edges(s, d), 1).select("query_id", "node_id", "hop")


@query(f"with {BFS}, h2 as (select distinct h1.q, b as n from h1 join e on a=h1.n) select n as query_id, n as node_id, 0 as hop from h0 union all select q, n, 1 from h1 where n<>q union all select q, n, 2 from h2 where n<>q and (q, n) not in (select q, n from h1)")
def bfs_two_hop(s, d):
    return G.bfs(_starts(s, d), P.edges(s, d), 2).select("query_id", "node_id", "hop")


@query(f"with {EDGES} select e.id, e.source_id as source, e.relation, p.p_name||' ('||e.target_id||')' as target from edges e left join part p on 'P'||p.p_partkey = e.target_id where e.weight >= 0.9")
def subgraph_edges_labelled(s, d):
    named = P.nodes(s, d).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("id"), "name")
    return G.labelled_edges(P.edges(s, d).where("weight >= 0.9"), named).select("id", "source", "relation", "target")


ENTITIES = f"""u as (select name, min(lower(p_type)) as heading, min(p_partkey) as id, max(p_size)/50.0 as importance from (select *, p_name as name from part) group by name),
 al as (select lower(name) as alias, id as node_id from u union all select 'the '||lower(name), id from u),
 en as (select id as entity_id, case id % 6 when 0 then name when 1 then upper(name) when 2 then split_part(name,' ',2)||' '||split_part(name,' ',1) when 3 then 'new thing '||(id // 12) when 4 then 'Known As '||id else name end as name,
  case when id % 6 = 3 then '' else heading end as heading, case when id % 6 = 4 then ['x', 'The '||name] else []::varchar[] end as aliases, case when id % 6 = 5 then 0.4 else 0.9 end as confidence from u),
 ek as (select entity_id, list_distinct({KEYWORDS.format("name||' '||heading")}) as k from en), nk as (select id, importance, list_distinct({KEYWORDS.format("name||' '||heading")}) as k from u),
 byw as (select w, id, importance, k from (select unnest(k) as w, id, importance, k, row_number() over (partition by w order by importance desc, id::varchar) rn from (select id, importance, k, unnest(k) as w from nk)) where rn <= 10)"""


@query(f"""with {ENTITIES}, st as (select en.*, (select min(id) from u where u.name = en.name) as x, (select min(node_id) from al where alias = lower(en.name)) as a, (select min(node_id) from al where list_contains(list_transform(en.aliases, lambda y: lower(y)), alias)) as l from en),
 kw as (select entity_id, id, s from (select e.entity_id, b.id, len(list_intersect(e.k, b.k))/len(list_distinct(e.k||b.k))::double as s, row_number() over (partition by e.entity_id order by len(list_intersect(e.k, b.k))/len(list_distinct(e.k||b.k))::double desc, b.importance desc, b.id::varchar) rn from ek e join (select distinct id, importance, k, w from byw) b on list_contains(e.k, b.w) where len(list_intersect(e.k, b.k))/len(list_distinct(e.k||b.k))::double >= 0.85) where rn = 1),
 r as (select st.entity_id, st.name, case when confidence < 0.5 then 'skipped' when x is not null then 'exact_name' when a is not null then 'alias_self' when l is not null then 'alias_list' when kw.id is not null then 'keyword' else 'created' end as method, x, a, l, kw.id as kid, kw.s, confidence from st left join kw using (entity_id)),
 z as (select *, row_number() over (partition by method, name order by entity_id) as rn from r)
 select entity_id, case when method = 'created' and rn > 1 then 'exact_name' else method end as method, case method when 'exact_name' then x::varchar when 'alias_self' then a::varchar when 'alias_list' then l::varchar when 'keyword' then kid::varchar when 'created' then 'n_'||md5(name) end as node_id,
  round(case method when 'skipped' then 0 when 'keyword' then s when 'created' then case when rn > 1 then 1.0 else confidence end else 1.0 end, 6) as match_confidence from z""")
def entity_resolution_cascade(s, d):
    n = P.nodes(s, d).groupBy("name").agg(F.min("heading").alias("heading"), F.min("id").alias("id"), F.max("importance").alias("importance"))
    i, parts = F.col("id"), F.split("name", " ")
    name = F.when(i % 6 == 1, F.upper("name")).when(i % 6 == 2, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).when(i % 6 == 3, F.concat(F.lit("new thing "), F.floor(i / 12).cast("string"))).when(i % 6 == 4, F.concat(F.lit("Known As "), i.cast("string"))).otherwise(F.col("name"))
    listed = F.when(i % 6 == 4, F.array(F.lit("x"), F.concat(F.lit("The "), "name"))).otherwise(F.array().cast("array<string>"))
    ents = n.select(i.alias("entity_id"), name.alias("name"), F.when(i % 6 == 3, "").otherwise(F.col("heading")).alias("heading"), listed.alias("aliases"), F.when(i % 6 == 5, 0.4).otherwise(0.9).alias("confidence"))
    low = F.lower("name")
    aliases = n.select(i.alias("node_id"), F.explode(F.array(low, F.concat(F.lit("the "), low))).alias("alias"))
    return G.resolve_entities(ents, n, aliases).select("entity_id", "method", "node_id", r6("match_confidence", "match_confidence"))


@query(f"""with {NODES}, w as (select distinct name, {KEYWORDS.format('name')} as k from nodes) select a.name as a, b.name as b, round(len(list_intersect(a.k,b.k))/len(list_distinct(a.k||b.k))::double,6) as jaccard from w a join w b on a.name < b.name and len(list_intersect(a.k,b.k)) > 0""")
def jaccard_match(s, d):
    w = P.nodes(s, d).select("name").distinct().select("name", E.keywords("name").alias("k"))
    one, two = w.select(F.col("name").alias("a"), F.col("k").alias("ka"), F.explode("k").alias("w")), w.select(F.col("name").alias("b"), F.col("k").alias("kb"), F.explode("k").alias("w"))
    return one.join(two, "w").where("a < b").select("a", "b", r6(E.jaccard("ka", "kb"), "jaccard")).distinct()


OPS = f"""{EDGES}, ops as (select l_orderkey*100000+l_partkey as op_id, 'insert_edge' as op_type, 'S'||(l_suppkey + case when l_orderkey % 11 = 0 then 100000 else 0 end) as source_id, 'P'||l_partkey as target_id, case when l_orderkey % 7 = 0 then 'likes' else 'uses' end as relation, min(l_quantity)/50 as confidence, null::varchar as edge_id, null::varchar as node_id, null::varchar as alias from lineitem group by 1,3,4,5
  union all select 1000000000000000 + cast(substr(source_id, 2) as bigint)*1000000 + cast(substr(target_id, 2) as bigint), case cast(substr(target_id, 2) as bigint) % 3 when 0 then 'update_edge_confidence' when 1 then 'deactivate_edge' else 'merge_nodes' end, null, null, null, 0.95, case when cast(substr(target_id, 2) as bigint) % 10 = 0 then id||'x' else id end, null, null from edges
  union all select 2000000000000000 + s_suppkey, 'add_alias', null, null, null, null, null, 'S'||(s_suppkey + case when s_suppkey % 4 = 0 then 100000 else 0 end), case when s_suppkey % 3 = 0 then '  ' else ' Alias '||(s_suppkey // 2) end from supplier),
 c0 as (select o.*, case op_type when 'insert_edge' then case when not exists (select 1 from supplier s where 'S'||s.s_suppkey = o.source_id) then 'node missing' when o.relation = 'likes' then 'unknown relation' when o.confidence < 0.6 then 'low confidence' when d.id is not null then 'duplicate' end
   when 'add_alias' then case when not exists (select 1 from supplier s where 'S'||s.s_suppkey = o.node_id) then 'node missing' when trim(o.alias) = '' then 'blank alias' end
   when 'merge_nodes' then 'unknown operation' else case when e.id is null then 'edge missing' when not e.active then 'edge inactive' end end as reason, d.id as dup
  from ops o left join edges d on d.source_id=o.source_id and d.target_id=o.target_id and d.relation=o.relation and d.active left join edges e on e.id = o.edge_id),
 chk as (select * replace (case when reason is null and op_type = 'insert_edge' and rn > 1 then 'duplicate' else reason end as reason, case when reason is null and op_type = 'insert_edge' and rn > 1 then source_id||'|'||target_id||'|'||relation else dup end as dup)
  from (select *, row_number() over (partition by reason is null and op_type = 'insert_edge', source_id, target_id, relation order by op_id) as rn from c0)),
 made as (select source_id||'|'||target_id||'|'||relation as id, source_id, target_id, relation, confidence, 0.7 as weight, true as active from chk where op_type = 'insert_edge' and reason is null),
 chg as (select coalesce(dup, edge_id) as id, max_by(confidence, op_id) as c from chk where (op_type = 'update_edge_confidence' and reason is null) or reason = 'duplicate' group by 1),
 off as (select distinct edge_id as id from chk where op_type = 'deactivate_edge' and reason is null),
 als as (select distinct node_id, lower(trim(alias)) as alias from chk where op_type = 'add_alias' and reason is null)"""


def _operations(s, d, edges):
    none, li = F.lit(None).cast("string"), P.table(s, d, "lineitem")
    far = F.when(F.col("l_orderkey") % 11 == 0, 100000).otherwise(0)
    keys = {"op_id": F.col("l_orderkey") * 100000 + F.col("l_partkey"), "source_id": F.concat(F.lit("S"), (F.col("l_suppkey") + far).cast("string")), "target_id": F.concat(F.lit("P"), F.col("l_partkey").cast("string")), "relation": F.when(F.col("l_orderkey") % 7 == 0, "likes").otherwise("uses")}
    new = li.groupBy(*(c.alias(n) for n, c in keys.items())).agg((F.min("l_quantity") / 50).alias("confidence")).withColumns({"op_type": F.lit("insert_edge"), "edge_id": none, "node_id": none, "alias": none})
    t = F.substring("target_id", 2, 20).cast("long")
    old = edges.select(
        (F.lit(10**15) + F.substring("source_id", 2, 20).cast("long") * 1000000 + t).alias("op_id"), F.when(t % 3 == 0, "update_edge_confidence").when(t % 3 == 1, "deactivate_edge").otherwise("merge_nodes").alias("op_type"),
        F.when(t % 10 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("edge_id"), F.lit(0.95).alias("confidence"),
    )
    k = F.col("s_suppkey")
    said = P.table(s, d, "supplier").select((F.lit(2 * 10**15) + k).alias("op_id"), F.lit("add_alias").alias("op_type"), F.concat(F.lit("S"), (k + F.when(k % 4 == 0, 100000).otherwise(0)).cast("string")).alias("node_id"), F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" Alias "), F.floor(k / 2).cast("string"))).alias("alias"))
    return new.unionByName(old, allowMissingColumns=True).unionByName(said, allowMissingColumns=True)


def _checked(s, d, edges):
    known = P.table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id")).unionAll(P.table(s, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))))
    return G.validate_operations(_operations(s, d, edges), known, edges)


def _applied(s, d):
    aliases = P.aliases(s, d).select(F.concat(F.lit("P"), F.col("node_id").cast("string")).alias("node_id"), "alias")
    edges = settled(P.edges(s, d), "edges")  # summed once
    return G.apply_operations(edges, aliases, settled(_checked(s, d, edges), "checked"))


@query(f"with {OPS} select op_id, op_type, coalesce(reason, 'ok') as reason, case when op_type = 'insert_edge' then dup end as duplicate_edge_id from chk")
def validate_ops(s, d):
    return _checked(s, d, settled(P.edges(s, d), "edges")).select("op_id", "op_type", F.coalesce("reason", F.lit("ok")).alias("reason"), "duplicate_edge_id")


@query(f"with {OPS} select count(*) filter (op_type = 'insert_edge' and reason is null) as inserted, count(*) filter (reason = 'duplicate' or (op_type = 'update_edge_confidence' and reason is null)) as updated, (select count(*) from off) as deactivated, (select count(*) from als) as aliased, count(*) filter (reason is not null) as rejected, count(*) filter (reason = 'duplicate') as converted from chk")
def op_report(s, d):
    return _applied(s, d)[2].select("inserted", "updated", "deactivated", "aliased", "rejected", "converted")


@query(f"with {OPS} select e.id, e.source_id, e.target_id, e.relation, e.weight, round(coalesce(chg.c, e.confidence), 6) as confidence, e.active and off.id is null as active from (select id, source_id, target_id, relation, weight, confidence, active from edges union all select id, source_id, target_id, relation, weight, confidence, active from made) e left join chg using (id) left join off using (id)")
def ops_edges_after(s, d):
    """All edges after the operations: inserted ones, changed confidences, and those switched off."""
    return _applied(s, d)[0].select("id", "source_id", "target_id", "relation", "weight", r6("confidence", "confidence"), "active")


@query(f"with {OPS} select node_id, alias from als union all select 'P'||p_partkey, lower(p_brand) from part")
def ops_aliases_after(s, d):
    return _applied(s, d)[1].select("node_id", "alias")


DAYS = f"floor((epoch_us(timestamp '{AS_OF}') - epoch_us(ts))/86400000000.0)"


@query(f"select event_id as id, case when {DAYS.replace(AS_OF, '2024-06-01 00:00:00')} >= 30 and abs(round(least(1.0,value/500)*power(0.98, floor({DAYS.replace(AS_OF, '2024-06-01 00:00:00')}/30)),4)-least(1.0,value/500)) >= 0.001 then round(least(1.0,value/500)*power(0.98, floor({DAYS.replace(AS_OF, '2024-06-01 00:00:00')}/30)),4) else round(least(1.0,value/500),6) end as importance from events")
def importance_decay(s, d):
    facts = P.working_memory(s, d).select("id", F.col("priority").alias("importance"), "created_at")
    return L.decay(facts, as_of("2024-06-01 00:00:00")).select("id", r6("importance", "importance"))


@query(f"with {NODES}, k as (select *, count(*) over (partition by type) n, row_number() over (partition by type order by round(0.7*importance+0.3*least(access_count,10)/10.0,6) desc, id) rn from nodes where importance >= 0.15) select id from k where n <= 200 or rn <= 160")
def prune_floor_overflow(s, d):
    return L.prune(P.nodes(s, d), ["type"], cap=200, target=160).select("id")


@query("""with a as (select *, o_custkey % 8 as owner, row_number() over (partition by o_custkey % 8 order by o_orderdate, o_orderkey) rn, count(*) over (partition by o_custkey % 8) n from orders where substr(o_orderpriority,1,1)='1' and o_orderdate < timestamp '2000-01-01' - interval 180 days)
 select owner, (rn-1)//20 as batch, sum(o_orderkey % 12)::bigint as turn_count, max(o_orderkey % 100)/100.0 as importance, count(*) as n_merged from a where rn <= n - n % 20 group by 1,2""")
def episode_merge_batches(s, d):
    m = L.merge_episodes(P.episodes(s, d), as_of("2000-01-01 00:00:00"), 0)
    return m.select("owner", "batch", F.col("turn_count").cast("long").alias("turn_count"), "importance", F.size("merged_from").cast("long").alias("n_merged"))


@query("""with r as (select event_id as id, ['session','project','user','User'][1 + event_id % 4] as scope, ['narrow','general'][1 + (event_id // 4) % 2] as spec, (event_id % 10)/10.0 as conf, event_id % 5 <> 0 as act, event_id % 7 <> 0 as nov from events),
 b as (select *, case when scope in ('session','User') then case spec when 'narrow' then 7 else 14 end when scope='project' then case spec when 'narrow' then 45 else 90 end else case spec when 'narrow' then 90 else 180 end end as d0 from r),
 c as (select *, case when act then d0 else least(d0,14) end as d1 from b), e as (select *, case when nov then d1 else least(d1,7) end as d2 from c) select id, case when conf < 0.4 then greatest(3, d2//2) else d2 end as days from e""")
def reflection_expiry(s, d):
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    i = F.col("event_id")
    r = P.table(s, d, "events").select(i.alias("id"), pick(["session", "project", "user", "User"], i % 4).alias("scope"), pick(["narrow", "general"], F.floor(i / 4) % 2).alias("specificity"), (i % 10 / 10.0).alias("confidence"), (i % 5 != 0).alias("actionable"), (i % 7 != 0).alias("novel"), F.lit("x").alias("directive"))
    return L.reflection_expiry(r).select("id", "days")


@query("select user_id as session_id, event_id as id, case when event_id % 4 = 0 then 'delete' when event_id % 4 = 1 then 'promote' else 'keep' end as bucket from events")
def consolidate_decisions(s, d):
    ids = P.table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"))
    made = [ids.where(c).withColumn("bucket", F.lit(b)) for c, b in (("id % 4 = 0", "delete"), ("id % 4 = 1", "promote"), ("id % 4 = 2", "delete"), ("id % 4 = 2", "promote"))]
    unknown = ids.limit(1).select("session_id", (-F.col("id") - 1).alias("id"), F.lit("delete").alias("bucket"))
    decisions = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3]).unionByName(unknown)
    return T.merge_decisions(ids, decisions)


@query("select o_orderkey as id from orders where o_orderdate >= timestamp '2001-08-01' - interval 30 days order by o_orderdate desc, o_orderkey limit 200")
def episodes_recent_within_days(s, d):
    e = P.episodes(s, d).where(F.col("start_time") >= as_of("2001-08-01 00:00:00") - F.make_dt_interval(F.lit(30)))
    return T.topk(e, [F.desc("start_time"), F.col("id")], 200).select("id")


@query("select session_id, id from (select o_custkey as session_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) rn from orders) where rn<=5")
def episodes_by_session(s, d):
    return T.topk_per_key(P.episodes(s, d), ["session_id"], [F.desc("start_time"), F.col("id")], 5).select("session_id", "id")


def _raw(s, d):
    k = F.col("conv_id")
    whole = F.concat(F.lit('{"entities":[{"name":"alpha beta'), k.cast("string"), F.lit('","type":"Concept","aliases":["AB"],"confidence":0.9},{"name":"Gamma","confidence":"x"}],"candidate_relations":[{"source":"gamma","target":"ALPHA BETA'), k.cast("string"), F.lit('","relation":"uses","confidence":1.4}]}'))
    cut_ = F.expr("substring(whole, 1, length(whole) - 2)")
    return P.table(s, d, "conversations").select("conv_id").distinct().withColumn("whole", whole).select(k.alias("session_id"), F.when(k % 4 == 0, F.concat(F.lit("```json\n"), "whole", F.lit("\n```"))).when(k % 4 == 1, cut_).when(k % 4 == 2, F.lit("no json")).otherwise(F.col("whole")).alias("json"))


@query("select distinct conv_id as session_id, case conv_id % 4 when 1 then 'repaired' when 2 then 'retry' else 'ok' end as status from conversations")
def repair_truncated_json(s, d):
    return X.parse_extractions(_raw(s, d)).select("session_id", "status")


@query("with c as (select distinct conv_id as k from conversations where conv_id % 4 <> 2) select k as session_id, 'Alpha Beta'||k as name, 0.9::double as confidence, 1 as n_aliases from c union all select k, 'Gamma', 0.5::double, 0 from c")
def parse_extraction_json(s, d):
    e = X.parsed_entities(X.parse_extractions(_raw(s, d)))
    return e.select("session_id", "name", "confidence", F.size("aliases").alias("n_aliases"))


@query("with c as (select distinct conv_id as k from conversations where conv_id % 4 <> 2) select k as session_id, 'Gamma' as source, 'Alpha Beta'||k as target, 1.0::double as confidence from c")
def parse_relation_json(s, d):
    p = X.parse_extractions(_raw(s, d))
    return X.parsed_relations(p, X.parsed_entities(p)).select("session_id", "source", "target", "confidence")


def _tagged(s, d):
    return P.turns(s, d).select(F.concat_ws("-", "session_id", "turn", "role").alias("id"), "turn", F.concat(F.lit('x <tool_call>{"tool":"find","arguments":{"q":1}}</tool_call> <tool_call>oops</tool_call>'), F.col("turn").cast("string")).alias("text"))


@query("select concat_ws('-', conv_id, turn, role) as id, 'find' as tool, '{\"q\":1}' as arguments from conversations")
def parse_tool_calls(s, d):
    return X.parse_tool_calls(_tagged(s, d)).select("id", "tool", "arguments")


@query("select concat_ws('-', conv_id, turn, role) as id, 'x  '||turn as text from conversations")
def strip_tags(s, d):
    return _tagged(s, d).select("id", E.strip_tool_calls("text").alias("text"))


@query(f"with {EDGES} select id from edges where cast(substr(target_id, 2) as bigint) % 10 <> 0")
def node_delete_cascade(s, d):
    """Edges that are left when every tenth part is deleted."""
    n = P.nodes(s, d).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("id"), (F.col("id") % 10 == 0).alias("gone"))
    return T.delete_cascade(n, n.where("gone"), P.edges(s, d))[1].select("id")


@query(f"with {NODES}, {LINKS} select id, access_count + coalesce(c, 0) as access_count from nodes left join (select node_id, count(*) as c from links group by 1) on node_id = id")
def node_access_hits(s, d):
    """Each link to a memory counts as a read of its node."""
    return T.add_hits(P.nodes(s, d), P.links(s, d).select(F.col("node_id").alias("id")), "id", "access_count").select("id", "access_count")


@query(f"with {EDGES} select id, case when weight >= 0.7 then 0.95::double else confidence end as confidence from edges")
def edge_confidence_patch(s, d):
    e = P.edges(s, d)
    return T.patch(e, e.where("weight >= 0.7").select("id", F.lit(0.95).alias("confidence")), "id").select("id", "confidence")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Questions to text: names, aliases, prefixes and keywords of the questions give seeds, and the strongest edges around them the
    context of each question."""
    found, named = _seeds(s, d)
    node = F.concat(F.lit("P"), F.col("id").cast("string"))
    nodes = named.withColumn("id", node).unionByName(P.table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("Organization").alias("type"), F.lit(0.5).alias("confidence")), allowMissingColumns=True)
    seeds = found.select("query_id", F.concat(F.lit("P"), F.col("node_id").cast("string")).alias("node_id"))
    return G.answer(s.createDataFrame(QUESTIONS, "query_id int, text string"), seeds, nodes, P.edges(s, d)).orderBy("query_id")
