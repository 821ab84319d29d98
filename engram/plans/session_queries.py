"""Queries of sessions, scratchpads, queues and working memory, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import decode
from engram.operators import edits as D
from engram.operators import lifecycle as L
from engram.operators import scratchpad as PAD
from engram.operators import sessions as S
from engram.operators import tables as T
from engram.plans.base import AS_OF, MEMORY, as_of, query, r6
from engram.sources import proxies as P

# A turn of conversation k is spoken k hours and as many minutes as its number after the start of 2024; its summary notes are
# those of assistants, its facts those of users.
AT = "timestamp '2024-01-01 00:00:00' + to_hours(conv_id::int) + to_minutes(turn::int)"
LIVE = f"""live as (select conv_id as k, min({AT}) as started, max({AT}) as last, count(*) as n, list('note '||turn order by turn) filter (role = 'assistant') as notes, list('m'||turn order by turn) filter (role = 'user') as mems,
 right(string_agg(role||': '||text, chr(10) order by turn) filter (role in ('user', 'assistant')), 8000) as said from conversations group by 1)"""


def _beats(s, d):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("session_id").cast("int"), F.col("turn").cast("int"))
    return P.turns(s, d).withColumn("at", at)


def _sessions(s, d):
    """Live sessions built by the operators, one change after the other; of every third conversation nothing but turns is known."""
    beats = _beats(s, d)
    none = S._blank(beats.select("session_id").limit(0), as_of())
    up = S.heartbeat(none, beats.select("session_id", "at"))
    note, fact = beats.where("role = 'assistant' and session_id % 3 <> 0"), beats.where("role = 'user' and session_id % 3 <> 0")
    up = S.append_summaries(up, note.select("session_id", F.col("turn").alias("seq"), F.concat(F.lit("note "), F.col("turn").cast("string")).alias("text")).unionByName(note.select("session_id", F.lit(-1).cast("long").alias("seq"), F.lit("  ").alias("text"))))
    up = S.append_memory_ids(up, fact.select("session_id", F.col("turn").alias("seq"), F.explode(F.array(F.concat(F.lit("m"), F.col("turn").cast("string")), F.concat(F.lit("m"), F.col("turn").cast("string")))).alias("memory_id")))
    return S.save_conversations(up, beats.select("session_id", "turn", "role", "text"))


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


@query(f"with {LIVE} select k as session_id, strftime(started, '%Y-%m-%d %H:%M') as started_at, strftime(last, '%Y-%m-%d %H:%M') as last_turn_at, n as turn_count from live")
def session_heartbeats(s, d):
    """Turns count up, the last one is kept, and sessions that had no row get one."""
    return _sessions(s, d).select("session_id", _time("started_at"), _time("last_turn_at"), "turn_count")


@query(f"with {LIVE} select k as session_id, case when k % 3 = 0 then '' else coalesce(array_to_string(notes, '|'), '') end as notes, case when k % 3 = 0 then '' else coalesce(array_to_string(mems, '|'), '') end as memory_ids from live")
def session_lists(s, d):
    return _sessions(s, d).select("session_id", F.array_join("chunk_summaries", "|").alias("notes"), F.array_join("related_semantic_memory_ids", "|").alias("memory_ids"))


@query("select conv_id as session_id, count(*) as n, md5(string_agg(role||chr(9)||text, chr(10) order by turn)) as digest from conversations group by 1")
def session_conversation(s, d):
    """The snapshot of a conversation as stored."""
    lines = F.transform("full_conversation", lambda m: F.concat(m["role"], F.lit("\t"), m["content"]))
    return _sessions(s, d).select("session_id", F.size("full_conversation").cast("long").alias("n"), F.md5(F.array_join(lines, "\n")).alias("digest"))


@query(f"with {LIVE} select a.k as session_id, coalesce(n, 0) as turn_count, live.k is not null as active, coalesce(strftime(started, '%Y-%m-%d %H:%M'), '') as started_at from (select distinct conv_id * 2 as k from conversations) a left join live using (k)")
def session_state(s, d):
    """Sessions that have no row have no turns and aren't active."""
    asked = P.turns(s, d).select((F.col("session_id") * 2).alias("session_id")).distinct()
    return S.state_of(asked, _sessions(s, d)).select("session_id", "turn_count", "active", F.coalesce(F.date_format("started_at", "yyyy-MM-dd HH:mm"), F.lit("")).alias("started_at"))


@query(f"with {LIVE} select k as session_id, n as turn_count from live union all select k + 1000000, 0 from live where k % 2 = 0")
def session_start(s, d):
    """Starting a session that is there changes nothing."""
    have = _sessions(s, d)
    starts = have.select(F.explode(F.array("session_id", F.when(F.col("session_id") % 2 == 0, F.col("session_id") + 1000000))).alias("session_id")).where("session_id is not null").withColumn("at", as_of())
    return S.start(have, starts).select("session_id", "turn_count")


@query(f"with {LIVE} select k as session_id from live where n < 5")
def session_close(s, d):
    have = _sessions(s, d)
    return S.close(have, have.where("turn_count >= 5")).select("session_id")


def _pads(s, d):
    """Scratchpads at the end: even sessions have a goal, every fourth an error, and assistants' turns are done subtasks."""
    k = F.col("session_id")
    t = P.turns(s, d).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "assistant") & (F.col("session_id") % 5 == 0), F.struct("turn")))), lambda x: F.concat(F.lit("finished "), x["turn"].cast("string"))).alias("subtasks"))
    return t.select("session_id", F.when(k % 2 == 0, F.concat(F.lit("the long goal "), k.cast("string"))).otherwise("").alias("goal"), "subtasks", F.when(k % 7 == 0, F.array(F.lit("note<insert>: kept "))).otherwise(F.array().cast("array<string>")).alias("updates"), F.when(k % 4 == 0, "it broke").alias("error"))


PADS = f"{LIVE}, pads as (select k, case when k % 2 = 0 then 'the long goal '||k else '' end as goal, (select coalesce(list('finished '||turn order by turn), []) from conversations c where c.conv_id = live.k and role = 'assistant' and k % 5 = 0) as tasks, k % 7 = 0 as upd, k % 4 = 0 as err, n, notes, said, mems from live)"


@query(f"""with {PADS} select k as session_id, 'goal' as kind, 'User was working on: '||goal as text, 0.75 as importance from pads where goal <> '' union all select k, 'subtask', 'User completed task: '||unnest(tasks[1:3]), 0.6 from pads
 union all select k, 'update', 'kept', 0.65 from pads where upd union all select k, 'error', 'User encountered an issue last session: it broke', 0.5 from pads where err""")
def session_end_facts(s, d):
    """What an ended session leaves as facts."""
    return S.end(_sessions(s, d), _pads(s, d), as_of("2024-03-01 00:00:00"))["facts"].select("session_id", "kind", "text", "importance")


@query(f"with {PADS} select k as session_id, array_to_string(list_filter([case when goal <> '' then 'Goal: '||goal end, case when len(tasks) > 0 then 'Completed: '||array_to_string(tasks[1:5], '; ') end, case when err then 'Last error: it broke' end], lambda x: x is not null), ' | ') as value from pads where goal <> '' or len(tasks) > 0 or err")
def session_end_notes(s, d):
    return S.end(_sessions(s, d), _pads(s, d), as_of("2024-03-01 00:00:00"))["working_memory"].select("session_id", "value")


NOTES = "(case when k % 3 = 0 then [] else coalesce(notes, []) end)"


@query(f"""with {PADS} select k as session_id, case when goal <> '' then substr(goal, 1, 60) else 'Session summary' end as title, n as turn_count, md5(array_to_string(list_filter([case when len({NOTES}) > 0 then 'Session narrative (in order): | '||array_to_string(list_transform({NOTES}, lambda x, i: '  '||i||'. '||x), ' | ') end, case when goal <> '' then 'Goal: '||goal end,
 case when len(tasks) > 0 then 'Completed: '||array_to_string(tasks[1:5], '; ') end, case when upd then 'Notable updates: note<insert>: kept ' end, case when err then 'Last error: it broke' end, 'Turn count: '||n], lambda x: x is not null), ' | ')) as digest from pads where not (n < 2 and goal = '' and len(tasks) = 0)""")
def session_end_episodes(s, d):
    """Episodes of sessions worth keeping, with the summary that needs no model."""
    return S.end(_sessions(s, d), _pads(s, d), as_of("2024-03-01 00:00:00"))["episodes"].select("session_id", "title", "turn_count", F.md5("summary").alias("digest"))


@query(f"with {PADS} select k as session_id, 'ep_'||k as episodic_memory_id, case when k % 3 = 0 then 0 else coalesce(len(mems), 0) end as n_facts, md5(case when len({NOTES}) > 0 then array_to_string({NOTES}, chr(10)||chr(10)) else coalesce(said, '') end) as digest from pads where not (n < 2 and goal = '' and len(tasks) = 0)")
def session_end_queue(s, d):
    q = S.end(_sessions(s, d), _pads(s, d), as_of("2024-03-01 00:00:00"))["queue"]
    return q.select("session_id", "episodic_memory_id", F.size("semantic_memory_ids").cast("long").alias("n_facts"), F.md5("conversation_text").alias("digest"))


@query(f"""with {LIVE} select k as session_id, 'interrupted' as outcome, 0.4::double as importance, n as turn_count, md5('Session '||k||' ended without a clean shutdown after '||n||' turn(s). '||case when len({NOTES}) > 0 then 'Recovered narrative: '||substr(array_to_string({NOTES}, ' '), 1, 2000) when coalesce(said, '') <> '' then 'Last known state: '||substr(said, 1, 4000) else 'No recoverable state.' end) as digest from live where k <> 1""")
def session_recovery(s, d):
    """Sessions that never ended become interrupted episodes, but for the current one."""
    return S.recover(_sessions(s, d), F.lit(1), as_of())["episodes"].select("session_id", "outcome", "importance", "turn_count", F.md5("summary").alias("digest"))


@query(f"with {PADS} select k as session_id, n >= 2 or goal <> '' or len(tasks) > 0 as kept from pads")
def negligible_sessions(s, d):
    j = _pads(s, d).join(_sessions(s, d), "session_id")
    return j.select("session_id", S.worth_keeping(F.col("turn_count"), F.col("goal"), F.col("subtasks")).alias("kept"))


@query("select o_custkey as owner, md5('RECENT SESSIONS:'||chr(10)||string_agg('  - '||t||': '||sm, chr(10) order by rn)) as digest from (select o_custkey, case when o_orderkey % 3 = 0 then '(untitled)' else 'order '||o_orderkey end as t, o_orderpriority as sm, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn <= 2 group by 1")
def session_digest(s, d):
    """The two latest episodes of an owner as the lines a session starts with."""
    o = P.table(s, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("title"), F.col("o_orderpriority").alias("summary"), F.col("o_orderdate").alias("start_time"))
    return S.digest(o, ["owner"]).select("owner", F.md5("text").alias("digest"))


@query("select c_custkey as owner, coalesce(array_to_string(list_filter([case when c_custkey % 2 = 0 then 'goals' end, case when c_custkey % 3 = 0 then 'done' end, case when c_custkey % 5 = 0 then 'recent' end], lambda x: x is not null), chr(10)), '') as context from customer")
def session_start_context(s, d):
    c = P.table(s, d, "customer").select(F.col("c_custkey").alias("owner"))
    text = lambda n, t: c.where(f"owner % {n} = 0").withColumn("text", F.lit(t))
    return S.start_context(c, text(2, "goals"), text(3, "done"), text(5, "recent"), ["owner"])


@query("select o_orderkey as session_id, o_orderstatus, o_orderpriority from orders where o_orderkey in (3, 17, 64, 100000000)")
def queue_entry_lookup(s, d):
    q = P.table(s, d, "orders").withColumnRenamed("o_orderkey", "session_id")
    wanted = s.createDataFrame([(3,), (17,), (64,), (100000000,)], "session_id long")
    return q.join(F.broadcast(wanted), "session_id", "left_semi").select("session_id", "o_orderstatus", "o_orderpriority")


@query("select o_orderkey as session_id, o_orderstatus = 'P' and o_orderkey % 2 <> 0 as pending from orders")
def queue_mark_processed(s, d):
    q = P.queue(s, d)
    done = q.where("processed_at is null and session_id % 2 = 0").select("session_id", as_of().alias("processed_at"))
    return T.patch(q, done, "session_id").select("session_id", F.col("processed_at").isNull().alias("pending"))


@query("select o_orderkey as session_id from orders where o_orderstatus = 'P' or o_orderdate >= timestamp '2001-08-01 00:00:00' - interval 700 days")
def queue_drop_processed(s, d):
    return S.drop_processed(P.queue(s, d), as_of("2001-08-01 00:00:00"), 700).select("session_id")


@query("select o_orderkey as session_id, o_orderkey % 4 = 0 or o_orderstatus = 'P' as pending, case when o_orderkey % 4 = 0 then 'again' else '' end as conversation_text from orders")
def queue_enqueue_again(s, d):
    q = P.queue(s, d).withColumn("conversation_text", F.lit(""))
    return S.enqueue(q, q.where("session_id % 4 = 0").withColumn("conversation_text", F.lit("again"))).select("session_id", F.col("processed_at").isNull().alias("pending"), "conversation_text")


@query(f"with {MEMORY} select session_id, id, row_number() over (partition by session_id order by created_at desc, id desc) as place from wm where memory_type = 'click' and (expires_at is null or expires_at > timestamp '{AS_OF}')")
def working_memory_by_type(s, d):
    from pyspark.sql.window import Window

    rows = T.where_all(P.working_memory(s, d), F.col("memory_type") == "click", F.col("expires_at").isNull() | (F.col("expires_at") > as_of()))
    return rows.select("session_id", "id", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))).alias("place"))


@query("select event_id as id, date_diff('day', date_trunc('day', ts), date_trunc('day', case when event_id % 3 = 0 then ts + to_days(7) else ts + to_days(60) end)) as days, case when event_id % 2 = 0 then 'a|b' else '' end as tags from events")
def working_memory_insert(s, d):
    """Rows without an expiry live 60 days; tags in one text become a list."""
    e = P.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.make_dt_interval(F.lit(7))).alias("expires_at"), F.when(F.col("event_id") % 2 == 0, " a, b,").otherwise("").alias("tags"))
    made = D.insert_working_memory(e.withColumn("tags", F.array("tags")).limit(0), e)
    return made.select("id", F.datediff("expires_at", "created_at").cast("long").alias("days"), F.array_join("tags", "|").alias("tags"))


@query(f"with {MEMORY} select id, round(case when id % 2 = 0 then 0.9 else priority end, 6) as priority, coalesce(strftime(case when id % 2 = 0 and id % 4 = 0 then timestamp '2025-01-01 00:00:00' when id % 2 = 0 then timestamp '{AS_OF}' + to_days(60) else expires_at end, '%Y-%m-%d'), '') as expires from wm")
def working_memory_update(s, d):
    """A change refreshes the expiry unless it names one; one without fields changes nothing."""
    wm, i = P.working_memory(s, d), F.col("id")
    ch = wm.select("id", F.when(i % 2 == 0, 0.9).alias("priority"), F.when(i % 4 == 0, as_of("2025-01-01 00:00:00")).alias("expires_at"))
    return D.update_working_memory(wm, ch, as_of()).select("id", r6("priority", "priority"), F.coalesce(F.date_format("expires_at", "yyyy-MM-dd"), F.lit("")).alias("expires"))


@query("select event_id as id from events where event_id % 7 <> 0")
def working_memory_delete(s, d):
    wm = P.working_memory(s, d)
    return T.delete(wm, wm.where("id % 7 = 0"), ["id"]).select("id")


# A scratchpad log: views set the goal, clicks add a subtask, purchases complete the latest one added before, errors are kept
# and count a retry, signups leave a tool output under one of two names.
LOG = """e as (select user_id as u, event_id as id, event_type as t, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as c from events),
 done as (select u, c, min(id) as pos from e where t = 'purchase' and c is not null group by 1, 2),
 st as (select e.u, coalesce(max_by('g'||id, id) filter (t = 'view'), '') as goal, coalesce(string_agg('t'||id, ',' order by id) filter (t = 'click' and (e.u, id) not in (select u, c from done)), '') as subtasks, count(*) filter (t = 'error') as retries, max_by('e'||id, id) filter (t = 'error') as err,
  max_by('o'||id, id) filter (t = 'signup' and id % 2 = 0) as o0, min(id) filter (t = 'signup' and id % 2 = 0) as f0, max_by('o'||id, id) filter (t = 'signup' and id % 2 = 1) as o1, min(id) filter (t = 'signup' and id % 2 = 1) as f1 from e group by 1),
 cd as (select u, string_agg('t'||c, ',' order by pos) as completed from done group by 1), z as (select st.*, coalesce(completed, '') as completed from st left join cd using (u))"""


def _state(s, d):
    from pyspark.sql.window import Window

    e = P.table(s, d, "events")
    i, w = F.col("event_id").cast("string"), Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("event_type") == "click", i), ignorenulls=True).over(w)
    ops = {"view": ("set_goal", F.concat(F.lit("g"), i)), "click": ("add_subtask", F.concat(F.lit("t"), i)), "purchase": ("complete_subtask", F.concat(F.lit("t"), F.coalesce(latest, F.lit("?")))), "error": ("set_error", F.concat(F.lit("e"), i)), "signup": ("tool_output", F.concat(F.lit("o"), i))}
    op, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (name, v) in ops.items():
        op, value = F.when(F.col("event_type") == kind, name).otherwise(op), F.when(F.col("event_type") == kind, v).otherwise(value)
    key = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    log = e.select(F.col("user_id").alias("session_id"), (F.col("event_id") * 2).alias("seq"), op.alias("op"), key.alias("key"), value.alias("value"))
    again = e.where("event_type = 'error'").select(F.col("user_id").alias("session_id"), (F.col("event_id") * 2 + 1).alias("seq"), F.lit("retry").alias("op"), F.lit("").alias("key"), F.lit("").alias("value"))
    return PAD.fold(log.unionByName(again))


@query(f"with {LOG} select u as session_id, goal, subtasks, completed, retries, coalesce(err, '') as error, coalesce(o0, '') as output from z")
def scratchpad_state(s, d):
    """State after all operations of a session."""
    st = F.col("state")
    return _state(s, d).select("session_id", st["goal"].alias("goal"), F.array_join(st["subtasks"], ",").alias("subtasks"), F.array_join(st["completed"], ",").alias("completed"), st["retries"].cast("long").alias("retries"), F.coalesce(st["error"], F.lit("")).alias("error"), F.coalesce(PAD.output_of(st, "even"), F.lit("")).alias("output"))


@query(f"""with {LOG}, nl as (select chr(10) as n) select u as session_id, md5('SHORT-TERM MEMORY'||n||n||'NOTES:'||n||n||n||'CONVERSATION SUMMARY:'||n||n||n||'CURRENT GOAL:'||n||goal||n||n||case when subtasks <> '' then 'SUBTASKS:'||n||replace(subtasks, ',', n) else 'SUBTASKS:'||n||'None'||n||n end
 ||case when completed <> '' then n||n||'COMPLETED SUBTASKS:'||n||replace(completed, ',', n) else 'COMPLETED SUBTASKS:'||n||'None'||n||n end||n||n||'CURRENT STEP:'||n||n||n||'NEXT ACTION:'||n||n||n||'ACTIVE TOOL:'||n||n||n
 ||case when o0 is null and o1 is null then 'TOOL OUTPUTS:'||n||'None'||n||n else 'TOOL OUTPUTS:'||n||case when o1 is null or f0 < f1 then '  even: '||o0||n||coalesce('  odd: '||o1||n, '') else '  odd: '||o1||n||coalesce('  even: '||o0||n, '') end||n end
 ||'MEMORY UPDATES:'||n||'None'||n||n||'RETRY COUNT:'||n||retries||n||n||'LAST ERROR:'||n||coalesce(err, 'None')||n||n) as digest from z, nl""")
def scratchpad_text(s, d):
    """The compiled scratchpad, character by character."""
    return _state(s, d).select("session_id", F.md5(PAD.compiled(F.col("state"))).alias("digest"))


@query("""with u as (select event_id, user_id, ['planning', 'execution', 'reflection', 'tool_outputs', 'nowhere'][1 + event_id % 5] as section, ['current_goal', 'retry_count', 'notes'][1 + event_id % 3] as key from events)
 select event_id, section = 'tool_outputs' or (section, key) in (('planning', 'current_goal'), ('execution', 'retry_count'), ('reflection', 'notes')) as valid from u""")
def scratchpad_update_valid(s, d):
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("event_id") % len(values)).cast("int"))
    return P.table(s, d, "events").select("event_id", PAD.valid_update(pick(["planning", "execution", "reflection", "tool_outputs", "nowhere"]), pick(["current_goal", "retry_count", "notes"])).alias("valid"))


@query("select user_id as session_id, 'goal '||max(event_id) as goal, 'Updated planning.current_goal = goal '||max(event_id) as said from events group by 1")
def scratchpad_updates(s, d):
    """Updates by section and key, each with the output it leaves; invalid ones change nothing."""
    e = P.table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.concat(F.lit("goal "), F.col("event_id").cast("string")).alias("value"))
    good = e.withColumns({"section": F.lit("planning"), "key": F.lit("current_goal")})
    st = PAD.fold(PAD.updates_as_log(good.unionByName(e.withColumns({"section": F.lit("nowhere"), "key": F.lit("current_goal")}))))
    return st.select("session_id", F.col("state.goal").alias("goal"), PAD.output_of(F.col("state"), "update_scratchpad_state").alias("said"))


@query("select event_id as id, case when event_id % 3 = 0 then 'none' else 'calls' end as calls from events")
def truncated_calls(s, d):
    """Calls of an answer that was cut off are dropped."""
    e = P.table(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "length").when(F.col("event_id") % 3 == 1, "stop").alias("finish_reason"), F.array(F.lit("call")).alias("tool_calls"))
    return decode.native_calls(e).select("id", F.when(F.col("tool_calls").isNull(), "none").otherwise("calls").alias("calls"))


@query("select conv_id as session_id, turn, row_number() over (partition by conv_id order by turn) as place from conversations")
def history_full(s, d):
    from pyspark.sql.window import Window

    return P.turns(s, d).select("session_id", "turn", F.row_number().over(Window.partitionBy("session_id").orderBy("turn")).alias("place"))


@query("select event_id as id, least(1.0, greatest(0.1, (event_id % 13)/10.0)) as priority from events where event_id % 5 <> 0")
def reflection_priority(s, d):
    i = F.col("event_id")
    r = P.table(s, d, "events").select(i.alias("id"), F.lit("session").alias("scope"), F.lit("narrow").alias("specificity"), (i % 13 / 10.0).alias("confidence"), F.lit(True).alias("actionable"), F.lit(True).alias("novel"), F.when(i % 5 == 0, "  ").otherwise("do").alias("directive"))
    return L.reflection_expiry(r).select("id", "priority")
