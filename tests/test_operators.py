"""Operators on small tables with results worked out by hand."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import exprs as E
from engram.operators import graph as G
from engram.operators import tables as T
from engram.operators import vector as V
from engram.plans import everything as catalogue
from engram.plans import memory_queries as M
from engram.plans import registry, tools
from engram.sources import store
from engram.streaming import turns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        (lambda: E.keywords(F.lit("The Red-Widget of"), F.lit("x red 42")), ["red", "widget", "42"]),
        (lambda: E.python_title(F.lit("a-b c")), "A-B C"),
        (lambda: E.entity_name(F.lit(" iPhone ")), "iPhone"),
        (lambda: E.clamp(F.lit(1.7)), 1.0),
        (lambda: E.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), 0.5),
        (lambda: E.negated(F.lit("another day")), True),
        (lambda: E.recalls(F.lit("What did we plan?")), True),
        (lambda: E.too_thin(F.lit(""), F.lit("a")), True),
        (lambda: E.strip_reasoning(F.lit("<think>x\ny</think> ok")), "ok"),
        (lambda: E.strip_fences(F.lit("```json\n{}\n```")), "{}"),
        (lambda: E.repaired_json(F.lit('{"a":[{"b":1},{"c')), '{"a":[{"b":1}]}'),
        (lambda: E.subtask_list(F.lit("1. one. 2. two")), ["one", "two"]),
        (lambda: E.subtask_list(F.lit(" just one. ")), ["just one."]),
        (lambda: E.schema_type(F.lit("int, the count")), "integer"),
        (lambda: E.clamp(F.lit(None).cast("double")), None),
        (lambda: E.reflection_days(F.lit("User"), F.lit("general"), F.lit(0.39), F.lit(True), F.lit(True)), 7),
        (lambda: E.reflection_days(F.lit("user"), F.lit("narrow"), F.lit(0.4), F.lit(False), F.lit(False)), 7),
    ],
)
def test_expressions(spark, expr, want):
    assert one(spark, expr()) == want


def test_decay_by_whole_periods(spark):
    at = lambda days: F.lit(dt.datetime(2024, 3, 1) - dt.timedelta(days=days)).cast("timestamp_ntz")
    now = F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz")
    got = [one(spark, E.decayed(F.lit(0.5), E.age_days(at(d), now))) for d in (29, 30, 59, 60)]
    assert got == [0.5, 0.49, 0.49, 0.4802]


def test_table_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "z"), (3, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, T.insert_new(t, new, ["id"], [F.col("v")]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, T.upsert(t, new, ["id"], [F.desc("v")]).collect())) == [(1, "a"), (2, "z"), (3, "d")]
    assert sorted(map(tuple, T.patch(t, new.limit(1), "id").collect())) == [(1, "a"), (2, "z")]
    assert [r.id for r in T.delete(t, new, ["id"]).collect()] == [1]
    assert T.predicate({"$and": [{"id": {"$gte": 2}}, {"v": "b"}]}) is not None and t.where(T.predicate({"$and": [{"id": {"$gte": 2}}, {"v": "b"}]})).count() == 1


def test_fact_classes_at_the_default_distances(spark):
    cols = "distance double, new_importance double, old_importance double, new_category string, old_category string, new_polarity string, old_polarity string, new_text string, old_text string"
    base = ("c", "c", "neutral", "neutral", "likes tea", "likes tea")
    rows = [(0.08, 0.5, 0.5, *base), (0.081, 0.9, 0.5, *base), (0.35, 0.5, 0.5, *base), (0.351, 0.5, 0.5, *base), (0.2, 0.5, 0.5, *base[:4], "never likes tea", "likes tea"), (None, 0.5, 0.5, *base)]
    got = [r.action for r in V.classify_facts(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["touch", "replace", "touch", "insert", "insert", "insert"]


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert store.versions(spark, root) == []
    store.publish(spark.range(2), root)
    store.publish(spark.range(5), root)
    assert store.versions(spark, root) == [0, 1]
    assert (store.read(spark, root).count(), store.read(spark, root, 0).count()) == (5, 2)


def letters(text):
    return [float(text.lower().count(c)) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"]


@pytest.fixture
def memory(spark):
    fact = lambda i, text: (1, f"m{i}", text, letters(text), 0.5, "other", "neutral", 0)
    facts = spark.createDataFrame([fact(1, "the cat likes milk"), fact(2, "a zebra jumps quickly over fences")], "owner long, id string, text string, embedding array<double>, importance double, category string, polarity string, access_count long")
    day = lambda n: dt.datetime(2024, 1, n)
    episodes = spark.createDataFrame([("e1", 7, "Milk", "talk of cats", day(1), ["m1", "gone"], letters("cats and milk")), ("e2", 8, "", "talk of zebras", day(9), [], letters("zebra quick jump"))], "id string, session_id long, title string, summary string, start_time timestamp_ntz, related_semantic_memory_ids array<string>, embedding array<double>")
    nodes = spark.createDataFrame([("n1", "Zebra", "Concept", "animal", 0.5, 0.9, 0, 0), ("n2", "Fence", "Concept", "", 0.5, 0.625, 0, 0)], "id string, name string, type string, heading string, importance double, confidence double, access_count int, traversal_count int")
    aliases = spark.createDataFrame([("n2", "barrier")], "node_id string, alias string")
    edges = spark.createDataFrame([("x", "n1", "n2", "uses", 0.5, 0.7, True)], "id string, source_id string, target_id string, relation string, confidence double, weight double, active boolean")
    log = spark.createDataFrame([], "session_id long, seq long, op string, key string, value string")
    return tools.Memory(spark, facts, episodes, nodes, aliases, edges, log, "2024-01-10 00:00:00", letters)


def test_tools_by_name(memory):
    assert len(tools.TOOLS) == 10 and set(registry.names()) >= {t.__name__ for t in tools.TOOLS}
    assert tools.run_call(memory, "nothing", {})[1] == "Unknown tool: nothing"
    assert tools.run_call(memory, "query_knowledge_graph", {})[1] == "Failed to call query_knowledge_graph."
    m, said = tools.run_call(memory, "query_knowledge_graph", {"query": "which zebra is behind the barrier", "other": 1})
    assert "Zebra (n1) type=Concept conf=0.90" in said and "Fence (n2) type=Concept conf=0.63" in said and "[x]  Zebra (n1) --uses--> Fence (n2)  conf=0.50" in said
    assert tools.run_call(m, "query_knowledge_graph", {"query": "  "})[1].startswith("No relevant")
    m, said = tools.run_call(m, "store_semantic_memory", {"text": "the cat likes milk", "importance": 0.9})
    assert said == "Done." and {r.id: (r.importance, r.access_count) for r in m.facts.collect()} == {"m1": (0.9, 1), "m2": (0.5, 0)}
    m, _ = tools.run_call(m, "store_semantic_memory", {"text": "the cat never likes milk", "importance": 0.9})
    assert m.facts.count() == 3


def test_tools_search_and_scratchpad(memory):
    call = '<tool_call>{"tool": "search_semantic_memory", "arguments": {"query": "cat milk", "k": 1}}</tool_call>'
    m, out = tools.execute(memory, "first " + call, [{"id": "c1", "function": {"name": "search_episodic_memory", "arguments": '{"query": "cats milk", "k": 1}'}}, {"id": "c2", "function": {"name": "browse_episodic_memory", "arguments": "{broken"}}])
    assert out["c1"] == "Episode: Milk\n  When: 2024-01-01\n  Summary: talk of cats\n  Related facts:\n    - the cat likes milk"
    assert out["c2"].startswith("Episode: (untitled)\n  When: 2024-01-09")
    kept = m.state().select("state.outputs").first().outputs
    assert [o.name for o in kept] == ["search_semantic_memory", "search_episodic_memory", "browse_episodic_memory"] and kept[0].output == "1. [other] the cat likes milk (importance: 0.5)"
    m, _ = tools.run_call(m, "update_scratchpad_state", {"section": "planning", "key": "subtasks", "value": "1. a 2. b"})
    assert m.state().select("state.subtasks").first().subtasks == ["a", "b"]
    with pytest.raises(ValueError):
        tools.run_call(m, "update_scratchpad_state", {"section": "planning", "key": "mood", "value": "x"})
    m, _ = tools.run_call(m, "add_scratchpad_memory_update", {"memory_type": "note", "data": "d"})
    assert '"note<insert>:d"' in tools.run_call(m, "get_scratchpad_state", {})[1]


def test_streamed_sessions_and_micro_batches(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(1, at(0, 0)), (1, at(0, 10)), (1, at(2, 0)), (2, at(0, 5)), (3, at(9, 0))]
    schema = "session_id long, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    got = {(r.session_id, r.n_turns) for r in turns.run_once(turns.session_activity(stream), "activity").collect()}
    assert got == {(1, 2), (1, 1), (2, 1)}  # the last session is still open
    seen = []
    turns.micro_batches(stream, lambda df, i: seen.append((i, df.count())), 1, f"{tmp_path}/state").processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert seen == [(0, 5)]


def test_many_queries_go_in_parts(spark, monkeypatch):
    store_ = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "query_id long, q array<double>")
    whole = sorted((r.query_id, r.id, r.distance) for r in V.knn(store_, asked, 2).collect())
    monkeypatch.setattr(V, "BROADCAST_QUERIES", 4)
    assert sorted((r.query_id, r.id, r.distance) for r in V.knn(store_, asked, 2).collect()) == whole and len(whole) == 18


def test_registry_drops_what_a_function_does_not_take():
    registry.register("double", lambda x: 2 * x)
    assert registry.call("double", x=2, y=3) == 4


def test_facts_stored_after_the_chain_of_near_ones_is_cut(spark, tmp_path):
    """Ids in the order of numbers (9 before 10), and a fact near one that is itself left out."""
    turn = lambda a: [math.cos(a), math.sin(a), 0.0]
    rows = [(9, turn(0.0), 1), (10, turn(0.0), 1), (11, turn(0.8), 1), (12, turn(1.6), 1), (13, turn(0.0), 2), (14, [0.0, 0.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, M.facts_store_in_order(spark, str(tmp_path)).select("id", "importance", "access_count").collect()))
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = [(i, float(x), n) for i, x, n in sorted(duck.execute(f"select id, importance, access_count from ({catalogue.ORACLE['facts_store_in_order']})").fetchall())]
    assert got == want and [r[0] for r in got] == [9, 13, 14]


def test_pairs_of_a_group_meet_in_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, v[i].tolist(), i % 2) for i in range(60)] + [(60, [0.0] * 4, 0)], "id long, embedding array<double>, g int")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = [i for i in range(60) if not any(1 - u[i] @ u[j] <= 0.3 for j in range(i % 2, i, 2))] + [60]
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    assert sorted(r.id for r in V.without_earlier(rows, 0.3, "g").collect()) == want


@pytest.fixture
def twice(spark):
    """Two nodes of one id, each a start."""
    start = spark.createDataFrame([(1, "a"), (1, "a")], "query_id int, node_id string")
    nodes = spark.createDataFrame([("a", "ring", "Concept", 0.5), ("a", "hot plate", "PROMO", 0.25), ("b", "bolt", "Concept", 0.5)], "id string, name string, type string, confidence double")
    edges = spark.createDataFrame([("e", "a", "b", "uses", 0.7, 0.9, True)], "id string, source_id string, target_id string, relation string, weight double, confidence double, active boolean")
    return start, nodes, edges


def test_subgraph_lists_each_start_of_one_id(twice):
    found, around = G.subgraph(*twice)
    assert sorted(map(tuple, found.select("node_id", "hop").collect())) == [("a", 0), ("a", 0), ("b", 1)]
    assert [r.id for r in around.collect()] == ["e"]


def test_answer_has_a_line_for_each_start_of_one_id(spark, twice):
    start, nodes, edges = twice
    text = G.answer(spark.createDataFrame([(1, "?")], "query_id int, text string"), start, nodes, edges).collect()[0].text
    assert [text.count(x) for x in ("  ring (a) type", "  hot plate (a) type", "  ring (a) --uses--> bolt (b)", "  hot plate (a) --uses--> bolt (b)")] == [2, 2, 2, 2]


def test_nearest_among_copies_odd_vectors_and_uneven_lengths(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(40, 3)), 1)
    v = np.concatenate([v, v, v[:10] * 2])
    rows = [(f"r{i}", v[i].tolist(), i % 3) for i in range(90)] + [("short", [1.0, 1.0], 0), ("none", None, 0), ("zero", [0.0] * 3, 0), ("hole", [1.0, None, 1.0], 0)]
    store_ = spark.createDataFrame(rows, "id string, embedding array<float>, label int")
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(30)] + [(99, [0.0] * 3), (98, [1.0, 0.0])], "query_id int, q array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(q, i, d) for q in range(30) for d, i in sorted((abs(round(1 - float(u[q] @ u[i]), 6)), f"r{i}") for i in range(90) if i % 3 < 2)[:4]} | {(98, "short", 0.292893)}
    monkeypatch.setattr(V, "QUERIES_AT_ONCE", 7)
    got = V.knn(store_, asked, 4, where=F.col("label") < 2)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert {(r.query_id, r.id, round(r.distance, 5)) for r in got.collect()} == {(q, i, round(d, 5)) for q, i, d in want}
