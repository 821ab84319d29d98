"""Every query of the catalogue against its SQL in DuckDB."""

import re

import duckdb
import pandas as pd
import pytest

from engram.operators import graph as G
from engram.plans import everything as catalogue
from engram.plans import graph_queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda v: "None" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def one_id(tmp_path_factory):
    """Parts with the ids of the word nodes, 1000001 on; each has the word of its id in its name."""
    at, c = tmp_path_factory.mktemp("one_id"), duckdb.connect()
    words = "list_sort(list_distinct((select list(split_part(p_name, ' ', 2)) from part)))"
    made = {"part": f"p_partkey + 999901 as p_partkey, case when p_partkey between 100 and 107 then 'red '||{words}[p_partkey - 99] else p_name end as p_name", "lineitem": "l_partkey + 999901 as l_partkey", "supplier": "s_suppkey as s_suppkey"}
    for t, new in made.items():
        c.execute(f"create table {t} as select * from '{DATA}/{t}.parquet'")
        c.execute(f"copy (select * replace ({new}) from {t}) to '{at}/{t}.parquet' (format parquet)")
        c.execute(f"create or replace table {t} as select * from '{at}/{t}.parquet'")
    return c, str(at)


@pytest.mark.parametrize("name", ["tier1_hits", "rrf_fusion", "seed_selection", "subgraph_fetch"])
def test_matches_sql_where_two_nodes_have_one_id(spark, one_id, name):
    c, at = one_id
    assert rows(catalogue.QUERIES[name](spark, at).toPandas()) == rows(c.execute(catalogue.ORACLE[name]).df())


def test_answer_where_two_nodes_have_one_id(spark, one_id):
    """The lines of the SQL in the order of its ids; in which order lines of one id stand the SQL leaves open."""
    c, at = one_id
    head, _, tail = catalogue.ORACLE["graph_answer"].rpartition("md5(")
    want = dict(c.execute(f"{head}({tail}").fetchall())
    got = {r.query_id: r.text for r in G.answer(spark.createDataFrame(Q.QUESTIONS, "query_id int, text string"), *Q._answer_tables(spark, at)).collect()}
    keys = lambda t: re.findall(r"^  (?:\[(.+?)\]|.*\((\w+)\) type=)", t, re.M)
    assert sorted(got) == sorted(want) and max(len(keys(t)) - len(set(keys(t))) for t in got.values()) > 0
    for q, text in want.items():
        assert keys(got[q]) == keys(text) and sorted(got[q].split("\n")) == sorted(text.split("\n"))
