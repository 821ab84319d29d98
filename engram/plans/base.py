"""The registry of queries, and what their SQL shares: memory tables as projections of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import exprs as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

STOP = ", ".join(f"'{w}'" for w in E.STOPWORDS)
KEYWORDS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda w: length(w) > 1 and w not in ({STOP}))"
NODES = "nodes as (select p_partkey as id, p_name as name, p_type as type, lower(p_type) as heading, p_size/50.0 as importance, (p_retailprice-900)/100.0 as confidence, p_size as access_count, p_partkey % 50 as traversal_count from part)"
EDGES = """edges as (select 'S'||l_suppkey||'-P'||l_partkey as id, 'S'||l_suppkey as source_id, 'P'||l_partkey as target_id, round(avg(l_discount)*10,6) as weight, round(avg(l_quantity)/50,6) as confidence,
 max(l_linestatus)='O' as active, case max(l_returnflag) when 'A' then 'uses' when 'N' then 'related_to' else 'mentions' end as relation from lineitem group by l_suppkey, l_partkey)"""
LINKS = "links as (select l_partkey as node_id, l_orderkey as memory_id, case when max(case when l_returnflag='R' then 1 else 0 end)=1 then 'semantic' else 'episodic' end as memory_type, round(1-max(l_discount),6) as relevance from lineitem group by 1,2)"
MEMORY = """wm as (select event_id as id, user_id as session_id, event_type as memory_type, least(1.0, value/500) as priority, ts as created_at,
 case when event_type<>'signup' then ts + to_days(case event_type when 'error' then 5 when 'click' then 10 else 20 end) end as expires_at from events)"""
PRIOR = "(0.4*importance + 0.3*confidence + 0.3*least(1.0, ln(1+access_count+traversal_count)/ln(51)))"
AS_OF = "2024-01-20 00:00:00"


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def r6(c, name: str):
    return F.round(c, 6).alias(name)
