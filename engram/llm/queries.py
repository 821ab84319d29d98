"""The queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import read_table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.warc import archive_and_index

    return archive_and_index(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.mixing import mix

    mixed = mix(read_table(spark, sf_dir, "documents"))
    shards, places = F.transform("spots", lambda x: x["shard"]), F.transform("spots", lambda x: x["place"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", shards.alias("shards"), places.alias("places"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.embeddings import linked_vectors

    return linked_vectors(read_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.substrings import repeated_strings

    return repeated_strings(read_table(spark, sf_dir, "documents")).drop("spans")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.decontaminate import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.sstable import encode_and_store

    return encode_and_store(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.linededup import dedup_lines

    done = dedup_lines(read_table(spark, sf_dir, "documents"), min_lines=1)
    return done.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.sharding import shard

    return shard(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_mixing, op3_minhash, op4_embeddings, op5_toxicity, op6_suffix_dedup, op7_decontaminate, op8_sstable, op9_line_dedup, op10_sharding)}
#: Four base-32 digits of each 20 bits of a hexadecimal digest.
BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x'||substr(h, 1 + (i // 4) * 5, 5))::int >> (15 - 5 * (i % 4))) & 31)::int, 1)), '')"
#: Components of links l(a, b): the smallest id that each of ids(i) reaches.
REACH = "reach(i, r) as (select i, i from ids union select reach.i, l.b from reach join l on l.a = reach.r), comp as (select i, min(r) as c from reach group by 1)"

ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""with p as (select page_id, coalesce(html, '') as t, upper(sha1(coalesce(html, ''))) as h from pages), f as (select *, min(page_id) over (partition by t) as first from p)
 select page_id, octet_length(encode(t))::bigint as payload_bytes, {BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f""",
    "op3_minhash": f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
 s as (select doc_id, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end)) as sh from w),
 n as (select doc_id, count(*) as n from s group by 1), x as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
 l as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 75 * (na.n + nb.n - shared)), ids as (select doc_id as i from documents), {REACH}
 select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c as component_id, c = d.doc_id as kept from documents d left join n using (doc_id) join comp on i = d.doc_id""",
    "op4_embeddings": f"""with recursive e as (select vec_id, embedding::double[] as v, label from embeddings where label is not null and embedding is not null), l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93), ids as (select vec_id as i from embeddings), {REACH}
 select vec_id, (select count(*) from l where a = vec_id) as n_links, c as component_id, c = vec_id as kept from embeddings join comp on i = vec_id""",
    # a run of one to three lines shows which lines go and where runs adjoin; longer ones change neither
    "op9_line_dedup": """with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents), u as (select doc_id, ls, s, unnest(range(1, len(ls) - s + 2)) as i from d, range(1, 4) t(s)),
 w as (select doc_id, i, s, array_to_string(ls[i:i+s-1], chr(10)) as key, len(list_filter(ls[i:i+s-1], lambda x: regexp_matches(x, '\\S'))) as said from u),
 f as (select *, first_value(doc_id) over k as fd, first_value(i) over k as fi from w window k as (partition by s, key order by doc_id, i)),
 later as (select doc_id, i, i + s as until from f where (fd <> doc_id or i - fi >= s) and (s = 3 or said > 0)),
 starts as (select *, i >= coalesce(max(until) over (partition by doc_id order by i, until rows between unbounded preceding and 1 preceding), -1) as st from later),
 runs as (select doc_id, count(*) filter (st) as n_runs from starts group by 1), gone as (select doc_id, list(distinct j) as js from (select doc_id, unnest(range(i, until)) as j from later) group by 1)
 select d.doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(len(js), 0)::bigint as n_removed, coalesce(n_runs, 0)::bigint as n_runs, sha256(array_to_string(list_filter(ls, lambda x, i: not list_contains(coalesce(js, []), i)), chr(10))) as kept_sha256 from d left join runs using (doc_id) left join gone using (doc_id)""",
}
