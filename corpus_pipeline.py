"""A corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token shards; each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import cut, drop, read_table
from engram.llm.decontaminate import leaks
from engram.llm.minhash import near_duplicates
from engram.llm.mixing import mix, shuffled
from engram.llm.queries import vocabulary_path
from engram.llm.sstable import encode_and_store
from engram.llm.toxicity import scored, train

THRESHOLD = 0.3

# Every stage but the last returns the columns of its input, whatever their names, as it carries rows in one struct. Null
# and empty texts pass the filtering stages, repeated rows are rows of their own where nothing else is said, texts are
# read whole, and an empty table stays one.


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts get the model's bias."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return scored(docs, model, docs.columns).where(F.col("score") < THRESHOLD).select("row.*")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Rows that repeat its id and text
    stay one, rows of its id with another text stay; rows without an id stay all."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    known = rows.join(kept, "doc_id")
    again = known.where("n > 1").withColumn("h", F.xxhash64("row.text")).withColumn("h2", F.xxhash64(F.lit(7), "row.text")).dropDuplicates(["doc_id", "h", "h2"])
    return known.where("n = 1").select("row").unionAll(again.select("row")).unionAll(rows.where("doc_id is null").select("row")).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked. Rows without an id are not looked at and stay."""
    hit = leaks(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes of a document, shard by shard in shuffled order: up to two, none of those beyond
    their source's target. Rows without words are taken once."""
    return shuffled(mix(docs, keep=True)).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all rows, read back: null texts are empty, copies and null ids have entries of their own."""
    return encode_and_store(docs.select("doc_id", "text"), vocabulary_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", minhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_shards", token_stage),
]

#: Stages are learned, drawn or tokenized; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = cut(stage(spark, docs, sf_dir), name)
        paths.append(path)
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop(spark, *paths)  # the last stage has read its input when it returns
    return out
