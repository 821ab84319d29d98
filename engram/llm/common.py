"""What the operators share: the shared folder, tables that cut lineage, word hashing, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the bytes 9 to 13, which is what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
BIG_ID = 2**63 - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="engram-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The table written to the shared folder and read again, and its path for drop()."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    owned(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def owned(spark: SparkSession, *paths: str) -> None:
    """Paths that nobody else names: they go with the driver's JVM at the latest, as results are read from them till then."""
    for path in paths:
        fs, at = _store(spark, path)
        fs.deleteOnExit(at)


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = _store(spark, path)
        fs.delete(at, True)


#: A key with more than this share of the rows is frequent; there are fewer than 1 / SHARE such keys.
SHARE = 0.001


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with keyed(*keys, n, ...), whose n counts the rows of a key among all total.

    Rows of frequent keys meet them by broadcast and are never shuffled by their key; the others are, and no key of theirs
    has more than SHARE of the rows. The driver holds the hashes of the frequent keys, fewer than 1 / SHARE."""
    mark = F.xxhash64(*keys)
    often = [r.m for r in keyed.where(F.col("n") > max(total, 1) * SHARE).select(mark.alias("m")).limit(int(1 / SHARE)).collect()]
    if not often:
        return rows.join(keyed, keys)
    hot = rows.where(mark.isin(often)).join(F.broadcast(keyed.where(mark.isin(often))), keys)
    return hot.unionByName(rows.where(~mark.isin(often)).join(keyed.where(~mark.isin(often)), keys))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, as executors open it: any scheme that pyarrow knows, else a local or mounted path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, computed once per word; emptied when it holds too many."""

    LIMIT = 1 << 17  # some 30 MB

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(tokens: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, none make none."""
    if not tokens:
        return np.empty(0, np.uint64)
    w = hashes.array(tokens)
    span = min(k, len(w))
    out = np.full(len(w) - span + 1, span, np.uint64)
    for i in range(span):
        out = mixed(out * np.uint64(0x100000001B3) + w[i : len(w) - span + 1 + i])
    return np.unique(out)


def connected_components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """Component (the smallest id reachable) of every id in edges(a, b); and the paths to drop when it has been used.

    Each round every vertex points to its smallest neighbour if that is smaller, pointers are doubled until they reach
    roots, and edges are contracted to edges between roots. Only minima by key and equi-joins are used, so a vertex
    with very many edges is pre-aggregated or split; labels and edges stay in tables of the shared folder."""
    spark = edges.sparkSession
    e, e_path = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, labels_path = None, ""
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("o")).unionAll(e.select(F.col("b").alias("v"), F.col("a").alias("o")))
        up, up_path = cut(both.groupBy("v").agg(F.min("o").alias("p")).select("v", F.least("v", "p").alias("p"), F.lit(True).alias("moved")), "up")
        while True:
            above = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jumped, path = cut(up.join(above, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "up")
            drop(spark, up_path)
            up, up_path = jumped, path
            if up.where("moved").isEmpty():
                break
        up = up.select("v", "p")
        if labels is None:
            renamed = up.select(F.col("v").alias("id"), F.col("p").alias("component_id"))
        else:
            renamed = labels.join(up, labels.component_id == up.v, "left").select("id", F.coalesce("p", "component_id").alias("component_id"))
        new_labels, new_path = cut(renamed, "labels")
        ends = up.select(F.col("v").alias("a"), F.col("p").alias("ra")), up.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        left, left_path = cut(e.join(ends[0], "a").join(ends[1], "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop(spark, up_path, e_path, *([labels_path] if labels_path else []))
        labels, labels_path, e, e_path = new_labels, new_path, left, left_path
    drop(spark, e_path)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component_id")).limit(0), []
    return labels, [labels_path]


def forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges (member, root) with the same components as the pairs, at most one per member."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
    return [(x, r) for x in list(up) if (r := root(x)) != x]
