"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs with one word between them, hashed into
2**BITS places. Training is online: per-coordinate rates from summed squared gradients, and an L1 term that keeps a
coordinate at exactly zero until its evidence exceeds it, so few weights are non-zero and the model is broadcast as
two short arrays (never more than 2**BITS entries).

The model is fitted on at most MOST_ROWS labelled rows, those with the smallest hash of their id, in one task whose
memory is bounded by that number; scoring reads every whole text."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import WordHashes, mixed

BITS = 20
MOST_ROWS = 12_000
EPOCHS = 4
SLICE = 256  # texts held as Python strings at a time
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0

#: A-Z in lower case, ASCII that is no letter or digit as space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Distinct places of the text's words, pairs and skip-pairs."""
    if not text or not (tokens := text.encode("utf-8", "surrogatepass").translate(FOLD).split()):
        return np.empty(0, np.int64)
    w = hashes.array(tokens)
    parts = [w]
    for gap, tag in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(w) > gap:
            parts.append(mixed(w[:-gap] * np.uint64(0x100000001B3) + w[gap:] + np.uint64(tag)))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Follow the regularised leader, proximal; bias in the last place, without L1."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at]


def fit(rows: list[tuple[str | None, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero places and weights from (text, label) rows, in their order."""
    hashes, model = WordHashes(), Ftrl()
    data = [(features(t, hashes), int(y)) for t, y in rows]
    for _ in range(EPOCHS):
        for at, y in data:
            model.learn(at, y)
    return model.sparse()


def scores(texts: list[str | None], dense: np.ndarray, hashes: WordHashes) -> np.ndarray:
    total = np.array([dense[features(t, hashes)].sum() for t in texts]) + dense[-1]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The model from docs(doc_id, text) and labels(doc_id, toxic), of rows whose crc32(doc_id as text) mod 4 is not 2.

    Rows without label or id are not learned from; repeated labels of an id count once, as toxic if any is, and of an id
    with several texts the least by hash is read. Without labelled rows the model is empty and every score is 0.5."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    known_texts = chosen.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    rows = known_texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    rows = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.col("first.text").alias("text"), "toxic").limit(most_rows)

    def learn(batches):
        got = [(h, i, t, y) for b in batches for h, i, t, y in zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "text", "toxic")))]
        if got:
            at, w = fit([(t, y) for _, _, t, y in sorted(got, key=lambda r: r[:2])])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w, pa.float64())], names=["at", "w"])

    got = rows.coalesce(1).mapInArrow(learn, "at int, w double").collect()
    return np.array([r.at for r in got], np.int32), np.array([r.w for r in got], np.float64)


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@functools.lru_cache(1)
def _dense(packed: bytes) -> np.ndarray:
    n = len(packed) // 12
    out = np.zeros((1 << BITS) + 1)
    out[np.frombuffer(packed, np.int32, n)] = np.frombuffer(packed, np.float64, n, 4 * n)
    return out


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], columns: list[str]) -> DataFrame:
    """row, a struct of the columns, and score of every row of docs(text): texts are read whole; null and empty ones get the
    bias alone. Columns may have any names; an empty table gives no rows."""
    at, w = model
    sent = docs.sparkSession.sparkContext.broadcast(at.tobytes() + w.tobytes())  # 12 MB at most
    inner = [F.col(f"`{c}`") for c in columns]
    rows = docs.select(F.struct(*inner).alias("row"), *([] if "text" in columns else [F.col("text").alias("text")]))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches):
        hashes, dense = WordHashes(), _dense(sent.value)
        for b in batches:
            row = b.column("row")
            texts = row.field("text") if "text" in columns else b.column("text")
            got = [scores(texts.slice(i, SLICE).to_pylist(), dense, hashes) for i in range(0, len(texts), SLICE)]
            yield pa.RecordBatch.from_arrays([row, pa.array(np.concatenate(got) if got else [], pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text).

    Null ids are scored and not held out; repeated rows are scored each; other columns are ignored, whatever their names;
    an empty table gives no rows."""
    got = scored(docs, train(docs, labels), ["doc_id"]).select("row.doc_id", "score")
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
