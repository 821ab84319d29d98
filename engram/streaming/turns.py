"""Structured Streaming over conversation turns; each stream has a batch operator it must agree with."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.sources.store import fresh_path

def run_once(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """What is there now, through the stream and into a table of the shared folder, with the checkpoint beside it."""
    spark = stream.sparkSession
    path = fresh_path(spark, what)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


CHUNK = "session_id long, chunk long, first_turn long, last_turn long, n_chars long"


def turn_chunks(turns: DataFrame, n: int = 5) -> DataFrame:
    """Full chunks of n turns of streamed turns(session_id, turn, role, text), in the order of turns as they arrive.

    State holds the turns of an unfinished chunk only, n - 1 at most. Turns of one micro-batch are put in order; a turn that
    arrives in a later batch than its successors goes into the chunk open then, as it does in a live session, so batch and
    stream agree when the turns of a session arrive in order."""

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (0, "")
        pending = [tuple(map(int, x.split(":"))) for x in held.split(",") if x]
        rows = sorted((int(t), len(x)) for b in batches for t, x in zip(b["turn"], b["text"]))
        out = []
        for row in rows:
            pending.append(row)
            if len(pending) == n:
                out.append((key[0], done, pending[0][0], pending[-1][0], sum(p[1] for p in pending)))
                done, pending = done + 1, []
        state.update((done, ",".join(f"{a}:{b}" for a, b in pending)))
        yield pd.DataFrame(out, columns=["session_id", "chunk", "first_turn", "last_turn", "n_chars"])

    return turns.groupBy("session_id").applyInPandasWithState(step, CHUNK, "done long, held string", "append", GroupStateTimeout.NoTimeout)


def session_activity(turns: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Closed sessions of streamed turns(session_id, ts): a session ends after the gap; late rows are dropped by the watermark."""
    return turns.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_turns")).select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n_turns")


def micro_batches(turns: DataFrame, store, seconds: int = 30, checkpoint: str | None = None):
    """Hands turns to store(df, batch_id) every so many seconds; batches are replayed with the same number after a failure."""
    writer = turns.writeStream.foreachBatch(store).trigger(processingTime=f"{seconds} seconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
