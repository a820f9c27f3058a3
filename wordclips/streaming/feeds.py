"""Live feeds: votes, reports, jobs and clips (W*)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordclips.functions.text import vetoed, vote_weight
from wordclips.operators.feedback import BOUNDARY_KINDS
from wordclips.session import shared_folder


def stream_votes(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Current score and weight per (word, clip_id) as votes come in.

    ``events`` is (seq, word, clip_id, op, delta).  The state of a key is its
    score alone.  With ``ttl_ms`` a key nobody votes on for that long is
    forgotten, which bounds the state.  Use update mode.
    """
    def fold(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        score = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        for op, delta in zip(rows["op"], rows["delta"]):
            score = score + int(delta) if op == "add" else int(delta) if op == "set" else 0
        state.update((score,))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"word": [key[0]], "clip_id": [key[1]], "score": [score]})

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    scores = events.groupBy("word", "clip_id").applyInPandasWithState(
        fold, "word string, clip_id bigint, score bigint", "score bigint", "update", timeout)
    return scores.withColumns({"weight": vote_weight("score"), "vetoed": vetoed("score")})


def stream_reports(events: DataFrame) -> DataFrame:
    """Running count per (clip_id, kind) (W2); update or complete mode."""
    return events.where(F.col("kind").isin(*BOUNDARY_KINDS)).groupBy("clip_id", "kind").agg(F.count(F.lit(1)).alias("count"))


def stream_job_state(events: DataFrame) -> DataFrame:
    """Latest status per job as events come in (W3); update or complete mode."""
    at = F.struct("ts", "seq")
    return events.groupBy("job_id").agg(F.max_by("status", at).alias("status"), F.max("ts").alias("updated"))


def stream_clips(clips: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, watermark: str = "1 day"):
    """Start writing new clips once each.

    ``clips`` is (ts, video_id, word, start_ms, ...).  A clip said again
    within the watermark is dropped; ``write`` gets each micro-batch, e.g. to
    merge it where unchanged.  Returns the running query.
    """
    once = clips.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["video_id", "word", "start_ms"])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Drain a stream of per-key results into files and give the last row of every key.

    Each micro-batch is written to the shared folder under its number, so a
    batch that is retried overwrites itself.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write) \
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    cols = [c for c in done.columns if c not in (*keys, "batch")]
    return done.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*keys, "r.*")
