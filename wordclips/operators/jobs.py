"""Job state from its event log, and which jobs to remember."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordclips.operators import ordered as O

ENDED = ("done", "error", "cancelled")
DAY_MS = 86_400_000


def _ms(ts) -> Column:
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def job_state(events: DataFrame) -> DataFrame:
    """Latest status of every job with when it was first and last heard of."""
    at = F.struct("ts", "seq")
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"), F.min("ts").alias("created"),
        F.max("ts").alias("updated"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("events"))


def queue_stats(state: DataFrame) -> DataFrame:
    one = F.count(F.lit(1))
    return state.groupBy("status").agg(one.alias("n"))


def queue_position(state: DataFrame) -> DataFrame:
    """How many waiting jobs are ahead of each waiting job."""
    waiting = state.where(F.col("status") == "queued")
    day = O.bucket(_ms("created"), DAY_MS)
    return O.scan(waiting, [], ["created", "job_id"], day, ahead=O.rank()) \
        .withColumn("ahead", F.col("ahead") - 1)


def batch_done(state: DataFrame, batch: Column) -> DataFrame:
    """Whether every member of a batch has ended."""
    ended = F.col("status").isin(*ENDED)
    return state.groupBy(batch.alias("batch_id")).agg(
        F.count(F.lit(1)).alias("members"), F.bool_and(ended).alias("complete"))


def retain_recent(state: DataFrame, now: Column, ttl_s: int = 1800, keep: int = 50) -> DataFrame:
    """Live jobs, and of the finished ones the newest ``keep`` not past their time."""
    over = F.col("status").isin(*ENDED)
    fresh = _ms(now) - _ms("updated") <= ttl_s * 1000
    recent = state.where(over & fresh).orderBy(F.desc("created"), F.desc("job_id")).limit(keep)
    return state.where(~over).unionByName(recent)
