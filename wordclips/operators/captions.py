"""Captions checked against the clips spoken at the same time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordclips.operators import ordered as O
from wordclips.operators.index import hour
from wordclips.session import stored

TOL_MS = 600
CONFLICT_MS = 250


def _as_of(clips: DataFrame, asks: DataFrame, keys: list[str], value, chunk_ms: int, name: str) -> DataFrame:
    """(source_id, cap_id, name): ``value`` of the last clip at or before each ask's ``at_ms``."""
    left = clips.select(*keys, F.col("start_ms").alias("at_ms"), F.lit(0).alias("side"),
                        F.col("clip_id").alias("n"), value.alias("__v"))
    right = asks.select(*keys, "at_ms", F.lit(1).alias("side"), F.col("cap_id").alias("n"),
                        F.lit(None).cast(left.schema["__v"].dataType).alias("__v"))
    # Dealt out once, by source: neither the chunks of its words nor their sums are sent again.
    both = left.unionByName(right).repartition("source_id")
    seq = O.scan(both, keys, ["at_ms", "side", "n"], O.bucket("at_ms", chunk_ms),
                 **{name: O.latest("__v", F.col("side") == 0)})
    return seq.where(F.col("side") == 1).select("source_id", F.col("n").alias("cap_id"), name)


def _reached(clips: DataFrame, asks: DataFrame, chunk_ms: int, name: str) -> DataFrame:
    """(source_id, cap_id, name): the last end of the clips that start at or before each ask's ``at_ms``."""
    left = clips.select("source_id", F.col("start_ms").alias("at_ms"), F.lit(0).alias("side"), F.col("clip_id").alias("n"), "end_ms")
    right = asks.select("source_id", "at_ms", F.lit(1).alias("side"), F.col("cap_id").alias("n"),
                        F.lit(None).cast(left.schema["end_ms"].dataType).alias("end_ms"))
    seq = O.scan(left.unionByName(right), ["source_id"], ["at_ms", "side", "n"], O.bucket("at_ms", chunk_ms), **{name: O.running_max("end_ms")})
    return seq.where(F.col("side") == 1).select("source_id", F.col("n").alias("cap_id"), name)


def verify_captions(captions: DataFrame, clips: DataFrame, chunk_ms: int = 3_600_000) -> DataFrame:
    """Status of every caption word.

    A clip stands at a caption when it starts by t + 0.6 s and some clip up to
    it, in spoken order, ends at or after t - 0.6 s.  That running end never
    falls, so the last clip (of the source, or of the source and word) decides,
    and three as-of lookups replace a range join: nothing is paired up.  Those
    that ask by source alone stay with clips and captions that lie where their
    recording does, and all are joined by source; only what is asked by word
    goes through the stored reach.

    ``captions`` is (source_id, cap_id, word, t_ms).  Clips are taken not to
    end more than 0.35 s before they start, as every ingested clip.
    """
    seq = O.scan(clips.select("source_id", "clip_id", "word", "start_ms", "end_ms"), ["source_id"],
                 ["start_ms", "clip_id"], hour(width=chunk_ms),
                 reach=O.running_max("end_ms"))
    seq = stored(seq.drop("end_ms"), "seq")     # read twice by the scan by word
    late = captions.withColumn("at_ms", F.col("t_ms") + TOL_MS)
    any_reach = _reached(clips, late, chunk_ms, "any_reach")
    same_reach = _as_of(seq, late, ["source_id", "word"], F.col("reach"), chunk_ms, "same_reach")
    nearest = _nearest(clips, captions, chunk_ms)
    on = ["source_id", "cap_id"]
    t = captions.join(any_reach, on).join(nearest, on).join(same_reach, on)
    edge = F.col("t_ms") - TOL_MS
    status = F.when(F.col("any_reach").isNull() | (F.col("any_reach") < edge), "missed") \
        .when(F.col("same_reach") >= edge, "agreed") \
        .when(F.col("near_diff") <= CONFLICT_MS, "disagree").otherwise("drifted")
    return t.withColumn("status", status).select(
        "source_id", "cap_id", "word", "t_ms", "status",
        F.when(F.col("status") == "disagree", F.col("near_word")).alias("clip_word"))


def _nearest(clips: DataFrame, captions: DataFrame, chunk_ms: int) -> DataFrame:
    """(source_id, cap_id, near_diff, near_word); of clips that start together the first stands for all."""
    left = clips.select("source_id", F.col("start_ms").alias("at_ms"), F.lit(0).alias("side"),
                        F.col("clip_id").alias("n"), "word")
    right = captions.select("source_id", F.col("t_ms").alias("at_ms"), F.lit(1).alias("side"),
                            F.col("cap_id").alias("n"), "word")
    first = F.struct("at_ms", (-F.col("n")).alias("n"), "word")
    at = F.struct("at_ms", "word")
    seq = O.scan(left.unionByName(right), ["source_id"], ["at_ms", "side", "n"],
                 O.bucket("at_ms", chunk_ms), prev=O.running_max(F.when(F.col("side") == 0, first)),
                 next=O.lead(at, where=F.col("side") == 0)).where(F.col("side") == 1)
    back = F.col("at_ms") - F.col("prev.at_ms")
    ahead = F.col("next.at_ms") - F.col("at_ms")
    use_next = back.isNull() | (ahead < back)
    return seq.select("source_id", F.col("n").alias("cap_id"), F.least(back, ahead).alias("near_diff"),
                      F.when(use_next, F.col("next.word")).otherwise(F.col("prev.word")).alias("near_word"))


def caption_agreement(checked: DataFrame, clips: DataFrame) -> DataFrame:
    """Counts and agreed share per source and, with a null source, overall."""
    def count(s: str):
        return F.sum((F.col("status") == s).cast("bigint")).alias(s)

    n_clips = clips.groupBy("source_id").agg(F.count(F.lit(1)).alias("clips"))
    per = checked.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("captions"), *[count(s) for s in ("agreed", "missed", "disagree", "drifted")]) \
        .join(n_clips, "source_id", "left").withColumn("clips", F.coalesce("clips", F.lit(0)))
    names = ["captions", "agreed", "missed", "disagree", "drifted", "clips"]
    every = per.groupBy().agg(*[F.sum(n).alias(n) for n in names]) \
        .select(F.lit(None).cast("bigint").alias("source_id"), *names)
    return per.unionByName(every).withColumn(
        "agreed_pct", F.floor(F.col("agreed") * 100 / F.greatest(F.lit(1), "captions")).cast("bigint"))


def top_disagreements(checked: DataFrame, show: int = 20) -> DataFrame:
    """The disagreements seen more than once, most frequent first."""
    pairs = checked.where(F.col("status") == "disagree").groupBy(
        F.col("clip_word").alias("stored"), F.col("word").alias("caption")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.where(F.col("n") > 1).orderBy(F.desc("n"), "stored", "caption").limit(show)

