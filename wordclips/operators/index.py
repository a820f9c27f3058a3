"""The clip index: clips in spoken order with their neighbours (C*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordclips.operators import ordered as O

HOUR_MS = 3_600_000
MIN_USABLE_MS = 50
BLEED_GAP_MS = 120
IDLE_GAP_MS = 450
IDLE_CLEAR_MS = 60
GAP_CLEAR_MS = 20
GAP_MIN_MS = 140


def hour(ms="start_ms", width: int = HOUR_MS) -> Column:
    """Chunk of a recording: an hour of speech is some ten thousand words."""
    return O.bucket(ms, width)


def first_phone_is_vowel(lexicon: DataFrame, vowels: DataFrame) -> DataFrame:
    """(word, vowel_onset) for every word the lexicon can pronounce."""
    heads = lexicon.where(F.size("phones") > 0).select("word", F.col("phones")[0].alias("phone"))
    return heads.join(F.broadcast(vowels.select("phone", F.lit(True).alias("v"))), "phone", "left") \
        .select("word", F.coalesce("v", F.lit(False)).alias("vowel_onset"))


def build_index(clips: DataFrame, chunk_ms: int = HOUR_MS) -> DataFrame:
    """Positive-length clips numbered per source with both neighbours."""
    kept = clips.where(F.col("end_ms") > F.col("start_ms"))
    out = O.scan(kept, ["source_id"], ["start_ms", "clip_id"], hour(width=chunk_ms),
                 idx=O.rank(), prev_end=O.lag("end_ms"), next_start=O.lead("start_ms"),
                 next_word=O.lead("word"))
    return out.withColumn("idx", F.col("idx") - 1) \
        .withColumn("gap_after", F.col("next_start") - F.col("end_ms"))


def apart(col: str) -> Column:
    """One of 4096 short strings by the hash of ``col``: the join key of a row that asks for nothing."""
    return F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(col), F.lit(4096)).cast("string"))


def with_bleed_risk(index: DataFrame, onsets: DataFrame) -> DataFrame:
    """Flag clips whose next word starts on a vowel right up against them.

    ``onsets`` is unique per word.  Only clips with a close neighbour need it;
    the rest are dealt out by ``apart``, as a null key would send all to one task.
    Each word is asked for once a source, and those with an onset go back there,
    so that clips that lie where their recording does are not shuffled.
    """
    near = F.when(F.col("gap_after") < BLEED_GAP_MS, F.col("next_word"))
    vowels = onsets.where("vowel_onset").select(F.col("word").alias("__k")).distinct()
    found = index.select("source_id", near.alias("__k")).where(F.col("__k").isNotNull()).distinct() \
        .join(vowels, "__k", "left_semi").withColumn("bleed_risk", F.lit(True))
    joined = index.withColumn("__k", F.coalesce(near, apart("clip_id"))).join(found.hint("merge"), ["source_id", "__k"], "left")
    return joined.select(*[F.col(c) for c in index.columns], F.coalesce("bleed_risk", F.lit(False)).alias("bleed_risk"))


def source_quality(clips: DataFrame) -> DataFrame:
    """Share of a source's clips, degenerate ones included, of usable length."""
    good = (F.col("end_ms") - F.col("start_ms") >= MIN_USABLE_MS).cast("bigint")
    return clips.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_clips"), F.sum(good).alias("n_good"),
        (F.sum(good) / F.count(F.lit(1))).alias("quality"))


def idle_regions(index: DataFrame, min_ms: int = 0) -> DataFrame:
    """On-screen silences long enough to cut from (C4)."""
    return index.where(F.col("gap_after") >= IDLE_GAP_MS).select(
        "source_id", "clip_id", (F.col("end_ms") + IDLE_CLEAR_MS).alias("start_ms"),
        (F.col("next_start") - IDLE_CLEAR_MS).alias("end_ms"),
    ).where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def positions(index: DataFrame) -> DataFrame:
    return index.select("word", "source_id", "idx")


def usable_takes(index: DataFrame) -> DataFrame:
    return index.where(F.col("end_ms") - F.col("start_ms") >= MIN_USABLE_MS)


def vocabulary(index: DataFrame) -> DataFrame:
    return usable_takes(index).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def transcript_gaps(clips: DataFrame, sources: DataFrame, chunk_ms: int = HOUR_MS) -> DataFrame:
    """Stretches no word covers, before, between and after the words.

    ``sources`` carries (source_id, duration_ms).
    """
    seq = O.scan(clips.select("source_id", "clip_id", "start_ms", "end_ms"), ["source_id"],
                 ["start_ms", "clip_id"], hour(width=chunk_ms), next_start=O.lead("start_ms"))
    between = seq.where(F.col("next_start").isNotNull()).select(
        "source_id", (F.col("end_ms") + GAP_CLEAR_MS).alias("start_ms"),
        (F.col("next_start") - GAP_CLEAR_MS).alias("end_ms"))
    ends = clips.groupBy("source_id").agg(
        F.min("start_ms").alias("first"),
        F.max_by("end_ms", F.struct("start_ms", "clip_id")).alias("last"))
    head = ends.select("source_id", F.lit(0).cast("bigint").alias("start_ms"),
                       (F.col("first") - GAP_CLEAR_MS).alias("end_ms"))
    tail = ends.join(sources, "source_id").select(
        "source_id", (F.col("last") + GAP_CLEAR_MS).alias("start_ms"),
        F.col("duration_ms").alias("end_ms"))
    return between.unionByName(head).unionByName(tail) \
        .where(F.col("end_ms") - F.col("start_ms") >= GAP_MIN_MS)
