"""Energy frames and the output timeline (N*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordclips.operators import ordered as O

FRAME_MS = 10
PART_MS = 2_000         # frames may carry ``part``, the stretch of this length they lie in
PEAK_FLOOR, HOLD, MIN_BURST_MS, CLICK_MS = 550.0, 0.6, 30, 180
QUIET_SHARE, IDLE_RMS, FPS = 0.25, 400.0, 25


def noise_bursts(frames: DataFrame, gaps: DataFrame, chunk_ms: int = 600_000) -> DataFrame:
    """Noises in the stretches no word covers.

    ``frames`` is (source_id, t_ms, rms), ``gaps`` (source_id, gap_id, start_ms,
    end_ms).  A burst opens at a share of the gap's peak and holds above a
    lower one, so each island above the lower one holds at most one burst.
    """
    g = gaps.select("source_id", "gap_id", F.col("start_ms").alias("g_start"), F.col("end_ms").alias("g_end"), (F.col("end_ms") - 1).alias("g_last"))
    f = O.overlap_join(frames, g, ["source_id"], ("t_ms", "t_ms"), ("g_start", "g_last"), 5_000)
    f = f.withColumn("k", F.floor((F.col("t_ms") - F.col("g_start")) / FRAME_MS))
    # Of one gap, not of a recording; an aggregate joined back would make every frame once more.
    one = Window.partitionBy("source_id", "gap_id")
    f = f.withColumns({"top": F.max("rms").over(one), "n": F.max("k").over(one) + 1}).where(F.col("top") >= PEAK_FLOOR)
    thr = F.greatest(F.lit(PEAK_FLOOR * 0.6), F.col("top") * 0.30)
    f = f.withColumns({"open": F.col("rms") >= thr, "hold": F.col("rms") >= thr * HOLD})
    key, chunk = ["source_id", "gap_id"], O.bucket("t_ms", chunk_ms)
    # An island ends where a frame below the line comes between.
    f = O.scan(f, key, ["t_ms"], chunk, breaks=O.running_sum((~F.col("hold")).cast("int")))
    b = f.where("hold").groupBy(*key, "g_start", "n", "breaks").agg(
        F.min(F.when(F.col("open"), F.col("k"))).alias("i"), (F.max("k") + 1).alias("j"), F.max("rms").alias("peak")).where(F.col("i").isNotNull())
    start = F.col("g_start") + F.greatest(F.lit(0), F.col("i") - 1) * FRAME_MS
    end = F.col("g_start") + F.least(F.col("n"), F.col("j") + 1) * FRAME_MS
    b = b.select(*key, start.alias("start_ms"), end.alias("end_ms"), "peak")
    dur = F.col("end_ms") - F.col("start_ms")
    return b.where((F.col("peak") >= PEAK_FLOOR) & (dur >= MIN_BURST_MS)) \
        .withColumn("kind", F.when(dur < CLICK_MS, "click").otherwise("spew"))


def quiet_threshold(frames: DataFrame) -> DataFrame:
    """(source_id, threshold): a quarter of the way from the quiet to the loud frames."""
    q = O.quantile(frames, ["source_id"], "db", F.floor("db"), low=0.05, high=0.95)
    return q.select("source_id", (F.col("low") + QUIET_SHARE * (F.col("high") - F.col("low"))).alias("threshold"))


def quiet_frames(frames: DataFrame, chunk_ms: int = 600_000) -> DataFrame:
    """Frames (source_id, t_ms, db) with whether they are quiet and start a pause."""
    # Merged, as Spark may take frames for as few as the clips they come from, and broadcast them.
    f = frames.hint("merge").join(quiet_threshold(frames), "source_id").withColumn("quiet", F.col("db") < F.col("threshold"))
    f = O.scan(f, ["source_id"], ["t_ms"], O.bucket("t_ms", chunk_ms), nxt=O.lead("quiet"))
    return f.withColumn("pause", F.col("quiet") & F.coalesce("nxt", F.lit(False))).drop("nxt", "threshold")


def quiet_idle(regions: DataFrame, frames: DataFrame, limit: float = IDLE_RMS) -> DataFrame:
    """Idle regions that really are silent (N3); ``regions`` as from ``idle_regions``."""
    r = regions.withColumn("last", F.col("end_ms") - 1)
    f = O.overlap_join(frames.select("source_id", "t_ms", "rms"), r, ["source_id"], ("t_ms", "t_ms"), ("start_ms", "last"), 5_000)
    level = f.groupBy("source_id", "clip_id", "start_ms", "end_ms").agg(F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("level"))
    return level.where(F.col("level") <= limit)


def timeline(segments: DataFrame, speed: float = 1.0, chunk: int = 10_000) -> DataFrame:
    """When each token is on screen.

    ``segments`` is (text_id, seg, tok, from_ms, to_ms, stretch, pause_ms,
    subword).  Lengths are whole video frames, but for pieces of a word; a
    token spliced from several pieces spans them all.
    """
    span = F.greatest(F.lit(0), F.col("to_ms") - F.col("from_ms")) / 1000.0
    sounding = span * F.coalesce("stretch", F.lit(1.0))
    total = (sounding + F.coalesce("pause_ms", F.lit(0)) / 1000.0) / speed
    s = segments.withColumns({"sounding": sounding / speed, "total": F.when(F.col("subword"), total).otherwise(
        F.bround(total * FPS) / FPS)})
    s = O.scan(s, ["text_id"], ["seg"], O.bucket("seg", chunk), at=O.sum_before("total"))
    g = s.groupBy("text_id", "tok").agg(F.min("at").alias("a"), F.max_by(F.col("at") + F.col("sounding"), "seg").alias("b"))
    return g.select("text_id", "tok", F.round("a", 3).alias("start_s"), F.round("b", 3).alias("end_s"))

