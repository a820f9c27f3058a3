"""Corpus health: summaries, flags and audits (J1-J6, J11-J13, A1-A4, A19, A20, U*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.functions import text as TX
from wordclips.operators import ordered as O
from wordclips.operators.frames import PART_MS
from wordclips.operators.index import hour
from wordclips.session import stored

SHORT_MS, LONG_MS = 60, 1500
PHONE_SLACK_MS = 60
EDGE_SLACK_MS = 20
EDGE_NEAR_MS = 300


def dur() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def source_summary(sources: DataFrame, clips: DataFrame) -> DataFrame:
    """Clips, first start and last end of every source, empty ones too.

    The clips are summed up before the join, so it is one row per source.
    """
    per = clips.groupBy("source_id").agg(F.count(F.lit(1)).alias("clips"),
                                         F.min("start_ms").alias("first_ms"),
                                         F.max("end_ms").alias("last_ms"))
    return sources.select("source_id", "video_id").join(per, "source_id", "left") \
        .withColumn("clips", F.coalesce("clips", F.lit(0)))


def reports_text(reports: DataFrame) -> DataFrame:
    item = F.concat_ws(":", "kind", F.col("count").cast("string"))
    return reports.groupBy(*O.by_clip(reports)).agg(
        F.array_join(F.sort_array(F.collect_list(item)), ", ").alias("reports"))


def reported_clips(clips: DataFrame, reports: DataFrame) -> DataFrame:
    """Clips with reports, listed as kind:count."""
    return clips.join(reports_text(reports), O.by_clip(reports)).select(
        "clip_id", "source_id", "word", "start_ms", "end_ms", "reports")


def downvoted(ratings: DataFrame, clips: DataFrame) -> DataFrame:
    """Negative ratings with the clip they are about, if it still exists."""
    neg = ratings.where(F.col("score") < 0).withColumnRenamed("word", "target_word")
    on = O.by_clip(ratings)
    c = clips.select("clip_id", "source_id", F.col("word").alias("clip_word"), F.col("source_id").alias("__at"))
    found = neg.join(c, on, "left").withColumn("source_id", F.col("__at"))
    return found.select("clip_id", *[x for x in neg.columns if x not in on], "source_id", "clip_word")


def known_sources(sources: DataFrame, clips: DataFrame) -> DataFrame:
    """Sources with usable clips, and whether any of them awaits alignment."""
    usable = clips.where((F.col("start_ms") >= 0) & (dur() > 0))
    per = usable.groupBy("source_id").agg(F.max(F.col("phones").isNull()).alias("needs_alignment"))
    return sources.select("source_id", "video_id").join(per, "source_id")


def pending_tone(clips: DataFrame, tone: DataFrame) -> DataFrame:
    return clips.join(tone.select("clip_id"), "clip_id", "left_anti")


def orphans(tone: DataFrame, clips: DataFrame) -> DataFrame:
    return tone.join(clips.select("clip_id"), "clip_id", "left_anti")


def plan_ingest(listing: DataFrame, known: DataFrame, limit: int, skip: int = 0) -> DataFrame:
    """The next videos to ingest.

    ``listing`` is (pos, video_id).  Repeats keep their first place, ``limit``
    is what is left of the target once the known ones are counted.
    """
    first = listing.where(F.col("video_id").isNotNull()).groupBy("video_id").agg(F.min("pos").alias("pos"))
    return first.join(known.select("video_id"), "video_id", "left_anti").orderBy("pos").offset(skip).limit(limit)


def locate(ids: DataFrame, clips: DataFrame, noises: DataFrame) -> DataFrame:
    """Where a clip id lives, words before noises."""
    cols = ["clip_id", "source_id", "word", "start_ms", "end_ms"]
    both = clips.select(*cols, F.lit("word").alias("kind"), F.lit(0).alias("p")).unionByName(
        noises.select(*cols, F.lit("noise").alias("kind"), F.lit(1).alias("p")))
    hit = both.join(ids.select("clip_id").distinct(), "clip_id", "left_semi")
    best = F.min_by(F.struct("source_id", "word", "start_ms", "end_ms", "kind"), "p")
    return hit.groupBy("clip_id").agg(best.alias("r")).select("clip_id", "r.*")


def all_clips(clips: DataFrame, noises: DataFrame) -> DataFrame:
    """Words and noises together."""
    cols = ["source_id", "clip_id", "word", "start_ms", "end_ms"]
    return clips.select(*cols, F.lit("word").alias("kind")).unionByName(
        noises.select(*cols, F.lit("noise").alias("kind")))


def next_word_start(both: DataFrame, chunk_ms: int) -> DataFrame:
    """(source_id, start_ms, next_start): the first word strictly later than a start."""
    starts = both.groupBy("source_id", "start_ms").agg(F.max(F.col("kind") == "word").alias("w"))
    return O.scan(starts, ["source_id"], ["start_ms"], hour(width=chunk_ms),
                  next_start=O.lead("start_ms", where=F.col("w"))).drop("w")


def clip_flags(clips: DataFrame, noises: DataFrame, ratings: DataFrame, reports: DataFrame,
               known_words: DataFrame, chunk_ms: int = 3_600_000) -> DataFrame:
    """What looks suspect about each clip in the editor.

    ``clips`` carries ``phones``; ``known_words`` lists pronounceable words.
    """
    cols = ["source_id", "clip_id", "word", "start_ms", "end_ms"]
    # The phone arrays are read here and no further.
    words = clips.select(*cols, F.lit("word").alias("kind"), F.col("phones").isNotNull().alias("aligned"),
                         phones_outside().alias("outside"))
    noise = noises.select(*cols, F.lit("noise").alias("kind"), F.lit(True).alias("aligned"),
                          F.lit(False).alias("outside"))
    both = words.unionByName(noise)
    nxt = next_word_start(both.select("source_id", "start_ms", "kind"), chunk_ms)
    some = words.groupBy("source_id").agg(F.max("aligned").alias("any_aligned"))
    bad = ratings.where(F.col("score") < 0).select(*O.by_clip(ratings)).distinct().withColumn("neg", F.lit(True))
    said = reports.groupBy(*O.by_clip(reports)).agg(F.sort_array(F.collect_list(F.concat(
        F.lit("reported: "), "kind", F.when(F.col("count") > 1, F.concat(
            F.lit(" x"), F.col("count").cast("string"))).otherwise("")))).alias("said"))
    # Only words without phones are looked up, each once a source, and the known ones go back there.
    known = words.where(~F.col("aligned")).select("source_id", "word").distinct() \
        .join(known_words.select("word"), "word", "left_semi").withColumn("known", F.lit(True))
    t = both.join(nxt, ["source_id", "start_ms"], "left").join(some, "source_id", "left") \
        .join(bad, O.by_clip(ratings), "left").join(said, O.by_clip(reports), "left").join(known, ["source_id", "word"], "left")
    is_word = F.col("kind") == "word"
    gap = F.col("next_start") - F.col("end_ms")
    unaligned = is_word & F.coalesce("any_aligned", F.lit(False)) & ~F.col("aligned")
    flags = F.array(
        F.when(dur() < SHORT_MS, F.lit("very short")), F.when(gap < 0, F.lit("overlaps next")),
        F.when(dur() > LONG_MS, F.lit("very long")), F.when(is_word & F.col("neg"), F.lit("downvoted")),
        F.when(unaligned & F.col("known"), F.lit("not aligned")),
        F.when(unaligned & F.col("known").isNull(), F.lit("no pronunciation")),
        F.when(~unaligned & F.col("outside"), F.lit("alignment moved off")))
    told = F.when(is_word & F.col("said").isNotNull(), F.col("said")).otherwise(F.array())
    return t.select("source_id", "clip_id", "kind", gap.alias("gap_after"),
                    F.array_join(F.concat(F.array_compact(flags), told), "; ").alias("flags"))


def phones_outside(phones: str = "phones", length: Column | None = None) -> Column:
    """Do stored phone times lie outside their clip by more than the slack?"""
    span = dur() if length is None else length
    p = F.col(phones)
    first = F.array_min(F.transform(p, lambda x: x["start_ms"]))
    last = F.array_max(F.transform(p, lambda x: x["end_ms"]))
    return F.coalesce((first < -PHONE_SLACK_MS) | (last > span + PHONE_SLACK_MS), F.lit(False))


def corpus_stats(clips: DataFrame, sources: DataFrame, tone: DataFrame) -> DataFrame:
    """Totals and coverage of the whole corpus in one row (A1)."""
    c = clips.groupBy().agg(
        F.count(F.lit(1)).alias("total_clips"), F.countDistinct("word").alias("words"),
        F.sum(F.col("phones").isNotNull().cast("bigint")).alias("aligned_clips"))
    s = sources.groupBy().agg(F.count(F.lit(1)).alias("sources"))
    z = tone.join(clips.select("clip_id"), "clip_id", "left_semi").groupBy().agg(F.count(F.lit(1)).alias("toned_clips"))
    return c.crossJoin(s).crossJoin(z).withColumn("coverage_pct", F.round(
        F.col("aligned_clips") / F.greatest(F.lit(1), F.col("total_clips")) * 100, 1))


def issue_rows(clips: DataFrame, ratings: DataFrame, reports: DataFrame, known_words: DataFrame,
               files: DataFrame, sources: DataFrame, chunk_ms: int = 3_600_000) -> DataFrame:
    """Every diagnostic finding as (section, clip_id, source_id, word, margin_ms, reason) (A2)."""
    def row(df, section, reason, clip=F.col("clip_id"), src=F.col("source_id"),
            word=F.col("word"), margin=None):
        return df.select(F.lit(section).alias("section"), clip.cast("bigint").alias("clip_id"),
                         src.cast("bigint").alias("source_id"), word.alias("word"),
                         (F.lit(None) if margin is None else margin).cast("bigint").alias("margin_ms"),
                         reason.alias("reason"))

    none = F.lit(None)
    seq = O.scan(clips.select("source_id", "clip_id", "word", "start_ms", "end_ms"), ["source_id"],
                 ["start_ms", "clip_id"], hour(width=chunk_ms), next_start=O.lead("start_ms"))
    told = reports_text(reports)
    checked = clips.join(told, O.by_clip(reports), "left")
    # Both findings about one clip's own row come from one pass over it.
    found = F.array_compact(F.array(
        F.when(dur() <= 0, F.struct(F.lit("negative_margins").alias("s"), dur().alias("m"),
                                  F.lit("non-positive duration").alias("r"))),
        F.when(F.col("next_start") < F.col("end_ms"), F.struct(
            F.lit("negative_margins").alias("s"), (F.col("next_start") - F.col("end_ms")).alias("m"),
            F.lit("overlaps next clip").alias("r")))))
    margins = seq.select("*", F.explode(found).alias("f")).select(
        F.col("f.s").alias("section"), "clip_id", "source_id", "word",
        F.col("f.m").cast("bigint").alias("margin_ms"), F.col("f.r").alias("reason"))
    low = row(checked.where(F.col("reports").isNotNull() | ((dur() > 0) & (dur() < SHORT_MS))),
              "low_confidence", F.coalesce(F.concat(F.lit("boundary reports: "), "reports"),
                                           F.lit("very short duration")))
    mute = row(clips.select("word").distinct().join(known_words.select("word"), "word", "left_anti"),
               "no_pronunciation", F.lit("no pronunciation"), none, none)
    down = row(downvoted(ratings, clips), "downvoted", F.concat(F.lit("for "), "target_word"),
               word=F.col("clip_word"), margin=F.col("score"))
    lost = row(unindexed(files, sources), "unindexed", F.col("source_file"), none, none, none.cast("string"))
    return margins.unionByName(low).unionByName(mute).unionByName(down).unionByName(lost)


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def alignment_status(clips: DataFrame, known_words: DataFrame, show: int = 20) -> DataFrame:
    """Per source: clips to align, stale ones, and words nobody can place (A3).

    Each word is looked up once a source, and the known ones go back there.
    """
    words = known_words.select("word", F.lit(True).alias("known"))
    placed = clips.where(F.col("source_id").isNotNull())
    looked = placed.select("source_id", "word").distinct().join(words, "word").hint("merge")
    lost = clips.where(F.col("source_id").isNull())
    return _status_of(placed.join(looked, ["source_id", "word"], "left"), show).unionByName(
        _status_of(lost.join(words, "word", "left"), show))


def _status_of(t: DataFrame, show: int) -> DataFrame:
    known = F.col("known").isNotNull()
    bare = F.col("phones").isNull()
    stale = ~bare & phones_outside()
    per = t.groupBy("source_id").agg(
        F.sum((known & (bare | stale)).cast("bigint")).alias("pending"),
        F.sum((known & stale).cast("bigint")).alias("stale"),
        F.sum((~known & (bare | stale)).cast("bigint")).alias("no_pronunciation"))
    words = t.where(~known & bare).select("source_id", "word").distinct()
    w = Window.partitionBy("source_id").orderBy("word")
    named = words.withColumn("r", F.row_number().over(w)).where(F.col("r") <= show) \
        .groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_list("word")), ",").alias("unknown_words"))
    return per.join(named, "source_id", "left").withColumn(
        "unknown_words", F.coalesce("unknown_words", F.lit("")))


def unspliceable(clips: DataFrame, known_words: DataFrame) -> DataFrame:
    """Words nothing can pronounce, by how many clips they strand (A4)."""
    counts = clips.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = clips.groupBy().agg(F.count(F.lit(1)).alias("total"))
    return counts.join(known_words.select("word"), "word", "left_anti").crossJoin(F.broadcast(total)) \
        .select("word", "n", F.round(F.col("n") * 100 / F.col("total"), 6).alias("share_pct"))


def edge_audit(index: DataFrame, chunk_ms: int = 3_600_000) -> DataFrame:
    """How often cuts fall inside the letters of a take or its neighbours.

    ``index`` carries clip-relative ``phones`` and ``bleed_risk``.  One row per
    whether the take is followed closely.
    """
    on = F.col("start_ms") + F.col("phones")[0]["start_ms"]
    off = F.col("start_ms") + F.element_at("phones", -1)["end_ms"]
    t = index.select("source_id", "clip_id", "start_ms", "end_ms", "prev_end", "next_start", "edited", "bleed_risk",
                     F.col("phones").isNotNull().alias("aligned"), on.alias("on"), off.alias("off"))
    # The scan reads its rows twice, and these come out of several joins.
    t = O.scan(stored(t, "edges"), ["source_id"], ["start_ms", "clip_id"], hour(width=chunk_ms),
               next_on=O.lead("on"), prev_off=O.lag("off"))
    cut = TX.extract_window(F.lit(False))
    t = t.where("aligned").withColumn("cut", cut)
    near_next = F.col("next_start") - F.col("end_ms") < EDGE_NEAR_MS
    near_prev = F.col("start_ms") - F.col("prev_end") < EDGE_NEAR_MS

    def share(cond: Column, name: str) -> Column:
        return F.round(F.avg(F.coalesce(cond, F.lit(False)).cast("int")), 6).alias(name)

    adjacent = F.coalesce(F.col("next_start") - F.col("end_ms") < 100, F.lit(False))
    return t.groupBy(adjacent.alias("adjacent")).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("cut.end_ms") < F.col("off") - EDGE_SLACK_MS, "end_cut"),
        share(F.col("cut.start_ms") > F.col("on") + EDGE_SLACK_MS, "start_cut"),
        share(near_next & (F.col("cut.end_ms") > F.col("next_on") + EDGE_SLACK_MS), "into_next"),
        share(near_prev & (F.col("cut.start_ms") < F.col("prev_off") - EDGE_SLACK_MS), "from_prev"))


def noise_inventory(noises: DataFrame) -> DataFrame:
    """Recordings of each noise, and of any noise where there are several."""
    kinds = noises.groupBy(F.col("word").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    every = kinds.groupBy().agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")) \
        .where((F.col("kinds") > 1) & (F.col("n") > 1)).select(F.lit("noise").alias("kind"), "n")
    return kinds.unionByName(every)


def unindexed(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files on disk no source points to."""
    return files.select("source_file").join(sources.select("source_file"), "source_file", "left_anti")


def template_words(unspliceable_words: DataFrame, listed: DataFrame) -> DataFrame:
    """Unpronounceable words not yet in the pronunciation file."""
    return unspliceable_words.select("word", "n").join(listed.select("word"), "word", "left_anti")


def frames_in_clips(frames: DataFrame, clips: DataFrame, width: int = PART_MS) -> DataFrame:
    """Frames falling inside each clip of their source (J13); they may carry ``part`` (``frames.PART_MS``)."""
    c = clips.where(dur() > 0).select("source_id", "clip_id", "start_ms", "end_ms")
    part = "part" if "part" in frames.columns and width == PART_MS else None
    return O.overlap_join(frames, c, ["source_id"], ("t_ms", "t_ms"), ("start_ms", "end_ms"), width, part)
