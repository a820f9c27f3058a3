"""Songs as note tables: notes, parts, roles, keys, tempo.

Notes are (song_id, part_id, note_id, pitch, start_ms, dur_ms, velocity).  A
part is summed up by counts per pitch or per moment, never by a list of notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.functions import music as MU
from wordclips.operators import ordered as O
from wordclips.session import stored

PART = ["song_id", "part_id"]
MINUTE_MS = 60_000
TICKS = 100_000
DEFAULT_USEC = 500_000
STUCK_MS = 4_000
MELODY_GAP_MS = 30


def _minute(ms="start_ms") -> Column:
    return O.bucket(ms, MINUTE_MS)


# --- tempo ----------------------------------------------------------------------

def tempo_map(tempo: DataFrame) -> DataFrame:
    """(song_id, tick, usec, base): tick-microseconds passed before each change.

    A song with no change at tick 0 starts at 120 BPM.
    """
    t = tempo.select("song_id", "tick", F.when(F.col("usec") > 0, F.col("usec")).otherwise(DEFAULT_USEC).cast("bigint").alias("usec"))
    late = t.groupBy("song_id").agg(F.min("tick").alias("first")).where(F.col("first") > 0) \
        .select("song_id", F.lit(0).cast("bigint").alias("tick"), F.lit(DEFAULT_USEC).cast("bigint").alias("usec"))
    seq = O.scan(t.unionByName(late), ["song_id"], ["tick", "usec"], O.bucket("tick", TICKS), nxt=O.lead("tick"))
    span = (F.col("nxt") - F.col("tick")) * F.col("usec")
    return O.scan(seq.withColumn("span", span), ["song_id"], ["tick", "usec"], O.bucket("tick", TICKS),
                  base=O.sum_before("span"))


def ticks_to_seconds(events: DataFrame, tempo: DataFrame, ticks_per_beat: int = 480) -> DataFrame:
    """Events (song_id, event_id, tick) in seconds, by the last change at or before them."""
    changes = tempo_map(tempo).select("song_id", F.col("tick").alias("at"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("event_id"),
                                      F.struct("tick", "usec", "base").alias("chg"))
    asks = events.select("song_id", F.greatest(F.lit(0), "tick").alias("at"), F.lit(1).alias("side"), "event_id",
                         F.lit(None).cast(changes.schema["chg"].dataType).alias("chg"))
    seq = O.scan(changes.unionByName(asks), ["song_id"], ["at", "side", "event_id"], O.bucket("at", TICKS),
                 now=O.latest("chg", F.col("side") == 0)).where(F.col("side") == 1)
    base, usec, tick = F.coalesce("now.base", F.lit(0)), F.coalesce("now.usec", F.lit(DEFAULT_USEC)), F.coalesce("now.tick", F.lit(0))
    return seq.select("song_id", "event_id", F.col("at").alias("tick"),
                      ((base + (F.col("at") - tick) * usec) / 1e6 / ticks_per_beat).alias("seconds"))


def main_bpm(tempo: DataFrame, ends: DataFrame) -> DataFrame:
    """The tempo each song spends longest in (A14); ``ends`` is (song_id, end_tick)."""
    t = tempo_map(tempo).join(ends, "song_id", "left")
    until = F.coalesce("nxt", F.greatest(F.coalesce("end_tick", F.lit(0)), "tick"))
    per = t.groupBy("song_id", "usec").agg(F.sum((until - F.col("tick")) * F.col("usec")).alias("time"), F.min("tick").alias("first"))
    return per.groupBy("song_id").agg(F.max_by("usec", F.struct(F.col("time"), -F.col("first"))).alias("usec")) \
        .select("song_id", "usec", (F.lit(60e6) / F.col("usec")).alias("bpm"))


# --- notes from events -------------------------------------------------------------

def pair_notes(events: DataFrame, ends: DataFrame) -> DataFrame:
    """Note-ons matched to note-offs, first in first out (M1).

    ``events`` is (song_id, track, channel, pitch, tick, seq, is_on, velocity),
    ``ends`` (song_id, track, end_tick).  An off takes the count of open notes
    below 0 and every earlier low exactly when nothing is open: it is dropped, so
    the low, turned round, tells how many were.  The k-th on then belongs to the
    k-th off left; an on without one ends with its track, unreleased.

    One pass: counts and lows inside chunks, one row a chunk (its counts and its
    low) from which follows what each chunk begins with, and one grouping by k.
    """
    key = ["song_id", "track", "channel", "pitch"]
    near = Window.partitionBy(*key, "chunk").orderBy("tick", "seq")
    upto, before = near.rowsBetween(Window.unboundedPreceding, 0), near.rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumns({"chunk": O.bucket("tick", TICKS), "d": F.when(F.col("is_on"), 1).otherwise(-1)})
    e = e.withColumns({"open": F.sum("d").over(upto), "ons": F.count_if("is_on").over(upto), "rows": F.count(F.lit(1)).over(upto)})
    e = e.withColumn("low", F.min("open").over(before))
    chunks = e.groupBy(*key, "chunk").agg(F.sum("d").alias("d"), F.min("open").alias("low"), F.count_if("is_on").alias("ons"), F.count(F.lit(1)).alias("rows"))
    far = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*key, "chunk", "low", *[F.coalesce(F.sum(c).over(far), F.lit(0)).alias(f"{c}0") for c in ("d", "ons", "rows")])
    chunks = chunks.select(*key, "chunk", "d0", "ons0", "rows0", F.least(F.lit(0), F.min(F.col("d0") + F.col("low")).over(far)).alias("low0"))
    e = e.join(chunks, [*key, "chunk"])
    open_, low = F.col("d0") + F.col("open"), F.least("low0", F.col("d0") + F.col("low"))
    ons = F.col("ons0") + F.col("ons")
    stray = ~F.col("is_on") & (open_ < low)
    k = F.when(F.col("is_on"), ons).otherwise(F.col("rows0") + F.col("rows") - ons + low)
    both = e.where(~stray).groupBy(*key, k.alias("k")).agg(
        F.max(F.when(F.col("is_on"), F.struct("tick", "velocity"))).alias("on"), F.max(F.when(~F.col("is_on"), F.col("tick"))).alias("off"))
    return both.join(ends, ["song_id", "track"], "left").select(
        *key, "k", F.col("on.velocity").alias("velocity"), F.col("on.tick").alias("start"),
        F.coalesce("off", "end_tick").alias("end"), F.col("off").isNotNull().alias("released"))


def clamp_notes(notes: DataFrame) -> DataFrame:
    """Notes never let go ring at most 4 s past the last released one (M2).

    ``notes`` is (song_id, start_ms, end_ms, released, ...).
    """
    last = notes.where("released").groupBy("song_id").agg(F.max("end_ms").alias("__last"))
    held = F.least(F.col("end_ms"), F.greatest("start_ms", "__last") + STUCK_MS)
    return notes.join(last, "song_id", "left").withColumn("end_ms", F.when(
        F.col("released") | F.col("__last").isNull(), F.col("end_ms")).otherwise(held)).drop("__last")


def build_parts(notes: DataFrame, programs: DataFrame) -> DataFrame:
    """Parts with their notes and most used program (M3).

    ``notes`` is (song_id, track, channel, note_id, pitch, start_ms, dur_ms),
    ``programs`` (song_id, track, channel, start_ms, seq, program).  The drum
    channel is split by drum group.
    """
    key = ["song_id", "track", "channel"]
    chg = programs.select(*key, "start_ms", F.lit(0).alias("side"), F.col("seq").alias("n"), "program", F.lit(None).cast("bigint").alias("pitch"))
    ons = notes.select(*key, "start_ms", F.lit(1).alias("side"), F.col("note_id").alias("n"), F.lit(None).cast("bigint").alias("program"), "pitch")
    seq = O.scan(chg.unionByName(ons), key, ["start_ms", "side", "n", "program"], _minute(), prog=O.latest("program", F.col("side") == 0)) \
        .where(F.col("side") == 1)
    drums = F.col("channel") == MU.DRUM_CHANNEL
    group = F.when(drums, MU.drum_group(F.col("pitch")))
    used = seq.groupBy(*key, group.alias("drum_group"), F.coalesce("prog", F.lit(0)).alias("prog")).agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("start_ms", "n")).alias("first"))
    top = F.max_by("prog", F.struct(F.col("c"), -F.col("first.start_ms"), -F.col("first.n"), -F.col("prog")))
    p = used.groupBy(*key, "drum_group").agg(top.alias("program"), F.sum("c").alias("notes"))
    name = F.concat(F.lit("t"), "track", F.lit("c"), "channel", F.when(
        F.col("drum_group").isNotNull(), F.concat(F.lit("-"), "drum_group")).otherwise(""))
    return p.select(*key, "drum_group", name.alias("part_name"), F.when(F.col("drum_group").isNull(), F.col("program")).alias("program"), "notes")


# --- part statistics ---------------------------------------------------------------

def _summed_up_to(per: DataFrame) -> DataFrame:
    """Adds to (part, pitch, d) the sum of ``d`` up to the pitch and of the whole part."""
    w = Window.partitionBy(*PART)
    return per.withColumns({"acc": F.sum("d").over(w.orderBy("pitch").rowsBetween(Window.unboundedPreceding, 0)),
                            "total": F.sum("d").over(w)})


def _median() -> Column:
    return F.min(F.when(F.col("acc") * 2 >= F.col("total"), F.col("pitch"))).alias("median_pitch")


def weighted_median(notes: DataFrame) -> DataFrame:
    """The pitch each part sits on, weighted by how long notes last (A10)."""
    per = notes.groupBy(*PART, "pitch").agg(F.sum("dur_ms").alias("d"))
    return _summed_up_to(per).groupBy(*PART).agg(_median())


def polyphony(notes: DataFrame) -> DataFrame:
    """Most notes at once, and how many while any sounds.

    Starts and ends are netted per moment before anything is ordered; an end
    comes before a start at the same moment, so the net is the count reached.
    """
    ev = notes.select(*PART, F.explode(F.array(
        F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")),
        F.struct((F.col("start_ms") + F.col("dur_ms")).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    net = ev.groupBy(*PART, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    seq = O.scan(net, PART, ["t"], _minute("t"), on=O.running_sum("d"), nxt=O.lead("t"))
    span = F.when(F.col("on") > 0, F.col("nxt") - F.col("t"))
    return seq.groupBy(*PART).agg(F.max("on").alias("most"), (F.coalesce(
        F.sum(F.col("on") * span) / F.sum(span), F.lit(0.0))).alias("typical"))


def part_summary(notes: DataFrame, pans: DataFrame | None = None) -> DataFrame:
    """One row per part: size, range, usual and median pitch, polyphony, onset."""
    per = _summed_up_to(notes.groupBy(*PART, "pitch").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("start_ms", "dur_ms")).alias("first"), F.sum("dur_ms").alias("d")))
    usual = F.max_by("pitch", F.struct(F.col("c"), -F.col("first.start_ms"), -F.col("first.dur_ms"), -F.col("pitch")))
    s = per.groupBy(*PART).agg(F.sum("c").alias("notes"), F.min("pitch").alias("low"), F.max("pitch").alias("high"),
                               usual.alias("common_pitch"), F.min("first.start_ms").alias("first_ms"), _median())
    s = s.join(polyphony(notes), PART)
    if pans is not None:
        s = s.join(pans.select(*PART, F.round("pan", 2).alias("pan")), PART, "left")
    return s.withColumns({"low_name": MU.note_name(F.col("low")), "high_name": MU.note_name(F.col("high"))})


def _profiles(spark) -> DataFrame:
    rows = []
    for tonic in range(12):
        for mode, profile in (("major", MU.MAJOR_PROFILE), ("minor", MU.MINOR_PROFILE)):
            rows += [(tonic, mode, (tonic + i) % 12, float(v)) for i, v in enumerate(profile)]
    return spark.createDataFrame(rows, "tonic int, mode string, pc int, weight double")


def detect_key(notes: DataFrame) -> DataFrame:
    """(song_id, key, confidence) from how long each pitch class sounds.

    ``notes`` are the melodic parts.  A relative key scoring nearly as well is
    decided by where bass and tune start and end, the mode by its third and
    sixth.
    """
    pc = (F.col("pitch") % 12).cast("int")
    hist = notes.groupBy("song_id", pc.alias("pc")).agg(F.sum("dur_ms").cast("double").alias("h"))
    # Per song one row: its 12 sums as an array.
    filled = hist.groupBy("song_id").agg(F.map_from_entries(F.collect_list(F.struct("pc", "h"))).alias("m"))
    arr = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    songs = filled.select("song_id", arr.alias("hist")).where(F.aggregate("hist", F.lit(0.0), lambda a, x: a + x) > 0)
    prof = F.broadcast(_profiles(notes.sparkSession))
    long = songs.select("song_id", F.posexplode("hist").alias("pc", "h")).join(prof, "pc")
    score = long.groupBy("song_id", "tonic", "mode").agg(F.corr("h", "weight").alias("c")) \
        .withColumn("score", F.round(F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)), 9))
    names = F.array(*[F.lit(p) for p in MU.PITCH_CLASSES])
    name = F.concat(F.get(names, F.col("tonic")), F.lit(" "), "mode")
    ranked = score.groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct(
        "score", name.alias("name"), "tonic", "mode")), asc=False).alias("r"))
    b, second = F.get("r", 0), F.get("r", 1)
    t = ranked.join(songs, "song_id").withColumns({"b": b, "second": second["score"]})
    t = t.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.score")))
                     * F.least(F.lit(1.0), F.lit(0.5) + (F.col("b.score") - F.col("second")) * 5))
    major = F.col("b.mode") == "major"
    rel = F.when(major, (F.col("b.tonic") + 9) % 12).otherwise((F.col("b.tonic") + 3) % 12)
    t = t.withColumns({"rel": rel, "rel_mode": F.when(major, "minor").otherwise("major")})
    rel_score = F.get(F.filter("r", lambda x: (x["tonic"] == F.col("rel")) & (x["mode"] == F.col("rel_mode"))), 0)["score"]
    t = t.withColumn("close", F.col("b.score") - rel_score < 0.15).join(_homes(notes), "song_id", "left")
    top = F.array_max("hist")

    def votes(x: Column) -> Column:
        said = sum((F.when(F.col(c) == x, 1.0).otherwise(0.0) for c in ("bass_first", "bass_last", "tune_first")), F.lit(0.0))
        return said + F.lit(0.1) * F.get("hist", x) / top

    use_rel = F.col("close") & (votes(F.col("rel")) > votes(F.col("b.tonic")))
    t = t.withColumns({"tonic": F.when(use_rel, F.col("rel")).otherwise(F.col("b.tonic")),
                       "mode": F.when(use_rel, F.col("rel_mode")).otherwise(F.col("b.mode"))})
    at = lambda d: F.get("hist", (F.col("tonic") + d) % 12)
    mi, ma = at(3) + 0.5 * at(8), at(4) + 0.5 * at(9)
    total = F.aggregate("hist", F.lit(0.0), lambda a, x: a + x)
    told = (mi + ma > 0.02 * total) & (F.abs(mi - ma) > 0.25 * (mi + ma))
    mode = F.when(told, F.when(mi > ma, "minor").otherwise("major")).otherwise(F.col("mode"))
    return t.select("song_id", F.concat(F.get(names, F.col("tonic")), F.lit(" "), mode).alias("key"), "confidence")


def _homes(notes: DataFrame) -> DataFrame:
    """Pitch class of the bass's first and last note and of the tune's first."""
    per = notes.groupBy(*PART).agg(
        F.min(F.struct("start_ms", "pitch")).alias("a"), F.max(F.struct("start_ms", "pitch")).alias("z"),
        F.min(F.struct(F.col("start_ms"), (-F.col("pitch")).alias("np"))).alias("t")).join(weighted_median(notes), PART)
    low, high = F.struct("median_pitch", "part_id"), F.struct(F.col("median_pitch"), -F.col("part_id"))
    g = per.groupBy("song_id").agg(F.min_by(F.struct("a", "z"), low).alias("lo"), F.max_by("t", high).alias("hi"))
    return g.select("song_id", (F.col("lo.a.pitch") % 12).cast("int").alias("bass_first"),
                    (F.col("lo.z.pitch") % 12).cast("int").alias("bass_last"), (-F.col("hi.np") % 12).cast("int").alias("tune_first"))


def assign_roles(parts: DataFrame) -> DataFrame:
    """The job of every part (M4).

    ``parts`` is (song_id, part_id, program, drum_group, median_pitch, typical,
    notes), one row per part; a song has few.
    """
    w = Window.partitionBy("song_id")
    melodic = F.col("drum_group").isNull()
    p = parts.withColumns({
        "by_program": F.max(melodic & F.coalesce(F.col("program").between(32, 39), F.lit(False))).over(w),
        "n_melodic": F.sum(melodic.cast("int")).over(w),
        "low": melodic & (F.col("median_pitch") < 48) & (F.col("typical") < 1.5)})
    lowest = F.min(F.when(F.col("low"), F.struct("median_pitch", "part_id"))).over(w)
    bass = melodic & F.when(F.col("by_program"), F.coalesce(F.col("program").between(32, 39), F.lit(False))).otherwise(
        (F.col("n_melodic") > 1) & F.coalesce(F.col("lowest.part_id") == F.col("part_id"), F.lit(False)))
    p = p.withColumn("lowest", lowest).withColumn("bass", bass)
    rest = melodic & ~F.col("bass") & (F.col("typical") < 2.5)
    lead = F.max(F.when(rest, F.struct(F.bround(F.col("median_pitch") / 3).alias("h"), F.col("notes"), (-F.col("part_id")).alias("np")))).over(w)
    p = p.withColumn("lead", lead)
    role = F.when(~melodic, F.concat(F.lit("drums:"), "drum_group")).when(F.col("bass"), "bass") \
        .when(F.col("typical") >= 2.5, "chords").when(-F.col("lead.np") == F.col("part_id"), "lead").otherwise("rhythm")
    return p.withColumn("role", role).drop("by_program", "n_melodic", "low", "lowest", "bass", "lead")


def part_names(parts: DataFrame) -> DataFrame:
    """Unique readable names: Distortion Guitar (lead), and 2, 3 ... for repeats (M3)."""
    dim = F.broadcast(MU.program_dim(parts.sparkSession).select("program", "program_name"))
    p = parts.join(dim, "program", "left")
    base = F.when(F.col("drum_group").isNotNull(), F.col("drum_group")).otherwise(
        F.concat(F.coalesce("program_name", F.lit("Acoustic Grand Piano")), F.lit(" ("), "role", F.lit(")")))
    w = Window.partitionBy("song_id", "base").orderBy("part_id")
    k = F.row_number().over(w)
    return p.withColumn("base", base).withColumn("k", k).withColumn("name", F.when(
        (F.col("k") == 1) | F.col("drum_group").isNotNull(), F.col("base")).otherwise(
        F.concat("base", F.lit(" "), F.col("k").cast("string")))).drop("base", "k", "program_name")


def bass_line(roles: DataFrame) -> DataFrame:
    """The lowest part of songs where none is called the bass (M5)."""
    m = roles.where(F.col("drum_group").isNull() & (F.col("notes") > 0))
    low = m.groupBy("song_id").agg(F.max((F.col("role") == "bass").cast("int")).alias("has"), F.min_by(
        F.struct("part_id", "role", "median_pitch"), F.struct("median_pitch", "part_id")).alias("l"))
    return low.where((F.col("has") == 0) & (F.col("l.role") != "lead") & (F.col("l.median_pitch") < 53)) \
        .select("song_id", F.col("l.part_id").alias("part_id"))


def melody(notes: DataFrame) -> DataFrame:
    """The top line of each part: notes under 30 ms after the last kept one go (M6).

    Only the highest note of a moment can stay.  A moment 30 ms or more after
    the one before it always stays, so the rule is followed only inside the
    runs of moments closer than that: from a run's first moment, along the table
    of next moments (``reach``), at any length of a run.
    """
    tops = notes.groupBy(*PART, "start_ms").agg(F.max("pitch").alias("pitch"))
    seq = O.scan(tops, PART, ["start_ms"], _minute(), prev=O.lag("start_ms"))
    fresh = F.col("prev").isNull() | (F.col("start_ms") - F.col("prev") >= MELODY_GAP_MS)
    seq = O.scan(seq.withColumn("fresh", fresh.cast("int")), PART, ["start_ms"], _minute(), run=O.running_sum("fresh"))
    run = [*PART, "run"]
    seq = stored(seq.select(*run, "start_ms", "pitch"), "moments")
    # From each moment to the next one that may be kept after it: 30 ms later, in the same run.
    asks = seq.select(*run, (F.col("start_ms") + MELODY_GAP_MS).alias("at"), F.col("start_ms").alias("n"))
    both = asks.withColumn("is_moment", F.lit(False)).unionByName(seq.select(
        *run, F.col("start_ms").alias("at"), F.col("start_ms").alias("n"), F.lit(True).alias("is_moment")))
    steps = O.scan(both, run, ["at", "is_moment", "n"], _minute("at"), to=O.lead("at", F.col("is_moment")))
    steps = stored(steps.where(~F.col("is_moment") & F.col("to").isNotNull()).select(*run, "n", "to"), "steps")
    longest = steps.groupBy(*run).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    first = seq.groupBy(*run).agg(F.min("start_ms").alias("n"))
    kept = O.reach(first, steps, run, longest)
    return seq.join(kept.withColumnRenamed("n", "start_ms"), [*run, "start_ms"]).select(*PART, "start_ms", "pitch")


def auto_octave(median: Column, sample: Column) -> Column:
    """Octaves to move a part to where a voice sings it (M7)."""
    move = F.greatest(F.lit(-3), F.least(F.lit(3), F.bround((sample - median) / 12.0)))
    return F.when(sample.isNull(), 0).otherwise(move).cast("int")


def octaves_to_fit(lowest: Column, floor_hz: Column, shift: Column) -> Column:
    """Octaves to raise a part so that its lowest note reaches ``floor_hz`` (M7)."""
    hz = MU.midi_to_hz(lowest + shift)
    up = F.ceil(F.log2((floor_hz - 1e-6) / hz))
    return F.when((floor_hz <= 0) | lowest.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(6), up))).cast("int")


def fit_melody(line: DataFrame, wants: DataFrame) -> DataFrame:
    """``n`` notes of each part's line, round again if it runs out, by octaves to the voice (M7).

    ``wants`` is (song_id, part_id, n, centre).
    """
    med = O.quantile(line, PART, "pitch", median=0.5)
    seq = O.scan(line, PART, ["start_ms"], _minute(), k=O.rank())
    size = line.groupBy(*PART).agg(F.count(F.lit(1)).alias("size"))
    slots = wants.join(size, PART).join(med, PART).select(
        *PART, "centre", "median", "size", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    slots = slots.withColumn("k", F.col("i") % F.col("size") + 1)
    shift = F.bround((F.col("centre") - F.col("median")) / 12) * 12
    return slots.join(seq, [*PART, "k"]).select(*PART, F.col("i").cast("bigint").alias("i"), (F.col("pitch") + shift).alias("pitch"))


def notes_in_range(notes: DataFrame, views: DataFrame, width: int = 5_000) -> DataFrame:
    """Notes sounding in each viewport (J10); ``views`` is (view_id, song_id, from_ms, to_ms)."""
    n = notes.withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))
    v = views.withColumn("last_ms", F.col("to_ms") - 1)
    return O.overlap_join(n, v, ["song_id"], ("start_ms", "end_ms"), ("from_ms", "last_ms"), width).drop("last_ms", "end_ms")


def describe_song(songs: DataFrame, parts: DataFrame) -> DataFrame:
    """A song in plain words (M8); ``songs`` is (song_id, bpm, key, duration_ms)."""
    fam = F.broadcast(MU.program_dim(parts.sparkSession).select("program", "family"))
    m = parts.where(F.col("drum_group").isNull()).withColumn("program", F.coalesce("program", F.lit(0))).join(fam, "program")
    c = m.groupBy("song_id", "family").agg(F.count(F.lit(1)).alias("n"), F.min("part_id").alias("first"))
    bit = F.when(F.col("n") == 1, F.col("family")).otherwise(F.concat(
        F.col("n").cast("string"), F.lit(" "), "family", F.when(F.col("family").endswith("s"), "").otherwise("s")))
    bits = c.groupBy("song_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(
        (-F.col("n")).alias("o"), "first", bit.alias("b")))), lambda x: x["b"]).alias("bits"))
    side = parts.groupBy("song_id").agg(F.sum(F.col("drum_group").isNotNull().cast("int")).alias("drums"),
                                        F.max(F.coalesce(F.col("program").isin(29, 30), F.lit(False))).alias("heavy"))
    t = songs.join(bits, "song_id", "left").join(side, "song_id", "left")
    b = F.col("bpm")
    pace = F.when(b < 76, "Slow").when(b < 100, "Relaxed").when(b < 128, "Upbeat").when(b < 160, "Fast").otherwise("Very fast")
    s = F.bround(F.col("duration_ms") / 1000).cast("bigint")
    kit = F.when(F.col("drums") > 0, F.array(F.concat(F.col("drums").cast("string"), F.lit(" drum sound"), F.when(F.col("drums") > 1, "s").otherwise("")))) \
        .otherwise(F.array().cast("array<string>"))
    text = F.concat(pace, F.lit(" ("), F.bround(b).cast("bigint").cast("string"), F.lit(" BPM), "), "key", F.lit(", "),
                    F.when(F.col("key").endswith("minor"), "dark").otherwise("bright"), F.when(F.col("heavy"), " and heavy").otherwise(""),
                    F.lit(", "), F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(" long: "),
                    F.array_join(F.concat(F.coalesce("bits", F.array().cast("array<string>")), kit), ", "), F.lit("."))
    return t.select("song_id", text.alias("description"))


def song_library(notes: DataFrame, parts: DataFrame, bpm: DataFrame, keys: DataFrame, tempo: DataFrame, added: DataFrame) -> DataFrame:
    """One row per song, newest first (A15); ``added`` is (song_id, added)."""
    n = notes.groupBy("song_id").agg(F.count(F.lit(1)).alias("notes"), F.max(F.col("start_ms") + F.col("dur_ms")).alias("duration_ms"))
    p = parts.groupBy("song_id").agg(F.sum(F.col("drum_group").isNull().cast("bigint")).alias("parts"),
                                     F.sum(F.col("drum_group").isNotNull().cast("bigint")).alias("drums"))
    c = tempo.groupBy("song_id").agg(F.greatest(F.lit(0), F.count_distinct("tick", "usec") - 1).alias("tempo_changes"))
    return n.join(p, "song_id").join(bpm.select("song_id", F.bround("bpm").cast("bigint").alias("bpm")), "song_id", "left") \
        .join(keys.select("song_id", "key"), "song_id", "left").join(c, "song_id", "left").join(added, "song_id", "left") \
        .orderBy(F.desc("added"), "song_id")
