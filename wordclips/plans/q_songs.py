"""Queries on songs, notes and loudness (S9, M*, A10-A18, J8, J10, R8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordclips.functions import music as MU
from wordclips.operators import loudness as LD
from wordclips.operators import ordered as O
from wordclips.operators import songs as SG
from wordclips.operators import takes as TK
from wordclips.plans.catalog import query

PART = ["song_id", "part_id"]


def melodic(t):
    return t.notes.where(F.col("channel") != 9)


def roles(t):
    """Parts with statistics, a program each and a drum group on the drum channel."""
    s = SG.weighted_median(t.notes).join(SG.polyphony(t.notes), PART).join(
        t.notes.groupBy(*PART).agg(F.count(F.lit(1)).alias("notes"), F.max("channel").alias("channel")), PART)
    p = s.select(*PART, "median_pitch", "typical", "notes",
                 F.when(F.col("channel") != 9, (F.col("song_id") * 13 + F.col("part_id") * 29) % 128).alias("program"),
                 F.when(F.col("channel") == 9, F.lit("perc")).alias("drum_group"))
    return SG.assign_roles(p)


_STATS = """wm AS (SELECT song_id, part_id, min(pitch) AS median_pitch FROM (SELECT song_id, part_id, pitch,
      sum(d) OVER (PARTITION BY song_id, part_id ORDER BY pitch) AS acc, sum(d) OVER (PARTITION BY song_id, part_id) AS tot
      FROM (SELECT song_id, part_id, pitch, sum(dur_ms) AS d FROM notes GROUP BY 1, 2, 3)) WHERE acc * 2 >= tot GROUP BY 1, 2),
    ev AS (SELECT song_id, part_id, start_ms AS t, 1 AS d FROM notes UNION ALL SELECT song_id, part_id, start_ms + dur_ms, -1 FROM notes),
    net AS (SELECT song_id, part_id, t, sum(d) AS d FROM ev GROUP BY 1, 2, 3),
    ru AS (SELECT *, sum(d) OVER w AS n, lead(t) OVER w - t AS span FROM net WINDOW w AS (PARTITION BY song_id, part_id ORDER BY t)),
    po AS (SELECT song_id, part_id, CAST(max(n) AS BIGINT) AS most, sum(CASE WHEN n > 0 THEN n * span END) / sum(CASE WHEN n > 0 THEN span END) AS typical FROM ru GROUP BY 1, 2)"""
_ROLES = _STATS + """,
    p0 AS (SELECT song_id, part_id, median_pitch, typical, notes, CASE WHEN channel <> 9 THEN (song_id * 13 + part_id * 29) % 128 END AS program,
      CASE WHEN channel = 9 THEN 'perc' END AS drum_group FROM wm JOIN po USING (song_id, part_id)
      JOIN (SELECT song_id, part_id, count(*) AS notes, max(channel) AS channel FROM notes GROUP BY 1, 2) USING (song_id, part_id)),
    p1 AS (SELECT *, bool_or(drum_group IS NULL AND coalesce(program BETWEEN 32 AND 39, false)) OVER (PARTITION BY song_id) AS byp,
      sum(CASE WHEN drum_group IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY song_id) AS nm,
      first_value(part_id) OVER (PARTITION BY song_id ORDER BY CASE WHEN drum_group IS NULL AND median_pitch < 48 AND typical < 1.5 THEN 0 ELSE 1 END, median_pitch, part_id) AS lowp,
      bool_or(drum_group IS NULL AND median_pitch < 48 AND typical < 1.5) OVER (PARTITION BY song_id) AS anylow FROM p0),
    p2 AS (SELECT *, drum_group IS NULL AND CASE WHEN byp THEN coalesce(program BETWEEN 32 AND 39, false) ELSE nm > 1 AND anylow AND part_id = lowp END AS bass FROM p1),
    p3 AS (SELECT *, CASE WHEN drum_group IS NULL AND NOT bass AND typical < 2.5 THEN row_number() OVER (PARTITION BY song_id
      ORDER BY drum_group IS NULL AND NOT bass AND typical < 2.5 DESC, round_even(median_pitch / 3, 0) DESC, notes DESC, part_id) END AS lr FROM p2),
    roles AS (SELECT song_id, part_id, median_pitch, typical, notes, program, drum_group, CASE WHEN drum_group IS NOT NULL THEN 'drums:' || drum_group
      WHEN bass THEN 'bass' WHEN typical >= 2.5 THEN 'chords' WHEN lr = 1 THEN 'lead' ELSE 'rhythm' END AS role FROM p3)"""


@query("J8_ticks_to_seconds", "tempo", """
    WITH t AS (SELECT * FROM tempo UNION ALL SELECT song_id, 0, 500000 FROM tempo GROUP BY 1 HAVING min(tick) > 0),
    m AS (SELECT *, coalesce(sum(sp) OVER (PARTITION BY song_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
      FROM (SELECT *, (lead(tick) OVER (PARTITION BY song_id ORDER BY tick) - tick) * usec AS sp FROM t)),
    e AS (SELECT l_orderkey % 500 AS song_id, l_orderkey * 10 + l_linenumber AS event_id, l_partkey * 13 % 9600 AS tick FROM lineitem)
    SELECT e.song_id, event_id, e.tick, (coalesce(base, 0) + (e.tick - coalesce(m.tick, 0)) * coalesce(usec, 500000))::DOUBLE / 1e6 / 480 AS seconds
    FROM e ASOF LEFT JOIN m ON e.song_id = m.song_id AND e.tick >= m.tick""")
def _(t):
    e = t.read("lineitem").select((F.col("l_orderkey") % 500).alias("song_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
                                  (F.col("l_partkey") * 13 % 9600).alias("tick"))
    return SG.ticks_to_seconds(e, t.tempo)


@query("A14_main_bpm", "tempo", """
    WITH t AS (SELECT * FROM tempo UNION ALL SELECT song_id, 0, 500000 FROM tempo GROUP BY 1 HAVING min(tick) > 0),
    s AS (SELECT song_id, usec, tick, (coalesce(lead(tick) OVER (PARTITION BY song_id ORDER BY tick), greatest(9600, tick)) - tick) * usec AS sp FROM t),
    g AS (SELECT song_id, usec, sum(sp) AS time, min(tick) AS first FROM s GROUP BY 1, 2)
    SELECT song_id, usec, round(60e6 / usec, 6) AS bpm FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY time DESC, first) AS r FROM g) WHERE r = 1""")
def bpm(t):
    ends = t.tempo.select("song_id").distinct().withColumn("end_tick", F.lit(9600).cast("bigint"))
    return SG.main_bpm(t.tempo, ends).withColumn("bpm", F.round("bpm", 6))


def midi_events(t):
    """Note events by tick: every note's on and off, some offs missing and some stray."""
    n = t.notes.select("song_id", F.lit(0).cast("bigint").alias("track"), F.col("part_id").alias("channel"), "pitch", "start_ms", "dur_ms", "note_id", "velocity")
    on = n.select("song_id", "track", "channel", "pitch", F.col("start_ms").alias("tick"), (F.col("note_id") * 4 + 1).alias("seq"), F.lit(True).alias("is_on"), "velocity")
    off = n.where(F.col("note_id") % 41 != 0).select("song_id", "track", "channel", "pitch", (F.col("start_ms") + F.col("dur_ms")).alias("tick"),
                                                    (F.col("note_id") * 4).alias("seq"), F.lit(False).alias("is_on"), F.lit(0).cast("bigint").alias("velocity"))
    stray = n.where(F.col("velocity") % 37 == 0).select("song_id", "track", "channel", "pitch", F.col("start_ms").alias("tick"), (F.col("note_id") * 4 + 2).alias("seq"),
                                                        F.lit(False).alias("is_on"), F.lit(0).cast("bigint").alias("velocity"))
    return on.unionByName(off).unionByName(stray)


def track_ends(t):
    return t.notes.groupBy("song_id").agg(F.max(F.col("start_ms") + F.col("dur_ms") + 60000).alias("end_tick")) \
        .withColumn("track", F.lit(0).cast("bigint"))


_PAIRS = """e0 AS (SELECT song_id, part_id AS channel, pitch, start_ms AS tick, note_id * 4 + 1 AS seq, 1 AS d, velocity FROM notes
      UNION ALL SELECT song_id, part_id, pitch, start_ms + dur_ms, note_id * 4, -1, 0 FROM notes WHERE note_id % 41 <> 0
      UNION ALL SELECT song_id, part_id, pitch, start_ms, note_id * 4 + 2, -1, 0 FROM notes WHERE velocity % 37 = 0),
    e1 AS (SELECT *, sum(d) OVER (PARTITION BY song_id, channel, pitch ORDER BY tick, seq) AS op FROM e0),
    e2 AS (SELECT *, coalesce(min(op) OVER (PARTITION BY song_id, channel, pitch ORDER BY tick, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM e1),
    e3 AS (SELECT *, row_number() OVER (PARTITION BY song_id, channel, pitch, d ORDER BY tick, seq) AS k FROM e2 WHERE NOT (d = -1 AND op < least(0, low))),
    te AS (SELECT song_id, max(start_ms + dur_ms + 60000) AS end_tick FROM notes GROUP BY 1),
    pairs AS (SELECT a.song_id, a.channel, a.pitch, a.k, a.velocity, a.tick AS start, coalesce(b.tick, end_tick) AS "end", b.tick IS NOT NULL AS released
      FROM e3 a LEFT JOIN e3 b ON b.song_id = a.song_id AND b.channel = a.channel AND b.pitch = a.pitch AND b.k = a.k AND b.d = -1
      JOIN te ON te.song_id = a.song_id WHERE a.d = 1)"""


@query("M1_pair_notes", "notes", f'WITH {_PAIRS} SELECT song_id, channel, pitch, k, velocity, start, "end", released FROM pairs')
def pairs(t):
    return SG.pair_notes(midi_events(t), track_ends(t)).drop("track")


@query("M2_clamp_notes", "notes", f"""WITH {_PAIRS}, l AS (SELECT song_id, max("end") AS last FROM pairs WHERE released GROUP BY 1)
    SELECT song_id, channel, pitch, k, start AS start_ms, CASE WHEN released OR last IS NULL THEN "end" ELSE least("end", greatest(start, last) + 4000) END AS end_ms
    FROM pairs LEFT JOIN l USING (song_id)""")
def _(t):
    p = pairs(t).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})
    return SG.clamp_notes(p).select("song_id", "channel", "pitch", "k", "start_ms", "end_ms")


@query("M3_build_parts", "notes", """
    WITH n AS (SELECT song_id, 0 AS track, channel, note_id, pitch, start_ms FROM notes),
    pr AS (SELECT song_id, 0 AS track, channel, start_ms, note_id AS seq, velocity AS program FROM notes WHERE note_id % 5 = 0),
    a AS (SELECT n.*, CASE WHEN channel = 9 THEN CASE WHEN pitch IN (35,36) THEN 'kick' WHEN pitch IN (31,37,38,39,40) THEN 'snare'
        WHEN pitch IN (42,44,46,54,69,70,82) THEN 'hats' WHEN pitch IN (41,43,45,47,48,50) OR pitch BETWEEN 60 AND 68 THEN 'toms'
        WHEN pitch IN (49,51,52,53,55,57,59) THEN 'cymbals' ELSE 'perc' END END AS drum_group,
      coalesce((SELECT arg_max(program, (pr.start_ms, seq, program)) FROM pr WHERE pr.song_id = n.song_id AND pr.channel = n.channel AND pr.start_ms <= n.start_ms), 0) AS prog FROM n),
    u AS (SELECT song_id, track, channel, drum_group, prog, count(*) AS c, min((start_ms, note_id)) AS first FROM a GROUP BY 1, 2, 3, 4, 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY song_id, track, channel, drum_group ORDER BY c DESC, first, prog) AS r, sum(c) OVER (PARTITION BY song_id, track, channel, drum_group) AS notes FROM u)
    SELECT song_id, CAST(track AS BIGINT) AS track, channel, drum_group, 't' || track || 'c' || channel || coalesce('-' || drum_group, '') AS part_name,
      CASE WHEN drum_group IS NULL THEN prog END AS program, CAST(notes AS BIGINT) AS notes FROM r WHERE r = 1""")
def _(t):
    n = t.notes.withColumn("track", F.lit(0).cast("bigint"))
    p = n.where(F.col("note_id") % 5 == 0).select("song_id", "track", "channel", "start_ms", F.col("note_id").alias("seq"), F.col("velocity").alias("program"))
    return SG.build_parts(n, p)


@query("M4_assign_roles", "notes", f"WITH {_ROLES} SELECT song_id, part_id, role FROM roles")
def _(t):
    return roles(t).select(*PART, "role")


@query("M3_part_names", "notes", f"""WITH {_ROLES}, b AS (SELECT *, coalesce(drum_group, 'P' || program || ' (' || role || ')') AS base FROM roles)
    SELECT song_id, part_id, row_number() OVER (PARTITION BY song_id, base ORDER BY part_id) AS nth FROM b""")
def _(t):
    nth = F.when(F.col("name").rlike(r" \d+$") & ~F.col("name").rlike(r"\)$"), F.regexp_extract("name", r" (\d+)$", 1).try_cast("bigint"))
    return SG.part_names(roles(t)).select(*PART, F.coalesce(nth, F.lit(1)).cast("bigint").alias("nth"))


@query("M5_bass_line", "notes", f"""WITH {_ROLES}, l AS (SELECT song_id, bool_or(role = 'bass') AS has, arg_min({{'p': part_id, 'r': role, 'm': median_pitch}}, (median_pitch, part_id)) AS l
      FROM roles WHERE drum_group IS NULL GROUP BY 1) SELECT song_id, l.p AS part_id FROM l WHERE NOT has AND l.r <> 'lead' AND l.m < 53""")
def _(t):
    return SG.bass_line(roles(t))


@query("A10_weighted_median", "notes", f"WITH {_STATS} SELECT * FROM wm")
def _(t):
    return SG.weighted_median(t.notes)


@query("A11_polyphony", "notes", f"WITH {_STATS} SELECT song_id, part_id, most, round(typical, 6) AS typical FROM po")
def _(t):
    return SG.polyphony(t.notes).withColumn("typical", F.round("typical", 6))


@query("A12_part_summary", "notes", f"""WITH {_STATS}, c AS (SELECT song_id, part_id, pitch, count(*) AS c, min((start_ms, dur_ms)) AS f FROM notes GROUP BY 1, 2, 3),
    u AS (SELECT *, row_number() OVER (PARTITION BY song_id, part_id ORDER BY c DESC, f, pitch) AS r FROM c)
    SELECT n.song_id, n.part_id, count(*) AS notes, min(n.pitch) AS low, max(n.pitch) AS high, any_value(u.pitch) AS common_pitch, min(start_ms) AS first_ms,
      any_value(median_pitch) AS median_pitch, any_value(most) AS most, round(any_value(typical), 6) AS typical,
      ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][min(n.pitch) % 12 + 1] || (min(n.pitch) // 12 - 1) AS low_name,
      ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][max(n.pitch) % 12 + 1] || (max(n.pitch) // 12 - 1) AS high_name
    FROM notes n JOIN u ON u.song_id = n.song_id AND u.part_id = n.part_id AND r = 1 JOIN wm ON wm.song_id = n.song_id AND wm.part_id = n.part_id
    JOIN po ON po.song_id = n.song_id AND po.part_id = n.part_id GROUP BY 1, 2""")
def _(t):
    return SG.part_summary(t.notes).withColumn("typical", F.round("typical", 6))


_PROF = ",".join(f"({tonic},'{mode}',{(tonic + i) % 12},{v}::DOUBLE)" for tonic in range(12)
                 for mode, p in (("major", MU.MAJOR_PROFILE), ("minor", MU.MINOR_PROFILE)) for i, v in enumerate(p))
_NAMES = "['" + "','".join(MU.PITCH_CLASSES) + "']"
_KEY = _STATS + f""",
    mel AS (SELECT * FROM notes WHERE channel <> 9),
    h0 AS (SELECT song_id, pitch % 12 AS pc, sum(dur_ms)::DOUBLE AS h FROM mel GROUP BY 1, 2),
    hist AS (SELECT s.song_id, k.pc, coalesce(h, 0) AS h FROM (SELECT DISTINCT song_id FROM h0) s CROSS JOIN (SELECT unnest(range(12)) AS pc) k
      LEFT JOIN h0 ON h0.song_id = s.song_id AND h0.pc = k.pc),
    hl AS (SELECT song_id, list(h ORDER BY pc) AS hist, sum(h) AS total, max(h) AS top FROM hist GROUP BY 1),
    prof(tonic, mode, pc, weight) AS (VALUES {_PROF}),
    sc AS (SELECT song_id, tonic, mode, {_NAMES}[tonic + 1] || ' ' || mode AS name, round(coalesce(corr(h, weight), 0), 9) AS score FROM hist JOIN prof USING (pc) GROUP BY 1, 2, 3),
    rk AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, name DESC) AS r FROM sc),
    b AS (SELECT song_id, tonic, mode, score, CASE WHEN mode = 'major' THEN (tonic + 9) % 12 ELSE (tonic + 3) % 12 END AS rel,
      CASE WHEN mode = 'major' THEN 'minor' ELSE 'major' END AS rmode FROM rk WHERE r = 1),
    pp AS (SELECT m.song_id, m.part_id, any_value(median_pitch) AS mp, min((start_ms, pitch)) AS a, max((start_ms, pitch)) AS z, min((start_ms, -pitch)) AS t
      FROM mel m JOIN wm ON wm.song_id = m.song_id AND wm.part_id = m.part_id GROUP BY 1, 2),
    hm AS (SELECT song_id, arg_min(a[2], (mp, part_id)) % 12 AS bf, arg_min(z[2], (mp, part_id)) % 12 AS bl, (-arg_max(t[2], (mp, -part_id))) % 12 AS tf FROM pp GROUP BY 1),
    v AS (SELECT b.*, hist, total, s2.score AS second, b.score - sr.score < 0.15 AS close,
      (bf = b.tonic)::INT + (bl = b.tonic)::INT + (tf = b.tonic)::INT + 0.1::DOUBLE * hist[b.tonic + 1] / top AS vt,
      (bf = rel)::INT + (bl = rel)::INT + (tf = rel)::INT + 0.1::DOUBLE * hist[rel + 1] / top AS vr
      FROM b JOIN hl USING (song_id) JOIN hm USING (song_id) JOIN rk s2 ON s2.song_id = b.song_id AND s2.r = 2
      JOIN sc sr ON sr.song_id = b.song_id AND sr.tonic = rel AND sr.mode = rmode),
    w AS (SELECT *, CASE WHEN close AND vr > vt THEN rel ELSE tonic END AS ft, CASE WHEN close AND vr > vt THEN rmode ELSE mode END AS fm FROM v),
    x AS (SELECT *, hist[(ft + 3) % 12 + 1] + 0.5 * hist[(ft + 8) % 12 + 1] AS mi, hist[(ft + 4) % 12 + 1] + 0.5 * hist[(ft + 9) % 12 + 1] AS ma FROM w),
    keys AS (SELECT song_id, {_NAMES}[ft + 1] || ' ' || CASE WHEN mi + ma > 0.02 * total AND abs(mi - ma) > 0.25 * (mi + ma) THEN CASE WHEN mi > ma THEN 'minor' ELSE 'major' END ELSE fm END AS key,
      greatest(0, least(1, score)) * least(1, 0.5::DOUBLE + (score - second) * 5) AS confidence FROM x)"""


@query("A13_detect_key", "notes", f"WITH {_KEY} SELECT song_id, key, round(confidence, 6) AS confidence FROM keys")
def keys(t):
    return SG.detect_key(melodic(t)).withColumn("confidence", F.round("confidence", 6))


@query("M6_melody", "notes", """WITH RECURSIVE tops AS MATERIALIZED (SELECT song_id, part_id, start_ms + start_ms // 500 % 3 * 10 AS start_ms, max(pitch) AS pitch FROM notes GROUP BY 1, 2, 3),
    m AS (SELECT song_id, part_id, min(start_ms) AS start_ms FROM tops GROUP BY 1, 2 UNION ALL
      SELECT song_id, part_id, nxt FROM (SELECT m.song_id, m.part_id, (SELECT min(t.start_ms) FROM tops t WHERE t.song_id = m.song_id AND t.part_id = m.part_id AND t.start_ms >= m.start_ms + 30) AS nxt FROM m) WHERE nxt IS NOT NULL)
    SELECT song_id, part_id, start_ms, pitch FROM m JOIN tops USING (song_id, part_id, start_ms)""")
def _(t):
    n = t.notes.withColumn("start_ms", F.col("start_ms") + F.floor(F.col("start_ms") / 500) % 3 * 10)
    return SG.melody(n)


@query("M7_octaves", "notes", f"""WITH {_STATS} SELECT song_id, part_id, CAST(greatest(-3, least(3, round_even((57 - median_pitch) / 12.0::DOUBLE, 0))) AS INTEGER) AS octave,
    CAST(greatest(0, least(6, ceil(log2((110 - 1e-6::DOUBLE) / (440.0::DOUBLE * pow(2.0::DOUBLE, (low - 69) / 12.0::DOUBLE)))))) AS INTEGER) AS raise
    FROM wm JOIN (SELECT song_id, part_id, min(pitch) AS low FROM notes GROUP BY 1, 2) USING (song_id, part_id)""")
def _(t):
    low = t.notes.groupBy(*PART).agg(F.min("pitch").alias("low"))
    return SG.weighted_median(t.notes).join(low, PART).select(
        *PART, SG.auto_octave(F.col("median_pitch"), F.lit(57)).alias("octave"),
        SG.octaves_to_fit(F.col("low"), F.lit(110.0), F.lit(0)).alias("raise"))


@query("M7_fit_melody", "notes", """WITH l AS (SELECT song_id, part_id, start_ms, max(pitch) AS pitch FROM notes GROUP BY 1, 2, 3),
    s AS (SELECT *, row_number() OVER (PARTITION BY song_id, part_id ORDER BY start_ms) - 1 AS k, count(*) OVER (PARTITION BY song_id, part_id) AS n,
      quantile_cont(pitch, 0.5) OVER (PARTITION BY song_id, part_id) AS med FROM l)
    SELECT song_id, part_id, CAST(i AS BIGINT) AS i, pitch + round_even((60 - med) / 12, 0) * 12 AS pitch FROM s, (SELECT unnest(range(12)) AS i) WHERE i % n = k""")
def _(t):
    line = SG.melody(t.notes)
    wants = line.select(*PART).distinct().withColumns({"n": F.lit(12), "centre": F.lit(60.0)})
    return SG.fit_melody(line, wants)


@query("M8_describe_song", "notes tempo", f"""WITH {_ROLES},
    s AS (SELECT n.song_id, 70.0::DOUBLE + n.song_id % 100 AS bpm, CASE WHEN n.song_id % 2 = 0 THEN 'C major' ELSE 'A minor' END AS key, max(start_ms + dur_ms) AS dur FROM notes n GROUP BY 1),
    c AS (SELECT song_id, ['piano','chromatic percussion','organ','guitar','bass','strings','ensemble','brass','reed','pipe','synth lead','synth pad','synth effects','ethnic','percussive','sound effects'][program // 8 + 1] AS fam,
      count(*) AS n, min(part_id) AS first FROM roles WHERE drum_group IS NULL GROUP BY 1, 2),
    f AS (SELECT song_id, string_agg(CASE WHEN n = 1 THEN fam ELSE n || ' ' || fam || CASE WHEN ends_with(fam, 's') THEN '' ELSE 's' END END, ', ' ORDER BY n DESC, first) AS bits FROM c GROUP BY 1),
    d AS (SELECT song_id, count(drum_group) AS drums, bool_or(coalesce(program IN (29, 30), false)) AS heavy FROM roles GROUP BY 1)
    SELECT song_id, CASE WHEN bpm < 76 THEN 'Slow' WHEN bpm < 100 THEN 'Relaxed' WHEN bpm < 128 THEN 'Upbeat' WHEN bpm < 160 THEN 'Fast' ELSE 'Very fast' END || ' (' || CAST(bpm AS BIGINT) || ' BPM), ' || key || ', '
      || CASE WHEN ends_with(key, 'minor') THEN 'dark' ELSE 'bright' END || CASE WHEN heavy THEN ' and heavy' ELSE '' END || ', ' || (CAST(round_even(dur / 1000, 0) AS BIGINT) // 60) || ':'
      || lpad(CAST(CAST(round_even(dur / 1000, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' long: ' || concat_ws(', ', bits, CASE WHEN drums > 0 THEN drums || ' drum sound' || CASE WHEN drums > 1 THEN 's' ELSE '' END END) || '.' AS description
    FROM s LEFT JOIN f USING (song_id) LEFT JOIN d USING (song_id)""")
def _(t):
    s = t.notes.groupBy("song_id").agg(F.max(F.col("start_ms") + F.col("dur_ms")).alias("duration_ms")).withColumns({
        "bpm": F.lit(70.0) + F.col("song_id") % 100, "key": F.when(F.col("song_id") % 2 == 0, "C major").otherwise("A minor")})
    return SG.describe_song(s, roles(t))


@query("A15_song_library", "notes tempo", f"""WITH {_ROLES}, {_KEY.replace(_STATS + ',', '', 1)},
    t AS (SELECT * FROM tempo UNION ALL SELECT song_id, 0, 500000 FROM tempo GROUP BY 1 HAVING min(tick) > 0),
    sp AS (SELECT song_id, usec, tick, (coalesce(lead(tick) OVER (PARTITION BY song_id ORDER BY tick), greatest(9600, tick)) - tick) * usec AS sp FROM t),
    g AS (SELECT song_id, usec, sum(sp) AS time, min(tick) AS first FROM sp GROUP BY 1, 2),
    bp AS (SELECT song_id, usec FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY time DESC, first) AS r FROM g) WHERE r = 1)
    SELECT n.song_id, count(*) AS notes, max(start_ms + dur_ms) AS duration_ms, any_value(parts) AS parts, any_value(drums) AS drums,
      any_value(CAST(round_even(round(60e6::DOUBLE / usec, 6), 0) AS BIGINT)) AS bpm, any_value(key) AS key, any_value(tc) AS tempo_changes, n.song_id * 7 % 500 AS added FROM notes n
    JOIN (SELECT song_id, sum((drum_group IS NULL)::BIGINT)::BIGINT AS parts, sum((drum_group IS NOT NULL)::BIGINT)::BIGINT AS drums FROM roles GROUP BY 1) r ON r.song_id = n.song_id
    LEFT JOIN keys k ON k.song_id = n.song_id LEFT JOIN bp ON bp.song_id = n.song_id
    LEFT JOIN (SELECT song_id, greatest(0, count(DISTINCT (tick, usec)) - 1) AS tc FROM tempo GROUP BY 1) c ON c.song_id = n.song_id GROUP BY n.song_id""")
def _(t):
    added = t.notes.select("song_id").distinct().withColumn("added", F.col("song_id") * 7 % 500)
    return SG.song_library(t.notes, roles(t), bpm(t), keys(t), t.tempo, added)


@query("J10_notes_in_range", "notes", """WITH v AS (SELECT DISTINCT song_id * 10 + k AS view_id, song_id, (song_id * 37 + k * 9000) % 27000 AS from_ms, (song_id * 37 + k * 9000) % 27000 + 3000 AS to_ms
      FROM notes, (SELECT unnest(range(3)) AS k)) SELECT view_id, note_id FROM v JOIN notes n ON n.song_id = v.song_id AND start_ms < to_ms AND start_ms + dur_ms >= from_ms""")
def _(t):
    v = t.notes.select("song_id").distinct().select("song_id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    lo = (F.col("song_id") * 37 + F.col("k") * 9000) % 27000
    v = v.select((F.col("song_id") * 10 + F.col("k")).alias("view_id"), "song_id", lo.alias("from_ms"), (lo + 3000).alias("to_ms"))
    return SG.notes_in_range(t.notes, v).select("view_id", "note_id")


@query("R8_stride_sample", "notes", """WITH s AS (SELECT song_id, part_id, note_id, row_number() OVER (PARTITION BY song_id, part_id ORDER BY start_ms, note_id) - 1 AS k,
    CAST(ceil(count(*) OVER (PARTITION BY song_id, part_id) / 8) AS BIGINT) AS step FROM notes) SELECT song_id, part_id, note_id FROM s WHERE k % step = 0""")
def _(t):
    return TK.stride_sample(t.notes, 8, O.bucket("start_ms", 60_000)).select(*PART, "note_id")


_LUFS = "(-0.691::DOUBLE + 10 * log10(greatest({}, 1e-20::DOUBLE)))"
_GATED = f"""loud AS (SELECT * FROM blocks WHERE {_LUFS.format('power')} > -70), gate AS (SELECT song_id, part_id, avg(power) AS mean FROM loud GROUP BY 1, 2),
    gated AS (SELECT gate.song_id, gate.part_id, {_LUFS.format('coalesce(k, mean)')} AS lufs FROM gate LEFT JOIN (SELECT song_id, part_id, avg(power) AS k FROM loud JOIN gate USING (song_id, part_id)
      WHERE {_LUFS.format('power')} > {_LUFS.format('mean')} - 10 GROUP BY 1, 2) f ON f.song_id = gate.song_id AND f.part_id = gate.part_id)"""
_ROLE = "['lead','bass','chords','rhythm','drums:kick','drums:snare','drums:hats','drums:toms','drums:cymbals','drums:perc'][role_id + 1]"
_SHARE = _GATED + f""", onb AS (SELECT b.*, {_ROLE} AS role FROM blocks b JOIN gated g ON g.song_id = b.song_id AND g.part_id = b.part_id WHERE power > pow(10::DOUBLE, (lufs + 0.691::DOUBLE - 20) / 10)),
    cnt AS (SELECT song_id, role, block, count(*) AS n FROM onb GROUP BY 1, 2, 3),
    share AS (SELECT g.song_id, g.part_id, coalesce(s, 1) AS share FROM gated g LEFT JOIN (SELECT song_id, part_id, avg(1.0::DOUBLE / n) AS s FROM onb JOIN cnt USING (song_id, role, block) GROUP BY 1, 2) m
      ON m.song_id = g.song_id AND m.part_id = g.part_id)"""
_TARGET = "CASE role WHEN 'lead' THEN 0.0 WHEN 'bass' THEN -2.9 WHEN 'chords' THEN -3.4 WHEN 'rhythm' THEN -5.1 WHEN 'drums:kick' THEN -4.0 WHEN 'drums:snare' THEN -10.7 WHEN 'drums:hats' THEN -23.1 WHEN 'drums:toms' THEN -4.0 WHEN 'drums:cymbals' THEN -25.8 WHEN 'drums:perc' THEN -26.3 ELSE -5.1 END::DOUBLE"
_REF = _SHARE + f""", pr AS (SELECT DISTINCT song_id, part_id, {_ROLE} AS role FROM blocks),
    imp AS (SELECT pr.*, lufs, share, lufs - ({_TARGET}) - 10 * log10(share) AS implied FROM pr JOIN gated USING (song_id, part_id) JOIN share USING (song_id, part_id)),
    ref AS (SELECT song_id, CASE WHEN l IS NULL THEN e ELSE least(l, e + 3) END AS reference FROM (SELECT song_id, quantile_cont(implied, 0.5) AS e, quantile_cont(CASE WHEN role = 'lead' THEN implied END, 0.5) AS l FROM imp GROUP BY 1))"""


def roled(t):
    names = F.array(*[F.lit(n) for n in LD.ROLE_TARGETS])
    return t.blocks.withColumn("role", F.get(names, F.col("role_id").cast("int")))


def measured(t):
    b = roled(t)
    loud = LD.gated_loudness(b)
    return b.select(*PART, "role").distinct().join(loud, PART).join(LD.role_share(b, loud), PART)


@query("A16_gated_loudness", "blocks", f"WITH {_GATED} SELECT song_id, part_id, round(lufs, 6) AS lufs FROM gated")
def _(t):
    return LD.gated_loudness(t.blocks).withColumn("lufs", F.round("lufs", 6))


@query("A17_role_share", "blocks", f"WITH {_SHARE} SELECT song_id, part_id, round(share, 6) AS share FROM share")
def _(t):
    b = roled(t)
    return LD.role_share(b, LD.gated_loudness(b)).withColumn("share", F.round("share", 6))


@query("A18_reference_level", "blocks", f"WITH {_REF} SELECT song_id, round(reference, 6) AS reference FROM ref")
def _(t):
    return LD.reference_level(measured(t)).withColumn("reference", F.round("reference", 6))


@query("M12_ride_gain", "blocks", f"""WITH {_GATED}, st AS (SELECT song_id, part_id, block, {_LUFS.format('avg(power) OVER (PARTITION BY song_id, part_id ORDER BY block ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)')} AS st FROM blocks),
    u AS (SELECT song_id, part_id, quantile_cont(st, 0.5) AS usual FROM st JOIN gated USING (song_id, part_id) WHERE st > lufs - 20 GROUP BY 1, 2)
    SELECT song_id, part_id, block, round(pow(10::DOUBLE, -least(12, greatest(st - (coalesce(usual, lufs) + 2), 0) * 0.75::DOUBLE) / 20), 6) AS gain
    FROM st JOIN gated USING (song_id, part_id) LEFT JOIN u USING (song_id, part_id)""")
def _(t):
    return LD.ride_gain(t.blocks).withColumn("gain", F.round("gain", 6))


@query("M13_balance_gain", "blocks", f"""WITH {_REF}, e AS (SELECT song_id, part_id, reference + ({_TARGET}) + 10 * log10(share) - lufs AS err FROM imp JOIN ref USING (song_id))
    SELECT song_id, part_id, round(pow(10::DOUBLE, greatest(-12, least(12, CASE WHEN err < 0 THEN -greatest(0, -err - 1.5::DOUBLE) ELSE greatest(0, err - 3) * 0.6::DOUBLE END)) / 20), 6) AS gain FROM e""")
def _(t):
    m = measured(t)
    g = LD.gain_for(F.col("lufs"), F.col("role"), F.lit(0.0), F.col("reference"), F.col("share"))
    return m.join(LD.reference_level(m), "song_id").select(*PART, F.round(g, 6).alias("gain"))
