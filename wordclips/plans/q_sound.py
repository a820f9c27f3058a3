"""Queries on tone, sounds, frames and the timeline (A8, A9, Z*, M9-M11, R10, N*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordclips.operators import frames as FR
from wordclips.operators import index as IX
from wordclips.operators import sounds as SN
from wordclips.operators import splice as SP
from wordclips.operators import tone as TN
from wordclips.plans.catalog import query
from wordclips.plans.q_songs import roles

_F = TN.FEATURES
_SRC = {f: ("pitch" if f in ("pitch_start", "pitch_end") else f) for f in _F}
_SC = {f: (f"ln(greatest({f}, 1e-3::DOUBLE))" if f == "pace" else f) for f in _F}
_STAT = "st AS (SELECT " + ", ".join(
    f"avg({_SC[_SRC[f]]}) AS {f}_mean, greatest(stddev_pop({_SC[_SRC[f]]}), 1e-6::DOUBLE) AS {f}_std" for f in _F) + " FROM feats)"
_FEATS = "feats AS (SELECT clip_id, label, CASE WHEN clip_id % 11 = 0 THEN NULL ELSE pitch END AS pitch, pitch_start, pitch_end, movement, loudness, pace, brightness FROM features)"
_Z = "z AS (SELECT clip_id, label, " + ", ".join(
    f"CASE WHEN {f} IS NOT NULL THEN greatest(-3, least(3, ({_SC[f]} - {f}_mean) / {f}_std)) END AS {f}" for f in _F) + " FROM feats, st)"


def feats(t):
    return t.features.withColumn("pitch", F.when(F.col("clip_id") % 11 != 0, F.col("pitch")))


def standard(t):
    return TN.standardise(feats(t), TN.tone_stats(feats(t)))


@query("A8_tone_stats", "features", f"WITH {_FEATS}, {_STAT} SELECT " + ", ".join(f"round({f}_{s}, 6) AS {f}_{s}" for f in _F for s in ("mean", "std")) + " FROM st")
def _(t):
    return TN.tone_stats(feats(t)).select(*[F.round(f"{f}_{s}", 6).alias(f"{f}_{s}") for f in _F for s in ("mean", "std")])


@query("Z1_standardise", "features", f"WITH {_FEATS}, {_STAT}, {_Z} SELECT clip_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in _F) + " FROM z")
def _(t):
    return standard(t).select("clip_id", *[F.round(f, 6).alias(f) for f in _F])


@query("Z2_categorise")
def _(t):
    return TN.categorise(standard(t)).groupBy("category").agg(F.count(F.lit(1)).alias("size"))


_CEN = ", ".join(f"avg(coalesce({f}, 0)) * 8 AS c_{f}" for f in TN.SHAPE)
_NAMED = ",".join(f"{{'a': abs(c_{f}), 'w': CASE WHEN c_{f} > 0 THEN '{TN.FEATURE_WORDS[f][0]}' ELSE '{TN.FEATURE_WORDS[f][1]}' END}}" for f in TN.SHAPE)


@query("Z3_name_category", "features", f"""WITH {_FEATS}, {_STAT}, {_Z}, c AS (SELECT label, {_CEN} FROM z GROUP BY 1)
    SELECT label, coalesce(nullif(array_to_string(list_transform(list_sort(list_filter([{_NAMED}], lambda p: p.a >= 0.5), 'DESC')[1:3], lambda p: p.w), ', '), ''), 'even') AS name FROM c""")
def _(t):
    c = standard(t).groupBy("label").agg(*[(F.avg(F.coalesce(f, F.lit(0.0))) * 8).alias(f"c_{f}") for f in TN.SHAPE])
    return c.select("label", TN.name_category({f: F.col(f"c_{f}") for f in TN.SHAPE}).alias("name"))


def toned_takes(t):
    return t.index.where(F.col("end_ms") - F.col("start_ms") >= 50).select(
        "word", "clip_id", "source_id", (F.col("clip_id") % 5).alias("category"))


@query("Z4_target_category", "idx tokens", """
    WITH per AS (SELECT word, clip_id % 5 AS category, count(*) AS n FROM idx WHERE end_ms - start_ms >= 50 GROUP BY 1, 2),
    g AS (SELECT text_id AS sentence_id, category, count(*) AS covers, CAST(sum(n) AS BIGINT) AS takes FROM (SELECT DISTINCT text_id, pos, word FROM tokens) JOIN per USING (word) GROUP BY 1, 2)
    SELECT sentence_id, category, covers, takes FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY covers DESC, takes DESC, category) AS r FROM g) WHERE r = 1""")
def target(t):
    return TN.target_category(t.tokens.withColumnRenamed("text_id", "sentence_id"), toned_takes(t))


_W = """d AS (SELECT a.clip_id, b.label = 3 AS same_cat, a.label = b.label AS same_src, a.pitch_end - b.pitch_start AS p, a.loudness - b.loudness AS l, a.brightness - b.brightness AS r
      FROM z a JOIN z b ON b.clip_id = a.clip_id + 1)"""


@query("Z5_tone_weight", "features", f"""WITH {_FEATS}, {_STAT}, {_Z}, {_W} SELECT clip_id,
    round(CASE WHEN same_cat THEN 10 ELSE 1 END * CASE WHEN same_src THEN sqrt(20) ELSE 1 END * exp(-0.5::DOUBLE * (p * p + l * l + r * r) / 3 / (2 * 0.35::DOUBLE * 0.35::DOUBLE)), 6) AS weight FROM d""")
def _(t):
    z = standard(t).select("clip_id", F.struct(F.col("label").alias("source_id"), F.col("label").alias("category"), *_F).alias("t"))
    nxt = z.select((F.col("clip_id") - 1).alias("clip_id"), F.col("t").alias("c"))
    return z.join(nxt, "clip_id").select("clip_id", F.round(TN.tone_weight(0.5, F.lit(3), F.col("t"), F.col("c")), 6).alias("weight"))


@query("Z6_pick_sentence")
def _(t):
    x = F.col("clip_id")
    takes = toned_takes(t).select("*", ((x % 7) / 3.0).alias("pitch_start"), ((x % 6) / 3.0).alias("pitch_end"),
                                  ((x % 4) / 2.0).alias("loudness"), ((x % 3) / 2.0).alias("brightness"), (F.lit(1.0) + x % 13).alias("pick_weight"))
    words = t.tokens.select(F.col("text_id").alias("sentence_id"), "pos", "word")
    return TN.pick_sentence(words, takes, target(t))


def voiced_frames(t):
    k = F.col("rms")
    return t.frames.select("source_id", "part", "t_ms", k.cast("double").alias("rms"), F.when(k % 180 != 20, 100.0 + k % 7 * 20).alias("f0"),
                           ((k % 11) / 11.0).alias("bright")).groupBy("source_id", "part", "t_ms").agg(
        F.min("rms").alias("rms"), F.min("f0").alias("f0"), F.min("bright").alias("bright"))


@query("A9_tone_features", "frames clips", """
    WITH f AS (SELECT source_id, t_ms, min(rms)::DOUBLE AS rms, min(CASE WHEN rms % 180 <> 20 THEN 100.0::DOUBLE + rms % 7 * 20 END) AS f0, min((rms % 11) / 11.0::DOUBLE) AS bright FROM frames GROUP BY 1, 2),
    j AS (SELECT c.source_id, c.clip_id, length(word) AS n, end_ms - start_ms AS dur, t_ms, rms, f0, bright, 69 + 12 * log2(f0 / 440) AS s FROM clips c JOIN f ON f.source_id = c.source_id AND t_ms BETWEEN start_ms AND end_ms WHERE end_ms > start_ms),
    v AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms) AS a, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms DESC) AS z FROM j WHERE f0 IS NOT NULL),
    p AS (SELECT clip_id, quantile_cont(s, 0.5) AS pitch, quantile_cont(CASE WHEN a <= 4 THEN s END, 0.5) AS pitch_start, quantile_cont(CASE WHEN z <= 4 THEN s END, 0.5) AS pitch_end, stddev_pop(s) AS movement
      FROM v GROUP BY 1 HAVING count(*) >= 3),
    ref AS (SELECT source_id, 20 * log10(coalesce(quantile_cont(CASE WHEN f0 IS NOT NULL THEN rms END, 0.5), quantile_cont(rms, 0.5)) + 1e-9::DOUBLE) AS ref_db FROM f GROUP BY 1),
    g AS (SELECT source_id, clip_id, sqrt(avg(rms * rms)) AS rms, avg(bright) AS bright, max(dur / 1000.0::DOUBLE / greatest(1, n)) AS pace FROM j GROUP BY 1, 2)
    SELECT clip_id, round(pitch, 6) AS pitch, round(pitch_start, 6) AS pitch_start, round(pitch_end, 6) AS pitch_end, round(movement, 6) AS movement,
      round(20 * log10(rms + 1e-9::DOUBLE) - ref_db, 6) AS loudness, round(pace, 6) AS pace, round(10 * log10(bright + 1e-9::DOUBLE), 6) AS brightness FROM g JOIN ref USING (source_id) LEFT JOIN p USING (clip_id)""")
def _(t):
    c = t.clips.where(F.col("end_ms") > F.col("start_ms")).withColumn("n_phones", F.length("word"))
    return TN.tone_features(voiced_frames(t), c).select("clip_id", *[F.round(f, 6).alias(f) for f in _F])


# --- sounds ---------------------------------------------------------------------

def measures(t):
    """Measured sounds: one per vector, named after a common word, sound or noise."""
    e = t.read("embeddings")
    x = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    names = F.array(*[F.lit(n) for n in ("/ah/", "/k/", "/s/", "*click*", "*spew*", "the", "and", "/d/", "no", "/b/")])
    return e.select(F.get(names, F.col("label")).alias("name"), F.col("vec_id").alias("take"), (x(0) * 3).alias("dur"),
                    F.when(F.col("vec_id") % 4 != 0, x(1) * 1000 + 60).alias("f0"), F.least(F.lit(1.0), x(2) * 4).alias("voiced"),
                    (x(3) * 600).alias("stability"), (x(4) / 8).alias("attack"), (x(5) * 20000).alias("centroid"),
                    F.least(F.lit(1.0), x(6) * 4).alias("hf"), F.least(F.lit(1.0), x(7) * 4).alias("lf"), (x(8) * 30).alias("crest"))


def _b(v, lo, hi, soft):
    return f"CASE WHEN {v} BETWEEN {lo} AND {hi} THEN 1.0::DOUBLE ELSE greatest(0, 1 - CASE WHEN {v} < {lo} THEN {lo} - {v} ELSE {v} - {hi} END / {soft}::DOUBLE) END"


_M = """m AS (SELECT ['/ah/','/k/','/s/','*click*','*spew*','the','and','/d/','no','/b/'][label + 1] AS name, vec_id AS take, abs(embedding[1]::DOUBLE) * 3 AS dur,
      CASE WHEN vec_id % 4 <> 0 THEN abs(embedding[2]::DOUBLE) * 1000 + 60 END AS f0, least(1, abs(embedding[3]::DOUBLE) * 4) AS voiced, abs(embedding[4]::DOUBLE) * 600 AS stability,
      abs(embedding[5]::DOUBLE) / 8 AS attack, abs(embedding[6]::DOUBLE) * 20000 AS centroid, least(1, abs(embedding[7]::DOUBLE) * 4) AS hf, least(1, abs(embedding[8]::DOUBLE) * 4) AS lf,
      abs(embedding[9]::DOUBLE) * 30 AS crest FROM embeddings)"""
_SH, _PU = _b("attack", 0.0, "0.015::DOUBLE", 0.05), _b("crest", "2.4::DOUBLE", 8.0, 0.8)
_SCORE = f"""CASE role WHEN 'drums:kick' THEN 2.5 * ({_b('lf', '0.45::DOUBLE', 1.0, 0.35)}) + 2 * ({_SH}) + ({_PU}) + 0.5 * ({_b('centroid', 0.0, 400.0, 500)})
    WHEN 'drums:snare' THEN 2 * ({_SH}) + 2 * ({_b('hf', '0.35::DOUBLE', 1.0, 0.3)}) + 1 - voiced + ({_PU})
    WHEN 'drums:hats' THEN 3 * hf + ({_b('centroid', 6000.0, 16000.0, 4000)}) + 0.5 * (1 - voiced) + 0.5 * ({_PU})
    WHEN 'drums:toms' THEN 1.5 * ({_b('lf', 0.25, '0.9::DOUBLE', 0.3)}) + 1.5 * ({_SH}) + voiced + 0.5 * ({_PU}) + ({_b('centroid', 0.0, 1200.0, 1000)})
    WHEN 'drums:cymbals' THEN 3 * hf + 1.5 * ({_b('dur', 0.25, '0.6::DOUBLE', 0.3)}) + 0.5 * (1 - voiced)
    WHEN 'drums:perc' THEN 2.5 * ({_SH}) + 1 - voiced + ({_PU})
    ELSE CASE WHEN f0 IS NULL THEN -5 ELSE 2.5 * voiced + 1.5 * greatest(0, 1 - stability / 150) + ({_b('dur', 0.25, '0.8::DOUBLE', 0.3)})
      + CASE WHEN role = 'bass' THEN 0.5 * ({_b('f0', 60.0, 150.0, 80)}) ELSE 0 END END END"""
_DIM = "dim(role, place, kind, name) AS (VALUES " + ",".join(
    [f"('{r}',{i},'unit','{u}')" for r in SN.PREFERRED for i, u in enumerate(SN.SOUNDS[r])]
    + [f"('{r}',{100 + i},'word','{w}')" for r in SN.PREFERRED for i, w in enumerate(SN.PREFERRED[r])]) + ")"
_CANDS = f"""{_DIM}, u AS (SELECT '/' || lower(phone) || '/' AS name FROM (SELECT unnest(phones).phone AS phone FROM aligned WHERE phones IS NOT NULL) GROUP BY phone HAVING count(*) >= 3),
    nz AS (SELECT '*' || word || '*' AS name, dense_rank() OVER (ORDER BY n DESC, word) AS r FROM (SELECT word, count(*) AS n FROM noises GROUP BY 1)),
    asked AS (SELECT DISTINCT role FROM dim),
    own AS (SELECT role, place, name FROM dim WHERE kind = 'word' AND name IN (SELECT word FROM vocab) UNION ALL SELECT role, place, name FROM dim WHERE kind = 'unit' AND name IN (SELECT name FROM u)
      UNION ALL SELECT role, CAST(r - 1000 AS INTEGER), name FROM asked, nz WHERE starts_with(role, 'drums')),
    few AS (SELECT role FROM asked WHERE (SELECT count(*) FROM own WHERE own.role = asked.role) < 3),
    often AS (SELECT word AS name, row_number() OVER (ORDER BY n DESC, word) AS r FROM vocab WHERE regexp_full_match(word, '\\p{{L}}+') ORDER BY n DESC, word LIMIT 30),
    cands AS (SELECT * FROM own UNION ALL SELECT role, CAST(r + 1000 AS INTEGER), name FROM few, often WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.role = few.role AND own.name = often.name))"""


def all_roles(t):
    return SN.role_dim(t.spark).select("role").distinct()


def cands(t):
    units = SP.phone_intervals(t.aligned).groupBy("phone").agg(F.count(F.lit(1)).alias("n"))
    noises = t.noises.groupBy(F.col("word").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return SN.candidates(all_roles(t), IX.vocabulary(t.index), units, noises)


@query("M10_candidates", "vocab aligned noises", f"WITH {_CANDS} SELECT role, place, name FROM cands")
def _(t):
    return cands(t)


@query("M9_score_sounds", "", f"WITH {_DIM}, {_M}, r AS (SELECT DISTINCT role FROM dim) SELECT role, name, take, round({_SCORE}, 6) AS score FROM r, m")
def _(t):
    each = all_roles(t).crossJoin(measures(t).select("name").distinct()).withColumn("place", F.lit(0))
    return SN.score_sounds(each, measures(t)).select("role", "name", "take", F.round("score", 6).alias("score"))


@query("R10_rank_sounds", "vocab aligned noises", f"""WITH {_CANDS}, {_M}, s AS (SELECT role, place, c.name, take, round({_SCORE}, 9) AS score FROM cands c JOIN m ON m.name = c.name),
    t AS (SELECT *, row_number() OVER (PARTITION BY role, name ORDER BY score DESC, take) AS r FROM s),
    g AS (SELECT role, name, place, score, take FROM t WHERE r = 1)
    SELECT role, name, take, row_number() OVER (PARTITION BY role ORDER BY score DESC, place, name) AS rank FROM g""")
def ranked(t):
    s = SN.score_sounds(cands(t), measures(t)).withColumn("score", F.round("score", 9))
    return SN.rank_sounds(s).select("role", "name", "take", "rank")


@query("M11_recommend")
def _(t):
    s = SN.score_sounds(cands(t), measures(t))
    return SN.recommend(roles(t).select("song_id", "part_id", "role", "median_pitch"), SN.rank_sounds(s))


# --- frames -----------------------------------------------------------------------

def gaps(t):
    g = IX.transcript_gaps(t.clips, t.sources.select("source_id", "duration_ms"))
    return g.withColumn("gap_id", F.col("start_ms"))


def gap_frames(t):
    """10 ms frames over every stretch without words."""
    g = gaps(t).groupBy("source_id", "start_ms").agg(F.max("end_ms").alias("end_ms"))
    n = F.floor((F.col("end_ms") - F.col("start_ms") - 1) / 10).cast("int")
    f = g.select("source_id", F.explode(F.sequence(F.lit(0), n)).alias("k"), "start_ms")
    at = F.col("start_ms") + F.col("k").cast("bigint") * 10
    return f.select("source_id", at.alias("t_ms")).distinct().select("source_id", "t_ms", (
        (F.col("source_id") * 31 + F.floor(F.col("t_ms") / 70) * 13 + F.col("t_ms") * 3) % 19 * 45).cast("double").alias("rms"))


_GAPS = """seq AS (SELECT source_id, start_ms, end_ms, lead(start_ms) OVER w AS nxt, row_number() OVER w AS r FROM clips WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, clip_id)),
    gaps AS (SELECT *, start_ms AS gap_id FROM (SELECT source_id, end_ms + 20 AS start_ms, nxt - 20 AS end_ms FROM seq WHERE nxt IS NOT NULL UNION ALL SELECT source_id, 0, start_ms - 20 FROM seq WHERE r = 1
      UNION ALL SELECT source_id, end_ms + 20, duration_ms FROM seq JOIN sources USING (source_id) WHERE nxt IS NULL) WHERE end_ms - start_ms >= 140),
    gf AS (SELECT source_id, t_ms, ((source_id * 31 + t_ms // 70 * 13 + t_ms * 3) % 19 * 45)::DOUBLE AS rms FROM (SELECT DISTINCT source_id, start_ms + k * 10 AS t_ms FROM
      (SELECT source_id, start_ms, unnest(range(0, (max(end_ms) - start_ms - 1) // 10 + 1)) AS k FROM gaps GROUP BY 1, 2)))"""


@query("N1_noise_bursts", "clips sources", f"""WITH {_GAPS},
    f AS (SELECT g.source_id, gap_id, g.start_ms AS gs, (t_ms - g.start_ms) // 10 AS k, t_ms, rms FROM gaps g JOIN gf ON gf.source_id = g.source_id AND t_ms >= g.start_ms AND t_ms < g.end_ms),
    e AS (SELECT *, max(rms) OVER p AS top, max(k) OVER p + 1 AS n FROM f WINDOW p AS (PARTITION BY source_id, gap_id)),
    h AS (SELECT *, greatest(330, top * 0.3::DOUBLE) AS thr FROM e WHERE top >= 550),
    i AS (SELECT *, sum((rms < thr * 0.6::DOUBLE)::INT) OVER (PARTITION BY source_id, gap_id ORDER BY t_ms) AS br FROM h),
    b AS (SELECT source_id, gap_id, gs, n, min(CASE WHEN rms >= thr THEN k END) AS i, max(k) + 1 AS j, max(rms) AS peak FROM i WHERE rms >= thr * 0.6::DOUBLE GROUP BY source_id, gap_id, gs, n, br),
    c AS (SELECT source_id, gap_id, gs + greatest(0, i - 1) * 10 AS start_ms, gs + least(n, j + 1) * 10 AS end_ms, peak FROM b WHERE i IS NOT NULL)
    SELECT *, CASE WHEN end_ms - start_ms < 180 THEN 'click' ELSE 'spew' END AS kind FROM c WHERE peak >= 550 AND end_ms - start_ms >= 30""")
def _(t):
    return FR.noise_bursts(gap_frames(t), gaps(t))


@query("N2_quiet_frames", "frames", """WITH f AS (SELECT source_id, t_ms, min(rms)::DOUBLE AS db FROM frames GROUP BY 1, 2),
    q AS (SELECT source_id, quantile_cont(db, 0.05) AS a, quantile_cont(db, 0.95) AS b FROM f GROUP BY 1),
    s AS (SELECT f.source_id, t_ms, db < a + 0.25::DOUBLE * (b - a) AS quiet FROM f JOIN q ON q.source_id = f.source_id)
    SELECT source_id, count(*) AS frames, CAST(sum(quiet::INT) AS BIGINT) AS quiet, CAST(sum((quiet AND coalesce(nx, false))::INT) AS BIGINT) AS pauses
    FROM (SELECT *, lead(quiet) OVER (PARTITION BY source_id ORDER BY t_ms) AS nx FROM s) GROUP BY 1""")
def _(t):
    f = t.frames.groupBy("source_id", "part", "t_ms").agg(F.min("rms").cast("double").alias("db")).drop("part")
    return FR.quiet_frames(f).groupBy("source_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("quiet").cast("bigint")).alias("quiet"),
                                                       F.sum(F.col("pause").cast("bigint")).alias("pauses"))


@query("N3_quiet_idle", "idx clips sources", f"""WITH {_GAPS}, r AS (SELECT source_id, clip_id, end_ms + 60 AS start_ms, next_start - 60 AS end_ms FROM idx WHERE gap_after >= 450)
    SELECT r.source_id, clip_id, r.start_ms, r.end_ms, round(sqrt(avg(rms * rms)), 6) AS level FROM r JOIN gf ON gf.source_id = r.source_id AND t_ms >= r.start_ms AND t_ms < r.end_ms
    GROUP BY 1, 2, 3, 4 HAVING sqrt(avg(rms * rms)) <= 470""")
def _(t):
    return FR.quiet_idle(IX.idle_regions(t.index), gap_frames(t), 470.0).withColumn("level", F.round("level", 6))


@query("N4_timeline", "idx", """WITH s AS (SELECT source_id AS text_id, idx AS seg, idx // 2 AS tok, (end_ms - start_ms) / 1000.0::DOUBLE * (1 + (tok % 3) * 0.1::DOUBLE) AS snd,
      CASE WHEN tok % 9 = 0 THEN 200 ELSE 0 END / 1000.0::DOUBLE AS pause, tok % 11 = 0 AS sub FROM idx),
    d AS (SELECT *, snd / 1.25::DOUBLE AS len, CASE WHEN sub THEN (snd + pause) / 1.25::DOUBLE ELSE round_even((snd + pause) / 1.25::DOUBLE * 25, 0) / 25 END AS total FROM s),
    a AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY text_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM d)
    SELECT text_id, tok, round(min(beg), 3) AS start_s, round(arg_max(beg + len, seg), 3) AS end_s FROM a GROUP BY 1, 2""")
def _(t):
    s = t.index.select(F.col("source_id").alias("text_id"), F.col("idx").alias("seg"), F.floor(F.col("idx") / 2).alias("w"), F.col("start_ms").alias("from_ms"),
                       F.col("end_ms").alias("to_ms"), (1 + (F.col("tok") % 3) * 0.1).alias("stretch"), F.when(F.col("tok") % 9 == 0, 200).otherwise(0).alias("pause_ms"),
                       (F.col("tok") % 11 == 0).alias("subword")).withColumnRenamed("w", "tok")
    return FR.timeline(s, 1.25)
