"""Queries over the clip index and the column functions (C*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordclips.functions import music as MU
from wordclips.functions import phones as PH
from wordclips.functions import text as TX
from wordclips.operators import index as IX
from wordclips.operators import splice as SP
from wordclips.plans.catalog import query


@query("C1_build_index", "idx", """SELECT source_id, clip_id, word, idx, start_ms, end_ms, prev_end, next_start, gap_after FROM idx""")
def _(t):
    return t.index.select("source_id", "clip_id", "word", "idx", "start_ms", "end_ms", "prev_end",
                          "next_start", "gap_after")


@query("C2_source_quality", "quality", """SELECT source_id, n_clips, n_good, round(quality, 6) AS quality FROM quality""")
def _(t):
    return t.quality.withColumn("quality", F.round("quality", 6))


@query("C3_bleed_risk", "bleed", """SELECT source_id, clip_id, bleed_risk FROM bleed""")
def _(t):
    return t.index_bleed.select("source_id", "clip_id", "bleed_risk")


@query("C4_idle_regions", "idx", """SELECT source_id, clip_id, end_ms + 60 AS start_ms, next_start - 60 AS end_ms
    FROM idx WHERE gap_after >= 450 AND next_start - end_ms - 120 >= 400""")
def _(t):
    return IX.idle_regions(t.index, 400)


@query("C5_word_positions", "idx", "SELECT word, source_id, idx FROM idx")
def _(t):
    return IX.positions(t.index)


@query("C5_usable_takes", "idx", "SELECT word, source_id, clip_id, idx FROM idx WHERE end_ms - start_ms >= 50")
def _(t):
    return IX.usable_takes(t.index).select("word", "source_id", "clip_id", "idx")


@query("C5_vocabulary", "vocab", "SELECT word, n FROM vocab")
def _(t):
    return IX.vocabulary(t.clips.where(F.col("end_ms") > F.col("start_ms")))


@query("C6_transcript_gaps", "clips sources", """
    WITH seq AS (SELECT source_id, start_ms, end_ms, lead(start_ms) OVER w AS nxt, clip_id,
                   row_number() OVER w AS r FROM clips WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, clip_id)),
    gaps AS (
      SELECT source_id, end_ms + 20 AS start_ms, nxt - 20 AS end_ms FROM seq WHERE nxt IS NOT NULL
      UNION ALL SELECT source_id, 0, start_ms - 20 FROM seq WHERE r = 1
      UNION ALL SELECT source_id, end_ms + 20, duration_ms FROM seq JOIN sources USING (source_id) WHERE nxt IS NULL)
    SELECT * FROM gaps WHERE end_ms - start_ms >= 140""")
def _(t):
    return IX.transcript_gaps(t.clips, t.sources.select("source_id", "duration_ms"))


@query("P1_clean_word", "", r"""SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) AS w,
    lower(regexp_replace(text, '[^\p{L}\p{N}_'']', '', 'g')) AS w_apostrophe FROM documents""")
def _(t):
    return t.read("documents").select("doc_id", TX.clean_word("text").alias("w"),
                                      TX.clean_word("text", True).alias("w_apostrophe"))


@query("P2_ascii_fold", "vocab", r"""SELECT word, regexp_replace(translate(word,
    'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY'),
    '[^\x00-\x7F]', '', 'g') AS folded FROM vocab""")
def _(t):
    return IX.vocabulary(t.index).select("word", TX.ascii_fold("word").alias("folded"))


@query("P2_norm_tokens", "", r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'),
    lambda t: lower(regexp_replace(t, '[^\p{L}\p{N}_]', '', 'g'))), lambda w: w <> '') AS tokens FROM documents""")
def _(t):
    return t.read("documents").select("doc_id", TX.norm_tokens("text").alias("tokens"))


@query("P3_tokenize", "tokens", "SELECT text_id, pos, word, ends FROM tokens")
def _(t):
    return t.tokens


@query("P7_duration_floor", "vocab lexicon", """SELECT word,
    CAST(CASE WHEN phones IS NOT NULL THEN len(phones) * 45 ELSE greatest(80, length(word) * 25) END AS BIGINT) AS floor_ms,
    CAST(len(phones) * 50 + CASE WHEN len(list_filter(phones, lambda p: p IN ('AA','AE','AH','EH','IH','IY'))) > 0
        THEN 50 ELSE 0 END AS BIGINT) AS splice_floor_ms FROM vocab LEFT JOIN lexicon USING (word)""")
def _(t):
    v = IX.vocabulary(t.index).join(t.lexicon, "word", "left")
    return v.select("word", TX.duration_floor_ms("word", F.size("phones")).alias("floor_ms"),
                    F.when(F.col("phones").isNotNull(), TX.splice_floor_ms(
                        F.size("phones"), F.exists("phones", PH.is_vowel))).alias("splice_floor_ms"))


@query("P8_vote_weight", "ratings reports", """
    WITH n AS (SELECT clip_id, sum(count) AS reports FROM reports GROUP BY 1)
    SELECT word, clip_id, score, round(CASE WHEN score = 0 THEN 1 ELSE least(8, greatest(0.02, pow(2.0, score))) END, 6) AS weight,
      score <= -2 AS vetoed, round(pow(0.2, coalesce(reports, 0)), 9) AS report_weight FROM ratings LEFT JOIN n USING (clip_id)""")
def _(t):
    n = t.reports.groupBy("clip_id").agg(F.sum("count").alias("reports"))
    return t.ratings.join(n, "clip_id", "left").select(
        "word", "clip_id", "score", F.round(TX.vote_weight("score"), 6).alias("weight"),
        TX.vetoed("score").alias("vetoed"), F.round(TX.report_weight("reports"), 9).alias("report_weight"))


@query("P9_edge_weight", "idx", """SELECT clip_id, CAST(CASE WHEN next_start IS NULL OR next_start - end_ms >= 100 THEN 60 ELSE 1 END
    * CASE WHEN prev_end IS NULL OR start_ms - prev_end >= 60 THEN 10 ELSE 1 END AS DOUBLE) AS weight FROM idx""")
def _(t):
    return t.index.select("clip_id", TX.edge_weight().alias("weight"))


@query("P10_extract_window", "bleed", """
    WITH a AS (SELECT *, greatest(0, least(start_ms, greatest(start_ms - CASE WHEN edited = 1 THEN 0 ELSE 50 END,
        coalesce(prev_end + 50, -1000000)))) AS b,
      CASE WHEN edited = 1 THEN end_ms ELSE end_ms + CASE WHEN next_start IS NULL THEN 450 ELSE 180 END END AS w0 FROM bleed),
    c AS (SELECT *, CASE WHEN next_start IS NULL THEN w0 ELSE
        least(w0, greatest(end_ms, next_start - CASE WHEN bleed_risk THEN 160 ELSE 50 END)) END AS w FROM a)
    SELECT clip_id, CAST(b AS BIGINT) AS cut_start, CAST(greatest(w, CASE WHEN edited = 1 OR coalesce(next_start <= end_ms + 1, false)
        THEN end_ms ELSE greatest(end_ms, b + 50) END) AS BIGINT) AS cut_end FROM c""")
def _(t):
    cut = TX.extract_window(F.col("next_start").isNull())
    return t.index_bleed.select("clip_id", cut.alias("c")).select(
        "clip_id", F.col("c.start_ms").alias("cut_start"), F.col("c.end_ms").alias("cut_end"))


@query("P11_phone_class", "aligned", """
    WITH p AS (SELECT clip_id, unnest(phones) AS u FROM aligned WHERE phones IS NOT NULL),
    k AS (SELECT u.phone AS phone, u.end_ms - u.start_ms AS dur,
      CASE WHEN u.phone IN ('AA','AE','AH','EH','IH','IY') THEN 'vowel' WHEN u.phone IN ('F','HH','S','V','Z') THEN 'fricative'
           WHEN u.phone IN ('B','D','G','JH','K','P','T') THEN 'plosive' ELSE 'other' END AS kind FROM p)
    SELECT phone, kind, count(*) AS n, CAST(sum(CASE
      WHEN kind = 'vowel' AND dur BETWEEN 70 AND 600 OR kind = 'fricative' AND dur BETWEEN 50 AND 400
        OR kind = 'plosive' AND dur BETWEEN 30 AND 200 OR kind = 'other' AND dur BETWEEN 50 AND 350 THEN 1 ELSE 0 END) AS BIGINT) AS plausible
    FROM k GROUP BY 1, 2""")
def _(t):
    p = t.aligned.select(F.explode(SP.phones_of()).alias("u")).select(
        F.col("u.phone").alias("phone"), (F.col("u.end_ms") - F.col("u.start_ms")).alias("dur"))
    fits = F.col("dur").between(F.col("lo_ms"), F.col("hi_ms")).cast("bigint")
    return p.join(F.broadcast(PH.phone_dim(t.spark)), "phone").groupBy("phone", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(fits).alias("plausible"))


@query("P12_note_dims", "notes", """SELECT CASE WHEN channel = 9 THEN CASE WHEN pitch IN (35,36) THEN 'kick'
      WHEN pitch IN (31,37,38,39,40) THEN 'snare' WHEN pitch IN (42,44,46,54,69,70,82) THEN 'hats'
      WHEN pitch IN (41,43,45,47,48,50) OR pitch BETWEEN 60 AND 68 THEN 'toms'
      WHEN pitch IN (49,51,52,53,55,57,59) THEN 'cymbals' ELSE 'perc' END
    ELSE ['piano','chromatic percussion','organ','guitar','bass','strings','ensemble','brass','reed','pipe','synth lead',
      'synth pad','synth effects','ethnic','percussive','sound effects'][velocity // 8 + 1] END AS label, count(*) AS n
    FROM notes GROUP BY 1""")
def _(t):
    n = t.notes.withColumn("program", F.col("velocity")).join(
        F.broadcast(MU.program_dim(t.spark)), "program", "left")
    label = F.when(F.col("channel") == MU.DRUM_CHANNEL, MU.drum_group(F.col("pitch"))).otherwise(F.col("family"))
    return n.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("P13_pitch_conversions", "notes", """SELECT pitch, round(440.0 * pow(2.0, (pitch - 69) / 12.0), 6) AS hz,
    round(69 + 12 * log2(440.0 * pow(2.0, (pitch - 69) / 12.0) / 440.0), 6) AS midi,
    ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][pitch % 12 + 1] || CAST(pitch // 12 - 1 AS VARCHAR) AS name, count(*) AS n
    FROM notes GROUP BY pitch""")
def _(t):
    p = F.col("pitch")
    return t.notes.groupBy("pitch").agg(F.count(F.lit(1)).alias("n")).select(
        "pitch", F.round(MU.midi_to_hz(p), 6).alias("hz"),
        F.round(MU.hz_to_midi(MU.midi_to_hz(p)), 6).alias("midi"), MU.note_name(p).alias("name"), "n")


@query("P14_clamp", "", """SELECT event_id, least(40.0, greatest(2.0, coalesce(
    TRY_CAST(CASE WHEN event_type = 'error' THEN 'NaN-' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 10.0))) AS v FROM events""")
def _(t):
    given = F.when(F.col("event_type") == "error", F.lit("NaN-")).otherwise(F.col("value").cast("string"))
    return t.read("events").select("event_id", TX.clamp(given, 2.0, 40.0, 10.0).alias("v"))


@query("P15_norm_title", "", r"""
    WITH a AS (SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages),
    b AS (SELECT page_id, title, regexp_replace(split_part(title, '|', 1), '\s[-–]\s(.|\n)*$', '') AS t FROM a),
    c AS (SELECT page_id, title, regexp_replace(regexp_replace(lower(t), '\(.*?\)', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g') AS t FROM b)
    SELECT page_id, title, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(t), ' +'),
      lambda w: CASE w WHEN 'one' THEN '1' WHEN 'two' THEN '2' WHEN 'three' THEN '3' WHEN 'four' THEN '4' WHEN 'five' THEN '5' ELSE w END),
      lambda w: w <> '' AND w NOT IN ('the','a','poem','kids','poems','stories','with')), ' ') AS norm FROM c""")
def _(t):
    p = t.read("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", "title", TX.norm_title("title").alias("norm"))
