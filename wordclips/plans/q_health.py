"""Queries on corpus health, feedback, captions and jobs (J*, A*, U*, W3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordclips.operators import captions as CA
from wordclips.operators import diagnostics as D
from wordclips.operators import feedback as FB
from wordclips.operators import jobs as JB
from wordclips.operators import takes as TK
from wordclips.plans.catalog import query
from wordclips.plans.tables import PLACES

_OUTSIDE = """coalesce(list_min(list_transform(phones, lambda p: p.start_ms)) < -60
    OR list_max(list_transform(phones, lambda p: p.end_ms)) > end_ms - start_ms + 60, false)"""


def files(t):
    """Files on disk: one per source, and some nobody indexed."""
    s = t.sources.select("source_id", "source_file")
    extra = s.where(F.col("source_id") % 13 == 0).select(F.concat("source_file", F.lit(".part")).alias("source_file"))
    return s.select("source_file").unionByName(extra)


_FILES = """files AS (SELECT source_file FROM sources UNION ALL
    SELECT source_file || '.part' FROM sources WHERE source_id % 13 = 0)"""


def tone_rows(t):
    """Clips with a measured tone, and some whose clip is gone."""
    c = t.clips.where(F.col("tok") % 3 == 0).select("clip_id")
    return c.unionByName(t.clips.where(F.col("tok") % 50 == 0).select((-F.col("clip_id") - 1).alias("clip_id")))


_TONE = """tone AS (SELECT clip_id FROM clips WHERE tok % 3 = 0 UNION ALL
    SELECT -clip_id - 1 FROM clips WHERE tok % 50 = 0)"""


@query("J1_source_summary", "sources clips", """SELECT s.source_id, video_id, count(c.clip_id) AS clips, min(start_ms) AS first_ms,
    max(end_ms) AS last_ms FROM sources s LEFT JOIN (SELECT * FROM clips WHERE corpus <> 'de') c ON c.source_id = s.source_id GROUP BY 1, 2""")
def _(t):
    return D.source_summary(t.sources, t.clips.where(F.col("corpus") != "de"))


@query("J2_reported_clips", "clips reports", """SELECT clip_id, source_id, word, start_ms, end_ms,
    string_agg(kind || ':' || count, ', ' ORDER BY kind || ':' || count) AS reports FROM reports JOIN clips USING (clip_id) GROUP BY 1,2,3,4,5""")
def _(t):
    return D.reported_clips(t.clips, t.reports)


@query("J3_downvoted", "clips ratings", """SELECT r.clip_id, r.word AS target_word, score, source_id, c.word AS clip_word
    FROM ratings r LEFT JOIN (SELECT * FROM clips WHERE tok % 5 <> 0) c ON c.clip_id = r.clip_id WHERE score < 0""")
def _(t):
    return D.downvoted(t.ratings, t.clips.where(F.col("tok") % 5 != 0))


@query("J4_known_sources", "sources aligned", """SELECT source_id, video_id, max(phones IS NULL) AS needs_alignment FROM sources
    JOIN aligned USING (source_id) WHERE start_ms >= 0 AND end_ms > start_ms GROUP BY 1, 2""")
def _(t):
    return D.known_sources(t.sources, t.aligned)


@query("J5_pending_tone", "clips", f"WITH {_TONE} SELECT source_id, clip_id FROM clips ANTI JOIN tone USING (clip_id)")
def _(t):
    return D.pending_tone(t.clips, tone_rows(t)).select("source_id", "clip_id")


@query("J5_tone_orphans", "clips", f"WITH {_TONE} SELECT clip_id FROM tone ANTI JOIN clips USING (clip_id)")
def _(t):
    return D.orphans(tone_rows(t), t.clips)


@query("J6_plan_ingest", "sources", """WITH first AS (SELECT 'vid' || (user_id * 7) AS video_id, min(event_id) AS pos FROM events GROUP BY 1)
    SELECT video_id, pos FROM first ANTI JOIN (SELECT video_id FROM sources WHERE source_id % 3 <> 0) USING (video_id) ORDER BY pos LIMIT 40""")
def _(t):
    listing = t.read("events").select(F.col("event_id").alias("pos"),
                                      F.concat(F.lit("vid"), F.col("user_id") * 7).alias("video_id"))
    return D.plan_ingest(listing, t.sources.where(F.col("source_id") % 3 != 0), 40)


@query("J7_verify_captions", "clips captions", """
    WITH seq AS (SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, clip_id) AS reach FROM clips),
    c AS (SELECT *, source_id * 2147483648 + tok AS cap_id FROM captions),
    win AS (SELECT cap_id, t_ms, c.word AS cap, s.word AS w, s.start_ms, s.clip_id FROM c JOIN seq s ON s.source_id = c.source_id
      AND s.start_ms <= t_ms + 600 AND s.reach >= t_ms - 600),
    near AS (SELECT *, row_number() OVER (PARTITION BY cap_id ORDER BY abs(start_ms - t_ms), start_ms, clip_id) AS r,
      max(w = cap) OVER (PARTITION BY cap_id) AS same FROM win)
    SELECT source_id, c.cap_id, c.word, c.t_ms, CASE WHEN near.cap_id IS NULL THEN 'missed' WHEN same THEN 'agreed'
        WHEN abs(start_ms - c.t_ms) <= 250 THEN 'disagree' ELSE 'drifted' END AS status,
      CASE WHEN NOT same AND abs(start_ms - c.t_ms) <= 250 THEN w END AS clip_word
    FROM c LEFT JOIN near ON near.cap_id = c.cap_id AND r = 1""")
def j7(t):
    caps = t.captions.withColumn("cap_id", F.col("source_id") * PLACES + F.col("tok")).drop("tok")
    return CA.verify_captions(caps, t.clips)


_CHECKED = """seq AS (SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, clip_id) AS reach FROM clips),
    c AS (SELECT *, source_id * 2147483648 + tok AS cap_id FROM captions),
    win AS (SELECT cap_id, t_ms, c.word AS cap, s.word AS w, s.start_ms, s.clip_id FROM c JOIN seq s ON s.source_id = c.source_id
      AND s.start_ms <= t_ms + 600 AND s.reach >= t_ms - 600),
    near AS (SELECT *, row_number() OVER (PARTITION BY cap_id ORDER BY abs(start_ms - t_ms), start_ms, clip_id) AS r,
      max(w = cap) OVER (PARTITION BY cap_id) AS same FROM win),
    checked AS (SELECT source_id, c.cap_id, c.word, w, CASE WHEN near.cap_id IS NULL THEN 'missed' WHEN same THEN 'agreed'
        WHEN abs(start_ms - c.t_ms) <= 250 THEN 'disagree' ELSE 'drifted' END AS status
      FROM c LEFT JOIN near ON near.cap_id = c.cap_id AND r = 1)"""


@query("A22_top_disagreements", "clips captions", f"""WITH {_CHECKED} SELECT w AS stored, word AS caption, count(*) AS n FROM checked
    WHERE status = 'disagree' GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, stored, caption LIMIT 20""")
def _(t):
    return CA.top_disagreements(j7(t))


@query("A23_caption_agreement", "clips captions", f"""WITH {_CHECKED},
    per AS (SELECT source_id, count(*) AS captions, CAST(sum(CASE WHEN status = 'agreed' THEN 1 ELSE 0 END) AS BIGINT) AS agreed,
      CAST(sum(CASE WHEN status = 'missed' THEN 1 ELSE 0 END) AS BIGINT) AS missed,
      CAST(sum(CASE WHEN status = 'disagree' THEN 1 ELSE 0 END) AS BIGINT) AS disagree,
      CAST(sum(CASE WHEN status = 'drifted' THEN 1 ELSE 0 END) AS BIGINT) AS drifted FROM checked GROUP BY 1),
    withc AS (SELECT per.*, (SELECT count(*) FROM clips WHERE clips.source_id = per.source_id) AS clips FROM per),
    u AS (SELECT source_id, captions, agreed, missed, disagree, drifted, clips FROM withc UNION ALL
      SELECT NULL, CAST(sum(captions) AS BIGINT), CAST(sum(agreed) AS BIGINT), CAST(sum(missed) AS BIGINT),
        CAST(sum(disagree) AS BIGINT), CAST(sum(drifted) AS BIGINT), CAST(sum(clips) AS BIGINT) FROM withc)
    SELECT *, agreed * 100 // greatest(1, captions) AS agreed_pct FROM u""")
def _(t):
    return CA.caption_agreement(j7(t), t.clips)


@query("J11_locate", "clips noises", """
    WITH ids AS (SELECT DISTINCT clip_id + CASE WHEN clip_id % 2 = 0 THEN 0 ELSE 50000 END AS clip_id FROM clips WHERE tok % 5 = 2),
    b AS (SELECT *, 0 AS p, 'word' AS kind FROM (SELECT clip_id, source_id, word, start_ms, end_ms FROM clips WHERE tok % 2 = 0)
      UNION ALL SELECT clip_id, source_id, word, start_ms, end_ms, 1, 'noise' FROM noises)
    SELECT clip_id, source_id, word, start_ms, end_ms, kind FROM (
      SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY p) AS r FROM b SEMI JOIN ids USING (clip_id)) WHERE r = 1""")
def _(t):
    ids = t.clips.where(F.col("tok") % 5 == 2).select(
        (F.col("clip_id") + F.when(F.col("clip_id") % 2 == 0, 0).otherwise(50000)).alias("clip_id"))
    return D.locate(ids, t.clips.where(F.col("tok") % 2 == 0), t.noises)


@query("J12_clip_flags", "aligned noises ratings reports lexicon", f"""
    WITH b AS (SELECT source_id, clip_id, word, start_ms, end_ms, phones, 'word' AS kind FROM aligned
      UNION ALL SELECT source_id, clip_id, word, start_ms, end_ms, NULL, 'noise' FROM noises),
    n AS (SELECT *, min(CASE WHEN kind = 'word' THEN start_ms END) OVER (PARTITION BY source_id ORDER BY start_ms
        RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
      max(phones IS NOT NULL) OVER (PARTITION BY source_id) AS al FROM b),
    neg AS (SELECT DISTINCT clip_id, true AS neg FROM ratings WHERE score < 0),
    said AS (SELECT clip_id, list_sort(list('reported: ' || kind || CASE WHEN count > 1 THEN ' x' || count ELSE '' END)) AS said FROM reports GROUP BY 1),
    k AS (SELECT word, true AS known FROM lexicon),
    f AS (SELECT source_id, clip_id, kind, nxt - end_ms AS gap_after, [
      CASE WHEN end_ms - start_ms < 60 THEN 'very short' END, CASE WHEN nxt - end_ms < 0 THEN 'overlaps next' END,
      CASE WHEN end_ms - start_ms > 1500 THEN 'very long' END, CASE WHEN kind = 'word' AND neg THEN 'downvoted' END,
      CASE WHEN kind = 'word' AND al AND phones IS NULL AND known THEN 'not aligned' END,
      CASE WHEN kind = 'word' AND al AND phones IS NULL AND known IS NULL THEN 'no pronunciation' END,
      CASE WHEN kind = 'word' AND {_OUTSIDE} THEN 'alignment moved off' END] AS fl,
      CASE WHEN kind = 'word' AND said IS NOT NULL THEN said ELSE [] END AS told
      FROM n LEFT JOIN neg USING (clip_id) LEFT JOIN said USING (clip_id) LEFT JOIN k USING (word))
    SELECT source_id, clip_id, kind, gap_after,
      coalesce(array_to_string(list_concat(list_filter(fl, lambda x: x IS NOT NULL), told), '; '), '') AS flags FROM f""")
def _(t):
    return D.clip_flags(t.aligned, t.noises, t.ratings, t.reports, t.lexicon)


@query("J13_frames_in_clips", "clips frames", """SELECT c.clip_id, count(*) AS frames, CAST(sum(rms) AS BIGINT) AS rms FROM clips c
    JOIN frames f ON f.source_id = c.source_id AND f.t_ms BETWEEN c.start_ms AND c.end_ms WHERE c.end_ms > c.start_ms GROUP BY 1""")
def _(t):
    j = D.frames_in_clips(t.frames.drop("clip_id"), t.clips)
    return j.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("rms").alias("rms"))


@query("A1_corpus_stats", "aligned sources", f"""WITH {_TONE.replace('FROM clips', 'FROM aligned')}
    SELECT count(*) AS total_clips, count(DISTINCT word) AS words,
      CAST(sum(CASE WHEN phones IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS aligned_clips, (SELECT count(*) FROM sources) AS sources,
      (SELECT count(*) FROM tone SEMI JOIN aligned USING (clip_id)) AS toned_clips,
      round(sum(CASE WHEN phones IS NOT NULL THEN 1 ELSE 0 END) / greatest(1, count(*)) * 100, 1) AS coverage_pct FROM aligned""")
def _(t):
    return D.corpus_stats(t.aligned, t.sources, tone_rows(t))


_ISSUES = f"""{_FILES},
    seq AS (SELECT *, lead(start_ms) OVER (PARTITION BY source_id ORDER BY start_ms, clip_id) AS nxt FROM clips),
    told AS (SELECT clip_id, string_agg(kind || ':' || count, ', ' ORDER BY kind || ':' || count) AS reports FROM reports GROUP BY 1),
    issues AS (
      SELECT 'negative_margins' AS section, clip_id, source_id, word, end_ms - start_ms AS margin_ms, 'non-positive duration' AS reason
        FROM clips WHERE end_ms <= start_ms
      UNION ALL SELECT 'negative_margins', clip_id, source_id, word, nxt - end_ms, 'overlaps next clip' FROM seq WHERE nxt < end_ms
      UNION ALL SELECT 'low_confidence', clip_id, source_id, word, NULL, coalesce('boundary reports: ' || reports, 'very short duration')
        FROM clips LEFT JOIN told USING (clip_id) WHERE reports IS NOT NULL OR (end_ms > start_ms AND end_ms - start_ms < 60)
      UNION ALL SELECT 'no_pronunciation', NULL, NULL, word, NULL, 'no pronunciation' FROM (SELECT DISTINCT word FROM clips) ANTI JOIN lexicon USING (word)
      UNION ALL SELECT 'downvoted', r.clip_id, source_id, c.word, score, 'for ' || r.word FROM ratings r LEFT JOIN clips c ON c.clip_id = r.clip_id WHERE score < 0
      UNION ALL SELECT 'unindexed', NULL, NULL, NULL, NULL, source_file FROM files ANTI JOIN sources USING (source_file))"""


def issues(t):
    return D.issue_rows(t.clips, t.ratings, t.reports, t.lexicon, files(t), t.sources)


@query("A2_diagnostics", "clips ratings reports lexicon sources", f"WITH {_ISSUES} SELECT * FROM issues")
def _(t):
    return issues(t)


@query("A2_diagnostics_summary", "clips ratings reports lexicon sources", f"WITH {_ISSUES} SELECT section, count(*) AS n FROM issues GROUP BY 1")
def _(t):
    return D.issue_summary(issues(t))


@query("A3_alignment_status", "aligned lexicon", f"""
    WITH a AS (SELECT a.*, l.word IS NOT NULL AS known, {_OUTSIDE.replace('phones', 'a.phones')} AS out FROM aligned a LEFT JOIN lexicon l ON l.word = a.word),
    per AS (SELECT source_id, CAST(sum(CASE WHEN known AND (phones IS NULL OR out) THEN 1 ELSE 0 END) AS BIGINT) AS pending,
      CAST(sum(CASE WHEN known AND phones IS NOT NULL AND out THEN 1 ELSE 0 END) AS BIGINT) AS stale,
      CAST(sum(CASE WHEN NOT known AND (phones IS NULL OR out) THEN 1 ELSE 0 END) AS BIGINT) AS no_pronunciation FROM a GROUP BY 1),
    w AS (SELECT source_id, array_to_string(list_sort(list(DISTINCT word))[1:20], ',') AS unknown_words FROM a WHERE NOT known AND phones IS NULL GROUP BY 1)
    SELECT source_id, pending, stale, no_pronunciation, coalesce(unknown_words, '') AS unknown_words FROM per LEFT JOIN w USING (source_id)""")
def _(t):
    return D.alignment_status(t.aligned, t.lexicon)


@query("A4_unspliceable", "clips lexicon", """SELECT word, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM clips), 6) AS share_pct
    FROM clips ANTI JOIN lexicon USING (word) GROUP BY 1""")
def _(t):
    return D.unspliceable(t.clips, t.lexicon)


@query("A5_fold_votes", "votes", """
    WITH v AS (SELECT *, CASE WHEN seq % 97 = 0 THEN 'set' ELSE op END AS o, CASE WHEN seq % 97 = 0 THEN seq % 5 - 2 ELSE delta END AS d FROM votes),
    b AS (SELECT word, clip_id, max(CASE WHEN o <> 'add' THEN seq END) AS bs FROM v GROUP BY 1, 2)
    SELECT word, clip_id, CAST(sum(CASE WHEN o = 'add' THEN d WHEN o = 'set' THEN d ELSE 0 END) AS BIGINT) AS score
    FROM v JOIN b USING (word, clip_id) WHERE bs IS NULL OR seq >= bs GROUP BY 1, 2
    HAVING NOT (count(*) = 1 AND max(o) = 'set' AND max(d) = 0)""")
def _(t):
    hand = F.col("seq") % 97 == 0
    v = t.votes.withColumn("delta", F.when(hand, F.col("seq") % 5 - 2).otherwise(F.col("delta"))) \
        .withColumn("op", F.when(hand, F.lit("set")).otherwise(F.col("op")))
    return FB.fold_votes(v)


@query("A6_fold_reports", "report_log", """SELECT clip_id, kind, count(*) AS count FROM report_log
    WHERE kind IN ('starts late','starts early','ends early','ends late') GROUP BY 1, 2""")
def _(t):
    return FB.fold_reports(t.report_log)


@query("A7_ratings_map", "ratings", """WITH r AS (SELECT word, clip_id % 1000 AS clip_id, max(score) AS score FROM ratings GROUP BY 1, 2)
    SELECT clip_id, string_agg(word || '=' || score, ',' ORDER BY word) AS scores FROM r GROUP BY 1""")
def _(t):
    r = t.ratings.groupBy("word", (F.col("clip_id") % 1000).alias("clip_id")).agg(F.max("score").alias("score"))
    item = F.transform(F.map_entries("ratings"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return FB.ratings_map(r).select("clip_id", F.array_join(item, ",").alias("scores"))


@query("A19_edge_audit", "bleed aligned", """
    WITH a AS (SELECT b.*, p.phones, b.start_ms + p.phones[1].start_ms AS ons, b.start_ms + p.phones[len(p.phones)].end_ms AS offs
      FROM bleed b JOIN aligned p USING (clip_id)),
    s AS (SELECT *, lead(ons) OVER w AS next_on, lag(offs) OVER w AS prev_off FROM a WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, clip_id)),
    c0 AS (SELECT *, greatest(0, least(start_ms, greatest(start_ms - CASE WHEN edited = 1 THEN 0 ELSE 50 END, coalesce(prev_end + 50, -1000000)))) AS cs,
      CASE WHEN edited = 1 THEN end_ms ELSE end_ms + 180 END AS w0 FROM s WHERE phones IS NOT NULL),
    c AS (SELECT *, greatest(CASE WHEN next_start IS NULL THEN w0 ELSE least(w0, greatest(end_ms, next_start - CASE WHEN bleed_risk THEN 160 ELSE 50 END)) END,
      CASE WHEN edited = 1 OR coalesce(next_start <= end_ms + 1, false) THEN end_ms ELSE greatest(end_ms, cs + 50) END) AS ce FROM c0)
    SELECT coalesce(next_start - end_ms < 100, false) AS adjacent, count(*) AS n,
      round(avg(CASE WHEN ce < offs - 20 THEN 1 ELSE 0 END), 6) AS end_cut, round(avg(CASE WHEN cs > ons + 20 THEN 1 ELSE 0 END), 6) AS start_cut,
      round(avg(CASE WHEN next_start - end_ms < 300 AND ce > next_on + 20 THEN 1 ELSE 0 END), 6) AS into_next,
      round(avg(CASE WHEN start_ms - prev_end < 300 AND cs < prev_off - 20 THEN 1 ELSE 0 END), 6) AS from_prev FROM c GROUP BY 1""")
def _(t):
    # Only the outer phones are asked for.
    ends = F.array(F.get("phones", F.lit(0)), F.get("phones", F.size("phones") - 1))
    p = t.aligned.select("source_id", "clip_id", F.when(F.size("phones") > 0, ends).otherwise(F.col("phones")).alias("phones"))
    return D.edge_audit(t.index_bleed.join(p, ["source_id", "clip_id"]))


@query("A20_noise_inventory", "noises", """WITH k AS (SELECT word AS kind, count(*) AS n FROM noises GROUP BY 1)
    SELECT * FROM k UNION ALL SELECT 'noise', CAST(sum(n) AS BIGINT) FROM k HAVING count(*) > 1 AND sum(n) > 1""")
def _(t):
    return D.noise_inventory(t.noises)


@query("U1_all_clips", "clips noises", """SELECT source_id, clip_id, word, start_ms, end_ms, 'word' AS kind FROM clips
    UNION ALL SELECT source_id, clip_id, word, start_ms, end_ms, 'noise' FROM noises""")
def _(t):
    return D.all_clips(t.clips, t.noises)


@query("U2_unindexed_files", "sources", f"WITH {_FILES} SELECT source_file FROM files ANTI JOIN sources USING (source_file)")
def _(t):
    return D.unindexed(files(t), t.sources)


@query("U2_template_words", "clips lexicon", """SELECT word, count(*) AS n FROM clips ANTI JOIN lexicon USING (word)
    WHERE word NOT IN (SELECT word FROM clips WHERE tok % 3 = 0) GROUP BY 1""")
def _(t):
    return D.template_words(D.unspliceable(t.clips, t.lexicon), t.clips.where(F.col("tok") % 3 == 0))


@query("W3_job_state", "jobs", """SELECT job_id, arg_max(status, (ts, seq)) AS status, min(ts) AS created, max(ts) AS updated,
    min(seq) AS first_seq, count(*) AS events FROM jobs GROUP BY 1""")
def _(t):
    return JB.job_state(t.jobs)


@query("W3_queue_stats", "jobs", "WITH s AS (SELECT job_id, arg_max(status, (ts, seq)) AS status FROM jobs GROUP BY 1) SELECT status, count(*) AS n FROM s GROUP BY 1")
def _(t):
    return JB.queue_stats(JB.job_state(t.jobs))


@query("W3_queue_position", "jobs", """WITH s AS (SELECT job_id, arg_max(status, (ts, seq)) AS status, min(ts) AS created FROM jobs GROUP BY 1)
    SELECT job_id, row_number() OVER (ORDER BY created, job_id) - 1 AS ahead FROM s WHERE status = 'queued'""")
def _(t):
    return JB.queue_position(JB.job_state(t.jobs)).select("job_id", "ahead")


@query("W3_batch_done", "jobs", """WITH s AS (SELECT job_id, arg_max(status, (ts, seq)) AS status FROM jobs GROUP BY 1)
    SELECT job_id // 3 AS batch_id, count(*) AS members, bool_and(status IN ('done','error','cancelled')) AS complete FROM s GROUP BY 1""")
def _(t):
    return JB.batch_done(JB.job_state(t.jobs), F.floor(F.col("job_id") / 3))


@query("R3_retain_recent", "jobs", """
    WITH s AS (SELECT job_id, arg_max(status, (ts, seq)) AS status, min(ts) AS created, max(ts) AS updated FROM jobs GROUP BY 1),
    live AS (SELECT * FROM s WHERE status NOT IN ('done','error','cancelled')),
    kept AS (SELECT * FROM s WHERE status IN ('done','error','cancelled') AND TIMESTAMP '2024-01-31' - updated <= INTERVAL 72 HOUR
      ORDER BY created DESC, job_id DESC LIMIT 50)
    SELECT job_id, status FROM (SELECT * FROM live UNION ALL SELECT * FROM kept)""")
def _(t):
    now = F.lit("2024-01-31").cast("timestamp")
    return JB.retain_recent(JB.job_state(t.jobs), now, 72 * 3600).select("job_id", "status")


# --- takes -------------------------------------------------------------------

_TAKES = """rep AS (SELECT clip_id, sum(count) AS reports FROM reports GROUP BY 1),
    takes0 AS (SELECT b.*, coalesce(r.score, 0) AS score, coalesce(rep.reports, 0) AS reports, q.quality,
      CAST(CASE WHEN next_start IS NULL OR next_start - end_ms >= 100 THEN 60 ELSE 1 END
        * CASE WHEN prev_end IS NULL OR start_ms - prev_end >= 60 THEN 10 ELSE 1 END AS DOUBLE) AS edge
      FROM bleed b LEFT JOIN ratings r ON r.word = b.word AND r.clip_id = b.clip_id LEFT JOIN rep ON rep.clip_id = b.clip_id
      LEFT JOIN quality q ON q.source_id = b.source_id WHERE end_ms - start_ms >= 50),
    takes1 AS (SELECT *, quality * quality * quality * edge
      * CASE WHEN score = 0 THEN 1 ELSE least(8, greatest(0.02::DOUBLE, pow(2.0, score))) END * pow(0.2::DOUBLE, reports) AS weight FROM takes0),
    takes AS (SELECT *, greatest(weight * CASE WHEN bleed_risk THEN 0.05::DOUBLE ELSE 1 END, 1e-6::DOUBLE) AS pick_weight FROM takes1)"""
_FLOORS = """floors AS (SELECT word, CASE WHEN phones IS NOT NULL THEN len(phones) * 45 ELSE greatest(80, length(word) * 25) END AS floor_ms
      FROM vocab LEFT JOIN lexicon USING (word))"""
_GOOD = """med AS (SELECT word, count(*) AS n, list_sort(list(end_ms - start_ms))[count(*) // 2 + 1] AS median_ms FROM takes GROUP BY 1),
    band AS (SELECT takes.*, n, median_ms, n = 1 OR (end_ms - start_ms BETWEEN greatest(floor_ms::DOUBLE, median_ms * 0.5)
      AND greatest(median_ms * 2.5, 450)) AS good FROM takes JOIN med USING (word) JOIN floors USING (word)),
    saved AS (SELECT *, bool_or(good) OVER (PARTITION BY word) AS any_good,
      row_number() OVER (PARTITION BY word ORDER BY abs(end_ms - start_ms - median_ms), source_id, start_ms, clip_id) AS r FROM band),
    plausible AS (SELECT * FROM saved WHERE good OR (NOT any_good AND r = 1))"""
_NEED = "bleed quality ratings reports vocab lexicon"


def takes(t):
    return TK.weighted_takes(t.index, t.quality, t.ratings, t.reports, t.onsets)


def plausible(t, rows):
    """The plausible of ``rows``, with the columns that the queries below read."""
    slim = rows.select("word", "source_id", "clip_id", "start_ms", "end_ms", "pick_weight")
    return TK.plausible_takes(slim, floors(t))


def floors(t):
    from wordclips.functions import text as TX
    from wordclips.operators import index as IX
    v = IX.vocabulary(t.index).join(t.lexicon, "word", "left")
    return v.select("word", TX.duration_floor_ms("word", F.size("phones")).alias("floor_ms"))


@query("R1_clip_choices", _NEED, f"""WITH {_TAKES} SELECT word, clip_id, source_id, start_ms, end_ms, edge > 1 AS clean, score,
      CAST(reports AS BIGINT) AS reports, score <= -2 AS vetoed, rank FROM (SELECT *, row_number() OVER (PARTITION BY word
      ORDER BY weight DESC, source_id, start_ms, clip_id) AS rank FROM takes) WHERE rank <= 60""")
def _(t):
    return TK.clip_choices(takes(t)).select("word", "clip_id", "source_id", "start_ms", "end_ms", "clean",
                                            "score", "reports", "vetoed", "rank")


@query("R2_retain_budget", "clips", """SELECT clip_id FROM (SELECT clip_id, sum(length(word) * 1000) OVER (ORDER BY start_ms DESC, clip_id DESC) AS s FROM clips)
    WHERE s <= 100000000""")
def _(t):
    f = t.clips.select("clip_id", "start_ms", (F.length("word") * 1000).cast("bigint").alias("size"))
    from wordclips.operators.ordered import bucket
    return TK.retain_budget(f, ["start_ms", "clip_id"], "size", 100_000_000, bucket("start_ms", 10_000)).select("clip_id")


@query("R4_plausible_takes", _NEED, f"WITH {_TAKES}, {_FLOORS}, {_GOOD} SELECT word, clip_id, CAST(median_ms AS BIGINT) AS median_ms, n FROM plausible")
def _(t):
    return plausible(t, takes(t)).select("word", "clip_id", "median_ms", "n")


@query("R5_best_takes", _NEED, f"""WITH {_TAKES}, {_FLOORS}, {_GOOD} SELECT word, source_id, clip_id, start_ms, end_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY pick_weight DESC, source_id, start_ms, clip_id) AS rr FROM plausible) WHERE rr = 1""")
def _(t):
    return TK.best_takes(plausible(t, takes(t))).drop("pick_weight")


@query("R5_pick_takes")
def _(t):
    return TK.pick_takes(plausible(t, TK.without_vetoed(takes(t))), seed=7)


@query("R6_vetoed_words", _NEED, f"""WITH {_TAKES} SELECT word, count(*) AS takes, count(*) AS rejected FROM takes
    GROUP BY 1 HAVING bool_and(score <= -2)""")
def _(t):
    return TK.vetoed_words(takes(t))


@query("R9_spaced_takes", "idx", """WITH s AS (SELECT word, clip_id, row_number() OVER (PARTITION BY word ORDER BY clip_id) - 1 AS k,
    greatest(1, count(*) OVER (PARTITION BY word) // 4) AS step FROM idx WHERE end_ms - start_ms >= 50)
    SELECT word, clip_id, k // step AS slot FROM s WHERE k % step = 0 AND k < step * 4""")
def _(t):
    u = t.index.where(F.col("end_ms") - F.col("start_ms") >= 50)
    return TK.spaced_takes(u).select("word", "clip_id", "slot")


@query("R11_by_audibility", "clips", """WITH d AS (SELECT word, clip_id, end_ms - start_ms AS dur, end_ms - start_ms >= length(word) * 50 AS audible
      FROM clips WHERE end_ms - start_ms >= 50)
    SELECT word, clip_id, audible, row_number() OVER (PARTITION BY word ORDER BY audible DESC,
      CASE WHEN audible THEN dur ELSE -dur END, clip_id) AS rank FROM d""")
def _(t):
    u = t.clips.where(F.col("end_ms") - F.col("start_ms") >= 50)
    return TK.by_audibility(u, F.length("word") * 50).select("word", "clip_id", "audible", "rank")


@query("R12_sample_words")
def _(t):
    return TK.sample_words(t.index)
