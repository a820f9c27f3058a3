"""Queries on reading, keeping and correcting corpora, and live feeds (S*, C7-C10, T*, J9, W*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordclips import schemas
from wordclips.functions import text as TX
from wordclips.operators import reconcile as RC
from wordclips.operators import windows as WN
from wordclips.plans.catalog import query
from wordclips.plans.tables import PLACES
from wordclips.session import stored
from wordclips.sources import corpus as CO
from wordclips.sources import readers as RD
from wordclips.streaming import feeds as FD

CLIP = ["source_id", "clip_id", "word", "start_ms", "end_ms", "source_file", "edited"]


# --- sources -------------------------------------------------------------------

def transcripts(t):
    """Every document as a timed transcript, some times bad, five words a segment or so."""
    c = t.clips.select("source_id", F.floor(F.col("tok") / 5).alias("seg"), "tok", F.struct(
        F.concat("word", F.lit(",")).alias("word"), F.when(F.col("tok") % 37 == 0, float("nan")).otherwise(F.col("start_ms") / 1000.0).alias("start"),
        (F.col("end_ms") / 1000.0).alias("end")).alias("w"))
    s = c.groupBy("source_id", "seg").agg(F.transform(F.sort_array(F.collect_list(F.struct("tok", "w"))), lambda x: x["w"]).alias("words"))
    return s.select("source_id", F.array(F.struct("words")).alias("segments"))


@query("S1_transcript_words", "clips", """SELECT source_id, word, start_ms, end_ms FROM clips WHERE tok % 37 <> 0 AND end_ms > start_ms""")
def _(t):
    return RD.transcript_words(transcripts(t))[0].select("source_id", "word", "start_ms", "end_ms")


@query("S1_rejected_words", "clips", "SELECT source_id, word FROM clips WHERE tok % 37 = 0 OR end_ms <= start_ms")
def _(t):
    return RD.transcript_words(transcripts(t))[1].select("source_id", "word")


@query("S2_caption_words", "captions", """SELECT source_id, CASE WHEN k = 1 THEN word ELSE 'again' END AS word, t_ms FROM captions, (SELECT unnest([1, 2]) AS k)""")
def _(t):
    c = t.captions.select("source_id", F.array(F.struct(F.col("t_ms").cast("double").alias("tStartMs"), F.array(F.struct(
        F.concat("word", F.lit(" Again!")).alias("utf8"), F.lit(None).cast("double").alias("tOffsetMs"))).alias("segs"))).alias("events"))
    return RD.caption_words(c).select("source_id", "word", "t_ms")


@query("S4_relative_paths", "clips", r"""SELECT clip_id, 'downloads/' || source_id || '.mp4' AS source_file FROM clips""")
def _(t):
    p = F.concat(F.lit("C:\\corpus\\downloads\\"), F.col("source_id").cast("string"), F.lit(".mp4"))
    return t.clips.select("clip_id", CO.relative_path(p).alias("source_file"))


@query("S4_save_load_corpus", "clips", "SELECT source_id, clip_id, word, start_ms, end_ms, corpus FROM clips WHERE corpus IN ('en', 'de')")
def _(t):
    import uuid

    from wordclips.session import shared_folder
    path = f"{shared_folder(t.spark)}/corpus-{uuid.uuid4().hex}"
    CO.save_corpus(t.clips.select("corpus", "source_id", "clip_id", "word", "start_ms", "end_ms"), path)
    return CO.load_corpus(t.spark, path, ["en", "de"])


@query("S5_audit_paths", "clips", """SELECT count(*) AS clips, count(DISTINCT source_id) AS files FROM clips WHERE source_id % 9 = 4""")
def _(t):
    bad = F.concat(F.lit("/abs/"), F.col("source_id").cast("string"))
    return CO.audit_paths(t.clips.withColumn("source_file", F.when(F.col("source_id") % 9 == 4, bad).otherwise(F.col("source_file"))))


@query("S6_validate_schema")
def _(t):
    return CO.validate_schema(t.aligned, T.StructType.fromDDL(schemas.TABLES["clips"]), ["clip_id", "source_id", "word", "phones"])


@query("S9_note_events", "notes", "SELECT song_id, channel, count(*) AS events, CAST(sum(start_ms) AS BIGINT) AS ticks FROM notes GROUP BY 1, 2")
def _(t):
    import uuid

    from wordclips.session import shared_folder
    path = f"{shared_folder(t.spark)}/events-{uuid.uuid4().hex}"
    none = F.lit(None).cast("bigint")
    t.notes.select("song_id", F.lit(0).cast("bigint").alias("track"), "channel", F.col("start_ms").alias("tick"), F.col("note_id").alias("seq"),
                   F.lit("note_on").alias("type"), F.col("pitch").alias("note"), "velocity", none.alias("program"), none.alias("tempo")).write.parquet(path)
    e = RD.read_midi_events(t.spark, path)
    return e.groupBy("song_id", "channel").agg(F.count(F.lit(1)).alias("events"), F.sum("tick").alias("ticks"))


def wiki(t):
    """Documents as wiki pages: their lines are sections with links and templates."""
    body = F.regexp_replace("text", r"\n", "\n==Part==\n[[a|b]] {{x}} ''")
    return t.read("documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("intro\n==First==\n"), body).alias("text"))


_MARKUP = ((r"(?m)^=+.*?=+[ \t]*$", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", r"\1"), (r"\[\[([^\]]*)\]\]", r"\1"), (r"\{\{[^}]*\}\}", " "),
           ("<[^>]+>", " "), ("''''''", ""), ("''''", ""), (r"[ \t]+", " "), (r"^\s+|\s+$", ""))
_BODY = "CASE WHEN k = 0 THEN line ELSE '[[a|b]] {{x}} ''''' || line END"
for _pattern, _new in _MARKUP:
    _BODY = f"regexp_replace({_BODY}, '{_pattern}', '{_new}', 'g')"


@query("S10_wiki_sections", "", f"""WITH l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
    b AS (SELECT page_id, CAST(k AS INTEGER) AS k, CASE WHEN k = 0 THEN 'First' ELSE 'Part' END AS title, {_BODY} AS body FROM l)
    SELECT page_id, k, title, body FROM b WHERE body <> ''""")
def _(t):
    return RD.parse_wiki_sections(wiki(t))


def settings(t):
    c = t.sources.select("corpus").distinct()
    return c.select("corpus", F.lit("splice_mode").alias("key"), F.when(F.col("corpus") == "en", "loose").otherwise("strict").alias("value")).unionByName(
        c.where(F.col("corpus") == "fr").select("corpus", F.lit("max_units").alias("key"), F.lit("12").alias("value")))


@query("S11_corpora_totals", "clips sources", """SELECT s.corpus, count(DISTINCT source_id) AS sources, any_value(c.clips) AS clips, any_value(c.words) AS words,
    CASE WHEN s.corpus = 'en' THEN 'loose' ELSE 'strict' END AS splice_mode, CAST(CASE WHEN s.corpus = 'fr' THEN 12 END AS INTEGER) AS max_units, CAST(0 AS INTEGER) AS schema_version
    FROM sources s LEFT JOIN (SELECT corpus, count(*) AS clips, count(DISTINCT word) AS words FROM clips GROUP BY 1) c ON c.corpus = s.corpus GROUP BY s.corpus""")
def _(t):
    return CO.corpora_totals(t.clips, t.sources, settings(t))


@query("S12_upgrade", "clips", "SELECT source_id, clip_id, word, CAST(0 AS INTEGER) AS edited, CAST(NULL AS DOUBLE) AS pitch FROM clips")
def _(t):
    old = t.clips.select("source_id", "clip_id", "word")
    return CO.upgrade(old, T.StructType.fromDDL("clip_id bigint, word string, edited int, pitch double"), {"edited": 0})


# --- windows ---------------------------------------------------------------------

def cores(t):
    return t.clips.where(F.col("tok") % 6 != 0).select(
        "source_id", "clip_id", (F.col("start_ms") + (F.col("tok") * 17) % 120 - 40).alias("onset"), (F.col("end_ms") + (F.col("tok") * 23) % 160 - 60).alias("core_end"))


_PLACED = """c AS (SELECT *, start_ms + tok * 17 % 120 - 40 AS o0, end_ms + tok * 23 % 160 - 60 AS e0 FROM clips),
    u AS (SELECT *, CASE WHEN ok THEN o0 END AS onset, CASE WHEN ok THEN e0 END AS core_end FROM (SELECT *, tok % 6 <> 0 AND edited <> 1 AND e0 > o0 AS ok FROM c)),
    s AS (SELECT u.*, duration_ms, lead(coalesce(onset, start_ms)) OVER (PARTITION BY u.source_id ORDER BY start_ms, clip_id) AS nxt FROM u JOIN sources USING (source_id)),
    n AS (SELECT *, CASE WHEN ok THEN greatest(0, onset) END AS ns, CASE WHEN ok THEN CASE WHEN nxt IS NULL THEN least(core_end + 300, duration_ms)
      ELSE least(core_end + 300, duration_ms, greatest(core_end, nxt - 20), nxt) END END AS ne FROM s),
    w AS (SELECT *, lead(ns) OVER w AS n_start, lag(ne) OVER w AS p_end, lag(core_end) OVER w AS p_core FROM n WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, clip_id)),
    placed AS (SELECT source_id, clip_id, os AS start_ms, oe AS end_ms, os - start_ms AS shift_ms FROM (SELECT *,
      CASE WHEN p_end > ns THEN greatest(ns, least(greatest(p_core, ns), onset)) ELSE ns END AS os, CASE WHEN ne > n_start THEN greatest(core_end, n_start) ELSE ne END AS oe
      FROM w WHERE ok) WHERE oe - os >= 40)"""


def placed(t):
    return WN.place_boundaries(t.clips, cores(t), t.sources)


@query("C7_place_boundaries", "clips sources", f"WITH {_PLACED} SELECT * FROM placed")
def _(t):
    return placed(t)


@query("C7_median_shift", "clips sources", f"WITH {_PLACED} SELECT source_id, quantile_cont(shift_ms, 0.5) AS median_shift_ms FROM placed GROUP BY 1")
def _(t):
    return WN.median_shift(placed(t))


@query("C8_crossing_repair", "clips sources", f"""WITH {_PLACED} SELECT source_id, CAST(coalesce(sum((ne > n_start)::INT), 0) AS BIGINT) AS crossings FROM w WHERE ok GROUP BY 1""")
def _(t):
    # As many neighbours meet at a cut as crossed before it.
    from wordclips.operators import ordered as O
    from wordclips.operators.index import hour
    c = t.clips.join(cores(t), ["source_id", "clip_id"], "left")
    ok = (F.col("edited") != 1) & (F.col("core_end") > F.col("onset"))
    c = c.withColumns({"onset": F.when(ok, F.col("onset")), "core_end": F.when(ok, F.col("core_end"))})
    s = O.scan(c.withColumn("at", F.coalesce("onset", "start_ms")), ["source_id"], ["start_ms", "clip_id"], hour(), nxt=O.lead("at"), n_on=O.lead("onset")) \
        .join(t.sources.select("source_id", "duration_ms"), "source_id").where(F.col("onset").isNotNull())
    end = F.least(F.col("core_end") + 300, F.col("duration_ms"))
    end = F.when(F.col("nxt").isNotNull(), F.least(end, F.greatest(F.col("core_end"), F.col("nxt") - 20), F.col("nxt"))).otherwise(end)
    return s.groupBy("source_id").agg(F.coalesce(F.sum(((end > F.greatest(F.lit(0), "n_on")) & F.col("n_on").isNotNull()).cast("bigint")), F.lit(0)).alias("crossings"))


@query("C9_spread_words", "clips", """WITH g AS (SELECT source_id * 2147483648 + tok // 4 AS group_id, tok AS j, word, min(start_ms) OVER p AS lo_ms, max(end_ms) OVER p AS hi_ms FROM clips
      WINDOW p AS (PARTITION BY source_id, tok // 4)),
    s AS (SELECT *, greatest(hi_ms, lo_ms + count(*) OVER (PARTITION BY group_id)) AS hi, sum(length(word)) OVER (PARTITION BY group_id ORDER BY j) AS upto, sum(length(word)) OVER (PARTITION BY group_id) AS al FROM g)
    SELECT group_id, j, word, CAST(lo_ms + (hi - lo_ms) * (upto - length(word)) // al AS BIGINT) AS start_ms, CAST(lo_ms + (hi - lo_ms) * upto // al AS BIGINT) AS end_ms FROM s""")
def _(t):
    g = t.clips.withColumn("group_id", F.col("source_id") * PLACES + F.floor(F.col("tok") / 4))
    ends = g.groupBy("group_id").agg(F.min("start_ms").alias("lo_ms"), F.max("end_ms").alias("hi_ms"))
    return WN.spread_words(g.select("group_id", F.col("tok").alias("j"), "word").join(ends, "group_id")).select("group_id", "j", "word", "start_ms", "end_ms")


_WIN = """WITH RECURSIVE p AS (SELECT source_id, start_ms, end_ms, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, clip_id) AS n FROM clips WHERE end_ms > start_ms),
    mx AS (SELECT source_id, n, max(end_ms) OVER (PARTITION BY source_id ORDER BY n) AS upto FROM p),
    f AS (SELECT source_id, upto, min(n) AS n FROM mx GROUP BY 1, 2),"""
# No clip is as long as a window, so the first end past a time is the first running maximum past it.
_HEADS = """heads AS (SELECT source_id, min(n) AS n FROM p GROUP BY 1 UNION ALL SELECT h.source_id, x.nxt FROM heads h JOIN nx x ON x.source_id = h.source_id AND x.n = h.n)
    SELECT source_id, n AS win, CAST(coalesce(lead(n) OVER (PARTITION BY source_id ORDER BY n), last + 1) - n AS BIGINT) AS words
    FROM heads JOIN (SELECT source_id, max(n) AS last FROM p GROUP BY 1) USING (source_id)"""


def timed(t):
    """The clips with the columns that windows are made from."""
    return t.clips.select("source_id", "clip_id", "start_ms", "end_ms")


@query("C10_group_words", "clips", f"""{_WIN}
    nx AS MATERIALIZED (SELECT p.source_id, p.n, f.n AS nxt FROM p ASOF JOIN f ON f.source_id = p.source_id AND p.start_ms + 40000 < f.upto), {_HEADS}""")
def _(t):
    return WN.window_words(timed(t), "group").groupBy("source_id", "win").agg(F.count(F.lit(1)).alias("words"))


@query("C10_window_words", "clips", f"""{_WIN}
    lo AS (SELECT p.*, f.n AS lo FROM p ASOF JOIN f ON f.source_id = p.source_id AND p.start_ms + 20000 <= f.upto),
    hi AS (SELECT lo.*, f.n AS hi FROM lo ASOF LEFT JOIN f ON f.source_id = lo.source_id AND lo.start_ms + 30000 <= f.upto),
    gaps AS (SELECT source_id, n, start_ms - lag(end_ms) OVER (PARTITION BY source_id ORDER BY n) AS gap FROM p),
    nx AS MATERIALIZED (SELECT h.source_id, h.n, CAST(coalesce(arg_max(g.n, g.gap * 1000000 - g.n), min(h.lo)) AS BIGINT) AS nxt
      FROM (SELECT source_id, n, greatest(lo, n + 1) AS lo, coalesce(hi, 9223372036854775807) AS hi FROM hi) h
      LEFT JOIN gaps g ON g.source_id = h.source_id AND g.n >= h.lo AND g.n < h.hi AND g.n < h.lo + 1000 GROUP BY 1, 2), {_HEADS}""")
def _(t):
    return WN.window_words(timed(t), "window").groupBy("source_id", "win").agg(F.count(F.lit(1)).alias("words"))


# --- reconciliation -----------------------------------------------------------------

def heard_of(w):
    """What a second listener heard: words missed, misheard and added."""
    said = F.when(F.col("n") % 19 == 5, F.array().cast("array<string>")).when(F.col("n") % 17 == 3, F.array(F.concat("word", F.lit("er")))) \
        .when(F.col("n") % 23 == 7, F.array("word", F.lit("erm"))).otherwise(F.array("word"))
    return w.select("source_id", "win", "n", F.posexplode(said).alias("s", "word")) \
        .select("source_id", "win", (F.col("n") * 10 + F.col("s")).alias("pos"), "word")


def windows(t):
    # A stored table in practice: both sides and every later step read it, but not the phones.
    c = t.aligned.select("source_id", "clip_id", "word", "start_ms", "end_ms", "edited")
    w = stored(WN.window_words(c, "window").select("source_id", "win", "n", F.col("n").alias("pos"), "clip_id", "word", "edited"), "windows")
    return w, heard_of(w)


_KEYS = ["source_id", "win"]


@query("T1_diff_tokens")
def _(t):
    w, h = windows(t)
    return RC.diff_tokens(RC.compared_as(w), RC.compared_as(h), _KEYS)


@query("T2_plan_corrections")
def _(t):
    c = t.clips.select("source_id", F.col("tok").alias("pos"), "clip_id", "word")
    w = t.clips.withColumns({"n": F.col("tok"), "win": F.lit(0).cast("bigint")})
    return RC.plan_corrections(c, heard_of(w).select("source_id", "pos", "word"), t.lexicon)


def actions(t):
    w, h = windows(t)
    return RC.plan_second_opinion(w, h, _KEYS)


@query("T3_plan_second_opinion")
def _(t):
    return actions(t).select("source_id", "win", "k", "action", F.array_join("words", " ").alias("words"), F.size("clips").alias("n_clips"), "after", "before")


@query("T4_apply_actions")
def _(t):
    # Both results: every clip, with the reports against it.
    clips, reports = RC.apply_actions(t.aligned.drop("tok"), t.reports.drop("source_id"), actions(t), _KEYS)
    told = reports.groupBy("clip_id").agg(F.sum("count").alias("reports"))
    return clips.select(*CLIP).join(told, "clip_id", "left")


def edits(t):
    n = F.col("tok") % 20
    op = F.when(n == 3, "rename").when(n == 8, "move").when(n == 13, "delete")
    return t.clips.where(op.isNotNull()).select(
        "source_id", "clip_id", op.alias("op"), F.concat("word", F.lit("x")).alias("new_word"), (F.col("start_ms") + F.col("tok") % 90 - 30).alias("new_start"),
        (F.col("end_ms") - F.col("tok") % 50).alias("new_end"))


_PT = "coalesce(array_to_string(list_transform(phones, lambda p: p.phone || p.start_ms || '-' || p.end_ms), ' '), '')"
_EDITS = """ed AS (SELECT clip_id, CASE tok % 20 WHEN 3 THEN 'rename' WHEN 8 THEN 'move' ELSE 'delete' END AS op, word || 'x' AS new_word,
      start_ms + tok % 90 - 30 AS new_start, end_ms - tok % 50 AS new_end FROM clips WHERE tok % 20 IN (3, 8, 13))"""


def phone_text(df):
    return df.withColumn("phones", F.coalesce(F.array_join(F.transform("phones", lambda p: F.concat(
        p["phone"], p["start_ms"].cast("string"), F.lit("-"), p["end_ms"].cast("string"))), " "), F.lit("")))


@query("T5_apply_edits", "aligned clips", f"""WITH {_EDITS},
    j AS (SELECT a.*, op, new_word, new_start, new_end, list_transform(phones, lambda p: {{'phone': p.phone, 'start_ms': p.start_ms + a.start_ms - new_start, 'end_ms': p.end_ms + a.start_ms - new_start}}) AS mv
      FROM aligned a LEFT JOIN (SELECT * FROM ed WHERE op <> 'move' OR new_end - new_start >= 20) e ON e.clip_id = a.clip_id WHERE op IS NULL OR op <> 'delete'),
    k AS (SELECT source_id, clip_id, CASE WHEN op = 'rename' THEN new_word ELSE word END AS word, CASE WHEN op = 'move' THEN new_start ELSE start_ms END AS start_ms,
      CASE WHEN op = 'move' THEN new_end ELSE end_ms END AS end_ms, source_file, CASE WHEN op = 'move' THEN 1 ELSE edited END AS edited,
      CASE WHEN op = 'rename' THEN NULL WHEN op = 'move' THEN CASE WHEN list_min(list_transform(mv, lambda p: p.start_ms)) < -60 OR list_max(list_transform(mv, lambda p: p.end_ms)) > new_end - new_start + 60
        THEN NULL ELSE mv END ELSE phones END AS phones FROM j)
    SELECT source_id, clip_id, word, start_ms, end_ms, source_file, edited, {_PT} AS phones FROM k""")
def _(t):
    return phone_text(RC.apply_edits(t.aligned, edits(t)).select(*CLIP, "phones"))


@query("T5_clear_reports", "clips reports", f"WITH {_EDITS} SELECT clip_id, kind, count FROM reports ANTI JOIN (SELECT clip_id FROM ed WHERE op IN ('move','delete')) USING (clip_id)")
def _(t):
    return RC.clear_dependants(t.reports, edits(t), "reports").select("clip_id", "kind", "count")


@query("T5_clear_ratings", "clips ratings", f"WITH {_EDITS} SELECT word, clip_id, score FROM ratings ANTI JOIN (SELECT clip_id FROM ed WHERE op = 'delete') USING (clip_id)")
def _(t):
    return RC.clear_dependants(t.ratings, edits(t), "ratings").select("word", "clip_id", "score")


@query("T6_refresh_phones", "aligned clips sources", f"""WITH {_PLACED},
    j AS (SELECT a.*, p.start_ms AS ns, p.end_ms AS ne, list_transform(phones, lambda q: {{'phone': q.phone, 'start_ms': q.start_ms + a.start_ms - p.start_ms, 'end_ms': q.end_ms + a.start_ms - p.start_ms}}) AS mv
      FROM aligned a LEFT JOIN placed p ON p.clip_id = a.clip_id),
    k AS (SELECT clip_id, coalesce(ns, start_ms) AS start_ms, coalesce(ne, end_ms) AS end_ms, CASE WHEN ns IS NULL THEN phones
      WHEN list_min(list_transform(mv, lambda p: p.start_ms)) < -60 OR list_max(list_transform(mv, lambda p: p.end_ms)) > ne - ns + 60 OR abs(ne - ns - (end_ms - start_ms)) > 30 THEN NULL ELSE mv END AS phones FROM j)
    SELECT clip_id, start_ms, end_ms, {_PT} AS phones FROM k""")
def _(t):
    return phone_text(RC.refresh_phones(t.aligned, placed(t)).select("clip_id", "start_ms", "end_ms", "phones"))


def measured(t):
    """Phones measured for clips, some of which have changed since."""
    late = F.col("tok") % 8 == 1
    return t.aligned.where(F.col("phones").isNotNull()).select(
        "source_id", "clip_id", F.when(late, F.concat("word", F.lit("s"))).otherwise(F.col("word")).alias("word"), "start_ms",
        (F.col("end_ms") + F.when(F.col("tok") % 8 == 2, 5).otherwise(0)).alias("end_ms"), "source_file", "phones")


@query("T7_merge_if_unchanged", "aligned", f"""WITH k AS (SELECT clip_id, CASE WHEN tok % 8 IN (1, 2) THEN NULL ELSE phones END AS phones FROM aligned) SELECT clip_id, {_PT} AS phones FROM k""")
def _(t):
    bare = t.aligned.withColumn("phones", F.lit(None).cast(schemas.PHONES))
    return phone_text(RC.merge_if_unchanged(bare, measured(t))[0].select("clip_id", "phones"))


@query("T7_rejected", "aligned", "SELECT clip_id FROM aligned WHERE phones IS NOT NULL AND tok % 8 IN (1, 2)")
def _(t):
    return RC.merge_if_unchanged(t.aligned, measured(t))[1].select("clip_id")


def retaken(t):
    """New clips for every other source, shifted."""
    return t.clips.where(F.col("source_id") % 2 == 0).select(
        "source_id", (F.col("clip_id") + 50_000_000_000).alias("clip_id"), "word", (F.col("start_ms") + 15).alias("start_ms"), (F.col("end_ms") + 15).alias("end_ms"), "source_file",
        F.lit(0).alias("edited"))


@query("T8_replace_source", "clips", """WITH h AS (SELECT DISTINCT source_id FROM clips WHERE edited = 1 AND tok > 60),
    take AS (SELECT DISTINCT source_id FROM clips WHERE source_id % 2 = 0 AND source_id NOT IN (SELECT source_id FROM h))
    SELECT source_id, clip_id, start_ms, end_ms FROM clips ANTI JOIN take USING (source_id) UNION ALL
    SELECT source_id, clip_id + 50000000000, start_ms + 15, end_ms + 15 FROM clips SEMI JOIN take USING (source_id)""")
def _(t):
    old = t.clips.withColumn("edited", F.when(F.col("tok") > 60, F.col("edited")).otherwise(0)).select(*CLIP)
    return RC.replace_source(old, retaken(t))[0].select("source_id", "clip_id", "start_ms", "end_ms")


@query("J9_remap_pins", "clips", """WITH p AS (SELECT word, clip_id AS k, clip_id, CASE WHEN tok % 3 = 0 THEN start_ms + 20 END AS s, CASE WHEN tok % 3 = 0 THEN end_ms - 40 END AS e, source_id, start_ms AS os, end_ms AS oe FROM clips WHERE tok % 13 = 4),
    n AS (SELECT source_id, word, clip_id + 50000000000 AS nid, start_ms + 15 AS ns, end_ms + 15 AS ne FROM clips),
    o AS (SELECT p.word, k, count(*) AS c, min(nid) AS nid FROM p JOIN n ON n.source_id = p.source_id AND n.word = p.word
      AND CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN ns - 1 <= s AND s < e AND e <= ne + 1 ELSE least(ne, oe) > greatest(ns, os) END GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT p.word, p.k, nid AS clip_id, CASE WHEN nid IS NOT NULL THEN s END AS start_ms, CASE WHEN nid IS NOT NULL THEN e END AS end_ms,
      CASE WHEN nid IS NOT NULL THEN 'remapped' ELSE 'released' END AS state FROM p LEFT JOIN o ON o.word = p.word AND o.k = p.k""")
def _(t):
    cut = F.col("tok") % 3 == 0
    pins = t.clips.where(F.col("tok") % 13 == 4).select("source_id", "word", F.col("clip_id").alias("k"), "clip_id", F.when(cut, F.col("start_ms") + 20).alias("start_ms"),
                                                       F.when(cut, F.col("end_ms") - 40).alias("end_ms"))
    new = t.clips.withColumns({"clip_id": F.col("clip_id") + 50_000_000_000, "start_ms": F.col("start_ms") + 15, "end_ms": F.col("end_ms") + 15})
    return RC.remap_pins(pins, t.clips, new)


_NORM = r"array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g')), ' +'), lambda w: w <> '' AND w NOT IN ('the','a','poem','kids','poems','stories','with')), ' ')"


@query("T9_match_titles", "", rf"""
    WITH d0 AS (SELECT doc_id, array_to_string(regexp_split_to_array(text, '[ \n\t\r]+')[1:6], ' ') AS title FROM documents),
    d AS (SELECT doc_id, {_NORM.format("regexp_replace(title, chr(10), ' ', 'g')")} AS norm FROM d0),
    p0 AS (SELECT coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages),
    p AS (SELECT norm, min(title) AS title FROM (SELECT title, {_NORM.format('title')} AS norm FROM p0) WHERE norm <> '' GROUP BY 1),
    a AS (SELECT DISTINCT norm FROM d WHERE norm <> ''),
    x AS (SELECT a.norm AS an, p.norm AS pn, title, 1 - levenshtein(a.norm, p.norm) / greatest(length(a.norm), length(p.norm)) AS l FROM a JOIN p
      ON list_has_any(string_split(a.norm, ' '), string_split(p.norm, ' ')) OR contains(a.norm, p.norm) OR contains(p.norm, a.norm)),
    s AS (SELECT an, pn, title, round(CASE WHEN contains(an, pn) OR contains(pn, an) THEN greatest(l, 0.9::DOUBLE) ELSE l END, 6) AS score FROM x),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY an ORDER BY score DESC, pn) AS r FROM s) WHERE r = 1)
    SELECT doc_id, title, score FROM d JOIN b ON b.an = d.norm""")
def _(t):
    first = F.array_join(F.slice(F.split("text", "[ \\n\\t\\r]+"), 1, 6), " ")
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " ")), " +"), lambda w: (w != "") & ~w.isin(*TX.TITLE_STOP_WORDS))
    d = t.read("documents").select("doc_id", F.array_join(words(first), " ").alias("norm"))
    p = t.read("pages").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")).withColumn("norm", F.array_join(words(F.col("title")), " "))
    return RC.match_titles(d, p).select("doc_id", "title", "score")


@query("T10_mark_unheard", "clips reports", """SELECT clip_id, kind, count FROM reports UNION ALL SELECT clip_id, 'unheard', 3 FROM clips WHERE edited <> 1 AND tok % 101 = 9""")
def _(t):
    conf = t.clips.select("clip_id", F.when(F.col("tok") % 101 == 9, 0.01).otherwise(0.5).alias("confidence"))
    return RC.mark_unheard(t.clips, conf, t.reports)


# --- live feeds -----------------------------------------------------------------------

def live(t):
    """The event file as a stream."""
    schema = t.read("events").schema
    e = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("W1_stream_votes", "votes", """WITH b AS (SELECT word, clip_id, max(CASE WHEN op = 'reset' THEN seq END) AS bs FROM votes GROUP BY 1, 2)
    SELECT word, clip_id, CAST(sum(CASE WHEN op = 'add' THEN delta ELSE 0 END) AS BIGINT) AS score FROM votes JOIN b USING (word, clip_id) WHERE bs IS NULL OR seq >= bs GROUP BY 1, 2""")
def _(t):
    kind = F.col("event_type")
    v = live(t).select(F.col("event_id").alias("seq"), F.concat(F.lit("w"), F.col("event_id") % 20).alias("word"), (F.col("user_id") % 50).alias("clip_id"),
                       F.when(kind == "signup", "reset").otherwise("add").alias("op"), F.when(kind.isin("purchase", "click"), 1).otherwise(-1).cast("bigint").alias("delta"))
    return FD.run_to_end(FD.stream_votes(v), ["word", "clip_id"]).select("word", "clip_id", "score")


@query("W2_stream_reports", "report_log", "SELECT clip_id, kind, count(*) AS count FROM report_log WHERE kind <> 'odd' GROUP BY 1, 2")
def _(t):
    kind = F.col("event_type")
    r = live(t).select((F.col("user_id") % 50).alias("clip_id"), F.when(kind == "click", "starts early").when(kind == "view", "starts late")
                       .when(kind == "purchase", "ends early").when(kind == "error", "ends late").otherwise("odd").alias("kind"))
    return FD.run_to_end(FD.stream_reports(r), ["clip_id", "kind"])


@query("W3_stream_job_state", "jobs", "SELECT job_id, arg_max(status, (ts, seq)) AS status FROM jobs GROUP BY 1")
def _(t):
    kind = F.col("event_type")
    e = live(t).select("ts", F.col("event_id").alias("seq"), F.col("user_id").alias("job_id"), F.when(kind == "signup", "queued").when(kind.isin("view", "click"), "running")
                       .when(kind == "purchase", "done").otherwise("error").alias("status"))
    return FD.run_to_end(FD.stream_job_state(e), ["job_id"]).select("job_id", "status")


@query("W4_stream_clips", "", "SELECT DISTINCT 'vid' || (event_id % 40) AS video_id, event_type AS word, user_id * 10 AS start_ms FROM events")
def _(t):
    import uuid

    from wordclips.session import shared_folder
    base = f"{shared_folder(t.spark)}/clips-{uuid.uuid4().hex}"
    c = live(t).select("ts", F.concat(F.lit("vid"), F.col("event_id") % 40).alias("video_id"), F.col("event_type").alias("word"), (F.col("user_id") * 10).alias("start_ms"))
    FD.stream_clips(c, lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/state", "60 days").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("video_id", "word", "start_ms")
