"""Queries on pronunciations and splicing (S3, S8, P4-P6, C11, C12, R7, F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordclips.functions import phones as PH
from wordclips.functions import text as TX
from wordclips.operators import index as IX
from wordclips.operators import lexicon as LX
from wordclips.operators import splice as SP
from wordclips.plans.catalog import query

_V = "('AA','AE','AH','EH','IH','IY')"
_SW = """sw AS (SELECT word, phones, n FROM vocab JOIN lexicon USING (word))"""
_TARGETS = """tg AS (SELECT word AS target, phones FROM wanted_lexicon ANTI JOIN vocab USING (word))"""


def sounding(t):
    return SP.sounding_words(t.lexicon, IX.vocabulary(t.index))


def targets(t):
    """Pronounceable words no recording holds."""
    return t.wanted_lexicon.join(IX.vocabulary(t.index).select("word"), "word", "left_anti")


def chars_of(t):
    """Clips with characters spread evenly, besides their phones."""
    span = F.col("end_ms") - F.col("start_ms")
    n = F.length("word")
    chars = F.transform(F.split("word", ""), lambda c, k: F.struct(
        c.alias("ch"), F.floor(span * k / n).alias("start_ms"), F.floor(span * (k + 1) / n).alias("end_ms")))
    return t.aligned.withColumn("chars", F.when(F.col("word").rlike("^[a-z]+$") & (span > 0), chars))


@query("C11_phone_intervals", "aligned", """WITH p AS (SELECT source_id, clip_id, word, start_ms AS s, unnest(phones) AS u, generate_subscripts(phones, 1) - 1 AS pos
      FROM aligned WHERE phones IS NOT NULL)
    SELECT source_id, clip_id, word, pos, u.phone AS phone, s + greatest(u.start_ms, 0) AS start_ms, s + u.end_ms AS end_ms FROM p""")
def _(t):
    return SP.phone_intervals(t.aligned)


@query("C12_subword_span", "aligned", f"""
    WITH a AS (SELECT clip_id, word, phones, 1 AS skip, greatest(1, len(phones) - 1) AS k, len(phones) AS n FROM aligned WHERE phones IS NOT NULL)
    SELECT clip_id, CAST(phones[least(skip, n - 1) + 1].start_ms AS BIGINT) AS cut_start, CAST(CASE WHEN phones[least(k, n)].phone IN {_V} THEN phones[least(k, n)].end_ms
      WHEN k < n THEN least(greatest(phones[k].end_ms, phones[k].start_ms + 55), phones[k + 1].end_ms)
      ELSE greatest(phones[least(k, n)].end_ms, phones[least(k, n)].start_ms + 55) END AS BIGINT) AS cut_end FROM a""")
def _(t):
    a = t.aligned.where(F.col("phones").isNotNull()).withColumn(
        "chars", F.lit(None).cast("array<struct<ch:string,start_ms:bigint,end_ms:bigint>>"))
    k = F.greatest(F.lit(1), F.size("phones") - 1)
    vowel = PH.is_vowel(F.get("phones", k - 1)["phone"])
    return a.select("clip_id", SP.subword_span(F.lit(1), k, vowel).alias("s")).select(
        "clip_id", F.col("s.start_ms").alias("cut_start"), F.col("s.end_ms").alias("cut_end"))


@query("C12_subword_span_letters")
def _(t):
    c = chars_of(t).where(F.col("phones").isNull() & F.col("chars").isNotNull())
    s = SP.subword_span(F.lit(1), F.greatest(F.lit(1), F.floor(F.length("word") / 2)).cast("int"),
                        F.substring("word", -1, 1).isin(*"aeiouy"))
    return c.select("clip_id", "word", s.alias("s")).select("clip_id", "word", "s.start_ms", "s.end_ms")


@query("R7_phone_units", "aligned", f"""
    WITH p AS (SELECT source_id, clip_id, start_ms AS s, unnest(phones) AS u, generate_subscripts(phones, 1) - 1 AS pos FROM aligned WHERE phones IS NOT NULL),
    i AS (SELECT source_id, clip_id, pos, u.phone AS phone, s + greatest(u.start_ms, 0) AS start_ms, s + u.end_ms AS end_ms FROM p),
    k AS (SELECT *, CASE WHEN phone IN {_V} THEN [70, 600, 200] WHEN phone IN ('F','HH','S','V','Z') THEN [50, 400, 140]
      WHEN phone IN ('B','D','G','JH','K','P','T') THEN [30, 200, 70] ELSE [50, 350, 120] END AS b FROM i),
    r AS (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY abs(end_ms - start_ms - b[3]), source_id, start_ms, clip_id, pos) AS rank
      FROM k WHERE end_ms - start_ms BETWEEN b[1] AND b[2])
    SELECT phone, rank, source_id, clip_id, pos, start_ms, end_ms FROM r WHERE rank <= 60""")
def _(t):
    return SP.phone_units(SP.phone_intervals(t.aligned))


@query("F3_phone_index", "vocab lexicon", f"""WITH {_SW} SELECT unnest(phones) AS phone, word, generate_subscripts(phones, 1) - 1 AS pos, n,
    CAST(len(phones) AS BIGINT) AS size FROM sw""")
def _(t):
    return SP.phone_index(sounding(t))


@query("F4_phone_sources", "vocab lexicon clips", f"""WITH {_SW},
    runs AS (SELECT DISTINCT array_to_string(phones[i:i + 1], ' ') AS run FROM sw, (SELECT unnest(range(1, 60)) AS i) WHERE i < len(phones)),
    lg AS (SELECT word, max(end_ms - start_ms) AS longest_ms FROM clips GROUP BY 1),
    h AS (SELECT array_to_string(phones[i:i + 1], ' ') AS run, word, n, i - 1 AS pos, phones FROM sw, (SELECT unnest(range(1, 60)) AS i) WHERE i < len(phones)),
    f AS (SELECT run, word, n, min(pos) AS pos, any_value(phones) AS phones FROM h GROUP BY 1, 2, 3),
    c AS (SELECT f.*, longest_ms, CAST(pos > 0 AS BIGINT) + CAST(pos + 2 < len(phones) AS BIGINT) AS cuts,
      pos + 2 < len(phones) AND phones[pos + 2] IN {_V} AS after_vowel,
      word IN ('{"','".join(PH.FUNCTION_WORDS)}') AS function_word FROM f JOIN lg USING (word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY cuts, after_vowel, function_word, -least(n, 20), longest_ms DESC, word) AS rank FROM c)
    SELECT run, rank, word, pos, cuts, after_vowel, function_word, n FROM r WHERE rank <= 40""")
def _(t):
    w = sounding(t)
    groups = SP.phone_runs(w).where(F.col("m") == 2).select("run")
    longest = t.clips.groupBy("word").agg(F.max(F.col("end_ms") - F.col("start_ms")).alias("longest_ms"))
    return SP.phone_sources(groups, w, longest)


_EDGES = f"""{_SW}, {_TARGETS},
    k AS (SELECT unnest(range(1, 80)) AS i),
    tr AS (SELECT target, a.i - 1 AS i, b.i AS j, array_to_string(phones[a.i:b.i], ' ') AS run, phones[b.i + 1] AS nxt
      FROM tg, k a, k b WHERE b.i >= a.i AND b.i <= len(phones)),
    sr AS (SELECT word, array_to_string(phones[a.i:b.i], ' ') AS run, phones[b.i + 1] AS aft,
      1000 - 80 * (b.i - a.i + 1) + CASE WHEN a.i > 1 THEN 120 ELSE 0 END + CASE WHEN b.i < len(phones) THEN 120 ELSE 0 END
      - 4 * least(n, 10) + CASE WHEN word IN ('{"','".join(PH.FUNCTION_WORDS)}') AND len(list_filter(phones[a.i:b.i], lambda p: p IN {_V})) > 0 THEN 600 ELSE 0 END
      + CASE WHEN b.i < len(phones) AND phones[b.i] IN {_V} THEN 250 ELSE 0 END
      + CASE WHEN a.i > 1 AND phones[a.i - 1] IN {_V} THEN 250 ELSE 0 END AS price
      FROM sw, k a, k b WHERE b.i >= a.i AND b.i <= len(phones)),
    best AS (SELECT run, aft, min(price) AS price, arg_min(word, (price, word)) AS word FROM sr SEMI JOIN (SELECT DISTINCT run FROM tr) USING (run) GROUP BY 1, 2),
    edges AS (SELECT target, i, j, CAST(min(price) AS BIGINT) AS cost, arg_min(word, (price, word)) AS word FROM tr JOIN best USING (run)
      WHERE nxt IS NULL OR aft IS NULL OR nxt <> aft GROUP BY 1, 2, 3)"""


@query("F5_splice_edges", "vocab lexicon wanted_lexicon", f"WITH {_EDGES} SELECT target, i, j, cost, word FROM edges")
def _(t):
    return SP.splice_edges(targets(t), sounding(t)).select("target", "i", "j", "cost", "word")


@query("F6_splice_plan", "vocab lexicon wanted_lexicon", f"""WITH RECURSIVE {_EDGES},
    em AS MATERIALIZED (SELECT target, i, j, cost FROM edges),
    path AS (SELECT target, j AS pos, cost FROM em WHERE i = 0 UNION ALL
      SELECT p.target, e.j, p.cost + e.cost FROM path p JOIN em e ON e.target = p.target AND e.i = p.pos)
    SELECT target, CAST(min(cost) AS BIGINT) AS cost FROM path JOIN tg USING (target) WHERE pos = len(phones) GROUP BY 1""")
def _(t):
    tg = targets(t)
    return SP.splice_plan(tg, SP.splice_edges(tg, sounding(t))).select("target", "cost")


def scarce(t):
    """A vocabulary without some sounds, which leaves words to approximate."""
    return sounding(t).where(~F.array_contains("phones", "SH") & ~F.array_contains("phones", "AE") & ~F.array_contains("phones", "G"))


@query("F7_loose_plan")
def _(t):
    tg = targets(t)
    return SP.splice_plan(tg, SP.splice_edges(tg, scarce(t), "loose")).select("target", "cost", "n_pieces", "approx")


@query("F7_desperate_plan")
def _(t):
    tg = targets(t)
    return SP.splice_plan(tg, SP.splice_edges(tg, scarce(t), "desperate")).select("target", "cost", "n_pieces", "approx")


def recipes(t):
    """A recipe per target: its phones two by two, the first group pinned or preferred."""
    tg = targets(t).where(F.size("phones") >= 2)
    n = F.size("phones")
    any_clip = t.clips.groupBy("word").agg(F.min("clip_id").alias("clip_id"), F.min_by("start_ms", "clip_id").alias("s"),
                                           F.min_by("end_ms", "clip_id").alias("e"))
    src = SP.phone_runs(sounding(t)).where(F.col("m") == 2).groupBy("run").agg(F.min("word").alias("pin_word"))
    tg = tg.withColumn("run", F.array_join(F.slice("phones", 1, 2), " ")).join(src, "run", "left") \
        .join(any_clip.withColumnRenamed("word", "pin_word"), "pin_word", "left")
    pin = F.length("word") % 2 == 0
    groups = F.transform(F.sequence(F.lit(1), n, F.lit(2)), lambda i: F.struct(
        F.slice("phones", i, 2).alias("phones"),
        F.when((i == 1) & F.col("pin_word").isNotNull(), F.array("pin_word")).otherwise(F.array().cast("array<string>")).alias("from"),
        F.when((i == 1) & pin, F.col("clip_id")).alias("clip_id"),
        F.when((i == 1) & pin, F.col("s")).alias("start_ms"), F.when((i == 1) & pin, F.col("e")).alias("end_ms")))
    return tg.select("word", groups.alias("groups"))


@query("F8_apply_recipes")
def _(t):
    phrases = t.index.select(F.col("word").alias("phrase"), "clip_id").limit(0)
    return SP.apply_recipes(recipes(t), targets(t), sounding(t), t.clips, phrases)


@query("F9_limit_units")
def _(t):
    tg = targets(t)
    return SP.limit_units(SP.splice_plan(tg, SP.splice_edges(tg, sounding(t))), 3).select("target", "cost", "n_pieces")


@query("F10_realise_plan")
def _(t):
    tg = targets(t)
    plans = SP.splice_plan(tg, SP.splice_edges(tg, sounding(t)))
    return SP.realise_plan(plans, chars_of(t))


@query("F1_pronounce")
def _(t):
    words = t.clips.select("word").unionByName(t.tokens.select("word"))
    return LX.pronounce(words, t.lexicon)


@query("F2_guess_phones")
def _(t):
    words = t.clips.select("word").distinct().join(t.lexicon.select("word"), "word", "left_anti")
    return LX.guess_phones(words, t.lexicon)


@query("P4_expand_tokens")
def _(t):
    return LX.expand_tokens(TX.written_tokens(t.texts), IX.vocabulary(t.index), t.lexicon)


@query("P5_unstretch")
def _(t):
    return LX.unstretch(TX.written_tokens(t.texts).select(F.col("raw").alias("token")), IX.vocabulary(t.index), t.lexicon)


@query("P6_spelling_variants", "vocab", r"""SELECT word, array_to_string(list_filter([
      CASE WHEN ends_with(word, 'nt') AND length(word) > 3 THEN word[1:length(word) - 1] || '''t' END,
      CASE WHEN ends_with(word, 've') AND length(word) > 2 THEN word[1:length(word) - 2] || '''ve' END,
      CASE WHEN ends_with(word, 'll') AND length(word) > 2 THEN word[1:length(word) - 2] || '''ll' END,
      CASE WHEN ends_with(word, 're') AND length(word) > 2 THEN word[1:length(word) - 2] || '''re' END,
      CASE WHEN ends_with(word, 'd') AND length(word) > 1 THEN word[1:length(word) - 1] || '''d' END,
      CASE WHEN ends_with(word, 's') AND length(word) > 1 THEN word[1:length(word) - 1] || '''s' END,
      CASE WHEN ends_with(word, 'm') AND length(word) > 1 THEN word[1:length(word) - 1] || '''m' END,
      CASE WHEN ends_with(word, 'our') AND length(word) > 4 THEN word[1:length(word) - 3] || 'or' END,
      CASE WHEN ends_with(word, 'ise') AND length(word) > 4 THEN word[1:length(word) - 3] || 'ize' END,
      CASE WHEN ends_with(word, 'ised') AND length(word) > 5 THEN word[1:length(word) - 4] || 'ized' END,
      CASE WHEN ends_with(word, 'ising') AND length(word) > 6 THEN word[1:length(word) - 5] || 'izing' END,
      CASE WHEN ends_with(word, 'isation') AND length(word) > 8 THEN word[1:length(word) - 7] || 'ization' END,
      CASE WHEN ends_with(word, 'yse') AND length(word) > 4 THEN word[1:length(word) - 3] || 'yze' END,
      CASE WHEN ends_with(word, 'ogue') AND length(word) > 5 THEN word[1:length(word) - 4] || 'og' END,
      CASE WHEN ends_with(word, 're') AND length(word) > 4 AND word[length(word) - 2] NOT IN ('a','e','i','o','u') THEN word[1:length(word) - 2] || 'er' END
    ], lambda x: x IS NOT NULL), ' ') AS variants FROM vocab""")
def _(t):
    return IX.vocabulary(t.index).select("word", F.array_join(TX.spelling_variants("word"), " ").alias("variants"))


def pronunciation_files(t):
    """User files made from the vocabulary: ARPAbet, spelt, skipped and respelt lines."""
    words = t.clips.where(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.min("clip_id").alias("line"))
    n = F.col("line") % 5
    arpa = F.when(n == 0, F.lit("=letters")).when(n == 1, F.lit("=skip")).when(n == 2, F.lit("HH AH L OW")) \
        .when(n == 3, F.concat(F.substring("word", 1, 3), F.lit(" t"))).otherwise(F.lit("!!"))
    return words.where(F.length("word") % 4 == 0).select(F.lit(1).alias("layer"), "line", "word", arpa.alias("value"))


_LETTERS = "MAP {" + ", ".join(f"'{c}': ['" + "','".join(v) + "']" for c, v in LX.LETTER_NAMES.items()) + "}"
_FILES_READ = f"""over AS (SELECT word, ['AH'] AS phones FROM lexicon WHERE length(word) % 5 = 1),
    low AS (SELECT word, coalesce(over.phones, lexicon.phones) AS phones FROM lexicon LEFT JOIN over USING (word)),
    f AS (SELECT word, min(clip_id) AS line FROM clips WHERE regexp_full_match(word, '[a-z]+') GROUP BY 1 HAVING length(word) % 4 = 0),
    v AS (SELECT f.*, low.word AS start, CASE line % 5
      WHEN 0 THEN flatten(list_transform(string_split(f.word, ''), lambda c: {_LETTERS}[c]))
      WHEN 2 THEN ['HH','AH','L','OW'] WHEN 3 THEN list_concat(low.phones, ['T']) END AS phones,
      line % 5 < 3 OR line % 5 = 3 AND low.word IS NOT NULL AS good
      FROM f LEFT JOIN low ON low.word = substring(f.word, 1, 3))"""


@query("S3_load_lexicon", "clips lexicon", f"""WITH {_FILES_READ}
    SELECT word, phones FROM v WHERE good UNION ALL SELECT word, phones FROM low WHERE word NOT IN (SELECT word FROM v WHERE good)""")
def _(t):
    none = t.lexicon.where(F.length("word") % 5 == 1).select("word", F.array(F.lit("AH")).alias("phones"))
    return LX.load_lexicon(t.lexicon, none, pronunciation_files(t))[0]


@query("S3_rejected_rows", "clips lexicon", f"""WITH {_FILES_READ}
    SELECT CAST(1 AS INTEGER) AS layer, line, word, CASE line % 5 WHEN 3 THEN substring(word, 1, 3) || ' t' ELSE '!!' END AS value FROM v WHERE NOT good""")
def _(t):
    none = t.lexicon.where(F.length("word") % 5 == 1).select("word", F.array(F.lit("AH")).alias("phones"))
    return LX.load_lexicon(t.lexicon, none, pronunciation_files(t))[1]


@query("S8_effective_lexicon", "clips", """
    WITH w AS (SELECT word, min(clip_id) AS line FROM clips WHERE regexp_full_match(word, '[a-z]+') GROUP BY 1 HAVING length(word) % 4 = 0),
    v AS (SELECT line, word, CASE line % 5 WHEN 0 THEN '=letters' WHEN 1 THEN '=skip' WHEN 2 THEN 'HH AH L OW' WHEN 3 THEN substring(word, 1, 3) || ' t' ELSE '!!' END AS value FROM w)
    SELECT CAST(0 AS INTEGER) AS layer, line, word, value FROM v WHERE line % 2 = 0 UNION ALL SELECT 1, line, word, value FROM v WHERE line % 3 = 0""")
def _(t):
    f = pronunciation_files(t).drop("layer")
    return LX.effective_lexicon(f.where(F.col("line") % 2 == 0), f.where(F.col("line") % 3 == 0))


