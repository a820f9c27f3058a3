"""Words put together from the sounds of other words.

All matching is between *distinct* phone runs: every run of phones the
vocabulary holds is reduced to its cheapest source before any target meets it,
so a sound that half the corpus makes never pairs up with every target.
Costs are whole thousandths, so that equal plans compare equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.functions.phones import (
    AFFRICATE_TAIL, FUNCTION_WORDS, canonical, is_vowel, near_phone_dim, phone_dim)
from wordclips.operators.index import MIN_USABLE_MS
from wordclips.session import cut_lineage, stored

UNIT, PER_PHONE, PER_CUT, COMMON, REDUCED, AFTER_VOWEL = 1000, 80, 120, 4, 600, 250
SUBSTITUTE, HALF, SKIP, DISLIKED = 10_000, 2_000, 25_000, 700
INF = 2 ** 60
UNITS_KEPT = 60


# --- phone intervals ---------------------------------------------------------

def phones_of(phones: str = "phones") -> Column:
    """The phones to explode, none where a clip has no array.

    Exploding a bare column has Spark filter by it first, and a filter and a
    generator each work the whole array out again where it is made on the way.
    """
    return F.when(F.size(phones) > 0, F.col(phones))


def phone_intervals(clips: DataFrame) -> DataFrame:
    """Absolute span of every aligned phone (C11)."""
    return clips.select("source_id", "clip_id", "word", "start_ms", F.posexplode(phones_of()).alias("pos", "p")).select(
        "source_id", "clip_id", "word", F.col("pos").cast("bigint").alias("pos"), F.col("p.phone").alias("phone"),
        (F.col("start_ms") + F.greatest(F.col("p.start_ms"), F.lit(0))).alias("start_ms"),
        (F.col("start_ms") + F.col("p.end_ms")).alias("end_ms"))


def phone_units(intervals: DataFrame, keep: int = UNITS_KEPT) -> DataFrame:
    """Per phone, the instances nearest the length it ought to have."""
    dim = F.broadcast(phone_dim(intervals.sparkSession))
    dur = F.col("end_ms") - F.col("start_ms")
    fit = intervals.join(dim, "phone").where(dur.between(F.col("lo_ms"), F.col("hi_ms")))
    w = Window.partitionBy("phone").orderBy(F.abs(dur - F.col("want_ms")), "source_id", "start_ms", "clip_id", "pos")
    return fit.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= keep) \
        .select("phone", "rank", "source_id", "clip_id", "pos", "start_ms", "end_ms")


# Letters that are one sound together, in the order tried.
GRAPHEMES = ("tch sch th sh ch ph wh ck ng qu gh oo ee ea ai ay oa ow ou oy oi au aw ew ie igh ar er ir or ur").split()


def grapheme_sizes(word: Column) -> Column:
    """Lengths of the letter groups of a word."""
    found = F.regexp_extract_all(F.lower(word), F.lit("(" + "|".join([*GRAPHEMES, "."]) + ")"), F.lit(1))
    return F.transform(found, lambda g: F.length(g))


def subword_span(skip: Column, k: Column, last_vowel: Column, phones="phones", chars="chars", word="word") -> Column:
    """Clip-relative (start, end) of the phones after ``skip`` up to the ``k``-th.

    Aligned phones decide where a clip has them.  Otherwise aligned characters
    (ch, start_ms, end_ms) are used by letter groups; without either, null.
    """
    p, c = F.col(phones), F.col(chars)
    n = F.size(p)
    has = p.isNotNull() & (n > 0)
    first = F.when(skip <= 0, F.get(p, 0)["start_ms"]).otherwise(F.get(p, F.least(skip, n - 1).cast("int"))["start_ms"])
    at = F.get(p, (F.least(k, n) - 1).cast("int"))
    end = F.when(k > 0, at["end_ms"]).otherwise(F.get(p, 0)["start_ms"])
    held = F.greatest(end, at["start_ms"] + 55)
    held = F.when(k < n, F.least(held, F.get(p, k.cast("int"))["end_ms"])).otherwise(held)
    end = F.when(~last_vowel & (k > 0), held).otherwise(end)

    m = F.size(c)
    groups = grapheme_sizes(F.col(word))
    final = F.get(c, m - 1)["end_ms"]
    upto = lambda q: F.aggregate(F.slice(groups, F.lit(1), F.greatest(q, F.lit(0)).cast("int")), F.lit(0), lambda a, x: a + x)
    i0, i1 = upto(skip), upto(k)
    c_first = F.when(skip <= 0, F.get(c, 0)["start_ms"]).when((skip >= F.size(groups)) | (i0 >= m), final) \
        .otherwise(F.get(c, i0)["start_ms"])
    # Through a vowel written with more letters than were counted.
    rest = F.slice(c, i1 + 1, F.greatest(m - i1, F.lit(0)))
    run = F.aggregate(rest, F.struct(F.lit(True).alias("go"), F.get(c, i1)["start_ms"].alias("t")), lambda a, x: F.when(
        a["go"] & F.lower(x["ch"]).isin(*"aeiouy"), F.struct(F.lit(True).alias("go"), x["end_ms"].alias("t")))
        .otherwise(F.struct(F.lit(False).alias("go"), a["t"].alias("t"))), lambda a: a["t"])
    prev = F.get(c, i1 - 1)
    firm = F.least(F.greatest(prev["end_ms"] + 30, prev["start_ms"] + 55), F.get(c, i1)["start_ms"])
    c_end = F.when((k >= F.size(groups)) | (i1 >= m), final).when(i1 == 0, F.get(c, 0)["start_ms"]) \
        .when(last_vowel, run).otherwise(firm)
    has_c = c.isNotNull() & (m > 0)
    return F.when(has, F.struct(first.alias("start_ms"), end.alias("end_ms"))) \
        .when(has_c, F.struct(c_first.alias("start_ms"), c_end.alias("end_ms")))


# --- phone runs -----------------------------------------------------------------

def sounding_words(lexicon: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, phones, n): words with takes, their phones canonical and takes counted."""
    return vocab.join(lexicon.where(F.size("phones") > 0), "word").select(
        "word", F.transform("phones", lambda p: canonical(p)).alias("phones"), "n")


def phone_index(words: DataFrame) -> DataFrame:
    """Where each phone occurs in each word."""
    return words.select("word", "n", F.size("phones").cast("bigint").alias("size"),
                        F.posexplode("phones").alias("pos", "phone")) \
        .select("phone", "word", F.col("pos").cast("bigint").alias("pos"), "n", "size")


def phone_runs(words: DataFrame, name: str = "phones") -> DataFrame:
    """Every run of consecutive phones: (.., i, m, run).

    Some sixty rows a word, which Spark takes for one: joins with them are
    merged, or their hundreds of MB would be collected to be broadcast.
    """
    n = F.size(name)
    return words.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")) \
        .select("*", F.explode(F.sequence(F.lit(1), F.size(name) - F.col("i"))).alias("m")) \
        .withColumn("run", F.array_join(F.slice(name, F.col("i") + 1, F.col("m")), " "))


def priced_runs(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """Runs of the vocabulary that are ``wanted`` (run), with the phone after and the price.

    The price is that of one piece cut from this word: cheaper when longer and
    when the word is common, dearer per cut, after a vowel and from a word
    said with a reduced vowel.
    """
    r = phone_runs(words.where(F.size("phones") > 0)).join(wanted.select("run").hint("merge"), "run", "left_semi")
    size = F.size("phones")
    front, end = F.col("i") > 0, F.col("i") + F.col("m") < size
    piece = F.slice("phones", F.col("i") + 1, F.col("m"))
    last = F.element_at(piece, -1)
    before = F.get("phones", F.col("i") - 1)
    weak = F.col("word").isin(*FUNCTION_WORDS) & F.exists(piece, is_vowel)
    one = lambda c, v: F.when(c, v).otherwise(0)
    price = (UNIT - PER_PHONE * F.col("m") + one(front, PER_CUT) + one(end, PER_CUT)
             - COMMON * F.least(F.col("n"), F.lit(10)) + one(weak, REDUCED)
             + one(end & is_vowel(last), AFTER_VOWEL) + one(front & F.coalesce(is_vowel(before), F.lit(False)), AFTER_VOWEL))
    return r.select("run", F.get("phones", F.col("i") + F.col("m")).alias("after"),
                    F.col("m").cast("bigint").alias("m"), price.cast("bigint").alias("price"), "word",
                    F.col("i").cast("bigint").alias("word_pos"), size.cast("bigint").alias("word_size"))


_PIECE = ["price", "word", "word_pos", "word_size"]


def cheapest_runs(priced: DataFrame) -> DataFrame:
    """One source per (run, phone after it)."""
    return priced.groupBy("run", "after").agg(F.max("m").alias("m"), F.min(F.struct(*_PIECE)).alias("s")) \
        .select("run", "after", "m", "s.*")


def phone_sources(groups: DataFrame, words: DataFrame, longest: DataFrame, limit: int = 40) -> DataFrame:
    """Words holding each run of phones, best first.

    ``groups`` is (run), ``longest`` (word, longest_ms).  A word counts once,
    for its first match.
    """
    hits = phone_runs(words).join(groups.select("run").distinct(), "run", "left_semi")
    first = hits.groupBy("run", "word").agg(F.min("i").alias("pos"), F.max("m").alias("m"),
                                            F.first("phones").alias("phones"), F.first("n").alias("n"))
    front, end = F.col("pos") > 0, F.col("pos") + F.col("m") < F.size("phones")
    t = first.join(longest, "word").withColumns({
        "cuts": front.cast("bigint") + end.cast("bigint"),
        "after_vowel": end & is_vowel(F.get("phones", F.col("pos") + F.col("m") - 1)),
        "function_word": F.col("word").isin(*FUNCTION_WORDS)})
    w = Window.partitionBy("run").orderBy("cuts", "after_vowel", "function_word", -F.least(F.col("n"), F.lit(20)),
                                          F.desc("longest_ms"), "word")
    return t.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit) \
        .select("run", "rank", "word", F.col("pos").cast("bigint").alias("pos"), "cuts", "after_vowel", "function_word", "n")


# --- edges and plans ---------------------------------------------------------------

def splice_edges(targets: DataFrame, words: DataFrame, mode: str = "strict",
                 disliked: DataFrame | None = None) -> DataFrame:
    """The cheapest piece for every stretch (i, j) of every target's phones.

    A piece is always the longest match from where it starts.  ``loose`` adds
    stand-ins one feature away and the back half of an affricate,
    ``desperate`` also stepping over a phone.  ``disliked`` is (target, word,
    votes): sources voted down for a target cost more there.  Both inputs are
    read several times, and may come from whole corpora, so they are written once.
    """
    targets, words = stored(targets.select("word", "phones"), "targets"), stored(words, "words")
    t = targets.where(F.size("phones") > 0).select(
        F.col("word").alias("target"), F.transform("phones", lambda p: canonical(p)).alias("phones"))
    tr = phone_runs(t).select("target", F.col("i").cast("bigint").alias("i"), (F.col("i") + F.col("m")).cast("bigint").alias("j"),
                              "run", F.get("phones", F.col("i") + F.col("m")).alias("next"))
    wanted = tr.select("run").distinct()
    if mode == "strict":
        pairs, priced = None, priced_runs(words, wanted)
    else:
        pairs = near_runs(t, words)
        priced = priced_runs(words, pairs.select(F.col("said").alias("run")).distinct())
    stop = _stops(pairs is not None, targets)
    edges = _best_edges(tr, cheapest_runs(priced), pairs, stop)
    if disliked is not None:
        some = disliked.select("target").distinct()
        # Only targets somebody voted about meet their sources one by one.
        own = tr.join(some, "target", "left_semi")
        single = _best_edges(own, priced, pairs, stop, disliked)
        edges = edges.join(some, "target", "left_anti").unionByName(single)
    if mode != "strict":
        edges = edges.unionByName(_half_edges(t, words))
    if mode == "desperate":
        steps = t.select("target", F.explode(F.sequence(F.lit(0), F.size("phones") - 1)).alias("i"))
        edges = edges.unionByName(steps.select(
            "target", F.col("i").cast("bigint").alias("i"), (F.col("i") + 1).cast("bigint").alias("j"),
            F.lit(SKIP).cast("bigint").alias("cost"), F.lit(None).cast("string").alias("word"),
            F.lit(None).cast("bigint").alias("word_pos"), F.lit(None).cast("bigint").alias("word_size"),
            F.lit("skip").alias("kind")))
    best = edges.groupBy("target", "i", "j").agg(F.min(F.struct("cost", "kind", "word", "word_pos", "word_size")).alias("e"))
    return best.select("target", "i", "j", "e.*")


def _stops(loose: bool, df: DataFrame):
    """Keeps matches that could not have gone on for one more phone."""
    if not loose:
        def strict(d: DataFrame) -> DataFrame:
            return d.where(F.col("next").isNull() | F.col("after").isNull() | (F.col("next") != F.col("after")))
        return strict
    near = F.broadcast(near_phone_dim(df.sparkSession).select(
        F.col("phone").alias("next"), F.col("near").alias("after"), F.lit(True).alias("__near")))

    def loosely(d: DataFrame) -> DataFrame:
        d = d.join(near, ["next", "after"], "left")
        on = (F.col("next") == F.col("after")) | F.coalesce("__near", F.lit(False))
        return d.where(~F.coalesce(on, F.lit(False))).drop("__near")
    return loosely


def _best_edges(tr, sources, pairs, stop, disliked=None) -> DataFrame:
    """The cheapest source for every stretch of ``tr`` (target, i, j, run, next).

    What a stretch costs follows from its run and the phone after it, so each such
    pair is priced once, from one source per run and phone after that, and the
    stretches of all targets look it up.  Only targets with votes of their own
    are priced one by one.
    """
    said = F.struct("cost", "kind", "word", "word_pos", "word_size")
    if pairs is None:
        s = sources.drop("m").withColumn("subs", F.lit(0))
    else:
        s = pairs.hint("merge").join(sources.drop("m").withColumnRenamed("run", "said"), "said")
    s = s.withColumns({"cost": (F.col("price") + SUBSTITUTE * F.col("subs")).cast("bigint"),
                       "kind": F.when(F.col("subs") > 0, "near").otherwise("piece")})
    if disliked is not None:
        d = stop(tr.hint("merge").join(s, "run")).join(disliked, ["target", "word"], "left") \
            .withColumn("cost", (F.col("cost") + DISLIKED * F.coalesce("votes", F.lit(0))).cast("bigint"))
        found = d.groupBy("target", "i", "j").agg(F.min(said).alias("e"))
    else:
        if pairs is not None:
            s = s.groupBy("run", "after").agg(F.min(said).alias("e")).select("run", "after", "e.*")
        best = stop(tr.select("run", "next").distinct().hint("merge").join(s, "run")).groupBy("run", "next").agg(F.min(said).alias("e"))
        # The last stretch of a target has no phone after it.
        best = best.select(F.col("run"), F.coalesce("next", F.lit("")).alias("__next"), "e")
        found = tr.withColumn("__next", F.coalesce("next", F.lit(""))).hint("merge").join(best, ["run", "__next"])
    return found.select("target", "i", "j", F.col("e.cost").alias("cost"), F.col("e.word").alias("word"),
                        F.col("e.word_pos").alias("word_pos"), F.col("e.word_size").alias("word_size"), F.col("e.kind").alias("kind"))


def near_runs(targets: DataFrame, words: DataFrame) -> DataFrame:
    """(run, said, subs): every run wanted with the vocabulary's runs that may stand for it.

    Grown one phone at a time over distinct runs only; a pair is dropped as
    soon as the vocabulary has no such run.
    """
    spark = targets.sparkSession
    dim = near_phone_dim(spark)
    same = dim.select("phone").distinct()
    alike = dim.unionByName(same.select("phone", F.col("phone").alias("near")))
    every = phone_dim(spark).select("phone", F.col("phone").alias("near"))
    alike = F.broadcast(alike.unionByName(every).distinct())
    want = phone_runs(targets).select("run", F.col("m")).distinct()
    want = want.select("run", "m", F.regexp_replace("run", r" ?[^ ]+$", "").alias("head"),
                       F.regexp_extract("run", r"([^ ]+)$", 1).alias("phone"))
    have = cut_lineage(phone_runs(words).select("run", "m").distinct())
    want = cut_lineage(want)
    level, out, m = None, None, 1
    while True:
        w = want.where(F.col("m") == m).join(alike, "phone")
        changed = (F.col("phone") != F.col("near")).cast("int")
        if level is None:
            nxt = w.select("run", F.col("near").alias("said"), changed.alias("subs"))
        else:
            prev = level.select(F.col("run").alias("head"), F.col("said").alias("said0"), F.col("subs").alias("subs0"))
            nxt = w.hint("merge").join(prev, "head").select("run", F.concat_ws(" ", "said0", "near").alias("said"),
                                              (F.col("subs0") + changed).alias("subs"))
        real = have.where(F.col("m") == m).select(F.col("run").alias("said"))
        level = cut_lineage(nxt.join(real.hint("merge"), "said", "left_semi").select("run", "said", "subs"))
        out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            return out
        m += 1


def _half_edges(t: DataFrame, words: DataFrame) -> DataFrame:
    """The fricative inside an affricate, for a phone wanted on its own."""
    tails = F.create_map(*[F.lit(x) for kv in AFFRICATE_TAIL.items() for x in kv])
    idx = phone_index(words).withColumn("half", F.try_element_at(tails, "phone")).where(F.col("half").isNotNull())
    src = idx.groupBy("half").agg(F.min(F.struct("word", "pos", "size")).alias("s"))
    wants = t.select("target", F.posexplode("phones").alias("i", "half")).where(F.col("half").isin(*set(AFFRICATE_TAIL.values())))
    return wants.join(src, "half").select(
        "target", F.col("i").cast("bigint").alias("i"), (F.col("i") + 1).cast("bigint").alias("j"),
        F.lit(UNIT + HALF).cast("bigint").alias("cost"), F.col("s.word").alias("word"),
        F.col("s.pos").alias("word_pos"), F.col("s.size").alias("word_size"), F.lit("half").alias("kind"))


def splice_plan(targets: DataFrame, edges: DataFrame, guessed: DataFrame | None = None) -> DataFrame:
    """The cheapest cover of every target's phones.

    One fold over the edges of a target in order of where they start: a
    target's phones and so its edges are few, and came in as one row.  Gives
    (target, cost, pieces, n_pieces, approx).
    """
    e = F.struct("i", "j", "cost", "word", "word_pos", "word_size", "kind")
    sizes = targets.where(F.size("phones") > 0).select(F.col("word").alias("target"), F.size("phones").alias("n"))
    g = edges.groupBy("target").agg(F.sort_array(F.collect_list(e)).alias("es")).join(sizes, "target")
    cell = F.struct(F.lit(INF).cast("bigint").alias("cost"), F.lit(-1).alias("via"))
    zero = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit(-1).alias("via"))
    table = F.concat(F.array(zero), F.array_repeat(cell, F.col("n")))
    es = F.transform("es", lambda x, k: F.struct(x["i"].cast("int").alias("i"), x["j"].cast("int").alias("j"),
                                                 x["cost"].alias("cost"), k.alias("k")))

    def relax(acc: Column, x: Column) -> Column:
        c = F.get(acc, x["i"])["cost"] + x["cost"]
        better = (F.get(acc, x["i"])["cost"] < INF) & (c < F.get(acc, x["j"])["cost"])
        return F.when(better, F.transform(acc, lambda v, q: F.when(
            q == x["j"], F.struct(c.alias("cost"), x["k"].alias("via"))).otherwise(v))).otherwise(acc)

    p = g.select("target", "n", "es", F.aggregate(es, table, relax).alias("dp"))
    p = p.where(F.get("dp", F.col("n"))["cost"] < INF)
    empty = F.array().cast("array<int>")
    back = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.struct(F.col("n").alias("at"), empty.alias("path")), lambda a, _: F.when(
        a["at"] > 0, F.struct(F.get("es", F.get("dp", a["at"])["via"])["i"].cast("int").alias("at"),
                              F.concat(F.array(F.get("dp", a["at"])["via"]), a["path"]).alias("path"))).otherwise(a),
        lambda a: a["path"])
    p = p.select("target", F.get("dp", F.col("n"))["cost"].alias("cost"),
                 F.transform(back, lambda k: F.get("es", k)).alias("pieces"))
    heard = F.filter("pieces", lambda x: x["kind"] != "skip")
    approx = F.exists("pieces", lambda x: x["kind"].isin("near", "skip"))
    out = p.select("target", "cost", heard.alias("pieces"), F.size(heard).cast("bigint").alias("n_pieces"), approx.alias("approx")) \
        .where(F.col("n_pieces") > 0)
    if guessed is not None:
        out = out.join(guessed.select(F.col("word").alias("target"), F.lit(True).alias("g")), "target", "left") \
            .withColumn("approx", F.col("approx") | F.coalesce("g", F.lit(False))).drop("g")
    return out


def limit_units(plans: DataFrame, max_units: int = 8) -> DataFrame:
    """Plans with few enough pieces (F9); the limit is held to 2..24."""
    return plans.where(F.col("n_pieces") <= max(2, min(24, max_units)))


# --- recipes ----------------------------------------------------------------------

RECIPE = ("array<struct<phones:array<string>,from:array<string>,clip_id:bigint,start_ms:bigint,end_ms:bigint>>")


def apply_recipes(recipes: DataFrame, targets: DataFrame, words: DataFrame, takes: DataFrame,
                  phrase_clips: DataFrame) -> DataFrame:
    """Saved recipes that still hold: one row per group (F8).

    ``recipes`` is (word, groups); ``takes`` the clips; ``phrase_clips`` is
    (phrase, clip_id) of spoken phrases.  A pinned cut is used while its clip
    is the same word and contains it, else the preferred sources in order,
    else the word with the fewest cuts.  A recipe with a group nothing can
    supply is left out altogether.
    """
    t = targets.select("word", F.transform("phones", lambda p: canonical(p)).alias("phones"))
    ok = recipes.join(t, "word").where(F.flatten(F.transform("groups", lambda g: g["phones"])) == F.col("phones"))
    g = ok.select("word", F.posexplode("groups").alias("k", "g")).select(
        "word", "k", F.array_join("g.phones", " ").alias("run"), F.col("g.from").alias("prefer"),
        F.col("g.clip_id").alias("pin"), F.col("g.start_ms").alias("pin_start"), F.col("g.end_ms").alias("pin_end"))
    hits = phone_runs(words).join(g.select("run").distinct(), "run", "left_semi").groupBy("run", F.col("word").alias("source")).agg(
        F.min("i").alias("pos"), F.max("m").alias("m"), F.max(F.size("phones")).alias("size"))
    hits = hits.withColumn("cuts", (F.col("pos") > 0).cast("int") + (F.col("pos") + F.col("m") < F.col("size")).cast("int"))
    clip = takes.select(F.col("clip_id").alias("pin"), F.col("word").alias("source"), "start_ms", "end_ms")
    inside = (F.col("start_ms") - 1 <= F.col("pin_start")) & (F.col("pin_start") < F.col("pin_end")) \
        & (F.col("pin_end") <= F.col("end_ms") + 1)
    pinned = g.where(F.col("pin").isNotNull()).join(clip, "pin").where(
        (F.col("source") == F.get("prefer", 0)) & inside).join(hits, ["run", "source"]) \
        .select("word", "k", F.lit(0).alias("way"), F.lit(0).alias("at"), F.lit(0).alias("cuts"), "source",
                F.col("pin").alias("clip_id"), "pos")
    pref = g.select("word", "k", "run", F.posexplode("prefer").alias("at", "p")).withColumn(
        "source", F.regexp_replace(F.element_at(F.split("p", " "), -1), r"^\*|:.*$", ""))
    said = phrase_clips.groupBy(F.col("phrase").alias("p")).agg(F.min("clip_id").alias("clip_id"))
    wanted = pref.join(hits.select("run", "source", "pos"), ["run", "source"]).join(said, "p", "left") \
        .where(~F.col("p").contains(" ") | F.col("clip_id").isNotNull()) \
        .select("word", "k", F.lit(1).alias("way"), "at", F.lit(0).alias("cuts"), "source", "clip_id", "pos")
    least = hits.groupBy("run").agg(F.min(F.struct("cuts", "source", "pos")).alias("h"))
    any_word = g.join(least, "run").select("word", "k", F.lit(2).alias("way"), F.lit(0).alias("at"), F.col("h.cuts").alias("cuts"),
                                           F.col("h.source").alias("source"), F.lit(None).cast("bigint").alias("clip_id"), F.col("h.pos").alias("pos"))
    best = pinned.unionByName(wanted).unionByName(any_word).groupBy("word", "k").agg(
        F.min(F.struct("way", "at", "cuts", "source", "clip_id", "pos")).alias("b"))
    whole = best.groupBy("word").agg(F.count(F.lit(1)).alias("got")).join(
        ok.select("word", F.size("groups").alias("n")), "word").where(F.col("got") == F.col("n")).select("word")
    return best.join(whole, "word", "left_semi").select(
        "word", F.col("k").cast("bigint").alias("k"), "b.way", "b.source", "b.clip_id", F.col("b.pos").cast("bigint").alias("pos"))


def realise_plan(plans: DataFrame, takes: DataFrame, disliked: DataFrame | None = None) -> DataFrame:
    """A take and a span for every planned piece.

    ``takes`` carries ``phones`` and ``chars``.  Takes long enough to hear come
    first, the shortest of them; voted-down ones last.  Where no take of the
    word can be cut, its longest take is played whole.
    """
    p = plans.select("target", F.posexplode("pieces").alias("k", "p")).select(
        "target", F.col("k").cast("bigint").alias("k"), "p.word", F.col("p.word_pos").alias("skip"),
        (F.col("p.word_pos") + F.col("p.j") - F.col("p.i")).alias("upto"), (F.col("p.j") - F.col("p.i")).alias("m"))
    # Equal pieces of a word are cut once, whatever targets want them, unless a target has votes of its own.
    spec = [*(["target"] if disliked is not None else []), "word", "skip", "upto", "m"]
    p = stored(p.distinct(), "pieces")
    t = takes.where(F.col("end_ms") - F.col("start_ms") >= MIN_USABLE_MS)
    j = p.select(*spec).distinct().join(
        t.select("word", "clip_id", "source_id", "start_ms", "end_ms", "phones", "chars"), "word")
    piece = F.slice("phones", F.col("skip").cast("int") + 1, F.col("m").cast("int"))
    vowel_end = F.coalesce(is_vowel(F.get("phones", (F.col("upto") - 1).cast("int"))["phone"]), F.lit(True))
    span = subword_span(F.col("skip"), F.col("upto"), vowel_end)
    dur = F.col("end_ms") - F.col("start_ms")
    floor = F.col("m") * 50 + F.when(F.exists(piece, lambda x: is_vowel(x["phone"])), 50).otherwise(0)
    votes = F.lit(0)
    if disliked is not None:
        j = j.join(disliked, ["target", "clip_id"], "left")
        votes = F.coalesce("votes", F.lit(0))
    j = j.select(*spec, "clip_id", "source_id", "start_ms", dur.alias("dur"), span.alias("span"),
                 (dur < floor).cast("int").alias("short"), votes.alias("votes_")) \
        .select(*spec, "clip_id", "source_id", "start_ms", "dur", "short", "votes_",
                F.col("span.start_ms").alias("lo"), F.col("span.end_ms").alias("hi"))
    usable = F.coalesce(F.col("hi") > F.col("lo"), F.lit(False))
    # The first take of each length, in plain numbers that Spark adds up without sorting takes by piece.
    order = F.coalesce("clip_id", F.lit(0))
    j = j.groupBy(*spec, "votes_", "short", "dur", usable.alias("usable"), F.col("clip_id").isNull().alias("lost")).agg(
        F.min("clip_id").alias("clip_id"), *[F.min_by(c, order).alias(c) for c in ("source_id", "start_ms", "lo", "hi")])
    place = F.struct("votes_", "short", F.when(F.col("short") == 0, F.col("dur")).otherwise(-F.col("dur")), "clip_id")
    take = F.struct("clip_id", "source_id", (F.col("start_ms") + F.col("lo")).alias("cut_start"),
                    (F.col("start_ms") + F.col("hi")).alias("cut_end"))
    whole = F.struct("clip_id", "source_id", F.col("start_ms").alias("cut_start"),
                     (F.col("start_ms") + F.col("dur")).alias("cut_end"))
    g = j.groupBy(*spec).agg(
        F.min_by(take, F.when(F.col("usable"), place)).alias("cut"),
        F.max_by(whole, F.struct("dur", -F.col("clip_id"))).alias("whole"))
    g = g.select(*spec, F.col("cut").isNotNull().alias("is_cut"), F.coalesce("cut", "whole").alias("t"))
    return p.join(g, spec).select("target", "k", "word", "is_cut", "t.*")
