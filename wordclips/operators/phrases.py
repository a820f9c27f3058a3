"""Phrases really spoken in a row: runs, covers, continuations (Q*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.functions import text as TX
from wordclips.operators import ordered as O
from wordclips.operators.index import HOUR_MS, hour
from wordclips.session import stored

RUN_GAP_MS = 600
TEXT_CHUNK = 10_000


def phrase_index(clips: DataFrame, ratings: DataFrame, chunk_ms: int = HOUR_MS) -> DataFrame:
    """The clip index with each step to the next clip: its word, and whether a run may take it."""
    on = ["word", *O.by_clip(ratings)]
    kept = clips.where(F.col("end_ms") > F.col("start_ms")).join(ratings.select(*on, "score"), on, "left") \
        .withColumn("vetoed", TX.vetoed("score")).drop("score")
    # Read twice by the scan, so written once: the votes are joined by word and clip.
    out = O.scan(stored(kept, "voted"), ["source_id"], ["start_ms", "clip_id"], hour(width=chunk_ms),
                 idx=O.rank(), prev_end=O.lag("end_ms"), next_start=O.lead("start_ms"),
                 next_word=O.lead("word"), next_vetoed=O.lead("vetoed"))
    gap = F.col("next_start") - F.col("end_ms")
    step = (gap <= RUN_GAP_MS) & ~F.col("vetoed") & ~F.col("next_vetoed")
    return out.withColumns({"idx": F.col("idx") - 1, "gap_after": gap,
                            "step": F.coalesce(step, F.lit(False))}).drop("next_vetoed")


def text_steps(tokens: DataFrame) -> DataFrame:
    """(text_id, pos, word, ends, next_word) of every token."""
    return O.scan(tokens, ["text_id"], ["pos"], O.bucket("pos", TEXT_CHUNK), next_word=O.lead("word"))


def match_runs(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """Every maximal run from every position of a text (Q1).

    Word pairs are joined, and hits that continue each other along a diagonal
    (idx - pos) of one text and source form an island.  The result holds one
    row per hit, so the join makes nothing that is not asked for; for the best
    run alone use ``best_run``, which pairs nothing up.
    """
    q = text_steps(tokens).where(F.col("next_word").isNotNull()).select("text_id", "pos", "word", "next_word")
    c = index.where("step").select("source_id", "idx", "word", "next_word")
    hits = q.join(c, ["word", "next_word"]).withColumn("diag", F.col("idx") - F.col("pos"))
    keys = ["text_id", "source_id", "diag"]
    w = Window.partitionBy(*keys).orderBy("pos")
    isl = hits.withColumn("isl", F.col("pos") - F.row_number().over(w))
    last = F.max("pos").over(Window.partitionBy(*keys, "isl"))
    return isl.select("text_id", "pos", "source_id", F.col("idx").alias("start_idx"),
                      (last - F.col("pos") + 2).alias("length"))


def _hash(*cols) -> Column:
    """128 bits of two words, as 16 bytes: enough to stand for them."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *cols)))


def _hash_both(left, right) -> Column:
    """128 bits of two hashes."""
    return F.unhex(F.md5(F.concat(left, right)))


def _shared(q: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the hashes the other side does not have left out."""
    c = stored(c.join(q.select("h").distinct(), "h", "left_semi"), "blocks")
    q = stored(q.join(c.select("h").distinct(), "h", "left_semi"), "blocks")
    return q, c


def _doubled(df: DataFrame, keys: list[str], place: str, span: int) -> DataFrame:
    """Blocks of twice ``span`` steps from two blocks that follow each other."""
    right = df.select(*keys, (F.col(place) - span).alias(place), F.col("h").alias("h2"))
    return df.join(right, [*keys, place]).select(*keys, place, _hash_both("h", "h2").alias("h"))


def best_run(tokens: DataFrame, index: DataFrame, quality: DataFrame) -> DataFrame:
    """The longest run from every position, ties to the better source, then the first (Q2).

    Blocks of 1, 2, 4, ... steps are matched by hash, keeping on each side only
    what the other side also has, and the longest match of every position is
    then put together from blocks, largest first.  Positions are matched with
    *distinct* hashes and never with each other, so a phrase said a billion
    times costs one row per saying, and the rounds grow with the logarithm of
    the longest run.
    """
    q0 = text_steps(tokens).where(F.col("next_word").isNotNull()).select(
        "text_id", "pos", _hash("word", "next_word").alias("h"))
    c0 = index.where("step").select("source_id", "idx", _hash("word", "next_word").alias("h"))
    qs, cs = ["text_id", "pos"], ["source_id", "idx"]
    levels = []
    q, c = _shared(q0, c0)
    while not q.isEmpty():
        levels.append((q, c))
        span = 2 ** (len(levels) - 1)
        q, c = _shared(_doubled(q, ["text_id"], "pos", span), _doubled(c, ["source_id"], "idx", span))
    if not levels:
        return _named(q0.limit(0).withColumn("s", F.lit(0)), c0.limit(0).withColumn("s", F.lit(0)), quality)

    qst = cst = None
    for k in reversed(range(len(levels))):
        q, c = levels[k]
        span = 2 ** k
        if qst is not None:
            qst, cst = _advance(qst, cst, q, c, span)
        # Positions whose largest block is this one start from it.
        top = q if k + 1 == len(levels) else q.join(levels[k + 1][0].select(*qs), qs, "left_anti")
        new_q = top.withColumn("s", F.lit(span).cast("bigint"))
        new_c = c.join(top.select("h").distinct(), "h", "left_semi").withColumn("s", F.lit(span).cast("bigint"))
        names_q, names_c = [*qs, "s", "h"], [*cs, "s", "h"]
        qst = new_q.select(*names_q) if qst is None else qst.unionByName(new_q.select(*names_q))
        cst = new_c.select(*names_c) if cst is None else cst.unionByName(new_c.select(*names_c))
    return _named(qst, cst, quality)


def _advance(qst: DataFrame, cst: DataFrame, q: DataFrame, c: DataFrame, span: int):
    """Lengthen matches by one block of ``span`` steps where both sides have it."""
    def longer(state, blocks, keys, place):
        nxt = blocks.select(*keys, F.col(place).alias("at"), F.col("h").alias("h2"))
        here = state.withColumn("at", F.col(place) + F.col("s"))
        return here.join(nxt, [*keys, "at"], "left").select(
            *keys, place, "s", "h", F.when(F.col("h2").isNotNull(), _hash_both("h", "h2")).alias("n"))

    ql = longer(qst, q, ["text_id"], "pos")
    cl = longer(cst, c, ["source_id"], "idx")
    both = ql.where(F.col("n").isNotNull()).select("n").distinct().join(
        cl.where(F.col("n").isNotNull()).select("n").distinct(), "n", "left_semi")
    hit = both.select("n", F.lit(True).alias("hit"))
    grown = F.coalesce("hit", F.lit(False))
    qn = stored(ql.join(hit, "n", "left").select(
        "text_id", "pos", (F.col("s") + F.when(grown, span).otherwise(0)).alias("s"),
        F.when(grown, F.col("n")).otherwise(F.col("h")).alias("h")))
    # A saying may serve texts that stop here and texts that go on.
    stay = cl.select("source_id", "idx", "s", "h")
    go = cl.join(both, "n", "left_semi").select("source_id", "idx", (F.col("s") + span).alias("s"),
                                                F.col("n").alias("h"))
    cn = stay.unionByName(go).join(qn.select("h").distinct(), "h", "left_semi")
    return qn, stored(cn)


def _named(qst: DataFrame, cst: DataFrame, quality: DataFrame) -> DataFrame:
    best = cst.join(quality.select("source_id", "quality"), "source_id").groupBy("h").agg(
        F.min(F.struct((-F.col("quality")).alias("nq"), "source_id", "idx")).alias("b"))
    return qst.join(best, "h").select(
        "text_id", "pos", F.col("b.source_id").alias("source_id"), F.col("b.idx").alias("start_idx"),
        (F.col("s") + 1).cast("bigint").alias("length"))


def cover_text(tokens: DataFrame, best: DataFrame) -> DataFrame:
    """Each text read left to right in the longest runs, never across a sentence end (Q3).

    One row per piece: (text_id, pos, length, source_id, start_idx); single
    words have length 1 and no source.
    """
    sent = O.scan(tokens, ["text_id"], ["pos"], O.bucket("pos", TEXT_CHUNK),
                  later_end=O.lead("pos", where=F.col("ends")))
    stop = F.when(F.col("ends"), F.col("pos")).otherwise(F.col("later_end"))
    t = sent.withColumn("stop", stop).join(best, ["text_id", "pos"], "left")
    cap = F.least(F.col("length"), F.col("stop") - F.col("pos") + 1)
    # A position without a run has no length, which ``least`` would skip over.
    run = F.col("length").isNotNull() & (cap >= 2)
    t = t.withColumn("cap", F.when(run, cap).otherwise(F.lit(1)).cast("bigint"))
    # One array of run candidates per text, which came in as one row.
    runs = t.where(F.col("cap") >= 2).groupBy("text_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "cap"))).alias("runs"))
    start = F.struct(F.lit(0).cast("bigint").alias("free"),
                     F.array().cast("array<struct<pos:bigint,cap:bigint>>").alias("kept"))
    picked = F.aggregate("runs", start, lambda acc, r: F.when(
        r["pos"] >= acc["free"], F.struct((r["pos"] + r["cap"]).alias("free"),
                                          F.array_append(acc["kept"], r).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"])
    kept = runs.select("text_id", F.explode(picked).alias("r")).select("text_id", "r.pos", "r.cap")
    inner = kept.select("text_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("cap") - 1)).alias("pos"),
                        F.lit(True).alias("inner"))
    run_rows = t.join(kept.select("text_id", "pos"), ["text_id", "pos"], "left_semi") \
        .select("text_id", "pos", F.col("cap").alias("length"), "source_id", "start_idx")
    singles = t.join(inner, ["text_id", "pos"], "left_anti").select(
        "text_id", "pos", F.lit(1).cast("bigint").alias("length"),
        F.lit(None).cast("bigint").alias("source_id"), F.lit(None).cast("bigint").alias("start_idx"))
    return run_rows.unionByName(singles)


def merge_runs(runs: DataFrame, index: DataFrame) -> DataFrame:
    """One clip per run, tight at its end, with the span of every word (Q4).

    ``runs`` is (source_id, start_idx, length), ``index`` carries ``bleed_risk``.
    """
    keys = ["source_id", "start_idx", "length"]
    wanted = runs.select(*keys).distinct()
    steps = wanted.select(*keys, F.explode(F.sequence(
        F.col("start_idx"), F.col("start_idx") + F.col("length") - 1)).alias("idx"))
    each = steps.join(index.select("source_id", "idx", "clip_id", "word", "start_ms", "end_ms",
                                   "prev_end", "next_start", "bleed_risk"), ["source_id", "idx"])
    g = each.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("idx", "word", "start_ms", "end_ms", "clip_id"))).alias("w"),
        F.min_by("prev_end", "idx").alias("prev_end"),
        F.max_by(F.struct("start_ms", "end_ms", "next_start", "bleed_risk"), "idx").alias("last"))
    last = F.col("last")
    clear = last["next_start"] - F.when(last["bleed_risk"], 160).otherwise(50)
    end = F.when(last["next_start"].isNotNull(), F.greatest(
        F.least(last["end_ms"], clear), last["start_ms"] + 50)).otherwise(last["end_ms"])
    return g.select(
        *keys, F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("words"),
        F.col("w")[0]["start_ms"].alias("start_ms"), end.alias("end_ms"), "prev_end",
        F.transform("w", lambda x: F.struct(x["clip_id"].alias("clip_id"), x["start_ms"].alias("start_ms"),
                                            x["end_ms"].alias("end_ms"))).alias("spans"))


def _grams(index: DataFrame, n: int, chunk_ms: int) -> DataFrame:
    """The index with ``nxt``: word and times of the next ``n`` clips of the source."""
    value = F.struct("word", "start_ms", "end_ms", "clip_id")
    return O.following(index.select("source_id", "clip_id", "word", "start_ms", "end_ms"), ["source_id"],
                       ["start_ms", "clip_id"], hour(width=chunk_ms), value, n, "nxt")


def _unbroken(n: Column) -> Column:
    """Are the first ``n`` steps all without a long pause?"""
    chain = F.concat(F.array(F.struct("word", "start_ms", "end_ms", "clip_id")), F.col("nxt"))
    return F.forall(F.sequence(F.lit(1), n), lambda i: F.get(chain, i)["start_ms"]
                    - F.get(chain, i - 1)["end_ms"] <= RUN_GAP_MS)


def ngram_counts(index: DataFrame, n: int, chunk_ms: int = HOUR_MS) -> DataFrame:
    """How often each unbroken phrase of ``n`` words was said (Q8)."""
    g = _grams(index, n - 1, chunk_ms).where(F.size("nxt") == n - 1)
    if n > 1:
        g = g.where(_unbroken(F.lit(n - 1)))
    words = F.concat_ws(" ", "word", F.transform("nxt", lambda x: x["word"]))
    return g.groupBy(words.alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


def continuations(contexts: DataFrame, index: DataFrame, limit: int = 10,
                  chunk_ms: int = HOUR_MS, longest: int = 4) -> DataFrame:
    """Words that follow the longest known tail of each context (Q5).

    ``contexts`` is (ctx_id, words array, prefix).  Tails shared by many
    contexts are counted once, and only phrases some context ends in are.
    """
    n = F.size("words")
    contexts = contexts.withColumn("prefix", F.coalesce("prefix", F.lit("")))
    tails = contexts.where(n > 0).select(
        "ctx_id", "prefix", "words", F.explode(F.sequence(F.lit(1), F.least(n, F.lit(longest)))).alias("len")) \
        .select("ctx_id", "prefix", "len", F.array_join(F.slice("words", -F.col("len"), F.col("len")), " ").alias("tail"))
    asked = tails.select("len", "tail", "prefix").distinct()
    g = _grams(index, longest, chunk_ms)
    said = g.select("word", "start_ms", "end_ms", "clip_id", "nxt", F.explode(F.sequence(
        F.lit(1), F.greatest(F.lit(1), F.size("nxt")))).alias("len")).where(F.size("nxt") >= F.col("len"))
    said = said.where(_unbroken(F.col("len"))).select(
        "len", F.array_join(F.slice(F.concat(F.array("word"), F.transform("nxt", lambda x: x["word"])),
                                    F.lit(1), F.col("len")), " ").alias("tail"),
        F.get("nxt", F.col("len") - 1)["word"].alias("next"))
    counts = said.join(asked.select("len", "tail").distinct(), ["len", "tail"], "left_semi") \
        .groupBy("len", "tail", "next").agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(asked, ["len", "tail"]).where(F.col("next").startswith(F.col("prefix")))
    w = Window.partitionBy("len", "tail", "prefix").orderBy(F.desc("n"), "next")
    top = found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)
    known = top.where(F.col("rank") == 1).select("len", "tail", "prefix")
    keys = ["len", "tail", "prefix"]
    use = tails.join(known, keys, "left_semi").groupBy("ctx_id").agg(
        F.max(F.struct(*keys)).alias("t")).select("ctx_id", "t.*")
    return use.join(top, keys).select("ctx_id", F.col("len").cast("bigint").alias("matched"), "next", "n", "rank")


def complete_prefix(contexts: DataFrame, vocab: DataFrame, continued: DataFrame, limit: int = 10) -> DataFrame:
    """Corpus words beginning as typed that no continuation already offers (Q6).

    Ranking keeps ``limit`` words more per prefix than asked, as many as the
    continuations of one context can take away, before contexts are joined.
    """
    typed = contexts.where(F.length("prefix") > 0).select("ctx_id", "prefix")
    heads = vocab.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k")) \
        .select("word", "n", F.expr("substring(word, 1, k)").alias("prefix"))
    per = Window.partitionBy("prefix").orderBy(F.desc("n"), "word")
    top = heads.join(typed.select("prefix").distinct(), "prefix", "left_semi") \
        .withColumn("r", F.row_number().over(per)).where(F.col("r") <= 2 * limit)
    left = typed.join(top, "prefix").join(
        continued.select("ctx_id", F.col("next").alias("word")), ["ctx_id", "word"], "left_anti")
    w = Window.partitionBy("ctx_id").orderBy(F.desc("n"), "word")
    return left.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit) \
        .select("ctx_id", "word", "n", "rank")


def phrase_takes(index: DataFrame, phrases: DataFrame, chunk_ms: int = HOUR_MS) -> DataFrame:
    """Clips of a phrase's last word said right after its other words (Q7).

    ``phrases`` is (phrase), of two words or more.  Pauses do not matter here;
    clips over 40 ms do.
    """
    sizes = phrases.select("phrase", F.size(F.split("phrase", " ")).alias("len")).where("len > 1").distinct()
    longest = max(2, sizes.agg(F.max("len")).first()[0] or 0)
    g = _grams(index, longest - 1, chunk_ms)
    said = g.select("source_id", "nxt", "word", F.explode(F.sequence(F.lit(1), F.greatest(
        F.lit(1), F.size("nxt")))).alias("k")).where(F.size("nxt") >= F.col("k"))
    last = F.get("nxt", F.col("k") - 1)
    said = said.select("source_id", last.alias("c"), (F.col("k") + 1).alias("len"), F.concat_ws(
        " ", "word", F.transform(F.slice("nxt", F.lit(1), F.col("k")), lambda x: x["word"])).alias("phrase"))
    return said.where(F.col("c.end_ms") - F.col("c.start_ms") > 40).join(
        sizes, ["phrase", "len"], "left_semi").select(
        "phrase", "source_id", F.col("c.clip_id").alias("clip_id"))


def token_status(tokens: DataFrame, cover: DataFrame, takes: DataFrame, spliceable: DataFrame) -> DataFrame:
    """run, found, spliced or missing for every token of a text.

    ``takes`` lists words with a playable take, ``spliceable`` words that can
    be put together.
    """
    runs = cover.where(F.col("length") >= 2)
    inner = runs.select("text_id", F.explode(F.sequence(
        F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("pos"), F.lit(True).alias("in_run"))
    t = tokens.join(inner, ["text_id", "pos"], "left") \
        .join(takes.select("word", F.lit(True).alias("has")), "word", "left") \
        .join(spliceable.select("word", F.lit(True).alias("can")), "word", "left")
    status = F.when(F.col("in_run"), "run").when(F.col("has"), "found") \
        .when(F.col("can"), "spliced").otherwise("missing")
    return t.select("text_id", "pos", "word", status.alias("status"))


def coverage_report(statuses: DataFrame) -> DataFrame:
    """Tokens of each status per text, and the share that can be said."""
    names = ["run", "found", "spliced", "missing"]
    p = statuses.groupBy("text_id").agg(F.count(F.lit(1)).alias("tokens"), *[
        F.sum((F.col("status") == s).cast("bigint")).alias(s) for s in names])
    return p.withColumn("said_share", F.round(1 - F.col("missing") / F.col("tokens"), 6))
