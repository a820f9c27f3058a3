import random

from pyspark.sql import functions as F

from tests import models
from wordclips.functions import text as TX
from wordclips.operators import captions as CA
from wordclips.operators import index as IX
from wordclips.operators import phrases as PR


def corpus(spark, seed, n_sources=4, n=60, vocab="abcd"):
    r = random.Random(seed)
    rows, sources = [], {}
    for s in range(n_sources):
        t, seq = 0, []
        for i in range(n):
            t += r.choice([100, 300, 900, 1500])
            e = t + r.choice([80, 200])
            seq.append((r.choice(vocab), t, e))
            rows.append((s, s * 1000 + i, seq[-1][0], t, e, 0))
        sources[s] = seq
    return sources, spark.createDataFrame(rows, "source_id bigint, clip_id bigint, word string, start_ms bigint, end_ms bigint, edited int")


def no_ratings(spark):
    return spark.createDataFrame([], "word string, clip_id bigint, score bigint")


def test_runs_and_best_run_match_a_plain_search(spark):
    sources, clips = corpus(spark, 5)
    r = random.Random(6)
    texts = {7: r.choices("abcde", k=30), 8: r.choices("abcd", k=17)}
    tok = spark.createDataFrame([(t, i, w, i % 6 == 5 or i == len(ws) - 1) for t, ws in texts.items() for i, w in enumerate(ws)],
                                "text_id bigint, pos bigint, word string, ends boolean")
    idx = PR.phrase_index(clips, no_ratings(spark), chunk_ms=5_000)
    got = {(x.text_id, x.pos, x.source_id, x.start_idx, x.length) for x in PR.match_runs(tok, idx).collect()}
    want = {(t, *r) for t, ws in texts.items() for r in models.runs(ws, sources, 600)}
    assert got == want
    q = spark.createDataFrame([(s, 0.5 + 0.1 * (s % 2)) for s in sources], "source_id bigint, quality double")
    quality = {s: 0.5 + 0.1 * (s % 2) for s in sources}
    best = {(x.text_id, x.pos): (x.length, x.source_id, x.start_idx) for x in PR.best_run(tok, idx, q).collect()}
    expect = {}
    for t, pos, s, i, k in want:
        cand = (-k, -quality[s], s, i)
        if (t, pos) not in expect or cand < expect[t, pos]:
            expect[t, pos] = cand
    assert best == {key: (-c[0], c[2], c[3]) for key, c in expect.items()}

    cover = {(x.text_id, x.pos): x.length for x in PR.cover_text(tok, PR.best_run(tok, idx, q)).collect()}
    for t, ws in texts.items():
        i, plan = 0, {}
        while i < len(ws):
            stop = next(j for j in range(i, len(ws)) if j % 6 == 5 or j == len(ws) - 1)
            k = min(best.get((t, i), (1,))[0], stop - i + 1)
            plan[i] = k if k >= 2 else 1
            i += plan[i]
        assert {p: n for (tt, p), n in cover.items() if tt == t} == plan


def test_a_rejected_take_ends_a_run(spark):
    clips = spark.createDataFrame([(1, i, w, i * 300, i * 300 + 200, 0) for i, w in enumerate("abcd")],
                                  "source_id bigint, clip_id bigint, word string, start_ms bigint, end_ms bigint, edited int")
    bad = spark.createDataFrame([("c", 2, -2)], "word string, clip_id bigint, score bigint")
    tok = spark.createDataFrame([(1, i, w, i == 3) for i, w in enumerate("abcd")], "text_id bigint, pos bigint, word string, ends boolean")
    got = {(x.pos, x.length) for x in PR.match_runs(tok, PR.phrase_index(clips, bad)).collect()}
    assert got == {(0, 2)}


def test_captions_match_the_two_pointer_walk(spark):
    r = random.Random(9)
    sources, clips = corpus(spark, 8, 3, 50)
    caps, want = [], {}
    for s, seq in sources.items():
        times = sorted(r.randrange(0, seq[-1][2] + 3000) for _ in range(60))
        words = [(r.choice("abcdz"), t) for t in times]
        for i, ((w, t), st) in enumerate(zip(words, models.compare_captions(words, seq))):
            caps.append((s, s * 1000 + i, w, t))
            want[s * 1000 + i] = st
    df = spark.createDataFrame(caps, "source_id bigint, cap_id bigint, word string, t_ms bigint")
    got = {x.cap_id: x.status for x in CA.verify_captions(df, clips, chunk_ms=4_000).collect()}
    assert got == want


def test_index_neighbours_and_gaps(spark):
    rows = [(1, 10, "a", 0, 100), (1, 11, "b", 100, 100), (1, 12, "c", 700, 900), (1, 13, "d", 880, 1000)]
    clips = spark.createDataFrame(rows, "source_id bigint, clip_id bigint, word string, start_ms bigint, end_ms bigint")
    got = {x.clip_id: (x.idx, x.prev_end, x.next_start, x.gap_after) for x in IX.build_index(clips, chunk_ms=500).collect()}
    assert got == {10: (0, None, 700, 600), 12: (1, 100, 880, -20), 13: (2, 900, None, None)}
    idle = IX.idle_regions(IX.build_index(clips)).collect()
    assert [(x.start_ms, x.end_ms) for x in idle] == [(160, 640)]


def test_tokenize_ends(spark):
    t = spark.createDataFrame([(1, 'Hello there. "Well?") no-one -- 5!')], "text_id bigint, text string")
    got = [(x.word, x.ends) for x in TX.tokenize(t).orderBy("pos").collect()]
    assert got == [("hello", False), ("there", True), ("well", True), ("noone", False), ("5", True)]


def test_continuations_back_off(spark):
    rows = [(1, i, w, i * 300, i * 300 + 200) for i, w in enumerate("a b c a b d a b c".split())]
    idx = spark.createDataFrame(rows, "source_id bigint, clip_id bigint, word string, start_ms bigint, end_ms bigint")
    ctx = spark.createDataFrame([(1, ["x", "a", "b"], ""), (2, ["q"], ""), (3, ["a", "b"], "d")], "ctx_id bigint, words array<string>, prefix string")
    got = {(x.ctx_id, x.matched, x.next, x.n) for x in PR.continuations(ctx, idx).collect()}
    assert got == {(1, 2, "c", 2), (1, 2, "d", 1), (3, 2, "d", 1)}
    assert PR.ngram_counts(idx, 3).where(F.col("phrase") == "a b c").collect()[0].n == 2
