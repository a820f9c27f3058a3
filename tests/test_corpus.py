import json
import random

from pyspark.sql import functions as F

from tests import models
from wordclips.operators import feedback as FB
from wordclips.operators import reconcile as RC
from wordclips.operators import takes as TK
from wordclips.operators import windows as WN
from wordclips.sources import corpus as CO
from wordclips.sources import readers as RD
from wordclips.streaming import feeds as FD

CLIP = "source_id bigint, clip_id bigint, word string, start_ms bigint, end_ms bigint, edited int"


def test_windows_match_a_plain_walk_across_chunks(spark):
    r = random.Random(4)
    rows, want = [], {"group": set(), "window": set()}
    for s in range(3):
        t, seq = 0, []
        for i in range(900):
            t += r.choice([150, 300, 600, 2500]) if r.random() < 0.995 else 400_000
            seq.append((t, t + 120))
            rows.append((s, s * 10_000 + i, "w", t, t + 120, 0))
        want["group"] |= {(s, i + 1) for i in models.groups(seq)}
        want["window"] |= {(s, i + 1) for i in models.windows(seq)}
    clips = spark.createDataFrame(rows, CLIP)
    for mode in want:
        got = {(x.source_id, x.win) for x in WN.window_words(clips, mode, chunk_ms=60_000).select("source_id", "win").distinct().collect()}
        assert got == want[mode]


def said(spark, text, edited=()):
    ws = text.split()
    return spark.createDataFrame([(1, i, i, w, int(i in edited)) for i, w in enumerate(ws)], "win bigint, pos bigint, clip_id bigint, word string, edited int")


def plan(spark, have, heard, edited=()):
    h = spark.createDataFrame([(1, i, w) for i, w in enumerate(heard.split())], "win bigint, pos bigint, word string")
    return [(x.action, list(x.clips), list(x.words), x.after, x.before) for x in
            RC.plan_second_opinion(said(spark, have, edited), h, ["win"]).orderBy("k", "clips").collect()]


def test_second_opinion_plans(spark):
    assert plan(spark, "one two three cat four five six", "one two three hat four five six") == [("relabel", [3], ["hat"], None, None)]
    assert plan(spark, "one two play time on to five six", "one two playtime onto five six") == []
    assert plan(spark, "we can really hypnotise people right now", "we can really hypnotize people right now") == []
    assert plan(spark, "i was born on the 8th of may then", "i was born on the eighth of may then") == []
    assert plan(spark, "you know go to bed brian i cant", "you know go to bed brian erm i cant") == [("insert", [], ["erm"], 5, 6)]
    assert plan(spark, "one two three cat four five six", "one two three hat four five six", edited=[2]) == []
    assert plan(spark, "cat two three four five six", "hat two three four five six") == []
    got = plan(spark, "a b c d e f c d e g h i", "a b c d e g h i")
    assert [x[0] for x in got] == ["dispute"] and len(got[0][1]) == 4


def test_spread_words(spark):
    g = spark.createDataFrame([(1, j, w, 1000, 2000) for j, w in enumerate(["a", "rotten", "headache"])], "group_id bigint, j bigint, word string, lo_ms bigint, hi_ms bigint")
    got = [(x.start_ms, x.end_ms) for x in WN.spread_words(g).orderBy("j").collect()]
    assert got[0][0] == 1000 and got[-1][1] == 2000 and all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_boundaries_respect_neighbours(spark):
    clips = spark.createDataFrame([(1, 1, "a", 0, 400, 0), (1, 2, "b", 500, 900, 0), (1, 3, "c", 950, 1400, 1), (1, 4, "d", 1500, 1800, 0)], CLIP)
    cores = spark.createDataFrame([(1, 20, 560), (2, 520, 940), (3, 950, 1300), (4, 1600, 1500)], "clip_id bigint, onset bigint, core_end bigint")
    src = spark.createDataFrame([(1, 2000)], "source_id bigint, duration_ms bigint")
    got = {x.clip_id: (x.start_ms, x.end_ms) for x in WN.place_boundaries(clips, cores, src, chunk_ms=300).collect()}
    assert got == {1: (20, 520), 2: (520, 940)}      # 3 is edited, 4 has a degenerate core


def test_placed_cores_never_overlap(spark):
    r = random.Random(8)
    rows, core = [], []
    t = 0
    for i in range(200):
        t += r.randrange(50, 500)
        rows.append((1, i, "w", t, t + 200, int(r.random() < 0.1)))
        core.append((i, t + r.randrange(-40, 40), t + r.randrange(60, 400)))
    src = spark.createDataFrame([(1, t + 1000)], "source_id bigint, duration_ms bigint")
    got = WN.place_boundaries(spark.createDataFrame(rows, CLIP), spark.createDataFrame(core, "clip_id bigint, onset bigint, core_end bigint"), src, 5_000)
    spans = {x.clip_id: (x.start_ms, x.end_ms) for x in got.collect()}
    assert all(e - s >= 40 for s, e in spans.values())


def test_votes_fold(spark):
    ev = spark.createDataFrame([(1, "w", 1, "add", 1), (2, "w", 1, "reset", 0), (3, "w", 1, "add", -1), (4, "w", 1, "add", -1), (5, "w", 2, "reset", 0),
                                (6, "w", 3, "add", 1), (7, "w", 3, "set", 0), (8, "w", 4, "set", 3), (9, "w", 4, "add", 1)],
                               "seq bigint, word string, clip_id bigint, op string, delta bigint")
    assert {x.clip_id: x.score for x in FB.fold_votes(ev).collect()} == {1: -2, 2: 0, 4: 4}


def test_edits_touch_only_their_clips(spark):
    ph = "array<struct<phone:string,start_ms:bigint,end_ms:bigint>>"
    rows = [(1, i, "w", i * 1000, i * 1000 + 300, "f", 0, [("AA", 0, 100), ("T", 100, 300)]) for i in range(5)]
    clips = spark.createDataFrame(rows, f"source_id bigint, clip_id bigint, word string, start_ms bigint, end_ms bigint, source_file string, edited int, phones {ph}")
    ed = spark.createDataFrame([(0, "rename", "x", None, None), (1, "move", None, 1050, 1300), (2, "move", None, 2200, 2300), (3, "delete", None, None, None)],
                               "clip_id bigint, op string, new_word string, new_start bigint, new_end bigint")
    got = {x.clip_id: x for x in RC.apply_edits(clips, ed).collect()}
    assert set(got) == {0, 1, 2, 4} and got[0].word == "x" and got[0].phones is None
    assert got[1].edited == 1 and [tuple(p) for p in got[1].phones] == [("AA", -50, 50), ("T", 50, 250)]
    assert got[2].phones is None and tuple(got[4]) == tuple(clips.where("clip_id = 4").collect()[0])
    dep = spark.createDataFrame([(i,) for i in range(5)], "clip_id bigint")
    assert {x[0] for x in RC.clear_dependants(dep, ed, "ratings").collect()} == {0, 1, 2, 4}
    assert {x[0] for x in RC.clear_dependants(dep, ed, "reports").collect()} == {0, 4}


def test_edited_source_is_not_replaced_unless_forced(spark):
    old = spark.createDataFrame([(1, 1, "a", 0, 10, 1), (2, 2, "a", 0, 10, 0)], CLIP)
    new = spark.createDataFrame([(1, 11, "b", 0, 10, 0), (2, 12, "b", 0, 10, 0)], CLIP)
    kept, refused = RC.replace_source(old, new)
    assert {x.clip_id for x in kept.collect()} == {1, 12} and [x.source_id for x in refused.collect()] == [1]
    assert {x.clip_id for x in RC.replace_source(old, new, force=True)[0].collect()} == {11, 12}


def test_plausible_takes_band_and_fallback(spark):
    rows = [("w", 1, i, 0, d) for i, d in enumerate([200, 210, 220, 900, 60])] + [("q", 1, 10, 0, 50), ("q", 1, 11, 0, 55), ("z", 1, 20, 0, 50)]
    t = spark.createDataFrame(rows, "word string, source_id bigint, clip_id bigint, start_ms bigint, end_ms bigint")
    floors = spark.createDataFrame([("w", 90), ("q", 500), ("z", 500)], "word string, floor_ms bigint")
    got = {(x.word, x.clip_id) for x in TK.plausible_takes(t, floors).collect()}
    assert got == {("w", 0), ("w", 1), ("w", 2), ("q", 11), ("z", 20)}


def test_weighted_pick_is_seeded_and_follows_weight(spark):
    t = spark.range(4000).select(F.concat(F.lit("w"), F.col("id") % 1000).alias("word"), F.lit(1).alias("source_id"), F.col("id").alias("clip_id"),
                                 F.lit(0).alias("start_ms"), F.lit(1).alias("end_ms"), F.when(F.col("id") < 1000, 9.0).otherwise(1.0).alias("pick_weight"))
    a = {x.word: x.clip_id for x in TK.pick_takes(t, 1).collect()}
    assert a == {x.word: x.clip_id for x in TK.pick_takes(t, 1).collect()}
    heavy = sum(c < 1000 for c in a.values())
    assert 680 < heavy < 820                 # 9 in 12


def test_readers(spark, tmp_path):
    f = tmp_path / "t.json"
    f.write_text(json.dumps({"source_id": 1, "segments": [{"words": [
        {"word": " Don't", "start": 0.1, "end": 0.5}, {"word": "--", "start": 0.5, "end": 0.6},
        {"word": "bad", "start": 0.9, "end": 0.7}, {"word": "neg", "start": -1.0, "end": 0.7}]}]}))
    clips, rejected = RD.read_transcripts(spark, str(f))
    assert [(x.word, x.start_ms, x.end_ms) for x in clips.collect()] == [("dont", 100, 500)]
    assert sorted(x.word for x in rejected.collect()) == ["bad", "neg"]
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"source_id": 1, "events": [{"tStartMs": 1000, "segs": [{"utf8": "Two words", "tOffsetMs": 50}, {"utf8": "\n"}]}, {"tStartMs": -9, "segs": [{"utf8": "x"}]}]}))
    assert [(x.word, x.t_ms) for x in RD.read_captions(spark, str(c)).collect()] == [("two", 1050), ("words", 1050)]
    p = tmp_path / "p.csv"
    p.write_text("#note,x\nmick,M IH K\nmick,=skip\n")
    assert [(x.word, x.value) for x in RD.read_pronunciations(spark, [str(p)]).orderBy("line").collect()] == [("mick", "M IH K"), ("mick", "=skip")]


def test_wiki_sections(spark):
    text = "pre\n==One==\n[[a|bee]] [[sea]] {{t}} <b>x</b>\n===sub===\n'''bold'''\n== Two ==\nbody\n==Empty==\n"
    got = {x.title: x.body for x in RD.parse_wiki_sections(spark.createDataFrame([(1, text)], "page_id bigint, text string")).collect()}
    assert got["Two"] == "body" and got["One"].startswith("bee sea x") and "sub" not in got["One"] and got["One"].endswith("bold") and "Empty" not in got


def test_corpus_round_trip_and_upgrade(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, "w", 0, "C:\\x\\downloads\\f.mp4"), ("b", 2, 2, "v", 5, "/y/g.mp4")],
                               "corpus string, source_id bigint, clip_id bigint, word string, start_ms bigint, source_file string")
    CO.save_corpus(df, str(tmp_path / "c"))
    got = CO.load_corpus(spark, str(tmp_path / "c"), ["a"])
    assert [x.source_file for x in got.collect()] == ["downloads/f.mp4"]
    assert CO.audit_paths(df).collect()[0].clips == 2
    from pyspark.sql.types import StructType
    up = CO.upgrade(df, StructType.fromDDL("word string, edited int"), {"edited": 0})
    assert CO.upgrade(up, StructType.fromDDL("edited int")).columns == up.columns and up.collect()[0].edited == 0


def test_votes_stream_like_the_log(spark, tmp_path):
    ev = [(i, "w", i % 3, "reset" if i % 7 == 0 else "add", 1 if i % 2 else -1) for i in range(60)]
    schema = "seq bigint, word string, clip_id bigint, op string, delta bigint"
    df = spark.createDataFrame(ev, schema)
    for k, part in enumerate((ev[:30], ev[30:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    live = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {x.clip_id: x.score for x in FD.run_to_end(FD.stream_votes(live), ["word", "clip_id"]).collect()}
    assert got == {x.clip_id: x.score for x in FB.fold_votes(df).collect()}
