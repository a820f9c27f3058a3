import random

from tests import models
from wordclips.operators import ordered as O
from wordclips.operators import tone as TN

TAKE = ("word string, clip_id bigint, source_id bigint, category bigint, pitch_start double, pitch_end double, "
        "loudness double, brightness double, pick_weight double")


def test_every_take_is_weighed_after_the_one_before(spark):
    r = random.Random(6)
    some = lambda: None if r.random() < 0.15 else round(r.uniform(-2, 2), 3)
    rows, clip = [], 0
    for w in "abcdefg":
        for _ in range(r.randrange(1, 60)):
            clip += 1
            rows.append((w, clip, r.randrange(6), r.choice([0, 1, 2, None]), some(), some(), some(), some(), r.uniform(0.01, 5)))
    takes = {}
    for w, c, s, k, a, z, lo, br, pick in rows:
        takes.setdefault(w, []).append((c, s, k, a, z, lo, br, pick))
    sentences = {n: [r.choice("abcdefgxy") for _ in range(r.randrange(0, 40))] for n in range(30)}
    target = {n: r.choice([0, 1, 2]) for n in sentences if n % 4}
    words = spark.createDataFrame([(n, 2 * p, w) for n, ws in sentences.items() for p, w in enumerate(ws)], "sentence_id bigint, pos bigint, word string")
    targets = spark.createDataFrame(list(target.items()), "sentence_id bigint, category bigint")
    for strength in (1.0, 0.2):
        got = {}
        for x in TN.pick_sentence(words, spark.createDataFrame(rows, TAKE), targets, strength).orderBy("sentence_id", "pos").collect():
            got.setdefault(x.sentence_id, []).append((x.word, x.clip_id))
        for n, ws in sentences.items():
            assert got.get(n, []) == models.walk_sentence(ws, takes, target.get(n), strength), n


def test_picks_of_nothing(spark):
    words = spark.createDataFrame([(1, 0, "a")], "sentence_id bigint, pos bigint, word string")
    targets = spark.createDataFrame([], "sentence_id bigint, category bigint")
    assert TN.pick_sentence(words, spark.createDataFrame([], TAKE), targets).count() == 0


def test_reach_follows_every_way(spark):
    r = random.Random(3)
    step = {(g, n): n + r.randrange(1, 4) for g in range(3) for n in range(200)}
    rows = spark.createDataFrame([(g, n, to) for (g, n), to in step.items()], "g bigint, n bigint, to bigint")
    first = spark.createDataFrame([(0, 5), (1, 0)], "g bigint, n bigint")
    want = set()
    for g, n in ((0, 5), (1, 0)):
        while True:
            want.add((g, n))
            if (g, n) not in step:
                break
            n = step[g, n]
    got = [(x.g, x.n) for x in O.reach(first, rows, ["g"], 200).collect()]
    assert set(got) == want and len(got) == len(want)
