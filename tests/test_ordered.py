import random

from pyspark.sql import functions as F

from wordclips.operators import ordered as O


def frame(spark, seed=1, n=400):
    r = random.Random(seed)
    rows = [(k % 3, r.randrange(0, 900), i, r.randrange(-5, 6)) for i, k in enumerate(r.choices(range(9), k=n))]
    return rows, spark.createDataFrame(rows, "g bigint, t bigint, id bigint, v bigint")


def test_scan_matches_one_long_window(spark):
    rows, df = frame(spark)
    pos = F.col("v") > 0
    got = O.scan(df, ["g"], ["t", "id"], O.bucket("t", 50), k=O.rank(), s=O.running_sum("v"), b=O.sum_before("v"),
                 hi=O.running_max("v"), lo=O.running_min("v"), mb=O.min_before("v"), prev=O.lag("v"), nxt=O.lead("v"),
                 pp=O.lag("v", pos), np=O.lead("v", pos), cur=O.latest("v", pos)).collect()
    for g in range(3):
        seq = sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2]))
        mine = {r["id"]: r for r in got if r["g"] == g}
        vs = [r[3] for r in seq]
        for i, r in enumerate(seq):
            m = mine[r[2]]
            before, after = vs[:i], vs[i + 1:]
            assert m["k"] == i + 1 and m["s"] == sum(vs[:i + 1]) and m["b"] == sum(before)
            assert m["hi"] == max(vs[:i + 1]) and m["lo"] == min(vs[:i + 1])
            assert m["mb"] == (min(before) if before else None)
            assert m["prev"] == (before[-1] if before else None) and m["nxt"] == (after[0] if after else None)
            assert m["pp"] == next((x for x in reversed(before) if x > 0), None)
            assert m["np"] == next((x for x in after if x > 0), None)
            assert m["cur"] == next((x for x in reversed(vs[:i + 1]) if x > 0), None)


def test_lag_tells_a_null_value_from_no_row(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 7), (1, 200, 8)], "g bigint, t bigint, v bigint")
    got = {r["t"]: r["p"] for r in O.scan(df, ["g"], ["t"], O.bucket("t", 100), p=O.lag("v")).collect()}
    assert got == {1: None, 2: None, 200: 7}


def test_following_crosses_chunks(spark):
    rows, df = frame(spark, 2, 120)
    got = {r["id"]: [x["v"] for x in r["nx"]] for r in O.following(df, ["g"], ["t", "id"], O.bucket("t", 20), F.struct("v"), 3, "nx").collect()}
    for g in range(3):
        seq = sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2]))
        for i, r in enumerate(seq):
            assert got[r[2]] == [x[3] for x in seq[i + 1:i + 4]]


def test_quantile_forms(spark):
    rows, df = frame(spark, 3, 101)
    import numpy as np
    for chunk in (None, O.bucket("t", 100)):
        got = {r["g"]: r for r in O.quantile(df, ["g"], "t", chunk, p=0.37, m="upper").collect()}
        for g in range(3):
            ts = sorted(r[1] for r in rows if r[0] == g)
            assert abs(got[g]["p"] - np.percentile(ts, 37)) < 1e-9 and got[g]["m"] == ts[len(ts) // 2]


def test_overlap_join_gives_each_pair_once(spark):
    r = random.Random(4)
    a = [(i, r.randrange(0, 300), r.randrange(0, 60)) for i in range(60)]
    b = [(i, r.randrange(0, 300), r.randrange(0, 60)) for i in range(60)]
    l = spark.createDataFrame([(1, i, s, s + d) for i, s, d in a], "g bigint, i bigint, ls bigint, le bigint")
    q = spark.createDataFrame([(1, i, s, s + d) for i, s, d in b], "g bigint, j bigint, rs bigint, re bigint")
    got = [(x["i"], x["j"]) for x in O.overlap_join(l, q, ["g"], ("ls", "le"), ("rs", "re"), 25).collect()]
    want = [(i, j) for i, s, d in a for j, t, e in b if s <= t + e and t <= s + d]
    assert sorted(got) == sorted(want)
