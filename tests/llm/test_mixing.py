import pytest
from pyspark.sql import functions as F

from wordclips.llm import mixing

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, target string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "clash") for i, t, s in rows], KIND)


def _filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Reshare until none is above its limit, step by step."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, share * sum(sizes.values()), set(sizes)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_targets_reshare_what_a_source_cannot_take(spark):
    sizes = {"b": 10, "a": 1000, "ä": 300, None: 50, "": 0, "c": 700}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(frame, (5, 2, 1), 1.5, 2.0).collect()}
    want = _filled(sizes)
    assert set(got) == set(want)
    for s in want:
        assert got[s] == pytest.approx(want[s])


def test_words_taken_come_near_the_target(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 3}") for i in range(600)]
    rows += [(1000 + i, "copy of one", "s0") for i in range(400)]
    got = mixing.mix(_docs(spark, rows), near=16).collect()
    assert len(got) == 1000
    for s in ("s0", "s1", "s2"):
        mine = [r for r in got if r["source"] == s]
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert abs(taken - mine[0]["target"]) <= max(r["size"] for r in mine)
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
    assert max(r["copies"] for r in got) <= 2


def test_nulls_repeats_and_reruns(spark):
    rows = [(1, None, None), (None, "a b c", "x"), (2, "a b c", "x"), (2, "a b c", "x"), (3, "", "x"), (4, " \t\n\r\x0b\x0c", "")]
    docs = _docs(spark, rows)
    plan = mixing.mix(docs)
    one, two = (sorted(map(tuple, p.collect()), key=repr) for p in (plan, mixing.mix(docs)))
    assert one == two and len(one) == 6
    assert {r["size"] for r in plan.collect()} == {0, 3}
    mixed = mixing.mixed(docs)
    assert mixed.count() == sum(r["copies"] for r in plan.collect())
    assert mixed.where("repeat > 2").count() == 0


def test_empty_table_and_very_long_text(spark):
    assert mixing.mix(_docs(spark, [])).count() == 0
    long = _docs(spark, [(1, "word " * 200_000, "a"), (2, "x", "b")])
    got = {r["doc_id"]: r["size"] for r in mixing.mix(long).collect()}
    assert got == {1: 200_000, 2: 1}


def test_size_may_be_any_column(spark):
    got = mixing.mix(_docs(spark, [(1, "abc", "a"), (2, "abcdef", "a")]), size=F.length("text").cast("bigint"))
    assert {r["size"] for r in got.collect()} == {3, 6}


def test_a_text_in_two_sources_is_taken_from_each(spark):
    rows = [(1, "one text here", s) for s in ("A", "B", "B", None)] + [(i, "w " * (i % 5 + 1), "AB"[i % 2]) for i in range(2, 30)]
    docs = _docs(spark, rows)
    for seed in range(17, 23):
        plan = {}
        for r in mixing.mix(docs, seed=seed).collect():
            plan[r["doc_id"], r["source"]] = plan.get((r["doc_id"], r["source"]), 0) + r["copies"]
        have = {(r["doc_id"], r["source"]): r["count"] for r in mixing.mixed(docs, seed=seed).groupBy("doc_id", "source").count().collect()}
        assert have == {k: n for k, n in plan.items() if n}
