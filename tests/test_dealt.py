"""Clips made where their recording was dealt to, and tables about them that name the source."""

import pytest
from pyspark.sql import functions as F

from wordclips.operators import diagnostics as D
from wordclips.operators import ordered as O
from wordclips.operators import takes as TK
from wordclips.plans import tables as T
from wordclips.plans.queries import QUERIES

WORDS = "one two three four five seven eight one two three nine ten eleven twelve thirteen"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dealt"))
    rows = [(i, WORDS * (1 + i % 3), ["en", "de", None][i % 3], "web") for i in range(12)] + [(12, None, "en", "web"), (13, "", "en", "web")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def shuffles(df, capsys):
    capsys.readouterr()
    df.explain()
    return [x for x in capsys.readouterr().out.splitlines() if "Exchange" in x]


@pytest.mark.parametrize("name", ["C7_median_shift", "C8_crossing_repair", "N1_noise_bursts", "S1_transcript_words", "S1_rejected_words",
                                  "T5_apply_edits", "T7_merge_if_unchanged", "C1_build_index"])
def test_only_documents_are_shuffled(spark, folder, capsys, name):
    df = QUERIES[name](spark, folder)
    assert all("REPARTITION_BY_NUM" in x and "doc_id" in x for x in shuffles(df, capsys))
    assert df.count() > 0


def test_what_is_looked_up_by_word_is_small(spark, folder, capsys):
    # Reports, words, votes: one row a source and word goes to the lexicon and back, no clip does.
    moved = [x for x in shuffles(QUERIES["J12_clip_flags"](spark, folder), capsys) if "REPARTITION_BY_NUM" not in x]
    assert moved and not any("clip_id" in x or "start_ms" in x for x in moved)


def test_the_size_of_the_files_gives_the_parts(spark, folder, monkeypatch):
    deal = spark.conf.get("spark.wordclips.deal")
    spark.conf.unset("spark.wordclips.deal")
    try:
        parts = lambda: T.Tables(spark, folder).documents.rdd.getNumPartitions()
        assert parts() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        monkeypatch.setattr(T, "DEAL_BYTES", 50)
        assert parts() > 20
    finally:
        spark.conf.set("spark.wordclips.deal", deal)


def test_a_vote_on_a_lost_clip_has_no_source(spark):
    clips = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "source_id bigint, clip_id bigint, word string")
    votes = spark.createDataFrame([(1, "x", 10, -1), (2, "y", 21, -2), (2, "z", 20, 1)], "source_id bigint, word string, clip_id bigint, score int")
    want = {(10, "x", -1, 1, "a"), (21, "y", -2, None, None)}
    assert {tuple(r) for r in D.downvoted(votes, clips).collect()} == want
    assert {tuple(r) for r in D.downvoted(votes.drop("source_id"), clips).collect()} == want


def test_takes_are_counted_in_their_scan(spark, capsys):
    takes = spark.range(0, 100).select(F.when(F.col("id") < 90, "a").otherwise("b").alias("word"), F.col("id").alias("clip_id"))
    got = TK.spaced_takes(takes, 4, width=7)
    got.explain()
    assert capsys.readouterr().out.count("Join") == 1
    assert {(r.word, r.clip_id, r.slot) for r in got.collect()} == {("a", 0, 0), ("a", 22, 1), ("a", 44, 2), ("a", 66, 3),
                                                                  ("b", 90, 0), ("b", 92, 1), ("b", 94, 2), ("b", 96, 3)}
    whole = O.scan(takes, ["word"], ["clip_id"], None, n=O.total())
    assert {(r.word, r.n) for r in whole.distinct().select("word", "n").collect()} == {("a", 90), ("b", 10)}
