"""What is left on disk, sent between tasks or to the driver: shuffle files, clips looked up by word, exploded runs."""

import re
import time

import pytest
from pyspark.sql import functions as F

from wordclips import session as S
from wordclips.operators import diagnostics as D
from wordclips.operators import ordered as O
from wordclips.operators import splice as SP
from wordclips.operators import windows as WN
from wordclips.plans import q_corpus as QC
from wordclips.plans.queries import QUERIES
from wordclips.schemas import PHONES

CO_LOCATED, BROADCAST = "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def merged(spark):
    """Joins as between large tables."""
    old = spark.conf.get(BROADCAST)
    spark.conf.set(BROADCAST, "-1")
    yield
    spark.conf.set(BROADCAST, old)


@pytest.fixture
def folder(spark, tmp_path):
    words = "one two three even five seven eight one two three nine ten eleven apple ants "
    rows = [(i, words * (1 + i % 3), "en", "web") for i in range(8)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def sent(df, capsys):
    """(columns, how) of each shuffle but that of the documents."""
    capsys.readouterr()
    df.explain("formatted")
    found = re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\nArguments: (.*)", capsys.readouterr().out)
    return [x for x in found if "REPARTITION_BY_NUM" not in x[1]]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("cut", [S.stored, S.cut_lineage])
def test_what_is_written_once_leaves_no_shuffle_files(spark, cut):
    before, old = shuffle_files(spark), spark.conf.get(S.CLEANUP)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = cut(df)
    until = time.time() + 20            # Spark does not wait for the files to go
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(S.CLEANUP) == old
    assert out.count() == df.count() == 7


def test_a_scan_nobody_reads_the_steps_of_joins_nothing(spark, capsys):
    df = spark.createDataFrame([(1, 5, 9), (1, 205, 8), (None, 6, 7), (2, None, 6)], "g bigint, t bigint, v bigint")
    got = O.scan(df, ["g"], ["t"], O.bucket("t", 100), k=O.rank())
    assert {tuple(r) for r in got.collect()} == {(1, 5, 9, 1), (1, 205, 8, 2)}
    few = got.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    few.explain()
    assert "Join" not in capsys.readouterr().out
    assert {tuple(r) for r in few.collect()} == {(9, 1), (8, 1)}


@pytest.mark.parametrize("mode", ["strict", "loose"])
def test_exploded_runs_are_not_broadcast(spark, capsys, mode):
    words = spark.createDataFrame([("ab", ["AE", "B"], 3), ("bd", ["B", "D"], 2)], "word string, phones array<string>, n bigint")
    targets = spark.createDataFrame([("t", ["AE", "B", "D"])], "word string, phones array<string>")
    got = SP.splice_edges(targets, words, mode)
    capsys.readouterr()
    got.explain()
    # Only the fixed table of like phones is, and what stands for half a phone.
    wide = [x for x in capsys.readouterr().out.splitlines() if "BroadcastHashJoin" in x and ("run" in x or "said" in x)]
    assert not wide and got.count() >= 4


def test_bleed_sends_words_and_no_clips(spark, folder, merged, capsys):
    df = QUERIES["C3_bleed_risk"](spark, folder)
    moved = sent(df, capsys)
    assert moved and not any("clip_id" in columns for columns, _ in moved)
    assert df.where("bleed_risk").count() > 0


def test_alignment_status_sends_words_and_no_phones(spark, merged, capsys):
    clips = [(s, i, w, 0, 100, p) for s in (1, 2) for i, (w, p) in enumerate(
        [("a", None), ("b", [("AE", 0, 50)]), ("c", None), ("a", [("AE", 0, 500)])])]
    schema = f"source_id bigint not null, clip_id bigint, word string, start_ms bigint, end_ms bigint, phones {PHONES}"
    known = spark.createDataFrame([("a",), ("b",)], "word string")
    old = spark.conf.get(CO_LOCATED)
    spark.conf.set(CO_LOCATED, "false")
    try:
        placed = spark.createDataFrame(clips, schema).repartition(3, "source_id")
        df = D.alignment_status(placed, known)
        assert not any("phones" in columns for columns, _ in sent(df, capsys))
        assert {tuple(r) for r in df.collect()} == {(1, 2, 1, 1, "c"), (2, 2, 1, 1, "c")}
    finally:
        spark.conf.set(CO_LOCATED, old)
    # Clips of no source are a group of their own.
    lost = spark.createDataFrame([(None, *c[1:]) for c in clips], schema.replace(" not null", ""))
    assert [tuple(r) for r in D.alignment_status(lost, known).collect()] == [(None, 4, 2, 2, "")]


def test_checked_captions_stay_with_their_source(spark, folder, merged, capsys):
    df = QUERIES["J7_verify_captions"](spark, folder)
    moved = sent(df, capsys)
    assert moved and not any(how.startswith("hashpartitioning(cap_id") for _, how in moved)
    # What goes back to the source is what was asked by word; nothing else that has been looked up moves.
    assert sum("any_reach" in c or "near_" in c or "t_ms" in c.replace("at_ms", "") for c, _ in moved) == 0
    assert df.count() > 0


def test_windows_are_made_from_what_they_read(spark, folder, monkeypatch):
    seen = {}
    for at in (WN, QC):
        monkeypatch.setattr(at, "stored", lambda df, name="table": seen.update({name: set(df.columns)}) or S.stored(df, name))
    assert QUERIES["C10_group_words"](spark, folder).count() > 0
    assert seen["numbered"] == {"source_id", "clip_id", "start_ms", "end_ms", "n"}
    QUERIES["T1_diff_tokens"](spark, folder)
    assert seen["windows"] == {"source_id", "win", "n", "pos", "clip_id", "word", "edited"}
