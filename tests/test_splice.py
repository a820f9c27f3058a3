"""Phones exploded once, runs priced once, pieces cut once."""

from pyspark.sql import functions as F

from wordclips.operators import splice as SP
from wordclips.plans.queries import QUERIES
from wordclips.schemas import CHARS, PHONES


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_phones_are_made_once(spark, tmp_path, capsys):
    rows = [(i, "some plain words to say", "en", "web") for i in range(3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("P11_phone_class", "C11_phone_intervals", "R7_phone_units"):
        df = QUERIES[name](spark, str(tmp_path))
        # A filter on the bare column would split and transform the word twice more.
        assert plan(df, capsys).count("transform(split(") == 1
        assert df.count() > 0


def test_intervals_of_clips_without_phones(spark):
    rows = [(1, 1, "ab", 100, [("AE", -5, 40), ("B", 40, 90)]), (1, 2, "cd", 300, None), (1, 3, "ef", 500, [])]
    clips = spark.createDataFrame(rows, f"source_id bigint, clip_id bigint, word string, start_ms bigint, phones {PHONES}")
    assert {tuple(r) for r in SP.phone_intervals(clips).collect()} == {(1, 1, "ab", 0, "AE", 100, 140), (1, 1, "ab", 1, "B", 140, 190)}


def test_a_run_is_priced_once_for_all_targets(spark, capsys):
    words = spark.createDataFrame([("ab", ["AE", "B"], 3), ("bd", ["B", "D"], 2), ("abd", ["AE", "B", "D"], 1)],
                                  "word string, phones array<string>, n bigint")
    some = [["AE", "B", "AE"], ["D", "AE", "B"], ["AE", "B", "AE", "B"]]
    targets = spark.createDataFrame([(f"t{i}", some[i % 3]) for i in range(60)], "word string, phones array<string>")
    for mode in ("strict", "loose", "desperate"):
        got = SP.splice_edges(targets, words, mode)
        # Sources meet distinct runs with the phone after, not the stretches of each target.
        text = plan(got, capsys)
        assert "keys=[run" in text and "next" in text.split("keys=[run", 1)[1].split("]")[0]
        rows = {(r.target, r.i, r.j): (r.cost, r.word) for r in got.collect()}
        for t in range(3, 60):
            mine = {k[1:]: v for k, v in rows.items() if k[0] == f"t{t}"}
            assert mine and mine == {k[1:]: v for k, v in rows.items() if k[0] == f"t{t % 3}"}


def _takes(spark):
    rows = []
    for i in range(40):
        n = 120 + i % 5 * 40
        phones = None if i % 7 == 0 else [("AE", 0, n // 2), ("B", n // 2, n)]
        rows.append(("ab", 100 - i, i % 3, 1000 * i, 1000 * i + n, phones, None))
    rows.append(("ab", 500, 9, 0, 900, None, None))
    rows.append(("zz", 600, 9, 0, 300, None, None))
    return spark.createDataFrame(rows, "word string, clip_id bigint, source_id bigint, start_ms bigint, end_ms bigint, "
                                 f"phones {PHONES}, chars {CHARS}")


PIECES = "target string, pieces array<struct<i:int,j:int,cost:bigint,word:string,word_pos:bigint,word_size:bigint,kind:string>>"


def test_a_piece_is_cut_once_for_all_targets(spark):
    piece = ("ab", 0, 1)
    plans = spark.createDataFrame([(f"t{i}", [(0, 1, 5, "ab", 0, 2, "piece"), (1, 2, 5, "ab", 1, 2, "piece"), (2, 3, 5, "zz", 0, 1, "piece")])
                                   for i in range(30)], PIECES)
    takes = _takes(spark)
    got = {(r.target, r.k): (r.word, r.is_cut, r.clip_id, r.source_id, r.cut_start, r.cut_end)
           for r in SP.realise_plan(plans, takes).collect()}
    # The shortest takes with phones last 120 ms; of those the lowest clip id is of the last row.
    i = max(x for x in range(40) if x % 5 == 0 and x % 7)
    assert len(got) == 90
    for t in range(30):
        assert got[f"t{t}", 0] == ("ab", True, 100 - i, i % 3, 1000 * i, 1000 * i + 60)
        assert got[f"t{t}", 1] == ("ab", True, 100 - i, i % 3, 1000 * i + 60, 1000 * i + 120)
        assert got[f"t{t}", 2] == ("zz", False, 600, 9, 0, 300)
    votes = spark.createDataFrame([("t1", 100 - i, 1)], "target string, clip_id bigint, votes bigint")
    told = {(r.target, r.k): r.clip_id for r in SP.realise_plan(plans, takes, votes).collect()}
    assert told["t1", 0] != 100 - i and told["t2", 0] == 100 - i


def test_takes_are_not_sorted_by_piece(spark, capsys):
    plans = spark.createDataFrame([("t", [(0, 1, 5, "ab", 0, 2, "piece")])], PIECES)
    text = plan(SP.realise_plan(plans, _takes(spark)), capsys)
    assert "HashAggregate" in text and text.count("partial_min_by(source_id") == 1


def test_pronounce_reads_its_inputs_once(spark, tmp_path, capsys):
    from wordclips.operators import lexicon as LX
    spark.createDataFrame([("cats",), ("Cat",), ("uncat",), ("catdog",)], "word string").write.parquet(f"{tmp_path}/said")
    spark.createDataFrame([("cat", ["K", "AE", "T"]), ("dog", ["D", "AO", "G"])], "word string, phones array<string>") \
        .write.parquet(f"{tmp_path}/lexicon")
    got = LX.pronounce(spark.read.parquet(f"{tmp_path}/said"), spark.read.parquet(f"{tmp_path}/lexicon"))
    text = plan(got, capsys)
    assert f"{tmp_path}/said" not in text and f"{tmp_path}/lexicon" not in text
    assert {r.word: " ".join(r.phones) for r in got.collect()} == {
        "cat": "K AE T", "cats": "K AE T S", "uncat": "AH N K AE T", "catdog": "K AE T D AO G"}
