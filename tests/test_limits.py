"""Inputs beyond the limits that operators once had."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_words import lex
from wordclips.functions import text as TX
from wordclips.operators import lexicon as LX
from wordclips.operators import reconcile as RC
from wordclips.operators import windows as WN


def _said(spark, *digits):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(digits)], "i int, d string")
    return [r["s"] and " ".join(r["s"]) for r in d.select("i", TX.say_number(F.col("d")).alias("s")).orderBy("i").collect()]


def test_numbers_of_any_length(spark):
    assert _said(spark, "0", "007", "10", "100", "101", "1000", "1005", "1105", "20000", "1000001") == [
        "zero", "seven", "ten", "one hundred", "one hundred and one", "one thousand", "one thousand and five",
        "one thousand one hundred and five", "twenty thousand", "one million and one"]
    assert _said(spark, "1234567890123456789", "2" + "0" * 63, "3" + "0" * 303, "4" + "0" * 306) == [
        "one quintillion two hundred and thirty four quadrillion five hundred and sixty seven trillion eight hundred and "
        "ninety billion one hundred and twenty three million four hundred and fifty six thousand seven hundred and eighty nine",
        "two vigintillion", "three centillion", None]
    assert TX.scale_names()[10:13] == ["nonillion", "decillion", "undecillion"]


def test_no_part_of_a_mixed_token_is_lost(spark):
    d = lex(spark, five="F AY V", cat="K AE T")
    words = spark.createDataFrame([("abcdefghijklmnopqrstu5",), ("cat5",)], "word string")
    got = {r.word: " ".join(r.phones) for r in LX.pronounce(words, d).collect()}
    assert got["cat5"] == "K AE T F AY V"
    letters = [p for c in "abcdefghijklmnopqrstu" for p in LX.LETTER_NAMES[c]]
    assert got["abcdefghijklmnopqrstu5"] == " ".join([*letters, "F", "AY", "V"])


def test_a_suppressed_word_stays_silent(spark):
    d = lex(spark, **{"don't": "D OW N T", "colour": "K AH L ER"}).unionByName(
        spark.createDataFrame([("dont", None), ("color", None)], "word string, phones array<string>"))
    words = spark.createDataFrame([("dont",), ("color",), ("colour",)], "word string")
    assert {r.word for r in LX.pronounce(words, d).collect()} == {"colour"}


def test_respellings_in_long_chains(spark):
    rows = [(0, 1, "wa", "cat"), *[(0, i, f"w{chr(96 + i)}", f"w{chr(95 + i)}") for i in range(2, 9)],
            (0, 20, "early", "late"), (0, 21, "late", "cat"), (0, 22, "two", "wa nothing"), (0, 23, "three", "two"),
            (1, 1, "wa", "dog"), (1, 2, "again", "wa")]
    frame = spark.createDataFrame(rows, "layer int, line bigint, word string, value string")
    got, rejected = LX.load_lexicon(lex(spark, cat="K AE T", dog="D AO G"), lex(spark, x="K"), frame)
    words = {r.word: " ".join(r.phones) for r in got.collect()}
    assert all(words[f"w{c}"] == "K AE T" for c in "bcdefgh") and words["wa"] == words["again"] == "D AO G"
    assert {r.word for r in rejected.collect()} == {"early", "two", "three"}


def _walk_window(start, end, i):
    """The rule step by step: from the first end past 20 s, the widest gap before an end past 30 s."""
    j = i + 1
    while j < len(start) and end[j] - start[i] < 20_000:
        j += 1
    best = (None, j)
    for k in range(j, len(start)):
        if end[k] - start[i] >= 30_000:
            break
        gap = start[k] - end[k - 1]
        if best[0] is None or gap > best[0]:
            best = (gap, k)
    return best[1]


def test_windows_on_arrays_follow_the_rule():
    rng = np.random.default_rng(5)
    for _ in range(200):
        start = np.sort(rng.integers(0, 120_000, rng.integers(1, 200)))
        end = start + rng.integers(1, 9_000, len(start))
        for i in range(len(start)):
            assert WN._next_window(start, end, i) == _walk_window(start, end, i)
            later = [j for j in range(i + 1, len(start)) if end[j] - start[i] > 40_000]
            assert WN._next_group(start, end, i) == (later[0] if later else len(start))


def test_titles_that_contain_one_another(spark):
    titles = spark.createDataFrame([(1, "harrybo"), (2, "big harrybos grandads house"), (3, "ox"), (4, "nothing alike"), (5, "")], "doc_id int, norm string")
    pages = spark.createDataFrame([("Harrybos Grandad", "harrybos grandad"), ("Foxes", "foxes"), ("None", "")], "title string, norm string")
    got = {r["doc_id"]: (r["title"], r["score"]) for r in RC.match_titles(titles, pages).collect()}
    assert got[1] == ("Harrybos Grandad", 0.9) and got[2] == ("Harrybos Grandad", 0.9) and got[3] == ("Foxes", 0.9)
    assert set(got) == {1, 2, 3}
