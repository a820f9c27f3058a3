import re

from pyspark.sql import functions as F

from tests.llm import models
from wordclips.llm import fingerprints as FP


def _texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def _prints(spark, texts, k=3, w=4):
    rows = FP.winnow(_texts(spark, texts), "text", "p", k, w).orderBy("i").collect()
    return [[(x >> 32, x & 0x7FFFFFFF) for x in r["p"]] for r in rows]


def test_positions_are_the_rightmost_minima(spark):
    texts = [" ".join("abcab"[(i * i + j) % 5] for i in range(30)) for j in range(5)] + ["x " * 50, "a b", "", None, "one"]
    k, w = 3, 4
    got = _prints(spark, texts, k, w)
    for text, kept in zip(texts, got):
        units = (text or "").split()
        h = dict()
        for hash_, at in kept:
            h[tuple(units[at:at + k])] = hash_
        # The hash of a gram that was never kept is not known: take Spark's for all of them.
        grams = [tuple(units[i:i + k]) for i in range(len(units) - k + 1)] or ([tuple(units)] if units else [])
        known = {g: _gram_hash(spark, g, k) for g in set(grams)}
        assert all(known[g] == v for g, v in h.items())
        assert [at for _, at in kept] == models.winnow(text, units, lambda g: known[g], k, w)


def _gram_hash(spark, gram, k):
    units = F.array(*[F.xxhash64(F.lit(u)) for u in gram])
    one = F.xxhash64(*[F.get(units, i) for i in range(k)]) if len(gram) == k else F.xxhash64(units)
    return spark.range(1).select(F.shiftright(one, 32)).first()[0]


def test_equal_runs_are_found(spark):
    passage = " ".join(f"p{i}" for i in range(FP.K + FP.W - 1))
    texts = [" ".join(f"{c}{i}" for i in range(40)) + " " + passage + " " + " ".join(f"{c}{i}" for i in range(40, 55)) for c in "ab"]
    rows = FP.winnow(_texts(spark, texts), "text", "p").select(FP.hashes("p").alias("h")).collect()
    assert set(rows[0]["h"]) & set(rows[1]["h"])


def test_units_of_unspaced_scripts(spark):
    assert len(_prints(spark, ["汉字没有空格的文本也有很多单位"], 3, 2)[0]) > 1


def test_next_and_likeness(spark):
    rows = [(5, "e"), (1, "a"), (None, "n"), (3, "c"), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (1, 2, 100):
        got = FP.with_next(docs, "doc_id", F.col("text"), "next", per_chunk=size).collect()
        assert {(r["doc_id"], r["text"]): r["next"] for r in got} == {
            (None, "n"): "a", (1, "a"): "b", (3, "b"): "c", (3, "c"): "e", (5, "e"): "n"}
    assert FP.with_next(docs.limit(0), "doc_id", F.col("text"), "next").count() == 0
    assert FP.with_next(docs.limit(1), "doc_id", F.col("text"), "next").first()["next"] == "e"
    a = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<int>")
    got = spark.range(1).select(FP.likeness(a(), a()), FP.likeness(a(), a(1)), FP.likeness(a(1, 2), a(2, 3)), FP.likeness(a(1), a(1)))
    assert tuple(got.first()) == (1.0, 0.0, 1 / 3, 1.0)


def test_very_long_text(spark):
    got = _prints(spark, ["w1 w2 w3 w4 w5 w6 w7 " * 60_000], FP.K, FP.W)[0]
    assert len(got) > 60_000 / FP.W


def test_the_next_row_whatever_columns_are_named(spark):
    docs = spark.createDataFrame([(i, f"t{i}", i, "x", 2, 3) for i in range(9)], "doc_id bigint, text string, c bigint, after string, k int, head int")
    got = FP.with_next(docs, "doc_id", F.col("text"), "next", per_chunk=2)
    assert got.columns == [*docs.columns, "next"]
    assert {(r["doc_id"], r["c"], r["after"], r["k"], r["next"]) for r in got.collect()} == {(i, i, "x", 2, f"t{(i + 1) % 9}") for i in range(9)}


def test_columns_added_once_rows_are_dealt_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "doc_id bigint, text string")
    for size in (2, 100):
        got = FP.with_next(docs, "doc_id", F.struct("text", "n"), "next", per_chunk=size,
                           add=lambda df: df.withColumn("n", F.col("doc_id") * 10)).collect()
        assert {(r["doc_id"], r["n"], r["next"]["text"], r["next"]["n"]) for r in got} == {
            (i, i * 10, f"t{(i + 1) % 9}", (i + 1) % 9 * 10) for i in range(9)}


def test_the_next_text_is_not_winnowed_again(spark, tmp_path):
    texts = [" ".join(f"w{i * j % 97}" for j in range(60)) for i in range(5)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = FP.op2_winnow_fingerprints(spark, str(tmp_path))
    # The texts after are not split into units: their fingerprints come with them.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(" in plan and not re.search(r"regexp_extract_all\(\w*\(?_*next", plan)
    rows = {r["doc_id"]: r for r in got.collect()}
    prints = lambda i: {x.split("@")[0] for x in rows[i]["fingerprint"].split()}
    for i in range(7):
        a, b = prints(i), prints((i + 1) % 7)
        assert rows[i]["near_next"] == (len(a & b) / len(a | b) if a | b else 1.0)
