from pyspark.sql import functions as F

from wordclips.operators import diagnostics as D
from wordclips.operators import frames as FR
from wordclips.operators import tone as TN
from wordclips.plans.tables import Tables


def _tables(spark, path):
    words = ["a", "bb" * 40, "ccc", "word"] * 9
    rows = [(1, " ".join(words), "en", "x"), (2, "one", "en", "x"), (2, "one", "en", "x"), (None, "null id", "en", "x"), (4, None, "en", "x"), (5, "z" * 200, "de", "y")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return Tables(spark, str(path))


def test_frames_are_those_of_the_clips_and_lie_in_their_part(spark, tmp_path):
    t = _tables(spark, tmp_path)
    got = sorted(tuple(r) for r in t.frames.select("source_id", "clip_id", "part", "t_ms", "rms").collect())
    want = []
    for r in t.clips.where("end_ms > start_ms").collect():
        for k in range((r["end_ms"] - r["start_ms"]) // 10 + 1):
            at = r["start_ms"] + k * 10
            want.append((r["source_id"], r["clip_id"], at // FR.PART_MS, at, (r["clip_id"] * 37 + k * 101) % 17 * 60 + 200))
    assert got == sorted(want) and len({x[2] for x in got}) > 3


def test_frames_stay_where_their_clips_were_sent(spark, tmp_path):
    t = _tables(spark, tmp_path)
    f = t.frames.groupBy("source_id", "part", "t_ms").agg(F.min("rms").cast("double").alias("rms"))
    # The clips are dealt out once; grouping the frames moves nothing.
    assert f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(source_id") == 1
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Clips made into frames and clips they are looked up in: one exchange each.
        assert D.frames_in_clips(f, t.clips)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(source_id") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_part_changes_no_result(spark, tmp_path):
    t = _tables(spark, tmp_path)
    f = t.frames.select("source_id", "part", "t_ms", F.col("rms").cast("double").alias("rms"), (F.col("rms") / 7).alias("f0"), F.lit(0.5).alias("bright")).distinct()
    c = t.clips.where("end_ms > start_ms").withColumn("n_phones", F.length("word"))
    rows = lambda df: sorted(map(str, df.collect()))
    rounded = lambda df: df.select("clip_id", *[F.round(x, 6).alias(x) for x in TN.FEATURES])
    assert rows(rounded(TN.tone_features(f, c))) == rows(rounded(TN.tone_features(f.drop("part"), c)))
    cols = ["clip_id", "t_ms", "rms"]
    assert rows(D.frames_in_clips(f, c).select(*cols)) == rows(D.frames_in_clips(f.drop("part"), c).select(*cols))
