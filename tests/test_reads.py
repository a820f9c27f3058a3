"""What joins and scans read and deal out: each table once, and no key that gathers idle rows."""

from pyspark.sql import functions as F

from wordclips.operators import index as IX


def clips_of(spark, n=400, step=400):
    rows = [(1, i, "abcd"[i % 4], i * step, i * step + 150, 0) for i in range(n)]
    return spark.createDataFrame(rows, "source_id bigint, clip_id bigint, word string, start_ms bigint, end_ms bigint, edited int")


def read_from(df):
    """The stored tables that ``df`` reads."""
    return {f.rsplit("/", 2)[1].split("-")[0] for f in df.inputFiles()}


def test_clips_without_a_close_neighbour_are_dealt_out(spark):
    index = IX.build_index(clips_of(spark))
    onsets = spark.createDataFrame([("a", True), ("b", False)], "word string, vowel_onset boolean").hint("merge")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = IX.with_bleed_risk(index, onsets).withColumn("part", F.spark_partition_id())
        assert out.columns[-2:] == ["bleed_risk", "part"] and len(out.select("part").distinct().collect()) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out.count() == 400 and out.where("bleed_risk").count() == 0
    close = IX.with_bleed_risk(IX.build_index(clips_of(spark, step=200)), onsets)
    assert {x.next_word for x in close.where("bleed_risk").collect()} == {"a"} and close.where("bleed_risk").count() == 99


def test_a_recordings_first_chunk_has_one_door(spark, monkeypatch):
    from wordclips.operators import windows as WN
    seen, chained = [], WN.entered
    monkeypatch.setattr(WN, "entered", lambda doors: seen.append(doors.count()) or chained(doors))
    got = WN.window_words(clips_of(spark), "group", chunk_ms=200_000)
    assert seen == [1] and got.count() == 400
    assert [x.win for x in got.select("win").distinct().orderBy("win").collect()][:2] == [1, 101]


def test_runs_are_hashed_to_16_bytes_and_votes_joined_once(spark):
    from wordclips.operators import phrases as PR
    h = spark.range(1).select(PR._hash(F.lit("a"), F.lit("b")).alias("h")).select("h", PR._hash_both("h", "h").alias("g")).first()
    assert len(h.h) == len(h.g) == 16 and h.h != h.g
    none = spark.createDataFrame([], "word string, clip_id bigint, score bigint")
    out = PR.phrase_index(clips_of(spark), none)
    assert read_from(out) == {"voted"} and out.count() == 400


def test_plausible_takes_reads_its_takes_once(spark):
    from wordclips.operators import takes as TK
    floors = spark.createDataFrame([("a", 80)], "word string, floor_ms int")
    out = TK.plausible_takes(clips_of(spark), floors)
    assert read_from(out) == {"takes"} and out.count() == 400


def test_edge_audit_reads_its_rows_once(spark):
    from wordclips.operators import diagnostics as D
    phones = F.array(F.struct(F.lit("AE").alias("phone"), F.lit(0).alias("start_ms"), F.lit(300).alias("end_ms")))
    index = IX.build_index(clips_of(spark)).withColumns({"bleed_risk": F.lit(False), "phones": F.when(F.col("clip_id") % 2 == 0, phones)})
    out = D.edge_audit(index)
    assert read_from(out) == {"edges"}
    assert [(x.adjacent, x.n, x.end_cut) for x in out.collect()] == [(False, 200, 0.0)]


def test_captions_read_the_clips_reach_once(spark):
    from wordclips.operators import captions as CA
    caps = spark.createDataFrame([(1, 1, "a", 0), (1, 2, "z", 400)], "source_id bigint, cap_id bigint, word string, t_ms bigint")
    plan = CA.verify_captions(caps, clips_of(spark))
    assert read_from(plan) == {"seq"}
    assert {(x.cap_id, x.status, x.clip_word) for x in plan.collect()} == {(1, "agreed", None), (2, "disagree", "b")}
