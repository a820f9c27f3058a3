from pyspark.sql import functions as F

from wordclips.llm import chats

PARTS = "conv_id bigint, message int, seq bigint, kind string, role string, text string"


def _fold(spark, rows):
    folded = chats.drop_redone(chats.fold_events(spark.createDataFrame(rows, PARTS)), F.lit(0))
    return sorted((tuple(r[c] for c in ("conv_id", "message", "role", "text")) for r in folded.collect()), key=repr)


def test_deltas_edits_and_regenerations(spark):
    log = [(1, 0, 0, "start", "user", ""), (1, 0, 1, "delta", None, "he"), (1, 0, 2, "delta", None, "llo"),
           (1, 1, 3, "start", "assistant", "one"), (1, 2, 4, "start", "user", "more"), (1, 3, 5, "start", "assistant", "two"),
           (1, 0, 6, "edit", None, "hi"), (1, 1, 7, "regenerate", None, None), (1, 1, 8, "delta", None, "again"),
           (1, 2, 9, "start", "user", "next")]
    # The regeneration of message 1 voids 2 and 3; 2 was begun anew after it.
    assert _fold(spark, log) == [(1, 0, "user", "hi"), (1, 1, "assistant", "again"), (1, 2, "user", "next")]


def test_many_deltas_over_several_runs(spark):
    n = 5 * chats.RUN
    log = [(1, 0, i, "delta", "user", f"{i},") for i in range(n)]
    assert _fold(spark, log) == [(1, 0, "user", "".join(f"{i}," for i in range(n)))]
    log.append((1, 0, 100, "edit", None, None))
    log = [x for x in log if x[2] != 100 or x[3] == "edit"]
    assert _fold(spark, log) == [(1, 0, "user", "".join(f"{i}," for i in range(101, n)))]


def test_odd_events(spark):
    assert _fold(spark, []) == []
    assert _fold(spark, [(None, 0, None, "delta", None, "x"), (None, None, 1, "start", "user", None)]) == [
        (None, 0, None, "x"), (None, None, "user", "")]


def test_format_round_trip_and_mask(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\<|end|>\n<|start|>user<|say|>b", "ends in <", "\\", "", None, "é\n\n😀[[<\\\\<"]
    rows = [(i, t, ("assistant", "user", None, "as\nsistant<|say|>")[(i + t) % 4], nasty[(i + t) % 7]) for i in range(5) for t in range(70)]
    rows += [(9, 0, "user", "same"), (9, 0, "user", "same"), (9, None, "system", "first"), (None, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chats.format_turns(turns).withColumn("turns", chats.read_back(F.col("formatted"))) \
        .withColumn("loss", chats.loss_text(F.col("segments"))).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=key)
        out = next(g for g in got if g["conv_id"] == c)
        assert [(t["role"], t["text"]) for t in out["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert out["loss"] == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert "".join(s["text"] for s in out["segments"]) == out["formatted"]
        assert "[INST]" not in out["formatted"] and "</s>" not in out["formatted"]


def test_very_long_turn(spark):
    text = "ab<c" * 100_000
    turns = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    got = chats.format_turns(turns).withColumn("loss", chats.loss_text(F.col("segments"))).first()
    assert got["loss"] == text
