import random

from tests import models
from wordclips.operators import songs as SG


def notes_df(spark, rows):
    """rows: (part, start_ms, dur_ms, pitch)."""
    return spark.createDataFrame([(1, p, i, k, s, d, 90) for i, (p, s, d, k) in enumerate(rows)],
                                 "song_id bigint, part_id bigint, note_id bigint, pitch bigint, start_ms bigint, dur_ms bigint, velocity bigint")


def test_pairing_is_first_in_first_out_with_stray_offs(spark):
    r = random.Random(1)
    rows, want = [], []
    for key in range(30):
        ev = [(t, r.random() < 0.5) for t in sorted(r.sample(range(0, 400_000, 500), 20))]
        rows += [(1, 0, 0, key, t, i, on, 90) for i, (t, on) in enumerate(ev)]
        want += [(key, s, e) for s, e in models.pair_notes(ev)]
    ev = spark.createDataFrame(rows, "song_id bigint, track bigint, channel bigint, pitch bigint, tick bigint, seq bigint, is_on boolean, velocity bigint")
    ends = spark.createDataFrame([(1, 0, 999_999)], "song_id bigint, track bigint, end_tick bigint")
    got = [(x.pitch, x.start, x.end if x.released else None) for x in SG.pair_notes(ev, ends).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tempo_change_moves_later_notes(spark):
    tempo = spark.createDataFrame([(1, 0, 500_000), (1, 1920, 1_000_000)], "song_id bigint, tick bigint, usec bigint")
    ev = spark.createDataFrame([(1, 5, 2400), (1, 1, 240), (2, 9, 240)], "song_id bigint, event_id bigint, tick bigint")
    got = {x.event_id: x.seconds for x in SG.ticks_to_seconds(ev, tempo).collect()}
    assert got == {5: 3.0, 1: 0.25, 9: 0.25}
    ends = spark.createDataFrame([(1, 3840)], "song_id bigint, end_tick bigint")
    assert SG.main_bpm(tempo, ends).collect()[0].bpm == 60.0


def test_keys(spark):
    def key(rows):
        return SG.detect_key(notes_df(spark, rows)).collect()[0].key

    scale = [0, 2, 4, 5, 7, 9, 11, 12]
    assert key([(1, i * 500, 500, 60 + s) for i, s in enumerate(scale)]) == "C major"
    minor = [0, 2, 3, 5, 7, 8, 10, 12]
    assert key([(1, i * 500, 500, 57 + s) for i, s in enumerate(minor)] + [(2, 0, 500, 45), (2, 4000, 1500, 45)]) == "A minor"


def test_polyphony_and_weighted_median(spark):
    n = notes_df(spark, [(1, 0, 1000, 60), (1, 0, 1000, 64), (1, 500, 500, 67), (1, 2000, 4000, 72)])
    p = SG.polyphony(n).collect()[0]
    assert p.most == 3 and abs(p.typical - (2 * 500 + 3 * 500 + 4000) / 5000) < 1e-9
    assert SG.weighted_median(n).collect()[0].median_pitch == 72


def test_roles(spark):
    parts = spark.createDataFrame([(1, 1, 30, None, 40, 1.0, 9), (1, 2, 80, None, 72, 1.1, 20), (1, 3, 48, None, 60, 3.0, 9), (1, 4, None, "kick", 36, 1.0, 5),
                                   (2, 1, 30, None, 40, 1.0, 9), (2, 2, 33, None, 45, 1.0, 9), (2, 3, 80, None, 72, 1.0, 3)],
                                  "song_id bigint, part_id bigint, program bigint, drum_group string, median_pitch bigint, typical double, notes bigint")
    got = {(x.song_id, x.part_id): x.role for x in SG.assign_roles(parts).collect()}
    assert got == {(1, 1): "bass", (1, 2): "lead", (1, 3): "chords", (1, 4): "drums:kick", (2, 1): "rhythm", (2, 2): "bass", (2, 3): "lead"}


def test_octaves(spark):
    df = spark.createDataFrame([(36, 48), (28, 48), (72, 48), (50, 48), (50, None)], "m int, s int")
    from pyspark.sql import functions as F
    assert [x[0] for x in df.select(SG.auto_octave(F.col("m"), F.col("s"))).collect()] == [1, 2, -2, 0, 0]


def test_melody_keeps_what_is_30ms_after_the_last_kept(spark):
    r = random.Random(2)
    rows = [(1, s, 100, r.randrange(40, 80)) for s in (r.randrange(0, 4000) for _ in range(300))]
    got = [(x.start_ms, x.pitch) for x in SG.melody(notes_df(spark, rows)).collect()]
    assert sorted(got) == models.melody([(s, p) for _, s, _, p in rows])
