"""Loudness of parts from power per 0.1 s block, and balancing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.operators import ordered as O

PART = ["song_id", "part_id"]
SILENCE, RELATIVE, PLAYING = -70.0, -10.0, 20.0
RIDE_BLOCKS, RIDE_ABOVE, RIDE_STRENGTH, MAX_MOVE = 30, 2.0, 0.75, 12.0
LEAD_TRUST, REFERENCE = 3.0, -20.0

# Where each role sits under the lead, in dB.
ROLE_TARGETS = {"lead": 0.0, "bass": -2.9, "chords": -3.4, "rhythm": -5.1, "drums:kick": -4.0, "drums:snare": -10.7,
                "drums:hats": -23.1, "drums:toms": -4.0, "drums:cymbals": -25.8, "drums:perc": -26.3}
BACKING = -5.1


def lufs(power: Column) -> Column:
    return F.lit(-0.691) + 10.0 * F.log10(F.greatest(power, F.lit(1e-20)))


def role_target(role: Column) -> Column:
    out = F.lit(BACKING)
    for name, db in ROLE_TARGETS.items():
        out = F.when(role == name, F.lit(db)).otherwise(out)
    return out


def gated_loudness(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Loudness while playing: silence and what is far below the rest left out."""
    keys = keys or PART
    loud = blocks.where(lufs(F.col("power")) > SILENCE)
    gate = loud.groupBy(*keys).agg(F.avg("power").alias("mean"))
    kept = loud.join(gate, keys).where(lufs(F.col("power")) > lufs(F.col("mean")) + RELATIVE)
    fine = kept.groupBy(*keys).agg(F.avg("power").alias("kept"))
    return gate.join(fine, keys, "left").select(*keys, lufs(F.coalesce("kept", "mean")).alias("lufs"))


def role_share(blocks: DataFrame, loud: DataFrame) -> DataFrame:
    """How much of its role's place a part gets when others play with it.

    ``blocks`` carries ``role``; a part plays where it is within 20 dB of its
    own loudness.
    """
    on = blocks.join(loud, PART).where(F.col("power") > F.pow(F.lit(10.0), (F.col("lufs") + 0.691 - PLAYING) / 10.0))
    count = on.groupBy("song_id", "role", "block").agg(F.count(F.lit(1)).alias("n"))
    mine = on.join(count, ["song_id", "role", "block"]).groupBy(*PART).agg(F.avg(1.0 / F.col("n")).alias("share"))
    return loud.select(*PART).join(mine, PART, "left").withColumn("share", F.coalesce("share", F.lit(1.0)))


def reference_level(parts: DataFrame) -> DataFrame:
    """Where a song's lead sits (A18); ``parts`` is (song_id, part_id, role, lufs, share)."""
    implied = F.col("lufs") - role_target(F.col("role")) - 10.0 * F.log10("share")
    p = parts.withColumn("implied", implied)
    every = p.groupBy("song_id").agg(F.percentile("implied", 0.5).alias("every"),
                                     F.percentile(F.when(F.col("role") == "lead", F.col("implied")), 0.5).alias("leads"))
    return every.select("song_id", F.when(F.col("leads").isNull(), F.col("every")).otherwise(
        F.least(F.col("leads"), F.col("every") + LEAD_TRUST)).alias("reference"))


def ride_gain(blocks: DataFrame, chunk: int = 6_000) -> DataFrame:
    """A gain per block turning a part's loud sections down.

    The level is the mean of the 30 blocks around each (15 before, 14 after),
    fewer in a shorter part and at its ends; what exceeds the usual level while
    playing by over 2 dB is cut by three quarters of the excess.
    """
    size = blocks.groupBy(*PART).agg(F.count(F.lit(1)).alias("size"))
    sized = blocks.join(size, PART)
    half = RIDE_BLOCKS // 2
    w = Window.partitionBy(*PART, "chunk").orderBy("block")
    long = O.with_halo(sized.where(F.col("size") >= RIDE_BLOCKS), "block", chunk, RIDE_BLOCKS, RIDE_BLOCKS) \
        .withColumn("near", F.avg("power").over(w.rangeBetween(-half, RIDE_BLOCKS - half - 1))).where("own")
    # A part shorter than the window, under 30 rows, takes its own length as the width.
    whole = F.collect_list(F.struct("block", "power")).over(Window.partitionBy(*PART))
    left = F.floor(F.col("size") / 2)
    inside = F.filter("whole", lambda x: (x["block"] >= F.col("block") - left)
                      & (x["block"] <= F.col("block") + F.col("size") - left - 1))
    short = sized.where(F.col("size") < RIDE_BLOCKS).withColumn("whole", whole) \
        .withColumn("near", F.aggregate(inside, F.lit(0.0), lambda a, x: a + x["power"]) / F.size(inside))
    cols = [*PART, "block", lufs(F.col("near")).alias("st")]
    st = long.select(*cols).unionByName(short.select(*cols))
    loud = gated_loudness(blocks)
    on = st.join(loud, PART)
    usual = O.quantile(on.where(F.col("st") > F.col("lufs") - PLAYING), PART, "st",
                       F.floor(F.col("st") * 10), usual=0.5)
    t = on.join(usual, PART, "left")
    over = F.col("st") - (F.coalesce("usual", "lufs") + RIDE_ABOVE)
    cut = F.least(F.lit(MAX_MOVE), F.greatest(over, F.lit(0.0)) * RIDE_STRENGTH)
    return t.select(*PART, "block", F.pow(F.lit(10.0), -cut / 20.0).alias("gain"))


def gain_for(measured: Column, role: Column, trim_db: Column, reference: Column, share: Column) -> Column:
    """How far to move a part, as a factor."""
    err = reference + role_target(role) + 10.0 * F.log10(share) - measured
    down = -F.greatest(F.lit(0.0), -err - 1.5)
    up = F.greatest(F.lit(0.0), err - 3.0) * 0.6
    move = F.greatest(F.lit(-MAX_MOVE), F.least(F.lit(MAX_MOVE), F.when(err < 0, down).otherwise(up))) + trim_db
    return F.pow(F.lit(10.0), F.when(measured.isNull(), trim_db).otherwise(move) / 20.0)
