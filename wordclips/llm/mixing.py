"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected ``target / source_size`` times in the mix.
Along an order of the source's documents these expectations are summed up, one
random offset is added, and a document is emitted once per integer boundary its
own stretch of that sum crosses.  Long documents come first in the order, so the
words taken miss the target by less than the longest document of the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.llm.catalog import query, table
from wordclips.llm.text import count_words, whole
from wordclips.session import stored


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target of each source: shares of ``share`` x all sizes, none above ``most`` x its own.

    ``sizes`` has one row per ``source`` with ``source_size``.  Sources in code
    point order, null last, take ``weights`` in turn.  What a source can't take
    is reshared by weight until none is above its limit; that fixed point is
    ``min(limit, level * weight)`` for one level, found by sorting the sources by
    ``limit / weight``: below the level a source is full, above it is not.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                       (turn % len(weights) + 1).cast("int"))
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    level = (F.col("wanted") - F.col("before")) / F.col("left")
    ranked = (
        sizes.withColumn("weight", own)
        .withColumn("limit", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("before", F.coalesce(F.sum("limit").over(
            filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.when(level <= F.col("ratio"), level))
    )
    common = F.min_by("level", F.when(F.col("level").isNotNull(), F.struct(
        F.col("ratio"), F.col("source").isNull(), F.col("source")))).over(Window.partitionBy())
    target = F.least(F.col("limit"), F.coalesce(common * F.col("weight"), F.col("limit")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights: Sequence[float] = (5, 2, 1),
        share: float = 1.5, most: float = 2.0, seed: int = 17, near: int = 1000) -> DataFrame:
    """One row per document: doc_id, key, copy, source, size, source_size, target, copies.

    ``docs`` has doc_id, text and source; other columns are ignored.  ``size``
    defaults to the text's words (null: 0).  A null source is a source of its
    own.  Equal rows are told apart by ``copy`` (1, 2, ...); ``key`` names the
    text.  Empty texts have size 0 and are drawn like others; an empty table
    gives an empty mix.  The same seed gives the same mix.

    No source is sorted in one task: rows are counted per (source, size), and a
    group of equal sizes is cut by hash into parts of about ``near`` rows.
    """
    rows = stored(docs.select(
        "doc_id", "source", (count_words("text") if size is None else size).alias("size"),
        F.xxhash64(whole("text"), F.lit(seed)).alias("key")), "mix")
    same = F.col("source").eqNullSafe
    hist = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_size = Window.partitionBy("source").orderBy(F.desc("size"))
    hist = hist.withColumn("base", F.sum("n").over(by_size) - F.col("n"))

    # Rows of one size in hash order: parts of about `near` rows, ranks in a part, parts summed up.
    spread = F.xxhash64("doc_id", "key", F.lit(seed))
    h = hist.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "base")
    placed = rows.join(h, same(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z") \
        .withColumn("h", spread) \
        .withColumn("part", F.pmod("h", F.ceil(F.col("n") / near)))
    group = ["source", "size", "part"]
    ranked = placed.withColumn("at", F.row_number().over(
        Window.partitionBy(*group).orderBy("h", "doc_id", "key")))
    ranked = ranked.withColumn("copy", F.row_number().over(
        Window.partitionBy(*group, "h", "doc_id", "key").orderBy("at")).cast("bigint"))
    parts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("k"))
    parts = parts.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"),
        (F.sum("k").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("k")).alias("earlier"))
    ranked = ranked.join(parts, same(F.col("s")) & (F.col("size") == F.col("z"))
                         & (F.col("part") == F.col("p"))).drop("s", "z", "p")

    aims = targets(sizes, weights, share, most)
    aims = aims.select(F.col("source").alias("s"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.lit(((seed * 2654435761) % 2**32) / 2**32)
    rank = F.col("base") + F.col("earlier") + F.col("at")
    crossed = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return ranked.join(aims, same(F.col("s"))).select(
        "doc_id", "key", "copy", "source", "size", "source_size", "target",
        crossed.cast("bigint").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken from its source, with ``repeat`` from 1.

    Rows of one doc_id, text and source are told apart by lang and n_chars; equal rows are interchangeable.
    """
    seed = how.get("seed", 17)
    plan = mix(docs, **how).where("copies > 0").select(
        F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("copy").alias("c"), F.col("source").alias("s"),
        "size", "source_size", "target", "copies")
    keyed = docs.select("doc_id", "text", "lang", "source", "n_chars",
                        F.xxhash64(whole("text"), F.lit(seed)).alias("key"))
    keyed = keyed.withColumn("copy", F.row_number().over(
        Window.partitionBy("doc_id", "key", "source").orderBy("lang", "n_chars")))
    meet = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")) & (F.col("copy") == F.col("c"))
    return keyed.join(plan, meet).select(
        "doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target",
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("repeat"))


@query("op3_mix_sources")
def op3_mix_sources(spark, sf_dir):
    """Contract: doc_id, size, source_size, target, taken (and source, copies)."""
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target",
                    (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
