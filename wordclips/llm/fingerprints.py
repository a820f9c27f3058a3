"""Winnowed document fingerprints, in DataFrame functions only.

Units are words (a character of a script written without blanks counts as one).
Every run of ``k`` units is hashed; of every ``w`` hashes in a row the smallest
is kept, the rightmost one among equals, with its position.  Two texts that
share a run of ``w + k - 1`` units share a fingerprint inside it; fewer than
``k`` units in common are never reported.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.llm.catalog import query, table
from wordclips.llm.text import whole

K, W = 5, 12
#: Scripts without blanks between words: each of their characters is a unit.
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNIT = rf"[{_SINGLE}]|[^\x20\x09-\x0D{_SINGLE}]+"

_LOW = (1 << 31) - 1


def _pairs(df: DataFrame, new: str, left: str, shift: int, join) -> DataFrame:
    """``new[i] = join(left[i], left[i + shift])``, as long as both exist."""
    n = F.greatest(F.size(left) - shift, F.lit(0))
    return df.withColumn(new, F.zip_with(F.slice(left, F.lit(1), n), F.slice(left, F.lit(shift + 1), n), join))


def winnow(df: DataFrame, text: str, into: str, k: int = K, w: int = W) -> DataFrame:
    """Add ``into``: array of longs, each a kept hash (high 32 bits) with its position (low 31).

    Positions count units from 0 and rise.  A text of fewer than ``k`` units is
    one hash of all its units; an empty or null text has none; with fewer than
    ``w`` hashes the smallest of all is kept.  Equal texts have equal arrays.
    """
    if w < 2 or k < 1:
        raise ValueError("k must be at least 1 and w at least 2")
    tmp = [f"__{into}_{i}" for i in range(4)]
    out = df.withColumn(tmp[0], F.transform(F.regexp_extract_all(whole(text), F.lit(UNIT), F.lit(0)),
                                            lambda u: F.xxhash64(u)))
    units = tmp[0]
    # The hash above, the position counted down below: the least value is the smallest hash, rightmost.
    pack = lambda h, i: F.shiftleft(F.shiftright(h, 32), 32).bitwiseOR(F.lit(_LOW).cast("bigint") - i)
    full = F.transform(F.sequence(F.lit(0), F.size(units) - k), lambda i: pack(F.xxhash64(
        *[F.get(units, i + j if j else i) for j in range(k)]), i))
    packed = F.when(F.size(units) >= k, full).when(F.size(units) > 0, F.array(pack(F.xxhash64(units), F.lit(0)))) \
        .otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(tmp[1], packed).drop(units)
    # Minima of runs of 1, 2, 4, ... hashes; a run of w is covered by two of the longest.
    at, span, least = tmp[1], 1, lambda a, b: F.least(a, b)
    whole_min = F.array(F.array_min(tmp[1]))
    out = out.withColumn(tmp[3], F.when(F.size(tmp[1]) > 0, whole_min).otherwise(F.array().cast("array<bigint>")))
    turn = 0
    while span < w:
        step = min(span, w - span)
        new = f"__{into}_m{turn}"
        out = _pairs(out, new, at, step, least).drop(at)
        at, span, turn = new, span + step, turn + 1
    kept = F.when(F.size(at) > 0, F.array_distinct(at)).otherwise(F.col(tmp[3]))
    return out.withColumn(into, F.transform(kept, lambda x: F.shiftleft(F.shiftright(x, 32), 32).bitwiseOR(
        F.lit(_LOW).cast("bigint") - x.bitwiseAND(F.lit(_LOW).cast("bigint"))))).drop(at, tmp[3])


def hashes(prints: Column | str) -> Column:
    """The distinct hashes of a fingerprint, without their positions."""
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 32).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes; two empty ones are alike, an empty and another not."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared))


def shown(prints: str) -> Column:
    """``hash@position`` of each kept hash, hexadecimal and decimal, blanks between."""
    return F.array_join(F.transform(prints, lambda x: F.concat(
        F.hex(F.shiftrightunsigned(x, 32)), F.lit("@"),
        x.bitwiseAND(F.lit(_LOW).cast("bigint")).cast("string"))), " ")


def with_next(docs: DataFrame, key: str, value: Column, into: str, per_chunk: int = 2000,
              add: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``into``: ``value`` of the row with the next larger ``key``, after the last that of the first.

    Rows with equal keys follow one another in order of ``value``; a null key
    comes first.  The rows are cut at quantiles of ``key`` into chunks, each in
    order in its own task; from the next chunk only the first row is needed.
    ``add`` gives rows further columns, which ``value`` may use and the result
    keeps; it works once on each row, after the rows are dealt out.
    ``key`` is numeric; input columns may have any name without two leading underscores.
    """
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("have")).first()
    parts = max(1, min(10_000, stats["n"] // per_chunk))
    edges: list = []
    if stats["have"] and parts > 1:
        edges = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    splits = [-math.inf, *sorted({float(e) for e in edges} or {0.0}), math.inf]
    cut = Bucketizer(splits=splits, inputCol="__at", outputCol="__chunk", handleInvalid="keep")
    placed = cut.transform(docs.withColumn("__at", F.col(key).cast("double"))).drop("__at") \
        .withColumn("__chunk", F.when(F.col(key).isNull(), -1).otherwise(F.col("__chunk").cast("int")))
    narrow = placed.select(key, "__chunk")
    add = add or (lambda df: df)
    order = [F.col(key).asc_nulls_first(), F.col("__value")]
    inside = add(placed.repartition("__chunk")).withColumn("__value", value).withColumn(
        "__next", F.lead(F.struct("__value")).over(Window.partitionBy("__chunk").orderBy(*order)))
    # One key per chunk (at most 10,000, checked above), then the value of that key's first row.
    firsts = narrow.groupBy("__chunk").agg(F.min(F.struct(F.col(key).alias("key"))).alias("__k"))
    # struct() orders null first, as above.
    heads = placed.join(F.broadcast(firsts.select(F.col("__chunk").alias("__c"), F.col("__k")["key"].alias("__k"))),
                      (F.col("__chunk") == F.col("__c")) & F.col(key).eqNullSafe(F.col("__k")))
    heads = add(heads).withColumn("__value", value).groupBy("__chunk").agg(F.min(F.struct("__value")).alias("head"))
    around = Window.orderBy("__chunk")
    ends = heads.select(F.col("__chunk").alias("__c"), F.coalesce(
        F.lead("head").over(around), F.first("head").over(
            around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__after"))
    joined = inside.join(ends, F.col("__chunk") == F.col("__c"))
    return joined.withColumn(into, F.coalesce("__next", "__after")["__value"]) \
        .drop("__chunk", "__value", "__next", "__c", "__after")


@query("op2_winnow_fingerprints")
def op2_winnow_fingerprints(spark, sf_dir):
    """Contract: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole("text").alias("text"))
    # The next document's fingerprint is its own: each text is winnowed once, each edited text once.
    pairs = with_next(docs, "doc_id", F.struct("text", "a"), "next",
                      add=lambda df: winnow(df, "text", "own").withColumn("a", hashes("own")))
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - cut as int))"), F.expr("substring(next.text, 1, cut)"))
    out = pairs.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("cut", cut) \
        .withColumn("edited", edited)
    out = winnow(out, "edited", "changed")
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown("own").alias("fingerprint"), shown("changed").alias("edited_fingerprint"),
        likeness(F.col("a"), hashes("changed")).alias("near_edited"),
        likeness(F.col("a"), F.col("next.a")).alias("near_next"))
