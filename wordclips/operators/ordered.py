"""Ordered computations that survive a group holding a large share of all rows.

A plain ``Window.partitionBy(source)`` puts a whole recording into one task.
Here a group is cut into *chunks* along its order.  Every chunk is handled by
its own window, each chunk is summed up in one row (a partial aggregation), and
what a chunk inherits from its neighbours is found by a window over those
summary rows alone.  ``scan`` is the general form; ``quantile`` and
``band_keys`` build on the same idea.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.session import stored

_CHUNK = "__chunk"
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


@dataclass(frozen=True)
class Step:
    """One ordered column: inside a chunk, per chunk, across chunks, combined."""

    local: Callable
    summary: Callable
    carry: Callable
    combine: Callable


def _box(expr) -> Column:
    # A struct is never null itself, so "no such row" and "null value" differ.
    return F.struct(_col(expr).alias("v"))


def _col(expr) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


def lag(expr, where: Column | None = None) -> Step:
    """Value of the previous row, or of the previous row satisfying ``where``."""
    if where is None:
        return Step(
            lambda w, wd: F.lag(_box(expr)).over(w),
            lambda o: F.max_by(_box(expr), o),
            lambda s, w, wd: F.lag(s).over(w),
            lambda a, b: F.coalesce(a, b)["v"],
        )
    return Step(
        lambda w, wd: F.last(F.when(where, _box(expr)), True).over(w.rowsBetween(*_BEFORE)),
        lambda o: F.max_by(_box(expr), F.when(where, o)),
        lambda s, w, wd: F.last(s, True).over(w.rowsBetween(*_BEFORE)),
        lambda a, b: F.coalesce(a, b)["v"],
    )


def lead(expr, where: Column | None = None) -> Step:
    """Value of the next row, or of the next row satisfying ``where``."""
    if where is None:
        return Step(
            lambda w, wd: F.lead(_box(expr)).over(w),
            lambda o: F.min_by(_box(expr), o),
            lambda s, w, wd: F.lead(s).over(w),
            lambda a, b: F.coalesce(a, b)["v"],
        )
    return Step(
        lambda w, wd: F.last(F.when(where, _box(expr)), True).over(wd.rowsBetween(*_BEFORE)),
        lambda o: F.min_by(_box(expr), F.when(where, o)),
        lambda s, w, wd: F.last(s, True).over(wd.rowsBetween(*_BEFORE)),
        lambda a, b: F.coalesce(a, b)["v"],
    )


def latest(expr, where: Column) -> Step:
    """Value of the last row satisfying ``where``, this row included."""
    return Step(
        lambda w, wd: F.last(F.when(where, _box(expr)), True).over(w.rowsBetween(*_UPTO)),
        lambda o: F.max_by(_box(expr), F.when(where, o)),
        lambda s, w, wd: F.last(s, True).over(w.rowsBetween(*_BEFORE)),
        lambda a, b: F.coalesce(a, b)["v"],
    )


def rank() -> Step:
    """1-based position in the whole group."""
    return Step(
        lambda w, wd: F.row_number().over(w).cast("bigint"),
        lambda o: F.count(F.lit(1)),
        lambda s, w, wd: F.sum(s).over(w.rowsBetween(*_BEFORE)),
        lambda a, b: a + F.coalesce(b, F.lit(0)),
    )


def total() -> Step:
    """Rows of the whole group."""
    return Step(
        lambda w, wd: F.count(F.lit(1)).over(w.rowsBetween(*_ALL)),
        lambda o: F.count(F.lit(1)),
        lambda s, w, wd: F.sum(s).over(w.rowsBetween(*_ALL)),
        lambda a, b: F.coalesce(b, a),
    )


def running_sum(expr) -> Step:
    return Step(
        lambda w, wd: F.sum(_col(expr)).over(w.rowsBetween(*_UPTO)),
        lambda o: F.sum(_col(expr)),
        lambda s, w, wd: F.sum(s).over(w.rowsBetween(*_BEFORE)),
        lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    )


def sum_before(expr) -> Step:
    return Step(
        lambda w, wd: F.sum(_col(expr)).over(w.rowsBetween(*_BEFORE)),
        lambda o: F.sum(_col(expr)),
        lambda s, w, wd: F.sum(s).over(w.rowsBetween(*_BEFORE)),
        lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    )


def running_max(expr) -> Step:
    return Step(
        lambda w, wd: F.max(_col(expr)).over(w.rowsBetween(*_UPTO)),
        lambda o: F.max(_col(expr)),
        lambda s, w, wd: F.max(s).over(w.rowsBetween(*_BEFORE)),
        lambda a, b: F.greatest(a, b),
    )


def running_min(expr) -> Step:
    return Step(
        lambda w, wd: F.min(_col(expr)).over(w.rowsBetween(*_UPTO)),
        lambda o: F.min(_col(expr)),
        lambda s, w, wd: F.min(s).over(w.rowsBetween(*_BEFORE)),
        lambda a, b: F.least(a, b),
    )


def min_before(expr) -> Step:
    return Step(
        lambda w, wd: F.min(_col(expr)).over(w.rowsBetween(*_BEFORE)),
        lambda o: F.min(_col(expr)),
        lambda s, w, wd: F.min(s).over(w.rowsBetween(*_BEFORE)),
        lambda a, b: F.least(a, b),
    )


def min_after(expr) -> Step:
    return Step(
        lambda w, wd: F.min(_col(expr)).over(wd.rowsBetween(*_BEFORE)),
        lambda o: F.min(_col(expr)),
        lambda s, w, wd: F.min(s).over(wd.rowsBetween(*_BEFORE)),
        lambda a, b: F.least(a, b),
    )


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
         **steps: Step) -> DataFrame:
    """Add ordered columns per ``keys``; ``order`` must be total in a group.

    ``chunk`` must not decrease along ``order``.  Rows without a key or chunk are left out.  With no
    chunk each group is one window: only for groups known to be small.
    """
    keys, order = list(keys), list(order)
    if chunk is None:
        one = Window.partitionBy(*keys)
        w, wd = one.orderBy(*order), one.orderBy(*[F.desc(c) for c in order])
        return df.select(*[c for c in df.columns if c not in steps], *[
            s.combine(s.local(w, wd), F.lit(None)).alias(n) for n, s in steps.items()])
    base = df.withColumn(_CHUNK, chunk)
    # Every row left finds its chunk, so Spark may leave the join out where none of the steps is read.
    base = base.where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, _CHUNK)]))
    near = Window.partitionBy(*keys, _CHUNK)
    w, wd = near.orderBy(*order), near.orderBy(*[F.desc(c) for c in order])
    at = F.struct(*order)
    rows = base.select("*", *[s.local(w, wd).alias(f"__l_{n}") for n, s in steps.items()])
    summary = base.groupBy(*keys, _CHUNK).agg(
        *[s.summary(at).alias(f"__s_{n}") for n, s in steps.items()])
    far = Window.partitionBy(*keys)
    k, kd = far.orderBy(_CHUNK), far.orderBy(F.desc(_CHUNK))
    carried = summary.select(*keys, _CHUNK, *[
        s.carry(F.col(f"__s_{n}"), k, kd).alias(f"__c_{n}") for n, s in steps.items()])
    kept = [c for c in df.columns if c not in steps]
    return rows.join(carried, [*keys, _CHUNK], "left").select(*kept, *[
        s.combine(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, s in steps.items()])


def quantile(df: DataFrame, keys: Sequence[str], value: str, chunk: Column | None = None,
             **points: float | str) -> DataFrame:
    """Exact quantiles per group from a value histogram, never a list of values.

    A number asks for the linearly interpolated quantile, ``"upper"`` for the
    upper median (element ``n // 2`` of the sorted values).
    """
    keys = list(keys)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n"))
    if chunk is None:
        # One row per distinct value: a window over them is small.
        w = Window.partitionBy(*keys)
        both = hist.withColumns({
            "__hi": F.sum("__n").over(w.orderBy(value).rowsBetween(*_UPTO)),
            "__total": F.sum("__n").over(w)})
    else:
        cum = scan(hist, keys, [value], chunk, __hi=running_sum("__n"))
        totals = hist.groupBy(*keys).agg(F.sum("__n").alias("__total"))
        both = cum.join(totals, keys) if keys else cum.crossJoin(F.broadcast(totals))
    lo_edge = F.col("__hi") - F.col("__n")

    def at(rank_: Column) -> Column:
        return F.max(F.when((lo_edge <= rank_) & (rank_ < F.col("__hi")), F.col(value)))

    aggs, outs = [], []
    for name, p in points.items():
        if p == "upper":
            aggs.append(at(F.floor(F.col("__total") / 2)).alias(name))
            outs.append(F.col(name))
            continue
        place = F.lit(float(p)) * (F.col("__total") - 1)
        aggs.append(at(F.floor(place)).alias(f"__lo_{name}"))
        aggs.append(at(F.ceil(place)).alias(f"__up_{name}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"__t_{name}"))
        lo, up = F.col(f"__lo_{name}").cast("double"), F.col(f"__up_{name}").cast("double")
        outs.append((lo + (up - lo) * F.col(f"__t_{name}")).alias(name))
    return both.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def by_clip(table: DataFrame) -> list[str]:
    """How a table about clips names them: with their source where it has it.

    Clips that lie where their recording does then meet it without a shuffle.
    """
    return [c for c in ("source_id", "clip_id") if c in table.columns]


def bucket(ms, width: int) -> Column:
    return F.floor(_col(ms) / F.lit(width)).cast("bigint")


def buckets_between(lo, hi, width: int) -> Column:
    """Every bucket a closed interval touches (none when it is reversed)."""
    return F.explode(F.when(_col(lo) <= _col(hi),
                            F.sequence(bucket(lo, width), bucket(hi, width))))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                 left_span: tuple, right_span: tuple, width: int, part: str | None = None) -> DataFrame:
    """Pairs whose closed spans [lo, hi] meet, found by an equi-join on buckets.

    Each pair is kept only in the bucket where the later of the two spans
    starts, so no distinct is needed and a hot key is spread over its buckets.
    ``part`` names the bucket of a left side of moments (lo equal to hi) that has
    it already: rows dealt out by the keys and ``part`` then stay where they are.
    Such rows may come from far fewer ones, by whose size Spark would broadcast
    them, so they are merged.
    """
    l_lo, l_hi = map(_col, left_span)
    r_lo, r_hi = map(_col, right_span)
    a = left.select("*", l_lo.alias("__ll"), l_hi.alias("__lh"),
                    (F.col(part) if part else buckets_between(l_lo, l_hi, width)).alias("__b"))
    b = right.select("*", r_lo.alias("__rl"), r_hi.alias("__rh"),
                     buckets_between(r_lo, r_hi, width).alias("__b"))
    if part:
        a = a.hint("merge")
    meets = (F.col("__ll") <= F.col("__rh")) & (F.col("__rl") <= F.col("__lh"))
    first = F.col("__b") == bucket(F.greatest("__ll", "__rl"), width)
    return (a.join(b, [*keys, "__b"]).where(meets & first)
            .drop("__b", "__ll", "__lh", "__rl", "__rh"))


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
              value: Column, k: int, name: str) -> DataFrame:
    """Add ``name``: ``value`` (a struct) of up to ``k`` rows after this one, in order."""
    keys, order = list(keys), list(order)
    base = df.withColumn(_CHUNK, chunk)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    rows = base.withColumn("__l", F.collect_list(value).over(w.rowsBetween(1, k)))
    firsts = base.select(*keys, _CHUNK, value.alias("__v"), F.row_number().over(w).alias("__r")) \
        .where(F.col("__r") <= k)
    heads = firsts.groupBy(*keys, _CHUNK).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda x: x["__v"]).alias("__h"))
    far = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(1, k)
    # The next k chunks hold at least k rows between them, where so many follow.
    carried = heads.select(*keys, _CHUNK, F.flatten(F.collect_list("__h").over(far)).alias("__c"))
    return rows.join(carried, [*keys, _CHUNK]).withColumn(
        name, F.slice(F.concat("__l", "__c"), 1, k)).drop("__l", "__c", _CHUNK)


def with_halo(df: DataFrame, place: str, size: int, before: int, after: int) -> DataFrame:
    """Rows cut into chunks of ``size`` along ``place``, each with the rows just outside it.

    Adds ``chunk`` and ``own``; a window per chunk then sees up to ``before``
    and ``after`` rows beyond it, and only ``own`` rows are kept.
    """
    home = bucket(place, size)
    near = F.array_distinct(F.array(
        home, bucket(F.col(place) + before, size), bucket(F.col(place) - after, size)))
    return df.select("*", home.alias("__home"), F.explode(near).alias("chunk")) \
        .withColumn("own", F.col("chunk") == F.col("__home")).drop("__home")


def reach(first: DataFrame, step: DataFrame, keys: Sequence[str], longest: int) -> DataFrame:
    """Every (keys..., n) met from those of ``first`` by following ``step`` (keys..., n, to), each once.

    Each n has one ``to`` at most and no way comes back; ``longest`` is no less
    than the steps of the longest way.  Pointer doubling: tables of 1, 2, 4, ...
    steps are joined from one another, and what lies at any distance is gathered
    from the longest steps to the shortest, so the rounds grow with the logarithm.
    """
    keys = list(keys)
    jumps = [step.select(*keys, "n", "to")]
    while (1 << len(jumps)) <= longest:
        now = jumps[-1]
        then = now.select(*keys, F.col("n").alias("to"), F.col("to").alias("__far"))
        jumps.append(stored(now.join(then, [*keys, "to"]).select(*keys, "n", F.col("__far").alias("to")), "jumps"))
    met = first.select(*keys, "n")
    for now in reversed(jumps):
        met = met.unionByName(met.join(now, [*keys, "n"]).select(*keys, F.col("to").alias("n")))
    return met
