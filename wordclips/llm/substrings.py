"""Exact removal of repeated byte strings, by distributed prefix doubling.

A full suffix array of the corpus would sort one (position, rank) pair per byte
and round.  Here only positions that can still matter are sorted:

* Anchors.  Of every ``window`` positions in a row the one whose 16-byte string
  has the smallest hash is the anchor (the rightmost of equals).  The anchor of a
  position depends only on the ``size`` bytes that start there, so equal strings
  have their anchors in the same place, and positions with one anchor are a range.
* A round ranks every range by a prefix: bytes that all strings of the range
  share.  Ranks held once are unique: the range is done.  The rank of the whole
  stretch (the range and ``size`` bytes beyond) is held twice: all its strings are
  repeated, past the threshold.  What is neither is cut into shorter ranges, whose
  shared prefix is longer, and ranked again: 40 bytes at first, then 185, then 200.
* A range that is settled stays in the next round as one representative, for
  others may hold some of its strings.

Ranks are 64-bit names of strings, made from prefix sums; two are compared at a
time (shared bytes and stretch), 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordclips.llm import arrays
from wordclips.llm.catalog import query, table
from wordclips.llm.text import text_key, whole
from wordclips.session import stored

SIZE = 200
GRAM = 16
#: Positions per range in the rounds after the first.
WIDTHS = (16, 1)
_STEP = 1 << 20

#: place: first position, one less than the number of positions, and distance from the
#: first position to the anchor, in one number (see _packed).
_RANGES = "key long, place long, name long, stretch long, settled boolean"


def _window(size: int) -> int:
    """Positions with one anchor lie within this many; the prefix they share is 40 bytes at 200."""
    return max(1, size - max(GRAM, size // 5) + 1)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` values in a row."""
    span = 1
    while span < w:
        step = min(span, w - span)
        v = np.minimum(v[:len(v) - step], v[step:])
        span += step
    return v


def anchored(data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(lo, hi, name, stretch, shape) of each anchor's range of positions, a stretch of text at a time.

    A range at the edge of a stretch of text is cut there, so that memory does
    not grow with the text; a cut range is only a shorter one.
    """
    window = _window(size)
    gram = min(GRAM, size - window + 1)
    last = len(data) - size                 # the last position a whole string starts at
    for base in range(0, last + 1, _STEP):
        end = min(base + _STEP, last + 1)   # positions [base, end)
        part = data[base:end + size - 1]
        h = arrays.prefix(part)
        n = end - base
        at = np.arange(n + window - 1)
        value = arrays.stretch(h, at, at + gram)
        # Smallest hash first, the rightmost of equals: the place counted down in the low bits.
        packed = (value >> np.uint64(24) << np.uint64(24)) | (np.uint64((1 << 24) - 1) - at.astype(np.uint64))
        anchor = (np.uint64((1 << 24) - 1) - (_sliding_min(packed, window) & np.uint64((1 << 24) - 1))).astype(np.int64)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1, [n]))
        lo, hi = cut[:-1], cut[1:] - 1
        a = anchor[lo]
        name = arrays.stretch(h, a, a + size - window + 1)
        yield lo + base, hi + base, a - lo, name, _whole(h, lo, hi, a - lo, size)


def _whole(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, ahead: np.ndarray, size: int) -> np.ndarray:
    """Rank of a range's stretch and of where its anchor lies in it."""
    return arrays.stretch(h, lo, hi + size) ^ arrays.mix(ahead.astype(np.uint64), 0xA11CE)


def cut_ranges(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, ahead: np.ndarray, name: np.ndarray,
               settled: np.ndarray, size: int, width: int) -> tuple[np.ndarray, ...]:
    """Ranges cut where the distance to the anchor is a multiple of ``width``: the same places everywhere."""
    near, far = (ahead - (hi - lo)) // width, ahead // width
    many = far - near + 1
    of = np.repeat(np.arange(len(lo)), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    j = near[of] + step
    a = lo[of] + ahead[of]
    new_lo = a - np.minimum(ahead[of], width * j + width - 1)
    new_hi = a - np.maximum((ahead - (hi - lo))[of], width * j)
    base = int(lo.min())
    h = arrays.prefix(data[base:int(hi.max()) + size])
    core = arrays.stretch(h, a - width * j - base, a - width * j - width + 1 + size - base)
    named = arrays.mix(name[of] ^ arrays.mix(core) ^ arrays.mix(j.astype(np.uint64), 0xB10C))
    return (new_lo, new_hi, a - new_lo, named,
            _whole(h, new_lo - base, new_hi - base, a - new_lo, size), settled[of])


def _packed(lo: np.ndarray, hi: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Position 32 bits, width and distance 16 each: a window is at most a few hundred positions."""
    return (lo.astype(np.int64) << 32) | ((hi - lo).astype(np.int64) << 16) | ahead.astype(np.int64)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = place >> 32
    return lo, lo + ((place >> 16) & 0xFFFF), place & 0xFFFF


def _record(keys, lo, hi, ahead, name, stretch, settled) -> pa.RecordBatch:
    return pa.record_batch([
        pa.array(keys, pa.int64()), pa.array(_packed(lo, hi, ahead)), pa.array(name.view(np.int64)),
        pa.array(stretch.view(np.int64)), pa.array(settled)],
        names=["key", "place", "name", "stretch", "settled"])


def _lots(rows, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(key, arrays...) of single texts gathered into batches of some ten thousand ranges."""
    held, n = [], 0
    for key, got in rows:
        held.append((np.full(len(got[0]), key, dtype=np.int64), *got))
        n += len(got[0])
        if n >= most:
            yield _record(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield _record(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _anchors(size: int):
    def rows(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for key, data in zip(keys, arrays.texts(batch.column("text")), strict=True):
                for got in anchored(data, size):
                    yield key, (*got, np.zeros(len(got[0]), dtype=bool))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            yield from _lots(rows(batches))

    return work


def _shorter(size: int, width: int, together: int = 1 << 20):
    """Cut the ranges asked for of each text: columns key, text, ranges."""

    def rows(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            ranges = batch.column("ranges")
            cuts = ranges.offsets.to_numpy()
            place, name, settled = (pa.compute.struct_field(ranges.values, f).to_numpy(zero_copy_only=False)
                                    for f in ("place", "name", "settled"))
            for i, (key, data) in enumerate(zip(keys, arrays.texts(batch.column("text")), strict=True)):
                mine = np.arange(cuts[i], cuts[i + 1])
                mine = mine[np.argsort(place[mine], kind="stable")]
                lo, hi, ahead = _unpacked(place[mine])
                at = 0
                while at < len(mine):       # neighbours within a megabyte are hashed in one go
                    end = at + max(1, int(np.searchsorted(lo[at:], lo[at] + together)))
                    part = slice(at, end)
                    yield key, cut_ranges(data, lo[part], hi[part], ahead[part], name[mine[part]].view(np.uint64),
                                          settled[mine[part]], size, width)
                    at = end

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            yield from _lots(rows(batches))

    return work


def _whole_rows(rows: DataFrame) -> DataFrame:
    return rows.where("key IS NOT NULL AND place IS NOT NULL AND name IS NOT NULL AND stretch IS NOT NULL")


def _past(live: DataFrame, one: bool = True) -> tuple[DataFrame, DataFrame]:
    """(how often each stretch is held, spans of those past the threshold).

    Where ranges go on (``one``), all uses of ``live`` and of what is held ask for
    the same columns and rows, so that one shuffle of each serves them.
    """
    first = [F.min(F.struct("key", "place")).alias("one")] if one else []
    held = live.groupBy("name", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("settled").alias("done"), *first)
    held = held.where("one IS NOT NULL") if one else held
    past = held.where("n > 1 OR done").select("name", "stretch", "n")
    if not one:
        return held, live.where("NOT settled").join(past, ["name", "stretch"], "left_semi").select("key", "place")
    fresh = F.when(F.col("n") > 0, ~F.col("settled"))       # asked after the join, as n is part of it
    return held, live.join(past, ["name", "stretch"]).where(fresh).select("key", "place")


def _round(rows: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """One round of ranking -> (spans past the threshold, ranges to cut and rank again).

    Only counts per rank are grouped, combined before they are shuffled; rows
    meet them in equi-joins, which can be split where one rank is very common.
    """
    rows = _whole_rows(rows)
    shared = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.bool_and("settled").alias("done")) \
        .where("n > 1 AND NOT done").select("name")
    live = rows.join(shared, "name", "left_semi")
    held, spans = _past(_whole_rows(stored(live, "ranges")) if keep else live)
    alone = held.where("n = 1 AND NOT done").select("name").distinct()
    again = held.join(alone, "name", "left_semi").select(
        "one.*", "name", (F.col("done") | (F.col("n") > 1)).alias("settled"))
    return spans, again


def _texts(docs: DataFrame) -> DataFrame:
    text = whole("text")
    # 64 bits of the text and its length name it: equal texts share their spans.
    # The document's id deals out copies of a text over tasks.
    return docs.select(
        "doc_id", F.xxhash64(text).bitwiseXOR(F.octet_length(text).cast("bigint")).alias("key"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-2**63)).alias("copy"), text.cast("binary").alias("text"))


def repeated(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """Positions at which a repeated string of ``size`` bytes starts: key, place.

    ``texts`` is that of ``_texts``; rows with equal keys have equal texts, and
    one of them answers for all where ranges are cut.  Every round joins all of
    its columns, so Spark shuffles the texts once for all rounds.
    """
    if size < 2 * GRAM:
        raise ValueError(f"size must be at least {2 * GRAM}")
    first = texts.select("key", "text").where(F.octet_length("text") >= size).mapInArrow(_anchors(size), _RANGES)
    spans, again = _round(first, keep=True)
    speaker = texts.groupBy("key").agg(F.min("copy").alias("copy"))
    for width in WIDTHS:
        ranges = again.groupBy("key").agg(F.collect_list(F.struct("place", "name", "settled")).alias("ranges"))
        rows = texts.join(ranges.join(speaker, "key"), ["key", "copy"]).mapInArrow(_shorter(size, width), _RANGES)
        if width == 1:                      # what all strings of a range share is the string
            more = _past(_whole_rows(rows), one=False)[1]
        else:
            more, again = _round(rows)
        spans = spans.unionByName(more)
    return spans


def _merged(size: int):
    """Bytes covered by each text's spans, as starts and ends of maximal runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            spans = batch.column("spans")
            cuts, place = spans.offsets.to_numpy(), spans.values.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                lo, hi, _ = _unpacked(np.sort(place[cuts[i]:cuts[i + 1]]))
                hi = np.maximum.accumulate(hi) + size
                fresh = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                starts.append(lo[fresh])
                ends.append(hi[np.concatenate((fresh[1:] - 1, [len(hi) - 1]))])
            yield pa.record_batch([batch.column("key"), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                                  names=["key", "starts", "ends"])

    return work


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, runs, kept = [], [], [], []
        for data, start, end in zip(arrays.texts(batch.column("text")), batch.column("starts").to_pylist(),
                                    batch.column("ends").to_pylist(), strict=True):
            start, end = start or [], end or []
            total.append(len(data))
            gone.append(sum(end) - sum(start))
            runs.append(len(start))
            kept.append(b"".join(data[a:b].tobytes() for a, b in zip([0, *end], [*start, len(data)], strict=True)))
        yield pa.record_batch([
            batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
            pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    ``docs`` has doc_id and text (UTF-8; null: empty).  A byte goes if a string of
    ``size`` bytes that covers it also starts anywhere else, in this document or
    another; strings are those of the input.  Copies of a text, rows with an equal
    doc_id among them, are each other's repeats, so all of them go.  Texts shorter
    than ``size`` bytes stay whole.  ``kept`` may end inside a character.  ``size``
    is 60,000 at most: places within a range are packed.
    """
    if not 0 < size <= 60_000:
        raise ValueError("size must be between 1 and 60,000")
    texts = _texts(docs)
    # Each copy of a text gives the same spans; one of each is gathered.
    spans = repeated(texts, size).distinct().groupBy("key").agg(F.collect_list("place").alias("spans")) \
        .mapInArrow(_merged(size), "key long, starts array<int>, ends array<int>")
    each = texts.select("key", "copy").distinct().join(spans, "key")
    kind = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long") \
        .add("n_spans", "long").add("kept", "binary")
    return texts.join(each, ["key", "copy"], "left").mapInArrow(_removed, kind)


@query("op10_repeated_substrings")
def op10_repeated_substrings(spark, sf_dir):
    """Contract: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
