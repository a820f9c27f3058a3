"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size (number of distinct shingles, classes of powers
of two).  Of a document only the shingles that items may have count: its hits,
in order, told by a fixed-size Bloom filter of the items' shingles (it is only a
filter: with more items than it suits more is looked at and the answer is the
same).  For a class of size s the hits are cut into blocks of s / 4, and five
blocks in a row are a window: an item of the class that no other item's
shingles interrupt lies whole in one, however much else stands between, and is
then at least 0.3 of it.  Windows and items meet where one of their MinHash
values is equal, and every meeting is verified by exact containment of the
item's shingles in the document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordclips.llm import arrays
from wordclips.llm.catalog import query, table
from wordclips.llm.text import text_key, words
from wordclips.session import stored

SHINGLE, SHARE = 5, 0.8
#: MinHash values per window. An item with 0.8 of its shingles in a window of its
#: class has a Jaccard similarity of 0.29 to it at least: missed once in a million.
PERMUTATIONS = 40
BLOOM_BITS = 22

_ROWS = "key string, size int, slot int, value bigint"


def _seed(slot: int) -> int:
    return (0x9E3779B97F4A7C15 * (slot + 1)) & ((1 << 64) - 1)


def _class(n: int) -> int:
    """The power of two at or above ``n``, 4 at least."""
    return max(4, 1 << (int(n) - 1).bit_length())


def _tag(values: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """What stands for a MinHash value in the Bloom filter; shingles stand for themselves."""
    code = size.astype(np.uint64) * np.uint64(1000) + slot.astype(np.uint64) + np.uint64(2)
    return arrays.mix(values ^ (code * np.uint64(_seed(0))), 0)


def _batch(key: list, size: list, slot: list, value: list) -> pa.RecordBatch:
    return pa.record_batch([
        pa.array(key, pa.string()), pa.array(size, pa.int32()), pa.array(slot, pa.int32()),
        pa.array(np.concatenate(value).view(np.int64) if value else [], pa.int64())],
        names=["key", "size", "slot", "value"])


def _item_rows(k: int, slots: int):
    """Per item: its distinct shingles (size 0, slot: how many) and its MinHash values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                key, size, slot, value = [], [], [], []
                for name, data in zip(batch.column(0).to_pylist(), arrays.texts(batch.column(1)), strict=True):
                    own = np.unique(arrays.shingles(arrays.word_hashes(data), k))
                    if not len(own):
                        continue
                    s = _class(len(own))
                    key += [name] * (len(own) + slots)
                    size += [0] * len(own) + [s] * slots
                    slot += [len(own)] * len(own) + list(range(slots))
                    value += [own, *[arrays.mix(own, _seed(j)).min(keepdims=True) for j in range(slots)]]
                yield _batch(key, size, slot, value)

    return work


def least_hits(size: int, share: float) -> int:
    """Distinct hits without which a document can't hold an item of a class: the smallest has half of ``size`` and one."""
    return max(1, math.ceil(share * (size // 2 + 1) - 1e-9)) if size > 4 else 1


def window_minima(values: np.ndarray, block: int) -> np.ndarray:
    """Along the last axis, the least of every five blocks in a row (of all, where there are fewer)."""
    least = np.minimum.reduceat(values, np.arange(0, values.shape[-1], block), axis=-1)
    n = max(1, least.shape[-1] - 4)
    out = least[..., :n].copy()
    for d in range(1, min(5, least.shape[-1])):
        np.minimum(out, least[..., d:d + n], out=out)
    return out


def _window_rows(hits: np.ndarray, classes: list[int], slots: int, bloom: arrays.Bloom):
    """(size, slots, values) of the windows of a document's hits that items may have, each once."""
    together = max(1, (1 << 18) // len(hits))
    seeds = np.array([_seed(j) for j in range(slots)], dtype=np.uint64)
    for lo in range(0, slots, together):
        mixed = arrays.mix(hits[None, :], seeds[lo:lo + together, None])
        for s in classes:
            window = window_minima(mixed, s // 4)
            slot = np.repeat(np.arange(lo, lo + len(window)), window.shape[1])
            flat = window.ravel()
            able = bloom.holds(_tag(flat, np.uint64(s), slot))
            if able.any():
                both = np.unique(np.rec.fromarrays((slot[able], flat[able])))
                yield s, both.f0, both.f1


def _document_rows(k: int, slots: int, classes: list[int], bloom: arrays.Bloom, share: float):
    """Per document: shingles that items may have (size 0), and window values that items may have."""
    least = [(s, least_hits(s, share)) for s in classes]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                key, size, slot, value = [], [], [], []
                for name, data in zip(batch.column(0).to_pylist(), arrays.texts(batch.column(1)), strict=True):
                    own = arrays.shingles(arrays.word_hashes(data), k)
                    hits = own[bloom.holds(own)]
                    met = np.unique(hits)
                    able = [s for s, n in least if len(met) >= n]
                    if not able:
                        continue
                    key += [name] * len(met)
                    size += [0] * len(met)
                    slot += [0] * len(met)
                    value.append(met)
                    for s, places, found in _window_rows(hits, able, slots, bloom):
                        key += [name] * len(found)
                        size += [s] * len(found)
                        slot += places.tolist()
                        value.append(found)
                yield _batch(key, size, slot, value)

    return work


def _bloom(rows: DataFrame, bits: int) -> arrays.Bloom:
    """Filter over the items' rows: at most ``2 ** (bits - 6)`` words come to the driver."""
    tags = F.when(F.col("size") == 0, F.col("value")).otherwise(F.col("tag"))
    low = (1 << bits) - 1
    places = F.explode(F.array(tags.bitwiseAND(F.lit(low).cast("bigint")),
                               F.shiftrightunsigned(tags, 32).bitwiseAND(F.lit(low).cast("bigint"))))
    words_ = rows.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w"))
    return arrays.Bloom({r["i"]: r["w"] for r in words_.collect()}, bits)


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in batches:
            value, size, slot = (b.column(c).to_numpy(zero_copy_only=False) for c in ("value", "size", "slot"))
            tag = _tag(value.view(np.uint64), size, slot)
            yield pa.record_batch([*b.columns, pa.array(tag.view(np.int64))],
                                  names=[*b.schema.names, "tag"])


def contained(docs: DataFrame, items: DataFrame, share: float = SHARE, k: int = SHINGLE,
              slots: int = PERMUTATIONS, bits: int = BLOOM_BITS) -> DataFrame:
    """Pairs with at least ``share`` of an item's distinct shingles in a document.

    ``docs`` has doc_id and text, ``items`` item_id and text.  Returns doc_id,
    item_id, n_shared, n_item, share.  Texts are compared as lower-case words;
    items of fewer than ``k`` words (null and empty ones too) are too short to
    be evidence and match nothing, nor do such documents.  Rows with equal
    doc_id are documents of their own, each with its pairs; so are equal items.
    """
    named = items.select("item_id", text_key("text").alias("item"), "text")
    first = named.groupBy("item").agg(F.first("text").alias("text")).select(
        F.col("item").alias("key"), words("text").alias("words"))
    rows = stored(first.mapInArrow(_item_rows(k, slots), _ROWS).mapInArrow(_tagged, _ROWS + ", tag bigint"), "items")
    classes = sorted(r["size"] for r in rows.where("size > 0").select("size").distinct().collect())
    bloom = _bloom(rows, bits)
    found = stored(docs.select(text_key("text").alias("key"), words("text").alias("words"))
                   .mapInArrow(_document_rows(k, slots, classes, bloom, share), _ROWS).distinct(), "windows")
    sides = rows.where("size > 0").select(F.col("key").alias("item"), "size", "slot", "value")
    pairs = found.where("size > 0").join(sides, ["size", "slot", "value"]).select("key", "item").distinct()
    wanted = rows.where("size = 0").select(F.col("key").alias("item"), F.col("slot").cast("bigint").alias("n_item"), "value")
    shared = pairs.join(wanted, "item").join(found.where("size = 0").select("key", "value"), ["key", "value"]) \
        .groupBy("key", "item", "n_item").agg(F.count(F.lit(1)).alias("n_shared")) \
        .where(F.col("n_shared") >= F.lit(float(share)) * F.col("n_item"))
    return docs.select("doc_id", text_key("text").alias("key")).join(shared, "key") \
        .join(named.select("item_id", "item"), "item") \
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("share"))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without documents that hold an item; every other row and column stays."""
    keyed = docs.withColumn("__key", text_key("text"))
    dirty = contained(docs.select(text_key("text").alias("doc_id"), "text"), items, **how)
    return keyed.join(dirty.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").drop("__key")


_WORDS = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'))"

OP9_SQL = f"""
WITH item_words AS (SELECT item_id, string_split({_WORDS}, ' ') AS w FROM benchmark),
item_grams AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - {SHINGLE - 2}),
         lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS g
  FROM item_words WHERE len(w) >= {SHINGLE}),
doc_words AS (SELECT doc_id, string_split({_WORDS}, ' ') AS w FROM documents),
doc_grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {SHINGLE - 2}),
         lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS g
  FROM doc_words WHERE len(w) >= {SHINGLE}),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_grams GROUP BY 1)
SELECT doc_id, i.item_id, count(*) AS n_shared, n_item, count(*) / n_item AS share
FROM item_grams i JOIN doc_grams d USING (g) JOIN sizes s ON s.item_id = i.item_id
GROUP BY doc_id, i.item_id, n_item HAVING count(*) >= {SHARE} * n_item
"""


@query("op9_benchmark_leaks", OP9_SQL)
def op9_benchmark_leaks(spark, sf_dir):
    """Every document against every benchmark item."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
