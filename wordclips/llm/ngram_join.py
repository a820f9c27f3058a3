"""N-gram Jaccard self-join of documents by chosen paths.

A document is its set of five-word shingles, held as 64 MinHash values: two sets
agree in a value with their Jaccard similarity as probability.  A run starts a
path per set from one sampled value; sets on the same path share a bucket.  A
bucket that is too large is split by the value at a further place of the run,
down to a largest depth; small buckets are compared whole.  No two runs read one
place, so they miss a pair independently, and they are repeated until a pair at
the threshold that shares every bucket on the way down is missed with less than
one chance in ten thousand.  What is found only says which sets may be connected:
inside each such component all sets are then compared exactly, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.llm import arrays
from wordclips.llm.catalog import query, table
from wordclips.llm.components import components
from wordclips.llm.text import words
from wordclips.session import stored

SHINGLE, ALIKE = 5, 0.8
SLOTS = 64
#: A bucket of up to LIMIT sets is compared whole; larger ones are split, DEPTH times at most.
LIMIT, DEPTH = 256, 3
#: Sets of a component compared in one task, pairs of such blocks in others.
BLOCK = 512


def runs_for(alike: float, recall: float = 0.9999, depth: int = DEPTH) -> int:
    """Runs after which a pair at ``alike`` that must share ``depth`` values in a run is met.

    This counts on runs without a place in common: runs * depth <= SLOTS (see ``place_of``).
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - alike ** depth))


def place_of(run, level: int, runs: int):
    """The place whose value run ``run`` reads at ``level`` (0: its first step)."""
    return (level * runs + run) % SLOTS


def floor_of(alike: float) -> int:
    """Equal MinHash values below which a pair at ``alike`` lies less than once in 300,000 (4.5 sigma)."""
    return max(1, math.floor(SLOTS * alike - 4.5 * math.sqrt(SLOTS * alike * (1 - alike))))


def sets_of(data: np.ndarray, k: int) -> np.ndarray:
    """Shingles of a text in words; fewer than ``k`` words are one shingle."""
    own = arrays.word_hashes(data)
    return arrays.shingles(own, k if len(own) >= k else max(1, len(own)))


def _sketches(k: int):
    seeds = [(0xD1B54A32D192ED03 * (i + 1)) & ((1 << 64) - 1) for i in range(SLOTS)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out = []
                for data in arrays.texts(batch.column("words")):
                    own = sets_of(data, k)
                    out.append(_sketch(own, seeds) if len(own) else None)
                yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(out, pa.binary())],
                                      names=["doc_id", "key", "sketch"])

    return work


def _sketch(own: np.ndarray, seeds: list[int], piece: int = 4096) -> bytes:
    low = np.full(SLOTS, np.uint64(2**64 - 1))
    for at in range(0, len(own), piece):
        part = own[at:at + piece]
        for i, seed in enumerate(seeds):
            # An odd multiplier per place orders the (already mixed) hashes anew.
            low[i] = min(low[i], ((part ^ np.uint64(seed)) * np.uint64(seed | 1)).min())
    return (arrays.mix(low) >> np.uint64(32)).astype("<u4").tobytes()


def _matrix(column) -> np.ndarray:
    """Sketches as rows of 32-bit values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, SLOTS)


def _paths(runs: int):
    """First steps: one row per set and run. A path's last byte is its run."""
    if runs > 256:
        raise ValueError("at most 256 runs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = _matrix(batch.column("sketch")).astype(np.uint64)
                for run in range(runs):
                    path = arrays.mix(m[:, place_of(run, 0, runs)] ^ np.uint64((run + 1) << 40), 77)
                    path = path >> np.uint64(8) << np.uint64(8) | np.uint64(run)
                    yield pa.record_batch([batch.column("key"), pa.array(path.view(np.int64))], names=["key", "path"])

    return work


def _deeper(runs: int, level: int):
    """Paths one step longer, by the value at their run's place at ``level``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = _matrix(batch.column("sketch")).astype(np.uint64)
                path = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
                run = path & np.uint64(255)
                place = place_of(run.astype(np.int64), level, runs)
                path = arrays.mix(path ^ arrays.mix(m[np.arange(len(m)), place]), 78)
                path = path >> np.uint64(8) << np.uint64(8) | run
                yield pa.record_batch([batch.column("key"), pa.array(path.view(np.int64))], names=["key", "path"])

    return work


def _edges(pairs: list, keys: np.ndarray) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    return pa.record_batch([pa.array(list(keys[a]), pa.binary()), pa.array(list(keys[b]), pa.binary())], names=["a", "b"])


def _alike(m: np.ndarray, least: int) -> np.ndarray:
    """Which rows of sketches have ``least`` equal values, compared a stretch of rows at a time."""
    out = np.zeros((len(m), len(m)), dtype=bool)
    for at in range(0, len(m), 64):
        out[at:at + 64] = (m[at:at + 64, None, :] == m[None, :, :]).sum(axis=2) >= least
    return out


def _small_buckets(least: int):
    """Edges that connect what is alike in each bucket: a spanning forest, not all pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in arrays.whole_groups(batches, "path"):
            keys = np.array(t.column("key").to_pylist(), dtype=object)
            m = _matrix(t.column("sketch"))
            cut = arrays.starts_of(t.column("path").to_numpy())
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            met = two[(m[two] == m[two + 1]).sum(axis=1) >= least]
            pairs = [(met, met + 1)]
            for lo, n in zip(cut[:-1][size > 2], size[size > 2], strict=True):
                label = arrays.roots(_alike(m[lo:lo + n], least))
                own = np.flatnonzero(label != np.arange(n))
                pairs.append((lo + label[own], lo + own))
            yield _edges(pairs, keys)

    return work


def _rest_against_block(least: int):
    """In a block of a large bucket: edges from sets without a pivot to any set alike."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in arrays.whole_groups(batches, "cell"):
            keys = np.array(t.column("key").to_pylist(), dtype=object)
            under = np.array(t.column("under").to_pylist(), dtype=object)
            m, rest = _matrix(t.column("sketch")), t.column("rest").to_numpy()
            cut, pairs = arrays.starts_of(t.column("cell").to_numpy()), []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                # Sets under one pivot are connected through it. Only edges that connect what is not yet are kept.
                _, first, label = np.unique(under[lo:hi].astype(bytes), return_index=True, return_inverse=True)
                label = first[label]
                for i in np.flatnonzero(rest[lo:hi]):
                    met = np.unique(label[(m[lo:hi] == m[lo + i]).sum(axis=1) >= least])
                    new = met[met != label[i]]
                    pairs.append((np.full(len(new), lo + i), lo + new))
                    label[np.isin(label, new)] = label[i]
            yield _edges(pairs, keys)

    return work


def _under_pivots(least: int, core: int):
    """Adds to each set of a large bucket: its best pivot, whether none is near (rest), pivots tied to a pivot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, m = b.column("key").to_pylist(), _matrix(b.column("sketch"))
            lists = b.column("pivots")
            cut = lists.offsets.to_numpy()
            names = lists.values.field("pivot").to_pylist()
            row = np.repeat(np.arange(len(m)), np.diff(cut))
            same = np.zeros(len(names), dtype=np.int64)
            if len(row):
                own = slice(cut[0], cut[-1])
                same[own] = (m[row] == _matrix(lists.values.field("sketch"))[own]).sum(axis=1)
            under, rest, ties = [], [], []
            for i, key in enumerate(keys):
                mine, part = names[cut[i]:cut[i + 1]], same[cut[i]:cut[i + 1]]
                near = len(mine) > 0 and part.max() >= core
                under.append(mine[int(part.argmax())] if near else key)
                rest.append(not near)
                ties.append([p for p, n in zip(mine, part, strict=True) if n >= least and p != key] if key in mine else [])
            yield pa.record_batch([b.column("path"), b.column("key"), b.column("sketch"), b.column("count"),
                                   pa.array(under, pa.binary()), pa.array(rest), pa.array(ties, pa.list_(pa.binary()))],
                                  names=["path", "key", "sketch", "count", "under", "rest", "ties"])

    return work


def _large_buckets(rows: DataFrame, counts: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Edges of buckets that no split makes small, such as thousands of near copies.

    About four members chosen by hash are pivots (so their list stays short,
    however large the bucket).  A set with 0.9 of its values equal to a pivot's
    hangs under it; only the others are compared with the whole bucket, in blocks
    of about ``4 * BLOCK`` sets.
    """
    known = rows.join(counts, "path").join(sketches, "key")
    mark = F.pmod(F.xxhash64("key", "path"), F.lit(1 << 40))
    pivots = known.where(mark < (F.lit(4.0) / F.col("count")) * (1 << 40)).groupBy("path").agg(
        F.collect_list(F.struct(F.col("key").alias("pivot"), "sketch")).alias("pivots"))
    listed = known.join(pivots, "path", "left").withColumn("pivots", F.coalesce("pivots", F.array()))
    told = stored(listed.select("path", "key", "sketch", "count", "pivots").mapInArrow(
        _under_pivots(least, math.ceil(0.9 * SLOTS)), "path long, key binary, sketch binary, count long, "
        "under binary, rest boolean, ties array<binary>"), "told")
    hung = told.where("not rest").select(F.col("under").alias("a"), F.col("key").alias("b"))
    tied = told.select(F.explode("ties").alias("a"), F.col("key").alias("b"))
    blocks = F.ceil(F.col("count") / (4 * BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("key"), blocks).cast("int")
    where_to = F.when(F.col("rest"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(mine))
    busy = told.where("rest").select("path").distinct()
    cells = told.join(busy, "path", "left_semi").select("path", "key", "sketch", "under", "rest", F.explode(where_to).alias("block"))
    compared = cells.select(F.xxhash64("path", "block").alias("cell"), "key", "sketch", "under", "rest") \
        .repartition("cell").sortWithinPartitions("cell").mapInArrow(_rest_against_block(least), "a binary, b binary")
    return hung.unionByName(tied).unionByName(compared)


def candidates(sketches: DataFrame, alike: float = ALIKE, runs: int | None = None, limit: int = LIMIT,
               depth: int = DEPTH) -> DataFrame:
    """Edges (a, b) whose components hold every pair at ``alike``; ``sketches`` has key and sketch."""
    runs, least = runs or runs_for(alike, depth=depth), floor_of(alike)
    rows = stored(sketches.mapInArrow(_paths(runs), "key binary, path long"), "paths")
    found = None
    for level in range(1, depth + 1):
        counts = rows.groupBy("path").count().where("count > 1")
        sized = stored(rows.join(counts, "path"), "paths")
        here = sized.where(F.col("count") <= limit).select("path", "key").join(sketches, "key") \
            .repartition("path").sortWithinPartitions("path").mapInArrow(_small_buckets(least), "a binary, b binary")
        found = here if found is None else found.unionByName(here)
        large = sized.where(F.col("count") > limit)
        if large.isEmpty():
            return found
        if level < depth:
            rows = large.select("key", "path").join(sketches, "key").mapInArrow(
                _deeper(runs, level), "key binary, path long")
    counts = large.select("path", "count").distinct()
    return found.unionByName(_large_buckets(large.select("path", "key"), counts, sketches, least))


def _sets(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                made = [np.unique(sets_of(d, k)).tobytes() for d in arrays.texts(batch.column("words"))]
                yield pa.record_batch([batch.column("key"), batch.column("root"), batch.column("copies"),
                                       pa.array(made, pa.binary())], names=["key", "root", "copies", "shingles"])

    return work


def shared_counts(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many values each two sets share."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], dtype=np.float64)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(often > 1) - 1          # values of one set only are shared by none
    keep = often[at] > 1
    row, at = row[keep], new[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((n, n), dtype=np.float64)
    total = int(at[-1]) + 1 if len(at) else 0
    for lo in range(0, total, columns):
        a, b = np.searchsorted(at, [lo, lo + columns])
        held = np.zeros((n, min(columns, total - lo)), dtype=np.float32)
        held[row[a:b], at[a:b] - lo] = 1
        out += held @ held.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _exact(alike: float):
    """Per cell: links of each set to the others, and edges that connect what is linked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in arrays.whole_groups(batches, "cell"):
            keys = t.column("key").to_pylist()
            shingles = [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").to_pylist()]
            copies, side = t.column("copies").to_numpy(), t.column("side").to_numpy()
            cut = arrays.starts_of(t.column("cell").to_numpy())
            key, texts, others, root = [], [], [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi - lo < 2:
                    continue
                shared = shared_counts(shingles[lo:hi])
                size = np.diag(shared)
                linked = shared / (size[:, None] + size[None, :] - shared) >= alike
                np.fill_diagonal(linked, False)
                part = side[lo:hi]          # 0: a block against itself; 1 and 2: two blocks
                linked &= (part[:, None] != part[None, :]) | (part[:, None] == 0)
                label = arrays.roots(linked)
                own = np.flatnonzero(linked.any(axis=1))
                key += [keys[lo + i] for i in own]
                texts += list(linked[own].sum(axis=1))
                others += list(linked[own] @ copies[lo:hi])
                root += [keys[lo + i] for i in label[own]]
            yield pa.record_batch([pa.array(key, pa.binary()), pa.array(texts, pa.int64()),
                                   pa.array(others, pa.int64()), pa.array(root, pa.binary())],
                                  names=["key", "texts", "others", "root"])

    return work


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def joined(docs: DataFrame, alike: float = ALIKE, k: int = SHINGLE, runs: int | None = None,
           limit: int = LIMIT, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, key, root, class_id, n_links, n_texts, n_copies.

    Documents are compared as sets of ``k``-word shingles of their lower-case
    words (fewer than ``k`` words: one shingle).  n_texts counts the different
    texts at a Jaccard similarity of ``alike`` or more, n_links the other
    documents (copies too), n_copies the documents with the same words, itself
    included.  A class is a connected component of links, class_id its smallest
    doc_id (null where all are null).  Texts without words (null too) are copies
    of one another and linked to nothing else.  Rows with equal doc_id are
    documents of their own.  ``key`` names the words, ``root`` the class.
    """
    rows = stored(docs.select("doc_id", words("text").alias("words"))
                  .withColumn("key", _key(F.col("words")))
                  .mapInArrow(_sketches(k), docs.select("doc_id").schema.add("key", "binary").add("sketch", "binary")), "sketches")
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_copies"))
    sketches = stored(rows.where("sketch is not null").groupBy("key").agg(F.first("sketch").alias("sketch")), "sets")
    reach = components(candidates(sketches, alike, runs, limit, depth))

    spread = reach.join(copies, reach["node"] == copies["key"]).select("key", "root", F.col("n_copies").alias("copies"))
    texts = docs.select(words("text").alias("words")).withColumn("key", _key(F.col("words")))
    sets = texts.join(spread, "key").groupBy("key").agg(
        F.first("words").alias("words"), F.first("root").alias("root"), F.first("copies").alias("copies")) \
        .mapInArrow(_sets(k), "key binary, root binary, copies long, shingles binary")
    sizes = reach.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    cells = sets.join(sizes, "root").withColumn("mine", mine) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    exact = cells.select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
                         "key", "copies", "shingles", side.alias("side")) \
        .repartition("cell").sortWithinPartitions("cell") \
        .mapInArrow(_exact(alike), "key binary, texts long, others long, root binary")
    exact = stored(exact, "links")
    classes = components(exact.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = exact.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("others").alias("others"))
    full = rows.select("doc_id", "key").join(copies, "key").join(links, "key", "left") \
        .join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = full.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    zero = F.lit(0).cast("bigint")
    return full.join(named, "root").select(
        "doc_id", "key", "root", "class_id",
        (F.coalesce("others", zero) + F.col("n_copies") - 1).alias("n_links"),
        F.coalesce("texts", zero).alias("n_texts"), "n_copies")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest doc_id, a null one last.

    Of equal rows one stays; every column does.
    """
    found = joined(docs, **how)
    first = found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("f")).select(
        F.col("f.doc_id").alias("__d"), F.col("f.key").alias("__k"))
    keyed = docs.withColumn("__key", _key(words("text")))
    same = keyed["doc_id"].eqNullSafe(first["__d"]) & (keyed["__key"] == first["__k"])
    kept = keyed.join(first, same).withColumn("__n", F.row_number().over(
        Window.partitionBy("doc_id", "__key").orderBy("text")))
    return kept.where("__n = 1").select(*[keyed[c] for c in docs.columns])


@query("op1_ngram_join")
def op1_ngram_join(spark, sf_dir):
    """Every document: its class, its links to other documents and texts, its copies."""
    return joined(table(spark, sf_dir, "documents")).drop("key", "root")
