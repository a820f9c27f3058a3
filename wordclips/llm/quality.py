"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are hashed runs of three bytes, hashed runs of five byte classes
(upper case, lower case, digit, blank, each mark) and words that come again
soon; their weighted counts are projected on the strongest directions of a
labelled sample.  That sample is bounded, so its vectors can be broadcast; every
document is compared with all of them in blocks of exact cosine products, and
the nearest vote for their labels with a power of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordclips.llm import arrays
from wordclips.llm.catalog import query, table
from wordclips.llm.sampling import per_label
from wordclips.llm.text import whole

#: Bound of the labelled sample: documents per label.
PER_LABEL = 1500
RANK, NEIGHBOURS, POWER = 48, 25, 8
CUT = 0.3

RUNS, CLASSES, AGAIN = 4096, 1024, 16
TERMS = RUNS + CLASSES + AGAIN


def _classes() -> np.ndarray:
    kind = np.arange(256)
    kind[ord("a"):ord("z") + 1] = 1
    kind[ord("A"):ord("Z") + 1] = 2
    kind[ord("0"):ord("9") + 1] = 3
    kind[128:] = 1                          # letters of other scripts, mostly lower case
    return kind.astype(np.uint32)


_KIND = _classes()
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def term_counts(data: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Counts of a whole text's terms, runs gathered a piece at a time; they don't depend on the pieces."""
    out = np.zeros(TERMS, dtype=np.float64)
    for lo in range(0, len(data), piece):
        part = data[lo:lo + piece + 4]      # runs across the cut are counted once, with the former piece
        b = part.astype(np.uint32)
        n = min(piece, len(part) - 2)
        if n > 0:
            run = (b[:n] * np.uint32(0x9E3779B1)) ^ (b[1:n + 1] * np.uint32(0x85EBCA6B)) ^ (b[2:n + 2] * np.uint32(0xC2B2AE35))
            out[:RUNS] += np.bincount(run >> np.uint32(20), minlength=RUNS)
        c = _KIND[part]
        n = min(piece, len(part) - 4)
        if n > 0:
            run = c[:n]
            for j in range(1, 5):
                run = run * np.uint32(0x01000193) ^ c[j:n + j]
            out[RUNS:RUNS + CLASSES] += np.bincount((run * np.uint32(0x9E3779B1)) >> np.uint32(22), minlength=CLASSES)
    words = arrays.word_hashes(np.where(_BLANK[data], np.uint8(32), data))     # cuts between words by itself
    for d in range(1, AGAIN):               # a word that was said d words ago
        out[RUNS + CLASSES + d] = (words[d:] == words[:-d]).sum()
    out[RUNS + CLASSES] = len(words)
    return out


def weighted(counts: np.ndarray) -> np.ndarray:
    """Each kind of term by itself: logarithms of its counts, scaled to length one; repeats by their share."""
    out = np.log1p(counts)
    runs, classes, again = out[:, :RUNS], out[:, RUNS:RUNS + CLASSES], counts[:, RUNS + CLASSES:]
    for block in (runs, classes):
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12)
    share = np.sqrt(again / np.maximum(again[:, :1], 1))
    share[:, 0] = 0
    out[:, RUNS + CLASSES:] = share
    return out


@dataclass(frozen=True)
class Voters:
    scale: np.ndarray       # inverse document frequency of each term in the sample
    axes: np.ndarray        # TERMS x RANK
    vectors: np.ndarray     # one row of length one per labelled document
    labels: np.ndarray
    prior: float            # what a text without terms is given


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train(counts: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 3) -> Voters:
    """Latent directions by a randomised singular value decomposition of the sample."""
    df = (counts > 0).sum(axis=0)
    scale = np.log((1 + len(counts)) / (1 + df)) + 0.25
    x = weighted(counts) * scale
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(x @ rng.normal(size=(x.shape[1], min(rank + 16, *x.shape))))
    for _ in range(3):
        q, _ = np.linalg.qr(x @ (x.T @ q))
    _, _, axes = np.linalg.svd(q.T @ x, full_matrices=False)
    axes = axes[:rank].T
    return Voters(scale.astype(np.float32), axes.astype(np.float32), _unit(x @ axes).astype(np.float32),
                  labels.astype(np.float64), float(labels.mean()))


def vote(counts: np.ndarray, voters: Voters, nearest: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
    """Share of the nearest labelled vectors' weight that has label 1."""
    out = np.full(len(counts), voters.prior)
    k = min(nearest, len(voters.labels))
    for lo in range(0, len(counts), block):
        part = counts[lo:lo + block]
        cos = _unit((weighted(part) * voters.scale) @ voters.axes) @ voters.vectors.T
        top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cos, top, 1), 0, None) ** POWER
        total = weight.sum(axis=1)
        said = (weight * voters.labels[top]).sum(axis=1)
        some = total > 0
        out[lo:lo + block][some] = said[some] / total[some]
    return np.clip(out, 0.0, 1.0)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            made = [term_counts(d).astype("<f4").tobytes() for d in arrays.texts(batch.column("text"))]
            yield pa.record_batch([batch.column("quality"), pa.array(made, pa.binary())], names=["quality", "counts"])


def fit(docs: DataFrame, labels: DataFrame, most: int = PER_LABEL, rank: int = RANK) -> Voters | None:
    """Vectors of at most ``most`` documents of each label, chosen by hash of their id.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality (0 or 1; null
    teaches nothing).  The labels are sampled before they meet the texts: no more
    than ``2 * most`` rows are broadcast.  Of rows with one doc_id the first text
    counts.  Only term counts come to the driver, 20 kB a document.  None where
    nothing is labelled.
    """
    able = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    few = per_label(able, "quality", most, ["doc_id"])
    chosen = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(few), "doc_id") \
        .groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = chosen.select("quality", "text").mapInArrow(_count_rows, "quality int, counts binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["quality"], bytes(r["counts"])))
    counts = np.frombuffer(b"".join(r["counts"] for r in got), dtype="<f4").reshape(len(got), TERMS)
    return train(counts.astype(np.float32), np.array([r["quality"] for r in got]), rank)


def score(text: Column, voters: Voters | None) -> Column:
    """Vote for label 1 on a whole text, 0 to 1; the sample's share of label 1 for an empty or null text."""
    if voters is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with np.errstate(over="ignore"):
            for column in batches:
                made, held = [], []
                for data in arrays.texts(column):
                    held.append(term_counts(data).astype(np.float32))
                    if len(held) == 512:
                        made.append(vote(np.stack(held), voters))
                        held = []
                if held:
                    made.append(vote(np.stack(held), voters))
                yield pa.array(np.concatenate(made) if made else [], pa.float64())

    return judge(whole(text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@query("op5_quality_votes")
def op5_quality_votes(spark, sf_dir):
    """Contract: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    voters = fit(docs, labels.where(~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text"), voters).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
