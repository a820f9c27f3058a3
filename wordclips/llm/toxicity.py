"""Toxic spans and document scores by a linear-chain conditional random field.

Every word of a text is tagged toxic or not.  What speaks for a tag are the
word, its beginnings and ends, its letters' case and its neighbours; what speaks
for a pair of tags is learned too.  Forward-backward sums give each word the
probability that it is toxic.  The offending spans follow from these, and a
document's score from its likeliest word and from how many are expected.

The field is taught labelled words.  Where only documents are labelled,
``seeds`` finds the words and beginnings of words that set toxic documents
apart: those words of toxic documents are labelled toxic, all words of clean
documents and the other words of such documents are not, and documents that
nothing explains teach nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordclips.llm import arrays
from wordclips.llm.catalog import query, table
from wordclips.llm.sampling import per_label
from wordclips.llm.text import whole

#: Bound of the training sample: documents per label, and windows of WINDOW words of each.
PER_LABEL, WINDOWS, WINDOW = 800, 48, 64
BITS = 18
BEGINNINGS, ENDINGS = (3, 4, 5, 6, 7, 8), (3, 4)
#: Columns of the features: the word, its beginnings, its ends, its shape, the word before and after.
OWN = 1 + len(BEGINNINGS)
FEATURES = OWN + len(ENDINGS) + 3
CUT = 0.7
#: Least probability of a word that counts towards a document's expected number.
LIKELY = 0.1
_CAP = 8.0


# ---- words and features

_WORD = np.zeros(256, dtype=bool)
_WORD[ord("a"):ord("z") + 1] = _WORD[ord("A"):ord("Z") + 1] = _WORD[ord("0"):ord("9") + 1] = True
_WORD[128:] = True


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and À-Þ in lower case; other letters stay, lengths too."""
    out = data.copy()
    out[(data >= ord("A")) & (data <= ord("Z"))] += 32
    if len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        able = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        out[able] += 32
    return out


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: runs of ASCII letters, digits and other scripts' characters but their punctuation."""
    part = np.zeros(len(data) + 2, dtype=bool)
    inside = part[1:-1]
    inside[:] = _WORD[data]
    if len(data) > 1:
        sign = np.flatnonzero(data[:-1] == 0xC2)                    # C2 xx: signs of Latin-1
        inside[sign], inside[sign + 1] = False, False
        sign = np.flatnonzero(((data[:-1] == 0xE2) & (data[1:] < 0x82)) | ((data[:-1] == 0xE3) & (data[1:] == 0x80)))
        for d in range(3):                                          # E2 80 xx, E2 81 xx, E3 80 xx: dashes, quotes, stops
            inside[np.minimum(sign + d, len(data) - 1)] = False
    turn = np.flatnonzero(part[1:] != part[:-1])
    return turn[::2], turn[1::2]


def _named(values: np.ndarray, kind: int) -> np.ndarray:
    """32 bits of a feature, never 0 (which stands for none)."""
    return (arrays.mix(values, 0x51ED27 * (kind + 1)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1 << 31)


def _shape(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Upper-case letters (none, the first, more, all) and digits (none, some) of each word."""
    sums = [np.concatenate(([0], np.cumsum((data >= a) & (data <= b)))) for a, b in ((65, 90), (48, 57))]
    upper, digit = (s[hi] - s[lo] for s in sums)
    first = (data[lo] >= 65) & (data[lo] <= 90)
    kind = np.where(upper == 0, 0, np.where(upper == hi - lo, 3, np.where((upper == 1) & first, 1, 2)))
    return (kind * 2 + (digit > 0)).astype(np.uint64)


def features(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """FEATURES values for each word [lo, hi) of a text, 0 for those it lacks.

    ``first`` marks words without one before them.  Hashes are taken a piece at a
    time; pieces end between words, so the values don't depend on them.
    """
    out = np.zeros((len(lo), FEATURES), dtype=np.uint32)
    plain = lower(data)
    done = 0
    while done < len(lo):
        upto = max(done + 1, int(np.searchsorted(hi, lo[done] + piece, "right")))
        base = int(lo[done])
        part = slice(base, int(hi[upto - 1]))
        a, b = lo[done:upto] - base, hi[done:upto] - base
        sums = arrays.prefix(plain[part])
        out[done:upto, 0] = _named(arrays.stretch(sums, a, b), 0)
        for j, k in enumerate(BEGINNINGS):
            able = b - a > k
            out[done:upto, 1 + j][able] = _named(arrays.stretch(sums, a[able], a[able] + k), 1)
        for j, k in enumerate(ENDINGS):
            able = b - a > k
            out[done:upto, OWN + j][able] = _named(arrays.stretch(sums, b[able] - k, b[able]), 2)
        out[done:upto, OWN + len(ENDINGS)] = _named(_shape(data[part], a, b), 3)
        done = upto
    own, same = out[:, 0].astype(np.uint64), ~first[1:]
    out[1:, -2][same] = _named(own[:-1], 4)[same]
    out[:-1, -1][same] = _named(own[1:], 5)[same]
    return out


# ---- the field

@dataclass(frozen=True)
class Chain:
    """Of two tags (0 clean, 1 toxic): a weight per hashed feature for tag 1, of tags that begin, of pairs of tags."""

    weights: np.ndarray     # 2 ** BITS
    begin: np.ndarray       # 2
    pairs: np.ndarray       # 2 x 2, from and to


def emissions(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the features of each word say for tag 1; 0 for absent ones."""
    total = np.zeros(len(values))
    for j in range(values.shape[1]):
        v = values[:, j]
        total += np.where(v == 0, 0.0, weights[v & np.uint32(len(weights) - 1)])
    return total


def _after(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Row vectors ``start @ steps[0] @ ... @ steps[t]`` for each t, scaled to a sum of 1.

    ``steps`` is 2 x 2 x n.  Blocks of steps are multiplied side by side, the
    blocks' products are run through in the same way, and then the blocks'
    insides, so that few and wide numpy calls do the work at any length.
    """
    n = steps.shape[2]
    if n <= 32:
        out, now = np.zeros((2, n)), start
        for t in range(n):
            now = now @ steps[:, :, t]
            now = now / now.sum()
            out[:, t] = now
        return out
    size = math.isqrt(n - 1) + 1
    blocks = -(-n // size)
    whole_ = np.empty((2, 2, blocks * size))
    whole_[:, :, :n] = steps
    whole_[:, :, n:] = np.eye(2)[:, :, None]
    inner = np.ascontiguousarray(whole_.reshape(2, 2, blocks, size).transpose(3, 0, 1, 2))
    made = np.repeat(np.eye(2)[:, :, None], blocks, axis=2)
    for s in inner:
        made = made[:, 0, None] * s[None, 0] + made[:, 1, None] * s[None, 1]
        made /= made.sum(axis=(0, 1))
    ends = _after(made, start)
    now = np.concatenate((start[:, None], ends[:, :-1]), axis=1)
    out = np.empty((size, 2, blocks))
    for j, s in enumerate(inner):
        now = now[0] * s[0] + now[1] * s[1]
        now = now / now.sum(axis=0)
        out[j] = now
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


def marginals(said: np.ndarray, first: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Probability of tag 1 for each word, and of each pair of tags (2 x 2 x n) of it and the one before.

    Texts follow one another; ``first`` marks their first words, for which the
    pairs are 0.  A first word's step does not depend on what came before, so one
    pass forward and one backward serve all texts.
    """
    n = len(said)
    if not n:
        return np.zeros(0), np.zeros((2, 2, 0))
    said = np.clip(said, -30, 30)
    steps = np.exp(np.where(first, chain.begin[None, :, None], chain.pairs[:, :, None]))
    steps[:, 1] *= np.exp(said)
    steps /= steps.sum(axis=(0, 1))
    half = np.full(2, 0.5)
    ahead = _after(steps, half)
    back = np.full((2, n), 0.5)
    back[:, :-1] = _after(steps[:, :, :0:-1].transpose(1, 0, 2), half)[:, ::-1]
    both = ahead * back
    tag = both[1] / both.sum(axis=0)
    pair = np.zeros((2, 2, n))
    pair[:, :, 1:] = ahead[:, None, :-1] * steps[:, :, 1:] * back[None, :, 1:]
    pair /= np.maximum(pair.sum(axis=(0, 1)), 1e-300)
    pair[:, :, first] = 0
    return tag, pair


def train(values: np.ndarray, tags: np.ndarray, first: np.ndarray, bits: int = BITS, epochs: int = 8, batch: int = 12_288,
          rate: float = 0.15, decay: float = 2e-6, seed: int = 5) -> Chain:
    """Weights by Adam on the conditional log-likelihood of the tags, a batch of whole sequences at a time."""
    rng = np.random.default_rng(seed)
    low = np.uint32((1 << bits) - 1)
    weights, begin, pairs = np.zeros(1 << bits), np.zeros(2), np.zeros((2, 2))
    held = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, begin, pairs)]
    cuts = np.append(np.flatnonzero(first), len(tags))
    batch = min(batch, max(512, len(tags) // 24))           # few words are gone through in small steps
    turn, turns = 0, epochs * max(1, -(-len(tags) // batch)) + 1
    for _ in range(epochs):
        order = rng.permutation(len(cuts) - 1)
        size = np.cumsum(cuts[order + 1] - cuts[order])
        for part in np.split(order, np.flatnonzero(np.diff(size // batch)) + 1):
            at = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in part])
            f, y, v = first[at], tags[at], values[at]
            p, some = (v & low).astype(np.int64), v != 0
            said = np.where(some, weights[p], 0.0).sum(axis=1)
            tag, pair = marginals(said, f, Chain(weights, begin, pairs))
            miss = (y - tag) / len(at)
            step = np.bincount(p.ravel(), (miss[:, None] * some).ravel(), minlength=len(weights)) - decay * weights
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1][~f[1:]], y[1:][~f[1:]]), 1)
            starts = np.array([(1 - y[f]).sum() - (1 - tag[f]).sum(), y[f].sum() - tag[f].sum()])
            turn += 1
            pace = rate * max(0.02, 1 - turn / turns)           # ever smaller steps: the last batch is not the last word
            for x, (m, s), g in zip((weights, begin, pairs), held, (step, starts / len(at), (seen - pair.sum(axis=2)) / len(at)), strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.98
                s += 0.02 * g * g
                x += pace * (m / (1 - 0.9 ** turn)) / (np.sqrt(s / (1 - 0.98 ** turn)) + 1e-8)
    return Chain(weights.astype(np.float32), begin, pairs)


# ---- labelled words from labelled documents

def _gain(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, ratio: float) -> np.ndarray:
    """Log-likelihood gained by knowing that toxic and clean documents have a feature.

    0 where, of all documents that have it, fewer than half are toxic; a clean
    document of the sample stands for ``ratio`` times as many as a toxic one.
    """
    share = n_toxic / max(1, n_toxic + n_clean)
    rate = toxic / np.maximum(1, toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(toxic > 0, toxic * np.log(rate / share), 0) + np.where(clean > 0, clean * np.log((1 - rate) / (1 - share)), 0)
    return np.where((rate > share) & (toxic >= ratio * clean), gain, 0.0)


def seeds(doc: np.ndarray, own: np.ndarray, toxic: np.ndarray, ratio: float = 1.0, sure: float = 12.0, rest: float = 9.0) -> np.ndarray:
    """Features (words and beginnings of words) that set toxic documents apart.

    ``doc`` numbers each word's document, ``own`` holds its features, ``toxic``
    says which documents are.  A feature counts where it is met once, or twice,
    in a document.  Taken are all that gain ``sure`` over all documents, then one
    by one those that gain the most over documents without any so far.
    """
    pair = np.concatenate([(doc[f != 0].astype(np.uint64) << np.uint64(32)) | f[f != 0].astype(np.uint64) for f in own.T])
    pair.sort()
    at = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
    often, pair = np.diff(at, append=len(pair)), pair[at]
    pair = np.concatenate((pair, pair[often > 1]))
    twice = np.arange(len(pair)) >= len(often)
    where = (pair >> np.uint64(32)).astype(np.int64)
    names, code = np.unique((pair & np.uint64(0xFFFFFFFF)) * np.uint64(2) + twice, return_inverse=True)
    bad = toxic[where]
    clean = np.bincount(code[~bad], minlength=len(names))
    n_clean = int((~toxic).sum())
    taken = _gain(np.bincount(code[bad], minlength=len(names)), clean, int(toxic.sum()), n_clean, ratio) >= sure
    code, where = code[bad], where[bad]
    open_ = toxic.copy()
    open_[where[taken[code]]] = False
    while open_.any():
        gain = _gain(np.bincount(code[open_[where]], minlength=len(names)), clean, int(open_.sum()), n_clean, ratio)
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] < rest:
            break
        taken[best] = True
        open_[where[code == best]] = False
    return np.unique((names[taken] >> np.uint64(1)).astype(np.uint32))


def labelled(doc: np.ndarray, own: np.ndarray, toxic: np.ndarray, ratio: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """A tag for each word, and which words teach: those of clean documents, and of toxic ones that have a toxic word."""
    found = seeds(doc, own, toxic, ratio)
    tag = np.isin(own, found).any(axis=1) & toxic[doc]
    explained = np.zeros(len(toxic), dtype=bool)
    explained[doc[tag]] = True
    return tag.astype(np.int64), (~toxic | explained)[doc]


# ---- documents

@dataclass(frozen=True)
class Model:
    chain: Chain
    level: np.ndarray       # what the likeliest word, the expected number and 1 add to a document's log-odds
    prior: float            # share of toxic documents


def summary(tag: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: log-odds of its likeliest word, logarithm of the expected number of toxic words, 1."""
    top = np.zeros(n)
    np.maximum.at(top, doc, tag)
    total = np.bincount(doc, np.where(tag >= LIKELY, tag, 0), minlength=n)     # long texts add up no small ones
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.clip(np.log(top / (1 - top)), -_CAP, _CAP), np.log(total + 0.01), np.ones(n)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the first two coefficients are not negative."""
    w = np.zeros(x.shape[1])
    keep = np.array([decay, decay, 1e-6])
    for free in ((0, 1, 2), None):
        if free is None:
            free = tuple(i for i in range(3) if i == 2 or w[i] > 0)
            if len(free) == 3:
                break
            w = np.zeros(3)
        cols = list(free)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x[:, cols].T @ (weight * (y - p)) - keep[cols] * w[cols]
            curve = (x[:, cols] * (weight * p * (1 - p))[:, None]).T @ x[:, cols] + np.diag(keep[cols])
            w[cols] += np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w


def learn(doc: np.ndarray, values: np.ndarray, first: np.ndarray, toxic: np.ndarray, weight: np.ndarray, folds: int = 3) -> Model:
    """The field and the level of documents; the latter from fields that did not see the documents they judge."""
    prior = float((toxic * weight).sum() / weight.sum())
    ratio = float(weight[~toxic].mean() / weight[toxic].mean())
    fold = (arrays.mix(np.arange(len(toxic), dtype=np.uint64), 99) % np.uint64(folds)).astype(int)
    out = np.zeros(len(doc))
    for k in range(folds):
        mine = fold[doc] != k
        known = toxic & (fold != k)
        tag, teach = labelled(doc[mine], values[mine][:, :OWN], known, ratio)
        chain = train(values[mine][teach], tag[teach], first[mine][teach])
        other = ~mine
        out[other] = marginals(emissions(values[other], chain.weights), first[other], chain)[0]
    tag, teach = labelled(doc, values[:, :OWN], toxic, ratio)
    chain = train(values[teach], tag[teach], first[teach])
    return Model(chain, _logistic(summary(out, doc, len(toxic)), toxic.astype(float), weight), prior)


def _sampled(most: int, size: int):
    """Features of at most ``most`` windows of a document's words, chosen by hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                made = []
                for data in arrays.texts(batch.column("text")):
                    lo, hi = words(data)
                    window = np.arange(len(lo)) // size
                    if len(lo) > most * size:
                        n = int(window[-1]) + 1
                        chosen = np.zeros(n, dtype=bool)
                        chosen[np.argsort(arrays.mix(np.arange(n, dtype=np.uint64), 7))[:most]] = True
                        lo, hi, window = (x[chosen[window]] for x in (lo, hi, window))
                    first = np.diff(window, prepend=-1) != 0
                    made.append(features(data, lo, hi, first).astype("<u4").tobytes())
                yield pa.record_batch([batch.column("doc_id").cast(pa.string()), batch.column("toxic"), pa.array(made, pa.binary())],
                                      names=["doc_id", "toxic", "features"])

    return work


def fit(docs: DataFrame, labels: DataFrame, most: int = PER_LABEL, windows: int = WINDOWS, window: int = WINDOW) -> Model | None:
    """A model from at most ``most`` documents of each label, chosen by hash of their id.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0 or 1; null
    teaches nothing; of two labels of one id the larger counts).  A document
    teaches by ``windows`` windows of ``window`` words at most, chosen by hash, so
    the driver gets some 50 bytes for each of ``2 * most * windows * window`` words at
    most.  Of rows with one doc_id the first text counts.  None where either
    label is missing.
    """
    able = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in able.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    few = per_label(able, "toxic", most, ["doc_id"])
    chosen = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(few), "doc_id") \
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = chosen.mapInArrow(_sampled(windows, window), "doc_id string, toxic int, features binary").collect()
    got.sort(key=lambda r: (r["toxic"], r["doc_id"]))
    toxic = np.array([r["toxic"] == 1 for r in got])
    if not len(got) or toxic.all() or not toxic.any():
        return None
    rows = [np.frombuffer(r["features"], dtype="<u4").reshape(-1, FEATURES) for r in got]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    # A window's first word has none before it, and so had no feature of one.
    values = np.concatenate(rows)
    first = np.concatenate([np.arange(len(r)) % window == 0 for r in rows])
    del rows, got
    weight = np.where(toxic, share[1] / toxic.sum(), share[0] / (~toxic).sum())
    with np.errstate(over="ignore"):
        return learn(doc, values, first, toxic, weight / weight.mean())


def _spans(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, tag: np.ndarray, least: float) -> list[dict]:
    """Runs of words with a probability of ``least`` or more, in code points."""
    bad = np.flatnonzero(tag >= least)
    if not len(bad):
        return []
    point = np.flatnonzero((data & 0xC0) != 0x80)
    runs = np.split(bad, np.flatnonzero(np.diff(bad) > 1) + 1)
    return [{"begin": int(np.searchsorted(point, lo[r[0]])), "end": int(np.searchsorted(point, hi[r[-1]])),
             "probability": float(tag[r].max())} for r in runs]


_VERDICT = "score double, spans array<struct<begin: int, end: int, probability: double>>"
_ARROW = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct(
    [("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))])


def judged(lot: Sequence[np.ndarray], model: Model, least: float = 0.5) -> list[dict]:
    """Score and spans of each text of a lot."""
    gap = np.full(1, 32, dtype=np.uint8)
    data = np.concatenate([x for t in lot for x in (t, gap)])
    begins = np.cumsum([0] + [len(t) + 1 for t in lot])
    lo, hi = words(data)
    doc = np.searchsorted(begins, lo, "right") - 1
    first = np.diff(doc, prepend=-1) != 0
    tag, _ = marginals(emissions(features(data, lo, hi, first), model.chain.weights), first, model.chain)
    odds = summary(tag, doc, len(lot)) @ model.level
    cuts = np.searchsorted(doc, np.arange(len(lot) + 1))
    return [{"score": round(1 / (1 + math.exp(-max(-30.0, min(30.0, float(odds[i]))))), 9),
             "spans": _spans(t, lo[cuts[i]:cuts[i + 1]] - begins[i], hi[cuts[i]:cuts[i + 1]] - begins[i], tag[cuts[i]:cuts[i + 1]], least)}
            for i, t in enumerate(lot)]


def judge(text: Column, model: Model | None, least: float = 0.5) -> Column:
    """Struct (score, spans) of a whole text: how likely it is toxic, 0 to 1, and its offending spans.

    A span is a run of words whose probabilities reach ``least``: begin and end
    (exclusive) in code points, and the largest of them.  A text without words,
    null or empty, has no span and the score of no evidence.  Equal texts are
    judged alike.  Without a model every score is 0.5.
    """
    if model is None:
        return F.struct(F.lit(0.5).alias("score"), F.array().cast("array<struct<begin: int, end: int, probability: double>>").alias("spans"))

    @F.arrow_udf(_VERDICT)
    def said(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with np.errstate(over="ignore"):
            for column in batches:
                yield pa.array([x for lot in arrays.lots(column) for x in judged(lot, model, least)], _ARROW)

    return said(whole(text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


@query("op12_toxic_spans")
def op12_toxic_spans(spark, sf_dir):
    """Contract: doc_id, held_out, score, predicted (and the offending spans)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), judge(F.col("text"), model).alias("said"))
    return out.select("doc_id", "held_out", "said.score", (F.col("said.score") >= CUT).cast("int").alias("predicted"), "said.spans")
