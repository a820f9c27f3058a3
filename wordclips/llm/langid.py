"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of a window, each filter keeps its
largest answer in it, and a softmax layer reads those.  The network is trained
in numpy on a bounded sample of labelled windows; a text is cut into windows of
fixed length, all of them are judged, and their probabilities averaged.
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

#: Bytes in a window, filter widths, filters of each width.
LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Bound of the training sample: documents per language, windows of each.
DOCUMENTS, WINDOWS = 400, 4
UNKNOWN = "und"


@dataclass(frozen=True)
class Network:
    """filters[m][j]: what byte j of a filter of width m adds (256 x FILTERS)."""

    languages: tuple[str, ...]
    filters: dict[int, np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def windows_of(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A text's bytes as rows of ``length``, the last one filled up with zeros."""
    rows = max(1, -(-len(data) // length))
    out = np.zeros(rows * length, dtype=np.uint8)
    out[:len(data)] = data
    return out.reshape(rows, length)


def _maxima(net_filters: dict[int, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of each filter in each window, and where."""
    best, where = [], []
    for m, table_ in net_filters.items():
        n = x.shape[1] - m + 1
        answer = sum(table_[j][x[:, j:j + n]] for j in range(m))
        at = answer.argmax(axis=1)
        best.append(np.take_along_axis(answer, at[:, None, :], 1)[:, 0, :])
        where.append(at)
    return np.concatenate(best, axis=1), np.concatenate(where, axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], epochs: int = 12, batch: int = 64,
          rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on cross-entropy; ``x`` windows (n x LENGTH bytes), ``y`` places in ``languages``."""
    rng = np.random.default_rng(seed)
    params = {m: rng.normal(0, 0.3, (m, 256, FILTERS)).astype(np.float32) for m in WIDTHS}
    params["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
    params["bias"] = np.zeros(len(languages), dtype=np.float32)
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            rows = order[lo:lo + batch]
            xb, yb = x[rows], y[rows]
            pooled, at = _maxima({m: params[m] for m in WIDTHS}, xb)
            hidden = np.maximum(pooled, 0)
            error = _softmax(hidden @ params["out"] + params["bias"])
            error[np.arange(len(rows)), yb] -= 1
            error /= len(rows)
            back = (error @ params["out"].T) * (pooled > 0)
            grad = {"out": hidden.T @ error, "bias": error.sum(axis=0)}
            for i, m in enumerate(WIDTHS):
                mine = slice(i * FILTERS, (i + 1) * FILTERS)
                g = np.zeros_like(params[m])
                row = np.arange(len(rows))[:, None]
                for j in range(m):          # only the bytes under the largest answer moved it
                    np.add.at(g[j], (xb[row, at[:, mine] + j], np.arange(FILTERS)[None, :]), back[:, mine])
                grad[m] = g
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Network(languages, {m: params[m] for m in WIDTHS}, params["out"], params["bias"])


class Judge:
    """A network made ready for many windows: answers are looked up by pairs of bytes."""

    def __init__(self, net: Network, together: int = 512):
        self.net, self.together = net, together
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.tables = {}
        for m, t in net.filters.items():
            self.tables[m] = [(j, pair(t[j], t[j + 1]) if j + 1 < m else t[j]) for j in range(0, m, 2)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.net.languages)), dtype=np.float64)
        for lo in range(0, len(x), self.together):
            part = x[lo:lo + self.together].astype(np.int64)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            pooled = []
            for m, tables in self.tables.items():
                n = x.shape[1] - m + 1
                answer = None
                for j, t in tables:
                    got = np.take(t, (pairs if len(t) > 256 else part)[:, j:j + n], axis=0)
                    answer = got if answer is None else np.add(answer, got, out=answer)
                pooled.append(answer.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            out[lo:lo + self.together] = _softmax(hidden @ self.net.out + self.net.bias)
        return out

    def judge(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each text and its mean probability over the text's windows.

        The last window counts by how much of it is text.
        """
        cut = [windows_of(r) for r in rows]
        count = np.array([len(c) for c in cut])
        p = self.probabilities(np.concatenate(cut))
        weight = np.full(len(p), LENGTH, dtype=np.float64)
        ends = np.cumsum(count) - 1
        weight[ends] = np.maximum(1, np.array([len(r) for r in rows]) - (count - 1) * LENGTH)
        starts = ends - count + 1
        mean = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        best = mean.argmax(axis=1)
        return best, mean[np.arange(len(mean)), best]


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, rows = [], []
        for name, data in zip(batch.column("lang").to_pylist(), arrays.texts(batch.column("text")), strict=True):
            cut = windows_of(data)
            for i in np.unique(np.linspace(0, len(cut) - 1, WINDOWS).round().astype(int)):
                lang.append(name)
                rows.append(cut[i].tobytes())
        yield pa.record_batch([pa.array(lang, pa.string()), pa.array(rows, pa.binary())], names=["lang", "window"])


def fit(labelled: DataFrame, per_language: int = DOCUMENTS) -> Network | None:
    """Train on at most ``per_language`` documents of each language, chosen by hash of id and text.

    ``labelled`` has doc_id, text and lang; rows without either, or without a letter,
    teach nothing.  WINDOWS evenly spaced windows of each document are used, from
    its start to its end.  None where nothing is labelled.
    """
    able = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = per_label(able.select("doc_id", "lang", "text"), "lang", per_language, ["doc_id", "text"]).select(
        "lang", F.lower("text").alias("text"))
    got = sample.mapInArrow(_sample_windows, "lang string, window binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["window"]))
    languages = tuple(sorted({r["lang"] for r in got}))
    place = {name: i for i, name in enumerate(languages)}
    x = np.frombuffer(b"".join(r["window"] for r in got), dtype=np.uint8).reshape(len(got), LENGTH)
    return train(x, np.array([place[r["lang"]] for r in got]), languages)


def identify(text: Column, net: Network | None) -> Column:
    """Struct (lang_pred, score) of a text: ``und`` and 0 for null texts and texts without a letter.

    Whole texts are read, some megabytes at a time.
    """
    blank = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return blank
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    ready: list[Judge] = []

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not ready:
            ready.append(Judge(net))
        for column in batches:
            names, scores = [], []
            for lot in arrays.lots(column):
                best, score = ready[0].judge(lot)
                names += [net.languages[i] for i in best]
                scores += score.tolist()
            yield pa.array([{"lang_pred": a, "score": b} for a, b in zip(names, scores, strict=True)], kind)

    got = judge(F.lower(whole(text)))
    return F.when(whole(text).rlike(r"\p{L}"), got).otherwise(blank)


def reject_unknown(docs: DataFrame, net: Network | None, least: float = 0.4) -> DataFrame:
    """``docs`` without texts of no known language: ``und``, or a score under ``least``. All columns stay.

    A text half in one known language and half in another scores about 0.5 and stays.
    """
    judged = docs.withColumn("__language", identify(F.col("text"), net))
    return judged.where((F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= least)) \
        .drop("__language")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    """Contract: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), identify(F.col("text"), net).alias("l"))
    return out.select("doc_id", "held_out", "l.lang_pred", "l.score")
