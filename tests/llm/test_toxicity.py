import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordclips.llm import arrays, toxicity

KIND = "doc_id bigint, text string, score string, spans int"


def _bytes(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def _chain(rng):
    return toxicity.Chain(rng.normal(size=64), rng.normal(size=2), rng.normal(size=(2, 2)))


def _brute(said, chain):
    """Marginals and pair marginals of one text by a sum over all its taggings."""
    n = len(said)
    tag, pair, total = np.zeros(n), np.zeros((2, 2, n)), 0.0
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(chain.begin[y[0]] + sum(chain.pairs[a, b] for a, b in itertools.pairwise(y)) + (said * np.array(y)).sum())
        total += w
        tag += w * np.array(y)
        for t in range(1, n):
            pair[y[t - 1], y[t], t] += w
    return tag / total, pair / total


def test_marginals_are_sums_over_all_taggings():
    rng = np.random.default_rng(0)
    chain = _chain(rng)
    sizes = [1, 2, 5, 9, 1, 7, 8, 3, 9, 6]
    said = [rng.normal(size=n) * 3 for n in sizes]
    first = np.concatenate([np.arange(n) == 0 for n in sizes])
    tag, pair = toxicity.marginals(np.concatenate(said), first, chain)
    want = [_brute(s, chain) for s in said]
    assert np.allclose(tag, np.concatenate([w[0] for w in want]))
    assert np.allclose(pair, np.concatenate([w[1] for w in want], axis=2))
    assert len(toxicity.marginals(np.zeros(0), np.zeros(0, bool), chain)[0]) == 0


def test_a_long_chain_does_not_depend_on_blocks():
    rng = np.random.default_rng(1)
    chain, n = _chain(rng), 20_000
    said, first = rng.normal(size=n) * 4, rng.random(n) < 0.001
    first[0] = True
    tag, _ = toxicity.marginals(said, first, chain)
    ahead, back, now = np.zeros((n, 2)), np.zeros((n, 2)), None
    for t in range(n):
        now = (chain.begin if first[t] else np.log(np.exp(now)[:, None] * np.exp(chain.pairs)).T @ [1, 1] * 0 + np.log((np.exp(now)[:, None] * np.exp(chain.pairs)).sum(0)))
        now = now + np.array([0, said[t]])
        now = now - now.max()
        ahead[t] = now
    back[-1] = 0
    for t in range(n - 2, -1, -1):
        back[t] = 0 if first[t + 1] else np.log((np.exp(chain.pairs) * np.exp(back[t + 1] + [0, said[t + 1]])).sum(1))
        back[t] -= back[t].max()
    both = np.exp(ahead + back)
    assert np.allclose(tag, both[:, 1] / both.sum(1), atol=1e-9)


def test_gradient_finds_weights():
    rng = np.random.default_rng(2)
    values = ((rng.integers(1, 40, (6000, 3)) + 64 * np.arange(3)) | (1 << 31)).astype(np.uint32)
    tags = np.isin(values[:, 0] & 255, [3, 9]).astype(np.int64)
    first = np.arange(6000) % 20 == 0
    chain = toxicity.train(values, tags, first, bits=8, epochs=12, batch=500)
    tag, _ = toxicity.marginals(toxicity.emissions(values, chain.weights), first, chain)
    assert ((tag > 0.5) == tags).mean() > 0.99


def test_words_and_features():
    text = "Ein „Idiot“, É1a—x yz «q» 。日本 "
    data = _bytes(text)
    lo, hi = toxicity.words(data)
    assert [bytes(data[a:b]).decode() for a, b in zip(lo, hi, strict=True)] == ["Ein", "Idiot", "É1a", "x", "yz", "q", "日本"]
    assert bytes(toxicity.lower(_bytes("ÀÉÞ×ÿ ABz"))).decode() == "àéþ×ÿ abz"
    with np.errstate(over="ignore"):
        both = _bytes("idiot idiots. Idiot " * 50)
        lo, hi = toxicity.words(both)
        first = np.arange(len(lo)) == 0
        whole, cut = (toxicity.features(both, lo, hi, first, piece=p) for p in (1 << 20, 30))
    assert (whole == cut).all()
    assert whole[0, 0] == whole[2, 0] and whole[0, 0] != whole[1, 0] and whole[0, 3] == 0 and whole[1, 3] == arrays_beginning(b"idiot")
    assert whole[0, -2] == 0 and whole[0, -1] != 0 and whole[-1, -1] == 0


def arrays_beginning(part):
    with np.errstate(over="ignore"):
        sums = arrays.prefix(np.frombuffer(part, dtype=np.uint8))
        return toxicity._named(arrays.stretch(sums, np.array([0]), np.array([len(part)])), 1)[0]


def _corpus(n, seed):
    """Clean documents, and toxic ones with whole words or with words that begin alike."""
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        out = [word() for _ in range(rng.randrange(10, 120))]
        toxic = i % 5 == 0
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            out.insert(rng.randrange(len(out)), rng.choice(["grumble", "Fiend", "zlax" + word(), "zlax" + word()]))
        rows.append((i, " ".join(out) + ".", int(toxic)))
    return rows


def test_held_out_documents_and_spans(spark):
    rows = _corpus(900, 4)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in rows], KIND)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, most=300)
    got = docs.select("doc_id", "text", toxicity.judge(F.col("text"), model).alias("v")).collect()
    truth = {i: y for i, _, y in rows}
    mine = [r for r in got if r["doc_id"] % 3 == 0]
    assert np.mean([(r["v"]["score"] >= 0.7) == truth[r["doc_id"]] for r in mine]) > 0.98
    found = [r["text"][s["begin"]:s["end"]] for r in mine for s in r["v"]["spans"]]
    bad = lambda x: any(w.startswith(("grumble", "Fiend", "zlax")) for w in x.split())
    assert np.mean([bad(x) for x in found]) > 0.98 and len(found) > 120
    said = sum(bad(w) for r in mine for w in r["text"].split())
    assert sum(len([w for w in x.split() if bad(w)]) for x in found) > 0.9 * said


def test_odd_texts(spark):
    rows = _corpus(300, 5)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in rows], KIND)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1), (9_999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    long = "the end " * 400_000
    odd = spark.createDataFrame([(1, None, "", 0), (2, "", "", 0), (3, ".,!", "", 0), (4, long, "", 0), (5, long + "é Fiend", "", 0),
                                 (6, "y" * 1_500_000, "", 0), (None, "Fiend", "", 0), (None, "Fiend", "", 0)], KIND)
    got = [(r["doc_id"], r["v"]["score"], [(s["begin"], s["end"]) for s in r["v"]["spans"]])
           for r in odd.select("doc_id", toxicity.judge(F.col("text"), model).alias("v")).collect()]
    by = {i: (s, x) for i, s, x in got}
    assert by[1] == by[2] == by[3] and by[1][0] < 0.3 and by[4][0] < 0.7
    assert by[5][1] == [(len(long) + 2, len(long) + 7)] and by[None][1] == [(0, 5)] and by[None][0] > 0.7
    assert len(got) == 8 and all(0 <= s <= 1 for _, s, _ in got)
    assert odd.limit(0).select(toxicity.judge(F.col("text"), model)).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.fit(docs, labels.limit(0)) is None
    assert {r["v"]["score"] for r in odd.select(toxicity.judge(F.col("text"), None).alias("v")).collect()} == {0.5}


def test_features_set_toxic_documents_apart():
    own = np.zeros((60, toxicity.OWN), dtype=np.uint32)
    doc = np.repeat(np.arange(30), 2)
    toxic = np.arange(30) < 10
    own[:, 0] = 1000 + np.arange(60)
    own[doc < 6, 1] = 7                 # twice in six toxic documents
    own[[0, 20, 22, 24, 26, 28, 30], 2] = 8     # mostly in clean ones
    assert toxicity.seeds(doc, own, toxic, sure=6, rest=5).tolist() == [7]
    tag, teach = toxicity.labelled(doc, own, toxic)
    assert tag.sum() in (0, 12) and teach[doc >= 10].all()
    assert pytest.approx(toxicity._gain(np.array([5]), np.array([0]), 5, 5, 1.0)[0]) == 5 * np.log(2)
