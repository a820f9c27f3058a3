import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordclips.llm import langid, quality, urls
from wordclips.llm.sampling import per_label

KIND = "doc_id bigint, text string, lang string, source string, score string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", "clash") for i, t, g in rows], KIND)


def _texts(n, seed=1):
    rng = random.Random(seed)
    parts = {"en": ["the", "and", "ing", "tion", "er"], "fr": ["eau", "é", "tre", "que", "oi"], "el": ["και", "του", "ος", "α"]}
    rows = []
    for i in range(n):
        g = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[g]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 200))), g))
    return rows


def test_language_of_held_out_texts(spark):
    rows = _texts(300)
    docs = _docs(spark, rows)
    net = langid.fit(docs.where("doc_id % 3 < 2 or doc_id % 2 = 0"))
    got = docs.select("doc_id", "lang", langid.identify(F.col("text"), net).alias("l")).collect()
    assert np.mean([r["l"]["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert all(0 <= r["l"]["score"] <= 1 for r in got)


def test_language_of_odd_texts(spark):
    net = langid.fit(_docs(spark, _texts(60)))
    odd = _docs(spark, [(1, None, "en"), (2, "", None), (3, "123 !?", "fr"), (4, "the and the " * 100_000, None), (4, "a", None), (None, "α", None)])
    got = {(r["doc_id"], r["text"]): r["l"] for r in odd.select("doc_id", "text", langid.identify(F.col("text"), net).alias("l")).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in got if i[0] in (1, 2, 3))
    assert next(v for k, v in got.items() if k[1] and k[1].startswith("the and"))["lang_pred"] == "en"
    assert langid.fit(odd.where("lang = 'de'")) is None
    assert {r["l"]["lang_pred"] for r in odd.select(langid.identify(F.col("text"), None).alias("l")).collect()} == {"und"}
    kept = langid.reject_unknown(odd, net, least=0.0)
    assert kept.columns == odd.columns and kept.count() == 3
    assert langid.reject_unknown(odd.limit(0), net).count() == 0


def test_fast_answers_are_the_networks(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 255, (7, langid.LENGTH)).astype(np.uint8)
    net = langid.train(x, np.array([0, 1, 0, 1, 0, 1, 1]), ("a", "b"), epochs=2)
    pooled, _ = langid._maxima(net.filters, x)
    slow = langid._softmax(np.maximum(pooled, 0) @ net.out + net.bias)
    assert np.allclose(langid.Judge(net, together=3).probabilities(x), slow, atol=1e-5)


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 255, (40, 32)).astype(np.uint8), np.arange(40) % 2
    x[y == 1, 3:6] = [1, 2, 3]
    net = langid.train(x, y, ("a", "b"), epochs=60)
    assert (langid.Judge(net).probabilities(x).argmax(axis=1) == y).all()


def test_quality_votes(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(80)) + "."
    bad = [lambda: good().upper() + "!!", lambda: "word " * 90, lambda: good().replace(" ", "*** ")]
    rows = [(i, good() if i % 4 else bad[i % 3](), "en") for i in range(400)]
    docs = _docs(spark, rows)
    labels = docs.select(F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"), "doc_id")
    voters = quality.fit(docs, labels.where("doc_id < 300"))
    got = docs.where("doc_id >= 300").select("doc_id", quality.score(F.col("text"), voters).alias("q")).collect()
    assert np.mean([(r["q"] >= 0.5) == bool(r["doc_id"] % 4) for r in got]) > 0.97
    odd = _docs(spark, [(1, None, None), (2, "", None), (3, "é", None), (3, "é", None), (4, "x" * 3_000_000, None)])
    scores = {r["doc_id"]: r["q"] for r in odd.select("doc_id", quality.score(F.col("text"), voters).alias("q")).collect()}
    assert scores[1] == scores[2] == pytest.approx(voters.prior) and all(0 <= s <= 1 for s in scores.values())
    assert quality.fit(docs, labels.limit(0)) is None
    assert odd.select(quality.score(F.col("text"), None).alias("q")).first()["q"] == 0.5


def test_counts_do_not_depend_on_pieces():
    data = np.frombuffer(("Some text, " * 50).encode(), np.uint8)
    with np.errstate(over="ignore"):
        whole, cut = quality.term_counts(data), quality.term_counts(data, piece=64)
    assert (whole == cut).all()
    # Beyond the pieces in which words are hashed: no word is counted twice, no repeat lost.
    words = [f"w{i % 9}" for i in range(400_000)]
    with np.errstate(over="ignore"):
        got = quality.term_counts(np.frombuffer(" ".join(words).encode(), np.uint8))[quality.RUNS + quality.CLASSES:]
    assert got[0] == len(words) and got[9] == len(words) - 9 and not got[1:9].any()


def test_exact_votes():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.02, (40, quality.TERMS)).astype(np.float32)
    voters = quality.train(counts, np.arange(40) % 2, rank=8)
    got = quality.vote(counts, voters, nearest=5, block=7)
    v = quality._unit((quality.weighted(counts) * voters.scale) @ voters.axes)
    for i in range(40):
        cos = voters.vectors @ v[i]
        top = np.argsort(-cos)[:5]
        w = np.clip(cos[top], 0, None) ** quality.POWER
        assert got[i] == pytest.approx((w * voters.labels[top]).sum() / w.sum(), abs=1e-4)


def _pages(spark, urls_):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls_)], "page_id bigint, url string, host string")


def test_hosts_paths_and_rules(spark):
    cases = {
        "https://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/x": ("example.net", "/EN/x", "net/", "block"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "http://example.net/en": ("example.net", "/en", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "x://www.example.com/de/1#a/b": ("www.example.com", "/de/1", "example.com/de/", "block"),
        "http://É.org/fr/?q=http://x.net/": ("É.org", "/fr/", "org/fr/", "allow"),
    }
    free = ["http://x.net", "http://a.org/frx", "http://q.com?x=/de/", "no scheme.net/en/", "", None, "://", "http://a.com/\nb"]
    got = urls.judge(_pages(spark, [*cases, *free])).orderBy("page_id").collect()
    assert [tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in got[:len(cases)]] == list(cases.values())
    assert [(r["host"], r["path"], r["rule"]) for r in got[len(cases):]] == [
        ("x.net", "", None), ("a.org", "/frx", None), ("q.com", "", None), ("", "", None), ("", "", None), ("", "", None),
        ("", "", None), ("a.com", "/\nb", None)]
    assert {r["verdict"] for r in got} <= {"allow", "block"}


def _witten_bell(grams, text, order):
    """Mean log-probability of a padded text's characters."""
    total = 0.0
    padded = "\2" * order + text + "\3"
    for i in range(order, len(padded)):
        p = 1 / 256
        for o in range(order + 1):
            seen = grams.get(padded[i - o:i], {})
            n = sum(seen.values())
            if n:
                p = (seen.get(padded[i], 0) + len(seen) * p) / (n + len(seen))
        total += math.log(p)
    return total / (len(text) + 1)


def test_ratio_against_brute_force(spark):
    order = 3
    rows = [("a.com/en/0", 3, 0), ("b.com/xx", 0, 5), ("a.com/de", 1, 1), ("zz", 0, 0), ("", 0, 0), ("aaaa", 2, 0)]
    frame = spark.createDataFrame(rows, "form string, allowed bigint, blocked bigint")
    got = {r["form"]: r["score"] for r in urls.ratios(frame, order).collect()}
    models = []
    for side in (1, 2):
        grams = {}
        for row in rows:
            padded = "\2" * order + row[0] + "\3"
            for i in range(order, len(padded)):
                for o in range(order + 1):
                    if row[side]:
                        c = grams.setdefault(padded[i - o:i], {})
                        c[padded[i]] = c.get(padded[i], 0) + row[side]
        models.append(grams)
    assert set(got) == {r[0] for r in rows}
    for form, *_ in rows:
        assert got[form] == pytest.approx(_witten_bell(models[0], form, order) - _witten_bell(models[1], form, order))


def test_threshold_and_small_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "score double, allowed bigint, blocked bigint")
    assert urls.threshold(frame([(-1.0, 0, 9), (0.2, 1, 5), (0.5, 7, 0), (2.0, 3, 1)])).first()["cut"] == 0.5
    assert urls.threshold(frame([(-1.0, 0, 9)])).first()["cut"] == 0.0
    assert urls.threshold(frame([])).first()["cut"] == 0.0
    assert urls.judge(_pages(spark, [])).count() == 0
    got = urls.judge(_pages(spark, ["http://a.com/" + "x" * 100_000, "http://a.com/y", "http://a.com/y"])).collect()
    assert len(got) == 3 and {r["verdict"] for r in got} == {"allow"}


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 10 == 0], f"t{i % 50}") for i in range(4000)] + [(5, None, "x")], "doc_id int, lang string, text string")
    one, two = (sorted(map(tuple, per_label(rows, "lang", 100, ["doc_id", "text"]).collect())) for _ in range(2))
    assert one == two and [sum(r[1] == k for r in one) for k in "ab"] == [100, 100]
    few = per_label(rows, "lang", 10_000, ["doc_id", "text"])
    assert few.count() == 4000 and few.columns == rows.columns
    assert per_label(rows.limit(0), "lang", 5, ["doc_id"]).count() == 0
