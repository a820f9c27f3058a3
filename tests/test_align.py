import difflib
import random

import pytest
from pyspark.sql import functions as F

from tests import models
from wordclips.operators import align as AL
from wordclips.operators import reconcile as RC

KIND = "win bigint, pos bigint, key string"


def _sides(spark, texts):
    return [spark.createDataFrame([(g, p * 3, w) for g, both in texts.items() for p, w in enumerate(both[side])], KIND) for side in (0, 1)]


def _changed(r, words, rate):
    out = []
    for w in words:
        x = r.random()
        if x > rate:
            out.append(w)
        elif x < rate / 3:
            out += [w, r.choice("abcdefgh")]
        elif x < rate / 2:
            out.append(w + "x")
    return out


def _texts(seed):
    r = random.Random(seed)
    texts = {}
    for g in range(24):
        words = [r.choice("abcdefgh" if g % 2 else [f"w{i}" for i in range(60)]) for _ in range(r.randrange(0, 60))]
        texts[g] = (words, _changed(r, words, 0.3))
    moved = [f"w{i}" for i in range(200)]
    texts[100] = (moved, moved[:30] + moved[120:150] + moved[30:120] + moved[150:])     # a moved passage
    texts[101] = (["x"] * 80, ["x"] * 61)                                                # one word
    texts[102] = (["a", "b"] * 40, ["b", "a"] * 40)
    texts[103] = ([], ["a", "b"])
    texts[104] = (["a"], [])
    texts[105] = (list(reversed(moved[:40])), moved[:40])
    texts[106] = (["a", "b", "c"], ["d", "e"])
    return texts


@pytest.mark.parametrize("chunk", [10_000, 21])
def test_opcodes_against_the_rule(spark, monkeypatch, chunk):
    monkeypatch.setattr(AL, "CHUNK", chunk)
    texts = _texts(chunk)
    have, heard = _sides(spark, texts)
    got = {}
    for x in RC.diff_tokens(have, heard, ["win"]).collect():
        got.setdefault(x.win, []).append((x.k, (x.tag, x.i1, x.i2, x.j1, x.j2)))
    for g, (a, b) in texts.items():
        assert [op for _, op in sorted(got.get(g, []))] == models.ops_of(models.align(a, b), len(a), len(b)), g
        assert [k for k, _ in sorted(got.get(g, []))] == list(range(len(got.get(g, []))))


def test_the_rule_finds_what_the_longest_stretches_give():
    r = random.Random(9)
    for _ in range(40):
        a = [f"w{r.randrange(400)}" for _ in range(200)]
        b = _changed(r, a, 0.1)
        mine, theirs = len(models.align(a, b)), sum(i2 - i1 for t, i1, i2, _, _ in models.opcodes(a, b) if t == "equal")
        assert mine >= theirs - 3


def test_one_long_text_and_its_halves(spark):
    r = random.Random(5)
    a = [f"w{r.randrange(3000)}" for _ in range(6000)]
    b = [w + "s" if n % 41 == 7 else w for n, w in enumerate(a)]
    clips = [(1, n, n, w) for n, w in enumerate(a)] + [(2 + n // 3000, n % 3000, 10_000 + n, w) for n, w in enumerate(a)]
    ref = [(1, n, w) for n, w in enumerate(b)] + [(2 + n // 3000, n % 3000, w) for n, w in enumerate(b)]
    lexicon = spark.createDataFrame([(w + "s", ["K"]) for w in set(a)], "word string, phones array<string>")
    got = RC.plan_corrections(spark.createDataFrame(clips, "source_id bigint, pos bigint, clip_id bigint, word string"),
                              spark.createDataFrame(ref, "source_id bigint, pos bigint, word string"), lexicon).collect()
    whole = {(x.clip_id, x.old, x.new) for x in got if x.source_id == 1}
    assert whole == {(x.clip_id - 10_000, x.old, x.new) for x in got if x.source_id > 1}
    assert whole == {(n, w, w + "s") for n, w in enumerate(a) if n % 41 == 7 and 2 * len(w) / (2 * len(w) + 1) >= 0.77}


def test_similarity_of_words(spark):
    r = random.Random(2)
    pairs = [("", ""), ("a", ""), ("", "abc"), ("hypnotise", "hypnotize"), ("aab", "abaab"), ("conker", "konker"), ("été", "ete"), ("abcabc", "abc")]
    pairs += [("".join(r.choice("abcd") for _ in range(r.randrange(0, 12))), "".join(r.choice("abcd") for _ in range(r.randrange(0, 12)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", RC.similarity("a", "b").alias("s")).collect()
    for x in got:
        assert x.s == pytest.approx(difflib.SequenceMatcher(None, x.a, x.b, autojunk=False).ratio()), x
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(RC.similarity(F.col("a"), "b").alias("s")).first().s is None


def test_accents_fold_as_unicode_decomposes_them(spark):
    from wordclips.functions import text as TX
    pairs = [("café", "cafe"), ("Škoda", "Skoda"), ("ő", "o"), ("é", "e"), ("ﬁn", "fin"), ("½", "12"), ("ß", ""), ("日本a", "a"), ("", ""), ("plain", "plain")]
    got = spark.createDataFrame(pairs, "word string, want string").select("want", TX.ascii_fold("word").alias("folded")).collect()
    assert [(x.want, x.folded) for x in got if x.want != x.folded] == []
