import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import models
from wordclips.llm import arrays, components, decontaminate, ngram_join, substrings

KIND = "doc_id bigint, text string, key string, words string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], KIND)


def _corpus(seed=1, groups=6, size=12):
    """Groups of near copies with a few words changed, some exact copies and single texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + str(rng.randrange(40))
    rows, n = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.randrange(40, 400))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 60))):
                text[rng.randrange(len(text))] = word()
            rows.append((n, " ".join(text)))
            n += 1
    for _ in range(20):
        rows.append((n, " ".join(word() for _ in range(rng.randrange(5, 80)))))
        n += 1
    odd = [None, "", "!!!", "one", "One!", "one two three four", "a b c d e", "a b c d e", "A, b c d e."]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + [(1000, None), (7, "repeated id"), (None, rows[0][1])]


@pytest.mark.parametrize("how", [{}, {"limit": 2, "depth": 2, "block": 4, "runs": 24}])
def test_join_against_brute_force(spark, how):
    rows = _corpus()
    got = ngram_join.joined(_docs(spark, rows), **how).drop("key", "root").collect()
    assert sorted(map(tuple, got), key=repr) == models.classes(rows)


def test_one_of_each(spark):
    rows = _corpus(seed=2, groups=3, size=5)
    docs = _docs(spark, rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {c: None for _, c, *_ in models.classes(rows)}
    assert kept.count() == len(classes)
    assert {r["doc_id"] for r in kept.collect()} == set(classes)
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert 1 - (1 - 0.8 ** 2) ** ngram_join.runs_for(0.8) >= 0.9999


def test_runs_reach_the_recall_at_the_depth_used():
    runs, depth = ngram_join.runs_for(0.8), ngram_join.DEPTH
    assert 1 - (1 - 0.8 ** depth) ** runs >= 0.9999
    # Runs that shared places would miss the same pairs.
    places = [ngram_join.place_of(r, level, runs) for level in range(depth) for r in range(runs)]
    assert len(set(places)) == runs * depth


def test_each_run_meets_a_pair_the_others_miss(spark):
    rng, depth = np.random.default_rng(5), 3
    runs = ngram_join.runs_for(0.8, depth=depth)
    rows = []
    for r in range(runs):
        a = rng.integers(0, 2**32, ngram_join.SLOTS, dtype=np.uint32)
        b = a.copy()
        b[[i for i in range(runs) if i != r]] ^= 1      # the first places of all other runs
        rows += [(bytes([r, side]), x.astype("<u4").tobytes()) for side, x in enumerate((a, b))]
    sketches = spark.createDataFrame(rows, "key binary, sketch binary")
    got = ngram_join.candidates(sketches, 0.8, limit=1, depth=depth).collect()
    assert {bytes(e["a"])[0] for e in got if e["a"] != e["b"]} == set(range(runs))
    assert all(e["a"][0] == e["b"][0] for e in got)


def test_a_large_bucket_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    got = ngram_join.joined(_docs(spark, rows), limit=8, depth=1, block=16).drop("key", "root").collect()
    assert sorted(map(tuple, got), key=repr) == models.classes(rows)


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 5, 100, 200, 300)]
    got = ngram_join.shared_counts(sets, columns=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, None), (301, 300), (300, 301)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _items(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id bigint, text string, item string")


def _contained(docs, items, share=0.8, k=5):
    out = []
    for i, item in items:
        s = models.shingles(item, k, short=False)
        for d, text in docs:
            n = len(s & models.shingles(text, k, short=False)) if s else 0
            if s and n >= share * len(s):
                out.append((d, i, n, len(s), n / len(s)))
    return sorted(out, key=repr)


def test_containment_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 5, 6, 9, 17, 30, 64, 65, 130])))) for i in range(60)]
    docs = []
    for d in range(80):
        text = [word() for _ in range(rng.randrange(1, 3000))]
        if d % 2:
            leak = items[rng.randrange(60)][1].upper().split()
            for _ in range(rng.randrange(3)):
                leak[rng.randrange(len(leak))] = word()
            at = rng.randrange(len(text))
            text[at:at] = leak
        docs.append((d, ", ".join(text)))
    docs += [(100, None), (101, ""), (101, items[1][1]), (101, items[1][1]), (None, items[2][1])]
    items += [(100, None), (101, ""), (102, items[1][1]), (None, items[2][1])]
    got = decontaminate.contained(_docs(spark, docs), _items(spark, items))
    assert sorted(map(tuple, got.collect()), key=repr) == _contained(docs, items)
    # A Bloom filter that holds nearly everything changes no result.
    full = decontaminate.contained(_docs(spark, docs), _items(spark, items), bits=6)
    assert sorted(map(tuple, full.collect()), key=repr) == _contained(docs, items)
    dirty = {d for d, *_ in _contained(docs, items)}
    kept = decontaminate.clean(_docs(spark, docs), _items(spark, items))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((d for d, _ in docs if d not in dirty or d == 101 and _ == ""), key=repr)
    assert kept.columns == ["doc_id", "text", "key", "words"]


def test_scattered_items_are_found(spark):
    # Items of 100 words in five pieces, hundreds of words between: 80 of 96 shingles are left.
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(50_000)}"
    items = [(i, " ".join(word() for _ in range(100))) for i in range(40)]
    docs = []
    for i, text in items:
        w, out = text.split(), []
        for n in range(0, 100, 20):
            out += w[n:n + 20] + [word() for _ in range(rng.randrange(200, 600))]
        docs.append((i, " ".join(out)))
    got = decontaminate.contained(_docs(spark, docs), _items(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(40)}


def test_hits_that_rule_a_class_out():
    for size in (4, 8, 16, 128):
        least = decontaminate.least_hits(size, 0.8)
        smallest = 1 if size == 4 else size // 2 + 1
        assert least >= 1 and (least - 1) < 0.8 * smallest <= least
    values = np.arange(40)[::-1].reshape(1, 40).astype(np.uint64)
    assert decontaminate.window_minima(values, 4).tolist() == [[20, 16, 12, 8, 4, 0]]
    assert decontaminate.window_minima(values[:, :10], 4).tolist() == [[30]]


def test_containment_of_empty_tables(spark):
    docs, items = _docs(spark, [(1, "a b c d e f")]), _items(spark, [(1, "a b c d e")])
    assert decontaminate.contained(docs.limit(0), items).count() == 0
    assert decontaminate.contained(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == 1


def _removed(spark, texts, size):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, key string")
    rows = substrings.remove_repeats(docs, size).orderBy("doc_id").collect()
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows]


@pytest.mark.parametrize("size", [32, 60, 200])
def test_repeats_against_brute_force(spark, size):
    rng = random.Random(size)
    text = lambda n: "".join(rng.choice("ab cdé") for _ in range(n))
    parts = [text(rng.randrange(size // 2, 3 * size)) for _ in range(8)]
    texts = ["".join(rng.choice([rng.choice(parts), text(rng.randrange(1, size))]) for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    texts += [None, "", "a" * size, "a" * (size - 1), "ab" * size, "ab" * (3 * size), "be be " * size, texts[0], texts[0], texts[1][5:],
              "x" + texts[2], "日本語" * size]
    assert _removed(spark, texts, size) == models.without_repeats(texts, size)


def test_copies_of_a_text_gather_its_spans_once(spark, monkeypatch):
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    plain = substrings._merged

    def merged(size):
        work = plain(size)

        def once(batches):
            for batch in batches:
                for spans in batch.column("spans").to_pylist():
                    assert len(spans) == len(set(spans))
                yield from work([batch])

        return once

    monkeypatch.setattr(substrings, "_merged", merged)
    texts = [text] * 40 + [text[:500], "z" * 100]
    assert _removed(spark, texts, 64) == models.without_repeats(texts, 64)


def test_repeats_over_the_cuts_of_a_long_text(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [long[:1500] + long[200:2900] + long[:700], long[900:]]
    whole = models.without_repeats(texts, 64)
    with np.errstate(over="ignore"):
        starts = {}
        for step in (100, 1 << 20):
            monkeypatch.setattr(substrings, "_STEP", step)
            got = [g for g in substrings.anchored(np.frombuffer(texts[0].encode(), np.uint8), 64)]
            starts[step] = [p for lo, hi, *_ in got for a, b in zip(lo, hi) for p in range(a, b + 1)]
    assert starts[100] == starts[1 << 20] == list(range(len(texts[0]) - 63))
    assert _removed(spark, texts, 64) == whole
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hashes_of_words_do_not_depend_on_pieces(monkeypatch):
    text = np.frombuffer(" ".join(f"word{i}" for i in range(500)).encode(), np.uint8)
    with np.errstate(over="ignore"):
        whole = arrays.word_hashes(text)
        monkeypatch.setattr(arrays, "_PIECE", 64)
        assert (arrays.word_hashes(text) == whole).all()
    assert len(whole) == len(set(whole.tolist())) == 500


def test_groups_are_never_parted():
    batches = [pa.record_batch([pa.array(x)], names=["g"]) for x in ([1, 1], [1, 2], [2], [], [2, 3, 4], [5])]
    got = [t.column("g").to_pylist() for t in arrays.whole_groups(iter(batches), "g")]
    assert sum(got, []) == [1, 1, 1, 2, 2, 2, 3, 4, 5]
    for g in range(1, 6):
        assert sum(g in t for t in got) == 1
