"""The pipeline as it is wired, stage by stage, against brute-force models."""

import random

import corpus_pipeline
from tests.llm import models
from tests.llm.test_lines import _brute as lines_brute
from wordclips.session import stored

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
PARTS = {"en": ["the", "and", "ing", "tion", "er", "st"], "fr": ["eau", "é", "tre", "que", "oi", "ç"]}
FOOTER = "Shared footer of every site"


def _word(r, lang):
    return "".join(r.choice(PARTS[lang]) for _ in range(r.randrange(1, 4)))


def _docs(r, item):
    rows = []
    for i in range(180):
        lang = "en" if i % 3 else "fr"
        words = [_word(r, lang) for _ in range(r.randrange(60, 140))]
        lines = [" ".join(words[n:n + 15]) for n in range(0, len(words), 15)]
        if 150 <= i < 156:
            lines.insert(2, item)
        if i % 5 == 0:
            lines.append(FOOTER)
        rows.append((i, "\n".join(lines), lang, f"s{i % 12}"))
    rows += [(200 + i, _word(r, "en") + " " + rows[i][1], rows[i][2], f"s{i % 12}") for i in range(12)]       # near copies
    rows += [(220 + i, rows[20][1], rows[20][2], "s1") for i in range(4)]                                    # exact ones
    rows += [(300, None, None, "s1"), (301, "", "en", None), (302, "12 34 !? 56", "en", "s2"), (None, "the end " + rows[31][1], "en", None)]
    return [(i, t, g, s, None if t is None else len(t), "more") for i, t, g, s in rows]


def _holds(text, item):
    mine, its = models.shingles(text, short=False), models.shingles(item, short=False)
    return bool(its) and len(mine & its) >= 0.8 * len(its)


def test_stages_one_by_one(spark, tmp_path):
    r = random.Random(12)
    item = " ".join(_word(r, "en") for _ in range(24))
    rows = _docs(r, item)
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        outs.append([x.asDict() for x in docs.collect()])
        if name != "mix":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    one, two, three, four, mix = outs
    key = lambda x: repr((x["doc_id"], x["text"]))
    given = {repr((i, t)) for i, t, *_ in rows}
    # Texts in either language stay at the production threshold, what has no language goes.
    assert {key(x) for x in one} <= given
    assert {x["doc_id"] for x in one} == {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    want = lines_brute([(x["doc_id"], x["text"], x["source"]) for x in one], 8)
    assert sorted(((x["doc_id"], x["text"]) for x in two), key=repr) == sorted(((w[0], w[1]) for w in want), key=repr)
    assert any(FOOTER in x["text"] for x in one) and not any(FOOTER in x["text"] for x in two)
    assert all(x["n_chars"] == len(x["text"]) for x in two)
    classes = models.classes([(x["doc_id"], x["text"]) for x in two])
    named = {c for _, c, *_ in classes if c is not None}
    assert {x["doc_id"] for x in three} == named and len(three) == len(named)
    assert {x["doc_id"] for x in four} == {x["doc_id"] for x in three if not _holds(x["text"], item)}
    assert len(three) - len(four) == 6
    sizes, taken, target = {}, {}, {}
    for x in four:
        sizes.setdefault(x["source"], {})[x["doc_id"]] = len(x["text"].split())
    for x in mix:
        assert sizes[x["source"]][x["doc_id"]] == x["size"] and x["repeat"] <= 2
        taken[x["source"]] = taken.get(x["source"], 0) + x["size"]
        target[x["source"]] = x["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(sizes[s].values())
    assert len({(x["doc_id"], x["repeat"]) for x in mix}) == len(mix)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
