import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordclips.llm import infilling

KIND = "doc_id bigint, text string, form string, extra int"


def _brute(doc_id, text, plain=10, spm=20):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    lo, hi = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or three % 100 >= 100 - plain:
        return n, "plain", None, None, text
    if four % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _texts(seed=3):
    rng = random.Random(seed)
    parts = ["word", "Ab", " ", "\n", "é", "日本", "1", ".", "😀", "<", "P", ">", "zz" * 9]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60)))) for i in range(300)]


ODD = [(None, None), (None, "a b"), (1, ""), (2, "x" * 50_000), (2, "x" * 50_000), (3, "é" * 30_000 + "<P" + ">" * 2), (4, "a<M>b"), (5, "ab " * 1_500_000)]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_against_the_definition(spark, block):
    rows = _texts() + (ODD if block > 1 else ODD[:3])
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], KIND)
    out = infilling.fill_in_middle(docs, block=block)
    assert out.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", infilling.restored("output", "form")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == _brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["extra"] == 7
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_tree_counts_and_finds():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 8, 64):
        for n in (0, 1, 5, 63, 64, 65, 500):
            text = "".join(rng.choice(list("ab .é日"), n))
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            units = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
            blocks = infilling.Blocks(data, size)
            assert (blocks.units, blocks.points) == (len(units), len(text))
            assert [blocks.begins(i) for i in range(len(units) + 1)] == [*units, len(text)]
            point, unit = infilling.marks(data)
            for b in range(-(-len(data) // size) + 1):
                assert list(blocks.before(b)) == [unit[:b * size].sum(), point[:b * size].sum()]


def test_shares_of_forms_and_empty_table(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    n = {r["form"]: r["count"] for r in infilling.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] / 20_000 - 0.1) < 0.01 and abs(n["spm"] / (20_000 - n["plain"]) - 0.2) < 0.015
    assert infilling.fill_in_middle(docs.limit(0)).count() == 0
    same = infilling.fill_in_middle(docs, plain=0, spm=100).where("form != 'spm'")
    assert same.count() == 0
