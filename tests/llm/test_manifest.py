import hashlib

import pytest
from pyspark.sql import functions as F

from wordclips.llm import manifest

KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string, extra string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _levels(nodes, fan):
    """All levels of a tree, the leaves' first."""
    out = [nodes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([_h(*now[i:i + fan]) for i in range(0, len(now), fan)])
    return out


def _path(levels, at, fan):
    out = []
    for level in levels[:-1]:
        lo = at // fan * fan
        out.append(("".join(level[lo:at]), "".join(level[at + 1:lo + fan])))
        at //= fan
    return out


def _brute(rows, fan):
    """Rows of COLUMNS -> sorted (doc_id, leaf, path, subroot, root)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], _leaf(*r)))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        by[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = _levels([x[1] for x in by[g]], fan)
    top = _levels([trees[g][-1][0] for g in groups], fan)
    return sorted(((i, d, _path(trees[g], n, fan) + _path(top, k, fan), trees[g][-1][0], top[-1][0])
                   for k, g in enumerate(groups) for n, (i, d) in enumerate(by[g])), key=repr)


def _grown(spark, rows, fan, chunk):
    docs = spark.createDataFrame([(*r, "kept") for r in rows], KIND).repartition(5)
    leaves = docs.select("doc_id", "lang", "extra", manifest.leaf(*manifest.COLUMNS).alias("leaf"))
    out = manifest.grow(leaves, "doc_id", "lang", fan, chunk)
    assert out.columns == ["doc_id", "lang", "extra", "leaf", "path", "subroot", "root"]
    return out


ODD = [(None, None, None, None, None), (7, None, "de", None, ""), (7, "s", "de", 3, "añb"), (7, "s", "de", 3, "añb"),
       (8, "s", "", 0, None), (9, "s", "é", 1, "x" * 300_000)]


@pytest.mark.parametrize("fan, chunk", [(2, 4), (2, 1024), (3, 9), (5, 7)])
def test_against_brute_force(spark, fan, chunk):
    rows = [((i * 37) % 211 - 50, f"s{i % 3}", ["en", "fr", "en", "z", "en"][i % 5], i, f"text {i}") for i in range(150)] + ODD
    out = _grown(spark, rows, fan, chunk)
    got = sorted(((r["doc_id"], r["leaf"], [(x["left"], x["right"]) for x in r["path"]], r["subroot"], r["root"])
                  for r in out.collect()), key=repr)
    assert got == _brute(rows, fan)
    # Every leaf leads to the root, a changed one doesn't.
    found = out.select(manifest.folded(F.col("leaf"), "path").alias("a"), manifest.folded(F.sha2(F.col("leaf").cast("binary"), 256), "path").alias("b"), "root")
    assert found.where("a != root or b = root").count() == 0


def test_lone_and_empty(spark):
    assert _grown(spark, [], 2, 1024).count() == 0
    one = _grown(spark, [(5, "s", None, 1, "a")], 2, 1024).first()
    assert one["leaf"] == one["subroot"] == one["root"] == _leaf(5, "s", None, 1, "a") and one["path"] == []


def test_clashing_columns_are_told(spark):
    leaves = spark.createDataFrame([(1, "a", "x", 2)], "doc_id bigint, lang string, leaf string, pos int")
    with pytest.raises(ValueError, match="pos"):
        manifest.grow(leaves, "doc_id", "lang")
    with pytest.raises(ValueError):
        manifest.grow(leaves.drop("pos"), "doc_id", "lang", fan=1)


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(i, "s", "en", None if i % 9 == 0 else i, f"t{i}") for i in range(60)] + ODD
    spark.createDataFrame([(*r, "clash") for r in rows], KIND.replace("extra", "leaf")).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib
    got = {(r["doc_id"], r["leaf"]): r for r in manifest.op13_merkle_manifest(spark, str(tmp_path)).collect()}
    for i, d, path, sub, root in _brute(rows, 2):
        r = got[i, d]
        assert (r["subroot"], r["root"], r["proof_sha256"]) == (sub, root, _h(*[a + b for a, b in path]))
        row = next(x for x in rows if x[0] == i and _leaf(*x) == d)
        changed = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and row[3] is not None
        assert r["verified"] == (not changed) and (r["folded_root"] == root) == r["verified"]
