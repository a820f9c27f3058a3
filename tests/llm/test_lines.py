from wordclips.llm import lines

KIND = "doc_id bigint, text string, source string, n_lines string, extra int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 7) for i, t, s in rows], KIND)


def _brute(rows, min_sites):
    """By the rule: boilerplate goes from every text; from a page copied only what other texts show as widely."""
    norm = lambda x: x.strip(" ").lower()
    sites, shown, apart = {}, {}, {}
    for _, t, s in rows:
        sites.setdefault(t or "", set()).add(s)
    copied = {t for t, found in sites.items() if len(found) >= min_sites}
    for t, found in sites.items():
        for x in t.split("\n"):
            if norm(x):
                shown.setdefault(norm(x), set()).update(found)
                apart.setdefault(norm(x), set()).update(() if t in copied else found)
    out = []
    for i, t, _ in rows:
        parts, page = (t or "").split("\n"), (t or "") in copied
        wide = apart if page else shown
        rest = [x for x in parts if len(wide.get(norm(x), ())) < min_sites]
        hits = len(parts) - len(rest)
        any_ = any(len(shown.get(norm(x), ())) >= min_sites for x in parts)
        out.append((i, "\n".join(rest) if hits else t, len(parts), hits, page and any_))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    own = "a line of its own that is long enough to be most of it "
    rows = [(i, f"Accept cookies \n{own}{i}\n\n  accept COOKIES", f"site{i % 12}") for i in range(60)]
    rows += [(100 + i, f"seen on few sites\n{own}{i + 100}", f"site{i % 3}") for i in range(20)]
    rows += [(200 + i, "one page\ncopied everywhere", f"site{i}") for i in range(12)]
    rows += [(300, None, None), (301, "", "site1"), (302, "\n\n", None), (302, "\n\n", None), (None, "Accept cookies\n" + own, None)]
    got = lines.remove_boilerplate(_docs(spark, rows), min_sites=8)
    have = sorted((tuple(r[c] for c in ("doc_id", "text", "n_lines", "n_removed", "whole_copy")) for r in got.collect()), key=repr)
    assert have == _brute(rows, 8)
    assert got.columns == ["doc_id", "text", "source", "extra", "n_lines", "n_removed", "whole_copy"]


def test_every_document_loses_its_boilerplate(spark):
    page = "one page\ncopied everywhere\nShared footer of all sites"
    rows = [(i, f"a line of its own {i}\nShared footer of all sites", f"s{i}") for i in range(10)]
    rows += [(20, "Shared footer of all sites\nown", "s0"), (21, "shared footer of all sites ", "s1")]
    rows += [(22 + i, "own twice\nShared footer of all sites", f"s{i}") for i in range(2)]
    rows += [(30 + i, page, f"s{i}") for i in range(9)]
    rows += [(40, "one page\nnot copied", "s0")]
    have = lines.remove_boilerplate(_docs(spark, rows), min_sites=8)
    assert sorted((tuple(r[c] for c in ("doc_id", "text", "n_lines", "n_removed", "whole_copy")) for r in have.collect()), key=repr) == _brute(rows, 8)
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["whole_copy"])
           for r in lines.remove_boilerplate(_docs(spark, rows), min_sites=8).collect()}
    want = {i: (f"a line of its own {i}", 1, False) for i in range(10)}
    want |= {20: ("own", 1, False), 21: ("", 1, False), 22: ("own twice", 1, False), 23: ("own twice", 1, False)}
    want |= {30 + i: ("one page\ncopied everywhere", 1, True) for i in range(9)}
    assert got == want | {40: ("not copied", 1, False)}


def test_near_the_threshold_counts_are_exact(spark):
    # Lines on 1 to 120 sites around a threshold of 60.
    rows = [(k * 1000 + s, f"line of {k} sites\n{'x' * 60} {k} {s}", f"s{s}") for k in range(40, 80) for s in range(k)]
    bad = lines.boilerplate(_docs(spark, rows), min_sites=60, log_k=6)
    assert bad.count() == 20


def test_empty_and_very_long(spark):
    assert lines.remove_boilerplate(_docs(spark, [])).count() == 0
    long = "\n".join(f"line {i}" for i in range(100_000))
    got = lines.remove_boilerplate(_docs(spark, [(1, long, "a")])).first()
    assert (got["n_lines"], got["n_removed"], got["text"]) == (100_000, 0, long)


def test_hot_names_are_dealt_out(spark):
    # A page that is a third of all rows, and one line on every row.
    rows = [(i, "the page\nits second line\nFooter", f"s{i % 40}") for i in range(400)]
    rows += [(1000 + i, f"a line of its own {i}\nFooter", f"s{i % 40}") for i in range(700)]
    rows += [(2000 + i, f"the page\nwith more {i}", f"s{i % 5}") for i in range(50)]
    got = lines.remove_boilerplate(_docs(spark, rows).repartition(7), min_sites=8)
    assert sorted((tuple(r[c] for c in ("doc_id", "text", "n_lines", "n_removed", "whole_copy")) for r in got.collect()), key=repr) == _brute(rows, 8)
    counts = spark.createDataFrame([(i, 1) for i in range(30_000)] + [(-1, 50_000), (-2, 30_000)], "k int, n int")
    assert {(r["k"], r["parts"]) for r in lines._hot(counts, ["k"]).collect()} == {(-1, 4546), (-2, 2728)}
    assert lines._hot(counts.limit(0), ["k"]).count() == 0
