"""Cross-site boilerplate lines, found by how many distinct sites show them.

Texts are read once, into a table of line hashes per different text and site.
A HyperLogLog sketch of sites per line hash merges by aggregation, so a line on
every page costs one small row per task.  Lines whose estimate lies near the
threshold get an exact count of distinct sites; the others are decided by it.

Only lines with as many rows as sites are asked for can reach the threshold; the
others go before any sketch is made.  Of the rest, those with very many rows are
few by arithmetic (HOT); joins deal their rows out over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordclips.llm.catalog import query, table
from wordclips.llm.text import text_key, whole
from wordclips.session import stored

#: Production parameter: sites that make a line boilerplate.
MIN_SITES = 8
#: Names with more than one in HOT of all rows are dealt out in joins: fewer than HOT of them can be.
HOT = 10_000


def normal(line: Column) -> Column:
    """What makes two lines the same: letters' case and outer blanks don't count."""
    return F.lower(F.trim(line))


def _site(site: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("?"))


def _hashes(line: Column) -> list[Column]:
    # 96 bits from two functions: no two lines of a corpus are taken for one.
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def _shown(docs: DataFrame, site: str) -> DataFrame:
    """Each different text once per site: key, site, lines (at, h1, h2 of those that are not blank)."""
    line = F.filter(F.transform(F.split(whole("text"), "\n"), lambda x, i: F.struct(i.alias("at"), normal(x).alias("line"))),
                    lambda x: x["line"] != "")
    rows = docs.select(text_key("text").alias("key"), _site(site).alias("site"), F.transform(
        line, lambda x: F.struct(x["at"].alias("at"), *_hashes(x["line"]))).alias("lines"))
    return rows.groupBy("key", "site").agg(F.max("lines").alias("lines"))


def _hot(counts: DataFrame, names: list[str]) -> DataFrame:
    """Names with more than one in HOT of all that n of ``counts`` adds up to, and in how many parts to deal their rows.

    Fewer than HOT names, with fewer than 2 * HOT parts in all.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    share = F.col("n") * HOT / F.col("all")
    return stored(counts.crossJoin(F.broadcast(total)).where(share > 1).select(      # one row
        *names, F.ceil(share).cast("int").alias("parts")), "hot")


def _meet(rows: DataFrame, found: DataFrame, hot: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found`` on ``names``; rows of a hot name are dealt out over its parts, and it is repeated for each."""
    known, parts = F.broadcast(hot), F.coalesce("parts", F.lit(1))
    mine = rows.join(known, names, "left").withColumn("__part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("parts")
    theirs = found.join(known, names, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return mine.join(theirs, [*names, "__part"], how).drop("__part")


def _candidates(shown: DataFrame, min_sites: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, site, copied, at, h1, h2) of lines that enough rows show, and the hot lines among them."""
    each = shown.select("key", "site", "copied", F.explode("lines").alias("x")).select("key", "site", "copied", "x.at", "x.h1", "x.h2")
    counts = stored(each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites), "often")
    hot = _hot(counts, ["h1", "h2"])
    return stored(_meet(each, counts.select("h1", "h2"), hot, ["h1", "h2"], "left_semi"), "lines"), hot


def _spread(rows: DataFrame, hot: DataFrame, min_sites: int, log_k: int) -> DataFrame:
    spread = rows.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_k))).alias("sites"))
    margin = max(2.0, 5 * 1.04 / 2 ** (log_k / 2) * min_sites)
    clear = spread.where(F.col("sites") > min_sites + margin).select("h1", "h2")
    near = spread.where(F.col("sites").between(min_sites - margin, min_sites + margin)).select("h1", "h2")
    exact = _meet(rows, near, hot, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(
        F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return clear.unionByName(exact.select("h1", "h2"))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES,
                log_k: int = 10) -> DataFrame:
    """Hashes (h1, h2) of the lines that ``min_sites`` distinct sites or more show.

    A null site counts as one site.  Estimates further from ``min_sites`` than
    five standard errors of the sketch (and than two sites) are trusted.
    """
    rows, hot = _candidates(stored(_shown(docs, site).withColumn("copied", F.lit(False)), "shown"), min_sites)
    return _spread(rows, hot, min_sites, log_k)


def _hits(docs: DataFrame, site: str, min_sites: int, log_k: int = 10) -> DataFrame:
    """Per key of a text with boilerplate: the places of lines to remove (hits) and whether it is a page copied (copied)."""
    names = ["h1", "h2"]
    shown = stored(_shown(docs, site), "shown")
    copies = shown.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    told = _meet(shown, copies.select("key", F.lit(True).alias("copied")), _hot(copies, ["key"]), ["key"], "left")
    rows, hot = _candidates(told.withColumn("copied", F.col("copied").isNotNull()), min_sites)
    found = stored(_meet(rows, _spread(rows, hot, min_sites, log_k), hot, names, "left_semi"), "found")
    single = found.where(~F.col("copied"))
    apart = single.groupBy(*names).agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    paged = found.where("copied").select("key", "at", *names).distinct()
    paged = _meet(paged, apart.select(*names, F.lit(True).alias("apart")), hot, names, "left")
    hits = single.select("key", "at", "copied").unionByName(paged.select(
        "key", F.when(F.col("apart"), F.col("at")).alias("at"), F.lit(True).alias("copied"))).groupBy("key").agg(
        F.collect_set("at").alias("hits"), F.bool_or("copied").alias("copied"))
    return stored(hits, "hits")             # so that the join with texts can be split where a text is copied often


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` (text and a site column) with boilerplate lines taken out of ``text``.

    Adds n_lines, n_removed and whole_copy; other columns stay, also equally
    named ones.  Lines are parted by ``\\n``; blank lines are never boilerplate.
    Every document loses its boilerplate, whatever its share.  A text that
    ``min_sites`` distinct sites or more show as a whole is a page copied
    (whole_copy): its lines are on as many sites for that alone, so it loses only
    those that as many sites show in texts that are no such copies; the
    near-duplicate stage judges the copies.  A null text counts as empty and has
    one line.  Documents with equal texts lose the same lines.
    """
    hits = _hits(docs, site, min_sites)
    parts = F.split(whole("text"), "\n")
    keyed = docs.withColumn("__key", text_key("text"))
    joined = keyed.join(hits.select(F.col("key").alias("__key"), F.col("hits").alias("__hits"), F.col("copied").alias("__copy")),
                        "__key", "left") \
        .withColumn("__parts", parts) \
        .withColumn("__map", F.when(F.size("__hits") > 0, F.map_from_entries(
            F.transform("__hits", lambda i: F.struct(i, F.lit(True))))))
    is_hit = lambda i: F.coalesce(F.try_element_at("__map", i), F.lit(False))
    kept = F.when(F.col("__map").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter("__parts", lambda x, i: ~is_hit(i)), "\n"))
    removed = F.when(F.col("__map").isNull(), F.lit(0)).otherwise(F.size("__hits"))
    mine = ("n_lines", "n_removed", "whole_copy")
    return joined.select(
        *[kept.alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in mine],
        F.size("__parts").cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed"),
        F.coalesce("__copy", F.lit(False)).alias("whole_copy"))


OP7_SQL = f"""
WITH parts AS (
  SELECT doc_id, coalesce(source, '?') AS site, coalesce(text, '') AS text FROM documents),
copies AS (SELECT text FROM parts GROUP BY text HAVING count(DISTINCT site) >= {MIN_SITES}),
told AS (SELECT p.*, c.text IS NOT NULL AS copied FROM parts p LEFT JOIN copies c USING (text)),
each AS (
  SELECT doc_id, site, copied, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM told),
seen AS (
  SELECT lower(trim(line, ' ')) AS line, count(DISTINCT site) AS sites, count(DISTINCT site) FILTER (WHERE NOT copied) AS apart
  FROM each WHERE trim(line, ' ') <> '' GROUP BY 1),
marked AS (
  SELECT doc_id, copied, pos, e.line, coalesce(s.sites >= {MIN_SITES}, false) AS bad,
         coalesce(CASE WHEN copied THEN s.apart ELSE s.sites END >= {MIN_SITES}, false) AS hit
  FROM each e LEFT JOIN seen s ON lower(trim(e.line, ' ')) = s.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_removed, bool_or(copied AND bad) AS whole_copy,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op7_line_spread", OP7_SQL)
def op7_line_spread(spark, sf_dir):
    """Every document: its lines, those removed, and the digest of the text kept."""
    out = remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "whole_copy",
                      F.sha2(whole("text").cast("binary"), 256).alias("kept_sha256"))
