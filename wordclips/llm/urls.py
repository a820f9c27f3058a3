"""URL filter: fixed rules, and a character language-model ratio for what no rule judges.

URLs that a rule allows or blocks teach two Markov models of variable order,
smoothed by Witten-Bell interpolation: a context is trusted by how often it was
seen against how many different characters followed it.  A URL's score is the
difference of its log-likelihoods under both, divided by its length.  The score
at which it is allowed is calibrated on ruled URLs kept out of the models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordclips.llm.catalog import query, table
from wordclips.session import stored

#: (verdict, rule): a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Characters of context at most; one in CALIBRATION forms is kept out of the models.
ORDER, CALIBRATION = 4, 5
_START, _END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def host(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def ruled(rules: Sequence[tuple[str, str]], host_: Column, path_: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; of equally long ones the last."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        site, slash, rest = rule.partition("/")
        fits = ((host_ == site) | host_.endswith("." + site)) & path_.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def form(url: str) -> Column:
    """What the models read of a URL: host, path and the rest in lower case, every digit as 0; null: empty."""
    rest = F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    return F.regexp_replace(F.lower(F.concat(host(url), path(url), rest)), r"\d", "0")


def ratios(forms: DataFrame, order: int = ORDER) -> DataFrame:
    """form, score from ``forms``: distinct form with allowed, blocked (training weights, 0 for none).

    Grams are counted over all forms; every table is keyed by grams or contexts
    and joined, none is collected or broadcast by request.
    """
    padded = F.concat(F.lit(_START * order), "form", F.lit(_END))
    grams = F.regexp_extract_all(padded, F.lit(r"(?s)(?=(.{%d}))" % (order + 1)), F.lit(1))
    said = stored(forms.select("form", "allowed", "blocked", F.explode(grams).alias("gram"))
                  .groupBy("form", "gram", "allowed", "blocked").agg(F.count(F.lit(1)).alias("m")), "grams")
    whole_grams = said.groupBy("gram").agg(F.sum(F.col("m") * F.col("allowed")).alias("a"),
                                           F.sum(F.col("m") * F.col("blocked")).alias("b"))
    whole_grams = stored(whole_grams, "grams")
    orders = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.right("gram", F.lit(o + 1)).alias("tail"))
                                 for o in range(order + 1)])).alias("t")
    tails = whole_grams.select("a", "b", orders).groupBy("t.o", "t.tail").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    before = F.expr("left(tail, o)")
    tails = tails.withColumn("context", before)
    contexts = tails.groupBy("o", "context").agg(
        F.sum("a").alias("na"), F.count_if(F.col("a") > 0).alias("ta"),
        F.sum("b").alias("nb"), F.count_if(F.col("b") > 0).alias("tb"))
    model = tails.join(contexts, ["o", "context"]).select("o", "tail", "a", "na", "ta", "b", "nb", "tb")
    expanded = whole_grams.select("gram", orders).select("gram", "t.o", "t.tail").join(model, ["o", "tail"])
    steps = expanded.groupBy("gram").agg(F.sort_array(F.collect_list(
        F.struct("o", "a", "na", "ta", "b", "nb", "tb"))).alias("steps"))      # order + 1 of them

    def likelihood(c: str, n: str, t: str) -> Column:
        # From the empty context to the longest: a context never seen leaves what shorter ones say.
        return F.aggregate("steps", F.lit(1.0 / 256), lambda p, s: F.when(
            s[n] > 0, (s[c] + s[t] * p) / (s[n] + s[t])).otherwise(p))

    weighed = steps.select("gram", (F.log(likelihood("a", "na", "ta")) - F.log(likelihood("b", "nb", "tb"))).alias("ratio"))
    return said.join(weighed, "gram").groupBy("form").agg(
        (F.sum(F.col("m") * F.col("ratio")) / F.sum("m")).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row, cut: the score from which URLs are allowed.

    ``scored`` has score, allowed and blocked (weights of forms kept out of the
    models).  Scores are put in bins of a hundredth; the cut is that with the
    fewest wrong verdicts, both kinds of URL weighing the same, and the nearest
    to 0 among equals.  0 where either kind is missing.
    """
    bins = scored.groupBy(F.round("score", 2).alias("at")).agg(
        F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    below = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    wrong = (F.coalesce(F.sum("allowed").over(below), F.lit(0)) / F.sum("allowed").over(every)
             + (F.sum("blocked").over(every) - F.coalesce(F.sum("blocked").over(below), F.lit(0)))
             / F.sum("blocked").over(every))
    both = (F.sum("allowed").over(every) > 0) & (F.sum("blocked").over(every) > 0)
    costs = bins.select("at", F.when(both, wrong).alias("wrong"))
    return costs.agg(F.coalesce(F.min_by("at", F.when(F.col("wrong").isNotNull(), F.struct(
        "wrong", F.abs("at"), "at"))), F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score, cut for each row of ``pages`` (page_id, url).

    Null URLs and those without ``://`` have an empty host and path; no rule
    fits them and the models judge the empty form.  With no ruled URL of either
    kind all scores are 0 and the verdict is allow.  Equal URLs have equal rows.
    """
    rows = pages.select("page_id", host("url").alias("host"), path("url").alias("path"), form("url").alias("form"))
    rows = rows.withColumn("by_rule", ruled(rules, F.col("host"), F.col("path")))
    kept = F.pmod(F.xxhash64("form"), F.lit(CALIBRATION)) == 0
    said = F.col("by_rule.verdict")
    forms = rows.groupBy("form").agg(F.count_if(said == "allow").alias("allow"), F.count_if(said == "block").alias("block"))
    forms = stored(forms.select("form", "allow", "block", kept.alias("kept")), "forms")
    none = F.lit(0).cast("bigint")
    taught = forms.select("form", F.when(F.col("kept"), none).otherwise(F.col("allow")).alias("allowed"),
                          F.when(F.col("kept"), none).otherwise(F.col("block")).alias("blocked"))
    scored = forms.join(ratios(taught, order), "form")
    cut = threshold(scored.where("kept").select("score", F.col("allow").alias("allowed"), F.col("block").alias("blocked")))
    known = scored.select("form", "score").crossJoin(F.broadcast(cut))      # one row
    return rows.join(known, "form").select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"),
        F.coalesce(said, F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block")).alias("verdict"),
        "score", "cut")


@query("op6_url_filter")
def op6_url_filter(spark, sf_dir):
    """Contract: page_id, host, path, rule, verdict (and score, cut)."""
    return judge(table(spark, sf_dir, "pages"))
