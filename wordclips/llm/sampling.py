"""Bounded samples of labelled rows, for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SPAN = 1 << 40


def per_label(rows: DataFrame, label: str, n: int, by: list[str]) -> DataFrame:
    """At most ``n`` rows of each value of ``label``, chosen by hash of the columns ``by``.

    Rows of each label are counted first (one number per label comes to the
    driver, as the model will have more than that), and a hash keeps about one
    and a half times ``n`` of them before any are ranked: no label's rows are
    ever gathered, and the choice is the same each time.
    """
    counts = {r[label]: r["count"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, (1.5 * n + 50) / c))])
    marked = rows.withColumn("__mark", F.pmod(F.xxhash64(*by), F.lit(_SPAN)))
    near = marked.where(F.col("__mark") < F.element_at(share, F.col(label)) * _SPAN)
    turn = F.row_number().over(Window.partitionBy(label).orderBy("__mark", *by))
    return near.withColumn("__turn", turn).where(F.col("__turn") <= n).drop("__mark", "__turn")
