"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``; columns beyond those are not asked for and don't
reach the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordclips.llm import decontaminate, langid, lines, mixing, ngram_join
from wordclips.llm.catalog import table
from wordclips.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; it learns from those with a language given."""
    return langid.reject_unknown(docs.select(*COLUMNS), langid.fit(docs))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites show are taken out; n_chars follows the text, every document stays."""
    out = lines.remove_boilerplate(docs.select(*COLUMNS))
    kind = docs.schema["n_chars"].dataType
    size = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).select(*COLUMNS)


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest doc_id."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it (repeat: 1, 2)."""
    return mixing.mixed(docs.select(*COLUMNS))


STAGES = [
    ("language", known_language),
    ("lines", without_boilerplate),
    ("near_duplicates", one_per_class),
    ("benchmark", without_benchmark),
    ("mix", mix_sources),
]

#: The first stage is a trained network: no SQL says what it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
