"""Corpora on disk: loading, saving, checking and listing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FOLDER = "downloads/"


def relative_path(path) -> Column:
    """A file's path as stored: inside the downloads folder, forward slashes."""
    p = F.regexp_replace(path if isinstance(path, Column) else F.col(path), r"\\", "/")
    return F.when(p == "", p).otherwise(F.concat(F.lit(FOLDER), F.element_at(F.split(p, "/"), -1)))


def save_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a table by corpus, sorted in its files by where the clips are."""
    out = df.withColumn("source_file", relative_path("source_file")) if "source_file" in df.columns else df
    order = [c for c in ("source_id", "start_ms") if c in df.columns]
    if order:
        # Ranges of (corpus, place): a large source is spread over many files.
        out = out.repartitionByRange("corpus", *order).sortWithinPartitions("corpus", *order)
    out.write.mode(mode).partitionBy("corpus").parquet(path)


def load_corpus(spark: SparkSession, path: str, corpora: list[str] | None = None) -> DataFrame:
    """Read a table back; a list of corpora prunes the folders read."""
    df = spark.read.parquet(path)
    return df if corpora is None else df.where(F.col("corpus").isin(*corpora))


def audit_paths(clips: DataFrame) -> DataFrame:
    """Clips and files whose path another machine could not follow."""
    return clips.where(~F.col("source_file").like(FOLDER + "%")).groupBy().agg(
        F.count(F.lit(1)).alias("clips"), F.countDistinct("source_file").alias("files"))


def validate_schema(df: DataFrame, required: StructType, keys: list[str]) -> DataFrame:
    """One row per requirement with how many rows break it."""
    spark = df.sparkSession
    have = {f.name: f.dataType for f in df.schema.fields}
    shape = [(f"column {f.name}", int(f.name not in have or have[f.name] != f.dataType)) for f in required.fields]
    present = [k for k in keys if k in have]
    counts = df.agg(*[F.sum(F.col(k).isNull().cast("bigint")).alias(k) for k in present]) if present else None
    out = spark.createDataFrame(shape, "requirement string, broken bigint")
    if counts is not None:
        out = out.unionByName(counts.select(F.explode(F.array(*[F.struct(
            F.lit(f"not null {k}").alias("requirement"), F.coalesce(k, F.lit(0)).alias("broken")) for k in present])).alias("r")).select("r.*"))
    return out


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes per top-level member of a bundle, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    root = path.rstrip("/")
    top = F.regexp_extract(F.regexp_replace("path", "^file:/*", "/"), "^" + root + "/([^/]+)", 1)
    return files.groupBy(top.alias("member")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def upgrade(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """Add the columns ``schema`` has and ``df`` lacks; never alter the others."""
    have = set(df.columns)
    add = {f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in schema.fields if f.name not in have}
    return df.withColumns(add) if add else df


def corpora_totals(clips: DataFrame, sources: DataFrame, settings: DataFrame) -> DataFrame:
    """Every corpus with its clips, words, sources and settings."""
    # Distinct words first, per corpus and word, so that a large corpus is many groups.
    words = clips.groupBy("corpus", "word").agg(F.count(F.lit(1)).alias("c")).groupBy("corpus").agg(
        F.sum("c").alias("clips"), F.count(F.lit(1)).alias("words"))
    src = sources.groupBy("corpus").agg(F.count(F.lit(1)).alias("sources"))
    kept = settings.groupBy("corpus").pivot("key", ["splice_mode", "max_units", "schema_version"]).agg(F.first("value"))
    return src.join(words, "corpus", "left").join(kept, "corpus", "left").select(
        "corpus", F.coalesce("clips", F.lit(0)).alias("clips"), F.coalesce("words", F.lit(0)).alias("words"), "sources",
        "splice_mode", F.col("max_units").cast("int").alias("max_units"),
        F.coalesce(F.col("schema_version").cast("int"), F.lit(0)).alias("schema_version"))
