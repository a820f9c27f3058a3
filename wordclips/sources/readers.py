"""Reading transcripts, captions, note events, pronunciations and wiki pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordclips import schemas
from wordclips.functions.text import clean_word


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def transcript_words(transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips, rejected) of word-timed transcripts (S1), times in ms.

    ``transcripts`` is (source_id, segments).  Words that are only punctuation
    are dropped; times that are not finite, negative or reversed are rejected.
    """
    w = transcripts.select("source_id", F.posexplode("segments").alias("s", "seg")) \
        .select("source_id", "s", F.posexplode("seg.words").alias("k", "w")) \
        .select("source_id", "s", "k", clean_word("w.word").alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("end")) \
        .where(F.col("word") != "")
    good = _finite(F.col("start")) & _finite(F.col("end")) & (F.col("start") >= 0) & (F.col("start") < F.col("end"))
    good = F.coalesce(good, F.lit(False))
    clips = w.where(good).select("source_id", "s", "k", "word", F.round(F.col("start") * 1000).cast("bigint").alias("start_ms"),
                                 F.round(F.col("end") * 1000).cast("bigint").alias("end_ms"))
    return clips, w.where(~good)


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return transcript_words(spark.read.schema(schemas.TRANSCRIPT).json(path))


def caption_words(captions: DataFrame) -> DataFrame:
    """(source_id, word, t_ms) of timed captions, several words of a segment at its time."""
    seg = captions.select("source_id", F.posexplode("events").alias("e", "ev")) \
        .select("source_id", "e", F.col("ev.tStartMs").alias("t0"), F.posexplode("ev.segs").alias("s", "seg"))
    t = F.coalesce("t0", F.lit(0.0)) + F.coalesce("seg.tOffsetMs", F.lit(0.0))
    w = seg.where(F.col("seg.utf8").isNotNull()).select("source_id", "e", "s", t.alias("t"), F.posexplode(F.split("seg.utf8", r"\s+")).alias("k", "raw"))
    out = w.where(_finite(F.col("t")) & (F.col("t") >= 0)).select(
        "source_id", "e", "s", "k", clean_word("raw").alias("word"), F.round("t").cast("bigint").alias("t_ms"))
    return out.where(F.col("word") != "")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return caption_words(spark.read.schema(schemas.CAPTIONS).json(path)).sort("source_id", "t_ms", "e", "s", "k")


def read_pronunciations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """User pronunciation files as (layer, line, word, value), the last path on top (S3).

    Lines are numbered by their place in the file: one file is read as one
    partition, a user's file being short.
    """
    out = None
    for layer, path in enumerate(paths):
        df = spark.read.schema(schemas.PRONUNCIATIONS).option("comment", "#").csv(path).coalesce(1)
        df = df.select(F.lit(layer).alias("layer"), F.monotonically_increasing_id().alias("line"), "word", "value").where(F.col("value").isNotNull())
        out = df if out is None else out.unionByName(df)
    return out


def read_midi_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Decoded note events, typed."""
    reader = spark.read.schema(schemas.MIDI_EVENTS)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def parse_wiki_sections(pages: DataFrame) -> DataFrame:
    """(page_id, k, title, body) of each ``==title==`` section, markup taken off."""
    head = r"(?m)^==(?!=)[ \t]*(.+?)(?<!=)==[ \t]*$"
    marked = F.regexp_replace("text", head, "\u0001$1\u0002")
    parts = F.slice(F.split(marked, "\u0001"), F.lit(2), F.size(F.split(marked, "\u0001")))
    p = pages.select("page_id", F.posexplode(parts).alias("k", "part"))
    body = F.element_at(F.split("part", "\u0002", 2), -1)
    for pattern, new in ((r"(?m)^=+.*?=+[ \t]*$", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"),
                         (r"\{\{[^}]*\}\}", " "), (r"<[^>]+>", " "), ("'''", ""), ("''", ""), (r"[ \t]+", " "), (r"^\s+|\s+$", "")):
        body = F.regexp_replace(body, pattern, new)
    return p.select("page_id", "k", F.trim(F.element_at(F.split("part", "\u0002", 2), 1)).alias("title"), body.alias("body")) \
        .where(F.col("body") != "")
