"""Column expressions on texts shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: str | Column) -> Column:
    """128 bits that name a text: documents with equal texts share every decision on texts."""
    return F.md5(whole(text).cast("binary"))


def words(text: str | Column) -> Column:
    """Lower-case words, one blank between two: letters, digits and marks, anything else parts them."""
    return F.trim(F.regexp_replace(F.lower(whole(text)), r"[^\p{L}\p{N}\p{M}]+", " "))


def count_words(text: str | Column) -> Column:
    """Runs of characters other than blank, tab and line ends."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")
