"""All queries of this subpackage; importing the modules below registers them."""

from wordclips.llm import (  # noqa: F401
    chats,
    decontaminate,
    fingerprints,
    infilling,
    langid,
    lines,
    manifest,
    mixing,
    ngram_join,
    quality,
    substrings,
    toxicity,
    urls,
)
from wordclips.llm.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
