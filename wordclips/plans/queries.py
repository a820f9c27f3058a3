"""All registered queries; importing the modules below registers them."""

from wordclips.plans import (  # noqa: F401
    q_corpus,
    q_health,
    q_index,
    q_phrases,
    q_songs,
    q_sound,
    q_splice,
)
from wordclips.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
