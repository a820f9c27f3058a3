"""Spark-native analytics over corpora of timed words, sounds and notes."""

from wordclips.session import build_session

__all__ = ["build_session"]
