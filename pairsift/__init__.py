"""Spark operators for curating and evaluating parallel (sentence-pair) corpora."""

from pairsift.profile import LangProfile, ENGLISH_OCCITAN

__all__ = ["LangProfile", "ENGLISH_OCCITAN"]
