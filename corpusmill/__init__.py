"""Corpus analytics on Spark: cleaning, scoring, deduplication, mixing, evaluation and reports."""

__version__ = "0.1.0"
