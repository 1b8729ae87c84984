"""Length filter, cleaning and hash split of raw documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import SPACE, split_value, strip

MIN_CHARS, MAX_CHARS = 100, 500_000
EMAIL_MARK = "[EMAIL]"


def length_filter(docs: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS, text: str = "text") -> DataFrame:
    """Rows whose raw text has least to most characters."""
    return docs.filter(F.length(text).between(least, most))


def redact_email(text: Column) -> Column:
    """Runs of black characters with an @ and a later dot inside.

    A run that does not match from its first character does not match from
    a later one, so each run is tried once.
    """
    black = "[^" + SPACE[1:]
    return F.regexp_replace(text, rf"(?<!{black}){black}[^@{SPACE[1:-1]}]*+@{black}+\.{black}+", EMAIL_MARK)


def clean(text: Column, collapse: bool = True, redact: bool = True) -> Column:
    """Blanks and tabs as one blank, three line ends or more as two, e-mail addresses redacted; always stripped."""
    if collapse:
        text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    if redact:
        text = redact_email(text)
    return strip(text)


def clean_docs(docs: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS, collapse: bool = True, redact: bool = True) -> DataFrame:
    """The length filter reads raw texts, so it comes first."""
    return length_filter(docs, least, most).withColumn("text", clean(F.col("text"), collapse, redact))


def assign_split(docs: DataFrame, val_ratio: float, text: str = "text") -> DataFrame:
    """split: val if the text's hash value is below val_ratio, else train."""
    return docs.withColumn("split", F.when(split_value(F.col(text)) < val_ratio, "val").otherwise("train"))


def curriculum(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shortest text first."""
    return docs.orderBy(F.length(text), key)
