"""Column builders with the Unicode semantics of the corpus tools: white space, words, normal forms, hashes."""

from __future__ import annotations

import sys
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space as a Java character class; plain \s is ASCII.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

def words(text: Column) -> Column:
    """Words between white space, none empty."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def strip(text: Column, chars: str = SPACE) -> Column:
    return F.regexp_replace(text, rf"\A{chars}+|{chars}+\z", "")


@cache
def _upper_letters() -> tuple[str, str]:
    """All letters that are not their own upper case, and the one letter that is it.

    ß has the capital ẞ, Greek letters with an iota below have the title form, ligatures stay.
    """
    one = lambda c: "ẞ" if c == "ß" else next((u for u in (c.upper(), c.title()) if len(u) == 1), c)
    pairs = [(c, one(c)) for c in map(chr, range(sys.maxunicode + 1)) if c.upper() != c]
    pairs = [(c, u) for c, u in pairs if u != c]
    return "".join(c for c, _ in pairs), "".join(u for _, u in pairs)


def upper_by_letter(text: Column) -> Column:
    """Upper case with one letter for each letter, as DuckDB's upper; F.upper makes SS of ß and FI of ﬁ."""
    return F.translate(text, *_upper_letters())


@F.arrow_udf(StringType())
def _decomposed(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_normalize(text, form="NFKD"), pattern=r"\p{Mn}+", replacement="")


def strip_accents(text: Column) -> Column:
    """The compatibility decomposition (NFKD) without non-spacing marks; plain ASCII texts are not sent to Python."""
    return F.coalesce(_decomposed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize(text: Column) -> Column:
    """Without accents, lower case, runs of white space as one blank, then without punctuation, stripped.

    Punctuation goes after the blanks, so "a - b" keeps two blanks.
    """
    plain = F.regexp_replace(F.lower(strip_accents(text)), SPACE + "+", " ")
    return strip(F.regexp_replace(plain, rf"[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]", ""))


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once; inside a lambda an expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ngrams(w: Column, n: int) -> Column:
    """Distinct runs of n words joined by blanks; fewer words make one run, no words an empty one."""

    def runs(x: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1)))
        return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(x, i, n), " ")))

    # slicing an array of a stored row unpacks all of it each time; that of a function's result does not
    return let(F.transform(w, lambda x: x), runs)


def exact_hash(text: Column) -> Column:
    """md5 of the lower-case words joined by blanks."""
    return F.md5(F.array_join(words(F.lower(text)), " "))


def split_value(text: Column) -> Column:
    """A number in [0, 1) from the md5 of the first 500 characters."""
    head = F.md5(F.substring(text, 1, 500).cast("binary"))
    return F.conv(F.substring(head, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def hash_order(seed: str, *keys: Column | str) -> Column:
    """A number that orders rows at random, the same on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *keys)), 1, 15), 16, 10).cast("long")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))
