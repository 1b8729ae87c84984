"""License scans: canonical digest lookup of entire texts.  DataFrame functions only.

A text is brought to a canonical form (case, punctuation and white space,
copyright lines, equivalent spellings) and the SHA-256 of the form is looked up
among the digests of known licences with a hash join.  Only whole texts match;
a licence inside a longer text has another digest.

The form is made of words, so that neither comment signs nor line widths
matter.  Copyright lines are left out by two rules without look-around, each in
time that grows with the text: a notice, up to words that begin a known
licence, wherever lines break; and a line that begins with a notice with sign
or year.  Texts without the word or the sign skip both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.licenses import LICENSES, OPENINGS

#: Known digests up to this number are broadcast (under 200 bytes each); more are joined by shuffle.
MAX_BROADCAST_LICENSES = 100_000
#: Words that the holders in front of a licence may have.
HOLDER_WORDS = 100

# Equivalent spellings in lower-case words with one blank around each, applied in this order.
SPELLINGS = (
    ("licence", "license"),
    (" sub license", " sublicense"),
    (" non infringement", " noninfringement"),
    (" favour", " favor"),
    (" honour", " honor"),
    (" organis", " organiz"),
    (" authoris", " authoriz"),
    (" recognis", " recogniz"),
    (" whilst ", " while "),
    (" merchantibility ", " merchantability "),
    (" https ", " http "),
    (" all rights reserved ", " "),
    (" copyrightsign ", " "),
)
# Words that no holder's name has; a notice does not reach over them.
SENTENCE_WORDS = ("may", "must", "shall", "not", "is", "are", "you", "any", "use")
SIGN, STOP = " copyrightsign ", "\x01"


def _opening(words: str) -> str:
    return r"[ \n]+".join((STOP if w in SENTENCE_WORDS else "") + w.replace("license", "licen[cs]e") for w in words.split())


# In both, every word has a blank of its own on either side; lines end with one \n, paragraphs with two.
NOTICE = rf" copyright(?:sign)? \n?(?: [^ \n{STOP}]+ \n?){{0,{HOLDER_WORDS}}}?[ \n]*((?:{'|'.join(map(_opening, OPENINGS))}) )"
LINE = r"(?m)^ (?:copyright  copyrightsign |copyrightsign  (?:copyright|[0-9]{4})|copyright  (?:by  )?[0-9]{4})[^\n]{0,300}$"
NOT_WORDS = r"[^\p{L}\p{N}]+"
NOT_WORDS_IN_LINES = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    signs = F.replace(F.replace(F.lower(text), F.lit("(c)"), F.lit(SIGN)), F.lit("©"), F.lit(SIGN))
    lines = F.regexp_replace(F.regexp_replace(signs, NOT_WORDS_IN_LINES, "  "), r" *\n *", "\n")
    lines = F.concat(F.lit(" "), F.replace(lines, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for word in SENTENCE_WORDS:
        lines = F.replace(lines, F.lit(f" {word} "), F.lit(f" {STOP}{word} "))
    lines = F.regexp_replace(F.regexp_replace(lines, NOTICE, " $1"), LINE, " ")
    words = F.regexp_replace(F.when(F.contains(signs, F.lit("copyright")), lines).otherwise(signs), NOT_WORDS, " ")
    form = F.concat(F.lit(" "), words, F.lit(" "))
    for spelling, plain in SPELLINGS:
        form = F.replace(form, F.lit(spelling), F.lit(plain))
    return F.trim(form)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, licenses=LICENSES) -> DataFrame:
    """license_digest, license_id: one row a digest, the smallest id of equal texts."""
    raw = spark.createDataFrame(list(licenses), "license_id string, license_text string")
    return raw.select(digest(F.col("license_text")).alias("license_digest"), "license_id").groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (hex SHA-256 of the canonical text), license_id (null if unknown) for every row of documents.

    licenses: license_digest, license_id (default: LICENSES).  Null texts have
    a null digest and no licence; texts without letters or digits have the
    digest of the empty form and no licence; null and repeated doc_ids are
    passed on; other columns are ignored; the time for a very long text or a
    very long line grows with its length; an empty table gives an empty result.
    """
    known = known_licenses(docs.sparkSession) if licenses is None else licenses
    known = known.filter(F.col("license_digest") != F.sha2(F.lit(""), 256))
    if known.limit(MAX_BROADCAST_LICENSES + 1).count() <= MAX_BROADCAST_LICENSES:
        known = F.broadcast(known)
    digests = docs.select(F.col("doc_id").cast("long"), digest(F.col("text").cast("string")).alias("digest"))
    return digests.join(known, F.col("digest") == F.col("license_digest"), "left").select("doc_id", "digest", "license_id")


def license_sql() -> str:
    """The same in SQL: forms of the documents and of the fixed texts, joined."""

    def form(text: str) -> str:
        signs = f"replace(replace(lower({text}), '(c)', '{SIGN}'), '©', '{SIGN}')"
        lines = f"regexp_replace(regexp_replace({signs}, '{NOT_WORDS_IN_LINES}', '  ', 'g'), ' *\\n *', chr(10), 'g')"
        lines = f"(' ' || replace({lines}, chr(10), ' ' || chr(10) || ' ') || ' ')"
        for word in SENTENCE_WORDS:
            lines = f"replace({lines}, ' {word} ', ' ' || chr(1) || '{word} ')"
        notice = NOTICE.replace(STOP, "\\x01")
        lines = f"regexp_replace(regexp_replace({lines}, '{notice}', ' \\1', 'g'), '{LINE}', ' ', 'g')"
        out = f"' ' || regexp_replace(CASE WHEN contains({signs}, 'copyright') THEN {lines} ELSE {signs} END, '{NOT_WORDS}', ' ', 'g') || ' '"
        for spelling, plain in SPELLINGS:
            out = f"replace({out}, '{spelling}', '{plain}')"
        return f"trim({out})"

    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in LICENSES)
    return f"""
WITH known AS (SELECT sha256({form("t")}) AS d, min(k) AS license_id FROM (VALUES {rows}) AS v(k, t) GROUP BY 1),
docs AS (SELECT doc_id, sha256({form("text")}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM docs LEFT JOIN known ON digest = d AND d <> sha256('')
"""
