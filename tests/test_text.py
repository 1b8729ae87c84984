import hashlib
import random
import re
import time
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import cleaning, quality

TRAPS = [
    "", " ", "a b c", " lead trail ", "a\x1cb\u0085c", "café não", "İ ß ǅ", "😀 astral 😀", "²³ ½ Ⅳ ª º Ⓐ", "é123.456.789-09", "\r\n\r\n\r\nx", "\n\n\n\ny", "a - b",
    "mail me: a.b@c.de, now", "Uma frase. Outra! Mais?!", "tabs\t\tand  blanks", "snake_case ok",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TRAPS)), "doc_id long, text string")


def get(rows, column):
    return [r[0] for r in rows.orderBy("doc_id").select(column).collect()]


def test_words_and_strip_are_unicode(rows):
    assert get(rows, tx.words(F.col("text"))) == [t.split() for t in TRAPS]
    assert get(rows, tx.strip(F.col("text"))) == [t.strip() for t in TRAPS]


def test_normalize(rows):
    def expected(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn").lower()
        return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", t)).strip()

    got = get(rows, tx.normalize(F.col("text")))
    assert got == [expected(t) for t in TRAPS]
    assert got[TRAPS.index("a - b")] == "a  b"
    rng = random.Random(1)
    more = ["ő ş Ạ Ế ﬁn Ａｂｃ №5 ½ ẞ ﷺ 가 ⅷ", "पी कि"] + ["".join(chr(rng.choice([rng.randrange(0x80, 0x530), rng.randrange(0x1E00, 0x2200), 32])) for _ in range(40)) for _ in range(60)]
    more = ["".join(c for c in t if unicodedata.category(c) not in ("Cn", "Cc")) for t in more]
    rows = rows.sparkSession.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    assert get(rows, tx.normalize(F.col("text"))) == [expected(t) for t in more]


def test_upper_case_by_letter_equals_that_of_sql(spark):
    text = "".join(chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000)
    got = get(spark.createDataFrame([(0, text), (1, "aß😀ﬁ\u1fb3"), (2, None)], "doc_id long, text string"), tx.upper_by_letter(F.col("text")))
    assert got[0] == duckdb.execute("SELECT upper(?)", [text]).fetchall()[0][0]
    assert got[1:] == ["Aẞ😀ﬁ\u1fbc", None]


def test_ngrams_and_hashes(rows):
    def grams(t, n):
        w = t.split()
        return [" ".join(w)] if len(w) < n else list(dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))

    assert get(rows, tx.ngrams(tx.words(F.col("text")), 2)) == [grams(t, 2) for t in TRAPS]
    assert get(rows, tx.exact_hash(F.col("text"))) == [hashlib.md5(" ".join(t.lower().split()).encode()).hexdigest() for t in TRAPS]
    value = lambda t: int(hashlib.md5(t[:500].encode()).hexdigest()[:16], 16) / 2**64
    assert get(rows, tx.split_value(F.col("text"))) == [value(t) for t in TRAPS]


def test_cleaning(spark, rows):
    def expected(t):
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t))
        return re.sub(r"\S+@\S+\.\S+", "[EMAIL]", t).strip()

    assert get(rows, cleaning.clean(F.col("text"))) == [expected(t) for t in TRAPS]
    assert get(rows, cleaning.clean(F.col("text"), False, False)) == [t.strip() for t in TRAPS]
    sizes = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((99, 100, 101, 500_000, 500_001))], "doc_id long, text string")
    assert [r["doc_id"] for r in cleaning.length_filter(sizes).collect()] == [1, 2, 3]
    assert [r["doc_id"] for r in cleaning.curriculum(sizes).collect()] == [0, 1, 2, 3, 4]


def test_email_redaction_in_linear_time(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab@. \n\u00a0", k=rng.randrange(14))) for _ in range(1500)] + ["a@" * 200_000, "@" * 300_000, "a@b" + "." * 300_000 + "c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.monotonic()
    got = get(rows, cleaning.redact_email(F.col("text")))
    assert time.monotonic() - start < 10
    assert got[:1500] == [re.sub(r"\S+@\S+\.\S+", "[EMAIL]", t) for t in texts[:1500]] and got[1500:] == [*texts[1500:1502], "[EMAIL]"]


def test_signals(rows):
    t = F.col("text")
    assert get(rows, quality.n_sentences(t)) == [0 if not x.strip() else max(1, len(re.findall(r"[.!?]+", x))) for x in TRAPS]
    special = F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{N}}{tx.SPACE[1:-1]}]", ""))
    assert get(rows, special) == [sum(not (c.isalnum() or c.isspace()) for c in x) for x in TRAPS]
    upper = F.length(F.regexp_replace(t, r"[^\p{IsUppercase}]", ""))
    assert get(rows, upper) == [sum(c.isupper() for c in x) for x in TRAPS]


def test_pii_language_toxicity(spark):
    samples = [("CPF 123.456.789-09", True), ("fone (11) 91234-5678", True), ("a@b.com", True), ("4111 1111 1111 1111", True), ("nada 12", False)]
    rows = spark.createDataFrame(samples, "text string, pii boolean")
    assert all(r["pii"] == r["got"] for r in rows.withColumn("got", quality.has_pii(F.col("text"))).collect())
    lang = spark.createDataFrame([("o gato que não está em casa",), ("the cat is not in the house",), ("xyz abc",), ("",)], "text string")
    assert [r[0] for r in lang.select(quality.language(tx.words(F.col("text")))).collect()] == ["pt", "en", "outro", "outro"]
    toxic = spark.createDataFrame([("seu idiota!",), ("um dois três quatro cinco seis sete oito nove dez onze doze lixo",), ("ok",), ("",)], "text string")
    assert [r[0] for r in toxic.select(quality.toxicity(tx.words(F.col("text")))).collect()] == [1.0, 1 / 13 * 10, 0.0, 0.0]


def test_config_filter(spark):
    rows = spark.createDataFrame([(0.9, 0.0, "pt", False, False), (0.2, 0.0, "pt", False, False), (0.9, 0.0, "en", False, False), (0.9, 0.9, "pt", True, False), (0.9, 0.0, "pt", False, True)], "quality_score double, toxicity_score double, language string, has_pii boolean, is_duplicate boolean")
    n = lambda c: quality.filter_from_config(rows, c).count()
    assert (n({}), n({"language_id": {"enabled": False}}), n({"pii_filter": {"enabled": True, "action": "remove"}}), n({"pii_filter": {"enabled": True, "action": "flag"}}), n({"toxicity_filter": {"max_toxicity_score": 0.5}})) == (2, 3, 1, 2, 1)
