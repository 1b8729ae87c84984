"""Pieces that the SQL twins share."""

from __future__ import annotations

import unicodedata

from corpusmill.operators.quality import EN_WORDS, PII, PT_WORDS, TOXIC_WORDS

SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda w: w <> '')"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def _decomposed(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")


# the engine has no compatibility decomposition: letters and signs below U+2200 by table, ligatures, fractions and the like by name
_ONE = [c for c in map(chr, range(0x80, 0x2200)) if len(_decomposed(c)) == 1 and _decomposed(c) != c]
_MANY = [chr(c) for c in (0xBC, 0xBD, 0xBE, 0x132, 0x133, 0x149, *range(0x1C4, 0x1CD), 0x1F1, 0x1F2, 0x1F3, 0x2025, 0x2026, 0x2116, 0x2122, *range(0xFB00, 0xFB07))]


def plain(text: str) -> str:
    out = f"regexp_replace(translate({text}, '{''.join(_ONE)}', '{''.join(map(_decomposed, _ONE))}'), '\\p{{Mn}}', '', 'g')"
    many = out
    for c in _MANY:
        many = f"replace({many}, '{c}', '{_decomposed(c)}')"
    return f"(CASE WHEN regexp_matches({text}, '[{''.join(_MANY)}]') THEN {many} ELSE {out} END)"


def normal(text: str) -> str:
    one = f"regexp_replace(lower({plain(text)}), '{SPACE}+', ' ', 'g')"
    return strip(f"regexp_replace({one}, '[^\\p{{L}}\\p{{N}}_{SPACE[1:-1]}]', '', 'g')")


def ngrams(w: str, n: int) -> str:
    return f"CASE WHEN len({w}) < {n} THEN [array_to_string({w}, ' ')] ELSE list_distinct(list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i+{n - 1}], ' '))) END"


def split_value(text: str) -> str:
    return f"('0x' || substr(md5(substr({text}, 1, 500)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"


def order_key(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 15))::BIGINT"


def pii(text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in PII.values()) + ")"


_list = lambda values: "[" + ", ".join(q(v) for v in values) + "]"

CLEAN = strip(r"regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\S+@\S+\.\S+', '[EMAIL]', 'g')")

MANIFEST = f"""
b AS (SELECT doc_id AS raw_index, text, source AS domain, {words("text")} AS w, list_distinct(list_transform({words("text")}, lambda x: lower(x))) AS u FROM documents WHERE text <> ''),
c AS (SELECT *, length(text)::INT AS n_chars, len(w)::INT AS n_words,
    (CASE WHEN {strip("text")} = '' THEN 0 ELSE greatest(len(regexp_extract_all(text, '[.!?]+')), 1) END)::INT AS n_sentences,
    len(list_intersect(u, {_list(PT_WORDS)}))::DOUBLE / greatest(len(u), 1) AS pt, len(list_intersect(u, {_list(EN_WORDS)}))::DOUBLE / greatest(len(u), 1) AS en,
    len(list_filter(w, lambda x: list_contains({_list(TOXIC_WORDS)}, regexp_replace(regexp_replace(lower(x), '^[.,!?;:]+', ''), '[.,!?;:]+$', '')))) AS bad,
    length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS upper,
    length(regexp_replace(text, '[\\p{{L}}\\p{{N}}{SPACE[1:-1]}]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS special FROM b),
m AS (SELECT 'doc_' || lpad(raw_index::VARCHAR, 6, '0') || '_' || substr(md5(text), 1, 12) AS doc_id, n_chars, n_words, n_sentences,
    CASE WHEN pt > en AND pt > 0.05 THEN 'pt' WHEN en > pt AND en > 0.05 THEN 'en' ELSE 'outro' END AS language, domain,
    CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE round(least(greatest(
      0.3::DOUBLE * (CASE WHEN n_words < 10 THEN 0.1 WHEN n_words < 50 THEN 0.4 WHEN n_words <= 5000 THEN 1.0 ELSE 0.7 END)::DOUBLE
      + 0.3::DOUBLE * (CASE WHEN n_sentences = 0 THEN 0.2 WHEN n_words::DOUBLE / n_sentences BETWEEN 10 AND 25 THEN 1.0 WHEN n_words::DOUBLE / n_sentences BETWEEN 5 AND 40 THEN 0.6 ELSE 0.3 END)::DOUBLE
      + 0.2::DOUBLE * (CASE WHEN special < 0.1 THEN 1.0 WHEN special < 0.2 THEN 0.7 WHEN special < 0.4 THEN 0.4 ELSE 0.1 END)::DOUBLE
      + 0.2::DOUBLE * (CASE WHEN letters = 0 THEN 0.5 WHEN upper::DOUBLE / letters < 0.3 THEN 1.0 WHEN upper::DOUBLE / letters < 0.5 THEN 0.5 ELSE 0.1 END)::DOUBLE, 0), 1), 4) END AS quality_score,
    {pii("text")} AS has_pii, CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE least(bad::DOUBLE / n_words * 10, 1.0) END AS toxicity_score, raw_index,
    min(raw_index) OVER (PARTITION BY CASE WHEN len(w) = 0 THEN '#' || raw_index ELSE md5(array_to_string(list_transform(w, lambda x: lower(x)), ' ')) END) AS cluster_id FROM c)
"""
