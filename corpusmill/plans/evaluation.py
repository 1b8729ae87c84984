"""Queries over labels, conversations and benchmark: chat, parsers, metrics, statistics, reports.

Two heuristic predictors stand in for models: long (300 words or more) and
clean (few special characters), each against labels.quality.  Answers of models
are stood in for by set phrases before the turns of conversations, raw rows of
evaluation tasks by columns made from benchmark items.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.ordering import numbered
from corpusmill.functions.text import words
from corpusmill.operators import chat, contamination, metrics, packing, reports, stats, tasks
from corpusmill.plans import sql
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table

# ---- G: chat ---------------------------------------------------------------


def gathered(spark: SparkSession, d: str) -> DataFrame:
    return chat.gather(table(spark, d, "conversations"))


def _each(piece: str, tail: str = "''") -> str:
    return f"SELECT conv_id, coalesce(string_agg({piece}, '' ORDER BY turn, role, text), '') || {tail} AS text FROM conversations GROUP BY conv_id"


NL = "chr(10)"
CHAT = f"CASE WHEN role = 'user' THEN '<|turn>user' || {NL} || text || '<turn|>' || {NL} WHEN role IN ('model', 'assistant') THEN '<|turn>model' || {NL} || text || '<turn|>' || {NL} ELSE '' END"
MANUAL = f"'<|turn>' || role || {NL} || text || '<turn|>' || {NL}"
BASE = f"CASE WHEN role = 'model' THEN 'Resposta: ' || text || {NL} || {NL} ELSE 'Pergunta: ' || text || {NL} END"
MODEL = f"'<|turn>model' || {NL}"

query("chat_format", _each(CHAT))(lambda s, d: gathered(s, d).select("conv_id", chat.format_chat(F.col("messages")).alias("text")))
query("chat_generation_prompt", _each(CHAT, MODEL))(lambda s, d: gathered(s, d).select("conv_id", chat.format_chat(F.col("messages"), generate=True).alias("text")))
query("manual_template", _each(MANUAL))(lambda s, d: gathered(s, d).select("conv_id", chat.manual_template(F.col("messages")).alias("text")))
query("baseline_template", _each(BASE, "'Resposta: '"))(lambda s, d: gathered(s, d).select("conv_id", chat.baseline_template(F.col("messages")).alias("text")))
query("think_injection", f"SELECT conv_id, replace(text, {MODEL}, {MODEL} || '<|think|>' || {NL}) AS text FROM ({_each(CHAT)})")(
    lambda s, d: gathered(s, d).select("conv_id", chat.inject_think(chat.format_chat(F.col("messages")), "on", training=True).alias("text"))
)
query("think_budget", f"SELECT conv_id, text || '<|think|>' || {NL} || '<|channel>thought' || {NL} || '<channel|>' || {NL} AS text FROM ({_each(CHAT, MODEL)})")(
    lambda s, d: gathered(s, d).select("conv_id", chat.inject_think(chat.format_chat(F.col("messages"), generate=True), "budget", training=False).alias("text"))
)


THINK, EMPTY = f"'<|think|>' || {NL}", f"'<|think|>' || {NL} || '<|channel>thought' || {NL} || '<channel|>' || {NL}"
MODES = [(mode, training) for mode in ("off", "on", "budget") for training in (True, False)]


@query(
    "think_modes",
    f"WITH t AS ({_each(CHAT)}), g AS ({_each(CHAT, MODEL)}) "
    + " UNION ALL ".join(
        f"SELECT conv_id, '{mode}' AS mode, {str(training).lower()} AS training, "
        + ("text" if mode == "off" else f"replace(text, {MODEL}, {MODEL} || {THINK if mode == 'on' else EMPTY})" if training else f"text || {THINK if mode == 'on' else EMPTY}")
        + f" AS text FROM {'t' if training else 'g'}"
        for mode, training in MODES
    ),
)
def think_modes(spark: SparkSession, d: str) -> DataFrame:
    shown = lambda mode, training: chat.inject_think(chat.format_chat(F.col("messages"), generate=not training), mode, training)
    cells = F.array(*[F.struct(F.lit(mode).alias("mode"), F.lit(training).alias("training"), shown(mode, training).alias("text")) for mode, training in MODES])
    return gathered(spark, d).select("conv_id", F.inline(cells))


def thoughtful(spark: SparkSession, d: str) -> DataFrame:
    wrap = F.concat(F.lit("<think>plan "), F.col("turn").cast("string"), F.lit("</think>\n\n\n"), F.col("text"), F.lit("<|channel>thought\nlate"))
    return table(spark, d, "conversations").select("conv_id", "turn", wrap.alias("text"))


query("think_strip", f"SELECT conv_id, turn, {sql.strip('text')} AS answer, 'plan ' || turn || chr(10) || 'late' AS thoughts FROM conversations")(
    lambda s, d: thoughtful(s, d).select("conv_id", "turn", chat.strip_thought(F.col("text")).alias("answer"), chat.extract_thoughts(F.col("text")).alias("thoughts"))
)
query("think_strip_output", f"SELECT conv_id, turn, {sql.strip('text')} AS answer, 'late' AS thought FROM conversations")(
    lambda s, d: thoughtful(s, d).select("conv_id", "turn", chat.strip_thought_output(F.col("text")).alias("answer"), chat.extract_thought_output(F.col("text")).alias("thought"))
)


@query("sharegpt_normalize", "SELECT conv_id, string_agg(CASE WHEN role IN ('human', 'user') THEN 'user' ELSE 'model' END, ',' ORDER BY turn, role, text) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def sharegpt_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = gathered(spark, d).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))).alias("conversations"))
    out = chat.normalize_columns(raw)
    return out.select("conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.size("messages").cast("long").alias("n"))


query("turn_stats", "SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations, sum(length(text))::BIGINT AS n_chars, max(turn) AS last_turn FROM conversations GROUP BY role")(
    lambda s, d: table(s, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.countDistinct("conv_id").alias("n_conversations"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.max("turn").alias("last_turn"))
)


@query(
    "sharegpt_roundtrip",
    "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'user' ELSE 'model' END, ',' ORDER BY turn, role, text) AS roles, md5(string_agg(text, '|' ORDER BY turn, role, text)) AS content_md5 FROM conversations GROUP BY conv_id",
)
def sharegpt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    named = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"), m["content"].alias("value")))
    out = chat.normalize_columns(gathered(spark, d).select("conv_id", named.alias("conversations")))
    return out.select("conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|")).alias("content_md5"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the turn after it, as a request and its answer."""
    return neighbours(spark, d).select("conv_id", "turn", F.col("gold").alias("request"), F.col("prediction").alias("answer"))


PAIRED = "SELECT a.conv_id, a.turn, a.text AS request, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'"


def _messages(rows: DataFrame) -> DataFrame:
    return chat.normalize_columns(rows).select("conv_id", "turn", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("messages"))


query("alpaca_normalize", f"WITH p AS ({PAIRED}) SELECT conv_id, turn, 'user=' || request || CASE WHEN turn % 2 = 0 THEN '' ELSE chr(10) || chr(10) || 'more ' || turn END || '|model=' || answer AS messages FROM p")(
    lambda s, d: _messages(pairs(s, d).select("conv_id", "turn", F.col("request").alias("instruction"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("more "), F.col("turn"))).alias("input"), F.col("answer").alias("output")))
)
query("prompt_response_normalize", f"WITH p AS ({PAIRED}) SELECT conv_id, turn, 'user=' || request || '|model=' || answer AS messages FROM p")(lambda s, d: _messages(pairs(s, d).withColumnsRenamed({"request": "prompt", "answer": "response"})))
query("messages_normalize", _each("role || '=' || text || '|'"))(
    lambda s, d: chat.normalize_columns(gathered(s, d)).select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"], F.lit("|"))), "").alias("text"))
)
query("preference_format", f"WITH p AS ({PAIRED}) SELECT conv_id, turn, '<|turn>user' || {NL} || request || '<turn|>' || {NL} || {MODEL} AS prompt, answer AS chosen, 'No: ' || answer AS rejected FROM p")(
    lambda s, d: chat.preference_format(pairs(s, d).select("conv_id", "turn", F.col("request").alias("prompt"), F.col("answer").alias("chosen"), F.concat(F.lit("No: "), "answer").alias("rejected")))
)


def marked_ids(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, ids: for each turn its marker (1 user, 2 others) and its length + 10."""
    return gathered(spark, d).select("conv_id", F.flatten(F.transform("messages", lambda m: F.array(F.when(m["role"] == "user", 1).otherwise(2), F.length(m["content"]) + 10))).alias("ids"))


MARKED = """i AS (SELECT conv_id, 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, CASE role WHEN 'user' THEN 1 ELSE 2 END AS marker, length(text) + 10 AS n FROM conversations),
e AS (SELECT conv_id, i - 1 AS i, marker AS id FROM i UNION ALL SELECT conv_id, i, n FROM i),
m AS (SELECT conv_id, i, id, max(CASE WHEN id = 1 THEN i END) OVER w AS turn_at, max(CASE WHEN id = 2 THEN i END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_at, bool_or(id = 2) OVER (PARTITION BY conv_id) AS any_response
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
l AS (SELECT conv_id, i, id, CASE WHEN NOT any_response OR (response_at IS NOT NULL AND coalesce(turn_at, 0) < response_at) THEN id ELSE -100 END AS label, any_response FROM m)"""
_joined_ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
query("completion_mask", f"WITH {MARKED} SELECT conv_id, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids, string_agg(label::VARCHAR, ',' ORDER BY i) AS labels FROM l GROUP BY conv_id")(
    lambda s, d: marked_ids(s, d).select("conv_id", "ids", chat.completion_mask(F.col("ids"), [2], [1]).alias("labels")).select("conv_id", _joined_ids("ids"), _joined_ids("labels"))
)
query(
    "completion_collator",
    f"WITH {MARKED}, t AS (SELECT max(c) AS most FROM (SELECT count(*) AS c FROM l GROUP BY conv_id)), g AS (SELECT conv_id, count(*) AS c, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids, string_agg((CASE WHEN any_response THEN label ELSE -100 END)::VARCHAR, ',' ORDER BY i) AS labels FROM l GROUP BY conv_id)"
    " SELECT conv_id, ids || repeat(',0', (most - c)::INT) AS ids, labels || repeat(',-100', (most - c)::INT) AS labels, c::INT AS n_tokens FROM g, t",
)(
    lambda s, d: packing.padded(marked_ids(s, d).select("conv_id", "ids", chat.completion_mask(F.col("ids"), [2], [1], keep_if_absent=False).alias("labels")), 0, "ids", "labels").select(
        "conv_id", _joined_ids("ids"), _joined_ids("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens")
    )
)


# ---- H: parsers and metrics ------------------------------------------------

ANSWERS = (
    "A", "b", "C) porque sim", "D. texto", "Resposta: E", "A alternativa correta é a letra C", "(d) talvez", "E", "e: final", "A resposta é B", "portanto, a opção D", "nenhuma", "AB", "42", "Answer: c", "x (A) y (B)",
    "sim", "Não.", "yes, it is", "resposta: não", "talvez", "falso!", "True", "R: s", "1", "0", "incorreto", "The entailment holds", "not entailment", "not_entailment", "É positivo", "sentimento negativo", "neutro", "odio", "nao_odio", "", "  ",
    "Desculpe, não posso ajudar", "I can't do that", "claro, aqui está", "É antiético",
)
def answers(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, raw: a set phrase, in two of three turns with the turn's text after it."""
    phrase = F.get(F.array(*map(F.lit, ANSWERS)), ((F.col("conv_id") * 7 + F.col("turn")) % len(ANSWERS)).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, phrase).otherwise(F.concat(phrase, F.lit(" "), "text")).alias("raw"))


RAW = f"v AS (SELECT conv_id, turn, [{', '.join(map(sql.q, ANSWERS))}][((conv_id * 7 + turn) % {len(ANSWERS)})::INT + 1] || CASE WHEN turn % 3 = 0 THEN '' ELSE ' ' || text END AS raw FROM conversations)"
# without look-around: what is not a letter (digit) is doubled, so that each letter (digit) has neighbours of its own
LETTERS = rf"""x AS (SELECT *, {sql.strip('raw')} AS t FROM v), y AS (SELECT *, CASE WHEN regexp_matches(t, '^[A-Ea-e]\s[a-z]') THEN ' ' || substr(t, 2) ELSE t END AS body FROM x),
z AS (SELECT *, regexp_extract_all(regexp_replace(body, '([^a-zA-Z])', '\1\1', 'g'), '(?:^|[^a-zA-Z])([A-Ea-e])(?:[^a-zA-Z]|$)', 1) AS alone FROM y),
a AS (SELECT *, coalesce(CASE WHEN regexp_full_match(t, '[A-Ea-e]') THEN upper(t) END, nullif(upper(regexp_extract(t, '^([A-Ea-e])[).]', 1)), ''),
  nullif(upper(regexp_extract(t, '(?i)(?:resposta|answer|alternativa|é)\s*[:\s]\s*([A-E])(?:[^\p{{L}}\p{{N}}_]|$)', 1)), ''), nullif(upper(regexp_extract(t, '\(([A-Ea-e])\)', 1)), ''),
  nullif(upper(regexp_extract(t, '^([A-Ea-e])(?:\s*$|[:\-)])', 1)), ''), upper(alone[-1]), CASE WHEN length(t) <= 3 AND regexp_matches(t, '^[A-Ea-e]') THEN upper(substr(t, 1, 1)) END, '') AS letter FROM z)"""
query("letter_extract", f"WITH {RAW}, {LETTERS} SELECT conv_id, turn, letter FROM a")(lambda s, d: answers(s, d).select("conv_id", "turn", tasks.extract_letter(F.col("raw")).alias("letter")))
query(
    "choice_parsers",
    f"""WITH {RAW}, {LETTERS} SELECT conv_id, turn,
  CASE WHEN letter <> '' THEN letter WHEN regexp_matches(t, '[0-9]') THEN replace(regexp_extract_all(t, '(-?[0-9]+(?:[.,][0-9]+)?)', 1)[-1], ',', '.') ELSE substr(t, 1, 20) END AS math,
  CASE WHEN letter IN ('A', 'B', 'C', 'D') THEN letter WHEN regexp_matches(raw, '(?:^|[^0-9])[0-3](?:[^0-9]|$)') THEN chr(65 + regexp_extract(raw, '(?:^|[^0-9])([0-3])(?:[^0-9]|$)', 1)::INT) ELSE '' END AS hellaswag FROM a""",
)(lambda s, d: answers(s, d).select("conv_id", "turn", tasks.parse_math(F.col("raw")).alias("math"), tasks.parse_hellaswag(F.col("raw")).alias("hellaswag")))
T = f"lower({sql.strip('raw')})"
query(
    "task_parsers",
    rf"""WITH {RAW} SELECT conv_id, turn,
  CASE WHEN {T} LIKE '%sim%' OR {T} LIKE '%yes%' OR {T} LIKE '%verdadeiro%' OR {T} LIKE '%true%' THEN 'sim' ELSE 'nao' END AS boolq,
  CASE WHEN {T} LIKE '%positiv%' THEN 'positivo' WHEN {T} LIKE '%negativ%' THEN 'negativo' ELSE 'neutro' END AS sentiment,
  CASE WHEN {T} LIKE '%nao%' OR {T} LIKE '%não%' OR {T} LIKE '%no%' THEN 'nao_odio' WHEN {T} LIKE '%odio%' OR {T} LIKE '%ódio%' OR {T} LIKE '%hate%' OR {T} LIKE '%sim%' THEN 'odio' ELSE 'nao_odio' END AS hate,
  CASE WHEN {T} LIKE '%sim%' OR {T} LIKE '%yes%' OR {T} LIKE '%parafrase%' OR {T} LIKE '%paráfrase%' THEN 'sim' ELSE 'nao' END AS paraphrase,
  CASE WHEN {T} LIKE '%entailment%' AND NOT contains(right(split_part({T}, 'entailment', 1), 5), 'not') THEN 'entailment' ELSE 'not_entailment' END AS rte,
  coalesce(regexp_extract(raw, '(\d+\.?\d*)', 1), '') AS number FROM v""",
)(
    lambda s, d: answers(s, d).select(
        "conv_id",
        "turn",
        *[parse(F.col("raw")).alias(name) for name, parse in (("boolq", tasks.parse_boolq), ("sentiment", tasks.parse_sentiment), ("hate", tasks.parse_hate), ("paraphrase", tasks.parse_paraphrase), ("rte", tasks.parse_rte), ("number", tasks.extract_number))],
    )
)
YES, NO = (", ".join(map(sql.q, x)) for x in (metrics.YES, metrics.NO))
BOOL = f"""{RAW}, a AS (SELECT *, regexp_replace({T}, '[.!,]+$', '') AS t0 FROM v),
b AS (SELECT *, CASE WHEN starts_with(t0, 'resposta:') THEN {sql.strip('substr(t0, 10)')} WHEN starts_with(t0, 'answer:') THEN {sql.strip('substr(t0, 8)')} WHEN starts_with(t0, 'r:') THEN {sql.strip('substr(t0, 3)')} ELSE t0 END AS t FROM a),
c AS (SELECT *, {sql.words('t')}[1] AS f FROM b), n AS (SELECT conv_id, turn, CASE WHEN t IN ({YES}) THEN 'sim' WHEN t IN ({NO}) THEN 'nao' WHEN f IN ({YES}) THEN 'sim' WHEN f IN ({NO}) THEN 'nao' END AS answer FROM c)"""
query("boolq_normalize", f"WITH {BOOL} SELECT * FROM n")(lambda s, d: answers(s, d).select("conv_id", "turn", metrics.normalize_bool(F.col("raw")).alias("answer")))
query(
    "boolq_accuracy",
    f"WITH {BOOL} SELECT count(*) FILTER (answer = CASE WHEN conv_id % 2 = 0 THEN 'sim' ELSE 'nao' END)::DOUBLE / count(*) AS accuracy, count(*) FILTER (answer = CASE WHEN conv_id % 2 = 0 THEN 'sim' ELSE 'nao' END) AS n_correct, count(*) AS n_total, count(*) FILTER (answer IS NULL) AS n_invalid FROM n",
)(lambda s, d: metrics.boolq_accuracy(answers(s, d).select(F.col("raw").alias("prediction"), F.when(F.col("conv_id") % 2 == 0, "sim").otherwise("não").alias("gold"))))
query(
    "refusal_rate",
    f"WITH {RAW}, r AS (SELECT " + " OR ".join(f"contains(p, {sql.q(p)})" for p in metrics.REFUSALS) + f" AS r FROM (SELECT {sql.plain('lower(raw)')} AS p FROM v)) SELECT count(*) FILTER (r)::DOUBLE / count(*) AS refusal_rate, count(*) FILTER (r) AS n_refused, count(*) AS n_total FROM r",
)(lambda s, d: metrics.refusal_rate(answers(s, d).select(F.col("raw").alias("prediction"), F.lit("refuse").alias("gold"))))
RUBRIC = (("the", 2.0), ("und", 1.0), ("que", 1.0), ("les", 4.0))
query(
    "rubric_weighted",
    "SELECT conv_id, turn, (" + " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for k, w in RUBRIC) + ") / 8.0::DOUBLE AS score FROM conversations",
)(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", metrics.rubric(F.col("text"), list(RUBRIC)).alias("score")))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """idx, doc_id, gold, long, clean: two predictors and their scores against labels.quality."""
    text = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.size(words(F.col("text"))).alias("n"), F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s]", "")).alias("odd"))
    both = table(spark, d, "labels").join(text, "doc_id")
    return both.select("doc_id", "source", "n_chars", "n", F.col("quality").alias("gold"), (F.col("n") >= 300).cast("int").alias("long"), (F.col("odd") * 20 < F.col("n_chars")).cast("int").alias("clean"))


SCORED = f"z AS (SELECT doc_id, source, n_chars, len({sql.words('text')}) AS n, quality AS gold, (len({sql.words('text')}) >= 300)::INT AS long, (length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) * 20 < n_chars)::INT AS clean FROM labels JOIN documents USING (doc_id))"
pred = lambda s, d, name: scored(s, d).select(F.col(name).cast("string").alias("prediction"), F.col("gold").cast("string").alias("gold"))

query("quality_vs_labels_accuracy", f"WITH {SCORED} SELECT count(*) FILTER (clean = gold)::DOUBLE / count(*) AS accuracy, floor(count(*) FILTER (clean = gold)::DOUBLE / count(*) * count(*))::BIGINT AS n_correct, count(*) AS n_total FROM z")(lambda s, d: metrics.accuracy(pred(s, d, "clean")))
query(
    "quality_vs_labels_f1_counts",
    f"WITH {SCORED}, l AS (SELECT DISTINCT gold AS x FROM z UNION SELECT DISTINCT clean FROM z) SELECT x::VARCHAR AS label, count(*) FILTER (clean = x AND gold = x) AS tp, count(*) FILTER (clean = x AND gold <> x) AS fp, count(*) FILTER (clean <> x AND gold = x) AS fn FROM z, l GROUP BY x",
)(lambda s, d: metrics.label_counts(pred(s, d, "clean")))
query(
    "quality_vs_labels_macro_f1",
    f"WITH {SCORED}, l AS (SELECT DISTINCT gold AS x FROM z UNION SELECT DISTINCT clean FROM z), c AS (SELECT x, count(*) FILTER (clean = x AND gold = x) AS tp, count(*) FILTER (clean = x AND gold <> x) AS fp, count(*) FILTER (clean <> x AND gold = x) AS fn FROM z, l GROUP BY x)"
    " SELECT sum(CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END) / count(*) AS macro_f1, count(*) AS n_labels FROM c",
)(lambda s, d: metrics.macro_f1(pred(s, d, "clean")))
CORR = "CASE WHEN count(*) < 3 THEN 0.0::DOUBLE ELSE (count(*)::DOUBLE * sum({0} * {1}) - sum({0}) * sum({1})) / sqrt((count(*)::DOUBLE * sum({0} * {0}) - sum({0}) * sum({0})) * (count(*)::DOUBLE * sum({1} * {1}) - sum({1}) * sum({1}))) END"
query(
    "score_label_correlation",
    f"WITH {SCORED}, r AS (SELECT n::DOUBLE AS x, gold::DOUBLE AS y, (rank() OVER (ORDER BY n))::DOUBLE + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS rx, (rank() OVER (ORDER BY gold))::DOUBLE + (count(*) OVER (PARTITION BY gold) - 1) / 2.0::DOUBLE AS ry FROM z) SELECT {CORR.format('x', 'y')} AS pearson, {CORR.format('rx', 'ry')} AS spearman, count(*) AS n_valid FROM r",
)(lambda s, d: metrics.correlations(scored(s, d).select(F.col("n").cast("string").alias("prediction"), F.col("gold").cast("string").alias("gold"))))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn (gold) with the turn that follows it (prediction)."""
    t = table(spark, d, "conversations")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return t.filter("role = 'user'").join(after, ["conv_id", "turn"]).select("conv_id", "turn", "prediction", F.col("text").alias("gold"))


REF, PRE = (f"list_distinct({sql.words(f'lower({t})')})" for t in ("a.text", "b.text"))
query("rubric_token_recall", f"SELECT a.conv_id, a.turn, len(list_intersect({REF}, {PRE}))::DOUBLE / len({REF}) AS recall FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'")(
    lambda s, d: neighbours(s, d).select("conv_id", "turn", metrics.token_recall(F.col("prediction"), F.col("gold")).alias("recall"))
)
query("rouge_l")(lambda s, d: neighbours(s, d).select("conv_id", "turn", metrics.rouge_l_f1("prediction", "gold").alias("rouge_l")))  # dynamic programming

TAGS = ("O", "B-PESSOA", "I-PESSOA", "I-LOCAL", "B-LOCAL")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, gold, prediction: words with tags by length and place, and lines of entities for words whose length is a multiple of 4."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", words(F.translate("text", "|:", "")).alias("tokens"))
    tags = F.transform("tokens", lambda w, i: F.get(F.array(*map(F.lit, TAGS)), (F.length(w) + i) % 5))
    picked = F.filter("tokens", lambda w: F.length(w) % 4 == 0)
    lines = F.array_join(F.transform(picked, lambda w: F.concat(F.lit("Entidade: "), w, F.lit(" | TIPO: "), F.when(F.length(w) == 4, "pessoa").otherwise("LOCAL"))), "\n")
    found = F.transform(tasks.parse_entities(lines), lambda e: F.struct(e["start"].alias("start"), e["label"].alias("label")))
    return rows.select("conv_id", "turn", tasks.bio_spans(F.col("tokens"), tags).alias("gold"), found.alias("prediction"))


ENTITIES = f"""w AS (SELECT conv_id, turn, {sql.words("translate(text, '|:', '')")} AS w FROM conversations),
e AS (SELECT conv_id, turn, i, w[i] AS tok, [{', '.join(map(sql.q, TAGS))}][(length(w[i]) + i - 1) % 5 + 1] AS tag FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
b AS (SELECT *, lag(tag, 1, 'O') OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM e),
s AS (SELECT *, tag LIKE 'B-%' OR (tag LIKE 'I-%' AND NOT (before <> 'O' AND substr(before, 3) = substr(tag, 3))) AS fresh FROM b),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM s),
g AS (SELECT conv_id, turn, lower(string_agg(tok, ' ' ORDER BY i)) AS start, substr(any_value(tag), 3) AS label FROM n WHERE tag <> 'O' GROUP BY conv_id, turn, n),
p AS (SELECT DISTINCT conv_id, turn, lower(tok) AS start, CASE WHEN length(tok) = 4 THEN 'PESSOA' ELSE 'LOCAL' END AS label FROM e WHERE length(tok) % 4 = 0)"""
query("bio_spans", f"WITH {ENTITIES} SELECT * FROM g")(lambda s, d: entities(s, d).select("conv_id", "turn", F.inline("gold")))
query(
    "entity_micro_f1",
    f"WITH {ENTITIES}, t AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS ng)"
    " SELECT tp::DOUBLE / np AS precision, tp::DOUBLE / ng AS recall, (2 * tp)::DOUBLE / (np + ng) AS micro_f1, tp, np - tp AS fp, ng - tp AS fn FROM t",
)(lambda s, d: metrics.entity_micro_f1(entities(s, d)))


@query("task_prompts", f"SELECT item_id, {sql.strip('HEAD || text || chr(10) || TAIL')} AS prompt FROM benchmark".replace("HEAD", sql.q(tasks.INSTRUCTIONS["enem"] + "\n\nPergunta: ")).replace("TAIL", sql.q("A) sim\nB) não\nResposta:")))
def task_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), F.array(F.lit("sim"), F.lit("não")).alias("options"), F.lit("A").alias("answer"))
    return rows.select("item_id", tasks.task_prompt(rows, "enem").alias("prompt"))


def item() -> Column:
    return F.col("item_id")


def body() -> Column:
    return F.col("text")


_pick = lambda i, *values: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
_pick_sql = lambda *values: f"[{', '.join(map(sql.q, values))}][(item_id % {len(values)})::INT + 1]"
_strings = lambda *values: F.array(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in values])
_labelled = lambda: {"question": body(), "choices": F.struct(F.array(F.concat(body(), F.lit("1")), F.concat(body(), F.lit("0"))).alias("text"), _strings("B", "A").alias("label")), "answerKey": _pick(item(), "A", "B")}
ABCD, COURT = _pick_sql("A", "B", "C", "D"), list(tasks.COURT_OPTIONS.values())
LABELLED = f"text || '¦' || text || '0~' || text || '1¦' || {_pick_sql('A', 'B')}"
# task: (raw columns made from a benchmark item, the normal row in SQL: fields joined by ¦, lists by ~)
ADAPTED = {
    "enem": (lambda: {"question": body(), "alternatives": _strings("x", item()), "label": _pick(item(), "A", "B")}, f"text || '¦x~' || item_id || '¦' || {_pick_sql('A', 'B')}"),
    "bluex": (_labelled, LABELLED),
    "oab_bench": (_labelled, LABELLED),
    "arc_en": (_labelled, LABELLED),
    "copa_pt": (lambda: {"premise": body(), "choice1": F.lit("a"), "choice2": F.lit("b"), "question": _pick(item(), "cause", "effect"), "label": item() % 2}, f"text || {_pick_sql(' porque...', ' portanto...')} || '¦a~b¦' || {_pick_sql('A', 'B')}"),
    "broverbs": (lambda: {"input": body(), "alternatives": _strings("a", "b", "c", "d"), "correct_index": item() % 4}, f"text || '¦a~b~c~d¦' || {ABCD}"),
    "math_pt": (lambda: {"problem": body(), "choices": F.create_map(F.lit("B"), F.lit("2"), F.lit("A"), item().cast("string")), "answer": _pick(item(), "A", "B")}, f"text || '¦' || item_id || '~2¦' || {_pick_sql('A', 'B')}"),
    "legalbench_br": (lambda: {"sentence": body(), "label": item() % 4}, f"text || '¦' || {sql.q('~'.join(COURT))} || '¦' || {_pick_sql('A', 'B', 'C', '')}"),
    "mmlu_en": (lambda: {"question": body(), "choices": _strings("a", "b", "c", "d"), "answer": item() % 4}, f"text || '¦a~b~c~d¦' || {ABCD}"),
    "hellaswag_en": (lambda: {"ctx": F.when(item() % 2 == 0, body()).otherwise(""), "ctx_a": body(), "ctx_b": F.lit("b"), "endings": _strings("x"), "label": (item() % 4).cast("string")}, f"text || {_pick_sql('', ' b')} || '¦x¦' || {ABCD}"),
    "assin2_rte": (lambda: {"premise": body(), "hypothesis": F.lit("h"), "entailment_judgment": item() % 2}, f"text || '¦h¦' || {_pick_sql('not_entailment', 'entailment')}"),
    "rte_pt": (lambda: {"premise": body(), "hypothesis": F.lit("h"), "label": item() % 2}, f"text || '¦h¦' || {_pick_sql('entailment', 'not_entailment')}"),
    "mrpc_pt": (lambda: {"sentence1": body(), "sentence2": F.lit("b"), "label": item() % 2}, f"text || '¦b¦' || {_pick_sql('nao', 'sim')}"),
    "assin2_sts": (lambda: {"premise": body(), "hypothesis": F.lit("h"), "relatedness_score": F.when(item() % 3 > 0, item() % 3 + 0.5)}, f"text || '¦h¦' || {_pick_sql('3.0', '1.5', '2.5')}"),
    "hatebr": (lambda: {"instagram_comments": body(), "offensive_language": item() % 2 == 0}, f"text || '¦' || {_pick_sql('odio', 'nao_odio')}"),
    "tweet_sentbr": (lambda: {"sentence": body(), "label": _pick(item(), " Negative", "positive", "NEUTRAL ", "misto")}, f"text || '¦' || {_pick_sql('negativo', 'positivo', 'neutro', 'misto')}"),
    "publichearing_br": (lambda: {"transcricao": body(), "metadados": F.struct(_pick(item(), " Saúde ", "").alias("assunto")), "label": F.lit("outro"), "materia": F.lit("m")}, f"text || '¦' || {_pick_sql('saúde', 'outro')} || '¦m'"),
    "boolq_pt": (lambda: {"passage": body(), "question": F.lit("q"), "label": item() % 2}, f"text || '¦q¦' || {_pick_sql('false', 'true')}"),
    "lener_br": (lambda: {"id": item().cast("string"), "tokens": F.array(body(), F.lit("b")), "ner_tags": _strings("O", "B-X")}, "item_id || '¦' || text || '~b¦O~B-X¦' || text || ' b'"),
    "xlsum_pt": (lambda: {"id": item(), "text": body(), "summary": F.lit("s")}, "text || '¦s'"),
    "donotanswer_pt": (lambda: {"question": body(), "category": F.lit("c")}, "text || '¦c¦refuse'"),
}


def _fields(rows: DataFrame) -> DataFrame:
    shown = [F.array_join(c, "~") if t.startswith("array") else F.col(c).cast("string") for c, t in rows.dtypes]
    return rows.select(F.concat_ws("¦", *shown).alias("normal"))


@query("task_adapters", " UNION ALL ".join(f"SELECT {sql.q(t)} AS task, {normal} AS normal FROM benchmark" for t, (_, normal) in ADAPTED.items()))
def task_adapters(spark: SparkSession, d: str) -> DataFrame:
    items, out = table(spark, d, "benchmark"), None
    for task, (raw, _) in ADAPTED.items():
        one = _fields(tasks.ADAPTERS[task](items.select(*[c.alias(name) for name, c in raw().items()]))).select(F.lit(task).alias("task"), "normal")
        out = one if out is None else out.union(one)
    return out


# task: (columns of a normal row, its text with the answer in SQL)
SHOWN = {
    "enem": (lambda: {"question": body(), "options": _strings("x", item()), "answer": _pick(item(), "A", "B")}, f"'Pergunta: ' || text || chr(10) || 'A) x' || chr(10) || 'B) ' || item_id || chr(10) || 'Resposta: ' || {_pick_sql('A', 'B')}"),
    "assin2_sts": (lambda: {"sentence1": body(), "sentence2": F.lit("b"), "score": item() % 3 + 0.5}, f"'Sentença 1: ' || text || chr(10) || 'Sentença 2: b' || chr(10) || 'Nota: ' || {_pick_sql('0.5', '1.5', '2.5')}"),
    "rte_pt": (lambda: {"premise": body(), "hypothesis": F.lit("h"), "label": _pick(item(), "entailment", "not_entailment")}, f"'Premissa: ' || text || chr(10) || 'Hipótese: h' || chr(10) || 'Resposta: ' || {_pick_sql('entailment', 'not_entailment')}"),
    "mrpc_pt": (lambda: {"sentence1": body(), "sentence2": F.lit("b"), "label": F.lit("sim")}, "'Premissa: ' || text || chr(10) || 'Hipótese: b' || chr(10) || 'Resposta: sim'"),
    "hatebr": (lambda: {"text": body(), "label": F.lit("odio")}, "'Texto: ' || text || chr(10) || 'Classificação: odio'"),
    "xlsum_pt": (lambda: {"text": body(), "summary": F.lit("s")}, "'Texto: ' || text || chr(10) || 'Resumo: s'"),
    "boolq_pt": (lambda: {"passage": body(), "question": F.lit("q"), "answer": item() % 2 == 0}, f"'Texto: ' || text || chr(10) || chr(10) || 'Pergunta: q' || chr(10) || 'Resposta: ' || {_pick_sql('sim', 'não')}"),
    "lener_br": (lambda: {"text": body(), "entities": F.array(F.struct(F.lit("Ana").alias("text"), F.lit("PESSOA").alias("label")))}, "'Texto: ' || text || chr(10) || 'Entidades:' || chr(10) || 'ENTIDADE: Ana | TIPO: PESSOA'"),
}


@query("prompt_shapes", " UNION ALL ".join(f"SELECT {sql.q(t)} AS task, item_id, {text} AS shown FROM benchmark" for t, (_, text) in SHOWN.items()))
def prompt_shapes(spark: SparkSession, d: str) -> DataFrame:
    items, out = table(spark, d, "benchmark"), None
    for task, (columns, _) in SHOWN.items():
        rows = items.select("item_id", *[c.alias(name) for name, c in columns().items()])
        one = rows.select(F.lit(task).alias("task"), "item_id", tasks.example_text(rows, task, with_answer=True).alias("shown"))
        out = one if out is None else out.union(one)
    return out


query("letter_options", "SELECT item_id, array_to_string(list_transform(range(0, item_id % 5 + 1), lambda i: chr((65 + i)::INT)), ',') AS letters FROM benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(tasks.option_set((item() % 5 + 1).cast("int")), ",").alias("letters"))
)
query("gold_answers", f"SELECT item_id, {ABCD} AS by_number, {_pick_sql('A', 'B')} AS by_text, upper(replace(trim(substr(text, 1, 8)), 'ß', 'ss')) AS label, {_pick_sql('sim', 'nao')} AS truth FROM benchmark")(
    lambda s, d: (r := table(s, d, "benchmark").select("item_id", (item() % 4).alias("n"), (item() % 2).cast("string").alias("t"), F.substring("text", 1, 8).alias("x"), (item() % 2 == 0).alias("b"))).select(
        "item_id", tasks.gold_answer(r, "n").alias("by_number"), tasks.gold_answer(r, "t").alias("by_text"), tasks.gold_answer(r, "x").alias("label"), tasks.gold_answer(r, "b").alias("truth")
    )
)


@query("task_selection", "SELECT item_id AS name FROM benchmark WHERE item_id % 5 <> 0 AND (item_id % 3 = 0 OR item_id % 2 = 0) AND item_id % 4 < 2")
def task_selection(spark: SparkSession, d: str) -> DataFrame:
    enabled = F.when(item() % 5 != 0, F.when(item() % 2 == 0, True)).otherwise(False)
    catalogue = table(spark, d, "benchmark").select(item().alias("name"), enabled.alias("enabled"), F.when(item() % 3 != 0, item() % 2).alias("path"), F.when(item() % 4 < 2, "low").otherwise("high").alias("group"))
    return tasks.select_tasks(catalogue, spark.range(1).select(F.col("id").alias("path")), "low").select("name")


query("benchmark_text_pick", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE 'premise ' || item_id END AS text FROM benchmark WHERE item_id % 3 < 2")(
    lambda s, d: contamination.pick_text(table(s, d, "benchmark").select("item_id", F.when(item() % 3 == 0, body()).when(item() % 3 == 2, "").alias("question"), F.concat(F.lit("premise "), item()).alias("premise")), "question", "text", "premise").select("item_id", "text")
)
query(
    "few_shot_split",
    "WITH n AS (SELECT count(*) AS n FROM benchmark), r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS i FROM benchmark) SELECT item_id, i <= 5 AND n > 15 AS is_shot FROM r, n",
)(lambda s, d: (p := tasks.few_shot_split(table(s, d, "benchmark"), 5, "item_id"))[0].select("item_id", F.lit(True).alias("is_shot")).union(p[1].select("item_id", F.lit(False))))

# ---- I: statistics ---------------------------------------------------------

Z = f"{NormalDist().inv_cdf(1 - (1 - 0.95) / 2)!r}::DOUBLE"
query(
    "wilson_by_source",
    f"WITH {SCORED}, c AS (SELECT source, count(*) FILTER (clean = gold) AS k, count(*)::BIGINT AS n FROM z GROUP BY source), w AS (SELECT source, k::DOUBLE / n AS p, n FROM c)"
    f" SELECT source, p AS point_estimate, greatest(0.0::DOUBLE, (p + {Z} * {Z} / (2 * n) - {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n)) AS ci_lower, least(1.0::DOUBLE, (p + {Z} * {Z} / (2 * n) + {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n)) AS ci_upper, n AS n_total FROM w",
)(
    lambda s, d: (c := scored(s, d).groupBy("source").agg(F.sum((F.col("clean") == F.col("gold")).cast("long")).alias("k"), F.count(F.lit(1)).alias("n_total"))).select(
        "source", *[x.alias(n) for x, n in zip(stats.wilson(F.col("k"), F.col("n_total")), ("point_estimate", "ci_lower", "ci_upper"))], "n_total"
    )
)


def paired(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, correct_a, correct_b, score_a, score_b: hits of the two predictors."""
    hits = scored(spark, d).select("doc_id", "source", (F.col("clean") == F.col("gold")).alias("correct_a"), (F.col("long") == F.col("gold")).alias("correct_b"))
    return hits.withColumns({"score_a": F.col("correct_a").cast("double"), "score_b": F.col("correct_b").cast("double")})


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """The paired hits with consecutive numbers in order of doc_id."""
    return numbered(paired(spark, d), "doc_id")


HITS = f"{SCORED}, h AS (SELECT doc_id, (clean = gold) AS a, (long = gold) AS b, (clean = gold)::INT::DOUBLE AS sa, (long = gold)::INT::DOUBLE AS sb, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM z)"
DRAWS = 2000
BOOT = f"{HITS}, n AS (SELECT count(*) AS n FROM h), i AS (SELECT draw, place, {sql.order_key(sql.q('boot'), 'draw', 'place')} % n AS idx, n FROM (SELECT unnest(range(0, {DRAWS})) AS draw), (SELECT idx AS place FROM h), n), m AS (SELECT draw, sum(sa) / count(*) AS m, (sum(sa) - sum(sb)) / count(*) AS d FROM i JOIN h USING (idx) GROUP BY draw)"
# both tails of the normal distribution beyond z, by Simpson's rule on 2000 steps
TWO_SIDED = "round(1 - 2 * (least({0}, 10.0::DOUBLE) / 6000) * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(least({0}, 10.0::DOUBLE) * i / 2000) * (least({0}, 10.0::DOUBLE) * i / 2000) / 2) / sqrt(2 * pi()))), 9)"
rounded = lambda digits, *columns: [F.round(c, digits).alias(c) for c in columns]
query(
    "mcnemar",
    f"WITH {HITS}, t AS (SELECT count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM h), u AS (SELECT b, c, CASE WHEN b + c = 0 THEN 0.0::DOUBLE ELSE ((abs(b - c) - 1) * (abs(b - c) - 1))::DOUBLE / (b + c) END AS statistic FROM t)"
    f" SELECT b, c, statistic, CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE {TWO_SIDED.format('sqrt(statistic)')} END AS p_value FROM u",
)(lambda s, d: stats.mcnemar(paired(s, d)).select("b", "c", "statistic", *rounded(9, "p_value")))
query(
    "wilcoxon",
    f"WITH {HITS}, t AS (SELECT count(*) FILTER (sa > sb)::DOUBLE AS p, count(*) FILTER (sa < sb)::DOUBLE AS m, (count(*) FILTER (sa <> sb))::DOUBLE AS n FROM h),"
    " u AS (SELECT n, p * (n + 1) / 2 AS w_plus, m * (n + 1) / 2 AS w_minus, least(p, m) * (n + 1) / 2 AS statistic, n * (n + 1) * (2 * n + 1) / 24 - (n * n * n - n) / 48 AS var FROM t),"
    f" y AS (SELECT *, CASE WHEN var <= 0 THEN 0.0::DOUBLE ELSE abs(statistic - n * (n + 1) / 4) / sqrt(var) END AS z FROM u) SELECT n::BIGINT AS n, w_plus, w_minus, statistic, {TWO_SIDED.format('z')} AS p_value FROM y",
)(lambda s, d: stats.wilcoxon(paired(s, d)).select("n", "w_plus", "w_minus", "statistic", *rounded(9, "p_value")))
EFFECT = "CASE WHEN abs(d) < 0.2 THEN 'negligível' WHEN abs(d) < 0.5 THEN 'pequeno' WHEN abs(d) < 0.8 THEN 'médio' ELSE 'grande' END AS interpretation"
query("cohens_d", f"WITH {HITS} SELECT round(d, 9) AS cohens_d, {EFFECT} FROM (SELECT avg(sa - sb) / stddev_samp(sa - sb) AS d FROM h)")(lambda s, d: stats.cohens_d(paired(s, d)).select(*rounded(9, "cohens_d"), "interpretation"))
query("bootstrap_draws", f"WITH {BOOT} SELECT draw, m FROM m")(lambda s, d: stats.resampled(indexed(s, d), DRAWS, "boot", ["score_a"]).groupBy("draw").agg((F.sum("score_a") / F.count(F.lit(1))).alias("m")))
query("bootstrap_ci", f"WITH {BOOT} SELECT round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS std, round(quantile_cont(m, 0.025), 9) AS ci_lower, round(quantile_cont(m, 0.975), 9) AS ci_upper, count(*) AS n_bootstrap FROM m")(
    lambda s, d: stats.bootstrap_ci(indexed(s, d), DRAWS, value="score_a").select(*rounded(9, "mean", "std", "ci_lower", "ci_upper"), "n_bootstrap")
)
query(
    "paired_bootstrap",
    f"WITH {BOOT}, q AS (SELECT avg(d) AS mean_diff, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, count(*) FILTER (d > 0)::DOUBLE / count(*) AS prob_a_gt_b FROM m)"
    " SELECT round(mean_diff, 9) AS mean_diff, round(lo, 9) AS ci_lower, round(hi, 9) AS ci_upper, prob_a_gt_b, NOT (lo <= 0 AND hi >= 0) AS significant FROM q",
)(lambda s, d: stats.paired_bootstrap(indexed(s, d), DRAWS).select(*rounded(9, "mean_diff", "ci_lower", "ci_upper"), "prob_a_gt_b", "significant"))
query(
    "paired_permutation",
    f"WITH {HITS}, o AS (SELECT sum(sa - sb) AS s, count(*) AS n FROM h), g AS (SELECT draw, sum(CASE WHEN {sql.order_key(sql.q('perm'), 'draw', 'idx')} % 2 = 0 THEN sa - sb ELSE sb - sa END) AS x FROM (SELECT unnest(range(0, {DRAWS})) AS draw), h GROUP BY draw) SELECT (count(*) FILTER (abs(x) >= abs(s)) + 1)::DOUBLE / ({DRAWS} + 1) AS p_value, any_value(s) / any_value(n) AS mean_diff FROM g, o",
)(lambda s, d: stats.paired_permutation(indexed(s, d), DRAWS))


def source_tests(spark: SparkSession, d: str) -> DataFrame:
    """test, p_value: for each source a share of its discordant documents, in whole 1024ths."""
    n = lambda c: F.sum(c.cast("long"))
    t = paired(spark, d).groupBy("source").agg(n(F.col("correct_a") & ~F.col("correct_b")).alias("b"), n(~F.col("correct_a") & F.col("correct_b")).alias("c"))
    return t.select(F.col("source").alias("test"), (F.floor((F.least("b", "c") + 1) * 1024 / (F.col("b") + F.col("c") + 40)) / 1024).alias("p_value"))


TESTS_SQL = f"{HITS}, d AS (SELECT source, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM h JOIN documents USING (doc_id) GROUP BY source), t AS (SELECT source AS test, floor((least(b, c) + 1) * 1024::DOUBLE / (b + c + 40)) / 1024 AS p_value FROM d)"
query("bonferroni", f"WITH {TESTS_SQL} SELECT test, p_value, least(p_value * count(*) OVER (), 1.0::DOUBLE) AS adjusted FROM t")(lambda s, d: stats.bonferroni(source_tests(s, d)))
query("holm", f"WITH {TESTS_SQL}, r AS (SELECT *, p_value * (count(*) OVER () - row_number() OVER (ORDER BY p_value, test) + 1) AS x FROM t) SELECT test, p_value, least(max(x) OVER (ORDER BY p_value, test ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE) AS adjusted FROM r")(
    lambda s, d: stats.holm(source_tests(s, d))
)
T_95 = "CASE n_seeds WHEN 2 THEN 12.706204736432095 WHEN 3 THEN 4.302652729696142 WHEN 4 THEN 3.182446305284263 WHEN 5 THEN 2.7764451051977987 ELSE 0 END::DOUBLE"
query(
    "seed_t_interval",
    f"WITH {SCORED}, e AS (SELECT source, doc_id % 5 AS seed, floor(count(*) FILTER (clean = gold) * 1024::DOUBLE / count(*)) / 1024 AS score FROM z GROUP BY 1, 2),"
    " g AS (SELECT source, count(*) AS n_seeds, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std FROM e GROUP BY source)"
    f" SELECT source, n_seeds, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - {T_95} * std / sqrt(n_seeds), 6) AS ci_lower, round(mean + {T_95} * std / sqrt(n_seeds), 6) AS ci_upper FROM g",
)(
    lambda s, d: stats.seed_intervals(
        scored(s, d).groupBy("source", (F.col("doc_id") % 5).alias("seed")).agg((F.floor(F.sum((F.col("clean") == F.col("gold")).cast("long")) * 1024 / F.count(F.lit(1))) / 1024).alias("score")), ["source"]
    ).select("source", "n_seeds", *rounded(6, "mean", "std", "ci_lower", "ci_upper"))
)

# ---- J: reports ------------------------------------------------------------

# Results of an evaluation: the predictors are models, English and other documents the modes, sources the benchmarks.  Scores are
# whole 1024ths, so that their sums are exact.  long has its own metric, or only accuracy, or (every fifth source) neither.
NUMBER = "CAST(substr(source, 4) AS BIGINT)"
FLAT = f"""{SCORED}, c AS (SELECT model, CASE WHEN lang = 'en' THEN 'think_off' ELSE 'think_on' END AS think_mode, z.source AS source, count(*) AS n, floor(count(*) FILTER (hit) * 1024::DOUBLE / count(*)) / 1024 AS s
  FROM (SELECT *, 'clean' AS model, clean = gold AS hit FROM z UNION ALL SELECT *, 'long', long = gold FROM z) z JOIN documents USING (doc_id) GROUP BY 1, 2, 3),
f AS (SELECT model, think_mode, source AS benchmark, 'g' || {NUMBER} % 3 AS "group", CASE model WHEN 'clean' THEN 'accuracy' ELSE 'macro_f1' END AS metric,
  CASE WHEN model = 'long' AND {NUMBER} % 5 = 0 THEN 0.0::DOUBLE ELSE s END AS score, n::INT AS n_examples, n / 4.0::DOUBLE AS inference_time FROM c)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    both = rows.select("source", F.when(F.col("lang") == "en", "think_off").otherwise("think_on").alias("mode"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) == F.col("gold")).alias("hit")) for m in ("clean", "long")])).alias("x"))
    cells = both.groupBy(F.col("x.model").alias("model"), "mode", "source").agg(F.count(F.lit(1)).alias("n"), (F.floor(F.sum(F.col("x.hit").cast("long")) * 1024 / F.count(F.lit(1))) / 1024).alias("s"))
    number = F.substring("source", 4, 10).cast("long")
    own = F.when(number % 5 == 0, F.create_map(F.lit("other"), F.col("s"))).when(number % 2 == 0, F.create_map(F.lit("macro_f1"), F.col("s"), F.lit("accuracy"), F.lit(0.25))).otherwise(F.create_map(F.lit("accuracy"), F.col("s")))
    clean = F.col("model") == "clean"
    result = F.struct(
        F.col("source").alias("task"),
        F.concat(F.lit("g"), number % 3).alias("group"),
        F.when(clean, "accuracy").otherwise("macro_f1").alias("metric_name"),
        F.when(clean, F.create_map(F.lit("accuracy"), F.col("s"))).otherwise(own).alias("metrics"),
        F.col("n").cast("int").alias("num_examples"),
        (F.col("n") / 4).alias("inference_time_sec"),
        F.col("mode").alias("think_mode"),
    )
    modes = cells.groupBy("model", "mode").agg(F.map_from_entries(F.collect_list(F.struct("source", result))).alias("per"))  # a row a benchmark and model
    return modes.groupBy(F.col("model").alias("model_name")).agg(F.map_from_entries(F.collect_list(F.struct("mode", "per"))).alias("benchmarks"))


flat = lambda s, d: reports.flatten_results(results(s, d))
query("results_flat", f"WITH {FLAT} SELECT * FROM f")(flat)
query("results_pivot", f"WITH {FLAT} SELECT model, think_mode, max(score) FILTER (benchmark = 'src0') AS src0, max(score) FILTER (benchmark = 'src1') AS src1, max(score) FILTER (benchmark = 'src2') AS src2 FROM f GROUP BY 1, 2")(lambda s, d: reports.pivot_scores(flat(s, d), ["src0", "src1", "src2"]))
query("group_pivot", f"WITH {FLAT} SELECT \"group\", avg(score) FILTER (model = 'clean') AS clean, avg(score) FILTER (model = 'long') AS long FROM f GROUP BY 1")(lambda s, d: reports.group_pivot(flat(s, d), ["clean", "long"]))
query("group_averages", f'WITH {FLAT} SELECT model, think_mode, "group", avg(score) AS avg_score, count(*) AS n_benchmarks FROM f GROUP BY 1, 2, 3')(lambda s, d: reports.group_averages(flat(s, d)))
query("best_per_benchmark", f"WITH {FLAT}, r AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY score DESC, model, think_mode) AS n FROM f) SELECT benchmark, model, think_mode, score FROM r WHERE n = 1")(lambda s, d: reports.best_per_benchmark(flat(s, d)))
query("dashboard_winner", f"WITH {FLAT}, r AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY score DESC, model) AS n FROM f WHERE think_mode = 'think_off') SELECT benchmark, model, think_mode, score FROM r WHERE n = 1")(
    lambda s, d: reports.best_per_benchmark(flat(s, d), "think_off")
)
query("comparison_cells", f"WITH {FLAT} SELECT benchmark, model, score, row_number() OVER (PARTITION BY benchmark ORDER BY score DESC, model) = 1 AS is_best FROM f WHERE think_mode = 'think_off' AND \"group\" = 'g1'")(
    lambda s, d: reports.comparison_cells(flat(s, d), group="g1")
)
query("model_ranking", f"WITH {FLAT}, a AS (SELECT model, avg(score) AS avg_score FROM f GROUP BY model) SELECT model, avg_score, row_number() OVER (ORDER BY avg_score DESC, model)::INT AS position FROM a")(lambda s, d: reports.model_ranking(flat(s, d)))
query("last_per_benchmark", f"WITH {FLAT} SELECT model, benchmark, max_by(score, think_mode) AS score FROM f GROUP BY 1, 2")(lambda s, d: reports.last_per_benchmark(flat(s, d)))
query("results_upsert", f"WITH {FLAT} SELECT model, think_mode, benchmark, score FROM f WHERE model <> 'clean' UNION ALL SELECT model, think_mode, benchmark, score / 2 FROM f WHERE model = 'clean' AND think_mode = 'think_off'")(
    lambda s, d: reports.upsert((r := flat(s, d).select("model", "think_mode", "benchmark", "score")), r.filter("model = 'clean' and think_mode = 'think_off'").withColumn("score", F.col("score") / 2), "model")
)
