"""Conversations: column normal forms, templates, thought blocks, completion masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import SPACE, let, strip

# Markers of turns and of thought.
TURN_OPEN, TURN_CLOSE = "<|turn>", "<turn|>"
THINK = "<|think|>"
CHANNEL_OPEN, CHANNEL_CLOSE = "<|channel>thought", "<channel|>"
MODEL_PREFIX = TURN_OPEN + "model\n"
EMPTY_THOUGHT = f"{THINK}\n{CHANNEL_OPEN}\n{CHANNEL_CLOSE}\n"
THOUGHT = rf"(?s)<\|channel>thought{SPACE}*(.*?){SPACE}*(?:<channel\|>|\z)|<think>{SPACE}*(.*?){SPACE}*(?:</think>|\z)"
THOUGHT_CHANNEL = r"(?s)<\|channel>thought\n?(.*?)(?:\n?<channel\|>|\z)"
THOUGHT_TAG = r"(?s)<think>(.*?)(?:</think>|\z)"
IGNORED = -100


def gather(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """key, messages: array of (role, content) in order."""
    m = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def _joined(messages: Column, render) -> Column:
    return F.array_join(F.transform(messages, render), "")


def format_chat(messages: Column, generate: bool = False, think: bool = False) -> Column:
    """User and model turns; system and unknown roles are left out; assistant is model."""
    thought = (lambda c: F.concat(F.lit(CHANNEL_OPEN + "\n"), c, F.lit("\n" + CHANNEL_CLOSE))) if think else (lambda c: c)
    text = _joined(
        messages,
        lambda m: F.when(m["role"] == "user", F.concat(F.lit(TURN_OPEN + "user\n"), m["content"], F.lit(TURN_CLOSE + "\n")))
        .when(m["role"].isin("model", "assistant"), F.concat(F.lit(MODEL_PREFIX), thought(m["content"]), F.lit(TURN_CLOSE + "\n")))
        .otherwise(""),
    )
    return F.concat(text, F.lit(MODEL_PREFIX + (CHANNEL_OPEN + "\n" if think else ""))) if generate else text


def manual_template(messages: Column, generate: bool = False) -> Column:
    """Every role as given."""
    text = _joined(messages, lambda m: F.concat(F.lit(TURN_OPEN), m["role"], F.lit("\n"), m["content"], F.lit(TURN_CLOSE + "\n")))
    return F.concat(text, F.lit(MODEL_PREFIX)) if generate else text


def baseline_template(messages: Column, training: bool = False, shots: Column | None = None, prefix: str = "", suffix: str = "", user: tuple[str, str] = ("Pergunta: ", "\n"), model: tuple[str, str] = ("Resposta: ", "\n\n"), separator: str = "---\n") -> Column:
    """A template for models without chat turns; all roles but model are formatted as user."""

    def body(m: Column) -> Column:
        return _joined(m, lambda x: F.when(x["role"] == "model", F.concat(F.lit(model[0]), x["content"], F.lit(model[1]))).otherwise(F.concat(F.lit(user[0]), x["content"], F.lit(user[1]))))

    parts = [F.lit(prefix)]
    if shots is not None:
        parts += [body(shots), F.lit(separator)]
    parts.append(body(messages))
    if not training:
        parts.append(F.lit(model[0]))
    return F.concat(*parts, F.lit(suffix))


def inject_think(text: Column, mode: str, training: bool) -> Column:
    """on: the think mark after the model prefix; budget: an empty thought; off and unknown modes: unchanged."""
    addition = {"on": THINK + "\n", "budget": EMPTY_THOUGHT}.get(mode)
    if addition is None:
        return text
    if not training:
        return F.when(F.endswith(text, F.lit(MODEL_PREFIX)), F.concat(text, F.lit(addition))).otherwise(text)
    return F.when(F.contains(text, F.lit(THINK)), text).otherwise(F.replace(text, F.lit(MODEL_PREFIX), F.lit(MODEL_PREFIX + addition)))


def strip_thought(text: Column) -> Column:
    """Both forms of thought go, unfinished ones too; three line ends or more become two; stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, THOUGHT, ""), r"\n{3,}", "\n\n"))


def strip_thought_output(text: Column) -> Column:
    """As a scorer does it: one form after the other, line ends stay."""
    return strip(F.regexp_replace(F.regexp_replace(text, THOUGHT_CHANNEL, ""), THOUGHT_TAG, ""))


def extract_thoughts(text: Column) -> Column:
    """All thoughts, joined by line ends."""
    both = F.zip_with(F.regexp_extract_all(text, F.lit(THOUGHT), F.lit(1)), F.regexp_extract_all(text, F.lit(THOUGHT), F.lit(2)), lambda a, b: strip(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))
    return F.array_join(F.filter(both, lambda x: x != ""), "\n")


def extract_thought_output(text: Column) -> Column:
    """The first thought of the first form that is there."""
    return F.when(text.rlike(THOUGHT_CHANNEL), strip(F.regexp_extract(text, THOUGHT_CHANNEL, 1))).when(text.rlike(THOUGHT_TAG), strip(F.regexp_extract(text, THOUGHT_TAG, 1))).otherwise("")


def normalize_columns(rows: DataFrame) -> DataFrame:
    """messages from instruction/output(/input), conversations(from, value), messages or prompt/response columns."""
    have = set(rows.columns)
    pair = lambda u, m: F.array(F.struct(F.lit("user").alias("role"), u.alias("content")), F.struct(F.lit("model").alias("role"), m.alias("content")))
    if {"instruction", "output"} <= have:
        user = F.col("instruction")
        if "input" in have:
            user = F.concat(user, F.when(F.coalesce("input", F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("input"))).otherwise(""))
        return rows.select(*_rest(rows, "instruction", "output", "input"), pair(user, F.col("output")).alias("messages"))
    if "conversations" in have:
        turns = F.transform("conversations", lambda t: F.struct(F.when(t["from"].isin("human", "user"), "user").otherwise("model").alias("role"), t["value"].alias("content")))
        return rows.select(*_rest(rows, "conversations"), turns.alias("messages"))
    if "messages" in have or not {"prompt", "response"} <= have:
        return rows
    return rows.select(*_rest(rows, "prompt", "response"), pair(F.col("prompt"), F.col("response")).alias("messages"))


def _rest(rows: DataFrame, *gone: str) -> list[str]:
    return [c for c in rows.columns if c not in gone]


def preference_format(rows: DataFrame) -> DataFrame:
    """prompt with the template and the generation suffix; chosen and rejected as they are."""
    user = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return rows.withColumn("prompt", format_chat(user, generate=True))


def _find(ids: Column, pattern: list[int]) -> Column:
    """1-based places at which a token pattern begins."""
    n = len(pattern)
    places = F.sequence(F.lit(1), F.greatest(F.size(ids) - n + 1, F.lit(1)))
    return F.filter(places, lambda i: F.slice(ids, i, n) == F.array(*[F.lit(p) for p in pattern]))


def completion_mask(ids: Column, response: list[int], turn: list[int], keep_if_absent: bool = True) -> Column:
    """Labels: ids after each response marker up to the next turn marker, -100 elsewhere.

    Without a response marker all labels are kept, or all masked for a collator (keep_if_absent=False).
    """
    size, after = F.size(ids), len(response)

    def spans(places: Column) -> Column:
        ends = lambda s: F.array_min(F.filter(places["ends"], lambda e: e >= s + after))
        return F.transform(places["starts"], lambda s: F.struct((s + after).alias("lo"), F.coalesce(ends(s), size + 1).alias("hi")))

    def labels(kept: Column) -> Column:
        inside = lambda i: F.exists(kept, lambda p: (i + 1 >= p["lo"]) & (i + 1 < p["hi"]))
        absent = ids if keep_if_absent else F.transform(ids, lambda x: F.lit(IGNORED))
        return F.when(F.size(kept) == 0, absent).otherwise(F.transform(ids, lambda x, i: F.when(inside(i), x).otherwise(F.lit(IGNORED))))

    places = F.struct(_find(ids, response).alias("starts"), _find(ids, turn).alias("ends"))
    return let(let(places, spans), labels)
