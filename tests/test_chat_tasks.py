import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chat, tasks

M = "array<struct<role:string,content:string>>"
TALK = [("system", "s"), ("user", "oi"), ("assistant", "olá"), ("tool", "t"), ("user", "e?"), ("model", "sim")]


def one(spark, column, value, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}").select(column(F.col("x"))).first()[0]


def test_templates(spark):
    assert one(spark, chat.format_chat, TALK, M) == "<|turn>user\noi<turn|>\n<|turn>model\nolá<turn|>\n<|turn>user\ne?<turn|>\n<|turn>model\nsim<turn|>\n"
    assert one(spark, lambda x: chat.format_chat(x, True, True), TALK[1:3], M) == "<|turn>user\noi<turn|>\n<|turn>model\n<|channel>thought\nolá\n<channel|><turn|>\n<|turn>model\n<|channel>thought\n"
    assert one(spark, lambda x: chat.manual_template(x, True), TALK[:2], M) == "<|turn>system\ns<turn|>\n<|turn>user\noi<turn|>\n<|turn>model\n"
    assert one(spark, chat.baseline_template, [("system", "s"), ("model", "m"), ("x", "y")], M) == "Pergunta: s\nResposta: m\n\nPergunta: y\nResposta: "
    assert one(spark, lambda x: chat.baseline_template(x, True, shots=x, prefix="P", suffix="S"), [("user", "u")], M) == "PPergunta: u\n---\nPergunta: u\nS"


@pytest.mark.parametrize("mode,training,given,expected", [
    ("off", True, "a<|turn>model\n", "a<|turn>model\n"), ("on", False, "a<|turn>model\n", "a<|turn>model\n<|think|>\n"), ("on", False, "a", "a"),
    ("on", True, "<|turn>model\nx<|turn>model\ny", "<|turn>model\n<|think|>\nx<|turn>model\n<|think|>\ny"), ("on", True, "<|think|><|turn>model\n", "<|think|><|turn>model\n"),
    ("budget", False, "<|turn>model\n", "<|turn>model\n<|think|>\n<|channel>thought\n<channel|>\n"), ("other", False, "z", "z"),
])
def test_think_modes(spark, mode, training, given, expected):
    assert one(spark, lambda x: chat.inject_think(x, mode, training), given) == expected


def test_thoughts(spark):
    texts = ["<think>a</think>\n\n\n\nb", "<|channel>thought\nx\n<channel|>y", "sem", "<think>aberto", "1<think>p</think>2<|channel>thought q <channel|>3", "<think></think>z"]
    pattern = re.compile(r"<\|channel>thought\s*(.*?)\s*(?:<channel\|>|$)|<think>\s*(.*?)\s*(?:</think>|$)", re.S)
    for t in texts:
        assert one(spark, chat.strip_thought, t) == re.sub(r"\n{3,}", "\n\n", pattern.sub("", t)).strip()
        assert one(spark, chat.extract_thoughts, t) == "\n".join(x for x in ((a or b).strip() for a, b in pattern.findall(t)) if x)
    assert one(spark, chat.strip_thought_output, texts[0]) == "b" and one(spark, chat.extract_thought_output, texts[4]) == "q"


def test_column_forms(spark):
    alpaca = spark.createDataFrame([("faça", "isto", "feito"), ("faça", "", "ok"), ("x", None, "y")], "instruction string, input string, output string")
    assert [[tuple(m) for m in r["messages"]] for r in chat.normalize_columns(alpaca).collect()] == [[("user", "faça\n\nisto"), ("model", "feito")], [("user", "faça"), ("model", "ok")], [("user", "x"), ("model", "y")]]
    pair = spark.createDataFrame([("p", "r")], "prompt string, response string")
    assert [tuple(m) for m in chat.normalize_columns(pair).first()["messages"]] == [("user", "p"), ("model", "r")]
    pref = spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string")
    assert tuple(chat.preference_format(pref).first()) == ("<|turn>user\np<turn|>\n<|turn>model\n", "c", "r")


def brute_mask(ids, response, turn, keep):
    find = lambda p: [i for i in range(len(ids) - len(p) + 1) if ids[i : i + len(p)] == p]
    starts = find(response)
    if not starts:
        return list(ids) if keep else [-100] * len(ids)
    out = [-100] * len(ids)
    for s in starts:
        lo = s + len(response)
        hi = min((e for e in find(turn) if e >= lo), default=len(ids))
        out[lo:hi] = ids[lo:hi]
    return out


def test_completion_masks(spark):
    for ids in ([1, 5, 2, 3, 7, 8, 1, 6, 2, 3, 9], [4, 4], [2, 3], [2, 3, 1, 2, 3], [1]):
        for keep in (True, False):
            got = one(spark, lambda x: chat.completion_mask(x, [2, 3], [1], keep), ids, "array<int>")
            assert got == brute_mask(ids, [2, 3], [1], keep)


LETTERS = {
    "A": "A", "b": "B", "C) porque": "C", "D. texto": "D", "Resposta: E": "E", "a resposta é b": "B", "(d) talvez": "D", "E": "E", "e: final": "E", "A alternativa correta é a letra C": "A", "portanto, a opção D": "D",
    "nenhuma": "", "AB": "A", "42": "", "Answer: c": "C", "A casa caiu": "", "x (A) y (B)": "A", "": "", "A resposta longa sem letra": "",
}


def test_letters(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in LETTERS], "x string").select("x", tasks.extract_letter(F.col("x"))).collect()}
    assert got == LETTERS


def test_other_parsers(spark):
    assert one(spark, tasks.parse_math, "o valor é 3,5 cm") == "3.5" and one(spark, tasks.parse_math, "(C)") == "C"
    assert one(spark, tasks.parse_hellaswag, "opcao 2") == "C" and one(spark, tasks.parse_hellaswag, "E") == ""
    assert one(spark, tasks.parse_rte, "It is not entailment") == "not_entailment" and one(spark, tasks.parse_rte, "Entailment") == "entailment"


def test_adapters(spark):
    adapt = lambda task, schema, row: tasks.ADAPTERS[task](spark.createDataFrame([row], schema)).first().asDict(recursive=True)
    assert adapt("bluex", "question string, choices struct<text:array<string>,label:array<string>>, answerKey string", ("q", (["y", "x"], ["B", "A"]), "B")) == {"question": "q", "options": ["x", "y"], "answer": "B"}
    assert adapt("copa_pt", "premise string, choice1 string, choice2 string, question string, label int", ("p", "a", "b", "cause", 1)) == {"question": "p porque...", "options": ["a", "b"], "answer": "B"}
    assert adapt("math_pt", "problem string, choices map<string,string>, answer string", ("p", {"B": "2", "A": "1"}, "A"))["options"] == ["1", "2"]
    assert adapt("legalbench_br", "sentence string, label int", ("s", 2))["answer"] == "C"
    assert adapt("assin2_rte", "premise string, hypothesis string, entailment_judgment int", ("p", "h", 1))["label"] == "entailment"
    assert adapt("rte_pt", "premise string, hypothesis string, label int", ("p", "h", 1))["label"] == "not_entailment"
    assert adapt("hatebr", "instagram_comments string, offensive_language boolean", ("t", True)) == {"text": "t", "label": "odio"}
    assert adapt("tweet_sentbr", "sentence string, label string", ("t", "Positive")) == {"text": "t", "label": "positivo"}
    assert adapt("boolq_pt", "passage string, question string, label int", ("p", "q", 1))["answer"] is True
    assert adapt("enem", "question string, alternatives array<string>, label string", ("q", ["a"], "A")) == {"question": "q", "options": ["a"], "answer": "A"}
    assert adapt("broverbs", "input string, alternatives array<string>, correct_index int", ("i", ["a", "b"], 1))["answer"] == "B"
    assert adapt("publichearing_br", "transcricao string, metadados struct<assunto:string>, materia string", ("t", (" Saúde ",), "m")) == {"text": "t", "label": "saúde", "summary": "m"}
    assert adapt("lener_br", "id string, tokens array<string>, ner_tags array<string>", ("1", ["a", "b"], ["O", "B-X"]))["text"] == "a b"
    assert set(tasks.PARSERS) == set(tasks.ADAPTERS) and set(tasks.ADAPTERS) <= set(tasks.INSTRUCTIONS)


def test_prompts(spark):
    rows = spark.createDataFrame([("Qual?", ["x", "y"], "B")], "question string, options array<string>, answer string")
    shot = rows.select(tasks.example_text(rows, "enem", True)).first()[0]
    assert shot == "Pergunta: Qual?\nA) x\nB) y\nResposta: B"
    assert rows.select(tasks.task_prompt(rows, "enem", [shot])).first()[0] == tasks.INSTRUCTIONS["enem"] + f"\n\n{shot}\n\nPergunta: Qual?\nA) x\nB) y\nResposta:"
    boolq = spark.createDataFrame([("p", "q", False)], "passage string, question string, answer boolean")
    assert boolq.select(tasks.example_text(boolq, "boolq_pt", True)).first()[0] == "Texto: p\n\nPergunta: q\nResposta: não"


def test_few_shot_split(spark):
    rows = spark.range(14)
    assert [x.count() for x in tasks.few_shot_split(rows, 3, "id")] == [3, 11]
    assert [x.count() for x in tasks.few_shot_split(rows, 4, "id")] == [0, 14]
