import itertools
import random

import pytest

from corpusmill.llm import role_repair as rr


def legal(states):
    at = rr.START
    for s in states:
        if s not in rr.NEXT[at]:
            return False
        at = s
    return at in (rr.START, rr.ASSISTANT)


def least_cost(roles):
    """Dijkstra over (turns read, state), one elementary step at a time."""
    import heapq

    queue, done = [(0, 0, rr.START)], set()
    while queue:
        cost, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(roles) and state in (rr.ASSISTANT, rr.START):
            return cost
        for target in rr.NEXT[state]:
            heapq.heappush(queue, (cost + rr.INSERT, i, target))
            if i < len(roles):
                heapq.heappush(queue, (cost + (0 if roles[i] == target else rr.RELABEL), i + 1, target))
        if i < len(roles) and state != rr.START:
            heapq.heappush(queue, (cost + rr.MERGE + (0 if roles[i] == state else rr.RELABEL), i + 1, state))


def test_cost_is_least_for_all_short_sequences():
    for n in range(1, 6):
        for roles in itertools.product((-1, 1, 2, 3), repeat=n):
            matrix = [rr.solve(list(roles), s)[0] for s in range(4)]
            assert rr.chain([matrix])[0] == least_cost(roles)


@pytest.mark.parametrize("piece", [1, 3, 256])
def test_repaired_conversations_are_legal_and_cheapest(spark, piece):
    rng = random.Random(piece)
    names = ["system", "user", "assistant", "Human", "gpt", None, "tool", " USER "]
    chats = {c: [rng.choice(names) for _ in range(rng.randrange(1, 12))] for c in range(40)}
    rows = [(c, t, r, f"text {c}.{t}") for c, roles in chats.items() for t, r in enumerate(roles)]
    rows += [(50, None, "user", None), (50, 3, "assistant", ""), (50, 3, "assistant", ""), (None, 0, "user", "nobody")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(3)
    fixed = rr.repair_turns(df, piece).collect()
    assert len(fixed) == len(rows)
    texts = {r["conv_id"]: r for r in rr.render_conversations(rr.repair_turns(df, piece)).collect()}
    states = {f"<|{r}|>": i + 1 for i, r in enumerate(rr.ROLES)}
    for c, roles in chats.items():
        assert texts[c]["cost"] == least_cost([rr.known_role(r) for r in roles])
        shown = [states[x] for x in texts[c]["text"].split("\n") if x in states]
        assert legal(shown) and texts[c]["text"].count(rr.CLOSE) == len(shown)
        assert all(f"text {c}.{t}" in texts[c]["text"] for t in range(len(roles)))
        paid = sum(rr.MERGE * (r["action"] == "merge") + rr.RELABEL * r["relabelled"] + rr.INSERT * r["inserted"] for r in fixed if r["conv_id"] == c)
        assert paid == texts[c]["cost"]
    assert texts[None]["text"] == "<|user|>\nnobody<|end|>\n<|assistant|>\n<|end|>\n"
    assert texts[50]["cost"] == rr.MERGE


@pytest.mark.parametrize("piece", [4, 256])
def test_crowded_turns(spark, piece):
    """Many rows of one turn, of no turn and of no conversation are cut into pieces, and cost what they cost in one."""
    rng = random.Random(piece)
    rows = [(1, None, "user", "x")] * 3000 + [(1, 7, rng.choice(["user", "assistant", None, "tool"]), f"t{i}") for i in range(3000)]
    rows += [(None, 2, "assistant", "y")] * 2500 + [(None, 3, "user", "z"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    fixed = rr.repair_turns(df, piece).collect()
    assert sorted((str(r["conv_id"]), str(r["turn"]), str(r["role"])) for r in fixed) == sorted((str(c), str(t), str(r)) for c, t, r, _ in rows)
    sizes = {}
    for r in fixed:
        key = r["conv_id"], r["piece"], r["sub_piece"]
        sizes[key] = sizes.get(key, 0) + 1
    assert max(sizes.values()) <= 4 * piece + 8
    last = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")
    for conv in (1, 2, None):
        roles = [rr.known_role(r[2]) for r in sorted((r for r in rows if r[0] == conv), key=last)]
        assert {r["cost"] for r in fixed if r["conv_id"] == conv} == {least_cost(roles)}
        paid = sum(rr.MERGE * (r["action"] == "merge") + rr.RELABEL * r["relabelled"] + rr.INSERT * r["inserted"] for r in fixed if r["conv_id"] == conv)
        assert paid == least_cost(roles)


def test_empty(spark):
    assert rr.repair_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
