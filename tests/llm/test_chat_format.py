import itertools
import random

import numpy as np

from marlstone.llm.chat_format import ROLES, STATES, Model, defaults, fit, format_conversations, line_shapes, marker, op5_chat_format, render, shape, turns


def every_path(model, lines):
    """The best score over all state sequences."""
    emissions, blank = [], False
    for x in lines:
        emissions.append(model.emission(marker(x)[0], shape(x, blank)))
        blank = not x.strip()
    best = -np.inf
    for path in itertools.product(range(len(STATES)), repeat=len(lines)):
        score = model.start[path[0]] + emissions[0][path[0]]
        for i in range(1, len(path)):
            score += model.move[path[i - 1], path[i]] + emissions[i][path[i]]
        best = max(best, score)
    return best, emissions


def test_viterbi_against_all_paths():
    rnd, model = random.Random(1), Model(*defaults())
    for _ in range(12):
        lines = [rnd.choice(["User: hi", "Assistant: yes?", "plain", "", "### System", "x" * 80, "a: b"]) for _ in range(rnd.randint(1, 5))]
        best, emissions = every_path(model, lines)
        path = [STATES.index((r, o)) for r, o, _ in model.decode(lines)]
        score = model.start[path[0]] + emissions[0][path[0]] + sum(model.move[a, b] + e[b] for a, b, e in zip(path, path[1:], emissions[1:], strict=False))
        assert abs(best - score) < 1e-9


def test_markers():
    assert [marker(x)[0] for x in ("User: a", "### Human: b", "<|assistant|>", "[SYSTEM] c", "**Bot**: d", "users: e", "plain", "A: f", "Amen")] == [1, 1, 2, 0, 2, -1, -1, 2, -1]


def test_turns_and_rendering():
    found = turns("System: be kind\nHuman: how?\nmore\n\nstill\nAI: so\nUser: thanks", Model(*defaults()))
    assert [(t["role"], t["text"]) for t in found] == [("system", "be kind"), ("user", "how?\nmore\n\nstill"), ("assistant", "so"), ("user", "thanks")]
    assert render(found[:1]) == "<|system|>\nbe kind\n<|end|>\n"
    assert turns("", Model(*defaults())) == []


def plain(rows, model):
    """conv_id -> what its row must hold; rows without an id each on their own."""
    out = []
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[0] if r[0] is not None else ("row", k), []).append(r)
    for own in groups.values():
        own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        lines = [(f"{r[2]}: " if r[2] is not None else "") + (r[3] or "") for r in own]
        want = turns("\n".join(lines), model)
        out.append((own[0][0], len(own), len(want), ",".join(t["role"] for t in want), render(want)))
    return sorted(out, key=str)


def test_conversations(spark):
    rows = [(1, 0, "user", "hello\nthere", "x"), (1, 1, "assistant", "hi", "x"), (1, 1, "assistant", "hi", "x"), (2, 0, None, "lonely", "x"), (3, None, "user", None, "x"), (None, 0, "user", "q", "x"), (None, 1, "assistant", "r", "x"), (None, 0, "user", "q", "x"), (4, 2000, "assistant", "late", "x"), (4, 0, "user", "early " * 200_000, "x"), (5, 0, "tool", "result", "x"), (5, 1, "user", "fine\nuser: x\nBot: y", "x"), (5, 2, "Human", "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, roles string")
    out = format_conversations(df).collect()
    assert sorted(((r.conv_id, r.n_turns, r.n_parsed, r.roles, r.rendered) for r in out), key=str) == plain(rows, Model(*fit(line_shapes(df))))
    got = {r.conv_id: r for r in out}
    assert got[1].roles == "user,assistant,assistant" and (got[1].n_turns, got[1].n_same, got[1].n_unknown) == (3, 3, 0)
    assert (got[5].n_turns, got[5].n_parsed, got[5].n_unknown, got[5].n_same) == (3, 5, 1, 2)
    assert sum(r.conv_id is None for r in out) == 3 and set(r for x in out for r in x.roles.split(",")) <= set(ROLES) | {""}
    assert format_conversations(df.limit(0)).count() == 0


def test_one_decoding_over_all_turns(spark, tmp_path):
    """Unmarked turns anywhere in a long conversation go on with the turn before; a conversation is one row."""
    names = ("user", "assistant")
    rows = [(1, i, None if i in (1024, 1025, 2048, 2049) or 3072 <= i < 4200 else "tool" if i == 1500 else names[i % 2], f"turn {i}") for i in range(4300)]
    rows += [(2, -1, "user", "before"), (2, 0, None, "after"), (2, None, "system", "null"), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = op5_chat_format(spark, str(tmp_path)).collect()
    assert sorted(((r.conv_id, r.n_turns, r.n_parsed, r.roles, r.rendered) for r in out), key=str) == plain(rows, Model(*fit(line_shapes(df))))
    got = {r.conv_id: r for r in out}
    assert (got[3].n_turns, got[3].n_parsed, got[3].roles, got[3].rendered) == (1, 0, "", "")
    assert "turn 1023\nturn 1024\nturn 1025\n" in got[1].rendered and "turn 2047\nturn 2048\n" in got[1].rendered
