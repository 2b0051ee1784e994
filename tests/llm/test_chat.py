from __future__ import annotations

import json

from tessera.llm import chat

SCHEMAS = [("sum", "a", "integer", True), ("sum", "b", "number", False), ("reply", "prompt", "string", True), ("reply", "turn", "integer", True)]


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def call(i, args, *after, name="sum"):
    return {"id": i, "name": name, "arguments": args if isinstance(args, str) else json.dumps(args), "after": list(after)}


def rows(spark, turns):
    schemas = spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean")
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return chat.formatted(df, schemas).collect()


def test_real_calls(spark):
    calls = [call("c1", {"b": 2.5, "a": 1, "é": None}), call("c2", {"a": "x"}, "c1"), call("c3", "[1]", "c2", "c1"), call("c4", {"a": 4}, "c5"), call("c5", {"a": 5}, "c4"), call("c6", {"a": 6}, "c5"), call("c7", {}, name="none")]
    turns = [
        (1, 0, "user", None), (1, 1, "assistant", json.dumps({"tool_calls": calls})), (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "one"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "again"})), (1, 4, "tool", json.dumps({"tool_call_id": "lost", "content": "?"})),
        (1, 5, "assistant", json.dumps({"tool_calls": [call("c1", {"a": 9})]})), (1, 1, "assistant", json.dumps({"tool_calls": calls})), (1, 6, "tool", "no json"),
    ]
    got = rows(spark, turns)
    by = {(r.turn, r.call_id): r for r in got}
    assert len(got) == len(by) == 12
    status = {k: (r.status, r.level) for k, r in by.items() if r.kind == "call"}
    assert status == {(1, "c1"): ("linked", 0), (1, "c2"): ("pending", 1), (1, "c3"): ("pending", 2), (1, "c4"): ("cyclic", None), (1, "c5"): ("cyclic", None), (1, "c6"): ("cyclic", None), (1, "c7"): ("pending", 0), (5, "c1"): ("repeated", 0)}
    assert by[1, "c1"].canonical == canonical({"arguments": {"a": 1, "b": 2.5, "é": None}, "call_id": "c1", "errors": ["unknown é"], "level": 0, "name": "sum", "result": "one", "status": "linked"})
    assert json.loads(by[1, "c2"].canonical)["errors"] == ["a is string, not integer"]
    assert json.loads(by[1, "c3"].canonical)["errors"] == ["not an object"]
    assert json.loads(by[1, "c7"].canonical)["errors"] == ["no schema of none"]
    assert by[1, "c4"].valid and not by[1, "c2"].valid
    assert by[3, "c1"].status == "repeated" and by[4, "lost"].status == "orphan"
    assert {(r.turn, r.status) for r in got if r.kind == "message"} == {(0, "plain"), (6, "plain")}


def test_turns_of_conversations(spark):
    turns = [(7, 0, "system", "be kind"), (7, 1, "user", 'say "hi"'), (7, 2, "assistant", "hi"), (7, 3, "user", "bye"), (7, 4, "assistant", None), (7, 5, "user", "still\nthere?"), (8, 0, "assistant", "first"), (None, 0, "user", "lost"), (8, 1, None, None)]
    got = {(r.conv_id, r.turn): r for r in rows(spark, turns + turns)}
    assert len(got) == 7
    assert [(got[7, t].level, got[7, t].status) for t in (1, 3, 5)] == [(0, "linked"), (1, "linked"), (2, "pending")]
    assert got[7, 1].canonical == canonical({"arguments": {"prompt": 'say "hi"', "turn": 1}, "call_id": "reply-1", "errors": [], "level": 0, "name": "reply", "result": "hi", "status": "linked"})
    assert got[8, 0].kind == got[8, 1].kind == got[7, 0].kind == "message"
    assert got[None, 0].level is None


def test_levels_are_longest_chains(spark):
    import random

    rng = random.Random(4)
    waits = {f"c{i}": sorted({f"c{rng.randrange(i)}" for _ in range(rng.choice([1, 1, 1, 2, 3]))}) if i and rng.random() < 0.9 else [] for i in range(120)}
    waits |= {f"d{i}": [f"d{i - 1}"] if i else [] for i in range(70)} | {"x": ["y"], "y": ["z"], "z": ["x"], "w": ["x", "c1"], "v": ["w"], "s": ["s"], "g": ["gone"]}
    level = {}

    def depth(k, seen=()):
        if k in seen:
            return None
        if k not in level:
            below = [depth(n, (*seen, k)) for n in waits[k] if n in waits]
            level[k] = None if None in below else 1 + max(below, default=-1)
        return level[k]

    want = {k: depth(k) for k in waits}
    calls = spark.createDataFrame([(1, k, a) for k, a in waits.items()], "conv_id long, call_id string, after array<string>")
    assert {r.call_id: r.level for r in chat.levels(calls).collect()} == {k: v for k, v in want.items() if v is not None}


def test_nothing(spark):
    assert rows(spark, [(1, 0, "user", "x")][:0] or []) == []


def test_main_path_is_native(spark, sf_dir):
    from tessera.llm.queries import op1_chat, op2_licenses

    for query in (op1_chat, op2_licenses):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_query_covers_every_turn(spark, sf_dir):
    from tessera.llm.queries import op1_chat

    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    level, answered = {}, {k for k, r in turns.items() if r.role == "assistant" and (k[0], k[1] - 1) in turns and turns[k[0], k[1] - 1].role == "user"}
    for k, r in sorted(turns.items()):
        if r.role == "user":
            before = (k[0], k[1] - 2)
            level[k] = level[before] + 1 if (k[0], k[1] - 1) in turns and turns[k[0], k[1] - 1].role == "assistant" and before in level else 0
    got = op1_chat(spark, sf_dir).collect()
    assert {(r.conv_id, r.turn): r.level for r in got if r.kind == "call"} == level
    assert {(r.conv_id, r.turn) for r in got} == set(turns) - answered
    for r in got:
        if r.kind == "call":
            reply = turns.get((r.conv_id, r.turn + 1))
            value = {"arguments": {"prompt": turns[r.conv_id, r.turn].text, "turn": r.turn}, "call_id": r.call_id, "errors": [], "level": r.level, "name": "reply", "status": r.status}
            if reply is not None and reply.role == "assistant":
                value["result"] = reply.text
            assert r.canonical == canonical(value)
