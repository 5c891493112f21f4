import json
import random

from assimspark.llm.chat import chat_lines

CALL = lambda i, name="search", args=None, **more: {"id": i, "name": name, "arguments": {"query": "x"} if args is None else args, **more}


def turn(*calls, **more):
    return json.dumps({"tool_calls": list(calls), **more})


def result(i, content="ok"):
    return json.dumps({"content": content, "tool_call_id": i})


def lines(spark, rows):
    got = chat_lines(spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, json string")).collect()
    big = 10**9
    return sorted(got, key=lambda r: (str(r["conv_id"]), r["ord_turn"] or 0, r["part"], big if r["level"] is None else r["level"], r["place"], r["turn"] or 0, r["json"]))


def test_calls_are_linked_ordered_and_checked(spark):
    rows = [
        (1, 0, "user", "What's \"up\"?\né"),
        (1, 1, "assistant", turn(CALL("b", after=["a"]), CALL("a", args={"query": "q", "limit": 3}), CALL("c", "nope"), CALL("d", args={"limit": "3", "query": 1}), content="thinking")),
        (1, 2, "tool", result("b")), (1, 3, "tool", result("a", {"z": 1, "a": [1, 2.5]})), (1, 4, "tool", result("a", "again")), (1, 5, "tool", result("zz")),
    ]
    got = [(r["kind"], r["status"], r["linked"], r["level"], json.loads(r["json"])) for r in lines(spark, rows)]
    assert [(k, s, ln, lv) for k, s, ln, lv, _ in got] == [
        ("message", "valid", False, 0), ("message", "valid", True, 1), ("call", "valid", True, 0), ("call", "unknown_tool", False, 0), ("call", "bad_arguments", False, 0), ("call", "valid", True, 1),
        ("result", "valid", True, 1), ("result", "valid", True, 0), ("result", "repeated_id", False, 0), ("result", "orphan", False, 0)]
    assert got[0][4] == {"content": "What's \"up\"?\né", "id": "t0", "role": "user"} and got[1][4] == {"content": "thinking", "id": "t1", "reply_to": "t0", "role": "assistant"} and got[7][4] == {"content": {"z": 1, "a": [1, 2.5]}, "id": "a", "type": "result"}
    assert lines(spark, rows)[2]["json"] == '{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search","type":"call"}'


def test_cycles_chains_and_repeats(spark):
    rows = [(2, 0, "assistant", turn(CALL("x", after=["y"]), CALL("y", after=["x"]), CALL("z", after=["missing"]), CALL("z"), CALL(None)))]
    rows += [(3, t, "assistant", turn(CALL(f"k{t}", after=[f"k{t + 1}"] if t < 6 else []))) for t in range(7)]
    got = lines(spark, rows)
    two = [(json.loads(r["json"])["id"], r["status"], r["level"]) for r in got if r["conv_id"] == 2 and r["kind"] == "call"]
    assert sorted(two, key=str) == sorted([("x", "cyclic", None), ("y", "cyclic", None), ("z", "valid", 0), ("z", "repeated_id", 0), (None, "valid", 0)], key=str)
    three = {json.loads(r["json"])["id"]: (r["level"], r["ord_turn"]) for r in got if r["conv_id"] == 3 and r["kind"] == "call"}
    assert three == {f"k{t}": (6 - t, 6) for t in range(7)}


def test_plain_null_and_empty(spark):
    rows = [(1, 0, None, None), (None, 1, "user", "{bad json"), (1, None, "tool", result("q")), (1, 0, None, None), (4, 0, "user", "w " * 50_000)]
    got = lines(spark, rows)
    assert len(got) == 5 and sum(r["kind"] == "result" for r in got) == 1 and [json.loads(r["json"]) for r in got if r["conv_id"] == 1 and r["turn"] == 0] == [{"content": "", "id": "t0", "role": ""}] * 2 and [r["status"] for r in got if r["turn"] == 0] == ["unknown_role"] * 2 + ["valid"]
    assert lines(spark, rows[:0]) == []


def test_messages_and_chains_equal_brute_force(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "robot", None]
    rows = [(c, t, rng.choice(roles), rng.choice(["", "a\tb", "ü \\ \"q\"", None])) for c in range(12) for t in range(rng.choice([1, 3, 70])) if rng.random() < 0.9]
    rows += rows[:5]
    there = {(c, t) for c, t, *_ in rows}

    def chain(c, t):
        return 0 if (c, t - 1) not in there else 1 + chain(c, t - 1)

    want = []
    for c, t, role, text in rows:
        body = {"content": text or "", "id": f"t{t}"} | ({"reply_to": f"t{t - 1}"} if (c, t - 1) in there else {}) | {"role": role or ""}
        want.append((c, t, chain(c, t), "valid" if role in ("system", "user", "assistant") else "unknown_role", (c, t - 1) in there, json.dumps(body, ensure_ascii=False, separators=(",", ":"))))
    assert sorted((r["conv_id"], r["turn"], r["level"], r["status"], r["linked"], r["json"]) for r in lines(spark, rows)) == sorted(want)


def by_hand(rows, schemas):
    """(conv, turn, kind, id, status, linked, level, ord_turn) of all calls and results, by plain loops."""
    kinds = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict}

    def fits(value, kind):
        if kind == "number":
            return isinstance(value, (int, float)) and not isinstance(value, bool)
        return isinstance(value, kinds[kind]) and not (kind == "integer" and isinstance(value, bool))

    def status(name, args):
        if name not in schemas:
            return "unknown_tool"
        known = schemas[name]
        good = isinstance(args, dict) and args.keys() <= known.keys() and all((p in args and fits(args[p], k)) or (p not in args and not need) for p, (k, need) in known.items())
        return "valid" if good else "bad_arguments"

    out = []
    for conv in {c for c, *_ in rows}:
        calls, results, owner = [], [], {}
        for _, t, role, text in sorted(r for r in rows if r[0] == conv):
            body = json.loads(text)
            for place, c in enumerate(body.get("tool_calls", [])):
                calls.append((t, place, c))
                owner.setdefault(c["id"], (t, place, c))
            if "tool_call_id" in body:
                results.append((t, body["tool_call_id"]))
        level, floor = {}, {}
        while True:
            new = {}
            for i, (t, _, c) in owner.items():
                needs = {n for n in c.get("after", []) if n in owner}
                if i not in level and needs <= level.keys():
                    new[i] = (1 + max((level[n] for n in needs), default=-1), max([t, *(floor[n] for n in needs)]))
            if not new:
                break
            level |= {i: a for i, (a, _) in new.items()}
            floor |= {i: b for i, (_, b) in new.items()}
        answers = {i: min(((t <= owner[i][0], t) for t, j in results if j == i), default=None) for i in owner}
        for t, place, c in calls:
            i, own = c["id"], owner[c["id"]][:2] == (t, place)
            s = "repeated_id" if not own else "cyclic" if i not in level else status(c["name"], c["arguments"])
            out.append((conv, t, "call", i, s, own and answers[i] is not None, level.get(i) if own else 0, floor.get(i, t) if own else t))
        for t, i in results:
            first = i in owner and answers[i][1] == t
            out.append((conv, t, "result", i, "orphan" if i not in owner else "valid" if first else "repeated_id", first, level.get(i, 0), max(t, floor.get(i, owner[i][0])) if i in owner else t))
    return sorted(out, key=str)


def test_calls_and_results_equal_brute_force(spark):
    schemas = {"find": {"query": ("string", True), "limit": ("integer", False), "deep": ("boolean", False)}, "sum": {"values": ("array", True), "scale": ("number", False), "options": ("object", False)}, "none": {}}
    values = ["x", 3, 2.5, True, [1, "a"], {"k": 1}, None]
    rng, rows = random.Random(11), []
    for conv in range(14):
        ids = [f"i{k}" for k in range(rng.choice([3, 8, 25]))]
        made, turns = [], 0
        for i in ids:
            name = rng.choice(["find", "sum", "none", "other"])
            args = {p: rng.choice(values[:-1] if rng.random() < 0.5 else {"string": ["q"], "integer": [4], "boolean": [False], "array": [[1]], "number": [1.5, 2], "object": [{"a": {}}]}[k]) for p, (k, need) in schemas.get(name, {}).items() if need and rng.random() < 0.95 or rng.random() < 0.4}
            args |= {"odd": 1} if rng.random() < 0.1 else {}
            pool = ids[:ids.index(i)][-4:] if conv % 3 else ids
            after = rng.sample(pool, min(len(pool), rng.choice([0, 1, 1, 1, 2, 3]))) + (["gone"] if rng.random() < 0.1 else [])
            made.append({"id": rng.choice(ids) if rng.random() < 0.05 else i, "name": name, "arguments": args, "after": after})
        rng.shuffle(made)
        while made:
            part, made = made[:rng.choice([1, 2, 4])], made[4:] if len(made) > 4 and rng.random() < 0.1 else made[1:] if len(made) < 2 else made[2:]
            rows.append((conv, turns, "assistant", json.dumps({"tool_calls": part})))
            turns += 1
            for c in part:
                for _ in range(rng.choice([0, 1, 1, 1, 2])):
                    rows.append((conv, turns, "tool", result(rng.choice([c["id"]] * 8 + ["stray"]))))
                    turns += 1
    want = by_hand(rows, schemas)
    got = chat_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), schemas).where("kind <> 'message'").collect()
    assert sorted(((r["conv_id"], r["turn"], r["kind"], json.loads(r["json"])["id"], r["status"], r["linked"], r["level"], r["ord_turn"]) for r in got), key=str) == want
    statuses = {(w[2], w[4]) for w in want}
    assert statuses >= {("call", "valid"), ("call", "cyclic"), ("call", "bad_arguments"), ("call", "unknown_tool"), ("call", "repeated_id"), ("result", "valid"), ("result", "orphan"), ("result", "repeated_id")} and max(w[6] or 0 for w in want) > 4


def test_long_chains_take_few_rounds(spark):
    n = 3000
    rows = [(1, t, "assistant", turn(CALL(f"k{t}", after=[f"k{t - 1}"] if t else []))) for t in range(n)] + [(2, 0, "assistant", turn(*(CALL(f"c{t}", after=[f"c{(t + 1) % 5}"]) for t in range(5)), CALL("on", after=["c0"])))]
    got = chat_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    assert sorted((json.loads(r["json"])["id"], r["level"], r["status"]) for r in got if r["conv_id"] == 1) == sorted((f"k{t}", t, "valid") for t in range(n))
    assert {r["status"] for r in got if r["conv_id"] == 2} == {"cyclic"}
