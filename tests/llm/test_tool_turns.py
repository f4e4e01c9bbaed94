"""Turns of tools, functions and other roles, held against a plain queue."""

import json
import random
from collections import deque

from lexspark.llm import toolcalls

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _call(*ids):
    return "".join(f'<tool_call>{{"id": "{i}", "name": "f", "arguments": "{{}}"}}</tool_call>' for i in ids)


def test_tool_turns_answer_waiting_calls_and_no_turn_is_lost(spark):
    rows = [
        (1, 0, "tool", "early"), (1, 1, "user", "hi"), (1, 2, "assistant", _call("a", "b", "c") + '<tool_result>{"id": "b", "content": "told"}</tool_result>'), (1, 3, "tool", "one"), (1, 4, "Function", "two"), (1, 5, "tool", "three"),
        (2, 0, "tool", "alone"), (3, 0, None, "nobody"), (3, 1, "critic", None), (4, 0, "assistant", _call("x")), (4, 1, "tool", 'and <tool_result>{"id": "x", "content": "y"}</tool_result>'),
    ]
    got = {r.conv_id: (r, json.loads(r.json)) for r in toolcalls.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2, 3, 4}
    results = lambda c: {x["id"]: x.get("result") for x in got[c][1]["calls"]}
    assert {k: v for k, v in results(1).items() if k in "abc"} == {"a": "one", "b": "told", "c": "two"}
    assert [x["result"] for x in got[1][1]["orphans"]] == ["early", "three"] and [x["result"] for x in got[2][1]["orphans"]] == ["alone"]
    assert [x["result"] for x in got[3][1]["orphans"]] == ["nobody", None]
    assert results(4) == {"x": "y"} and got[4][0].n_orphans == 2  # what the assistant said, and "and"


def test_queue_is_first_in_first_out(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(60):
        queue, ids = deque(), 0
        for turn in range(12):
            if rng.random() < 0.4:
                names = [f"c{ids + i}" for i in range(rng.randint(1, 3))]
                ids += len(names)
                queue.extend(names)
                rows.append((conv, turn, "assistant", _call(*names)))
            else:
                rows.append((conv, turn, "tool", f"r{turn}"))
                want[conv, f"r{turn}"] = queue.popleft() if queue else None
    got = {}
    for r in toolcalls.format_chats(spark.createDataFrame(rows, SCHEMA)).collect():
        body = json.loads(r.json)
        got |= {(r.conv_id, x["result"]): x["id"] for x in body["calls"] + body["orphans"] if x.get("result", "<")[0] == "r"}
    assert got == want


def test_schemas_are_read_or_refused():
    import pytest

    bad = lambda v, **schema: toolcalls.violations(v, schema)
    assert bad(True, enum=[1]) and bad(1, const=True) and not bad(1.0, enum=[1]) and bad([1], const=[True]) and not bad({"a": [1]}, const={"a": [1.0]})
    assert bad(5, exclusiveMaximum=5) and bad(5, exclusiveMinimum=5) and not bad(5, minimum=5, maximum=5) and bad(0.35, multipleOf=0.1) and not bad(0.3, multipleOf=0.1)
    assert bad([1, 1.0], uniqueItems=True) and not bad([1, True, "1"], uniqueItems=True) and bad("x", anyOf=[{"type": "integer"}, {"minLength": 2}]) and not bad("xy", anyOf=[{"type": "integer"}, {"minLength": 2}])
    assert bad(3, oneOf=[{"minimum": 1}, {"minimum": 2}]) and not bad(1, oneOf=[{"minimum": 1}, {"minimum": 2}]) and bad(1, **{"not": {"type": "integer"}}) and bad([1, "a"], items={"type": "integer"}) and bad([2, 1], prefixItems=[{"const": 1}])
    assert bad({"x": 1, "y": 2}, properties={"x": {}}, additionalProperties={"type": "string"}) == ["$.y: type"] and bad({"ab": 1}, patternProperties={"^a": {"type": "string"}}, additionalProperties=False) == ["$.ab: type"]
    tree = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "properties": {"next": {"$ref": "#/$defs/node"}, "v": {"type": "integer"}}, "required": ["v"]}}}
    toolcalls.check_schema(tree)
    assert toolcalls.violations({"v": 1, "next": {"v": "x"}}, tree) == ["$.next.v: type"] and not toolcalls.violations({"v": 1, "next": {"v": 2}}, tree)
    assert bad("2024-13-01", format="date") and not bad("2024-12-01T10:00:00Z", format="date-time") and bad({"a": 1}, dependentRequired={"a": ["b"]}) and bad(1, **{"if": {"type": "integer"}, "then": {"minimum": 2}})
    for schema in ({"minimun": 1}, {"type": "int"}, {"$ref": "other.json"}, {"$ref": "#/$defs/x"}, {"format": "postcode"}, {"anyOf": [{"propertis": {}}]}, {"properties": {"a": {"unevaluatedItems": False}}}):
        with pytest.raises(toolcalls.BadSchema):
            toolcalls.check_schema(schema)


def test_canonical_json_follows_the_rfc():
    """Numbers and key order of the appendices of RFC 8785."""
    import struct

    numbers = {
        "0000000000000000": "0", "8000000000000000": "0", "0000000000000001": "5e-324", "8000000000000001": "-5e-324", "7fefffffffffffff": "1.7976931348623157e+308", "4340000000000000": "9007199254740992", "c340000000000000": "-9007199254740992",
        "4430000000000000": "295147905179352830000", "44b52d02c7e14af5": "9.999999999999997e+22", "44b52d02c7e14af6": "1e+23", "444b1ae4d6e2ef4e": "999999999999999700000", "444b1ae4d6e2ef4f": "999999999999999900000", "444b1ae4d6e2ef50": "1e+21",
        "3eb0c6f7a0b5ed8c": "9.999999999999997e-7", "3eb0c6f7a0b5ed8d": "0.000001", "41b3de4355555553": "333333333.3333332", "41b3de4355555555": "333333333.3333333", "becbf647612f3696": "-0.0000033333333333333333",
    }
    for bits, want in numbers.items():
        assert toolcalls.canonical(struct.unpack(">d", bytes.fromhex(bits))[0]) == want
    assert toolcalls.canonical({"a": 1.0}) == toolcalls.canonical({"a": 1}) == '{"a":1}' and toolcalls.canonical(9007199254740993) == "9007199254740992" and toolcalls.canonical([56.0, 4.5, 2e-3, 1e-27]) == "[56,4.5,0.002,1e-27]"
    keys = ["\u20ac", "\r", "\ufb33", "1", "\U0001f600", "\u0080", "\u00f6"]
    assert [k for k, _ in json.loads(toolcalls.canonical(dict.fromkeys(keys, 0)), object_pairs_hook=list)] == ["\r", "1", "\u0080", "\u00f6", "\u20ac", "\U0001f600", "\ufb33"]
    assert toolcalls.canonical("\x0f\n\u20ac$\"\\/") == '"\\u000f\\n\u20ac$\\"\\\\/"'


def test_turns_of_no_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 2, "tool", "c"), (None, 2, "alien", "d"), (1, 0, "user", "x"), (1, 1, "assistant", "y")]
    got = toolcalls.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.n_calls, r.n_linked, r.n_orphans) for r in got) == [(0, 0, 0, 1)] * 3 + [(0, 1, 0, 0)] * 2 + [(1, 1, 1, 0)]


def test_links_against_a_plain_version(spark):
    """Random calls and results: the n-th call of an identifier meets its n-th result, and what is left is told."""
    import random

    rng = random.Random(6)
    calls = [(rng.randint(1, 5), f"c{rng.randint(0, 6)}", rng.randint(0, 9), "f", json.dumps({"x": rng.randint(0, 9)}), []) for _ in range(120)]
    results = [(rng.randint(1, 6), f"c{rng.randint(0, 7)}", rng.randint(0, 9), f"r{rng.randint(0, 9)}") for _ in range(120)]
    schemas = {"f": {"properties": {"x": {"maximum": 4}}}}
    got = {r.conv_id: r for r in toolcalls.link(spark.createDataFrame(calls, "conv_id bigint, call_id string, seq bigint, name string, arguments string, after array<string>"), spark.createDataFrame(results, "conv_id bigint, call_id string, seq bigint, content string"), schemas).collect()}
    assert set(got) == {c[0] for c in calls} | {r[0] for r in results}
    for conv, row in got.items():
        pairs, orphans, invalid = [], [], 0
        for name in {c[1] for c in calls + results}:
            own = sorted((c[2], c[4]) for c in calls if c[:2] == (conv, name))
            found = sorted((r[2], r[3]) for r in results if r[:2] == (conv, name))
            pairs += [(name, json.loads(c[1])["x"], found[i][1] if i < len(found) else None) for i, c in enumerate(own)]
            orphans += [(name, f[1]) for f in found[len(own) :]]
            invalid += sum(json.loads(c[1])["x"] > 4 for c in own)
        body = json.loads(row.json)
        key = lambda p: tuple(map(str, p))
        assert sorted(((c["id"], c["arguments"]["x"], c.get("result")) for c in body["calls"]), key=key) == sorted(pairs, key=key)
        assert sorted((o["id"], o["result"]) for o in body["orphans"]) == sorted(orphans) and row.n_invalid == invalid and row.n_linked == sum(p[2] is not None for p in pairs)
