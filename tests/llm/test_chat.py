import json
import random

import pytest

from wordloom.llm import chat as C
from wordloom.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, node string, key int"
TOOLS = [("add", '{"type":"object","required":["a"],"properties":{"a":{"type":"number"},"b":{"type":["integer","null"],"maximum":9},'
                 '"c":{"enum":["x","y"]},"d":{"type":"array","items":{"type":"string"}}},"additionalProperties":false}')]


def link(spark, rows):
    messages = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA).repartition(3)
    out = C.link(messages, spark.createDataFrame(TOOLS, "tool string, schema string"))
    assert out.columns == ["conv_id", "turn", "role", "kind", "call_id", "status", "invalid", "key", "step", "cyclic", "json"]
    return out.collect()


def call(conv, turn, i, arguments='{"a":1}', tool="add"):
    return (conv, turn, "assistant", None, i, tool, arguments)


def result(conv, turn, i, text="ok"):
    return (conv, turn, "tool", text, i, None, None)


def test_links_and_status(spark):
    rows = [(1, 0, "user", 'say "é"\n', None, None, None), call(1, 1, "k"), result(1, 2, "k"), result(1, 3, "k", "again"), call(1, 4, "k"),
            call(1, 5, "lost"), result(1, 6, "stray"), result(2, 0, "k"), call(None, 1, "k"), result(None, 2, "k"), call(1, 7, None),
            (1, 8, None, None, None, None, None), (1, 8, None, None, None, None, None)]
    got = {(r["conv_id"], r["turn"]): r for r in link(spark, rows)}
    status = {k: r["status"] for k, r in got.items()}
    assert status == {(1, 0): "message", (1, 1): "linked", (1, 2): "linked", (1, 3): "repeated", (1, 4): "repeated", (1, 5): "unanswered",
                      (1, 6): "orphan", (2, 0): "orphan", (None, 1): "unanswered", (None, 2): "orphan", (1, 7): "unanswered", (1, 8): "message"}
    assert got[1, 0]["json"] == '{"content":"say \\"é\\"\\n","role":"user"}'
    assert got[1, 2]["json"] == '{"content":"ok","role":"tool","tool_call_id":"k"}'
    assert got[1, 1]["json"] == '{"content":"","role":"assistant","tool_calls":[{"arguments":{"a":1},"id":"k","name":"add"}]}'


@pytest.mark.parametrize("arguments, tool, invalid, text", [
    ('{"b": 2.0, "a": 1.50}', "add", None, '{"a":1.5,"b":2}'), ("{}", "add", "$.a: missing", "{}"), (None, "add", "$.a: missing", "{}"),
    ('{"a": "1"}', "add", "$.a: not of type number", '{"a":"1"}'), ('{"a": true}', "add", "$.a: not of type number", '{"a":true}'),
    ('{"a":1,"b":10}', "add", "$.b: out of range", '{"a":1,"b":10}'), ('{"a":1,"c":"z"}', "add", "$.c: not one of the allowed values", '{"a":1,"c":"z"}'),
    ('{"a":1,"d":["s",1]}', "add", "$.d[1]: not of type string", '{"a":1,"d":["s",1]}'), ('{"a":1,"e":0}', "add", "$.e: unknown", '{"a":1,"e":0}'),
    ("[1]", "add", "arguments are not an object", "[1]"), ('{"a": ', "add", "arguments are not JSON", '"{\\"a\\": "'),
    ('{"z":"\\u00e9","y":{"k":[ ]}}', "none", "unknown tool", '{"y":{"k":[]},"z":"é"}'), ('{"a": NaN}', "add", "arguments are not JSON", '"{\\"a\\": NaN}"'),
    ('{"a":{"$result":"q"}}', "add", None, '{"a":{"$result":"q"}}')])
def test_arguments(spark, arguments, tool, invalid, text):
    [r] = link(spark, [call(1, 0, "k", arguments, tool)])
    assert r["invalid"] == invalid
    assert r["json"] == '{"content":"","role":"assistant","tool_calls":[{"arguments":' + text + ',"id":"k","name":"' + tool + '"}]}'
    json.loads(r["json"])


DEEP = '{"a":' * 100_000 + "1" + "}" * 100_000


@pytest.mark.parametrize("arguments, schema, invalid", [
    ('{"a":"\\ud800"}', "{}", "arguments hold half a character"), (DEEP, "{}", "arguments are nested too deeply"), ("{}", "{", "the tool's schema is not JSON"),
    ("{}", "[]", "$: unsupported schema"), ("{}", '{"unevaluatedItems":false}', "$: unsupported keyword unevaluatedItems"), ("{}", "false", "$: nothing is allowed"),
    ("{}", '{"required":3}', "the tool's schema is no JSON schema"), ('{"a":{}}', '{"properties":{"a":{"$ref":"#"}}}', None), ("{}", '{"$ref":"#"}', "the tool's schema does not end")])
def test_unreadable(spark, arguments, schema, invalid):
    messages = spark.createDataFrame([(*call(1, 0, "k", arguments), "n", 1)], SCHEMA)
    [r] = C.link(messages, spark.createDataFrame([("add", schema)], "tool string, schema string")).collect()
    assert r["invalid"] == invalid
    got = json.loads(r["json"])["tool_calls"][0]["arguments"] if arguments is not DEEP else arguments
    assert got == (arguments if invalid in C.UNREADABLE else json.loads(arguments))


VALUES = [None, True, False, 0, 1, 1.0, 1.5, -3, 10, "", "a", "ab", "abc", "é", [], [1], [1, 1.0], [1, "a"], [[]], {}, {"a": 1}, {"a": 1, "b": 2}, {"x1": "s"}]
#: A schema, and Python's own notion of what it allows.
RULES = [
    ({"type": "integer"}, lambda v: type(v) is int or type(v) is float and v == int(v)), ({"const": 1}, lambda v: v == 1 and not isinstance(v, bool)),
    ({"exclusiveMinimum": 1}, lambda v: not number(v) or v > 1), ({"exclusiveMaximum": 1}, lambda v: not number(v) or v < 1), ({"multipleOf": 0.5}, lambda v: not number(v) or v * 2 == int(v * 2)),
    ({"minLength": 2}, lambda v: not isinstance(v, str) or len(v) >= 2), ({"maxLength": 1}, lambda v: not isinstance(v, str) or len(v) <= 1), ({"pattern": "^a"}, lambda v: not isinstance(v, str) or v[:1] == "a"),
    ({"minItems": 1}, lambda v: not isinstance(v, list) or len(v) >= 1), ({"maxItems": 1}, lambda v: not isinstance(v, list) or len(v) <= 1), ({"uniqueItems": True}, lambda v: v != [1, 1]),
    ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, lambda v: not isinstance(v, list) or v in ([], [1], [1, "a"])), ({"contains": {"type": "array"}}, lambda v: not isinstance(v, list) or v == [[]]),
    ({"minProperties": 1}, lambda v: v != {}), ({"maxProperties": 1}, lambda v: not isinstance(v, dict) or len(v) < 2), ({"dependentRequired": {"a": ["b"]}}, lambda v: v != {"a": 1}),
    ({"patternProperties": {"^x": {"type": "string"}}, "additionalProperties": {"const": 1}}, lambda v: v != {"a": 1, "b": 2}), ({"propertyNames": {"maxLength": 1}}, lambda v: v != {"x1": "s"}),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, lambda v: isinstance(v, str) or not number(v) or v >= 5), ({"allOf": [{"minimum": 1}, {"maximum": 1}]}, lambda v: not number(v) or v == 1),
    ({"oneOf": [{"minimum": 1}, {"maximum": 1}]}, lambda v: number(v) and v != 1), ({"not": {"type": "string"}}, lambda v: not isinstance(v, str)),
    ({"if": {"type": "number"}, "then": {"minimum": 2}, "else": {"type": "string"}}, lambda v: v >= 2 if number(v) else isinstance(v, str)),
    ({"$defs": {"s": {"type": "string"}}, "$ref": "#/$defs/s"}, lambda v: isinstance(v, str)), ({"enum": [[1], {"a": 1.0}]}, lambda v: v in ([1], {"a": 1}))]


def number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def test_schema_keywords():
    for schema, allows in RULES:
        for v in VALUES:
            assert (C.problem(v, schema) is None) == bool(allows(v)), (schema, v)


def test_one_escaping_rule(spark):
    text = "".join(map(chr, range(32))) + '"\\\x7f\u2028'
    [r] = link(spark, [(1, 0, "assistant", text, text, text, json.dumps({"a": text}))])
    assert r["json"] == json.dumps({"content": text, "role": "assistant", "tool_calls": [{"arguments": {"a": text}, "id": text, "name": text}]},
                                   sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_order_is_topological(spark):
    r = random.Random(4)
    rows, edges = [], []
    for conv in range(6):
        ids = [f"i{k}" for k in range(12)]
        for k, i in enumerate(ids):
            refs = r.sample(ids[:k], min(k, r.randrange(3)))
            rows.append(call(conv, r.randrange(30), i, json.dumps({"a": [{"$result": x} for x in refs]})))
            rows.append(result(conv, r.randrange(30), i))
            edges += [((conv, "call", i), (conv, "result", i))] + [((conv, "result", x), (conv, "call", i)) for x in refs]
    got = {(x["conv_id"], x["kind"], x["call_id"]): x for x in link(spark, rows)}
    assert not any(x["cyclic"] for x in got.values())
    for a, b in edges:
        assert (got[a]["key"], got[a]["step"]) < (got[b]["key"], got[b]["step"])
    turns = {(c[0], "call" if c[5] else "result", c[4]): c[1] for c in rows}
    for k, x in got.items():      # no message is later than it must be
        before = [turns[a] for a, b in edges if b == k]
        assert x["key"] == max([turns[k], *[got[a]["key"] for a, b in edges if b == k]]) and x["key"] >= max(before, default=0)


def test_cycles_end(spark):
    rows = [call(1, 0, "p", '{"a":{"$result":"q"}}'), result(1, 1, "p"), call(1, 2, "q", '{"a":{"$result":"p"}}'), result(1, 3, "q"),
            (1, 4, "user", "hi", None, None, None), call(1, 5, "self", '{"a":{"$result":"self"}}'), result(1, 6, "self")]
    got = {(r["kind"], r["call_id"]): r for r in link(spark, rows)}
    assert all((r["key"], r["step"]) == (r["turn"], 0) for r in got.values() if r["cyclic"])
    assert any(r["cyclic"] for k, r in got.items() if k[1] in "pq" and k[1]) and not got["message", None]["cyclic"]


def test_empty(spark):
    assert link(spark, []) == []


def test_query(spark):
    rows = Q.QUERIES["op4_chat_formatting"](spark, "/root/testdata/sf0.001").collect()
    given = {(c["conv_id"], c["turn"]): c for c in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:
        c, m = given[r["conv_id"], r["turn"]], json.loads(r["json"])
        assert r["json"] == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and m["role"] == c["role"]
        answer = given.get((c["conv_id"], c["turn"] + (1 if c["role"] == "user" else -1)))
        if c["role"] == "user":
            arguments = m["tool_calls"][0]["arguments"]
            assert arguments["prompt"] == c["text"] and arguments["chars"] == len(c["text"])
            assert r["status"] == ("linked" if answer and answer["role"] == "assistant" else "unanswered")
        elif c["role"] == "assistant":
            assert m["content"] == c["text"] and r["status"] == ("linked" if answer and answer["role"] == "user" else "orphan")
        else:
            assert r["status"] == "message" and m["content"] == c["text"]
