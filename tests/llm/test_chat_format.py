import json

import pytest

from likeness.llm import chat_format as cf

SCHEMAS = {
    "add": {
        "properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "unit": {"type": "string", "enum": ["m", "s"]}},
        "required": ["a"],
        "additionalProperties": False,
    }
}


@pytest.mark.parametrize(
    ("text", "made", "fault"),
    [
        ('{"b": 1.5, "a":1}', '{"a":1,"b":1.5}', None),
        ('{"a": true}', '{"a":true}', "a is not integer"),
        ('{"b": 1}', '{"b":1}', "missing a"),
        ('{"a": 1, "c": 2}', '{"a":1,"c":2}', "unexpected c"),
        ('{"a": 1, "unit": "kg"}', '{"a":1,"unit":"kg"}', "unit is not allowed"),
        ("[1]", "[1]", "arguments are not an object"),
        ("{", '"{"', "arguments are not JSON"),
        ('{"a": NaN}', '"{\\"a\\": NaN}"', "arguments are not JSON"),
        (None, '""', "arguments are not JSON"),
    ],
)
def test_arguments(text, made, fault):
    assert cf.check_arguments("add", text, SCHEMAS) == (made, fault)
    assert cf.check_arguments("other", "{}", SCHEMAS) == ("{}", "unknown tool")


EVENTS = [
    # conv, turn, kind, role, content, call, name, after
    (1, 0, "message", "user", 'say "é"\n', None, None, None),
    (1, 1, "call", None, '{"a":1}', "x", "add", None),
    (1, 2, "result", None, '{"z":1, "b":2}', "x", None, None),
    (1, 3, "call", None, '{"a":2}', "y", "add", "z"),  # uses z, which is called later
    (1, 4, "result", None, "two", "y", None, None),
    (1, 6, "call", None, '{"a":3}', "z", "add", "x"),
    (1, 5, "result", None, "early", "z", None, None),
    (2, 0, "call", None, '{"a":1}', "p", "add", "q"),
    (2, 1, "call", None, '{"a":1}', "q", "add", "p"),
    (2, 2, "result", None, "1", "p", None, None),
    (2, 3, "result", None, "1", "q", None, None),
    (3, 0, "call", None, '{"a":"1"}', "x", "add", None),
    (3, 1, "call", None, '{"a":1}', "x", "add", None),
    (3, 2, "result", None, "1", "nobody", None, None),
    (3, 3, "call", None, '{"a":1}', "lonely", "add", "missing"),
    (None, None, None, None, None, None, None, None),
    (4, None, "call", None, None, None, None, None),
]
SCHEMA = "conv_id bigint, turn bigint, kind string, role string, content string, call_id string, name string, after string"


def test_links_order_and_json(spark):
    events = spark.createDataFrame(EVENTS, SCHEMA).selectExpr("*", "1 as row", "2 as depth", "3 as anchor")
    found = cf.format_chats(events, SCHEMAS).collect()
    assert len(found) == len(EVENTS)
    for r in found:
        value = json.loads(r.json)
        assert r.json == cf.canonical(value)
    status = {(r.conv_id, r.turn, r.kind): r.status for r in found}
    assert status[1, 1, "call"] == status[1, 2, "result"] == "linked"
    assert status[1, 5, "result"] == "early" and status[1, 6, "call"] == "linked"
    assert status[2, 0, "call"] == status[2, 1, "call"] == "cycle"
    assert status[3, 0, "call"] == "invalid: a is not integer" and status[3, 1, "call"] == "duplicate"
    assert status[3, 2, "result"] == "orphan" and status[3, 3, "call"] == "unanswered"
    order = [r for r in sorted((r for r in found if r.conv_id == 1), key=lambda r: (r.anchor, r.depth, r.part, r.turn))]
    assert [(r.kind, r.call_id) for r in order] == [
        ("message", None), ("call", "x"), ("result", "x"), ("call", "z"), ("result", "z"), ("call", "y"), ("result", "y"),
    ]
    assert next(r.json for r in order if r.kind == "message") == '{"content":"say \\"é\\"\\n","role":"user"}'
    assert next(r.json for r in order if r.kind == "result") == '{"content":{"b":2,"z":1},"id":"x","role":"tool"}'


def test_long_chain(spark):
    rows = [(9, 2 * i, "call", None, '{"a":1}', f"c{i}", "add", f"c{i - 1}" if i else None) for i in range(40)]
    rows += [(9, 2 * i + 1, "result", None, "r", f"c{i}", None, None) for i in range(40)]
    found = cf.format_chats(spark.createDataFrame(rows, SCHEMA), SCHEMAS).collect()
    assert all(r.status == "linked" for r in found)
    order = sorted(found, key=lambda r: (r.anchor, r.depth, r.part))
    assert [r.turn for r in order] == list(range(80))


def test_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "x"), (2, None, "user", "q"), (None, 1, None, None)]
    events = cf.conversation_events(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    found = cf.format_chats(events, cf.REPLY_SCHEMA).collect()
    assert sorted(r.status for r in found) == ["invalid: missing turn", "linked", "linked", "ok", "ok"]
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cf.format_chats(cf.conversation_events(empty), cf.REPLY_SCHEMA).count() == 0


@pytest.mark.parametrize(
    ("text", "made", "fault"),
    [
        ('{"a":1e999}', '"{\\"a\\":1e999}"', "arguments are not JSON"),
        ('{"a":1,"unit":"\\ud800"}', '{"a":1,"unit":"\\ud800"}', "unit is not allowed"),
        ('{"a":' + "9" * 5000 + "}", None, "arguments are not JSON"),
        ("[" * 100_000, None, "arguments are not JSON"),
    ],
)
def test_odd_arguments(text, made, fault):
    got = cf.check_arguments("add", text, SCHEMAS)
    assert got[1] == fault and (made is None or got[0] == made)
    got[0].encode()


@pytest.mark.parametrize(("value", "fault"), [("1", None), ('"x"', None), ("null", "v is not string or integer"), ("true", "v is not string or integer")])
def test_schemas_with_several_types(value, fault):
    schema = {"t": {"properties": {"v": {"type": ["string", "integer"]}, "w": {"type": "anything"}}}}
    assert cf.check_arguments("t", f'{{"v":{value},"w":2}}', schema)[1] == fault


def test_lone_surrogates_and_null_conversations(spark):
    rows = [
        (None, 0, "call", None, '{"a":1}', "x", "add", None),
        (None, 1, "result", None, '"\\ud800"', "x", None, None),
        (None, 2, "call", None, '{"a":2}', "y", "add", "x"),
        (None, 3, "call", None, '{"a":2}', "y", "add", "x"),
    ]
    found = {r.turn: r for r in cf.format_chats(spark.createDataFrame(rows, SCHEMA), SCHEMAS).collect()}
    assert [found[i].status for i in range(4)] == ["linked", "linked", "unanswered", "duplicate"]
    assert json.loads(found[1].json)["content"] == "\ud800" and found[2].depth == 1
    assert cf.canonical_text('"\\ud800"') == '"\\ud800"'
