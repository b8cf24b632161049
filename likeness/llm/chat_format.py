"""Chat formatting: link tool calls with their results and write canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import stored

# Python types of the JSON type names a schema may give.
_TYPES = {
    "string": str,
    "integer": int,
    "number": (int, float),
    "boolean": bool,
    "object": dict,
    "array": list,
    "null": type(None),
}


_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and characters as they are, but for lone surrogates, which stay escaped."""
    made = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", made)


def _parsed(text: str | None):
    """(value, its canonical form); an error for what is no JSON, numbers beyond a double among it."""
    value = json.loads(text or "", parse_constant=lambda c: 1 / 0)
    return value, canonical(value)


_NOT_JSON = (ValueError, ZeroDivisionError, RecursionError)


def _is_kind(item, kind) -> bool:
    """Whether ``item`` is of the named type, or of one of several; names JSON has not allow anything."""
    if isinstance(kind, (list, tuple)):
        return any(_is_kind(item, k) for k in kind)
    if isinstance(item, bool) and kind in ("integer", "number"):
        return False
    return isinstance(item, _TYPES.get(kind, object))


def check_arguments(name: str | None, text: str | None, schemas: Mapping[str, Mapping]) -> tuple[str, str | None]:
    """(canonical arguments or the raw text, fault or None).

    A schema is {"properties": {name: {"type": ..., "enum": [...]}}, "required": [...],
    "additionalProperties": bool}, the part of JSON Schema that tools use.  A type is a
    name or a list of names.
    """
    try:
        value, made = _parsed(text)
    except _NOT_JSON:
        return canonical(text or ""), "arguments are not JSON"
    schema = schemas.get(name or "")
    if schema is None:
        return made, "unknown tool"
    if not isinstance(value, dict):
        return made, "arguments are not an object"
    properties = schema.get("properties", {})
    for key in sorted(schema.get("required", ())):
        if key not in value:
            return made, f"missing {key}"
    for key in sorted(value):
        if key not in properties:
            if schema.get("additionalProperties", True):
                continue
            return made, f"unexpected {key}"
        kind, item = properties[key].get("type"), value[key]
        if kind and not _is_kind(item, kind):
            return made, f"{key} is not {kind if isinstance(kind, str) else ' or '.join(map(str, kind))}"
        if "enum" in properties[key] and item not in properties[key]["enum"]:
            return made, f"{key} is not allowed"
    return made, None


def _checked(schemas: Mapping[str, Mapping]):
    @F.pandas_udf("arguments string, fault string")
    def check(name: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [check_arguments(n, t, schemas) for n, t in zip(name, text)], columns=["arguments", "fault"]
        )

    return check


def canonical_text(value: str | None) -> str:
    """Content that is JSON, rewritten; other content as a JSON string."""
    try:
        return _parsed(value)[1]
    except _NOT_JSON:
        return canonical(value or "")


def _canonical_text(col: str):
    @F.pandas_udf("string")
    def rewrite(text: pd.Series) -> pd.Series:
        return pd.Series([canonical_text(t) for t in text], dtype=object)

    return rewrite(col)


def _first_of(rows: DataFrame) -> DataFrame:
    """Whether a row is the first of its identifier; the others are duplicates."""
    first = rows.filter("call_id is not null").groupBy("conv", "call_id").agg(
        F.min(F.struct("turn", "row")).alias("first")
    )
    # One small row per identifier: a hot one is a skewed join side, not a collected group.
    return rows.join(first, ["conv", "call_id"], "left").withColumn(
        "is_first", F.coalesce(F.col("first.row") == F.col("row"), F.lit(False))
    ).drop("first")


def _ordered(calls: DataFrame) -> DataFrame:
    """conv, call_id, anchor, depth of first calls by doubling pointers along ``after``.

    A call comes after the call whose result it uses: depth counts such steps and
    anchor is the latest turn among them, so sorting by (anchor, depth) is a
    topological order that keeps the turns wherever they agree with it.  A chain of n
    calls takes log2(n) rounds.  Calls on or behind a cycle never reach a start and
    get a NULL depth.
    """
    nodes = calls.select("conv", "call_id", F.col("last_turn").alias("anchor"), F.col("after").alias("up"))
    names = nodes.select("conv", F.col("call_id").alias("up"), F.lit(True).alias("_there"))
    nodes = nodes.join(names, ["conv", "up"], "left")
    nodes = nodes.select(
        "conv", "call_id", "anchor", F.when(F.col("_there"), F.col("up")).alias("up"),
        F.when(F.col("_there"), 1).otherwise(0).alias("depth"),
    )
    nodes = stored(nodes)
    longest = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(longest).bit_length() + 1):
        if not nodes.filter("up is not null").limit(1).count():
            break
        above = nodes.select(
            "conv",
            F.col("call_id").alias("up"),
            F.col("anchor").alias("up_anchor"),
            F.col("up").alias("up_up"),
            F.col("depth").alias("up_depth"),
        )
        nodes = stored(
            nodes.join(above, ["conv", "up"], "left").select(
                "conv",
                "call_id",
                F.greatest("anchor", F.coalesce("up_anchor", "anchor")).alias("anchor"),
                F.col("up_up").alias("up"),
                (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"),
            )
        )
    looped = F.col("up").isNotNull()
    return nodes.select("conv", "call_id", "anchor", F.when(~looped, F.col("depth")).alias("depth"))


def format_chats(events: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per event in canonical JSON, with what its links say.

    ``events``: conv_id, turn, kind ("message", "call" or "result"), role, content
    (text, or a call's arguments as JSON), call_id, name (of the tool), after (the
    call whose result this call uses).  Other columns are ignored, NULLs allowed
    everywhere: NULL is a conversation of its own, and a call or result without
    identifier has no partner.  Result: conv_id, anchor, depth, part (sort keys, in this order, then
    turn), turn, kind, call_id, status, json.  Status of a call: linked, unanswered,
    cycle, duplicate, or invalid: <fault>; of a result: linked, early (it stands before
    its call), orphan or duplicate; of a message: ok.  Nothing is dropped, and no
    conversation is ever gathered in one task: rows are joined by identifier.
    """
    rows = stored(
        events.select(
            F.monotonically_increasing_id().alias("row"),
            F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("null")).alias("conv"),
            *[F.col(c) for c in ("conv_id", "turn", "kind", "role", "content", "call_id", "name", "after")],
        )
    )
    made = _checked(schemas)("name", "content")
    calls = _first_of(rows.filter("kind = 'call'"))
    results = _first_of(rows.filter("kind = 'result'"))
    calls, results = stored(calls), stored(results)
    answers = results.filter("is_first").select(
        "conv", "call_id", F.col("turn").alias("result_turn"), F.lit(True).alias("answered")
    )
    linked = calls.filter("is_first").join(answers, ["conv", "call_id"], "left")
    order = _ordered(linked.withColumn("last_turn", F.greatest("turn", F.coalesce("result_turn", "turn"))))
    order = stored(order.join(linked.select("conv", "call_id", "answered", F.col("turn").alias("call_turn")), ["conv", "call_id"]))

    checked = calls.join(order.drop("call_turn"), ["conv", "call_id"], "left").withColumn("_c", made)
    call_rows = checked.select(
        "conv_id",
        "turn",
        F.coalesce("anchor", "turn").alias("anchor"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.lit(1).alias("part"),
        F.lit("call").alias("kind"),
        "call_id",
        F.when(F.col("call_id").isNotNull() & ~F.col("is_first"), "duplicate")
        .when(F.col("_c.fault").isNotNull(), F.concat(F.lit("invalid: "), F.col("_c.fault")))
        .when(F.col("call_id").isNull() | F.col("answered").isNull(), "unanswered")
        .when(F.col("depth").isNull(), "cycle")
        .otherwise("linked")
        .alias("status"),
        _json(arguments=F.col("_c.arguments"), id=_text("call_id"), name=_text("name"), role=F.lit('"assistant"')).alias("json"),
    )
    known = order.select("conv", "call_id", "anchor", "depth", "call_turn", F.lit(True).alias("called"))
    result_rows = results.join(known, ["conv", "call_id"], "left").select(
        "conv_id",
        "turn",
        F.coalesce("anchor", "turn").alias("anchor"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.lit(2).alias("part"),
        F.lit("result").alias("kind"),
        "call_id",
        F.when(F.col("call_id").isNotNull() & ~F.col("is_first"), "duplicate")
        .when(F.col("called").isNull(), "orphan")
        .when(F.col("turn") < F.col("call_turn"), "early")
        .otherwise("linked")
        .alias("status"),
        _json(content=_canonical_text("content"), id=_text("call_id"), role=F.lit('"tool"')).alias("json"),
    )
    message_rows = rows.filter("kind not in ('call', 'result') or kind is null").select(
        "conv_id",
        "turn",
        F.col("turn").alias("anchor"),
        F.lit(0).alias("depth"),
        F.lit(0).alias("part"),
        F.lit("message").alias("kind"),
        "call_id",
        F.lit("ok").alias("status"),
        _json(content=_text("content"), role=_text("role")).alias("json"),
    )
    return message_rows.unionByName(call_rows).unionByName(result_rows)


def _text(col: str):
    """A string column as a JSON string, NULL as null."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(col).cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(F.col(col).isNull(), F.lit("null")).otherwise(quoted)


def _json(**members):
    """A JSON object of finished members in the order of their names."""
    parts = []
    for i, (name, value) in enumerate(sorted(members.items())):
        parts += [F.lit((("," if i else "{") + canonical(name) + ":")), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


REPLY_SCHEMA = {
    "reply": {
        "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    }
}


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Turns as tool traffic: a user's turn calls ``reply`` and the assistant's next turn is its result.

    The identifier is that of conversation and turn; a call uses the result of the
    user turn before the last reply.  Turns of other roles are messages.
    """
    def name(turn):
        return F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), turn.cast("string"))

    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("turn")))
    return conversations.select(
        "conv_id",
        "turn",
        kind.alias("kind"),
        "role",
        F.when(kind == "call", arguments).otherwise(F.col("text")).alias("content"),
        F.when(kind == "call", name(F.col("turn"))).when(kind == "result", name(F.col("turn") - 1)).alias("call_id"),
        F.when(kind != "message", "reply").alias("name"),
        F.when((kind == "call") & (F.col("turn") >= 2), name(F.col("turn") - 2)).alias("after"),
    )
