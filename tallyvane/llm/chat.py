"""Chat formatting: tool-call linking, in DataFrame and SQL functions only.

Messages (conv_id, turn, role, text, call_id, tool, arguments, after) become one canonical JSON line each:

* calls (role `call`) and results (role `result`) are joined by (conv_id, call_id). Of calls repeated under one
  identifier the first by (turn, text) is the call and the others are `repeated_call`; the first of its results is
  `linked`, later ones are `repeated_result`, results without a call `orphan_result`, calls without a result
  `unanswered`, and calls or results without an identifier `unnamed`.
* order: a result comes after its call, a call after the results that it names in `after`. A message's order_turn
  is the greatest turn among itself and all it depends on, order_depth its steps behind the last message that set
  that turn; sorting a conversation by (order_turn, order_depth, turn, role, call_id) is topological. Both are
  found over the links alone: each message points at the message it waits for longest, pointers are doubled, and
  messages choose anew until none has a longer wait, so a chain of n links takes log n rounds. Links that run forward
  settle at once. Messages on a cycle, or behind one, are `cyclic` and keep their own turn.
* arguments are checked against the tool's schema (types, required, enum, minLength, additionalProperties; an
  enum's values by type, 1 and 1.0 alike) and serialised with sorted keys.

Lines are rows, never gathered by conversation, so a conversation of any length is no hot group; calls, results and
their order are joined by hash, the hashed side having one row for each identifier. Null text is left out of the line; arguments that are not JSON are kept as a string and
reported; a null conversation or identifier links with nothing. Repeated rows give repeated lines. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove

COLUMNS = ["conv_id", "turn", "role", "text", "call_id", "tool", "arguments", "after"]
_TYPES = {
    "string": lambda t: t == "STRING",
    "integer": lambda t: t == "BIGINT",
    "number": lambda t: t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"),
    "boolean": lambda t: t == "BOOLEAN",
    "array": lambda t: t.startswith("ARRAY"),
    "object": lambda t: t.startswith("OBJECT"),
    "null": lambda t: t == "VOID",
}


def _is_value(at: Column, kind: Column, value: object) -> Column:
    """Whether a variant is a given JSON value, type and all."""
    if isinstance(value, bool) or value is None:
        return (kind == ("VOID" if value is None else "BOOLEAN")) & (F.to_json(at) == json.dumps(value))
    if isinstance(value, (int, float)):
        return _TYPES["number"](kind) & (F.try_variant_get(at, "$", "double") == float(value))
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(at, "$", "string") == value)
    # members of a variant stand in the order of their names, as sort_keys has them
    return F.to_json(at) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def argument_errors(arguments: Column, tool: Column, schemas: dict[str, dict]) -> Column:
    """Sorted messages of what is wrong with a call's arguments (JSON text) under its tool's JSON schema."""
    value = F.try_parse_json(arguments)
    checks = [F.when(~F.coalesce(tool.isin(*schemas), F.lit(False)), F.lit("unknown tool")), F.when(value.isNull(), F.lit("arguments are not JSON"))]
    keys = F.json_object_keys(F.when(value.isNotNull(), arguments))
    for name, schema in sorted(schemas.items()):
        mine = (tool == name) & value.isNotNull()
        checks.append(F.when(mine & ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), F.lit("arguments are not an object")))
        for key, rule in sorted(schema.get("properties", {}).items()):
            at = F.try_variant_get(value, f"$['{key}']", "variant")
            kind = F.schema_of_variant(at)
            if key in schema.get("required", []):
                checks.append(F.when(mine & at.isNull(), F.lit(f"{key}: missing")))
            if rule.get("type"):
                kinds = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
                checks.append(F.when(mine & at.isNotNull() & ~reduce(lambda a, b: a | b, (_TYPES[k](kind) for k in kinds)), F.lit(f"{key}: not {' or '.join(kinds)}")))
            text = F.try_variant_get(value, f"$['{key}']", "string")
            if "enum" in rule:
                checks.append(F.when(mine & at.isNotNull() & ~F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(_is_value(at, kind, x), F.lit(False)) for x in rule["enum"]), F.lit(False)), F.lit(False)), F.lit(f"{key}: not an allowed value")))
            if "minLength" in rule:
                checks.append(F.when(mine & (kind == "STRING") & (F.char_length(text) < rule["minLength"]), F.lit(f"{key}: too short")))
        if schema.get("additionalProperties") is False:
            known = F.array(*[F.lit(k) for k in sorted(schema.get("properties", {}))]).cast("array<string>")
            extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), known)
            checks.append(F.when(mine & (F.size(extra) > 0), F.concat(F.lit("unexpected: "), F.array_join(F.array_sort(extra), ","))))
    return F.array_sort(F.filter(F.array(*checks), lambda x: x.isNotNull()))


def canonical_line(role: Column, text: Column, call_id: Column, tool: Column, arguments: Column) -> Column:
    """One JSON object with sorted keys at every level, without white space or null members."""
    value = F.try_parse_json(arguments)
    parsed = F.struct(value.alias("arguments"), call_id.alias("call_id"), text.alias("content"), role.alias("role"), tool.alias("tool"))
    raw = F.struct(arguments.alias("arguments"), call_id.alias("call_id"), text.alias("content"), role.alias("role"), tool.alias("tool"))
    return F.when(value.isNotNull(), F.to_json(parsed)).otherwise(F.to_json(raw))


def _order(links: DataFrame) -> DataFrame:
    """(conv_id, node, key, depth, cyclic) of the messages that wait for another one. links: conv_id, node, turn, needs, needs_turn.

    A node's value is (key, depth). It points at the needed node of the greatest value, or at none if its own turn is
    greater than all; `_chased` gives each node the value at its pointers' end. Values only grow with each new choice
    and what is on a cycle has no end, so choices settle; no chain is cut.
    """
    spark, paths = links.sparkSession, []
    edges = materialise(links, "chat-links", paths)
    if edges.filter("needs_turn >= turn").isEmpty():
        # every link runs forward in turns: the turns themselves are an order
        return edges.groupBy("conv_id", "node").agg(F.max("turn").alias("key")).withColumn("depth", F.lit(0)).withColumn("cyclic", F.lit(False))
    own = edges.groupBy("conv_id", "node").agg(F.max("turn").alias("turn"))
    needed = edges.select("conv_id", F.col("needs").alias("node"), F.col("needs_turn").alias("turn"))
    nodes = materialise(own.unionByName(needed).groupBy("conv_id", "node").agg(F.max("turn").alias("turn")), "chat-nodes", paths)
    most = nodes.count().bit_length() + 1
    values = nodes.select("conv_id", "node", F.col("turn").alias("key"), F.lit(0).alias("depth"), F.lit(False).alias("stuck"))
    while True:
        old: list[str] = []
        before = values.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "stuck", "key", "depth")
        offer = F.struct("stuck", "key", (F.col("depth") + 1).alias("depth"), F.col("needs").alias("at"))
        offers = edges.join(before.hint("shuffle_hash"), (edges.conv_id == before.c) & (edges.needs == before.n)).groupBy("conv_id", "node").agg(F.max(offer).alias("o"))
        met = nodes.join(offers.hint("shuffle_hash"), ["conv_id", "node"], "left")
        points = materialise(met.select("conv_id", "node", "turn", F.when(F.col("o.stuck") | (F.col("o.key") >= F.col("turn")), F.col("o.at")).alias("at")), "chat-points", old)
        new = materialise(_chased(points, most), "chat-values", paths)
        was = values.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.struct("stuck", "key", "depth").alias("was"))
        settled = new.join(was.hint("shuffle_hash"), (new.conv_id == was.c) & (new.node == was.n)).filter(F.struct("stuck", "key", "depth") != F.col("was")).isEmpty()
        remove(spark, old + paths[2:-1])
        paths = [*paths[:2], paths[-1]]
        values = new
        if settled:
            waiting = own.join(values.hint("shuffle_hash"), ["conv_id", "node"])
            return waiting.select("conv_id", "node", F.when(F.col("stuck"), F.col("turn")).otherwise(F.col("key")).alias("key"), F.when(F.col("stuck"), 0).otherwise(F.col("depth")).alias("depth"), F.col("stuck").alias("cyclic"))


def _chased(points: DataFrame, most: int) -> DataFrame:
    """(conv_id, node, key, depth, stuck): the turn at the end of each node's pointers and the steps to it; stuck: they have no end.

    Pointers are doubled up to `most` times, more than a path without a cycle can ask for.
    """
    spark, old = points.sparkSession, []
    state = points.select("conv_id", "node", F.col("turn").alias("key"), F.coalesce("at", "node").alias("at"), F.col("at").isNotNull().cast("long").alias("depth"), F.col("at").isNotNull().alias("open"))
    for _ in range(most):
        on = state.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("at").alias("to"), F.col("key").alias("k"), F.col("depth").alias("d"), F.col("open").alias("more"))
        met = state.join(on.hint("shuffle_hash"), (state.conv_id == on.c) & (state["at"] == on.n))
        state = materialise(met.select("conv_id", "node", F.col("k").alias("key"), F.col("to").alias("at"), (F.col("depth") + F.col("d")).alias("depth"), F.col("more").alias("open")), "chat-chased", old)
        remove(spark, old[:-1])
        old = old[-1:]
        if state.filter("open").isEmpty():
            break
    return state.select("conv_id", "node", F.when(~F.col("open"), F.col("key")).otherwise(F.lit(None)).alias("key"), F.when(~F.col("open"), F.col("depth")).otherwise(0).cast("int").alias("depth"), F.col("open").alias("stuck"))


def format_messages(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, role, call_id, status, valid, errors, order_turn, order_depth, message) of every message."""
    rows = messages.select(*COLUMNS)
    named = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    first = F.min(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("arguments", F.lit("")).alias("arguments")))
    calls = rows.filter((F.col("role") == "call") & named).groupBy("conv_id", "call_id").agg(first.alias("call"))
    results = rows.filter((F.col("role") == "result") & named).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("result"))
    pairs = materialise(calls.join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "full"), "chat-pairs")
    known = pairs.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "call", "result")
    tools = rows.filter(F.col("role").isin("call", "result"))
    node = F.concat_ws(":", "role", "call_id")
    answers = pairs.filter("call IS NOT NULL AND result IS NOT NULL").select(
        "conv_id", F.concat_ws(":", F.lit("result"), "call_id").alias("node"), F.col("result.turn").alias("turn"), F.concat_ws(":", F.lit("call"), "call_id").alias("needs"), F.col("call.turn").alias("needs_turn")
    )
    wanted = rows.filter((F.col("role") == "call") & named).select("conv_id", "call_id", "turn", F.explode(F.array_distinct("after")).alias("want"))
    asks = wanted.join(known.hint("shuffle_hash"), (wanted.conv_id == known.c) & (wanted.want == known.i)).filter("result IS NOT NULL").select(
        "conv_id", F.concat_ws(":", F.lit("call"), "call_id").alias("node"), "turn", F.concat_ws(":", F.lit("result"), "want").alias("needs"), F.col("result.turn").alias("needs_turn")
    )
    order = _order(answers.unionByName(asks)).select(F.col("conv_id").alias("oc"), F.col("node").alias("on"), "key", "depth", "cyclic")
    linked = rows.withColumn("_node", F.when(F.col("role").isin("call", "result") & named, node))
    linked = linked.join(known.hint("shuffle_hash"), (linked.conv_id == known.c) & (linked.call_id == known.i), "left")
    linked = linked.join(order.hint("shuffle_hash"), (linked.conv_id == order.oc) & (linked["_node"] == order.on), "left")
    is_call = F.col("call.turn").eqNullSafe(F.col("turn")) & F.col("call.text").eqNullSafe(F.coalesce("text", F.lit("")))
    is_call &= F.col("call.arguments").eqNullSafe(F.coalesce("arguments", F.lit("")))
    is_result = F.col("result.turn").eqNullSafe(F.col("turn")) & F.col("result.text").eqNullSafe(F.coalesce("text", F.lit("")))
    status = (
        F.when(~F.coalesce(F.col("role").isin("call", "result"), F.lit(False)), F.lit("message"))
        .when(~named, F.lit("unnamed"))
        .when(F.coalesce("cyclic", F.lit(False)), F.lit("cyclic"))
        .when(F.col("role") == "call", F.when(~is_call, F.lit("repeated_call")).when(F.col("result").isNull(), F.lit("unanswered")).otherwise(F.lit("linked")))
        .otherwise(F.when(F.col("call").isNull(), F.lit("orphan_result")).when(~is_result, F.lit("repeated_result")).otherwise(F.lit("linked")))
    )
    errors = F.when(F.col("role") == "call", argument_errors(F.col("arguments"), F.col("tool"), schemas))
    return linked.select(
        "conv_id", "turn", "role", "call_id", status.alias("status"),
        F.when(F.col("role") == "call", F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"),
        F.greatest(F.coalesce("key", "turn"), "turn").alias("order_turn"), F.coalesce("depth", F.lit(0)).alias("order_depth"),
        canonical_line(F.col("role"), F.col("text"), F.col("call_id"), F.col("tool"), F.col("arguments")).alias("message"),
    )


#: The tool as which turns of plain conversations are formatted.
REPLY = {"reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"], "additionalProperties": False}}


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Turns of plain conversations as tool messages: a user's turn calls `reply` under the identifier of its turn,
    waiting for the reply two turns before; an assistant's turn is the result of the turn before it."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    identifier = lambda turn: F.concat_ws("-", F.lit("turn"), turn)
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), F.col("turn").alias("turn")))
    return conversations.select(
        "conv_id", "turn",
        F.when(user, F.lit("call")).when(assistant, F.lit("result")).otherwise(F.col("role")).alias("role"),
        F.when(~F.coalesce(user, F.lit(False)), F.col("text")).alias("text"),
        F.when(user, identifier(F.col("turn"))).when(assistant, identifier(F.col("turn") - 1)).alias("call_id"),
        F.when(user, F.lit("reply")).alias("tool"),
        F.when(user, arguments).alias("arguments"),
        F.when(user, F.array(identifier(F.col("turn") - 2))).alias("after"),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    return format_messages(conversation_messages(conversations), REPLY)
