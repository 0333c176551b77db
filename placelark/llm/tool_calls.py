"""Chat formatting with tool-call linking. DataFrame functions only.

A turn whose text is a JSON object with `tool_calls` ([{"id", "name", "arguments"}], or [{"id", "function": {"name",
"arguments"}}], where arguments may be JSON in a string) makes calls; one with `tool_call_id` (and `content`) is a result; a turn may
be both, and its calls may come with content. Calls and results meet in a hash join on conversation and identifier; turns are
ordered topologically, a turn with results after the turns that called, however they were recorded; arguments are checked
against the tool's JSON schema; every message is written as canonical JSON: keys sorted at every depth, no white space.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelark.llm.common import discard, table, written

PAYLOAD = "tool_calls array<struct<id:string,name:string,arguments:variant,function:struct<name:string,arguments:variant>>>, tool_call_id string, content variant"
#: Types of JSON values, as Spark names them.
KINDS = {"string": "STRING", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "integer": "BIGINT|DECIMAL\\(\\d+,0\\)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
NUMERAL = "^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"
NOTES = {"title", "description", "default", "examples", "$schema", "$id"}
#: Tools that the schemas may be of: what the plan holds.
MAX_TOOLS = 1000
#: Turns that a chain of misplaced ones is followed over; a cycle of turns that answer each other has no order, and keeps that of its turns.
MAX_CHAIN = 64


def _closed(required: list[str], **properties) -> dict:
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


#: JSON schemas by tool. `numeral` lets a number come as a string.
TOOLS: dict[str, dict] = {
    "search": _closed(["query"], query={"type": "string"}, limit={"type": "integer"}),
    "geocode": _closed(["q"], q={"type": "string"}, country={"type": "string"}),
    "reverse": _closed(["lat", "lon"], lat={"type": "number", "numeral": True}, lon={"type": "number", "numeral": True}),
}


def canonical(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problem(value: Column, schema: dict, path: str = "") -> Column:
    """null if a variant fits the schema, else the first thing wrong: types, required and closed properties, items, enum, const,
    bounds, lengths and patterns, at any depth of the schema. Other keywords are refused."""
    unknown = set(schema) - NOTES - {"type", "numeral", "properties", "required", "additionalProperties", "items", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "pattern", "minItems", "maxItems"}
    if unknown:
        raise ValueError(f"keywords of a schema not supported: {sorted(unknown)}")
    here = f" of {path}" if path else ""
    found: list[Column] = []
    wrong = lambda condition, text: found.append(F.when(F.coalesce(condition, F.lit(True)), F.lit(text)))
    kind = F.schema_of_variant(value)
    is_kind = lambda names: kind.rlike(f"^({'|'.join(KINDS[x] for x in names)})$")
    if "type" in schema:
        ok = is_kind([schema["type"]] if isinstance(schema["type"], str) else schema["type"])
        if schema.get("numeral"):
            ok = ok | (kind == "STRING") & F.try_variant_get(value, "$", "string").rlike(NUMERAL)
        wrong(~ok, f"type{here}" if path else "arguments")
    if "enum" in schema or "const" in schema:
        wrong(~F.to_json(value).isin(*[canonical(x) for x in schema.get("enum", [schema.get("const")])]), f"value{here}")
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    for word, test in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x)):
        if word in schema:
            wrong(is_kind(["number"]) & test(schema[word]), f"{word}{here}")
    for word, test in (("minLength", lambda x: F.char_length(text) < x), ("maxLength", lambda x: F.char_length(text) > x), ("pattern", lambda x: ~text.rlike(x))):
        if word in schema:
            wrong(is_kind(["string"]) & test(schema[word]), f"{word}{here}")
    items = F.try_variant_get(value, "$", "array<variant>")
    for word, test in (("minItems", lambda x: F.size(items) < x), ("maxItems", lambda x: F.size(items) > x)):
        if word in schema:
            wrong(is_kind(["array"]) & test(schema[word]), f"{word}{here}")
    if "items" in schema:
        found.append(F.when(is_kind(["array"]), F.get(F.filter(F.transform(items, lambda x: problem(x, schema["items"], path + "[]")), lambda x: x.isNotNull()), 0)))
    own, required = schema.get("properties", {}), set(schema.get("required", []))
    named = F.try_variant_get(value, "$", "map<string,variant>")
    has = lambda k: F.array_contains(F.map_keys(named), k)
    for k in sorted(required | set(own)):
        at = f"{path}.{k}" if path else k
        if k in required:
            wrong(is_kind(["object"]) & ~has(k), f"missing {at}")
        if k in own:
            found.append(F.when(has(k), problem(F.try_element_at(named, F.lit(k)), own[k], at)))
    more = schema.get("additionalProperties", True)
    if more is False:
        extra = F.array_except(F.map_keys(named), F.array(*[F.lit(k) for k in sorted(own)]).cast("array<string>"))
        wrong(is_kind(["object"]) & (F.size(extra) > 0), f"unknown argument{here}")
    elif more is not True:
        raise ValueError("additionalProperties must be true or false")
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def schemas_of(tools) -> dict[str, dict]:
    """Schemas by name: of a dict, or of a table (name, schema as JSON), MAX_TOOLS at most."""
    if isinstance(tools, DataFrame):
        rows = tools.select("name", "schema").limit(MAX_TOOLS + 1).collect()
        if len(rows) > MAX_TOOLS or len({r[0] for r in rows}) < len(rows):
            raise ValueError(f"more than {MAX_TOOLS} tools, or a name twice")
        tools = {r[0]: json.loads(r[1]) for r in rows}
    return tools


def _wrong(name: Column, arguments: Column, tools: dict[str, dict]) -> Column:
    case = F.when(name.isNull(), F.lit("no name"))
    given = F.coalesce(arguments, F.parse_json(F.lit("{}")))
    given = F.when(F.is_variant_null(given), F.parse_json(F.lit("{}"))).otherwise(given)  # no arguments are empty ones
    for tool, schema in sorted(tools.items()):
        case = case.when(name == tool, problem(given, schema))
    return case.otherwise(F.lit("unknown tool"))


def _positions(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, level, depth) of the turns of the conversations in which a result (r) comes before its call (c): the largest
    (level, depth + 1) of the turns before, or the turn itself. Rounds of joins over those conversations' edges alone."""
    bad = edges.filter("c > r").select("conv_id").distinct()
    own = written(edges.join(bad, "conv_id", "left_semi"), "edges")
    start = own.select("conv_id", F.explode(F.array("c", "r")).alias("turn")).distinct().select("conv_id", "turn", F.struct(F.col("turn").alias("level"), F.lit(0).alias("depth")).alias("p"))
    at = written(start, "turns")
    for _ in range(MAX_CHAIN):
        came = own.join(at.select("conv_id", F.col("turn").alias("c"), "p"), ["conv_id", "c"]).groupBy("conv_id", F.col("r").alias("turn")).agg(F.max(F.struct(F.col("p.level").alias("level"), (F.col("p.depth") + 1).alias("depth"))).alias("q"))
        moved = written(at.select("conv_id", "turn", "p").join(came, ["conv_id", "turn"], "left").select("conv_id", "turn", F.greatest("p", F.coalesce("q", "p")).alias("p"), F.coalesce(F.col("q") > F.col("p"), F.lit(False)).alias("m")), "turns")
        discard(at)
        at = moved
        if at.filter("m").isEmpty():
            break
    return at.select("conv_id", "turn", "p.level", F.least("p.depth", F.lit(MAX_CHAIN)).alias("depth"))


def link_calls(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tools=None) -> DataFrame:
    """One row per message: (conv_id, turn, item, order_turn, order_depth, order_item, role, call_id, status, json).

    A turn with calls gives a message a call, numbered by `item`, and before them, as item -1, its result or else its content, if it has
    one; any other turn gives one. JSON values keep their types. Messages of a conversation sort by (order_turn, order_depth,
    turn, order_item): a turn with a result whose call comes later moves behind that call's turn, with all its messages, and the turns
    that answer it behind it; a result of a call of its own turn comes after that call. Order is a key, not a rank, so a
    conversation with a third of all turns needs no task of its own. status: text, call, unanswered, result, orphan
    (no such call), or invalid: with the reason. `tools`: schemas by name, or a table of them. Text that isn't such JSON is
    plain text, however long; null text, role or ids stay null in the JSON, and null identifiers link with nothing. A repeated call
    identifier keeps its first call (smallest turn, then item) as the link of results. Repeated rows stay; other columns are
    ignored. An empty table gives no rows. Plain turns are read once and never shuffled.
    """
    tools = schemas_of(TOOLS if tools is None else tools)
    looks = F.ltrim(F.coalesce(F.col(text_col), F.lit(""))).startswith("{")
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("_text"), F.when(looks, F.from_json(F.col(text_col), PAYLOAD)).alias("_p"))
    opts = {"ignoreNullFields": "false"}
    is_call, is_result = F.coalesce(F.size("_p.tool_calls") > 0, F.lit(False)), F.coalesce(F.col("_p.tool_call_id").isNotNull(), F.lit(False))
    string = lambda x: F.lit(x).cast("string")
    message = lambda item, kind, call_id, wrong, json_: F.struct(item.cast("int").alias("item"), F.lit(kind).alias("kind"), call_id.alias("call_id"), wrong.alias("wrong"), json_.alias("json"))

    def call(c: Column, i: Column) -> Column:
        given, name = F.coalesce(c["arguments"], c["function"]["arguments"]), F.coalesce(c["name"], c["function"]["name"])
        given = F.coalesce(F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(F.try_variant_get(given, "$", "string"))), given)
        return message(i, "call", c["id"], _wrong(name, given, tools), F.to_json(F.struct(given.alias("arguments"), c["id"].alias("id"), name.alias("name"), "role"), opts))

    head = F.when(is_call, -1).otherwise(0)
    result = message(head, "result", F.col("_p.tool_call_id"), string(None), F.to_json(F.struct(F.col("_p.content").alias("content"), "role", F.col("_p.tool_call_id").alias("tool_call_id")), opts))
    has_content = F.col("_p.content").isNotNull() & ~F.coalesce(F.is_variant_null("_p.content"), F.lit(False))
    said = message(head, "text", string(None), string(None), F.to_json(F.struct(F.col("_p.content").alias("content"), "role"), opts))
    plain = t.filter(~is_call & ~is_result).select(
        "conv_id", "turn", F.lit(0).alias("item"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_depth"), F.lit(-2).alias("order_item"), "role", string(None).alias("call_id"), F.lit("text").alias("status"),
        F.to_json(F.struct(F.col("_text").alias("content"), "role"), opts).alias("json"),
    )
    own = F.when(is_call, F.concat(F.array_compact(F.array(F.when(is_result, result).when(has_content, said))), F.transform("_p.tool_calls", call))).otherwise(F.array(result))
    linked = written(t.filter(is_call | is_result).select("conv_id", "turn", "role", F.explode(own).alias("m")).select("conv_id", "turn", "role", "m.*"), "messages")
    calls, results = linked.filter("kind = 'call' AND call_id IS NOT NULL"), linked.filter("kind = 'result'")
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "item")).alias("_at"))
    answered = results.select("conv_id", "call_id").distinct().withColumn("_answered", F.lit(True))
    m = linked.join(first, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    edges = results.join(first, ["conv_id", "call_id"]).select("conv_id", F.col("_at.turn").alias("c"), F.col("turn").alias("r")).filter("c <> r").distinct()
    if edges.filter("c > r").isEmpty():
        m = m.withColumn("level", F.col("turn")).withColumn("depth", F.lit(0))
    else:
        m = m.join(_positions(edges), ["conv_id", "turn"], "left").withColumn("level", F.coalesce("level", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    status = F.when(F.col("kind") == "text", "text").when((F.col("kind") == "result") & F.col("_at").isNull(), "orphan").when(F.col("kind") == "result", "result")
    status = status.when(F.col("wrong").isNotNull(), F.concat(F.lit("invalid: "), "wrong")).when(F.col("_answered").isNull(), "unanswered").otherwise("call")
    place = F.when((F.col("kind") == "result") & (F.col("_at.turn") == F.col("turn")), F.col("_at.item") * 2 + 1).when(F.col("kind") == "call", F.col("item") * 2).otherwise(-2)
    return plain.unionByName(m.select("conv_id", "turn", "item", F.col("level").alias("order_turn"), F.col("depth").alias("order_depth"), place.alias("order_item"), "role", "call_id", status.alias("status"), "json"))


def op8_tool_calls(spark, sf_dir):
    return link_calls(table(spark, sf_dir, "conversations"))
