"""Tool-call linking with DataFrame functions only: join, order, validation, canonical JSON.

Calls and results meet in a hash join by conversation and identifier. A call may depend on the results of
other calls; where all of these stand on earlier turns, turns are a topological order already,
and only conversations in which some don't are levelled in rounds. Arguments are checked against a schema for the tool's name, and
each message is a JSON text with sorted keys and no spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textkit import materialise

#: JSON Schema's names of types, and the variant types that satisfy them.
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID",
}

SCHEMA = "struct<required: array<string>, properties: map<string, struct<type: string>>, additionalProperties: boolean>"


def canonical(json_text: Column) -> Column:
    """JSON text with sorted keys and no spaces; null where it can't be parsed."""
    return F.to_json(F.try_parse_json(json_text))


def problems(arguments: Column, schema: Column) -> Column:
    """What is wrong with a JSON text against a parsed schema (SCHEMA), as a sorted array of texts; none: empty."""
    parsed = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    fields = F.when(is_object, F.expr("1")).isNotNull()
    kinds = F.transform_values(F.when(fields, parsed.cast("map<string, variant>")), lambda _, v: F.schema_of_variant(v))
    names = F.map_keys(kinds)
    none = F.array().cast("array<string>")
    required = F.coalesce(schema["required"], none)
    known = F.coalesce(schema["properties"], F.expr("map()").cast("map<string, struct<type: string>>"))
    missing = F.transform(F.array_except(required, names), lambda k: F.concat(F.lit("missing "), k))
    extra = F.when(schema["additionalProperties"] == F.lit(False), F.transform(F.array_except(names, F.map_keys(known)), lambda k: F.concat(F.lit("unknown "), k))).otherwise(none)
    pattern = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])

    def bad(k: Column) -> Column:
        wanted = F.try_element_at(pattern, F.try_element_at(known, k)["type"])
        got = F.try_element_at(kinds, k)
        return F.coalesce(~F.regexp_like(F.coalesce(got, F.lit("VOID")), F.concat(F.lit("^(?:"), wanted, F.lit(")$"))), F.lit(False))

    wrong = F.transform(F.filter(F.array_intersect(names, F.map_keys(known)), bad), lambda k: F.concat(F.lit("type "), k))
    found = F.array_sort(F.concat(missing, extra, wrong))
    return (
        F.when(arguments.isNull() | parsed.isNull(), F.array(F.lit("not JSON")))
        .when(~is_object, F.array(F.lit("not an object")))
        .when(schema.isNull(), F.array(F.lit("unknown tool")))
        .otherwise(found)
    )


def node(call_id: Column, turn: Column) -> Column:
    """What stands for a call in the order: its identifier; calls of one turn without any are one node."""
    return F.coalesce(call_id, F.concat(F.lit("\x00"), F.coalesce(turn.cast("string"), F.lit(""))))


#: Rounds in which levels may settle by themselves; conversations that need more are ordered by taking away what waits for nothing.
ROUNDS = 4


def levels(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conversation, node and level of each call; by level, then turn, a call comes after the results of all its dependencies.

    A dependency whose results don't all stand on earlier turns is late: it takes a level more than what it depends on, any other at
    least as much. Levels are raised in rounds until none changes. In a conversation that still changes after ROUNDS rounds, calls that wait for nothing are taken away in
    rounds instead, as many as its longest chain has calls; what then is left is on or behind a cycle and gets -1. Dependencies that aren't calls of the conversation don't count.
    """
    own = calls.select("conversation", node(F.col("call_id"), F.col("turn")).alias("node"), "turn", "depends_on")
    ids = own.groupBy("conversation", "node").agg(F.max("turn").alias("asked"))
    ready = results.groupBy("conversation", F.col("call_id").alias("node")).agg(F.max("turn").alias("answered"))
    ready = ids.join(ready, ["conversation", "node"], "left").select("conversation", F.col("node").alias("on"), F.greatest("asked", F.coalesce("answered", "asked")).alias("ready"))
    late = 1 - F.coalesce(F.col("ready") < F.col("turn"), F.lit(False)).cast("int")
    edges = own.select("conversation", "node", "turn", F.explode("depends_on").alias("on")).join(ready, ["conversation", "on"]).groupBy("conversation", "node", "on").agg(F.max(late).alias("late"))
    edges = materialise(edges, "edges")
    forward = edges.where("late = 1").select("conversation").distinct()
    flat = ids.select("conversation", "node", F.lit(0).alias("level"))
    if forward.isEmpty():
        return flat
    keys = ["conversation", "node"]
    hard = edges.join(forward, "conversation", "left_semi")
    # The first round: all levels are 0 before it.
    state = flat.join(forward, "conversation", "left_semi").drop("level").join(hard.groupBy(*keys).agg(F.max("late").alias("level")), keys, "left")
    state = materialise(state.select(*keys, F.coalesce("level", F.lit(0)).alias("level"), F.lit(True).alias("changed")), "levels")
    done = flat.join(forward, "conversation", "left_anti")
    for _ in range(ROUNDS):
        up = hard.join(state.select("conversation", F.col("node").alias("on"), F.col("level").alias("below")), ["conversation", "on"]).groupBy(*keys).agg(F.max(F.col("below") + F.col("late")).alias("want"))
        raised = state.select(*keys, "level").join(up, keys, "left")
        more = F.coalesce(F.col("want") > F.col("level"), F.lit(False))
        state = materialise(raised.select(*keys, F.when(more, F.col("want")).otherwise(F.col("level")).alias("level"), more.alias("changed")), "levels")
        restless = state.where("changed").select("conversation").distinct()
        if restless.isEmpty():
            return done.unionByName(state.select(*keys, "level"))
    done = done.unionByName(state.join(restless, "conversation", "left_anti").select(*keys, "level"))
    hard = materialise(hard.join(restless, "conversation", "left_semi").select("conversation", "node", "on"), "edges")
    now = state.join(restless, "conversation", "left_semi").select(*keys)
    left, level = now.count(), 0
    while left:
        waits = hard.join(now.withColumnRenamed("node", "on"), ["conversation", "on"], "left_semi").select(*keys, F.lit(True).alias("waits")).distinct()
        taken = materialise(now.join(waits, keys, "left"), "levels")
        done = done.unionByName(taken.where("waits is null").select(*keys, F.lit(level).alias("level")))
        now = taken.where("waits").drop("waits")
        still, level = now.count(), level + 1
        if still == left:
            break
        left = still
    return done.unionByName(now.withColumn("level", F.lit(-1)))


#: A schemas' table of at most so many bytes is broadcast.
SMALL_TABLE = 8 << 20


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call and each result, linked, ordered and serialised.

    calls: conversation, turn, call_id, name, arguments (JSON text), depends_on (array of call ids). results: conversation, turn,
    call_id, content. schemas: name, schema (JSON Schema text: required, properties' types, additionalProperties); of several of a name, the least text counts.

    Columns: conversation, place (sorts a conversation topologically: level, then turn, calls before results, and calls on or behind
    a cycle last), turn, kind (call or result),
    call_id, status (linked; unanswered call; orphan result; repeated: an identifier used by several calls or
    several results of the conversation, whose links are all kept as one; such a result takes the least name), problems (of calls), json.

    Null identifiers and null conversations link to nothing; a null turn is placed as turn 0, and what depends on such a call is levelled. Null
    names and contents are left out of the JSON, null arguments are null there; empty and very long texts are kept whole. Other columns aren't read.
    Repeated rows give repeated results; nothing is paired, as each side only counts the other. Empty tables give no rows.
    """
    keys = ["conversation", "call_id"]
    calls = calls.select(*keys, "turn", "name", "arguments", "depends_on", node(F.col("call_id"), F.col("turn")).alias("node"))
    results = results.select(*keys, "turn", "content")
    asked = calls.groupBy(*keys).agg(F.count("*").alias("n_calls"), F.min("name").alias("name_of"), F.max("turn").alias("asked_at"))
    answered = results.groupBy(*keys).agg(F.count("*").alias("n_results"))
    tools = schemas.where("name is not null").groupBy(F.col("name").alias("tool")).agg(F.min("schema").alias("schema"))
    size = tools.agg(F.sum(F.octet_length("tool") + F.coalesce(F.octet_length("schema"), F.lit(0)) + 16)).first()[0] or 0
    tools = tools.withColumn("schema", F.from_json("schema", SCHEMA))
    placed = levels(calls, results)
    if size <= SMALL_TABLE:
        tools = F.broadcast(tools)
    one = calls.join(answered, keys, "left").join(placed, ["conversation", "node"], "left").join(tools, F.col("name") == F.col("tool"), "left")
    call_json = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("name"), F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.lit("null"))).alias("arguments")))
    state = F.when(F.col("n_results").isNull(), "unanswered").when(F.col("n_results") > 1, "repeated").otherwise("linked")
    level = F.when(F.col("level") < 0, 1 << 30).otherwise(F.coalesce("level", F.lit(0))).cast("bigint") * 4294967296
    turn = F.coalesce("turn", F.lit(0))
    left = one.select(
        "conversation", (level + turn * 2).alias("place"), "turn", F.lit("call").alias("kind"), "call_id", state.alias("status"),
        problems(F.col("arguments"), F.col("schema")).alias("problems"), canonical(call_json).alias("json"),
    )
    two = results.join(asked, keys, "left").join(placed.withColumnRenamed("node", "call_id"), keys, "left")
    result_json = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("name_of").alias("name"), F.col("content")))
    state = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_calls") > 1, "repeated").otherwise("linked")
    # A result that stands before its call is placed behind it.
    behind = F.greatest(turn, F.coalesce("asked_at", turn))
    right = two.select(
        "conversation", (level + behind * 2 + 1).alias("place"), "turn", F.lit("result").alias("kind"), "call_id", state.alias("status"),
        F.array().cast("array<string>").alias("problems"), canonical(result_json).alias("json"),
    )
    return left.unionByName(right)


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) as calls and results.

    What the assistant says is the result of the user's turn before. Every other message is a call: of the tool instruct if
    the system says it, else (a null role, too) of the tool reply. A reply depends on the reply two turns before; an instruction holds for the whole
    conversation and depends on its last reply, so that it comes after all of them. Null texts are empty.
    """
    name = lambda kind, conv, turn: F.concat(F.lit(kind), conv.cast("string"), F.lit("-"), turn.cast("string"))
    conv, at, role = F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit(""))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), at.alias("turn")))
    asked = conversations.where(role != "assistant")
    last = asked.where(role != "system").groupBy("conv_id").agg(F.max("turn").alias("last"))
    instructions = asked.where(role == "system").join(last, "conv_id", "left")
    body = lambda kind, tool, on: [
        conv.alias("conversation"), "turn", name(kind, conv, at).alias("call_id"), F.lit(tool).alias("name"), arguments.alias("arguments"), F.array(name("c", conv, on)).alias("depends_on"),
    ]
    calls = asked.where(role != "system").select(*body("c", "reply", at - 2)).unionByName(instructions.select(*body("s", "instruct", F.col("last"))))
    results = conversations.where(role == "assistant").select(
        conv.alias("conversation"), "turn", name("c", conv, at - 1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content")
    )
    return calls, results
