"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

Calls and results meet in a hash join on their identifier, after each side has been aggregated to one
row an identifier, so repeated identifiers never multiply. A call may wait for another
call's result; calls are ordered by the length of that chain, found by pointer doubling in a logarithmic
number of joins, and then by identifier. Nothing gathers a conversation: every exchange is a
row, and its number within the conversation comes from range partitions.

Arguments are parsed as variants, whose objects keep their keys sorted: written back they are canonical -
sorted keys, no blanks, one spelling of each number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import ordinal_within
from tidemark.session import cut_lineage

#: Tool to its arguments: name to (type, required). Types: string, integer, number, boolean, array, object.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "ask": {"text": ("string", True), "words": ("integer", True), "turn": ("integer", True), "opening": ("boolean", False)},
}
#: How schema_of_variant spells each type.
SPELLED = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(?:BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<.*$", "object": "^OBJECT<.*$"}


def canonical(json: Column) -> Column:
    """Canonical JSON of a text, null if it is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> Column:
    """Sorted errors of a call's arguments (a JSON text): missing, type and unknown arguments, no object
    at all, or a tool without a schema."""
    schemas = SCHEMAS if schemas is None else schemas
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).rlike("^OBJECT<"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            own = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            absent = own.isNull() | (own == "VOID")
            checks.append(F.when(absent, F.lit(f"missing {field}") if required else F.lit(None)).when(~own.rlike(SPELLED[kind]), F.lit(f"type of {field}")))
        more = F.array_except(F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>")), F.array(*[F.lit(f) for f in fields]))
        found = F.concat(F.array_compact(F.array(*checks)), F.transform(more, lambda f: F.concat(F.lit("unknown "), f)))
        out = F.when(F.coalesce(name, F.lit("")) == tool, F.when(is_object, F.array_sort(found)).otherwise(F.array(F.lit("no object")))).otherwise(out)
    return out


def chain_depths(nodes: DataFrame) -> DataFrame:
    """(id, depth) of unique nodes (id, parent): how many nodes its chain of parents has.

    A parent that is no node ends the chain. Nodes on or behind a circle have a null depth. Every
    round doubles how far a pointer reaches, so there are about log2 of the longest chain.
    """
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    at = nodes.join(known, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("to"))
    at = cut_lineage(at.withColumn("depth", F.col("to").isNotNull().cast("long")))
    rounds = math.ceil(math.log2(max(2, at.count()))) + 1
    for _ in range(rounds):
        if at.filter("to is not null").isEmpty():
            break
        next_ = at.select(F.col("id").alias("to"), F.col("to").alias("next_to"), F.col("depth").alias("more"))
        moved = at.join(next_, "to", "left").select("id", F.col("next_to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        at = cut_lineage(moved)
    return at.select("id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """One row per identifier of a conversation.

    calls: conv_id, call_id, name, arguments (JSON text), after (the call whose result it waits for, or
    null). results: conv_id, call_id, content. Columns beyond these are not looked at.

    Returned: conv_id, call_id, status (linked, unanswered, orphan result, circular), n_calls, n_results,
    depth, position (1, 2, ... in the conversation; circular ones last), errors (of the arguments,
    comma-joined, empty if valid; null for an orphan result) and json. Of several calls or results with
    one identifier the alphabetically first (by name and arguments; by content) speaks. Rows whose
    conv_id or call_id is null belong to no exchange and are not returned. Null contents stay null in the
    JSON. Empty tables give an empty result.
    """
    def key(c: DataFrame) -> DataFrame:
        return c.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())

    told = F.struct("name", "arguments", "after")
    calls = key(calls).groupBy("conv_id", "call_id").agg(F.min(told).alias("call"), F.count(F.lit(1)).alias("n_calls"))
    results = key(results).groupBy("conv_id", "call_id").agg(F.min(F.struct("content")).alias("result"), F.count(F.lit(1)).alias("n_results"))
    linked = calls.join(results, ["conv_id", "call_id"], "full_outer")
    linked = cut_lineage(linked.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_calls", "n_results")}))
    ident = F.struct("conv_id", "call_id")
    after = F.when(F.col("call.after").isNotNull(), F.struct("conv_id", F.col("call.after").alias("call_id")))
    depths = chain_depths(linked.select(ident.alias("id"), after.alias("parent")))
    rows = linked.join(depths.select("id.conv_id", "id.call_id", "depth"), ["conv_id", "call_id"])
    status = (
        F.when(F.col("depth").isNull(), "circular").when(F.col("n_calls") == 0, "orphan result")
        .when(F.col("n_results") == 0, "unanswered").otherwise("linked")
    )
    errors = F.when(F.col("n_calls") > 0, F.array_join(argument_errors(F.col("call.name"), F.col("call.arguments"), schemas), ","))
    body = F.to_json(F.struct(F.col("call.after").alias("after"), F.col("call_id").alias("id"), F.col("call.name").alias("name"), F.col("result.content").alias("result")), {"ignoreNullFields": "false"})
    # Arguments come first in the alphabet of keys but "after"; they are JSON already.
    arguments = F.coalesce(canonical(F.col("call.arguments")), F.to_json(F.struct(F.col("call.arguments").alias("raw")), {"ignoreNullFields": "false"}))
    split = F.instr(body, ',"id":')
    json = F.concat(F.substr(body, F.lit(1), split - 1), F.lit(',"arguments":'), arguments, F.substr(body, split))
    rows = rows.select("conv_id", "call_id", status.alias("status"), "n_calls", "n_results", "depth", errors.alias("errors"), json.alias("json"))
    rows = rows.withColumn("__order", F.coalesce("depth", F.lit(2**62)))
    return ordinal_within(rows, ["conv_id"], ["__order", "call_id"], "position").drop("__order")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off plain turns: a user's turn calls ``ask``, the assistant's next turn
    is its result, and a call waits for the exchange two turns before. Other roles are neither."""
    text, turn = F.col("text"), F.col("turn")
    ident = lambda back: (turn - back).cast("string")
    arguments = F.to_json(F.struct(
        (turn == 0).alias("opening"), text.alias("text"), turn.alias("turn"),
        F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).alias("words"),
    ))
    calls = conversations.filter("role = 'user'").select("conv_id", ident(0).alias("call_id"), F.lit("ask").alias("name"), arguments.alias("arguments"), F.when(turn >= 2, ident(2)).alias("after"))
    results = conversations.filter("role = 'assistant'").select("conv_id", ident(1).alias("call_id"), text.alias("content"))
    return calls, results


def chat_rows(conversations: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """The exchanges of plain turns (``link_calls``) and a row for each text they do not tell.

    Further statuses: message (a turn of another role, or of none), unidentified (its conv_id or turn is
    null) and repeated (another text of a turn whose alphabetically first speaks in the exchange; equal
    ones are told once, and counted there). These rows count no calls or results, have no depth, position
    or errors, and their JSON has the role, text and turn; call_id is the exchange's, or the turn.
    """
    calls, results = turns_as_calls(conversations)
    role, turn = F.col("role"), F.col("turn")
    known = F.coalesce(role.isin("user", "assistant"), F.lit(False))
    unplaced = F.col("conv_id").isNull() | turn.isNull()
    status = F.when(unplaced, "unidentified").otherwise("message")
    body = F.to_json(F.struct("role", "text", "turn"), {"ignoreNullFields": "false"})
    others = conversations.filter(unplaced | ~known).select("conv_id", turn.cast("string").alias("call_id"), status.alias("status"), body.alias("json"))

    def repeated(told: DataFrame, value: str, who: str, text: Column, back: int) -> DataFrame:
        told = told.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).select("conv_id", "call_id", F.struct(value).alias("told"))
        several = told.groupBy("conv_id", "call_id").agg(F.min("told").alias("first"), F.max("told").alias("last")).filter("first != last").drop("last")
        more = told.join(several, ["conv_id", "call_id"]).filter("told != first").select("conv_id", "call_id", "told").distinct()
        body = F.struct(F.lit(who).alias("role"), text.alias("text"), (F.col("call_id").cast("long") + back).alias("turn"))
        return more.select("conv_id", "call_id", F.lit("repeated").alias("status"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))

    rest = others.unionByName(repeated(calls, "arguments", "user", F.get_json_object("told.arguments", "$.text"), 0))
    rest = rest.unionByName(repeated(results, "content", "assistant", F.col("told.content"), 1))
    rest = rest.withColumns({n: F.lit(0).cast("long") for n in ("n_calls", "n_results")})
    return link_calls(calls, results, schemas).unionByName(rest, allowMissingColumns=True)
