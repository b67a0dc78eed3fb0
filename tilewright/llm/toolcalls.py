"""Tool-call linking for chat data (native).

Calls and results are hash-joined by identifier; calls are put in topological order of
the calls they wait for; arguments are validated against schemas; and every call with
its result becomes one line of canonical JSON (sorted keys, no spaces).

The output has a row per call, not per conversation, so a conversation that holds a
third of all messages is no single value or task.  Depths come from pointer doubling,
about log2 of the longest chain rounds, each an equi-join on unique identifiers.  Calls
with several needs take a round a layer, without a bound on rounds; where a table has
such calls and at most ``ONE_TASK_LINKS`` needs (counted first), one task orders it.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import settle, settle_narrow, table

#: JSON kinds of schemas and the type names that a parsed value may have.
KINDS = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}

ONE_TASK_LINKS = 200_000


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, Any]]) -> Column:
    """Sorted array of what is wrong with a call's argument JSON; empty if valid.

    A schema has ``properties`` (argument to kind, optional minimum, maximum, max_length
    and enum) and ``required``.  Arguments that it does not name are errors.
    """
    parsed = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.when(name.isNull(), F.array(F.lit("no_tool"))).otherwise(F.array(F.concat(F.lit("unknown_tool:"), name)))
    for tool, schema in schemas.items():
        rules: list[Column] = []
        for argument, rule in schema["properties"].items():
            path = "$." + argument
            value = F.try_variant_get(parsed, path, "string")
            number = F.try_variant_get(parsed, path, "double")
            present = F.array_contains(keys, argument)
            wrong = ~F.schema_of_variant(F.try_variant_get(parsed, path, "variant")).rlike(KINDS[rule["kind"]])
            rules.append(F.when(present & F.coalesce(wrong, F.lit(True)), F.lit(f"type:{argument}")))
            fits = present & ~F.coalesce(wrong, F.lit(True))
            if "minimum" in rule:
                rules.append(F.when(fits & (number < rule["minimum"]), F.lit(f"minimum:{argument}")))
            if "maximum" in rule:
                rules.append(F.when(fits & (number > rule["maximum"]), F.lit(f"maximum:{argument}")))
            if "max_length" in rule:
                rules.append(F.when(fits & (F.length(value) > rule["max_length"]), F.lit(f"max_length:{argument}")))
            if "enum" in rule:
                rules.append(F.when(fits & ~value.isin(list(rule["enum"])), F.lit(f"enum:{argument}")))
            if argument in schema.get("required", ()):
                rules.append(F.when(~present, F.lit(f"missing:{argument}")))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(k) for k in schema["properties"]]).cast("array<string>")), lambda k: F.concat(F.lit("unknown:"), k))
        found = F.concat(F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>"), extra)
        is_object = F.coalesce(F.schema_of_variant(parsed).rlike("^OBJECT"), F.lit(False))
        out = F.when(name == tool, F.when(is_object, found).otherwise(F.array(F.lit("not_an_object")))).otherwise(out)
    return F.array_sort(out)


def _layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(call_id, depth) of the calls with needs, from all (call_id, needs); cycles and what waits for them are absent."""
    wanted, follow = defaultdict(set), defaultdict(list)
    kind = pa.string()
    for batch in batches:
        kind = batch.schema.field(0).type
        for call, need in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if need not in wanted[call]:
                wanted[call].add(need)
                follow[need].append(call)
    waits, depth = {c: len(n) for c, n in wanted.items()}, {}
    ready = deque((n, 0) for n in follow if n not in wanted)
    while ready:
        call, d = ready.popleft()
        for other in follow.get(call, ()):
            depth[other] = max(depth.get(other, 0), d + 1)
            waits[other] -= 1
            if not waits[other]:
                ready.append((other, depth[other]))
    known = [c for c in depth if not waits[c]]
    yield pa.RecordBatch.from_arrays([pa.array(known, kind), pa.array([depth[c] for c in known], pa.int64())], ["call_id", "depth"])


def depths(calls: DataFrame, links: DataFrame) -> DataFrame:
    """(call_id, depth): 0 without dependencies, else one more than the deepest dependency; cycles are absent.

    ``links`` has (call_id, needs) among existing calls.  Calls with one dependency
    jump along their chain in doubling steps; others wait until all theirs are known.
    """
    counted = links.groupBy("call_id").agg(F.count("*").alias("n"), F.min("needs").alias("one"))
    state = settle(
        calls.select("call_id")
        .distinct()
        .join(counted, "call_id", "left")
        .select(
            "call_id",
            F.when(F.col("n").isNull(), F.lit(0).cast("long")).alias("depth"),
            F.when(F.col("n") == 1, F.col("one")).alias("ahead"),
            F.when(F.col("n") == 1, F.lit(1).cast("long")).alias("steps"),
        )
    )
    several = settle(links.join(counted.where("n > 1").select("call_id"), "call_id"))
    branching = not several.isEmpty()
    if branching and links.count() <= ONE_TASK_LINKS:
        kind = dict(links.dtypes)["call_id"]
        ordered = links.select("call_id", "needs").coalesce(1).mapInArrow(_layers, f"call_id {kind}, depth long")
        return settle(state.where("depth = 0").select("call_id", "depth").unionByName(ordered))
    open_before = None
    while True:  # a round resolves every call whose needs are known: without one, the rest are cycles
        still = state.where("depth IS NULL").count()
        if still in (0, open_before):
            break
        open_before = still
        other = state.select(F.col("call_id").alias("ahead"), F.col("depth").alias("o_depth"), F.col("ahead").alias("o_ahead"), F.col("steps").alias("o_steps"))
        jumped = state.where("depth IS NULL AND ahead IS NOT NULL").join(other, "ahead").select(
            "call_id",
            (F.col("o_depth") + F.col("steps")).alias("depth"),
            F.when(F.col("o_depth").isNull() & F.col("o_ahead").isNotNull(), F.col("o_ahead")).otherwise(F.col("ahead")).alias("ahead"),
            F.when(F.col("o_depth").isNull() & F.col("o_ahead").isNotNull(), F.col("steps") + F.col("o_steps")).otherwise(F.col("steps")).alias("steps"),
        )
        rest = state.where("depth IS NOT NULL OR ahead IS NULL")
        if branching:
            known = state.select(F.col("call_id").alias("needs"), F.col("depth").alias("d"))
            ready = several.join(known, "needs").groupBy("call_id").agg(F.max("d").alias("d"), F.bool_and(F.col("d").isNotNull()).alias("all"))
            rest = rest.join(ready.where("all").select("call_id", "d"), "call_id", "left").select("call_id", F.coalesce("depth", F.col("d") + 1).alias("depth"), "ahead", "steps")
        state = settle_narrow(rest.unionByName(jumped))
    return state.where("depth IS NOT NULL").select("call_id", "depth")


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row per call_id and per result without a call.

    ``calls``: call_id, position, name, arguments (JSON), needs (array of call_ids).
    ``results``: call_id, position, content.  Of calls or results that repeat an
    identifier the one with the lowest position (then smallest fields) counts and the
    others are numbered in n_calls or n_results.  A null identifier links with nothing.
    status: ok, invalid_arguments, missing_result, result_before_call, unmet_need (a
    needed call does not exist), cycle or orphan_result; the first that applies from
    the right.  Rows with ``depth`` are in topological order by (depth, position, call_id).
    Empty tables give no rows.  Extra columns, clashing names included, are not used.
    """
    calls = calls.select("call_id", F.col("position").cast("long").alias("position"), "name", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    results = results.select("call_id", F.col("position").cast("long").alias("position"), "content")
    void = calls.where("call_id IS NULL")
    first = (
        calls.where("call_id IS NOT NULL")
        .groupBy("call_id")
        .agg(F.min(F.struct("position", "name", "arguments", "needs")).alias("c"), F.count("*").alias("n_calls"))
        .select("call_id", "c.*", "n_calls")
    )
    first = settle(first)
    answered = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("position", "content")).alias("r"), F.count("*").alias("n_results"))
    needed = first.select("call_id", F.explode(F.array_distinct("needs")).alias("needs")).where("needs IS NOT NULL")
    known = first.select(F.col("call_id").alias("needs"))
    links = settle(needed.join(known, "needs"))
    unmet = needed.join(known, "needs", "left_anti").select("call_id").distinct().withColumn("unmet", F.lit(True))
    linked = (
        first.join(depths(first, links), "call_id", "left")
        .join(unmet, "call_id", "left")
        .withColumn("is_call", F.lit(True))
        .join(answered, "call_id", "full")
        .unionByName(void.withColumn("is_call", F.lit(True)).withColumn("n_calls", F.lit(1).cast("long")), allowMissingColumns=True)
    )
    errors = F.when(F.col("is_call"), argument_errors(F.col("name"), F.col("arguments"), schemas))
    status = (
        F.when(F.col("is_call").isNull(), "orphan_result")
        .when(F.col("call_id").isNotNull() & F.col("depth").isNull(), "cycle")
        .when(F.col("unmet"), "unmet_need")
        .when(F.col("r.position") < F.col("position"), "result_before_call")
        .when(F.col("r").isNull(), "missing_result")
        .when(F.size("errors") > 0, "invalid_arguments")
        .otherwise("ok")
    )
    body = F.to_json(
        F.struct(
            F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.array("arguments"))).alias("arguments"),
            F.col("call_id").alias("id"),
            F.col("name"),
            F.array_sort("needs").alias("needs"),
            F.col("r.content").alias("result"),
            F.col("status"),
        )
    )
    return (
        linked.withColumn("errors", errors)
        .withColumn("status", status)
        .select(
            "call_id",
            F.coalesce("position", "r.position").alias("position"),
            "name",
            "depth",
            "status",
            F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
            F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
            F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
            body.alias("json"),
        )
    )


#: Tools that the query reads user messages as calls of.
CHAT_SCHEMAS: dict[str, dict[str, Any]] = {
    "reply": {"properties": {"lines": {"kind": "integer", "minimum": 1, "maximum": 8}, "prompt": {"kind": "string", "max_length": 2000}}, "required": ["lines", "prompt"]},
    "brief": {"properties": {"prompt": {"kind": "string", "max_length": 120}, "style": {"kind": "string", "enum": ["short"]}}, "required": ["prompt"]},
}


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User messages as calls, assistant messages as results of the message before them.

    A call is identified by conversation and turn and needs the user message two turns
    earlier, if there is one.  Messages of under 60 characters call ``brief``.
    """
    ident = F.concat_ws(":", F.col("conv_id"), F.col("turn"))
    users = conversations.where("role = 'user'").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    earlier = users.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("follows")).distinct()
    short = F.length("text") < 60
    arguments = F.when(short, F.to_json(F.struct(F.col("text").alias("prompt"), F.lit("short").alias("style")))).otherwise(
        F.to_json(F.struct(F.size(F.split("text", "\n")).alias("lines"), F.col("text").alias("prompt")))
    )
    calls = users.join(earlier, ["conv_id", "turn"], "left").select(
        F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), ident).alias("call_id"),
        F.col("turn").alias("position"),
        F.when(short, "brief").otherwise("reply").alias("name"),
        arguments.alias("arguments"),
        F.when(F.col("follows"), F.array(F.concat_ws(":", F.col("conv_id"), F.col("turn") - 2))).alias("needs"),
    )
    results = conversations.where("role = 'assistant'").select(
        F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1)).alias("call_id"),
        F.col("turn").cast("long").alias("position"),
        F.col("text").cast("string").alias("content"),
    )
    return calls, results


def op9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*chat_calls(table(spark, sf_dir, "conversations")), CHAT_SCHEMAS)


def canonical(value: Any) -> str:
    """What the json column holds for a value: sorted keys, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
