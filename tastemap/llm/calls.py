"""Tool-call linking for chat data; DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CALL = ["conv_id", "call_id"]


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def message_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written in chat messages (conv_id, turn, role, text).

    A call is an entry of ``tool_calls`` in an assistant text that is a JSON object: id, name (or
    function.name) and arguments (object, or a string of one). A result is a tool message, a JSON object with
    ``tool_call_id`` and ``content``. Other texts, nulls included, hold neither.
    """
    shape = "tool_calls array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>"
    spoken = messages.filter((F.col("role") == "assistant") & F.ltrim("text").startswith("{")).select("conv_id", "turn", F.posexplode(F.from_json("text", shape)["tool_calls"]).alias("place", "c"))
    calls = spoken.select(
        "conv_id", F.col("c.id").alias("call_id"), F.coalesce("c.name", "c.function.name").alias("name"),
        F.coalesce("c.arguments", "c.function.arguments").alias("arguments"), "turn", "place")
    told = messages.filter((F.col("role") == "tool") & F.ltrim("text").startswith("{"))
    told = told.select("conv_id", "turn", F.from_json("text", "tool_call_id string, content string").alias("r"))
    return calls, told.select("conv_id", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"), "turn")


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id and the sorted ``errors`` of calls whose arguments break their schema.

    ``schemas``: name, field, type (string, integer, number, boolean, array or object), required. Errors:
    ``no object`` (null, no JSON, or JSON of another kind), ``unknown tool``, ``missing:f``, ``type:f``, ``unknown:f``.
    """
    parsed = calls.select(*CALL, "name", F.expr("try_parse_json(arguments)").alias("v"))
    is_object = F.coalesce(F.expr("schema_of_variant(v) LIKE 'OBJECT%'"), F.lit(False))
    fields = F.when(is_object, F.from_json(F.to_json("v"), "map<string,variant>"))
    parsed = parsed.select(*CALL, "name", is_object.alias("is_object"), fields.alias("fields"))
    given = parsed.select(*CALL, "name", F.explode("fields").alias("field", "value")).select(*CALL, "name", "field", F.expr("schema_of_variant(value)").alias("kind"))
    by_name = schemas.groupBy("name").agg(F.collect_list("field").alias("known"), F.array_sort(F.collect_list(F.when(F.col("required"), F.col("field")))).alias("needed"))
    whole = parsed.join(by_name, "name", "left").select(
        *CALL,
        F.when(~F.col("is_object"), F.array(F.lit("no object"))).when(F.col("known").isNull(), F.array(F.lit("unknown tool"))).otherwise(
            F.transform(F.array_except("needed", F.map_keys("fields")), lambda f: F.concat(F.lit("missing:"), f))).alias("errors"))
    whole = whole.select(*CALL, F.explode("errors").alias("error"))
    tools = schemas.select("name").distinct()
    typed = given.join(tools, "name").join(schemas.select("name", "field", "type"), ["name", "field"], "left")
    number = F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    fits = (
        F.when(F.col("type") == "string", F.col("kind") == "STRING").when(F.col("type") == "integer", F.col("kind").rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"))
        .when(F.col("type") == "number", number).when(F.col("type") == "boolean", F.col("kind") == "BOOLEAN")
        .when(F.col("type") == "array", F.col("kind").startswith("ARRAY")).when(F.col("type") == "object", F.col("kind").startswith("OBJECT")))
    wrong = typed.select(*CALL, F.when(F.col("type").isNull(), F.concat(F.lit("unknown:"), "field")).when(~fits, F.concat(F.lit("type:"), "field")).alias("error"))
    return whole.union(wrong.filter("error is not null")).groupBy(*CALL).agg(F.array_sort(F.collect_set("error")).alias("errors"))


#: More than any chain of calls has; lengths around a cycle stop growing there.
FAR = 1 << 40


def topological_steps(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """conv_id, call_id and ``step``: 0 without needs, else one more than the largest step among the calls needed.

    ``needs``: conv_id, call_id, needed. Needs of calls that do not exist are left out. Calls in or behind a
    cycle get step null.

    Each round settles the calls without open needs, and passes every need of a call that itself has a single
    open need on to that one, with the lengths added up. A chain thus halves each round and a tree shrinks about
    as fast; only calls with several open needs, each on another such call, take one round a step.
    """
    known = calls.select(*CALL).distinct()
    links = needs.select(*CALL, "needed").distinct().join(known.withColumnRenamed("call_id", "needed"), ["conv_id", "needed"], "left_semi")
    # A row is a bound of its call's step: ``least``, and ``gap`` above the step of the call needed.
    bounds = known.join(links, CALL, "left").select(*CALL, "needed", F.when(F.col("needed").isNotNull(), F.lit(1)).cast("long").alias("gap"), F.lit(0).cast("long").alias("least"))
    bounds, done = written(bounds), None
    while True:
        state = written(bounds.groupBy(*CALL).agg(F.max("least").alias("at_least"), F.min("needed").alias("via"), F.max("needed").alias("last"), F.max("gap").alias("via_gap")))
        settled = state.filter("last is null").select(*CALL, F.col("at_least").cast("int").alias("step"))
        if settled.isEmpty():
            break
        done = settled if done is None else done.union(settled)
        bounds = written(_next_bounds(bounds, state))
    return known.join(done, CALL, "left") if done is not None else known.withColumn("step", F.lit(None).cast("int"))


def _next_bounds(bounds: DataFrame, state: DataFrame) -> DataFrame:
    """Bounds of the calls still open, after the needs of settled calls and of calls with a single need."""
    ends = state.filter("last is null").select("conv_id", F.col("call_id").alias("via"), F.col("at_least").alias("end"))
    single = F.col("via") == F.col("last")
    behind = state.join(ends, ["conv_id", "via"], "left").select(
        "conv_id", F.col("call_id").alias("needed"), "at_least", "via_gap",
        F.when(F.col("last").isNull(), F.col("at_least")).when(single, F.greatest("at_least", F.col("end") + F.col("via_gap"))).alias("reached"),
        F.when(F.col("last").isNull() | (single & F.col("end").isNotNull()), True).otherwise(False).alias("ends"),
        F.when(single & (F.col("via") != F.col("call_id")), F.col("via")).alias("onward"))
    near = lambda c: F.least(c, F.lit(FAR))
    met = bounds.filter("needed is not null").join(behind, ["conv_id", "needed"])
    passed = F.col("onward").isNotNull()
    moved = met.select(
        *CALL, F.when(F.col("ends"), None).when(passed, F.col("onward")).otherwise(F.col("needed")).alias("needed"),
        F.when(F.col("ends"), None).when(passed, near(F.col("gap") + F.col("via_gap"))).otherwise(F.col("gap")).alias("gap"),
        F.greatest("least", near(F.when(F.col("ends"), F.col("reached")).otherwise(F.col("at_least")) + F.col("gap"))).alias("least"))
    kept = state.filter("last is not null").select(*CALL, F.lit(None).cast(bounds.schema["needed"].dataType).alias("needed"), F.lit(None).cast("long").alias("gap"), F.col("at_least").alias("least"))
    return moved.unionByName(kept)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, needs: DataFrame | None = None) -> DataFrame:
    """One row per call, and per result without a call: linked, ordered, validated and as canonical JSON.

    ``calls``: conv_id, call_id, name, arguments (JSON), turn, place. ``results``: conv_id, call_id, content,
    turn. Calls and results meet in a hash join by (conv_id, call_id), so a conversation that holds a third of
    all calls spreads by call. The first result by turn and content is linked and ``n_results`` counts them;
    of calls that share an identifier the first by turn, place, name and arguments stands and ``n_calls`` counts
    them. A null identifier links with nothing. Arguments and contents of any length are read whole, other columns
    are not read, and empty tables give no rows.

    Returns conv_id, call_id, turn, step (null: no call, or a cycle), n_calls, n_results, valid, errors, json.
    """
    first = F.struct("turn", "place", F.coalesce("name", F.lit("")).alias("by_name"), F.coalesce("arguments", F.lit("")).alias("by_text"), "name", "arguments")
    once = calls.filter("conv_id is not null and call_id is not null").groupBy(*CALL).agg(F.min(first).alias("c"), F.count("*").alias("n_calls"))
    once = written(once.select(*CALL, "c.turn", "c.place", "c.name", "c.arguments", "n_calls"))
    told = results.filter("conv_id is not null and call_id is not null").groupBy(*CALL).agg(F.min(F.struct("turn", F.coalesce("content", F.lit("")).alias("content"))).alias("r"), F.count("*").alias("n_results"))
    steps = topological_steps(once, needs) if needs is not None else once.select(*CALL, F.lit(0).alias("step"))
    out = once.join(told, CALL, "full").join(steps, CALL, "left").join(argument_errors(once, schemas), CALL, "left")
    no_call = F.col("n_calls").isNull()
    errors = F.when(no_call, F.array(F.lit("no call"))).otherwise(F.coalesce("errors", F.array().cast("array<string>")))
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("arguments")), F.lit("null")), F.lit(',"call_id":'), _quoted(F.col("call_id")),
        F.lit(',"name":'), F.coalesce(_quoted(F.col("name")), F.lit("null")), F.lit(',"result":'), F.coalesce(_quoted(F.col("r.content")), F.lit("null")), F.lit("}"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        *CALL, F.coalesce(out["turn"], F.col("r.turn")).alias("turn"), "step", n("n_calls").alias("n_calls"), n("n_results").alias("n_results"),
        (F.size(errors) == 0).alias("valid"), errors.alias("errors"), body.alias("json"))


def _quoted(text: Column) -> Column:
    """A JSON string; null stays null."""
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1"))
