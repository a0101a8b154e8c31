"""Tool-call linking for chat data, in DataFrame operations only.

Calls and results meet in a hash join by (conversation, identifier).  A call may wait for others (``after``): its
depth is one more than theirs, found by doubling along chains and round by round where calls wait for several, so
(depth, turn) orders a conversation's calls topologically; calls on a cycle get no depth.  Arguments are parsed as variants and held
against a schema per tool.  Every call gives one line of canonical JSON: sorted keys, no white space.

Nothing is gathered by conversation: a conversation of any length is rows that sort by (depth, turn, call_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.scratch import written

#: Tool -> field -> (type, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]

_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY<", "object": "OBJECT<"}


def _errors(schemas: Schemas, tool: str, arguments: str) -> Column:
    """What is wrong with the arguments, in order of the schema's fields."""
    value = F.try_parse_json(arguments)
    known = F.lit(None).cast("array<string>")
    for name, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            if kind == "number":
                fits = got.isin("BIGINT", "DOUBLE") | got.startswith("DECIMAL")
            else:
                fits = got.startswith(_TYPES[kind])
            absent = F.lit(f"missing {field}") if required else F.lit(None)
            checks.append(F.when(got.isNull() | (got == "VOID"), absent).when(~fits, F.lit(f"type {field}")))
        listed = F.array(*[F.lit(x) for x in fields]) if fields else F.array().cast("array<string>")
        extra = F.transform(F.sort_array(F.array_except(F.json_object_keys(arguments), listed)), lambda x: F.concat(F.lit("unexpected "), x))
        known = F.when(F.col(tool) == name, F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), F.coalesce(extra, F.array().cast("array<string>")))).otherwise(known)
    broken = value.isNull() | ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(F.col(tool).isNull() | ~F.col(tool).isin(*schemas), F.array(F.lit("unknown tool"))).when(broken, F.array(F.lit("not an object"))).otherwise(known)


def _anchors(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, steps): where the chain of calls that each wait for one other ends, and after how many
    steps, by doubling: as many tables as the longest chain has binary digits.  Chains that run into a cycle end nowhere."""
    now = written(single.select("conv_id", "call_id", F.col("dep").alias("at"), F.lit(1).alias("steps")), "chains")
    for _ in range(max(1, now.count()).bit_length() + 1):
        on = now.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"))
        step = now.select("conv_id", "call_id", "at", "steps").join(on, ["conv_id", "at"], "left")
        now = written(step.select("conv_id", "call_id", F.coalesce("to", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("to").isNotNull().alias("moved")), "chains")
        if not now.where("moved").limit(1).count():
            break
    return now.where("not moved").drop("moved")  # what still moves goes round


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of the calls that wait for no cycle: one more than the deepest call waited for.

    Calls that wait for one other only are followed to the end of their chain by doubling; calls that wait for
    several are placed round by round, as many rounds as the longest chain of such calls has."""
    key = ["conv_id", "call_id"]
    keys = calls.select(*key)
    waits = calls.select(*key, F.explode("after").alias("dep")).distinct()
    # identifiers that name no call are not waited for
    waits = written(waits.join(keys.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi").select(*key, "dep"), "waits")
    number = written(waits.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep")), "waits-for")
    chain = _anchors(number.where("n = 1"))
    placed = written(keys.join(number.select(*key), key, "left_anti").withColumn("depth", F.lit(0)), "depth")
    many = waits.join(number.where("n > 1").select(*key), key, "left_semi")
    # each call waited for, by the end of its chain; a chain without an end never lets its caller be placed
    lost = number.where("n = 1").join(chain, key, "left_anti").select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("lost"))
    by_end = many.join(chain.select("conv_id", F.col("call_id").alias("dep"), "at", "steps"), ["conv_id", "dep"], "left").join(lost, ["conv_id", "dep"], "left")
    by_end = written(by_end.select(*key, F.when(F.col("lost"), F.col("call_id")).otherwise(F.coalesce("at", "dep")).alias("at"), F.coalesce("steps", F.lit(0)).alias("steps")), "ends")
    last = placed
    while by_end.limit(1).count():
        touched = by_end.join(last.select("conv_id", F.col("call_id").alias("at")), ["conv_id", "at"], "left_semi").select(*key).distinct()
        known = by_end.join(touched, key, "left_semi").join(placed.select("conv_id", F.col("call_id").alias("at"), "depth"), ["conv_id", "at"], "left")
        ready = known.groupBy(*key).agg(F.max(F.col("depth") + F.col("steps") + 1).alias("depth"), F.count_if(F.col("depth").isNull()).alias("open")).where("open = 0")
        last = written(ready.select(*key, "depth"), "depth")
        if not last.limit(1).count():
            break
        placed = placed.unionByName(last)
    ends = chain.join(placed.select("conv_id", F.col("call_id").alias("at"), "depth"), ["conv_id", "at"])
    return placed.unionByName(ends.select(*key, (F.col("depth") + F.col("steps")).alias("depth")))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and per result without a call: conv_id, call_id, turn, kind (``call`` or ``orphan``),
    depth, errors, n_results, result, json.

    ``calls``: conv_id, call_id, turn, tool, arguments (JSON), after (identifiers it waits for).  ``results``:
    conv_id, call_id, turn, content.  Of calls that share an identifier the one with the smallest turn (then tool
    and arguments) is linked and the rest are errors ``duplicate id``; of a call's results the first by turn
    (then content) is its result.  A call without conversation or identifier is an error ``no id`` and is not
    linked; a result without them is an orphan.  Errors otherwise: ``unknown tool``, ``not an object``, ``missing
    F``, ``type F``, ``unexpected F``, ``cycle``, ``no result``.  Invalid arguments are null in the JSON line.
    Equal rows are duplicates of each other; empty tables give no rows; texts are taken whole, whatever their length;
    other columns are not read.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "call_id", "turn", "tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    named = calls.where("conv_id is not null and call_id is not null")
    first = written(named.groupBy(*key).agg(F.min(F.struct("turn", "tool", "arguments", "after")).alias("c"), F.count(F.lit(1)).alias("n")).select(*key, "c.*", "n"), "calls")
    got = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    linked = first.join(depths(first), key, "left").hint("shuffle_hash").join(got.hint("shuffle_hash"), key, "left")
    bad = _errors(schemas, "tool", "arguments")
    more = F.array_compact(F.array(F.when(F.col("depth").isNull(), F.lit("cycle")), F.when(F.col("n_results").isNull(), F.lit("no result"))))
    linked = linked.withColumn("_bad", bad).withColumn("errors", F.concat("_bad", more))
    # keys in order; a variant's own keys are sorted
    line = F.to_json(
        F.struct(
            F.when(F.size("_bad") == 0, F.try_parse_json("arguments")).alias("arguments"),
            F.col("conv_id").alias("conversation"),
            F.col("call_id").alias("id"),
            F.col("r.content").alias("result"),
            F.col("tool").alias("tool"),
        ),
        {"ignoreNullFields": "false"},
    )
    out = linked.select(*key, "turn", F.lit("call").alias("kind"), "depth", "errors", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.col("r.content").alias("result"), line.alias("json"))
    none = F.lit(None)

    def plain(df: DataFrame, kind: str, error: str, content: Column) -> DataFrame:
        return df.select(*key, "turn", F.lit(kind).alias("kind"), none.cast("int").alias("depth"), F.array(F.lit(error)).alias("errors"), F.lit(0).cast("long").alias("n_results"), content.alias("result"), none.cast("string").alias("json"))

    again = first.where("n > 1").select(*key, F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))).withColumn("turn", none.cast("long"))
    lost = results.join(first.select(*key), key, "left_anti")
    unnamed = calls.where("conv_id is null or call_id is null")
    return out.unionByName(plain(again, "call", "duplicate id", none.cast("string"))).unionByName(plain(unnamed, "call", "no id", none.cast("string"))).unionByName(plain(lost, "orphan", "no call", F.col("content")))
