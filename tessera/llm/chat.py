"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Only DataFrame and SQL functions run here. Calls and results meet in a hash join on conversation and call id, both of
which spread a long conversation over all tasks. A call's level is the length of the longest chain of calls that it
waits for. Chains of calls that wait for one other each are followed by doubling, so that a chain of n calls takes
log2(n) rounds of joins; calls that wait for several are peeled in rounds over the chains between them. No conversation
is ever gathered in one place. Arguments are exploded and joined to their schemas. Canonical JSON has sorted keys and no spaces.

Repeated rows count once. Of different calls or results with one id the first by turn, then by a hash of its content,
counts, the others are `repeated`. Calls on a cycle, and those that wait for one, have no level and the status `cyclic`; a call without a
result is `pending`, a result without a call `orphan`. Arguments that aren't a JSON object give the error `not an object`.
Nulls: a row without a conversation or call id is linked to nothing. Other columns have no part in the result, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import written

CALL = "tool_calls array<struct<id string, name string, arguments string, after array<string>>>"
RESULT = "tool_call_id string, content string"
#: Most rows of a schema table that is sent to all executors; a larger one is joined by key.
SENT_SCHEMAS = 10_000


def messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages of rows of conv_id, turn, role and text.

    An assistant's text that is a JSON object with `tool_calls` makes these calls, a tool's text with `tool_call_id` is a
    result. Of the rest, each user turn with a text is a call of `reply` whose result is the assistant's turn after it;
    it waits for the call that the turn before it answers. What remains are plain messages.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").distinct()
    before = turns.filter(F.col("role").isin("assistant") | ((F.col("role") == "user") & F.col("text").isNotNull()))
    before = before.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.collect_set("role").alias("before"))
    turns = written(turns.join(before, ["conv_id", "turn"], "left"), "turns")
    made, got = F.when(F.col("role") == "assistant", F.from_json("text", CALL)["tool_calls"]), F.when(F.col("role") == "tool", F.from_json("text", RESULT))
    is_call, is_answer = made.isNotNull(), F.coalesce(got["tool_call_id"].isNotNull(), F.lit(False))
    asks = ~is_call & (F.col("role") == "user") & F.col("text").isNotNull()
    replies = ~is_call & (F.col("role") == "assistant") & F.array_contains("before", "user")
    asks, replies = (F.coalesce(x, F.lit(False)) for x in (asks, replies))
    name = lambda turn: F.concat(F.lit("reply-"), turn.cast("string"))
    real = turns.filter(is_call).select("conv_id", "turn", F.explode(F.array_distinct(made)).alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.after", F.array()).alias("after"))
    after = F.when(F.array_contains("before", "assistant"), F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    asked = turns.filter(asks).select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), after.alias("after"))
    answers = turns.filter(is_answer).select("conv_id", "turn", got["tool_call_id"].alias("call_id"), got["content"].alias("content"))
    given = turns.filter(replies).select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return real.unionByName(asked), answers.unionByName(given), turns.filter(~is_call & ~is_answer & ~asks & ~replies).select("conv_id", "turn", "role", "text")


def first_of(rows: DataFrame, *others: str) -> DataFrame:
    """rows with `mark`, a hash of the columns others, and `repeated`: whether another row of its conversation and call id
    comes before it by turn and mark."""
    rows = rows.withColumn("mark", F.xxhash64(*others))
    head = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call")).agg(F.min(F.struct("turn", "mark")).alias("_head"))
    joined = rows.join(head, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("call_id").eqNullSafe(F.col("_call")))
    return joined.select(*rows.columns, (~F.struct("turn", "mark").eqNullSafe(F.col("_head"))).alias("repeated"))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level of the calls that don't wait for a cycle; what isn't among calls isn't waited for."""
    key = ["conv_id", "call_id"]
    nodes = written(calls.select(*key).filter("conv_id IS NOT NULL AND call_id IS NOT NULL").distinct(), "nodes")
    waits = calls.select(*key, F.explode("after").alias("needs")).distinct()
    waits = written(waits.join(nodes.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi"), "waits")
    degree = written(waits.groupBy(*key).agg(F.count("*").alias("n")), "degree")
    roots = nodes.join(degree, key, "left_anti").withColumn("level", F.lit(0))
    # ends: the call at the end of each chain of single waits, which has none or several, and the steps to it.
    ends = written(waits.join(degree.filter("n = 1"), key, "left_semi").select(*key, F.col("needs").alias("end"), F.lit(1).alias("steps")), "ends")
    for _ in range(max(1, ends.count()).bit_length() + 1):
        further = ends.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("_end"), F.col("steps").alias("_steps"))
        moved = ends.join(further, ["conv_id", "end"], "left").select(*key, F.coalesce("_end", "end").alias("end"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_end").isNotNull().alias("moved"))
        ends = written(moved, "ends")
        if not ends.filter("moved").head(1):
            break
        ends = ends.drop("moved")
    else:  # what still moves goes round
        ends = ends.join(ends.select("conv_id", F.col("call_id").alias("end")), ["conv_id", "end"], "left_anti")
    ends = ends.select(*key, "end", "steps")
    several = degree.filter("n > 1").select(*key)
    found = roots
    if several.head(1):
        steps = waits.join(several, key, "left_semi").join(ends.select("conv_id", F.col("call_id").alias("needs"), "end", "steps"), ["conv_id", "needs"], "left")
        single = degree.filter("n = 1").select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("chained"))
        steps = steps.join(single, ["conv_id", "needs"], "left")
        end = F.when(F.col("end").isNotNull(), F.col("end")).when(F.col("chained").isNull(), F.col("needs"))
        left = written(steps.select(*key, end.alias("end"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "left")
        found = written(roots, "levels")
        while True:  # each round frees a call at least, or is the last
            met = left.join(found.select("conv_id", F.col("call_id").alias("end"), "level"), ["conv_id", "end"], "left")
            freed = met.groupBy(*key).agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("steps")).alias("level")).filter("open = 0").select(*key, "level")
            freed = written(freed, "freed")
            if not freed.head(1):
                break
            left, found = written(left.join(freed, key, "left_anti"), "left"), written(found.unionByName(freed), "levels")
    chained = ends.join(found.select("conv_id", F.col("call_id").alias("end"), "level"), ["conv_id", "end"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return written(found.unionByName(chained), "levels")


def _kind(value: Column) -> Column:
    found = F.schema_of_variant(value)
    return F.when(found.startswith("OBJECT"), "object").when(found.startswith("ARRAY"), "array").when(found == "BIGINT", "integer").when(found.startswith("DECIMAL") | (found == "DOUBLE"), "number").when(found == "VOID", "null").otherwise(F.lower(found))


def errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, mark and a sorted array of what is wrong with the arguments of calls, where something is.

    schemas: name, param, type (string, integer, number, boolean, object, array) and required. An integer is a number too.
    """
    schemas = schemas.select("name", "param", "type", "required").dropDuplicates(["name", "param"])
    known = schemas.select("name").distinct()
    if schemas.count() <= SENT_SCHEMAS:
        schemas, known = F.broadcast(schemas), F.broadcast(known)
    key = ["conv_id", "call_id", "turn", "mark", "name"]
    parsed = calls.select(*key, F.try_parse_json("arguments").alias("v")).withColumn("whole", F.coalesce(_kind(F.col("v")) == "object", F.lit(False)))
    wrong = parsed.filter(~F.col("whole")).select(*key, F.lit("not an object").alias("error"))
    odd = parsed.join(known, "name", "left_anti").select(*key, F.concat(F.lit("no schema of "), F.coalesce("name", F.lit("null"))).alias("error"))
    sound = parsed.filter("whole").join(known, "name", "left_semi")
    given = sound.lateralJoin(sound.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*key, F.col("key").alias("param"), _kind(F.col("value")).alias("kind"))
    met = given.join(schemas, ["name", "param"], "left")
    fits = (F.col("kind") == F.col("type")) | ((F.col("type") == "number") & (F.col("kind") == "integer"))
    unfit = met.filter(F.col("type").isNull() | ~fits).select(*key, F.when(F.col("type").isNull(), F.concat(F.lit("unknown "), "param")).otherwise(F.concat("param", F.lit(" is "), "kind", F.lit(", not "), "type")).alias("error"))
    due = sound.select(*key).join(schemas.filter("required"), "name")
    lacking = due.join(given.select(*key, "param"), [*key, "param"], "left_anti").select(*key, F.concat(F.lit("missing "), "param").alias("error"))
    found = wrong.unionByName(odd).unionByName(unfit).unionByName(lacking)
    return written(found.groupBy(*key[:-1]).agg(F.sort_array(F.collect_set("error")).alias("errors")), "errors")


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, kind (call or result), call_id, level, status, valid and canonical of all calls and orphan results."""
    calls, results = first_of(calls, "name", "arguments", "after"), first_of(results, "content")
    heads, answers = calls.filter("NOT repeated"), results.filter("NOT repeated").select("conv_id", "call_id", "content", F.col("turn").alias("answered"))
    rows = calls.join(levels(heads), ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left")
    key = ["conv_id", "call_id", "turn", "mark"]
    wrong = errors(calls.drop("repeated"), schemas).select(*[F.col(c).alias(f"_{c}") for c in key], "errors")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    rows = rows.join(wrong, same, "left").select(*rows.columns, F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
    status = F.when(F.col("repeated"), "repeated").when(F.col("level").isNull(), "cyclic").when(F.col("answered").isNull(), "pending").otherwise("linked")
    # The fields of each object stand in the order of their names; a parsed object keeps its keys sorted.
    json = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("call_id"), F.col("errors").alias("errors"), F.col("level").alias("level"), F.col("name").alias("name"), F.when(~F.col("repeated"), F.col("content")).alias("result"), status.alias("status")))
    made = rows.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "level", status.alias("status"), (F.size("errors") == 0).alias("valid"), json.alias("canonical"))
    known = written(calls.select("conv_id", "call_id").distinct(), "known").withColumn("_known", F.lit(True))
    lone = results.join(known, ["conv_id", "call_id"], "left").filter("repeated OR _known IS NULL")
    lone = lone.withColumn("status", F.when(F.col("_known").isNull(), "orphan").otherwise("repeated"))
    json = F.to_json(F.struct("call_id", F.col("content").alias("result"), "status"))
    return made.unionByName(lone.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.lit(None).cast("int").alias("level"), "status", F.lit(True).alias("valid"), json.alias("canonical")))


def formatted(conversations: DataFrame, schemas: DataFrame) -> DataFrame:
    """linked() of the calls and results of conversations, and their plain messages."""
    calls, results, plain = messages(conversations)
    json = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")))
    said = plain.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit("plain").alias("status"), F.lit(True).alias("valid"), json.alias("canonical"))
    return linked(calls, results, schemas).unionByName(said)
