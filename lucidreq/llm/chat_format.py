"""Chat messages with their tool calls linked, ordered, validated and serialised.

An assistant's text that is a JSON object with ``tool_calls`` (objects with id,
name, arguments, optionally ``after``: ids of calls whose results it waits for)
makes calls; the text of a ``tool`` message that is a JSON object with
``tool_call_id`` is the result of one. Results are hash-joined with calls by
(conv_id, id); a result comes after its call, and a call after the results it
waits for, which gives a topological order; arguments are checked against the
tools' schemas; every message becomes one line of canonical JSON (all keys of the
message, sorted, no spaces).

Rows stay one for each message, so no conversation is ever gathered in a task.
Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

TOOL_SCHEMA = "name string, parameter string, type string, required boolean"

#: The tools that calls are checked against unless others are given: one row for each parameter.
DEFAULT_TOOLS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("calculator", "expression", "string", True),
    ("get_weather", "city", "string", True),
    ("get_weather", "unit", "string", False),
]


_LAST = 2**63 - 1


def _variant(c: Column, kind: str) -> Column:
    return F.try_variant_get(c, "$", kind)


def _object(json: Column) -> Column:
    """The JSON object's entries; null for any other text, and for objects that repeat a key."""
    return F.when(F.try_parse_json(json).isNotNull(), F.from_json(json, "map<string,variant>"))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, mid (a digest of the four, the same for repeated rows), at (turn, null ones last), entries, calls, result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.lower(F.trim(F.coalesce(F.col("role").cast("string"), F.lit(""))))
    out = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    mid = F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}))
    entries = F.when(F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{"), _object(F.col("text")))
    out = out.withColumns({"mid": mid, "at": F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)), "entries": entries})
    listed = F.from_json(F.col("entries")["tool_calls"].cast("string"), "array<map<string,variant>>")
    calls = F.when((F.col("role") == "assistant") & F.col("entries")["tool_calls"].isNotNull(), listed)
    result = F.when(F.col("role") == "tool", _variant(F.col("entries")["tool_call_id"], "string"))
    return out.withColumns({"calls": F.when(~F.exists(calls, lambda c: c.isNull()), calls), "result": result})


def _arguments(call: Column) -> Column:
    """The call's arguments; a string is read as JSON where it is some."""
    own = call["arguments"]
    return F.coalesce(F.try_parse_json(_variant(own, "string")), own)


def calls_of(messages: DataFrame) -> DataFrame:
    """One row for each call: conv_id, at, mid, place, call_id, name, args, after. A repeated message makes its calls once."""
    own = messages.where("calls is not null").select("conv_id", "at", "mid", "calls").dropDuplicates(["mid"])
    own = own.select("conv_id", "at", "mid", F.posexplode("calls").alias("place", "c"))
    c = F.col("c")
    return own.select(
        "conv_id", "at", "mid", "place", _variant(c["id"], "string").alias("call_id"), _variant(c["name"], "string").alias("name"), _arguments(c).alias("args"), _variant(c["after"], "array<string>").alias("after")
    )


def first_calls(calls: DataFrame) -> DataFrame:
    """The earliest call of each (conv_id, call_id), which results link to."""
    return (
        calls.where("conv_id is not null and call_id is not null")
        .groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("at", "mid")).alias("m"))
        .select("conv_id", "call_id", F.col("m.at").alias("s_at"), F.col("m.mid").alias("s"))
    )


def validated(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """mid, place and n_errors of each call.

    An error is: an unknown tool, arguments that are no JSON object, a required
    parameter that is absent, a parameter that the tool lacks, a value of another
    type (integers are numbers too).
    """
    spark = calls.sparkSession
    key = ["mid", "place"]
    is_object = F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False))
    rows = calls.select(*key, "name", F.when(is_object, F.col("args")).alias("args"))
    given = spark.sql("SELECT c.mid, c.place, c.name, v.key AS parameter, schema_of_variant(v.value) AS kind FROM {c} c, LATERAL variant_explode(c.args) v", c=rows)
    names = tools.select("name").distinct()
    kind = (
        F.when(F.col("kind").isin("BIGINT"), "integer")
        .when(F.col("kind").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(F.col("kind") == "STRING", "string")
        .when(F.col("kind") == "BOOLEAN", "boolean")
        .when(F.col("kind").startswith("ARRAY"), "array")
        .when(F.col("kind").startswith("OBJECT"), "object")
        .otherwise("null")
    )
    wrong = (
        given.join(names, "name")
        .join(tools.select("name", "parameter", "type"), ["name", "parameter"], "left")
        .where(F.col("type").isNull() | ~((F.col("type") == kind) | ((F.col("type") == "number") & (kind == "integer"))))
        .select(*key)
    )
    wanted = rows.join(tools.where("required").select("name", "parameter"), "name")
    absent = wanted.join(given.select(*key, "parameter"), [*key, "parameter"], "left_anti").select(*key)
    unknown = rows.join(names, "name", "left_anti").select(*key)
    broken = rows.where("args is null").select(*key)
    errors = wrong.unionAll(absent).unionAll(unknown).unionAll(broken).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(errors, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("n_errors"))


def dependencies(messages: DataFrame, calls: DataFrame, links: DataFrame) -> DataFrame:
    """conv_id, s, s_at, t, t_at: message t comes after message s."""
    results = messages.where("result is not null").select("conv_id", "at", "mid", F.col("result").alias("call_id")).dropDuplicates(["mid"])
    of_result = results.join(links, ["conv_id", "call_id"]).select("conv_id", "s", "s_at", F.col("mid").alias("t"), F.col("at").alias("t_at"))
    waits = calls.select("conv_id", "mid", "at", F.explode("after").alias("call_id"))
    done = results.select("conv_id", "call_id", F.col("mid").alias("s"), F.col("at").alias("s_at"))
    of_call = waits.join(done, ["conv_id", "call_id"]).select("conv_id", "s", "s_at", F.col("mid").alias("t"), F.col("at").alias("t_at"))
    return of_result.unionByName(of_call).distinct()


def ordered(edges: DataFrame) -> DataFrame:
    """mid, level, order_at of the messages whose turns alone don't put them in order.

    A conversation in which every message's turn is later than those it depends on
    needs nothing. In the others a message moves behind what it depends on: (order_at,
    level) is the greatest of (its turn, 0) and (order_at, level + 1) of those. A
    message in a cycle, or behind one, has no level. Rounds are as many as the
    longest chain in a conversation that is out of order.
    """
    odd = edges.where("s_at >= t_at").select("conv_id").distinct()
    edges = materialize(edges.join(odd, "conv_id", "left_semi"), "chat-edges")
    heads = edges.select(F.col("s").alias("mid"), F.col("s_at").alias("order_at")).distinct()
    tails = edges.select(F.col("t").alias("mid"), F.col("t_at").alias("at")).distinct()
    front = materialize(heads.join(tails, "mid", "left_anti").select("mid", F.lit(0).alias("level"), "order_at"), "chat-level")
    settled = [front]
    while not front.isEmpty():
        so_far = settled[0]
        for x in settled[1:]:
            so_far = so_far.unionByName(x)
        at = so_far.select(F.col("mid").alias("s"), "level", "order_at")
        near = edges.join(front.select(F.col("mid").alias("s")), "s", "left_semi").select("t").distinct()
        into = edges.join(near, "t", "left_semi").join(at, "s", "left")
        last = F.max(F.struct("order_at", (F.col("level") + 1).alias("level")))
        ready = into.groupBy("t", "t_at").agg(F.count(F.lit(1)).alias("n"), F.count("order_at").alias("k"), last.alias("m")).where("n = k")
        moved = F.greatest(F.struct(F.col("t_at").alias("order_at"), F.lit(0).alias("level")), F.col("m"))
        front = materialize(ready.select(F.col("t").alias("mid"), moved.alias("p")).select("mid", "p.level", "p.order_at"), "chat-level")
        settled.append(front)
    done = settled[0]
    for x in settled[1:]:
        done = done.unionByName(x)
    cyclic = tails.join(done.select("mid"), "mid", "left_anti").select("mid", F.lit(None).cast("int").alias("level"), F.col("at").alias("order_at"))
    return done.unionByName(cyclic)


def canonical(messages: DataFrame) -> DataFrame:
    """Adds json: one line with all keys, sorted at every depth; arguments given as a string of JSON are that JSON."""
    put = lambda m, **new: F.map_concat(F.map_filter(m, lambda k, _: ~k.isin(*new)), F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]))
    string = lambda c: F.parse_json(F.to_json(F.array(c)))  # noqa: E731  an array of the one string
    one = lambda c: F.variant_get(string(c), "$[0]", "variant")
    content = F.coalesce(F.col("entries")["content"], one(F.lit("")))
    calls = F.parse_json(F.to_json(F.transform("calls", lambda c: F.when(c["arguments"].isNotNull(), put(c, arguments=_arguments(c))).otherwise(c))))
    with_calls = put(F.col("entries"), content=content, role=one(F.col("role")), tool_calls=calls)
    with_result = put(F.col("entries"), content=content, role=one(F.col("role")))
    line = lambda m: F.to_json(F.parse_json(F.to_json(m)))
    plain = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")))
    return messages.withColumn("json", F.when(F.col("calls").isNotNull(), line(with_calls)).when(F.col("result").isNotNull(), line(with_result)).otherwise(plain))


def format_chats(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, json, n_calls, n_invalid, linked, level, order_turn.

    Sorting by (conv_id, order_turn, level, turn), nulls last, gives a conversation in a
    valid order; level is null in a cycle. linked is null for messages that are no
    result, false for a result without its call. Null role and text count as
    empty; a null conv_id or call id links with nothing; a null turn is later than
    any other; of calls that share an id the first counts; a repeated message is
    repeated in the result, and its calls count once. A JSON text of another shape,
    or with a key twice, is an ordinary text. Other columns play no part.
    """
    rows = parsed(messages)
    calls = materialize(calls_of(rows), "chat-calls")
    links = first_calls(calls)
    checked = validated(calls, tools).groupBy("mid").agg(F.count(F.lit(1)).cast("int").alias("n_calls"), F.sum((F.col("n_errors") > 0).cast("int")).cast("int").alias("n_invalid"))
    levels = ordered(dependencies(rows, calls, links)).withColumn("moved", F.lit(True))
    out = canonical(rows).join(checked, "mid", "left").join(levels, "mid", "left")
    found = links.select(F.col("conv_id").alias("f_conv_id"), F.col("call_id").alias("f_call_id"), F.lit(True).alias("found"))
    out = out.join(found, (F.col("conv_id") == F.col("f_conv_id")) & (F.col("result") == F.col("f_call_id")), "left")
    order_turn = F.when(F.col("moved"), F.when(F.col("order_at") < F.lit(_LAST), F.col("order_at"))).otherwise(F.col("turn"))
    return out.select(
        "conv_id",
        "turn",
        "role",
        "json",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"),
        F.when(F.col("result").isNotNull(), F.coalesce("found", F.lit(False))).alias("linked"),
        F.when(F.col("moved"), F.col("level")).otherwise(F.lit(0)).alias("level"),
        order_turn.cast(messages.schema["turn"].dataType).alias("order_turn"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every message of conversations, linked, checked and serialised."""
    return format_chats(table(spark, sf_dir, "conversations"), spark.createDataFrame(DEFAULT_TOOLS, TOOL_SCHEMA))
