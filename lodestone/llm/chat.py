"""Chat formatting: tool calls linked with their results.

A conversation's rows are read as events. An assistant row whose text is a
JSON object with ``tool_calls`` (a list of ``{id, name, arguments,
depends_on?}``) makes calls; a ``tool`` row with ``tool_call_id`` and
``content`` makes a result. With ``plain="exchange"`` every other user row is
a call of the function ``respond`` with its text as ``prompt``, and the
assistant row of the next turn is its result; with ``plain="message"`` such
rows stay messages.

Calls and results are hash-joined by (conversation, identifier). Calls are
ordered topologically: level 0 depends on nothing, others come one level
after the last call they depend on. Arguments are checked against the
function's JSON schema (``required``, and the ``type`` of ``properties``).
Everything is serialised as canonical JSON: keys sorted, no spaces.

DataFrame operations only, one row for each event; no conversation is
gathered, however long. Defined results: of several calls or results with
one identifier in a conversation the first by (turn, place) counts, others
are not linked; a result without a call is not linked; a call on a cycle has
level null; null text, or JSON that does not parse, is plain text; columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .native import join_on, small

SCHEMA_ROWS = 100_000  # bound for broadcasting the schemas
RESPOND = '{"required":["prompt"],"properties":{"prompt":{"type":"string"}}}'
_KEY = ["conv_id", "call_id"]


def _json(c: Column) -> Column:
    """A string as JSON; null as null."""
    j = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), "null").otherwise(F.substr(j, F.lit(6), F.length(j) - 6))


def events(conversations: DataFrame, plain: str = "exchange") -> DataFrame:
    """conv_id, turn, place, role, kind, call_id, name, arguments, after,
    content: a row for each call, result and message."""
    c = conversations.select("conv_id", "turn", "role", "text")
    c = c.withColumn("v", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    c = c.withColumn("calls", F.coalesce(calls, F.array().cast("array<variant>")))
    result_id = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    got = lambda path, kind: F.try_variant_get("call", path, kind)
    none = F.lit(None).cast("string")
    raw = got("$.arguments", "variant")
    # Arguments may come as an object or as a string that holds one.
    text_form = F.try_variant_get("call", "$.arguments", "string")
    made = c.where(F.size("calls") > 0).select("conv_id", "turn", "role", F.posexplode("calls").alias("place", "call")).select(
        "conv_id", "turn", "place", "role", F.lit("call").alias("kind"), got("$.id", "string").alias("call_id"), got("$.name", "string").alias("name"),
        F.coalesce(F.to_json(F.try_parse_json(text_form)), F.to_json(raw)).alias("arguments"),
        F.coalesce(got("$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("after"), none.alias("content"),
    )
    rest = c.where(F.size("calls") == 0).withColumn("result_id", result_id)
    ident = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    kind, cid = F.when(F.col("result_id").isNotNull(), "result"), F.col("result_id")
    if plain == "exchange":
        ask, reply = F.col("role") == "user", F.col("role") == "assistant"
        kind = kind.when(ask, "call").when(reply, "result")
        cid = F.coalesce(cid, F.when(ask, ident(F.col("turn"))).when(reply, ident(F.col("turn") - 1)))
    call = kind.otherwise("message") == "call"
    content = F.coalesce(F.try_variant_get("v", "$.content", "string"), F.to_json(F.try_variant_get("v", "$.content", "variant")))
    other = rest.select(
        "conv_id", "turn", F.lit(0).alias("place"), "role", kind.otherwise("message").alias("kind"), cid.alias("call_id"), F.when(call, F.lit("respond")).alias("name"),
        F.when(call, F.concat(F.lit('{"prompt":'), _json(F.col("text")), F.lit("}"))).alias("arguments"),
        F.array().cast("array<string>").alias("after"), F.when(F.col("result_id").isNotNull(), content).when(~call, F.col("text")).alias("content"),
    )
    return made.unionByName(other)


def levels(calls: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """conv_id, call_id, level of the calls that depend on others."""
    edges = calls.select(*_KEY, F.explode("after").alias("dep")).distinct()
    known_ids = calls.select("conv_id", F.col("call_id").alias("dep")).distinct()
    edges = settle(join_on(edges, known_ids, ["conv_id", "dep"], "left_semi"), "edges")
    done = calls.select(*_KEY).distinct()
    done = settle(join_on(done, edges.select(*_KEY), _KEY, "left_anti").withColumn("level", F.lit(0)), "levels")
    open_, parts = edges, []
    for level in range(1, max_rounds):
        if not open_.limit(1).count():
            break
        # A call is placed once none of its dependencies is open.
        waiting = join_on(open_, open_.select("conv_id", F.col("call_id").alias("dep")).distinct(), ["conv_id", "dep"], "left_semi").select(*_KEY).distinct()
        ready = join_on(open_.select(*_KEY).distinct(), waiting, _KEY, "left_anti")
        ready = settle(ready.withColumn("level", F.lit(level)), "levels")
        if not ready.limit(1).count():
            break  # only cycles are left
        parts.append(ready)
        open_ = settle(join_on(open_, ready.drop("level"), _KEY, "left_anti"), "edges")
    for p in parts:
        done = done.unionByName(p)
    return done


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``problems``: what its arguments lack. schemas: name,
    schema (JSON)."""
    s = schemas.groupBy("name").agg(F.first("schema").alias("schema"))
    s = s.select("name", F.from_json("schema", "required array<string>, properties map<string, struct<type: string>>").alias("schema"))
    c = calls.join(small(s, SCHEMA_ROWS), "name", "left")
    args = F.try_parse_json("arguments")
    is_object = F.schema_of_variant(args).startswith("OBJECT")
    c = c.withColumn("args", F.when(is_object, F.from_json("arguments", "map<string, variant>")))
    keys = F.coalesce(F.map_keys("args"), F.array().cast("array<string>"))
    missing = F.transform(F.array_except(F.coalesce("schema.required", F.array().cast("array<string>")), keys), lambda k: F.concat(F.lit("missing "), k))
    is_a = lambda v: F.schema_of_variant(v)

    def wrong(e: Column) -> Column:
        want, have = e["value"]["type"], is_a(F.element_at("args", e["key"]))
        whole = have == "BIGINT"
        number = whole | have.startswith("DECIMAL") | have.isin("DOUBLE", "FLOAT")
        ok = (
            F.when(want == "string", have == "STRING").when(want == "integer", whole).when(want == "number", number)
            .when(want == "boolean", have == "BOOLEAN").when(want == "array", have.startswith("ARRAY")).when(want == "object", have.startswith("OBJECT"))
            .when(want == "null", have == "VOID").otherwise(True)
        )
        return ~F.coalesce(ok, F.lit(True))

    typed = F.filter(F.map_entries(F.coalesce("schema.properties", F.create_map().cast("map<string, struct<type: string>>"))), lambda e: F.array_contains(keys, e["key"]))
    wrongs = F.transform(F.filter(typed, wrong), lambda e: F.concat(F.lit("not "), e["value"]["type"], F.lit(": "), e["key"]))
    found = F.when(F.col("schema").isNull(), F.array(F.lit("unknown function"))).when(F.col("args").isNull(), F.array(F.lit("no object")))
    return c.withColumn("problems", found.otherwise(F.array_sort(F.concat(missing, wrongs)))).drop("schema", "args")


def format_chat(conversations: DataFrame, schemas: DataFrame | None = None, plain: str = "exchange") -> DataFrame:
    """conv_id, turn, place, role, kind, call_id, linked, level, valid,
    problems, json: a row for each event."""
    if schemas is None:
        schemas = conversations.sparkSession.range(1).select(F.lit("respond").alias("name"), F.lit(RESPOND).alias("schema"))
    e = events(conversations, plain)
    calls, results, rest = (e.where(F.col("kind") == k) for k in ("call", "result", "message"))
    first = lambda df: df.where(F.col("call_id").isNotNull()).groupBy(*_KEY).agg(F.min(F.struct("turn", "place")).alias("at"))
    answer = results.where(F.col("call_id").isNotNull()).groupBy(*_KEY).agg(F.min_by(F.struct("content"), F.struct("turn", "place")).alias("answer"))
    here = F.struct("turn", "place")
    c = problems(calls, schemas)
    c = join_on(join_on(c, first(calls), _KEY, "left"), answer, _KEY, "left").withColumn("first", here == F.col("at"))
    c = c.withColumn("linked", F.coalesce(F.col("first") & F.col("answer").isNotNull(), F.lit(False)))
    depends = calls.where(F.size("after") > 0)
    if depends.limit(1).count():
        c = join_on(c, levels(calls.where(F.col("call_id").isNotNull())), _KEY, "left")
    else:
        c = c.withColumn("level", F.lit(0))
    j = F.concat(
        F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), _json(F.col("call_id")), F.lit(',"name":'), _json(F.col("name")),
        F.lit(',"result":'), F.when(F.col("linked"), _json(F.col("answer.content"))).otherwise(F.lit("null")), F.lit(',"role":'), _json(F.col("role")), F.lit("}"),
    )
    c = c.withColumns({"valid": F.size("problems") == 0, "json": j, "problems": F.array_join("problems", "; ")})
    r = join_on(join_on(results, first(calls).withColumnRenamed("at", "call_at"), _KEY, "left"), first(results), _KEY, "left")
    said = F.concat(F.lit('{"content":'), _json(F.col("content")), F.lit(',"id":'), _json(F.col("call_id")), F.lit(',"role":'), _json(F.col("role")), F.lit("}"))
    r = r.withColumns({"linked": F.coalesce((here == F.col("at")) & F.col("call_at").isNotNull(), F.lit(False)), "json": said})
    m = rest.withColumns({"linked": F.lit(False), "json": F.concat(F.lit('{"content":'), _json(F.col("content")), F.lit(',"role":'), _json(F.col("role")), F.lit("}"))})
    blank = {"level": F.lit(None).cast("int"), "valid": F.lit(None).cast("boolean"), "problems": F.lit(None).cast("string")}
    columns = ["conv_id", "turn", "place", "role", "kind", "call_id", "linked", "level", "valid", "problems", "json"]
    parts = [c.select(*columns), *(x.withColumns(blank).select(*columns) for x in (r, m))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
