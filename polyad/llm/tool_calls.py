"""Tool-call linking and canonical JSON for chat messages (operator 6).

Messages that carry a call, `{"id", "name", "arguments"}`, are joined by conversation and identifier with those
that carry a result, `{"tool_call_id", "content"}`. Plain chat is read as calls as well: a user's turn is a call
of `ask` with the turn and text as arguments, named by its turn number, and the assistant's next turn is its
result. Other messages stay plain.

Order. A call depends on the results its arguments refer to (`{"$result": id}`, at any depth), a result on the
first call of its identifier. Each message gets `order_turn`, the largest turn among itself and all it depends
on, and `order_level`, one more than the largest level of what it depends on (0 without). Sorted by
(`order_turn`, `order_level`, `turn`), messages come after all they depend on, and nothing moves where results
follow their calls. A message that depends on itself, or on one that does, has no such place: it is `cyclic` and
keeps its own turn, at level 0.

Dependencies are kept between identifiers, not messages: all results of an identifier depend on its one first
call, so repeated calls and results never make pairs. A conversation's dependencies are sorted topologically in
one task while there are at most `most_edges` of them; those of larger conversations are settled in rounds of
joins, one for each level, until nothing changes. Both ways give the same.

Arguments are parsed (a string that holds JSON counts as that JSON) and checked against the schema of the tool's
name: each field has a JSON type and may be required, and no other fields are allowed. A message is written as
JSON without spaces and with the keys of every object sorted, by UTF-16 code units; numbers in their shortest form.

One row per message; conversations are never gathered into one task, and joins are by (conversation, id), which
adaptive execution splits where an identifier has very many messages.

Defined results: null or empty texts of plain roles make calls whose text is null or empty, which the schema
of `ask` finds invalid; a second call of the same identifier in a conversation is `repeated` and links to no
result; results without a call are `orphan`, calls without a result `open`; messages without a conversation or
an identifier link to nothing; a null turn counts as the last; text that does not begin with an object, or is
no valid JSON, or repeats a key of one object, is plain text; repeated rows stay rows, of which one is the first;
other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.llm.common import materialize, table

#: Tool name to fields: (JSON type, required).
SCHEMAS = {"ask": {"text": ("string", True), "turn": ("integer", True)}}
#: How the types of parsed values begin; numbers without fraction and exponent are integers.
_TYPES = {"string": "STRING$", "integer": r"(BIGINT$|DECIMAL\(\d+,0\)$)", "number": r"(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "BOOLEAN$", "object": "OBJECT<", "array": "ARRAY<", "null": "VOID$"}
_LAST = 2**63 - 1
KEYS = ["conv_id", "call_id"]


def _json(value: Column) -> Column:
    """A string as a JSON string."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def _member(value: Column, name: str) -> Column:
    """A member of a parsed object, parsed; null if it is none."""
    return F.try_variant_get(value, "$[" + '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]', "variant")


def _kind(value: Column) -> Column:
    return F.replace(F.schema_of_variant(value), F.lit(" "), F.lit(""))


def _string(value: Column) -> Column:
    """The value of a parsed string; null for other types."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _valid(arguments: Column, name: Column, schemas: dict) -> Column:
    """Whether parsed arguments fit the schema of the tool; unknown tools don't."""
    given = F.map_keys(F.try_variant_get(arguments, "$", "map<string,variant>"))
    found = F.lit(False)
    for tool, schema in schemas.items():
        test = _kind(arguments).startswith("OBJECT<")
        for field, (kind, required) in schema.items():
            fits = _kind(_member(arguments, field)).rlike("^" + _TYPES[kind])
            if kind == "string" and required:
                fits = fits & (F.length(_string(_member(arguments, field))) > 0)
            test = test & F.coalesce(fits, F.lit(not required))
        known = F.array(*[F.lit(f) for f in schema]).cast("array<string>")
        test = test & (F.size(F.array_except(given, known)) == 0)
        found = F.when(name == tool, test).otherwise(found)
    return F.coalesce(found, F.lit(False))


def _settle(edges: list[dict]) -> dict:
    """Place of each first call: id to (turn, level), or None if it is cyclic. An edge leads from a call (id `x`, turn `tx`)
    to an identifier `y` with results, the last in turn `ty`; `ny` is null if y has no call, else the turn of its first."""
    needs, waits, open_of = defaultdict(list), defaultdict(list), {}
    turns: dict = {}
    for e in edges:
        turns[e["x"]] = e["tx"]
        if e["ny"] is not None:
            turns.setdefault(e["y"], e["ny"])
            waits[e["y"]].append(e["x"])
        needs[e["x"]].append((e["y"], e["ty"], e["ny"] is not None))
    for x in turns:
        open_of[x] = sum(called for _, _, called in needs[x])
    ready, done = [x for x, n in open_of.items() if not n], {}
    while ready:
        x = ready.pop()
        turn, level = turns[x], 0
        for y, ty, called in needs[x]:
            at, deep = done[y] if called else (ty, -1)
            turn, level = max(turn, at, ty), max(level, deep + 2)
        done[x] = (turn, level)
        for w in waits[x]:
            open_of[w] -= 1
            if not open_of[w]:
                ready.append(w)
    return {x: done.get(x) for x in turns}


_PLACE = "conv_id bigint, call_id string, place_turn bigint, place_level bigint"


def _in_tasks(edges: DataFrame) -> DataFrame:
    def run(found: pa.Table) -> pa.Table:
        places = _settle(found.to_pylist())
        rows = [(x, *(p or (None, None))) for x, p in places.items()]
        return pa.table({
            "conv_id": pa.array([found["conv_id"][0].as_py()] * len(rows), pa.int64()),
            "call_id": pa.array([r[0] for r in rows], pa.string()),
            "place_turn": pa.array([r[1] for r in rows], pa.int64()),
            "place_level": pa.array([r[2] for r in rows], pa.int64()),
        })

    return edges.groupBy("conv_id").applyInArrow(run, _PLACE)


def _in_rounds(edges: DataFrame) -> DataFrame:
    """Level by level: a call is settled once all it waits for are."""
    nodes = edges.select("conv_id", F.col("x").alias("call_id"), F.col("tx").alias("turn")).unionAll(edges.where("ny is not null").select("conv_id", "y", "ny"))
    nodes = nodes.groupBy(*KEYS).agg(F.min("turn").alias("turn"))
    starts = nodes.join(edges.select("conv_id", F.col("x").alias("call_id")).distinct(), KEYS, "left_anti")
    settled = [materialize(starts.select(*KEYS, F.col("turn").alias("place_turn"), F.lit(0).cast("bigint").alias("place_level")), "settled")]
    # what an edge adds to its call; known at once where y has no call
    state = edges.select("conv_id", "x", "y", "tx", "ty", (F.col("ny").isNull()).alias("known"), F.col("ty").alias("at"), F.when(F.col("ny").isNull(), 1).cast("bigint").alias("deep"))
    while True:
        new = settled[-1].select("conv_id", F.col("call_id").alias("y"), F.col("place_turn").alias("_t"), F.col("place_level").alias("_l"))
        state = state.join(new, ["conv_id", "y"], "left").select(
            "conv_id", "x", "y", "tx", "ty",
            (F.col("known") | F.col("_l").isNotNull()).alias("known"),
            F.greatest("at", "_t").alias("at"),
            F.coalesce(F.col("_l") + 2, "deep").alias("deep"),
        )
        state = materialize(state, "waiting")
        found = state.groupBy("conv_id", F.col("x").alias("call_id")).agg(F.bool_and("known").alias("all"), F.greatest(F.max("tx"), F.max("at")).alias("place_turn"), F.max("deep").alias("place_level"))
        found = materialize(found.where("all").select(*KEYS, "place_turn", "place_level"), "settled")
        if found.isEmpty():
            break
        settled.append(found)
        state = state.join(found.select("conv_id", F.col("call_id").alias("x")), ["conv_id", "x"], "left_anti")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionAll(more)
    left = state.select("conv_id", F.col("x").alias("call_id")).distinct()
    return out.unionAll(left.select(*KEYS, F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))


def _parsed(messages: DataFrame) -> DataFrame:
    """One row per message with its kind, identifier, tool, arguments (parsed and as JSON), content and a row number."""
    given = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    object_ = F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    given = given.withColumn("m", object_)
    given = given.withColumns({"id": _string(_member(F.col("m"), "id")), "tool": _string(_member(F.col("m"), "name")), "result_of": _string(_member(F.col("m"), "tool_call_id")), "arguments": _member(F.col("m"), "arguments"), "answer": _member(F.col("m"), "content")})
    is_call, is_result = F.col("id").isNotNull() & F.col("tool").isNotNull(), F.col("result_of").isNotNull()
    own = F.concat(F.lit("turn-"), F.col("turn").cast("string"))
    before = F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string"))
    text = F.coalesce(_json(F.col("text")), F.lit("null"))
    asked = F.concat(F.lit('{"text":'), text, F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    inner = F.coalesce(F.try_parse_json(_string(F.col("arguments"))), F.col("arguments"))
    marked = given.select(
        "conv_id", "turn", "role",
        F.when(is_call, "call").when(is_result, "result").when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("plain").alias("kind"),
        F.when(is_call, F.col("id")).when(is_result, F.col("result_of")).when(F.col("role") == "user", own).when(F.col("role") == "assistant", before).alias("call_id"),
        F.when(is_call, F.col("tool")).when(~is_result & (F.col("role") == "user"), F.lit("ask")).alias("name"),
        F.when(is_call, inner).alias("parsed"),
        F.when(~is_call & ~is_result & (F.col("role") == "user"), asked).alias("asked"),
        F.when(is_result, F.coalesce(F.to_json("answer"), F.lit("null"))).otherwise(text).alias("content"),
        F.length("text").alias("n"),
    )
    # plain chat fits the schema of `ask` by construction, if it has text and a turn and is asked so
    return marked.withColumn("arguments", F.coalesce(F.to_json("parsed"), "asked", F.lit("null")))


def link(messages: DataFrame, schemas: dict = SCHEMAS, most_edges: int = 200_000) -> DataFrame:
    """From `messages(conv_id, turn, role, text)`: `(conv_id, turn, role, kind, call_id, status, order_turn, order_level, valid, message)`."""
    marked = _parsed(messages)
    arguments = F.coalesce("parsed", F.try_parse_json("asked"))
    quote = lambda c: F.coalesce(_json(F.col(c)), F.lit("null"))
    body = (
        F.when(F.col("kind") == "call", F.concat(F.lit('{"arguments":'), "arguments", F.lit(',"id":'), quote("call_id"), F.lit(',"name":'), quote("name"), F.lit(',"role":'), quote("role"), F.lit("}")))
        .when(F.col("kind") == "result", F.concat(F.lit('{"content":'), "content", F.lit(',"role":'), quote("role"), F.lit(',"tool_call_id":'), quote("call_id"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"content":'), "content", F.lit(',"role":'), quote("role"), F.lit("}")))
    )
    found = F.regexp_extract_all("arguments", F.lit(r'\{"\$result":"((?:[^"\\]|\\.)*)"\}'), 1)
    refers = F.transform(found, lambda x: F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), x, F.lit('"'))), "$", "string"))
    rows = marked.select(
        "conv_id", "turn", "role", "kind", "call_id",
        F.when(F.col("kind") == "call", _valid(arguments, F.col("name"), schemas)).alias("valid"),
        F.when((F.col("kind") == "call") & F.col("arguments").contains('"$result"'), F.array_distinct(refers)).alias("refers"),
        body.alias("message"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows.withColumn("refers", F.when(F.size("refers") > 0, F.col("refers"))), "messages")
    turn = F.coalesce("turn", F.lit(_LAST))
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    ids = rows.where("kind != 'plain' and conv_id is not null and call_id is not null").groupBy(*KEYS).agg(
        F.min(F.when(call, F.struct(turn.alias("turn"), F.xxhash64("message").alias("h"), "row"))).alias("first"),
        F.count_if(result).alias("n_results"),
        F.max(F.when(result, turn)).alias("result_turn"),
    )
    ids = ids.select(*KEYS, F.col("first.row").alias("call_row"), F.col("first.turn").alias("call_turn"), "n_results", "result_turn")
    referring = rows.where("refers is not null and conv_id is not null")
    if referring.isEmpty():
        places = None
    else:
        ids = materialize(ids, "identifiers")
        wanted = referring.select("conv_id", "call_id", "row", turn.alias("tx"), F.explode("refers").alias("y"))
        met = wanted.join(ids.where("n_results > 0").select("conv_id", F.col("call_id").alias("y"), F.col("call_turn").alias("ny"), F.col("result_turn").alias("ty")), ["conv_id", "y"])
        met = materialize(met, "references")
        firsts = ids.select("conv_id", F.col("call_row").alias("row"))
        edges = met.join(firsts, ["conv_id", "row"], "left_semi").select("conv_id", F.col("call_id").alias("x"), "y", "tx", "ty", "ny")
        edges = materialize(edges, "edges")
        large = materialize(edges.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).select("conv_id"), "large")
        if large.isEmpty():
            places = _in_tasks(edges)
        else:
            places = _in_tasks(edges.join(large, "conv_id", "left_anti")).unionAll(_in_rounds(materialize(edges.join(large, "conv_id", "left_semi"), "edges")))
        places = materialize(places.withColumn("in_graph", F.lit(True)), "places")
        # repeated calls wait for what they refer to, as first calls do, but nothing waits for them
        again = met.join(firsts, ["conv_id", "row"], "left_anti").join(places.withColumnRenamed("call_id", "y"), ["conv_id", "y"], "left")
        stuck = F.col("in_graph") & F.col("place_level").isNull()
        level = F.when(F.col("ny").isNull(), 1).otherwise(F.coalesce("place_level", F.lit(0)) + 2)
        repeats = again.groupBy("row").agg(F.bool_or(F.coalesce(stuck, F.lit(False))).alias("again_stuck"), F.greatest(F.max("tx"), F.max("ty"), F.max(F.coalesce("place_turn", "ny"))).alias("again_turn"), F.max(level).alias("again_level"))
    linked = rows.drop("refers").join(ids, KEYS, "left")
    if places is None:
        stuck, call_place, call_level = F.lit(False), F.col("call_turn"), F.lit(0)
    else:
        linked = linked.join(places, KEYS, "left").join(repeats, "row", "left")
        stuck = F.coalesce(F.col("in_graph") & F.col("place_level").isNull(), F.lit(False))
        call_place, call_level = F.coalesce("place_turn", "call_turn"), F.coalesce("place_level", F.lit(0))
    repeated = call & F.col("call_row").isNotNull() & (F.col("call_row") != F.col("row"))
    at_turn, at_level, cyclic = F.col("turn"), F.lit(0), F.lit(False)
    if places is not None:
        at_turn = F.when(repeated, F.coalesce("again_turn", "turn")).when(call, F.coalesce("place_turn", "turn")).otherwise(at_turn)
        at_level = F.when(repeated, F.coalesce("again_level", F.lit(0))).when(call, call_level).otherwise(at_level)
        cyclic = F.when(repeated, F.coalesce("again_stuck", F.lit(False))).when(F.col("kind") == "plain", F.lit(False)).otherwise(stuck)
    at_turn = F.when(result & F.col("call_row").isNotNull(), F.greatest(turn, call_place)).otherwise(at_turn)
    at_level = F.when(result & F.col("call_row").isNotNull(), call_level + 1).otherwise(at_level)
    status = (
        F.when(F.col("kind") == "plain", "plain")
        .when(cyclic, "cyclic")
        .when(repeated, "repeated")
        .when(call, F.when(F.col("n_results") > 0, "linked").otherwise("open"))
        .otherwise(F.when(F.col("call_row").isNull(), "orphan").otherwise("linked"))
    )
    return linked.select(
        "conv_id", "turn", "role", "kind", "call_id", status.alias("status"),
        F.nullif(F.when(cyclic, F.col("turn")).otherwise(at_turn), F.lit(_LAST)).alias("order_turn"),
        F.when(cyclic, F.lit(0)).otherwise(at_level).cast("int").alias("order_level"),
        "valid", "message",
    )


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))


#: The same where messages are plain chat, as in the tables; tests hold calls and results against brute force.
ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, role, text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'plain' END AS kind,
    CASE role WHEN 'user' THEN 'turn-' || turn WHEN 'assistant' THEN 'turn-' || (turn - 1) END AS call_id
  FROM conversations
), calls AS (SELECT conv_id, call_id, count(*) AS n, min(turn) AS turn FROM m WHERE kind = 'call' GROUP BY ALL),
results AS (SELECT conv_id, call_id, count(*) AS n FROM m WHERE kind = 'result' GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, m.kind, m.call_id,
  CASE m.kind WHEN 'plain' THEN 'plain' WHEN 'call' THEN CASE WHEN r.n > 0 THEN 'linked' ELSE 'open' END
    ELSE CASE WHEN c.n > 0 THEN 'linked' ELSE 'orphan' END END AS status,
  CASE WHEN m.kind = 'result' THEN greatest(m.turn, coalesce(c.turn, m.turn)) ELSE m.turn END AS order_turn,
  CASE WHEN m.kind = 'result' AND c.n > 0 THEN 1 ELSE 0 END AS order_level,
  CASE WHEN m.kind = 'call' THEN coalesce(length(text) > 0, false) END AS valid,
  CASE m.kind
    WHEN 'call' THEN '{"arguments":{"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":' || m.turn || '},"id":"' || m.call_id || '","name":"ask","role":"user"}'
    WHEN 'result' THEN '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":"assistant","tool_call_id":"' || m.call_id || '"}'
    ELSE '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' END AS message
FROM m LEFT JOIN calls c ON m.conv_id = c.conv_id AND m.call_id = c.call_id
LEFT JOIN results r ON m.conv_id = r.conv_id AND m.call_id = r.call_id
"""
