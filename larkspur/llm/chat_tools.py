"""Tool calls in chats: linking with results, topological order, validation and canonical JSON.

Messages are rows (conv_id, turn, role, text). A message of role ``assistant`` whose text is a JSON object with ``tool_calls``, a list of objects with
``id``, ``name`` and ``arguments``, makes calls; one of role ``tool`` whose text is an object with ``tool_call_id`` and ``content`` is a result. The first call
and the first result of each identifier, found by partial aggregation, are hash-joined by conversation and identifier. An argument ``{"$ref": id}`` anywhere makes a call depend on another of its
conversation; calls are ordered so that each follows what it depends on, and otherwise by their places.

References are joined to the calls they name. Where all of a conversation point back, the order is that of the places, which are numbered by ranges:
a conversation of any length is spread over tasks. Only a conversation with a reference forward, to itself or to no call is ordered as a graph, by one task.

Defined results: messages with null or malformed text, or without calls, make none; calls and results without identifier are never linked; of
several calls with one identifier the first is linked, later ones are ``duplicate``; of several results the first counts and later ones are ``extra``;
a result without call is ``orphan``, a call without result ``unanswered``; calls in or behind a cycle, or that refer to no call, come last with an error; a null conversation
is one of its own; rows that repeat make calls each; other columns are ignored. Arguments that aren't JSON (NaN, infinities and numbers beyond doubles aren't) or are
nested deeper than ``DEEPEST`` have an error and the value null; of equal keys the last counts; lone surrogates are written as escapes; a schema
with a keyword or type that isn't known is a ValueError before anything runs.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, store

CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>>"
RESULT = "struct<tool_call_id: string, content: string>"
#: The tool of :func:`exchanges`.
REPLY = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "object", "required": ["$ref"]}},
        "additionalProperties": False,
    }
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": float, "integer": int}
#: Keywords of schemas that are checked, and those that only describe.
CHECKED = frozenset("type enum const properties required additionalProperties items minLength maxLength minItems maxItems minimum maximum exclusiveMinimum exclusiveMaximum pattern allOf anyOf oneOf not".split())
SAID = frozenset("title description default examples $schema $id $comment deprecated readOnly writeOnly format".split())
#: Arguments nested deeper have an error and the value null.
DEEPEST = 100


def check_schema(schema: Any, at: str = "$") -> None:
    """Raise ValueError at what :func:`violations` doesn't know."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema must be an object")
    if strange := sorted(schema.keys() - CHECKED - SAID):
        raise ValueError(f"{at}: keywords that aren't supported: {', '.join(strange)}")
    kinds = schema.get("type", [])
    if strange := [k for k in ([kinds] if isinstance(kinds, str) else kinds) if k not in _TYPES]:
        raise ValueError(f"{at}: no such type: {strange[0]}")
    if "pattern" in schema:
        re.compile(schema["pattern"])
    for k, x in schema.get("properties", {}).items():
        check_schema(x, f"{at}.{k}")
    for word in ("items", "not", "additionalProperties"):
        if word in schema and not (word == "additionalProperties" and isinstance(schema[word], bool)):
            check_schema(schema[word], f"{at}.{word}")
    for word in ("allOf", "anyOf", "oneOf"):
        for x in schema.get(word, []):
            check_schema(x, f"{at}.{word}")


def printable(text: str) -> str:
    """Lone surrogates, which UTF-8 can't hold, as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    """JSON with sorted keys, no space and characters as they are; whole numbers exactly, others by the fewest digits that read back."""
    return printable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def same(a: Any, b: Any) -> bool:
    """Equality of JSON values: true isn't 1, but 1.0 is."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(x, b[k]) for k, x in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema of the keywords in ``CHECKED``."""
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    out = []
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]) or "const" in schema and not same(value, schema["const"]):
        out.append(f"{at}: not an allowed value")
    for x in schema.get("allOf", []):
        out += violations(value, x, at)
    for word, many in (("anyOf", range(1, 1 << 30)), ("oneOf", range(1, 2)), ("not", range(1))):
        if word in schema and sum(not violations(value, x, at) for x in (schema[word] if word != "not" else [schema[word]])) not in many:
            out.append(f"{at}: breaks {word}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        rest = schema.get("additionalProperties", True)
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif rest is False:
                out.append(f"{at}.{k}: not expected")
            elif isinstance(rest, dict):
                out += violations(value[k], rest, f"{at}.{k}")
    size = len(value) if isinstance(value, (str, list)) else value if _is(value, "number") else None
    if size is not None:
        least, most = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems")}.get(type(value), ("minimum", "maximum"))
        if size < schema.get(least, size):
            out.append(f"{at}: below {least}")
        if size > schema.get(most, size):
            out.append(f"{at}: above {most}")
        if least == "minimum":
            if "exclusiveMinimum" in schema and size <= schema["exclusiveMinimum"]:
                out.append(f"{at}: below exclusiveMinimum")
            if "exclusiveMaximum" in schema and size >= schema["exclusiveMaximum"]:
                out.append(f"{at}: above exclusiveMaximum")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: breaks pattern")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{k}]")
    return out


def references(value: Any) -> set[str]:
    if isinstance(value, dict):
        if isinstance(ref := value.get("$ref"), str):
            return {ref}
        value = list(value.values())
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def topological(needs: list[set[int]]) -> list[int]:
    """Positions so that each follows those it needs, the least first where there is a choice; those on or behind cycles are left out."""
    users: list[list[int]] = [[] for _ in needs]
    open_ = [len(n) for n in needs]
    for k, n in enumerate(needs):
        for x in n:
            users[x].append(k)
    heap = [k for k, n in enumerate(open_) if not n]
    out = []
    while heap:
        out.append(k := heapq.heappop(heap))
        for u in users[k]:
            open_[u] -= 1
            if not open_[u]:
                heapq.heappush(heap, u)
    return out


def _constant(text: str) -> float:
    raise ValueError(text)


def _real(text: str) -> float:
    return x if math.isfinite(x := float(text)) else _constant(text)


def _deep(value: Any) -> bool:
    level = [value]
    for _ in range(DEEPEST):
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return False
    return True


def _parse(text: str | None) -> tuple[Any, list[str]]:
    try:
        value = json.loads(text if text is not None else "null", parse_constant=_constant, parse_float=_real)
    except ValueError:
        return None, ["$: not JSON"]
    except RecursionError:
        return None, ["$: nested too deep"]
    return (None, ["$: nested too deep"]) if _deep(value) else (value, [])


def order_calls(rows: list[dict], schemas: dict[str, dict]) -> list[dict]:
    """The calls of one conversation, in order, with canonical arguments and errors."""
    rows = sorted(rows, key=lambda r: (r["turn"] is None, r["turn"] or 0, r["place"], r["call_id"] or "", r["arguments"] or "", r["name"] or ""))
    owner: dict[str, int] = {}
    for k, r in enumerate(rows):
        if r["status"] in ("linked", "unanswered") and r["call_id"] is not None:
            owner.setdefault(r["call_id"], k)
    parsed = [_parse(r["arguments"]) if r["status"] not in ("orphan", "extra") else (None, []) for r in rows]
    wanted = [references(v) for v, _ in parsed]
    missing = [sorted(x for x in w if x not in owner) for w in wanted]
    needs = [{owner[x] for x in w if x in owner} for w in wanted]
    sound = topological([n | ({k} if m else set()) for k, (n, m) in enumerate(zip(needs, missing, strict=True))])
    placed = set(sound)
    out = []
    for position, k in enumerate([*sound, *(k for k in range(len(rows)) if k not in placed)]):
        r, (value, errors) = rows[k], parsed[k]
        errors = list(errors)
        if r["status"] not in ("orphan", "extra"):
            if not errors:
                errors = violations(value, schemas[r["name"]]) if r["name"] in schemas else ["$: no such tool"]
            errors += [f"{x}: refers to no call" for x in missing[k]]
            if k not in placed and not missing[k]:
                errors.append("depends on itself or on an unplaced call")
        record = {"arguments": value, "id": r["call_id"], "name": r["name"], "result": r["result"]}
        out.append({"position": position, "call_id": r["call_id"], "name": r["name"], "status": r["status"], "valid": not errors and r["status"] not in ("orphan", "extra"), "errors": [printable(e) for e in errors], "json": canonical(record)})
    return out


def read_call(row: dict, schemas: dict[str, dict]) -> dict:
    """The errors of one row by itself, what it refers to and its canonical JSON."""
    aside = row["status"] in ("orphan", "extra")
    value, errors = (None, []) if aside else _parse(row["arguments"])
    if not aside and not errors:
        errors = violations(value, schemas[row["name"]]) if row["name"] in schemas else ["$: no such tool"]
    record = {"arguments": value, "id": row["call_id"], "name": row["name"], "result": row["result"]}
    return {"errors": [printable(e) for e in errors], "refs": sorted(map(printable, references(value))), "json": canonical(record)}


def _linked(messages: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, list[str]]:
    """Calls with their results, and results without: (conv_id, turn, place, call_id, name, arguments, result, status)."""
    slim = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    made = slim.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.from_json("text", CALLS)["tool_calls"]).alias("place", "c")).where("c is not null")
    calls = made.select("conv_id", "turn", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    given = slim.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", RESULT).alias("r")).where("r.tool_call_id is not null or r.content is not null")
    results = given.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("result"))
    calls, p1 = store(calls.withColumn("uid", F.monotonically_increasing_id()))
    results, p2 = store(results.withColumn("r_uid", F.monotonically_increasing_id()))
    by = [F.col("turn").isNull(), "turn"]
    first_calls = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min_by("uid", F.struct(*by, "place", "arguments", "name")).alias("uid"))
    first_results = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min_by("r_uid", F.struct(*by, "result")).alias("r_uid"))
    c, r = first_calls.alias("c"), first_results.hint("shuffle_hash").alias("r")
    same = F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("c.call_id") == F.col("r.call_id"))
    pairs, p3 = store(c.join(r, same, "full").select("uid", "r_uid"))
    answers = pairs.where("uid is not null").join(results.select("r_uid", "result"), "r_uid", "left").select("uid", F.lit(True).alias("first"), "r_uid", "result")
    status = F.when(F.col("call_id").isNull(), "unanswered").when(F.col("first").isNull(), "duplicate").when(F.col("r_uid").isNull(), "unanswered").otherwise("linked")
    columns = ["conv_id", "turn", "place", "call_id", "name", "arguments", "result"]
    some = calls.join(answers, "uid", "left").select(*columns, status.alias("status"))
    none = F.lit(None).cast("string")
    alone = results.join(pairs.where("r_uid is not null").select("r_uid", F.col("uid").isNotNull().alias("answers")), "r_uid", "left").where("not coalesce(answers, false)")
    status = F.when(F.col("call_id").isNotNull() & F.col("answers").isNull(), "extra").otherwise("orphan")
    rest = alone.select("conv_id", "turn", F.lit(1 << 30).alias("place"), "call_id", none.alias("name"), none.alias("arguments"), "result", status.alias("status"))
    return some.union(rest), [p1, p2, p3]


def link(messages: DataFrame, schemas: dict[str, dict], conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, call_id, name, status, valid, errors, json) of each call, and of each result that isn't linked."""
    for name, schema in schemas.items():
        check_schema(schema, name)

    @F.arrow_udf("struct<errors: array<string>, refs: array<string>, json: string>")
    def read(column: pa.Array) -> pa.Array:
        kind = pa.struct([("errors", pa.list_(pa.string())), ("refs", pa.list_(pa.string())), ("json", pa.string())])
        return pa.array([read_call(x, schemas) for x in column.to_pylist()], kind)

    rows, paths = _linked(messages, conv_id, turn, role, text)
    fields = ["turn", "place", "call_id", "name", "arguments", "result", "status"]
    seen = rows.withColumn("seen", read(F.struct("call_id", "name", "arguments", "result", "status")))
    key = [F.col("turn").isNull(), F.coalesce("turn", F.lit(0)), F.col("place"), F.coalesce("call_id", F.lit(""))]
    rows, _ = store(seen.withColumn("key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])))
    discard(rows.sparkSession, *paths)

    owners = rows.where("call_id is not null and status in ('linked', 'unanswered')").select(F.col("conv_id").alias("o_conv"), F.col("call_id").alias("o_id"), F.col("key").alias("o_key"))
    wanted = rows.select("conv_id", "key", F.explode("seen.refs").alias("ref"))
    back = F.coalesce(F.col("o_key") < F.col("key"), F.lit(False))  # rows that are equal so far are left to the graph
    graphs, _ = store(wanted.join(owners, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("ref") == F.col("o_id")), "left").where(~back).select(F.col("conv_id").alias("g_conv")).distinct())
    inside = F.col("conv_id").eqNullSafe(F.col("g_conv"))

    # numbered by ranges: within a range of conversations and places, after what earlier ranges have of the conversation
    plain = rows.select("conv_id", "key", "call_id", "name", "status", "arguments", "seen.errors", "seen.json").join(graphs, inside, "left_anti")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged, _ = store(plain.repartitionByRange(n, "conv_id", "key.k0", "key.k1", "key.k2").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv_id").alias("s_conv"), F.col("part").alias("s_part"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")).where("offset > 0")
    local = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("key", F.coalesce("arguments", F.lit("")), F.coalesce("name", F.lit("")))) - 1
    placed = ranged.withColumn("local", local).join(offsets, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("part") == F.col("s_part")), "left")
    valid = (F.size("errors") == 0) & ~F.col("status").isin("orphan", "extra")
    placed = placed.select("conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).cast("int").alias("position"), "call_id", "name", "status", valid.alias("valid"), "errors", "json")

    @F.arrow_udf("array<struct<position: int, call_id: string, name: string, status: string, valid: boolean, errors: array<string>, json: string>>")
    def ordered(column: pa.Array) -> pa.Array:
        kind = pa.struct([("position", pa.int32()), ("call_id", pa.string()), ("name", pa.string()), ("status", pa.string()), ("valid", pa.bool_()), ("errors", pa.list_(pa.string())), ("json", pa.string())])
        return pa.array([order_calls(x, schemas) for x in column.to_pylist()], pa.list_(kind))

    grouped = rows.join(graphs, inside, "left_semi").groupBy("conv_id").agg(F.collect_list(F.struct(*fields)).alias("xs"))
    return placed.union(grouped.select("conv_id", F.inline(ordered("xs"))))


def exchanges(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages with calls: each user turn calls ``reply``, referring to the call before it, and the assistant turn that follows gives its result."""
    every = Window.partitionBy("conv_id").orderBy("turn")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    ident = F.concat(F.lit("c"), F.col("conv_id"), F.lit("t"), F.col("turn"))
    asked = F.when(F.col("role") == "user", ident)
    seen = conversations.select("conv_id", "turn", "role", "text", ident.alias("ident"), F.last(asked, ignorenulls=True).over(before).alias("last"))
    after = F.when(F.col("last").isNotNull(), F.struct(F.col("last").alias("$ref")))
    arguments = F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn"), after.alias("after"))
    call = F.to_json(F.struct(F.array(F.struct(F.col("ident").alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.col("last").alias("tool_call_id"), F.col("text").alias("content")))
    return seen.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"),
    )


#: The rows of link(exchanges(conversations), REPLY).
ORACLE = """
WITH seen AS (
    SELECT conv_id, turn, role, text, 'c' || conv_id || 't' || turn AS ident,
        last_value(CASE WHEN role = 'user' THEN 'c' || conv_id || 't' || turn END IGNORE NULLS)
            OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
    FROM conversations WHERE role IN ('user', 'assistant', 'system')
), answers AS (
    SELECT conv_id, turn, text, last, row_number() OVER (PARTITION BY conv_id, last ORDER BY turn) AS nth FROM seen WHERE role = 'assistant'
), calls AS (
    SELECT s.conv_id, s.turn, 0 AS place, s.ident AS call_id, 'reply' AS name, CASE WHEN a.last IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
        length(s.text) BETWEEN 1 AND 300 AS valid,
        CASE WHEN length(s.text) < 1 THEN ['$.prompt: below minLength'] WHEN length(s.text) > 300 THEN ['$.prompt: above maxLength'] ELSE [] END AS errors,
        '{"arguments":{' || CASE WHEN s.last IS NULL THEN '' ELSE '"after":{"$ref":' || to_json(s.last) || '},' END || '"prompt":' || to_json(s.text) || ',"turn":' || s.turn || '},"id":'
            || to_json(s.ident) || ',"name":"reply","result":' || coalesce(to_json(a.text), 'null') || '}' AS json
    FROM seen s LEFT JOIN answers a ON a.conv_id = s.conv_id AND a.last = s.ident AND a.nth = 1
    WHERE s.role = 'user'
    UNION ALL
    SELECT conv_id, turn, 1, last, NULL, CASE WHEN last IS NULL THEN 'orphan' ELSE 'extra' END, false, [],
        '{"arguments":null,"id":' || coalesce(to_json(last), 'null') || ',"name":null,"result":' || to_json(text) || '}'
    FROM answers WHERE last IS NULL OR nth > 1
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) - 1 AS INTEGER) AS position, call_id, name, status, valid, errors, json FROM calls
"""
