"""Chat formatting with linked tool calls.

Calls and results are hash-joined by conversation and call id.  Messages are put
into a topological order: a result comes after its call, and a call after the
results that its arguments refer to (``{"$result": "<call id>"}`` anywhere in
them).  Arguments are validated against the tool's JSON schema, and each message
is written as canonical JSON (sorted keys, no blanks, no escapes beyond the
necessary ones, written by one writer).

The order: a message's key starts as its turn and is raised to the key of
whatever it must follow; equal keys are told apart by the number of steps.  Only
messages that stand too early change, in rounds of joins, so conversations in
which turns already agree need a single look, and a conversation of any length
is never gathered in one place.  Messages are ordered by (key, step, turn, id);
each row carries its place's sort columns.

Defined cases: ``status`` is ``linked``, ``unanswered`` (a call without result),
``orphan`` (a result without call), ``repeated`` (a further result or call of an
id; the one of the smallest turn, then text, counts) or ``message``.  Calls
without a known tool, or with arguments that are no JSON object, are invalid
with a reason.  Messages on a cycle of references, and those that follow one so
closely that their step passes the conversation's size too, keep their turn and are
marked ``cyclic``.  Arguments that are no JSON, nested too deeply to read or hold half a
surrogate pair stay text; a tool's schema that cannot be read is a reason, not a
failure.  Null texts are empty; null conversation, turn or id compare as
equal nulls when sorted and never link.  Repeated rows stay, as repeated.  An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.operators.ranking import materialize

COLUMNS = ["conv_id", "turn", "role", "text", "call_id", "tool", "arguments"]
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and integral numbers as integers."""
    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2 ** 53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, KINDS.get(kind, object))


#: Keywords that say nothing about validity here.
NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "$anchor", "title", "description", "default", "examples", "deprecated",
         "readOnly", "writeOnly", "format", "contentEncoding", "contentMediaType"}
KNOWN = NOTES | {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength",
                 "pattern", "minItems", "maxItems", "uniqueItems", "items", "prefixItems", "contains", "required", "properties",
                 "patternProperties", "additionalProperties", "propertyNames", "minProperties", "maxProperties", "dependentRequired",
                 "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref"}


def same(a, b) -> bool:
    """Equality of JSON values: 1 and 1.0 are equal, 1 and true are not."""
    return canonical(a) == canonical(b)


def resolve(pointer: str, root):
    """The part of a schema that a local ``$ref`` names."""
    at = root
    for part in pointer.removeprefix("#").split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        at = at[int(part)] if isinstance(at, list) else at[part]
    return at


def problem(value, schema, at: str = "$", root=None) -> str | None:
    """The first way in which ``value`` breaks a JSON schema; a reference to a result fits any schema.

    Keywords beyond ``KNOWN``, references to other documents and patterns that do not
    compile are reported as unsupported, never passed over.
    """
    root = schema if root is None else root
    if schema is True:
        return None
    if schema is False:
        return f"{at}: nothing is allowed"
    if not isinstance(schema, dict):
        return f"{at}: unsupported schema"
    if isinstance(value, dict) and set(value) == {"$result"}:
        return None
    if strange := sorted(set(schema) - KNOWN):
        return f"{at}: unsupported keyword {strange[0]}"
    fits = lambda s: problem(value, s, at, root) is None
    if "$ref" in schema:
        if not str(schema["$ref"]).startswith("#"):
            return f"{at}: unsupported reference"
        if found := problem(value, resolve(schema["$ref"], root), at, root):
            return found
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not of type {kinds}"
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]) or "const" in schema and not same(value, schema["const"]):
        return f"{at}: not one of the allowed values"
    return (_number(value, schema, at) or _string(value, schema, at) or _object(value, schema, at, root)
            or _array(value, schema, at, root) or _combined(schema, at, fits))


def _number(value, schema, at):
    if not isinstance(value, (int, float)) or isinstance(value, bool):
        return None
    if value < schema.get("minimum", value) or value > schema.get("maximum", value):
        return f"{at}: out of range"
    if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"] or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
        return f"{at}: out of range"
    if "multipleOf" in schema and Fraction(repr(value)) % Fraction(repr(schema["multipleOf"])):
        return f"{at}: not a multiple"
    return None


def _string(value, schema, at):
    if not isinstance(value, str):
        return None
    if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{at}: out of length"
    if "pattern" in schema:
        try:
            if not re.search(schema["pattern"], value):
                return f"{at}: not of the pattern"
        except re.error:
            return f"{at}: unsupported pattern"
    return None


def _object(value, schema, at, root):
    if not isinstance(value, dict):
        return None
    known, patterns, rest = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
    if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
        return f"{at}: out of size"
    for k in sorted(schema.get("required", [])):
        if k not in value:
            return f"{at}.{k}: missing"
    for k in sorted(schema.get("dependentRequired", {})):
        if k in value and (lacking := sorted(set(schema["dependentRequired"][k]) - set(value))):
            return f"{at}.{lacking[0]}: missing"
    for k in sorted(value):
        if "propertyNames" in schema and (found := problem(k, schema["propertyNames"], f"{at}.{k}", root)):
            return found
        try:
            own = [known[x] for x in (k,) if x in known] + [patterns[p] for p in sorted(patterns) if re.search(p, k)]
        except re.error:
            return f"{at}: unsupported pattern"
        if not own and rest is False:
            return f"{at}.{k}: unknown"
        for one in own or [rest]:
            if found := problem(value[k], one, f"{at}.{k}", root):
                return found
    return None


def _array(value, schema, at, root):
    if not isinstance(value, list):
        return None
    if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
        return f"{at}: out of size"
    if schema.get("uniqueItems") and len({canonical(v) for v in value}) < len(value):
        return f"{at}: items repeat"
    first = schema.get("prefixItems", [])
    rest = schema.get("items", True)
    for i, v in enumerate(value):
        if found := problem(v, first[i] if i < len(first) else rest, f"{at}[{i}]", root):
            return found
    if "contains" in schema and not any(problem(v, schema["contains"], at, root) is None for v in value):
        return f"{at}: lacks an item"
    return None


def _combined(schema, at, fits):
    if not all(map(fits, schema.get("allOf", []))):
        return f"{at}: not all of the schemas fit"
    if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        return f"{at}: none of the schemas fits"
    if "oneOf" in schema and sum(map(fits, schema["oneOf"])) != 1:
        return f"{at}: not one of the schemas fits"
    if "not" in schema and fits(schema["not"]):
        return f"{at}: fits what is excluded"
    if "if" in schema and not fits(schema.get("then" if fits(schema["if"]) else "else", True)):
        return f"{at}: the condition's schema does not fit"
    return None


def references(value) -> set[str]:
    """Ids of the results that arguments refer to."""
    if isinstance(value, dict):
        if set(value) == {"$result"}:
            return {str(value["$result"])}
        value = list(value.values())
    return set().union(*map(references, value)) if isinstance(value, list) else set()


#: Reasons for which arguments stay the text that they are.
UNREADABLE = ("arguments are not JSON", "arguments are nested too deeply", "arguments hold half a character")


def read_arguments(arguments: str | None, tool_schema: str | None, cache: dict) -> tuple[str, str | None, list[str]]:
    """(canonical arguments, reason if invalid, ids of the results that they refer to)."""
    try:
        value = json.loads(arguments) if arguments else {}
        text = canonical(value)
        text.encode()
        refs = sorted(references(value))
    except UnicodeEncodeError:
        return arguments, UNREADABLE[2], []
    except ValueError:
        return arguments, UNREADABLE[0], []
    except RecursionError:
        return arguments, UNREADABLE[1], []
    if not isinstance(value, dict):
        return text, "arguments are not an object", []
    if tool_schema is None:
        return text, "unknown tool", refs
    if tool_schema not in cache:
        try:
            cache[tool_schema] = json.loads(tool_schema)
        except (ValueError, RecursionError):
            cache[tool_schema] = None
    if cache[tool_schema] is None:
        return text, "the tool's schema is not JSON", refs
    try:
        return text, problem(value, cache[tool_schema]), refs
    except RecursionError:
        return text, "the tool's schema does not end", refs
    except (LookupError, TypeError, ValueError, AttributeError):
        return text, "the tool's schema is no JSON schema", refs


def message_json(kind: str, role: str | None, text: str, call_id: str | None, tool: str | None, args: str | None, invalid: str | None) -> str:
    """Canonical JSON of a message: sorted names, one escaping rule for all its strings."""
    quote = lambda x: json.dumps(x, ensure_ascii=False)
    head = f'{{"content":{quote(text)},"role":{quote(role)}'
    if kind == "call":
        args = quote(args) if invalid in UNREADABLE else args
        return f'{head},"tool_calls":[{{"arguments":{args},"id":{quote(call_id)},"name":{quote(tool)}}}]}}'
    return head + (f',"tool_call_id":{quote(call_id)}}}' if kind == "result" else "}")


def examine(calls: DataFrame) -> DataFrame:
    """Add canonical ``args``, ``invalid`` (reason or null), ``refs`` and ``json`` to messages with their tool's ``schema``."""
    names = calls.columns
    extra = ["args", "invalid", "refs", "json"]
    kinds = [T.StringType(), T.StringType(), T.ArrayType(T.StringType()), T.StringType()]
    schema = T.StructType([*calls.schema.fields, *map(T.StructField, extra, kinds)])

    def run(batches):
        import pyarrow as pa
        cache: dict = {}
        types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        for whole in batches:
            for a in range(0, whole.num_rows, 256):     # so many messages at a time as Python strings
                batch = whole.slice(a, 256)
                rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "text", "call_id", "tool", "arguments", "schema")))
                found = []
                for kind, role, text, call_id, tool, arguments, tool_schema in rows:
                    args, invalid, refs = read_arguments(arguments, tool_schema, cache)
                    found.append((args, invalid, refs, message_json(kind, role, text, call_id, tool, args, invalid)))
                cols = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cols, types)], [*names, *extra])

    return calls.mapInArrow(run, schema)


def order_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, key, step, cyclic): nodes (node, turn, size), edges (before, after) must give before < after.

    ``size`` is the number of messages of the node's conversation, which no path
    without a cycle exceeds.
    """
    now = materialize(nodes.select("node", "size", "turn", F.col("turn").alias("key"), F.lit(0).alias("step"),
                                   F.lit(False).alias("cyclic")), "order")
    while True:
        before = now.select(F.col("node").alias("before"), F.col("key").alias("bk"), F.col("step").alias("bs"), F.col("cyclic").alias("bc"))
        late = (edges.join(before.filter(~F.col("bc")), "before").join(now.filter(~F.col("cyclic")), F.col("after") == F.col("node"))
                .filter((F.col("bk") > F.col("key")) | ((F.col("bk") == F.col("key")) & (F.col("bs") >= F.col("step"))))
                .groupBy("after").agg(F.max(F.struct("bk", "bs")).alias("past")))
        late = materialize(late, "late")
        if late.isEmpty():
            place = lambda c, own: F.when(F.col("cyclic"), own).otherwise(F.col(c)).alias(c)
            return now.select("node", place("key", F.col("turn")), place("step", F.lit(0)), "cyclic")
        joined = now.join(late, F.col("node") == F.col("after"), "left")
        step = F.coalesce(F.col("past.bs") + 1, F.col("step"))
        now = materialize(joined.select("node", "size", "turn", F.coalesce("past.bk", "key").alias("key"), step.alias("step"),
                                        (F.col("cyclic") | (step > F.col("size"))).alias("cyclic")), "order")


def link(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """Link, order, validate and serialise.

    ``messages``: conv_id, turn, role, text, call_id, tool, arguments; a row with
    ``tool`` is a call, another row with ``call_id`` is a result.  ``tools``:
    tool, schema (one row per tool).  Returns one row per message: conv_id, turn,
    role, kind, call_id, status, invalid, key, step, cyclic, json.
    """
    rows = messages.select(*COLUMNS).withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "kind", F.when(F.col("tool").isNotNull(), "call").when(F.col("call_id").isNotNull(), "result").otherwise("message"))
    known = rows.join(tools.select("tool", "schema"), "tool", "left")
    seen = examine(known.select(*COLUMNS, "kind", "schema").withColumn("node", F.xxhash64(*COLUMNS, F.lit(0))))
    # equal rows get numbers, so that every row has a node of its own
    same = Window.partitionBy("node").orderBy("turn")
    seen = materialize(seen.withColumn("node", F.xxhash64("node", F.row_number().over(same))), "messages")

    linked = seen.filter(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    first = linked.groupBy("conv_id", "call_id").agg(
        *[F.min(F.when(F.col("kind") == k, F.struct("turn", "text", "args", "node"))).getField("node").alias(k) for k in ("call", "result")])
    first = materialize(first, "first-links")
    pairs = first.filter(F.col("call").isNotNull() & F.col("result").isNotNull())
    needs = (seen.filter((F.col("kind") == "call") & (F.size("refs") > 0))
             .select("conv_id", F.col("node").alias("after"), F.explode("refs").alias("call_id"))
             .join(pairs, ["conv_id", "call_id"]).select(F.col("result").alias("before"), "after"))
    edges = materialize(pairs.select(F.col("call").alias("before"), F.col("result").alias("after")).unionByName(needs), "edges")
    sizes = seen.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    nodes = seen.join(sizes, seen["conv_id"].eqNullSafe(sizes["conv_id"])).select("node", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), "size")
    keys = order_keys(nodes, edges)

    out = (seen.join(keys, "node")
           .join(first.withColumnsRenamed({"conv_id": "fc", "call_id": "fi"}),
                 (F.col("conv_id") == F.col("fc")) & (F.col("call_id") == F.col("fi")), "left"))
    own = F.when(F.col("kind") == "call", F.col("call")).otherwise(F.col("result"))
    other = F.when(F.col("kind") == "call", F.col("result")).otherwise(F.col("call"))
    status = (F.when(F.col("kind") == "message", "message").when(own != F.col("node"), "repeated")
              .when(other.isNull() | own.isNull(), F.when(F.col("kind") == "call", "unanswered").otherwise("orphan")).otherwise("linked"))
    return out.select("conv_id", "turn", "role", "kind", "call_id", status.alias("status"),
                      F.when(F.col("kind") == "call", F.col("invalid")).alias("invalid"), "key", "step", "cyclic", "json")
