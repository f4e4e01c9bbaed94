"""Chat formatting: tool calls linked to their results, as canonical JSON.

Calls and results are rows with an identifier.  A hash join links them within a conversation: the n-th call of an
identifier with the n-th result of it.  The calls of a conversation are put in topological order of the calls they
name in ``after`` (ties and calls on a cycle go by ``seq``), their arguments are validated against the JSON schema of
their tool, and everything is written as canonical JSON by RFC 8785: keys in the order of their UTF-16 code units, no
blanks, numbers as ECMAScript writes the nearest double, no escapes that JSON doesn't ask for.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: JSON schemas of the arguments of the tools that a plain dialogue is told with, see :func:`from_messages`.
SCHEMAS = {
    "reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "set_context": {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}}},
}
#: Tools whose calls have no result.
SILENT = frozenset({"set_context"})
#: Markup of calls and results within a message: JSON objects with id, name, arguments, after, and id, content.
CALL, RESULT = r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)<tool_result>(.*?)</tool_result>"

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Keywords of a schema that say nothing of a value.
_NOTES = frozenset("title description default examples deprecated readOnly writeOnly $schema $id $comment $defs definitions".split())
_FORMATS = {
    "date": r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])", "time": r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+\-]\d\d:\d\d)?",
    "email": r"[^@\s]+@[^@\s]+", "uuid": r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "uri": r"[A-Za-z][A-Za-z0-9+.\-]*:\S*",
    "ipv4": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)",
}
_FORMATS["date-time"] = rf"{_FORMATS['date']}[Tt]{_FORMATS['time']}"


class BadSchema(ValueError):
    """A schema with a keyword, type, format or reference that isn't known, so that nothing is called valid unread."""


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return _number(value) and (isinstance(value, int) or kind == "number" or value.is_integer())
    return isinstance(value, _TYPES[kind])


def same(a: object, b: object) -> bool:
    """Equality of JSON values: 1 and 1.0 are equal, 1 and true aren't."""
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same, a, b))
    return a == b and _number(a) == _number(b) and isinstance(a, bool) == isinstance(b, bool)


def _target(ref: str, root: object) -> object:
    if not ref.startswith("#"):
        raise BadSchema(f"a reference out of the schema: {ref!r}")
    for step in ref[1:].split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(root, list) and step.isdigit() and int(step) < len(root):
            root = root[int(step)]
        elif isinstance(root, dict) and step in root:
            root = root[step]
        else:
            raise BadSchema(f"a reference to nothing: {ref!r}")
    return root


def _multiple(value: float, of: float) -> bool:
    return (Decimal(repr(value)) % Decimal(repr(of))) == 0


#: For keywords of one kind of value: the test that fails.
_BOUNDS = {
    "minimum": lambda v, m: v < m, "maximum": lambda v, m: v > m, "exclusiveMinimum": lambda v, m: v <= m, "exclusiveMaximum": lambda v, m: v >= m, "multipleOf": lambda v, m: not _multiple(v, m),
    "minLength": lambda v, m: len(v) < m, "maxLength": lambda v, m: len(v) > m, "pattern": lambda v, m: not re.search(m, v), "format": lambda v, m: not re.fullmatch(_FORMATS[m], v),
    "minItems": lambda v, m: len(v) < m, "maxItems": lambda v, m: len(v) > m, "uniqueItems": lambda v, m: m and len({canonical(x) for x in v}) < len(v),
    "minProperties": lambda v, m: len(v) < m, "maxProperties": lambda v, m: len(v) > m,
}
_OF_NUMBER, _OF_TEXT, _OF_LIST, _OF_OBJECT = (tuple(list(_BOUNDS)[a:b]) for a, b in ((0, 5), (5, 9), (9, 12), (12, 14)))
#: Keywords that hold a schema, a list of schemas, and schemas by name.
_ONE, _MANY, _NAMED = ("not", "items", "contains", "additionalProperties", "propertyNames", "if", "then", "else"), ("anyOf", "allOf", "oneOf", "prefixItems"), ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")
_KNOWN = _NOTES | {*_BOUNDS, *_ONE, *_MANY, *_NAMED, "type", "enum", "const", "required", "dependentRequired", "$ref", "minContains", "maxContains"}


def check_schema(schema: object, root: object = None, path: str = "#") -> None:
    """Raise :class:`BadSchema` for what :func:`violations` doesn't know."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise BadSchema(f"{path}: no schema")
    if unknown := sorted(set(schema) - _KNOWN):
        raise BadSchema(f"{path}: unknown keyword {unknown[0]!r}")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in (*_TYPES, "integer", "number"):
            raise BadSchema(f"{path}: unknown type {kind!r}")
    if "format" in schema and schema["format"] not in _FORMATS:
        raise BadSchema(f"{path}: unknown format {schema['format']!r}")
    if "$ref" in schema:
        _target(schema["$ref"], root)
    for k in _ONE:
        if k in schema:
            check_schema(schema[k], root, f"{path}/{k}")
    for k in (*_MANY, *_NAMED):
        for name, part in enumerate(schema[k]) if isinstance(schema.get(k), list) else schema.get(k, {}).items():
            check_schema(part, root, f"{path}/{k}/{name}")


def violations(value: object, schema: dict | bool, path: str = "$", root: object = None) -> list[str]:
    """What of ``value`` breaks ``schema``, each as place and keyword.  Schemas are checked first (:func:`check_schema`)."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: false"]
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}: type"]
    ok = lambda part, v=value: not violations(v, part, path, root)
    out = []
    if "$ref" in schema:
        out += violations(value, _target(schema["$ref"], root), path, root)
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        out.append(f"{path}: enum")
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{path}: const")
    for part in schema.get("allOf", ()):
        out += violations(value, part, path, root)
    if "anyOf" in schema and not any(map(ok, schema["anyOf"])):
        out.append(f"{path}: anyOf")
    if "oneOf" in schema and sum(map(ok, schema["oneOf"])) != 1:
        out.append(f"{path}: oneOf")
    if "not" in schema and ok(schema["not"]):
        out.append(f"{path}: not")
    if "if" in schema and (branch := "then" if ok(schema["if"]) else "else") in schema:
        out += violations(value, schema[branch], path, root)
    bounds = _OF_NUMBER if _number(value) else _OF_TEXT if isinstance(value, str) else _OF_LIST if isinstance(value, list) else _OF_OBJECT if isinstance(value, dict) else ()
    out += [f"{path}: {k}" for k in bounds if k in schema and _BOUNDS[k](value, schema[k])]
    if isinstance(value, list):
        first = schema.get("prefixItems", ())
        for i, x in enumerate(value):
            if i < len(first):
                out += violations(x, first[i], f"{path}[{i}]", root)
            elif "items" in schema:
                out += violations(x, schema["items"], f"{path}[{i}]", root)
        if "contains" in schema:
            n = sum(ok(schema["contains"], x) for x in value)
            if not schema.get("minContains", 1) <= n <= schema.get("maxContains", n):
                out.append(f"{path}: contains")
    if isinstance(value, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        out += [f"{path}.{k}: required" for k in schema.get("required", ()) if k not in value]
        out += [f"{path}.{k}: required" for of, names in schema.get("dependentRequired", {}).items() if of in value for k in names if k not in value]
        for of, part in schema.get("dependentSchemas", {}).items():
            out += violations(value, part, path, root) if of in value else []
        for k in sorted(value):
            if "propertyNames" in schema and not ok(schema["propertyNames"], k):
                out.append(f"{path}.{k}: propertyNames")
            matching = [part for pattern, part in patterns.items() if re.search(pattern, k)]
            for part in [*([known[k]] if k in known else []), *matching]:
                out += violations(value[k], part, f"{path}.{k}", root)
            if k not in known and not matching and "additionalProperties" in schema:
                rest = schema["additionalProperties"]
                out += [f"{path}.{k}: additional"] if rest is False else violations(value[k], rest, f"{path}.{k}", root)
    return out


def number(value: float) -> str:
    """A number as ECMAScript writes it; integers are doubles like all numbers of JSON."""
    if isinstance(value, int):
        if abs(value) <= 1 << 53:
            return str(value)
        value = float(value)  # an OverflowError beyond all doubles
    if not math.isfinite(value):
        raise ValueError("no number of JSON")
    if not value:
        return "0"
    sign, figures, exponent = Decimal(repr(value)).normalize().as_tuple()
    d, point = "".join(map(str, figures)), len(figures) + exponent
    if len(d) <= point <= 21:
        d += "0" * (point - len(d))
    elif 0 < point <= 21:
        d = f"{d[:point]}.{d[point:]}"
    elif -6 < point <= 0:
        d = f"0.{'0' * -point}{d}"
    else:
        d = f"{d[0]}{'.' * (len(d) > 1)}{d[1:]}e{point - 1:+d}"
    return "-" * sign + d


def canonical(value: object) -> str:
    """Canonical JSON by RFC 8785.  A lone surrogate is a ValueError, as are NaN and infinities."""
    if isinstance(value, str):
        value.encode()
        return json.dumps(value, ensure_ascii=False)
    if value is None or isinstance(value, bool):
        return "null" if value is None else "true" if value else "false"
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda r: r[0].encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return number(value)


def _refuse(word: str) -> None:
    raise ValueError(word)


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key twice")
    return out


def _load(text: str | None) -> object:
    return json.loads(text, parse_constant=_refuse, object_pairs_hook=_object) if text is not None else None


def order(ids: list[str | None], after: list[list[str]], seq: list[tuple]) -> tuple[list[int], set[int]]:
    """Topological order of calls by position in the lists, and those on or behind a cycle, which come last by ``seq``.

    ``after`` names the calls a call depends on; names of no call, and its own, don't count.  Of ready calls the least
    ``seq`` goes first.  A name shared by several calls stands for all of them.
    """
    by_id = defaultdict(list)
    for i, name in enumerate(ids):
        by_id[name].append(i)
    waits = [{j for name in names for j in by_id.get(name, ()) if j != i} for i, names in enumerate(after)]
    wanted = defaultdict(list)
    for i, w in enumerate(waits):
        for j in w:
            wanted[j].append(i)
    left = [len(w) for w in waits]
    ready = [(seq[i], i) for i, n in enumerate(left) if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        _, i = heapq.heappop(ready)
        out.append(i)
        for j in wanted[i]:
            left[j] -= 1
            if not left[j]:
                heapq.heappush(ready, (seq[j], j))
    stuck = set(range(len(ids))) - set(out)
    return out + sorted(stuck, key=lambda i: (seq[i], i)), stuck


def render(conversation: object, rows: list[dict], schemas: dict = SCHEMAS, silent: frozenset = SILENT) -> tuple[int, int, int, int, int, int, str]:
    """Calls, linked, unanswered, orphan results, invalid, cyclic, and the JSON of a conversation's linked rows."""
    calls = [r for r in rows if r["is_call"]]
    orphans = [r for r in rows if not r["is_call"]]
    calls.sort(key=lambda r: (r["seq"], r["call_id"] or "", r["name"] or "", r["arguments"] or ""))
    orphans.sort(key=lambda r: (r["result_seq"], r["call_id"] or "", r["content"] or ""))
    at, stuck = order([r["call_id"] for r in calls], [r["after"] or [] for r in calls], [(r["seq"], r["call_id"] or "") for r in calls])
    out, invalid, linked, open_calls = [], 0, 0, 0
    for i in at:
        r = calls[i]
        try:
            arguments = _load(r["arguments"])
            errors = violations(arguments, schemas[r["name"]]) if r["name"] in schemas else ["unknown tool"]
            canonical(arguments)
        except (ValueError, RecursionError, OverflowError):
            arguments, errors = r["arguments"], ["not JSON"]
        invalid += bool(errors)
        answered = r["result_seq"] is not None
        linked += answered
        open_calls += not answered and r["name"] not in silent
        item = {"id": r["call_id"], "name": r["name"], "arguments": arguments, "valid": not errors}
        if errors:
            item["errors"] = errors
        if answered:
            item["result"] = r["content"]
        if i in stuck:
            item["cyclic"] = True
        out.append(item)
    body = {"conversation": conversation, "calls": out, "orphans": [{"id": r["call_id"], "result": r["content"]} for r in orphans]}
    return len(calls), linked, open_calls, len(orphans), invalid, len(stuck), canonical(body)


FIELDS = ("is_call", "call_id", "seq", "name", "arguments", "after", "result_seq", "content")
SCHEMA = "conv_id bigint, n_calls int, n_linked int, n_unanswered int, n_orphans int, n_invalid int, n_cyclic int, json string"


def link(calls: DataFrame, results: DataFrame, schemas: dict | None = None, silent: frozenset = SILENT) -> DataFrame:
    """One row for each conversation, :data:`SCHEMA`.

    ``calls``: ``conv_id, call_id, seq, name, arguments`` (JSON text) ``, after`` (array of call ids).
    ``results``: ``conv_id, call_id, seq, content``.  Null call ids link to nothing.  Rows with a null conversation id
    belong to no conversation: each is told in a row of its own, and links to nothing.  Null arguments are JSON's null, a
    null name is an unknown tool, and arguments that name a key twice are no JSON.  Of rows with equal ids and ``seq`` the
    order goes by their text; equal rows are all kept.  Long texts are kept whole; empty tables give no rows; extra columns
    are ignored.  A schema with a keyword that isn't known is a :class:`BadSchema` at once.
    """
    schemas = SCHEMAS if schemas is None else schemas
    for schema in schemas.values():
        check_schema(schema)
    def numbered(rows: DataFrame, *by: str) -> DataFrame:
        """With ``nth`` among the rows of a conversation and call id; rows of no conversation only meet their equals."""
        apart = F.when(F.col("conv_id").isNull(), F.xxhash64("call_id", "seq", *by))
        told = rows.withColumn("apart", apart)
        return told.withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "call_id", "apart").orderBy("seq", *by)))

    left = numbered(calls.select("conv_id", "call_id", "seq", "name", "arguments", "after"), "name", "arguments").withColumn("is_call", F.lit(True))
    right = numbered(results.select("conv_id", "call_id", "seq", "content"), "content").select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("seq").alias("result_seq"), "content", F.col("apart").alias("r_apart"), F.col("nth").alias("r_nth"))
    equal = (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")) & (F.col("nth") == F.col("r_nth"))
    joined = left.hint("shuffle_hash").join(right.hint("shuffle_hash"), equal, "full_outer")
    found = F.coalesce(F.col("is_call"), F.lit(False))
    row = F.struct(found.alias("is_call"), F.coalesce("call_id", "r_id").alias("call_id"), "seq", "name", "arguments", "after", "result_seq", "content").alias("row")
    # rows of no conversation are told apart by what they are and their number among equals
    alone = F.when(F.col("conv_id").isNull() & F.col("r_conv").isNull(), F.xxhash64(found, F.coalesce("apart", "r_apart"), F.coalesce("nth", "r_nth")))
    rows = joined.select(F.when(found, F.col("conv_id")).otherwise(F.col("r_conv")).alias("conv_id"), alone.alias("alone"), row)
    grouped = rows.groupBy("conv_id", "alone").agg(F.collect_list("row").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            done = [render(c, rows, schemas, silent) for c, rows in zip(ids, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[i] for d in done], pa.int32()) for i in range(6)), pa.array([d[6] for d in done], pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return grouped.select(F.col("conv_id").cast("bigint").alias("conv_id"), "rows").mapInArrow(run, SCHEMA)


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``conv_id, turn, role, text``, for :func:`link`.

    Tool calls and results marked up in a text (:data:`CALL`, :data:`RESULT`) are taken as they are.  The dialogue
    itself is told in the same form: a user's turn ``n`` calls ``reply`` under the identifier ``turn-n``, after the
    user's turn before; an assistant's turn is the result of the nearest earlier user's turn, or an orphan; a
    system's turn calls ``set_context``.  A turn of role ``tool`` or ``function`` is the result of the oldest earlier
    marked-up call that waits for one (it has an id, and no marked-up result), or an orphan; with marked-up results in
    it only what else it says is told, as an orphan.  Turns of any other role, or of none, are orphans, so each turn is
    told and each conversation has a row.  Null turns count as -1, turns without a conversation stand alone.
    """
    said = messages.select("conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("seq"), F.lower("role").alias("role"), F.col("text").cast("string").alias("text"))
    # turns of no conversation have none before them, and aren't brought together
    before = W.partitionBy("conv_id", F.when(F.col("conv_id").isNull(), F.xxhash64("seq", "role", "text"))).orderBy("seq").rangeBetween(W.unboundedPreceding, -1)
    asked_before = F.max(F.when(F.col("role") == "user", F.col("seq"))).over(before)
    said = said.withColumn("asked", F.when(F.col("conv_id").isNotNull(), asked_before))
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("turn-"), F.col(c).cast("string")))
    spoken = said.filter(F.col("role").isin("user", "system")).select(
        "conv_id", name("seq").alias("call_id"), "seq", F.when(F.col("role") == "user", "reply").otherwise("set_context").alias("name"),
        F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("prompt"), F.col("seq").alias("turn")))).otherwise(F.to_json(F.struct("text"))).alias("arguments"),
        F.when(F.col("asked").isNotNull() & (F.col("role") == "user"), F.array(name("asked"))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    heard = said.filter("role = 'assistant'").select("conv_id", name("asked").alias("call_id"), "seq", F.col("text").alias("content"))
    other = said.filter("role IS NULL OR role NOT IN ('user', 'system', 'assistant', 'tool', 'function')").select("conv_id", F.lit(None).cast("string").alias("call_id"), "seq", F.col("text").alias("content"))
    marked = lambda pattern: said.filter(F.col("text").contains("<tool_")).select("conv_id", "seq", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("nth", "json"))
    get = lambda k: F.get_json_object("json", f"$.{k}")
    asked = marked(CALL)
    calls = asked.select("conv_id", get("id").alias("call_id"), "seq", get("name").alias("name"), get("arguments").alias("arguments"), F.coalesce(F.from_json(get("after"), "array<string>"), F.array().cast("array<string>")).alias("after"))
    results = marked(RESULT).select("conv_id", get("id").alias("call_id"), "seq", get("content").alias("content"))
    waiting = asked.select("conv_id", "seq", "nth", get("id").alias("call_id"))
    return spoken.unionByName(calls), heard.unionByName(other).unionByName(results).unionByName(_tool_turns(said, waiting, results))


def _tool_turns(said: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results told by tool and function turns, which answer waiting calls first in, first out."""
    none = lambda kind: F.lit(None).cast(kind)
    turns = said.filter("role IN ('tool', 'function')").select("conv_id", F.col("seq"), "text", F.regexp_like(F.coalesce("text", F.lit("")), F.lit(RESULT)).alias("marked"))
    rest = turns.filter("marked").select("conv_id", none("string").alias("call_id"), "seq", F.regexp_replace("text", F.lit(RESULT), F.lit("")).alias("content")).filter(F.trim("content") != "")
    lone = turns.filter("NOT marked AND conv_id IS NULL").select("conv_id", none("string").alias("call_id"), "seq", F.col("text").alias("content"))
    plain = turns.filter("NOT marked AND conv_id IS NOT NULL").select("conv_id", "seq", F.lit(0).alias("nth"), none("string").alias("call_id"), F.lit("turn").alias("kind"), F.col("text").alias("content"))
    asked = calls.select("conv_id", "seq", "nth", "call_id", F.lit("call").alias("kind"), none("string").alias("content"))
    told = results.select("conv_id", "seq", F.lit(0).alias("nth"), "call_id", F.lit("result").alias("kind"), none("string").alias("content"))
    answered = F.max(F.col("kind") == "result").over(W.partitionBy("conv_id", "call_id"))
    events = plain.unionByName(asked.unionByName(told).filter("call_id IS NOT NULL AND conv_id IS NOT NULL").withColumn("answered", answered).filter("kind = 'call' AND NOT answered").drop("answered"))
    within = W.partitionBy("conv_id")
    waiting = F.coalesce(F.sum((F.col("kind") == "call").cast("int")).over(within.orderBy("seq").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the k-th turn, before which c calls came: k + min(0, least of c - j up to j = k) turns have an answered call by then
    numbered = events.withColumn("k", F.row_number().over(W.partitionBy("conv_id", "kind").orderBy("seq", "nth", "content"))).withColumn("c", waiting)
    low = lambda to: F.coalesce(F.least(F.lit(0), F.min(F.col("c") - F.col("k")).over(within.orderBy("k").rowsBetween(W.unboundedPreceding, to))), F.lit(0))
    met = numbered.filter("kind = 'turn'").withColumn("m", F.col("k") + low(0)).withColumn("m0", F.col("k") - 1 + low(-1))
    queue = numbered.filter("kind = 'call'").select(F.col("conv_id").alias("q_conv"), F.col("k").alias("q"), F.col("call_id").alias("q_id"))
    same = (F.col("conv_id") == F.col("q_conv")) & (F.when(F.col("m") > F.col("m0"), F.col("m")) == F.col("q"))
    return rest.unionByName(lone).unionByName(met.join(queue, same, "left").select("conv_id", F.col("q_id").alias("call_id"), "seq", "content"))


def format_chats(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """:func:`link` over :func:`from_messages`, a row for each conversation and for each turn without one.

    Nulls, empty and long texts, ties, repeated turns, empty tables and extra columns: as told there.  A conversation is
    one row, so it is gathered in one task; turns that belong to none aren't.
    """
    return link(*from_messages(messages), schemas)
