"""Text and JSON jobs over records, prompts and replies."""

from __future__ import annotations

import bisect
import json
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.shipping import ship

#: Effect class of each tool kind; anything else counts as the last. Fixed values.
KIND_EFFECTS = {
    "read": "read", "search": "read", "fetch": "read", "think": "compute", "switch_mode": "compute",
    "edit": "execute_code", "delete": "execute_code", "move": "execute_code", "execute": "execute_code", "other": "execute_code",
}
UNKNOWN_EFFECT = "execute_code"
MIN_SECRET = 8
#: Bytes of secrets, with their names, that may be sent to every task.
MAX_SECRETS = 64 << 20


def redact(text: Column, secrets: dict[str, str]) -> tuple[Column, Column]:
    """(text with secret values replaced, sorted names removed); longest first, values under the least length left alone."""
    kept = sorted(((n, v) for n, v in secrets.items() if len(v) >= MIN_SECRET), key=lambda kv: -len(kv[1]))
    out, names = text, []
    for name, value in kept:
        names.append(F.when(F.contains(out, F.lit(value)), name))
        out = F.replace(out, F.lit(value), F.lit(f"[REDACTED:{name}]"))
    return out, F.array_sort(F.filter(F.array(*names), lambda x: x.isNotNull())) if names else F.array().cast("array<string>")


def _redacted(text: str, automaton, names: list[str]) -> tuple[str, list[str]]:
    """One text; of overlapping values the longest is taken first, then by name, then from the left."""
    found = sorted((-size, rank, stop + 1 - size) for stop, (rank, size) in automaton.iter(text))
    taken, ends = [], []  # disjoint spans in order of the text
    for minus, rank, start in found:
        i = bisect.bisect_right(ends, start)
        if i == len(taken) or taken[i][0] >= start - minus:
            taken.insert(i, (start, start - minus, rank))
            ends.insert(i, start - minus)
    out, at = [], 0
    for start, stop, rank in taken:
        out += [text[at:start], f"[REDACTED:{names[rank]}]"]
        at = stop
    return "".join([*out, text[at:]]), sorted({names[rank] for _, _, rank in taken})


def redact_all(docs: DataFrame, secrets: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with the values of a table of secrets (name, value) replaced in one pass; adds `redacted`, the sorted names.

    An automaton of all values goes to the tasks; a table of over MAX_SECRETS bytes raises an error. Values under the least length
    and null names are left alone; a value under several names goes by the first. What a replacement puts in is not searched
    again. A null text stays null, without names. If the input has a `redacted` itself, the added column gets an underscore more.
    """
    spark = docs.sparkSession
    ship(spark)
    known = secrets.where(F.col("name").isNotNull() & (F.length("value") >= MIN_SECRET)).groupBy("value").agg(F.min("name").alias("name"))
    size = known.agg(F.sum(F.octet_length("value") + F.octet_length("name"))).first()[0] or 0
    if size > MAX_SECRETS:
        raise ValueError(f"{size} bytes of secrets; at most {MAX_SECRETS} go to the tasks")
    held = spark.sparkContext.broadcast(sorted((r["name"], r["value"]) for r in known.collect()))
    added = "redacted"
    while added in docs.columns:
        added += "_"
    at = docs.columns.index(text_col)

    def run(batches):
        automaton = ahocorasick.Automaton()
        for rank, (_, value) in enumerate(held.value):
            automaton.add_word(value, (rank, len(value)))
        automaton.make_automaton()
        names = [n for n, _ in held.value]
        for b in batches:
            done = [(t, []) if t is None or not names else _redacted(t, automaton, names) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array([t for t, _ in done], b.column(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in done], pa.list_(pa.string()))], [*b.schema.names, added])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(added, ArrayType(StringType()))]))


def wrap_input(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'<input name="{name}">'), F.replace(value, F.lit("</input"), F.lit("<\\/input")), F.lit("</input>"))


def render(template: str, fields: dict[str, Column]) -> tuple[Column, Column]:
    """(prompt, error) of a template with {dotted.name} fields; a field that is missing or null gives an error and no prompt."""
    parts, missing = [], F.lit(None).cast("string")
    pieces = re.split(r"\{([A-Za-z0-9_.]+)\}", template)
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        else:
            value = fields.get(piece)
            value = F.lit(None).cast("string") if value is None else value.cast("string")
            missing = F.coalesce(missing, F.when(value.isNull(), f"missing field {piece}"))
            parts.append(F.coalesce(wrap_input(piece, value), F.lit("")))
    return F.when(missing.isNull(), F.concat(*parts)), missing


def strip_fences(text: Column) -> Column:
    """Without one leading fence line and one trailing fence; other text as it stands, trimmed."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(F.substring(t, F.lit(4), F.length(t)))
    inner = F.regexp_replace(inner, r"\s+$", "")
    inner = F.when(inner.endswith("```"), F.substring(inner, F.lit(1), F.length(inner) - 3)).otherwise(inner)
    return F.regexp_replace(F.when(t.startswith("```"), inner).otherwise(t), r"^\s+|\s+$", "")


#: JSON types by the names that schemas give them, as the parser names them. Fixed values.
TYPE_NAMES = {"string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT", "null": "VOID"}
MESSAGE_CAP = 300


def violation(reply: Column, schema: dict) -> Column:
    """The most specific violation of an object schema by a JSON reply, as "path: rule" of at most 300 characters; null if it conforms.

    The schema is walked, with nested `properties` and `items`, and becomes one expression: values of arrays go through a
    higher-order function, so replies of any size stay in one row. Of several failures the deepest comes first, then the rule's
    name, then the order of the walk: object rules before properties in the order of the schema, entries by position. Rules: type,
    enum, minimum, maximum, minLength, maxLength, minItems, maxItems, items, required, properties, additionalProperties. A field
    that is there as null satisfies `required`; 5.0 is an integer; a boolean is no number. References and combinators of schemas
    are not read. A reply that is null is no JSON.
    """
    v = F.try_parse_json(reply)
    found = _failures(v, schema, F.lit("$"), 0)
    none = F.lit(None).cast(_FAILURE)
    # the first of the deepest, by one fold: array_sort is not stable
    better = lambda best, x: best.isNull() | (x["depth"] > best["depth"]) | ((x["depth"] == best["depth"]) & (x["rule"] < best["rule"]))
    first = F.reduce(found, none, lambda best, x: F.when(better(best, x), x).otherwise(best))
    words = F.concat(first["path"], F.lit(": "), first["message"])
    return F.when(v.isNull(), "$: not JSON").otherwise(F.left(words, F.lit(MESSAGE_CAP)))


_FAILURE = "struct<depth:int,rule:string,path:string,message:string>"


def _is_type(v: Column, name: str) -> Column:
    kind = F.schema_of_variant(v)
    if name in TYPE_NAMES:
        return kind.startswith(TYPE_NAMES[name])
    number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    if name == "number":
        return number
    if name == "integer":
        value = F.try_variant_get(v, "$", "double")
        return number & (kind.startswith("BIGINT") | (value == F.floor(value)))
    return F.lit(False)


def _failures(v: Column, schema: dict, path: Column, depth: int) -> Column:
    """Array of the failures of a variant, in the order of the walk."""
    def fail(ok: Column, rule: str, message: Column | str) -> Column:
        message = F.lit(message) if isinstance(message, str) else message
        one = F.struct(F.lit(depth).alias("depth"), F.lit(rule).alias("rule"), path.alias("path"), message.alias("message")).cast(_FAILURE)
        return F.when(~F.coalesce(ok, F.lit(False)), F.array(one)).otherwise(F.array().cast(f"array<{_FAILURE}>"))

    out = []
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    is_object, is_array, is_string, is_number = (_is_type(v, t) for t in ("object", "array", "string", "number"))
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = _is_type(v, names[0])
        for n in names[1:]:
            ok = ok | _is_type(v, n)
        out.append(fail(ok, "type", f"type {' or '.join(names)}"))
    if "enum" in schema:
        allowed = F.array(*[F.to_json(F.parse_json(F.lit(json.dumps(x)))) for x in schema["enum"]])
        out.append(fail(F.array_contains(allowed, F.to_json(v)), "enum", "enum"))
    for rule, ok in (("minimum", lambda n: number >= n), ("maximum", lambda n: number <= n)):
        if rule in schema:
            out.append(fail(~is_number | ok(schema[rule]), rule, f"{rule} {schema[rule]}"))
    for rule, ok in (("minLength", lambda n: F.length(text) >= n), ("maxLength", lambda n: F.length(text) <= n)):
        if rule in schema:
            out.append(fail(~is_string | ok(schema[rule]), rule, f"{rule} {schema[rule]}"))
    size = F.when(is_array, F.json_array_length(F.to_json(v)))
    for rule, ok in (("minItems", lambda n: size >= n), ("maxItems", lambda n: size <= n)):
        if rule in schema:
            out.append(fail(~is_array | ok(schema[rule]), rule, f"{rule} {schema[rule]}"))
    field = lambda name: F.variant_get(v, f'$["{name}"]', "variant")
    for name in schema.get("required", []):
        out.append(fail(~is_object | field(name).isNotNull(), "required", f"required {name}"))
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        extra = F.array_sort(F.array_except(F.json_object_keys(F.to_json(v)), known))
        out.append(fail(~is_object | (F.size(extra) == 0), "additionalProperties", F.concat(F.lit("additional "), F.array_join(extra, ","))))
    empty = F.array().cast(f"array<{_FAILURE}>")
    for name, inner in schema.get("properties", {}).items():
        out.append(F.when(is_object & field(name).isNotNull(), _failures(field(name), inner, F.concat(path, F.lit(f".{name}")), depth + 1)).otherwise(empty))
    if "items" in schema:
        held = F.try_variant_get(v, "$", "array<variant>")
        each = F.transform(held, lambda x, i: _failures(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1))
        out.append(F.when(is_array, F.flatten(each)).otherwise(empty))
    return F.concat(*out) if out else empty


def tool_calls(replies: DataFrame) -> DataFrame:
    """One row per call of an output's tool_calls (JSON text): name, whether it was rejected, and whether it was offered."""
    calls = F.from_json(F.get_json_object("output", "$.tool_calls"), "array<struct<name:string,rejected:boolean>>")
    return replies.select("run_id", "step_id", "offered", F.posexplode(calls).alias("place", "c")).select("run_id", "step_id", F.col("place").cast("bigint").alias("place"), "c.name", F.coalesce("c.rejected", F.lit(False)).alias("rejected"), F.array_contains("offered", F.col("c.name")).alias("was_offered"))


def kind_effect(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KIND_EFFECTS.items() for x in kv])
    return F.coalesce(table[F.coalesce(kind, F.lit(""))], F.lit(UNKNOWN_EFFECT))


def resolve_alias(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Model of each requested name: the alias's model if there is one, else the name itself."""
    return rows.join(aliases, "requested", "left").withColumn("resolved", F.coalesce("model", "requested")).drop("model")


def select_tools(tools: DataFrame, declared: DataFrame) -> DataFrame:
    """Tools of each agent with whether they are offered: their effect is declared."""
    rows = tools.join(declared, "agent")
    return rows.withColumn("offered", F.array_contains("declared", F.col("effect"))).drop("declared")


def word_count(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("bigint")


def output_stats(outputs: DataFrame, group: str, text: str, cap: int) -> DataFrame:
    n = F.octet_length(text).cast("bigint")
    return outputs.groupBy(group).agg(F.count("*").alias("n"), F.max(n).alias("largest"), F.sum(n).alias("bytes"), F.count(F.when(n > cap, 1)).alias("over_cap"), F.percentile_approx(n, 0.5, 1000000).alias("median"))
