"""Walks over JSON of any shape.

A record is parsed and walked once, in its own row, without recursion: what it names or where it differs comes out as rows, and
only those move on. Texts are read as Spark's JSON parser reads them (what follows the first value is ignored, NaN is no JSON);
of a repeated key of an object the last value counts. What is nested deeper than the parser goes (some thousands) is no JSON.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import packed, unpacked
from ..functions.shipping import ship

class _MISSING:
    """Stands for no value; a class, so that it is the same one in every process."""


class _Number(float):
    """A number with a fraction or an exponent, and its text."""

    __slots__ = ("text",)

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out


def _no_constant(name: str):
    raise ValueError(name)


_READER = json.JSONDecoder(parse_float=_Number, parse_constant=_no_constant)


def _read(text: str | None):
    """The value at the head of a text, or _MISSING."""
    try:
        return _READER.raw_decode(text.lstrip(" \t\r\n"))[0]
    except (AttributeError, ValueError, RecursionError):
        return _MISSING


def _clean(text: str) -> str:
    """Text that can be stored: halves of surrogate pairs become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _named(doc) -> list[str]:
    """The digests that a value names, in the order of a walk that looks at an object before what it holds."""
    found, todo = [], [doc]
    while todo:
        x = todo.pop()
        if type(x) is dict:
            if "size" in x and type(x.get("sha256")) is str:
                found.append(_clean(x["sha256"]))
            if type(x.get("pricing_snapshot_hash")) is str:
                found.append(_clean(x["pricing_snapshot_hash"]))
            x = list(x.values())
        elif type(x) is not list:
            continue
        todo.extend(v for v in reversed(x) if type(v) in (dict, list))
    return found


def _text_of(value) -> str:
    """JSON text of a value with its numbers as they were written."""
    out, todo = [], [(value, False)]
    while todo:
        x, plain = todo.pop()
        if plain:
            out.append(x)
        elif type(x) is _Number:
            out.append(x.text)
        elif type(x) is dict or type(x) is list:
            ends = "{}" if type(x) is dict else "[]"
            parts = [(ends[0], True)]
            for i, k in enumerate(x):
                parts.append(("," * (i > 0) + (json.dumps(k) + ":" if type(x) is dict else ""), True))
                parts.append((x[k] if type(x) is dict else k, False))
            todo.extend(reversed([*parts, (ends[1], True)]))
        else:
            out.append(json.dumps(x))
    return "".join(out)


def _kind(x) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")


def _double(x) -> float:
    try:
        return float(x)
    except OverflowError:
        return float(str(x))


def _differences(recorded, current) -> list[tuple[str, str, object, object]]:
    """(path, rule, value, value now) of the topmost places where `recorded` is no subset of `current`."""
    found, todo = [], [("$", recorded, current)]
    while todo:
        path, a, b = todo.pop()
        if b is _MISSING:
            found.append((path, "vanished", a, b))
            continue
        one, two = _kind(a), _kind(b)
        if one == two == "array":
            if len(a) != len(b):
                found.append((path, "length", a, b))
            else:
                todo.extend((f"{path}[{i}]", x, y) for i, (x, y) in enumerate(zip(a, b, strict=True)))
        elif one == two == "object":
            todo.extend((f"{path}.{k}", x, b.get(k, _MISSING)) for k, x in a.items())
        elif {one, two} <= {"number", "boolean"}:
            if _double(a) != _double(b):
                found.append((path, "differs", a, b))
        elif one != two or a != b:
            found.append((path, "differs", a, b))
    return found


def references(records: DataFrame) -> DataFrame:
    """Digests that a run's records name anywhere (run_id, sha256, place), once each, by first reference.

    A reference is an object with a text `sha256` and a `size`, or a text `pricing_snapshot_hash`, at any depth. Order is that of
    a walk through records by seq which looks at an object before what it holds, in the order of the text.
    """
    ship(records.sparkSession)
    names = ["run_id", "seq", "sha256", "i"]

    def walk(batches):
        for batch in batches:
            at, digests, places = [], [], []
            for n, text in enumerate(batch.column(2).to_pylist()):
                for i, digest in enumerate(_named(_read(text))):
                    at.append(n)
                    digests.append(digest)
                    places.append(i)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(digests, pa.string()), pa.array(places, pa.int64())], names)

    # a name stands in the text as it is, or with an escape
    may = F.contains("record", F.lit("sha256")) | F.contains("record", F.lit("pricing_snapshot_hash")) | F.contains("record", F.lit("\\u"))
    rows = records.where(may).select("run_id", "seq", "record").mapInArrow(walk, "run_id string, seq bigint, sha256 string, i bigint")
    # dealt once, by run, with ids and digests as bytes
    rows = rows.select(packed("run_id").alias("run"), packed("sha256").alias("digest"), "seq", "i").repartition("run")
    first = rows.groupBy("run", "digest").agg(F.min(F.struct("seq", "i")).alias("at")).withColumn("sha256", unpacked("digest"))
    return first.select(unpacked("run").alias("run_id"), "sha256", F.expr("cast(row_number() over (partition by run order by at, sha256) as bigint)").alias("place"))


def drift(recorded: DataFrame, current: DataFrame, key: str = "key", text: str = "state") -> DataFrame:
    """drift_of() for states that lie in two tables. Keys are unique on both sides; a key without a current state differs at `$`."""
    pair = recorded.select(key, F.col(text).alias("recorded")).join(current.select(key, F.col(text).alias("current")), key, "left")
    return drift_of(pair, key)


def drift_of(pairs: DataFrame, key: str = "key") -> DataFrame:
    """Where a recorded state is no subset of the current one: key, path, rule (vanished, length, differs), value, now (JSON text).

    pairs: a key and the JSON texts `recorded` and `current`. Objects may have more fields now; arrays must be as long, and their
    entries agree one by one; numbers are equal by value (booleans count as 1 and 0), all else by kind and value. Only the
    topmost path of a difference is given. A missing current state differs at `$`; a missing recorded one does not.
    """
    ship(pairs.sparkSession)

    def compare(batches):
        for batch in batches:
            at, out = [], [[], [], [], []]
            for n, (old, new) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                was = _read(old)
                for path, rule, a, b in [] if was is _MISSING else _differences(was, _read(new)):
                    at.append(n)
                    for values, value in zip(out, (_clean(path), rule, _text_of(a), None if b is _MISSING else _text_of(b)), strict=True):
                        values.append(value)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, pa.string()) for v in out)]
            yield pa.RecordBatch.from_arrays(columns, [key, "path", "rule", "value", "now"])

    # equal texts have no difference
    rows = pairs.where("recorded is not null and not recorded <=> current").select(key, "recorded", "current")
    found = rows.mapInArrow(compare, f"`{key}` {pairs.schema[key].dataType.simpleString()}, path string, rule string, value string, now string")
    as_text = lambda c: F.to_json(F.parse_json(c)).alias(c)
    return found.select(key, "path", "rule", as_text("value"), as_text("now"))
