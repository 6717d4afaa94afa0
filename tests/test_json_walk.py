"""Walks over nested JSON against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import json_walk, textjobs


def random_json(r, depth=0):
    kind = r.choice(["object", "array", "leaf", "leaf"]) if depth < 4 else "leaf"
    if kind == "object":
        out = {k: random_json(r, depth + 1) for k in r.sample(["b", "a", "key", "x.y", "a[0]", "ü", "place", "size", "sha256", "pricing_snapshot_hash"], r.randint(0, 4))}
        if r.random() < 0.3:
            out |= {"sha256": f"h{r.randint(0, 5)}", "size": r.choice([1, None])}
        return out
    if kind == "array":
        return [random_json(r, depth + 1) for _ in range(r.randint(0, 3))]
    return r.choice([1, 1.5, -7, "s", "", "h3", True, False, None, "5"])


def reference_walk(records):
    seen = {}

    def walk(x):
        if isinstance(x, dict):
            for ok, v in (("size" in x, x.get("sha256")), (True, x.get("pricing_snapshot_hash"))):
                if ok and isinstance(v, str):
                    seen.setdefault(v)
        for item in x.values() if isinstance(x, dict) else x if isinstance(x, list) else []:
            walk(item)

    for x in records:
        walk(x)
    return list(seen)


def test_references_at_any_depth(spark):
    r = random.Random(3)
    runs = {f"r{i}": [random_json(r) for _ in range(3)] for i in range(40)}
    deep = {"sha256": "deepest", "size": 0}
    for i in range(30):
        deep = {"next": deep} if i % 2 else [deep, {"sha256": f"d{i}", "size": 1}]
    runs["deep"] = [deep]
    rows = [(run, i, json.dumps(x, ensure_ascii=bool(i % 2))) for run, xs in runs.items() for i, x in enumerate(xs)] + [("bad", 1, "{"), ("bad", 2, None), ("bad", 3, "3"), ("bad", 4, '"sha256"')]
    got = {}
    for x in json_walk.references(spark.createDataFrame(rows, "run_id string, seq bigint, record string").repartition(3)).orderBy("run_id", "place").collect():
        got.setdefault(x["run_id"], []).append(x["sha256"])
    assert got == {k: v for k, xs in runs.items() if (v := reference_walk(xs))} and len(got["deep"]) == 16
    assert json_walk.references(spark.createDataFrame([], "run_id string, seq bigint, record string")).count() == 0


def subset_drift(a, b, path="$"):
    if isinstance(a, dict) and isinstance(b, dict):
        return [x for k, v in a.items() for x in ([(f"{path}.{k}", "vanished")] if k not in b else subset_drift(v, b[k], f"{path}.{k}"))]
    if isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            return [(path, "length")]
        return [x for i, (p, q) in enumerate(zip(a, b, strict=True)) for x in subset_drift(p, q, f"{path}[{i}]")]
    return [] if a == b else [(path, "differs")]


def changed(r, x):
    """The same value with a few changes."""
    if r.random() < 0.08:
        return random_json(r, 3)
    if isinstance(x, dict):
        out = {k: changed(r, v) for k, v in x.items() if r.random() > 0.05}
        return out | ({"more": 1} if r.random() < 0.3 else {})
    if isinstance(x, list):
        return [changed(r, v) for v in x] + ([1] if r.random() < 0.05 else [])
    return x


def test_drift_equals_recursion(spark):
    r = random.Random(8)
    pairs = {f"k{i}": (x, changed(r, x)) for i in range(150) for x in [[random_json(r), random_json(r, 1)]]}
    pairs |= {"num": ({"a": 1, "b": True, "c": 2.0, "d": "1"}, {"a": 1.0, "b": 1, "c": 2, "d": 1}), "kind": ({"a": {}}, {"a": []}), "dot": ({"a.b": 1, "a": {"b": 2}}, {"a": {"b": 2}})}
    schema = "key string, state string"
    old = spark.createDataFrame([(k, json.dumps(a)) for k, (a, _) in pairs.items()] + [("gone", '{"a":1}')], schema)
    new = spark.createDataFrame([(k, json.dumps(b)) for k, (_, b) in pairs.items()] + [("extra", "[1]")], schema)
    got = sorted((x["key"], x["path"], x["rule"]) for x in json_walk.drift(old, new).collect())
    want = sorted([(k, *x) for k, (a, b) in pairs.items() for x in subset_drift(a, b)] + [("gone", "$", "vanished")])
    assert got == want and len(want) > 60
    assert json_walk.drift(old.limit(0), new).count() == 0


def _plan(df):
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_walk_stores_no_levels(spark, tmp_path):
    """Records are walked where they lie: nothing is written, references move once and drift not at all; escaped names and digests of any form are found."""
    record = json.dumps({"effects": [{"proof": {"sha256": "AB", "size": 0}}, {"sha256": "0aff", "size": None}, {"sha256": "", "size": 1}]}).replace("sha256", "\\u0073ha256", 1)
    rows = spark.createDataFrame([("r\u00e9", 2, record), ("r\u00e9", 1, '{"pricing_snapshot_hash":"0aff"} end')], "run_id string, seq bigint, record string").repartition(3, "run_id")
    found = json_walk.references(rows)
    assert _plan(found).count("Exchange") == 2  # the rows' own, and one by run
    assert sorted((x["place"], x["sha256"], x["run_id"]) for x in found.collect()) == [(1, "0aff", "r\u00e9"), (2, "AB", "r\u00e9"), (3, "", "r\u00e9")]
    pairs = spark.createDataFrame([("a", '{"n":1e3,"m":1.50,"x":{"b":1,"a":[2]}}', '{"n":1001,"m":2,"x":[]}'), ("b", "[1]", None), ("c", None, "[1]"), ("d", "{", "{}")], "key string, recorded string, current string")
    drift = json_walk.drift_of(pairs)
    assert "Exchange" not in _plan(drift)
    assert sorted(map(tuple, drift.collect())) == [("a", "$.m", "differs", "1.5", "2"), ("a", "$.n", "differs", "1000.0", "1001"), ("a", "$.x", "differs", '{"a":[2],"b":1}', "[]"), ("b", "$", "vanished", "[1]", None)]


# ------------------------------------------------------------------ schemas

SCHEMA = {
    "type": "object", "required": ["a", "b"], "additionalProperties": False,
    "properties": {
        "a": {"type": "integer", "minimum": 2, "maximum": 9}, "b": {"type": ["string", "null"], "minLength": 2, "maxLength": 4, "enum": ["ab", "abcd", "x", None, "longer"]},
        "c": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "number"}, "v": {"type": "array", "items": {"type": "boolean"}}}, "additionalProperties": False}},
        "d": {"type": "object", "properties": {"e": {"type": "object", "required": ["f"], "properties": {"f": {"enum": [1, "1", [1], {"z": 1}]}}}}}, "n": {"type": "null"},
    },
}


def brute(x, schema, path="$", depth=0):
    """(depth, rule, path, message) of every failure, in the order of the walk."""
    number = isinstance(x, int | float) and not isinstance(x, bool)
    kinds = {"string": isinstance(x, str), "integer": number and x == int(x), "number": number, "boolean": isinstance(x, bool), "array": isinstance(x, list), "object": isinstance(x, dict), "null": x is None}
    out = []
    fail = lambda ok, rule, message: None if ok else out.append((depth, rule, path, message))
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fail(any(kinds[n] for n in names), "type", "type " + " or ".join(names))
    if "enum" in schema:
        fail(any(x == e and type(x) is type(e) for e in schema["enum"]), "enum", "enum")
    for rule, ok in (("minimum", lambda n: x >= n), ("maximum", lambda n: x <= n)):
        if rule in schema and number:
            fail(ok(schema[rule]), rule, f"{rule} {schema[rule]}")
    for rule, kind, ok in (("minLength", "string", lambda n: len(x) >= n), ("maxLength", "string", lambda n: len(x) <= n), ("minItems", "array", lambda n: len(x) >= n), ("maxItems", "array", lambda n: len(x) <= n)):
        if rule in schema and kinds[kind]:
            fail(ok(schema[rule]), rule, f"{rule} {schema[rule]}")
    if isinstance(x, dict):
        for n in schema.get("required", []):
            fail(n in x, "required", f"required {n}")
        extra = sorted(set(x) - set(schema.get("properties", {})))
        fail(schema.get("additionalProperties") is not False or not extra, "additionalProperties", "additional " + ",".join(extra))
        for n, inner in schema.get("properties", {}).items():
            if n in x:
                out += brute(x[n], inner, f"{path}.{n}", depth + 1)
    if isinstance(x, list) and "items" in schema:
        for i, item in enumerate(x):
            out += brute(item, schema["items"], f"{path}[{i}]", depth + 1)
    return out


def first(x):
    found = brute(x, SCHEMA)
    best = sorted(found, key=lambda f: (-f[0], f[1]))[0] if found else None
    return None if best is None else f"{best[2]}: {best[3]}"[:300]


def test_conformance_equals_a_validator(spark):
    r = random.Random(6)
    leaf = lambda: r.choice([1, 5, 10, 5.0, 5.5, "x", "ab", "abcd", "longer", None, True, [], {}, "é", "éé"])
    items = lambda: [r.choice([leaf(), {"k": leaf()}, {"k": 1, "v": [True, leaf()]}, {"k": 2, "z": 1}, {"v": [False]}]) for _ in range(r.randint(0, 4))]
    values = []
    for _ in range(400):
        x = {"a": r.choice([5, 5, leaf()]), "b": r.choice(["ab", "ab", leaf()]), "c": r.choice([leaf(), items(), items(), [{"k": 1}]]), "d": r.choice([{}, leaf(), {"e": {"f": r.choice([1, "1", [1], {"z": 1}, 2])}}, {"e": {}}]), "n": r.choice([None, 1])}
        values.append({k: v for k, v in x.items() if r.random() < 0.8} | ({"q" * 400: 1} if r.random() < 0.05 else {}))
    values += [[1], 5, "x", None, {}, {"a": None, "b": None}]
    texts = [json.dumps(v) for v in values]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, "no json"), (-2, None)], "i bigint, reply string")
    got = {x["i"]: x["v"] for x in rows.select("i", textjobs.violation(F.col("reply"), SCHEMA).alias("v")).collect()}
    assert got[-1] == got[-2] == "$: not JSON"
    for i, v in enumerate(values):
        assert got[i] == first(v), texts[i]
    assert sum(x is None for x in got.values()) > 3 and max(len(x or "") for x in got.values()) == 300


@pytest.mark.parametrize("text,want", [('{"a":2,"b":null}', None), ('{"a":2}', "$: required b"), ('{"a":5.0,"b":"ab","c":[{"k":1,"v":[true,1]}]}', "$.c[0].v[1]: type boolean")])
def test_conformance_examples(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(textjobs.violation(F.col("t"), SCHEMA)).first()[0] == want
