"""Redaction from a table of secrets against the chain of replacements."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import textjobs


def _by_hand(text, secrets):
    """Longest first, then by name, over marks that no text holds; names in order."""
    marks = {}
    for i, (name, value) in enumerate(sorted(secrets.items(), key=lambda kv: (-len(kv[1]), kv[0]))):
        if len(value) >= textjobs.MIN_SECRET and value in text:
            marks[chr(0xE000 + i)] = name
            text = text.replace(value, chr(0xE000 + i))
    for mark, name in marks.items():
        text = text.replace(mark, f"[REDACTED:{name}]")
    return text, sorted(marks.values())


def test_table_of_secrets_equals_the_chain(spark):
    rnd = random.Random(5)
    secrets = {f"n{i}": "".join(rnd.choice("ab") for _ in range(rnd.randint(6, 12))) for i in range(60)}
    secrets = {n: v for i, (n, v) in enumerate(secrets.items()) if v not in list(secrets.values())[:i]}
    texts = ["".join(rnd.choice("aab \u00e9\U0001f600") for _ in range(rnd.randint(0, 400))) for _ in range(200)] + ["", secrets["n1"] * 3]
    table = spark.createDataFrame(list(secrets.items()), "name string, value string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "id long, text string, redacted string")
    out = textjobs.redact_all(docs, table)
    assert out.columns == ["id", "text", "redacted", "redacted_"]
    rows = {r["id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert (rows[i]["text"], rows[i]["redacted_"]) == _by_hand(t, secrets)
    assert rows[len(texts)]["text"] is None and rows[len(texts)]["redacted_"] == []


def test_ten_thousand_secrets_nulls_and_bounds(spark, monkeypatch):
    table = spark.range(10_000).select(F.concat(F.lit("k"), "id").alias("name"), F.concat(F.lit("secret-value-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("value"))
    odd = spark.createDataFrame([(None, "nameless-value"), ("short", "tiny"), ("none", None), ("k0a", "secret-value-000000")], "name string, value string")
    docs = spark.range(50).select("id", F.format_string("a secret-value-%06d, nameless-value, tiny", F.col("id") * 211).alias("text"))
    rows = textjobs.redact_all(docs, table.unionByName(odd)).collect()
    assert {(r["text"], tuple(r["redacted"])) for r in rows} == {(f"a [REDACTED:k{i * 211}], nameless-value, tiny" if i * 211 < 10_000 else f"a secret-value-{i * 211:06d}, nameless-value, tiny", (f"k{i * 211}",) if i * 211 < 10_000 else ()) for i in range(50)}
    assert textjobs.redact_all(docs, table.limit(0)).where("size(redacted) > 0").count() == 0
    assert textjobs.redact_all(docs.limit(0), table).count() == 0
    monkeypatch.setattr(textjobs, "MAX_SECRETS", 100)
    with pytest.raises(ValueError, match="bytes of secrets"):
        textjobs.redact_all(docs, table)
