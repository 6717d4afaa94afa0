"""Whitening, reversed search and the toxicity grammar against brute force, and on awkward rows."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>, label int"
DOCS = "doc_id bigint, text string, lang string, source string"


# ------------------------------------------------------------------ 11 whitening


@pytest.mark.parametrize("low,high,rows", [(-40, 40, 500), (0, 1, 64), (-7, 2**30, 70), (-(2**50), 2**50, 9), (5, 5, 3)])
def test_bit_planes_give_exact_products(low, high, rows):
    from logweave.llm.whitening import scatter

    r = random.Random(rows)
    z = np.array([[r.randint(low, high) for _ in range(5)] for _ in range(rows)], np.int64)
    sums, cross = scatter(z)
    exact = z.astype(object)
    assert (sums == exact.sum(axis=0)).all() and (cross == exact.T.dot(exact)).all()


def test_whitening_equals_a_dense_computation(spark):
    from logweave.llm.whitening import whiten

    r = np.random.default_rng(3)
    v = (r.normal(size=(9000, 12)) @ r.normal(size=(12, 12))).astype(np.float32)
    v[100:3100] = v[7]  # a third of the rows are one vector
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], VECTORS).repartition(5)
    out = whiten(df).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    want = ((n * x - s).astype(object) ** 2).sum(axis=1)
    assert len(out) == n * 12 and (out.n == n).all()
    assert [int(d) for d in out[out.component == 1].deviation] == [int(d) for d in want]
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float) - 1_000_000, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    plain = (x - s / n) @ vectors / np.sqrt(values)
    got = out.whitened.to_numpy().reshape(n, 12)
    signs = np.sign((plain * got).sum(axis=0))
    assert np.allclose(plain * signs, got, atol=1e-8)
    assert np.allclose(out.explained.to_numpy()[:12], values / values.sum(), rtol=1e-9)
    assert out.identity_error.nunique() == 1 and 0 <= out.identity_error[0] < 1e-9
    assert np.abs(np.cov(got.T, bias=True) - np.eye(12)).max() < 1e-9


def test_whitening_of_awkward_rows(spark):
    from logweave.llm.whitening import whiten

    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -1.0]), (2, [0.25, -1.0, -1.0]), (2, [0.25, -1.0, -1.0]), (None, [0.0, 0.125, -1.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [1.0, -inf, 1.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], VECTORS).select("*", *[F.lit("x").alias(c) for c in ("_v", "_id", "component", "n", "i", "v")])
    out = whiten(df).toPandas()
    assert len(out) == 4 * 3 and (out.n == 4).all() and out.vec_id.isna().sum() == 3
    assert out[out.component == 3].whitened.isna().all() and out[out.component < 3].whitened.notna().all()  # the last dimension is constant
    assert out.explained.groupby(out.component).first().sum() == pytest.approx(1.0)
    assert whiten(df.where("vec_id = 5")).count() == 0 and whiten(df.limit(0)).columns == whiten(df).columns
    one = whiten(df.where("vec_id = 1")).toPandas()
    assert one.whitened.isna().all() and one.explained.isna().all() and one.identity_error.isna().all() and (one.deviation == 0).all()
    with pytest.raises(Exception, match="would not be exact"):
        whiten(spark.createDataFrame([(1, [1e30], 0)], VECTORS)).count()


# ------------------------------------------------------------------ 12 reversed search


def brute_search(docs, items, k=10):
    find = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    seen = [(i, find(t)) for i, t in docs]
    seen = [(i, t) for i, t in seen if t]
    n_docs, length = len(seen), sum(len(t) for _, t in seen)
    out = []
    for item, text in items:
        scored = []
        for i, words in seen:
            score, m = 0, 10 + 90 * len(words) * n_docs // length
            for t in set(find(text)):
                tf = words.count(t)
                if tf:
                    df = sum(t in w for _, w in seen)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def corpus():
    r = random.Random(5)
    words = ["Ab", "ab", "Éa", "éa", "x1", "9", "naïve", "日本", "of", "the", "cat_dog", "it's", "Ünï"]
    docs = [(i, " ".join(r.choice(words[: 3 + i % 11]) for _ in range(r.randint(1, 40)))) for i in range(60)]
    docs += [(100 + i, "the cat_dog of ab") for i in range(40)]  # ties by copies
    return docs + [(7, "ab of"), (7, "ab of"), (None, "ab of"), (200, None), (201, ""), (202, " .,;_ "), (203, "the " * 5000)]


ITEMS = [(1, "the cat of Ab"), (2, "日本 Ünï ünï"), (3, None), (4, ""), (5, "nowhere to be found"), (6, "the cat of Ab"), (6, "9 x1"), (None, "éa of")]


@pytest.mark.parametrize("most_bytes,piece", [(8 << 20, 4 << 20), (90, 4 << 20), (8 << 20, 7)])
def test_search_equals_scoring_all(spark, monkeypatch, most_bytes, piece):
    from logweave.llm import reversed_search

    monkeypatch.setattr(reversed_search, "PIECE", piece)
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string").repartition(6).select("*", *[F.lit("x").alias(c) for c in ("_id", "_text", "n", "t", "tf", "score", "rank")])
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("_item", F.lit("x"))
    got = reversed_search.search(docs, items, most_bytes=most_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(corpus(), ITEMS)
    assert reversed_search.search(docs.limit(0), items).count() == 0 and reversed_search.search(docs, items.limit(0)).count() == 0


def test_pieces_of_a_text_lose_no_term(monkeypatch):
    from logweave.llm import reversed_search

    text = " ".join(t or "" for _, t in corpus()).encode()
    whole = [t for part in reversed_search.terms(text) for t in part]
    monkeypatch.setattr(reversed_search, "PIECE", 11)
    assert [t for part in reversed_search.terms(text) for t in part] == whole


def test_scores_beyond_exact_doubles():
    from logweave.llm.reversed_search import Index, _added

    index = Index([b"a b", b"b"])
    t, own = np.array([0, 1, 1]), np.array([2**60 + 1, 3, 5])
    got = _added(index, np.ones(2, np.int64), False, 2, np.array([0, 0, 1]), t, own)
    assert got.tolist() == [[2**60 + 4, 3], [5, 5]]


# ------------------------------------------------------------------ 13 toxicity


def test_grammar_marks_clauses():
    from logweave.llm.toxicity import DIRECTED, INSULT, NEGATED, REPORTED, THREAT, Grammar, Lexicon, clause_hits, learn_lexicon

    lexicon = learn_lexicon({}, 0, 0)
    assert isinstance(lexicon, Lexicon)
    marks = lambda text: [s for _, h in [clause_hits(text, lexicon, Grammar())] for s, _, _ in h]
    assert marks("What an idiot") == [INSULT]
    assert marks("You are an idiot.") == [INSULT | DIRECTED] and marks("idiot, that is what you are") == [INSULT | DIRECTED]
    assert marks("this is not a stupid idea") == [INSULT | NEGATED] and marks("Don't be stupid") == [INSULT | NEGATED]
    assert marks("not today. stupid") == [INSULT]  # a clause ends the reach of negation
    assert marks("not one two three stupid") == [INSULT]
    assert marks('it said "stupid"') == [INSULT | REPORTED] and marks("it said so. stupid") == [INSULT]
    assert marks("they wrote that you are not stupid") == [INSULT | REPORTED | DIRECTED | NEGATED]
    assert marks("I will hurt you") == [THREAT | DIRECTED] and marks("shoes that hurt") == []
    assert marks("l'idiot") == [INSULT] and marks("") == [] and marks("...") == []
    weighted = Grammar(directed=0.5, negated=-1.0, reported=-2.0)
    assert clause_hits("they wrote that you are not stupid", lexicon, weighted)[1][0][2] == pytest.approx(-2.5)


def test_composition_runs_one_after_the_other():
    from logweave.llm.toxicity import DIRECTED, NEGATED, NEGATION, REPORT, REPORTED, SYMBOLS, TARGET, compose, context

    a, b, c = context(NEGATION, 3, NEGATED, -1.0), context(REPORT, None, REPORTED, 0.25), context(TARGET, 2, DIRECTED, 2.0)
    joined = compose(compose(a, b), c)
    r = random.Random(1)
    for _ in range(200):
        word = [r.choice(SYMBOLS) for _ in range(r.randint(0, 12))]
        one, w1 = a.run(word)
        two, w2 = b.run(one)
        three, w3 = c.run(two)
        out, w = joined.run(word)
        assert out == three and w == pytest.approx([x + y + z for x, y, z in zip(w1, w2, w3)])


def test_stems_account_for_their_words_once():
    from logweave.llm.toxicity import INSULT, learn_lexicon

    counts = {"zorba$": (40, 0), "zorb": (95, 1), "zor": (100, 60), "vexi$": (30, 160), "vex": (30, 160), "zorbil$": (4, 0)}
    lexicon = learn_lexicon(counts, 200, 1000)
    assert lexicon["zorba"][0] == INSULT and lexicon["zorbenu"][0] == INSULT and lexicon["zoran"][0] != INSULT and lexicon["vexi"][0] != INSULT


def test_pieces_end_with_clauses(monkeypatch):
    from logweave.llm import toxicity

    text = "You are an idiot. " * 50 + "not a clown; said she: loser\n" * 40 + "word " * 300
    lexicon = toxicity.learn_lexicon({}, 0, 0)
    whole = toxicity.clause_hits(text, lexicon, toxicity.Grammar())
    monkeypatch.setattr(toxicity.pieces, "__defaults__", (37,))
    assert toxicity.clause_hits(text, lexicon, toxicity.Grammar()) == whole and len(whole[1]) == 130


def test_toxicity_of_held_out_rows(spark):
    from logweave.llm.toxicity import toxicity_report

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity_report(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    seen = out.join(labels, "doc_id").where("held_out and toxic is not null").toPandas()
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    toxic, clean = seen[seen.toxic == 1], seen[seen.toxic == 0]
    assert len(toxic) > 100 and toxic.predicted.mean() > 0.9 and clean.predicted.mean() < 0.005
    assert ((seen.score >= 0.7) == (seen.predicted == 1)).all() and seen.score.between(0, 1).all()


def test_toxicity_of_awkward_rows(spark):
    from logweave.llm.toxicity import toxicity_report

    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [(i, prose(40) + (" zorbling flumped " if i % 4 == 0 else " "), "en", "s") for i in range(400)]
    rows += [(1000, None, "en", "s"), (1001, "", None, None), (1002, " ... ", "en", "s"), (None, "you idiot", "en", "s"), (1003, "ok. " * 60_000 + "idiot scum", "en", "s"), (5, rows[5][1], "en", "s"), (1004, "zorbling zorbling", "xx", "q")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(0, 0, 0), (1, 1, None), (9999, 1, 1), (None, 1, 1), (2, 1, 7)], "doc_id bigint, quality int, toxic int")
    clash = [F.lit("x").alias(c) for c in ("toxic", "_d", "u", "r", "score", "held_out", "_t", "key", "n", "e")]
    out = toxicity_report(docs.select("*", *clash), labels.select("*", F.lit("y").alias("text"), F.lit("y").alias("u"))).toPandas()
    assert len(out) == len(rows) and out.columns.tolist() == ["doc_id", "held_out", "score", "predicted", "n_hits"]
    by = out.set_index("doc_id")
    known = out[out.doc_id.notna() & (out.doc_id < 400)]
    held = known[known.held_out]
    assert (held.predicted == (held.doc_id % 4 == 0)).all() and len(held) > 80
    assert by.loc[1000, "score"] == by.loc[1001, "score"] == by.loc[1002, "score"] < 0.7 and by.loc[1003, "n_hits"] == 2 and by.loc[1004, "predicted"] == 1
    assert not out[out.doc_id.isna()].held_out.any()
    nothing = toxicity_report(docs, labels.limit(0)).toPandas()
    assert len(nothing) == len(rows) and nothing[nothing.doc_id.isna()].n_hits.iloc[0] == 1
    assert toxicity_report(docs.limit(0), labels).count() == 0
