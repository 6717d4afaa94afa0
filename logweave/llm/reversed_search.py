"""Ranked lexical search the other way round: documents stream through an index of the queries.

The items' terms are few next to the documents, so the inverted index is of the items: it goes to all workers, in blocks of
bounded size. One pass takes the terms of every document apart and keeps, of each, its length and the counts of the terms that
some item holds. From these come the documents' frequencies and the weights; then each task streams its documents' counts through
the postings, adds up scores for the items, and keeps a heap of the best documents of each item. Heaps are merged in two levels.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, cut, ship

#: A term in UTF-8: ASCII letters and digits, and every character beyond ASCII.
TERM, BREAK = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are taken apart at once; bytes of items' texts of one index; scores and postings held at once.
PIECE, INDEX_BYTES, AT_ONCE = 4 << 20, 8 << 20, 2_000_000
#: Least number of parts in which heaps meet before the last merge.
PARTS = 32


def terms(text: bytes):
    """All terms of a text in lists, A-Z in lower case; a long text in pieces that end between terms."""
    text, at = text.lower(), 0  # bytes.lower changes ASCII letters only
    while at < len(text):
        found = BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        stop = found.start() if found else len(text)
        yield TERM.findall(text, at, stop)
        at = stop


class Index:
    """Terms of some items: a number for each term, and the items of each number (postings[starts[t] : starts[t + 1]])."""

    def __init__(self, texts: list[bytes | None]):
        self.items = len(texts)
        of: dict[bytes, list[int]] = {}
        for i, text in enumerate(texts):
            for term in {t for part in terms(text or b"") for t in part}:
                of.setdefault(term, []).append(i)
        self.number = {t: k for k, t in enumerate(sorted(of))}
        held = [of[t] for t in sorted(of)]
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
        self.postings = np.array([i for x in held for i in x], np.int64)


def count_terms(docs: DataFrame, sent) -> DataFrame:
    """_id, n (terms with repeats), t and tf (numbers of indexed terms and their counts, packed) of each document with a term."""

    def run(batches):
        number = sent.value.number
        for b in batches:
            n, ids, tfs = [], [], []
            for text in as_bytes(b.column(1)):
                count, own = 0, Counter()
                for part in terms(text or b""):
                    count += len(part)
                    own.update(filter(number.__contains__, part))
                n.append(count)
                ids.append(np.array([number[t] for t in own], np.int32).tobytes())
                tfs.append(np.array(list(own.values()), np.int64).tobytes())
            keep = pa.array(np.array(n) > 0, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], ["_id", "n", "t", "tf"]).filter(keep)

    return docs.select("_id", "_text").mapInArrow(run, "_id bigint, n bigint, t binary, tf binary")


def frequencies(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents that hold each indexed term): as many numbers as the index has terms."""

    def run(batches):
        n, length, df = 0, 0, np.zeros(size, np.int64)
        for b in batches:
            n, length = n + b.num_rows, length + sum(b.column(0).to_pylist())
            df += np.bincount(np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, length, *df[at].tolist()], pa.int64())], ["k", "v"])

    rows = counts.select("n", "t").mapInArrow(run, "k bigint, v bigint").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    df = np.zeros(size + 2, np.int64)
    df[rows.column("k").to_numpy()] = rows.column("v").to_numpy()  # the last two are the totals
    return int(df[-2]), int(df[-1]), df[:size]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Heaps:
    """The k best documents of each item so far, ties by ascending id, rows without an id last."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.item = self.doc = self.score = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.least = np.ones(items, np.int64)  # scores below this are of no use

    def update(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        d, i = np.nonzero(scores >= self.least)
        if not len(d):
            return
        item, doc = np.concatenate([self.item, i]), np.concatenate([self.doc, docs[d]])
        score, none = np.concatenate([self.score, scores[d, i]]), np.concatenate([self.null, null[d]])
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.k]
        self.item, self.doc, self.score, self.null = item[rank < self.k], doc[keep], score[keep], none[keep]
        full = np.flatnonzero(rank == self.k - 1)
        self.least[item[full]] = score[order][full]


def _added(index: Index, w: np.ndarray, exact: bool, docs: int, doc: np.ndarray, t: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Scores (documents, items) from terms t of documents doc, each worth `own`, through the postings; in whole numbers."""
    out = np.zeros(docs * index.items, np.int64)
    each = index.starts[t + 1] - index.starts[t]
    stops = np.cumsum(each)
    lo = 0
    while lo < len(t):
        hi = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        n = each[lo:hi]
        at = np.repeat(index.starts[t[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(doc[lo:hi] * index.items, n) + index.postings[at]
        if exact:  # doubles hold these sums exactly
            out += np.bincount(key, weights=np.repeat(own[lo:hi], n).astype(np.float64), minlength=len(out)).astype(np.int64)
        else:
            np.add.at(out, key, np.repeat(own[lo:hi], n))
        lo = hi
    return out.reshape(docs, index.items)


def best_of_tasks(counts: DataFrame, sent, n_docs: int, length: int, w: np.ndarray, k: int) -> DataFrame:
    """_item, _id, score: of each task the k best documents of each item."""
    index = sent.value
    worth = np.zeros(index.items, np.float64)
    np.add.at(worth, index.postings, np.repeat(w, np.diff(index.starts)).astype(np.float64))
    exact = bool(worth.max(initial=0) * 1e6 < 2**52)
    few = max(1, AT_ONCE // max(1, index.items))
    sent_w = counts.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        index, w = sent.value, sent_w.value
        heaps = Heaps(index.items, k)
        for b in batches:
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            m = np.array([10 + 90 * n * n_docs // length for n in b.column(1).to_pylist()], np.int64)
            t, tf = b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo in range(0, len(ids), few):
                hi = min(lo + few, len(ids))
                n = [len(x) // 4 for x in t[lo:hi]]
                doc = np.repeat(np.arange(hi - lo), n)
                tt, f = np.frombuffer(b"".join(t[lo:hi]), np.int32).astype(np.int64), np.frombuffer(b"".join(tf[lo:hi]), np.int64)
                own = w[tt] * (1_000_000_000 * f // (1000 * f + 8 * m[lo:hi][doc]))
                heaps.update(_added(index, w, exact, hi - lo, doc, tt, own), ids[lo:hi], null[lo:hi])
        if len(heaps.item):
            doc = pa.array(heaps.doc, mask=heaps.null)
            yield pa.RecordBatch.from_arrays([pa.array(heaps.item), doc, pa.array(heaps.score)], ["_item", "_id", "score"])

    return counts.mapInArrow(run, "_item bigint, _id bigint, score bigint")


def merge(heaps: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with their rank: parts of the tasks first, then all."""
    order = [F.desc("score"), F.asc_nulls_last("_id")]
    part = heaps.withColumn("_part", F.spark_partition_id() % F.lit(PARTS))
    part = part.withColumn("rank", F.row_number().over(W.partitionBy("_item", "_part").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    return part.withColumn("rank", F.row_number().over(W.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= k).drop("_part")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", most_bytes: int = INDEX_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0, equal scores by ascending id.

    Null texts and texts without a term are no documents, and items without a term have no rows. Rows are ranked for themselves:
    a repeated document stands at several ranks. Items with one text are searched once and get their ranks each. Documents without
    an id come last among equal scores. Texts of any length are read whole. Ids are integers. An empty table on either side gives
    no rows. Other columns are left out, whatever their names. Items beyond `most_bytes` of text are searched in blocks, each with
    its own pass.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("_id"), F.col(f"`{text}`").alias("_text"))
    asked = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").alias("_text")).where(F.col("_text").isNotNull())
    texts = asked.select("_text").distinct()
    total = texts.agg(F.sum(F.octet_length("_text") + 64).cast("bigint").alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // most_bytes))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == block).toArrow()  # about most_bytes
        index = Index(as_bytes(own.column("_text").combine_chunks()))
        if not index.number:
            continue
        sent = spark.sparkContext.broadcast(index)
        counts = cut(count_terms(d, sent))
        n_docs, length, df = frequencies(counts, len(index.number))
        if not n_docs:
            return out
        names = spark.createDataFrame(own.append_column("_item", pa.array(range(own.num_rows), pa.int64())))
        found = merge(best_of_tasks(counts, sent, n_docs, length, weights(n_docs, df), k), k).join(asked.join(F.broadcast(names), "_text").select("_item", "item_id"), "_item")
        out = out.unionByName(found.select("item_id", "rank", F.col("_id").alias("doc_id"), "score"))
    return out
