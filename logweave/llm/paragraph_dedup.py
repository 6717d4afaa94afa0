"""Substring deduplication by paragraph MinHash banding.

Paragraphs are the lines of a text with at least `min_words` words, lower-cased (A-Z) and with single blanks. Exact copies are
folded first by a 128-bit hash. Each distinct paragraph then has `bands` band keys of `rows` MinHash values over its five-word
shingles; with 16 bands of 4, a pair of Jaccard similarity 0.8 shares a key with probability 0.9998, a pair of 0.9 with
1 - 2e-8. Paragraphs that share a key are verified by the exact Jaccard similarity of their shingle sets, and linked at
`threshold` or more; removals go by connected components.

A passage may also stand inside longer lines or run over short ones, where no line matches as a whole. So windows of `min_words`
words are picked by winnowing: of every REACH windows that start at successive words the one with the least hash. The choice
depends on the words alone, whatever stands around them, so two documents that share min_words + REACH - 1 words in a row
(50) share a picked window. A picked window together with the next one is a second item: where both documents go on alike,
the words between two picks are covered too. Items are compared by 128-bit hashes, exactly.

No bucket is cut. A bucket is dealt out as pairs of blocks, so that a task holds two blocks at most, and within one only a
spanning forest of the verified links is emitted. Buckets with the same members in several bands are verified once. Shingle
sets are made only for paragraphs that share a key with another.

Documents are told apart by doc_id, and where it is null by a hash of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bloom, cut, few, ship, slabs
from .components import connected_components
from .jaccard import block_pairs, shingle_hashes, verified_links

BANDS, ROWS = 16, 4
#: Successive starts of which one window is picked.
REACH = 31
_RNG = np.random.default_rng(20240101)
_A = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Factors of the words of a shingle, by place.
_PLACES = _RNG.integers(1 << 62, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
#: Odd bases of two polynomial hashes over the words of a window, and their inverses modulo 2^64.
_BASES = [int(x) | 1 for x in _RNG.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]
#: Masks of the first bytes of eight, and the bytes up to which words are hashed together.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG_WORD = 64


def _document() -> Column:
    """What tells documents apart: a hash of the id, or of the text where there is none."""
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit("id"), "doc_id")), F.xxhash64(F.lit("text"), "text")).alias("doc")


def paragraphs(text: bytes | None, min_words: int):
    """(paragraph number, start, stop, words): lines with enough words; offsets in code points."""
    at = 0
    for i, line in enumerate(text.split(b"\n") if text else []):
        size = len(line) if line.isascii() else len(line.decode("utf-8", "replace"))
        words = line.lower().split()
        if len(words) >= min_words:
            yield i, at, at + size, words
        at += size + 1


def _stir(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit counts for every other."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _PLACES[0]
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each word, its 64-bit hash), eight bytes of all words at a time; words of over LONG_WORD bytes by XXH3."""
    raw = np.frombuffer(text, np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    begin, stop = edges[::2], edges[1::2]
    size = stop - begin
    hashes = size.astype(np.uint64) * _MIX
    if not len(size):
        return begin, hashes
    eight = np.ndarray(len(raw), "<u8", text + bytes(8), strides=(1,))
    for k in range(0, min(int(size.max()), LONG_WORD), 8):
        rows = np.flatnonzero(size > k) if k else slice(None)
        block = eight[begin[rows] + k] & _FIRST[np.minimum(size[rows] - k, 8)]
        hashes[rows] = _stir(hashes[rows] ^ block)
    for i in np.flatnonzero(size > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(text[begin[i] : stop[i]])
    return begin, hashes


def flat_shingles(words: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of sets of words, back to back; shingles of each set) from 64-bit hashes of the words: a sum with a factor for each place, mixed. A set of fewer words is one shingle."""
    begin = np.cumsum(sizes) - sizes
    short = np.flatnonzero(sizes < width)
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        total[: len(words) - k] += words[k:] * _PLACES[k]
    for i in short:  # without the words of the next set
        own = words[begin[i] : begin[i] + sizes[i]]
        total[begin[i]] = (own * _PLACES[: len(own)]).sum(dtype=np.uint64)
    n = np.maximum(sizes - width + 1, 1)
    hashes = total[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return hashes ^ (hashes >> np.uint64(29)), n


def band_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Band keys of sets of shingle hashes, back to back: a row for each set. Repeated hashes change nothing."""
    low = np.empty((BANDS * ROWS, len(sizes)), np.uint32)
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    a, b = _A[:, None], _B[:, None]
    at = 0
    for lo, hi in slabs(sizes.tolist(), 8192):  # some at a time: the products of very long texts would fill the memory
        stop = at + int(sizes[lo:hi].sum())
        if hi - lo == 1:
            low[:, lo] = np.min([(hashes[i : min(i + 8192, stop)] * a + b).min(axis=1) for i in range(at, stop, 8192)], axis=0)
        else:
            starts = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
            low[:, lo:hi] = np.minimum.reduceat(hashes[at:stop] * a + b, starts, axis=1)
        at = stop
    key = np.zeros((BANDS, len(sizes)), np.uint64)
    for r in range(ROWS):
        key = (key ^ low[r::ROWS]) * _MIX
        key ^= key >> np.uint64(29)
    # 32 bits: half the bytes in shuffles, which compress zeros; a chance collision is one more pair to verify
    return (key >> np.uint64(32)).view(np.int64).T


def _paragraph_rows(docs: DataFrame, min_words: int, width: int) -> DataFrame:
    names = ["doc_id", "doc", "para", "start", "stop", "n_words", "h1", "h2", *[f"b{i}" for i in range(BANDS)]]

    def run(batches):
        for b in batches:
            at, nums, marks, raw, held = [], [], [], [], 0
            keys = [np.zeros((0, BANDS), np.int64)]

            def add_keys(raw=raw, nums=nums, keys=keys):
                words = word_hashes(b"\n".join(raw))[1]
                keys.append(band_keys(*flat_shingles(words, np.array([x[3] for x in nums[-len(raw) :]], np.int64), width)))
                raw.clear()

            for i, t in enumerate(as_bytes(b.column(2))):
                for no, start, stop, words in paragraphs(t, min_words):
                    at.append(i)
                    nums.append((no, start, stop, len(words)))
                    raw.append(b" ".join(words))
                    marks.append(xxhash.xxh3_128_digest(raw[-1]))
                    held += len(words)
                    if held > 500_000:  # what is held of long texts stays small
                        add_keys()
                        held = 0
            if raw:
                add_keys()
            n = len(at)
            table = np.array(nums, np.int64).reshape(n, 4)
            marked = np.frombuffer(b"".join(marks), ">i8").astype(np.int64).reshape(n, 2)
            key = np.concatenate(keys)
            took = pa.array(at, pa.int64())
            cols = [b.column(0).take(took), b.column(1).take(took), *[pa.array(table[:, j]) for j in range(4)], pa.array(marked[:, 0]), pa.array(marked[:, 1]), *[pa.array(key[:, j]) for j in range(BANDS)]]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])
    return docs.select("doc_id", _document(), "text").mapInArrow(run, schema)


def _windows(words: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Items of texts: (text, first word, word after the last, hash, second hash).

    words: 64-bit hashes of the words of all texts, back to back; sizes: words of each text. Texts under `width` words have none.
    Each text is laid out with room for one whole choice, so that texts do not see each other.
    """
    room = np.maximum(sizes, width + REACH - 1)
    begin = np.cumsum(room) - room
    own = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(words))
    flat = np.zeros(int(room.sum()), np.uint64)
    flat[own] = words
    total = len(flat)
    if not len(words) or total < width:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    sums, shift = [], []
    for base, inverse, mix in zip(_BASES, _INVERSES, (1, 29), strict=True):
        w = flat ^ (flat >> np.uint64(mix))
        power = np.full(total, base, np.uint64)
        power[0] = 1
        back = np.full(total, inverse, np.uint64)
        back[0] = 1
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * np.multiply.accumulate(power))]))
        shift.append(np.multiply.accumulate(back))

    def item(at, stop, i):
        x = (sums[i][stop] - sums[i][at]) * shift[i][at]
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return (x ^ (x >> np.uint64(29))).view(np.int64)

    starts = np.arange(total - width + 1)
    text = np.repeat(np.arange(len(sizes)), room)[: len(starts)]
    order = item(starts, starts + width, 0).view(np.uint64) >> np.uint64(1)
    valid = starts + width <= (begin + sizes)[text]
    order = np.where(valid, order, ~np.uint64(0))  # never the least
    # least of REACH starts from each on, by doubling; then the largest of these over the choices that see a start
    least, reach = order, 1
    while reach < REACH:
        step = min(reach, REACH - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    choice = np.arange(len(least))
    inside = choice + REACH + width - 1 <= (begin + room)[text[: len(choice)]]
    least = np.where(inside, least, np.uint64(0))
    most = np.concatenate([np.zeros(REACH - 1, np.uint64), least, np.zeros(len(starts) - len(least), np.uint64)])
    seen, reach = most, 1
    while reach < REACH:
        step = min(reach, REACH - reach)
        seen = np.maximum(seen[: len(seen) - step], seen[step:])
        reach += step
    seen = np.concatenate([seen, np.zeros(len(starts) - len(seen), np.uint64)])[: len(starts)]
    at = np.flatnonzero(valid & (order == seen))
    doc = text[at]
    follow = np.flatnonzero(doc[1:] == doc[:-1]) if len(at) else np.zeros(0, np.int64)
    first, stop = np.concatenate([at, at[follow]]), np.concatenate([at + width, at[follow + 1] + width])
    who = np.concatenate([doc, doc[follow]])
    return who, first - begin[who], stop - begin[who], item(first, stop, 0), item(first, stop, 1)


def _items(texts: list[bytes | None], width: int):
    """The items of texts, some at a time: (index of the first text, text, first word, word after the last, hashes)."""
    for lo, hi in slabs([len(t or b"") + 200 for t in texts], 1_500_000):
        raw = b"\n".join([t or b"" for t in texts[lo:hi]]).lower()
        begin, words = word_hashes(raw)
        starts = np.cumsum([0, *[len(t or b"") + 1 for t in texts[lo:hi]]])
        yield lo, *_windows(words, np.diff(np.searchsorted(begin, starts)), width)


def _passage_digests(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, doc, h1, h2) of the items."""

    def run(batches):
        for b in batches:
            for lo, who, _, _, h1, h2 in _items(as_bytes(b.column(2)), min_words):
                took = pa.array(lo + who)
                yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), pa.array(h1), pa.array(h2)], ["doc_id", "doc", "h1", "h2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _document(), "text").mapInArrow(run, f"doc_id {kind}, doc bigint, h1 bigint, h2 bigint")


def _passage_rows(docs: DataFrame, min_words: int, sieve) -> DataFrame:
    """The items that pass the filter, with their places in the text: line, last line, start and stop in code points, words."""
    names = ["doc_id", "doc", "para", "end_para", "start", "stop", "n_words", "h1", "h2"]

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(2))
            at, places = [], [np.zeros((7, 0), np.int64)]
            for lo, who, first, stop, h1, h2 in _items(texts, min_words):
                some = np.flatnonzero(sieve.value.may_hold(h1))
                some = some[np.argsort(who[some], kind="stable")]
                edges = np.flatnonzero(np.concatenate([[True], who[some][1:] != who[some][:-1]])) if len(some) else []
                for i, e in enumerate(edges):
                    own = some[e : edges[i + 1] if i + 1 < len(edges) else len(some)]
                    raw = np.frombuffer(texts[lo + int(who[own[0]])], np.uint8)
                    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
                    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
                    finishes = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
                    x, y = begins[first[own]], finishes[stop[own] - 1]
                    breaks, points = np.flatnonzero(raw == 10), np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    places.append(np.stack([np.searchsorted(breaks, x), np.searchsorted(breaks, y), points[x], points[y], stop[own] - first[own], h1[own], h2[own]]))
                    at.append(lo + who[own])
            cols = np.concatenate(places, axis=1).astype(np.int64)
            took = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), *[pa.array(c) for c in cols]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _document(), "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))


def _repeated_items(docs: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2, copies, low, d_low) of the items that more than one document holds."""
    ship(docs.sparkSession)
    seen = _passage_digests(docs, min_words).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.min("doc").alias("d_low"), F.max("doc").alias("d_high"))
    return cut(seen.where("d_low <> d_high").select("h1", "h2", "copies", "low", "d_low"))


def _sweep(rows: list[dict]):
    """Spans of one document: (para, start, stop, n_words, class_id, n_paragraphs, removed).

    Items that hold the copy which stays are kept, whatever else covers them; the rest of the other items goes; lines are left out.
    """
    starts = np.array([r["start"] for r in rows])
    stops = np.array([r["stop"] for r in rows])
    kind = np.array([2 if r["line"] else int(r["removed"]) for r in rows])
    points = np.unique(np.concatenate([starts, stops]))
    line_of = {r["stop"]: r["end_para"] for r in rows} | {r["start"]: r["para"] for r in rows}
    cover = np.zeros((3, len(points)), np.int64)
    np.add.at(cover, (kind, np.searchsorted(points, starts)), 1)
    np.add.at(cover, (kind, np.searchsorted(points, stops)), -1)
    kept, gone, line = cover.cumsum(axis=1) > 0
    label = np.where(line, 0, np.where(kept, 1, np.where(gone, 2, 0)))
    edges = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist()]
    line_stops = {r["stop"] for r in rows if r["line"]}
    for i, lo in enumerate(edges[:-1]):
        if not label[lo]:
            continue
        start, stop = int(points[lo]), int(points[edges[i + 1]])
        after = start in line_stops  # a newline parts it from the line before
        own = np.flatnonzero((starts < stop) & (stops > start) & (kind == label[lo] - 1))
        if start + after < stop:
            yield line_of[start] + after, start + after, stop, max(rows[j]["n_words"] for j in own), min((rows[j]["low"] for j in own if rows[j]["low"] is not None), default=None), max(rows[j]["copies"] for j in own), bool(label[lo] == 2)


def _spans(windows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Windows of a document put together to spans outside its lines."""
    rows = windows.withColumn("line", F.lit(False))
    if lines is not None:
        rows = cut(rows)
        flagged = lines.join(rows.select("doc").distinct(), "doc", "left_semi").select("doc_id", "doc", "para", F.col("para").alias("end_para"), "start", "stop", F.lit(True).alias("line"))
        rows = rows.unionByName(flagged, allowMissingColumns=True)
    kind = windows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, para bigint, start bigint, stop bigint, n_words bigint, class_id {kind}, n_paragraphs bigint, removed boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held: list[dict] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held and held[0]["doc"] != r["doc"]:
                    out += [(held[0]["doc_id"], *x) for x in _sweep(held)]
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([(n, b.schema.field("low" if n in ("doc_id", "class_id") else "removed" if n == "removed" else "start").type) for n in names]))
            types = b.schema
        if held:
            rest = [dict(zip(names, (held[0]["doc_id"], *x), strict=True)) for x in _sweep(held)]
            yield pa.RecordBatch.from_pylist(rest, pa.schema([(n, types.field("low" if n in ("doc_id", "class_id") else "removed" if n == "removed" else "start").type) for n in names]))

    return rows.repartition("doc").sortWithinPartitions("doc", "start").mapInArrow(run, schema)


def _judged(docs: DataFrame, min_words: int, lines: DataFrame | None = None) -> DataFrame:
    """Repeated items with their places and removed: all but the copies in one document go. That is the first by id of those that hold the item clear of removed lines."""
    repeated = _repeated_items(docs, min_words)
    places = _passage_rows(docs, min_words, bloom(repeated.select("h1"), "h1"))
    if lines is None:
        found = places.join(repeated, ["h1", "h2"])
        first = F.when(F.col("low").isNull(), F.col("doc") == F.col("d_low")).otherwise(F.col("doc_id").eqNullSafe(F.col("low")))
        return found.withColumn("removed", ~first).drop("h1", "h2", "d_low")
    flagged = lines.groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "removed")).alias("cuts")).withColumnRenamed("doc", "_doc")
    found = places.join(flagged, F.col("doc") == F.col("_doc"), "left")
    within = lambda x: (x["start"] <= F.col("start")) & (x["stop"] >= F.col("stop"))
    some = lambda f: F.coalesce(F.exists("cuts", f), F.lit(False))
    # what lies in a removed line whole is gone with it; what lies in another line whole only counts as a copy
    found = found.where(~some(lambda x: x["removed"] & within(x))).withColumn("inside", some(within))
    found = found.withColumn("touched", some(lambda x: x["removed"] & (x["start"] < F.col("stop")) & (x["stop"] > F.col("start")))).drop("_doc", "cuts")
    found = cut(found.join(repeated, ["h1", "h2"]))
    stays = cut(found.where("not touched").groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.min("doc").alias("d_keeper"), F.lit(True).alias("some")))
    # where a removed line cuts into every copy, the first by id stays as far as it lies outside
    marked = found.where("not inside").join(stays, ["h1", "h2"], "left")
    keeper, d_keeper = (F.when(F.col("some"), F.col(x)).otherwise(F.col(y)) for x, y in (("keeper", "low"), ("d_keeper", "d_low")))
    first = F.when(keeper.isNull(), F.col("doc") == d_keeper).otherwise(F.col("doc_id").eqNullSafe(keeper))
    return marked.withColumn("removed", ~first).drop("h1", "h2", "d_low", "keeper", "d_keeper", "some", "touched", "inside")


def repeated_passages(docs: DataFrame, min_words: int) -> DataFrame:
    """Spans that another document holds word for word: doc_id, para, start, stop, n_words, class_id, n_paragraphs, removed.

    Items are merged where they overlap and agree in removed: an item stays whole in the smallest id that holds it. class_id is
    the smallest id that holds one of the items, n_words the words of the longest item, n_paragraphs its copies. Null and short
    texts have no spans. Documents without an id take part, told apart by their texts; a repeated row is no other document. An
    empty table gives no rows.
    """
    return _spans(_judged(docs, min_words))


def _shared_keys(batches):
    """Of rows (band, key, pid) sorted by band and key, those whose key occurs with another pid as well."""
    held = None  # last row of the batch before, and whether it has been emitted
    for b in batches:
        band, key, pid = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        out = False
        if held is not None:
            band, key, pid = (np.concatenate([[h], x]) for h, x in zip(held[:3], (band, key, pid), strict=True))
            out = held[3]
        same = (band[1:] == band[:-1]) & (key[1:] == key[:-1])
        take = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        emit = take.copy()
        if out:
            emit[0] = False
        emitted_last = bool(take[-1]) or (out and len(key) == 1)
        held = (band[-1], key[-1], pid[-1], emitted_last)
        if emit.any():
            yield pa.RecordBatch.from_arrays([pa.array(band[emit].astype(np.int64)), pa.array(key[emit]), pa.array(pid[emit])], ["band", "key", "pid"])


def _shingle_sets(docs: DataFrame, wanted: DataFrame, min_words: int, width: int) -> DataFrame:
    """(pid, shingles) of the wanted paragraphs (pid, h1, h2, doc), read again from one document that holds each."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2", "pid")).alias("want")).withColumnRenamed("doc", "_d")
    near = docs.select(_document(), "text").join(lists, F.col("doc") == F.col("_d")).select("text", "want")

    def run(batches):
        for b in batches:
            pids, sets = [], []
            for t, want in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                by = {(w["h1"], w["h2"]): w["pid"] for w in want}
                for _, _, _, words in paragraphs(t, min_words):
                    h = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), ">i8")
                    pid = by.pop((int(h[0]), int(h[1])), None)
                    if pid is not None:
                        pids.append(pid)
                        sets.append(shingle_hashes(words, width).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["pid", "shingles"])

    return near.mapInArrow(run, "pid bigint, shingles array<bigint>").dropDuplicates(["pid"])


def repeated_text(docs: DataFrame, min_words: int = 20, **options) -> DataFrame:
    """repeated_paragraphs(), and what repeated passages cover outside these lines; kind tells which (paragraph or passage).

    Of every repeated stretch one copy stays: an item's copy inside a removed line does not count as the one that stays. Nulls,
    repeated rows and empty tables: as in these two.
    """
    lines = cut(_repeated_lines(docs, min_words, **options))
    rest = _spans(_judged(docs, min_words, lines), lines)
    return lines.drop("doc").withColumn("kind", F.lit("paragraph")).unionByName(rest.withColumn("kind", F.lit("passage")))


def repeated_paragraphs(docs: DataFrame, min_words: int = 20, threshold: float = 0.8, width: int = 5, block_words: int = 150_000) -> DataFrame:
    """One row per paragraph that another document holds as well, exactly or nearly.

    doc_id, para (line number from 0), start, stop (code points), n_words, class_id (smallest doc_id of the class), n_paragraphs
    of the class, removed (all but the first of a class by doc_id and line). A class is a connected component of links.
    Null or short texts have no paragraphs and no rows. Paragraphs that repeat within one document only are left alone.
    Documents without an id take part, told apart by their texts, but name a class only if it has no other. A repeated row is
    a copy under the same id: with no other document it makes no class. An empty table gives no rows. Other columns are not
    read.
    """
    return _repeated_lines(docs, min_words, threshold, width, block_words).drop("doc")


def _repeated_lines(docs: DataFrame, min_words: int, threshold: float = 0.8, width: int = 5, block_words: int = 150_000) -> DataFrame:
    ship(docs.sparkSession)
    rows = cut(_paragraph_rows(docs, min_words, width))
    distinct = rows.groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.min("doc").alias("d_low"), F.max("doc").alias("d_high"), F.max("n_words").alias("n_words"), *[F.max(f"b{i}").alias(f"b{i}") for i in range(BANDS)]
    )
    distinct = cut(distinct.withColumn("pid", F.monotonically_increasing_id()))
    keyed = distinct.select("pid", F.posexplode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("band", "key"))
    dealt = keyed.select(F.col("band").cast("bigint").alias("band"), "key", "pid").repartition("band", "key").sortWithinPartitions("band", "key")
    members = cut(dealt.mapInArrow(_shared_keys, "band bigint, key bigint, pid bigint"))
    # the same members in several bands: one bucket is enough
    mark = F.xxhash64(F.lit(1), "pid"), F.xxhash64(F.lit(2), "pid")
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.bit_xor(mark[0]).alias("x1"), F.bit_xor(mark[1]).alias("x2"))
    buckets = cut(buckets.groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("k")).select("k.band", "k.key"))
    own = members.join(buckets, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "pid")
    own = cut(own.join(distinct.select("pid", "h1", "h2", "d_low", "n_words"), "pid"))
    sizes = cut(own.groupBy("bucket").agg(F.sum("n_words").alias("size")))
    pairs = block_pairs(own.select("bucket", "pid").join(sizes, "bucket"), block_words)
    wanted = own.select("pid", "h1", "h2", F.col("d_low").alias("doc")).distinct()
    roots = connected_components(verified_links(pairs, _shingle_sets(docs, wanted, min_words, width), threshold))
    rooted = distinct.join(roots.withColumnRenamed("node", "pid"), "pid", "left").select("h1", "h2", "copies", "low", "d_low", "d_high", F.coalesce("root", "pid").alias("root"))
    size = distinct.count()
    rooted = cut(few(rooted, size))
    classes = rooted.groupBy("root").agg(F.sum("copies").alias("n_paragraphs"), F.min("low").alias("class_id"), F.min("d_low").alias("d_low"), F.max("d_high").alias("d_high"))
    classes = cut(few(classes.where("d_low <> d_high").select("root", "n_paragraphs", "class_id", F.col("d_low").alias("d_first")), size))
    labels = rooted.select("h1", "h2", "root").join(classes, "root")
    found = cut(rows.select("doc_id", "doc", "para", "start", "stop", "n_words", "h1", "h2").join(labels, ["h1", "h2"]).drop("h1", "h2"))
    # the copy that stays: the first line of the class in the document that names it, or without an id in its first document
    named = F.when(F.col("class_id").isNull(), F.col("doc") == F.col("d_first")).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = cut(found.where(named).groupBy("root").agg(F.min("para").alias("f_para")))
    kept = named & (F.col("para") == F.col("f_para"))
    return found.join(first, "root").select("doc_id", "doc", "para", "start", "stop", "n_words", "class_id", "n_paragraphs", (~kept).alias("removed"))
