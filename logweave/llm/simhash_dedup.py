"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are reduced to distinct values first, so exact copies cost nothing. Each bit position carries a nonzero vector
of F2^(r+1); the mask of a nonzero v keeps the bits whose vector has odd product with v. For any r differing positions some v
is orthogonal to all of their vectors, so the two fingerprints agree under that mask: no pair within the radius is lost.
A bucket over `bucket_rows` fingerprints is split once more by covering masks over the bits its mask leaves free. What agrees
under both masks has at most 16 free bits, hence at most 65,536 members: that bound holds for any input.
Inside a bucket a spanning forest of the verified links is emitted, not all pairs.

Near copies in the sense of shingle sets (five words, Jaccard similarity 0.8 or more) differ in about ten of 64 bits, too many for
one covering. keep_one() takes fingerprints of 128 bits in four blocks, each with a covering of radius 4: pairs within 19
bits surely share a bucket, those beyond it mostly. Candidates at 32 bits or fewer are verified by exact Jaccard similarity.
The pairs that fingerprints leave out are found by prefixes of the shingle sets, in one order for all: sets of similarity t share
a shingle among the first n - ceil(t n) + 1 of each. Only pairs that fingerprints have not linked are followed (prefix_links).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import written
from .common import as_bytes, bloom, cut, few, let_go, masked, ship
from .components import connected_components
from .jaccard import block_pairs, shingle_hashes, verified_links

BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """SimHash over word shingles, repeats included: a bit is set if it is set in over half of the XXH64 values."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= width:
        raw = digest(joined, seed)
        count = 1
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        first = (ends - lengths)[: n - width + 1].tolist()
        last = ends[width - 1 :].tolist()
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(first, last, strict=True)])
        count = n - width + 1
    table = np.frombuffer(raw, np.uint8).reshape(count, 8)
    sums = np.concatenate([np.bincount(table[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
    return int(np.packbits(2 * sums > count).view(">u8")[0])


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """2^(radius+1)-1 masks over the bit positions; any `radius` positions are left out together by one of them."""
    order = (1 << (radius + 1)) - 1
    vector = {p: i % order + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, order + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): one row per input row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            out = np.array([fingerprint(t, width, seed) for t in as_bytes(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within one bucket: each member is a frontier once, against those not yet reached."""
    left = fp.copy()
    a, b = [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), x))
                b.append(hit)
                frontier.extend(hit)
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(key: np.ndarray, fp: np.ndarray, radius: int, limit: int | None):
    """Links inside the runs of equal keys, and a flag for each row in a run over `limit`."""
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    hot = sizes > limit if limit else np.zeros(len(sizes), bool)
    a, b = [], []
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_of > 1) & (size_of <= 8))
    f, k = fp[small], key[small]
    for d in range(1, 8):
        if len(f) <= d:
            break
        ok = (k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius)
        a.append(f[:-d][ok])
        b.append(f[d:][ok])
    for s, n in zip(starts[(sizes > 8) & ~hot], sizes[(sizes > 8) & ~hot], strict=True):
        x, y = _forest(fp[s : s + n], radius)
        a.append(x)
        b.append(y)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none), np.repeat(hot, sizes)


def _bucket_job(radius: int, limit: int | None):
    """Over rows (mask, key, fp) sorted by mask and key: rows (a, b, mask) that are links, or with b null a member of a hot bucket."""

    def run(batches):
        def emit(mask, key, fp):
            ids = np.concatenate([[0], np.cumsum((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))])
            a, b, hot = _links(ids, fp, radius, limit)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.zeros(len(a), np.int32))], ["a", "b", "mask"]
                )
            if hot.any():
                m = fp[hot].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.nulls(len(m), pa.int64()), pa.array(mask[hot])], ["a", "b", "mask"])

        held: list = []
        rows = 0
        flooded = None
        for batch in batches:
            mask = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            if flooded is not None:  # the rest of a bucket that is already known as hot
                same = (mask == flooded[0]) & (key == flooded[1])
                n = int(same.argmin()) if not same.all() else len(same)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp[:n].view(np.int64)), pa.nulls(n, pa.int64()), pa.array(mask[:n])], ["a", "b", "mask"]
                    )
                mask, key, fp = mask[n:], key[n:], fp[n:]
                if not len(key):
                    continue
                flooded = None
            held.append((mask, key, fp))
            rows += len(key)
            mask, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            tail = int(last[-1]) + 1 if len(last) else 0
            if tail:
                yield from emit(mask[:tail], key[:tail], fp[:tail])
            held, rows = [(mask[tail:], key[tail:], fp[tail:])], len(key) - tail
            if limit and rows > limit:
                yield from emit(*held[0])
                flooded = (held[0][0][0], held[0][1][0])
                held, rows = [], 0
        if held:
            yield from emit(*held[0])

    return run


def near_links(fps: DataFrame, radius: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """(a, b): a spanning set of the links between distinct 64-bit values in column fp: each linked pair is joined by a path of links."""
    ship(fps.sparkSession)
    masks = covering_masks(list(range(BITS)), radius)
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = fps.select("fp", keyed.alias("k")).select("k.mask", "k.key", "fp")
    found = cut(rows.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_bucket_job(radius, bucket_rows), "a bigint, b bigint, mask int"))
    links = found.where("b is not null").select("a", "b")
    inner = []
    for m in masks:
        free = [p for p in range(BITS) if not m >> p & 1]
        inner.append([_signed(m | s) for s in covering_masks(free, radius)])
    deep = F.array(*[F.array(*[F.lit(x) for x in row]) for row in inner])
    hot = found.where("b is null").select(F.col("a").alias("fp"), "mask")
    again = hot.select("fp", "mask", F.posexplode(F.element_at(deep, F.col("mask") + 1)).alias("i", "m2")).select(
        (F.col("mask") * 100 + F.col("i")).alias("mask"), F.col("fp").bitwiseAND(F.col("m2")).alias("key"), "fp"
    )
    more = again.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_bucket_job(radius, None), "a bigint, b bigint, mask int")
    return links.unionByName(more.select("a", "b"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, seed: int = 42, bucket_rows: int = 4096
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links, its own included).

    Null or blank text: fingerprint zero, linked like any other. A text under `width` words is one shingle. Null ids keep their
    row and never name a component unless all of its ids are null. Repeated rows come back repeated. Empty table: no rows.
    Other columns are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width, seed))
    values = cut(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = connected_components(near_links(values.select("fp"), radius, bucket_rows))
    rooted = values.join(roots, values.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# ---------------------------------------------------------------- near copies by wide fingerprints and exact Jaccard

#: A wide fingerprint: two 64-bit words in blocks of 32 bits, each with its own covering of radius 4.
BLOCK_BITS, BLOCK_RADIUS = 32, 4
#: Fingerprints of a bucket held at once, and comparisons made in it, before it is split by further masks.
HELD_ROWS, COMPARISONS = 65_536, 100_000_000


def wide_masks() -> list[tuple[int, int]]:
    """Masks over both words: 31 for each block. Pairs within 4 * (4 + 1) - 1 = 19 bits differ in at most 4 bits of some block, so a mask of it leaves all of these out."""
    out = []
    for block in range(2 * BITS // BLOCK_BITS):
        at = block * BLOCK_BITS
        for m in covering_masks(list(range(at, at + BLOCK_BITS)), BLOCK_RADIUS):
            out.append((m & ((1 << BITS) - 1), m >> BITS))
    return out


def inner_masks(outer: tuple[int, int]) -> list[tuple[int, int]]:
    """The same over the bits that a mask leaves free, for what shares a hot bucket."""
    free = [p for p in range(2 * BITS) if not (outer[0] | outer[1] << BITS) >> p & 1]
    out = []
    for block in range(4):
        for m in covering_masks(free[block::4], BLOCK_RADIUS):
            out.append((m & ((1 << BITS) - 1), m >> BITS))
    return out


def wide_fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two words of SimHash over distinct 64-bit shingle hashes; none: zero."""
    out = []
    for word in range(2):
        h = shingles
        if word:  # a second 64 bits out of the first
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        sums = np.zeros(BITS, np.int64)
        for lo in range(0, len(h), 4096):
            sums += np.unpackbits(h[lo : lo + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * sums > len(h)).view(">u8")[0]))
    return out[0], out[1]


def _row_key(id_col: str, text_col: str) -> list:
    """A row's identity and its order: rows without an id last, then by id, then by a hash of the text."""
    return [F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")]


#: Columns by which rows of one identity meet, see _keyed.
ROW_KEY = ["h", "n", "k"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (n, id, h, ...) with the id as text in k, empty where it is null (n tells): by these, joins, windows and groups deal rows alike, so texts and sets move once."""
    return rows.withColumn("k", F.coalesce(F.col("id").cast("string"), F.lit("")))


def _wide_prints(rows: DataFrame, width: int) -> DataFrame:
    """(n, id, h, d1, d2, f1, f2, n_words) of rows (n, id, h, text): d is a digest of the words, f the fingerprint."""

    def run(batches):
        let_go()
        for b in batches:
            digests, prints, n_words = [], [], np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(as_bytes(b.column(3))):  # one text's words at a time
                words = t.lower().split() if t else []
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                prints.append(wide_fingerprint(shingle_hashes(words, width)) if words else (0, 0))
                n_words[i] = len(words)
            d = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(b.num_rows, 2)
            f = np.array(prints, np.uint64).reshape(b.num_rows, 2).view(np.int64)
            cols = [*b.columns[:3], pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(n_words)]
            yield pa.RecordBatch.from_arrays(cols, ["n", "id", "h", "d1", "d2", "f1", "f2", "n_words"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"n boolean, id {kind}, h bigint, d1 bigint, d2 bigint, f1 bigint, f2 bigint, n_words bigint")


def _wide_stars(fp: np.ndarray, who: np.ndarray, radius: int, budget: int):
    """Links (a, b) from the first member of each component to the others, and the members that are still to be compared if the budget did not do.

    Members come in ascending order of `who`, so a link goes to the component's smallest one.
    """
    rest = np.arange(len(fp))
    a, b = [], []
    spent = 0
    frontier: list[int] = []
    center = 0
    while len(rest):
        if not frontier:
            center, rest = int(rest[0]), rest[1:]
            frontier = [center]
        x = frontier.pop()
        spent += len(rest)
        near = np.bitwise_count(fp[rest] ^ fp[x]).sum(axis=1) <= radius
        if near.any():
            hit = rest[near]
            a.append(np.full(len(hit), who[center]))
            b.append(who[hit])
            frontier.extend(hit.tolist())
            rest = rest[~near]
        if spent > budget and len(rest):
            return a, b, np.concatenate([np.array(frontier, np.int64), rest])
    return a, b, np.zeros(0, np.int64)


def _wide_job(radius: int, held_rows: int, budget: int, last: bool):
    """Over rows (mask, key, f1, f2, who) sorted by mask, key and who: links (a, b), or members (a, null, mask, key, f1, f2) of buckets over their bounds."""
    names = ["a", "b", "mask", "key", "f1", "f2"]

    def links(a, b):
        z = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(z.astype(np.int32)), pa.array(z), pa.array(z), pa.array(z)], names)

    def members(mask, key, fp, who):
        f = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(mask), pa.array(key), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())], names)

    def run(batches):
        def emit(mask, key, fp, who):
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], cuts])
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 8), sizes))
            bucket = np.repeat(np.arange(len(sizes)), sizes)[small]
            a, b = [], []
            for d in range(1, 8):
                if len(small) <= d:
                    break
                ok = (bucket[d:] == bucket[:-d]) & (np.bitwise_count(fp[small[d:]] ^ fp[small[:-d]]).sum(axis=1) <= radius)
                a.append(who[small[:-d][ok]])
                b.append(who[small[d:][ok]])
            for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
                x, y, left = _wide_stars(fp[s : s + n], who[s : s + n], radius, 1 << 62 if last else budget)
                a += x
                b += y
                if len(left):
                    yield members(mask[s + left], key[s + left], fp[s + left], who[s + left])
            if a and sum(map(len, a)):
                yield links(np.concatenate(a), np.concatenate(b))

        let_go()
        held: list = []
        flooded = None
        for batch in batches:
            mask = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            fp = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)], axis=1).view(np.uint64)
            who = batch.column(4).to_numpy(zero_copy_only=False)
            if flooded is not None:  # the rest of a bucket that is already known as hot
                same = (mask == flooded[0]) & (key == flooded[1])
                n = len(same) if same.all() else int(same.argmin())
                if n:
                    yield members(mask[:n], key[:n], fp[:n], who[:n])
                mask, key, fp, who = mask[n:], key[n:], fp[n:], who[n:]
            if not len(key):
                continue
            flooded = None
            held.append((mask, key, fp, who))
            if (mask[0], key[0]) == (mask[-1], key[-1]) and sum(len(x[1]) for x in held) < held_rows:
                continue  # perhaps all one bucket so far
            mask, key, fp, who = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            tail = int(ends[-1]) + 1 if len(ends) else 0
            if tail:
                yield from emit(mask[:tail], key[:tail], fp[:tail], who[:tail])
            held = [(mask[tail:], key[tail:], fp[tail:], who[tail:])]
            if not last and len(key) - tail > held_rows:
                mask, key, fp, who = held[0]
                a, b, _ = _wide_stars(fp, who, radius, budget)
                if a:
                    yield links(np.concatenate(a), np.concatenate(b))
                yield members(mask, key, fp, who)
                flooded, held = (mask[0], key[0]), []
        if held:
            yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def bucket_blocks(members: DataFrame, block: int) -> DataFrame:
    """Rows (mask, key, f1, f2, who) of buckets dealt as pairs of blocks of about `block` members, a bucket of its own for each pair: any two members of a bucket meet, and nobody holds more than two blocks."""
    sizes = members.groupBy("mask", "key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = members.join(sizes, ["mask", "key"]).withColumn("own", F.pmod(F.xxhash64("who"), F.col("blocks")).cast("int"))
    # a block meets every other one; its own members meet there too
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("own")) | (F.col("blocks") == 1))
    pairs = dealt.withColumn("other", F.explode(others))
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return pairs.select("mask", key.alias("key"), "f1", "f2", "who")


def wide_links(prints: DataFrame, radius: int = 32, held_rows: int = HELD_ROWS, budget: int = COMPARISONS) -> DataFrame:
    """(a, b): links between distinct wide fingerprints (who, f1, f2) at `radius` or fewer differing bits: for each linked pair that shares a bucket, a path of links.

    Every pair within 19 bits shares a bucket, most pairs beyond it do too. A bucket with more members or work than its bounds
    is split by further masks over its free bits; what is over them even then is compared by pairs of blocks.
    """
    ship(prints.sparkSession)
    masks = wide_masks()
    keys = F.array(*[F.col("f1" if m[0] else "f2").bitwiseAND(F.lit(_signed(m[0] or m[1]))) for m in masks])
    rows = prints.select("f1", "f2", "who", F.posexplode(keys).alias("mask", "key")).select("mask", "key", "f1", "f2", "who")
    schema = "a bigint, b bigint, mask int, key bigint, f1 bigint, f2 bigint"

    def compared(buckets: DataFrame, last: bool) -> DataFrame:
        return buckets.repartition("mask", "key").sortWithinPartitions("mask", "key", "who").mapInArrow(_wide_job(radius, held_rows, budget, last), schema)

    found = cut(compared(rows, False))
    deep: dict[int, np.ndarray] = {}

    def further(batches):
        for b in batches:
            outer = b.column(2).to_numpy(zero_copy_only=False)
            fp = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)], axis=1).view(np.uint64)
            who = b.column(0).to_numpy(zero_copy_only=False)
            for m in np.unique(outer).tolist():
                if m not in deep:
                    deep[m] = np.array(inner_masks(masks[m]), np.uint64)
                own = fp[outer == m]
                base = (own & np.array(masks[m], np.uint64)).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for i, inner in enumerate(deep[m]):
                    part = own & inner
                    key = (base ^ part[:, 0]) * np.uint64(0xBF58476D1CE4E5B9) ^ (part[:, 1] * np.uint64(0x94D049BB133111EB))
                    n = len(own)
                    f = own.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m * 1000 + i, np.int32)), pa.array(key.view(np.int64)), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.array(who[outer == m])], ["mask", "key", "f1", "f2", "who"])

    links, hot = found.where("b is not null").select("a", "b"), found.where("b is null")
    if not hot.isEmpty():
        again = cut(compared(hot.mapInArrow(further, "mask int, key bigint, f1 bigint, f2 bigint, who bigint"), False))
        links, dense = links.unionByName(again.where("b is not null").select("a", "b")), again.where("b is null")
        if not dense.isEmpty():
            blocks = bucket_blocks(dense.select("mask", "key", "f1", "f2", F.col("a").alias("who")), max(2, held_rows // 4))
            links = links.unionByName(compared(blocks, True).select("a", "b"))
    # a member meets a few smaller ones in each of its buckets: one link to the least stays, the others are linked to the least
    lists = links.groupBy(F.greatest("a", "b").alias("a")).agg(F.array_sort(F.collect_set(F.least("a", "b"))).alias("less"))
    lists = cut(few(lists, prints.count()))
    rest = lists.select(F.explode(F.slice("less", 2, F.size("less"))).alias("a"), F.col("less")[0].alias("b")).distinct()
    return lists.select("a", F.col("less")[0].alias("b")).unionByName(rest)


#: One text in SAMPLE is counted for its shingles; those of COMMON of them or more come last in the order of prefixes.
SAMPLE, COMMON = 16, 3


def _common_shingles(rows: DataFrame, width: int):
    """A filter that holds the shingles of many texts, and by chance a few others. Any filter gives right results: it only keeps buckets small."""

    def run(batches):
        let_go()
        for b in batches:
            for t in as_bytes(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes((t or b"").lower().split(), width).view(np.int64))], ["s"])

    some = rows.where(F.pmod("h", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "s bigint")
    return bloom(cut(some.groupBy("s").count().where(F.col("count") >= COMMON).select("s")), "s")


def prefix(shingles: np.ndarray, common: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles of a set, rare ones before common ones and then by hash: two sets at `threshold` or more share one of them."""
    ordered = np.concatenate([shingles[~common], shingles[common]])
    return ordered[: len(ordered) - math.ceil(threshold * len(ordered) - 1e-9) + 1]


def prefix_pairs(met: DataFrame, threshold: float) -> DataFrame:
    """(pid, pid2), each pair once: sets of different roots that may reach the threshold, by sizes and by what is left of each from a shared shingle on. met: (s, pid, root, size, left)."""
    other = met.select("s", *[F.col(c).alias(f"{c}2") for c in ("pid", "root", "size", "left")])
    fits = (F.col("root") < F.col("root2")) & (F.col("size") >= F.col("size2") * (threshold - 1e-9)) & (F.col("size2") >= F.col("size") * (threshold - 1e-9))
    enough = F.least("left", "left2") >= (F.col("size") + F.col("size2")) * (threshold / (1 + threshold)) - 1e-6
    return met.join(other, "s").where(fits & enough).select("pid", "pid2").distinct()


def prefix_links(rows: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b): the links between texts (pid, root, n, id, h) of different roots, by exact Jaccard similarity; texts are read from rows (n, id, h, text).

    Sets that share a shingle of their prefixes are candidates if their sizes allow it, and the places of that shingle: where it is
    the first that they share, only what follows it on either side can be shared besides. What their prefixes share bounds what
    the whole sets share, so few candidates have their sets compared, each pair by itself.
    """
    common = _common_shingles(rows, width)

    def heads(sets: list[np.ndarray]) -> list[np.ndarray]:
        return [prefix(s, common.value.may_hold(s.view(np.int64)), threshold) for s in sets]

    held = written(_wanted_shingles(rows, texts, width, heads))
    of = W.partitionBy("s")
    met = held.select("pid", "root", "size", F.posexplode("shingles").alias("place", "s")).withColumn("left", F.col("size") - F.col("place")).drop("place")
    met = met.withColumns({"low": F.min("root").over(of), "high": F.max("root").over(of)}).where("low < high")
    met = cut(met.select("s", "pid", "root", "size", "left"))
    pairs = prefix_pairs(met, threshold)
    left, right = (held.select(F.col("pid").alias(f"pid{i}"), F.col("size").alias(f"size{i}"), F.col("shingles").alias(f"shingles{i}")) for i in ("", "2"))
    both = pairs.join(left, "pid").join(right, "pid2")
    shared = F.size(F.array_intersect("shingles", "shingles2")) + F.greatest(F.col("size") - F.size("shingles"), F.col("size2") - F.size("shingles2"))
    pairs = cut(both.where(shared >= (F.col("size") + F.col("size2")) * (threshold / (1 + threshold)) - 1e-6).select("pid", "pid2").withColumn("bucket", F.monotonically_increasing_id()))
    ends = pairs.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), F.explode(F.array("pid", "pid2")).alias("pid"))
    wanted = texts.drop("root").join(ends.select("pid").distinct(), "pid", "left_semi")
    return verified_links(ends, _wanted_shingles(rows, wanted, width).select("pid", "shingles"), threshold)


def _wanted_shingles(rows: DataFrame, wanted: DataFrame, width: int, part_of=None) -> DataFrame:
    """wanted's own columns (pid and others), size and shingles of the rows that wanted (pid, n, id, h) names, or what part_of makes of their sets. Texts are not shuffled: a filter of bounded size lets few others pass."""
    sieve = bloom(wanted.select("h"), "h")

    def run(batches):
        let_go()
        for b in batches:
            own = np.flatnonzero(sieve.value.may_hold(b.column(2).to_numpy(zero_copy_only=False)))
            part = b.take(pa.array(own))
            sets = [shingle_hashes((t or b"").lower().split(), width) for t in as_bytes(part.column(3))]
            size = pa.array(list(map(len, sets)), pa.int64())
            sets = part_of(sets) if part_of else sets
            ends = np.concatenate([[0], np.cumsum(list(map(len, sets)))]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], size, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["n", "id", "h", "size", "shingles"])

    kind = rows.schema["id"].dataType.simpleString()
    some = _keyed(rows.mapInArrow(run, f"n boolean, id {kind}, h bigint, size bigint, shingles array<bigint>")).drop("id")
    own = _keyed(wanted).drop("id")
    if part_of:  # repeated rows go where the join deals its rows anyway
        return own.join(some.dropDuplicates(ROW_KEY), ROW_KEY).drop(*ROW_KEY)
    return own.join(some, ROW_KEY).drop(*ROW_KEY).dropDuplicates(["pid"])  # the sets meet their groups by pid next


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, radius: int = 32, block_words: int = 300_000) -> DataFrame:
    """(n, id, h, best): for every distinct row its identity and that of the row which stays of its group.

    Texts are linked if the exact Jaccard similarity of their sets of `width`-word shingles is `threshold` or more. Most links are
    found among candidates whose wide fingerprints differ in `radius` bits or fewer, or lead from one to the other; all others
    by prefix_links. A group is a connected component of links; texts of the same words are one text. The row that stays is the first by id, rows without an
    id last, then by a hash of the text.
    """
    ship(docs.sparkSession)
    rows = docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("text"))
    own = cut(_wide_prints(rows, width))
    texts = own.groupBy("d1", "d2", "f1", "f2").agg(F.min(F.struct("n", "id", "h")).alias("first"), F.max("n_words").alias("n_words"))
    size = own.count()
    texts = cut(few(texts, size).withColumn("pid", F.monotonically_increasing_id()))
    # a fingerprint goes by one of its texts
    prints = texts.groupBy("f1", "f2").agg(F.min("pid").alias("who"))
    prints = cut(few(prints, size))
    roots = connected_components(wide_links(prints, radius)).withColumnRenamed("node", "who")
    rooted = texts.join(prints, ["f1", "f2"]).join(roots, "who", "left").select("pid", "first", "n_words", F.coalesce("root", "who").alias("bucket"))
    rooted = cut(few(rooted, size))
    # members weigh as their words, so blocks are bounded in memory
    groups = cut(rooted.groupBy("bucket").agg(F.count("*").alias("texts"), F.sum(F.col("n_words") + 16).alias("size")).where("texts > 1").coalesce(8 + size // 250_000))
    members = cut(few(rooted.join(groups, "bucket").select("bucket", "pid", "size", "first"), size))
    sets = _wanted_shingles(rows, members.select("pid", "first.*"), width).select("pid", "shingles")
    links = verified_links(block_pairs(members.select("bucket", "pid", "size"), block_words), sets, threshold)
    same = connected_components(links).withColumnRenamed("node", "pid")
    labels = rooted.select("pid", "first").join(same, "pid", "left").withColumn("root", F.coalesce("root", "pid"))
    labels = cut(few(labels, size))
    # what fingerprints have left out joins whole groups
    more = prefix_links(rows, labels.select("pid", "root", "first.*"), threshold, width)
    root = {c: labels.select(F.col("pid").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"}
    joined = connected_components(more.join(root["a"], "a").join(root["b"], "b"), "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("top"))
    labels = cut(few(labels.join(joined, "root", "left").select("pid", "first", F.coalesce("top", "root").alias("root")), size))
    best = cut(few(labels.groupBy("root").agg(F.min("first").alias("best")), size))
    of = labels.join(best, "root").select("pid", "best")
    named = texts.select("d1", "d2", "pid").join(of, "pid").drop("pid")
    return own.select("n", "id", "h", "d1", "d2").distinct().join(named, ["d1", "d2"]).select("n", "id", "h", "best")


def named_rows(rows: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows whose identity is among kept (n, id, h), a repeated row once. The join and the window deal the texts alike, so these move once."""
    kept = _keyed(kept).select(*[F.col(c).alias(f"_{c}") for c in ROW_KEY])
    n, _, h = _row_key(id_col, text_col)
    keyed = rows.select("*", n.alias("_n"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_k"), h.alias("_h"))
    once = W.partitionBy("_h", "_n", "_k").orderBy("_h")
    found = keyed.join(kept, ["_h", "_n", "_k"], "left_semi").withColumn("_r", F.row_number().over(once)).where("_r = 1")
    return found.drop("_h", "_n", "_k", "_r")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, one of each group of near copies (see near_copies), columns as they are.

    Null and blank texts have no words and are one group. Rows without an id take part and stay only if no member of their
    group has one. A repeated row stays once. An empty table gives no rows.
    """
    rows, names, of = masked(docs)
    id_col, text_col = of[id_col], of[text_col]
    found = near_copies(rows, id_col, text_col, **options)
    kept = found.where((F.col("n") == F.col("best.n")) & F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))).select("n", "id", "h")
    left = named_rows(rows, kept, id_col, text_col)
    return left.select(*names).toDF(*docs.columns)
