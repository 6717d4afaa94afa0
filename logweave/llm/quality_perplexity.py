"""Quality rules by n-gram perplexity.

The model is an interpolated modified Kneser-Ney model over character n-grams of order 4, one per language. Characters are
lower-cased; digits are one class and white space is one. A class is the code point itself, so a 4-gram is an exact 64-bit
key and its suffixes and contexts are bit operations; code points above 65,535 share the 6,400 classes of the private use
area. Spark counts the n-grams, with a partial count per task, and derives continuation counts, discounts and
log-probabilities from them by grouping and joining.

The model is fitted on every row that passes the base rules and, unless `symbol_share` is None, has at most one counted symbol in
`symbol_share` characters. Rows that are full of marks are then judged by a model that has not learned them, so they stand out.

For scoring, each language's entries are sorted arrays of 64-bit keys beside their values. The arrays are broadcast only if
their number of entries is at most `max_entries` (12 bytes each); beyond that each document's distinct n-grams are joined to
the model table instead. Values are single-precision numbers on both ways.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, few, let_go, masked, ship, slabs

ORDER = 4
SYMBOL_BITS = 16
START, END = 0, 1
LOG2E = 1.4426950408889634
SYMBOLS = "#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Entries that may be broadcast: 16 million times 12 bytes.
MAX_ENTRIES = 16_000_000
#: Characters of a text taken at once, and n-grams counted in a task before they are handed on.
SLAB, HELD = 250_000, 500_000
#: By default a row with more symbols than one in so many characters is not learned from.
SYMBOL_SHARE = 50.0
#: Languages whose bands may be broadcast: a few dozen bytes each.
MAX_BANDS = 100_000
_table: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Class of each code point below 65,536; built once per process."""
    if not _table:
        out = np.zeros(65536, np.uint64)
        for cp in range(65536):
            low = chr(cp).lower()
            c = ord(low) if len(low) == 1 else cp
            if chr(c).isdigit():
                c = 48
            elif chr(c).isspace():
                c = 32
            out[cp] = max(c, 2)
        _table.append(out)
    return _table[0]


def symbols(text: bytes) -> np.ndarray:
    """Classes of a text's characters."""
    cp = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = symbol_table()[cp & 0xFFFF]
    far = np.flatnonzero(cp > 0xFFFF)
    if len(far):
        out[far] = 0xE000 + cp[far] % 6400
    return out


def _codes(s: np.ndarray) -> np.ndarray:
    code = s.copy()
    for back in range(1, ORDER):
        code[back:] |= s[:-back] << np.uint64(SYMBOL_BITS * back)
    return code


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the n-grams that end at each character and at the end of each text, and the index of their text."""
    parts, sizes = [], []
    for t in texts:
        own = symbols(t)
        parts += [np.full(ORDER - 1, START, np.uint64), own, np.full(1, END, np.uint64)]
        sizes.append(len(own) + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = _codes(np.concatenate(parts))
    sizes = np.array(sizes)
    begins = np.cumsum(sizes + ORDER - 1) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
    return code[at], doc


def gram_slabs(texts: list[bytes], limit: int = SLAB):
    """grams() of some texts at a time: (first text, text after the last, codes, index of their text). A very long text comes in pieces."""
    for lo, hi in slabs([len(t) for t in texts], limit):
        if hi - lo > 1 or len(texts[lo]) <= 4 * limit:
            yield lo, hi, *grams(texts[lo:hi])
            continue
        s = np.concatenate([np.full(ORDER - 1, START, np.uint64), symbols(texts[lo]), np.full(1, END, np.uint64)])
        for at in range(ORDER - 1, len(s), limit):
            code = _codes(s[at - ORDER + 1 : at + limit])[ORDER - 1 :]
            yield lo, hi, code, np.zeros(len(code), np.int64)


def _tally(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(count, first)


def learned_from(features: tuple[int, int, int, int, int], min_words: int = 50, symbol_share: float | None = SYMBOL_SHARE) -> bool:
    """Whether the model is fitted on a row: it passes the base rules and, with a symbol share, is not full of symbols."""
    n, chars, marks, _, repeat = features
    return n >= min_words and 100 * repeat <= 50 * n and (symbol_share is None or symbol_share * marks <= chars)


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_words: int | None = None, symbol_share: float | None = SYMBOL_SHARE) -> DataFrame:
    """(lang, code, n): exact counts over all rows, or with `min_words` over all rows learned from; null languages count as ''. Null text is left out."""
    ship(docs.sparkSession)

    def run(batches):
        let_go()
        held: dict[str, tuple[list, list]] = {}

        def flush(lang):
            code, n = _tally(*held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

        for b in batches:
            texts, langs = as_bytes(b.column(0)), b.column(1).to_pylist()
            rows: dict[str, list[bytes]] = {}
            for t, g in zip(texts, langs, strict=True):
                if t is not None and (min_words is None or learned_from(base_features(t), min_words, symbol_share)):
                    rows.setdefault(g or "", []).append(t)
            for lang, own in rows.items():
                for _, _, code, _ in gram_slabs(own):
                    code.sort()
                    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                    sizes = np.diff(np.concatenate([first, [len(code)]]))
                    h = held.setdefault(lang, ([], []))
                    h[0].append(code[first])
                    h[1].append(sizes)
                    if sum(map(len, h[0])) > HELD:
                        code, n = _tally(*h)
                        held[lang] = ([code], [n])
                        if len(code) > HELD // 2:
                            yield flush(lang)
            if len(held) > 64:  # many languages: what a task holds stays bounded
                for lang in list(held):
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    part = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("g")).mapInArrow(run, "lang string, code bigint, n bigint")
    return part.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, kind, code, value) from 4-gram counts.

    kind 1 to 4: natural log-probability of an n-gram of that order; kind 11 to 13: log weight of the shorter orders after a
    context of 1 to 3 characters; kind 10: log-probability of an unseen character.
    """
    bits = SYMBOL_BITS
    n = counts.count()
    counts = few(counts, n)
    # beyond so many languages, shuffled joins by language
    small = F.broadcast if counts.select("lang").distinct().count() <= MAX_BANDS else (lambda df: df)
    tables = {ORDER: counts.select("lang", "code", F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        short = F.col("code").bitwiseAND(F.lit((1 << bits * k) - 1))
        tables[k] = few(tables[k + 1].groupBy("lang", short.alias("code")).agg(F.count("*").alias("c")), n)
    out = None
    lower = None
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("h", F.shiftrightunsigned("code", bits))
        of = t.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)])
        y = F.expr("n1 / greatest(n1 + 2 * n2, 1)")
        d = [F.least(F.greatest(F.lit(0.05), F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(0.5 * i)), F.lit(i * 0.95)) for i in (1, 2, 3)]
        t = t.join(small(of.select("lang", *[x.alias(f"d{i + 1}") for i, x in enumerate(d)])), "lang")
        t = t.withColumn("d", F.expr("case when c = 1 then d1 when c = 2 then d2 else d3 end"))
        ctx = t.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("cut"), F.count("*").alias("kinds"))
        t = t.join(ctx, ["lang", "h"])
        if k == 1:
            t = t.withColumn("p", F.expr("(c - d) / total + cut / total / (kinds + 1)"))
            extra = ctx.select("lang", F.lit(10).alias("kind"), F.lit(0).cast("bigint").alias("code"), F.expr("ln(cut / total / (kinds + 1))").alias("value"))
        else:
            t = t.withColumn("s", F.col("code").bitwiseAND(F.lit((1 << bits * (k - 1)) - 1))).join(lower, ["lang", "s"])
            t = t.withColumn("p", F.expr("(c - d) / total + cut / total * q"))
            extra = ctx.select("lang", F.lit(9 + k).alias("kind"), F.col("h").alias("code"), F.expr("ln(cut / total)").alias("value"))
        t = cut(few(t.select("lang", "code", "p"), n))
        lower = t.select("lang", F.col("code").alias("s"), F.col("p").alias("q"))
        own = t.select("lang", F.lit(k).alias("kind"), "code", F.ln("p").alias("value")).unionByName(extra)
        out = own if out is None else out.unionByName(own)
    return cut(few(out, n))


class Arrays:
    """Sorted key arrays of one language."""

    def __init__(self, kind: np.ndarray, code: np.ndarray, value: np.ndarray):
        self.keys, self.values = {}, {}
        for k in np.unique(kind):
            own = kind == k
            keys = code[own].view(np.uint64)
            order = np.argsort(keys)
            self.keys[int(k)] = keys[order]
            self.values[int(k)] = value[own][order].astype(np.float32)

    def find(self, kind: int, code: np.ndarray) -> np.ndarray:
        """Values, NaN where there is no entry."""
        keys = self.keys.get(kind)
        if keys is None or not len(keys):
            return np.full(len(code), np.nan)
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        return np.where(keys[at] == code, self.values[kind][at].astype(np.float64), np.nan)

    def logp(self, code: np.ndarray) -> np.ndarray:
        """Natural log-probability of the last character of each 4-gram; `code` sorted is faster, not needed."""
        bits = np.uint64(SYMBOL_BITS)
        out = self.find(ORDER, code)
        weight = np.zeros(len(code))
        rest = np.flatnonzero(np.isnan(out))
        for k in range(ORDER - 1, 0, -1):
            if not len(rest):
                return out
            part = code[rest] & np.uint64((1 << SYMBOL_BITS * (k + 1)) - 1)
            back = self.find(10 + k, part >> bits)
            weight[rest] += np.where(np.isnan(back), 0.0, back)
            p = self.find(k, part & np.uint64((1 << SYMBOL_BITS * k) - 1))
            out[rest] = p + weight[rest]
            rest = rest[np.isnan(p)]
        out[rest] = self.find(10, np.zeros(len(rest), np.uint64)) + weight[rest]
        return np.nan_to_num(out, nan=-30.0)

    def sums(self, code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Sum of log-probabilities for each of `n` texts; every distinct n-gram is looked up once."""
        keys, own = np.unique(code, return_inverse=True)
        return np.bincount(doc, weights=self.logp(keys)[own], minlength=n)


def base_features(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(text.count(c.encode()) for c in SYMBOLS)
    dup = 0
    lines = text.split(b"\n")
    if len(set(lines)) < len(lines):
        full = [x for x in lines if x.strip(SPACES)]
        dup = len(full) - len(set(full))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            number: dict = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
            hot = np.bincount(ids)[ids] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(hot)] |= hot
            repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat


_COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_grams bigint, log_sum double"


def _measure(models):
    """Rows (carried columns, lang, base features, number of n-grams, sum of log-probabilities, null without a model of the language). models: broadcast, or None for features only."""

    def run(batches):
        let_go()
        arrays = models.value if models is not None else {}
        for b in batches:
            texts, langs = as_bytes(b.column(0)), b.column(1).to_pylist()
            base = np.array([base_features(t) for t in texts], np.int64).reshape(len(texts), 5)
            total, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            unknown = np.array([models is not None and t is not None and (g or "") not in arrays for t, g in zip(texts, langs, strict=True)], bool)
            by: dict[str, list[int]] = {}
            for i, g in enumerate(langs):
                if texts[i] is not None:
                    by.setdefault(g or "", []).append(i)
            for lang, own in by.items():
                model = arrays.get(lang)
                for lo, hi, code, doc in gram_slabs([texts[i] for i in own]):
                    rows = own[lo:hi]
                    size[rows] += np.bincount(doc, minlength=len(rows))
                    if model is not None:
                        total[rows] += model.sums(code, doc, len(rows))
            cols = [*b.columns[2:], pa.array([g or "" for g in langs], pa.string()), *[pa.array(base[:, j]) for j in range(5)], pa.array(size), pa.array(total, mask=unknown)]
            yield pa.RecordBatch.from_arrays(cols, [str(i) for i in range(len(cols))])

    return run


def _joined_scores(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The way without a broadcast: distinct n-grams of each document joined to the model, its shorter orders where one is missing."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for i, (t, g) in enumerate(zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True)):
                if t is not None:
                    for _, _, code, _ in gram_slabs([t]):
                        code, n = np.unique(code, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([b.column(2)[i].as_py()] * len(code), pa.string()), pa.array([g or ""] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["k", "lang", "code", "n"])

    found = docs.select("_t", "_g", "_k").mapInArrow(run, "k string, lang string, code bigint, n bigint")
    bits = SYMBOL_BITS
    short = lambda k: F.col("code").bitwiseAND(F.lit((1 << bits * k) - 1)) if k < ORDER else F.col("code")

    def side(kind):
        return model.where(F.col("kind") == kind).select("lang", F.col("code").alias("m"), F.col("value").alias(f"v{kind}"))

    for kind, part in [(ORDER, F.col("code"))] + [(k, short(k)) for k in (3, 2, 1)] + [(10 + k, F.shiftrightunsigned(short(k + 1), bits)) for k in (3, 2, 1)]:
        found = found.withColumn("m", part).join(side(kind), ["lang", "m"], "left").drop("m")
    w = [F.coalesce(F.col(f"v{10 + k}"), F.lit(0.0)).cast("double") for k in (3, 2, 1)]
    # what no order knows waits for its language's weight: added up by document first, as one language may hold a third of all rows
    known = F.coalesce(F.col("v4").cast("double"), F.col("v3") + w[0], F.col("v2") + w[0] + w[1], F.col("v1") + w[0] + w[1] + w[2])
    lost = known.isNull()
    sums = found.groupBy("k", "lang").agg(F.sum(F.coalesce(known, w[0] + w[1] + w[2]) * F.col("n")).alias("s"), F.sum(F.when(lost, F.col("n")).otherwise(0)).alias("lost"))
    unseen = side(10).drop("m")
    if unseen.count() <= MAX_BANDS:
        unseen = F.broadcast(unseen)
    return sums.join(unseen, "lang", "left").select("k", (F.col("s") + F.col("lost") * F.col("v10").cast("double")).alias("s"))


def quality_scores(docs: DataFrame, model: DataFrame, carry: list[str], text_col: str = "text", lang_col: str = "lang", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """carry columns, lang, base features, n_grams and log_sum (natural log) of each row under its language's model."""
    spark = docs.sparkSession
    ship(spark)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + ["model_lang string", _COLUMNS])
    picked = docs.select(F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("_g"), *carry)
    model = model.withColumn("value", F.col("value").cast("float"))
    if model.count() <= max_entries:
        flat = model.toArrow()
        langs = flat.column("lang").combine_chunks().dictionary_encode()
        names, place = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        order = np.argsort(place, kind="stable")
        sizes = np.bincount(place, minlength=len(names))
        stops = np.cumsum(sizes)
        kind, code, value = (flat.column(c).to_numpy()[order] for c in ("kind", "code", "value"))
        sent = spark.sparkContext.broadcast({g: Arrays(kind[a:b], code[a:b], value[a:b]) for g, a, b in zip(names, stops - sizes, stops, strict=True)})
        return picked.mapInArrow(_measure(sent), schema)
    keyed = picked.withColumn("_k", F.sha2(F.concat_ws("\x01", F.coalesce("_g", F.lit("")), "_t"), 256))
    plain = keyed.select("_t", "_g", *carry, "_k").mapInArrow(_measure(None), schema.replace("model_lang", "_k string, model_lang"))
    return plain.drop("log_sum").join(_joined_scores(keyed.dropDuplicates(["_k"]), model), plain["_k"] == F.col("k"), "left").drop("k", "_k").withColumn("log_sum", F.when(F.col("n_grams") == 0, 0.0).otherwise(F.col("s"))).drop("s")


def judge(
    docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", min_words: int = 50, low: float = 6.0, high: float = 6.0, floor_bits: float = 0.03, max_entries: int = MAX_ENTRIES, symbol_share: float | None = SYMBOL_SHARE
) -> DataFrame:
    """One row per input row: carry columns, base features, base_failed, bits_per_char, and kept.

    A document that passes the base rules is kept if its bits per character lie within its language's band: the median, less
    `low` and plus `high` times a spread. The spread is the interquartile range over 1.349, at least `floor_bits`. Both come
    from all documents of the language that the model is fitted on. Perplexity is 2 to the power bits_per_char, so the band is
    an upper and a lower perplexity. A language with nothing to fit on has no band and null bits_per_char: the base rules alone decide.
    `symbol_share` says which rows are learned from (None: all that pass the base rules); every row is judged.

    Null or blank text: zero words, base_failed, not kept. Null language: a language of its own. Repeated rows are counted and
    returned each time. An empty table gives no rows. Other columns are not read.
    """
    carry = ["doc_id"] if carry is None else carry
    model = kneser_ney(cut(count_grams(docs, text_col, lang_col, min_words, symbol_share)))

    def rated(scored: DataFrame) -> DataFrame:
        scored = scored.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        return scored.withColumn("bits_per_char", F.when(F.col("n_grams") > 1, -F.col("log_sum") * LOG2E / F.col("n_grams")))

    narrow = rated(cut(quality_scores(docs, model, ["doc_id"] if carry == ["doc_id"] else [], text_col, lang_col, max_entries)))
    q = F.percentile_approx("bits_per_char", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000)
    fitted = ~F.col("base_failed")
    if symbol_share is not None:
        fitted &= symbol_share * F.col("n_symbols") <= F.col("word_chars")
    bands = narrow.where(fitted).groupBy("model_lang").agg(q.alias("q"))
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(floor_bits))
    bands = cut(bands.select("model_lang", (F.col("q")[1] - low * spread).alias("band_low"), (F.col("q")[1] + high * spread).alias("band_high")))
    if bands.count() <= MAX_BANDS:  # beyond it, a shuffled join
        bands = F.broadcast(bands)
    # whole texts are scored again rather than written to the checkpoint folder
    scored = narrow if carry == ["doc_id"] else rated(quality_scores(docs, model, carry, text_col, lang_col, max_entries))
    inside = F.col("bits_per_char").between(F.col("band_low"), F.col("band_high"))
    return scored.join(bands, "model_lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("log_sum")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that judge() keeps, with their columns, whatever their names. Null and blank texts go; null ids and languages, repeated rows and empty tables are as in judge()."""
    rows, names, of = masked(docs)
    kept = judge(rows, carry=names, text_col=of["text"], lang_col=of["lang"], **options).where("kept")
    return kept.select(*names).toDF(*docs.columns)
