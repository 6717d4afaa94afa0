"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct character n-grams (1 to `n_max`) both
hold, over the root of the product of their own numbers. A bounded sample of labelled rows gives landmarks and training rows;
the Nyström map of the landmarks turns one-versus-rest kernel ridge regression into a linear problem of the landmarks' size.
Since kernel values are products of presence vectors, the learned weights fold into one matrix of (n-gram, language), and a
batch of whole texts is scored by matrix products, a block of n-grams at a time.

The model is fitted on the driver from a bounded sample (rows of a language, rows and landmarks in all, characters of a row:
documented bounds below); everything else runs over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, ship, slabs

#: Bounds of the fitting sample: rows of a language, landmarks of a language, languages.
PER_LANG, LANDMARKS, MAX_LANGS = 150, 50, 200
#: And in all: rows, landmarks; characters of a row that may be learned from. At most 120 million characters reach the driver.
MAX_ROWS, MAX_LANDMARKS, MAX_CHARS = 6_000, 600, 20_000
#: n-grams of a matrix product; characters of a text that are taken apart at once.
BLOCK, PIECE = 32_768, 4_000_000
UNKNOWN = "und"
_table: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Class of each code point below 65,536: lower case; white space, digits and marks are one class each."""
    if not _table:
        out = np.zeros(65536, np.int64)
        for cp in range(65536):
            low = chr(cp).lower()
            c = ord(low) if len(low) == 1 else cp
            out[cp] = c if chr(c).isalpha() else 1 if chr(c).isspace() else 2 if chr(c).isdigit() else 3
        _table.append(out)
    return _table[0]


def _symbols_of(text: bytes) -> np.ndarray:
    return _symbols()[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) & 0xFFFF]


def presence(texts: list[bytes], n_max: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(code, text index) of the distinct n-grams of each text, sorted by code for each length. Codes carry their length; at most 16,384 texts."""
    s = [_symbols_of(t) for t in texts]
    if len(s) == 1 and len(s[0]) > PIECE:  # a very long text in pieces that overlap
        found = [_presence([s[0][at : at + PIECE + n_max - 1]], n_max)[0] for at in range(0, len(s[0]), PIECE)]
        code = np.unique(np.concatenate(found))
        return code, np.zeros(len(code), np.int64)
    return _presence(s, n_max)


def _presence(parts: list[np.ndarray], n_max: int) -> tuple[np.ndarray, np.ndarray]:
    s = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(parts)), list(map(len, parts)))
    codes, docs = [], []
    code = s.astype(np.uint64)
    for n in range(1, n_max + 1):
        if n > 1:
            if len(s) < n:
                break
            code = code[:-1] << np.uint64(16) | s[n - 1 :].astype(np.uint64)
        inside = doc[: len(code)] == doc[n - 1 :]
        # low bits: the text; equal pairs of code and text become neighbours
        own = np.sort(code[inside] << np.uint64(14) | doc[: len(code)][inside].astype(np.uint64))
        own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        codes.append((own >> np.uint64(14)) | np.uint64(n) << np.uint64(60))
        docs.append((own & np.uint64(0x3FFF)).astype(np.int64))
    return (np.concatenate(codes), np.concatenate(docs)) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Rows:
    """Presence rows of texts over some n-grams (sorted codes), each over the root of the text's own number of n-grams; dense only a block at a time."""

    def __init__(self, texts: list[bytes], codes: np.ndarray, n_max: int):
        code, doc = presence(texts, n_max)
        self.n, self.width = len(texts), len(codes)
        self.scale = (1 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(texts)), 1))).astype(np.float32)
        at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
        hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
        order = np.argsort(at[hit], kind="stable")
        self.at, self.doc = at[hit][order], doc[hit][order]

    def block(self, lo: int, hi: int) -> np.ndarray:
        a, b = np.searchsorted(self.at, [lo, hi])
        x = np.zeros((self.n, hi - lo), np.float32)
        x[self.doc[a:b], self.at[a:b] - lo] = 1.0
        return x * self.scale[:, None]

    def blocks(self):
        return ((lo, min(lo + BLOCK, self.width)) for lo in range(0, self.width, BLOCK))

    def kernel(self, other: Rows) -> np.ndarray:
        out = np.zeros((self.n, other.n))
        for lo, hi in self.blocks():
            out += self.block(lo, hi) @ other.block(lo, hi).T
        return out


class Model:
    """n-grams of the landmarks (sorted codes), and a weight for each of them and each language."""

    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray, n_max: int):
        self.langs, self.codes, self.weights, self.n_max = langs, codes, weights, n_max

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows = Rows(texts, self.codes, self.n_max)
        out = np.zeros((len(texts), len(self.langs)), np.float32)
        for lo, hi in rows.blocks():
            out += rows.block(lo, hi) @ self.weights[lo:hi]
        return out


def fit(rows: list[tuple[bytes, str]], landmarks: int = LANDMARKS, ridge: float = 1e-3, n_max: int = 3) -> Model:
    """Kernel ridge regression of +1/-1 targets on the Nyström features of the first `landmarks` rows of each language (fewer where MAX_LANDMARKS asks for it)."""
    langs = sorted({g for _, g in rows})
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), n_max)
    each = max(1, min(landmarks, MAX_LANDMARKS // len(langs)))
    marks: list[bytes] = []
    for g in langs:
        marks += [t for t, own in rows if own == g][:each]
    codes = np.unique(presence(marks, n_max)[0])
    land = Rows(marks, codes, n_max)
    values, vectors = np.linalg.eigh(land.kernel(land))
    use = values > 1e-8 * max(values.max(), 1e-12)
    root = vectors[:, use] / np.sqrt(values[use])  # landmarks to Nyström features
    phi = np.concatenate([Rows([t for t, _ in rows[lo : lo + 256]], codes, n_max).kernel(land) for lo in range(0, len(rows), 256)]) @ root
    target = np.where(np.array([[own == g for g in langs] for _, own in rows]), 1.0, -1.0)
    # each class weighs as much as all others together
    weight = (target > 0) / np.maximum((target > 0).sum(0), 1) + (target < 0) / np.maximum((target < 0).sum(0), 1)
    beta = np.zeros((phi.shape[1], len(langs)))
    for j in range(len(langs)):
        w = weight[:, j : j + 1]
        beta[:, j] = np.linalg.solve(phi.T @ (phi * w) + ridge * np.eye(phi.shape[1]), phi.T @ (w[:, 0] * target[:, j]))
    right = (root @ beta).astype(np.float32)
    return Model(langs, codes, np.concatenate([land.block(lo, hi).T @ right for lo, hi in land.blocks()]), n_max)


def held_out(id_col: str = "doc_id"):
    """Column: the document is held out of learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> list[tuple[bytes, str]]:
    """At most `per_lang` labelled rows of each of the MAX_LANGS most frequent languages and MAX_ROWS in all, chosen by a hash of the id; never held-out rows.

    Rows over `max_chars` characters are not learned from. Rows are thinned by a hash threshold set from the languages' counts
    before they are ranked, so no language meets in one task.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return []
    per_lang = max(1, min(per_lang, MAX_ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], (2.0 * per_lang + 20) / r["count"])])  # at most MAX_LANGS entries
    u = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = rows.select("doc_id", "lang", u.alias("u")).where(F.col("u") < share[F.col("lang")])
    w = W.partitionBy("lang").orderBy("u", "doc_id")
    chosen = thin.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang).select("doc_id", "lang", "r").distinct()
    texts = rows.join(F.broadcast(chosen.withColumnsRenamed({"lang": "_g", "doc_id": "_d"})), (F.col("doc_id") == F.col("_d")) & (F.col("lang") == F.col("_g")))
    got = texts.select("lang", "r", "doc_id", F.encode("text", "UTF-8").alias("t")).collect()  # at most MAX_ROWS rows of max_chars characters, and their repeated rows
    return [(bytes(x["t"]), x["lang"]) for x in sorted(got, key=lambda x: (x["lang"], x["r"], x["doc_id"], bytes(x["t"])))]


def identify(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """carry columns, lang_pred and score (0 to 1) of every row's whole text."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # its size is bounded by the landmarks

    def run(batches):
        m = sent.value
        for b in batches:
            texts = as_bytes(b.column(0))
            pred: list[str] = [UNKNOWN] * len(texts)
            score = np.zeros(len(texts))
            live = [i for i, t in enumerate(texts) if t and m.langs and any(map(str.isalpha, t.decode("utf-8", "replace")))]
            for lo, hi in slabs([len(texts[i]) + 2_000 for i in live], 600_000):
                rows = live[lo:hi]
                s = m.scores([texts[i] for i in rows])
                best = s.argmax(axis=1)
                score[rows] = np.clip((1 + s[np.arange(len(rows)), best]) / 2, 0, 1)
                for i, k in zip(rows, best, strict=True):
                    pred[i] = m.langs[k]
            cols = [*b.columns[1:], pa.array(pred, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, [str(i) for i in range(len(cols))])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + ["lang_pred string", "score double"])
    return docs.select(F.col("text").alias("_t"), *[F.col(f"`{c}`") for c in carry]).mapInArrow(run, schema)


def language_report(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is `und` with score 0; so is every row if nothing labelled is there to learn from.
    Null ids are never held out. Ties go to the language first in the alphabet. Repeated rows come back repeated; an empty
    table gives no rows. lang is read only to fit, source never.
    """
    model = fit(training_sample(docs, per_lang))
    return identify(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
