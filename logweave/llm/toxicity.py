"""Toxicity by a weighted finite-state grammar of clauses.

A text is split into clauses, and each word gets a symbol from a character transducer: insult, threat, target, negation, reported
speech or other. Small word-level transducers then mark insults and threats with what stands about them: negated within a few
words, reported by an earlier verb or quotation mark of the clause, directed at a target before (read forwards) or after (read
backwards). They are composed into one weighted machine; a clause weighs the sum of its hits, each the word's own weight times the
weight of its path. Whole texts are scored from their clauses' weights, in all and by length.

What is learned: the words and stems of the insult transducer with their weights (log-odds between labelled texts, from counts of
stems that Spark adds up), the machine's path weights, and the slope of the score. Learning reads a bounded sample of labelled rows
(PER_LABEL, MAX_CHARS), near copies of one text once; scoring reads every row whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, cut, ship

#: Bounds of the sample that is learned from: rows of each label, characters of a row; stems that reach the driver.
PER_LABEL, MAX_CHARS, MAX_STEMS = {1: 5_000, 0: 20_000}, 20_000, 50_000
#: Characters of a learned stem, texts that must hold it, and how sure it must be (twice a log-likelihood ratio).
STEM, LEAST_TEXTS, SURE = range(3, 13), 3, 24.0
#: Words that negation and targets reach; a score from here on is a prediction.
NEGATION_SPAN, TARGET_SPAN, THRESHOLD = 3, 4, 0.7
#: Characters of a text that are taken apart at once; words whose symbols a worker remembers.
PIECE, REMEMBER = 2_000_000, 300_000

# Seed words of the transducers, by role.
INSULTS = ["idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "imbecile", "filth", "vermin", "dumb", "ugly", "crétin", "connard", "salaud", "ordure", "abruti", "dummkopf", "arschloch", "abschaum", "trottel", "vollidiot", "idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "cabrón"]
THREATS = ["kill", "murder", "hurt", "destroy", "strangle", "shoot", "stab", "beat", "tuer", "tuerai", "frapper", "détruire", "töten", "umbringen", "verletzen", "erschießen", "matar", "mataré", "golpear", "destruir"]
TARGETS = ["you", "your", "yours", "u", "he", "she", "they", "them", "him", "her", "people", "everyone", "tu", "toi", "vous", "il", "elle", "ils", "elles", "du", "dich", "dir", "ihr", "euch", "sie", "tú", "ti", "te", "usted", "ustedes", "ellos", "ellas"]
NEGATIONS = ["not", "no", "never", "nobody", "without", "ne", "pas", "jamais", "sans", "nicht", "kein", "keine", "keinen", "nie", "niemals", "nunca", "jamás", "sin"]
REPORTS = ["said", "says", "wrote", "writes", "called", "calls", "claimed", "quoted", "reported", "told", "dit", "écrit", "appelé", "raconte", "sagte", "schrieb", "nannte", "behauptet", "dijo", "escribió", "llamó", "cuenta", '"', "“", "”", "«", "»", "„"]

OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = range(6)
DIRECTED, NEGATED, REPORTED = 8, 16, 32
FLAGS = (DIRECTED, NEGATED, REPORTED)
#: Every symbol that a machine reads or writes.
SYMBOLS = [OTHER, TARGET, NEGATION, REPORT, *(hit | a | b | c for hit in (INSULT, THREAT) for a in (0, DIRECTED) for b in (0, NEGATED) for c in (0, REPORTED))]
HITS = [s for s in SYMBOLS if s & 7 in (INSULT, THREAT)]
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n\"“”«»„]")
ENDS = frozenset(".!?;\n")


class Transducer:
    """A deterministic weighted transducer: arcs[state][symbol] = (next state, symbol written, log weight). State 0 begins, all states end."""

    def __init__(self, arcs: list[dict[int, tuple[int, int, float]]]):
        self.arcs = arcs

    def run(self, symbols: list[int]) -> tuple[list[int], list[float]]:
        state, out, weights = 0, [], []
        for s in symbols:
            state, written, w = self.arcs[state][s]
            out.append(written)
            weights.append(w)
        return out, weights


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that runs `second` on what `first` writes; weights multiply. Only states that can be reached."""
    number, arcs, queue = {(0, 0): 0}, [], [(0, 0)]
    for a, b in queue:
        row = {}
        for s, (na, middle, wa) in first.arcs[a].items():
            nb, out, wb = second.arcs[b][middle]
            if (na, nb) not in number:
                number[na, nb] = len(number)
                queue.append((na, nb))
            row[s] = number[na, nb], out, wa + wb
        arcs.append(row)
    return Transducer(arcs)


def context(trigger: int, span: int | None, flag: int, weight: float = 0.0) -> Transducer:
    """Marks hits with `flag` where `trigger` stands up to `span` words before (anywhere before, if None)."""
    last = span or 1
    arcs: list[dict[int, tuple[int, int, float]]] = []
    for state in range(last + 1):
        after = state if span is None else max(state - 1, 0)
        row = {}
        for s in SYMBOLS:
            if s == trigger:
                row[s] = last, s, 0.0
            elif state and s in HITS and not s & flag:
                row[s] = after, s | flag, weight
            else:
                row[s] = after, s, 0.0
        arcs.append(row)
    return Transducer(arcs)


class Grammar:
    """The composed machine, read forwards, and the one for targets behind a hit, read backwards."""

    def __init__(self, directed: float = 0.0, negated: float = 0.0, reported: float = 0.0):
        self.forwards = compose(compose(context(NEGATION, NEGATION_SPAN, NEGATED, negated), context(REPORT, None, REPORTED, reported)), context(TARGET, TARGET_SPAN, DIRECTED, directed))
        self.backwards = context(TARGET, TARGET_SPAN, DIRECTED, directed)

    def hits(self, symbols: list[int]) -> list[tuple[int, int, float]]:
        """(place, marked symbol, log weight of its path) of each hit of a clause. A threat that is directed at nobody is none."""
        written, w = self.forwards.run(symbols)
        turned, v = self.backwards.run(written[::-1])
        return [(i, s, w[i] + v[-1 - i]) for i, s in enumerate(turned[::-1]) if s & 7 == INSULT or (s & 7 == THREAT and s & DIRECTED)]


class Lexicon(dict):
    """The character transducer: (symbol, weight) of a word, by its longest known stem or as a whole; remembers words it has seen."""

    def __init__(self, words: dict[str, tuple[int, float]], stems: dict[str, float]):
        super().__init__()
        self.fixed = {w: (r, 0.0) for r, known in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in known} | words
        self.arcs: list[dict[str, int]] = [{}]
        self.weight: list[float] = [0.0]
        for stem, w in stems.items():
            state = 0
            for c in stem:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.weight.append(0.0)
                state = self.arcs[state][c]
            self.weight[state] = w

    def __reduce__(self):
        return _as_lexicon, (self.fixed, self.arcs, self.weight)

    def read(self, word: str) -> tuple[int, float]:
        if word in self.fixed:
            return self.fixed[word]
        state, found, arcs = 0, 0.0, self.arcs
        for c in word:
            state = arcs[state].get(c, -1)
            if state < 0:
                break
            found = self.weight[state] or found
        if found:
            return INSULT, found
        if "'" in word or "’" in word:
            head, tail = re.split("['’]", word, maxsplit=1)
            if tail == "t" or head == "n":  # don't, n'est
                return NEGATION, 0.0
            return self.read(tail) if len(head) <= 2 else self.read(head)
        return OTHER, 0.0

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > REMEMBER:
            self.clear()
        self[word] = found = (OTHER, 0.0) if len(word) == 1 and word in ENDS else self.read(word)
        return found


def _as_lexicon(fixed, arcs, weight) -> Lexicon:
    out = Lexicon({}, {})
    out.fixed, out.arcs, out.weight = fixed, arcs, weight
    return out


def pieces(text: str, size: int = PIECE):
    """Parts of a text in lower case that end with a clause."""
    at = 0
    while at < len(text):
        stop = len(text)
        if at + size < stop:
            found = re.compile(r"[.!?;\n]").search(text, at + size)
            stop = found.end() if found else stop
        yield text[at:stop].lower()
        at = stop


def clause_hits(text: str, lexicon: Lexicon, grammar: Grammar) -> tuple[int, list[tuple[int, float, float]]]:
    """(words, hits) of a whole text; a hit is (marked symbol, weight of the word, log weight of the path). Clauses without a hit do not run."""
    n, out = 0, []
    for part in pieces(text):
        tokens = TOKEN.findall(part)
        n += len(tokens)
        read = list(map(lexicon.__getitem__, tokens))
        at = [i for i, (s, _) in enumerate(read) if s >= INSULT]
        done = -1
        for i in at:
            if i <= done:
                continue
            lo, hi = i, i
            while lo > 0 and tokens[lo - 1] not in ENDS:
                lo -= 1
            while hi < len(tokens) and tokens[hi] not in ENDS:
                hi += 1
            out += [(s, read[lo + k][1], w) for k, s, w in grammar.hits([s for s, _ in read[lo:hi]])]
            done = hi
    return n, out


def learned_from(id_col: str = "doc_id") -> Column:
    """Column: labels of the document may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_label: dict[int, int] = PER_LABEL, max_chars: int = MAX_CHARS) -> DataFrame:
    """text, toxic of a bounded sample of labelled rows, drawn by a hash of the id; never held-out rows, and texts that share their least five-word shingle once.

    Labels are thinned by a hash threshold set from their counts before they are ranked, so no label meets in one task, and only
    the chosen ids are joined to the texts. A document with both labels counts as toxic.
    """
    known = labels.select(F.col("doc_id").alias("_d"), F.col("toxic").cast("int").alias("toxic")).where(learned_from("_d") & F.col("toxic").isin(0, 1))
    known = known.groupBy("_d").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.lit(False), 0.0)
    for label, n in counts.items():
        share = share.when(F.col("toxic") == label, min(1.0, (2.0 * per_label[label] + 20) / n))
    u = F.pmod(F.xxhash64(F.lit("toxic"), "_d"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = known.withColumn("u", u).where(F.col("u") < share)
    most = F.when(F.col("toxic") == 1, per_label[1]).otherwise(per_label[0])
    chosen = thin.withColumn("r", F.row_number().over(W.partitionBy("toxic").orderBy("u", "_d"))).where(F.col("r") <= most).select("_d", "toxic")
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_d")).select("toxic", "text")  # at most the sum of per_label

    def keyed(batches):
        for b in batches:
            keys = []
            for text in as_bytes(b.column(1)):
                words = text.lower().split()
                keys.append(min(xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], ["toxic", "text", "key"])

    return cut(rows.mapInArrow(keyed, "toxic int, text string, key bigint").groupBy("toxic", "key").agg(F.min("text").alias("text")).drop("key"))


def stem_counts(sample: DataFrame) -> dict[str, tuple[int, int]]:
    """(toxic, other) counts of words with each stem (a word's beginning, or the whole word and "$"), a word once a text; stems of LEAST_TEXTS toxic words, the MAX_STEMS most frequent."""

    def run(batches):
        found: Counter = Counter()

        def rows():
            keys = list(found)
            out = [pa.array([k[0] for k in keys], pa.string()), pa.array([found[k] if k[1] else 0 for k in keys], pa.int64()), pa.array([0 if k[1] else found[k] for k in keys], pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(out, ["stem", "a", "b"])

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in {t for t in TOKEN.findall(text.lower()) if t[0].isalpha()}:
                    found[w + "$", toxic] += 1
                    for k in STEM:
                        if k >= len(w):
                            break
                        found[w[:k], toxic] += 1
            if len(found) > 400_000:
                yield rows()
        yield rows()

    total = sample.mapInArrow(run, "stem string, a bigint, b bigint").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = total.where(F.col("a") >= LEAST_TEXTS).orderBy(F.desc("a"), "b", "stem").limit(MAX_STEMS).collect()
    return {r["stem"]: (r["a"], r["b"]) for r in rows}


def log_odds(a: float, b: float, n_toxic: int, n_other: int) -> float:
    return math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_other + 1))


def sureness(a: float, b: float, n_toxic: int, n_other: int) -> float:
    """Twice the log-likelihood ratio of a stem more frequent in toxic texts, else 0."""
    p = n_toxic / (n_toxic + n_other)
    if a <= (a + b) * p:
        return 0.0
    return 2 * (a * math.log(a / ((a + b) * p)) + (b * math.log(b / ((a + b) * (1 - p))) if b else 0.0))


def learn_lexicon(counts: dict[str, tuple[int, int]], n_toxic: int, n_other: int) -> Lexicon:
    """Seeds weigh 2 before data; learned words and stems are those that are surely more frequent in toxic texts, without what longer ones account for."""
    words: dict[str, tuple[int, float]] = {}
    for role, seeds in ((INSULT, INSULTS), (THREAT, THREATS)):
        for w in seeds:
            a, b = counts.get(w + "$", (0, 0))
            own = (4 * 2.0 + (a + b) * log_odds(a, b, n_toxic, n_other)) / (4 + a + b)
            if own > 0.5:
                words[w] = role, min(own, 6.0)
    stems: dict[str, float] = {}
    if not n_toxic or not n_other:
        return Lexicon(words, stems)
    taken: dict[str, list[int]] = {}
    for stem in sorted(counts, key=lambda s: (-len(s), s)):
        whole = stem.endswith("$")
        a, b = counts[stem]
        less = taken.get(stem, [0, 0])
        ra, rb = a - less[0], b - less[1]
        if ra < LEAST_TEXTS or sureness(ra, rb, n_toxic, n_other) < SURE:
            continue
        weight = min(log_odds(ra, rb, n_toxic, n_other), 6.0)
        if weight < 1.0 or (whole and stem[:-1] in words):
            continue
        if whole:
            words[stem[:-1]] = INSULT, weight
        else:
            stems[stem] = weight
        core = stem.rstrip("$")
        for k in STEM:
            if k >= len(core) + whole:
                break
            if core[:k] != stem:
                seen = taken.setdefault(core[:k], [0, 0])
                seen[0], seen[1] = seen[0] + ra, seen[1] + rb
    return Lexicon(words, stems)


class Model:
    """Lexicon, grammar and the slope of the score."""

    #: Directed, negated, reported, threat (log weights); bias, slope by amount, slope by density.
    PRIOR = np.array([0.3, -0.7, -0.5, 0.0, -3.0, 1.0, 0.5])

    def __init__(self, lexicon: Lexicon, params: np.ndarray | None = None):
        self.lexicon, self.params = lexicon, self.PRIOR if params is None else params
        self.grammar = Grammar(*self.params[:3])

    def score(self, text: str) -> tuple[float, int]:
        n, hits = clause_hits(text, self.lexicon, self.grammar)
        amount = sum(own * math.exp(path + (self.params[3] if s & 7 == THREAT else 0.0)) for s, own, path in hits)
        z = self.params[4] + self.params[5] * math.log1p(amount) + self.params[6] * math.log1p(100 * amount / (n + 20))
        return 1 / (1 + math.exp(-max(min(z, 60.0), -60.0))), len(hits)


def _features(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights of hits by marked symbol, words, label) of the sample's texts: its rows bound what reaches the driver."""
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)
    place = {s: i for i, s in enumerate(HITS)}

    def run(batches):
        plain = Grammar()
        for b in batches:
            n, rows = [], []
            for text in b.column(1).to_pylist():
                words, hits = clause_hits(text, sent.value, plain)
                own = [0.0] * len(HITS)
                for s, w, _ in hits:
                    own[place[s]] += w
                n.append(words)
                rows.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "n", "e"])

    got = sorted((r["toxic"], r["n"], r["e"]) for r in sample.mapInArrow(run, "toxic int, n bigint, e array<double>").collect())
    return np.array([r[2] for r in got], np.float64).reshape(-1, len(HITS)), np.array([r[1] for r in got], np.float64), np.array([r[0] for r in got], np.float64)


def fit_params(e: np.ndarray, n: np.ndarray, y: np.ndarray, steps: int = 600, hold: float = 2.0) -> np.ndarray:
    """Path weights and slopes by gradient descent (Adam) on the logistic loss, held to PRIOR by a quadratic term."""
    p, prior = Model.PRIOR.copy(), Model.PRIOR
    if not len(y):
        return p
    marks = np.array([[bool(s & f) for f in FLAGS] + [s & 7 == THREAT] for s in HITS], np.float64)
    m, v, c = np.zeros_like(p), np.zeros_like(p), 100 / (n + 20)
    for step in range(1, steps + 1):
        own = e * np.exp(marks @ p[:4])
        amount = own.sum(axis=1)
        u, d = np.log1p(amount), np.log1p(c * amount)
        gap = 1 / (1 + np.exp(-np.clip(p[4] + p[5] * u + p[6] * d, -60, 60))) - y
        by_amount = gap * (p[5] / (1 + amount) + p[6] * c / (1 + c * amount))
        g = np.concatenate([by_amount @ (own @ marks), [gap.sum(), gap @ u, gap @ d]]) + hold * (p - prior)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        p[5:] = np.maximum(p[5:], 0.0)
    return p


def fit(docs: DataFrame, labels: DataFrame, per_label: dict[int, int] = PER_LABEL) -> Model:
    ship(docs.sparkSession)
    sample = training_sample(docs, labels, per_label)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    lexicon = learn_lexicon(stem_counts(sample), n.get(1, 0), n.get(0, 0))
    return Model(lexicon, fit_params(*_features(sample, lexicon)))


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """carry columns, score (0 to 1) and n_hits (insults and directed threats) of every row's whole text; a null text is an empty one."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by MAX_STEMS

    def run(batches):
        m = sent.value
        for b in batches:
            got = [m.score(text or "") for text in b.column(0).to_pylist()]
            cols = [*b.columns[1:], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [str(i) for i in range(len(cols))])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + ["score double", "n_hits bigint"])
    return docs.select(F.col("text").alias("_t"), *[F.col(f"`{c}`") for c in carry]).mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_hits.

    Null, empty and wordless texts have the score of a text without hits. Null ids are never learned from and not held out. Labels
    that are null or neither 0 nor 1, and labels of unknown documents, are left out; a document with both labels counts as toxic.
    Without labels of both kinds only the seed words count, with weights before data. Repeated rows come back repeated; an empty
    table gives no rows. Other columns are left out, whatever their names.
    """
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    out = score(docs.select("doc_id", "text"), model, ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")
