"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every whole text. The hash of each secret value is counted over the corpus by distinct repositories
and owners: a value that many owners or very many repositories carry is a copied example, a value bound to few that looks random is
treated as live. Counting goes by (value, owner, repository), then (value, owner), then value, each with a partial aggregate, so a value
that stands in a third of all documents is no single task's work.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, let_go, masked, ship

_GAP = r"(?:\s|\\[nr])"
#: A private key: its first line, header lines, base64 lines (the last may be short before the END line or with its padding), the END line if there is one.
_PEM = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_GAP}*+[A-Za-z-]+:[^\n\\]*+)*+((?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)*+(?:{_GAP}*+[A-Za-z0-9+/]+(?:={{1,2}}|={{0,2}}(?={_GAP}*-----END)))?)(?:{_GAP}*+-----END [A-Z ]*PRIVATE KEY-----)?"
#: Kinds in listing order. The first three are the base kinds. (name, pattern, group of the value, least length of the value)
PATTERNS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", _PEM, 1, 20),
]
_BLANKS = re.compile(_GAP)
_ORDER = {name: i for i, (name, *_) in enumerate(PATTERNS)}
_COMPILED = [(name, re.compile(p), group, least) for name, p, group, least in PATTERNS]
#: A text without one of these holds no match of the kind.
_NEEDS = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "github": ("gh",), "slack": ("xox",), "google": ("AIza",), "jwt": ("eyJ",), "pem": ("-----BEGIN ",)}


def find_spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in code points, by start and then kind; leftmost, not overlapping within a kind.

    The value of a private key is its body without blanks, so that the same key has one hash however its lines are broken; its
    span reaches from the first line to the END line, or over the base64 lines where that is missing. A first line without a
    body is no key.
    """
    if not text:
        return []
    low = text.lower()
    out = []
    for name, pattern, group, least in _COMPILED:
        if name == "assign":
            if not any(w in low for w in _NEEDS[name]):
                continue
        elif name in _NEEDS and not any(w in text for w in _NEEDS[name]):
            continue
        for m in pattern.finditer(text):
            value = _BLANKS.sub("", m.group(group)) if name == "pem" else m.group(group)
            if len(value) >= least:
                out.append((name, m.start(), m.end(), value))
    out.sort(key=lambda x: (x[1], _ORDER[x[0]]))
    return out


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


_SCAN = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, row_key string, found array<struct<kind:string,start:bigint,stop:bigint,hash:string,random:boolean>>"


def scan(docs: DataFrame, carry: list[str], text_col: str = "text", min_entropy: float = 2.5) -> DataFrame:
    """carry columns and what is found in each whole text; row_key is a digest of the text where anything is found."""
    ship(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())])

    def run(batches):
        let_go()
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column(0).to_pylist():
                spans = find_spans(t)
                base = [x for x in spans if _ORDER[x[0]] < 3]
                n = Counter(x[0] for x in base)
                row = (
                    n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans),
                    hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() if spans else None,
                    [{"kind": k, "start": s, "stop": e, "hash": hashlib.sha256(v.encode()).hexdigest(), "random": entropy(v) >= min_entropy} for k, s, e, v in spans],
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(item)]
            arrays = [*b.columns[1:], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, [str(i) for i in range(len(arrays))])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [_SCAN])
    return docs.select(F.col(text_col).alias("_t"), *[F.col(f"`{c}`") for c in carry]).mapInArrow(run, schema)


def ownership(found: DataFrame, owner: str, repository: str, example_owners: int = 3, example_repositories: int = 25) -> DataFrame:
    """(hash, n_repositories, n_owners, class) over rows with found: class is example, live or weak.

    example: carried by `example_owners` owners or more, or by `example_repositories` distinct repositories of whatever owners (a
    key of documentation that one large owner copies everywhere); live: by fewer, and random enough; weak: the rest. A null
    owner or repository counts as one owner or repository of its own.
    """
    each = found.select(F.explode("found").alias("f"), F.col(owner).alias("o"), F.col(repository).alias("r"))
    each = each.select("f.hash", "f.random", "o", "r").groupBy("hash", "o", "r").agg(F.max("random").alias("random"))
    by_owner = each.groupBy("hash", "o").agg(F.count("*").alias("repositories"), F.max("random").alias("random"))
    total = by_owner.groupBy("hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"), F.max("random").alias("random"))
    kind = F.when((F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories), "example").when(F.col("random"), "live").otherwise("weak")
    return total.select("hash", "n_repositories", "n_owners", kind.alias("class"))


def _classes(found: DataFrame, stats: DataFrame) -> DataFrame:
    """(row_key, classes): of each text with candidates, the class of each of its hashes."""
    pairs = found.where("row_key is not null").select("row_key", F.explode("found.hash").alias("hash")).distinct()
    return pairs.join(stats.select("hash", "class"), "hash").groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("hash", "class"))).alias("classes"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", example_owners: int = 3) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, and how many spans are live, example or weak.

    Null or empty text: no spans, the digest of the empty string. Repeated rows come back repeated. An empty table gives no
    rows. Other columns are not read.
    """
    picked = docs.select(F.col(id_col).alias("_id"), F.col(owner_col).cast("string").alias("_owner"), F.col(repository_col).cast("string").alias("_repo"), F.col(text_col).alias("_text"))
    found = cut(scan(picked, ["_id", "_owner", "_repo"], "_text"))
    classes = _classes(found, ownership(found.where("row_key is not null"), "_owner", "_repo", example_owners))
    rows = found.where("row_key is not null").join(classes, "row_key").unionByName(found.where("row_key is null").withColumn("classes", F.lit(None).cast("map<string,string>")))
    count = lambda c: F.coalesce(F.size(F.filter("found", lambda f: F.element_at("classes", f["hash"]) == c)).cast("bigint"), F.lit(0)).alias(f"n_{c}")
    return rows.select(F.col("_id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", count("live"), count("example"), count("weak"))


def _redact(text: str, spans, classes: dict[str, str], mark: str) -> str:
    out, at = [], 0
    for f in spans:
        if classes.get(f["hash"]) == "live" and f["start"] >= at:
            out += [text[at : f["start"]], mark]
            at = f["stop"]
        elif classes.get(f["hash"]) == "live" and f["stop"] > at:
            at = f["stop"]
    return "".join([*out, text[at:]])


def redact_live(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", length_col: str = "n_chars", mark: str = "[SECRET]", example_owners: int = 3) -> DataFrame:
    """The rows of `docs`, columns as they are, with every live credential replaced by `mark` and the length column set anew.

    Copied examples and weak values stay. Only documents with candidates are shuffled; the others pass through the scan. Null or
    empty texts pass as they are; null ids, owners and repeated rows count as in ownership() and come back as often as they
    are given. An empty table gives no rows.
    """
    renamed, columns, of = masked(docs)
    text_col, length_col = of[text_col], of.get(length_col)
    narrow = renamed.select(F.col(of[owner_col]).cast("string").alias("_owner"), F.col(of[repository_col]).cast("string").alias("_repo"), F.col(text_col).alias("_text"))
    found = cut(scan(narrow, ["_owner", "_repo"], "_text").where("row_key is not null").select("_owner", "_repo", "row_key", "found"))
    classes = _classes(found, ownership(found, "_owner", "_repo", example_owners))
    whole = scan(renamed, columns, text_col)
    clean = whole.where("row_key is null").select(*columns)
    dirty = whole.where("row_key is not null").join(classes, "row_key")
    kinds = {f.name: f.dataType for f in renamed.schema}

    def run(batches):
        let_go()
        for b in batches:
            text = [_redact(t, s, dict(c or []), mark) for t, s, c in zip(b.column("_text").to_pylist(), b.column("found").to_pylist(), b.column("classes").to_pylist(), strict=True)]
            arrays = []
            for c in columns:
                if c == text_col:
                    arrays.append(pa.array(text, b.column(c).type))
                elif c == length_col:
                    arrays.append(pa.array([len(t) for t in text]).cast(b.column(c).type))
                else:
                    arrays.append(b.column(c))
            yield pa.RecordBatch.from_arrays(arrays, columns)

    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in columns)
    fixed = dirty.withColumn("_text", F.col(text_col)).select(*columns, "_text", "found", "classes").mapInArrow(run, schema)
    return clean.unionByName(fixed).toDF(*docs.columns)
