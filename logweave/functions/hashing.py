"""Hashes over exact bytes, as Arrow functions: canonical JSON digests and keyed digests."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shipping import ship


#: JSON text with sorted keys, no blanks, ASCII escapes.
canonical_text = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode


def canonical(record: dict) -> bytes:
    """Sorted keys, no blanks, ASCII escapes."""
    return canonical_text(record).encode()


def packed(digest: Column | str) -> Column:
    """A digest as bytes, half as long as its lowercase hex digits; any other text keeps its bytes. Equal only where the texts are; null for null."""
    text = F.col(digest) if isinstance(digest, str) else digest
    hexed = text.rlike("^(?:[0-9a-f]{2})+$")
    return F.when(hexed, F.concat(F.lit(b"\x00"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x01"), F.encode(text, "UTF-8")))


def unpacked(digest: Column | str) -> Column:
    """The text that packed() made bytes of."""
    data = F.col(digest) if isinstance(digest, str) else digest
    rest = F.substring(data, F.lit(2), F.length(data))
    return F.when(F.substring(data, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


#: Values that differ from record to record and are their own canonical text: plain strings and whole numbers under known names.
_VARYING = re.compile(r'''"(prev_hash|run_id|seq|sealed_hash|sealed_seq|signature)":(?:"[0-9A-Za-z_.:-]*"|0(?=[,}])|[1-9][0-9]{0,17}(?=[,}]))''')
#: Shapes of records (what stands around such values, and their names) that were seen, and whether such records are canonical.
_shapes: dict[tuple[str, ...], bool] = {}


def _slow_record_digest(text: str | None) -> str | None:
    try:
        doc = json.loads(text)
        doc.pop("hash", None)
    except (TypeError, ValueError, AttributeError):
        return None
    return hashlib.sha256(canonical(doc)).hexdigest()


def record_digest(text: str | None) -> str | None:
    """SHA-256 of a record's canonical JSON without its own hash; null for null or unreadable text.

    Whether a record is its own canonical text does not depend on its varying values, only on its shape; shapes repeat and are
    remembered, so that most records need no parser.
    """
    if text is None:
        return None
    shape = tuple(_VARYING.split(text))
    canonical_so = _shapes.get(shape)
    if canonical_so:
        return hashlib.sha256(text.encode()).hexdigest()
    digest = _slow_record_digest(text)
    if canonical_so is None:
        if len(_shapes) >= 65_536:
            _shapes.clear()
        _shapes[shape] = digest is not None and digest == hashlib.sha256(text.encode()).hexdigest()
    return digest


def _record_hashes(records: pd.Series) -> pd.Series:
    return records.map(record_digest)


def _macs(secrets: pd.Series, messages: pd.Series) -> pd.Series:
    return pd.Series([None if k is None or m is None else hmac.digest(k.encode(), m.encode(), "sha256").hex() for k, m in zip(secrets, messages, strict=True)], dtype=object)


def record_hash(record: Column | str) -> Column:
    """SHA-256 of the canonical JSON of a stored record without its own hash; null for null or unreadable text."""
    ship()
    return F.pandas_udf(_record_hashes, "string")(record)


def hmac_hex(secret: Column | str, message: Column | str) -> Column:
    """Hex HMAC-SHA256 of UTF-8 text; null if either side is null."""
    ship()
    return F.pandas_udf(_macs, "string")(secret, message)
