"""Hash chains and seals over event logs.

A chained log has run_id, seq, event_type, record (JSON text without its hash), prev_hash, hash and the seal columns.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import struct
import tempfile
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_text, hmac_hex, packed, record_digest, record_hash, unpacked
from ..functions.shipping import ship
from .scan import newest_before

ALG = "hmac-sha256"
#: Events after which a seal is due. Fixed values.
SEAL_AFTER = ["run.completed", "run.failed", "run.cancelled", "run.suspended", "run.paused"]
SEALED = "integrity.sealed"
MESSAGE = "seal-v1:{}:{}:{}"
SEAL_TYPES = {"seq": "bigint", "sealed_seq": "bigint", "sealed_hash": "string", "alg": "string", "key_id": "string", "signature": "string"}
CHAIN = "run_id string, seq bigint, event_type string, record string, prev_hash string, hash string, sealed_seq bigint, sealed_hash string, alg string, key_id string, signature string"


def _values(column: pa.Array) -> list:
    """to_pylist(), faster: texts, and numbers where none is null, come as numpy arrays."""
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) or not column.null_count else column.to_pylist()


def stamp(log: DataFrame, body: Column, secret: str | None = None, key_id: str | None = None, dealt: bool = False) -> DataFrame:
    """Chain an unhashed log, with a seal after each due event when a secret is given.

    Each hash covers the one before, so a run is stamped in order within one task, row after row; runs are independent.
    dealt: each run lies in one partition already, as a derived log's do.
    """
    ship(log.sparkSession)
    rows = log.select("run_id", "seq", "event_type", F.to_json(body).alias("body"))

    names = [c.split()[0] for c in CHAIN.split(", ")]
    kinds = [pa.int64() if c.split()[1] == "bigint" else pa.string() for c in CHAIN.split(", ")]

    def run(batches):
        @lru_cache(maxsize=65_536)
        def around(text, kind):
            """The canonical record of a body, cut where its event's prev_hash, run_id and seq go. Bodies repeat."""
            doc = {**json.loads(text), "event_type": kind, "prev_hash": None, "run_id": None, "seq": None}
            parts, cuts = ["{"], []
            for i, k in enumerate(sorted(doc)):
                own = k in ("prev_hash", "run_id", "seq")
                parts.append(f"{',' if i else ''}{canonical_text(k)}:" + ("" if own else canonical_text(doc[k])))
                if own:
                    cuts.append("".join(parts))
                    parts = []
            return *cuts, "".join(parts) + "}"

        key, mark = (secret or "").encode(), canonical_text(key_id)
        now, prev, at, run_text = None, None, 0, "null"
        for batch in batches:
            out, seals = [], []
            for run_id, kind, text in zip(*(_values(batch.column(i)) for i in (0, 2, 3)), strict=True):
                if run_id != now:
                    now, prev, at, run_text = run_id, None, 0, canonical_text(run_id)
                at += 1
                a, b, c, d = around(text, kind)
                record = f'{a}"{prev}"{b}{run_text}{c}{at}{d}' if prev else f"{a}null{b}{run_text}{c}{at}{d}"
                digest = hashlib.sha256(record.encode()).hexdigest()
                out.append((run_id, at, kind, record, prev, digest))
                prev = digest
                if secret is not None and kind in SEAL_AFTER:
                    sealed_seq = at
                    at += 1
                    sign = hmac.digest(key, MESSAGE.format(run_id, sealed_seq, digest).encode(), "sha256").hex()
                    record = f'{{"alg":"{ALG}","event_type":"{SEALED}","key_id":{mark},"prev_hash":"{prev}","run_id":{run_text},"sealed_hash":"{digest}","sealed_seq":{sealed_seq},"seq":{at},"signature":"{sign}"}}'
                    prev = hashlib.sha256(record.encode()).hexdigest()
                    seals.append((len(out), (sealed_seq, digest, ALG, key_id, sign)))
                    out.append((run_id, at, SEALED, record, digest, prev))
            columns = list(zip(*out)) if out else [()] * 6
            columns += [[None] * len(out) for _ in names[6:]]
            for place, seal in seals:
                for column, value in zip(columns[6:], seal, strict=True):
                    column[place] = value
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

    rows = rows if dealt else rows.repartition("run_id")
    return rows.sortWithinPartitions("run_id", "seq").mapInArrow(run, CHAIN)


def seal_plan(log: DataFrame) -> DataFrame:
    """(run_id, seq, sealed_seq): the places of the seals that stamp() sets; a seal follows each due event, and what comes later moves on by one. No hash is needed for them."""
    so_far = "over (partition by run_id order by seq rows between unbounded preceding and current row)"
    due = F.col("event_type").isin(SEAL_AFTER)
    rows = log.select("run_id", "seq", due.alias("due"))
    rows = rows.select("run_id", "due", F.expr(f"count(*) {so_far} + count_if(due) {so_far}").alias("seq"))
    return rows.where("due").select("run_id", "seq", (F.col("seq") - 1).alias("sealed_seq"))


def link_reasons(chain: DataFrame, content_ok: Column, anchors: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Every event with the reason it fails, or null. anchors: (run_id, last_hash) that a tail continues; unhashed prefixes are legal.

    block: cut runs into blocks of so many events (see scan), where one run may be too long for a task; the chain is then read twice.
    """
    if block is None:
        w = "over (partition by run_id order by seq rows between unbounded preceding and 1 preceding)"
        rows = chain.withColumn("_prev", F.expr(f"last(hash, true) {w}"))
    else:
        rows = newest_before(chain, "_prev", F.col("hash"), block)
    if anchors is not None:
        rows = rows.join(anchors.withColumnRenamed("last_hash", "_anchor"), "run_id", "left").withColumn("_prev", F.coalesce("_prev", "_anchor"))
    reason = (
        F.when(F.col("hash").isNull() & F.col("_prev").isNotNull(), "unhashed event after a hashed one")
        .when(F.col("hash").isNotNull() & ~F.col("prev_hash").eqNullSafe(F.col("_prev")), "prev_hash does not match")
        .when(F.col("hash").isNotNull() & ~F.coalesce(content_ok, F.lit(False)), "content does not match its hash")
    )
    return rows.withColumn("reason", reason)


def content_matches() -> Column:
    return record_hash("record") == F.col("hash")


class _Carried:
    """What the events of one run carry, by seq: their hash and how many events (seals aside) there are up to it. Of a long run the older ones go to a temporary file; seqs must rise."""

    HELD = 50_000
    _ITEM = struct.Struct(">q?32sq")

    def __init__(self):
        self.new, self.file, self.n = {}, None, 0

    def add(self, seq: int, digest: str | None, below: int) -> None:
        self.new[seq] = (digest, below)
        if len(self.new) > self.HELD:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for at, (own, count) in self.new.items():
                self.file.write(self._ITEM.pack(at, own is not None, hashlib.sha256((own or "").encode()).digest(), count))
            self.n += len(self.new)
            self.new = {}

    def find(self, seq: int, digest: str | None) -> tuple[bool, int | None]:
        """Whether the event at a seq carries a hash, and its count."""
        if seq in self.new:
            own, below = self.new[seq]
            return own is not None and own == digest, below
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            self.file.seek(mid * self._ITEM.size)
            at, hashed, own, below = self._ITEM.unpack(self.file.read(self._ITEM.size))
            if at == seq:
                return hashed and digest is not None and own == hashlib.sha256(digest.encode()).digest(), below
            low, high = (mid + 1, high) if at < seq else (low, mid)
        return False, None


_PASS = "run_id string, seq bigint, sealed_seq bigint, sealed_hash string, alg string, key_id string, signature string, carried boolean, below bigint, events bigint, bad_seq bigint, reason string, verified bigint"


def in_order(chain: DataFrame, content_ok: Column | None = None, seals: bool = True) -> DataFrame:
    """A chain whose partitions hold whole runs in order, as stamp() gives them, read in one pass: a row per seal (with its seq) and one per run (without).

    A seal's row says whether the event it names carries its hash, and how many events (seals aside) there are up to that event;
    a run's row how many it has, and what verify() gives. No rows move and none of a run is held but what _Carried holds.
    """
    ship(chain.sparkSession)
    named = list(SEAL_TYPES)[1:]
    content = F.col("record") if content_ok is None else content_ok
    rows = chain.select("run_id", "seq", "event_type", "hash", "prev_hash", content.alias("_content"), *[F.col(c) if seals else F.lit(None).cast(SEAL_TYPES[c]).alias(c) for c in named])
    judged, names = content_ok is not None, [c.split()[0] for c in _PASS.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in _PASS.split(", ")]

    def run(batches):
        now, begun, done = None, False, []
        held, waiting, events, prev, bad, reason, verified = None, {}, 0, None, None, None, 0

        def close():
            done.extend((now, *seal, False, None, None, None, None, None) for some in waiting.values() for seal in some)
            done.append((now, None, None, None, None, None, None, None, None, events, bad, reason, verified))

        for batch in batches:
            kind_of = batch.column(2)
            at = pc.indices_nonzero(pc.equal(kind_of, SEALED).fill_null(False)) if seals else pa.array([], pa.uint64())
            sealed = zip(*(batch.column(6 + i).take(at).to_pylist() for i in range(5)))
            for run_id, seq, kind, own, before, content in zip(*(_values(batch.column(i)) for i in range(6)), strict=True):
                if run_id != now or not begun:
                    if begun:
                        close()
                    now, begun = run_id, True
                    held, waiting, events, prev, bad, reason, verified = _Carried(), {}, 0, None, None, None, 0
                if own is None:
                    why = "unhashed event after a hashed one" if prev is not None else None
                elif before != prev:
                    why = "prev_hash does not match"
                else:
                    why = None if (content if judged else record_digest(content) == own) else "content does not match its hash"
                if why is not None and reason is None:
                    bad, reason = seq, why
                if own is not None:
                    verified += reason is None
                    prev = own
                if kind is not None and kind != SEALED:
                    events += 1
                if not seals:
                    continue
                held.add(seq, own, events)
                if waiting and seq in waiting:
                    done.extend((now, *seal, *held.find(seq, seal[2]), None, None, None, None) for seal in waiting.pop(seq))
                if kind == SEALED:
                    seal = (seq, *next(sealed))
                    if seal[1] is not None and seal[1] > seq:
                        waiting.setdefault(seal[1], []).append(seal)
                    else:
                        done.append((now, *seal, *(held.find(seal[1], seal[2]) if seal[1] is not None else (False, None)), None, None, None, None))
            yield rows_of(done)
            done = []
        if begun:
            close()
            yield rows_of(done)

    def rows_of(done):
        columns = list(zip(*done)) if done else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(run, _PASS)


def verify(chain: DataFrame, content_ok: Column | None = None, anchors: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Per run: first failing seq and reason (null if it verifies), and the hashed events before it. ordered: see in_order()."""
    if ordered and anchors is None:
        return in_order(chain, content_ok, seals=False).select("run_id", "bad_seq", "reason", "verified")
    # records are judged before rows move, and digests move as bytes
    judged = (content_matches() if content_ok is None else content_ok).alias("_content_ok")
    rows = chain.select("run_id", "seq", packed("hash").alias("hash"), packed("prev_hash").alias("prev_hash"), judged)
    anchors = None if anchors is None else anchors.withColumn("last_hash", packed("last_hash"))
    rows = link_reasons(rows, F.col("_content_ok"), anchors)
    bad = F.col("reason").isNotNull()
    # whether the run has failed so far: a running maximum over the order in which the links were checked
    rows = rows.withColumn("_bad", F.expr("max(reason is not null) over (partition by run_id order by seq rows between unbounded preceding and current row)"))
    return rows.groupBy("run_id").agg(
        F.min(F.when(bad, F.col("seq"))).alias("bad_seq"), F.min_by("reason", F.when(bad, F.col("seq"))).alias("reason"), F.count(F.when(F.col("hash").isNotNull() & ~F.col("_bad"), 1)).alias("verified")
    )


def judge_seals(chain: DataFrame, keyring: DataFrame | None, ordered: bool = False) -> DataFrame:
    """One row per seal: valid, unknown_key, unjudged, or the problem found first. keyring: (key_id, secret). ordered: see in_order()."""
    if ordered:
        return _judged(in_order(chain, F.lit(True)).where("seq is not null"), keyring).select("run_id", "seq", "sealed_seq", "key_id", "verdict")
    # a seal meets the event it names in a window by run and seq: each event once, each seal once more at that place
    named = ["seq", "sealed_seq", "sealed_hash", "alg", "key_id", "signature"]
    own = f"struct(seq as _at, hash as _own, false as _seal, {', '.join(f'cast(null as {t}) as {c}' for c, t in SEAL_TYPES.items())})"
    seal = f"if(event_type = '{SEALED}', struct(sealed_seq as _at, cast(null as string) as _own, true as _seal, {', '.join(named)}), null)"
    rows = chain.selectExpr("run_id", f"inline(array_compact(array({own}, {seal})))")
    rows = rows.withColumn("_hash", F.expr("max(_own) over (partition by run_id, _at)")).where("_seal").drop("_at", "_own", "_seal")
    return _judged(rows.withColumn("carried", F.col("_hash") == F.col("sealed_hash")), keyring).select("run_id", "seq", "sealed_seq", "key_id", "verdict")


def _judged(rows: DataFrame, keyring: DataFrame | None) -> DataFrame:
    """Seals that know whether their hash is carried, with their verdict."""
    if keyring is None:
        rows = rows.withColumn("_mac", F.lit(None).cast("string")).withColumn("_known", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(keyring, "key_id", "left")
        message = F.format_string(MESSAGE.replace("{}", "%s"), "run_id", F.col("sealed_seq").cast("string"), "sealed_hash")
        rows = rows.withColumn("_mac", hmac_hex("secret", message)).withColumn("_known", F.col("secret").isNotNull())
    verdict = (
        F.when(~F.coalesce("carried", F.lit(False)), "sealed hash not carried")
        .when(F.col("alg") != ALG, "unknown algorithm")
        .when(F.col("_known").isNull(), "unjudged")
        .when(~F.col("_known"), "unknown_key")
        .when(F.col("_mac") != F.col("signature"), "signature does not verify")
        .otherwise("valid")
    )
    return rows.withColumn("verdict", verdict)


def _reported(rows: DataFrame, keyring: DataFrame | None) -> DataFrame:
    """What in_order() gives as one row per run: the seal report, and what verify() gives. Only judged seals and runs move, once, by run."""
    is_run = F.col("seq").isNull()
    # a run's row has no key; it takes its id, so that a join with many keys does not gather such rows
    judged = _judged(rows.withColumn("key_id", F.when(is_run, F.col("run_id")).otherwise(F.col("key_id"))), keyring).select(packed("run_id").alias("run"), is_run.alias("is_run"), "sealed_seq", F.when(~is_run, F.col("verdict")).alias("verdict"), "below", "events", "bad_seq", "reason", "verified")
    valid, n = F.col("verdict") == "valid", lambda where: F.count(F.when(where, 1))
    per = judged.repartition("run").groupBy("run").agg(
        n(~F.col("is_run")).alias("seals"), n(valid).alias("valid"), F.max(F.when(valid, F.col("sealed_seq"))).alias("sealed_through"), F.max(F.when(valid, F.col("below"))).alias("below"),
        n(~F.col("verdict").isin("valid", "unknown_key", "unjudged")).alias("problems"), n(F.col("verdict") == "unknown_key").alias("unknown_keys"),
        F.max("events").alias("events"), F.max("bad_seq").alias("bad_seq"), F.max("reason").alias("reason"), F.max("verified").alias("verified_events"),
    )
    tail = (F.col("events") - F.coalesce("below", F.lit(0))).alias("unsigned_tail")
    return per.select(unpacked("run").alias("run_id"), "seals", "valid", "sealed_through", tail, "problems", _seal_state(keyring).alias("state"), "bad_seq", "reason", "verified_events")


def _seal_state(keyring: DataFrame | None) -> Column:
    n = lambda c: F.coalesce(c, F.lit(0))
    no_keys = F.lit(keyring is None)
    return F.when(n("problems") > 0, "INVALID").when(n("seals") == 0, "unsigned").when(no_keys | ((n("valid") == 0) & (n("unknown_keys") > 0)), "unverifiable").otherwise("verified")


def seal_report(chain: DataFrame, keyring: DataFrame | None, ordered: bool = False) -> DataFrame:
    """Per run: seals, valid ones, highest seq a valid seal covers, events after it, state. ordered: see in_order()."""
    if ordered:
        return _reported(in_order(chain, F.lit(True)), keyring).drop("bad_seq", "reason", "verified_events")
    judged = judge_seals(chain, keyring)
    per = judged.groupBy("run_id").agg(
        F.count("*").alias("seals"), F.count(F.when(F.col("verdict") == "valid", 1)).alias("valid"), F.max(F.when(F.col("verdict") == "valid", F.col("sealed_seq"))).alias("sealed_through"),
        F.count(F.when(~F.col("verdict").isin("valid", "unknown_key", "unjudged"), 1)).alias("problems"), F.count(F.when(F.col("verdict") == "unknown_key", 1)).alias("unknown_keys"),
    )
    rows = chain.select("run_id", "seq", "event_type").join(per, "run_id", "left")
    out = rows.groupBy("run_id", "seals", "valid", "sealed_through", "problems", "unknown_keys").agg(
        F.count(F.when((F.col("event_type") != SEALED) & (F.col("sealed_through").isNull() | (F.col("seq") > F.col("sealed_through"))), 1)).alias("unsigned_tail")
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select("run_id", n("seals").alias("seals"), n("valid").alias("valid"), "sealed_through", "unsigned_tail", n("problems").alias("problems"), _seal_state(keyring).alias("state"))


def state_in_order(chain: DataFrame, keyring: DataFrame | None, content_ok: Column | None = None) -> DataFrame:
    """chain_state() of what verify() and seal_report() give for one chain, in one pass (see in_order())."""
    rows = _reported(in_order(chain, content_ok), keyring)
    return _state(rows)


def chain_state(verified: DataFrame, seals: DataFrame) -> DataFrame:
    """A broken chain or an invalid seal fails; unsigned or unverifiable seals do not."""
    return _state(verified.join(seals, "run_id"))


def _state(rows: DataFrame) -> DataFrame:
    error = F.when(F.col("bad_seq").isNotNull(), F.concat(F.lit("chain: "), F.col("reason"))).when(F.col("state") == "INVALID", "seals")
    return rows.select("run_id", error.isNull().alias("verified"), "state", "sealed_through", error.alias("error"))


def fleet_report(states: DataFrame) -> DataFrame:
    """Runs by verdict: FAIL, warn (not signed or not verifiable) or ok."""
    verdict = F.when(~F.col("verified"), "FAIL").when(F.col("state") != "verified", "warn").otherwise("ok")
    return states.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("runs"))


def sealed_through(chain: DataFrame) -> DataFrame:
    """Seq that each run's last seal names."""
    return chain.where(F.col("event_type") == SEALED).groupBy("run_id").agg(F.max_by("sealed_seq", "seq").alias("sealed_through"))
