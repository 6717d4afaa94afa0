"""SentencePiece encoding and decoding with distinct sampled segmentations.

The lattice of a text has an edge for every vocabulary piece that occurs in it; a piece's log-probability is Zipf's by its id
(the model file's scores are merge ranks), times `alpha`. Characters outside the vocabulary are one edge of byte pieces. No
piece continues over the start of a blank run or a newline, so the lattice is a chain of the lattices of its words; those are
built once per distinct word, with backward sums, which give every edge its conditional probability.

Sampling without replacement is Gumbel top-k by A* over regions of the lattice. Minus the logarithm of a perturbed score is an
arrival time of an exponential race: a region of mass m that may not arrive before time t arrives at t + E/m. The whole lattice
is the first region. The best region yields its best segmentation, drawn by forward sampling within it, and what is left of
it splits along that path: for each step, the same prefix with another edge. Backward sums make the regions' masses exact, so
the search is exact and opens only the regions it needs. After k segmentations the next arrival time is the threshold of the
inclusion probabilities 1 - exp(-p * threshold).

All random numbers hash the row's key with the sample, word and step: the result of a row does not depend on its batch.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, ship, slabs, worker_cache

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
#: Lattice positions kept per worker before the cache starts anew.
CACHE = 1_500_000
#: Characters that are sampled at once.
SLAB = 250_000
#: Edges that are kept room for, per position.
EDGES = 5
_models: dict[tuple, Lattices] = worker_cache()
_ALL = (1 << 64) - 1
#: A region of log mass below NEAR arrives after time exp(FAR): waiting times from 52-bit numbers are at least exp(-37).
NEAR, FAR = -60.0, 22.0
_MULT = np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from a 64-bit key of the row and further whole numbers."""
    x = keys
    for i, p in enumerate(parts):
        x = _mix(x + (np.atleast_1d(p).astype(np.uint64) + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def _mix_one(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def uniform(key: int, *parts: int) -> float:
    """uniforms() of one row."""
    x = key
    for i, p in enumerate(parts):
        x = _mix_one((x + (p + i + 1) * 0x9E3779B97F4A7C15) & _ALL)
    return ((x >> 12) + 0.5) / float(1 << 52)


class _Words(dict):
    """First position of each word's lattice; a new word gets the next stretch and is noted for learning."""

    def __init__(self, owner: Lattices, lead: str):
        self.owner, self.lead = owner, lead

    def __missing__(self, word: str) -> int:
        own = self.owner
        at = self[word] = own.next_pos
        whole = self.lead + word
        own.next_pos += len(whole) + 1
        own.pending.append(whole)
        return at


class Lattices:
    """Pieces of a model file, and the lattices of the words met so far."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        norm = np.log(np.sum(1.0 / np.arange(1, n + 1)))
        weight = -alpha * (np.log(np.arange(1, n + 1)) + norm)
        self.byte_ids = np.zeros(256, np.int64)
        raw: list[bytes] = []
        by_len: dict[int, tuple[list, list]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                raw.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i):
                raw.append(b"")
            else:
                raw.append(piece.encode())
                h, ids = by_len.setdefault(len(piece), ([], []))
                h.append(self._hash(piece))
                ids.append(i)
        self.max_len = max(by_len)
        self.tables = {}
        for k, (h, ids) in by_len.items():
            h, ids = np.array(h, np.uint64), np.array(ids, np.int64)
            order = np.argsort(h)
            sieve = np.zeros(1 << 18, bool)
            sieve[(h >> np.uint64(20)) & np.uint64(0x3FFFF)] = True
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces have one hash")
            self.tables[k] = (h[order], ids[order], sieve)
        self.weight = weight
        self.byte_weight = float(weight[-1])
        sizes = np.array([len(x) for x in raw], np.int64)
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_sizes, self.piece_starts = sizes, np.cumsum(sizes) - sizes
        self.reset()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_MULT) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def reset(self, capacity: int | None = None):
        self.capacity = capacity = capacity or CACHE
        self.next_pos = self.n_pos = self.n_edges = 0
        self.pending: list[str] = []
        self.start, self.after_blank = _Words(self, ""), _Words(self, SPACE)
        # rooms that fill up as words are learned; untouched room costs no memory
        self.ends = np.zeros(capacity, bool)  # by position: the word is over
        self.edge_from = np.zeros(capacity, np.int32)  # by position: its first edge
        self._room(capacity * EDGES)
        self.many: list[list[int]] = []

    def _room(self, edges: int):
        old = self.n_edges
        for name, kind in (("reach", np.float64), ("edge_pos", np.int32), ("step", np.int16), ("logq", np.float64), ("edge_id", np.int32)):
            fresh = np.zeros(edges, kind)
            if old:
                fresh[:old] = getattr(self, name)[:old]
            setattr(self, name, fresh)  # reach: position + cumulative probability; edge_id: a piece, or below zero bytes in self.many

    def learn(self, words: list[str]) -> None:
        """Build the lattices of new words."""
        sizes = np.array([len(w) for w in words], np.int64)
        text = "".join(words)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        total = len(cp)
        char_end = np.repeat(np.cumsum(sizes), sizes)  # in characters
        word = np.repeat(np.arange(len(words)), sizes)
        here = np.arange(total)
        h = np.zeros(total, np.uint64)
        froms, lens, ids, ws = [], [], [], []
        known = np.zeros(total, bool)
        for k in range(1, self.max_len + 1):
            if k > total:
                break
            h = h[: total - k + 1] * _MULT + cp[k - 1 :] + np.uint64(1)
            if k not in self.tables:
                continue
            keys, own, sieve = self.tables[k]
            inside = np.flatnonzero(sieve[(h >> np.uint64(20)) & np.uint64(0x3FFFF)] & (here[: total - k + 1] + k <= char_end[: total - k + 1]))
            at = np.minimum(np.searchsorted(keys, h[inside]), len(keys) - 1)
            hit = keys[at] == h[inside]
            p = inside[hit]
            froms.append(p)
            lens.append(np.full(len(p), k))
            ids.append(own[at[hit]])
            ws.append(self.weight[own[at[hit]]])
            if k == 1:
                known[p] = True
        odd = np.flatnonzero(~known)
        odd_bytes = [chr(int(cp[p])).encode("utf-8", "replace") for p in odd]
        froms.append(odd)
        lens.append(np.ones(len(odd), np.int64))
        ids.append(-1 - np.arange(len(odd)))
        ws.append(np.array([len(b) * self.byte_weight for b in odd_bytes]))
        frm, ln, pid, w = np.concatenate(froms), np.concatenate(lens), np.concatenate(ids), np.concatenate(ws)
        # positions: a word of L characters has L + 1
        pos = frm + word[frm]
        n_pos = total + len(words)
        last = np.cumsum(sizes + 1) - 1
        togo = np.repeat(last, sizes + 1) - np.arange(n_pos)
        beta = np.full(n_pos, -np.inf)
        beta[last] = 0.0
        order = np.argsort(togo[pos] * n_pos + pos)
        op, ol, ow = pos[order], ln[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], op[1:] != op[:-1]])) if len(op) else np.zeros(0, np.int64)
        layer = togo[op[first]] if len(first) else np.zeros(0, np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], layer[1:] != layer[:-1]])) if len(layer) else np.zeros(0, np.int64)
        for i, lo in enumerate(bounds):
            hi = bounds[i + 1] if i + 1 < len(bounds) else len(first)
            a = first[lo]
            b = first[hi] if hi < len(first) else len(op)
            v = ow[a:b] + beta[op[a:b] + ol[a:b]]
            beta[op[first[lo:hi]]] = np.logaddexp.reduceat(v, first[lo:hi] - a)
        order = np.argsort(pos * 64 + ln)
        pos, ln, pid, w = pos[order], ln[order], pid[order], w[order]
        logq = w + beta[pos + ln] - beta[pos]
        q = np.exp(logq)
        cum = np.cumsum(q)
        head = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]])) if len(pos) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([head, [len(pos)]]))
        cum -= np.repeat(np.where(head > 0, cum[head - 1], 0.0), counts)
        tails = head + counts - 1
        cum[tails] = 1.0
        base, lo = self.n_pos, self.n_edges
        hi = lo + len(pid)
        if hi + 1 > len(self.reach):
            self._room(2 * hi + 1)
        if len(odd):
            neg = np.flatnonzero(pid < 0)
            for e in neg:
                raw = odd_bytes[-1 - int(pid[e])]
                if len(raw) == 1:
                    pid[e] = self.byte_ids[raw[0]]
                else:
                    self.many.append([int(self.byte_ids[c]) for c in raw])
                    pid[e] = -len(self.many)
        self.edge_from[base + pos[head]] = lo + head
        self.ends[base + last] = True
        self.reach[lo:hi] = base + pos + cum
        self.edge_pos[lo:hi] = base + pos
        self.step[lo:hi] = ln
        self.logq[lo:hi] = logq
        self.edge_id[lo:hi] = pid
        self.n_pos, self.n_edges = base + n_pos, hi

    def _positions(self, text: str) -> list[int]:
        """Start positions of a text's words."""
        if not text:
            return []
        start, after_blank = self.start.__getitem__, self.after_blank.__getitem__
        if "  " in text or text[0] == " " or SPACE in text:
            return list(map(start, _UNITS.findall(SPACE + text.replace(" ", SPACE))))
        out: list[int] = []
        lead = after_blank  # the model's own blank before the text
        for line in text.split("\n"):
            if lead is not after_blank:
                out.append(start("\n"))
            head, *rest = line.split(" ")
            if head or lead is after_blank:
                out.append(lead(head))
            out.extend(map(after_blank, rest))
            lead = start
        return out

    def chains(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start positions of all words of all texts, and the number of words of each text."""
        found = [self._positions(t) for t in texts]
        if self.next_pos > self.capacity:  # start anew with this batch's words
            self.reset()
            found = [self._positions(t) for t in texts]
            if self.next_pos > CACHE:
                self.reset(self.next_pos)
                found = [self._positions(t) for t in texts]
        if self.pending:
            self.learn(self.pending)
            self.pending = []
        return np.fromiter(chain.from_iterable(found), np.int64), np.array([len(x) for x in found], np.int64)

    def _edges(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each position whose stretch of the cumulative probabilities holds u."""
        e = self.edge_from[at].astype(np.int64)
        want = at + u
        todo = np.flatnonzero(self.reach[e] <= want)
        while len(todo):
            e[todo] += 1
            todo = todo[self.reach[e[todo]] <= want[todo]]
        return e

    def forward(self, pos: np.ndarray, keys: np.ndarray, word_no: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """One forward sample of every word: edges back to back, and edges of each word."""
        n = np.zeros(len(pos), np.int64)
        live = np.arange(len(pos))
        at = pos.copy()
        base = _mix(keys + _mix(word_no.astype(np.uint64) + np.uint64(sample * 0xD1342543DE82EF95 & _ALL)))
        taken = []
        k = 0
        while len(live):
            u = ((_mix(base + np.uint64(k * 0x9E3779B97F4A7C15 & _ALL)) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
            e = self._edges(at, u)
            taken.append((live, e))
            n[live] += 1
            at = at + self.step[e]
            stay = ~self.ends[at]
            live, at, base = live[stay], at[stay], base[stay]
            k += 1
        offset = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        for k, (who, e) in enumerate(taken):
            out[offset[who] + k] = e
        return out, n

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of edges back to back."""
        ids = self.edge_id[edges]
        if len(ids) and ids.min() < 0:
            return np.array([y for x in ids.tolist() for y in (self.many[-1 - x] if x < 0 else (x,))], np.int32)
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of piece ids; the first blank is the model's own."""
        n = self.piece_sizes[ids]
        flat = self.piece_bytes[np.repeat(self.piece_starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        text = flat.tobytes().replace(SPACE.encode(), b" ")
        return text[1:] if text[:1] == b" " else text

    def sample(self, texts: list[str], keys: np.ndarray, k: int):
        """For each text, its segmentations in order of their perturbed scores: lists of (edges, log-probability, log inclusion probability)."""
        pos, n_words = self.chains(texts)
        word_no = np.arange(len(pos)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        word_key = np.repeat(keys, n_words)
        word_at = np.concatenate([[0], np.cumsum(n_words)])
        # a forward sample of every word for each segmentation; a later one is used from where it leaves an earlier path
        draws = []
        for s in range(k):
            edges, n = self.forward(pos, word_key, word_no, s)
            draws.append((edges, np.concatenate([[0], np.cumsum(n)])))
        edges, bounds = draws[0]
        doc_at = bounds[word_at]
        # regions of the first path that may still matter: all texts at once
        logq = self.logq[edges]
        sums = np.concatenate([[0.0], np.cumsum(logq)])
        size = np.diff(doc_at)
        before = sums[:-1] - np.repeat(sums[doc_at[:-1]], size)
        near = np.flatnonzero(before > NEAR)
        doc = np.repeat(np.arange(len(texts)), size)[near]
        first_time = -np.log(uniforms(keys, 1, 0))
        time = self._arrivals(keys[doc], 0, near - doc_at[:-1][doc], logq[near], before[near], first_time[doc])
        near_at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
        out = []
        for d in range(len(texts)):
            lo, hi = doc_at[d], doc_at[d + 1]
            own = time[near_at[d] : near_at[d + 1]]
            args = (d, k, edges[lo:hi], float(first_time[d]), int(keys[d]), draws, word_at, float(sums[hi] - sums[lo]))
            found = self._search(*args, own, NEAR)
            if found is None:  # deeper regions may matter in this text
                every = np.arange(lo, hi)
                own = self._arrivals(np.repeat(keys[d : d + 1], len(every)), 0, every - lo, logq[lo:hi], before[lo:hi], float(first_time[d]))
                found = self._search(*args, own, -np.inf)
            out.append(found)
        return out

    @staticmethod
    def _arrivals(keys, leaf, steps, logq, before, now):
        """Arrival times, after `now`, of the regions that leave a path at the given steps."""
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            mass = before + np.log(-np.expm1(np.minimum(logq, 0.0)))
            mass[logq > -1e-13] = -np.inf  # there is no other edge
            return now + np.exp(np.log(-np.log(uniforms(keys, 2, leaf, steps))) - mass)

    def _search(self, d, k, path, now, key, draws, word_at, logp, times, depth):
        """A* from the first segmentation of one text on; None if regions below `depth` may matter. A region is a leaf and a step at which to leave its path."""
        leaves, total = [path], [logp]
        opened = [(0, times)]  # first step of a leaf's own regions, and their arrival times
        shut: dict[tuple[int, int], list[int]] = {}
        while True:
            best, j, t = np.inf, -1, -1
            for i, (s, own) in enumerate(opened):
                if len(own):
                    a = int(own.argmin())
                    if own[a] < best:
                        best, j, t = float(own[a]), i, a + s
            if best > np.exp(FAR) and depth > -np.inf:
                return None
            if len(leaves) == k or not np.isfinite(best):
                break
            now, n, base = best, len(leaves), leaves[j]
            taken = shut.setdefault((j, t), [int(base[t])])
            # another edge at this step, then a fresh sample
            at = int(self.edge_pos[base[t]])
            lo = int(self.edge_from[at])
            hi = lo
            while hi < self.n_edges and self.edge_pos[hi] == at:
                hi += 1
            choice = [e for e in range(lo, hi) if e not in taken]
            p = np.cumsum(np.exp(self.logq[choice]))
            e = choice[min(int(np.searchsorted(p, uniform(key, 3, n) * p[-1], side="right")), len(choice) - 1)]
            taken.append(e)
            tail = [e]
            at += int(self.step[e])
            while not self.ends[at]:
                e, want = int(self.edge_from[at]), at + uniform(key, 4, n, len(tail))
                while self.reach[e] <= want:
                    e += 1
                tail.append(e)
                at += int(self.step[e])
            word = int(self.ends[self.edge_pos[base[:t]] + self.step[base[:t]]].sum())
            fresh, bounds = draws[n]
            leaf = np.concatenate([base[:t], np.array(tail, np.int64), fresh[bounds[word_at[d] + word + 1] : bounds[word_at[d + 1]]]])
            logq = self.logq[leaf]
            sums = np.cumsum(logq)
            # what is left of the region
            s, own = opened[j]
            left = 1.0 - float(np.exp(self.logq[taken]).sum())
            if left > 1e-13 and len(taken) < hi - lo:
                own[t - s] = now - np.log(uniform(key, 5, n)) / left * np.exp(-(sums[t] - logq[t]))
            else:
                own[t - s] = np.inf
            before = sums - logq
            stop = len(leaf) if depth == -np.inf else int(np.searchsorted(-before, -depth))
            steps = np.arange(t + 1, max(stop, t + 1))
            opened.append((t + 1, self._arrivals(np.full(len(steps), key, np.uint64), n, steps, logq[steps], before[steps], now)))
            leaves.append(leaf)
            total.append(float(sums[-1]))
        log_t = np.log(best) if np.isfinite(best) else np.inf

        def inclusion(lp: float) -> float:
            x = lp + log_t  # log of -log(1 - inclusion)
            return 0.0 if x > 4 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)

        return [(leaf, lp, inclusion(lp)) for leaf, lp in zip(leaves, total, strict=True)]


def lattices(path: str, alpha: float) -> Lattices:
    let_go(_models)
    if (path, alpha) not in _models:
        _models[path, alpha] = Lattices(path, alpha)
    return _models[path, alpha]


def sample_segmentations(docs: DataFrame, model: str, samples: int = 2, alpha: float = 0.5, seed: int = 11, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to `samples` distinct segmentations of every row's whole text: key, sample, ids, n_pieces, logp, log_inclusion, round_trip.

    Samples come in order of their perturbed scores. logp is the log-probability of the segmentation, log_inclusion the log of
    its inclusion probability given the threshold (0 if the text has no more segmentations than were asked for). round_trip says
    that decoding gives the text back; it is false for a text that holds the model's own blank mark U+2581, which the
    model reads as a blank. Null or empty text: one sample without pieces, logp 0. Repeated rows come back
    repeated and equal; a null key hashes as an empty one. An empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches):
        lat = lattices(model, alpha)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            keys = np.array([xxhash.xxh64_intdigest("" if x is None else str(x), seed) for x in b.column(0).to_pylist()], np.uint64)
            for lo, hi in slabs([len(t) + 50 for t in texts], SLAB):
                found = lat.sample(texts[lo:hi], keys[lo:hi], samples)
                row, no, sizes, parts, logp, incl, good = [], [], [], [], [], [], []
                for i, own in enumerate(found):
                    raw = texts[lo + i].encode("utf-8", "replace")
                    for s, (leaf, lp, li) in enumerate(own):
                        ids = lat.ids_of(leaf)
                        row.append(lo + i)
                        no.append(s)
                        sizes.append(len(ids))
                        parts.append(ids)
                        logp.append(lp)
                        incl.append(li)
                        good.append(lat.decode(ids) == raw)
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))), pa.array(sizes, pa.int64()), pa.array(logp, pa.float64()), pa.array(incl, pa.float64()), pa.array(good, pa.bool_())],
                    [key_col, "sample", "ids", "n_pieces", "logp", "log_inclusion", "round_trip"],
                )

    schema = f"`{key_col}` {kind}, sample int, ids array<int>, n_pieces bigint, logp double, log_inclusion double, round_trip boolean"
    return docs.select(key_col, text_col).mapInArrow(run, schema)
