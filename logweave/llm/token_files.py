"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Documents are dealt by ranges of doc_id and sorted within them. Each task encodes its range and writes one shard: `.bin` holds
the ids of its documents back to back (unsigned 16 bits if the vocabulary fits, else 32), `.len` the documents' lengths. The
shards' bases are prefix sums over the shard table; a second pass turns lengths into `.idx`, the unsigned 64-bit offset of
each document from the first id of the whole data set, with one closing offset. A file is written under a name of its task
attempt and renamed at the end, so a task that runs again leaves no half shard.

The folder must be reachable by a file path or by a scheme that pyarrow.fs knows (file, hdfs, s3, gs); shards on a file path
are memory-mapped when read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let_go, ship, worker_cache

#: Cached chunks per worker before the cache starts anew.
CACHE = 800_000
#: Bytes of input for a shard, where that gives more shards than shuffle partitions: bounds what a task holds of its ids.
SHARD_BYTES = 128 << 20
_encoders: dict[str, ChunkEncoder] = worker_cache()


def _filesystem(uri: str):
    """(file system, path) of a folder given by a path or a URI."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


class _Chunks(dict):
    """Number of each chunk; a new one gets the next number and is noted for learning."""

    def __init__(self, owner: ChunkEncoder, lead: str):
        self.owner, self.lead = owner, lead

    def __missing__(self, word: str) -> int:
        own = self.owner
        number = self[word] = own.known
        own.known += 1
        own.leads.append(self.lead)
        own.words.append(word)
        return number


class ChunkEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, each distinct chunk once.

    In a text whose white space is single blanks and newlines between words, pre-tokens never cross the start of a blank or a
    newline, so words with their leading blank can be encoded apart. Any other text is encoded as it stands. A new chunk of
    Latin letters, with or without marks of one kind of pre-token after them, goes to the library's BPE model directly; other
    new chunks are encoded together, parted by newlines, whose id only a newline has.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # the visible characters that stand for bytes, as the library's own pre-tokenizer shows them
        pre = self.tokenizer.pre_tokenizer
        shown = [pre.pre_tokenize_str(chr(c)) for c in range(33, 127)] if pre is not None else []
        self.plain = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and all(x and x[0][0] == chr(33 + i) for i, x in enumerate(shown))
        self.blank = pre.pre_tokenize_str(" a")[0][0][:-1] if self.plain else ""
        self.plain = self.plain and pre.pre_tokenize_str("a b")[0][0] == "a" and pre.pre_tokenize_str("ab.,c")[1][0] == ".,"
        # each Latin letter as its bytes are shown, asked of the library
        self.letters = str.maketrans({chr(c): pre.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x250) if chr(c).isalpha()}) if self.plain else {}
        self.reset()

    def reset(self):
        self.known = 1
        # chunks noted, and what is known of parts of them as bytes of 32-bit ids: no containers that the garbage collector would walk
        self.leads: list[str] = []
        self.words: list[str] = []
        self.first, self.inner = _Chunks(self, ""), _Chunks(self, " ")
        self.ids: list[np.ndarray] = [np.array([self.newline or 0], np.uint32)]
        self.sizes: list[np.ndarray] = [np.ones(1, np.int64)]
        self.cores: dict[str, bytes] = {}

    def _bpe(self, text: str) -> bytes:
        """Ids of one pre-token of Latin letters or of marks, as visible characters."""
        got = self.cores[text] = array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()
        return got

    def _learn(self) -> None:
        """Encode the chunks noted, in order of their numbers."""
        out: list[bytes] = []
        rest = []
        known, blank, letters = self.cores.get, self.blank, self.letters
        for lead, word in zip(self.leads, self.words, strict=True):
            core = word.rstrip(".,;:!?") if self.plain else ""
            if core.isalpha() and ((ascii := core.isascii()) or max(core) < "\u0250"):
                shown = core if ascii else core.translate(letters)
                if lead:
                    shown = blank + shown
                ids = known(shown) or self._bpe(shown)
                if len(core) < len(word):
                    mark = word[len(core) :]
                    ids += known(mark) or self._bpe(mark)
                out.append(ids)
            else:
                rest.append(len(out))
                out.append(b"")
        for lo in range(0, len(rest), 20_000):
            part = rest[lo : lo + 20_000]
            ids = self.tokenizer.encode("\n".join([self.leads[i] + self.words[i] for i in part]), add_special_tokens=False).ids
            at = 0
            for i in part:
                stop = ids.index(self.newline, at) if i != part[-1] else len(ids)
                out[i] = array("I", ids[at:stop]).tobytes()
                at = stop + 1
            if at != len(ids) + 1:
                raise ValueError("chunks do not part at newlines")
        self.sizes.append(np.fromiter(map(len, out), np.int64, len(out)) // 4)
        self.ids.append(np.frombuffer(b"".join(out), np.uint32))
        self.leads, self.words = [], []

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids back to back, `end_id` after each text, and the number of ids of each text."""
        if self.known > CACHE:
            self.reset()
        first, inner = self.first.__getitem__, self.inner.__getitem__
        numbers: list[np.ndarray | None] = []
        for t in texts:
            words = t.split()
            parts = t.count(" ") + t.count("\n")
            # as many words as parts, and no white space besides: tabs could make up for blank lines
            if self.newline is None or len(words) != parts + 1 or sum(map(len, words)) + parts != len(t) or any(s in t for s in self.special):
                numbers.append(None)
                continue
            at: list[int] = []
            for line in t.split("\n"):
                head, *more = line.split(" ")
                at.append(first(head))
                at.extend(map(inner, more))
                at.append(0)
            at.pop()
            numbers.append(np.array(at, np.int64))
        if self.words:
            self._learn()
        flat, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        self.ids, self.sizes = [flat], [sizes]
        starts = np.cumsum(sizes) - sizes
        parts, lengths = [], []
        for t, k in zip(texts, numbers, strict=True):
            if k is None:
                ids = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if t else [], np.uint32)
            else:
                n = sizes[k]
                ids = flat[np.repeat(starts[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            parts += [ids, np.array([end_id], np.uint32)]
            lengths.append(len(ids) + 1)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(lengths, np.int64)


def _encoder(path: str) -> ChunkEncoder:
    let_go(_encoders)
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def input_bytes(docs: DataFrame) -> int:
    """The optimizer's estimate of the table's size: for files their bytes, without a scan. 0 where it has none (it then says exabytes)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def _sweep_strays(folder: str, names: set[str]) -> None:
    """Delete the files of task attempts that did not count (lost, repeated or speculative). A folder is for one data set."""
    fs, root = _filesystem(folder)
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.type == pafs.FileType.File and re.fullmatch(r"_?\d{6}-[0-9a-f]{12}\.(bin|len|ids)", f.base_name) and f.base_name.lstrip("_").split(".")[0] not in names:
            fs.delete_file(f.path)


def _refuse_finished(folder: str) -> None:
    """An index file marks a finished data set: its shards are not to be mixed with others, or swept as strays."""
    fs, root = _filesystem(folder)
    if any(re.fullmatch(r"\d{6}-[0-9a-f]{12}\.idx", f.base_name) for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))):
        raise ValueError(f"{folder} holds a finished data set; give a new folder")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write `.bin` and `.len` files and return the shard table: shard, name, n_docs, n_ids, base (ids before the shard), width.

    Ascending id, then text; null ids first; null text is empty: its end id alone. Repeated rows are written each time. An
    empty table writes nothing and gives an empty table. Other columns are not read. A folder with a finished data set is an error.
    """
    spark = docs.sparkSession
    ship(spark)
    _refuse_finished(folder)
    n = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // SHARD_BYTES)
    dealt = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).repartitionByRange(n, "id").sortWithinPartitions("id", "t")

    def run(batches):
        encoder = _encoder(tokenizer)
        width = 2 if max(encoder.vocab, end_id + 1) <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        fs, root = _filesystem(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex[:12]}"
        temp = [f"{root}/_{name}.{x}" for x in ("bin", "len", "ids")]
        n_docs = n_ids = 0
        outs = None
        ids_kept = []
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            at = 0
            while at < len(texts):
                size, stop = 0, at
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 2_000_000):
                    size += len(texts[stop])
                    stop += 1
                if outs is None:
                    fs.create_dir(root, recursive=True)
                    outs = [fs.open_output_stream(p) for p in temp[:2]]
                flat, lengths = encoder.encode(texts[at:stop], end_id)
                outs[0].write(flat.astype("<u2" if width == 2 else "<u4").tobytes())
                outs[1].write(lengths.astype("<u8").tobytes())
                n_docs += len(lengths)
                n_ids += len(flat)
                at = stop
            ids_kept.append(ids)
        if outs is not None:
            for o in outs:
                o.close()
            key = pa.concat_arrays(ids_kept)
            with fs.open_output_stream(temp[2]) as o, pa.ipc.new_stream(o, pa.schema([("id", key.type)])) as w:
                w.write_batch(pa.record_batch([key], ["id"]))
            for p, x in zip(temp, ("bin", "len", "ids"), strict=True):
                fs.move(p, f"{root}/{name}.{x}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [n_docs], "n_ids": [n_ids], "width": [width]})

    # a row per shard is all that is gathered; the files themselves stay where their tasks put them
    table = dealt.mapInArrow(run, "shard bigint, name string, n_docs bigint, n_ids bigint, width bigint").collect()
    _sweep_strays(folder, {r["name"] for r in table})
    table = spark.createDataFrame(table, "shard bigint, name string, n_docs bigint, n_ids bigint, width bigint")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return table.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def write_index(shards: DataFrame, folder: str) -> None:
    """Write each shard's `.idx`: 64-bit offsets from the first id of the whole data set, one more than its documents."""
    ship(shards.sparkSession)

    def run(batches):
        fs, root = _filesystem(folder)
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_file(f"{root}/{r['name']}.len") as f:
                    lengths = np.frombuffer(f.read(), "<u8")
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + np.uint64(r["base"])
                temp = f"{root}/_{r['name']}-{uuid.uuid4().hex[:12]}.idx"
                with fs.open_output_stream(temp) as o:
                    o.write(offsets.astype("<u8").tobytes())
                fs.move(temp, f"{root}/{r['name']}.idx")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    n = max(1, shards.count())
    shards.repartition(n, "shard").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def read_shards(shards: DataFrame, folder: str, id_kind: str = "bigint") -> DataFrame:
    """One row per document from the files: id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    ship(shards.sparkSession)

    def run(batches):
        fs, root = _filesystem(folder)
        for b in batches:
            for r in b.to_pylist():
                kind = "<u2" if r["width"] == 2 else "<u4"
                at = f"{root}/{r['name']}"
                with fs.open_input_file(f"{at}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8")
                with fs.open_input_file(f"{at}.ids") as f:
                    ids = pa.ipc.open_stream(f.read()).read_all().column("id").combine_chunks()
                local = isinstance(fs, pafs.LocalFileSystem)
                flat = np.memmap(f"{at}.bin", kind, "r") if local else np.frombuffer(fs.open_input_file(f"{at}.bin").read(), kind)
                begins = (offsets - offsets[0]).astype(np.int64)
                for lo in range(0, len(ids), 5_000):
                    hi = min(lo + 5_000, len(ids))
                    crc = [zlib.crc32(flat[begins[i] : begins[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [ids[lo:hi], pa.array(offsets[lo:hi].astype(np.int64)), pa.array(np.diff(begins[lo : hi + 1])), pa.array(crc, pa.int64())],
                        ["id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, shards.count())
    return shards.repartition(n, "shard").mapInArrow(run, f"id {id_kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, **options) -> DataFrame:
    """Write the data set into `folder`; returns its shard table."""
    shards = write_shards(docs, folder, tokenizer, **options)
    write_index(shards, folder)
    return shards


def remove_files(shards: DataFrame, folder: str) -> None:
    """Delete the files of the shard table, and the folder if that leaves it empty."""
    fs, root = _filesystem(folder)
    for r in shards.select("name").collect():
        for x in ("bin", "len", "ids", "idx"):
            fs.delete_file(f"{root}/{r['name']}.{x}")
    if isinstance(fs, pafs.LocalFileSystem) and os.path.isdir(root) and not os.listdir(root):
        os.rmdir(root)
