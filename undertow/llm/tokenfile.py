"""Token ids in shard files with a minimal perfect hash index.

A shard is one file: a JSON header line, then raw sections. ``ids`` holds the token ids of the shard's
documents one after the other (16 bits each if the vocabulary allows, else 32), in ascending order of
the key. The index maps a key to its slot with a minimal perfect hash (levels of bit arrays: keys that
collide in one level go to the next), and each slot stores the key's fingerprint and the offset and
count of its ids, so a lookup takes a few reads and an absent key is told from its fingerprint.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.chunks import ChunkCoder
from undertow.llm.common import raw_bytes, texts_in, work_dir, written

GAMMA = 2.0  # bits of a level for each key that enters it
SHARD_BYTES = 64 << 20  # of ids, after which a task goes on with its next shard
CACHE = 300_000  # chunks whose ids are kept, in each of two generations
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * int(_A) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: about 3.7 bits a key without the ranks."""

    def __init__(self, bits: np.ndarray, sizes: list[int]) -> None:
        self.bits, self.sizes = bits, sizes
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.flags = np.unpackbits(bits, count=int(self.starts[-1])).astype(bool)
        self.rank = np.concatenate(([0], np.cumsum(self.flags))).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, sizes, left = [], [], keys
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            at = (_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.packbits(np.concatenate(levels)) if levels else np.empty(0, np.uint8), sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, in [0, number of keys); -1 where no level has it. Absent keys may get a slot."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.starts[level] + (_hash(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.flags[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 97) >> np.uint64(32)).astype("<u4")


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def write_shard(path: str, keys: list[int | None], counts: list[int], ids: bytes, width: int) -> None:
    """Writes under a name of its own, then renames, so that a task that is tried again leaves whole files only."""
    key = np.array([k for k in keys if k is not None], np.int64)
    nulls = len(keys) - len(key)
    n = np.array(counts, np.int64)
    start = np.concatenate(([0], np.cumsum(n)))[:-1].astype("<i8") if len(n) else np.empty(0, "<i8")
    distinct, first, times = np.unique(key, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    prints, record, records = np.zeros(len(slot), "<u4"), np.zeros(len(slot), "<i8"), np.zeros(len(slot), "<i4")
    prints[slot], record[slot], records[slot] = fingerprint(distinct), first + nulls, times
    parts = {
        "keys": key.astype("<i8").tobytes(), "start": start.tobytes(), "count": n.astype("<i4").tobytes(), "mph": index.bits.tobytes(),
        "fingerprint": prints.tobytes(), "record": record.tobytes(), "records": records.tobytes(), "ids": ids,
    }
    head = {"width": width, "nulls": nulls, "levels": index.sizes, "sections": {k: len(v) for k, v in parts.items()}}
    where, name = _open(path)
    own = f"{name}.{os.getpid()}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    where.create_dir(os.path.dirname(name), recursive=True)
    with where.open_output_stream(own) as f:
        f.write(json.dumps(head).encode() + b"\n")
        for v in parts.values():
            f.write(v)
    where.move(own, name)


class Shard:
    """A shard file for reading. Only what is asked for is read: the ids stay in the file."""

    def __init__(self, path: str) -> None:
        where, name = _open(path)
        self.file = where.open_input_file(name)
        line = self.file.read(1 << 16).split(b"\n", 1)[0]
        head = json.loads(line)
        self.width, self.nulls = head["width"], head["nulls"]
        at, self.at = len(line) + 1, {}
        for k, n in head["sections"].items():
            self.at[k] = (at, n)
            at += n
        self.index = PerfectHash(self._section("mph", np.uint8), head["levels"])
        self.prints, self.record, self.records = self._section("fingerprint", "<u4"), self._section("record", "<i8"), self._section("records", "<i4")
        self.start, self.count = self._section("start", "<i8"), self._section("count", "<i4")

    def _section(self, name: str, kind) -> np.ndarray:
        at, n = self.at[name]
        return np.frombuffer(self.file.read_at(n, at), kind)

    def keys(self) -> np.ndarray:
        return self._section("keys", "<i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key; -1 if the shard has no such key (wrong once in 2^32 absent keys)."""
        slot = self.index.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok])
        return np.where(ok, self.record[np.where(ok, slot, 0)] if len(self.record) else -1, -1)

    def ids(self, record: int) -> np.ndarray:
        at = self.at["ids"][0] + int(self.start[record]) * self.width
        raw = self.file.read_at(int(self.count[record]) * self.width, at)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")


def byte_alphabet() -> dict[int, str]:
    """Byte-level characters: printable bytes stand for themselves, the others follow from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in shown]
    return {b: chr(b if b in shown else 0x100 + other.index(b)) for b in range(256)}


#: Letters that the tokenizer's normaliser leaves as they are, in scripts whose letters are settled.
PLAIN = "a-z" + "".join(c for c in map(chr, range(0xC0, 0x530)) if c.isalpha() and c.lower() == c and unicodedata.normalize("NFC", c) == c)
JOINED = 64  # plain words that go to the tokenizer in one text


def word_cuts() -> np.ndarray:
    """Between which bytes of a lower-cased text no word of the tokenizer goes on: before white space, beside digits,
    between ASCII letters and signs (not after an apostrophe, which may begin a word of letters)."""
    byte = np.arange(256)
    blank = (byte == 32) | (byte >= 9) & (byte <= 13)
    letter, digit = (byte >= 97) & (byte <= 122), (byte >= 48) & (byte <= 57)
    sign = (byte < 128) & ~blank & ~letter & ~digit & ~((byte >= 65) & (byte <= 90))
    ascii_ = letter | digit | sign
    out = ~blank[:, None] & blank[None, :]
    out |= letter[:, None] & (sign | digit)[None, :] | digit[:, None] & ascii_[None, :]
    return out | (sign & (byte != ord("'")))[:, None] & (letter | digit)[None, :] | (byte == ord("'"))[:, None] & digit[None, :]


class WordTokens:
    """A word-based tokenizer: a text's ids are those of its chunks in turn.

    Texts that might spell a special token go to the tokenizer whole. Of others A-Z are lower-cased, as the
    tokenizer's own rules do. New chunks of plain letters go to the same model with nothing but white space
    between them, for their normalisation and words are known; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, width: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.tokenizer, self.kind = Tokenizer.from_file(path), "<u2" if width == 2 else "<u4"
        suffix = described["model"].get("end_of_word_suffix") or ""
        self.plain = re.compile(f"[{PLAIN}]+") if suffix else None
        self.bare = Tokenizer.from_str(json.dumps({**described, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # tokens that end a word
        for token, i in self.bare.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.shown = byte_alphabet()
        self.coder = ChunkCoder(word_cuts(), b"", self.kind, self._new, CACHE)

    def _new(self, chunks: list[bytes]) -> list[bytes]:
        words = [c.decode().strip(" \t\n\r\x0b\x0c") for c in chunks]
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if self.plain and self.plain.fullmatch(w)]
        shown = [w if (w := words[i]).isascii() else w.encode().decode("latin-1").translate(self.shown) for i in plain]
        texts = [" ".join(shown[i : i + JOINED]) for i in range(0, len(shown), JOINED)]
        ids = [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.array([i for some in ids for i in some], self.kind)
        ends = ((np.flatnonzero(self.last[flat]) + 1) * flat.itemsize).tolist()
        raw = flat.tobytes()
        for i, a, b in zip(plain, [0, *ends], ends, strict=False):
            out[i] = raw[a:b]
        if len(ends) != len(plain):
            raise ValueError("the tokenizer's words don't end with its suffix")
        other = sorted({i for i, w in enumerate(words) if w}.difference(plain))
        for i, e in zip(other, self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.kind).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        values, counts = self.coder.encode([b"" if b"<|" in t else t.lower() for t in texts])
        out = np.split(values, np.cumsum(counts)[:-1])
        for i, t in enumerate(texts):
            if b"<|" in t:
                out[i] = np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, self.kind)
        return out


@lru_cache(maxsize=1)
def _word_tokens(path: str, width: int) -> WordTokens:
    """Python workers serve many tasks: what one has learnt about words serves the next."""
    return WordTokens(path, width)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int, vocab: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` as shard files in ``folder``, in ascending order of the key over all shards.

    ``tokenizer`` is the path of a word-based tokenizer file on the driver. Every text's ids end with
    ``end_id``; null counts as empty. Null keys come first and can't be looked up; rows that repeat a
    key are neighbours in the order of their text's hash, in one shard or in some that follow each other, and
    a shard's index gives the first and their number. An empty table makes no file. A task writes a shard
    whenever it holds SHARD_BYTES of ids. Returns the catalogue: ``shard, path, documents, ids, first_key,
    last_key, base`` (``base``: ids of all shards before).
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name, width = tokenizer.rpartition("/")[2], 2 if max(vocab, end_id + 1) <= 1 << 16 else 4
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    ordered = (
        docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text")
    )
    most = SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_tokens(SparkFiles.get(name), width)
        stop = np.array([end_id], words.kind).tobytes()
        keys, counts, ids, size, part, nth = [], [], [], 0, TaskContext.get().partitionId(), 0

        def shard() -> pa.RecordBatch:
            path = f"{folder}/shard-{part:06d}-{nth:06d}.ids"
            write_shard(path, keys, counts, b"".join(ids), width)
            row = {"part": part, "nth": nth, "path": path, "documents": len(keys), "ids": sum(counts), "first_key": keys[0], "last_key": keys[-1]}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]))

        for batch in texts_in(batches, 256):
            for k, one in zip(batch.column("key").to_pylist(), words.encode(raw_bytes(batch.column("text"))), strict=True):
                keys.append(k), counts.append(len(one) + 1)
                ids += (one.tobytes(), stop)
                size += one.nbytes + width
                if size >= most:
                    yield shard()
                    keys, counts, ids, size, nth = [], [], [], 0, nth + 1
        if keys:
            yield shard()

    shards = written(ordered.mapInArrow(run, "part long, nth long, path string, documents long, ids long, first_key long, last_key long"), "token-catalogue")
    w = Window.orderBy("part", "nth")  # one row a shard file
    base = F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.select((F.row_number().over(w) - 1).alias("shard"), "path", "documents", "ids", "first_key", "last_key", base.alias("base"))


def read_token_files(catalogue: DataFrame) -> DataFrame:
    """``key, start, n_tokens, ids_crc32, shard`` of every stored document, each found through the index.

    A shard is read by one task, which holds its index and one document's ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                keys = shard.keys()
                first = shard.find(keys)
                if (first < 0).any():
                    raise ValueError(f"{row['path']}: its index lacks some of its keys")
                new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
                nth = np.arange(len(keys)) - np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.empty(0, np.int64)
                record = np.concatenate((np.arange(shard.nulls), first + nth)).astype(np.int64)
                crc = [zlib.crc32(shard.ids(r).astype("<u4").tobytes()) for r in record]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*[None] * shard.nulls, *keys.tolist()], pa.int64()), pa.array(row["base"] + shard.start[record]),
                        pa.array(shard.count[record].astype(np.int64)), pa.array(crc, pa.int64()), pa.array([row["shard"]] * len(record), pa.int32()),
                    ],
                    names=["key", "start", "n_tokens", "ids_crc32", "shard"],
                )

    spread = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return catalogue.repartition(spread, "shard").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(catalogue: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, ids`` (array<int>) for each stored row of ``keys``: keys meet the shards whose range has them."""
    shards = catalogue.where("last_key is not null").orderBy("shard").select("first_key", "last_key", "shard", "path").collect()  # one row a shard file
    firsts = np.array([s["first_key"] if s["first_key"] is not None else -(1 << 63) for s in shards], np.int64)
    lasts = np.array([s["last_key"] for s in shards], np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("key").drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            begin, end = np.searchsorted(lasts, wanted, "left"), np.searchsorted(firsts, wanted, "right")
            at = [(i, int(k)) for k, a, b in zip(wanted, begin, end, strict=True) for i in range(a, b)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shards[i]["shard"] for i, _ in at], pa.int32()), pa.array([shards[i]["path"] for i, _ in at], pa.string()), pa.array([k for _, k in at], pa.int64())],
                names=["shard", "path", "key"],
            )

    ranged = keys.select(F.col(key).cast("long").alias("key")).distinct().mapInArrow(placed, "shard int, path string, key long")

    def run(rows):
        import pandas as pd

        shard = Shard(rows["path"].iat[0])
        found = shard.find(rows["key"].to_numpy(np.int64))
        out = [(k, shard.ids(r + i).tolist()) for k, r in zip(rows["key"], found, strict=True) if r >= 0 for i in range(shard.records[shard.index.slots(np.array([k]))[0]])]
        return pd.DataFrame(out, columns=["key", "ids"])

    return ranged.groupBy("shard").applyInPandas(run, "key long, ids array<int>")


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of op6's contract."""
    folder = work_dir(docs.sparkSession, "tokens")
    read = read_token_files(write_token_files(docs, tokenizer, folder, end_id=2, vocab=49_408))
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard")
