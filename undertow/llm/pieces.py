"""SentencePiece encoding by an Aho-Corasick automaton and one Viterbi pass, and decoding.

The automaton holds all pieces. At each position of a text its output links name every piece that ends
there, and each relaxes the best score of that position. The best path is the segmentation of largest
summed score; a character that no piece covers falls back to its UTF-8 bytes. Texts are cut where no piece
goes on (mostly before spaces and between letters and punctuation), so the best path of a text is those of
its chunks one after the other; the new chunks of a batch go through the automaton side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.chunks import ChunkCoder
from undertow.llm.common import raw_bytes, texts_in

SPACE = "▁"
UNKNOWN = 10.0  # below the lowest score, for each character without a piece
NEVER_MERGED = -1e8  # models of merges mark pieces of spaces alone so; they count as just below the lowest score
CACHE = 100_000  # chunks whose segmentation is kept, in each of two generations
SIDE = 64  # characters of a chunk that goes side by side with others; longer ones go alone


class Automaton:
    """Aho-Corasick over pieces, as arrays, for many texts side by side.

    ``out`` is the state itself if a piece ends there, else the next such state on its chain of suffixes;
    ``link`` goes on along that chain, from longer pieces to shorter ones.
    """

    def __init__(self, pieces: list[tuple[str, int, float]]) -> None:
        chars = sorted({ch for name, _, _ in pieces for ch in name})
        self.code = np.zeros(max(map(ord, chars), default=0) + 2, np.int64)  # the last is for all beyond
        self.code[[ord(ch) for ch in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        code = {ch: i + 1 for i, ch in enumerate(chars)}
        edges: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, int, float]] = {}
        for name, i, score in pieces:
            state = 0
            for ch in name:
                if (to := edges[state].get(code[ch])) is None:
                    to = edges[state][code[ch]] = len(edges)
                    edges.append({})
                state = to
            ends[state] = (i, len(name), score)
        n = len(edges)
        fail, out, link, queue = [0] * n, [0] * n, [0] * n, [0]
        for state in queue:
            for c, to in edges[state].items():
                up = fail[state]
                while up and c not in edges[up]:
                    up = fail[up]
                fail[to] = edges[up].get(c, 0) if state else 0
                link[to] = out[fail[to]]
                out[to] = to if to in ends else link[to]
                queue.append(to)
        self.fail, self.out, self.link = (np.array(x, np.int64) for x in (fail, out, link))
        self.piece, self.length, self.score = np.full(n, -1, np.int32), np.zeros(n, np.int64), np.zeros(n)
        for state, (i, length, score) in ends.items():
            self.piece[state], self.length[state], self.score[state] = i, length, score
        keys = np.array([s * self.width + c for s, e in enumerate(edges) for c in e], np.int64)
        to = np.array([t for e in edges for t in e.values()], np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.to[slot[won]] = keys[won], to[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _edge(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states that edges lead to; -1 without an edge."""
        keys = states * self.width + codes
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.to[slot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out, at, left = np.zeros(len(states), np.int64), states.copy(), np.arange(len(states))
        while len(left):
            to = self._edge(at[left], codes[left])
            out[left[to >= 0]] = to[to >= 0]
            left = left[(to < 0) & (at[left] > 0)]
            at[left] = self.fail[at[left]]
        return out

    def best_paths(self, texts: list[str], unknown: float) -> tuple[list[bytes], list[int]]:
        """Pieces of the best path over each text as 32-bit integers, -1 for a character without one, and which texts
        have such characters. Of equal scores, the path with the longer last piece."""
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        size, most = size[order], int(size.max(initial=0))
        points = np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.zeros((len(texts), most), np.int64)
        codes[np.arange(most) < size[:, None]] = self.code[np.minimum(points, len(self.code) - 1)]
        best = np.zeros((most + 1, len(texts)))
        back, piece = np.zeros((most + 1, len(texts)), np.int64), np.full((most + 1, len(texts)), -1, np.int32)
        states = np.zeros(len(texts), np.int64)
        for at in range(most):
            on = int(np.searchsorted(-size, -at, "left"))  # texts that go on: those longer than ``at``
            states = self.step(states[:on], codes[:on, at])
            score, start, own = best[at, :on] + unknown, np.full(on, at), np.full(on, -1, np.int32)
            out = self.out[states]
            some = np.flatnonzero(out)
            while len(some):
                s = out[some]
                begin = at + 1 - self.length[s]
                total = best[begin, some] + self.score[s]
                more = total > score[some]
                i = some[more]
                score[i], start[i], own[i] = total[more], begin[more], self.piece[s[more]]
                out[some] = self.link[s]
                some = some[self.link[s] > 0]
            best[at + 1, :on], back[at + 1, :on], piece[at + 1, :on] = score, start, own
        steps, at, on = [], size.copy(), np.arange(len(texts))
        while len(on := on[at[on] > 0]):
            taken = np.full(len(texts), -2, np.int32)
            taken[on] = piece[at[on], on]
            at[on] = back[at[on], on]
            steps.append(taken)
        paths = [b""] * len(texts)
        if steps:
            table = np.stack(steps[::-1], axis=1)
            real = table > -2
            raw, ends = table[real].astype("<i4").tobytes(), (4 * np.cumsum(real.sum(axis=1))).tolist()
            for i, a, b in zip(order.tolist(), [0, *ends], ends, strict=False):
                paths[i] = raw[a:b]
        return paths, order[(table == -1).any(axis=1)].tolist() if steps else []


class Pieces:
    """The pieces of a model file, and texts to ids and back."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids = [0] * 256
        self.bytes_of: dict[int, bytes] = {}
        scored = []
        for i, name in enumerate(self.names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                scored.append((name, i, sp.get_score(i)))
                self.bytes_of[i] = name.replace(SPACE, " ").encode()
        lowest = min((s for _, _, s in scored if s > NEVER_MERGED), default=0.0)
        self.scores = {name: (i, max(score, lowest - 1)) for name, i, score in scored}
        self.automaton = Automaton([(name, i, score) for name, (i, score) in self.scores.items()])
        self.unknown = lowest - UNKNOWN
        table = [self.bytes_of.get(i, b"") for i in range(len(self.names))]
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.coder = ChunkCoder(cuts([name for name, _, _ in scored]), b" ", "<i4", self._new, CACHE)

    def _with_bytes(self, text: str, path: bytes) -> bytes:
        """Ids of a path; characters without a piece become the ids of their bytes."""
        ids, at = [], 0
        for i in np.frombuffer(path, "<i4").tolist():
            if i >= 0:
                ids.append(i)
                at += len(self.names[i])
            else:
                ids += [self.byte_ids[b] for b in (SPACE if text[at] == "\0" else text[at]).encode()]
                at += 1
        return np.array(ids, "<i4").tobytes()

    def _new(self, chunks: list[bytes]) -> list[bytes]:
        return self._marked([c.decode().replace(" ", SPACE) for c in chunks])

    def _marked(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in which spaces are space marks already and "\\0" stands for a literal space mark."""
        short = [i for i, t in enumerate(texts) if len(t) <= SIDE]
        out: list[bytes] = [b""] * len(texts)
        paths, odd = self.automaton.best_paths([texts[i] for i in short], self.unknown)
        for i in odd:
            paths[i] = self._with_bytes(texts[short[i]], paths[i])
        for i, path in zip(short, paths, strict=True):
            out[i] = path
        for i, t in enumerate(texts):
            if len(t) > SIDE:
                out[i] = self._with_bytes(t, self._alone(t))
        return out

    def _alone(self, text: str) -> bytes:
        """The best path over one long text: the automaton goes over it once, and each position is relaxed in turn."""
        auto, unknown = self.automaton, self.unknown
        codes = auto.code[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), len(auto.code) - 1)]
        best, back, state = [0.0], [(0, -1)], 0
        edges, fail, out, link = self._edges(), auto.fail, auto.out, auto.link
        for at, c in enumerate(codes.tolist()):
            while state and (state, c) not in edges:
                state = int(fail[state])
            state = edges.get((state, c), 0)
            score, from_ = best[at] + unknown, (at, -1)
            s = int(out[state])
            while s:
                begin = at + 1 - int(auto.length[s])
                if (total := best[begin] + float(auto.score[s])) > score:
                    score, from_ = total, (begin, int(auto.piece[s]))
                s = int(link[s])
            best.append(score), back.append(from_)
        path, at = [], len(text)
        while at:
            at, i = back[at]
            path.append(i)
        return np.array(path[::-1], "<i4").tobytes()

    def _edges(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_edge_table"):
            auto = self.automaton
            full = auto.keys >= 0
            self._edge_table = {(k // auto.width, k % auto.width): t for k, t in zip(auto.keys[full].tolist(), auto.to[full].tolist(), strict=True)}
        return self._edge_table

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts one after the other, and their number in each. A space goes before a text, as the model's files ask."""
        plain = [b"" if not t or b"\0" in t or MARK in t else t for t in texts]
        values, counts = self.coder.encode(plain)
        odd = {i: self._odd(t) for i, t in enumerate(texts) if t and not plain[i]}
        if not odd:
            return values, counts
        upto = np.cumsum(counts)
        parts = [odd.get(i, values[upto[i] - counts[i] : upto[i]]) for i in range(len(texts))]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _odd(self, raw: bytes) -> np.ndarray:
        """A text with NUL, whose byte piece stands for it (the mark for literal space marks must be free), or with space marks."""
        parts = [(SPACE if not i else "") + part.replace(SPACE, "\0").replace(" ", SPACE) for i, part in enumerate(raw.decode().split("\0"))]
        nul = np.array([self.byte_ids[0]], "<i4").tobytes()
        return np.frombuffer(nul.join(self._marked(parts)), "<i4")

    def decode(self, values: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids: pieces with spaces for space marks, bytes of byte pieces, without the first space."""
        known = (values >= 0) & (values < len(self.sizes))
        i = np.where(known, values, 0)
        n = np.where(known, self.sizes[i], 0)
        done = np.concatenate(([0], np.cumsum(n)))
        raw = self.flat[np.repeat(self.begins[i] - done[:-1], n) + np.arange(done[-1])].tobytes()
        ends = done[np.cumsum(counts)].tolist()
        return [(raw[a + 1 : b] if raw[a : a + 1] == b" " and b > a else raw[a:b]).decode("utf-8", "replace") for a, b in zip([0, *ends], ends, strict=False)]


MARK = SPACE.encode()


def cuts(names: list[str]) -> np.ndarray:
    """Between which two bytes no piece goes on: [x, y] is true if y begins a character and no piece has it after x."""
    out = np.ones((256, 256), bool)
    out[:, 0x80:0xC0] = False
    for name in names:
        raw = [ch.encode() for ch in name.replace(SPACE, " ")]
        for x, y in zip(raw, raw[1:], strict=False):
            out[x[-1], y[0]] = False
    return out


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def _model(name: str) -> Pieces:
    """Python workers serve many tasks: what one has learnt about words serves the next."""
    return _pieces(SparkFiles.get(name))


def _shared(df: DataFrame, path: str) -> str:
    df.sparkSession.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode_pieces(docs: DataFrame, model: str, *, text: str = "text", out: str = "piece_ids", columns: list[str] | None = None) -> DataFrame:
    """``docs`` plus ``out`` (array<int>) and ``out``_n. Null and empty texts have no ids.

    ``model`` is the path of a SentencePiece model file on the driver; Spark gives it to the executors.
    For a model of merges (BPE) the ids are the best path under its piece scores, not its merge order;
    for unigram models that is the model's own segmentation (unless it normalises texts; none is done).
    ``columns`` names those of ``docs`` to return (all by default); columns named as the new ones are
    replaced. Long words and texts are held one at a time.
    """
    name = _shared(docs, model)
    keep = [c for c in (columns or docs.columns) if c not in (out, f"{out}_n")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(f"{out}_n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(name)
        for batch in texts_in(batches, 256):
            values, n = pieces.encode(raw_bytes(batch.column(text)))
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(n)],
                names=[*keep, out, f"{out}_n"],
            )

    return docs.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, model: str, *, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``df`` plus ``out``: the text of the array ``ids`` (null of null; ids without a text are silent)."""
    name = _shared(df, model)
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(name)
        for batch in texts_in(batches, 256):
            lists = batch.column(ids)
            texts = pa.array(pieces.decode(lists.flatten().fill_null(-1).to_numpy(), lists.value_lengths().fill_null(0).to_numpy()), pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids of every text, and whether decoding gives the text again."""
    encoded = encode_pieces(docs.select("doc_id", "text"), model)
    decoded = decode_pieces(encoded, model)
    return decoded.select(
        "doc_id", F.col("piece_ids_n").alias("n_pieces"), "piece_ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
