"""Benchmark decontamination by a generalised suffix automaton.

The test items' words feed one automaton for all items. Document words stream through it and each
position learns the longest suffix that occurs in some item. A match of ``window`` words (or all of
a shorter item) marks its words as hit. The items that own a window hang at the automaton's state.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.common import raw_bytes, texts_in, words_of, written

WINDOW = 10
ADDED = ["n_words", "n_hit", "hit_items", "hit_spans", "coverage", "clean_text", "dropped"]
_KINDS = ["long", "long", "array<string>", "array<struct<start:long,end:long>>", "double", "string", "boolean"]
#: Words of test items that one automaton holds (about 100 bytes each, pickled); more items make more automata, one pass each.
AUTOMATON_WORDS = 500_000


class SuffixAutomaton:
    """Of several word sequences. Small: at most two states a word."""

    def __init__(self, window: int) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.full: dict[int, set] = {}  # state of a whole window -> items
        self.short: dict[tuple[int, int], set] = {}  # state, words of a short item -> items
        self.least = window  # words of the shortest window

    def _grow(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(symbol)
        if known is not None and length[known] == length[last] + 1:
            return known

        def split(p: int, q: int) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = clone
            while p >= 0 and nxt[p].get(symbol) == q:
                nxt[p][symbol] = clone
                p = link[p]
            return clone

        if known is not None:
            return split(last, known)
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            link[state] = q if length[q] == length[p] + 1 else split(p, q)
        return state

    def build(self, items: Iterable[tuple[object, list[bytes]]]) -> SuffixAutomaton:
        coded = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if ids:
                coded.append((item, ids))
                last = 0
                for symbol in ids:
                    last = self._grow(last, symbol)
        for item, ids in coded:
            if len(ids) < self.window:
                state = [s for _, s, _ in self.walk(ids)][-1]
                self.short.setdefault((self.cover(state, len(ids)), len(ids)), set()).add(item)
                self.least = min(self.least, len(ids))
            else:
                for _, state, n in self.walk(ids):
                    if n >= self.window:
                        self.full.setdefault(self.cover(state, self.window), set()).add(item)
        self.short_lengths = sorted({k for _, k in self.short})
        return self

    def cover(self, state: int, k: int) -> int:
        """The state of the last ``k`` words of what led to ``state``."""
        while self.length[self.link[state]] >= k:
            state = self.link[state]
        return state

    def walk(self, ids: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state and longest matching length after each word."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for i, symbol in enumerate(ids):
            while state and symbol not in nxt[state]:
                state = link[state]
                n = length[state]
            if (to := nxt[state].get(symbol)) is not None:
                state, n = to, n + 1
            yield i, state, n

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans as word positions [start, end), merged; items with occurring windows.

        An unknown word takes the automaton back to its root, so only runs of known words that are
        long enough for the shortest window are walked.
        """
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        items: set = set()
        for a, b in edge.reshape(-1, 2)[(edge[1::2] - edge[::2]) >= self.least]:
            for i, state, n in self.walk(ids[a:b].tolist()):
                at = int(a) + i + 1
                if n >= self.window and (found := self.full.get(self.cover(state, self.window))):
                    items |= found
                    spans.append((at - self.window, at))
                for k in self.short_lengths:
                    if k > n:
                        break
                    if found := self.short.get((self.cover(state, k), k)):
                        items |= found
                        spans.append((at - k, at))
        return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def build_automata(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``part, nth, automaton`` (pickled): built in tasks, each from at most AUTOMATON_WORDS words (or one longer item).

    Their number follows from the items' words, and not from how Spark deals the items.
    """
    most = AUTOMATON_WORDS
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null").distinct()
    sizes = items.mapInArrow(_word_counts, "words long").agg(F.sum("words").alias("n"))
    parts = max(1, -(-2 * (sizes.first()["n"] or 0) // most))  # one number

    def build(rows: pa.Table) -> pa.Table:
        made, own, size = [], [], 0
        for item, raw in zip(rows.column("item").to_pylist(), raw_bytes(rows.column("text")), strict=True):
            words = words_of(raw)
            if own and size + len(words) > most:
                made.append(SuffixAutomaton(window).build(own))
                own, size = [], 0
            if words:
                own.append((item, words))
                size += len(words)
        if own:
            made.append(SuffixAutomaton(window).build(own))
        part, nth = [rows.column("part")[0].as_py()] * len(made), list(range(len(made)))
        return pa.table([pa.array(part, pa.int32()), pa.array(nth, pa.int32()), pa.array([pickle.dumps(x, pickle.HIGHEST_PROTOCOL) for x in made], pa.binary())], names=["part", "nth", "automaton"])

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int"))
    return written(dealt.groupBy("part").applyInArrow(build, "part int, nth int, automaton binary"), "automata")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts_in(batches):
        yield pa.RecordBatch.from_arrays([pa.array([len(words_of(raw)) for raw in raw_bytes(batch.column("text"))], pa.int64())], names=["words"])


@lru_cache(maxsize=1)
def _loaded(raw: bytes) -> SuffixAutomaton:
    """Python workers serve many tasks, and hold one automaton at a time."""
    return pickle.loads(raw)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_span: int = 1,
    coverage_limit: float = 0.5,
    columns: list[str] | None = None,
) -> DataFrame:
    """``docs`` plus ``n_words, n_hit, hit_items, hit_spans, coverage, clean_text, dropped``.

    ``hit_spans`` are word positions [start, end). ``clean_text`` lacks spans of at least
    ``min_span`` words; ``dropped`` marks documents whose hit share is over ``coverage_limit``.
    A null or empty text has no words and no hits. Items without words or without an id own no
    window. Items of equal text are all reported. Every row of ``docs`` comes back once, repeated
    rows too; columns of ``docs`` that bear one of the names above are replaced.
    """
    added = T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(ADDED, _KINDS, strict=True)))
    out = docs.drop(*added.names)
    keep = [c for c in (columns or out.columns) if c in out.columns]
    table = build_automata(items, item_id, item_text, window)
    names = [(r.part, r.nth) for r in table.select("part", "nth").orderBy("part", "nth").collect()]  # one row an automaton
    empty = pickle.dumps(SuffixAutomaton(window).build([]))
    for i, (part, nth) in enumerate(names or [(None, None)]):
        last = i >= len(names) - 1
        carried = keep if last else list(dict.fromkeys([*keep, text]))
        raw = bytes(table.where((F.col("part") == part) & (F.col("nth") == nth)).first()["automaton"]) if names else empty
        shared = docs.sparkSession.sparkContext.broadcast(raw)  # bounded: see AUTOMATON_WORDS
        schema = T.StructType([*(docs.schema[c] for c in carried), *added.fields])
        out = out.mapInArrow(_scanner(shared, carried, not i, text, min_span, coverage_limit, added), schema)
        if not last:
            out = written(out, "decontaminate")
    if text in keep:
        out = out.withColumn("clean_text", F.coalesce("clean_text", text))
    return out


def _scanner(shared, carried: list[str], first: bool, text: str, min_span: int, limit: float, added: T.StructType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _loaded(shared.value)
        for batch in texts_in(batches):
            rows: dict[str, list] = {name: [] for name in added.names}
            before = (
                zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist(), strict=True)
                if not first
                else repeat((None, None))
            )
            for raw, (spans0, items0) in zip(raw_bytes(batch.column(text)), before, strict=False):
                words = words_of(raw)
                spans, items = automaton.scan(words)
                if spans0:
                    spans = merged([*spans, *((s["start"], s["end"]) for s in spans0)])
                n_hit = sum(b - a for a, b in spans)
                share = n_hit / len(words) if words else 0.0
                rows["n_words"].append(len(words))
                rows["n_hit"].append(n_hit)
                rows["hit_items"].append(sorted({*items, *(items0 or ())}))
                rows["hit_spans"].append([{"start": a, "end": b} for a, b in spans])
                rows["coverage"].append(share)
                rows["clean_text"].append(without(raw, [s for s in spans if s[1] - s[0] >= min_span]))
                rows["dropped"].append(share > limit)
            kinds = [
                pa.int64(), pa.int64(), pa.list_(pa.string()),
                pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                pa.float64(), pa.string(), pa.bool_(),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True))],
                names=[*carried, *rows],
            )

    return scan


def without(raw: bytes | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of ``spans`` and what stands between them; None if nothing goes."""
    if raw is None or not spans:
        return None
    at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    keep, last = [], 0
    for a, b in spans:
        keep.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*keep, raw[last:]]).decode()


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of op1's contract."""
    found = decontaminate(docs.select("doc_id", "text"), items, columns=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
