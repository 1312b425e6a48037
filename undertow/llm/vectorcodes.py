"""Vector codes by product quantisation, with codebooks from member-resident Lloyd rounds.

A vector's integer components ``floor(4096 * x)`` are cut into equal parts; each part position has a codebook of
at most 16 entries. Parts live as rows with the owner of their entry: a table dealt by (position, entry, salt), in
which every entry has as many owners as all vectors would need. A round is two steps over that table:

* update: every owner sums its resident members (rows of one owner meet before the exchange, which carries a row
  for each owner and task), owners of one entry are summed, and the entries move;
* move: every owner looks for the nearest entry of each resident. Members that stay are written where they are;
  only those whose entry changes go through a shuffle, to their new owner.

The codebooks are all that every task gets: parts x entries x width integers, whatever the number of vectors. Codes
and errors come from one map over the vectors with the final codebooks, which is the last assignment.

Defined results: vectors that are null, empty, or hold null or non-finite components are left out. The vector of the
smallest kept key gives the length; vectors of another length are left out too. A length that the number of parts
does not divide is filled up with zeros. Components beyond +-2**28 / 4096 count as that. Null keys come after all
others and rows of one key in order of their vectors, when the first entries are taken; every row gets its own code.
With fewer than 16 kept vectors the codebooks have as many entries as there are vectors; with none there are no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.common import Scratch, texts_in

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 28  # of a component: differences, squares and their sums stay within 64 bits
OWNER = 250_000  # members of one owner, at most about
BATCH = 8_192  # rows that a task looks at together


def _whole(vector: str, length: int | None = None) -> Column:
    """A vector that can be coded."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good if length is None else good & (F.size(v) == length), F.lit(False))


def _integers(column: pa.Array, length: int, parts: int) -> np.ndarray:
    """rows x parts x width integers of vectors that all have ``length`` components."""
    flat = np.asarray(column.flatten()).astype(np.float64).reshape(-1, length)
    whole = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    width = -(-length // parts)
    return np.pad(whole, ((0, 0), (0, width * parts - length))).reshape(-1, parts, width)


def nearest(members: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest row of ``book`` (the lower one of equal distances) and the squared distance."""
    far = np.zeros((len(members), len(book)), np.int64)
    for j in range(members.shape[1]):
        far += (members[:, j, None] - book[None, :, j]) ** 2
    entry = far.argmin(1) if len(members) else np.zeros(0, np.int64)
    return entry, far[np.arange(len(members)), entry]


def updated(book: np.ndarray, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> np.ndarray:
    """The codebooks with each used entry replaced by the floor of its members' mean; unused entries stay."""
    out = book.copy()
    for (position, entry), (count, total) in sums.items():
        out[position, entry] = [t // count for t in total]
    return out


class Residents:
    """The parts' table: position, entry, salt and one integer column for each component."""

    def __init__(self, vectors: DataFrame, vector: str, length: int, first: np.ndarray) -> None:
        self.parts, _, self.width = first.shape
        self.length, self.cells = length, [f"c{j}" for j in range(self.width)]
        self.shape = f"position int, entry int, salt int, {', '.join(f'{c} int' for c in self.cells)}"
        self.spark = vectors.sparkSession
        self.scratch = Scratch(self.spark, "residents")
        source = vectors.where(_whole(vector, length)).select(F.col(vector).cast("array<double>").alias("v"))
        self.salts = self._salts(source.count())
        placed = source.mapInArrow(self._place(first), self.shape).repartition("position", "entry", "salt")
        self.held = [self.scratch.put(placed)]

    def _salts(self, n: int) -> int:
        """Owners of an entry: even one that all vectors go to gives none much more than the mean of all tasks, or than OWNER."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return -(-n // max(1, min(OWNER, self.parts * n // (2 * tasks))))

    def _place(self, book: np.ndarray):
        length, parts, salts, names = self.length, self.parts, self.salts, ["position", "entry", "salt", *self.cells]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = 0
            for batch in texts_in(batches, BATCH):
                rows = _integers(batch.column("v"), length, parts)
                turn, seen = np.arange(seen, seen + len(rows)), seen + len(rows)
                for p in range(parts):
                    entry = nearest(rows[:, p], book[p])[0]
                    columns = [np.full(len(rows), p), entry, turn % salts, *rows[:, p].T]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=names)

        return run

    def sums(self) -> dict[tuple[int, int], tuple[int, list[int]]]:
        """Count and component sums of every used entry, from the owners' residents."""
        rows = self.spark.read.schema(self.shape).parquet(*self.held)
        own = rows.groupBy("position", "entry", "salt").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in self.cells))
        told = own.groupBy("position", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in self.cells)).collect()
        return {(r["position"], r["entry"]): (r["n"], [r[c] for c in self.cells]) for r in told}

    def move(self, book: np.ndarray) -> None:
        """Members that another entry is nearer to go to its owner; the others stay in their owner's files."""
        cells, salts, names = self.cells, self.salts, ["position", "entry", "salt", *self.cells, "moved"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = 0
            for batch in texts_in(batches, BATCH):
                position, old, salt = (np.asarray(batch.column(c)).astype(np.int64) for c in ("position", "entry", "salt"))
                rows = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in cells])
                entry, turn, seen = old.copy(), np.arange(seen, seen + len(rows)), seen + len(rows)
                for p in np.unique(position):
                    entry[position == p] = nearest(rows[position == p], book[p])[0]
                moved = entry != old
                salt = np.where(moved, turn % salts, salt)
                columns = [pa.array(c, pa.int32()) for c in (position, entry, salt, *rows.T)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(moved)], names=names)

        told = self.scratch.put(self.spark.read.schema(self.shape).parquet(*self.held).mapInArrow(run, f"{self.shape}, moved boolean"), "moved")
        rows = self.spark.read.schema(f"{self.shape}, moved boolean").parquet(told)
        came = self.scratch.put(rows.where("moved").drop("moved").repartition("position", "entry", "salt"))
        last, self.held = self.held, [p for p in (f"{told}/moved=false", came) if self.scratch.has(p)]
        self.scratch.remove(*(p for p in last if p not in self.held), f"{told}/moved=true")


def fit_codebooks(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[int, np.ndarray]:
    """The vectors' length and the codebooks, parts x entries x width integers; (0, none) without any vector."""
    kept = vectors.where(_whole(vector)).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    least = kept.orderBy(F.asc_nulls_last("k"), "v").limit(1).collect()
    if not least:
        return 0, np.zeros((parts, 0, 0), np.int64)
    length = len(least[0]["v"])
    first = [r["v"] for r in kept.where(F.size("v") == length).orderBy(F.asc_nulls_last("k"), "v").limit(entries).collect()]
    book = _integers(pa.array(first, pa.list_(pa.float64())), length, parts).transpose(1, 0, 2).copy()
    if rounds:
        residents = Residents(vectors, vector, length, book)
        for at in range(rounds):
            book = updated(book, residents.sums())
            if at + 1 < rounds:  # after the last update the vectors themselves are assigned
                residents.move(book)
        residents.scratch.clear()
    return length, book


def encode(vectors: DataFrame, model: tuple[int, np.ndarray], *, vector: str = "embedding", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of the vectors that can be coded (all by default), ``code`` and ``error``, which replace columns so named.

    ``code`` has the index of each part's nearest entry as two hex digits, ``error`` the squared distances' sum.
    """
    length, book = model
    keep = [c for c in (columns or vectors.columns) if c not in ("code", "error")]
    schema = T.StructType([*(vectors.schema[c] for c in keep), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    rows = vectors.where(_whole(vector, length)).select(*(F.col(f"`{c}`") for c in keep), F.col(vector).cast("array<double>").alias("_vector"))
    digits = np.array([f"{i:02x}" for i in range(book.shape[1])], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_in(batches, BATCH):
            whole = _integers(batch.column("_vector"), length, len(book))
            found = [nearest(whole[:, p], book[p]) for p in range(len(book))]
            code = np.sum([digits[entry] for entry, _ in found], axis=0) if len(whole) else np.array([], object)
            error = np.sum([far for _, far in found], axis=0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*keep, "code", "error"])

    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, model: tuple[int, np.ndarray], code: str = "code") -> DataFrame:
    """``coded`` plus ``decoded``: the integers of the entries that each code names, without the filling."""
    length, book = model
    parts = [F.array(*(F.array(*map(F.lit, entry.tolist())) for entry in own)) for own in book]
    at = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1 for p in range(len(book))]
    return coded.withColumn("decoded", F.slice(F.concat(*(F.element_at(own, i) for own, i in zip(parts, at, strict=True))), 1, length))


def digest(book: np.ndarray) -> str:
    """SHA-256 of the decimal components by part, entry and position within the part, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """The columns of op11's contract. Errors are summed by label in a table of a row for each label, written and
    joined as a table: Spark broadcasts it if its files are small and shuffles it otherwise."""
    model = fit_codebooks(vectors)
    scratch = Scratch(vectors.sparkSession, "vectorcodes")
    coded = scratch.write(encode(vectors, model, columns=["vec_id", "label"]))
    labels = scratch.write(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(model[1])).alias("codebooks_sha256"))
