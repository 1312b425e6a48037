"""What the operators of this subpackage share: word rules, the shared work folder, Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased; all others become spaces.
#: UTF-8 bytes from 0x80 up belong to words, so the byte form and the character form give the same words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(raw: bytes | None) -> list[bytes]:
    """The lower-cased words of a text in UTF-8; none of null."""
    return raw.translate(WORD_BYTES).split() if raw else []


def space_words_of(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; ``bytes.lower`` and ``bytes.split`` know ASCII only."""
    return raw.lower().split() if raw else []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``).

    Where the session has none, a local one is set for this session if it runs on this machine alone, as in
    tests; on a cluster executors could not see it, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="undertow-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and lost executors cost no recomputation."""
    return Scratch(df.sparkSession, name).write(df)


class Scratch:
    """Tables of one operator in the shared folder; those that no later step reads can be deleted."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.paths, self.made = spark, work_dir(spark, name), {}, 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def put(self, df: DataFrame, *by: str) -> str:
        """Writes ``df``, with a folder for each value of ``by``, and returns the path; see ``remove``."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
        return path

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, path: str) -> bool:
        where, system = self._at(path)
        return system.exists(where)

    def remove(self, *paths: str) -> None:
        """Deletes what ``put`` wrote. Nothing that is still to run may read it."""
        for path in paths:
            where, system = self._at(path)
            system.delete(where, True)

    def clear(self) -> None:
        """Deletes all of this operator's tables."""
        self.remove(self.folder)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that ``write`` returned. Nothing that is still to run may read them.

        What the steps before have shuffled goes too: Spark's cleaner deletes it once the JVM has found that
        nothing refers to it any more, so both collectors are asked to look.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(table)][0])
            path.getFileSystem(conf).delete(path, True)
            del self.paths[id(table)]
        gc.collect()
        jvm.java.lang.System.gc()


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def texts_in(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a task holds stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
