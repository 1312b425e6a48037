"""Exact deduplication as a stateful stream, in DataFrame operations only.

Rows reach the stream as (digest, length, stable identifier, content locator). A streaming aggregate
without watermark keeps one entry a digest in the disk-backed state store: the largest identifier,
its locator, the count. State never expires, so a later run over new rows with the same folder goes
on from it. Digests that were hit more than once are then checked on full bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm.common import work_dir, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else executors hold the stores' memory in later steps
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores takes 4 MB of disk ahead
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body.cast("binary"), 256))


def digest_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digest, bytes, identifier and locator (the file the row came from) of every row; null counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        digest(body).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.col(key).cast("long").alias("key"),
        F.input_file_name().alias("locator"),
    )


def run_state(rows: DataFrame, folder: str) -> DataFrame:
    """Streams the table ``rows`` (already in the shared folder) through the keyed state in ``folder``.

    Returns the state's last word for each digest: ``digest, n_bytes, keep_id, locator, group_size``.
    """
    spark = rows.sparkSession
    source = rows.inputFiles()
    if not source:
        return rows.groupBy("digest", "n_bytes").agg(*_state())
    with _conf(spark, STATE_CONF):
        stream = spark.readStream.schema(rows.schema).parquet(source[0].rpartition("/")[0])
        query = (
            stream.groupBy("digest", "n_bytes").agg(*_state())
            .writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/updates/batch={n}"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    told = spark.read.parquet(f"{folder}/updates")
    return told.groupBy("digest", "n_bytes").agg(
        F.max("keep_id").alias("keep_id"),
        F.max_by("locator", "batch").alias("locator"),
        F.max("group_size").alias("group_size"),
    )


def _state() -> list[Column]:
    return [
        F.max("key").alias("keep_id"),
        F.max_by("locator", "key").alias("locator"),
        F.count("*").alias("group_size"),
    ]


def exact_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` plus ``keep_id, group_size, kept, text_sha256``, one row for each input row.

    Of equal texts (null counts as empty) the row with the largest ``key`` stays. Rows repeated with
    the same key and text share one decision and are all marked kept; a null key is never the one
    that stays unless its whole group has null keys, and such groups are kept. Columns of ``docs``
    with the added names are replaced.

    A hot group costs one state entry and, in each task, one partly aggregated row before the
    shuffle. Its rows meet their entry in a join whose large side Spark may split.
    """
    spark = docs.sparkSession
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256", "_digest", "_body", "_sha")
    folder = work_dir(spark, "exactdedup")
    digest_rows(docs, key, text, digest).write.parquet(f"{folder}/rows")
    state = written(run_state(spark.read.parquet(f"{folder}/rows"), folder), "dedup-state")

    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumn("_digest", digest(body)).withColumn("_sha", F.col("_digest") if digest is sha256 else sha256(body))
    hits = state.where("group_size > 1").select(F.col("digest").alias("_digest"))
    # Full bytes of the hits: grouping by the text itself compares them, after a partial aggregate in each task.
    classes = (
        marked.join(hits, "_digest", "left_semi")
        .groupBy("_digest", body.alias("_body"))
        .agg(F.max(key).cast("long").alias("keep_id"), F.count("*").alias("group_size"))
    )
    mixed = written(classes.groupBy("_digest").agg(F.count("*").alias("n")).where("n > 1").select("_digest"), "dedup-mixed")
    told = [F.col("digest").alias("_digest"), "keep_id", "group_size"]
    if mixed.isEmpty():  # one text a digest, as always unless SHA-256 collides
        joined = marked.join(state.select(*told), "_digest")
    else:  # the texts of those digests meet their class by their bytes
        single = state.select(*told).join(mixed, "_digest", "left_anti")
        several = marked.join(mixed, "_digest", "left_semi").withColumn("_body", body).join(classes.join(mixed, "_digest", "left_semi"), ["_digest", "_body"])
        joined = marked.join(single, "_digest").unionByName(several.drop("_body"))
    return joined.select(
        *(F.col(f"`{c}`") for c in docs.columns), "keep_id", "group_size",
        F.coalesce(F.col(key) == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
