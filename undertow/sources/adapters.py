"""The driver's tables as the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions.scalars import fixed

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series a user: t in days since 2024-01-01 UTC."""
    e = table(spark, sf_dir, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 86400e6
    sector = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int")
    return e.select(F.col("user_id").cast("string").alias("series_id"), sector.alias("sector"), t.alias("t"), F.col("value").alias("flux"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stage = F.when(F.col("event_type") == "click", "phase1").when(F.col("event_type") == "view", "phase2").when(F.col("event_type") == "signup", "phase3").when(F.col("event_type") == "purchase", "predict").otherwise("DONE")
    status = F.when(stage != "DONE", "IN_PROGRESS").when(F.col("value") >= 60, F.format_string("CANDIDATE (%s)", fixed(F.col("value") / 1000, 2))).otherwise("CLEARED")
    return e.select(F.col("user_id").cast("string").alias("tic_id"), stage.alias("last_stage"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_id").alias("seq"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    profile = F.element_at(F.array(*map(F.lit, ["balanced", "ultra_short_period", "single_transit_long_period", "low_snr_m_dwarf", "other"])), (k % 5 + 1).cast("int"))
    return c.select(
        k.cast("string").alias("tic_id"), ((k * 37 % 1000) / 100.0 + 0.5).alias("best_period"), ((k * 7919 % 1000) / 1000.0 + 0.000003).alias("prob_planet"),
        ((k * 31 % 200) / 10000.0).alias("bls_power"), F.when(k % 7 != 0, (k * 13 % 80) / 10.0).alias("centroid_offset"),
        F.when(k % 3 == 0, "KNOWN").when(k % 3 == 1, "NEW_CANDIDATE").alias("discovery_status"), profile.alias("profile"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return l.join(d.select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
