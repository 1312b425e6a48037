"""Readers and writers of the library's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions.scalars import centroid_or_zero, is_missing, normalize_id
from undertow.operators.catalog import latest_state, ordered_distinct

CADENCE = "series_id string, sector int, t double, flux double, flux_err double"
PROGRESS = "tic_id string, last_stage string, status string, best_period double, updated_at timestamp, error string, sector int, seq long"
EVIDENCE = "tic_id string, best_period double, prob_planet double, bls_max_power double, centroid_offset double, plot string, timestamp string, discovery_status string"
STAGE_VERSION = 2


def read_cadence(spark: SparkSession, path: str, series: str | None = None, sector: int | None = None) -> DataFrame:
    """Rows of one or all series; partition pruning by sector. Raises if a named series has none."""
    df = spark.read.parquet(path)
    df = df if series is None else df.where(F.col("series_id") == series)
    df = df if sector is None else df.where(F.col("sector") == sector)
    if series is not None and df.isEmpty():
        raise ValueError(f"no rows of series {series}")
    return df if "flux_err" in df.columns else df.withColumn("flux_err", F.lit(None).cast("double"))


def read_target_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """tic_id, pos from text lines: blanks and # comments go, the first of equal ids stays, in line order."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"))
    ids = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(normalize_id(F.col("value")).alias("tic_id"), "pos")
    out = ordered_distinct(ids, "tic_id", "pos").orderBy("pos")
    return out if limit is None else out.limit(limit)


def sector_targets(catalogue: DataFrame, sector: int, limit: int | None = None) -> DataFrame:
    rows = catalogue.where((F.col("collection") == "TESS") & (F.col("sequence_number") == sector) & (F.col("dataproduct_type") == "timeseries"))
    out = rows.select(normalize_id(F.col("target_name").cast("string")).alias("tic_id")).distinct().orderBy("tic_id")
    return out if limit is None else out.limit(limit)


def known_objects(table: DataFrame, column: str) -> DataFrame:
    return table.select(F.col(column).cast("string").alias("tic_id")).where("tic_id is not null").distinct()


def labelled_catalogue(confirmed: DataFrame, candidates: DataFrame) -> DataFrame:
    """tic_id, label: confirmed ones of the mission are 1, false positives 0."""
    yes = confirmed.where("disc_facility like '%TESS%' and default_flag = 1").select("tic_id").distinct().withColumn("label", F.lit(1))
    no = candidates.where("tfopwg_disp = 'FP'").select("tic_id").distinct().withColumn("label", F.lit(0))
    return yes.unionByName(no)


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns global_* and local_* become arrays in file order; a missing centroid counts 0."""
    wide = spark.read.csv(path, header=True)
    view = lambda prefix: F.array(*(F.col(f"`{c}`").cast("double") for c in wide.columns if c.startswith(prefix)))
    centroid = F.col("centroid_offset").cast("double") if "centroid_offset" in wide.columns else F.lit(0.0)
    return wide.select(view("global_").alias("global_view"), view("local_").alias("local_view"), centroid.alias("centroid_offset"), F.col("label").cast("int").alias("label"))


def read_feature_manifest(manifest: DataFrame, features: DataFrame, key: str = "tic_id") -> DataFrame:
    """Stored views of the series that a manifest lists, with its labels; a missing centroid counts 0.

    A series listed twice comes twice; listed series without views fall out. The manifest's label wins.
    """
    views = features.select(key, "global_view", "local_view", "centroid_offset") if "centroid_offset" in features.columns else features.select(key, "global_view", "local_view", F.lit(None).cast("double").alias("centroid_offset"))
    rows = manifest.select(key, F.col("label").cast("int").alias("label")).join(views, key)
    return rows.select(key, "global_view", "local_view", centroid_or_zero(F.col("centroid_offset")).alias("centroid_offset"), "label")


def stage_read(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the current version; rows without a version count as current."""
    df = spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return df.where(f"cache_version is null or cache_version >= {STAGE_VERSION}") if "cache_version" in df.columns else df


def stage_write(df: DataFrame, path: str) -> None:
    """Replaces the sectors that ``df`` has and leaves the others."""
    out = df.withColumn("cache_version", F.lit(STAGE_VERSION))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sector").parquet(path)


def stage_exists(targets: DataFrame, stage: DataFrame, key: str = "series_id") -> DataFrame:
    return targets.join(stage.select(key), key, "left_semi")


def append(df: DataFrame, path: str) -> None:
    """Progress, timings and metrics grow by rows."""
    df.write.mode("append").parquet(path)


def progress_read(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.schema(PROGRESS).parquet(path)
    return latest_state(log.withColumn("tic_id", normalize_id(F.col("tic_id"))))


def evidence_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("centroid_offset", F.when(is_missing(F.col("centroid_offset")), None).otherwise(F.col("centroid_offset")))


def evidence_write(rows: DataFrame, path: str) -> None:
    evidence_rows(rows).write.mode("append").json(path)


def evidence_read(spark: SparkSession, path: str) -> DataFrame:
    """Unreadable records are skipped; ``source`` is the file."""
    df = spark.read.schema(EVIDENCE).option("mode", "DROPMALFORMED").json(path)
    return df.withColumn("source", F.col("_metadata.file_path")).where("tic_id is not null")


def discovery_packet(ranked: DataFrame) -> DataFrame:
    """One JSON text a candidate, under the names that a report uses."""
    return ranked.select(F.to_json(F.struct(F.col("tic_id").alias("target"), F.col("best_period").alias("period_days"), F.col("prob_planet").alias("probability"), "score", "discovery_status")).alias("packet"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Older multi-line result documents with NaN tokens; a missing confidence is null."""
    df = spark.read.option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    return df if "confidence_score" in df.columns else df.withColumn("confidence_score", F.lit(None).cast("double"))


def pending_sectors(spark: SparkSession, start: int, end: int, completed: DataFrame) -> DataFrame:
    every = spark.range(start, end + 1).select(F.col("id").cast("int").alias("sector"))
    return every.join(completed.select("sector"), "sector", "left_anti")


def metrics_write(scores: DataFrame, path: str) -> None:
    """A one-row table of metrics as JSON."""
    scores.write.mode("overwrite").json(path)


def metrics_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def timings_write(rows: DataFrame, path: str) -> None:
    """One row a finished series: series_id, milliseconds of each stage and in all, status."""
    rows.select("tic_id", "phase1_ms", "phase2_ms", "phase3_ms", "predict_ms", "total_ms", "status").write.mode("append").parquet(path)


def state_write(completed: DataFrame, path: str) -> None:
    """Adds completed sectors to a sweep's state; a sector written twice counts once when read."""
    completed.select(F.col("sector").cast("int").alias("sector")).distinct().write.mode("append").parquet(path)


def state_read(spark: SparkSession, path: str) -> DataFrame:
    """``sector`` of every completed one; none before the first write."""
    empty = spark.createDataFrame([], "sector int")
    return spark.read.schema("sector int").parquet(path).distinct() if exists(spark, path) else empty


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``), for a run's tables.

    Where the session has none, a local one is set for it if it runs on this machine alone; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='undertow-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
