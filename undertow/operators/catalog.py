"""Profiles, ranking, matching, progress and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.operators.running import running

#: Name, period range, grid size, gates, weights of the four score parts.
PROFILES = [
    ("balanced", 1.0, 15.0, 10000, 0.001, 0.85, (0.5, 0.25, 0.15, 0.10)),
    ("ultra_short_period", 0.2, 1.0, 15000, 0.002, 0.80, (0.45, 0.30, 0.15, 0.10)),
    ("single_transit_long_period", 10.0, 100.0, 8000, 0.0005, 0.75, (0.40, 0.20, 0.20, 0.20)),
    ("low_snr_m_dwarf", 0.5, 20.0, 12000, 0.0003, 0.70, (0.40, 0.25, 0.20, 0.15)),
]
PROFILE_SCHEMA = (
    "profile string, period_min double, period_max double, nperiods int, bls_threshold double, threshold double, "
    "weights struct<prob_planet:double,bls_power:double,centroid:double,niche_bonus:double>"
)


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_SCHEMA)


def resolve_profiles(rows: DataFrame, name: str = "profile") -> DataFrame:
    """``rows`` with the parameters of their profile; unknown and null names get the balanced ones."""
    known = profiles(rows.sparkSession)
    names = [p[0] for p in PROFILES]
    used = F.when(F.col(name).isin(names), F.col(name)).otherwise("balanced")
    return rows.withColumn("_p", used).join(F.broadcast(known.withColumnRenamed("profile", "_p")), "_p").drop("_p")


def with_overrides(rows: DataFrame, *params: str) -> DataFrame:
    """Non-null ``override_x`` columns win over the profile's ``x``."""
    return rows.withColumns({p: F.coalesce(f"override_{p}", p) for p in params}).drop(*(f"override_{p}" for p in params))


def score_candidates(rows: DataFrame, name: str = "profile") -> DataFrame:
    full = resolve_profiles(rows, name)
    score = S.candidate_score(F.col("prob_planet"), F.col("bls_power"), F.col("centroid_offset"), F.col(name), F.col("weights"))
    return full.withColumn("score", score).select(*rows.columns, "score")


def filter_candidates(rows: DataFrame, statuses: list[str], least: float) -> DataFrame:
    return rows.where(F.coalesce("discovery_status", F.lit("Unknown")).isin(statuses) & (F.col("prob_planet") >= least))


def display(rows: DataFrame, null_centroid_as_zero: bool = True) -> DataFrame:
    c = F.coalesce("centroid_offset", F.lit(0.0)) if null_centroid_as_zero else F.col("centroid_offset")
    return rows.select("tic_id", F.round("best_period", 4).alias("best_period"), F.round("prob_planet", 3).alias("prob_planet"), F.round("bls_power", 6).alias("bls_power"), F.round(c, 3).alias("centroid_offset"))


def rank_candidates(rows: DataFrame, by: str, key: str = "tic_id", group: str | None = None, k: int | None = None) -> DataFrame:
    """``rank`` by ``by`` descending, then key; the first k of each group, or of all."""
    if group is None and k is None:
        return running(rows, by, {"rank": F.lit(1)}, [F.col(key)])
    if group is None:
        rows = rows.orderBy(F.desc(by), key).limit(k)
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc(by), key)  # k rows without a group
    out = rows.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k is not None else out


def cross_match(candidates: DataFrame, known: DataFrame, key: str = "tic_id") -> DataFrame:
    """``discovery_status``: KNOWN or NEW_CANDIDATE, unless there is one already. An empty list tags nothing."""
    ids = known.select(S.normalize_id(F.col(known.columns[0]).cast("string")).alias("_id")).where("_id is not null").distinct().withColumn("_known", F.lit(True))
    some = ids.limit(1).agg(F.count("*").alias("n")).scalar() > 0  # looked up by the plan itself
    told = F.when(F.col("_known"), "KNOWN").when(some, "NEW_CANDIDATE")
    had = F.col("discovery_status") if "discovery_status" in candidates.columns else F.lit(None)
    joined = candidates.withColumn("_id", S.normalize_id(F.col(key).cast("string"))).join(ids, "_id", "left")
    return joined.withColumn("discovery_status", F.coalesce(had, told)).drop("_id", "_known")


def latest_state(log: DataFrame, key: str = "tic_id") -> DataFrame:
    """The last row of each id, by time and then sequence number; hot ids are reduced before the shuffle."""
    cols = [c for c in log.columns if c != key]
    last = F.max_by(F.struct(*cols), F.struct("updated_at", "seq"))
    return log.groupBy(key).agg(last.alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in cols))


def resume_pending(targets: DataFrame, log: DataFrame, key: str = "tic_id", done: tuple[str, ...] = ("DONE", "predict")) -> DataFrame:
    finished = latest_state(log, key).where(F.col("last_stage").isin(*done)).select(key)
    return targets.join(finished, key, "left_anti")


def stage_reached(stage: Column, at_least: str) -> Column:
    """Whether ``stage`` is ``at_least`` or later; unknown stages are not."""
    order = F.array(*map(F.lit, S.STAGES))
    return (F.array_position(order, stage) >= S.STAGES.index(at_least) + 1) & (F.array_position(order, stage) > 0)


def fill_missing(targets: DataFrame, stored: DataFrame, compute, key: str = "series_id") -> DataFrame:
    """Stored rows of the targets and computed ones for the rest."""
    todo = targets.join(stored.select(key), key, "left_anti")
    return stored.join(targets.select(key), key, "left_semi").unionByName(compute(todo))


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(position).alias(position))


def cap_per_class(rows: DataFrame, label: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def stitch_sectors(cadence: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` sectors of each series, each divided by its median, as sector ``all``."""
    w = Window.partitionBy("series_id").orderBy("sector")
    few = cadence.withColumn("_d", F.dense_rank().over(w)).where(F.col("_d") <= most).drop("_d")
    level = few.groupBy("series_id", "sector").agg(F.median("flux").alias("_m"))
    return few.join(level, ["series_id", "sector"]).select("series_id", F.lit("all").alias("sector"), "t", (F.col("flux") / F.nullif("_m", F.lit(0.0))).alias("flux"))


def progress_summary(log: DataFrame, key: str = "tic_id") -> DataFrame:
    last = latest_state(log, key)
    ids = last.agg(F.count("*").alias("ids"), F.count_if(F.col("last_stage") == "DONE").alias("done_ids"))
    rows = log.agg(F.count("*").alias("log_rows"), F.count_if(F.col("last_stage") == "DONE").alias("done_rows"), F.count_if(S.is_candidate(F.col("status"))).alias("candidate_rows"))
    return rows.withColumn("_", F.lit(1)).join(ids.withColumn("_", F.lit(1)), "_").drop("_")


def throughput(log: DataFrame) -> DataFrame:
    """Finished rows an hour between the first and last time; null if there is no time between."""
    done = log.where("last_stage = 'DONE'")
    hours = (F.unix_micros(F.max("updated_at")) - F.unix_micros(F.min("updated_at"))) / 3.6e9
    return done.agg(F.count("*").alias("finished"), F.round(F.count("*") / F.nullif(hours, F.lit(0.0)), 6).alias("per_hour"))


def throughput_running(log: DataFrame, day: str = "23 hours") -> DataFrame:
    """The rate as a run goes on: hour, finished (in it), total (so far), last_day (in the hours since ``day`` before),
    per_hour (total over the time from the first finished row to the hour's end). Hours without a finished row have none.

    Rows meet by the hour first, so the windows see a row for each hour of the run.
    """
    done = log.where("last_stage = 'DONE' and updated_at is not null")
    hours = done.groupBy(F.date_trunc("hour", "updated_at").alias("hour")).agg(F.count("*").alias("finished"), F.min("updated_at").alias("_first"))
    told = hours.withColumns({
        "total": F.expr("sum(finished) over (order by hour)"), "_first": F.expr("min(_first) over (order by hour)"),
        "last_day": F.expr(f"sum(finished) over (order by hour range between interval {day} preceding and current row)"),
    })
    spent = (F.unix_micros("hour") + 3_600_000_000 - F.unix_micros("_first")) / 3.6e9
    return told.select("hour", "finished", "total", "last_day", F.round(F.col("total") / spent, 6).alias("per_hour"))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Mean milliseconds of each stage and in all, over the finished series of a timings table."""
    return timings.agg(F.count("*").alias("series"), *(F.round(F.avg(f"{c}_ms"), 6).alias(f"mean_{c}_ms") for c in ("phase1", "phase2", "phase3", "predict", "total")))


def sweep_progress(completed: DataFrame, start: int, end: int) -> DataFrame:
    """done, total, share: how many of the sectors from start to end are completed."""
    done = F.count_distinct(F.when(F.col("sector").between(start, end), F.col("sector")))
    total = end - start + 1
    return completed.agg(done.alias("done"), F.lit(total).cast("long").alias("total"), F.round(done / F.lit(total), 6).alias("share"))
