"""Composite plans: scan, hunt, sweep, train, browse."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.operators import catalog, clean, fold, metrics, ml, search, vetting
from undertow.sources import io

IDS_BROADCAST = 100_000  # ids that are sent to all tasks; more are joined by a shuffle


@dataclass(frozen=True)
class Config:
    low: float = 0.5
    high: float = 20.0
    coarse: int = 2000
    refine: int = 3000
    half: int = 50
    sigma: float = 3.0
    rounds: int = 5
    least: int = 50
    bls_threshold: float = 0.001
    threshold: float = 0.85
    form: str = "grouped"
    gaps: float | None = 5.0  # median steps that part two segments of the trend
    snr: float | None = None  # least signal-to-noise ratio of a dip; 7.1 is usual


def hunt(series: DataFrame, cfg: Config = Config(), model: PipelineModel | None = None, log: DataFrame | None = None) -> DataFrame:
    """series_id, n, status, best_period, epoch, max_power, prob_planet for every pending series, and snr if it is asked for.

    Gates come before the costly steps: short series and series without power are never folded, and
    without a model nothing is. With ``cfg.snr`` a dip below that ratio is no signal either.
    """
    series = pending(series, log)
    cleaned = phase1(series, cfg)
    told = with_snr(cleaned, phase2(cleaned, cfg, series), cfg)
    strong = told.where(passes(cfg))
    features = None if model is None else fold.features(cleaned.join(strong.select("series_id"), "series_id", "left_semi"), strong)
    return verdicts(series, told, strong, features, cfg, model)


def pending(series: DataFrame, log: DataFrame | None) -> DataFrame:
    """The series that a progress log has not as finished."""
    if log is None:
        return series
    finished = catalog.latest_state(log).where(F.col("last_stage").isin("DONE", "predict")).select(F.col("tic_id").alias("series_id"))
    return series.join(finished, "series_id", "left_anti")


def phase1(series: DataFrame, cfg: Config) -> DataFrame:
    """Long enough series, cleaned. The window's exchange by series serves the cleaning and the search too."""
    long_enough = series.withColumn("_n", F.count("*").over(Window.partitionBy("series_id"))).where(F.col("_n") >= cfg.least)
    return clean.clean_series(long_enough.select("series_id", "t", "flux"), cfg.half, cfg.sigma, cfg.rounds, cfg.gaps)


def phase2(cleaned: DataFrame, cfg: Config, series: DataFrame | None = None) -> DataFrame:
    """The search of the cleaned rows; ``series``, the rows before, tells which series are long without cleaning them for it."""
    return search.two_pass(cleaned, cfg.low, cfg.high, coarse=cfg.coarse, refine=cfg.refine, form=cfg.form, counted=series)


def with_snr(cleaned: DataFrame, best: DataFrame, cfg: Config) -> DataFrame:
    """``best`` with ``snr`` if the gates ask for it. Every series of ``best`` has rows; the search runs once."""
    if cfg.snr is None:
        return best
    own = tuple(c for c in best.columns if c != "series_id")
    return vetting.depth_snr(cleaned, best, keep=own).select(*best.columns, "snr")


def passes(cfg: Config):
    enough = F.col("max_power") >= cfg.bls_threshold
    return enough if cfg.snr is None else enough & F.coalesce(F.col("snr") > cfg.snr, F.lit(False))


def verdicts(series: DataFrame, best: DataFrame, strong: DataFrame, features: DataFrame | None, cfg: Config, model: PipelineModel | None) -> DataFrame:
    """Every series with its status; without a model those that pass the gates are cleared, and the search runs once."""
    counts = series.groupBy("series_id").agg(F.count("*").alias("n"))
    out = counts.join(best, "series_id", "left")
    if features is None:
        out = out.withColumn("prob_planet", F.lit(None).cast("double"))
    else:
        out = out.join(ml.score_batch(features, model).select("series_id", "prob_planet"), "series_id", "left")
    weak = F.when(F.col("best_period").isNotNull() & ~passes(cfg), "NO_SIGNAL")
    status = F.coalesce(S.length_status(F.col("n"), cfg.least), weak, S.assign_status(F.col("prob_planet"), cfg.threshold))
    more = [] if cfg.snr is None else ["snr"]
    return out.select("series_id", "n", status.alias("status"), "best_period", "epoch", "max_power", *more, "prob_planet")


class Hunt(NamedTuple):
    """The tables of a staged hunt."""

    cleaned: DataFrame
    best: DataFrame
    features: DataFrame | None
    found: DataFrame
    timings: DataFrame


class Clock:
    """Writes the tables of a run's stages and tells what each took: ``seconds`` by the wall clock, ``rows`` as observed.

    A session that has observed can't ship pyspark.ml models with a training summary to tasks; ``ml`` fits them without.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.seconds: dict[str, float] = {}
        self.rows: dict[str, int] = {}

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        seen, began, path = Observation(name), time.monotonic(), f"{self.folder}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        self.seconds[name], self.rows[name] = time.monotonic() - began, seen.get["rows"]
        return self.spark.read.schema(df.schema).parquet(path)


def staged_hunt(series: DataFrame, folder: str, cfg: Config = Config(), model: PipelineModel | None = None, log: DataFrame | None = None) -> Hunt:
    """A hunt whose stages are tables in ``folder``, with a row of timings for each finished series.

    Each stage is read by the next, so that nothing is computed twice and a lost executor costs one stage at most. A
    stage's wall clock is dealt to the series that reach it by their rows: the sum over the series is the clock's.
    """
    clock, series = Clock(series.sparkSession, folder), pending(series, log)
    cleaned = clock.stage("phase1", phase1(series, cfg))
    best = clock.stage("phase2", with_snr(cleaned, phase2(cleaned, cfg), cfg))
    strong, features = best.where(passes(cfg)), None
    if model is not None:
        features = clock.stage("phase3", fold.features(cleaned.join(strong.select("series_id"), "series_id", "left_semi"), strong))
    found = clock.stage("predict", verdicts(series, best, strong, features, cfg, model))
    reached = {"phase1": F.lit(True), "phase2": F.col("best_period").isNotNull(), "phase3": passes(cfg), "predict": F.lit(True)}
    total = found.agg(*(F.sum(F.when(reached[p], F.col("n"))).alias(p) for p in S.STAGES[:4])).first()  # one row
    share = {f"{p}_ms": F.when(reached[p], F.col("n") / F.lit(max(total[p] or 1, 1)) * (1000 * clock.seconds.get(p, 0.0))).otherwise(0.0) for p in S.STAGES[:4]}
    rows = found.select(S.normalize_id(F.col("series_id").cast("string")).alias("tic_id"), "status", *(F.coalesce(x, F.lit(0.0)).alias(p) for p, x in share.items()))
    rows = rows.withColumn("total_ms", sum((F.col(p) for p in share), F.lit(0.0)))
    io.timings_write(rows, f"{folder}/timings")
    return Hunt(cleaned, best, features, found, series.sparkSession.read.parquet(f"{folder}/timings"))


def scan(series: DataFrame, series_id: str, cfg: Config = Config(), model: PipelineModel | None = None) -> DataFrame:
    return hunt(series.where(F.col("series_id") == series_id), cfg, model)


class Scan(NamedTuple):
    """All that a scan of one series works out."""

    cleaned: DataFrame
    spectrum: DataFrame
    best: DataFrame
    features: DataFrame
    curve: DataFrame
    found: DataFrame


def scan_all(series: DataFrame, series_id: str, cfg: Config = Config(), model: PipelineModel | None = None) -> Scan:
    """A scan with its intermediates: the cleaned series, both passes' spectrum, the views, the folded curve."""
    own = series.where(F.col("series_id") == series_id)
    cleaned = phase1(own, cfg)
    best = phase2(cleaned, cfg, own)
    spectrum = search.spectra(cleaned, cfg.low, cfg.high, cfg.coarse, cfg.refine, counted=own)
    curve = fold.folded_curve(fold.folded(cleaned, best))
    return Scan(cleaned, spectrum, best, fold.features(cleaned, best), curve, hunt(own, cfg, model))


def sweep(series: DataFrame, known: DataFrame, cfg: Config = Config(), model: PipelineModel | None = None, pending: DataFrame | None = None) -> DataFrame:
    """All pending sectors in one job: each (sector, series) is a series of its own."""
    return catalog.cross_match(_parted(hunt(_by_sector(series, pending), cfg, model), "series_id"), known, "series_id")


def staged_sweep(
    series: DataFrame, known: DataFrame, folder: str, cfg: Config = Config(), model: PipelineModel | None = None, pending: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """A sweep with stage tables in ``folder``, and its timings (sector, tic_id, milliseconds); see ``staged_hunt``."""
    done = staged_hunt(_by_sector(series, pending), folder, cfg, model)
    return catalog.cross_match(_parted(done.found, "series_id"), known, "series_id"), _parted(done.timings, "tic_id")


def _by_sector(series: DataFrame, pending: DataFrame | None) -> DataFrame:
    if pending is not None:
        series = series.join(F.broadcast(pending.select("sector")), "sector", "left_semi")
    return series.withColumn("series_id", F.concat_ws("|", F.col("sector").cast("string"), "series_id"))


def _parted(rows: DataFrame, key: str) -> DataFrame:
    part = F.split(key, r"\|", 2)
    return rows.withColumns({"sector": part[0].cast("int"), key: part[1]})


def sector_summary(swept: DataFrame) -> DataFrame:
    """Counts of each sector's series, and of the candidates among them by what is known of them."""
    return swept.groupBy("sector").agg(
        F.count("*").alias("done"), F.count_if(S.is_candidate(F.col("status"))).alias("candidates"),
        F.count_if(F.col("discovery_status") == "KNOWN").alias("known"), F.count_if(F.col("discovery_status") == "NEW_CANDIDATE").alias("new"),
    )


def sector_totals(swept: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Series by sector and kind of status, with the sector's totals and the sweep's.

    sector, kind (null in totals), level (0: one kind, 1: a sector, 3: the sweep), done, known, new, best (most power), and
    with ``timings`` (sector, tic_id, total_ms) the elapsed seconds. Candidates count as one kind, whatever their number.
    """
    kind = F.when(S.is_candidate(F.col("status")), "CANDIDATE").when(F.col("status").startswith("ERROR"), "ERROR").otherwise(F.col("status"))
    rows = swept.withColumn("kind", kind)
    spent = []
    if timings is not None:
        rows = rows.withColumn("tic_id", S.normalize_id(F.col("series_id").cast("string"))).join(timings.select("sector", "tic_id", "total_ms"), ["sector", "tic_id"], "left")
        spent = [(F.coalesce(F.sum("total_ms"), F.lit(0.0)) / 1000).alias("elapsed")]
    return rows.rollup("sector", "kind").agg(
        F.grouping_id("sector", "kind").cast("int").alias("level"), F.count("*").alias("done"), F.count_if(F.col("discovery_status") == "KNOWN").alias("known"),
        F.count_if(F.col("discovery_status") == "NEW_CANDIDATE").alias("new"), F.max("max_power").alias("best"), *spent,
    )


def search_stage(series: DataFrame, stored: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Best periods with their search's parameters, from the stage table where it has this search, else computed.

    ``stored`` and the result: series_id, sector, period_min, period_max, nperiods, best_period, epoch, max_power. A
    stored row counts only if all its parameters are this search's. ``series`` has series_id, sector, t, flux.
    """
    own = {"period_min": cfg.low, "period_max": cfg.high, "nperiods": cfg.coarse + cfg.refine}
    had = stored.where(" and ".join(f"{k} = {v!r}" for k, v in own.items()))
    keys = series.select("series_id", "sector").distinct()
    todo = series.join(had.select("series_id", "sector"), ["series_id", "sector"], "left_anti")
    both = todo.withColumn("series_id", F.concat_ws("|", F.col("sector").cast("string"), "series_id"))
    found = search.two_pass(both, cfg.low, cfg.high, coarse=cfg.coarse, refine=cfg.refine, form=cfg.form)
    part = F.split("series_id", r"\|", 2)
    found = found.withColumns({"sector": part[0].cast(series.schema["sector"].dataType), "series_id": part[1], **{k: F.lit(v) for k, v in own.items()}})
    cols = ["series_id", "sector", *own, "best_period", "epoch", "max_power"]
    return had.join(keys, ["series_id", "sector"], "left_semi").select(*cols).unionByName(found.select(*cols))


def feature_stage(series: DataFrame, best: DataFrame, stored: DataFrame, sector: str = "all") -> DataFrame:
    """Views with the key of their series, sector and period, from the stage table where it has the key, else computed.

    ``stored`` and the result: key, series_id, sector, best_period, global_view, local_view, centroid_offset. A search that
    found another period has another key, so its old views don't count. Only series without a stored row are folded.
    """
    key = S.stage3_key(F.col("series_id"), F.lit(sector), F.col("best_period"))
    wanted = best.withColumns({"key": key, "sector": F.lit(sector)})
    had = stored.join(wanted.select("key"), "key", "left_semi")
    todo = wanted.join(stored.select("key"), "key", "left_anti")
    views = fold.features(series.join(todo.select("series_id"), "series_id", "left_semi"), todo, rows=series.count())
    cols = ["key", "series_id", "sector", "best_period", "global_view", "local_view", "centroid_offset"]
    return had.select(*cols).unionByName(views.join(todo.select("key", "series_id", "sector", "best_period"), "series_id").select(*cols))


def record_hunt(found: DataFrame, log: str, evidence: str, threshold: float = 0.85, known: DataFrame | None = None) -> None:
    """Appends a hunt's results to the progress log (one DONE row a series) and its candidates to the evidence.

    ``found`` is read twice: give it as a written table, so that it is not searched twice.
    """
    error = F.when(F.col("status").startswith("ERROR"), F.col("status")).otherwise(F.lit(""))
    rows = found.select(
        S.normalize_id(F.col("series_id").cast("string")).alias("tic_id"), F.lit("DONE").alias("last_stage"), "status", "best_period", F.current_timestamp().alias("updated_at"),
        S.sanitize_error(error).alias("error"), F.lit(None).cast("int").alias("sector"), F.unix_micros(F.current_timestamp()).alias("seq"),
    )
    io.append(rows, log)
    strong = found.where(F.col("prob_planet") >= threshold)
    packet = strong.select(
        S.normalize_id(F.col("series_id").cast("string")).alias("tic_id"), "best_period", "prob_planet", F.col("max_power").alias("bls_max_power"),
        F.lit(None).cast("double").alias("centroid_offset"), F.lit("").alias("plot"), F.current_timestamp().cast("string").alias("timestamp"), F.lit(None).cast("string").alias("discovery_status"),
    )
    io.evidence_write(packet if known is None else catalog.cross_match(packet, known), evidence)


def sweep_pending(spark, series: DataFrame, known: DataFrame, state: str, start: int, end: int, out: str, cfg: Config = Config(), model: PipelineModel | None = None) -> DataFrame:
    """Sweeps the sectors from start to end that the state in ``state`` lacks, writes their results to ``out`` by sector,
    and then their numbers to the state; a run that is lost before that does its sectors again."""
    pending = io.pending_sectors(spark, start, end, io.state_read(spark, state))
    swept = sweep(series, known, cfg, model, pending)
    swept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sector").parquet(out)
    io.state_write(pending, state)
    return spark.read.parquet(out)


def build_labelled_set(labels: DataFrame, series: DataFrame, most: int = 250, cfg: Config = Config()) -> DataFrame:
    """Feature rows with labels: the first ``most`` ids of each class by hash, cleaned, searched and folded. Series that
    are too short or have no features fall out. ``labels`` has tic_id, label; ``series`` series_id, t, flux.

    The chosen ids, their rows, the cleaned rows and the search's result are written one by one: ``series`` is read once, its
    rows meet the few ids without a shuffle (unless ``most`` is large), and no task holds several steps at a time.
    """
    folder = io.work_dir(series.sparkSession, "labelled-set")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return series.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")

    chosen = kept(catalog.cap_per_class(labels, "label", "tic_id", most).select(F.col("tic_id").alias("series_id"), "label"), "chosen")
    ids = chosen.select("series_id").distinct()
    own = kept(series.join(F.broadcast(ids) if chosen.count() <= IDS_BROADCAST else ids, "series_id", "left_semi").select("series_id", "t", "flux"), "own")
    n = own.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.least)
    enough = own.join(n.select("series_id"), "series_id", "left_semi").select("series_id", "t", "flux")
    cleaned = kept(clean.clean_series(enough, cfg.half, cfg.sigma, cfg.rounds, cfg.gaps), "cleaned")
    best = kept(search.two_pass(cleaned, cfg.low, cfg.high, coarse=cfg.coarse, refine=cfg.refine, form=cfg.form), "best")
    return fold.features(cleaned, best, rows=cleaned.count()).join(chosen, "series_id")


def train(rows: DataFrame, grid: list[dict], key: str = "series_id", patience: int | None = None) -> tuple[PipelineModel, DataFrame]:
    """The best model of the grid and its validation metrics; see ``ml.select_by_f1`` for ``patience``."""
    fit, val = ml.train_val_split(rows, key)
    model, _ = ml.select_by_f1(fit, val, grid, patience)
    scored = ml.score_batch(val, model).select(F.col(key).alias("id"), "label", F.col("prob_planet").alias("score"))
    return model, metrics.precision_recall_f1(scored).join(metrics.roc_auc(scored)).join(metrics.average_precision(scored))


def browse(evidence: DataFrame, profile: str, statuses: list[str], least: float, k: int) -> DataFrame:
    rows = catalog.filter_candidates(evidence, statuses, least).withColumn("profile", F.lit(profile))
    return catalog.rank_candidates(catalog.score_candidates(rows), "score", k=k)
