"""Registered queries of vetting, sinusoids, quality and running rates, each with the SQL that gives the same rows.

A user of ``events`` has about 66 rows, so boxes are a quarter of a period wide here, for rows on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.operators import catalog, harmonics, ml, search, vetting
from undertow.plans import pipelines
from undertow.plans.queries import CAD, HIGH, LOW, PROG, _boxes, _cfg, _grid, _r, query
from undertow.sources import adapters as A
from undertow.sources import io

WIDE = 0.25
_BASE = f"WITH {CAD}, {_boxes(_grid(60))}, ph AS (SELECT c.series_id, t, flux, floor((t - best_bin/20.0*best_period)/best_period) k, (t - best_bin/20.0*best_period)/best_period - floor((t - best_bin/20.0*best_period)/best_period) phase, best_period, max_power FROM cadence c JOIN best USING (series_id))"
_SIDES = (
    f"g AS (SELECT series_id, CASE WHEN phase >= {WIDE} THEN 'out' WHEN CAST(k AS BIGINT) % 2 <> 0 THEN 'odd' ELSE 'even' END side, count(*) n, avg(flux) m, var_samp(flux) v, count(DISTINCT k) tr FROM ph GROUP BY 1, 2), "
    "oe AS (SELECT series_id, coalesce(max(n) FILTER (side='odd'), 0) n_odd, coalesce(max(n) FILTER (side='even'), 0) n_even, coalesce(max(tr) FILTER (side='odd'), 0) transits_odd, coalesce(max(tr) FILTER (side='even'), 0) transits_even, "
    "max(m) FILTER (side='out') - max(m) FILTER (side='odd') depth_odd, max(m) FILTER (side='out') - max(m) FILTER (side='even') depth_even, sqrt(max(v/n) FILTER (side='odd') + max(v/n) FILTER (side='even')) se FROM g GROUP BY 1), "
    "oez AS (SELECT *, CASE WHEN depth_odd IS NOT NULL AND depth_even IS NOT NULL THEN least(depth_odd, depth_even)/nullif(greatest(depth_odd, depth_even), 0) END ratio, abs(depth_odd - depth_even)/nullif(se, 0) z FROM oe)"
)
_SNR = (
    f"lv AS (SELECT series_id, median(flux) FILTER (phase >= {WIDE}) level FROM ph GROUP BY 1), "
    f"ds AS (SELECT series_id, count(*) FILTER (phase < {WIDE}) n_in, max(level) - avg(flux) FILTER (phase < {WIDE}) AS depth, median(abs(flux - level)) FILTER (phase >= {WIDE})*1.4826 noise, count(DISTINCT k) FILTER (phase < {WIDE}) transits FROM ph JOIN lv USING (series_id) GROUP BY 1)"
)
_SECOND = (
    f"m AS (SELECT *, phase - {WIDE / 2} - floor(phase - {WIDE / 2}) mid FROM ph), mk AS (SELECT *, least(mid, 1 - mid) < {WIDE} near FROM m), "
    f"bx AS (SELECT series_id, avg(flux) FILTER (phase < {WIDE}) mbox, avg(flux) FILTER (NOT near) mrest, count(*) FILTER (NOT near) n, sum(flux) FILTER (NOT near) s, stddev_samp(flux) FILTER (NOT near) sd FROM mk GROUP BY 1), "
    "cl AS (SELECT series_id, CAST(least(floor(mid*100), 99) AS INT) bin, count(*) n, sum(flux) s FROM mk WHERE NOT near GROUP BY 1, 2), "
    "wd AS (SELECT a.series_id, a.bin, sum(b.n) n_in, sum(b.s) s_in, max(a.bin + (b.bin - a.bin + 100) % 100) last FROM cl a JOIN cl b ON a.series_id = b.series_id AND (b.bin - a.bin + 100) % 100 < 5 GROUP BY 1, 2), "
    "sn AS (SELECT wd.series_id, bin, last, n_in, (s - s_in)/(n - n_in) - s_in/n_in AS depth, mrest - mbox AS prim, round(((s - s_in)/(n - n_in) - s_in/n_in)/nullif(sd*sqrt(1.0/n_in + 1.0/(n - n_in)), 0), 9) snr FROM wd JOIN bx USING (series_id) WHERE n_in >= 2 AND n - n_in >= 2), "
    "se AS (SELECT series_id, (bin + last + 1)/200.0 - floor((bin + last + 1)/200.0) AS phase, CAST(n_in AS BIGINT) n_in, depth, snr, depth/nullif(prim, 0) ratio, snr > 7.1 AS flagged FROM sn WHERE snr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY snr DESC, bin) = 1)"
)
_QUALITY = (
    "st AS (SELECT *, t - lag(t) OVER w dt, flux - lag(flux) OVER w df FROM cadence WINDOW w AS (PARTITION BY series_id ORDER BY t, flux)), "
    "qa AS (SELECT series_id, count(*) n, max(t) - min(t) span, median(dt) cadence, max(dt) gap, avg(flux) mean, sqrt(avg(df*df)/2) jump, regr_slope(flux, t) slope FROM st GROUP BY 1), "
    "qb AS (SELECT series_id, n, span, cadence, least(n/(span/cadence + 1), 1.0) completeness, gap/cadence largest_gap, jump/mean noise, abs(slope*span/mean) slope FROM qa), "
    "qs AS (SELECT *, completeness completeness_score, 1/greatest(largest_gap, 1.0) gap_score, greatest(1 - noise, 0.0) noise_score, greatest(1 - slope, 0.0) systematics_score, "
    "0.3::DOUBLE*completeness + 0.3::DOUBLE*greatest(1 - noise, 0.0) + 0.2::DOUBLE/greatest(largest_gap, 1.0) + 0.2::DOUBLE*greatest(1 - slope, 0.0) overall_score FROM qb)"
)


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = A.cadence(spark, sf).select("series_id", "t", "flux")
    return c, search.single_pass(c, LOW, HIGH, 60)


@query(f"{_BASE}, lv AS (SELECT series_id, avg(flux) FILTER (phase >= {WIDE}) level FROM ph GROUP BY 1) SELECT series_id, CAST(k AS BIGINT) transit, count(*) n, round(max(level) - avg(flux), 8) AS depth FROM ph JOIN lv USING (series_id) WHERE phase < {WIDE} GROUP BY 1, 2")
def transit_depths(spark: SparkSession, sf: str) -> DataFrame:
    return _r(vetting.transit_depths(*_found(spark, sf), WIDE), depth=8)


@query(f"{_BASE}, {_SIDES} SELECT series_id, n_odd, n_even, transits_odd, transits_even, round(depth_odd,8) depth_odd, round(depth_even,8) depth_even, round(ratio,5) ratio, round(z,5) z, coalesce(z > 3, false) flagged FROM oez")
def odd_even_depth(spark: SparkSession, sf: str) -> DataFrame:
    return _r(vetting.odd_even(*_found(spark, sf), WIDE), depth_odd=8, depth_even=8, ratio=5, z=5)


@query(f"{_BASE}, {_SECOND} SELECT series_id, round(phase,6) phase, n_in, round(depth,8) AS depth, round(snr,5) snr, round(ratio,5) ratio, flagged FROM se")
def secondary_eclipse(spark: SparkSession, sf: str) -> DataFrame:
    return _r(vetting.secondary_eclipse(*_found(spark, sf), WIDE), phase=6, depth=8, snr=5, ratio=5)


@query(f"{_BASE}, {_SNR} SELECT series_id, n_in, round(depth,8) AS depth, round(noise,8) noise, round(depth/nullif(noise,0)*sqrt(n_in),5) snr, transits, coalesce(depth/nullif(noise,0)*sqrt(n_in) > 7.1, false) detected FROM ds")
def transit_depth_snr(spark: SparkSession, sf: str) -> DataFrame:
    return _r(vetting.depth_snr(*_found(spark, sf), WIDE), depth=8, noise=8, snr=5)


@query(f"WITH {CAD}, {_QUALITY} SELECT series_id, n, {', '.join(f'round({c},6) {c}' for c in ('span', 'cadence', 'completeness', 'largest_gap', 'noise', 'slope', 'completeness_score', 'gap_score', 'noise_score', 'systematics_score', 'overall_score'))} FROM qs")
def series_quality(spark: SparkSession, sf: str) -> DataFrame:
    told = vetting.series_quality(A.cadence(spark, sf))
    return _r(told, **{c: 6 for c in told.columns if c not in ("series_id", "n")})


@query(
    f"{_BASE}, {_SIDES}, {_SNR}, {_SECOND.replace('se AS (', 'sec AS (')}, {_QUALITY}, va AS (SELECT series_id, stddev_pop(flux)/abs(avg(flux)) v FROM ph WHERE phase >= {WIDE} GROUP BY 1) "
    f"SELECT b.series_id, round(max_power,3) bls_power, round(best_period,6) \"period\", round(ds.depth,8) transit_depth, round(ds.depth/nullif(ds.noise,0)*sqrt(ds.n_in),5) snr, round(best_period*{WIDE},6) transit_duration, round(oez.ratio,5) odd_even_ratio, "
    "round(sec.ratio,5) secondary_eclipse, round(va.v,6) stellar_variability, round(overall_score,6) data_quality, CAST(qs.n AS DOUBLE) observation_count FROM best b LEFT JOIN ds ON ds.series_id = b.series_id LEFT JOIN oez ON oez.series_id = b.series_id "
    "LEFT JOIN sec ON sec.series_id = b.series_id LEFT JOIN va ON va.series_id = b.series_id LEFT JOIN qs ON qs.series_id = b.series_id"
)
def tabular_features(spark: SparkSession, sf: str) -> DataFrame:
    out = vetting.tabular_features(*_found(spark, sf), WIDE)
    return _r(out, bls_power=3, period=6, transit_depth=8, snr=5, transit_duration=6, odd_even_ratio=5, secondary_eclipse=5, stellar_variability=6, data_quality=6)


def _lomb(n: int) -> str:
    return (
        f"WITH {CAD}, grid AS ({_grid(n)}), own AS (SELECT series_id, min(t) t0, avg(flux) mean FROM cadence GROUP BY 1), "
        "r AS (SELECT c.series_id, pid, period, cos((t - t0)*(2*pi())/period) c, sin((t - t0)*(2*pi())/period) s, flux - mean y FROM cadence c JOIN own USING (series_id), grid), "
        "a AS (SELECT series_id, pid, period, count(*) n, avg(c) mc, avg(s) ms, avg(c*c) - avg(c)*avg(c) cc, avg(s*s) - avg(s)*avg(s) ss, avg(c*s) - avg(c)*avg(s) cs, avg(y*c) - avg(y)*avg(c) yc, avg(y*s) - avg(y)*avg(s) ys, avg(y*y) - avg(y)*avg(y) yy FROM r GROUP BY ALL), "
        "b AS (SELECT *, (yc*ss - ys*cs)/(cc*ss - cs*cs) a, (ys*cc - yc*cs)/(cc*ss - cs*cs) b FROM a), p AS (SELECT *, (a*yc + b*ys)/yy AS power FROM b) "
        "SELECT series_id, round(period,6) best_period, round(power,6) AS power, round(sqrt(a*a + b*b),5) amplitude, n, "
        f"round(1 - pow(1 - pow(greatest(1 - power, 0.0), (n - 3)/2.0), {n}), 6) false_alarm FROM p QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(power, 9) DESC, period) = 1"
    )


def _sinusoids(spark: SparkSession, sf: str, n: int, form: str) -> DataFrame:
    best = harmonics.lomb_scargle(A.cadence(spark, sf), LOW, HIGH, n, form=form)
    return _r(best.drop("phase"), best_period=6, power=6, amplitude=5, false_alarm=6)


@query(_lomb(harmonics.GRID))
def lomb_scargle(spark: SparkSession, sf: str) -> DataFrame:
    return _sinusoids(spark, sf, harmonics.GRID, "grouped")


@query(_lomb(100))
def lomb_scargle_sql(spark: SparkSession, sf: str) -> DataFrame:
    return _sinusoids(spark, sf, 100, "sql")


@query(
    f"WITH {PROG}, h AS (SELECT date_trunc('hour', updated_at) AS hour, count(*) finished FROM progress WHERE last_stage = 'DONE' GROUP BY 1), s AS (SELECT min(updated_at) t0 FROM progress WHERE last_stage = 'DONE'), "
    "w AS (SELECT hour, finished, sum(finished) OVER (ORDER BY hour) total, sum(finished) OVER (ORDER BY hour RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW) last_day FROM h) "
    "SELECT CAST(epoch(hour) AS BIGINT) AS hour, finished, CAST(total AS BIGINT) total, CAST(last_day AS BIGINT) last_day, round(total/((epoch_us(hour) + 3600000000 - epoch_us(t0))/3.6e9), 6) per_hour FROM w, s"
)
def throughput_running(spark: SparkSession, sf: str) -> DataFrame:
    told = catalog.throughput_running(A.progress(spark, sf))
    return told.withColumn("hour", F.unix_seconds("hour"))


# --- models: no SQL; tests hold them against planted labels
@query()
def boosted_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on embeddings as views, for labels 0 to 4 against the rest, that end where validation gains no more."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = A.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("series_id"), v.alias("global_view"), F.slice(v, 1, 16).alias("local_view"), F.lit(None).cast("double").alias("centroid_offset"), (F.col("label") < 5).cast("int").alias("label")
    )
    model, trees = ml.fit_boosted(*ml.train_val_split(rows, "series_id"), rounds=30, maxDepth=3)
    return ml.classify(ml.score_batch(rows, model)).select("series_id", "label", "prob_planet", "predicted", F.lit(trees).alias("trees"))


def _parity(series: DataFrame) -> DataFrame:
    """Odd users against even ones: a stand-in for a catalogue's labels."""
    return series.select("series_id", (F.col("series_id").cast("long") % 2).cast("int").alias("label")).distinct()


@query()
def forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A random forest on the ten scalars of every series."""
    series, best = _found(spark, sf)
    path = io.work_dir(spark, "tabular")
    vetting.tabular_features(series, best, WIDE).join(_parity(series), "series_id").write.parquet(path)
    rows = spark.read.parquet(path)
    return ml.score_forest(rows, ml.fit_forest(rows, vetting.TABULAR, numTrees=20)).select("series_id", "label", "prob_planet")


@query()
def train_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A labelled set of the given series, cleaned, searched and folded; the best of two models; its validation metrics."""
    series = A.cadence(spark, sf).select("series_id", "t", "flux")
    path = io.work_dir(spark, "labelled")
    labels = _parity(series).withColumnRenamed("series_id", "tic_id")
    pipelines.build_labelled_set(labels, series, cfg=_cfg()).write.parquet(path)
    return pipelines.train(spark.read.parquet(path), [{"maxIter": 10}, {"maxIter": 10, "regParam": 0.1}], patience=1)[1]
