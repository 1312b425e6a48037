"""Staged hunts, stage tables of views, totals, keyed state, training and readers on small tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.functions import views as V
from undertow.operators import catalog, ml, search
from undertow.plans import pipelines
from undertow.sources import io
from undertow.streaming import live

CFG = pipelines.Config(low=1.0, high=5.0, coarse=60, refine=40, least=20, gaps=None)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in ((1, 120), (2, 120), (3, 10), (4, 120)):
        t = np.sort(rng.uniform(0, 30, n))
        rows += [(str(k), 1 + k % 2, float(x), float(100 + rng.normal(0, 0.5) - (30 if k < 4 else 0) * (x % 1.7 < 0.1))) for x in t]
    return spark.createDataFrame(rows, "series_id string, sector int, t double, flux double")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def views(spark, n=60):
    rng = np.random.default_rng(7)
    rows = [(str(i), [float(i % 2) + float(rng.normal(0, 0.3)), 1.0], [float(rng.normal())], None if i % 3 else 0.5, i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, global_view array<double>, local_view array<double>, centroid_offset double, label int")


def test_staged_hunt_equals_the_lazy_one_and_writes_its_timings(spark, series, tmp_path):
    own = series.select("series_id", "t", "flux")
    array = lambda x, n: F.array_repeat(F.lit(float(x)), n)
    learn = [spark.range(1).select(array(i, 2048).alias("global_view"), array(i, 256).alias("local_view"), F.lit(0.0).alias("centroid_offset"), F.lit(i % 2).alias("label")) for i in range(4)]
    model = ml.fit_classifier(learn[0].union(learn[1]).union(learn[2]).union(learn[3]), maxIter=3)
    done = pipelines.staged_hunt(own, str(tmp_path / "h"), CFG, model)
    want = {r.series_id: r for r in pipelines.hunt(own, CFG).collect()}
    got = {r.series_id: r for r in done.found.collect()}
    assert set(got) == set(want) and all((got[k].best_period, got[k].max_power, got[k].n) == (want[k].best_period, want[k].max_power, want[k].n) for k in got)
    assert all((got[k].status == want[k].status) if want[k].status != "CLEARED" else got[k].prob_planet is not None for k in got)
    assert done.cleaned.where("series_id = '3'").count() == 0 and done.features.count() == sum(r.status == "CLEARED" or r.prob_planet is not None for r in got.values()) and done.best.count() == 3
    told = {r.tic_id: r for r in done.timings.collect()}
    assert set(told) == {"1", "2", "3", "4"} and all(r.total_ms == pytest.approx(r.phase1_ms + r.phase2_ms + r.phase3_ms + r.predict_ms) for r in told.values())
    assert told["3"].phase2_ms == 0 and told["3"].phase1_ms < told["1"].phase1_ms and told["1"].phase3_ms > 0
    summary = catalog.timing_summary(done.timings).first()
    assert summary.series == 4 and summary.mean_total_ms > 0


def test_noise_gate(spark, series, tmp_path):
    from dataclasses import replace

    strict = replace(CFG, snr=7.1, sigma=50.0, coarse=600, refine=300, half=80)
    got = {r.series_id: r for r in pipelines.hunt(series.select("series_id", "t", "flux"), strict).collect()}
    assert (got["4"].status, got["3"].status, got["3"].snr) == ("NO_SIGNAL", S.TOO_SHORT, None) and got["1"].status == "CLEARED" and got["1"].snr > 7.1
    staged = pipelines.staged_hunt(series.select("series_id", "t", "flux"), str(tmp_path / "s"), strict).found
    assert {r.series_id: r.status for r in staged.collect()} == {k: r.status for k, r in got.items()}


def test_scan_returns_its_intermediates(series):
    done = pipelines.scan_all(series, "1", CFG)
    best = done.best.first()
    spectrum = done.spectrum.collect()
    assert len(spectrum) == 100 and max((r.power, r.period) for r in spectrum if r["pass"] == "refine")[1] == pytest.approx(best.best_period)
    assert done.curve.count() == 200 and len(done.features.first().global_view) == 2048 and done.found.first().best_period == best.best_period
    assert {r.series_id for r in done.cleaned.select("series_id").distinct().collect()} == {"1"}


def test_views_are_stored_by_series_sector_and_period(spark, series):
    own = series.select("series_id", "t", "flux").where("series_id <> '3'")
    best = search.two_pass(own, 1.0, 5.0, coarse=40, refine=0)
    empty = spark.createDataFrame([], "key string, series_id string, sector string, best_period double, global_view array<double>, local_view array<double>, centroid_offset double")
    first = pipelines.feature_stage(own, best, empty, "7").persist()
    assert first.count() == 3 and len({r.key for r in first.collect()}) == 3
    marked = first.where("series_id <> '4'").withColumn("global_view", F.array(F.lit(-1.0)))
    again = {r.series_id: len(r.global_view) for r in pipelines.feature_stage(own, best, marked, "7").collect()}
    assert again == {"1": 1, "2": 1, "4": 2048}
    moved = best.withColumn("best_period", F.when(F.col("series_id") == "1", 3.0).otherwise(F.col("best_period")))
    assert {r.series_id: len(r.global_view) for r in pipelines.feature_stage(own, moved, marked, "7").collect()} == {"1": 2048, "2": 1, "4": 2048}
    first.unpersist()


def test_stage_keys(spark):
    row = spark.range(1).select(S.stage1_key(F.lit("TIC 5"), F.lit("a/b")).alias("a"), S.stage2_key(F.lit("5"), F.lit("all"), F.lit(0.5), F.lit(20.0), F.lit(5000)).alias("b")).first()
    assert (row.a, row.b) == ("TIC_5_a_b_phase1", "5_all_0.5_20.0_5000_phase2")


def test_totals_by_sector_and_for_the_sweep(spark):
    rows = [(1, "a", "CLEARED", 2.0, "KNOWN"), (1, "b", "CANDIDATE (0.90)", 9.0, "NEW_CANDIDATE"), (1, "c", "CANDIDATE (0.95)", 8.0, "KNOWN"), (2, "d", "ERROR: x", None, "NEW_CANDIDATE")]
    swept = spark.createDataFrame(rows, "sector int, series_id string, status string, max_power double, discovery_status string")
    spent = spark.createDataFrame([(1, "A", 500.0), (1, "B", 1500.0), (2, "D", 250.0)], "sector int, tic_id string, total_ms double")
    got = {(r.sector, r.kind, r.level): (r.done, r.known, r.new, r.best, r.elapsed) for r in pipelines.sector_totals(swept, spent).collect()}
    assert got[(1, "CANDIDATE", 0)] == (2, 1, 1, 9.0, 1.5) and got[(1, None, 1)] == (3, 2, 1, 9.0, 2.0)
    assert got[(2, "ERROR", 0)] == (1, 0, 1, None, 0.25) and got[(None, None, 3)] == (4, 2, 2, 9.0, 2.25) and len(got) == 6
    assert "elapsed" not in pipelines.sector_totals(swept).columns


def test_a_staged_sweep_tells_what_each_sector_took(spark, series, tmp_path):
    swept, timings = pipelines.staged_sweep(series, spark.createDataFrame([("2",)], "id string"), str(tmp_path / "w"), CFG)
    assert {(r.sector, r.series_id, r.discovery_status) for r in swept.collect()} == {(1, "2", "KNOWN"), (1, "4", "NEW_CANDIDATE"), (2, "1", "NEW_CANDIDATE"), (2, "3", "NEW_CANDIDATE")}
    got = {(r.sector, r.level): r for r in pipelines.sector_totals(swept, timings).where("level > 0").collect()}
    whole = timings.agg(F.sum("total_ms")).first()[0] / 1000
    assert got[(None, 3)].done == 4 and got[(None, 3)].elapsed == pytest.approx(whole) and got[(1, 1)].elapsed + got[(2, 1)].elapsed == pytest.approx(whole)


def test_running_throughput(spark):
    hours = [0.1, 0.5, 1.2, 30.0]
    log = spark.createDataFrame([(str(i), "DONE", h) for i, h in enumerate(hours)] + [("x", "phase1", 3.0)], "tic_id string, last_stage string, h double")
    log = log.withColumn("updated_at", F.timestamp_micros((F.col("h") * 3.6e9 + 1704067200000000).cast("long")))
    got = [(r.finished, r.total, r.last_day, r.per_hour) for r in catalog.throughput_running(log).orderBy("hour").collect()]
    assert [g[:3] for g in got] == [(2, 2, 2), (1, 3, 3), (1, 4, 1)] and got[0][3] == pytest.approx(2 / 0.9, abs=1e-6) and got[2][3] == pytest.approx(4 / 30.9, abs=1e-6)


def test_keyed_state_gives_what_all_rows_at_once_give(spark, series, tmp_path):
    landing, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    full = series.withColumn("flux_err", F.lit(None).cast("double")).select("series_id", "sector", "t", "flux", "flux_err")
    full = full.unionByName(spark.createDataFrame([("1", 1, 0.5, float("nan"), None), ("5", 1, 1.0, None, None)], full.schema))
    sizes = []
    for part in ("t >= 12 or series_id = '2'", "t < 12 and series_id <> '2'", "false"):  # later times land first
        full.where(part).coalesce(1).write.mode("append").parquet(landing)
        query = live.stateful_search(spark, landing, out, check, 1.0, 5.0, 40)  # each a start anew from the checkpoint
        query.awaitTermination()
        sizes.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert sizes == [full.where("t >= 12 or series_id = '2'").count(), full.where("t < 12 and series_id <> '2'").count(), 0]
    got = {r.series_id: r for r in live.latest_found(spark, out).collect()}
    want = {r.series_id: r for r in search.single_pass(series.select("series_id", "t", "flux"), 1.0, 5.0, 40).collect()}
    assert set(got) == set(want) == {"1", "2", "3", "4"}
    for k, r in got.items():
        assert (r.best_period, r.best_bin, r.n) == (want[k].best_period, want[k].best_bin, series.where(F.col("series_id") == k).count())
        assert r.epoch == pytest.approx(want[k].epoch) and r.max_power == pytest.approx(want[k].max_power)
    assert spark.read.parquet(out).where("series_id = '2'").count() == 1


def test_boosted_trees_stop_early(spark):
    rows = views(spark)
    fit, val = ml.train_val_split(rows, "series_id")
    model, trees = ml.fit_boosted(fit, val, rounds=30, maxDepth=2)
    assert 1 <= trees < 30 and ml.score_batch(val, model).where("prob_planet is null").count() == 0


def test_patience_ends_the_search_and_the_first_of_equal_models_stays(spark, monkeypatch):
    rows, tried = views(spark), []
    fit = ml.fit_classifier
    monkeypatch.setattr(ml, "fit_classifier", lambda r, **p: (tried.append(p), fit(r, **p))[1])
    grid = [{"maxIter": 20}, {"maxIter": 20}, {"maxIter": 20}, {"maxIter": 0}]
    _, f1 = ml.select_by_f1(rows, rows, grid, patience=2)
    assert len(tried) == 3 and f1 > 0.8


def test_training_gives_a_model_and_its_metrics(spark):
    model, scores = pipelines.train(views(spark, 100), [{"maxIter": 20}, {"kind": "gbt", "maxIter": 3}], patience=1)
    row = scores.first()
    assert row.f1 > 0.8 and row.roc_auc > 0.8 and row.average_precision > 0.8 and row.tp + row.fp + row.fn + row.tn == 20
    told = ml.classify(ml.score_batch(views(spark, 10), model)).collect()
    assert len(told) == 10 and all(r.predicted == (r.prob_planet >= 0.5) and r.prob_fp == pytest.approx(1 - r.prob_planet) for r in told)


def test_manifest_stage_exists_and_audit_time(spark):
    stored = spark.createDataFrame([("1", [1.0], [2.0], float("nan")), ("2", [1.0], [2.0], 3.0)], "tic_id string, global_view array<double>, local_view array<double>, centroid_offset double")
    listed = spark.createDataFrame([("1", 1, "a"), ("2", 0, "b"), ("9", 1, "c")], "tic_id string, label int, path string")
    got = {r.tic_id: (r.centroid_offset, r.label) for r in io.read_feature_manifest(listed, stored).collect()}
    assert got == {"1": (0.0, 1), "2": (3.0, 0)} and io.read_feature_manifest(listed, stored.drop("centroid_offset")).where("centroid_offset = 0").count() == 2
    assert [r.tic_id for r in io.stage_exists(listed.select("tic_id"), stored, "tic_id").orderBy("tic_id").collect()] == ["1", "2"]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)", spark.range(1).select(S.audit_timestamp()).first()[0])


def test_two_channels_have_one_length(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 4.0])], "g array<double>, l array<double>")
    a, b = df.select(V.two_channel(F.col("g"), F.col("l"), 5)).first()[0]
    assert a == [-0.5, -0.25, 0.0, 0.25, 0.5] and b == [0.0] * 5
