"""Stage tables, sinks, models, splits, running sums and incremental runs on small tables."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from undertow.operators import catalog, metrics, ml, running, search
from undertow.plans import pipelines
from undertow.sources import io
from undertow.streaming import live

CFG = pipelines.Config(low=1.0, high=5.0, coarse=40, refine=30, least=20)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in ((1, 60), (2, 60), (3, 10), (4, 60)):
        t = np.sort(rng.uniform(0, 30, n))
        rows += [(str(k), 1 + k % 2, float(x), float(100 + rng.normal(0, 0.5) - 30 * (x % 1.7 < 0.1))) for x in t]
    return spark.createDataFrame(rows, "series_id string, sector int, t double, flux double")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("ties", [1, 7, 10_000])
def test_running_sums_equal_one_window(spark, ties):
    rng = np.random.default_rng(2)
    values = [(i, float(rng.integers(0, 10_000) // ties), int(rng.integers(0, 5))) for i in range(3000)]
    rows = spark.createDataFrame([*values, (5000, None, 1), (5001, None, 2), (5002, float("nan"), 1)], "id int, x double, v int")
    w = Window.orderBy(F.desc_nulls_last("x"), "id").rowsBetween(Window.unboundedPreceding, 0)
    got = running.running(rows, "x", {"s": F.col("v"), "k": F.lit(1)}, [F.col("id")]).select("id", "s", "k")
    assert rows_of(got) == rows_of(rows.select("id", F.sum("v").over(w).alias("s"), F.row_number().over(w).alias("k")))
    assert running.running(rows.where("false"), "x", {"s": F.col("v")}).count() == 0


def test_curves_of_no_rows_and_of_one_class(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "id int, label int, score double")
    assert metrics.roc_auc(rows).first()[0] is None and metrics.average_precision(rows).first()[0] == 1.0
    assert metrics.pr_auc_trapezoid(rows).first()[0] == pytest.approx(0.5) and metrics.pr_auc_trapezoid(rows.where("false")).first()[0] is None


@pytest.mark.parametrize("n", [1, 4, 10, 57])
def test_split_takes_a_fifth_at_least_one(spark, n):
    rows = spark.range(n).select(F.col("id").cast("string").alias("series_id"), F.lit(1).alias("label"))
    fit, val = ml.train_val_split(rows, "series_id")
    assert (fit.count(), val.count()) == (n - max(1, n // 5), max(1, n // 5)) and fit.columns == rows.columns
    assert fit.join(val, "series_id").count() == 0


def test_augmented_copies_have_gaussian_noise_on_both_views(spark):
    rows = spark.createDataFrame([(f"k{i}", [1.0] * 200, [1.0] * 50) for i in range(60)], "series_id string, global_view array<double>, local_view array<double>")
    out = ml.augment(rows, "series_id").collect()
    assert len(out) == 120 and sum(r.local_view == [1.0] * 50 for r in out) >= 60
    noise = np.concatenate([np.array(r.local_view) - 1 for r in out if r.local_view != [1.0] * 50])
    assert 0.0018 < noise.std() < 0.0022 and abs(noise.mean()) < 2e-4 and (abs(noise) > 0.004).mean() < 0.07


def test_models_are_saved_and_loaded_and_a_user_model_scores(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), [float(i % 2), 1.0], [0.5], None, i % 2) for i in range(20)], "series_id string, global_view array<double>, local_view array<double>, centroid_offset double, label int")
    model = ml.fit_classifier(rows, maxIter=10)
    told = ml.score_batch(rows, model).select("series_id", "prob_planet")
    scores = metrics.precision_recall_f1(ml.score_batch(rows, model).select("label", F.col("prob_planet").alias("score")))
    ml.save_model(model, scores, str(tmp_path / "m"))
    assert rows_of(ml.score_batch(rows, ml.load_model(str(tmp_path / "m"))).select("series_id", "prob_planet")) == rows_of(told)
    assert io.metrics_read(spark, str(tmp_path / "m/metrics")).first()["f1"] == 1.0
    io.metrics_write(scores, str(tmp_path / "s"))
    assert io.metrics_read(spark, str(tmp_path / "s")).first()["tp"] == 10

    def make():
        return lambda batch: np.asarray(batch)[:, 0] * 0.5

    assert {r.prob_planet for r in ml.score_with(rows, make).collect()} == {0.0, 0.5}


def test_hunt_is_recorded_and_resumed(spark, series, tmp_path):
    log, evidence = str(tmp_path / "log"), str(tmp_path / "evidence")
    found = pipelines.hunt(series.select("series_id", "t", "flux"), CFG).withColumn("prob_planet", F.when(F.col("series_id") == "1", 0.9)).persist()
    pipelines.record_hunt(found, log, evidence, known=spark.createDataFrame([("1",)], "id string"))
    told = {r.tic_id: r for r in io.progress_read(spark, log).collect()}
    assert set(told) == {"1", "2", "3", "4"} and told["3"].error.startswith("ERROR") and told["1"].last_stage == "DONE"
    assert [(r.tic_id, r.discovery_status) for r in io.evidence_read(spark, evidence).collect()] == [("1", "KNOWN")]
    assert pipelines.hunt(series.select("series_id", "t", "flux"), CFG, log=io.progress_read(spark, log)).count() == 0


def test_sweep_does_each_sector_once(spark, series, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    known = spark.createDataFrame([("2",)], "id string")
    first = pipelines.sweep_pending(spark, series, known, state, 1, 2, out, CFG)
    assert {(r.sector, r.series_id) for r in first.collect()} == {(1, "2"), (1, "4"), (2, "1"), (2, "3")}
    assert rows_of(io.state_read(spark, state)) == [(1,), (2,)]
    again = pipelines.sweep_pending(spark, series, known, state, 1, 3, out, CFG)
    assert again.count() == 4 and catalog.sweep_progress(io.state_read(spark, state), 1, 4).first()["share"] == 0.75


def test_search_stage_computes_only_what_is_not_stored(spark, series):
    had = pipelines.search_stage(series, spark.createDataFrame([], "series_id string, sector int, period_min double, period_max double, nperiods int, best_period double, epoch double, max_power double"), CFG)
    half = had.where("series_id = '1'").withColumn("best_period", F.lit(-1.0))
    again = {r.series_id: r.best_period for r in pipelines.search_stage(series, half, CFG).collect()}
    assert again["1"] == -1.0 and again["2"] == {r.series_id: r.best_period for r in had.collect()}["2"]


def test_labelled_set_leaves_out_short_series(spark, series):
    labels = spark.createDataFrame([("1", 1), ("2", 0), ("3", 0), ("9", 1)], "tic_id string, label int")
    rows = pipelines.build_labelled_set(labels, series, cfg=CFG).collect()
    assert {(r.series_id, r.label, len(r.global_view)) for r in rows} == {("1", 1, 2048), ("2", 0, 2048)}


def test_incremental_hunt_searches_a_series_on_all_its_rows(spark, series, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    full = series.withColumn("flux_err", F.lit(None).cast("double")).select("series_id", "sector", "t", "flux", "flux_err")
    for part in ("t < 15 or series_id = '2'", "t >= 15 and series_id <> '2'"):
        full.where(part).write.mode("append").parquet(landing)
        live.incremental_hunt(spark, landing, out, str(tmp_path / "state"), CFG).awaitTermination()
    got = live.latest_found(spark, out).select("series_id", "n", "best_period")
    assert rows_of(got) == rows_of(pipelines.hunt(full, CFG).select("series_id", "n", "best_period"))
    assert spark.read.parquet(out).where("series_id = '2'").count() == 1


def test_streams_of_status_and_throughput(spark, tmp_path):
    log = str(tmp_path / "log")
    found = spark.createDataFrame([("1", 5, "CLEARED", 2.0, 1.0, None)], "series_id string, n long, status string, best_period double, max_power double, prob_planet double")
    pipelines.record_hunt(found, log, str(tmp_path / "e"))
    for df, mode in ((live.status_stream(spark, log), "complete"), (live.throughput_stream(spark, log), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(f"q{mode}{len(df.columns)}{df.columns[0]}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"q{mode}{len(df.columns)}{df.columns[0]}").count() == 1


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("global_0,global_1,local_0,label\n1.5,2,3,1\n")
    r = io.read_feature_csv(spark, str(tmp_path / "f.csv")).first()
    assert (r.global_view, r.local_view, r.centroid_offset, r.label) == ([1.5, 2.0], [3.0], 0.0, 1)
    (tmp_path / "r.json").write_text('{"target_name": "x",\n "snr": NaN}')
    assert io.read_results(spark, str(tmp_path / "r.json")).first()["confidence_score"] is None
    ranked = spark.createDataFrame([("1", 2.0, 0.9, 0.5, "KNOWN")], "tic_id string, best_period double, prob_planet double, score double, discovery_status string")
    assert '"target":"1"' in io.discovery_packet(ranked).first()[0]
    t = spark.createDataFrame([("1", 1.0, 2.0, 3.0, 4.0, 10.0, "CLEARED")], "tic_id string, phase1_ms double, phase2_ms double, phase3_ms double, predict_ms double, total_ms double, status string")
    io.timings_write(t, str(tmp_path / "t"))
    assert catalog.timing_summary(spark.read.parquet(str(tmp_path / "t"))).first()["mean_total_ms"] == 10.0
    c = spark.createDataFrame([("1", 1, 1.0, 2.0)], "series_id string, sector int, t double, flux double")
    c.write.parquet(str(tmp_path / "c"))
    assert io.read_cadence(spark, str(tmp_path / "c"), "1", 1).first()["flux_err"] is None
    with pytest.raises(ValueError):
        io.read_cadence(spark, str(tmp_path / "c"), "2")
    rows = spark.createDataFrame([("TESS", 3, "timeseries", "TIC 5"), ("TESS", 4, "timeseries", "6")], "collection string, sequence_number int, dataproduct_type string, target_name string")
    assert [r.tic_id for r in io.sector_targets(rows, 3).collect()] == ["5"]


def test_a_long_series_is_thinned_before_the_search(spark, series):
    few = search.search_grouped(series.select("series_id", "t", "flux"), 1.0, 5.0, coarse=30, refine=0, limit=25).collect()
    want = search.search_grouped(search.downsample(series.select("series_id", "t", "flux"), 25), 1.0, 5.0, coarse=30, refine=0, limit=None).collect()
    assert sorted(few) == sorted(want) and len(few) == 4
