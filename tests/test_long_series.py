"""Searches visit all rows of long series, which are dealt to several tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.operators import search

N = 90_000


@pytest.fixture(scope="module")
def long(spark):
    """A series of N rows with a dip in every third of them only, and one of 200."""
    rows = spark.range(N + 200).select(
        F.when(F.col("id") < N, "long").otherwise("short").alias("series_id"), (F.pmod(F.xxhash64("id"), F.lit(2_592_001)) / 86400).alias("t"), F.col("id")
    )
    dip = F.when((F.col("id") % 3 == 0) & (F.pmod("t", F.lit(2.5)) < 0.125), 3.0).otherwise(0.0)
    series = rows.select("series_id", "t", (100 + F.pmod(F.xxhash64("id", "t"), F.lit(1000)) / 500 - dip).alias("flux")).cache()
    series.count()
    yield series
    series.unpersist()


def arrays(series, name="long"):
    rows = series.where(F.col("series_id") == name).orderBy("t", "flux").toPandas()
    return rows.t.to_numpy(), rows.flux.to_numpy()


def by_series(df):
    return {r.series_id: r for r in df.collect()}


def same(got, want):
    assert (got.best_period, got.best_bin) == (want[0], want[3])
    assert got.epoch == pytest.approx(want[1]) and got.max_power == pytest.approx(want[2])


@pytest.mark.parametrize("epoch_by", ["power", "depth"])
def test_a_single_pass_visits_all_rows_of_a_long_series(spark, long, epoch_by):
    got = by_series(search.single_pass(long, 1.0, 10.0, 12, epoch_by=epoch_by))
    assert len(got) == 2
    for name in got:
        same(got[name], search.Kernel(epoch_by=epoch_by).best(*arrays(long, name), search.log_grid(1.0, 10.0, 12)))


@pytest.mark.parametrize("options", [{}, {"width": 3}, {"guard": False, "dips_only": True}, {"last_window": False}, {"bins": 8}])
def test_a_search_by_slices_equals_one_of_whole_series(spark, monkeypatch, options):
    """Slices are of one row and more; a series of equal rows has one slice, one of constant flux no power."""
    rng = np.random.default_rng(11)
    rows = [(k, float(t), float(y)) for k, n in (("a", 120), ("b", 130), ("c", 31), ("d", 7)) for t, y in zip(np.round(rng.uniform(0, 30, n), 2), np.round(rng.exponential(50, n), 1))]
    rows += [("equal", 1.5, 2.0)] * 90 + [("flat", float(i), 3.0) for i in range(90)] + [("a", 1.0, None), ("a", 2.0, float("nan")), ("a", 3.0, float("inf"))]
    series = spark.createDataFrame(rows, "series_id string, t double, flux double").repartition(3)
    bins = options.get("bins", 20)
    want = by_series(search.search_grouped(series, 1.0, 9.0, coarse=40, refine=15, **options))
    monkeypatch.setattr(search, "SLICE", 30)
    told = search.search_grouped(series, 1.0, 9.0, coarse=40, refine=15, **options)
    assert "slice" in told._jdf.queryExecution().optimizedPlan().toString() and 0 <= min(r.best_bin for r in told.collect()) < bins
    got = by_series(told)
    assert got.keys() == want.keys() and len(got) == 6
    for k in want:
        same(got[k], want[k][1:])


def test_two_passes_visit_all_rows_of_a_long_series(spark, long):
    got = by_series(search.two_pass(long, 1.0, 10.0, coarse=20, refine=10))
    assert len(got) == 2
    for name in got:
        t, flux = arrays(long, name)
        first = search.Kernel().best(t, flux, search.log_grid(1.0, 10.0, 20))[0]
        same(got[name], search.Kernel().best(t, flux, search.near_grid(first, 1.0, 10.0, 10)))


def test_spectra_of_a_long_series_are_of_all_rows(spark, long):
    told = search.merged_spectrum(long, 1.0, 10.0, 12, 5)
    got = {(r["pass"], r.pid): (r.period, r.power) for r in told.where("series_id = 'long'").collect()}
    t, flux = arrays(long)
    grid = search.log_grid(1.0, 10.0, 12)
    near = search.near_grid(search.Kernel().best(t, flux, grid)[0], 1.0, 10.0, 5)
    assert len(got) == 17 and told.where("series_id = 'short'").count() == 17
    for name, periods in (("coarse", grid), ("refine", near)):
        for i, power in enumerate(search.Kernel().spectrum(t, flux, periods)):
            assert got[(name, i)] == (periods[i], pytest.approx(power))


def hunted(long, snr=None):
    """The hunt's result for the long series, by NumPy over the cleaned rows."""
    from undertow.plans import pipelines

    cfg = pipelines.Config(low=1.0, high=10.0, coarse=12, refine=5, rounds=1, snr=snr)
    t, flux = arrays(pipelines.phase1(long, cfg))
    assert len(t) > 80_000
    first = search.Kernel().best(t, flux, search.log_grid(1.0, 10.0, 12))[0]
    return cfg, search.Kernel().best(t, flux, search.near_grid(first, 1.0, 10.0, 5))


def test_a_hunt_visits_all_rows_of_a_long_series(spark, long):
    from undertow.plans import pipelines

    cfg, want = hunted(long)
    got = by_series(pipelines.hunt(long, cfg))
    assert got.keys() == {"long", "short"} and got["long"].n == N and got["long"].best_period == want[0]
    assert got["long"].epoch == pytest.approx(want[1]) and got["long"].max_power == pytest.approx(want[2])


def test_a_staged_hunt_with_noise_visits_all_rows_of_a_long_series(spark, long, tmp_path):
    from undertow.plans import pipelines

    cfg, want = hunted(long, snr=5.0)
    got = by_series(pipelines.staged_hunt(long, str(tmp_path / "hunt"), cfg).found)["long"]
    assert (got.n, got.best_period) == (N, want[0]) and got.max_power == pytest.approx(want[2]) and got.snr is not None


def test_the_timings_of_a_hunt_hold_long_series(spark, long, tmp_path):
    from undertow.plans import pipelines

    cfg, want = hunted(long)
    done = pipelines.staged_hunt(long, str(tmp_path / "hunt"), cfg)
    assert by_series(done.best)["long"].best_period == want[0]
    told = {r.tic_id: r for r in done.timings.collect()}
    assert len(told) == 2
    assert all(r.phase2_ms > 0 and r.total_ms == pytest.approx(r.phase1_ms + r.phase2_ms + r.phase3_ms + r.predict_ms) for r in told.values())


def test_sinusoids_are_fitted_to_all_rows_of_a_long_series(spark, long, monkeypatch):
    from undertow.operators import harmonics

    got, grid = by_series(harmonics.lomb_scargle(long, 1.0, 10.0, 30)), search.log_grid(1.0, 10.0, 30)
    assert (got["long"].n, got["short"].n) == (N, 200)
    for name in got:
        power, a, b = harmonics._numpy(*arrays(long, name), grid)
        k = int(np.round(power, 9).argmax())
        assert got[name].best_period == grid[k] and got[name].power == pytest.approx(power[k]) and got[name].amplitude == pytest.approx(np.hypot(a[k], b[k]))
        assert got[name].phase == pytest.approx(np.mod(np.arctan2(b[k], a[k]) / (2 * np.pi), 1.0))
    monkeypatch.setattr(search, "SLICE", 30)
    few = by_series(harmonics.lomb_scargle(long.where("series_id = 'short'"), 1.0, 10.0, 30))["short"]
    assert few.asDict() == {k: v if k in ("series_id", "n") else pytest.approx(v) for k, v in got["short"].asDict().items()}
