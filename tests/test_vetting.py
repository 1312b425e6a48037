"""Vetting, sinusoids, quality and tabular features on planted signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.operators import clean, harmonics, ml, search, vetting

SCHEMA = "series_id string, t double, flux double"
BEST = "series_id string, best_period double, epoch double, max_power double"


def table(spark, **series):
    return spark.createDataFrame([(k, float(t), float(y)) for k, (ts, ys) in series.items() for t, y in zip(ts, ys)], SCHEMA)


def noisy(n=1500, seed=3, span=30, sigma=0.002):
    rng = np.random.default_rng(seed)
    return np.sort(rng.uniform(0, span, n)), 1 + rng.normal(0, sigma, n)


@pytest.fixture(scope="module")
def planted(spark):
    """``pair`` dips by 0.05 and 0.02 in turn, ``planet`` by 0.05 always, ``second`` also by 0.02 at phase 0.37 from the transit."""
    t, y = noisy()
    turn, phase = np.floor(t / 2.0), np.mod(t, 2.0) / 2.0
    box = phase < 0.05
    out = {"pair": y - box * np.where(turn % 2 == 0, 0.05, 0.02), "planet": y - box * 0.05}
    far = np.mod(phase - 0.025 - 0.37 + 0.5, 1.0) - 0.5
    out["second"] = out["planet"] - 0.02 * (np.abs(far) < 0.025)
    best = spark.createDataFrame([(k, 2.0, 0.0, 1.0) for k in out], BEST)
    return table(spark, **{k: (t, v) for k, v in out.items()}), best


def by_series(df):
    return {r.series_id: r for r in df.collect()}


def test_odd_even_flags_alternating_depths_only(planted):
    got = by_series(vetting.odd_even(*planted))
    pair, planet = got["pair"], got["planet"]
    assert pair.flagged and pair.z > 20 and pair.depth_even == pytest.approx(0.05, abs=0.001) and pair.depth_odd == pytest.approx(0.02, abs=0.001)
    assert not planet.flagged and planet.ratio == pytest.approx(1, abs=0.05) and (planet.transits_odd, planet.transits_even) == (7, 8)


def test_odd_even_at_twice_the_period_clears(spark, planted):
    series, _ = planted
    best = spark.createDataFrame([("pair", 4.0, 0.0, 1.0)], BEST)
    assert not by_series(vetting.odd_even(series, best, width=0.025))["pair"].flagged


def test_odd_even_before_the_epoch_with_one_side_and_without_spread(spark):
    rows = [("early", -0.5, 1.0), ("early", -3.99, 0.9), ("early", -1.99, 0.8), ("early", 0.01, 0.9), ("flat", 0.0, 1.0), ("flat", 0.6, 1.0), ("flat", 2.0, 1.0), ("flat", 2.5, None)]
    series = spark.createDataFrame(rows, SCHEMA)
    best = spark.createDataFrame([("early", 2.0, 0.0, 1.0), ("flat", 2.0, 0.0, 1.0), ("none", 2.0, 0.0, 1.0)], BEST)
    got = by_series(vetting.odd_even(series, best))
    assert (got["early"].n_even, got["early"].n_odd, got["early"].z) == (2, 1, None) and got["early"].depth_odd == pytest.approx(0.2)
    assert got["flat"].z is None and not got["flat"].flagged and "none" not in got
    assert vetting.odd_even(series.where("false"), best).count() == 0


def test_each_transit_has_a_number_and_a_depth(planted):
    rows = {r.transit: r.depth for r in vetting.transit_depths(*planted).where("series_id = 'pair'").collect()}
    assert sorted(rows) == list(range(15)) and all(abs(d - (0.02 if k % 2 else 0.05)) < 0.003 for k, d in rows.items())


def test_second_dip_is_found_where_it_is(planted):
    got = by_series(vetting.secondary_eclipse(*planted))
    assert got["second"].flagged and got["second"].phase == pytest.approx(0.37, abs=0.011) and got["second"].ratio == pytest.approx(0.4, abs=0.06)
    assert not got["planet"].flagged and not got["pair"].flagged


def test_second_dip_across_the_seam_equals_direct_windows(spark):
    rng = np.random.default_rng(8)
    t = np.sort(rng.uniform(0, 40, 300))
    y = rng.normal(10, 1, 300)
    best = spark.createDataFrame([("a", 3.0, 0.0, 1.0)], BEST)
    got = vetting.secondary_eclipse(table(spark, a=(t, y)), best, mask=0.0, bins=20, span=4).first()
    middle = np.mod(np.mod(t, 3.0) / 3.0 - 0.025, 1.0)
    cell, top = np.minimum(np.floor(middle * 20), 19), (-9.0, 0)
    for b in range(20):
        inside = np.mod(cell - b, 20) < 4
        depth = y[~inside].mean() - y[inside].mean()
        top = max(top, (depth / (y.std(ddof=1) * np.sqrt(1 / inside.sum() + 1 / (~inside).sum())), -b))
    assert got.snr == pytest.approx(top[0], abs=1e-8) and got.phase == pytest.approx(np.mod((-top[1] + 2) / 20, 1.0))


def test_depth_and_noise(spark, planted):
    series, best = planted
    got = by_series(vetting.depth_snr(series, best))["planet"]
    assert got.depth == pytest.approx(0.05, abs=0.001) and got.noise == pytest.approx(0.002, rel=0.1) and got.detected
    assert got.snr == pytest.approx(got.depth / got.noise * got.n_in**0.5) and got.transits == 15
    t, y = noisy(seed=9)
    assert not vetting.depth_snr(table(spark, planet=(t, y)), best).first().detected
    one = vetting.depth_snr(spark.createDataFrame([("planet", 0.0, 1.0)], SCHEMA), best).first()
    assert one.snr is None and not one.detected


def test_quality(spark):
    t = np.arange(100) * 0.5
    whole = table(spark, whole=(t, np.full(100, 2.0)), gappy=(np.delete(t, range(40, 60)), np.full(80, 2.0)), single=([1.0], [5.0]))
    got = by_series(vetting.series_quality(whole))
    assert got["whole"].overall_score == pytest.approx(1.0) and got["whole"].completeness == 1.0 and got["whole"].largest_gap == 1.0
    assert got["gappy"].completeness == pytest.approx(0.8) and got["gappy"].largest_gap == pytest.approx(21)
    assert got["single"].overall_score == pytest.approx(1.0)
    stored = spark.createDataFrame([(1.0, 0.2, 0.3, 0.0), (1.0, 1.0, 1.0, 1.0)], "c double, n double, g double, s double")
    told = [r[0] for r in stored.select(vetting.overall_quality(*(F.col(x) for x in "cngs"))).collect()]
    assert told == [pytest.approx(0.42), pytest.approx(1.0)]


def test_sinusoid_forms_agree_and_find_what_is_planted(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 40, 250))
    y = 5 + 0.4 * np.cos(2 * np.pi * (t - t.min()) / 3.3 - 1.0) + rng.normal(0, 0.1, 250)
    series = table(spark, a=(t, y), noise=(t, rng.normal(0, 1, 250)), flat=(t, np.ones(250)), few=(t[:3], y[:3]))
    a, b = (by_series(harmonics.lomb_scargle(series, 1.0, 10.0, 400, form=f)) for f in ("grouped", "sql"))
    for k in ("a", "noise"):
        for c in ("best_period", "power", "amplitude", "phase", "false_alarm"):
            assert a[k][c] == pytest.approx(b[k][c], abs=1e-6)
    assert a["a"].best_period == pytest.approx(3.3, rel=0.01) and a["a"].amplitude == pytest.approx(0.4, abs=0.03) and a["a"].false_alarm < 1e-6
    assert a["noise"].false_alarm > 0.01 and (a["flat"].power, a["few"].power, a["few"].false_alarm) == (0.0, 0.0, 1.0)
    left = harmonics.residual_of(series, harmonics.lomb_scargle(series, 1.0, 10.0, 3000)).where("series_id = 'a'")
    assert left.agg(F.stddev("flux")).first()[0] == pytest.approx(0.1, rel=0.15)


def test_sinusoid_power_equals_least_squares_with_a_free_mean(spark):
    rng = np.random.default_rng(5)
    t, y = np.sort(rng.uniform(0, 9, 60)), rng.normal(3, 1, 60)
    got = harmonics.harmonic_spectrum(table(spark, a=(t, y)), search.period_grid(spark, 0.7, 6.0, 9)).collect()
    assert len(got) == 9
    for r in got:
        w = 2 * np.pi * t / r.period
        x = np.column_stack((np.cos(w), np.sin(w), np.ones(60)))
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert r.power == pytest.approx(1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_trend_keeps_to_segments(spark):
    t = np.concatenate((np.arange(60), 500 + np.arange(60), 900 + np.arange(5))).astype(float)
    y = np.concatenate((5 + 0.01 * np.arange(60) ** 2, 80 - 0.3 * np.arange(60), [7, 7, 9, 7, 7])).astype(float)
    out = clean.clean_series(table(spark, a=(t, y)), half=10, sigma=50.0, rounds=1).orderBy("t").collect()
    flux = np.array([r.flux for r in out])
    assert len(out) == 125 and np.abs(flux[:120] - 1).max() < 1e-9 and flux[122] == pytest.approx(9 / 7) and flux[120] == 1.0
    whole = clean.clean_series(table(spark, a=(t, y)), half=10, sigma=50.0, rounds=1, gaps=None).orderBy("t").collect()
    assert max(abs(r.flux - 1) for r in whole[50:70]) > 0.1


def test_options_of_the_grouped_search_equal_the_sql_form(spark):
    rng = np.random.default_rng(6)
    t = np.sort(rng.uniform(0, 30, 150))
    series = table(spark, a=(t, 100 + rng.normal(0, 1, 150) - 9 * (t % 2.7 < 0.3)), b=(t[:30], rng.normal(100, 1, 30)))
    for options in ({"width": 3}, {"guard": False, "dips_only": True}, {"last_window": False}, {"epoch_by": "depth"}):
        a, b = (by_series(search.single_pass(series, 1.0, 8.0, 60, form=f, **options)) for f in ("grouped", "sql"))
        for k in a:
            assert [a[k][c] for c in ("best_period", "best_bin")] == [b[k][c] for c in ("best_period", "best_bin")], options
            assert a[k].epoch == pytest.approx(b[k].epoch) and a[k].max_power == pytest.approx(b[k].max_power)


def test_forest_on_the_ten_scalars(spark, planted):
    t, y = noisy(600, seed=1)
    rows, labels = {}, []
    for i in range(12):
        rng = np.random.default_rng(100 + i)
        flux = 1 + rng.normal(0, 0.002, 600)
        if i % 2:
            flux = flux - 0.04 * (np.mod(t, 2.0) / 2.0 < 0.05)
        rows[f"s{i}"] = (t, flux)
        labels.append((f"s{i}", i % 2))
    best = spark.createDataFrame([(k, 2.0, 0.0, 1.0) for k in [*rows, "none"]], BEST)
    features = vetting.tabular_features(table(spark, **rows), best)
    assert features.columns == ["series_id", *vetting.TABULAR] and features.where("series_id = 'none'").first().snr is None
    learn = features.join(spark.createDataFrame(labels, "series_id string, label int"), "series_id").withColumn("snr", F.when(F.col("series_id") != "s3", F.col("snr"))).persist()
    model = ml.fit_forest(learn.withColumn("void", F.lit(None).cast("double")), [*vetting.TABULAR, "void"], numTrees=10)
    told = ml.score_forest(learn.withColumn("void", F.lit(None).cast("double")), model).collect()
    assert all((r.prob_planet >= 0.5) == (r.label == 1) for r in told)
    gain = {r.feature: r.importance for r in ml.importances(spark, model).collect()}
    assert set(gain) == set(vetting.TABULAR) and sum(gain.values()) == pytest.approx(1) and gain["transit_depth"] + gain["snr"] > 0.3
    learn.unpersist()
