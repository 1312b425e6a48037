"""Micro series with hand-computed results, injected dips, and equal results of both search forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.functions import views as V
from undertow.operators import catalog, clean, fold, metrics, search
from undertow.sources import io


def dips(spark, period, depth=0.05, n=600, seed=0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 30, n))
    flux = 1 + rng.normal(0, 0.002, n) - depth * ((t % period) / period < 0.05)
    return spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(t, flux)], "series_id string, t double, flux double")


@pytest.mark.parametrize("period", [2.3, 5.1])
def test_injected_period_is_found(spark, period):
    best = search.two_pass(dips(spark, period), 1.0, 10.0, coarse=500, refine=300).first()
    assert min(abs(best.best_period / period - k) for k in (0.5, 1, 2)) < 0.01


def test_forms_agree(spark):
    s = dips(spark, 3.7)
    a = search.two_pass(s, 1.0, 10.0, coarse=50, refine=30, form="sql").first()
    b = search.two_pass(s, 1.0, 10.0, coarse=50, refine=30).first()
    assert (round(a.best_period, 8), a.best_bin) == (round(b.best_period, 8), b.best_bin)


def test_power_equals_direct_masks(spark):
    s = dips(spark, 3.7, n=200)
    rows = np.array(s.select("t", "flux").collect())
    t, y = rows[:, 0], rows[:, 1]
    got = {(r.pid, r.bin): r.power for r in search.box_power(s, search.period_grid(spark, 1.0, 10.0, 5)).collect()}
    for pid, p in enumerate(np.exp(np.log(1.0) + np.arange(5) * np.log(10.0) / 4)):
        for j in range(20):
            inside = np.floor((t % p) / p * 20) == j
            k, m = inside.sum(), (~inside).sum()
            want = (y[~inside].mean() - y[inside].mean()) ** 2 * k * m / (k + m) if k >= 2 and m >= 2 else 0.0
            assert got.get((pid, j), 0.0) == pytest.approx(want, abs=1e-9)


def test_empty_and_null_flux(spark):
    none = spark.createDataFrame([("a", 1.0, None)], "series_id string, t double, flux double")
    assert search.two_pass(none, 1.0, 10.0, coarse=5, refine=0).count() == 0
    assert search.single_pass(none, 1.0, 10.0, 5).count() == 0


def test_detrend_removes_a_quadratic(spark):
    rows = [("a", float(i), 5 + 0.1 * i + 0.002 * i * i) for i in range(60)]
    out = clean.detrend(spark.createDataFrame(rows, "series_id string, t double, flux double"), 10)
    assert out.select(F.max(F.abs(F.col("flux") - 1))).first()[0] < 1e-9


def test_fold_before_epoch_and_last_bin(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (0.95,)], "t double")
    assert [round(r[0], 6) for r in df.select(S.fold_phase(F.col("t"), F.lit(1.0), F.lit(0.0))).collect()] == [0.9, 0.0, 0.95]
    phased = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0)], "series_id string, phase double, flux double")
    assert [r.value for r in fold.bin_phase(phased, 2).orderBy("bin").collect()] == [1.0, 2.0]


def test_views(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "v array<double>")
    row = df.select(V.normalize_view(F.col("v")).alias("n"), V.pad_view(F.col("v"), 5).alias("p"), V.resample_view(F.col("v"), 5).alias("r")).first()
    assert row.n == [-0.5, 0.0, 1.0] and row.p == [1.0, 2.0, 4.0, 0.0, 0.0] and row.r == [1.0, 1.5, 2.0, 3.0, 4.0]


def test_auc_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1)], "label int, score double")
    assert metrics.roc_auc(rows).first()[0] == 0.75
    assert metrics.roc_auc(rows.where("label = 0")).first()[0] is None


def test_cross_match_and_states(spark):
    c = spark.createDataFrame([("TIC 1", None), ("2", None), ("3", "KNOWN")], "tic_id string, discovery_status string")
    known = spark.createDataFrame([("1",)], "id string")
    assert {r.tic_id: r.discovery_status for r in catalog.cross_match(c, known).collect()} == {"TIC 1": "KNOWN", "2": "NEW_CANDIDATE", "3": "KNOWN"}
    assert catalog.cross_match(c, known.where("false")).where("discovery_status is null").count() == 2


def test_target_list_and_stage_tables(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# ids\nTIC 5\n\n7\n5\n")
    assert [r.tic_id for r in io.read_target_list(spark, str(tmp_path / "t.txt")).collect()] == ["5", "7"]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "series_id string, sector int")
    io.stage_write(df, str(tmp_path / "s"))
    io.stage_write(df.where("sector = 2"), str(tmp_path / "s"))
    assert io.stage_read(spark, str(tmp_path / "s")).count() == 2
