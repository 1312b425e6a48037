"""The registered composites on a small table against brute force over the full grids."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.plans import queries

EVENTS = ["click", "error", "purchase", "signup", "view"]
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Two users of 80 events with a narrow dip near a day, one of 20 events, one of 300 with 60 in each sector."""
    rng = np.random.default_rng(5)
    rows = []
    for user, n in ((1, 80), (3, 80), (7, 20), (8, 300)):
        t = np.sort(rng.uniform(0, 30, n))
        value = 100 + rng.normal(0, 0.5, n) - 40 * ((t % 1.0371) / 1.0371 < 0.05)
        rows += [(len(rows) + i, START + datetime.timedelta(microseconds=int(x * 86400e6)), user, EVENTS[i % 5], float(v)) for i, (x, v) in enumerate(zip(t, value))]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(8,)], "o_custkey long").write.parquet(f"{path}/orders.parquet")
    return path


def best(t, y, periods):
    """Share, period and power of the best box, one period at a time."""
    n, s = len(t), y.sum()
    top = (-1.0, 0.0, 0.0)
    for p in periods:
        b = np.floor(np.mod(t, p) / p * 20).astype(int)
        k, q = np.bincount(b, minlength=20), np.bincount(b, y, 20)
        depth = (s - q) / np.maximum(n - k, 1) - q / np.maximum(k, 1)
        power = np.where((k >= 2) & (n - k >= 2), depth**2 * k * (n - k) / n, 0.0)
        share = np.round(power / ((y * y).sum() - s * s / n), 9)
        if share.max() > top[0]:
            top = (share.max(), p, power[share.argmax()])
    return top


def cleaned(rows):
    """Division by the median of segments shorter than the trend's window, and five rounds of clipping."""
    t, y = np.array(rows).T
    step = np.diff(t)
    segment = np.concatenate([[0], np.cumsum(step > 5 * np.median(step))])
    y = y / np.array([np.median(y[segment == s]) for s in segment])
    for _ in range(5):
        ok = np.abs(y - np.median(y)) <= 3 * y.std()
        t, y = t[ok], y[ok]
    return t, y


def two_pass(rows):
    t, y = cleaned(rows)
    first = best(t, y, np.round(np.exp(np.arange(2000) * (np.log(15.0) / 1999)), 9))[1]
    a, b = max(1.0, first * 0.85), min(15.0, first * 1.15)
    return best(t, y, np.round(a + np.arange(3000) * ((b - a) / 2999), 9))


def test_hunt_and_scan_on_full_grids(spark, table):
    series = {u: [tuple(r) for r in queries.A.cadence(spark, table).where(F.col("series_id") == u).orderBy("t").select("t", "flux").collect()] for u in ("1", "3")}
    got = {r.series_id: r for r in queries.pipelines.hunt(queries.A.cadence(spark, table).select("series_id", "t", "flux"), queries._cfg()).collect()}
    for user, rows in series.items():
        _, period, power = two_pass(rows)
        assert (got[user].best_period, got[user].max_power) == (pytest.approx(period, abs=1e-8), pytest.approx(power, rel=1e-6))
    assert (got["7"].status, got["7"].best_period, got["8"].n) == ("ERROR: Empty or too short light curve", None, 300)
    one = queries.scan(spark, table).collect()
    assert [(r.series_id, r.best_period, r.status) for r in one] == [("3", round(got["3"].best_period, 6), got["3"].status)]


def test_sweep_summary_counts_every_series(spark, table):
    rows = {r.sector: (r.done, r.candidates, r.known, r.new) for r in queries.sweep_summary(spark, table).collect()}
    assert rows == {s: (4, 0, 1, 3) for s in range(1, 6)}
