"""Sinusoid periodograms (least squares with a floating mean) over keyed, unevenly spaced series.

At a period, the best a * cos(wt) + b * sin(wt) + c follows from the means of cos, sin, their squares and product, and
of the flux times each: six sums besides the series' own. Times are taken from the series' first one, which leaves the
power as it is. Two forms give equal results: ``sql`` joins the grid and aggregates, ``grouped`` works out each series
with NumPy, a row visited once a period without making a row for it. There, the rows of a series of over ``search.SLICE``
rows are dealt to several tasks; their sums are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.operators.search import downsample, in_time, long_series, parted, period_grid

GRID = 5000  # periods, as many as two passes of the box search have
BEST = "series_id string, best_period double, power double, amplitude double, phase double, n long"
SUMS = ("mc", "ms", "cc", "ss", "cs", "my", "yc", "ys", "yy")  # of cos, sin, their squares and product, the flux, it times each, its square


def _good(series: DataFrame) -> DataFrame:
    return series.where("flux is not null and not isnan(flux) and t is not null").select("series_id", "t", "flux")


def _fit(c: Column, s: Column, cc: Column, ss: Column, cs: Column, y: Column, yc: Column, ys: Column, yy: Column) -> tuple[Column, Column, Column]:
    """Power, a and b from means; power is the share of the flux's variance that the sinusoid takes away."""
    cc, ss, cs = cc - c * c, ss - s * s, cs - c * s
    yc, ys, yy = yc - y * c, ys - y * s, yy - y * y
    det = cc * ss - cs * cs
    ok = (det > 1e-12) & (yy > 0)
    a, b = (yc * ss - ys * cs) / det, (ys * cc - yc * cs) / det
    return F.when(ok, (a * yc + b * ys) / yy).otherwise(0.0), F.when(ok, a).otherwise(0.0), F.when(ok, b).otherwise(0.0)


def harmonic_spectrum(series: DataFrame, grid: DataFrame) -> DataFrame:
    """series_id, pid, period, power, a, b, n for each series and period of ``grid``."""
    rows = _good(series)
    own = rows.groupBy("series_id").agg(F.min("t").alias("t0"), F.avg("flux").alias("mean"))
    rows = rows.join(own, "series_id").select("series_id", (F.col("t") - F.col("t0")).alias("t"), (F.col("flux") - F.col("mean")).alias("y"))
    angle = F.col("t") * (2 * pi) / F.col("period")
    rows = rows.join(F.broadcast(grid)).withColumns({"c": F.cos(angle), "s": F.sin(angle)})
    c, s, y = F.col("c"), F.col("s"), F.col("y")
    means = {"mc": c, "ms": s, "cc": c * c, "ss": s * s, "cs": c * s, "my": y, "yc": y * c, "ys": y * s, "yy": y * y}
    per = rows.groupBy("series_id", "pid", "period").agg(F.count("*").alias("n"), *(F.avg(x).alias(k) for k, x in means.items()))
    power, a, b = _fit(*(F.col(k) for k in means))
    return per.select("series_id", "pid", "period", power.alias("power"), a.alias("a"), b.alias("b"), "n")


def _numpy(t: np.ndarray, y: np.ndarray, periods: np.ndarray, chunk: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Power, a and b at each of ``periods``."""
    t, y = t - t.min(), y - y.mean()
    out = [np.zeros(len(periods)) for _ in range(3)]
    step, yy = max(1, chunk // len(t)), (y * y).mean()
    for at in range(0, len(periods), step):
        angle = t[None, :] * (2 * pi) / periods[at : at + step, None]
        c, s = np.cos(angle), np.sin(angle)
        mc, ms = c.mean(1), s.mean(1)
        cc, ss, cs = (c * c).mean(1) - mc * mc, (s * s).mean(1) - ms * ms, (c * s).mean(1) - mc * ms
        yc, ys = c @ y / len(y), s @ y / len(y)
        det = cc * ss - cs * cs
        ok = (det > 1e-12) & (yy > 0)
        det = np.where(ok, det, 1.0)
        a, b = np.where(ok, (yc * ss - ys * cs) / det, 0.0), np.where(ok, (ys * cc - yc * cs) / det, 0.0)
        for whole, part in zip(out, ((a * yc + b * ys) / (yy if yy > 0 else 1.0), a, b), strict=True):
            whole[at : at + step] = part
    return out[0], out[1], out[2]


def _near_best(t: np.ndarray, y: np.ndarray, periods: np.ndarray, chunk: int = 50_000) -> np.ndarray:
    """The periods that may have the most power: single precision tells it to 1e-3 where the fit is well posed, and all
    others stay in. Angles are brought to half a turn in double precision first."""
    t, y = t - t.min(), y - y.mean()
    spread, step = np.sqrt((y * y).mean()), max(1, chunk // len(t))
    if not spread > 0:
        return periods[:1]  # no power anywhere
    both, most = np.stack((np.ones(len(y)), y / spread), 1).astype(np.float32) / np.float32(len(y)), []
    for at in range(0, len(periods), step):
        turn = t[None, :] / periods[at : at + step, None]
        turn -= np.rint(turn)
        angle = (turn * (2 * pi)).astype(np.float32)
        c, s = np.cos(angle), np.sin(angle)
        (mc, yc), (ms, ys) = (c @ both).T.astype(float), (s @ both).T.astype(float)
        square = np.einsum("ij,ij->i", c, c).astype(float) / len(t)
        cc, ss, cs = square - mc * mc, 1 - square - ms * ms, np.einsum("ij,ij->i", c, s).astype(float) / len(t) - mc * ms
        det = cc * ss - cs * cs
        posed = det > 0.05
        power = (yc * yc * ss + ys * ys * cc - 2 * yc * ys * cs) / np.where(posed, det, 1.0)
        most.append(np.where(posed, power, np.inf))
    most = np.concatenate(most)
    told = np.isfinite(most)
    return periods[~told | (most >= (most[told].max() if told.any() else 0.0) - 2e-3)]


def _sums(t: np.ndarray, y: np.ndarray, periods: np.ndarray, chunk: int = 50_000) -> np.ndarray:
    """A row for each of SUMS at each of ``periods``."""
    out, step = np.empty((len(SUMS), len(periods))), max(1, chunk // len(t))
    out[5], out[8] = y.sum(), y @ y
    for at in range(0, len(periods), step):
        angle = t[None, :] * (2 * pi) / periods[at : at + step, None]
        c, s = np.cos(angle), np.sin(angle)
        square = np.einsum("ij,ij->i", c, c)
        out[:5, at : at + step] = c.sum(1), s.sum(1), square, len(t) - square, np.einsum("ij,ij->i", c, s)
        out[6:8, at : at + step] = c @ y, s @ y
    return out


def sliced_spectrum(rows: DataFrame, periods: np.ndarray) -> DataFrame:
    """As ``harmonic_spectrum``, of series dealt by ``slice``. A task holds a slice's sums and one batch of its rows."""
    own = rows.groupBy("series_id").agg(F.min("t").alias("t0"), F.avg("flux").alias("mean"))
    rows = rows.join(F.broadcast(own), "series_id").select("series_id", "slice", (F.col("t") - F.col("t0")).alias("t"), (F.col("flux") - F.col("mean")).alias("y"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sums = 0
        for rows in batches:
            name = rows.column("series_id")[0].as_py()
            n, sums = n + len(rows), sums + _sums(*(np.asarray(rows.column(c), float) for c in ("t", "y")), periods)
        told = {"series_id": pa.array([name] * len(periods), pa.string()), "pid": pa.array(np.arange(len(periods)), pa.int32()), "period": periods, "n": np.full(len(periods), n), **dict(zip(SUMS, sums, strict=True))}
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in told.values()], list(told))

    per = rows.groupBy("series_id", "slice").applyInArrow(one, f"series_id string, pid int, period double, n long, {', '.join(f'{k} double' for k in SUMS)}")
    per = per.groupBy("series_id", "pid", "period").agg(F.sum("n").alias("n"), *((F.sum(k) / F.sum("n")).alias(k) for k in SUMS))
    power, a, b = _fit(*(F.col(k) for k in SUMS))
    return per.select("series_id", "pid", "period", power.alias("power"), a.alias("a"), b.alias("b"), "n")


def _best(spectrum: DataFrame) -> DataFrame:
    """The period of the most power (to 9 digits) of each series, the smallest of equal ones, as BEST."""
    order = F.struct(F.round("power", 9).alias("p"), (-F.col("period")).alias("q"))
    per = spectrum.groupBy("series_id").agg(F.max_by(F.struct("period", "power", "a", "b", "n"), order).alias("x")).select("series_id", "x.*")
    turn = F.pmod(F.atan2("b", "a") / (2 * pi), F.lit(1.0))
    return per.select("series_id", F.col("period").alias("best_period"), "power", F.hypot("a", "b").alias("amplitude"), turn.alias("phase"), "n")


def lomb_scargle(series: DataFrame, low: float, high: float, n: int = GRID, *, form: str = "grouped", limit: int | None = None) -> DataFrame:
    """The best of ``n`` log-spaced periods for each series; of periods of equal power (to 9 digits) the smallest.

    series_id, best_period, power (0 to 1), amplitude, phase (of the crest, in periods after the first time), n (rows),
    false_alarm: the chance that noise alone reaches the power at one of the grid's periods, each taken as independent.
    All rows are visited, unless a ``limit`` is told: then a series of more rows is thinned to that many evenly spaced ones
    first. One of fewer than 4 rows, or of constant flux, has power 0.
    """
    rows = _good(series) if limit is None else downsample(_good(series), limit)
    if form == "sql":
        best = _best(harmonic_spectrum(rows, period_grid(series.sparkSession, low, high, n)))
    else:
        lo, hi = np.log(low), np.log(high)
        periods = np.round(np.exp(lo + np.arange(n) * ((hi - lo) / (n - 1))), 9)

        def one(rows: pa.Table) -> pa.Table:
            t, y = in_time(rows)
            near = _near_best(t, y, periods)
            power, a, b = _numpy(t, y, near)
            k = int(np.round(power, 9).argmax())
            turn = np.mod(np.arctan2(b[k], a[k]) / (2 * pi), 1.0)
            told = {"best_period": near[k], "power": power[k], "amplitude": np.hypot(a[k], b[k]), "phase": turn}
            return pa.table({"series_id": rows.column("series_id")[:1], **{c: pa.array([float(v)]) for c, v in told.items()}, "n": pa.array([len(t)], pa.int64())})

        rows = rows.withColumn("flux", F.col("flux").cast("double"))
        long = long_series(rows, limit)
        short, sliced = (rows, None) if long is None else parted(rows, long)
        best = short.groupBy("series_id").applyInArrow(one, BEST)
        if sliced is not None:
            best = best.unionByName(_best(sliced_spectrum(sliced, periods)))
    enough = F.col("n") >= 4
    best = best.withColumns({c: F.when(enough, F.col(c)).otherwise(0.0) for c in ("power", "amplitude", "phase")})
    single = F.pow(F.greatest(1 - F.col("power"), F.lit(0.0)), (F.col("n") - 3) / 2)
    return best.withColumn("false_alarm", F.when(enough, 1 - F.pow(1 - single, F.lit(n))).otherwise(1.0))


def residual_of(series: DataFrame, best: DataFrame) -> DataFrame:
    """``series`` with the best sinusoid taken away: what is left is searched for the next period, or for dips."""
    first = F.min("t").over(Window.partitionBy("series_id"))
    rows = series.withColumn("_t0", first).join(best.select("series_id", "best_period", "amplitude", "phase"), "series_id", "left")
    wave = F.col("amplitude") * F.cos(((F.col("t") - F.col("_t0")) / F.col("best_period") - F.col("phase")) * (2 * pi))
    return rows.withColumn("flux", F.col("flux") - F.coalesce(wave, F.lit(0.0))).select(*series.columns)
