"""Box periodograms over keyed time series.

Series are long rows (series_id, t, flux). A trial period folds a series into equal phase bins; depth
and power of a bin follow from its count and sum and the series' totals. Two forms give equal results:
``sql`` joins the grid and aggregates, ``grouped`` folds each series with NumPy; the latter visits a
row once a period without making a row for it and is the default for large grids. There, the rows of a series of over
SLICE rows are dealt to several tasks; their boxes are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from undertow.functions.scalars import log_period

BINS = 20
SLICE = 20_000  # rows of a series that one task searches; a longer series is dealt to tasks of about as many
VISITS = 50_000  # row visits of a step: its arrays stay within a core's cache
DEALT, GRID = 2_000_000, 100  # row visits of a task in the form sql; periods of a series where they aren't told
EDGE = 1e-14  # of a turn, for each turn since time 0: a row this near to a box's edge is told by the exact remainder
BEST = "series_id string, best_period double, epoch double, max_power double, best_bin int"


def period_grid(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """pid, period: n log-spaced trial periods."""
    return spark.range(n).select(F.col("id").cast("int").alias("pid"), log_period(F.col("id"), low, high, n).alias("period"))


def refine_grid(best: DataFrame, low: float, high: float, n: int, width: float = 0.15) -> DataFrame:
    """series_id, pid, period: n linear periods around each series' best one, kept within the range."""
    lo = F.greatest(F.lit(low), F.col("best_period") * (1 - width))
    hi = F.least(F.lit(high), F.col("best_period") * (1 + width))
    grid = best.select("series_id", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pid"))
    return grid.select("series_id", "pid", F.round(F.col("lo") + F.col("pid") * (F.col("hi") - F.col("lo")) / (n - 1), 9).alias("period"))


def downsample(series: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows a series, evenly spaced in time."""
    w = Window.partitionBy("series_id").orderBy("t")
    n = F.count("*").over(Window.partitionBy("series_id"))
    numbered = series.withColumn("_k", F.row_number().over(w).cast("long") - 1).withColumn("_n", n)
    # row k is kept if it is rint(i * (n - 1) / (limit - 1)) for some i
    i = F.rint(F.col("_k") * (limit - 1) / (F.col("_n") - 1))
    near = [F.rint((i + d) * (F.col("_n") - 1) / (limit - 1)) == F.col("_k") for d in (-1, 0, 1)]
    return numbered.where((F.col("_n") <= limit) | near[0] | near[1] | near[2]).drop("_k", "_n")


def totals(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(
        F.count("flux").alias("n"), F.sum("flux").alias("s"), F.sum(F.col("flux") * F.col("flux")).alias("ss"), F.min("t").alias("t0")
    )


def box_expr(n_in: Column, s_in: Column, n: Column, s: Column, guard: bool = True, dips_only: bool = False) -> tuple[Column, Column]:
    """depth and power of a box; without the guard, small counts are kept from dividing by zero only."""
    n_out = n - n_in
    eps = 0.0 if guard else 1e-10
    depth = (s - s_in) / (n_out + eps) - s_in / (n_in + eps)
    power = depth * depth * n_in * n_out / (n + eps)
    if dips_only:
        power = F.when(depth > 0, power).otherwise(0.0)
    if guard:
        ok = (n_in >= 2) & (n_out >= 2)
        return F.when(ok, depth).otherwise(0.0), F.when(ok, power).otherwise(0.0)
    return depth, power


def fold_bins(series: DataFrame, grid: DataFrame, bins: int = BINS) -> DataFrame:
    """series_id, pid, period, bin, n_in, s_in. A grid with series_id is joined on it, else all series get all of it."""
    joined = series.join(grid, "series_id") if "series_id" in grid.columns else series.join(F.broadcast(grid))
    phase = F.pmod(F.col("t"), F.col("period")) / F.col("period")
    return joined.groupBy("series_id", "pid", "period", F.floor(phase * bins).cast("int").alias("bin")).agg(
        F.count("*").alias("n_in"), F.sum("flux").alias("s_in")
    )


def wide_bins(folded: DataFrame, width: int, bins: int) -> DataFrame:
    """Boxes of ``width`` neighbouring bins, around the circle; ``bin`` is the first."""
    firsts = F.array(*(F.pmod(F.col("bin") - d, F.lit(bins)) for d in range(width)))
    spread = folded.select("series_id", "pid", "period", F.explode(firsts).alias("bin"), "n_in", "s_in")
    return spread.groupBy("series_id", "pid", "period", "bin").agg(F.sum("n_in").alias("n_in"), F.sum("s_in").alias("s_in"))


def dealt(series: DataFrame, periods: int) -> DataFrame:
    """``series`` dealt by series_id, so that a task makes about DEALT row visits, however many rows there are.

    Boxes, totals and the best then meet where their rows are, without a shuffle of boxes, and a task's boxes stay in memory.
    """
    return series.repartition(max(1, -(-series.count() * periods // DEALT)), "series_id")


def box_power(
    series: DataFrame, grid: DataFrame, *, bins: int = BINS, width: int = 1, guard: bool = True, dips_only: bool = False, last_window: bool = True, periods: int | None = None
) -> DataFrame:
    """series_id, pid, period, bin, depth, power, share for every box that holds rows. Null and non-finite flux goes.

    ``periods`` is the number of them for a series, by which rows are dealt; it is counted if ``grid`` is common to all.
    """
    series = series.where("flux is not null and not isnan(flux) and t is not null")
    series = dealt(series, periods or (GRID if "series_id" in grid.columns else grid.count()))
    folded = fold_bins(series, grid, bins)
    if width > 1:
        folded = wide_bins(folded, width, bins)
    if not last_window:
        folded = folded.where(F.col("bin") < bins - 1)
    return powers(folded, totals(series), guard, dips_only)


def powers(folded: DataFrame, own: DataFrame, guard: bool = True, dips_only: bool = False) -> DataFrame:
    """The boxes of ``folded`` with depth, power and share by their series' ``totals``."""
    depth, power = box_expr(F.col("n_in"), F.col("s_in"), F.col("n"), F.col("s"), guard, dips_only)
    scatter = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    out = folded.join(own, "series_id").withColumn("depth", depth).withColumn("power", power)
    return out.withColumn("share", F.round(F.when(scatter > 0, F.col("power") / scatter).otherwise(0.0), 9)).select(
        "series_id", "pid", "period", "bin", "n_in", "depth", "power", "share", "t0"
    )


def spectrum(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("series_id", "pid", "period").agg(F.max("power").alias("power"))


def best_of(boxes: DataFrame, bins: int = BINS, epoch_by: str = "power") -> DataFrame:
    """The smallest period, then bin, of the largest share; the epoch is that bin's phase after the first time."""
    top = F.max(F.struct(F.col("share"), -F.col("period"), -F.col("bin"), F.col("power"), F.col("period"), F.col("bin"), F.col("t0")))
    best = boxes.groupBy("series_id").agg(top.alias("x"))
    best = best.select("series_id", F.col("x.period").alias("best_period"), (F.col("x.t0") + F.col("x.bin") / bins * F.col("x.period")).alias("epoch"), F.col("x.power").alias("max_power"), F.col("x.bin").alias("best_bin"), F.col("x.t0").alias("t0"))
    if epoch_by == "power":
        return best.drop("t0")
    deep = boxes.where("n_in >= 2").join(best.select("series_id", F.col("best_period").alias("period")), ["series_id", "period"])
    deep = deep.groupBy("series_id").agg(F.max(F.struct(F.round("depth", 9).alias("d"), (-F.col("bin")).alias("b"))).alias("d"))
    phase = F.coalesce(-F.col("d.b") / bins, F.lit(0.5))
    return best.join(deep, "series_id", "left").select("series_id", "best_period", (F.col("t0") + phase * F.col("best_period")).alias("epoch"), "max_power", "best_bin")


class Kernel(NamedTuple):
    """The box search of one series in NumPy, with the options of ``box_power`` and ``best_of``."""

    bins: int = BINS
    width: int = 1
    guard: bool = True
    dips_only: bool = False
    last_window: bool = True
    epoch_by: str = "power"

    def cells(self, t: np.ndarray, periods: np.ndarray) -> np.ndarray:
        """Each row's box at each period, numbered through: floor(t mod period / period * bins) * (number of periods) + the period's place.

        Without the costly remainder, but where a row is so near to a box's edge that rounding may tell.
        """
        x = t[None, :] / periods[:, None]
        x -= np.floor(x)
        x *= self.bins
        b = x.astype(np.int64)
        x -= np.rint(x)
        edge = np.flatnonzero(np.abs(x, out=x).ravel() < EDGE * self.bins * max(1.0, np.abs(t).max() / periods.min()))
        if len(edge):
            at, row = np.divmod(edge, len(t))
            b.flat[edge] = np.floor(np.mod(t[row], periods[at]) / periods[at] * self.bins)
        b *= len(periods)
        b += np.arange(len(periods))[:, None]
        return b.ravel()

    def sums(self, t: np.ndarray, flux: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and flux of the boxes, a row for each bin and a column for each period."""
        b, k = self.cells(t, periods), len(periods) * self.bins
        n_in = np.bincount(b, minlength=k).reshape(self.bins, -1)
        s_in = np.bincount(b, np.tile(flux, len(periods)), k).reshape(self.bins, -1)
        if self.width > 1:
            n_in, s_in = (sum(np.roll(x, -d, 0) for d in range(self.width)) for x in (n_in, s_in))
        return n_in, s_in

    def all_sums(self, t: np.ndarray, flux: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``sums``, some of the periods at a time."""
        n_in, s_in = zip(*(self.sums(t, flux, p) for p in self.chunks(t, periods)), strict=True)
        return np.concatenate(n_in, 1), np.concatenate(s_in, 1)

    def near_best(self, t: np.ndarray, flux: np.ndarray, periods: np.ndarray, scatter: float) -> np.ndarray:
        """The periods that may have the largest share: those whose largest share, by fewer steps than ``boxes`` takes,
        is that of the best but for rounding. About the mean, a box's power is s_in^2 * n / (n_in * n_out)."""
        n = len(t)
        if not self.guard or self.dips_only or not self.last_window:
            return periods
        if n < 4 or scatter <= 0:
            return periods[:1]  # all shares are 0
        y, n_in = flux - flux.mean(), np.arange(n + 1.0)
        weight = np.zeros(n + 1)
        weight[2 : n - 1] = n / (n_in[2 : n - 1] * (n - n_in[2 : n - 1])) / scatter
        most = []
        for p in self.chunks(t, periods):
            inside, s = self.sums(t, y, p)
            s *= s
            s *= weight[inside]
            most.append(s.max(0))
        most = np.concatenate(most)
        return periods[most >= most.max() - 1e-8 - 1e-11 * n * (flux * flux).sum() / scatter]

    def boxes(self, t: np.ndarray, flux: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, depth and power (-1 where a box holds no rows) of every period's boxes."""
        n, s = len(t), flux.sum()
        n_in, s_in = (x.T for x in self.sums(t, flux, periods))
        n_out, eps = n - n_in, 0.0 if self.guard else 1e-10
        low = 1 if self.guard else 0
        depth = (s - s_in) / (np.maximum(n_out, low) + eps) - s_in / (np.maximum(n_in, low) + eps)
        power = depth * depth * n_in * n_out / (n + eps)
        if self.dips_only:
            power = np.where(depth > 0, power, 0.0)
        if self.guard:
            ok = (n_in >= 2) & (n_out >= 2)
            depth, power = np.where(ok, depth, 0.0), np.where(ok, power, 0.0)
        power = np.where(n_in > 0, power, -1.0)
        if not self.last_window:
            power[:, -1] = -1.0
        return n_in, depth, power

    def chunks(self, t: np.ndarray, periods: np.ndarray, size: int = VISITS) -> Iterator[np.ndarray]:
        """Some of the periods at a time, for at most about ``size`` row visits."""
        step = max(1, size // len(t))
        for at in range(0, len(periods), step):
            yield periods[at : at + step]

    def best(self, t: np.ndarray, flux: np.ndarray, periods: np.ndarray) -> tuple[float, float, float, int]:
        """Period, epoch, power and bin of the largest share: the smallest period, then bin, of equal ones."""
        scatter, top = (flux * flux).sum() - flux.sum() ** 2 / len(t), (-2.0, 0.0, 0, 0.0, 0.0)
        for p in self.chunks(t, self.near_best(t, flux, periods, scatter)):
            n_in, depth, power = self.boxes(t, flux, p)
            share = np.where(power >= 0, np.round(power / scatter, 9) if scatter > 0 else 0.0, -1.0)
            k = int(share.argmax())
            if share.flat[k] > top[0]:
                at, cell = divmod(k, self.bins)
                turn = cell / self.bins
                if self.epoch_by == "depth":
                    deep = np.where(n_in[at] >= 2, np.round(depth[at], 9), -np.inf)
                    deep[power[at] < 0] = -np.inf
                    turn = int(deep.argmax()) / self.bins if np.isfinite(deep).any() else 0.5
                top = (share.flat[k], p[at], cell, power.flat[k], turn)
        return top[1], t.min() + top[4] * top[1], top[3], top[2]

    def spectrum(self, t: np.ndarray, flux: np.ndarray, periods: np.ndarray) -> np.ndarray:
        """The largest power at each period."""
        return np.concatenate([self.boxes(t, flux, p)[2].max(1) for p in self.chunks(t, periods)])


def log_grid(low: float, high: float, n: int) -> np.ndarray:
    lo, hi = np.log(low), np.log(high)
    return np.round(np.exp(lo + np.arange(n) * ((hi - lo) / (n - 1))), 9)


def near_grid(best: float, low: float, high: float, n: int, width: float = 0.15) -> np.ndarray:
    a, b = max(low, best * (1 - width)), min(high, best * (1 + width))
    return np.round(a + np.arange(n) * (b - a) / (n - 1), 9)


def long_series(series: DataFrame, limit: int | None = None) -> DataFrame | None:
    """series_id, slices: the series of over SLICE rows and how many slices they are dealt to; None if there are none.

    Rows are counted as this is called, unless they were thinned to a ``limit`` that no slice exceeds. There is at most one
    such series for SLICE rows.
    """
    if limit is not None and limit <= SLICE:
        return None
    long = series.groupBy("series_id").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).where("slices > 1")
    return None if long.isEmpty() else long


def parted(series: DataFrame, long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all but the ``long`` series, and those of the long ones with their ``slice``, dealt by it."""
    rows = series.join(F.broadcast(long.select("series_id")), "series_id", "left_semi").join(F.broadcast(long), "series_id")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("t", "flux"), F.col("slices")).cast("int")).drop("slices")
    return series.join(F.broadcast(long.select("series_id")), "series_id", "left_anti"), rows.repartition("series_id", "slice")


def _finite(series: DataFrame, limit: int | None) -> DataFrame:
    """Rows that a search visits: all with finite flux, unless a series is to be thinned to ``limit`` evenly spaced ones."""
    series = series.where("flux is not null and not isnan(flux) and t is not null and abs(flux) <> double('inf')").select("series_id", "t", F.col("flux").cast("double").alias("flux"))
    return series if limit is None else downsample(series, limit)


def in_time(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Times and flux in one order, however the rows come: sums, and ties of them, then don't differ from run to run."""
    t, flux = (np.asarray(rows.column(c), float) for c in ("t", "flux"))
    order = np.lexsort((flux, t))
    return t[order], flux[order]


def _by_series(series: DataFrame, one, schema: str) -> DataFrame:
    """``one(t, flux)``, a dict of columns, for each series; one shuffle on series_id, Arrow batches to NumPy."""
    types = [f.split()[1] for f in schema.split(", ")]
    arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}

    def run(rows: pa.Table) -> pa.Table:
        found = one(*in_time(rows))
        n = len(next(iter(found.values())))
        found = {"series_id": [rows.column("series_id")[0].as_py()] * n, **found}
        return pa.table({k: pa.array(v, arrow[kind]) for (k, v), kind in zip(found.items(), types, strict=True)})

    return series.groupBy("series_id").applyInArrow(run, schema)


def fold_slices(rows: DataFrame, kernel: Kernel, grid: Callable[[float], np.ndarray]) -> DataFrame:
    """The boxes that hold rows, as of ``fold_bins``, of series dealt by ``slice``; ``grid`` tells periods from ``best_period``.

    A slice is folded batch by batch, so that a task holds its boxes and one batch of rows. The slices' boxes are added up.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_in = s_in = 0
        for rows in batches:
            name, periods = rows.column("series_id")[0].as_py(), grid(rows.column("best_period")[0].as_py())
            n, s = kernel.all_sums(np.asarray(rows.column("t"), float), np.asarray(rows.column("flux"), float), periods)
            n_in, s_in = n_in + n, s_in + s
        cell = np.flatnonzero(n_in.T)
        pid, at = np.divmod(cell, kernel.bins)
        cols = (pa.array([name] * len(cell), pa.string()), pa.array(pid, pa.int32()), periods[pid], pa.array(at, pa.int32()), n_in.T.flat[cell], s_in.T.flat[cell])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["series_id", "pid", "period", "bin", "n_in", "s_in"])

    boxes = rows.groupBy("series_id", "slice").applyInArrow(one, "series_id string, pid int, period double, bin int, n_in long, s_in double")
    return boxes.groupBy("series_id", "pid", "period", "bin").agg(F.sum("n_in").alias("n_in"), F.sum("s_in").alias("s_in"))


def boxes_sliced(rows: DataFrame, low: float, high: float, coarse: int, refine: int, kernel: Kernel) -> tuple[DataFrame, DataFrame | None]:
    """Both passes' boxes of series dealt by ``slice``; None for the second without ``refine``."""
    own = totals(rows)

    def boxes(rows: DataFrame, grid: Callable[[float], np.ndarray]) -> DataFrame:
        folded = fold_slices(rows, kernel, grid)
        return powers(folded if kernel.last_window else folded.where(F.col("bin") < kernel.bins - 1), own, kernel.guard, kernel.dips_only)

    periods = log_grid(low, high, coarse)
    first = boxes(rows.withColumn("best_period", F.lit(0.0)), lambda best: periods)
    if not refine:
        return first, None
    best = best_of(first, kernel.bins).select("series_id", "best_period")
    return first, boxes(rows.join(F.broadcast(best), "series_id"), lambda best: near_grid(best, low, high, refine))


def search_grouped(
    series: DataFrame, low: float, high: float, *, coarse: int = 2000, refine: int = 3000, bins: int = BINS, limit: int | None = None, counted: DataFrame | None = None, **options
) -> DataFrame:
    """Both passes for each series in one visit; without ``refine`` the coarse one alone. Options as of ``Kernel``.

    All rows are visited, those of long series in several tasks. Only if ``limit`` is told is a series of more rows thinned
    to it first. ``counted`` tells which series are long in place of ``series``: a table of these rows, or more, that costs less.
    """
    kernel, grid, series = Kernel(bins, **options), log_grid(low, high, coarse), _finite(series, limit)

    def one(t: np.ndarray, flux: np.ndarray) -> dict:
        found = kernel.best(t, flux, grid)
        if refine:
            found = kernel.best(t, flux, near_grid(found[0], low, high, refine))
        return dict(zip(("best_period", "epoch", "max_power", "best_bin"), ([x] for x in found), strict=True))

    long = long_series(series if counted is None else counted, limit)
    if long is None:
        return _by_series(series, one, BEST)
    series, rows = parted(series, long)
    first, second = boxes_sliced(rows, low, high, coarse, refine, kernel)
    return _by_series(series, one, BEST).unionByName(best_of(first if second is None else second, bins, kernel.epoch_by))


def spectra(
    series: DataFrame, low: float, high: float, coarse: int = 2000, refine: int = 3000, *, limit: int | None = None, counted: DataFrame | None = None, **options
) -> DataFrame:
    """pass, series_id, pid, period, power: both passes' spectra of each series, from the same visit as the search.

    ``limit`` and ``counted`` as of ``search_grouped``.
    """
    kernel, grid, series = Kernel(**options), log_grid(low, high, coarse), _finite(series, limit)

    def one(t: np.ndarray, flux: np.ndarray) -> dict:
        near = near_grid(kernel.best(t, flux, grid)[0], low, high, refine)
        power = np.concatenate((kernel.spectrum(t, flux, grid), kernel.spectrum(t, flux, near)))
        return {"pass": ["coarse"] * coarse + ["refine"] * refine, "pid": np.concatenate((np.arange(coarse), np.arange(refine))), "period": np.concatenate((grid, near)), "power": power}

    schema, long = "series_id string, pass string, pid int, period double, power double", long_series(series if counted is None else counted, limit)
    if long is None:
        return _by_series(series, one, schema)
    series, rows = parted(series, long)
    return _by_series(series, one, schema).unionByName(_both(*boxes_sliced(rows, low, high, coarse, refine, kernel)))


def single_pass(series: DataFrame, low: float, high: float, n: int, form: str = "grouped", limit: int | None = None, epoch_by: str = "power", **options) -> DataFrame:
    """The best of n log-spaced periods. Options of the box search: guard, dips_only, width, last_window, epoch_by."""
    if form == "grouped":
        return search_grouped(series, low, high, coarse=n, refine=0, limit=limit, epoch_by=epoch_by, **options)
    return best_of(box_power(series, period_grid(series.sparkSession, low, high, n), **options), epoch_by=epoch_by)


def two_pass(
    series: DataFrame, low: float, high: float, *, coarse: int = 2000, refine: int = 3000, form: str = "grouped", counted: DataFrame | None = None
) -> DataFrame:
    """Coarse log grid, then a linear grid around each winner; the refined winner is the answer. ``counted`` as of ``search_grouped``."""
    if form == "grouped":
        return search_grouped(series, low, high, coarse=coarse, refine=refine, counted=counted)
    most = max(coarse, refine)  # both passes are dealt alike
    first = single_pass(series, low, high, coarse, form="sql", periods=most)
    return best_of(box_power(series, refine_grid(first, low, high, refine), periods=most))


def merged_spectrum(series: DataFrame, low: float, high: float, coarse: int, refine: int, form: str = "grouped") -> DataFrame:
    """pass, series_id, pid, period, power of both passes."""
    if form == "grouped":
        return spectra(series, low, high, coarse, refine)
    most = max(coarse, refine)
    boxes = box_power(series, period_grid(series.sparkSession, low, high, coarse), periods=most)
    return _both(boxes, box_power(series, refine_grid(best_of(boxes), low, high, refine), periods=most))


def _both(first: DataFrame, second: DataFrame | None) -> DataFrame:
    """The spectra of both passes' boxes."""
    mark = lambda df, name: spectrum(df).withColumn("pass", F.lit(name))
    return mark(first, "coarse") if second is None else mark(first, "coarse").unionByName(mark(second, "refine"))


def in_out_means(series: DataFrame, inside: Column) -> DataFrame:
    """Counts and means within and outside a condition; outside is the total less the inside."""
    agg = series.groupBy("series_id").agg(F.count_if(inside).alias("n_in"), F.sum(F.when(inside, F.col("flux"))).alias("s_in"), F.count("flux").alias("n"), F.sum("flux").alias("s"))
    return agg.select("series_id", "n_in", (F.col("n") - F.col("n_in")).alias("n_out"), (F.col("s_in") / F.col("n_in")).alias("mean_in"), ((F.col("s") - F.coalesce("s_in", F.lit(0.0))) / F.nullif(F.col("n") - F.col("n_in"), F.lit(0))).alias("mean_out"))
