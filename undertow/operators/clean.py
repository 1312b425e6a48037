"""Series cleaning: detrending by a quadratic smoother as window sums, and sigma clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_segments(series: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """``segment``: rises by one where the step in time is over ``tolerance`` times the series' median step."""
    w, whole = Window.partitionBy("series_id").orderBy("t"), Window.partitionBy("series_id")
    stepped = series.withColumn("_dt", F.col("t") - F.lag("t").over(w)).withColumn("_m", F.median("_dt").over(whole))
    gap = F.coalesce((F.col("_dt") > F.col("_m") * tolerance).cast("int"), F.lit(0))
    return stepped.withColumn("segment", F.sum(gap).over(w)).drop("_dt", "_m")


def rolling_trend(series: DataFrame, half: int = 50, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``trend`` by a moving quadratic fit of 2 * half + 1 rows, null within ``half`` rows of an end.

    The fit's centre needs the sums of y, k*y and k*k*y only, with k the row number and y the flux less its mean.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    frame, whole = order.rowsBetween(-half, half), Window.partitionBy(*keys)
    rows = series.withColumn("_k", F.row_number().over(order).cast("double")).withColumn("_mean", F.avg("flux").over(whole)).withColumn("_n", F.count("*").over(whole))
    y = F.col("flux") - F.col("_mean")
    s0, s1, s2 = (F.sum(x).over(frame) for x in (y, F.col("_k") * y, F.col("_k") * F.col("_k") * y))
    q = s2 - 2 * F.col("_k") * s1 + F.col("_k") * F.col("_k") * s0
    m = half
    fit = (s0 * (3 * (3 * m * m + 3 * m - 1)) - q * 15) / ((2 * m - 1) * (2 * m + 1) * (2 * m + 3))
    inner = (F.col("_k") > m) & (F.col("_k") <= F.col("_n") - m)
    return rows.withColumn("trend", F.when(inner, fit + F.col("_mean"))).drop("_mean")


def detrend(series: DataFrame, half: int = 50, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Flux divided by its trend. The first and last ``half`` rows take the value there of the quadratic
    fitted to the outermost full window; series shorter than a window are divided by their median.

    With ``keys`` of series and segment every segment has windows, edges and a median of its own. All is windows over
    the keys, so that rows dealt by series once stay where they are.
    """
    m, whole = half, Window.partitionBy(*keys)
    rows = rolling_trend(series, half, keys)
    # Moments of the outermost windows, in x = row - centre, for a least-squares quadratic.
    first, last = F.col("_k") <= 2 * m + 1, F.col("_k") > F.col("_n") - 2 * m - 1
    x1, x2 = F.col("_k") - (m + 1), F.col("_k") - (F.col("_n") - m)
    moments = {f"_{n}{p}": F.sum(F.when(c, F.col("flux") * x**p)).over(whole) for n, c, x in (("a", first, x1), ("b", last, x2)) for p in (0, 1, 2)}
    rows = rows.withColumns({**moments, "_med": F.median("flux").over(whole)})
    n, t2 = 2 * m + 1, 2 * sum(i * i for i in range(1, m + 1))
    t4 = 2 * sum(i**4 for i in range(1, m + 1))
    det = n * t4 - t2 * t2

    def value(name: str, x: Column) -> Column:
        y0, y1, y2 = (F.col(f"_{name}{p}") for p in (0, 1, 2))
        return (y0 * t4 - y2 * t2) / det + y1 / t2 * x + (y2 * n - y0 * t2) / det * x * x

    trend = (
        F.when(F.col("_n") < n, F.col("_med")).when(F.col("_k") <= m, value("a", x1)).when(F.col("_k") > F.col("_n") - m, value("b", x2)).otherwise(F.col("trend"))
    )
    out = rows.withColumn("trend", trend)
    return out.withColumn("flux", F.col("flux") / F.nullif("trend", F.lit(0.0))).select(*series.columns, "trend")


def sigma_clip(series: DataFrame, sigma: float = 3.0, rounds: int = 5) -> DataFrame:
    """Drops rows over ``sigma`` population deviations from the median, ``rounds`` times."""
    w = Window.partitionBy("series_id")  # one exchange serves all rounds
    for _ in range(rounds):
        stats = series.withColumn("_m", F.median("flux").over(w)).withColumn("_s", F.stddev_pop("flux").over(w))
        series = stats.where(F.abs(F.col("flux") - F.col("_m")) <= sigma * F.col("_s")).drop("_m", "_s")
    return series


def clean_series(series: DataFrame, half: int = 50, sigma: float = 3.0, rounds: int = 5, gaps: float | None = 5.0) -> DataFrame:
    """Trend and outliers taken away; no window of the trend reaches over a step of more than ``gaps`` median ones.

    One exchange by series serves all of it. Without ``gaps`` a series is one segment.
    """
    if gaps is None:
        flat = detrend(series, half)
    else:
        flat = detrend(gap_segments(series, gaps), half, ("series_id", "segment")).drop("segment")
    return sigma_clip(flat.drop("trend"), sigma, rounds)
