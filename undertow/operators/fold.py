"""Folded features: binned views of each series on its best period, and centroid shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions.scalars import fold_phase

GLOBAL_BINS, LOCAL_BINS, WINDOW_BINS, HALF_WIDTH = 2048, 256, 50, 0.05
DEALT = 250_000  # rows of a task, where rows are dealt by series


def folded(series: DataFrame, best: DataFrame) -> DataFrame:
    return series.join(best.select("series_id", "best_period", "epoch"), "series_id").withColumn("phase", fold_phase(F.col("t"), F.col("best_period"), F.col("epoch")))


def bin_means(phased: DataFrame, bins: int, name: str) -> DataFrame:
    """series_id and ``name``: the series' mean ``m`` and the means ``v`` of those bins that have rows, for ``dense``.

    Bins are half open: a phase of exactly 1 counts for the mean only. Rows meet by series and bin before the series.
    """
    at = F.floor(F.col("phase") * bins).cast("int").alias("bin")
    means = phased.groupBy("series_id", at).agg(F.avg("flux").alias("v"), F.sum("flux").alias("s"), F.count("flux").alias("n"))
    known = F.array_sort(F.collect_list(F.when(F.col("bin") < bins, F.struct("bin", "v"))))
    return means.groupBy("series_id").agg(F.struct((F.sum("s") / F.sum("n")).alias("m"), known.alias("known")).alias(name))


def dense(name: str, bins: int, fill: str = "mean") -> Column:
    """The means of all bins as one array; an empty one has the series' mean, or null if ``fill`` is null."""
    known, blank = F.col(name)["known"], F.col(name)["m"] if fill == "mean" else F.lit(None).cast("double")
    before = lambda i: F.coalesce(F.get(known, i - 1)["bin"], F.lit(-1))
    parts = F.transform(known, lambda e, i: F.concat(F.array_repeat(blank, e["bin"] - before(i) - 1), F.array(F.coalesce(e["v"], blank))))
    rest = F.array_repeat(blank, F.lit(bins - 1) - before(F.size(known)))
    return F.concat(F.flatten(parts), rest)


def binned_view(phased: DataFrame, bins: int, name: str, fill: str = "mean") -> DataFrame:
    """series_id and the means of all bins as one array; the gaps between a series' bins are filled within its row."""
    return bin_means(phased, bins, "_means").select("series_id", dense("_means", bins, fill).alias(name))


def bin_phase(phased: DataFrame, bins: int, fill: str = "mean") -> DataFrame:
    """series_id, bin, value for all bins of ``binned_view``."""
    return binned_view(phased, bins, "view", fill).select("series_id", F.posexplode("view").alias("bin", "value"))


def transit_window(phased: DataFrame) -> DataFrame:
    """series_id, center: the middle of the lowest of 50 bins (the first of equal ones)."""
    low = F.array_min(F.transform("view", lambda x, i: F.struct(F.round(x, 9).alias("v"), i.alias("bin"))))
    return binned_view(phased, WINDOW_BINS, "view").select("series_id", ((low["bin"] + 0.5) / WINDOW_BINS).alias("center"))


def global_view(phased: DataFrame, bins: int = GLOBAL_BINS) -> DataFrame:
    return binned_view(phased, bins, "global_view")


def local_segment(phased: DataFrame, window: DataFrame, half: float = HALF_WIDTH) -> DataFrame:
    """Rows of the window around the dip with ``phase`` scaled to [0, 1]; all rows where fewer than 10 are inside."""
    rows = phased.join(window, "series_id")
    low, high, phase = F.col("center") - half, F.col("center") + half, F.col("phase")
    inside = (
        F.when(low < 0, (phase >= low + 1) | (phase < high)).when(high > 1, (phase >= low) | (phase < high - 1)).otherwise((phase >= low) & (phase < high))
    )
    flat = F.when((low < 0) & (phase >= low + 1), phase - 1).when((high > 1) & (phase < high - 1), phase + 1).otherwise(phase)
    rows = rows.withColumn("_in", inside).withColumn("_flat", flat)
    w = Window.partitionBy("series_id")
    rows = rows.withColumns({"_n": F.count_if("_in").over(w), "_a": F.min(F.when(F.col("_in"), F.col("_flat"))).over(w), "_b": F.max(F.when(F.col("_in"), F.col("_flat"))).over(w)}).where((F.col("_n") < 10) | F.col("_in"))
    scaled = F.when(F.col("_n") < 10, phase).when(F.col("_b") > F.col("_a"), (F.col("_flat") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0)
    return rows.withColumn("phase", scaled).select(*phased.columns)


def local_view(phased: DataFrame, window: DataFrame | None = None, bins: int = LOCAL_BINS) -> DataFrame:
    return binned_view(local_segment(phased, transit_window(phased) if window is None else window), bins, "local_view")


def folded_curve(phased: DataFrame, bins: int = 200) -> DataFrame:
    return bin_phase(phased, bins, fill="null")


def centroid_offset(pixels: DataFrame, best: DataFrame, window: DataFrame, half: float = HALF_WIDTH) -> DataFrame:
    """Distance of the flux-weighted centroids in and out of the window; null with fewer than 2 times or no flux on a side.

    ``pixels``: series_id, t, row, col, flux.
    """
    rows = folded(pixels, best).join(window, "series_id")
    low, high, phase = F.col("center") - half, F.col("center") + half, F.col("phase")
    inside = F.when(low < 0, (phase >= low + 1) | (phase < high)).when(high > 1, (phase >= low) | (phase < high - 1)).otherwise((phase >= low) & (phase < high))
    side = rows.groupBy("series_id", inside.alias("inside")).agg(
        F.sum("flux").alias("f"), F.sum(F.col("col") * F.col("flux")).alias("x"), F.sum(F.col("row") * F.col("flux")).alias("y"), F.countDistinct("t").alias("n")
    )
    ok = (F.col("n") >= 2) & (F.col("f") > 0)
    pick = lambda on, c: F.max(F.when((F.col("inside") == on) & ok, F.col(c) / F.col("f")))
    both = side.groupBy("series_id").agg(pick(True, "x").alias("xi"), pick(True, "y").alias("yi"), pick(False, "x").alias("xo"), pick(False, "y").alias("yo"))
    return both.select("series_id", F.sqrt((F.col("xi") - F.col("xo")) ** 2 + (F.col("yi") - F.col("yo")) ** 2).alias("centroid_offset"))


def features(series: DataFrame, best: DataFrame, pixels: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """series_id, global_view, local_view, centroid_offset (null without pixels).

    Views meet as means of the bins that have rows, and become whole arrays after. With ``rows``, how many there are at most,
    they are dealt by series to tasks of about DEALT rows, so that a task's memory does not grow with the table; one exchange
    then serves both views and the window, and ``best`` is worked out once.
    """
    phased = folded(series, best).select("series_id", "phase", "flux")
    if rows is not None:
        phased = phased.repartition(max(1, -(-rows // DEALT)), "series_id")
    window = transit_window(phased)
    local = bin_means(local_segment(phased, window), LOCAL_BINS, "_local")
    both = bin_means(phased, GLOBAL_BINS, "_global").join(local, "series_id")
    out = both.select("series_id", dense("_global", GLOBAL_BINS).alias("global_view"), dense("_local", LOCAL_BINS).alias("local_view"))
    if pixels is None:
        return out.withColumn("centroid_offset", F.lit(None).cast("double"))
    return out.join(centroid_offset(pixels, best, window), "series_id", "left")
