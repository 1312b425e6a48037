"""Checks that tell a planet's dips from other signals: depth and noise, odd against even, a second dip, data quality.

All take series (series_id, t, flux) and ``best`` (series_id, best_period, and best_bin or epoch). A transit's box is
``width`` periods long. It begins where bin ``best_bin`` of the search does, which counts phases from time 0; the search's
own epoch counts the bin from a series' first time, and so names another moment. Where ``best`` has no bins, its epoch is
taken as the time at which a box begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.operators.search import BINS as SEARCH_BINS

WIDTH = 0.05  # of a box, in periods: one of the search's 20 bins
SNR_GATE = 7.1  # fixed value: least signal-to-noise ratio of a detection
MAD_TO_SIGMA = 1.4826  # of normal noise
BINS, SPAN = 100, 5  # phase bins of the second dip's search, and neighbouring ones of a window
PARITY_GATE, SECOND_GATE = 3.0, 7.1
#: Weights of the four quality scores in the overall one.
QUALITY_WEIGHTS = {"completeness": 0.3, "noise_level": 0.3, "max_gap": 0.2, "systematic_errors": 0.2}


def _phased(series: DataFrame, best: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Good rows with ``turns``, periods since the epoch; ``transit``, their whole number; ``phase``, the rest; and best's ``keep``."""
    start = F.col("best_bin") / SEARCH_BINS * F.col("best_period") if "best_bin" in best.columns else F.col("epoch")
    rows = series.where("flux is not null and not isnan(flux) and t is not null").join(best.select("series_id", "best_period", start.alias("_start"), *(c for c in keep if c != "best_period")), "series_id")
    turns = (F.col("t") - F.col("_start")) / F.col("best_period")
    rows = rows.where("best_period > 0").withColumn("turns", turns).withColumn("transit", F.floor("turns"))
    return rows.withColumn("phase", F.col("turns") - F.col("transit"))


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0).cast("double"))


def transit_depths(series: DataFrame, best: DataFrame, width: float = WIDTH) -> DataFrame:
    """series_id, transit, n, depth: each transit's own depth, the mean outside all boxes less the mean in its box."""
    rows = _phased(series, best)
    inside = F.col("phase") < width
    per = rows.groupBy("series_id", F.when(inside, F.col("transit")).alias("transit")).agg(F.count("*").alias("n"), F.sum("flux").alias("s"))
    level = F.max(F.when(F.col("transit").isNull(), F.col("s") / F.col("n"))).over(Window.partitionBy("series_id"))
    return per.withColumn("depth", level - F.col("s") / F.col("n")).where("transit is not null").select("series_id", "transit", "n", "depth")


def odd_even(series: DataFrame, best: DataFrame, width: float = WIDTH, gate: float = PARITY_GATE) -> DataFrame:
    """Whether odd and even transits are equally deep; two stars that eclipse each other are not, if the period is half theirs.

    series_id, n_odd, n_even (rows), transits_odd, transits_even, depth_odd, depth_even, ratio (the shallower over the
    deeper), z, flagged. ``z`` is the difference over its standard error, Welch's test of rows in odd and even boxes, null
    where one side has fewer than 2 rows or both have no spread. Sums meet by (series, transit) before the series.
    """
    rows = _phased(series, best)
    inside = F.col("phase") < width
    # About the series' first value, so that squares of a large constant flux don't swamp the spread.
    base = series.where("flux is not null and not isnan(flux) and t is not null").groupBy("series_id").agg(F.min_by("flux", F.struct("t", "flux")).alias("_base"))
    rows = rows.join(base, "series_id").withColumn("_y", F.col("flux") - F.col("_base"))
    per = rows.groupBy("series_id", F.when(inside, F.col("transit")).alias("transit")).agg(
        F.count("*").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("ss")
    )
    side = F.when(F.col("transit").isNull(), "out").when(F.pmod(F.col("transit"), F.lit(2)) == 1, "odd").otherwise("even")
    pick = lambda name, c: F.sum(F.when(side == name, F.col(c)))
    sums = [pick(name, c).alias(f"{c}_{name}") for name in ("odd", "even", "out") for c in ("n", "s", "ss")]
    counts = [F.count_if(side == name).alias(f"transits_{name}") for name in ("odd", "even")]
    told = per.groupBy("series_id").agg(*sums, *counts)

    def variance(name: str) -> Column:  # of the side's mean
        n, s, ss = (F.col(f"{c}_{name}") for c in ("n", "s", "ss"))
        return F.when(n >= 2, F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0)) / n)

    told = told.withColumns({f"depth_{x}": F.col("s_out") / F.col("n_out") - F.col(f"s_{x}") / F.col(f"n_{x}") for x in ("odd", "even")})
    odd, even = F.col("depth_odd"), F.col("depth_even")
    z = _over(F.abs(odd - even), F.sqrt(variance("odd") + variance("even")))
    ratio = _over(F.least(odd, even), F.greatest(odd, even))
    return told.select(
        "series_id", F.coalesce("n_odd", F.lit(0)).alias("n_odd"), F.coalesce("n_even", F.lit(0)).alias("n_even"), "transits_odd", "transits_even", "depth_odd", "depth_even",
        F.when(odd.isNotNull() & even.isNotNull(), ratio).alias("ratio"), z.alias("z"), F.coalesce(z > gate, F.lit(False)).alias("flagged"),
    )


def secondary_eclipse(
    series: DataFrame, best: DataFrame, width: float = WIDTH, *, mask: float = 2.0, bins: int = BINS, span: int = SPAN, gate: float = SECOND_GATE
) -> DataFrame:
    """The deepest dip away from the transit, wherever it is in phase: an orbit need not be round, so not at 0.5 only.

    Rows within ``mask`` box widths around the box's middle are left out. What is left is binned by phase, and a window
    of ``span`` neighbouring bins goes around the circle: bins stand a second time after the last one, for the window's
    frame. The best window is that of most significance, the first of equal ones.

    series_id, phase (of the window's middle, from the transit's middle), n_in, depth, snr, ratio (of the depth to the
    transit's), flagged. Windows need 2 rows and 2 outside; a series without such a window, or without spread, has no row.
    """
    rows = _phased(series, best)
    middle = F.pmod(F.col("phase") - width / 2, F.lit(1.0))  # from the transit's middle
    near = F.least(middle, 1 - middle) < mask * width / 2
    kind = F.when(F.col("phase") < width, F.lit("box")).when(near, F.lit("mask"))
    cell = F.when(~near, F.least(F.floor(middle * bins), F.lit(bins - 1)).cast("int"))
    per = rows.groupBy("series_id", F.when(near, kind).alias("kind"), cell.alias("bin")).agg(F.count("*").alias("n"), F.sum("flux").alias("s"), F.sum(F.col("flux") * F.col("flux")).alias("ss"))
    whole = Window.partitionBy("series_id")
    rest = F.col("kind").isNull()
    total = {f"_{c}": F.sum(F.when(rest, F.col(c))).over(whole) for c in ("n", "s", "ss")}
    box = {f"_{c}_box": F.sum(F.when(F.col("kind") == "box", F.col(c))).over(whole) for c in ("n", "s")}
    per = per.withColumns({**total, **box}).where(rest)
    twice = per.withColumn("bin", F.explode(F.array("bin", F.col("bin") + bins)))
    frame = Window.partitionBy("series_id").orderBy("bin").rangeBetween(0, span - 1)
    # A window may begin in an empty bin: windows are looked at by their last bin that has rows, and by their first.
    window = twice.withColumns({"n_in": F.sum("n").over(frame), "s_in": F.sum("s").over(frame), "last": F.max("bin").over(frame)}).where(F.col("bin") < bins)
    n_out = F.col("_n") - F.col("n_in")
    depth = (F.col("_s") - F.col("s_in")) / n_out - F.col("s_in") / F.col("n_in")
    spread = F.sqrt(F.greatest((F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n")) / F.nullif(F.col("_n") - 1, F.lit(0)), F.lit(0.0)))
    snr = F.round(_over(depth, spread * F.sqrt(1 / F.col("n_in") + 1 / n_out)), 9)
    told = window.where((F.col("n_in") >= 2) & (F.col("_n") - F.col("n_in") >= 2)).withColumns({"depth": depth, "snr": snr}).where("snr is not null")
    primary = F.col("_s") / F.col("_n") - F.col("_s_box") / F.col("_n_box")
    phase = F.pmod((F.col("bin") + F.col("last") + 1) / (2 * bins), F.lit(1.0))
    top = told.withColumns({"phase": phase, "ratio": _over(F.col("depth"), primary)})
    found = top.groupBy("series_id").agg(F.max_by(F.struct("phase", "n_in", "depth", "snr", "ratio"), F.struct("snr", -F.col("bin"))).alias("x"))
    return found.select("series_id", "x.*", (F.col("x.snr") > gate).alias("flagged"))


def depth_snr(series: DataFrame, best: DataFrame, width: float = WIDTH, gate: float = SNR_GATE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Depth of the transit and its signal-to-noise ratio with a robust noise.

    series_id, n_in, depth (median outside less the mean inside), noise (1.4826 times the median absolute deviation
    outside), snr (depth over noise, times the root of the rows inside), transits (that have rows), detected. ``series``
    is to be detrended. Null where a side has no rows; no ratio without noise. Columns of ``best`` in ``keep`` come along,
    so that a search need not run again for a join with it.
    """
    rows = _phased(series, best, keep).withColumn("_in", F.col("phase") < width)
    level = F.median(F.when(~F.col("_in"), F.col("flux"))).over(Window.partitionBy("series_id"))
    rows = rows.withColumn("_level", level)
    told = rows.groupBy("series_id").agg(
        F.count_if("_in").alias("n_in"), (F.max("_level") - F.avg(F.when(F.col("_in"), F.col("flux")))).alias("depth"),
        (F.median(F.when(~F.col("_in"), F.abs(F.col("flux") - F.col("_level")))) * MAD_TO_SIGMA).alias("noise"), F.count_distinct(F.when(F.col("_in"), F.col("transit"))).alias("transits"),
        *(F.first(c).alias(c) for c in keep),
    )
    snr = _over(F.col("depth"), F.col("noise")) * F.sqrt("n_in")
    return told.select("series_id", *keep, "n_in", "depth", "noise", snr.alias("snr"), "transits", F.coalesce(snr > gate, F.lit(False)).alias("detected"))


def series_quality(series: DataFrame) -> DataFrame:
    """What a series' rows are worth, by one ordered pass over it.

    series_id, n, span, cadence (the median step in time), completeness (rows over those that the span has room for at
    that step, at most 1), largest_gap (in steps), noise (the root mean square of steps in flux over the root of 2, as a
    share of the mean), slope (of flux in time, over the span, as a share of the mean), and four scores in 0..1 with their
    weighted ``overall_score``. A single row has no step: it is complete, without gap and noise.
    """
    order = Window.partitionBy("series_id").orderBy("t", "flux")
    good = series.where("flux is not null and not isnan(flux) and t is not null")
    rows = good.withColumns({"_dt": F.col("t") - F.lag("t").over(order), "_df": F.col("flux") - F.lag("flux").over(order)})
    told = rows.groupBy("series_id").agg(
        F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), F.median("_dt").alias("cadence"), F.max("_dt").alias("gap"), F.avg("flux").alias("mean"),
        F.sqrt(F.avg(F.col("_df") * F.col("_df")) / 2).alias("jump"), F.regr_slope("flux", "t").alias("slope"), F.stddev_pop("flux").alias("sd"),
    )
    room = F.col("span") / F.nullif("cadence", F.lit(0.0)) + 1
    told = told.withColumns({
        "completeness": F.least(F.coalesce(F.col("n") / room, F.lit(1.0)), F.lit(1.0)), "largest_gap": F.coalesce(_over(F.col("gap"), F.col("cadence")), F.lit(0.0)),
        "noise": F.coalesce(F.abs(_over(F.col("jump"), F.col("mean"))), F.lit(0.0)), "slope": F.coalesce(F.abs(_over(F.col("slope") * F.col("span"), F.col("mean"))), F.lit(0.0)),
    })
    # A gap of one step is no gap; noise and slope as large as the mean itself leave nothing.
    scores = {
        "completeness_score": F.col("completeness"), "gap_score": 1 / F.greatest(F.col("largest_gap"), F.lit(1.0)),
        "noise_score": F.greatest(1 - F.col("noise"), F.lit(0.0)), "systematics_score": F.greatest(1 - F.col("slope"), F.lit(0.0)),
    }
    told = told.withColumns(scores)
    overall = overall_quality(F.col("completeness_score"), F.col("noise_score"), F.col("gap_score"), F.col("systematics_score"))
    return told.select("series_id", "n", "span", "cadence", "completeness", "largest_gap", "noise", "slope", *scores, overall.alias("overall_score"))


def overall_quality(completeness: Column, noise_level: Column, max_gap: Column, systematic_errors: Column) -> Column:
    w = QUALITY_WEIGHTS
    return w["completeness"] * completeness + w["noise_level"] * noise_level + w["max_gap"] * max_gap + w["systematic_errors"] * systematic_errors


#: Names of the scalars that a tree model learns from.
TABULAR = ["bls_power", "period", "transit_depth", "snr", "transit_duration", "odd_even_ratio", "secondary_eclipse", "stellar_variability", "data_quality", "observation_count"]


def tabular_features(series: DataFrame, best: DataFrame, width: float = WIDTH) -> DataFrame:
    """series_id and the ten scalars of TABULAR, missing ones null; ``best`` also has max_power."""
    noise = depth_snr(series, best, width).select("series_id", F.col("depth").alias("transit_depth"), "snr")
    parity = odd_even(series, best, width).select("series_id", F.col("ratio").alias("odd_even_ratio"))
    second = secondary_eclipse(series, best, width).select("series_id", F.col("ratio").alias("secondary_eclipse"))
    rows = _phased(series, best)
    spread = rows.where(F.col("phase") >= width).groupBy("series_id").agg(_over(F.stddev_pop("flux"), F.abs(F.avg("flux"))).alias("stellar_variability"))
    quality = series_quality(series).select("series_id", F.col("overall_score").alias("data_quality"), F.col("n").alias("observation_count"))
    out = best.select("series_id", F.col("max_power").alias("bls_power"), F.col("best_period").alias("period"), (F.col("best_period") * width).alias("transit_duration"))
    for more in (noise, parity, second, spread, quality):
        out = out.join(more, "series_id", "left")
    return out.select("series_id", *(F.col(c).cast("double").alias(c) for c in TABULAR))
