"""Column expressions: identifiers, gates, scores, phases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stages in order, statuses, profiles (period range, grid size, thresholds, weights).
STAGES = ["phase1", "phase2", "phase3", "predict", "DONE"]
TOO_SHORT = "ERROR: Empty or too short light curve"


def normalize_id(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.trim(c)), "^TIC", ""))


def canonical_id(c: Column) -> Column:
    return F.when(F.upper(c).startswith("TIC"), c).otherwise(F.concat(F.lit("TIC "), c))


def safe_key(c: Column) -> Column:
    return F.translate(c, "/ ", "__")


def fixed(c: Column, digits: int) -> Column:
    """``c`` with so many decimal places, rounded by its exact binary value as in C and Python (0.075 is 0.07): the %.2f of
    format_string rounds the shortest decimal text instead, up where that ends in 5. Infinities and NaN are inf, -inf and nan."""
    told = F.call_function("format_number", c, F.lit("0." + "0" * digits))
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(told)


def stage1_key(series: Column, sector: Column) -> Column:
    return safe_key(F.concat_ws("_", series, sector, F.lit("phase1")))


def stage2_key(series: Column, sector: Column, low: Column, high: Column, periods: Column) -> Column:
    """``low`` and ``high`` as doubles, whose text has a decimal point at least."""
    return safe_key(F.concat_ws("_", series, sector, low.cast("string"), high.cast("string"), periods.cast("string"), F.lit("phase2")))


def stage3_key(series: Column, sector: Column, period: Column) -> Column:
    return F.md5(F.format_string("%s_%s_%s_phase3", series, sector, fixed(period, 6)))


def sector_label(sector: Column) -> Column:
    return F.coalesce(sector.cast("string"), F.lit("all"))


def log_name(sector: Column) -> Column:
    return F.concat(F.lit("s"), F.lpad(sector.cast("string"), 3, "0"))


def fold_phase(t: Column, period: Column, epoch: Column) -> Column:
    """In [0, 1), also for times before the epoch."""
    return F.pmod(t - epoch, period) / period


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def centroid_or_zero(c: Column) -> Column:
    return F.when(is_missing(c), 0.0).otherwise(c)


def sanitize_error(c: Column) -> Column:
    return F.substring(F.translate(c, ",\n", "; "), 1, 200)


def length_status(n: Column, least: int = 50) -> Column:
    return F.when(n < least, TOO_SHORT)


def power_status(power: Column, threshold: Column | float) -> Column:
    return F.when(power < threshold, "NO_SIGNAL")


def assign_status(prob: Column, threshold: Column | float) -> Column:
    return F.when(prob >= threshold, F.format_string("CANDIDATE (%s)", fixed(prob, 2))).otherwise("CLEARED")


def is_candidate(status: Column) -> Column:
    return F.coalesce(status.startswith("CANDIDATE"), F.lit(False))


def niche_bonus(profile: Column, power: Column, prob: Column) -> Column:
    return (
        F.when(profile == "ultra_short_period", F.when(power > 0.003, 0.8).otherwise(0.3))
        .when(profile == "single_transit_long_period", 0.9)
        .when(profile == "low_snr_m_dwarf", F.when(prob > 0.6, 0.7).otherwise(0.3))
        .otherwise(0.5)
    )


def candidate_score(prob: Column, power: Column, centroid: Column, profile: Column, weights: Column) -> Column:
    """Weighted parts, capped at 1 and rounded to 4 digits. ``weights`` is a struct; a missing centroid counts 0.5."""
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), prob))
    near = F.when(is_missing(centroid), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - centroid / 5))
    total = (
        weights["prob_planet"] * clamp
        + weights["bls_power"] * F.least(power / 0.01, F.lit(1.0))
        + weights["centroid"] * near
        + weights["niche_bonus"] * niche_bonus(profile, power, prob)
    )
    return F.round(F.least(total, F.lit(1.0)), 4)


def log_period(i: Column, low: float, high: float, n: int) -> Column:
    """The i-th of n log-spaced periods, rounded so that engines agree."""
    from math import log

    return F.round(F.exp(F.lit(log(low)) + i * ((log(high) - log(low)) / (n - 1))), 9)


def audit_timestamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
