"""Running sums over a whole table in order of a number, without a window over all rows.

Rows are cut into ranges by bounds from a sample of them; ranges' sums give each range its start, and windows run
within ranges. Bounds are pairs of the number and of what orders its ties, so that many rows of one number are cut too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 16  # ranges are STEPS * STEPS
SAMPLE = 4_096  # rows, those of least hash


def _order(by: str, then: list) -> Column:
    """Ascending in this is descending in ``by`` (nulls last, NaN first), then ascending in ``then``."""
    x = F.col(by).cast("double")
    return F.struct(x.isNull().alias("a"), (~F.coalesce(F.isnan(x), F.lit(False))).alias("b"), F.when(~F.isnan(x), -x).alias("c"), *(F.col(t).alias(f"d{i}") if isinstance(t, str) else t.alias(f"d{i}") for i, t in enumerate(then)))


def running(rows: DataFrame, by: str, sums: dict[str, Column], then: list | None = None) -> DataFrame:
    """``rows`` plus each of ``sums`` summed over all rows up to this one, in descending order of ``by`` (nulls
    last), then of ``then``; rows that tie in all of it count up to the last of them if ``then`` is not given."""
    keyed = rows.withColumn("_at", _order(by, then or []))
    some = keyed.select("_at").orderBy(F.xxhash64("_at")).limit(SAMPLE).agg(F.array_sort(F.collect_list("_at")).alias("s"))
    n = STEPS * STEPS
    cuts = some.select(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / n).cast("int"))).alias("cuts"))
    coarse = cuts.select(F.filter("cuts", lambda _, i: (i + 1) % STEPS == 0)).scalar()
    # The range is the number of bounds at or before the row: whole steps first, then those of one step.
    dealt = keyed.withColumns({"_cuts": cuts.scalar(), "_coarse": coarse})
    passed = lambda c: F.coalesce(F.size(F.filter(c, lambda b: b <= F.col("_at"))), F.lit(0))
    dealt = dealt.withColumn("_step", passed(F.col("_coarse")))
    fine = F.slice("_cuts", F.col("_step") * STEPS + 1, F.lit(STEPS - 1))
    dealt = dealt.withColumn("_range", F.col("_step") * STEPS + passed(fine)).drop("_cuts", "_coarse", "_step")
    own = {f"_sum{i}": x for i, x in enumerate(sums.values())}
    dealt = dealt.withColumns(own)
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most STEPS * STEPS rows
    starts = dealt.groupBy("_range").agg(*(F.sum(c).alias(c) for c in own)).select("_range", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_start") for c in own))
    within = Window.partitionBy("_range").orderBy("_at")
    within = within.rowsBetween(Window.unboundedPreceding, 0) if then else within
    out = dealt.join(F.broadcast(starts), "_range").withColumns({n: F.sum(c).over(within) + F.col(f"{c}_start") for n, c in zip(sums, own, strict=True)})
    return out.drop("_range", "_at", *own, *(f"{c}_start" for c in own))
