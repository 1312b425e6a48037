"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from math import log

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.functions import views as V
from undertow.operators import catalog, clean, fold, metrics, ml, search
from undertow.plans import pipelines
from undertow.sources import adapters as A
from undertow.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOW, HIGH, N = 1.0, 15.0, 200
CAD = (
    "cadence AS (SELECT CAST(user_id AS VARCHAR) series_id, CAST(list_position(['click','error','purchase','signup','view'], event_type) AS INT) sector, "
    "(epoch_us(ts) - 1704067200000000) / 86400e6 t, value flux FROM events)"
)
EV = (
    "evidence AS (SELECT CAST(c_custkey AS VARCHAR) tic_id, (c_custkey*37%1000)/100.0+0.5 best_period, (c_custkey*7919%1000)/1000.0+CAST(0.000003 AS DOUBLE) prob_planet, "
    "(c_custkey*31%200)/10000.0 bls_power, CASE WHEN c_custkey%7<>0 THEN (c_custkey*13%80)/10.0 END centroid_offset, "
    "CASE c_custkey%3 WHEN 0 THEN 'KNOWN' WHEN 1 THEN 'NEW_CANDIDATE' END discovery_status, "
    "['balanced','ultra_short_period','single_transit_long_period','low_snr_m_dwarf','other'][c_custkey%5+1] profile FROM customer)"
)
PROG = (
    "progress AS (SELECT CAST(user_id AS VARCHAR) tic_id, CASE event_type WHEN 'click' THEN 'phase1' WHEN 'view' THEN 'phase2' WHEN 'signup' THEN 'phase3' "
    "WHEN 'purchase' THEN 'predict' ELSE 'DONE' END last_stage, CASE WHEN event_type <> 'error' THEN 'IN_PROGRESS' WHEN value >= 60 THEN printf('CANDIDATE (%.2f)', value/1000) ELSE 'CLEARED' END status, "
    "ts updated_at, event_id seq FROM events), latest AS (SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY updated_at DESC, seq DESC) = 1)"
)
LAB = "scored AS (SELECT l.doc_id id, l.quality label, (n_chars % 1000)/1000.0 score FROM labels l JOIN documents d USING (doc_id))"


def _grid(n: int, low: float = LOW, high: float = HIGH) -> str:
    return f"SELECT CAST(i AS INT) pid, round(exp({log(low)!r} + i * {(log(high) - log(low)) / (n - 1)!r}), 9) period FROM range({n}) r(i)"


def _boxes(grid: str, name: str = "", bins: int = 20, source: str = "cadence", on: str = "", where: str = "") -> str:
    return (
        f"grid{name} AS ({grid}), fold{name} AS (SELECT c.series_id, pid, period, CAST(floor((t % period) / period * {bins}) AS INT) bin, count(*) n_in, sum(flux) s_in FROM {source} c JOIN grid{name} g ON {on or 'true'} GROUP BY ALL), "
        f"tot{name} AS (SELECT series_id, count(flux) n, sum(flux) s, sum(flux*flux) ss, min(t) t0 FROM {source} GROUP BY 1), "
        f"raw{name} AS (SELECT f.*, n, s, ss, t0, CASE WHEN n_in >= 2 AND n - n_in >= 2 THEN (s - s_in)/(n - n_in) - s_in/n_in ELSE 0.0 END depth FROM fold{name} f JOIN tot{name} USING (series_id) {where}), "
        f"box{name} AS (SELECT *, depth*depth*n_in*(n-n_in)/n AS power, round(CASE WHEN ss - s*s/n > 0 THEN depth*depth*n_in*(n-n_in)/n/(ss - s*s/n) ELSE 0.0 END, 9) share FROM raw{name}), "
        f"best{name} AS (SELECT series_id, period best_period, t0 + bin/{bins}.0*period epoch, power max_power, bin best_bin FROM box{name} QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY share DESC, period, bin) = 1)"
    )


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _best(spark: SparkSession, sf: str) -> DataFrame:
    return search.single_pass(A.cadence(spark, sf), LOW, HIGH, N)


_BEST_OUT = "SELECT series_id, round(best_period,6) best_period, round(epoch,6) epoch, round(max_power,3) max_power, best_bin FROM best"


def _refine(n: int, best: str = "best") -> str:
    lo, hi = "greatest(1.0, best_period*0.85)", "least(15.0, best_period*1.15)"
    return f"SELECT series_id, CAST(i AS INT) pid, round({lo} + i*({hi} - {lo})/{n - 1}, 9) period FROM {best}, range({n}) r(i)"


_REFINE_SQL = _refine(40)
_FULL = f"{_boxes(_grid(2000))}, {_boxes(_refine(3000), '2', on='c.series_id = g.series_id')}"


# --- search
@query(f"WITH {CAD}, {_boxes(_grid(N))}, c AS (SELECT series_id, count(*) n FROM cadence GROUP BY 1) SELECT series_id, n, CASE WHEN n < 50 THEN '{S.TOO_SHORT}' WHEN max_power < 1000 THEN 'NO_SIGNAL' ELSE 'CLEARED' END status, round(best_period,6) best_period, round(epoch,6) epoch, round(max_power,3) max_power FROM best JOIN c USING (series_id)")
def best_period(spark: SparkSession, sf: str) -> DataFrame:
    n = A.cadence(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"))
    status = F.coalesce(S.length_status(F.col("n")), S.power_status(F.col("max_power"), 1000.0), F.lit("CLEARED"))
    out = _best(spark, sf).join(n, "series_id").select("series_id", "n", status.alias("status"), "best_period", "epoch", "max_power")
    return _r(out, best_period=6, epoch=6, max_power=3)


@query(f"WITH {CAD}, grid AS ({_grid(N)}), sp AS (SELECT series_id, max(t) - min(t) span FROM cadence GROUP BY 1) SELECT series_id, pid, period FROM sp JOIN grid ON period <= span / 3")
def period_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The trial periods that each series' time span holds three times."""
    spans = A.cadence(spark, sf).groupBy("series_id").agg((F.max("t") - F.min("t")).alias("span"))
    grid = F.broadcast(search.period_grid(spark, LOW, HIGH, N))
    return spans.join(grid, F.col("period") <= F.col("span") / 3).select("series_id", "pid", "period")


@query(f"WITH {CAD}, {_boxes(_grid(60))}, d AS (SELECT b.series_id, x.bin, row_number() OVER (PARTITION BY b.series_id ORDER BY round(x.depth, 9) DESC, x.bin) k FROM best b JOIN box x ON x.series_id = b.series_id AND x.period = b.best_period AND x.n_in >= 2) SELECT b.series_id, round(best_period,6) best_period, round(tot.t0 + coalesce(d.bin/20.0, 0.5)*best_period, 6) epoch, round(max_power,3) max_power, best_bin FROM best b JOIN tot USING (series_id) LEFT JOIN d ON d.series_id = b.series_id AND d.k = 1")
def epoch_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    return _r(search.single_pass(A.cadence(spark, sf), LOW, HIGH, 60, epoch_by="depth"), best_period=6, epoch=6, max_power=3)


@query(f"WITH {CAD}, {_boxes(_grid(20))}, u AS (SELECT series_id, pid, bin, n_in, n, (s - s_in)/(n - n_in + 1e-10) - s_in/(n_in + 1e-10) d FROM raw) SELECT series_id, pid, bin, n_in, round(d, 4) AS depth, round(CASE WHEN d > 0 THEN d*d*n_in*(n-n_in)/(n + 1e-10) ELSE 0.0 END, 2) AS power FROM u")
def box_power_unguarded(spark: SparkSession, sf: str) -> DataFrame:
    boxes = search.box_power(A.cadence(spark, sf), search.period_grid(spark, LOW, HIGH, 20), guard=False, dips_only=True)
    return _r(boxes.select("series_id", "pid", "bin", "n_in", "depth", "power"), depth=4, power=2)


_STAGE = (
    "WITH " + CAD.replace("cadence AS", "whole AS") + ", cadence AS (SELECT sector || '|' || series_id AS series_id, sector, t, flux FROM whole WHERE NOT (sector = 1 AND CAST(series_id AS INT) % 2 = 0)), "
    f"{_boxes(_grid(60))}, {_boxes(_REFINE_SQL, '2', on='c.series_id = g.series_id')}"
)


@query(f"{_STAGE} SELECT series_id, 1 AS sector, round(min(t),6) best_period, round(max(t),6) epoch, round(avg(flux),3) max_power FROM whole WHERE sector = 1 AND CAST(series_id AS INT) % 2 = 0 GROUP BY 1 UNION ALL SELECT split_part(series_id,'|',2), CAST(split_part(series_id,'|',1) AS INT), round(best_period,6), round(epoch,6), round(max_power,3) FROM best2")
def search_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Sector 1 of the even series is stored; odd series have stored rows of another search, which don't count."""
    c, cfg = A.cadence(spark, sf), pipelines.Config(low=LOW, high=HIGH, coarse=60, refine=40)
    first = c.where("sector = 1").groupBy("series_id", "sector").agg(F.min("t").alias("best_period"), F.max("t").alias("epoch"), F.avg("flux").alias("max_power"))
    even = F.col("series_id").cast("int") % 2 == 0
    stored = first.withColumns({"period_min": F.lit(LOW), "period_max": F.when(even, HIGH).otherwise(2.0), "nperiods": F.lit(100)})
    return _r(pipelines.search_stage(c, stored, cfg).select("series_id", "sector", "best_period", "epoch", "max_power"), best_period=6, epoch=6, max_power=3)


_REFINE = _REFINE_SQL
_TWO = f"WITH {CAD}, {_boxes(_grid(60))}, {_boxes(_REFINE, '2', on='c.series_id = g.series_id')}"


@query(f"WITH {CAD}, {_boxes(_grid(60))} SELECT series_id, pid, round(period, 6) period FROM ({_REFINE})")
def refine_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _r(search.refine_grid(search.single_pass(A.cadence(spark, sf), LOW, HIGH, 60), LOW, HIGH, 40), period=6)


@query(f"{_TWO} SELECT series_id, round(best_period,6) best_period, round(epoch,6) epoch, round(max_power,3) max_power, best_bin FROM best2")
def two_pass_sql(spark: SparkSession, sf: str) -> DataFrame:
    return _r(search.two_pass(A.cadence(spark, sf), LOW, HIGH, coarse=60, refine=40, form="sql"), best_period=6, epoch=6, max_power=3)


@query(f"{_TWO} SELECT series_id, round(best_period,6) best_period, round(epoch,6) epoch, round(max_power,3) max_power, best_bin FROM best2")
def two_pass_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return _r(search.two_pass(A.cadence(spark, sf), LOW, HIGH, coarse=60, refine=40), best_period=6, epoch=6, max_power=3)


@query(f"WITH {CAD}, {_FULL} SELECT series_id, round(best_period,6) best_period, round(epoch,6) epoch, round(max_power,3) max_power, best_bin FROM best2")
def two_pass_full(spark: SparkSession, sf: str) -> DataFrame:
    """Full grids: 2000 and 3000 periods."""
    return _r(search.two_pass(A.cadence(spark, sf), LOW, HIGH), best_period=6, epoch=6, max_power=3)


@query(f"{_TWO} SELECT 'coarse' AS pass, series_id, pid, round(period,6) period, round(ln(1 + max(power)),6) log_power FROM box GROUP BY ALL UNION ALL SELECT 'refine', series_id, pid, round(period,6), round(ln(1 + max(power)),6) FROM box2 GROUP BY ALL")
def merged_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Powers by their logarithm: many are short decimals, and so ties when they are rounded."""
    rows = search.merged_spectrum(A.cadence(spark, sf), LOW, HIGH, 60, 40)
    return rows.select("pass", "series_id", "pid", F.round("period", 6).alias("period"), F.round(F.log1p("power"), 6).alias("log_power"))


@query(f"WITH {CAD}, {_boxes(_grid(60), where='WHERE bin < 19')} {_BEST_OUT}")
def last_window_off(spark: SparkSession, sf: str) -> DataFrame:
    return _r(search.single_pass(A.cadence(spark, sf), LOW, HIGH, 60, last_window=False), best_period=6, epoch=6, max_power=3)


@query(f"WITH {CAD}, grid AS ({_grid(20)}), f AS (SELECT series_id, pid, period, CAST(floor((t % period)/period*20) AS INT) bin, count(*) n_in, sum(flux) s_in FROM cadence, grid GROUP BY ALL), w AS (SELECT series_id, pid, period, (bin - d + 20) % 20 bin, sum(n_in) n_in, sum(s_in) s_in FROM f, range(3) r(d) GROUP BY ALL), tot AS (SELECT series_id, count(*) n, sum(flux) s FROM cadence GROUP BY 1) SELECT series_id, pid, CAST(bin AS INT) bin, CAST(n_in AS BIGINT) n_in, round(CASE WHEN n_in>=2 AND n-n_in>=2 THEN ((s-s_in)/(n-n_in)-s_in/n_in)**2*n_in*(n-n_in)/n ELSE 0 END + 0.00123, 2) power FROM w JOIN tot USING (series_id)")
def box_power_wide(spark: SparkSession, sf: str) -> DataFrame:
    boxes = search.box_power(A.cadence(spark, sf), search.period_grid(spark, LOW, HIGH, 20), width=3)
    return boxes.select("series_id", "pid", "bin", "n_in", F.round(F.col("power") + 0.00123, 2).alias("power"))


@query(f"WITH {CAD}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 k, count(*) OVER (PARTITION BY series_id) n FROM cadence) SELECT series_id, t, flux FROM n WHERE n <= 60 OR k IN (SELECT round_even(i*(n-1)/59.0, 0) FROM range(60) r(i))")
def downsample(spark: SparkSession, sf: str) -> DataFrame:
    return search.downsample(A.cadence(spark, sf).select("series_id", "t", "flux"), 60)


@query(f"WITH {CAD} SELECT series_id, count(*) FILTER (t % 1 < 0.25) n_in, count(*) FILTER (t % 1 >= 0.25) n_out, round(avg(flux) FILTER (t % 1 < 0.25), 6) mean_in, round(avg(flux) FILTER (t % 1 >= 0.25), 6) mean_out FROM cadence GROUP BY 1")
def in_out_means(spark: SparkSession, sf: str) -> DataFrame:
    return _r(search.in_out_means(A.cadence(spark, sf), F.col("t") % 1 < 0.25), mean_in=6, mean_out=6)


# --- cleaning
_M = 10
_ROLL = f"k AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t) AS DOUBLE) k, avg(flux) OVER (PARTITION BY series_id) m, count(*) OVER (PARTITION BY series_id) n FROM cadence), s AS (SELECT *, sum(flux-m) OVER w s0, sum(k*(flux-m)) OVER w s1, sum(k*k*(flux-m)) OVER w s2 FROM k WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {_M} PRECEDING AND {_M} FOLLOWING)), tr AS (SELECT *, CASE WHEN k > {_M} AND k <= n-{_M} THEN ({3 * (3 * _M * _M + 3 * _M - 1)}*s0 - 15*(s2 - 2*k*s1 + k*k*s0))/{(2 * _M - 1) * (2 * _M + 1) * (2 * _M + 3)}.0 + m END trend FROM s)"


@query(f"WITH {CAD}, {_ROLL} SELECT series_id, round(t,6) t, round(trend,5) trend FROM tr")
def rolling_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _r(clean.rolling_trend(A.cadence(spark, sf), _M).select("series_id", "t", "trend"), t=6, trend=5)


@query(f"WITH {CAD}, {_ROLL}, e AS (SELECT series_id, median(flux) med, regr FROM (SELECT series_id, flux, 0 regr FROM cadence) GROUP BY ALL) SELECT series_id, round(t,6) t, round(flux/nullif(trend,0),4) flux FROM tr WHERE trend IS NOT NULL")
def detrend_inner(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.detrend(A.cadence(spark, sf).select("series_id", "t", "flux"), _M)
    inner = clean.rolling_trend(A.cadence(spark, sf), _M).where("trend is not null").select("series_id", "t")
    return _r(rows.join(inner, ["series_id", "t"]).select("series_id", "t", "flux"), t=6, flux=4)


@query(f"WITH {CAD}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) dt FROM cadence), m AS (SELECT series_id, median(dt) md FROM d GROUP BY 1) SELECT series_id, round(t,6) t, CAST(sum(coalesce(CAST(dt > 3*md AS INT),0)) OVER (PARTITION BY d.series_id ORDER BY t) AS BIGINT) segment FROM d JOIN m USING (series_id)")
def gap_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _r(clean.gap_segments(A.cadence(spark, sf), 3.0).select("series_id", "t", "segment"), t=6)


def _clip(rounds: int, sigma: float) -> str:
    out, last = "", "cadence"
    for i in range(rounds):
        out += f", m{i} AS (SELECT series_id, median(flux) md, stddev_pop(flux) sd FROM {last} GROUP BY 1), c{i} AS (SELECT x.* FROM {last} x JOIN m{i} USING (series_id) WHERE abs(flux-md) <= {sigma}*sd)"
        last = f"c{i}"
    return f"WITH {CAD}{out} SELECT series_id, round(t,6) t, flux FROM {last}"


@query(_clip(1, 2.0))
def sigma_clip_1(spark: SparkSession, sf: str) -> DataFrame:
    return _r(clean.sigma_clip(A.cadence(spark, sf), 2.0, 1).select("series_id", "t", "flux"), t=6)


@query(_clip(2, 2.0))
def sigma_clip_2(spark: SparkSession, sf: str) -> DataFrame:
    return _r(clean.sigma_clip(A.cadence(spark, sf), 2.0, 2).select("series_id", "t", "flux"), t=6)


_SEG = "dt AS (SELECT *, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) dt FROM cadence), md AS (SELECT *, median(dt) OVER (PARTITION BY series_id) md FROM dt), seg AS (SELECT series_id, t, flux, sum(coalesce(CAST(dt > 5*md AS INT), 0)) OVER (PARTITION BY series_id ORDER BY t) seg FROM md)"


def _clip_cte(source: str, rounds: int = 5, sigma: float = 3.0) -> str:
    """c1 to c<rounds>, each the rows of the one before within sigma deviations of the median."""
    out, last = [], source
    for i in range(1, rounds + 1):
        out += [f"m{i} AS (SELECT series_id, median(flux) md, stddev_pop(flux) sd FROM {last} GROUP BY 1)", f"c{i} AS (SELECT x.series_id, t, flux FROM {last} x JOIN m{i} USING (series_id) WHERE abs(flux - md) <= {sigma}*sd)"]
        last = f"c{i}"
    return ", ".join(out)


def _trend_cte(m: int) -> str:
    """flat: flux over its trend by segment; edges by a least-squares quadratic through the outermost window."""
    n, t2, t4 = 2 * m + 1, 2 * sum(i * i for i in range(1, m + 1)), 2 * sum(i**4 for i in range(1, m + 1))
    det, w = n * t4 - t2 * t2, "PARTITION BY series_id, seg"
    sides = {"a": (f"k <= {n}", f"(k - {m + 1})"), "b": (f"k > n - {n}", f"(k - (n - {m}))")}
    moments = ", ".join(f"sum(flux*pow({x}, {p})) FILTER ({c}) OVER ({w}) {s}{p}" for s, (c, x) in sides.items() for p in (0, 1, 2))
    edge = {s: f"(({s}0*{t4} - {s}2*{t2})/{det}.0 + {s}1/{t2}.0*{x} + ({s}2*{n} - {s}0*{t2})/{det}.0*{x}*{x})" for s, (_, x) in sides.items()}
    return (
        f"k AS (SELECT *, CAST(row_number() OVER ({w} ORDER BY t) AS DOUBLE) k, avg(flux) OVER ({w}) m, count(*) OVER ({w}) n FROM seg), "
        f"s AS (SELECT *, sum(flux-m) OVER w s0, sum(k*(flux-m)) OVER w s1, sum(k*k*(flux-m)) OVER w s2 FROM k WINDOW w AS ({w} ORDER BY t ROWS BETWEEN {m} PRECEDING AND {m} FOLLOWING)), "
        f"e AS (SELECT *, median(flux) OVER ({w}) med, {moments} FROM s), "
        f"flat AS (SELECT series_id, t, flux/nullif(CASE WHEN n < {n} THEN med WHEN k <= {m} THEN {edge['a']} WHEN k > n - {m} THEN {edge['b']} "
        f"ELSE ({3 * (3 * m * m + 3 * m - 1)}*s0 - 15*(s2 - 2*k*s1 + k*k*s0))/{(2 * m - 1) * (2 * m + 1) * (2 * m + 3)}.0 + m END, 0) flux FROM e)"
    )


@query(f"WITH {CAD}, {_SEG}, {_trend_cte(_M)}, {_clip_cte('flat')} SELECT series_id, round(t,6) t, round(flux,6) flux FROM c5")
def clean_series(spark: SparkSession, sf: str) -> DataFrame:
    return _r(clean.clean_series(A.cadence(spark, sf).select("series_id", "t", "flux"), _M), t=6, flux=6)


@query(f"WITH {CAD}, d AS (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY sector) r FROM cadence), f AS (SELECT * FROM d WHERE r <= 3), m AS (SELECT series_id, sector, median(flux) md FROM f GROUP BY 1,2) SELECT series_id, 'all' sector, round(t,6) t, round(flux/nullif(md,0),6) flux FROM f JOIN m USING (series_id, sector)")
def stitch_sectors(spark: SparkSession, sf: str) -> DataFrame:
    return _r(catalog.stitch_sectors(A.cadence(spark, sf)), t=6, flux=6)


# --- folding
_FOLD = f"WITH {CAD}, {_boxes(_grid(60))}, ph AS (SELECT c.series_id, flux, t, ((t-epoch) - floor((t-epoch)/best_period)*best_period)/best_period phase FROM cadence c JOIN best USING (series_id)), mean AS (SELECT series_id, avg(flux) m FROM ph GROUP BY 1)"


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cadence(spark, sf).select("series_id", "t", "flux")
    return fold.folded(c, search.single_pass(c, LOW, HIGH, 60))


@query(f"{_FOLD} SELECT series_id, round(t,6) t, round(phase,6) % 1 phase FROM ph")
def fold_phase(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf).select("series_id", F.round("t", 6).alias("t"), (F.round("phase", 6) % 1).alias("phase"))


@query(f"{_FOLD}, b AS (SELECT series_id, CAST(floor(phase*64) AS INT) bin, avg(flux) v FROM ph GROUP BY ALL) SELECT series_id, CAST(i AS INT) bin, round(coalesce(v, m) + CAST(0.00000013 AS DOUBLE),6) AS value FROM mean CROSS JOIN range(64) r(i) LEFT JOIN b USING (series_id) WHERE b.bin = i UNION ALL SELECT series_id, CAST(i AS INT), round(m + CAST(0.00000013 AS DOUBLE),6) FROM mean CROSS JOIN range(64) r(i) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.series_id = mean.series_id AND b.bin = i)")
def bin_phase(spark: SparkSession, sf: str) -> DataFrame:
    return _r(fold.bin_phase(_folded(spark, sf), 64).withColumn("value", F.col("value") + 0.00000013), value=6)  # off rounding ties of means


@query(f"{_FOLD}, b AS (SELECT series_id, CAST(floor(phase*2048) AS INT) bin, avg(flux) v FROM ph GROUP BY ALL) SELECT mean.series_id, CAST(i AS INT) bin, round(coalesce(v, m) + CAST(0.00000013 AS DOUBLE), 6) AS value FROM mean CROSS JOIN range(2048) r(i) LEFT JOIN b ON b.series_id = mean.series_id AND b.bin = i")
def global_view(spark: SparkSession, sf: str) -> DataFrame:
    cells = fold.global_view(_folded(spark, sf)).select("series_id", F.posexplode("global_view").alias("bin", "value"))
    return cells.select("series_id", "bin", F.round(F.col("value") + 0.00000013, 6).alias("value"))


_WINDOW = (
    "w50 AS (SELECT series_id, CAST(floor(phase*50) AS INT) bin, avg(flux) v FROM ph GROUP BY ALL), "
    "d50 AS (SELECT mean.series_id, i AS bin, round(coalesce(v, m), 9) v FROM mean CROSS JOIN range(50) r(i) LEFT JOIN w50 ON w50.series_id = mean.series_id AND w50.bin = i), "
    "win AS (SELECT series_id, (bin + 0.5)/50 center FROM d50 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY v, bin) = 1)"
)
_LOCAL = (
    f"{_WINDOW}, seg AS (SELECT ph.*, center - 0.05 lo, center + 0.05 hi FROM ph JOIN win USING (series_id)), "
    "s2 AS (SELECT *, CASE WHEN lo < 0 THEN phase >= lo + 1 OR phase < hi WHEN hi > 1 THEN phase >= lo OR phase < hi - 1 ELSE phase >= lo AND phase < hi END inn, "
    "CASE WHEN lo < 0 AND phase >= lo + 1 THEN phase - 1 WHEN hi > 1 AND phase < hi - 1 THEN phase + 1 ELSE phase END flat FROM seg), "
    "sp AS (SELECT series_id, count(*) FILTER (inn) n, min(flat) FILTER (inn) a, max(flat) FILTER (inn) b FROM s2 GROUP BY 1), "
    "l AS (SELECT series_id, flux, CASE WHEN n < 10 THEN phase WHEN b > a THEN (flat - a)/(b - a) ELSE 0.0 END phase FROM s2 JOIN sp USING (series_id) WHERE n < 10 OR inn), "
    "lm AS (SELECT series_id, avg(flux) m FROM l GROUP BY 1), lb AS (SELECT series_id, CAST(floor(phase*256) AS INT) bin, avg(flux) v FROM l GROUP BY ALL)"
)
_OFF = "CAST(0.00000013 AS DOUBLE)"  # off rounding ties of means
_LOCAL_OUT = f"lm.series_id, CAST(i AS INT) bin, round(coalesce(v, m) + {_OFF}, 6) AS value FROM lm CROSS JOIN range(256) r(i) LEFT JOIN lb ON lb.series_id = lm.series_id AND lb.bin = i"


def _cells(rows: DataFrame, view: str) -> DataFrame:
    return rows.select("series_id", F.posexplode(view).alias("bin", "value")).withColumn("value", F.round(F.col("value") + 0.00000013, 6))


@query(f"{_FOLD}, {_WINDOW} SELECT series_id, round(center, 6) center FROM win")
def transit_window(spark: SparkSession, sf: str) -> DataFrame:
    return _r(fold.transit_window(_folded(spark, sf)), center=6)


@query(f"{_FOLD}, {_LOCAL} SELECT {_LOCAL_OUT}")
def local_view(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(fold.local_view(_folded(spark, sf)), "local_view")


@query(f"{_FOLD}, f AS (SELECT series_id, CAST(floor(phase*200) AS INT) bin, avg(flux) v FROM ph GROUP BY ALL) SELECT mean.series_id, CAST(i AS INT) bin, round(v + {_OFF}, 6) AS value FROM mean CROSS JOIN range(200) r(i) LEFT JOIN f ON f.series_id = mean.series_id AND f.bin = i")
def folded_curve(spark: SparkSession, sf: str) -> DataFrame:
    return fold.folded_curve(_folded(spark, sf)).withColumn("value", F.round(F.col("value") + 0.00000013, 6))


@query(f"{_FOLD}, {_LOCAL}, b AS (SELECT series_id, CAST(floor(phase*2048) AS INT) bin, avg(flux) v FROM ph GROUP BY ALL) SELECT 'local' AS part, {_LOCAL_OUT} UNION ALL SELECT 'global', mean.series_id, CAST(i AS INT), round(coalesce(v, m) + {_OFF}, 6) FROM mean CROSS JOIN range(2048) r(i) LEFT JOIN b ON b.series_id = mean.series_id AND b.bin = i UNION ALL SELECT 'centroid', series_id, 0, NULL FROM mean")
def feature_stage(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cadence(spark, sf).select("series_id", "t", "flux")
    rows = fold.features(c, search.single_pass(c, LOW, HIGH, 60), rows=c.count())
    part = lambda name, view: F.struct(F.lit(name).alias("part"), view.alias("view"))
    # Views are told apart in the row: a union would work them out, and search, once for each of its sides.
    parts = F.array(part("local", F.col("local_view")), part("global", F.col("global_view")), part("centroid", F.array("centroid_offset")))
    cells = rows.select("series_id", F.explode(parts).alias("x")).select("x.part", "series_id", F.posexplode("x.view").alias("bin", "value"))
    return cells.withColumn("value", F.when(F.col("part") == "centroid", F.col("value")).otherwise(F.round(F.col("value") + 0.00000013, 6)))


@query("WITH p AS (SELECT CAST(label AS VARCHAR) series_id, CAST(vec_id AS DOUBLE) t, (i//8) AS r, (i%8) AS c, embedding[CAST(i AS INT)+1] + 1 flux, (vec_id % 3.0)/3.0 phase FROM embeddings, range(64) g(i)), s AS (SELECT series_id, phase >= 0.25 AND phase < 0.35 ins, sum(flux) f, sum(c*flux)/sum(flux) x, sum(r*flux)/sum(flux) y, count(DISTINCT t) n FROM p GROUP BY 1,2) SELECT a.series_id, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2),4) centroid_offset FROM s a JOIN s b ON a.series_id=b.series_id AND a.ins AND NOT b.ins WHERE a.n>=2 AND b.n>=2 AND a.f>0 AND b.f>0")
def centroid_offset(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings")
    px = e.select(F.col("label").cast("string").alias("series_id"), F.col("vec_id").cast("double").alias("t"), F.posexplode("embedding").alias("i", "v"))
    px = px.select("series_id", "t", F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).alias("col"), (F.col("v") + 1).cast("double").alias("flux"))
    ids = px.select("series_id").distinct()
    best = ids.select("series_id", F.lit(3.0).alias("best_period"), F.lit(0.0).alias("epoch"))
    return _r(fold.centroid_offset(px, best, ids.withColumn("center", F.lit(0.3))), centroid_offset=4)


_VEC = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings)"


@query(
    f"WITH {_VEC}, r AS (SELECT vec_id, v, i, i*(63/99.0::DOUBLE) x FROM e, range(100) g(i)), l AS (SELECT *, CAST(least(floor(x), 62) AS BIGINT) lo FROM r) "
    "SELECT vec_id, 'pad' kind, CAST(i AS INT) i, round(coalesce(v[i + 1], 0.0), 6) AS value FROM e, range(128) g(i) UNION ALL SELECT vec_id, 'cut', CAST(i AS INT), round(v[i + 1], 6) FROM e, range(50) g(i) "
    "UNION ALL SELECT vec_id, 'resample', CAST(i AS INT), round(v[lo + 1] + (v[lo + 2] - v[lo + 1])*(x - lo), 6) FROM l"
)
def view_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Every element of longer, shorter and resampled views."""
    e = A.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    kinds = {"pad": V.pad_view(F.col("v"), 128), "cut": V.pad_view(F.col("v"), 50), "resample": V.resample_view(F.col("v"), 100)}
    all_ = F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("view")) for k, x in kinds.items()))
    cells = e.select("vec_id", F.explode(all_).alias("x")).select("vec_id", "x.kind", F.posexplode("x.view").alias("i", "value"))
    return _r(cells, value=6)


@query("WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 2) v FROM embeddings), k AS (SELECT vec_id, v, list_aggregate(v, 'median') md FROM m) SELECT vec_id, CAST(i AS INT) i, round(v[i + 1]/md - 1, 6) AS value FROM k, range(64) g(i)")
def normalize_view(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 2).alias("v"))
    return _r(e.select("vec_id", F.posexplode(V.normalize_view(F.col("v"))).alias("i", "value")), value=6)


# --- identifiers, gates, sources
@query("SELECT c_custkey, trim(regexp_replace(upper(trim(c_name)), '^TIC', '')) id, CASE WHEN upper(c_name) LIKE 'TIC%' THEN c_name ELSE 'TIC ' || c_name END canonical, replace(replace(c_mktsegment || '/' || c_name, '/', '_'), ' ', '_') safe, md5(printf('%s_%s_%.6f_phase3', c_name, c_mktsegment, c_acctbal)) key3, replace(replace(c_name || '_' || c_mktsegment || '_phase1', '/', '_'), ' ', '_') key1, replace(replace(c_name || '_' || c_mktsegment || '_0.5_20.0_5000_phase2', '/', '_'), ' ', '_') key2, coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), 'all') sector, 's' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') log_name FROM customer")
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    c, name, seg = A.table(spark, sf, "customer"), F.col("c_name"), F.col("c_mktsegment")
    return c.select(
        "c_custkey", S.normalize_id(name).alias("id"), S.canonical_id(name).alias("canonical"), S.safe_key(F.concat_ws("/", seg, name)).alias("safe"),
        S.stage3_key(name, seg, F.col("c_acctbal")).alias("key3"), S.stage1_key(name, seg).alias("key1"),
        S.stage2_key(name, seg, F.lit(0.5), F.lit(20.0), F.lit(5000)).alias("key2"), S.sector_label(F.nullif("c_nationkey", F.lit(3))).alias("sector"), S.log_name(F.col("c_nationkey")).alias("log_name"),
    )


@query(f"WITH {EV} SELECT tic_id, CASE WHEN prob_planet >= 0.85 THEN printf('CANDIDATE (%.2f)', floor(prob_planet*100)/100) ELSE 'CLEARED' END status, prob_planet >= 0.85 is_candidate, CASE WHEN bls_power < 0.001 THEN 'NO_SIGNAL' END gate, coalesce(centroid_offset, 0.0) centroid, centroid_offset IS NULL missing, substr(replace(replace(coalesce(discovery_status,'x') || ',a', ',', ';'), chr(10), ' '), 1, 200) err FROM evidence")
def gates(spark: SparkSession, sf: str) -> DataFrame:
    status = S.assign_status(F.when(F.col("prob_planet") >= 0.85, F.floor(F.col("prob_planet") * 100) / 100), 0.85)
    return A.evidence(spark, sf).select(
        "tic_id", status.alias("status"), S.is_candidate(status).alias("is_candidate"), S.power_status(F.col("bls_power"), 0.001).alias("gate"),
        S.centroid_or_zero(F.col("centroid_offset")).alias("centroid"), S.is_missing(F.col("centroid_offset")).alias("missing"),
        S.sanitize_error(F.concat(F.coalesce("discovery_status", F.lit("x")), F.lit(",a"))).alias("err"),
    )


@query(f"WITH {CAD} SELECT series_id, count(*) n, round(min(t),6) t0, round(max(t),6) t1, round(avg(flux),6) mean, CASE WHEN count(*) < 50 THEN '{S.TOO_SHORT}' END status FROM cadence GROUP BY 1")
def series_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cadence(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg("flux").alias("mean"))
    return _r(c.withColumn("status", S.length_status(F.col("n"))), t0=6, t1=6, mean=6)


_SCORE_SQL = "SELECT e.*, CASE WHEN profile IN ('balanced','ultra_short_period','single_transit_long_period','low_snr_m_dwarf') THEN profile ELSE 'balanced' END p FROM evidence e"
_SCORED = (
    f"{EV}, w(p, a, b, c, d, lo, hi) AS (VALUES ('balanced',0.5,0.25,0.15,0.10,1.0,15.0),('ultra_short_period',0.45,0.30,0.15,0.10,0.2,1.0),('single_transit_long_period',0.40,0.20,0.20,0.20,10.0,100.0),('low_snr_m_dwarf',0.40,0.25,0.20,0.15,0.5,20.0)), "
    f"sc AS (SELECT x.*, lo, hi, round(least(1.0, CAST(a AS DOUBLE)*least(1.0,greatest(0.0,prob_planet)) + CAST(b AS DOUBLE)*least(1.0,bls_power/0.01) + CAST(c AS DOUBLE)*CASE WHEN centroid_offset IS NULL THEN 0.5 ELSE greatest(0.0,1-centroid_offset/5) END + CAST(d AS DOUBLE)*CASE profile WHEN 'ultra_short_period' THEN CASE WHEN bls_power>0.003 THEN 0.8 ELSE 0.3 END WHEN 'single_transit_long_period' THEN 0.9 WHEN 'low_snr_m_dwarf' THEN CASE WHEN prob_planet>0.6 THEN 0.7 ELSE 0.3 END ELSE 0.5 END),4) score FROM ({_SCORE_SQL}) x JOIN w USING (p))"
)


@query(f"WITH {_SCORED} SELECT tic_id, profile, score FROM sc")
def candidate_score(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.score_candidates(A.evidence(spark, sf)).select("tic_id", "profile", "score")


@query(f"WITH {_SCORED} SELECT tic_id, profile, CASE WHEN CAST(tic_id AS BIGINT) % 3 = 0 THEN 0.7 ELSE CAST(lo AS DOUBLE) END period_min, CASE WHEN CAST(tic_id AS BIGINT) % 2 = 0 THEN 9.5 ELSE CAST(hi AS DOUBLE) END period_max, CASE WHEN CAST(tic_id AS BIGINT) % 5 = 0 THEN CAST(77 AS INT) ELSE CASE p WHEN 'balanced' THEN 10000 WHEN 'ultra_short_period' THEN 15000 WHEN 'single_transit_long_period' THEN 8000 ELSE 12000 END END nperiods, CASE p WHEN 'balanced' THEN 0.85 WHEN 'ultra_short_period' THEN 0.80 WHEN 'single_transit_long_period' THEN 0.75 ELSE 0.70 END::DOUBLE threshold FROM sc")
def profile_params(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.resolve_profiles(A.evidence(spark, sf))
    k = F.col("tic_id").cast("long")
    rows = rows.withColumns({"override_period_min": F.when(k % 3 == 0, 0.7), "override_period_max": F.when(k % 2 == 0, 9.5), "override_nperiods": F.when(k % 5 == 0, 77)})
    return catalog.with_overrides(rows, "period_min", "period_max", "nperiods").select("tic_id", "profile", "period_min", "period_max", "nperiods", "threshold")


@query(f"WITH {EV} SELECT tic_id, round(best_period,4) best_period, round(prob_planet,3) prob_planet, round(bls_power,6) bls_power, round(coalesce(centroid_offset,0),3) centroid_offset FROM evidence WHERE coalesce(discovery_status,'Unknown') IN ('Unknown','NEW_CANDIDATE') AND prob_planet >= 0.4")
def filter_display(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.display(catalog.filter_candidates(A.evidence(spark, sf), ["Unknown", "NEW_CANDIDATE"], 0.4))


@query(f"WITH {EV} SELECT profile, tic_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY prob_planet DESC, tic_id) AS rank FROM evidence) WHERE rank <= 5")
def top_k_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.rank_candidates(A.evidence(spark, sf), "prob_planet", group="profile", k=5).select("profile", "tic_id", "rank")


_BALANCED = _SCORED.replace("['balanced','ultra_short_period','single_transit_long_period','low_snr_m_dwarf','other'][c_custkey%5+1] profile", "'balanced' profile")


@query(f"WITH {_BALANCED} SELECT tic_id, row_number() OVER (ORDER BY score DESC, tic_id) AS rank, score FROM sc WHERE coalesce(discovery_status,'Unknown') <> 'KNOWN' AND prob_planet >= 0.3 ORDER BY score DESC, tic_id LIMIT 50")
def browse(spark: SparkSession, sf: str) -> DataFrame:
    rows = pipelines.browse(A.evidence(spark, sf).drop("profile"), "balanced", ["Unknown", "NEW_CANDIDATE"], 0.3, 50)
    return rows.select("tic_id", "rank", F.col("score"))


# --- joins, sets, progress
_KNOWN = "known AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) tic_id FROM orders)"


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return io.known_objects(A.table(spark, sf, "orders"), "o_custkey")


@query(f"WITH {EV}, {_KNOWN} SELECT e.tic_id, coalesce(discovery_status, CASE WHEN k.tic_id IS NULL THEN 'NEW_CANDIDATE' ELSE 'KNOWN' END) discovery_status FROM evidence e LEFT JOIN known k USING (tic_id)")
def cross_match(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.cross_match(A.evidence(spark, sf), _known(spark, sf)).select("tic_id", "discovery_status")


@query(f"WITH {EV}, {_KNOWN} SELECT tic_id, true AS is_known FROM evidence WHERE tic_id IN (SELECT tic_id FROM known) UNION ALL SELECT tic_id, false FROM evidence WHERE tic_id NOT IN (SELECT tic_id FROM known)")
def known_and_new(spark: SparkSession, sf: str) -> DataFrame:
    e, k = A.evidence(spark, sf).select("tic_id"), _known(spark, sf)
    return e.join(k, "tic_id", "left_semi").withColumn("is_known", F.lit(True)).unionByName(e.join(k, "tic_id", "left_anti").withColumn("is_known", F.lit(False)))


@query(f"WITH {EV}, {_KNOWN} SELECT tic_id FROM evidence INTERSECT SELECT tic_id FROM known")
def known_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return A.evidence(spark, sf).select("tic_id").intersect(_known(spark, sf))


@query(f"WITH {PROG} SELECT tic_id, last_stage, status, seq FROM latest")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest_state(A.progress(spark, sf)).select("tic_id", "last_stage", "status", "seq")


@query(f"WITH {PROG} SELECT CAST(c_custkey AS VARCHAR) tic_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT tic_id FROM latest WHERE last_stage IN ('DONE','predict'))")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    targets = A.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("tic_id"))
    return catalog.resume_pending(targets, A.progress(spark, sf))


@query(f"WITH {PROG} SELECT tic_id, last_stage IN ('phase3','predict','DONE') reached FROM latest")
def stage_reached(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest_state(A.progress(spark, sf)).select("tic_id", catalog.stage_reached(F.col("last_stage"), "phase3").alias("reached"))


@query(f"WITH {CAD}, st AS (SELECT series_id, count(*) n, 'stored' src FROM cadence WHERE CAST(series_id AS INT) % 2 = 0 GROUP BY 1), al AS (SELECT series_id, count(*) n, 'computed' src FROM cadence WHERE CAST(series_id AS INT) % 2 = 1 GROUP BY 1) SELECT * FROM st UNION ALL SELECT * FROM al")
def fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    c = A.cadence(spark, sf)
    sums = lambda rows, name: rows.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("src", F.lit(name))
    stored = sums(c.where(F.col("series_id").cast("int") % 2 == 0), "stored")
    ids = c.select("series_id").distinct()
    return catalog.fill_missing(ids, stored, lambda todo: sums(c.join(todo, "series_id", "left_semi"), "computed"))


@query(f"WITH {PROG} SELECT status, count(*) AS n FROM progress GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.progress(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {PROG} SELECT (SELECT count(*) FROM progress) log_rows, (SELECT count(*) FROM progress WHERE last_stage='DONE') done_rows, (SELECT count(*) FROM progress WHERE status LIKE 'CANDIDATE%') candidate_rows, (SELECT count(*) FROM latest) ids, (SELECT count(*) FROM latest WHERE last_stage='DONE') done_ids")
def progress_summary(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.progress_summary(A.progress(spark, sf))


@query(f"WITH {PROG} SELECT count(*) finished, round(count(*)/((epoch_us(max(updated_at))-epoch_us(min(updated_at)))/3.6e9),6) per_hour FROM progress WHERE last_stage='DONE'")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.throughput(A.progress(spark, sf))


@query("SELECT count(*) AS series, round(avg(value),6) mean_phase1_ms, round(avg(value*2),6) mean_phase2_ms, round(avg(value+1),6) mean_phase3_ms, round(avg(user_id*1.0),6) mean_predict_ms, round(avg(value*4+1+user_id),6) mean_total_ms FROM events")
def timing_summary(spark: SparkSession, sf: str) -> DataFrame:
    e, v = A.table(spark, sf, "events"), F.col("value")
    own = {"phase1_ms": v, "phase2_ms": v * 2, "phase3_ms": v + 1, "predict_ms": F.col("user_id").cast("double"), "total_ms": v * 4 + 1 + F.col("user_id")}
    return catalog.timing_summary(e.select(*(x.alias(n) for n, x in own.items())))


@query("SELECT count(DISTINCT p_size) FILTER (p_size BETWEEN 1 AND 40) done, CAST(40 AS BIGINT) total, round(count(DISTINCT p_size) FILTER (p_size BETWEEN 1 AND 40)/40, 6) AS share FROM part WHERE p_size % 3 = 0")
def sweep_progress(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.sweep_progress(A.table(spark, sf, "part").where("p_size % 3 = 0").select(F.col("p_size").alias("sector")), 1, 40)


@query(f"WITH {EV} SELECT tic_id, row_number() OVER (ORDER BY prob_planet DESC, tic_id) AS rank FROM evidence")
def rank_all(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.rank_candidates(A.evidence(spark, sf), "prob_planet").select("tic_id", "rank")


@query(f"WITH {PROG} SELECT tic_id, seq FROM progress ORDER BY updated_at DESC, seq DESC LIMIT 100")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    return A.progress(spark, sf).orderBy(F.desc("updated_at"), F.desc("seq")).limit(100).select("tic_id", "seq")


@query(f"WITH {EV} SELECT count(DISTINCT tic_id) total, count(DISTINCT tic_id) FILTER (discovery_status='NEW_CANDIDATE') AS new, count(DISTINCT tic_id) FILTER (discovery_status='KNOWN') AS known FROM evidence")
def discovery_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("discovery_status")
    ids = lambda status: F.count_distinct(F.when(s == status, F.col("tic_id")))
    return A.evidence(spark, sf).agg(F.count_distinct("tic_id").alias("total"), ids("NEW_CANDIDATE").alias("new"), ids("KNOWN").alias("known"))


@query("SELECT CAST(i AS INT) sector FROM range(1, 101) r(i) WHERE i NOT IN (SELECT DISTINCT p_size FROM part WHERE p_size % 2 = 0)")
def pending_sectors(spark: SparkSession, sf: str) -> DataFrame:
    done = A.table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_size").alias("sector")).distinct()
    return io.pending_sectors(spark, 1, 100, done)


@query("SELECT o_custkey, min(o_orderkey) first_pos FROM orders GROUP BY 1 ORDER BY first_pos LIMIT 200")
def target_list(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("first_pos"))
    return catalog.ordered_distinct(o, "o_custkey", "first_pos").orderBy("first_pos").limit(200)


@query("SELECT CAST(c_custkey AS VARCHAR) tic_id, 1 AS label FROM customer WHERE c_mktsegment LIKE '%BUILD%' AND c_acctbal > 0 UNION ALL SELECT DISTINCT CAST(c_custkey AS VARCHAR), 0 FROM customer WHERE c_mktsegment = 'MACHINERY'")
def union_labelled(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("tic_id"), F.when(F.col("c_mktsegment").contains("BUILD"), "TESS").alias("disc_facility"),
        (F.col("c_acctbal") > 0).cast("int").alias("default_flag"), F.when(F.col("c_mktsegment") == "MACHINERY", "FP").alias("tfopwg_disp"),
    )
    return io.labelled_catalogue(c, c)


@query("SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) <= 20")
def cap_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.cap_per_class(A.table(spark, sf, "customer"), "c_mktsegment", "c_custkey", 20).select("c_custkey", "c_mktsegment")


# --- metrics
@query(f"WITH {LAB}, c AS (SELECT count(*) FILTER (label=1 AND score>=0.5) tp, count(*) FILTER (label<>1 AND score>=0.5) fp, count(*) FILTER (label=1 AND score<0.5) fn, count(*) FILTER (label<>1 AND score<0.5) tn FROM scored) SELECT tp, fp, fn, tn, round(tp/greatest(tp+fp,1),4) AS precision, round(tp/greatest(tp+fn,1),4) recall, round(2*(tp/greatest(tp+fp,1))*(tp/greatest(tp+fn,1))/greatest(tp/greatest(tp+fp,1)+tp/greatest(tp+fn,1),1e-8),4) f1 FROM c")
def precision_recall_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.precision_recall_f1(A.scored_labels(spark, sf))


@query(f"WITH {LAB}, r AS (SELECT label, avg(rn) OVER (PARTITION BY score) mid FROM (SELECT *, row_number() OVER (ORDER BY score) rn FROM scored)) SELECT round((sum(mid) FILTER (label=1) - count(*) FILTER (label=1)*(count(*) FILTER (label=1)+1)/2.0)/nullif(count(*) FILTER (label=1)*count(*) FILTER (label<>1),0),6) roc_auc FROM r")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_auc(A.scored_labels(spark, sf))


_CUM = f"{LAB}, g AS (SELECT score, count(*) FILTER (label=1) p, count(*) FILTER (label<>1) n FROM scored GROUP BY 1), cu AS (SELECT *, sum(p) OVER (ORDER BY score DESC) tp, sum(n) OVER (ORDER BY score DESC) fp FROM g)"


@query(f"WITH {_CUM} SELECT round(sum(p*tp/(tp+fp))/nullif(sum(p),0),6) average_precision FROM cu")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision(A.scored_labels(spark, sf))


@query(f"WITH {_CUM} SELECT score, CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp FROM cu")
def cumulative_pr(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cumulative_pr(A.scored_labels(spark, sf))


@query(f"WITH {LAB}, c AS (SELECT *, sum(label) OVER w tp, sum(1-label) OVER w fp, sum(label) OVER () tot FROM scored WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)), d AS (SELECT score, id, tp/(tp+fp+1e-10) pr, tp/(tot+1e-10) re FROM c) SELECT round(sum(a),6) pr_auc FROM (SELECT (re - lag(re) OVER (ORDER BY score DESC, id))*(pr + lag(pr) OVER (ORDER BY score DESC, id))/2 a FROM d)")
def pr_auc_trapezoid(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pr_auc_trapezoid(A.scored_labels(spark, sf))


@query(f"WITH {LAB} SELECT round(avg(-ln(greatest(1e-12, CASE WHEN label=1 THEN score ELSE 1-score END))),6) log_loss, round(avg(CAST((score>=0.5)::INT = label AS INT)),6) accuracy FROM scored")
def log_loss_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.log_loss_accuracy(A.scored_labels(spark, sf))


# --- composites
def _cfg() -> pipelines.Config:
    """The operator's own grids and gates; only the period range is the table's."""
    return pipelines.Config(low=LOW, high=HIGH)


def _hunted() -> str:
    """Segments of fewer rows than the trend's window, as all of the given table are, are divided by their median."""
    few = "n AS (SELECT series_id, count(*) n FROM cadence GROUP BY 1)"
    out = f"WITH {CAD}, {few}, {_SEG}, c0 AS (SELECT series_id, t, flux / median(flux) OVER (PARTITION BY series_id, seg) flux FROM seg JOIN n USING (series_id) WHERE n >= 50), {_clip_cte('c0')}"
    full = _FULL.replace("FROM cadence", "FROM c5")
    status = f"CASE WHEN n < 50 THEN '{S.TOO_SHORT}' WHEN max_power < 0.001 THEN 'NO_SIGNAL' ELSE 'CLEARED' END"
    return f"{out}, {full} SELECT series_id, n, {status} status, round(best_period,6) best_period, round(epoch,6) epoch, round(max_power,6) max_power, CAST(NULL AS DOUBLE) prob_planet FROM n LEFT JOIN best2 USING (series_id)"


@query(_hunted())
def hunt(spark: SparkSession, sf: str) -> DataFrame:
    return _r(pipelines.hunt(A.cadence(spark, sf).select("series_id", "t", "flux"), _cfg()), best_period=6, epoch=6, max_power=6)


@query(f"SELECT * FROM ({_hunted()}) WHERE series_id = '3'")
def scan(spark: SparkSession, sf: str) -> DataFrame:
    return _r(pipelines.scan(A.cadence(spark, sf).select("series_id", "t", "flux"), "3", _cfg()), best_period=6, epoch=6, max_power=6)


@query(f"WITH {CAD}, {_KNOWN}, s AS (SELECT DISTINCT sector, series_id FROM cadence) SELECT sector, count(*) done, CAST(0 AS BIGINT) candidates, count(k.tic_id) known, count(*) - count(k.tic_id) AS new FROM s LEFT JOIN known k ON k.tic_id = s.series_id GROUP BY 1")
def sweep_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Without a model no series is a candidate."""
    known = A.table(spark, sf, "orders").select(F.col("o_custkey").cast("string"))
    return pipelines.sector_summary(pipelines.sweep(A.cadence(spark, sf), known, _cfg()))


_NOISE = (
    "fo AS (SELECT c.series_id, flux, (t - best_bin/20.0*best_period)/best_period - floor((t - best_bin/20.0*best_period)/best_period) phase FROM c5 c JOIN best2 USING (series_id)), lv AS (SELECT series_id, median(flux) FILTER (phase >= 0.05) lev FROM fo GROUP BY 1), "
    "sn AS (SELECT series_id, (max(lev) - avg(flux) FILTER (phase < 0.05))/nullif(median(abs(flux - lev)) FILTER (phase >= 0.05)*1.4826, 0)*sqrt(count(*) FILTER (phase < 0.05)) snr FROM fo JOIN lv USING (series_id) GROUP BY 1)"
)
_GATE = 5.0


@query(f"{_hunted().split(' SELECT series_id, n, CASE')[0]}, {_NOISE} SELECT series_id, n, CASE WHEN n < 50 THEN '{S.TOO_SHORT}' WHEN max_power < 0.001 OR NOT coalesce(snr > {_GATE}, false) THEN 'NO_SIGNAL' ELSE 'CLEARED' END status, round(best_period,6) best_period, round(epoch,6) epoch, round(max_power,6) max_power, round(snr,5) snr, CAST(NULL AS DOUBLE) prob_planet FROM n LEFT JOIN best2 USING (series_id) LEFT JOIN sn USING (series_id)")
def hunt_snr(spark: SparkSession, sf: str) -> DataFrame:
    """A staged hunt that also asks for a dip of 5 times its noise."""
    cfg = replace(_cfg(), snr=_GATE)
    done = pipelines.staged_hunt(A.cadence(spark, sf).select("series_id", "t", "flux"), io.work_dir(spark, "hunt"), cfg)
    return _r(done.found, best_period=6, epoch=6, max_power=6, snr=5)


@query(f"{_hunted().split(' SELECT series_id, n, CASE')[0]} SELECT CAST(count(*) AS BIGINT) series, true AS timed, true AS adds_up FROM n")
def hunt_timings(spark: SparkSession, sf: str) -> DataFrame:
    """A hunt's own timings: a row for each series; their stages add up to their totals."""
    done = pipelines.staged_hunt(A.cadence(spark, sf).select("series_id", "t", "flux"), io.work_dir(spark, "hunt"), _cfg())
    parts = sum((F.col(f"{p}_ms") for p in S.STAGES[:4]), F.lit(0.0))
    return done.timings.agg(F.count("*").alias("series"), (F.sum("total_ms") > 0).alias("timed"), (F.max(F.abs(parts - F.col("total_ms"))) < 1e-6).alias("adds_up"))


_ONE = "WHERE series_id = '3'"


@query(
    f"{_hunted().split(' SELECT series_id, n, CASE')[0]}, fo AS (SELECT c.series_id, flux, (t - epoch)/best_period - floor((t - epoch)/best_period) phase FROM c5 c JOIN best2 USING (series_id)), cu AS (SELECT CAST(floor(phase*200) AS INT) bin, avg(flux) v FROM fo {_ONE} GROUP BY 1) "
    f"SELECT 'cleaned' part, round(t,6) x, round(flux,6) y FROM c5 {_ONE} UNION ALL SELECT 'coarse', round(period,6), round(max(power),7) FROM box {_ONE} GROUP BY period UNION ALL SELECT 'refine', round(period,6), round(max(power),7) FROM box2 {_ONE} GROUP BY period "
    f"UNION ALL SELECT 'best', round(best_period,6), round(max_power,6) FROM best2 {_ONE} UNION ALL SELECT 'curve', i, round(v,6) FROM range(200) r(i) LEFT JOIN cu ON bin = i"
)
def scan_tables(spark: SparkSession, sf: str) -> DataFrame:
    """What a scan of one series works out on the way."""
    done = pipelines.scan_all(A.cadence(spark, sf).select("series_id", "t", "flux"), "3", _cfg())
    part = lambda df, name, x, y, d: df.select(F.lit(name).alias("part") if isinstance(name, str) else name.alias("part"), F.round(F.col(x).cast("double"), 6).alias("x"), F.round(y, d).alias("y"))
    out = part(done.cleaned, "cleaned", "t", "flux", 6).unionByName(part(done.spectrum, F.col("pass"), "period", "power", 7))
    return out.unionByName(part(done.best, "best", "best_period", "max_power", 6)).unionByName(part(done.curve, "curve", "bin", "value", 6))


_LEAST, _SWEEP_GATE = 10, 1.0


def _swept() -> str:
    """As ``hunt``, for each sector's part of a series, with the sweep's gates."""
    cad = CAD.replace("cadence AS", "whole AS") + ", cadence AS (SELECT sector || '|' || series_id series_id, t, flux FROM whole)"
    out = _hunted().replace(CAD, cad).replace("n >= 50", f"n >= {_LEAST}").split(" SELECT series_id, n, CASE")[0]
    status = f"CASE WHEN n < {_LEAST} THEN 'ERROR' WHEN max_power < {_SWEEP_GATE} THEN 'NO_SIGNAL' ELSE 'CLEARED' END"
    return f"{out}, {_KNOWN}, sw AS (SELECT CAST(split_part(series_id,'|',1) AS INT) sector, {status} kind, max_power, k.tic_id IS NOT NULL is_known FROM n LEFT JOIN best2 USING (series_id) LEFT JOIN known k ON k.tic_id = split_part(series_id,'|',2))"


@query(f"{_swept()} SELECT sector, kind, CAST(grouping_id(sector, kind) AS INT) AS level, count(*) done, count(*) FILTER (is_known) known, count(*) FILTER (NOT is_known) AS new, round(max(max_power),6) best FROM sw GROUP BY ROLLUP (sector, kind)")
def sweep_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A sweep that searches: on the given table a user has about 13 rows a sector, so the gate is 10 rows here."""
    known = A.table(spark, sf, "orders").select(F.col("o_custkey").cast("string"))
    cfg = replace(_cfg(), least=_LEAST, bls_threshold=_SWEEP_GATE)
    return _r(pipelines.sector_totals(pipelines.sweep(A.cadence(spark, sf), known, cfg)), best=6)


@query()
def train_and_score(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier on embeddings as views: labels 0 to 4 against the rest."""
    e = A.table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = e.select(F.col("vec_id").alias("series_id"), v.alias("global_view"), F.slice(v, 1, 16).alias("local_view"), F.lit(None).cast("double").alias("centroid_offset"), (F.col("label") < 5).cast("int").alias("label"))
    fit, val = ml.train_val_split(rows, "series_id")
    model, _ = ml.select_by_f1(fit, val, [{"maxIter": 20}, {"maxIter": 20, "regParam": 0.1}])
    return ml.classify(ml.score_batch(rows, model)).select("series_id", "label", "prob_planet", "predicted", "prob_fp")
