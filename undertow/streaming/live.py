"""Incremental runs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from undertow.operators.search import BEST, BINS, log_grid
from undertow.plans.pipelines import Config, hunt
from undertow.sources.io import CADENCE, PROGRESS


def incremental_hunt(spark: SparkSession, landing: str, out: str, checkpoint: str, cfg: Config = Config()) -> StreamingQuery:
    """Searches the series that a newly landed batch has rows of, on all their rows landed so far.

    A batch that is tried again overwrites its own output; ``latest_found`` gives each series' last result.
    """

    def one(batch: DataFrame, n: int) -> None:
        touched = batch.select("series_id").distinct()
        rows = batch.sparkSession.read.schema(CADENCE).parquet(landing).join(touched, "series_id", "left_semi")
        hunt(rows, cfg).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = spark.readStream.schema(CADENCE).parquet(landing)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Folds(StatefulProcessor):
    """A series' state: how many rows, and what flux, each box of each trial period holds.

    Boxes add up, so a row is folded once, in whatever batch it comes, and never read again. The state of a series takes
    periods x bins x 12 bytes, whatever the number of its rows.
    """

    def __init__(self, periods: np.ndarray, bins: int) -> None:
        self.periods, self.bins = periods, bins

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "n long, s double, ss double, t0 double, counts binary, sums binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size = len(self.periods) * self.bins
        if self.state.exists():
            n, s, ss, t0, counts, sums = self.state.get()
            counts, sums = np.frombuffer(counts, "<i4").copy(), np.frombuffer(sums, "<f8").copy()
        else:
            n, s, ss, t0, counts, sums = 0, 0.0, 0.0, np.inf, np.zeros(size, "<i4"), np.zeros(size, "<f8")
        for part in rows:
            t, y = part["t"].to_numpy(float), part["flux"].to_numpy(float)
            n, s, ss, t0 = n + len(t), s + y.sum(), ss + (y * y).sum(), min(t0, t.min(initial=np.inf))
            step = max(1, 2_000_000 // max(len(t), 1))
            for at in range(0, len(self.periods), step):
                p = self.periods[at : at + step, None]
                box = (np.floor(np.mod(t[None, :], p) / p * self.bins).astype(np.int64) + np.arange(len(p))[:, None] * self.bins).ravel()
                own = slice(at * self.bins, (at + len(p)) * self.bins)
                counts[own] += np.bincount(box, minlength=len(p) * self.bins).astype("<i4")
                sums[own] += np.bincount(box, np.broadcast_to(y, (len(p), len(y))).ravel(), len(p) * self.bins)
        self.state.update((n, s, ss, float(t0), counts.tobytes(), sums.tobytes()))
        yield self.best(key[0], n, s, ss, t0, counts.reshape(-1, self.bins), sums.reshape(-1, self.bins))

    def best(self, series: str, n: int, s: float, ss: float, t0: float, n_in: np.ndarray, s_in: np.ndarray) -> pd.DataFrame:
        n_out, scatter = n - n_in, ss - s * s / n
        depth = (s - s_in) / np.maximum(n_out, 1) - s_in / np.maximum(n_in, 1)
        power = np.where((n_in >= 2) & (n_out >= 2), depth * depth * n_in * n_out / n, 0.0)
        share = np.where(n_in > 0, np.round(power / scatter, 9) if scatter > 0 else 0.0, -1.0)
        at, cell = divmod(int(share.argmax()), self.bins)
        found = (series, n, self.periods[at], t0 + cell / self.bins * self.periods[at], power[at, cell], cell)
        return pd.DataFrame([found], columns=["series_id", "n", "best_period", "epoch", "max_power", "best_bin"])

    def close(self) -> None:
        pass


def stateful_search(
    spark: SparkSession, landing: str, out: str, checkpoint: str, low: float, high: float, n: int = 500, bins: int = BINS
) -> StreamingQuery:
    """The best of ``n`` periods of every series that a newly landed batch has rows of, from keyed state.

    A batch reads its own files only; late and out-of-order rows update a series like any other. ``landing`` is to hold
    detrended flux: a trend needs its neighbours, and so can't be told from sums. Results go to ``out`` by batch, and a
    batch that is tried again overwrites its own; ``latest_found`` gives each series' last one. The session's state store
    is set to RocksDB, which keyed state of this kind needs; rows that repeat count again.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.readStream.schema(CADENCE).parquet(landing).where("flux is not null and not isnan(flux) and t is not null and abs(flux) <> double('inf')")
    found = rows.select("series_id", "t", "flux").groupBy("series_id").transformWithStateInPandas(
        Folds(log_grid(low, high, n), bins), BEST.replace("best_period", "n long, best_period", 1), "Update", "None"
    )

    def one(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={k}")

    return found.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_found(spark: SparkSession, out: str) -> DataFrame:
    """Each series' result of the last batch that had rows of it."""
    found = spark.read.parquet(out)
    cols = [c for c in found.columns if c not in ("series_id", "batch")]
    last = found.groupBy("series_id").agg(F.max_by(F.struct(*cols), "batch").alias("x"))
    return last.select("series_id", *(F.col(f"x.{c}").alias(c) for c in cols))


def status_stream(spark: SparkSession, progress: str) -> DataFrame:
    """Live rows per status; write it in complete mode."""
    return spark.readStream.schema(PROGRESS).parquet(progress).groupBy("status").count()


def throughput_stream(spark: SparkSession, progress: str, late: str = "2 hours") -> DataFrame:
    """Finished rows by hour; rows over ``late`` behind the newest are dropped."""
    rows = spark.readStream.schema(PROGRESS).parquet(progress).where("last_stage = 'DONE'")
    return rows.withWatermark("updated_at", late).groupBy(F.window("updated_at", "1 hour")).agg(F.count("*").alias("finished"))
