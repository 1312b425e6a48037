"""Rounded statuses, counts over all rows, and searches whose work and memory grow no faster than the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.sources import adapters as A


def test_statuses_round_by_the_binary_value(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate((65.0, 75.0, 85.0, 125.0, 165.0, 375.0))]
    events = spark.createDataFrame(rows, "event_id long, value double").select(
        "event_id", F.col("event_id").alias("user_id"), F.lit("error").alias("event_type"), "value", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit("{}").alias("props")
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.seq: r.status for r in A.progress(spark, str(tmp_path)).collect()}
    assert got == {i: f"CANDIDATE ({v / 1000:.2f})" for i, v in rows}
    status, key = S.assign_status(F.col("value") / 1000, 0.0), S.stage3_key(F.lit("a"), F.lit("all"), F.lit(0.0000005))
    assert [r[0] for r in events.orderBy("event_id").select(status).collect()] == [got[i] for i, _ in rows]
    import hashlib

    assert events.select(key).first()[0] == hashlib.md5(f"a_all_{0.0000005:.6f}_phase3".encode()).hexdigest()


def _random_series(rng, n):
    t = np.sort(np.round(rng.uniform(0, 30, n) * 24) / 24)
    return t, np.round(rng.exponential(50, n), 1)


def test_a_search_that_skips_periods_equals_one_of_all(spark):
    """Times on whole hours fall on boxes' edges, and few rows tie at many periods."""
    from undertow.operators import search

    rng, grid = np.random.default_rng(3), search.log_grid(1.0, 15.0, 400)
    for n in (3, 4, 7, 13, 66, 900):
        for k in (1, 2, 3):
            t, flux = _random_series(rng, n)
            kernel = search.Kernel(width=k)
            direct = np.floor(np.mod(t[None, :], grid[:, None]) / grid[:, None] * 20).astype(int)
            assert (kernel.cells(t, grid).reshape(400, n) // 400 == direct).all()
            best = np.concatenate([kernel.boxes(t, flux, grid[i : i + 1])[2] for i in range(400)])
            scatter = (flux * flux).sum() - flux.sum() ** 2 / n
            share = np.where(best >= 0, np.round(best / scatter, 9), -1.0)
            at, cell = divmod(int(share.argmax()), 20)
            assert kernel.best(t, flux, grid)[0] == grid[at] and kernel.best(t, flux, grid)[3] == cell
            if k == 1 and n >= 66:
                assert len(kernel.near_best(t, flux, grid, scatter)) < 40
    assert kernel.best(t, np.full(900, 3.0), grid)[0] == grid[0]


def test_sinusoids_by_single_precision_first_equal_those_of_all_periods():
    from undertow.operators import harmonics, search

    rng, grid = np.random.default_rng(4), search.log_grid(1.0, 15.0, 1000)
    for n in (2, 4, 5, 13, 66, 900):
        for _ in range(3):
            t, flux = _random_series(rng, n)
            near = harmonics._near_best(t, flux, grid)
            own, whole = harmonics._numpy(t, flux, near)[0], harmonics._numpy(t, flux, grid)[0]
            assert near[np.round(own, 9).argmax()] == grid[np.round(whole, 9).argmax()]
            assert n < 66 or len(near) < 200


@pytest.mark.parametrize("snr", [None, 5.0])
def test_a_hunt_searches_each_series_once(spark, snr):
    from undertow.plans import pipelines

    t, flux = _random_series(np.random.default_rng(5), 60)
    series = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(t, flux)], "series_id string, t double, flux double")
    found = pipelines.hunt(series, pipelines.Config(low=1.0, high=15.0, coarse=50, refine=20, snr=snr))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    row = found.first()
    assert row.n == 60 and row.prob_planet is None and row.best_period is not None


@pytest.mark.parametrize("width", [1, 3])
def test_boxes_meet_without_a_shuffle_in_tasks_of_bounded_work(spark, width, monkeypatch):
    from undertow.operators import search

    rng = np.random.default_rng(6)
    rows = [(str(k), float(x), float(y)) for k in range(40) for x, y in zip(*_random_series(rng, 30))]
    series = spark.createDataFrame(rows, "series_id string, t double, flux double")
    grid = search.period_grid(spark, 1.0, 10.0, 10)
    want = {(r.series_id, r.pid, r.bin): r.power for r in search.box_power(series, grid, width=width).collect()}
    monkeypatch.setattr(search, "DEALT", 1000)
    boxes = search.box_power(series, grid, width=width)
    assert boxes.rdd.getNumPartitions() == 12  # 1200 rows and 10 periods
    plan = boxes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") <= 2
    got = {(r.series_id, r.pid, r.bin): r.power for r in boxes.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_the_limit_of_clear_languages_counts_all_rows(spark, monkeypatch):
    """The sample has some 20 rows a language; the limit follows from the margins of all 600."""
    from undertow.llm import langid

    monkeypatch.setattr(langid, "PER_LANG", 20)
    monkeypatch.setattr(langid, "LEAST_LANG", 20)
    monkeypatch.setattr(langid, "CLEAR_LOST", 0.1)
    rng, words = np.random.default_rng(8), {"en": "the and house of water tree".split(), "de": "und der wasser baum haus ist".split()}
    rows = [(i, " ".join(rng.choice(words[lang] + words["de" if i % 9 == 0 and lang == "en" else lang], 12)), lang) for i in range(600) for lang in ("en" if i % 2 else "de",)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept, whole = {}, langid.clear_limit
    monkeypatch.setattr(langid, "clear_limit", lambda labelled, langs, machines, *names: kept.update(langs=langs, machines=machines, n=labelled.count()) or whole(labelled, langs, machines, *names))
    model = langid.fit_languages(docs, clear=True)
    fold = {r.doc_id: r.f for r in docs.select("doc_id", langid.fold_of("doc_id").alias("f")).collect()}
    margins = sorted(float(kept["machines"][fold[i]][kept["langs"].index(lang)] @ np.append(langid.features(t), np.float32(1))) for i, t, lang in rows)
    want = np.clip(margins[60], langid.CLEAR_LEAST, langid.CLEAR_MOST)
    assert kept["n"] == 600 and len(set(fold.values())) == 2
    assert want - 1.0001 / langid.CLEAR_STEPS <= model.limit <= want


def test_features_meet_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Views meet where rows are dealt by series."""
    from undertow.operators import fold, search

    rng = np.random.default_rng(9)
    rows = [(str(k), float(x), float(y)) for k in range(40) for x, y in zip(*_random_series(rng, 30))]
    series = spark.createDataFrame(rows, "series_id string, t double, flux double")
    best = search.single_pass(series, 1.0, 10.0, 10)
    want = {r.series_id: r for r in fold.features(series, best).collect()}
    monkeypatch.setattr(fold, "DEALT", 100)
    told = fold.features(series, best, rows=1200)
    assert told.rdd.getNumPartitions() == 12
    got = {r.series_id: r for r in told.collect()}
    assert got.keys() == want.keys() and len(got) == 40
    for k in want:
        assert np.allclose(got[k].global_view, want[k].global_view) and np.allclose(got[k].local_view, want[k].local_view)


def test_a_labelled_set_is_made_step_by_step(spark):
    """Cleaning and search are behind the set once it is told; its plan has folding alone."""
    from undertow.plans import pipelines

    rng = np.random.default_rng(10)
    rows = [(str(k), float(x), float(y)) for k in range(8) for x, y in zip(*_random_series(rng, 60))]
    series = spark.createDataFrame(rows, "series_id string, t double, flux double")
    labels = spark.createDataFrame([(str(k), k % 2) for k in range(8)], "tic_id string, label int")
    told = pipelines.build_labelled_set(labels, series, most=3, cfg=pipelines.Config(low=1.0, high=15.0, coarse=20, refine=10))
    assert "FlatMapGroups" not in told._jdf.queryExecution().optimizedPlan().toString()
    got = told.collect()
    assert sorted(r.label for r in got) == [0, 0, 0, 1, 1, 1] and all(len(r.global_view) == 2048 for r in got)


def test_statuses_of_what_is_no_number(spark):
    rows = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (0.075,), (None,)], "x double")
    assert [r[0] for r in rows.select(S.fixed(F.col("x"), 2)).collect()] == ["inf", "-inf", "nan", "0.07", None]
