"""The search over tree settings, missing values, and the forecast of campaigns without rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hourloom.durable import durable
from hourloom.operators.horizon import fill_forecast
from hourloom.operators.split import rolling_origin_folds
from hourloom.plans import model
from hourloom.schema import TARGET

SPACE = {"maxDepth": [2, 3], "maxIter": [1, 2, 4], "stepSize": [0.3], "minInstancesPerNode": [5]}


def _rows(spark):
    rows = [("ABCD"[i % 4], dt.date(2025, 1, 1 + i // 24), i % 24, None if i % 5 == 0 else float(i % 13), float(i * 7 % 31)) for i in range(300)]
    df = spark.createDataFrame(rows, f"campaign_name string, date date, hour int, clicks double, {TARGET} double")
    return df.withColumn("hourly_window", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def folds(spark):
    return durable(model.as_inputs(rolling_origin_folds(_rows(spark), 2), ["hour", "clicks"]))


def _direct(folds, params):
    total = 0.0
    for fold in (1, 2):
        fitted = model._pipeline(["hour", "clicks"], params, 42).fit(folds.filter(F.col("fold") < fold))
        scored = fitted.transform(folds.filter(F.col("fold") == fold))
        total += scored.agg(F.sqrt(F.avg(F.pow(F.col(TARGET) - F.col("prediction"), F.lit(2.0))))).first()[0]
    return total / 2


def test_one_fit_scores_all_tree_counts(folds, monkeypatch):
    fits = []
    pipeline = model._pipeline
    monkeypatch.setattr(model, "_pipeline", lambda names, params, seed: fits.append(params) or pipeline(names, params, seed))
    settings = model.sample_space(6, 42, SPACE)
    trials = model.search_settings(folds, ["hour", "clicks"], settings, 2, 42)
    assert len(fits) == 4 and all(p["maxIter"] == 4 for p in fits)  # two depths, two folds
    monkeypatch.undo()
    assert [t["rmse"] for t in trials] == sorted(t["rmse"] for t in trials) and len(trials) == 6
    for t in trials[:3]:
        assert math.isclose(t["rmse"], _direct(folds, t["params"]), rel_tol=1e-6) and t["trees"] == t["params"]["maxIter"]


def test_halving_judges_survivors_by_all_their_trees(folds):
    settings = model.sample_space(6, 42, {**SPACE, "maxIter": [4], "maxDepth": [1, 2, 3], "stepSize": [0.1, 0.3]})
    trials = model.search_settings(folds, ["hour", "clicks"], settings, 2, 42, halving=2, least_trees=1)
    assert len(trials) == 6 and {tuple(t["params"].items()) for t in trials} == {tuple(s.items()) for s in settings}
    assert [t["trees"] for t in trials] == [4, 4, 2, 1, 1, 1]
    assert math.isclose(trials[0]["rmse"], _direct(folds, trials[0]["params"]), rel_tol=1e-6)


def test_indicators_are_fixed_at_fit_time(spark):
    df = _rows(spark)
    fitted, meta = model.train_gbt(df, n_trials=2, cv_folds=2, space={**SPACE, "maxDepth": [2], "maxIter": [1, 2]}, indicators=True)
    assert meta["feature_names"] == ["hour", "clicks", "clicks_is_null"] and len(meta["trials"]) == 2
    inputs = model.as_inputs(df, meta["feature_names"])
    assert inputs.filter((F.col("clicks_is_null") == 1.0) != (F.col("clicks") == 0.0)).filter("clicks_is_null = 1.0").count() == 0
    assert inputs.agg(F.sum("clicks_is_null")).first()[0] == 60.0
    # Without NULLs in the rows to score, the column is there all the same.
    full = df.filter("clicks is not null")
    assert model.predict(fitted, full, meta["feature_names"]).filter("clicks_is_null = 0.0").count() == full.count()


def test_fill_forecast(spark):
    start = dt.datetime(2025, 1, 1, 20)
    hourly = spark.createDataFrame([("A", 1, start, 5.0), (None, 1, start, 2.0)], "campaign_name string, horizon int, target_ts timestamp_ntz, predicted_spend double")
    totals = spark.createDataFrame([("A", 100.0), ("B", 24.0), ("C", -3.0), (None, 9.0)], "campaign_name string, predicted_spend_12h double")
    got = fill_forecast(hourly, totals, start).collect()
    assert sum(r.source == "model" for r in got) == 2 and {r.campaign_name for r in got if r.source == "fallback"} == {"B", "C"}
    b = sorted((r.horizon, r.target_ts, r.predicted_spend) for r in got if r.campaign_name == "B")
    assert [h for h, _, _ in b] == list(range(1, 13)) and b[11][1] == start + dt.timedelta(hours=11)
    assert math.isclose(sum(v for _, _, v in b), 24.0) and all(r.predicted_spend == 0 for r in got if r.campaign_name == "C")


def test_every_known_campaign_gets_a_forecast(spark):
    df = _rows(spark).withColumn("campaign_name", F.when((F.col("campaign_name") == "D") & (F.col("date") < "2025-01-05"), "old").otherwise(F.col("campaign_name")))
    df = df.filter("campaign_name <> 'old' or date < '2025-01-05'")
    fitted, meta = model.train_gbt(df, n_trials=1, space={**SPACE, "maxDepth": [2], "maxIter": [2]})
    start = dt.datetime(2025, 2, 1, 8)
    got = model.score_hourly_filled(fitted, model.rows_to_forecast(df), df, meta["feature_names"], start)
    sources = {(r.campaign_name, r.source): r.n for r in got.groupBy("campaign_name", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sources[("old", "fallback")] == 12 and all(n == 12 for n in sources.values())
    assert {k for k, s in sources if s == "model"} == {"A", "B", "C", "D"}
