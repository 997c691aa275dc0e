"""Contracts of the model jobs, on one small run of the whole pipeline."""

import datetime as dt

from pyspark.sql import functions as F

from hourloom.operators.split import split_data
from hourloom.plans import jobs, model
from hourloom.plans.model import sample_space, SEARCH_SPACE
from hourloom.schema import TARGET
from hourloom.sources import files
from tests.helpers import frame, random_facts

SMALL = {"maxDepth": [2, 3], "maxIter": [2], "stepSize": [0.2], "minInstancesPerNode": [5]}


def test_search_space_sample():
    picks = sample_space(20, 42, SEARCH_SPACE)
    assert len({tuple(p.items()) for p in picks}) == 20
    assert picks == sample_space(20, 42, SEARCH_SPACE)
    assert len(sample_space(100, 1, SMALL)) == 2


def test_training_rows_without_dates(spark):
    df = spark.createDataFrame(
        [("A", i % 24, float(i), float(i * 2)) for i in range(60)],
        f"campaign_name string, hour int, clicks double, {TARGET} double",
    )
    fitted, meta = model.train_gbt(df, n_trials=2, cv_folds=2, space=SMALL)
    assert meta["feature_names"] == ["hour", "clicks"] and meta["best_cv_rmse"] > 0
    assert model.predict(fitted, df, meta["feature_names"]).count() == 60


def test_pipeline(spark, tmp_path):
    raw = str(tmp_path / "raw.parquet")
    files.sink_any(frame(spark, random_facts(campaigns=5, hours=72)), raw, "parquet")
    paths = {n: str(tmp_path / n) for n in ("model_path", "predictions_path", "report_path")}
    paths["scoring_path"] = str(tmp_path / "scoring.parquet")
    data = str(tmp_path / "processed.parquet")
    results = jobs.run_pipeline(
        spark, raw_path=raw, processed_path=data, start=dt.datetime(2025, 1, 4, 20), fetch_data=False,
        n_trials=1, cv_folds=2, space=SMALL, evaluate_model_flag=False, **paths,
    )
    assert results["dataset_shape"][1] == 106
    metrics = results["training_metrics"]
    for name in ("mae", "rmse", "r2", "smape", "wmape"):
        assert metrics[f"train_{name}"] is not None and metrics[f"test_{name}"] is not None
    hourly = results["predictions"].collect()
    per_campaign = {}
    for r in hourly:
        assert r["predicted_spend"] >= 0
        per_campaign.setdefault(r["campaign_name"], []).append(r["horizon"])
    assert all(sorted(h) == list(range(1, 13)) for h in per_campaign.values())
    wide = files.scan_any(spark, f"{paths['predictions_path']}/wide", "csv")
    assert wide.columns[0] == "Campaign" and len(wide.columns) == 13 and wide.count() == len(per_campaign)
    long = files.scan_any(spark, f"{paths['predictions_path']}/long", "csv")
    assert long.columns == ["campaign_name", "predicted_spend_12h", "timestamp"]

    newest = spark.read.parquet(paths["scoring_path"])
    assert {r["campaign_name"] for r in newest.collect()} == set(per_campaign)
    assert newest.agg(F.max("hour")).first()[0] >= 20  # the last rows of the day are kept

    report = jobs.evaluation_job(spark, data, paths["model_path"], paths["report_path"], n_repeats=1)
    text = "\n".join(r[0] for r in spark.read.text(f"{paths['report_path']}/report").collect())
    assert "MAE" in text and "n_samples" in text and report["top_features"].count() == 10

    fitted, names = model.load_for_scoring(spark, paths["model_path"])
    assert TARGET not in names and "campaign_name" not in names and "spend" not in names and len(names) == 101
    rows = files.scan_any(spark, data)
    _, test = split_data(rows, 0.2)
    scored = model.score_12h(fitted, rows, names)
    for r in model.predict_interval(scored, model.predictions(fitted, test, names), 50).collect():
        assert r["lower_95"] <= r["upper_95"] and r["std"] > 0
    importance = {r["feature"]: r["importance"] for r in model.importance_permutation(fitted, test, names, 1).collect()}
    builtin = {r["feature"]: r["importance"] for r in model.importance_builtin(spark, fitted, names).collect()}
    assert set(importance) == set(builtin) == set(names)
    assert all(importance[f] == 0 for f, g in builtin.items() if g == 0)
