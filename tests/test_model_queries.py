"""The registered model queries do the operator's whole job: all features, the whole grid, all folds, all tables."""

import math

import pytest

import __spark_entry__ as entry
from hourloom.durable import durable
from hourloom.plans import jobs, model, prepare

SF = "/root/testdata/sf0.001"
QUERIES = ["train_gbt", "train_job", "model_save_load", "score_12h", "score_hourly", "predict_two_stage", "fallback_distribution"]
QUERIES += ["forecast_job", "predict_interval", "importance_builtin", "importance_permutation", "evaluation_report", "run_pipeline"]


class Seen(Exception):
    pass


@pytest.fixture(scope="module")
def features(spark):
    return durable(prepare.feature_table(entry._facts(spark, SF)))


@pytest.mark.parametrize("name", QUERIES)
def test_search_is_whole(spark, monkeypatch, features, name):
    def train(df, features=None, n_trials=100, cv_folds=5, random_state=42, space=None, parallelism=4):
        raise Seen(len(features or model.feature_names(df)), n_trials, cv_folds, math.prod(map(len, space.values())))

    # All queries build the same table; it is made once.
    monkeypatch.setattr(prepare, "feature_table", lambda df, **lanes: features)
    monkeypatch.setattr(model, "train_gbt", train)
    with pytest.raises(Seen) as seen:
        entry.queries()[name](spark, SF)
    n_features, n_trials, folds, grid = seen.value.args
    assert n_features == 101 and folds == 5 and n_trials == grid > 1


def test_forecast_covers_scoring_rows(spark):
    got = {r.campaign_name for r in entry.queries()["forecast_job"](spark, SF).select("campaign_name").distinct().collect()}
    want = {r.campaign_name for r in prepare.scoring_rows(entry._facts(spark, SF)).select("campaign_name").collect()}
    assert got == want


def test_report_tables_are_all_returned(spark, monkeypatch):
    # One setting is enough for the shape of the report.
    monkeypatch.setattr(entry, "TRIALS", 1)
    repeats = []
    whole = model.importance_permutation
    monkeypatch.setattr(jobs, "importance_permutation", lambda m, df, names, n: repeats.append(n) or whole(m, df, names, 1))
    tables = {r.report_table for r in entry.queries()["evaluation_report"](spark, SF).select("report_table").distinct().collect()}
    assert len(tables) == 10 and {"metrics", "qq", "scatter", "campaign_mae", "feature_importance"} <= tables and repeats == [5]
