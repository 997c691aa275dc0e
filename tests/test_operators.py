"""Scalars, quality, quantiles, splits, resampling and metrics."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.functions import scalars as S
from hourloom.operators import campaign as C
from hourloom.operators import horizon as H
from hourloom.operators import metrics as M
from hourloom.operators import quality as Q
from hourloom.operators import split as X
from hourloom.operators import timeseries as T
from hourloom.operators.projections import add_temporal_features
from hourloom.operators.quantiles import exact_quantiles
from hourloom.sources import files, insights
from hourloom.streaming.ingest import ingest_new_pages
from tests.helpers import assert_same_rows, fact, frame, random_facts


def test_to_num(spark):
    given = [None, "", " 1.5 ", "x", "nan", "inf", "-3.9", "1e3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    out = df.select("i", S.to_num(F.col("t")).alias("n"), S.to_count(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r["n"] for r in out] == [0, 0, 1.5, 0, 0, 0, -3.9, 1000]
    assert [r["w"] for r in out] == [0, 0, 1, 0, 0, 0, -3, 1000]


def test_flatten_edge_rows(spark, tmp_path):
    page = (
        '{"data":[{"campaign_name":"A","date_start":"2025-01-02","spend":null,"impressions":12.9,"clicks":"",'
        '"hourly_stats_aggregated_by_advertiser_time_zone":"01:00:00 - 01:59:59",'
        '"actions":[{"action_type":"add_to_cart","value":"2"},{"action_type":"omni_add_to_cart","value":3},'
        '{"action_type":"","value":"9"},{"action_type":"post","value":"x"}]},'
        '{"date_start":"bad","hourly_stats_aggregated_by_advertiser_time_zone":"2025-01-03T05:00","spend":"1.25"},'
        '{"date_start":"bad","hourly_stats_aggregated_by_advertiser_time_zone":"05:00:00"}],"paging":{"next":null}}'
    )
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.json").write_text(page + "\n" + '{"data":[],"paging":{}}\n')
    flat = insights.flatten_insights(insights.scan_insight_pages(spark, str(tmp_path / "in")))
    rows = {(r["campaign_name"], r["hourly_window"]): r for r in flat.collect()}
    a = rows["A", "01:00:00 - 01:59:59"]
    assert (a["spend"], a["impressions"], a["clicks"], a["add_to_cart"], a["post"]) == (0.0, 12, 0, 5, 0)
    assert rows["", "2025-01-03T05:00"]["date"] == "2025-01-03"
    assert rows["", "05:00:00"]["date"] == ""

    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    ingest_new_pages(spark, str(tmp_path / "in"), out, offsets)
    ingest_new_pages(spark, str(tmp_path / "in"), out, offsets)  # nothing new
    assert spark.read.parquet(out).count() == 3


def test_validate(spark):
    rows = [fact("A", 0, 1, 5.0), fact("A", 0, 2, -1.0), fact("A", 0, 3, None), fact("A", 0, 4, float("nan"))]
    dirty = frame(spark, rows).withColumn(
        "date", F.when(F.col("hourly_window").startswith("01"), "nope").otherwise(F.col("date").cast("string"))
    )
    out = Q.validate(dirty).collect()
    assert sorted(r["spend"] for r in out) == [0.0, 0.0]
    with pytest.raises(ValueError, match="spend"):
        Q.validate(dirty.drop("spend"))


def test_parse_timestamp(spark):
    texts = ["2025-01-02 03:04:05", "2025-01-02T03:04:05", "2025-01-02 03:04:05.5", "2025-01-02T03:04:05.123456", "2025-01-02", "02.01.2025"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r[0] for r in df.select(S.parse_timestamp(F.col("t"))).collect()]
    base = dt.datetime(2025, 1, 2, 3, 4, 5)
    assert out == [base, base, base.replace(microsecond=500000), base.replace(microsecond=123456), dt.datetime(2025, 1, 2), None]


def test_time_windows(spark):
    out = T.get_time_windows(spark, "2025-01-01 00:00:00", "2025-01-01 02:30:00").orderBy("window_start").collect()
    assert [r["window_end"] - r["window_start"] for r in out] == [dt.timedelta(hours=1)] * 2 + [dt.timedelta(minutes=30)]
    assert T.get_time_windows(spark, "2025-01-02", "2025-01-01").count() == 0


def test_published_hourly_spread(spark):
    """Totals and hourly values published for four campaigns, night weight 0.3 from 8 PM."""
    totals = {"a": 151.79930945089419, "b": 174.3040142569786, "c": 173.59185123527624, "d": 227.5977918351389}
    expected = {
        "a": [26.79, 22.32, *[6.7] * 8, 22.32, 26.79],
        "b": [30.76, 25.63, *[7.69] * 8, 25.63, 30.76],
        "c": [30.63, 25.53, *[7.66] * 8, 25.53, 30.63],
        "d": [40.16, 33.47, *[10.04] * 8, 33.47, 40.16],
    }
    df = spark.createDataFrame(list(totals.items()), "campaign_name string, predicted_spend_12h double")
    start = dt.datetime(2025, 10, 25, 20)
    wide = H.forecast_wide(H.weight_distribution(df, 20, night=0.3), start)
    assert wide.columns == ["Campaign", "08 PM", "09 PM", "10 PM", "11 PM", "12 AM", "01 AM", "02 AM", "03 AM", "04 AM", "05 AM", "06 AM", "07 AM"]
    assert {r[0]: list(r[1:]) for r in wide.collect()} == expected


def test_horizon_frame_moves_the_calendar(spark):
    latest = frame(spark, [fact("A", 3, 22, 5.0)]).transform(Q.validate).transform(add_temporal_features)
    out = {r["horizon"]: r for r in H.build_horizon_frame(latest).collect()}
    assert sorted(out) == list(range(1, 13))
    assert (str(out[1]["date"]), out[1]["hour"], out[1]["is_weekend"]) == ("2025-01-04", 23, 1)
    assert (str(out[12]["date"]), out[12]["hour"], out[12]["is_business_hours"]) == ("2025-01-05", 10, 1)


def test_forecast_columns_follow_the_clock(spark):
    latest = frame(spark, [fact("A", 3, 22, 5.0), fact("B", 3, 20, 7.0)]).transform(Q.validate).transform(add_temporal_features)
    start = dt.datetime(2025, 1, 4, 0)
    same = {(r["campaign_name"], r["horizon"]): r["target_ts"] for r in H.build_horizon_frame(latest, start=start).collect()}
    assert all(same[c, h] == start + dt.timedelta(hours=h - 1) for c in "AB" for h in range(1, 13))
    zone = spark.conf.get("spark.sql.session.timeZone")
    base = {r["campaign_name"]: dt.datetime.combine(r["date"], dt.time(r["hour"])) for r in latest.select("campaign_name", "date", "hour").collect()}
    for name in (zone, "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", name)
        hourly = H.build_horizon_frame(latest).withColumn("predicted_spend", F.col("horizon").cast("double"))
        first = base["A"] + dt.timedelta(hours=1)
        wide = {r[0]: list(r[1:]) for r in H.forecast_wide(hourly, first).collect()}
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert wide == {"A": [float(h) for h in range(1, 13)], "B": [*[float(h) for h in range(3, 13)], 0.0, 0.0]}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 100, 500), "b": np.repeat([1.0, 2.0, 2.0, 9.0], 50), "c": np.array([4.0]), "d": rng.exponential(1e-3, 77)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, x double")
    levels = [0.0, 1 / 3, 0.5, 0.67, 1.0]
    for r in exact_quantiles(df, "x", levels, ["k"]).collect():
        assert np.allclose(r["q"], np.quantile(groups[r["k"]], levels), rtol=1e-12, atol=1e-12)
    whole = exact_quantiles(df, "x", levels).first()["q"]
    assert np.allclose(whole, np.quantile(np.concatenate(list(groups.values())), levels))


def test_tiers_with_equal_edges(spark):
    df = frame(spark, [fact(c, 0, h, 5.0) for c in "AB" for h in range(3)])
    assert {r["spend_level"] for r in C.campaign_tiers(df).collect()} == {"low"}
    assert {r["spend_level"] for r in C.add_campaign_clusters(df.transform(add_temporal_features)).collect()} == {0}


def test_splits_are_exact_with_copies(spark):
    rows = random_facts(hours=60) + [fact("copy", 1, 5, 7.0)] * 300
    df = frame(spark, rows).transform(Q.validate).transform(add_temporal_features)
    n = len(rows)
    train, test = X.split_data(df, 0.2, "time")
    assert (train.count(), test.count()) == (int(n * 0.8), n - int(n * 0.8))
    latest, earliest = (d.agg(F.max("date"), F.min("date")).first() for d in (train, test))
    assert latest[0] <= earliest[0] or latest[0] == earliest[1]
    assert_same_rows(train.unionByName(test), df)
    folds = {r["fold"]: r["count"] for r in X.rolling_origin_folds(df, 5).groupBy("fold").count().collect()}
    block = n // 6
    assert folds == {0: n - 5 * block, **{i: block for i in range(1, 6)}}
    with pytest.raises(ValueError):
        X.split_data(df, 0.2, "other")


def test_split_by_campaign(spark):
    df = frame(spark, [fact(f"K{i}", 0, h, 1.0) for i in range(11) for h in range(2)])
    train, test = X.split_data(df, 0.2)
    a, b = ({r[0] for r in d.select("campaign_name").distinct().collect()} for d in (train, test))
    assert len(b) == int(11 * 0.2) and not a & b and len(a | b) == 11
    assert {r[0] for r in X.split_data(df, 0.2)[1].select("campaign_name").distinct().collect()} == b
    assert X.split_data(df, 0.0)[1].count() == 0


def test_resample_and_gaps(spark):
    rows = [fact("A", 0, 0, 1.0), fact("A", 0, 1, 2.0), fact("A", 0, 5, 4.0), fact("B", 0, 3, 1.0)]
    df = T.with_event_ts(frame(spark, rows).transform(Q.validate).transform(add_temporal_features))
    out = T.resample_series(df).filter("campaign_name = 'A'").orderBy("bucket_ts").collect()
    assert [r["spend"] for r in out] == [1, 2, 0, 0, 0, 4]
    assert [r["is_missing_hour"] for r in out] == [0, 0, 1, 1, 1, 0]
    assert out[2]["ctr"] is None
    assert {r["campaign_name"]: r["n_gaps"] for r in T.gap_detect(df).collect()} == {"A": 1, "B": 0}
    checks = T.series_validate(df).first()
    assert (checks["missing_dates"], checks["duplicate_timestamps"], checks["time_gaps"]) == (True, True, False)
    assert Q.duplicate_detect(df.unionByName(df.limit(1))).count() == 1


def test_metrics(spark):
    y, p = [0.0, 0.0, 10.0, 20.0], [0.0, 1.0, 8.0, 25.0]
    df = spark.createDataFrame([("A", a, b, 1.0) for a, b in zip(y, p)], "campaign_name string, actual double, predicted double, w double")
    m = M.comprehensive_evaluation(df, df).first()
    assert math.isclose(m["mae"], 2.0) and math.isclose(m["rmse"], math.sqrt(30 / 4))
    assert math.isclose(m["r2"], 1 - 30 / (sum(v * v for v in y) - 4 * statistics.fmean(y) ** 2))
    assert math.isclose(m["smape"], (0 + 2 + 2 / 9 + 5 / 22.5) / 4 * 100)
    assert math.isclose(m["wmape"], 7 / 30 * 100)
    assert (m["zero_actuals"], m["zero_predictions"], m["n_samples"], m["train_mae"]) == (2, 1, 4, 2.0)
    assert M.zero_inflation(df).first()["model_bias"] == "Under-predicting zeros"
    assert math.isclose(df.agg(M.wmape("w").alias("x")).first()["x"], (0 + 1e6 + 0.2 + 0.25) * 100)
    zeros = df.withColumn("actual", F.lit(0.0))
    flat = M.regression_metrics(zeros).first()
    assert flat["wmape"] is None and flat["r2"] == 0.0
    assert M.residual_histogram(zeros.withColumn("predicted", F.lit(2.0))).agg(F.sum("n")).first()[0] == 4
    report = M.campaign_error_report(df).first()
    assert (report["abs_error_median"], report["actual_count"], report["mae"]) == (1.5, 4, 2.0)


def test_files(spark, tmp_path):
    df = frame(spark, [fact("A", 0, 1, 5.0)])
    for fmt in ("csv", "parquet", "json"):
        path = files.sink_any(df, str(tmp_path / f"x.{fmt}"), fmt)
        assert_same_rows(files.scan_any(spark, path, schema=df.schema), df)
    with pytest.raises(ValueError):
        files.sink_any(df, str(tmp_path / "x.orc"), "orc")
    with pytest.raises(ValueError):
        files.scan_any(spark, str(tmp_path / "x.unknown"))
    with pytest.raises(FileNotFoundError):
        files.scan_any(spark, str(tmp_path / "absent.csv"))
    assert files.list_files(spark, str(tmp_path / "absent")).count() == 0
    assert files.latest_file(spark, str(tmp_path / "absent")).first()["path"] is None
    assert files.list_files(spark, str(tmp_path / "x.json"), "*.json").count() >= 1


def test_resample_keeps_null_campaign(spark):
    rows = [fact(None, 0, h, 5.0) for h in (1, 2, 4)]
    df = frame(spark, rows).selectExpr("campaign_name", "spend", "cast(date as timestamp_ntz) + make_dt_interval(0, cast(split(hourly_window, ':')[0] as int)) as event_ts")
    got = sorted((r.bucket_ts.hour, r.spend, r.is_missing_hour) for r in T.resample_series(df, "hour", {"spend": "sum"}).collect())
    assert got == [(1, 5.0, 0), (2, 5.0, 0), (3, 0.0, 1), (4, 5.0, 0)]


def test_quantiles_leave_out_nan(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    assert exact_quantiles(df, "x", [0.5]).first().q == [2.0]


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from hourloom import durable

    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder or d), sparkContext=context)

    with pytest.raises(ValueError):
        durable.scratch_path(session("spark://host:7077"), "x")
    assert durable.scratch_path(session("spark://host:7077", "/shared"), "x").startswith("/shared/")
    assert durable.scratch_path(session("local[2]"), "x").endswith("/x")
