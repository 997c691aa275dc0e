"""Ties, time zones, lengths, bad pages and intervals."""

import pytest
from pyspark.sql import functions as F

from hourloom.functions import scalars as S
from hourloom.operators import series as R
from hourloom.operators import timeseries as T
from hourloom.operators.quantiles import value_ranks
from hourloom.plans.model import predict_interval
from hourloom.sources import insights
from tests.helpers import fact, frame


def test_latest_row_is_the_last_of_the_series(spark):
    rows = [fact(f"K{c}", 0, 5, float(i)) for c in range(6) for i in range(8)]
    df = frame(spark, rows).withColumn("hour", F.lit(5))
    lagged = R.add_lag_features(df, (1,), ("spend",))
    earlier = {(r.campaign_name, r.spend_lag_1h) for r in lagged.collect()}
    for r in R.latest_row(lagged).collect():
        # Nobody's previous row, so it is the last one.
        assert r.spend == 0.0 or (r.campaign_name, r.spend) not in earlier


def test_wall_clock_without_zone(spark):
    df = spark.createDataFrame([("2025-03-09 02:30:00",), ("bad",)], "t string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r[0] for r in df.select(S.parse_timestamp(F.col("t")).cast("string")).collect()]
            assert got == ["2025-03-09 02:30:00", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    with pytest.raises(Exception, match="no known timestamp pattern"):
        df.select(S.parse_timestamp(F.col("t"), strict=True)).collect()


def test_lengths(spark):
    assert [T.step_us(x) // 60_000_000 for x in ("15 minutes", 2, "hour", "24H", "7D")] == [15, 120, 60, 1440, 10080]
    with pytest.raises(ValueError):
        T.step_us("2 moons")
    df = spark.sql("select 'A' campaign_name, timestamp_ntz'2025-01-01 00:05:00' event_ts, 1.0D spend union all select 'A', timestamp_ntz'2025-01-01 00:50:00', 2.0D")
    out = T.resample_series(df, "15 minutes", {"spend": "sum"}).orderBy("bucket_ts").collect()
    assert [(r.bucket_ts.minute, r.spend, r.is_missing_hour) for r in out] == [(0, 1.0, 0), (15, 0.0, 1), (30, 0.0, 1), (45, 2.0, 0)]


def test_bad_pages_are_not_lost(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": []}\n{"data": [\n')
    with pytest.raises(Exception):
        insights.scan_insight_pages(spark, str(tmp_path)).collect()
    assert [r.page for r in insights.rejected_pages(spark, str(tmp_path)).collect()] == ['{"data": [']
    assert insights.scan_insight_pages(spark, str(tmp_path), mode="DROPMALFORMED").count() == 0


def test_interval_draws_from_all_residuals(spark):
    values = [float(i % 7) for i in range(50)] + [None, float("nan"), -3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = sorted((r["first"], r.v, r.copies) for r in value_ranks(df, "v").collect())
    assert ranks[0] == (0, -3.0, 1) and sum(r[2] for r in ranks) == 51
    holdout = df.select(F.col("v").alias("actual"), F.lit(0.0).alias("predicted"))
    predicted = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "campaign_name string, predicted_spend_12h double")
    for r in predict_interval(predicted, holdout).collect():
        assert r.prediction - 3 <= r.lower_95 <= r.upper_95 <= r.prediction + 6 and r.std > 1
    with pytest.raises(ValueError):
        predict_interval(predicted, holdout.limit(0))
