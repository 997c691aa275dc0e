"""Time frames and carried values in blocks of time, against brute force: hot campaigns, ties, nulls, times before 1970."""

import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from hourloom.operators import timeseries as T

ZERO = datetime.datetime(1970, 1, 1)


def _rows():
    rng = random.Random(8)
    rows = []
    for i in range(400):
        key = rng.choice(["hot", "hot", "hot", "cold", None])
        at = ZERO + datetime.timedelta(hours=rng.randint(-200, 200), microseconds=rng.choice([0, 1, 999_999, 3_599_999_999]))
        rows.append((i, key, None if i % 37 == 0 else at, rng.choice([None, 0.0, 0.0, 2.5, rng.random() * 9])))
    return rows + [(1000 + i, "flat", ZERO + datetime.timedelta(minutes=i), 7.0) for i in range(50)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id int, campaign_name string, event_ts timestamp_ntz, spend double")


def _us(t):
    return (t - ZERO) // datetime.timedelta(microseconds=1)


@pytest.mark.parametrize("hot_rows,block_cells", [(10**6, 1), (0, 10**6), (0, 3), (100, 8)])
def test_rolling_time(spark, hot_rows, block_cells):
    rows = _rows()
    lengths = {"a": "24H", "b": "90 minutes", "c": "3D"}
    got = T.rolling_time(_frame(spark, rows), lengths, ("spend",), hot_rows=hot_rows, block_cells=block_cells)
    got = {r.id: r for r in got.collect()}
    assert len(got) == len(rows)
    for i, key, at, _ in rows:
        for name, length in lengths.items():
            inside = [
                v for _, k, t, v in rows
                if k == key and v is not None and ((t is None) == (at is None)) and (at is None or 0 <= _us(at) - _us(t) < T.step_us(length))
            ]
            mean, std = got[i][f"spend_rolling_mean_{name}"], got[i][f"spend_rolling_std_{name}"]
            assert mean is None if not inside else math.isclose(mean, statistics.fmean(inside), abs_tol=1e-9), (i, name)
            assert std is None if len(inside) < 2 else math.isclose(std, statistics.stdev(inside), abs_tol=1e-6), (i, name)


@pytest.mark.parametrize("block_hours", [1, 24])
def test_carried_values(spark, block_hours):
    rows = _rows()
    got = {r.id: r[1] for r in T.hours_since_positive_spend(_frame(spark, rows), block_hours=block_hours).select("id", "hours_since_positive_spend").collect()}
    for i, key, at, _ in rows:
        earlier = [_us(t) for _, k, t, v in rows if k == key and at is not None and t is not None and t < at and v is not None and v > 0]
        expected = (_us(at) - max(earlier)) / T.HOUR_US if earlier else None
        assert got[i] is None if expected is None else math.isclose(got[i], expected), i


@pytest.mark.parametrize("hours", [1, 2, 30])
def test_gaps(spark, hours):
    rows = _rows()
    got = {r.campaign_name: r.n_gaps for r in T.gap_detect(_frame(spark, rows), hours=hours).collect()}
    for key in {r[1] for r in rows}:
        times = sorted({_us(t) for _, k, t, _ in rows if k == key and t is not None})
        assert got[key] == sum(b - a > hours * T.HOUR_US for a, b in zip(times, times[1:]))


def test_no_rows(spark):
    none = _frame(spark, [])
    assert T.rolling_time(none, ("24H",), ("spend",)).count() == 0
    assert T.gap_detect(none).count() == 0
    assert T.hours_since_positive_spend(none).count() == 0
    assert T.series_validate(none).collect()[0] == (True, True, True)


def test_no_window_orders_a_whole_hot_campaign(spark):
    rows = [(i, "hot", ZERO + datetime.timedelta(seconds=i), float(i % 5)) for i in range(3000)]
    cells = T._cells(_frame(spark, rows), ("spend",), "event_ts").withColumn("_us", T._us("_t"))
    block = T._block_us(cells, {"a": T.step_us("24H"), "b": T.step_us("7D")}, 100)
    assert T.step_us("24H") % block == 0
    assert cells.groupBy("_k", F.floor(F.col("_us") / block)).count().agg(F.max("count")).first()[0] <= 100
