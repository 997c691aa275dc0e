"""Ranks of values that crowd into one bucket, and the scatter tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from hourloom.operators import metrics
from hourloom.operators.quantiles import _counts_before, value_ranks


def _expected(values):
    counts, seen, out = collections.Counter(v for v in values if v is not None and v == v), 0, []
    for v in sorted(counts):
        out.append((v, seen, counts[v]))
        seen += counts[v]
    return out


@pytest.mark.parametrize("name,values", [
    ("one step", [1.0 + i * 2.0**-52 for i in range(700)] * 2),
    ("tiny", [i * 5e-324 for i in range(400)] + [-i * 1e-310 for i in range(300)]),
    ("mixed", [random.Random(1).gauss(0, 1) ** 9 for _ in range(600)] + [0.0, -0.0, float("inf"), float("-inf"), float("nan"), None, 1e308, -1e308]),
    ("clusters", [1.0 + 1e-9 * 2.0**-k for k in range(50)] + [1.0] * 30),
])
def test_ranks(spark, name, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for crowded in (65_536, 20):
        got = sorted(((r.v, r.first, r.copies) for r in map(_row, value_ranks(df, "v", crowded).collect())), key=lambda r: r[0])
        assert got == _expected(values), (name, crowded)


_Row = collections.namedtuple("_Row", "v first copies")


def _row(r):
    return _Row(r["v"], r["first"], r["copies"])


def test_no_window_orders_a_crowded_bucket(spark):
    runs = spark.range(5000).select(F.lit(1).alias("_bucket"), (F.lit(1.0) + F.col("id") * F.lit(2.0**-52)).alias("_x"), F.lit(1).cast("long").alias("copies"))
    ranked = _counts_before(runs, ["_bucket"], 100)
    assert ranked.agg(F.max("_before")).first()[0] == 4999 and ranked.select("_before").distinct().count() == 5000


def test_no_values(spark):
    assert value_ranks(spark.createDataFrame([(None,), (float("nan"),)], "v double"), "v").count() == 0


def test_scatter_tables(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.random() * 9, rng.choice([None, 1.0, rng.random()])) for i in range(2000)], "id int, actual double, predicted double")
    some = metrics.scatter_pairs(df, 0.25, ("id",))
    assert 400 < some.count() < 600 and sorted(some.collect(), key=str) == sorted(metrics.scatter_pairs(df.repartition(7), 0.25, ("id",)).collect(), key=str)
    assert some.select("line_max").first() == metrics.scatter_pairs(df).select("line_max").first()
    with pytest.raises(ValueError):
        metrics.scatter_pairs(df, 0.25)
    bins = metrics.scatter_bins(df, 10).collect()
    assert sum(r.n_rows for r in bins) == df.filter("predicted is not null").count()
    assert all(0 <= r.actual_bin < 10 and 0 <= r.predicted_bin < 10 for r in bins)
    assert metrics.scatter_bins(df.limit(0)).count() == 0
