"""Groups of many rows are cut until no window orders more than a few, with the same places as one sort."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from hourloom.operators import lanes, ranks, split
from hourloom.operators.quantiles import exact_quantiles
from tests.helpers import fact, frame


def test_digits_keep_the_order_of_numbers(spark):
    numbers = [-(2**63), -(2**40), -2, -1, 0, 1, 17, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", ranks.digits(F.col("n")).alias("d"))
    rows = sorted(df.collect(), key=lambda r: r.d)
    assert [r.n for r in rows] == numbers and {len(r.d) for r in rows} == {16}


@pytest.mark.parametrize("crowded", [65_536, 50, 1])
def test_copies_before(spark, crowded):
    rng = random.Random(5)
    heads = ["000000", "0000ff", "abcdef"]
    keys = {(g, rng.choice(heads) + f"{rng.randrange(4096):03x}" + f"{rng.randrange(4096):03x}") for g in ("a", "b", None) for _ in range(150 if g != "b" else 9)}
    rows = [(g, k, rng.randrange(1, 5)) for g, k in keys]
    df = spark.createDataFrame(rows, "g string, key string, n long")
    got = {(r.g, r.key): r.before for r in ranks.copies_before(df, ["g"], "key", "n", "before", crowded, length=12).collect()}
    assert got == {(g, k): sum(m for h, j, m in rows if h == g and j < k) for g, k, _ in rows}


def test_rows_of_equal_keys_stay_together(spark):
    df = spark.range(40).select(F.lit("x").alias("g"), F.lit("abcabc").alias("key"), F.lit(1).cast("long").alias("n"))
    got = sorted(r.before for r in ranks.copies_before(df, ["g"], "key", "n", "before", 10, length=6).collect())
    assert got == list(range(40))


def test_split_of_one_hour_and_one_campaign(spark):
    """All rows share campaign, date, hour and window, so only the hashes of the rows divide them."""
    rows = [fact("K", 0, 5, float(i)) for i in range(300)] + [fact("K", 0, 5, 7.0)] * 100
    df = frame(spark, rows).withColumn("hour", F.lit(5))
    plain = split.segment_by_rank(df, [F.lit(100), F.lit(333)])
    cut = split.segment_by_rank(df, [F.lit(100), F.lit(333)], crowded=20)
    assert {r.segment: r["count"] for r in cut.groupBy("segment").count().collect()} == {0: 100, 1: 233, 2: 67}
    seen = lambda d: sorted((r.spend, r.segment) for r in d.collect())
    assert seen(plain) == seen(cut) and len(seen(cut)) == 400
    assert split.segment_by_rank(df.limit(0), [F.lit(0)], crowded=20).count() == 0


def test_positions_in_a_crowded_hour(spark):
    rows = [fact(k, 0, 5, float(i)) for k in ("K", None) for i in range(200)] + [fact("K", 0, 5, 7.0)] * 50 + [fact("K", 1, 5, 1.0)]
    df = frame(spark, rows).withColumn("hour", F.lit(5))
    places = lambda crowded: sorted((str(r.campaign_name), r._first, r._copies, r.spend) for r in lanes.series_positions(df, crowded).collect())
    got = places(10)
    assert got == places(65_536)
    for name, n in (("K", 251), ("None", 200)):
        own = [(first, copies) for k, first, copies, _ in got if k == name]
        assert own[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(own, own[1:])) and sum(own[-1]) == n
    # The tie of the cold lane, a pair of numbers, gives the same order.
    tie = df.select("spend", lanes.series_tie(df.columns).alias("t")).filter("campaign_name is null").collect()
    assert [r.spend for r in sorted(tie, key=lambda r: r.t)] == [s for k, _, _, s in got if k == "None"]


@pytest.mark.parametrize("values", [
    [1e-9 * i for i in range(301)],
    [1.0 + i * 2.0**-52 for i in range(300)],
    [5.0] * 100 + [5.0 + 1e-12 * i for i in range(200)],
    [-3.0, float("inf"), 0.0, -0.0, 1e300, 5e-324, -1e-300, 2.0],
])
def test_quantiles_of_crowded_buckets(spark, values):
    rows = [(k, v) for k in ("a", "", None) for v in values] + [("z", None), ("z", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double")
    for crowded in (65_536, 15):
        got = {r.k: r.q for r in exact_quantiles(df, "x", [0.0, 0.5, 0.9], ["k"], crowded).collect()}
        assert set(got) == {"a", "", None}
        for q in got.values():
            assert q[0] == min(values) and q[1] == pytest.approx(statistics.median(values), rel=1e-15)
            rank = 0.9 * (len(values) - 1)
            low = sorted(values)[int(rank)], sorted(values)[min(int(rank) + 1, len(values) - 1)]
            assert low[0] <= q[2] <= low[1]
