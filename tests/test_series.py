"""Windows over campaign series against brute force, on both lanes."""

import statistics

import pytest
from pyspark.sql import functions as F

from hourloom.operators import campaign as C
from hourloom.operators import series as R
from hourloom.operators.lanes import series_positions
from hourloom.operators.projections import add_temporal_features
from hourloom.operators.quality import validate
from hourloom.plans.prepare import feature_table, gap_features, prepare_features, engineer_features
from tests.helpers import assert_same_rows, fact, frame, random_facts, same_value

HOT = {"hot_rows": 5, "block_rows": 7}


def cleaned(spark, rows):
    return frame(spark, rows).transform(validate).transform(add_temporal_features)


def by_campaign(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["campaign_name"], r["date"], r["hour"], r["hourly_window"])):
        out.setdefault(r["campaign_name"], []).append(r)
    return out


@pytest.mark.parametrize("lanes", [{}, HOT], ids=["cold", "hot"])
def test_offsets_and_frames_match_brute_force(spark, lanes):
    df = cleaned(spark, random_facts())
    lagged = R.add_lag_features(df, (1, 5), **lanes)
    both = R.add_expanding_features(R.add_spend_changed(lagged, **lanes), **lanes)
    for rows in by_campaign(both.collect()).values():
        for i, r in enumerate(rows):
            for k in (1, 5):
                assert r[f"spend_lag_{k}h"] == (rows[i - k]["spend"] if i >= k else 0)
            past = [x["spend"] for x in rows[: i + 1]]
            assert same_value(r["spend_expanding_sum"], sum(past))
            assert same_value(r["spend_expanding_mean"], sum(past) / len(past))
            assert r["hours_since_last_spend"] == int(i == 0 or r["spend"] != rows[i - 1]["spend"])


@pytest.mark.parametrize("lanes", [{}, HOT], ids=["cold", "hot"])
def test_rolling_matches_brute_force(spark, lanes):
    df = cleaned(spark, random_facts(campaigns=2))
    out = R.add_rolling_features(df, (1, 2, 3), ("spend", "ctr"), **lanes)
    for rows in by_campaign(out.collect()).values():
        for i, r in enumerate(rows):
            for d in (1, 2, 3):
                for c in ("spend", "ctr"):
                    seen = [x[c] for x in rows[max(0, i - 24 * d + 1) : i + 1]]
                    assert same_value(r[f"{c}_rolling_mean_{d}d"], statistics.fmean(seen))
                    std = statistics.stdev(seen) if len(seen) > 1 else None
                    assert same_value(r[f"{c}_rolling_std_{d}d"], std, 1e-7)


def test_rolling_deviation_of_a_flat_stretch_is_zero(spark):
    rows = [fact("K", h // 24, h % 24, 1e6 if h < 24 else 0.1) for h in range(96)]
    out = R.add_rolling_features(cleaned(spark, rows), (1, 2)).orderBy("date", "hour").collect()
    assert out[-1]["spend_rolling_std_1d"] < 1e-12
    assert out[-1]["spend_rolling_std_2d"] < 1e-12


@pytest.mark.parametrize("lanes", [{}, HOT], ids=["cold", "hot"])
def test_target_drops_the_last_rows(spark, lanes):
    df = cleaned(spark, random_facts() + [fact("short", 0, h, 5.0) for h in range(12)])
    out = R.add_target(df, **lanes)
    before, after = by_campaign(df.collect()), by_campaign(out.collect())
    assert "short" not in after
    for name, rows in after.items():
        source = before[name]
        assert len(rows) == len(source) - 12
        for i, r in enumerate(rows):
            assert r["target_spend_12h"] == source[i + 12]["spend"]


def test_copies_keep_their_number_and_positions(spark):
    """One row repeated many times, as after a double load: no copy is lost."""
    rows = [fact("K", 0, h, float(h)) for h in range(6)] + [fact("K", 0, 3, 3.0)] * 200
    df = cleaned(spark, rows)
    runs = series_positions(df).select("hour", "_copies", "_first").collect()
    assert sorted((r["hour"], r["_copies"], r["_first"]) for r in runs) == [
        (0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 201, 3), (4, 1, 204), (5, 1, 205)
    ]
    cold, hot = R.add_lag_features(df, (2,)), R.add_lag_features(df, (2,), **HOT)
    assert hot.count() == len(rows)
    assert_same_rows(cold, hot)
    assert_same_rows(R.add_expanding_features(df), R.add_expanding_features(df, **HOT))


def test_only_hot_campaigns_take_the_block_lane(spark):
    rows = random_facts(campaigns=2, hours=30) + [fact("big", h // 24, h % 24, float(h % 5)) for h in range(200)]
    df = cleaned(spark, rows)
    mixed = {"hot_rows": 100, "block_rows": 16}
    assert_same_rows(R.add_lag_features(df, (1, 24)), R.add_lag_features(df, (1, 24), **mixed))
    assert_same_rows(gap_features(df), gap_features(df, **mixed))
    assert_same_rows(C.add_campaign_features(df), C.add_campaign_features(df, **mixed))


def test_another_campaign_changes_nothing(spark):
    rows = random_facts(campaigns=2, hours=40)
    alone = R.add_lag_features(cleaned(spark, [r for r in rows if r[0] == "K0"]), (1,))
    among = R.add_lag_features(cleaned(spark, rows).repartition(3), (1,)).filter("campaign_name = 'K0'")
    assert_same_rows(alone, among)


def test_feature_table(spark):
    df = frame(spark, random_facts(campaigns=4, hours=100))
    table = feature_table(df)
    assert len(table.columns) == 106
    assert_same_rows(table, engineer_features(prepare_features(df)), 1e-6)
    assert_same_rows(table, feature_table(df, hot_rows=40, block_rows=30), 1e-6)


def test_rows_without_target_can_be_kept(spark):
    df = frame(spark, random_facts(campaigns=2, hours=40))
    kept = prepare_features(df, keep_unlabelled=True)
    assert kept.count() == df.count()
    assert kept.filter(F.col("target_spend_12h").isNull()).count() == 24


def test_newest_rows(spark):
    df = cleaned(spark, random_facts())
    groups = by_campaign(df.collect())
    tails = by_campaign(R.tail_rows(df, 5).collect())
    for name, rows in groups.items():
        assert [r["hour"] for r in tails[name]] == [r["hour"] for r in rows[-5:]]
    last_day = max(r["date"] for rows in groups.values() for r in rows)
    assert {r["date"] for r in R.latest_day_filter(df).collect()} == {last_day}
    assert R.latest_row(df).count() == len(groups)
    # No rows on the date asked for: the last 24 rows per campaign of the week before.
    assert R.current_rows(df, "2025-01-08").count() == sum(
        min(24, len([r for r in rows if str(r["date"]) >= "2025-01-01"])) for rows in groups.values()
    )
    assert R.current_rows(df, str(last_day)).count() == R.latest_day_filter(df).count()
