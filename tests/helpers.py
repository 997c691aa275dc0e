"""Small fixtures and comparisons shared by the tests."""

import math
import random

from hourloom.schema import COUNTERS, FACT


def fact(campaign, day, hour, spend, impressions=10, clicks=1, ctr=1.0, cpc=1.0, window=None):
    import datetime as dt

    label = window or f"{hour:02d}:00:00 - {hour:02d}:59:59"
    date = dt.date(2025, 1, 1) + dt.timedelta(days=day)
    return (campaign, date, label, spend, impressions, clicks, ctr, cpc, 1.0, 0.0, *[0] * len(COUNTERS))


def frame(spark, rows):
    # Fact columns are ordered name, date, window, then metrics in schema order.
    return spark.createDataFrame(rows, FACT)


def random_facts(seed=7, campaigns=3, hours=120, keep=0.8):
    rng = random.Random(seed)
    rows = []
    for c in range(campaigns):
        for h in range(hours):
            if rng.random() < keep:
                spend = 0.0 if rng.random() < 0.3 else round(rng.uniform(0, 100), 2)
                rows.append(fact(f"K{c}", h // 24, h % 24, spend, rng.randrange(1, 99), rng.randrange(9), round(rng.random(), 3)))
    return rows


def same_value(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
    return a == b


def assert_same_rows(left, right, tolerance=1e-9):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    key = lambda r: tuple(
        str(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r
    )
    a = sorted((tuple(r) for r in left.select(columns).collect()), key=key)
    b = sorted((tuple(r) for r in right.select(columns).collect()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c, v, w in zip(columns, x, y):
            assert same_value(v, w, tolerance), (c, v, w, x, y)
