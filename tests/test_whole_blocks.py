"""Long time frames over many short blocks: no frame is read block by block, and the sums are those of brute force."""

import datetime
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from hourloom.operators import timeseries as T

ZERO = datetime.datetime(1970, 1, 1)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "campaign_name string, event_ts timestamp_ntz, spend double")


def test_frames_of_hot_campaigns_only_grow(spark):
    """A frame with a start that moves is read anew for each row, so its cost would grow as rows times blocks."""
    rows = [("hot", ZERO + datetime.timedelta(minutes=i), float(i % 5)) for i in range(300)]
    got = T.rolling_time(_frame(spark, rows), ("1H", "3H", "24H"), ("spend",), hot_rows=0, block_cells=4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    frames = set(re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", plan))
    assert frames == {"unboundedpreceding$()"}


@pytest.mark.parametrize("block_cells", [1, 5, 64])
def test_sparse_blocks(spark, block_cells):
    """Bursts, long pauses, frames of up to thousands of blocks, most of them without a row; NaN and infinite values, values all null."""
    rng = random.Random(3)
    rows = []
    for burst in (-9000, -4321, 0, 1, 60, 4320, 4321, 10_000):
        for _ in range(12):
            rows.append((rng.choice(["a", None]), ZERO + datetime.timedelta(minutes=burst, seconds=rng.randrange(200)), rng.choice([None, 3.0, rng.random() * 1e6])))
    rows += [("null", ZERO + datetime.timedelta(hours=i), None) for i in range(3)] + [("nan", ZERO + datetime.timedelta(hours=i), math.nan) for i in range(3)]
    rows += [("a", None, 2.0), ("a", None, 5.0)]
    lengths = {"h": "3H", "d": "72H", "w": "7D"}
    # Lengths whose common divisor has many halvings; one frame is a single block at most, another many.
    got = T.rolling_time(_frame(spark, rows).withColumn("id", F.monotonically_increasing_id()), lengths, ("spend",), hot_rows=0, block_cells=block_cells).collect()
    assert len(got) == len(rows)
    for r in got:
        for name, length in lengths.items():
            span = datetime.timedelta(microseconds=T.step_us(length))
            inside = [
                v for k, t, v in rows
                if k == r.campaign_name and v is not None and (t is None) == (r.event_ts is None) and (t is None or t <= r.event_ts < t + span)
            ]
            mean, std = r[f"spend_rolling_mean_{name}"], r[f"spend_rolling_std_{name}"]
            if r.campaign_name == "nan":
                assert math.isnan(mean) and std == (0.0 if len(inside) > 1 else None)
                continue
            assert mean is None if not inside else math.isclose(mean, statistics.fmean(inside), rel_tol=1e-9), (r, name)
            assert std is None if len(inside) < 2 else math.isclose(std, statistics.stdev(inside), rel_tol=1e-6, abs_tol=1e-6), (r, name)


def test_block_length_is_the_first_that_fits(spark):
    rng = random.Random(4)
    rows = [("a" if i % 3 else None, ZERO + datetime.timedelta(seconds=rng.randrange(-5000, 5000) + (i % 2) * 9000), 1.0) for i in range(500)]
    cells = T._cells(_frame(spark, rows), ("spend",), "event_ts").withColumn("_us", T._us("_t"))
    places = [(r._k, r._us) for r in cells.select("_k", "_us").collect()]
    lengths = {"a": T.step_us("24H"), "b": T.step_us("7D")}
    for most in (1, 3, 40, 10_000):
        block = math.gcd(*lengths.values())
        while block % 2 == 0:
            full = [(k, us // block) for k, us in places]
            if max(full.count(f) for f in set(full)) <= most:
                break
            block //= 2
        assert T._block_us(cells, lengths, most) == block
