"""Hard negatives against brute force: ties, repeated rows, null and non-finite parts, several lots, both ways of multiplying."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from hourloom.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, row int, score string, low int, anchor int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, 3) for r in rows], SCHEMA)


def _brute(rows, first=5):
    fine = []
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, label, [math.floor(256 * x) for x in v]))
    low = lambda i: -(1 << 63) if i is None else i
    out = []
    for k, (anchor, label, v) in enumerate(fine):
        if anchor is None or anchor % 100:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), low(i), i, m) for j, (i, m, w) in enumerate(fine) if j != k]
        others.sort(key=lambda x: x[:2])
        for score, _, i, _ in [x for x in others if x[3] == label][:first]:
            window = [x for x in others if x[3] != label and 80 * -score <= 100 * -x[0] <= 100 * -score]
            out += [(anchor, i, n, x[2], -score, -x[0]) for n, x in enumerate(window[:first], 1)]
    return collections.Counter(out)


def _rows(seed, n, kinds, scale=1.0):
    rng = random.Random(seed)
    pool = [[round(rng.gauss(0.4, 0.5) * scale, 3) for _ in range(6)] for _ in range(kinds)]
    rows = [(i, rng.randrange(3), list(rng.choice(pool))) for i in range(n)]
    return rows, rng


def _got(spark, rows, **options):
    rounded = _frame(spark, rows).repartition(3)
    return collections.Counter(tuple(r) for r in hard_negatives.hard_negatives(rounded, F.col("id") % 100 == 0, **options).collect())


def _as_float(rows):
    import struct

    single = lambda x: x if x is None or not math.isfinite(x) else struct.unpack("f", struct.pack("f", x))[0]
    return [(i, label, v if v is None else [single(x) for x in v]) for i, label, v in rows]


@pytest.mark.parametrize("lot_bytes", [16 << 20, 100])
def test_against_brute_force(spark, lot_bytes):
    rows, rng = _rows(1, 420, 400)
    rows += [(1000, None, [1.0] * 6), (1001, 0, None), (1002, 1, [1.0, None, 0, 0, 0, 0]), (1100, 2, [float("nan")] * 6), (1003, 0, [float("inf")] * 6)]
    rows += [(1200, 1, [0.5, 0.25]), (1004, 1, [0.5] * 4), (1005, 0, []), (None, 1, [0.5] * 6), (1300, 7, [0.1] * 6), (1400, 0, [0.0] * 6), (1500, 0, [-0.5] * 6)]
    rows = _as_float(rows)
    expected = _brute(rows)
    assert len(expected) > 30
    assert _got(spark, rows, lot_bytes=lot_bytes) == expected


def test_ties(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", 64)
    rows, _ = _rows(2, 330, 4)
    rows = _as_float(rows)
    assert _got(spark, rows) == _brute(rows)


def test_repeated_rows(spark):
    rows, _ = _rows(3, 101, 90)
    rows = _as_float(rows + rows[:60] + [(0, 2, [0.3] * 6), (5, 1, [0.3] * 6), (100, 1, [0.9] * 6)])
    assert _got(spark, rows) == _brute(rows)


def test_large_components_stay_exact(spark):
    rows, _ = _rows(4, 210, 200, scale=2.0**16)
    rows = _as_float(rows)
    assert _got(spark, rows) == _brute(rows)
    with pytest.raises(ValueError):
        _got(spark, [(0, 1, [1e30] * 6), (1, 1, [1e30] * 6)])


def test_no_rows_and_no_anchors(spark):
    assert _got(spark, []) == {}
    assert _got(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == {}
    assert _got(spark, [(100, 1, [1.0])]) == {}
    assert _got(spark, [(100, 1, [1.0]), (2, 2, [1.0])]) == {}
