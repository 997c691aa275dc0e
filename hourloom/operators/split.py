"""Train/test splits and rolling-origin folds, without sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.durable import durable
from hourloom.functions.scalars import event_ts
from hourloom.operators.ranks import CROWDED, copies_before, digits
from hourloom.schema import KEY

_ALL_PRIOR = (Window.unboundedPreceding, -1)
COPIES_PER_TASK_ROW = 10_000


def _once() -> Column:
    """Partition key of windows over tables whose size is bounded, as noted at each use."""
    return F.lit(0)


def expand_copies(df: DataFrame, n: str) -> DataFrame:
    """Repeat each row ``n`` times; big counts are cut into pieces and spread first."""
    size = F.lit(COPIES_PER_TASK_ROW)
    pieces = df.withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / size).cast("int")))
    ).repartition(F.col("_piece"), F.xxhash64(*df.columns))
    left = F.least(size, F.col(n) - F.col("_piece") * size).cast("int")
    return pieces.withColumn("_copy", F.explode(F.sequence(F.lit(1), left))).drop("_copy", "_piece", n)


# ---- by campaign ----


def campaign_hash(seed: int = 42) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(KEY), F.lit("")), F.lit(f"#{seed}")))


def _hash_threshold(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """One row: the ``int(n * fraction)``-th smallest hash of the n campaigns ('' if none).

    Campaigns are counted in 4,096 groups by the head of their hash; only the group that
    holds the wanted rank is sorted.
    """
    hashes = df.select(campaign_hash(seed).alias("_h")).distinct()
    heads = (
        hashes.groupBy(F.substring("_h", 1, 3).alias("_head"))
        .agg(F.count(F.lit(1)).alias("_n"))
        # At most 4,096 rows.
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(_once())))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(Window.partitionBy(_once()).orderBy("_head").rowsBetween(*_ALL_PRIOR)),
                F.lit(0),
            ),
        )
        .withColumn("_k", F.floor(F.col("_total") * F.lit(float(fraction))))
        .filter((F.col("_k") > F.col("_before")) & (F.col("_k") <= F.col("_before") + F.col("_n")))
    )
    in_head = Window.partitionBy("_head").orderBy("_h")
    return (
        hashes.withColumn("_head", F.substring("_h", 1, 3))
        .join(F.broadcast(heads.select("_head", "_before", "_k")), "_head")
        .withColumn("_rank", F.row_number().over(in_head))
        .filter(F.col("_rank") == F.col("_k") - F.col("_before"))
        .agg(F.coalesce(F.max("_h"), F.lit("")).alias("_threshold"))
    )


def label_by_campaign(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` is test for the ``int(n * test_size)`` campaigns with the smallest hash.

    Membership is a comparison with one broadcast value, so nothing is joined by campaign.
    """
    threshold = F.broadcast(_hash_threshold(df, test_size, seed))
    split = F.when(campaign_hash(seed) <= F.col("_threshold"), "test").otherwise("train")
    return df.crossJoin(threshold).withColumn("split", split).drop("_threshold")


# ---- by time ----


def _hours(df: DataFrame) -> DataFrame:
    """Row counts per (date, hour) with the number of rows before; bounded by the calendar."""
    in_time = Window.partitionBy(_once()).orderBy("date", "hour").rowsBetween(*_ALL_PRIOR)
    return (
        df.groupBy("date", "hour")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(in_time), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(_once())))
    )


def segment_by_rank(df: DataFrame, cuts: list[Column], name: str = "segment", crowded: int = CROWDED) -> DataFrame:
    """Number of ``cuts`` at or below each row's rank in time order.

    ``cuts`` are ascending row counts, written in terms of ``_total``.  Hours that no cut
    divides are labelled as a whole.  Inside a divided hour rows are ranked by the md5 of
    campaign and hourly window, then by a hash of the row; identical rows travel as one row
    with a count.  No task ranks more than ``crowded`` of them.  The divided hours, at most
    one for each cut, are stored at once.
    """
    passed = lambda rank: F.size(F.filter("_cuts", lambda c: c <= rank))
    hours = (
        _hours(df)
        .withColumn("_cuts", F.array(*[c.cast("bigint") for c in cuts]))
        .withColumn("_low", passed(F.col("_before")))
        .withColumn("_high", passed(F.col("_before") + F.col("_n") - 1))
        .select(F.col("date").alias("_d"), F.col("hour").alias("_h"), "_before", "_cuts", "_low", "_high")
    )
    same = F.col("date").eqNullSafe(F.col("_d")) & F.col("hour").eqNullSafe(F.col("_h"))
    helpers = ["_d", "_h", "_before", "_cuts", "_low", "_high"]
    # One row per hour of the calendar (87,600 in ten years).
    rows = df.join(F.broadcast(hours), same)
    whole = rows.filter("_low = _high").withColumn(name, F.col("_low")).drop(*helpers)

    order = F.concat(F.md5(F.concat_ws("#", KEY, "hourly_window")), digits(F.xxhash64(*df.columns)))
    divided = hours.filter("_low < _high")
    runs = durable(
        df.join(F.broadcast(divided), same)
        .groupBy(*df.columns, *helpers)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_order", order)
    )
    ranked = copies_before(runs, ["_d", "_h"], "_order", "_copies", "_earlier", crowded)
    first, last = F.col("_first"), F.col("_first") + F.col("_copies") - 1
    cut = lambda i, default: F.coalesce(F.try_element_at("_cuts", i.cast("int")), default)
    seg = F.col(name)
    # Segment s holds the ranks from cut s (counted from 1) up to cut s + 1.
    start = F.when(seg == 0, F.lit(0)).otherwise(cut(F.greatest(seg, F.lit(1)), F.lit(0)))
    end = cut(seg + 1, last + 1)
    parts = (
        ranked.withColumn("_first", F.col("_before") + F.col("_earlier"))
        .withColumn(name, F.explode(F.sequence(passed(first), passed(last))))
        .withColumn("_share", F.least(last + 1, end) - F.greatest(first, start))
        .filter("_share > 0")
        .select(*df.columns, name, "_share")
    )
    return whole.unionByName(expand_copies(parts, "_share"))


def label_by_time(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """``split`` is train for the first ``int(n * (1 - test_size))`` rows in time order."""
    cut = F.floor(F.col("_total") * F.lit(1 - test_size))
    out = segment_by_rank(df, [cut], "_segment")
    return out.withColumn("split", F.when(F.col("_segment") == 0, "train").otherwise("test")).drop("_segment")


def rolling_origin_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """Add ``fold``: fold i tests on rows with ``fold = i`` and trains on ``fold < i``.

    The k test blocks hold ``n // (k + 1)`` rows each and end at the newest row.
    """
    block = F.floor(F.col("_total") / F.lit(k + 1))
    cuts = [F.col("_total") - block * (k - i) for i in range(k)]
    return segment_by_rank(df, cuts, "fold")


def split_series_gap(
    df: DataFrame, test_size: float = 0.2, gap_size: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Cut at the instant of the ``int(n * (1 - test_size))``-th row; rows in the
    ``gap_size`` hours after the cut belong to neither side."""
    hours = _hours(df)
    k = F.floor(F.col("_total") * F.lit(1 - test_size))
    cut = (
        hours.filter((k > F.col("_before")) & (k <= F.col("_before") + F.col("_n")))
        .select(event_ts(F.col("date"), F.col("hour")).alias("_cut"))
        .agg(F.max("_cut").alias("_cut"))
    )
    marked = df.crossJoin(F.broadcast(cut)).withColumn("_ts", event_ts(F.col("date"), F.col("hour")))
    embargo = F.col("_cut") + F.make_interval(hours=F.lit(gap_size))
    after = F.col("_ts") > F.col("_cut")
    train = marked.filter(~after).drop("_cut", "_ts")
    test = marked.filter(after & (F.col("_ts") >= embargo)).drop("_cut", "_ts")
    return train, test


def split_data(
    df: DataFrame, test_size: float = 0.2, split_method: str = "campaign", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    if split_method == "campaign":
        labelled = label_by_campaign(df, test_size, seed)
    elif split_method == "time":
        labelled = label_by_time(df, test_size)
    else:
        raise ValueError("split_method must be 'campaign' or 'time'")
    side = lambda s: labelled.filter(F.col("split") == s).drop("split")
    return side("train"), side("test")
