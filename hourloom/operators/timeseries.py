"""Operators on the time axis: resampling, gaps, time frames, window lists.

All work is done on cells, one per campaign and instant, built with map-side aggregation.  At hourly grain
the calendar bounds their number per campaign; at event grain it does not.  So work that would order all
cells of a campaign is cut into blocks of time: what lies inside a block is ordered by (campaign, block), and a
table with one row per campaign and block, which the calendar does bound, carries what earlier blocks leave behind.
"""

from __future__ import annotations

import bisect
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.durable import durable, stored
from hourloom.functions.scalars import event_ts, micros, wall_clock
from hourloom.operators.lanes import HOT_ROWS, MAX_BROADCAST_NAMES
from hourloom.schema import KEY

HOUR_US = 3_600_000_000
# --- Fixed values: window names and their length in hours. ---
TIME_WINDOWS = {"24H": 24, "7D": 168, "30D": 720}
ROLLING_METRICS = ("spend", "impressions", "clicks", "ctr")


def with_event_ts(df: DataFrame) -> DataFrame:
    return df.withColumn("event_ts", event_ts(F.col("date"), F.col("hour")))


def _us(c: str) -> Column:
    return micros(F.col(c))


def step_us(length: int | str) -> int:
    """Microseconds of a length: a number of hours, or a text such as "15 minutes", "hour", "24H" or "7D"."""
    text = f"{length} hours" if isinstance(length, int) else length.strip().lower()
    found = re.fullmatch(r"(\d*)\s*(m|min|minutes?|h|hours?|d|days?)", text)
    if not found or not int(found[1] or 1):
        raise ValueError(f"a length is a number of minutes, hours or days, such as '15 minutes'; got {length!r}")
    return int(found[1] or 1) * {"m": HOUR_US // 60, "h": HOUR_US, "d": 24 * HOUR_US}[found[2][0]]


def gap_detect(df: DataFrame, ts: str = "event_ts", hours: int = 2) -> DataFrame:
    """Per campaign, the number of steps between neighbouring instants above ``hours``.

    Inside a block of that length no step is above it, so the first and last instant of each block are enough.
    """
    step = F.lit(hours * HOUR_US).cast("bigint")
    blocks = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(KEY, F.floor(_us(ts) / step).alias("_block"))
        .agg(F.min(_us(ts)).alias("_first"), F.max(_us(ts)).alias("_last"))
    )
    before = F.lag("_last").over(Window.partitionBy(KEY).orderBy("_block"))
    return (
        blocks.withColumn("_step", F.col("_first") - before)
        .groupBy(KEY)
        .agg(F.count_if(F.col("_step") > step).alias("n_gaps"))
    )


def series_validate(df: DataFrame, ts: str = "event_ts") -> DataFrame:
    """One row of three checks; true means no such issue."""
    missing = df.agg((F.count_if(F.col(ts).isNull()) == 0).alias("missing_dates"))
    repeated = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(KEY, ts)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg((F.count_if(F.col("_n") > 1) == 0).alias("duplicate_timestamps"))
    )
    gaps = gap_detect(df, ts).agg((F.coalesce(F.sum("n_gaps"), F.lit(0)) == 0).alias("time_gaps"))
    # Three one-row tables.
    return missing.crossJoin(F.broadcast(repeated)).crossJoin(F.broadcast(gaps))


def resample_series(
    df: DataFrame,
    freq: str = "hour",
    aggregation: dict[str, str] | None = None,
    ts: str = "event_ts",
) -> DataFrame:
    """Regular buckets per campaign from its first to its last; empty ones are emitted with
    sum 0 and mean NULL, and marked in ``is_missing_hour``.  ``freq`` is a length as in
    ``step_us``; buckets count from 1970-01-01."""
    step = F.lit(step_us(freq)).cast("bigint")
    aggregation = aggregation or {
        "spend": "sum",
        "impressions": "sum",
        "clicks": "sum",
        "ctr": "mean",
        "cpc": "mean",
    }
    functions = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}
    bucket = (_us(ts) - F.pmod(_us(ts), step)).alias("_at")
    cells = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(KEY, bucket)
        .agg(*[functions[f](c).alias(c) for c, f in aggregation.items()])
        .withColumn("_seen", F.lit(True))
    )
    spine = (
        cells.groupBy(KEY)
        .agg(F.min("_at").alias("_a"), F.max("_at").alias("_b"))
        .select(KEY, F.explode(F.sequence("_a", "_b", step)).alias("_spine"))
        .withColumn("bucket_ts", wall_clock(F.col("_spine")))
    )
    fill = {
        c: F.coalesce(F.col(c), F.lit(0)) for c, f in aggregation.items() if f in ("sum", "count")
    }
    # A null key is a series like any other.
    seen = cells.withColumnRenamed(KEY, "_key")
    same = F.col(KEY).eqNullSafe(F.col("_key")) & (F.col("_spine") == F.col("_at"))
    out = spine.join(seen, same, "left").drop("_key", "_at", "_spine")
    return out.withColumns(
        {**fill, "is_missing_hour": F.when(F.col("_seen"), 0).otherwise(1)}
    ).drop("_seen")


def hours_since_positive_spend(df: DataFrame, ts: str = "event_ts", block_hours: int = 1) -> DataFrame:
    """Hours from the last earlier instant with spend above zero to the row's instant.

    Instants are ordered inside blocks of ``block_hours``; the last such instant of earlier blocks is carried over."""
    block = F.floor(_us(ts) / F.lit(block_hours * HOUR_US))
    cells = df.groupBy(F.col(KEY).alias("_k"), F.col(ts).alias("_t"), block.alias("_block")).agg(
        F.max(F.col("spend") > 0).alias("_spent")
    )
    at = F.when(F.col("_spent"), _us("_t"))
    prior = Window.unboundedPreceding, -1
    inside = F.max(at).over(Window.partitionBy("_k", "_block").orderBy("_t").rowsBetween(*prior))
    carried = (
        df.filter((F.col("spend") > 0) | F.col(ts).isNotNull())
        .groupBy(F.col(KEY).alias("_ck"), block.alias("_cb"))
        .agg(F.max(F.when(F.col("spend") > 0, _us(ts))).alias("_positive"))
        .select("_ck", "_cb", F.max("_positive").over(Window.partitionBy("_ck").orderBy("_cb").rowsBetween(*prior)).alias("_carried"))
    )
    same_block = F.col("_k").eqNullSafe(F.col("_ck")) & (F.col("_block") == F.col("_cb"))
    last = F.coalesce("_inside", "_carried")
    cells = (
        cells.withColumn("_inside", inside)
        .join(carried, same_block, "left")
        .select("_k", "_t", ((_us("_t") - last) / HOUR_US).alias("hours_since_positive_spend"))
    )
    same = F.col(KEY).eqNullSafe(F.col("_k")) & (F.col(ts) == F.col("_t"))
    return df.join(cells, same, "left").drop("_k", "_t")


#: Cells that the windows of one (campaign, block) order at most, if blocks can be made short enough.
BLOCK_CELLS = 262_144


def _cells(df: DataFrame, metrics: tuple[str, ...], ts: str) -> DataFrame:
    """One row per campaign and instant: count, mean, variance, least and largest value of each metric."""
    return df.groupBy(F.col(KEY).alias("_k"), F.col(ts).alias("_t")).agg(
        *[F.count(c).alias(f"n_{c}") for c in metrics],
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in metrics],
        *[F.var_pop(F.col(c).cast("double")).alias(f"v_{c}") for c in metrics],
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in metrics],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in metrics],
    )


def _cold_frames(cells: DataFrame, lengths: dict[str, int], metrics: tuple[str, ...]) -> DataFrame:
    """Sums over the frames of each cell, ordered by campaign."""
    whole = "OVER (PARTITION BY _k)"
    cells = cells.withColumn("_us", _us("_t")).selectExpr(
        "*",
        *[f"try_divide(sum(n_{c} * m_{c}) {whole}, sum(n_{c}) {whole}) AS c_{c}" for c in metrics],
    )
    framed = ["_k", "_t"]
    for name, length in lengths.items():
        w = f"OVER (PARTITION BY _k ORDER BY _us RANGE BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
        for c in metrics:
            framed += [
                f"sum(n_{c}) {w} AS n_{c}_{name}",
                f"sum(n_{c} * (m_{c} - c_{c})) {w} AS s_{c}_{name}",
                f"sum(n_{c} * (v_{c} + pow(m_{c} - c_{c}, 2))) {w} AS q_{c}_{name}",
                f"(min(lo_{c}) {w} = max(hi_{c}) {w}) AS same_{c}_{name}",
            ]
    return cells.selectExpr(*framed, *[f"c_{c}" for c in metrics])


#: How the parts of a summary are merged, and what leaves the other side of a merge as it is (NaN is the largest number).
_MERGE = {"n": "sum", "s": "sum", "q": "sum", "lo": "min", "hi": "max"}
_PLUS = {"sum": "{a} + {b}", "min": "least({a}, {b})", "max": "greatest({a}, {b})"}
_NOTHING = {"n": "0L", "s": "0D", "q": "0D", "lo": "double('NaN')", "hi": "double('-Infinity')"}
#: The place of cells without a time: before all instants, where no other frame reaches.
NO_TIME_US = -(2**62)


def _sums(metrics: tuple[str, ...]) -> list[str]:
    return [f"{part}_{c}" for c in metrics for part in _MERGE]


def _merge(x: str) -> str:
    return _MERGE[x.split("_")[0]]


def _nothing(x: str) -> str:
    return _NOTHING[x.split("_")[0]]


def _hot_cells(rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """One row per campaign and instant: count, sum and squares about the campaign mean, least and largest value of each metric."""
    value = {c: F.col(c).cast("double") for c in metrics}
    off = {c: value[c] - F.col(f"c_{c}") for c in metrics}
    parts = {"n": lambda c: F.count(c), "s": lambda c: F.sum(off[c]), "q": lambda c: F.sum(off[c] * off[c]), "lo": lambda c: F.min(value[c]), "hi": lambda c: F.max(value[c])}
    cells = rows.groupBy("_k", "_us").agg(*[parts[part](c).alias(f"{part}_{c}") for c in metrics for part in _MERGE])
    return cells.selectExpr("_k", "_us", *[f"coalesce({x}, {_nothing(x)}) AS {x}" for x in _sums(metrics)])


def _block_us(cells: DataFrame, lengths: dict[str, int], block_cells: int) -> int:
    """The longest block that is a frame divisor halved and leaves at most ``block_cells`` cells in a (campaign, block); if none does, the shortest."""
    block = math.gcd(*lengths.values())
    halvings = (block & -block).bit_length() - 1
    # Counted once in the shortest blocks; the longer ones are made of these.
    shortest = durable(cells.groupBy("_k", F.expr(_floor_div("_us", block >> halvings)).alias("_block")).agg(F.count(F.lit(1)).alias("_n")))

    def fits(n: int) -> bool:
        counts = shortest.groupBy("_k", F.shiftright("_block", halvings - n)).agg(F.sum("_n").alias("_n"))
        return (counts.agg(F.max("_n")).first()[0] or 0) <= block_cells

    return block >> bisect.bisect_left(range(halvings), True, key=fits)


def _floor_div(a: str, b: int | str) -> str:
    return f"({a} div {b} - CAST({a} < 0 AND {a} % {b} <> 0 AS INT))"


def _add_later(rows: DataFrame, parts: str, asked: str, sums: list[str]) -> DataFrame:
    """Rows where ``asked`` is not null, their sums merged with those of the other rows of the group at a later ``_at``."""
    over = f"OVER (PARTITION BY {parts} ORDER BY _at DESC, {asked} IS NULL ROWS UNBOUNDED PRECEDING)"
    kept = [c for c in rows.columns if c not in sums]
    rows = rows.selectExpr("*", *[f"{_merge(x)}(IF({asked} IS NULL, {x}, {_nothing(x)})) {over} AS later_{x}" for x in sums])
    return rows.where(f"{asked} IS NOT NULL").selectExpr(*kept, *[_PLUS[_merge(x)].format(a=x, b=f"later_{x}") + f" AS {x}" for x in sums])


def _whole_blocks(cells: DataFrame, block: int, lengths: dict[str, int], sums: list[str]) -> DataFrame:
    """Per block and window, the sums of the whole blocks between that of the frame's beginning and the block itself.

    Blocks are gathered in chunks as long as the frame.  The whole blocks are then those before the block in its chunk and those of
    the chunk before that come after the block in which the frame begins, so no frame is read block by block.
    """
    windows = ", ".join(f"struct('{w}' AS _w, {k}L AS _length, {k // block}L AS _n_blocks)" for w, k in lengths.items())
    blocks = cells.groupBy("_k", "_block").agg(*[F.expr(f"{_merge(x)}({x})").alias(x) for x in sums])
    blocks = blocks.selectExpr("*", f"inline(array({windows}))").withColumn("_chunk", F.expr(_floor_div("_block", "_n_blocks")))
    before = "OVER (PARTITION BY _k, _w, _chunk ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    place = ["_k", "_w", "_length", "_n_blocks"]
    asked = blocks.selectExpr(*place, "_chunk - 1 AS _chunk", "_block - _n_blocks AS _at", "_block", *[f"coalesce({_merge(x)}({x}) {before}, {_nothing(x)}) AS {x}" for x in sums])
    given = blocks.selectExpr(*place, "_chunk", "_block AS _at", "CAST(NULL AS BIGINT) AS _block", *sums)
    return _add_later(asked.unionByName(given), "_k, _w, _chunk", "_block", sums).drop("_chunk", "_at")


def _hot_frames(cells: DataFrame, lengths: dict[str, int], metrics: tuple[str, ...], block_cells: int) -> DataFrame:
    """Mean about the campaign mean, and deviation, over the frames of each cell, for campaigns with any number of cells.

    A frame (t - length, t] that ends in block b begins in block b - k, at the same place of the block.  It is made of
    block b up to t, of k - 1 whole blocks, and of the rest of block b - k after t - length.  The first two are merged in block b
    and looked up the third in block b - k, one row per cell and window, so each row is met once a window whatever the length.
    """
    sums = _sums(metrics)
    cells = stored(cells, "cells")
    block = _block_us(cells, lengths, block_cells)
    cells = cells.withColumn("_block", F.expr(_floor_div("_us", block)))
    whole = _whole_blocks(cells, block, lengths, sums).select("_k", "_block", "_w", "_length", "_n_blocks", *[F.col(x).alias(f"whole_{x}") for x in sums])
    upto = "OVER (PARTITION BY _k, _block ORDER BY _us ROWS UNBOUNDED PRECEDING)"
    starts = cells.selectExpr("_k", "_block", "_us", *[f"{_merge(x)}({x}) {upto} AS {x}" for x in sums])
    asked = starts.join(whole, ["_k", "_block"]).selectExpr(
        "_k", "_block - _n_blocks AS _block", "_us - _length AS _at", "_us", "_w",
        *[_PLUS[_merge(x)].format(a=x, b=f"whole_{x}") + f" AS {x}" for x in sums],
    )
    given = cells.selectExpr("_k", "_block", "_us AS _at", "_us", "CAST(NULL AS STRING) AS _w", *sums)
    framed = _add_later(asked.unionByName(given), "_k, _block", "_w", sums)
    long = framed.selectExpr("_k", "_us", "_w", *[x for c in metrics for x in _mean_and_std(f"n_{c}", f"s_{c}", f"q_{c}", f"lo_{c} = hi_{c}", f"{c}_rolling_{{}}")])
    # Exchanged as they are: rows of one cell come from different blocks, so merging before the exchange would only widen them.
    return long.repartition("_k", "_us").groupBy("_k", "_us").agg(
        *[F.max(F.when(F.col("_w") == w, F.col(f"{c}_rolling_{f}"))).alias(f"{c}_rolling_{f}_{w}") for w in lengths for c in metrics for f in ("mean", "std")]
    )


def _mean_and_std(n: str, s: str, q: str, same: str, name: str) -> list[str]:
    """SQL text of a frame's mean about the campaign mean and of its sample deviation."""
    std = f"CASE WHEN {n} < 2 THEN NULL WHEN {same} THEN 0D ELSE sqrt(greatest(0D, try_divide({q} - {s} * {s} / {n}, {n} - 1))) END"
    return [f"try_divide({s}, {n}) AS {name.format('mean')}", f"{std} AS {name.format('std')}"]


def rolling_time(
    df: DataFrame,
    windows: dict[str, int | str] | tuple[str, ...] | None = None,
    metrics: tuple[str, ...] = ROLLING_METRICS,
    ts: str = "event_ts",
    hot_rows: int = HOT_ROWS,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """Mean and sample deviation over (t - window, t] of time, for each row.

    Rows of one instant form a cell with (n, sum, squares, min, max).  Values are centred
    on the campaign mean before squaring, and a frame whose minimum equals its maximum has
    deviation 0 exactly.  ``windows`` has lengths as in ``step_us``, by name or as their own names.
    Campaigns of more than ``hot_rows`` rows are worked in blocks of time with at most ``block_cells`` cells.
    """
    windows = windows or TIME_WINDOWS
    if not isinstance(windows, dict):
        windows = {name: name for name in windows}
    lengths = {name: step_us(length) for name, length in windows.items()}
    metrics = tuple(c for c in metrics if c in df.columns)
    # One row per campaign, with a number that is never null and the values' centres.
    campaigns = durable(
        df.groupBy(F.col(KEY).alias("_hot_key"))
        .agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.col(c).cast("double")).alias(f"c_{c}") for c in metrics])
        .withColumn("_k", F.monotonically_increasing_id())
    )
    names = campaigns.filter(F.col("_n") > hot_rows).drop("_n")
    n_all, n_hot = campaigns.agg(F.count(F.lit(1)), F.count_if(F.col("_n") > hot_rows)).first()
    names = F.broadcast(names) if n_hot <= MAX_BROADCAST_NAMES else names
    is_hot = F.col(KEY).eqNullSafe(F.col("_hot_key"))
    out = []
    if n_hot < n_all or not n_all:
        cold = df.join(names, is_hot, "left_anti") if n_hot else df
        out.append(_cold_rows(cold, lengths, metrics, ts))
    if n_hot:
        hot = df.join(names, is_hot).drop("_hot_key").withColumn("_us", F.coalesce(_us(ts), F.lit(NO_TIME_US)))
        framed = _hot_frames(_hot_cells(hot, metrics), lengths, metrics, block_cells)
        mean = {f"{c}_rolling_mean_{w}": F.col(f"c_{c}") + F.col(f"{c}_rolling_mean_{w}") for w in lengths for c in metrics}
        out.append(hot.join(framed, ["_k", "_us"]).withColumns(mean).drop("_k", "_us", *[f"c_{c}" for c in metrics]))
    return reduce(DataFrame.unionByName, out)


def _cold_rows(df: DataFrame, lengths: dict[str, int], metrics: tuple[str, ...], ts: str) -> DataFrame:
    """The rows with the frames of their cells, ordered by campaign."""
    out = ["_k", "_t"]
    for name in lengths:
        for c in metrics:
            mean, std = _mean_and_std(f"n_{c}_{name}", f"s_{c}_{name}", f"q_{c}_{name}", f"same_{c}_{name}", f"{c}_rolling_{{}}_{name}")
            out += [f"c_{c} + {mean}", std]
    framed = _cold_frames(_cells(df, metrics, ts), lengths, metrics).selectExpr(*out)
    same = F.col(KEY).eqNullSafe(F.col("_k")) & F.col(ts).eqNullSafe(F.col("_t"))
    return df.join(framed, same, "left").drop("_k", "_t")


def time_windows(df: DataFrame, start: str, end: str, length: int | str = 1) -> DataFrame:
    """Consecutive [window_start, window_end) of a ``length`` as in ``step_us`` between two timestamp
    columns; the last one is cut at the end.  Rows with start >= end give no window."""
    step = F.lit(step_us(length)).cast("bigint")
    a, b = _us(start), _us(end)
    return (
        df.filter(a < b)
        .withColumn("_at", F.explode(F.when(a < b, F.sequence(a, b - 1, step))))
        .withColumn("window_start", wall_clock(F.col("_at")))
        .withColumn("window_end", wall_clock(F.least(F.col("_at") + step, b)))
        .drop("_at")
    )


def get_time_windows(spark: SparkSession, start: str, end: str, length: int | str = 1) -> DataFrame:
    bounds = spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end"))
    return time_windows(bounds, "start", "end", length).select("window_start", "window_end")
