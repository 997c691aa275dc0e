"""Row-offset and row-frame features of campaign series, and latest-row selection.

Offsets count rows, not hours: resample first to make them the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.operators.lanes import ORDER, Lane, Step, over_series, series_tie
from hourloom.schema import HORIZON, KEY, TARGET

LAGS = (1, 24, 168)
LAG_METRICS = ("spend", "impressions", "clicks")
LAG_METRICS_EXT = ("spend", "impressions", "clicks", "ctr", "cpc")
ROLLING_DAYS = (7, 14, 30)
ROLLING_METRICS = ("spend", "impressions", "clicks", "ctr")
EXPANDING_METRICS = ("spend", "impressions", "clicks")
DAY = 24


# ---- steps: Lane -> Lane, so that composed jobs share one exchange ----


def lag_step(lags: tuple[int, ...] = LAGS, metrics: tuple[str, ...] = LAG_METRICS) -> Step:
    def step(lane: Lane) -> Lane:
        w, types = lane.over(), dict(lane.df.dtypes)
        return lane.with_windows(
            {
                f"{c}_lag_{k}h": f"coalesce(lag(`{c}`, {k}) {w}, CAST(0 AS {types[c]}))"
                for k in lags
                for c in metrics
            }
        )

    return step


def target_step(rows_ahead: int = HORIZON, how: str = "row", keep_unlabelled: bool = False) -> Step:
    """``how="row"``: the spend ``rows_ahead`` rows later; ``"sum"``: the sum of those rows."""
    if how not in ("row", "sum"):
        raise ValueError("how must be 'row' or 'sum'")

    def step(lane: Lane) -> Lane:
        target = f"lead(spend, {rows_ahead}) {lane.over()}"
        if how == "sum":
            total = lane.over(f"ROWS BETWEEN 1 FOLLOWING AND {rows_ahead} FOLLOWING")
            target = f"IF({target} IS NULL, NULL, sum(spend) {total})"
        lane = lane.with_windows({TARGET: target})
        return lane if keep_unlabelled else drop_unlabelled_step(lane)

    return step


def drop_unlabelled_step(lane: Lane) -> Lane:
    return lane.map(lambda d: d.filter(F.col(TARGET).isNotNull()))


def rolling_step(
    days: tuple[int, ...] = ROLLING_DAYS, metrics: tuple[str, ...] = ROLLING_METRICS
) -> Step:
    """Mean and sample deviation of the last ``24 * d`` rows, current row included.

    A frame of 720 rows re-read for each row costs 720 steps.  Instead one frame of 24
    rows is summarised as (n, mean, m2), summaries are doubled with the summary that lies
    one frame earlier (48, 96, ... rows), and each window is pooled from the doublings
    that add up to its length.  Summaries are only pooled, never subtracted, so no digits
    cancel on a quiet stretch of a campaign that is busy elsewhere.
    """
    parts = ("n", "mean", "m2")

    def pool(lane: Lane, pieces: dict[str, list[tuple[str, int]]]) -> Lane:
        """Columns ``{name}_{n,mean,m2}_{metric}`` pooled from (prefix, rows back) pieces."""
        w = lane.over()
        moved, counts, means, squares = {}, {}, {}, {}
        for prefix, rows in {piece for group in pieces.values() for piece in group if piece[1]}:
            for part in parts:
                for c in metrics:
                    # Before the first row of a series the summary is empty.
                    moved[f"{prefix}_{part}_{c}_at_{rows}"] = (
                        f"coalesce(lag({prefix}_{part}_{c}, {rows}) {w}, 0D)"
                    )
        for name, group in pieces.items():
            for c in metrics:
                n, mean, m2 = (
                    [f"{p}_{part}_{c}" + (f"_at_{rows}" if rows else "") for p, rows in group]
                    for part in parts
                )
                total = " + ".join(f"{a} * {b}" for a, b in zip(n, mean))
                counts[f"{name}_n_{c}"] = " + ".join(n)
                means[f"{name}_mean_{c}"] = f"coalesce(try_divide({total}, {name}_n_{c}), 0D)"
                squares[f"{name}_m2_{c}"] = " + ".join(
                    f"{q} + {a} * pow({b} - {name}_mean_{c}, 2)" for a, b, q in zip(n, mean, m2)
                )
        lane = lane.with_windows(moved)
        for columns in (counts, means):
            lane = lane.with_sql(columns)
        return lane.with_sql(squares, drop=list(moved))

    def step(lane: Lane) -> Lane:
        base = lane.over(f"ROWS BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW")
        first = {}
        for c in metrics:
            v = f"CAST(`{c}` AS DOUBLE)"
            first[f"_r0_n_{c}"] = f"CAST(count({v}) {base} AS DOUBLE)"
            first[f"_r0_mean_{c}"] = f"coalesce(avg({v}) {base}, 0D)"
            first[f"_r0_m2_{c}"] = f"coalesce(var_pop({v}) {base} * count({v}) {base}, 0D)"
        lane = lane.with_windows(first)
        before = [c for c in lane.df.columns if c not in first]
        bits = max(days).bit_length()
        for i in range(1, bits):
            half = f"_r{i - 1}"
            lane = pool(lane, {f"_r{i}": [(half, 0), (half, DAY << (i - 1))]})
        pieces: dict[str, list[tuple[str, int]]] = {}
        for d in days:
            offset, pieces[f"_w{d}"] = 0, []
            for i in reversed(range(bits)):
                if d >> i & 1:
                    pieces[f"_w{d}"].append((f"_r{i}", offset * DAY))
                    offset += 1 << i
        lane = pool(lane, pieces)
        out: dict[str, str] = {}
        for d in days:
            for c in metrics:
                n, mean, m2 = (f"_w{d}_{part}_{c}" for part in parts)
                out[f"{c}_rolling_mean_{d}d"] = f"IF({n} > 0, {mean}, NULL)"
                out[f"{c}_rolling_std_{d}d"] = f"IF({n} > 1, sqrt({m2} / ({n} - 1)), NULL)"
        return lane.with_sql(out, drop=[c for c in lane.df.columns if c not in before])

    return step


def expanding_sum_step(metrics: tuple[str, ...] = EXPANDING_METRICS) -> Step:
    totals = {f"{c}_expanding_sum": f"CAST(`{c}` AS DOUBLE)" for c in metrics}
    counts = {f"_n_{c}": f"IF(`{c}` IS NULL, 0, 1)" for c in metrics}
    return lambda lane: lane.running_sum({**totals, **counts})


def expanding_mean_step(metrics: tuple[str, ...] = EXPANDING_METRICS) -> Step:
    """Means from the totals and counts of ``expanding_sum_step``."""
    means = {f"{c}_expanding_mean": f"try_divide({c}_expanding_sum, _n_{c})" for c in metrics}
    return lambda lane: lane.with_sql(means, drop=[f"_n_{c}" for c in metrics])


def spend_changed_step(lane: Lane) -> Lane:
    return lane.with_windows(
        {"hours_since_last_spend": f"IF(coalesce(spend = lag(spend) {lane.over()}, false), 0, 1)"}
    )


# ---- stand-alone operators ----


def add_lag_features(
    df: DataFrame, lags: tuple[int, ...] = LAGS, metrics: tuple[str, ...] = LAG_METRICS, **lanes
) -> DataFrame:
    return over_series(df, lag_step(tuple(lags), tuple(metrics)), back=max(lags), **lanes)


def add_lag_features_ext(df: DataFrame, lags: tuple[int, ...] = LAGS, **lanes) -> DataFrame:
    """Lags of those extended metrics that the frame has."""
    present = tuple(c for c in LAG_METRICS_EXT if c in df.columns)
    return add_lag_features(df, lags, present, **lanes)


def add_target(df: DataFrame, rows_ahead: int = HORIZON, how: str = "row", **lanes) -> DataFrame:
    return over_series(df, target_step(rows_ahead, how), ahead=rows_ahead, **lanes)


def add_rolling_features(
    df: DataFrame,
    days: tuple[int, ...] = ROLLING_DAYS,
    metrics: tuple[str, ...] = ROLLING_METRICS,
    **lanes,
) -> DataFrame:
    return over_series(df, rolling_step(tuple(days), tuple(metrics)), back=DAY * max(days), **lanes)


def add_expanding_features(
    df: DataFrame, metrics: tuple[str, ...] = EXPANDING_METRICS, **lanes
) -> DataFrame:
    metrics = tuple(metrics)
    return over_series(df, expanding_sum_step(metrics), expanding_mean_step(metrics), **lanes)


def add_spend_changed(df: DataFrame, **lanes) -> DataFrame:
    return over_series(df, spend_changed_step, back=1, **lanes)


def _newest_first() -> list[Column]:
    return [F.col(c).desc() for c in ORDER]


def tail_rows(df: DataFrame, n: int = 24) -> DataFrame:
    """Newest ``n`` rows of each campaign: the last ones of its series, ties included.

    ``row_number <= n`` is applied before the exchange as well, so a huge campaign sends
    at most ``n`` rows per input partition.
    """
    w = Window.partitionBy(KEY).orderBy(*_newest_first(), series_tie(df.columns).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latest_row(df: DataFrame) -> DataFrame:
    return tail_rows(df, 1)


def latest_day_filter(df: DataFrame) -> DataFrame:
    """Rows of the newest date.

    The maximum is a scalar subquery, so on a table partitioned by date the scan reads one
    partition.
    """
    return df.filter(F.col("date") == df.agg(F.max("date")).scalar())


def recent_fallback(df: DataFrame, as_of, days: int = 7, n: int = 24) -> DataFrame:
    """Newest ``n`` rows per campaign among the last ``days`` days before ``as_of``."""
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    return tail_rows(df.filter(F.col("date") >= start), n)


def current_rows(df: DataFrame, as_of=None) -> DataFrame:
    """Rows to forecast from: the newest date, or with ``as_of`` that date if it has rows,
    else the recent fallback."""
    if as_of is None:
        return latest_day_filter(df)
    today = df.filter(F.col("date") == F.lit(as_of).cast("date"))
    any_today = today.limit(1).agg(F.count(F.lit(1)).alias("_today"))
    fallback = recent_fallback(df, as_of).crossJoin(F.broadcast(any_today)).filter("_today = 0")
    return today.unionByName(fallback.drop("_today"))
