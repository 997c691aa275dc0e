"""Forecast frames: future rows, hourly spread, totals and output tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions.scalars import event_ts, fixed_time, flag, half_even, hour_weight, micros
from hourloom.operators.projections import (
    add_cyclical,
    add_interaction_features,
    clamp_nonnegative,
)
from hourloom.schema import HORIZON, KEY


def cross_join_horizons(df: DataFrame, horizons: int = HORIZON) -> DataFrame:
    """Each row once per horizon 1..n, made by explode: no second input, no shuffle."""
    return df.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in range(1, horizons + 1)])))


def build_horizon_frame(latest: DataFrame, horizons: int = HORIZON, start: datetime | None = None) -> DataFrame:
    """Future rows of each latest row, at ``target_ts``, with every column derived from the calendar computed again.

    With ``start``, horizon 1 is that hour for all campaigns, so equal horizons are equal clock hours.
    Without it, each campaign goes on from its own newest hour.  Other columns keep their value.
    """
    if start is None:
        future = event_ts(F.col("date"), F.col("hour")) + F.make_interval(hours=F.col("horizon"))
    else:
        future = fixed_time(start) + F.make_interval(hours=F.col("horizon") - 1)
    rows = cross_join_horizons(latest, horizons).withColumn("target_ts", future)
    hour, weekday = F.hour("target_ts"), F.weekday("target_ts")
    rows = rows.withColumns(
        {
            "date": F.col("target_ts").cast("date"),
            "hour": hour,
            "day_of_week": weekday,
            "day_of_month": F.dayofmonth("target_ts"),
            "month": F.month("target_ts"),
            "is_weekend": flag(weekday.isin(5, 6)),
            "is_business_hours": flag(hour.between(9, 17)),
            "was_missing": F.lit(0),
        }
    )
    if "hour_sin" in latest.columns:
        rows = add_cyclical(rows)
    if "hour_spend" in latest.columns:
        rows = add_interaction_features(rows)
    return rows


def weight_distribution(
    totals: DataFrame,
    start_hour: int,
    night: float = 0.4,
    total: str = "predicted_spend_12h",
    horizons: int = HORIZON,
) -> DataFrame:
    """Spread each campaign's total over the hours from ``start_hour`` by hour weight."""
    rows = cross_join_horizons(totals, horizons)
    hour = (F.lit(start_hour) + F.col("horizon") - 1) % 24
    slots = [(start_hour + i) % 24 for i in range(horizons)]
    whole = sum((hour_weight(F.lit(h), night) for h in slots), F.lit(0.0))
    return rows.withColumn("hour_of_day", hour).select(
        KEY,
        "horizon",
        "hour_of_day",
        (F.col(total) * hour_weight(F.col("hour_of_day"), night) / whole).alias("predicted_spend"),
    )


def fill_forecast(hourly: DataFrame, totals: DataFrame, start: datetime, night: float = 0.4) -> DataFrame:
    """The hourly forecast, and for campaigns that it lacks their total spread over the hours from ``start`` by hour weight.

    ``hourly``: campaign, horizon, target_ts, predicted_spend; ``totals``: campaign, predicted_spend_12h.  Negative totals count as 0.  ``source`` is
    "model" or "fallback".
    """
    have = hourly.select(F.col(KEY).alias("_has")).distinct()
    missing = totals.join(have, F.col(KEY).eqNullSafe(F.col("_has")), "left_anti")
    missing = missing.withColumn("predicted_spend_12h", clamp_nonnegative(F.col("predicted_spend_12h")))
    spread = weight_distribution(missing, start.hour, night).withColumn("target_ts", fixed_time(start) + F.make_interval(hours=F.col("horizon") - 1))
    columns = [KEY, "horizon", "target_ts", "predicted_spend"]
    return hourly.select(*columns, F.lit("model").alias("source")).unionByName(spread.select(*columns, F.lit("fallback").alias("source")))


def forecast_totals(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(KEY).agg(
        F.sum("predicted_spend").alias("predicted_spend_12h"),
        F.avg("predicted_spend").alias("average_per_hour"),
    )


def forecast_hour_totals(hourly: DataFrame) -> DataFrame:
    """Total per horizon, and that total over the number of campaigns.

    ``hourly`` has one row per campaign and horizon, so campaigns are counted on rows.
    """
    totals = hourly.groupBy("horizon").agg(
        F.sum("predicted_spend").alias("total_spend"), F.count(F.lit(1)).alias("n_campaigns")
    )
    return totals.select(
        "horizon", "total_spend", (F.col("total_spend") / F.col("n_campaigns")).alias("average_spend")
    )


def two_stage_total(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Per campaign, the sum of its non-negative predictions over the horizons."""
    return scored.groupBy(KEY).agg(F.sum(clamp_nonnegative(F.col(prediction))).alias("expected_spend_12h"))


def hour_labels(start: datetime, horizons: int = HORIZON) -> list[str]:
    return [(start + timedelta(hours=i)).strftime("%I %p") for i in range(horizons)]


def forecast_wide(hourly: DataFrame, start: datetime, horizons: int = HORIZON) -> DataFrame:
    """One row per campaign, one column per hour label, values rounded to cents.

    Where ``hourly`` has ``target_ts``, a value stands under the label of its clock hour, counted from ``start``; hours outside
    the labels are left out, their campaigns stay.  Otherwise horizon 1 is the hour of ``start``.
    """
    labels = hour_labels(start, horizons)
    slot = F.col("horizon")
    if "target_ts" in hourly.columns:
        slot = F.floor((micros(F.col("target_ts")) - micros(fixed_time(start))) / 3_600_000_000).cast("int") + 1
    wide = (
        hourly.select(F.col(KEY).alias("Campaign"), slot.alias("_slot"), "predicted_spend").groupBy("Campaign")
        .pivot("_slot", list(range(1, horizons + 1)))
        .agg(F.first("predicted_spend"))
    )
    values = [
        F.coalesce(half_even(F.col(f"`{i}`"), 2), F.lit(0.0)).alias(label)
        for i, label in enumerate(labels, start=1)
    ]
    return wide.select("Campaign", *values)


def forecast_long(totals: DataFrame, as_of: datetime) -> DataFrame:
    return totals.select(
        KEY,
        F.col("predicted_spend_12h"),
        fixed_time(as_of).alias("timestamp"),
    )


def horizon_array(hourly: DataFrame, horizons: int = HORIZON) -> DataFrame:
    """Exactly ``horizons`` values per campaign, in order, 0 where none was predicted."""
    values = [
        F.coalesce(F.max(F.when(F.col("horizon") == h, F.col("predicted_spend"))), F.lit(0.0))
        for h in range(1, horizons + 1)
    ]
    return hourly.groupBy(KEY).agg(F.array(*values).alias("hourly_spend"))
