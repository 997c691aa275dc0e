"""Fact-table views over an event log: one row per campaign and hour, or per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.schema import COUNTERS, FACT_COLUMNS

_FROM_EVENTS = {
    "clicks": "click",
    "add_to_cart": "signup",
    "view_content": "view",
    "web_in_store_purchase": "purchase",
}


def _campaign():
    return F.concat(F.lit("C"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0"))


def _complete(df: DataFrame) -> DataFrame:
    rest = {c: F.lit(0).cast("bigint") for c in COUNTERS if c not in df.columns}
    impressions = F.col("impressions")
    return df.withColumns(
        {
            "ctr": F.lit(100.0) * F.col("clicks") / impressions,
            "cpc": F.when(F.col("clicks") > 0, F.col("spend") / F.col("clicks")),
            "cpm": F.lit(1000.0) * F.col("spend") / impressions,
            "cpp": F.lit(0.0),
            **rest,
        }
    ).select(*FACT_COLUMNS)


def campaign_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly campaign facts summed from ``events`` (money summed as decimal)."""
    hour = F.lpad(F.hour(F.col("ts").cast("timestamp_ntz")).cast("string"), 2, "0")
    money = F.when(F.col("event_type") != "error", F.col("value").cast("decimal(18,2)"))
    hourly = (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .groupBy(
            _campaign().alias("campaign_name"),
            F.col("ts").cast("date").alias("date"),
            F.concat(hour, F.lit(":00:00 - "), hour, F.lit(":59:59")).alias("hourly_window"),
        )
        .agg(
            F.sum(money).cast("double").alias("spend"),
            F.count(F.lit(1)).alias("impressions"),
            *[F.count_if(F.col("event_type") == e).alias(c) for c, e in _FROM_EVENTS.items()],
        )
    )
    return _complete(hourly)


def campaign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts at event grain: grows with the event log, many rows per campaign and hour."""
    ts = F.col("ts").cast("timestamp_ntz")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        _campaign().alias("campaign_name"),
        F.col("ts").cast("date").alias("date"),
        F.concat(
            F.date_format(ts, "HH:mm:ss.SSSSSS"),
            F.lit(" - "),
            F.lpad(F.col("event_id").cast("string"), 12, "0"),
        ).alias("hourly_window"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("spend"),
        F.lit(1).cast("bigint").alias("impressions"),
        *[(F.col("event_type") == e).cast("bigint").alias(c) for c, e in _FROM_EVENTS.items()],
    )
    return _complete(events)
