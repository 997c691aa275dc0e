"""Landed insight pages to the flat fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hourloom.functions.scalars import action_total, repair_date, to_count, to_num
from hourloom.schema import (
    ACTION_VARIANTS,
    DOUBLE_METRICS,
    FACT_COLUMNS,
    METRICS,
    PAGE,
)
from hourloom.sources.files import sink_any

WINDOW_FIELD = "hourly_stats_aggregated_by_advertiser_time_zone"


def in_range(since: str | None, until: str | None) -> Column:
    """Rows of the inclusive date range; either end may be open."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col("date_start") >= since)
    if until is not None:
        keep = keep & (F.col("date_start") <= until)
    return keep


def explode_pages(pages: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row per element of ``data``, over all pages."""
    return pages.select(F.explode("data").alias("row")).select("row.*").filter(in_range(since, until))


def scan_insight_pages(
    spark: SparkSession,
    path: str,
    since: str | None = None,
    until: str | None = None,
    multi_line: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Raw rows of all pages in a directory: one JSON page per line, or per file if ``multi_line``.

    A page that can't be read is an error, unless ``mode`` is "DROPMALFORMED"; ``rejected_pages`` lists them.
    """
    pages = spark.read.schema(PAGE).option("mode", mode).option("multiLine", multi_line).json(path)
    return explode_pages(pages, since, until)


def rejected_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, page) of the pages that aren't JSON of the page schema."""
    pages = spark.read.option("wholetext", multi_line).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("page"))
    schema = StructType([*PAGE.fields, StructField("_bad", StringType())])
    bad = F.from_json("page", schema, {"columnNameOfCorruptRecord": "_bad"})["_bad"]
    return pages.filter((F.trim("page") != "") & bad.isNotNull())


def flatten_insights(rows: DataFrame) -> DataFrame:
    """One flat record per raw row; counters come from ``actions`` without exploding it."""
    window = F.coalesce(F.col(WINDOW_FIELD), F.lit(""))
    columns = {
        "campaign_name": F.coalesce(F.col("campaign_name"), F.lit("")),
        "date": repair_date(F.col("date_start"), F.col(WINDOW_FIELD)),
        "hourly_window": window,
        **{m: to_num(F.col(m)) if m in DOUBLE_METRICS else to_count(F.col(m)) for m in METRICS},
        **{name: action_total(F.col("actions"), types) for name, types in ACTION_VARIANTS.items()},
    }
    return rows.select(*[columns[c].alias(c) for c in FACT_COLUMNS])


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Every metric and counter as a number; bad text is 0."""
    present = [c for c in FACT_COLUMNS[3:] if c in df.columns]
    return df.withColumns(
        {c: to_num(F.col(c)) if c in DOUBLE_METRICS else to_count(F.col(c)) for c in present}
    )


def sort_dataset(df: DataFrame) -> DataFrame:
    """Output order of the raw table: a range-partitioned sort, for sinks only."""
    return df.orderBy("campaign_name", "date", "hourly_window")


def ingest_and_save(
    spark: SparkSession,
    pages_path: str,
    output_path: str,
    since: str | None = None,
    until: str | None = None,
    file_format: str = "csv",
) -> DataFrame:
    """Landed pages to the raw fact table on disk; returns the table read back."""
    flat = flatten_insights(scan_insight_pages(spark, pages_path, since, until))
    sink_any(sort_dataset(flat), output_path, file_format)
    from hourloom.sources.files import scan_any

    return scan_any(spark, output_path, file_format, flat.schema)
