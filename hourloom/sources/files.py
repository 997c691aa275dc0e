"""Tables and models in files."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from hourloom.operators.horizon import forecast_long, forecast_wide
from hourloom.schema import FACT

FORMATS = ("csv", "parquet", "json")


def _format(path: str, file_format: str | None) -> str:
    fmt = (file_format or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if fmt not in FORMATS:
        kind = "Unsupported file format" if file_format else "Cannot detect the format of"
        raise ValueError(f"{kind}: {file_format or path}")
    return fmt


def scan_any(
    spark: SparkSession,
    path: str,
    file_format: str | None = None,
    schema: T.StructType | None = None,
    **options,
) -> DataFrame:
    """Read CSV, Parquet or JSON lines.  Without a schema CSV types are inferred."""
    fmt = _format(path, file_format)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True).option("prefersDate", True)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.options(**options).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"File not found: {path}") from error
        raise


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = FACT) -> DataFrame:
    """Fact table in CSV with declared types, so the file is read once."""
    return scan_any(spark, path, "csv", schema)


def sink_any(df: DataFrame, path: str, file_format: str | None = "csv", **options) -> str:
    fmt = _format(path, file_format)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.options(**options).save(path)
    return path


def sink_processed(df: DataFrame, path: str, file_format: str = "parquet") -> str:
    """Parquet partitioned by date, so that a forecast of one day reads one directory."""
    if file_format == "parquet":
        # Rebalance gathers a date in few files and splits a date too big for one.
        even = df.hint("rebalance", F.col("date"))
        even.write.mode("overwrite").partitionBy("date").parquet(path)
        return path
    return sink_any(df, path, file_format)


def list_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """Matching files by name: metadata only, contents are not read.

    A missing directory gives an empty table.
    """
    columns = ["path", "modificationTime", "length"]
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    try:
        return reader.load(directory).select(*columns).orderBy("path")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint")


def latest_file(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """One row: the newest match, NULL when there is none."""
    return list_files(spark, directory, pattern).agg(
        F.max_by("path", "modificationTime").alias("path"),
        F.max("modificationTime").alias("modificationTime"),
    )


def sink_forecast_long(totals: DataFrame, path: str, as_of: datetime, file_format: str = "csv") -> DataFrame:
    out = forecast_long(totals, as_of)
    sink_any(out, path, file_format)
    return out


def sink_forecast_wide(hourly: DataFrame, path: str, start: datetime, file_format: str = "csv") -> DataFrame:
    out = forecast_wide(hourly, start)
    sink_any(out, path, file_format)
    return out


def model_save(spark: SparkSession, model, path: str, metadata: dict | None = None) -> str:
    """A fitted ML model directory with a one-row JSON table of metadata beside it."""
    model.write().overwrite().save(f"{path}/model")
    text = json.dumps(metadata or {}, default=str)
    row = spark.range(1).select(F.lit(text).alias("metadata"))
    row.write.mode("overwrite").text(f"{path}/metadata")
    return path


def model_load(spark: SparkSession, path: str):
    """The saved model and its metadata."""
    from pyspark.ml import PipelineModel

    try:
        text = spark.read.text(f"{path}/metadata").first()
    except AnalysisException as error:
        raise FileNotFoundError(f"Model not found: {path}") from error
    return PipelineModel.load(f"{path}/model"), json.loads(text[0]) if text else {}
