"""Validation and cleaning of the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.functions.scalars import no_nan
from hourloom.schema import KEY, REQUIRED


def require_columns(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    missing = [c for c in (required or REQUIRED) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def drop_bad_dates(df: DataFrame) -> DataFrame:
    """Parse ``date``; rows whose date does not parse are dropped."""
    return df.withColumn("date", F.col("date").try_cast("date")).filter(F.col("date").isNotNull())


def drop_negative_spend(df: DataFrame) -> DataFrame:
    """Missing spend counts as zero and stays."""
    spend = F.coalesce(no_nan(F.col("spend").cast("double")), F.lit(0.0))
    return df.filter(spend >= 0)


def fill_numeric_null(df: DataFrame) -> DataFrame:
    """NULL and NaN become 0 in every numeric column."""
    filled = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            filled[field.name] = F.coalesce(no_nan(F.col(field.name)), F.lit(0.0)).cast(field.dataType)
        elif isinstance(field.dataType, T.NumericType):
            filled[field.name] = F.coalesce(F.col(field.name), F.lit(0).cast(field.dataType))
    return df.withColumns(filled) if filled else df


def validate(df: DataFrame) -> DataFrame:
    return (
        df.transform(require_columns)
        .transform(drop_bad_dates)
        .transform(drop_negative_spend)
        .transform(fill_numeric_null)
    )


def quality_counts(df: DataFrame) -> DataFrame:
    """One row: bad dates, negative spends and the nulls of every numeric column; one pass."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.agg(
        F.count_if(F.col("date").try_cast("date").isNull()).alias("bad_dates"),
        F.count_if(F.col("spend") < 0).alias("negative_spend"),
        *[
            F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"null_{c}")
            for c in numeric
        ],
    )


def duplicate_detect(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    keys = keys or [KEY, "event_ts"]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
