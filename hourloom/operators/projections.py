"""Row-wise feature columns.  Each is one ``withColumns``: no shuffle, all in codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.scalars import EPS, cyclic, flag, leading_hour
from hourloom.schema import HORIZON, NOT_FEATURES


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def add_temporal_features(df: DataFrame) -> DataFrame:
    """Calendar parts of ``date`` and the hour parsed from ``hourly_window``; Monday is 0."""
    hour, weekday = leading_hour(F.col("hourly_window")), F.weekday("date")
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": weekday,
            "month": F.month("date"),
            "day_of_month": F.dayofmonth("date"),
            "is_weekend": flag(weekday.isin(5, 6)),
            "is_business_hours": flag(hour.between(9, 17)),
        }
    )


def cyclical_columns() -> dict[str, Column]:
    out = {}
    for prefix, source, period in [
        ("hour", "hour", 24),
        ("dayofweek", "day_of_week", 7),
        ("month", "month", 12),
    ]:
        out[f"{prefix}_sin"], out[f"{prefix}_cos"] = cyclic(F.col(source), period)
    return out


def add_cyclical(df: DataFrame) -> DataFrame:
    return df.withColumns(cyclical_columns())


def add_time_features(df: DataFrame, column: str = "date") -> DataFrame:
    """Calendar features of a timestamp column."""
    if column not in df.columns:
        raise ValueError(f"DataFrame must contain '{column}' column")
    ts = F.col(column)
    parts = df.withColumns(
        {
            "year": F.year(ts),
            "month": F.month(ts),
            "day": F.dayofmonth(ts),
            "hour": F.hour(ts.cast("timestamp_ntz")),
            "day_of_week": F.weekday(ts),
            "day_of_year": F.dayofyear(ts),
            "week_of_year": F.weekofyear(ts),
            "quarter": F.quarter(ts),
        }
    )
    return parts.withColumns(
        {
            **cyclical_columns(),
            "is_weekend": flag(F.col("day_of_week").isin(5, 6)),
            "is_business_hours": flag(F.col("hour").between(9, 17)),
            "is_lunch_hour": flag(F.col("hour").between(11, 14)),
            "is_prime_time": flag(F.col("hour").between(18, 22)),
            "is_holiday_season": flag(F.col("month").isin(11, 12)),
        }
    )


def add_ratio_features(df: DataFrame) -> DataFrame:
    actions = sum(
        (F.coalesce(_d(c), F.lit(0.0)) for c in ("landing_page_view", "view_content")),
        F.coalesce(_d("add_to_cart"), F.lit(0.0)),
    )
    return df.withColumns(
        {
            "ctr_cpm_ratio": _d("ctr") / (_d("cpm") + EPS),
            "cpc_ctr_ratio": _d("cpc") / (_d("ctr") + EPS),
            "clicks_to_impressions": _d("clicks") / (_d("impressions") + EPS),
            "actions_to_clicks": actions / (_d("clicks") + EPS),
            "spend_efficiency": _d("impressions") / (_d("spend") + EPS),
        }
    )


def add_interaction_features(df: DataFrame) -> DataFrame:
    pairs = {
        "hour_spend": ("hour", "spend"),
        "dayofweek_spend": ("day_of_week", "spend"),
        "ctr_cpc_interaction": ("ctr", "cpc"),
        "impressions_clicks_interaction": ("impressions", "clicks"),
        "business_hours_spend": ("is_business_hours", "spend"),
        "weekend_spend": ("is_weekend", "spend"),
    }
    return df.withColumns({name: _d(a) * _d(b) for name, (a, b) in pairs.items()})


def add_polynomial_features(df: DataFrame, degree: int = 2) -> DataFrame:
    metrics = ["spend", "impressions", "clicks", "ctr", "cpc"]
    return df.withColumns(
        {f"{c}_pow_{d}": F.pow(_d(c), F.lit(float(d))) for c in metrics for d in range(2, degree + 1)}
    )


def add_constant_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"forecast_horizon": F.lit(HORIZON), "is_missing_hour": F.lit(0)})


def feature_names(df: DataFrame) -> list[str]:
    """Model inputs: every column but the target, the keys and the current spend."""
    return [c for c in df.columns if c not in NOT_FEATURES]


def add_error_columns(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    y, p = _d(actual), _d(predicted)
    return df.withColumns(
        {
            "actual": y,
            "predicted": p,
            "error": y - p,
            "abs_error": F.abs(y - p),
            "pct_error": (y - p) / (y + EPS) * F.lit(100.0),
        }
    )


def clamp_nonnegative(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)
