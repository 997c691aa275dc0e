"""Raw facts to the feature table: one exchange by campaign for all windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.durable import durable
from hourloom.functions.scalars import half_even
from hourloom.operators.campaign import (
    attach_step,
    campaign_profile,
    clusters_step,
    frequency_step,
    tier_thresholds,
    volatility_step,
)
from hourloom.operators.lanes import over_series
from hourloom.operators.projections import (
    add_constant_features,
    add_cyclical,
    add_interaction_features,
    add_polynomial_features,
    add_ratio_features,
    add_temporal_features,
)
from hourloom.operators.quality import validate
from hourloom.operators.series import (
    DAY,
    LAGS,
    ROLLING_DAYS,
    current_rows,
    drop_unlabelled_step,
    expanding_mean_step,
    expanding_sum_step,
    lag_step,
    latest_row,
    rolling_step,
    spend_changed_step,
    tail_rows,
    target_step,
)
from hourloom.schema import FACT, HORIZON, TARGET
from hourloom.sources.files import scan_any, sink_processed


def _clean(df: DataFrame) -> DataFrame:
    return df.transform(validate).transform(add_temporal_features)


def _prepare_steps(keep_unlabelled: bool) -> list:
    """Lags and target first: the sort in time order then serves the whole-campaign
    windows too.  Statistics see all rows, so unlabelled rows are dropped last."""
    steps = [lag_step(), target_step(keep_unlabelled=True), attach_step()]
    return steps if keep_unlabelled else [*steps, drop_unlabelled_step]


def _labelled_means(clean: DataFrame) -> DataFrame:
    """Campaign means over rows that have a target, without a window over the table.

    Cleaned rows lack a target only at the end of a series, so the newest rows of each
    campaign are taken off its totals.
    """
    narrow = clean.select("campaign_name", "date", "hour", "hourly_window", "spend", "ctr", "cpc")
    signed = narrow.withColumn("_w", F.lit(1)).unionByName(
        tail_rows(narrow, HORIZON).withColumn("_w", F.lit(-1))
    )
    n = F.sum("_w")
    return (
        signed.groupBy("campaign_name")
        .agg(
            n.alias("_n"),
            *[
                half_even(F.sum(F.col(m) * F.col("_w")) / F.when(n > 0, n), 6).alias(f"{m}_mean")
                for m in ("spend", "ctr", "cpc")
            ],
        )
        .filter("_n > 0")
    )


def prepare_features(df: DataFrame, keep_unlabelled: bool = False, **lanes) -> DataFrame:
    """Validate, then calendar columns, campaign statistics, lags and target.

    Rows without a target are dropped unless ``keep_unlabelled``.
    """
    return over_series(
        _clean(df),
        *_prepare_steps(keep_unlabelled),
        back=max(LAGS),
        ahead=HORIZON,
        **lanes,
    )


def _projected(df: DataFrame) -> DataFrame:
    """Row-wise feature columns in one chain of projections."""
    return (
        df.transform(add_ratio_features)
        .transform(add_interaction_features)
        .transform(add_polynomial_features)
        .transform(add_cyclical)
        .transform(add_constant_features)
    )


def gap_features(df: DataFrame, **lanes) -> DataFrame:
    out = over_series(df, spend_changed_step, volatility_step, frequency_step, back=1, **lanes)
    return out.withColumn("is_missing_hour", F.lit(0))


def seasonal_features(df: DataFrame, **lanes) -> DataFrame:
    return gap_features(df.transform(add_cyclical).transform(add_constant_features), **lanes)


def _engineer_steps(thresholds: DataFrame) -> list:
    """Steps that can share a pass over the rows stand next to each other."""
    return [
        expanding_sum_step(),
        spend_changed_step,
        rolling_step(),
        expanding_mean_step(),
        volatility_step,
        clusters_step(thresholds),
        frequency_step,
    ]


def engineer_features(df: DataFrame, **lanes) -> DataFrame:
    """Windows, ratios, interactions, powers, seasonal columns and tiers of prepared rows."""
    # One row per campaign, read several times.
    thresholds = tier_thresholds(durable(campaign_profile(df)))
    rows = over_series(df, *_engineer_steps(thresholds), back=DAY * max(ROLLING_DAYS), **lanes)
    return _projected(rows)


def feature_table(df: DataFrame, keep_unlabelled: bool = False, **lanes) -> DataFrame:
    """``prepare_features`` and ``engineer_features`` in one pass over each series.

    The tier thresholds need the campaign means of labelled rows before any row can be
    compared; they come from a table of one row per campaign.
    """
    clean = _clean(df)
    means = campaign_profile(clean) if keep_unlabelled else _labelled_means(clean)
    thresholds = tier_thresholds(durable(means))
    # Frames of the second part start 720 rows back.
    rows = over_series(
        clean,
        *_prepare_steps(keep_unlabelled),
        *_engineer_steps(thresholds),
        back=DAY * max(ROLLING_DAYS),
        ahead=HORIZON,
        **lanes,
    )
    return _projected(rows)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Raw fact file; CSV is read with the declared types."""
    return scan_any(spark, path, schema=FACT if path.endswith(".csv") else None)


def prepare_dataset(
    spark: SparkSession, input_path: str, output_path: str, file_format: str = "parquet", **lanes
) -> DataFrame:
    """Raw fact file to the processed table on disk; returns the table read back."""
    sink_processed(feature_table(read_facts(spark, input_path), **lanes), output_path, file_format)
    return scan_any(spark, output_path, file_format)


def scoring_table(df: DataFrame, **lanes) -> DataFrame:
    """Feature rows up to the newest hour, without a target."""
    return feature_table(df, keep_unlabelled=True, **lanes).drop(TARGET)


def scoring_rows(df: DataFrame, as_of=None, **lanes) -> DataFrame:
    """The rows a forecast starts from: one per campaign active on the newest day."""
    return latest_row(current_rows(scoring_table(df, **lanes), as_of))
