"""Column names, Spark types and lookup values shared by the package."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "campaign_name"
REQUIRED = ["campaign_name", "date", "hourly_window", "spend"]
TARGET = "target_spend_12h"
HORIZON = 12

# --- Fixed values: action types that are summed into each counter column. ---
ACTION_VARIANTS: dict[str, list[str]] = {
    "web_in_store_purchase": ["web_in_store_purchase", "web_app_in_store_purchase"],
    "add_to_cart": [
        "add_to_cart",
        "omni_add_to_cart",
        "onsite_web_add_to_cart",
        "onsite_web_app_add_to_cart",
        "offsite_conversion.fb_pixel_add_to_cart",
    ],
    "landing_page_view": ["landing_page_view", "omni_landing_page_view"],
    "video_view": ["video_view"],
    "post": ["post"],
    "post_reaction": ["post_reaction"],
    "initiate_checkout": [
        "initiate_checkout",
        "omni_initiated_checkout",
        "onsite_web_initiate_checkout",
        "offsite_conversion.fb_pixel_initiate_checkout",
    ],
    "post_interaction_gross": ["post_interaction_gross"],
    "view_content": [
        "view_content",
        "omni_view_content",
        "onsite_web_view_content",
        "onsite_web_app_view_content",
        "offsite_conversion.fb_pixel_view_content",
    ],
    "post_engagement": ["post_engagement"],
    "page_engagement": ["page_engagement"],
}
COUNTERS = list(ACTION_VARIANTS)

# --- Fixed values: column order of the hourly fact table. ---
DOUBLE_METRICS = ["spend", "ctr", "cpc", "cpm", "cpp"]
LONG_METRICS = ["impressions", "clicks"]
METRICS = ["spend", "impressions", "clicks", "ctr", "cpc", "cpm", "cpp"]
FACT_COLUMNS = ["campaign_name", "date", "hourly_window", *METRICS, *COUNTERS]

# --- Fixed values: tier codes, and columns that are never features. ---
TIER_CODES = {"low": 0, "medium": 1, "high": 2}
NOT_FEATURES = [TARGET, "campaign_name", "date", "hourly_window", "spend"]


def _fact_type(name: str) -> T.DataType:
    if name in ("campaign_name", "hourly_window"):
        return T.StringType()
    if name == "date":
        return T.DateType()
    return T.DoubleType() if name in DOUBLE_METRICS else T.LongType()


FACT = T.StructType([T.StructField(c, _fact_type(c)) for c in FACT_COLUMNS])

_S = T.StringType()
# All scalars arrive as text or as bare JSON numbers; both load into STRING.
INSIGHT_ROW = T.StructType(
    [
        T.StructField("campaign_name", _S),
        T.StructField("date_start", _S),
        T.StructField("hourly_stats_aggregated_by_advertiser_time_zone", _S),
        *[T.StructField(m, _S) for m in METRICS],
        T.StructField(
            "actions",
            T.ArrayType(
                T.StructType([T.StructField("action_type", _S), T.StructField("value", _S)])
            ),
        ),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("data", T.ArrayType(INSIGHT_ROW)),
        T.StructField(
            "paging",
            T.StructType(
                [
                    T.StructField(
                        "cursors",
                        T.StructType([T.StructField("before", _S), T.StructField("after", _S)]),
                    ),
                    T.StructField("next", _S),
                ]
            ),
        ),
    ]
)
