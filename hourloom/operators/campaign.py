"""Campaign-level statistics, tiers, and their attachment to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.durable import durable
from hourloom.functions.scalars import half_even, tier_code
from hourloom.operators.lanes import Lane, Step, over_series
from hourloom.operators.quantiles import exact_quantiles
from hourloom.schema import KEY

# --- Fixed values: suffix of a statistic and the SQL function behind it. ---
_FUNCTIONS = {
    "mean": "avg",
    "std": "stddev_samp",
    "sum": "sum",
    "count": "count",
    "max": "max",
    "min": "min",
}
STATS = {
    "spend": ["mean", "std", "sum", "count"],
    "impressions": ["mean", "sum"],
    "clicks": ["mean", "sum"],
    "ctr": ["mean"],
    "cpc": ["mean"],
}
PROFILE = {
    "spend": ["mean", "std", "max", "min"],
    "ctr": ["mean", "std"],
    "cpc": ["mean", "std"],
    "impressions": ["mean", "sum"],
}
_TIER_INPUTS = {"spend": ["mean"], "ctr": ["mean"], "cpc": ["mean"]}


def _raw(spec: dict[str, list[str]]) -> dict[str, str]:
    return {f"{c}_{f}": f"{_FUNCTIONS[f]}(`{c}`)" for c, fs in spec.items() for f in fs}


def _rounded(df: DataFrame, spec: dict[str, list[str]], digits: int) -> dict[str, Column]:
    """Half-even rounding of the fractional statistics."""
    types = dict(df.dtypes)
    names = [f"{c}_{f}" for c, fs in spec.items() for f in fs]
    return {n: half_even(F.col(n), digits) for n in names if types[n] == "double"}


def _table(df: DataFrame, spec: dict[str, list[str]], digits: int) -> DataFrame:
    out = df.groupBy(KEY).agg(*[F.expr(c).alias(n) for n, c in _raw(spec).items()])
    return out.withColumns(_rounded(out, spec, digits))


def campaign_stats(df: DataFrame) -> DataFrame:
    return _table(df, STATS, 4)


def campaign_profile(df: DataFrame) -> DataFrame:
    return _table(df, PROFILE, 6)


def attach_step(spec: dict[str, list[str]] = STATS, digits: int = 4) -> Step:
    """Statistics of the whole campaign on each of its rows, without a join by campaign."""

    def step(lane: Lane) -> Lane:
        lane = lane.per_campaign(_raw(spec))
        return lane.with_columns(_rounded(lane.df, spec, digits))

    return step


def add_campaign_features(df: DataFrame, **lanes) -> DataFrame:
    return over_series(df, attach_step(), **lanes)


def join_campaign_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join of campaign-level columns fitted elsewhere, e.g. on training rows only.

    No hint: the table has one row per campaign, so its size is for the optimizer to check.
    """
    return df.join(stats, KEY, "left")


def tier_thresholds(profile: DataFrame) -> DataFrame:
    """One row of exact quantiles of the campaign means.

    ``spend_edges`` are the 1/3 and 2/3 quantiles, ``ctr_edges`` and ``cpc_edges`` the
    0.33 and 0.67 quantiles.
    """
    means = profile.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("x"))
                    for m in ("spend", "ctr", "cpc")
                ]
            )
        ).alias("e")
    ).select("e.metric", "e.x")
    cuts = [1 / 3, 2 / 3, 0.33, 0.67]
    q = exact_quantiles(means, "x", cuts, ["metric"])
    edges = lambda metric, a, b: F.max(
        F.when(F.col("metric") == metric, F.array(F.col("q")[a], F.col("q")[b]))
    ).alias(f"{metric}_edges")
    return q.agg(edges("spend", 0, 1), edges("ctr", 2, 3), edges("cpc", 2, 3))


def spend_level(mean: Column, edges: Column) -> Column:
    """Thirds of the campaigns, closed on the right; equal edges put ties in the lower one."""
    return (
        F.when(mean <= edges[0], "low").when(mean <= edges[1], "medium").when(mean.isNotNull(), "high")
    )


def performance_tier(ctr: Column, cpc: Column, ctr_edges: Column, cpc_edges: Column) -> Column:
    """Low wins over high."""
    low = (ctr < ctr_edges[0]) | (cpc > cpc_edges[1])
    high = (ctr > ctr_edges[1]) & (cpc < cpc_edges[0])
    return F.when(low, "low").when(high, "high").otherwise("medium")


def _tiers(df: DataFrame, thresholds: DataFrame, prefix: str = "") -> DataFrame:
    """Compare campaign means with the one-row table of thresholds."""
    mean = {m: F.col(f"{prefix}{m}_mean") for m in ("spend", "ctr", "cpc")}
    joined = df.crossJoin(F.broadcast(thresholds))
    return joined.withColumns(
        {
            "spend_level": spend_level(mean["spend"], F.col("spend_edges")),
            "performance_tier": performance_tier(
                mean["ctr"], mean["cpc"], F.col("ctr_edges"), F.col("cpc_edges")
            ),
        }
    ).drop("spend_edges", "ctr_edges", "cpc_edges")


def campaign_tiers(df: DataFrame) -> DataFrame:
    """Campaign profile with its two tiers by name, one row per campaign."""
    # One row per campaign, read several times.
    profile = durable(campaign_profile(df))
    return _tiers(profile, tier_thresholds(profile))


def clusters_step(thresholds: DataFrame) -> Step:
    """Tier codes on each row, from the campaign means on the row and global thresholds."""

    def step(lane: Lane) -> Lane:
        lane = lane.per_campaign({f"_{n}": c for n, c in _raw(_TIER_INPUTS).items()})
        names = [f"_{m}_mean" for m in ("spend", "ctr", "cpc")]
        lane = lane.with_columns({n: half_even(F.col(n), 6) for n in names})
        lane = lane.map(lambda d: _tiers(d, thresholds, "_").drop(*names))
        return lane.with_columns({c: tier_code(F.col(c)) for c in ("spend_level", "performance_tier")})

    return step


def add_campaign_clusters(df: DataFrame, **lanes) -> DataFrame:
    return over_series(df, clusters_step(tier_thresholds(durable(campaign_profile(df)))), **lanes)


def encode_tiers(df: DataFrame) -> DataFrame:
    present = [c for c in ("spend_level", "performance_tier") if c in df.columns]
    return df.withColumns({c: tier_code(F.col(c)) for c in present})


def volatility_step(lane: Lane) -> Lane:
    return lane.per_campaign({"campaign_spend_volatility": "stddev_samp(spend)"})


def frequency_step(lane: Lane) -> Lane:
    return lane.distinct_per_day({"campaign_hourly_frequency": "hour"})


def add_spend_volatility(df: DataFrame, **lanes) -> DataFrame:
    return over_series(df, volatility_step, **lanes)


def add_hourly_frequency(df: DataFrame, **lanes) -> DataFrame:
    return over_series(df, frequency_step, **lanes)


def distinct_campaigns(df: DataFrame) -> DataFrame:
    return df.select(KEY).distinct()


def semi_join_members(df: DataFrame, members: DataFrame) -> DataFrame:
    return df.join(members.select(KEY), KEY, "left_semi")


def anti_join_members(df: DataFrame, members: DataFrame) -> DataFrame:
    return df.join(members.select(KEY), KEY, "left_anti")
