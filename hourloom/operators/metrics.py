"""Error metrics and residual tables over a frame with ``actual`` and ``predicted``.

All are single-pass aggregates with map-side combine.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.scalars import EPS, half_even, smape_term
from hourloom.operators.projections import add_error_columns
from hourloom.operators.quantiles import exact_quantiles
from hourloom.schema import KEY

def _rows() -> Column:
    return F.count(F.lit(1))



def _y() -> Column:
    return F.col("actual").cast("double")


def _p() -> Column:
    return F.col("predicted").cast("double")


def mae() -> Column:
    return F.avg(F.abs(_y() - _p()))


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(_y() - _p(), F.lit(2.0))))


def r2() -> Column:
    """1 - SSE/SST; with a constant target 1 when every prediction is right, else 0."""
    sse = F.sum(F.pow(_y() - _p(), F.lit(2.0)))
    sst = F.var_pop(_y()) * F.count(_y())
    return F.when(sst > 0, F.lit(1.0) - sse / sst).when(sse == 0, F.lit(1.0)).when(sse > 0, F.lit(0.0))


def smape() -> Column:
    return F.avg(smape_term(_y(), _p())) * F.lit(100.0)


def wmape(weight: str | None = None) -> Column:
    """Percentage error weighted by the size of the target, or by a weight column."""
    error = F.abs(_p() - _y())
    if weight is None:
        # With weights |y| / sum |y| each row with y != 0 contributes |e| / sum |y|.
        size = F.sum(F.abs(_y()))
        return F.sum(F.when(_y() != 0, error).otherwise(F.lit(0.0))) / F.when(size > 0, size) * F.lit(100.0)
    base = F.when(_y() == 0, F.lit(EPS)).otherwise(F.abs(_y()))
    return F.sum(F.col(weight) * error / base) * F.lit(100.0)


def _zero_columns() -> dict[str, Column]:
    zeros = {"zero_actuals": F.count_if(_y() == 0), "zero_predictions": F.count_if(_p() == 0)}
    shares = {f"{n}_pct": c / _rows() * F.lit(100.0) for n, c in zeros.items()}
    return {**zeros, **shares}


def regression_columns() -> dict[str, Column]:
    return {"mae": mae(), "rmse": rmse(), "r2": r2(), "smape": smape(), "wmape": wmape()}


def _one_row(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in columns.items()])


def regression_metrics(df: DataFrame) -> DataFrame:
    return _one_row(df, regression_columns())


def zero_inflation(df: DataFrame) -> DataFrame:
    """Counts and percentages of zeros, and the direction of the bias."""
    out = _one_row(df, _zero_columns())
    a, p = F.col("zero_actuals"), F.col("zero_predictions")
    label = (
        F.when(a > p, "Under-predicting zeros").when(p > a, "Over-predicting zeros").otherwise("Balanced")
    )
    return out.withColumn("model_bias", label)


def target_summary(df: DataFrame) -> DataFrame:
    return _one_row(
        df, {"mean_target": F.avg(_y()), "std_target": F.stddev_samp(_y()), "n_samples": _rows()}
    )


def comprehensive_evaluation(test: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """One row of all metrics, with ``train_`` columns when a training frame is given."""
    base = {**regression_columns(), **_zero_columns()}
    out = _one_row(
        test,
        {**base, "mean_target": F.avg(_y()), "std_target": F.stddev_samp(_y()), "n_samples": _rows()},
    )
    if train is None:
        return out
    # Two one-row tables.
    return out.crossJoin(_one_row(train, {f"train_{n}": c for n, c in base.items()}))


def train_test_metrics(train: DataFrame, test: DataFrame) -> DataFrame:
    sides = [
        _one_row(d, {f"{side}_{n}": c for n, c in regression_columns().items()})
        for side, d in (("train", train), ("test", test))
    ]
    return sides[0].crossJoin(sides[1])


def as_long(one_row: DataFrame) -> DataFrame:
    """A one-row table as (metric, value)."""
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
            for n, t in one_row.dtypes
            if t != "string"
        ]
    )
    return one_row.select(F.explode(pairs).alias("e")).select("e.metric", "e.value")


def residual_stats(df: DataFrame) -> DataFrame:
    """Moments of actual - predicted; skewness and excess kurtosis are bias-adjusted."""
    e = _y() - _p()
    n, g1, g2 = F.count(e).cast("double"), F.skewness(e), F.kurtosis(e)
    skew = F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2) * g1
    kurt = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return _one_row(
        df,
        {
            "mean_residual": F.avg(e),
            "std_residual": F.stddev_samp(e),
            "max_residual": F.max(e),
            "min_residual": F.min(e),
            "residual_skewness": skew,
            "residual_kurtosis": kurt,
        },
    )


def campaign_error_report(df: DataFrame) -> DataFrame:
    """Errors per campaign, rounded half-even to 4 digits, and the plain ``mae``."""
    rows = add_error_columns(df).select(KEY, "actual", "predicted", "error", "abs_error")
    means = rows.groupBy(KEY).agg(
        F.avg("actual").alias("actual_mean"),
        F.count("actual").alias("actual_count"),
        F.avg("predicted").alias("predicted_mean"),
        F.avg("error").alias("error_mean"),
        F.stddev_samp("error").alias("error_std"),
        F.avg("abs_error").alias("abs_error_mean"),
        F.avg("abs_error").alias("mae"),
    )
    medians = exact_quantiles(rows, "abs_error", [0.5], [KEY]).select(
        F.col(KEY).alias("_k"), F.col("q")[0].alias("abs_error_median")
    )
    out = means.join(medians, F.col(KEY).eqNullSafe(F.col("_k")), "left").drop("_k")
    rounded = [c for c, t in out.dtypes if t == "double" and c != "mae"]
    return out.withColumns({c: half_even(F.col(c), 4) for c in rounded})


def residual_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins over the residuals, empty ones included; the maximum is in the last."""
    rows = df.select((_y() - _p()).alias("_r")).filter("_r IS NOT NULL")
    span = rows.agg(F.min("_r").alias("_a"), F.max("_r").alias("_b"))
    flat = F.col("_a") == F.col("_b")
    span = span.filter("_a IS NOT NULL").select(
        F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    bin_of = F.least(F.floor((F.col("_r") - F.col("_lo")) / width) + 1, F.lit(bins)).cast("int")
    counts = (
        rows.crossJoin(F.broadcast(span))
        .groupBy(bin_of.alias("bin"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    edges = span.select(
        "_lo", width.alias("_w"), F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    )
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("lower"),
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("upper"),
        F.coalesce(F.col("_n"), F.lit(0)).alias("n"),
    )


def residual_qq(df: DataFrame, points: int = 100) -> DataFrame:
    """Residual quantiles against normal quantiles at ``points`` evenly spaced levels."""
    levels = [(i + 0.5) / points for i in range(points)]
    normal = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in levels])
    rows = df.select((_y() - _p()).alias("_r"))
    grid = exact_quantiles(rows, "_r", levels)
    return grid.select(F.posexplode("q").alias("i", "residual_quantile")).select(
        (F.col("i") + 1).alias("point"),
        ((F.col("i") + 0.5) / F.lit(float(points))).alias("level"),
        F.get(normal, F.col("i")).alias("normal_quantile"),
        "residual_quantile",
    )


def scatter_pairs(df: DataFrame, share: float = 1.0, keys: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """(actual, predicted, residual) with the ends of the diagonal, which all rows give.

    With ``share`` below 1, those rows whose digest of ``keys`` and seed falls below it: the same rows at every run, about that share of them.
    ``scatter_bins`` counts all rows.
    """
    line = df.agg(
        F.least(F.min(_y()), F.min(_p())).alias("line_min"),
        F.greatest(F.max(_y()), F.max(_p())).alias("line_max"),
    )
    if share < 1:
        if not keys:
            raise ValueError("a sample needs the columns that tell rows apart")
        digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.lit(str(seed))))
        df = df.filter(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < round(share * 2**32))
    pairs = df.select(_y().alias("actual"), _p().alias("predicted"), (_y() - _p()).alias("residual"))
    return pairs.crossJoin(F.broadcast(line))


def scatter_bins(df: DataFrame, bins: int = 50) -> DataFrame:
    """Rows per cell of a ``bins`` x ``bins`` grid over the ranges of actual and predicted; cells without rows are left out."""
    pairs = df.select(_y().alias("_y"), _p().alias("_p")).filter("_y IS NOT NULL AND _p IS NOT NULL AND NOT isnan(_y) AND NOT isnan(_p)")
    ends = pairs.agg(*[f(c).alias(f"{c}_{n}") for c in ("_y", "_p") for n, f in (("lo", F.min), ("hi", F.max))])

    def cell(c: str):
        width = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        return F.when(width > 0, F.least(F.floor((F.col(c) - F.col(f"{c}_lo")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")

    # The ends are one row.
    placed = pairs.crossJoin(F.broadcast(ends)).select(cell("_y").alias("actual_bin"), cell("_p").alias("predicted_bin"))
    return placed.groupBy("actual_bin", "predicted_bin").agg(F.count(F.lit(1)).alias("n_rows"))


def union_importance(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack (feature, importance) tables with a ``method`` label."""
    out = None
    for method, table in tables.items():
        part = table.select("feature", "importance", F.lit(method).alias("method"))
        out = part if out is None else out.unionByName(part)
    return out


def top_features(importance: DataFrame, n: int = 10, method: str | None = None) -> DataFrame:
    """The ``n`` largest importances of one method."""
    rows = importance if method is None else importance.filter(F.col("method") == method)
    return rows.orderBy(F.col("importance").desc(), "feature").limit(n)
