"""Training, scoring, importance and intervals with Spark ML gradient-boosted trees."""

from __future__ import annotations

import math
import random
from datetime import datetime
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.operators.campaign import encode_tiers
from hourloom.operators.horizon import build_horizon_frame, fill_forecast, two_stage_total, weight_distribution
from hourloom.operators.metrics import train_test_metrics
from hourloom.operators.projections import clamp_nonnegative, feature_names
from hourloom.operators.quantiles import value_ranks
from hourloom.operators.series import current_rows, latest_row
from hourloom.operators.split import rolling_origin_folds, split_data
from hourloom.durable import durable
from hourloom.schema import KEY, TARGET
from hourloom.sources.files import model_load, model_save, scan_any

# --- Fixed values: search space; unlimited depth becomes 12.  Leaf count and the two
# regularisation weights have no counterpart in Spark's trees. ---
SEARCH_SPACE = {
    "maxDepth": [6, 8, 10, 12],
    "stepSize": [0.01, 0.05, 0.1, 0.2],
    "maxIter": [100, 200, 500, 1000],
    "subsamplingRate": [0.6, 0.8, 1.0],
    "featureSubsetStrategy": ["0.6", "0.8", "all"],
    "minInstancesPerNode": [10, 20, 50, 100],
}


MISSING = "_is_null"


def as_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns as doubles without NULLs: the trees accept no missing values.

    A feature ``{c}_is_null`` that is no column of ``df`` is made here: 1 where ``c`` is NULL (or no column at all)."""
    df = encode_tiers(df)
    made = [c for c in features if c.endswith(MISSING) and c not in df.columns]
    flags = {c: F.col(b).isNull().cast("double") if (b := c.removesuffix(MISSING)) in df.columns else F.lit(1.0) for c in made}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features if c not in flags}
    return df.withColumns({**flags, **filled})


def missing_indicators(df: DataFrame, features: list[str]) -> list[str]:
    """``{c}_is_null`` for each of the features that is NULL in some rows but not in all; one pass over ``df``."""
    df = encode_tiers(df)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in features]).first().asDict()
    return [c + MISSING for c in features if 0 < counts[c] < counts["_rows"]]


def select_features(df: DataFrame, indicators: bool = False) -> tuple[DataFrame, list[str]]:
    names = feature_names(df)
    if indicators:
        names = names + missing_indicators(df, names)
    return as_inputs(df, names), names


def sample_space(n_trials: int, seed: int, space: dict[str, list]) -> list[dict]:
    """``n_trials`` distinct settings of the grid (all of them when it is smaller)."""
    size = reduce(lambda a, values: a * len(values), space.values(), 1)
    picks = random.Random(seed).sample(range(size), min(n_trials, size))
    settings = []
    for index in picks:
        chosen = {}
        for name, values in space.items():
            index, i = divmod(index, len(values))
            chosen[name] = values[i]
        settings.append(chosen)
    return settings


def _pipeline(features: list[str], params: dict, seed: int) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol=TARGET, seed=seed, **params)
    return Pipeline(stages=[assembler, trees])


def _by_tree_count(settings: list[dict]) -> list[tuple[dict, list[int]]]:
    """Settings that differ in the number of trees alone share a fit: (the other parameters, the counts wanted)."""
    groups: dict[tuple, list[int]] = {}
    for setting in settings:
        rest = tuple(sorted((k, v) for k, v in setting.items() if k != "maxIter"))
        groups.setdefault(rest, []).append(setting["maxIter"])
    return [(dict(rest), sorted(set(counts))) for rest, counts in groups.items()]


def _fold_errors(rows: DataFrame, features: list[str], params: dict, counts: list[int], folds: int, seed: int) -> dict[int, float]:
    """Mean RMSE over the folds for each number of trees.

    Boosting adds trees one after the other, so the first k trees of a fit are the fit of k trees: one fit of the largest
    number gives the errors of all smaller ones.
    """
    sums = dict.fromkeys(counts, 0.0)
    for fold in range(1, folds + 1):
        model = _pipeline(features, {**params, "maxIter": counts[-1]}, seed).fit(rows.filter(F.col("fold") < fold))
        held = model.stages[0].transform(rows.filter(F.col("fold") == fold)).select("features", F.col(TARGET).cast("double").alias(TARGET))
        errors = model.stages[-1].evaluateEachIteration(held, "squared")
        for k in counts:
            sums[k] += math.sqrt(errors[k - 1])
    return {k: total / folds for k, total in sums.items()}


def search_settings(
    rows: DataFrame, features: list[str], settings: list[dict], folds: int, seed: int, parallelism: int = 4, halving: int = 0, least_trees: int = 50
) -> list[dict]:
    """All trials, best first: each setting with its mean RMSE and the number of trees it was judged by.

    ``halving`` = 0 judges every setting by all its trees.  With n > 1, all are judged by ``least_trees`` trees first; the best n-th
    goes on with n times as many, until the survivors are judged by all their trees.  Settings that fell out keep the error they had.
    """

    def judged(some: list[dict], most: int | None) -> list[dict]:
        capped = [{**s, "maxIter": min(s["maxIter"], most or s["maxIter"])} for s in some]
        groups = _by_tree_count(capped)
        task = inheritable_thread_target(rows.sparkSession)(lambda group: _fold_errors(rows, features, *group, folds, seed))
        with ThreadPool(min(parallelism, len(groups))) as pool:
            found = pool.map(task, groups)
        errors = {(tuple(sorted(rest.items())), k): e for (rest, _), by_count in zip(groups, found) for k, e in by_count.items()}
        key = lambda s: (tuple(sorted((k, v) for k, v in s.items() if k != "maxIter")), s["maxIter"])
        trials = [{"params": s, "trees": c["maxIter"], "rmse": errors[key(c)]} for s, c in zip(some, capped)]
        return sorted(trials, key=lambda t: t["rmse"])

    left, fallen, trees = settings, [], least_trees
    while halving > 1 and len(left) > 1 and trees < max(s["maxIter"] for s in left):
        trials = judged(left, trees)
        keep = -(-len(trials) // halving)
        left, fallen = [t["params"] for t in trials[:keep]], trials[keep:] + fallen
        trees *= halving
    return judged(left, None) + fallen


def train_gbt(
    df: DataFrame,
    features: list[str] | None = None,
    n_trials: int = 100,
    cv_folds: int = 5,
    random_state: int = 42,
    space: dict[str, list] | None = None,
    parallelism: int = 4,
    halving: int = 0,
    indicators: bool = False,
) -> tuple[PipelineModel, dict]:
    """Random search over boosted-tree settings by RMSE on rolling-origin folds, then a
    fit of the best setting on all rows.  Returns the model and its metadata, with all trials.

    ``parallelism`` fits run at a time, each as its own Spark jobs; settings that differ in the number of trees share
    one.  ``halving``: see ``search_settings``.  ``indicators``: features with NULLs also get ``{c}_is_null``, which are
    fixed here and kept among the feature names.
    """
    features = features or feature_names(df)
    if indicators:
        features = features + missing_indicators(df, features)
    # Folds follow time; a frame without dates is ordered by what it has.
    times = {"date": "date", "hour": "int", "hourly_window": "string"}
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in times.items() if c not in df.columns})
    settings = sample_space(n_trials, random_state, space or SEARCH_SPACE)
    trials = [{"params": settings[0], "trees": settings[0]["maxIter"], "rmse": None}]
    if len(settings) > 1:
        # Every trial reads the folds again, so they are cut from their lineage once.
        rows = durable(as_inputs(rolling_origin_folds(df, cv_folds), features))
        trials = search_settings(rows, features, settings, cv_folds, random_state, parallelism, halving)
    best = trials[0]["params"]
    model = _pipeline(features, best, random_state).fit(as_inputs(df, features))
    return model, {
        "best_params": best,
        "best_cv_rmse": trials[0]["rmse"],
        "feature_names": features,
        "model_type": "GBTRegressor",
        "trials": trials,
    }


def predict(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Rows of ``df`` with ``prediction``."""
    return model.transform(as_inputs(df, features)).drop("features")


def predictions(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Campaign, actual and predicted of labelled rows."""
    return predict(model, df, features).select(
        KEY, F.col(TARGET).alias("actual"), F.col("prediction").alias("predicted")
    )


def train_job(
    spark: SparkSession,
    data_path: str,
    model_path: str,
    n_trials: int = 100,
    cv_folds: int = 5,
    space: dict[str, list] | None = None,
    **search,
) -> tuple[PipelineModel, DataFrame]:
    """Processed table to a saved model; returns it with its train and test metrics.  ``search``: more options of ``train_gbt``."""
    train, test = split_data(scan_any(spark, data_path), 0.2, "campaign")
    model, metadata = train_gbt(train, None, n_trials, cv_folds, space=space, **search)
    model_save(spark, model, model_path, metadata)
    names = metadata["feature_names"]
    return model, train_test_metrics(predictions(model, train, names), predictions(model, test, names))


# ---- scoring ----


def score_12h(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """One prediction per campaign, from its newest row."""
    scored = predict(model, latest_row(df), features)
    return scored.select(KEY, F.col("prediction").alias("predicted_spend_12h"))


def score_horizons(model: PipelineModel, latest: DataFrame, features: list[str], start: datetime | None = None) -> DataFrame:
    """Raw prediction per campaign and horizon, with the hour it is for."""
    return predict(model, build_horizon_frame(latest, start=start), features).select(KEY, "horizon", "target_ts", "prediction")


def score_hourly(model: PipelineModel, latest: DataFrame, features: list[str], start: datetime | None = None) -> DataFrame:
    """Non-negative prediction per campaign and horizon; with ``start``, for the hours from then on, alike for all campaigns."""
    scored = score_horizons(model, latest_row(latest), features, start)
    return scored.select(KEY, "horizon", "target_ts", clamp_nonnegative(F.col("prediction")).alias("predicted_spend"))


def score_hourly_filled(
    model: PipelineModel, rows: DataFrame, wanted: DataFrame, features: list[str], start: datetime, night: float = 0.4
) -> DataFrame:
    """``score_hourly`` of ``rows``, and for the campaigns of ``wanted`` without a row there the total predicted from their newest
    row in ``wanted``, spread by hour weights; ``source`` says which."""
    hourly = score_hourly(model, rows, features, start)
    # Only campaigns without a forecast are scored for their total.
    missing = wanted.join(hourly.select(F.col(KEY).alias("_has")).distinct(), F.col(KEY).eqNullSafe(F.col("_has")), "left_anti")
    return fill_forecast(hourly, score_12h(model, missing, features), start, night)


def predict_two_stage(model: PipelineModel, latest: DataFrame, features: list[str]) -> DataFrame:
    return two_stage_total(score_horizons(model, latest_row(latest), features))


def fallback_hourly_distribution(
    model: PipelineModel, df: DataFrame, features: list[str], start_hour: int, night: float = 0.4
) -> DataFrame:
    return weight_distribution(score_12h(model, df, features), start_hour, night)


def predict_interval(
    predicted: DataFrame,
    holdout: DataFrame,
    n_iterations: int = 100,
    seed: int = 42,
    prediction: str = "predicted_spend_12h",
) -> DataFrame:
    """Residual bootstrap: ``n_iterations`` draws of prediction + hold-out residual.

    ``holdout`` has actual and predicted.  A draw is a rank picked by md5 of campaign, draw and seed among all
    residuals; draws meet residuals in a join by rank.  Without residuals there is no interval, which is an error.
    """
    error = (F.col("actual").cast("double") - F.col("predicted").cast("double")).alias("residual")
    residuals = durable(holdout.select(error).filter("residual IS NOT NULL AND NOT isnan(residual)"))
    n = residuals.count()
    if not n:
        raise ValueError("holdout has no row with both actual and predicted")
    pool = value_ranks(residuals, "residual").select(
        "residual", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("_rank")
    )
    digest = F.md5(F.concat_ws("|", F.col(KEY), F.col("_b"), F.lit(seed)))
    rank = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % F.lit(n)
    draws = predicted.select(KEY, F.col(prediction).alias("prediction"), F.explode(F.sequence(F.lit(1), F.lit(n_iterations))).alias("_b"))
    rows = draws.withColumn("_rank", rank).join(pool, "_rank").withColumn("_draw", F.col("prediction") + F.col("residual"))
    return rows.groupBy(KEY).agg(
        F.first("prediction").alias("prediction"),
        F.percentile("_draw", 0.025).alias("lower_95"),
        F.percentile("_draw", 0.975).alias("upper_95"),
        F.stddev_pop("_draw").alias("std"),
    )


# ---- importance ----


def importance_builtin(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """Share of the split gain per feature."""
    gains = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(
        [(n, float(g)) for n, g in zip(features, gains)], "feature string, importance double"
    )


def _shuffled_pairs(rows: DataFrame, repeats: int, seed: int) -> DataFrame:
    """Each row once per repeat, with the feature values of a row drawn by a permutation.

    Ranks in two hash orders are matched.  A rank is the count of the hash groups before
    plus the rank inside the group, so no task sorts the table.
    """

    def ranked(order_seed: int, rank: str) -> DataFrame:
        h = F.xxhash64("_id", F.col("repeat"), F.lit(order_seed))
        keyed = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn(
            "_h", h
        ).withColumn("_g", F.shiftright("_h", 48))
        prior = Window.partitionBy("_rep").orderBy("_grp").rowsBetween(Window.unboundedPreceding, -1)
        # At most 65,536 groups per repeat.
        sizes = (
            keyed.groupBy(F.col("repeat").alias("_rep"), F.col("_g").alias("_grp"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(prior), F.lit(0)))
            .drop("_n")
        )
        inside = F.row_number().over(Window.partitionBy("repeat", "_g").orderBy("_h", "_id"))
        same = (F.col("repeat") == F.col("_rep")) & (F.col("_g") == F.col("_grp"))
        return (
            keyed.withColumn("_inside", inside)
            .join(F.broadcast(sizes), same)
            .withColumn(rank, F.col("_before") + F.col("_inside"))
            .drop("_h", "_g", "_inside", "_rep", "_grp", "_before")
        )

    receivers = ranked(seed, "rank")
    donors = ranked(seed + 1, "rank").select("repeat", "rank", F.col("features").alias("donor"))
    return receivers.join(donors, ["repeat", "rank"])


def importance_permutation(
    model: PipelineModel,
    df: DataFrame,
    features: list[str],
    n_repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Mean drop of R2 when one feature is shuffled, over ``n_repeats`` shuffles.

    A feature that no tree splits on cannot change a prediction, so its drop is 0 and only
    the others are scored.  All (feature, repeat) cases are scored in one job.
    """
    spark = df.sparkSession
    assembler, trees = model.stages[0], model.stages[-1]
    gains = trees.featureImportances.toArray()
    used = [i for i, g in enumerate(gains) if g > 0]
    inputs = as_inputs(df, features)
    rows = durable(
        assembler.transform(inputs).select(
            F.struct(KEY, "date", "hour", "hourly_window").alias("_key"),
            "features",
            F.col(TARGET).alias("actual"),
        )
    )
    # The checkpoint fixes partitions and their order, so the row ids stay the same.
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).drop("_key")
    base = trees.transform(rows).agg(
        F.sum(F.pow(F.col("actual") - F.col("prediction"), F.lit(2.0))).alias("_sse"),
        (F.var_pop("actual") * F.count("actual")).alias("_sst"),
    )
    pairs = _shuffled_pairs(rows, n_repeats, seed)
    cases = (
        pairs.withColumn("own", vector_to_array("features"))
        .withColumn("other", vector_to_array("donor"))
        .withColumn("_j", F.explode(F.array(*[F.lit(j) for j in used] or [F.lit(-1)])))
        .filter("_j >= 0")
        .select(
            "repeat",
            "_j",
            "actual",
            array_to_vector(
                F.transform("own", lambda v, i: F.when(i == F.col("_j"), F.get("other", i)).otherwise(v))
            ).alias("features"),
        )
    )
    drops = (
        trees.transform(cases)
        .groupBy("_j", "repeat")
        .agg(F.sum(F.pow(F.col("actual") - F.col("prediction"), F.lit(2.0))).alias("_sse_j"))
        .crossJoin(F.broadcast(base))
        .groupBy("_j")
        .agg(F.avg((F.col("_sse_j") - F.col("_sse")) / F.when(F.col("_sst") > 0, F.col("_sst"))).alias("importance"))
    )
    names = spark.createDataFrame(list(enumerate(features)), "_i int, feature string")
    return names.join(F.broadcast(drops), F.col("_i") == F.col("_j"), "left").select(
        "feature", F.coalesce("importance", F.lit(0.0)).alias("importance")
    )


def load_for_scoring(spark: SparkSession, model_path: str) -> tuple[PipelineModel, list[str]]:
    model, metadata = model_load(spark, model_path)
    return model, metadata["feature_names"]


def rows_to_forecast(df: DataFrame, as_of=None) -> DataFrame:
    """Newest row of each campaign active on the newest day (or as of a date)."""
    return latest_row(current_rows(df, as_of))
