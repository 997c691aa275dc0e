"""Exact, linearly interpolated quantiles without holding a group in one task.

``percentile`` keeps every distinct value of a group in the memory of one task.  Here
values first fall into buckets that keep their order and whose number is bounded by the
range of a double (under 200,000; 64 per factor e), bucket counts give the buckets that hold the wanted
ranks, and only the values of those buckets are sorted.  Buckets of many different values are cut into parts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.durable import durable

#: Different values that one window orders at most, and the parts into which a bucket of more is cut.
CROWDED, CUTS = 65_536, 4096
#: Buckets per factor e: under 200,000 for all doubles.
BUCKETS_PER_LOG_UNIT = 64


def _bucket() -> Column:
    """Order-preserving, by the logarithm of the size: a whole number for each 64th of a factor e, below and above zero."""
    size = F.floor(F.log(F.abs("_x")) * BUCKETS_PER_LOG_UNIT) + 50_000
    finite = F.when(F.col("_x") == 0, F.lit(0)).otherwise(F.signum("_x") * size)
    return F.when(F.abs("_x") == float("inf"), F.signum("_x") * 200_000).otherwise(finite).cast("int")


def _counts_before(runs: DataFrame, group: list[str], crowded: int) -> DataFrame:
    """``runs`` (group, _x, copies) with ``_before``, the number of smaller values in the group.

    Groups with more than ``crowded`` different values are cut into ``CUTS`` parts of equal width between their ends, so often until no part is crowded.
    A part always leaves out one end, so parts of several values get smaller.
    """
    prior = Window.unboundedPreceding, -1
    sizes = runs.groupBy(*group).agg(F.count(F.lit(1)).alias("_d"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    large = durable(sizes.filter(F.col("_d") > crowded).drop("_d"))
    plain = F.coalesce(F.sum("copies").over(Window.partitionBy(*group).orderBy("_x").rowsBetween(*prior)), F.lit(0))
    n_large = large.count()
    if n_large == 0:
        return runs.withColumn("_before", plain)
    # At most one row for each ``crowded`` values; beyond a million the join is left to Spark.
    large = F.broadcast(large) if n_large <= 1_000_000 else large
    few = runs.join(large, group, "left_anti").withColumn("_before", plain)
    part = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CUTS).cast("int")
    parent = F.concat_ws("/", *group)
    many = durable(runs.join(large, group).select(*group, "_x", "copies", parent.alias("_path"), part.alias("_part")))
    totals = many.groupBy("_path", "_part").agg(F.sum("copies").alias("_n"))
    # At most CUTS + 1 rows for each crowded group.
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_part").rowsBetween(*prior)), F.lit(0))
    totals = totals.select("_path", "_part", earlier.alias("_earlier"))
    inside = _counts_before(many.select(*group, "_path", "_part", "_x", "copies"), ["_path", "_part"], crowded)
    whole = inside.join(totals, ["_path", "_part"]).withColumn("_before", F.col("_before") + F.col("_earlier"))
    return few.unionByName(whole.select(few.columns))


def value_ranks(df: DataFrame, value: str, crowded: int = CROWDED) -> DataFrame:
    """(value, first, copies): each distinct value, the number of smaller ones, and how often it
    occurs.  NULL and NaN are left out.  No task orders more than ``crowded`` values."""
    x = F.col(value).cast("double").alias("_x")
    runs = df.select(x).filter("_x IS NOT NULL AND NOT isnan(_x)").groupBy("_x").agg(F.count(F.lit(1)).alias("copies"))
    runs = durable(runs.withColumn("_bucket", _bucket()))
    counts = runs.groupBy("_bucket").agg(F.sum("copies").alias("_n"))
    # One row for each bucket.
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_first"))
    ranked = _counts_before(runs, ["_bucket"], crowded)
    return ranked.join(F.broadcast(counts), "_bucket").select(F.col("_x").alias(value), (F.col("_first") + F.col("_before")).alias("first"), "copies")


def exact_quantiles(
    df: DataFrame, value: str, probabilities: list[float], keys: list[str] | None = None, crowded: int = CROWDED
) -> DataFrame:
    """One row per group of ``keys``: the columns ``keys`` and ``q``, an array with one
    quantile of ``value`` per probability.  NULL and NaN are left out.  The values of the buckets that
    hold a wanted rank are stored at once; no task orders more than ``crowded`` of them."""
    keys = keys or []
    k = [f"_k{i}" for i in range(len(keys))]
    x = F.col(value).cast("double")
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], x.alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    rows = rows.withColumn("_bucket", _bucket())

    group = Window.partitionBy(*(k or [F.lit(0)]))
    prior = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy(*k, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "*",
            F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_before"),
            F.sum("_n").over(group).alias("_total"),
        )
    )
    # Each wanted rank lies between two neighbouring values, weighted by its fraction.  A
    # bucket keeps only the ranks that touch it.
    ranks_of = F.array(
        *[
            F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("rank"))
            for i, p in enumerate(probabilities)
        ]
    )
    wanted = F.explode(
        F.filter(
            ranks_of,
            lambda w: (F.ceil(w["rank"]) >= F.col("_before"))
            & (F.floor(w["rank"]) < F.col("_before") + F.col("_n")),
        )
    )
    low, high = F.floor("_want.rank"), F.ceil("_want.rank")
    ranks = (
        counts.withColumn("_want", wanted)
        .withColumn("_rank", F.explode(F.array_distinct(F.array(low, high))))
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        .withColumn(
            "_weight",
            F.when(F.col("_rank") == low, F.lit(1.0) - (F.col("_want.rank") - low)).otherwise(
                F.col("_want.rank") - low
            ),
        )
        .select(*k, "_bucket", F.col("_rank") - F.col("_before"), "_weight", "_want.i")
        .toDF(*k, "_bucket", "_offset", "_weight", "_i")
    )
    needed = ranks.select(*k, "_bucket").distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in k] + [
        F.col("a._bucket") == F.col("b._bucket")
    ]
    # One text for group and bucket: null keys are left out of it, and names tell the others apart.
    place = F.to_json(F.struct(*k, "_bucket")).alias("_place")
    values = durable(
        rows.alias("a").join(needed.alias("b"), same, "left_semi").groupBy(place, "_x").agg(F.count(F.lit(1)).alias("copies"))
    )
    placed = _counts_before(values, ["_place"], crowded)
    hit = (F.col("_offset") >= F.col("_before")) & (F.col("_offset") < F.col("_before") + F.col("copies"))
    parts = (
        ranks.withColumn("_place", place)
        .join(placed, "_place")
        .filter(hit)
        .select(*k, "_i", (F.col("_x") * F.col("_weight")).alias("_part"))
        .groupBy(*k, "_i")
        .agg(F.sum("_part").alias("_q"))
    )
    # At most one entry per probability and group.
    packed = F.transform(
        F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda e: e["_q"]
    ).alias("q")
    out = parts.groupBy(*k).agg(packed)
    return out.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], "q")
