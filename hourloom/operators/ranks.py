"""Places in an order by hash, however many rows meet in one group.

A window orders the rows of a group in one task.  Where a group has more than ``CROWDED`` rows, it is cut by the next
three hexadecimal digits of its rows' keys: the 4,096 parts keep the order, their sums are added up, and parts that are
still crowded are cut again.  Only rows whose whole keys are equal stay together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.durable import durable

#: Rows that one window orders at most, and the digits by which a group of more is cut.
CROWDED, DIGITS = 65_536, 3
MAX_BROADCAST_GROUPS = 100_000
_PRIOR = (Window.unboundedPreceding, -1)


def digits(number: Column) -> Column:
    """16 hexadecimal digits in the order of the signed 64-bit number."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def _same(columns: list[str], other: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(columns, other)])


def _sum_before(copies: str, group: list[str], order: str) -> Column:
    frame = Window.partitionBy(*group).orderBy(order).rowsBetween(*_PRIOR)
    return F.coalesce(F.sum(copies).over(frame), F.lit(0))


def copies_before(runs: DataFrame, group: list[str], key: str, copies: str, name: str, crowded: int = CROWDED, length: int = 48) -> DataFrame:
    """``runs`` with ``name``: the sum of ``copies`` over the rows of the same ``group`` with a smaller ``key``.

    ``key`` is text of ``length`` hexadecimal digits, of one letter case at each place; ``runs`` is read several times, so it should be stored.
    Groups are compared null-safe.  Counts of rows run at once.
    """
    return _cut(runs, group, key, copies, name, crowded, length, 0)


def _cut(runs: DataFrame, group: list[str], key: str, copies: str, name: str, crowded: int, length: int, depth: int) -> DataFrame:
    plain = runs.withColumn(name, _sum_before(copies, group, key))
    if depth * DIGITS >= length:
        return plain
    names = [f"_g{i}" for i in range(len(group))]
    large = durable(runs.groupBy(*[F.col(c).alias(a) for c, a in zip(group, names)]).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > crowded).drop("_rows"))
    n_large = large.count()
    if n_large == 0:
        return plain
    if n_large <= MAX_BROADCAST_GROUPS:
        large = F.broadcast(large)
    is_large, head = _same(group, names), f"_head{depth}"
    few = runs.join(large, is_large, "left_anti").withColumn(name, _sum_before(copies, group, key))
    many = durable(runs.join(large, is_large, "left_semi").withColumn(head, F.substring(key, depth * DIGITS + 1, DIGITS)))
    # At most 4,096 rows for each crowded group.
    totals = many.groupBy(*group, head).agg(F.sum(copies).alias("_n")).withColumn("_parts_before", _sum_before("_n", group, head))
    marks = [*names, "_gh"]
    totals = totals.select(*[F.col(c).alias(a) for c, a in zip([*group, head], marks)], "_parts_before")
    inside = _cut(many, [*group, head], key, copies, name, crowded, length, depth + 1)
    whole = inside.join(totals, _same([*group, head], marks)).withColumn(name, F.col(name) + F.col("_parts_before"))
    return few.unionByName(whole.select(few.columns))
