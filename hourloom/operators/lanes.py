"""Ordered work on campaign series that stays parallel when one campaign is huge.

A window partitioned by campaign puts each campaign in one task.  That is the
cheapest plan (one exchange, one sort) as long as every campaign fits in a task,
and a failure when one campaign holds a third of the table.  So rows take one of
two lanes:

* cold lane: windows partitioned by campaign;
* hot lane: campaigns above ``hot_rows``.  Each row gets its position in the
  series, positions are cut into blocks of ``block_rows``, and each block also
  receives the neighbouring rows its frames reach into.  Windows are then
  partitioned by (campaign, block) and give the same values.

A count per campaign (one column read, pre-aggregated before its exchange) tells
whether the hot lane is needed at all.  The list of hot campaigns is broadcast
behind that count: it has at most rows / ``hot_rows`` names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.durable import durable
from hourloom.operators.ranks import CROWDED, copies_before, digits
from hourloom.schema import FACT_COLUMNS, KEY

HOT_ROWS = 2_000_000
BLOCK_ROWS = 65_536
MAX_BROADCAST_NAMES = 1_000_000
ORDER = ["date", "hour", "hourly_window"]


class Lane:
    """Rows plus how they are laid out: ``parts`` is what one task owns.

    Window columns added one after the other wait until one of them is needed and then
    enter one select, so that windows with the same layout share one pass over the rows.
    """

    def __init__(self, df: DataFrame, parts: tuple[str, ...], order: tuple[str, ...], hot: bool):
        self._df, self.parts, self.order, self.hot = df, parts, order, hot
        self._waiting: dict[str, str] = {}
        self._kind = ""

    @property
    def df(self) -> DataFrame:
        if self._waiting:
            waiting, self._waiting = self._waiting, {}
            self._df = _select(self._df, waiting)
        return self._df

    def _next(self, df: DataFrame) -> Lane:
        return Lane(df, self.parts, self.order, self.hot)

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Lane:
        return self._next(fn(self.df))

    def with_columns(self, columns: dict[str, Column]) -> Lane:
        return self._next(self.df.withColumns(columns)) if columns else self

    def with_sql(self, columns: dict[str, str], drop: list[str] | None = None) -> Lane:
        """Like ``with_columns`` for SQL text: one statement, however many columns."""
        return self._next(_select(self.df, columns, drop or []))

    def with_windows(self, columns: dict[str, str], kind: str = "series") -> Lane:
        """SQL text of window columns; the columns they read must be in ``df`` already."""
        out = self._next(self._df)
        if self._waiting and self._kind != kind:
            out = self._next(self.df)
        else:
            out._waiting = dict(self._waiting)
        out._waiting.update(columns)
        out._kind = kind
        return out

    def over(self, frame: str = "") -> str:
        """SQL text of the series window."""
        parts, order = ", ".join(self.parts), ", ".join(self.order)
        return f"OVER (PARTITION BY {parts} ORDER BY {order} {frame})"

    def per_campaign(self, aggregates: dict[str, str]) -> Lane:
        """Attach whole-series aggregates (SQL text) to each row."""
        if not self.hot:
            whole = f"OVER (PARTITION BY {KEY})"
            return self.with_windows({n: f"{a} {whole}" for n, a in aggregates.items()}, "whole")
        # One row per hot campaign: bounded like the list of hot campaigns.
        stats = (
            self.df.filter("_own")
            .groupBy(F.col(KEY).alias("_k"))
            .agg(*[F.expr(a).alias(n) for n, a in aggregates.items()])
        )
        joined = self.df.join(F.broadcast(stats), F.col(KEY).eqNullSafe(F.col("_k")), "left")
        return self._next(joined.drop("_k"))

    def distinct_per_day(self, columns: dict[str, str]) -> Lane:
        """Attach the number of distinct values of a column within each (campaign, date)."""
        if not self.hot:
            day = f"OVER (PARTITION BY {KEY}, date)"
            return self.with_windows({n: f"size(collect_set({c}) {day})" for n, c in columns.items()}, "day")
        days = (
            self.df.filter("_own")
            .groupBy(F.col(KEY).alias("_k"), F.col("date").alias("_d"))
            .agg(*[F.count_distinct(F.col(c)).cast("int").alias(n) for n, c in columns.items()])
        )
        same = F.col(KEY).eqNullSafe(F.col("_k")) & F.col("date").eqNullSafe(F.col("_d"))
        return self._next(self.df.join(days, same, "left").drop("_k", "_d"))

    def running_sum(self, columns: dict[str, str]) -> Lane:
        """Attach running totals (SQL text) from the start of the series to the current row."""
        upto = self.over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        if not self.hot:
            return self.with_windows({n: f"sum({c}) {upto}" for n, c in columns.items()})
        # Totals of the blocks before this one are added to the total inside the block.
        earlier = (
            Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = (
            self.df.filter("_own")
            .groupBy(F.col(KEY).alias("_k"), F.col("_block").alias("_b"))
            .agg(*[F.expr(f"sum({c})").alias(f"_carry_{n}") for n, c in columns.items()])
            .select(
                "_k", "_b", *[F.sum(f"_carry_{n}").over(earlier).alias(f"_carry_{n}") for n in columns]
            )
        )
        same = F.col(KEY).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))
        inside = self.with_sql({n: f"sum(IF(_own, {c}, NULL)) {upto}" for n, c in columns.items()})
        total = {
            n: f"coalesce(_carry_{n} + {n}, _carry_{n}, {n})" for n in columns
        }
        joined = self._next(inside.df.join(carry, same, "left"))
        return joined.with_sql(total, drop=["_k", "_b", *[f"_carry_{n}" for n in columns]])


def _select(df: DataFrame, columns: dict[str, str], drop: list[str] | tuple = ()) -> DataFrame:
    replaced = [c for c in df.columns if c in columns or c in drop]
    kept = f"* EXCEPT ({', '.join(f'`{c}`' for c in replaced)})" if replaced else "*"
    new = "".join(f", {text} AS `{name}`" for name, text in columns.items())
    return df.sparkSession.sql(f"SELECT {kept}{new} FROM {{rows}}", rows=df)


Step = Callable[[Lane], Lane]


def _row_hash(columns: list[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def series_tie(columns: list[str]) -> Column:
    """Order of rows that share campaign, date, hour and window: by the hash of their facts, which
    later steps leave alone, then by the hash of all columns."""
    facts = [c for c in FACT_COLUMNS if c in columns]
    return F.struct(_row_hash(facts or columns).alias("facts"), _row_hash(columns).alias("all"))


def hot_names(df: DataFrame, hot_rows: int) -> DataFrame:
    """The campaigns of more than ``hot_rows`` rows, as ``_hot_key``."""
    return (
        df.groupBy(F.col(KEY).alias("_hot_key"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select("_hot_key")
    )


def _cold_lane(df: DataFrame) -> Lane:
    rows = df.withColumn("_tie", series_tie(df.columns))
    return Lane(rows, (KEY,), (*ORDER, "_tie"), False)


def series_positions(df: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Distinct rows with ``_copies`` and ``_first``, the 0-based position of the first copy.

    Identical rows collapse to one row with a count before any exchange by campaign.
    Counts per cell (campaign, hour, hourly window) are summed over the cells of a day and
    over the days of a campaign, so these windows are bounded by the calendar and not by
    the number of rows.  Inside a cell no task orders more than ``crowded`` rows.
    """
    cell = [KEY, *ORDER]
    tie = series_tie(df.columns)
    runs = durable(
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_tie", F.concat(digits(tie["facts"]), digits(tie["all"])))
    )
    cells = runs.groupBy(*cell).agg(F.sum("_copies").alias("_n"))
    prior = Window.unboundedPreceding, -1
    days = (
        cells.groupBy(F.col(KEY).alias("_dk"), F.col("date").alias("_dd"))
        .agg(F.sum("_n").alias("_dn"))
        .withColumn(
            "_day_first",
            F.coalesce(
                F.sum("_dn").over(Window.partitionBy("_dk").orderBy("_dd").rowsBetween(*prior)),
                F.lit(0),
            ),
        )
        .drop("_dn")
    )
    in_day = Window.partitionBy(KEY, "date").orderBy("hour", "hourly_window")
    cells = cells.withColumn(
        "_in_day", F.coalesce(F.sum("_n").over(in_day.rowsBetween(*prior)), F.lit(0))
    )
    cells = cells.join(
        days, F.col(KEY).eqNullSafe(F.col("_dk")) & F.col("date").eqNullSafe(F.col("_dd"))
    ).select(
        *[F.col(c).alias(f"_c_{c}") for c in cell],
        (F.col("_day_first") + F.col("_in_day")).alias("_cell_first"),
    )
    same_cell = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in cell]
    )
    ranked = copies_before(runs, cell, "_tie", "_copies", "_in_cell", crowded, length=32)
    return (
        ranked.join(cells, same_cell)
        .withColumn("_first", F.col("_cell_first") + F.col("_in_cell"))
        .drop(*[f"_c_{c}" for c in cell], "_cell_first", "_in_cell", "_tie")
    )


def _hot_lane(df: DataFrame, back: int, ahead: int, block_rows: int) -> Lane:
    size, first, last = (
        F.lit(block_rows),
        F.col("_first"),
        F.col("_first") + F.col("_copies") - 1,
    )
    block_start = F.col("_block") * size
    rows = (
        series_positions(df)
        .withColumn(
            "_block",
            F.explode(
                F.sequence(
                    F.floor(F.greatest(first - ahead, F.lit(0)) / size),
                    F.floor((last + back) / size),
                )
            ),
        )
        .repartition(F.col(KEY), F.col("_block"))
        # Copies are written out only now, inside their block.
        .withColumn(
            "_pos",
            F.explode(
                F.sequence(
                    F.greatest(first, block_start - back),
                    F.least(last, block_start + size - 1 + ahead),
                )
            ),
        )
        .withColumn("_own", F.floor(F.col("_pos") / size) == F.col("_block"))
        .drop("_first", "_copies")
    )
    # Laid out once: the steps and each of their aggregates read this table.
    return Lane(durable(rows), (KEY, "_block"), ("_pos",), True)


def over_series(
    df: DataFrame,
    *steps: Step,
    back: int = 0,
    ahead: int = 0,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``steps`` on every campaign series of ``df``.

    ``back`` and ``ahead`` are the numbers of rows before and after the current row
    that the steps' frames reach (running totals and whole-series aggregates excluded).
    """
    names = hot_names(df, hot_rows)
    n_hot = names.count()
    if n_hot == 0:
        cold = reduce(lambda lane, step: step(lane), steps, _cold_lane(df))
        return cold.df.drop("_tie")
    if n_hot <= MAX_BROADCAST_NAMES:
        names = F.broadcast(names)
    is_hot = F.col(KEY).eqNullSafe(F.col("_hot_key"))
    cold = _cold_lane(df.join(names, is_hot, "left_anti"))
    hot = _hot_lane(df.join(names, is_hot, "left_semi"), back, ahead, block_rows)
    for step in steps:
        cold, hot = step(cold), step(hot)
    out = cold.df.drop("_tie")
    return out.unionByName(hot.df.filter("_own").select(*out.columns))
