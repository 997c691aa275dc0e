"""Column expressions: parsing, calendar labels, encodings.  No shuffles here."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourloom.schema import TIER_CODES

# --- Fixed values: accepted timestamp patterns, first match wins. ---
TIMESTAMP_PATTERNS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]",
    "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]",
    "yyyy-MM-dd",
]

EPS = 1e-6


def no_nan(c: Column) -> Column:
    """A double with NaN turned into NULL."""
    return F.when(~F.isnan(c), c)


def to_num(c: Column) -> Column:
    """Text to double; missing, blank, unparseable, NaN and infinite become 0."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.abs(n) < F.lit(float("inf")), n).otherwise(F.lit(0.0))


def to_count(c: Column) -> Column:
    """Text to whole number, cut toward zero; a number too large for BIGINT is NULL-safe 0."""
    return F.coalesce(to_num(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def repair_date(date_start: Column, hourly_window: Column) -> Column:
    """Well-formed dates stay, blanks stay blank, others fall back to the window's date part."""
    given = F.coalesce(date_start, F.lit(""))
    window = F.coalesce(hourly_window, F.lit(""))
    well_formed = given.startswith("202") & (F.length(given) == 10)
    return (
        F.when((given == "") | well_formed, given)
        .when(window.contains("T"), F.split(window, "T")[0])
        .otherwise(F.lit(""))
    )


def action_total(actions: Column, variants: list[str]) -> Column:
    """Sum of the values of those actions whose type is one of ``variants``."""
    hits = F.filter(
        F.coalesce(actions, F.array().cast("array<struct<action_type:string,value:string>>")),
        lambda a: a["action_type"].isin(variants),
    )
    total = F.aggregate(hits, F.lit(0.0), lambda acc, a: acc + to_num(a["value"]))
    return F.coalesce(total.try_cast("bigint"), F.lit(0).cast("bigint"))


def leading_hour(hourly_window: Column) -> Column:
    return F.trim(F.split(hourly_window, ":")[0]).try_cast("int")


def event_ts(date: Column, hour: Column) -> Column:
    """Date plus whole hours, without a time zone."""
    midnight = date.cast("date").cast("timestamp_ntz")
    return midnight + F.make_interval(hours=hour)


def fixed_time(moment: datetime) -> Column:
    """A literal wall-clock time, which no time zone moves."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds from 1970 to a wall-clock time, whatever the session's time zone."""
    return F.call_function("div", ts.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.expr("INTERVAL '0.000001' SECOND"))


def wall_clock(us: Column) -> Column:
    """The wall-clock time so many microseconds after 1970."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + us * F.expr("INTERVAL '0.000001' SECOND")


def half_even(c: Column, digits: int) -> Column:
    """Half-even rounding that ignores the noise of the order of summation."""
    return F.bround(F.round(c, 10), digits)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * c / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def parse_timestamp(c: Column, strict: bool = False) -> Column:
    """First pattern that fits, else NULL, or an error if ``strict``; the result has no time zone."""
    # Read as UTC and taken back to UTC, so that no hour is skipped or repeated.
    zoned = F.concat(c, F.lit(" +00:00"))
    parsed = F.coalesce(*[F.try_to_timestamp(zoned, F.lit(p + " XXX")) for p in TIMESTAMP_PATTERNS])
    out = wall_clock(F.unix_micros(parsed))
    if not strict:
        return out
    return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("no known timestamp pattern fits: "), c))).otherwise(out)


def local_time(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """Wall-clock time in ``zone`` for a UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "hh a")


def tier_code(c: Column) -> Column:
    """low/medium/high to 0/1/2; codes pass through unchanged, anything else is medium."""
    text = c.cast("string")
    code = F.lit(TIER_CODES["medium"])
    for name, value in TIER_CODES.items():
        hit = (text == name) | (text.try_cast("double") == float(value))
        code = F.when(hit, F.lit(value)).otherwise(code)
    return code.cast("int")


def hour_weight(hour: Column, night: float = 0.4) -> Column:
    """Relative spend by hour of day."""
    # --- Fixed values: working hours, shoulder hours, remaining day, night. ---
    return (
        F.when(hour.between(9, 18), F.lit(1.8))
        .when(hour.between(7, 8) | hour.between(19, 20), F.lit(1.2))
        .when(hour.between(6, 21), F.lit(1.0))
        .otherwise(F.lit(float(night)))
    )


def smape_term(actual: Column, predicted: Column) -> Column:
    half = (F.abs(actual) + F.abs(predicted)) / F.lit(2.0)
    return F.when(half == 0, F.lit(0.0)).otherwise(F.abs(predicted - actual) / half)
