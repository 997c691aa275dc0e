"""Entry points: the flagship query, every operator as a query, and the SQL it must match.

Fractional results are compared after rounding to four digits (``_stable`` and ``_round``
do the same on both sides; the tiny shift moves values off exact ties).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import scalars as S
from hourloom.operators import campaign as C
from hourloom.operators import horizon as H
from hourloom.operators import metrics as M
from hourloom.operators import projections as P
from hourloom.operators import quality as Q
from hourloom.operators import series as R
from hourloom.operators import split as X
from hourloom.operators import timeseries as T
from hourloom.plans import jobs, model, prepare
from hourloom.durable import durable, scratch_path
from hourloom.schema import ACTION_VARIANTS, COUNTERS, FACT_COLUMNS, METRICS, NOT_FEATURES, PAGE, TARGET
from hourloom.sources import files, insights
from hourloom.sources.testviews import campaign_events, campaign_hourly
from hourloom.streaming.ingest import ingest_new_pages

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

AS_OF = datetime(2024, 1, 31, 20, 0)
FORECAST_START = datetime(2024, 1, 31, 2, 0)
# The model queries search this whole grid on 5 folds over all features; the trees are few (the library's own
# search is 100 settings of 100 to 1,000 trees).
SMALL = {
    "maxDepth": [3, 4],
    "stepSize": [0.1, 0.2],
    "maxIter": [5],
    "subsamplingRate": [1.0],
    "featureSubsetStrategy": ["all"],
    "minInstancesPerNode": [10],
}
# Every campaign of the test data takes the block lane with these.
HOT = {"hot_rows": 10, "block_rows": 100}


def _stable(df: DataFrame) -> DataFrame:
    def fixed(c: str):
        r = F.round(F.col(f"`{c}`") + 1e-7, 4)
        return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(c)

    return df.select(*[fixed(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _round(sql: str, doubles: str) -> str:
    if not doubles:
        return sql
    r = lambda c: f"round({c} + 1e-7, 4)"
    parts = [f"case when {r(c)} = 0 then cast(0 as double) else {r(c)} end as {c}" for c in doubles.split()]
    return f"select * replace ({', '.join(parts)}) from ({sql}) final"


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: _stable(fn(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = _round(sql, doubles)
        return fn

    return register


# ---------------------------------------------------------------- shared SQL

_RAW = """
select campaign_name, date, hourly_window,
  cast(sum(cast(value as decimal(18,2))) filter (where event_type <> 'error') as double) as spend,
  count(*) as impressions,
  count(*) filter (where event_type = 'click') as clicks,
  count(*) filter (where event_type = 'signup') as add_to_cart,
  count(*) filter (where event_type = 'view') as view_content,
  count(*) filter (where event_type = 'purchase') as web_in_store_purchase
from (select concat('C', lpad(cast(user_id % 20 as varchar), 2, '0')) as campaign_name,
        cast(ts as date) as date,
        concat(lpad(cast(hour(ts) as varchar), 2, '0'), ':00:00 - ',
               lpad(cast(hour(ts) as varchar), 2, '0'), ':59:59') as hourly_window,
        value, event_type from events) q
group by 1, 2, 3
"""
_ZERO_COUNTERS = [c for c in COUNTERS if c not in ("web_in_store_purchase", "add_to_cart", "view_content")]
_FACTS = f"""
select campaign_name, date, hourly_window, spend, impressions, clicks,
  cast(100 as double) * clicks / impressions as ctr,
  case when clicks > 0 then spend / clicks end as cpc,
  cast(1000 as double) * spend / impressions as cpm, cast(0 as double) as cpp,
  web_in_store_purchase, add_to_cart, view_content,
  {', '.join(f'cast(0 as bigint) as {c}' for c in _ZERO_COUNTERS)}
from ({_RAW}) raw
"""
_EVENT_FACTS = f"""
select concat('C', lpad(cast(user_id % 20 as varchar), 2, '0')) as campaign_name,
  cast(ts as date) as date,
  concat(strftime(ts, '%H:%M:%S.%f'), ' - ', lpad(cast(event_id as varchar), 12, '0')) as hourly_window,
  case when event_type <> 'error' then value end as spend, cast(1 as bigint) as impressions,
  cast(event_type = 'click' as bigint) as clicks,
  cast(100 as double) * cast(event_type = 'click' as bigint) as ctr,
  hour(ts) as hour
from events
"""
_NUMERIC = ["spend", "impressions", "clicks", "ctr", "cpc", "cpm", "cpp", *COUNTERS]
_VALID = f"""
select campaign_name, date, hourly_window, {', '.join(f'coalesce({c}, 0) as {c}' for c in _NUMERIC)}
from ({_FACTS}) facts where coalesce(spend, 0) >= 0
"""
_CLEAN = f"""
select *, cast(hour between 9 and 17 as int) as is_business_hours from (
  select *, cast(split_part(hourly_window, ':', 1) as int) as hour,
    cast(isodow(date) - 1 as int) as day_of_week, cast(month(date) as int) as month, cast(day(date) as int) as day_of_month,
    cast(isodow(date) >= 6 as int) as is_weekend
  from ({_VALID}) valid) t
"""
_TS = f"select *, cast(date as timestamp) + to_hours(hour) as event_ts from ({_CLEAN}) clean"
_W = "over (partition by campaign_name order by date, hour, hourly_window)"
_WR = "over (partition by campaign_name order by date, hour, hourly_window rows between {} preceding and current row)"
_K = "campaign_name, date, hourly_window"
_KEYS = ["campaign_name", "date", "hourly_window"]
_TARGETED = f"select * from (select *, lead(spend, 12) {_W} as target_spend_12h from ({_CLEAN}) c) t where target_spend_12h is not null"
_PAIRS = f"select campaign_name, date, hour, hourly_window, spend as actual, coalesce(lag(spend, 24) {_W}, 0) as predicted from ({_CLEAN}) c"
_D = "cast({} as double)"


def _even(expression: str, digits: int) -> str:
    """Half-even rounding of the decimal value, ten digits being kept before."""
    v = f"(cast({expression} as decimal(28,10)) * {10**digits})"
    return f"(case when {v} - floor({v}) = 0.5 then 2 * round({v} / 2) else round({v}) end / {10**digits})"


def _stats_sql(spec: dict[str, list[str]], source: str, digits: int = 4) -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "sum": "sum", "count": "count", "max": "max", "min": "min"}
    ints = ("impressions", "clicks")
    cols = []
    for c, fs in spec.items():
        for f in fs:
            e = f"{fn[f]}({c})"
            if f == "sum" and c in ints:
                e = f"cast({e} as bigint)"
            elif f != "count":
                e = _even(e, digits)
            cols.append(f"{e} as {c}_{f}")
    return f"select campaign_name, {', '.join(cols)} from ({source}) s group by campaign_name"


def _spec_doubles(spec: dict[str, list[str]]) -> str:
    return " ".join(
        f"{c}_{f}"
        for c, fs in spec.items()
        for f in fs
        if f != "count" and not (f == "sum" and c in ("impressions", "clicks"))
    )


_PROFILE = _stats_sql(C.PROFILE, _CLEAN, 6)
_THRESHOLDS = """
select quantile_cont(spend_mean, 1.0/3) as s1, quantile_cont(spend_mean, 2.0/3) as s2,
  quantile_cont(ctr_mean, 0.33) as c1, quantile_cont(ctr_mean, 0.67) as c2,
  quantile_cont(cpc_mean, 0.33) as p1, quantile_cont(cpc_mean, 0.67) as p2
"""


def _tiers_sql(source: str) -> str:
    return f"""
    with profile as (select campaign_name, {_even('avg(spend)', 6)} as spend_mean,
        {_even('avg(ctr)', 6)} as ctr_mean, {_even('avg(cpc)', 6)} as cpc_mean
      from ({source}) s group by campaign_name),
    th as ({_THRESHOLDS} from profile)
    select campaign_name,
      case when spend_mean <= s1 then 'low' when spend_mean <= s2 then 'medium' else 'high' end as spend_level,
      case when ctr_mean < c1 or cpc_mean > p2 then 'low'
           when ctr_mean > c2 and cpc_mean < p1 then 'high' else 'medium' end as performance_tier
    from profile, th"""


# ---------------------------------------------------------------- inputs


def _facts(spark, d):
    return campaign_hourly(spark, d)


def _clean(spark, d):
    return _facts(spark, d).transform(Q.validate).transform(P.add_temporal_features)


def _clean_events(spark, d):
    return campaign_events(spark, d).transform(Q.validate).transform(P.add_temporal_features)


def _ts(spark, d):
    return T.with_event_ts(_clean(spark, d))


def _pairs(spark, d):
    rows = R.add_lag_features(_clean(spark, d), (24,), ("spend",))
    return rows.select(*_KEYS, "hour", F.col("spend").alias("actual"), F.col("spend_lag_24h").alias("predicted"))


def _raw_rows(spark, d):
    """Insight rows with text numbers and actions, including blanks and two variants of a bucket."""
    action = lambda kind, value: F.struct(F.lit(kind).alias("action_type"), value.cast("string").alias("value"))
    f = _facts(spark, d)
    return f.select(
        "campaign_name",
        F.col("date").cast("string").alias("date_start"),
        F.col("hourly_window").alias(insights.WINDOW_FIELD),
        *[F.col(m).cast("string").alias(m) for m in METRICS],
        F.array(
            action("add_to_cart", F.col("add_to_cart")),
            action("omni_add_to_cart", F.lit("x")),
            action("view_content", F.col("view_content")),
            action("onsite_web_view_content", F.lit("1")),
            action("", F.lit("5")),
            action("web_app_in_store_purchase", F.col("web_in_store_purchase")),
        ).alias("actions"),
    )


def _pages(spark, d):
    """One page per campaign and day (at most 24 rows)."""
    rows = _raw_rows(spark, d)
    data = F.collect_list(F.struct(*rows.columns)).alias("data")
    return rows.groupBy("campaign_name", "date_start").agg(data).select(
        "data",
        F.struct(
            F.struct(F.lit("a").alias("before"), F.lit("b").alias("after")).alias("cursors"),
            F.lit(None).cast("string").alias("next"),
        ).alias("paging"),
    )


def _landed_pages(spark, d):
    path = scratch_path(spark, "pages")
    _pages(spark, d).write.json(path)
    return path


_FLAT = f"""
select campaign_name, cast(date as varchar) as date, hourly_window, {', '.join(f'coalesce({c}, 0) as {c}' for c in METRICS)},
  web_in_store_purchase, add_to_cart, view_content + 1 as view_content, {', '.join(_ZERO_COUNTERS)}
from ({_FACTS}) f
"""
_FLAT_D = "spend ctr cpc cpm cpp"


# ---------------------------------------------------------------- 2.1 scans and sinks


@query("scan_insight_pages", f"select campaign_name, cast(date as varchar) as date_start, hourly_window, cast(impressions as varchar) as impressions, 6 as n_actions from ({_FACTS}) f where date between date '2024-01-05' and date '2024-01-20'")
def _(spark, d):
    rows = insights.scan_insight_pages(spark, _landed_pages(spark, d), "2024-01-05", "2024-01-20")
    return rows.select("campaign_name", "date_start", F.col(insights.WINDOW_FIELD).alias("hourly_window"), "impressions", F.size("actions").alias("n_actions"))


@query("scan_csv", f"select * from ({_FACTS}) f", _FLAT_D)
def _(spark, d):
    return files.scan_csv(spark, files.sink_any(_facts(spark, d), scratch_path(spark, "facts.csv"), "csv"))


@query("scan_any", f"select * from ({_FACTS}) f", _FLAT_D)
def _(spark, d):
    facts = _facts(spark, d)
    path = files.sink_any(facts, scratch_path(spark, "facts.json"), "json")
    return files.scan_any(spark, path, schema=facts.schema)


@query("sink_any", f"select * from ({_FACTS}) f", _FLAT_D)
def _(spark, d):
    return files.scan_any(spark, files.sink_any(_facts(spark, d), scratch_path(spark, "facts.parquet"), "parquet"))


@query("sink_processed", f"select * from ({_CLEAN}) f", _FLAT_D)
def _(spark, d):
    return files.scan_any(spark, files.sink_processed(_clean(spark, d), scratch_path(spark, "processed.parquet")))


@query("ingest_and_save", _FLAT, _FLAT_D)
def _(spark, d):
    return insights.ingest_and_save(spark, _landed_pages(spark, d), scratch_path(spark, "raw.csv"))


@query("ingest_stream", _FLAT, _FLAT_D)
def _(spark, d):
    out = scratch_path(spark, "facts.parquet")
    ingest_new_pages(spark, _landed_pages(spark, d), out, scratch_path(spark, "offsets"))
    return spark.read.parquet(out)


_TOTALS = f"select campaign_name, sum(spend) as predicted_spend_12h from ({_CLEAN}) c group by 1"


def _totals(spark, d):
    return _clean(spark, d).groupBy("campaign_name").agg(F.sum("spend").alias("predicted_spend_12h"))


def _weights_sql(night: float = 0.4, start: int = 20) -> str:
    return f"""
    select campaign_name, horizon, hour_of_day, predicted_spend_12h * w / sum(w) over (partition by campaign_name) as predicted_spend
    from (select *, case when hour_of_day between 9 and 18 then 1.8e0
        when hour_of_day between 7 and 8 or hour_of_day between 19 and 20 then 1.2e0
        when hour_of_day between 6 and 21 then 1.0e0 else {night}e0 end as w
      from (select t.*, cast(h.h as int) as horizon, cast(({start} + h.h - 1) % 24 as int) as hour_of_day
        from ({_TOTALS}) t, range(1, 13) h(h)) a) b"""


@query("sink_forecast_long", f"select campaign_name, predicted_spend_12h, timestamp '2024-01-31 20:00:00' as timestamp from ({_TOTALS}) t", "predicted_spend_12h")
def _(spark, d):
    path = scratch_path(spark, "long.parquet")
    files.sink_forecast_long(_totals(spark, d), path, AS_OF, "parquet")
    return spark.read.parquet(path)


_LABELS = H.hour_labels(AS_OF)


@query(
    "sink_forecast_wide",
    "select campaign_name as \"Campaign\", "
    + ", ".join(f'max(case when horizon = {i} then v end) as "{label}"' for i, label in enumerate(_LABELS, 1))
    + f" from (select *, {_even('predicted_spend', 2)} as v from ({_weights_sql()}) w) x group by 1",
)
def _(spark, d):
    path = scratch_path(spark, "wide.csv")
    files.sink_forecast_wide(H.weight_distribution(_totals(spark, d), AS_OF.hour), path, AS_OF)
    return files.scan_any(spark, path)


# ---------------------------------------------------------------- 2.2 semi-structured


@query("flatten_insights", _FLAT, _FLAT_D)
def _(spark, d):
    return insights.flatten_insights(_raw_rows(spark, d))


@query("union_pages", _FLAT, _FLAT_D)
def _(spark, d):
    return insights.flatten_insights(insights.explode_pages(_pages(spark, d)))


_TEXT = "case event_id % 7 when 0 then '' when 1 then 'x' when 2 then null when 3 then concat(' ', cast(value as varchar), ' ') when 4 then 'nan' when 5 then '-3.9' else cast(value as varchar) end"


def _texts(spark, d):
    v = F.col("value").cast("string")
    m = F.col("event_id") % 7
    text = F.when(m == 0, "").when(m == 1, "x").when(m == 3, F.concat(F.lit(" "), v, F.lit(" "))).when(m == 4, "nan").when(m == 5, "-3.9").when(m == 6, v)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.alias("text"))


_NUM = "case when isfinite(try_cast(trim(t) as double)) then try_cast(trim(t) as double) else 0 end"


@query("to_num", f"select event_id, coalesce({_NUM}, 0) as num, cast(trunc(coalesce({_NUM}, 0)) as bigint) as whole from (select event_id, {_TEXT} as t from events) e", "num")
def _(spark, d):
    return _texts(spark, d).select("event_id", S.to_num(F.col("text")).alias("num"), S.to_count(F.col("text")).alias("whole"))


@query("coerce_numeric", f"select event_id, coalesce({_NUM}, 0) as spend, cast(trunc(coalesce({_NUM}, 0)) as bigint) as clicks from (select event_id, {_TEXT} as t from events) e", "spend")
def _(spark, d):
    return insights.coerce_numeric(_texts(spark, d).select("event_id", F.col("text").alias("spend"), F.col("text").alias("clicks")))


_DATE_TEXT = "case event_id % 5 when 0 then '' when 1 then 'bad' when 2 then '1999-01-01' when 3 then '2024-1-1' else cast(cast(ts as date) as varchar) end"
_WINDOW_TEXT = "case when event_id % 2 = 0 then concat(cast(cast(ts as date) as varchar), 'T01:00') else '01:00:00 - 01:59:59' end"


@query("date_repair", f"select event_id, case when ds = '' or (ds like '202%' and length(ds) = 10) then ds when contains(w, 'T') then split_part(w, 'T', 1) else '' end as date from (select event_id, {_DATE_TEXT} as ds, {_WINDOW_TEXT} as w from events) e")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    day, m = F.col("ts").cast("date").cast("string"), F.col("event_id") % 5
    ds = F.when(m == 0, "").when(m == 1, "bad").when(m == 2, "1999-01-01").when(m == 3, "2024-1-1").otherwise(day)
    w = F.when(F.col("event_id") % 2 == 0, F.concat(day, F.lit("T01:00"))).otherwise("01:00:00 - 01:59:59")
    return e.select("event_id", S.repair_date(ds, w).alias("date"))


@query("action_buckets", f"select campaign_name, date, hourly_window, web_in_store_purchase, add_to_cart, view_content + 1 as view_content, {', '.join(_ZERO_COUNTERS)} from ({_FACTS}) f")
def _(spark, d):
    r = _raw_rows(spark, d)
    return r.select(
        "campaign_name",
        F.col("date_start").cast("date").alias("date"),
        F.col(insights.WINDOW_FIELD).alias("hourly_window"),
        *[S.action_total(F.col("actions"), v).alias(c) for c, v in ACTION_VARIANTS.items()],
    )


# ---------------------------------------------------------------- 2.3 filters and validation


def _dirty(spark, d):
    """Facts with some unparseable dates and negative or missing spends."""
    h = F.substring("hourly_window", 1, 2)
    return _facts(spark, d).withColumns(
        {
            "date": F.when(h == "03", "not a date").otherwise(F.col("date").cast("string")),
            "spend": F.when(h == "05", -F.col("spend")).otherwise(F.col("spend")),
        }
    )


_DIRTY = f"select * replace (case when substr(hourly_window, 1, 2) = '03' then 'not a date' else cast(date as varchar) end as date, case when substr(hourly_window, 1, 2) = '05' then -spend else spend end as spend) from ({_FACTS}) f"


@query("drop_bad_dates", f"select * replace (try_cast(date as date) as date) from ({_DIRTY}) x where try_cast(date as date) is not null", _FLAT_D)
def _(spark, d):
    return Q.drop_bad_dates(_dirty(spark, d))


@query("drop_negative_spend", f"select * from ({_DIRTY}) x where coalesce(spend, 0) >= 0", _FLAT_D)
def _(spark, d):
    return Q.drop_negative_spend(_dirty(spark, d))


_FILLED = ", ".join(f"coalesce({c}, 0) as {c}" for c in _NUMERIC)


@query("fill_numeric_null", f"select * replace ({_FILLED}) from ({_FACTS}) x", _FLAT_D)
def _(spark, d):
    return Q.fill_numeric_null(_facts(spark, d))


@query("quality_counts", f"select count(*) filter (where try_cast(date as date) is null) as bad_dates, count(*) filter (where spend < 0) as negative_spend, {', '.join(f'count(*) - count({c}) as null_{c}' for c in _NUMERIC)} from ({_DIRTY}) x")
def _(spark, d):
    return Q.quality_counts(_dirty(spark, d))


@query("validate", f"select * replace (try_cast(date as date) as date, {_FILLED}) from ({_DIRTY}) x where try_cast(date as date) is not null and coalesce(spend, 0) >= 0", _FLAT_D)
def _(spark, d):
    return Q.validate(_dirty(spark, d))


@query("latest_day_filter", f"select {_K}, spend from ({_CLEAN}) c where date = (select max(date) from ({_CLEAN}) m)", "spend")
def _(spark, d):
    return R.latest_day_filter(_clean(spark, d)).select(*_KEYS, "spend")


_NEWEST = "row_number() over (partition by campaign_name order by date desc, hour desc, hourly_window desc)"


@query("recent_fallback", f"select {_K}, spend from (select *, {_NEWEST} as rn from ({_CLEAN}) c where date >= date '2024-01-28' - 7) x where rn <= 24", "spend")
def _(spark, d):
    return R.recent_fallback(_clean(spark, d), "2024-01-28").select(*_KEYS, "spend")


_GAPS = f"select campaign_name, count(*) filter (where step > interval 2 hour) as n_gaps from (select campaign_name, event_ts - lag(event_ts) over (partition by campaign_name order by event_ts) as step from (select distinct campaign_name, event_ts from ({_TS}) t) u) s group by 1"


@query("gap_detect", _GAPS)
def _(spark, d):
    return T.gap_detect(_ts(spark, d))


@query("duplicate_detect", "select campaign_name, event_ts, count(*) as n_rows from (select concat('C', lpad(cast(user_id % 20 as varchar), 2, '0')) as campaign_name, date_trunc('hour', ts) as event_ts from events) e group by 1, 2 having count(*) > 1")
def _(spark, d):
    return Q.duplicate_detect(T.with_event_ts(_clean_events(spark, d)))


@query("series_validate", f"select (select count(*) = 0 from ({_TS}) t where event_ts is null) as missing_dates, (select count(*) = 0 from (select 1 from ({_TS}) t group by campaign_name, event_ts having count(*) > 1) x) as duplicate_timestamps, (select coalesce(sum(n_gaps), 0) = 0 from ({_GAPS}) g) as time_gaps")
def _(spark, d):
    return T.series_validate(_ts(spark, d))


# ---------------------------------------------------------------- 2.4 date and time


@query("temporal_features", f"select * from ({_CLEAN}) c", _FLAT_D)
def _(spark, d):
    return _clean(spark, d)


_CYC = "{p}_sin {p}_cos"
_CYC_D = "hour_sin hour_cos dayofweek_sin dayofweek_cos month_sin month_cos"
_CYC_SQL = ", ".join(
    f"{f}(2 * pi() * {c} / {n}) as {p}_{f}" for p, c, n in [("hour", "hour", 24), ("dayofweek", "day_of_week", 7), ("month", "month", 12)] for f in ("sin", "cos")
)


@query(
    "calendar_features",
    f"select *, {_CYC_SQL}, cast(day_of_week >= 5 as int) as is_weekend, cast(hour between 9 and 17 as int) as is_business_hours, cast(hour between 11 and 14 as int) as is_lunch_hour, cast(hour between 18 and 22 as int) as is_prime_time, cast(month in (11, 12) as int) as is_holiday_season from (select event_id, ts as date, cast(year(ts) as int) as year, cast(month(ts) as int) as month, cast(day(ts) as int) as day, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as day_of_week, cast(dayofyear(ts) as int) as day_of_year, cast(weekofyear(ts) as int) as week_of_year, cast(quarter(ts) as int) as quarter from events) e",
    _CYC_D,
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return P.add_time_features(e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("date")))


@query("cyclical_encode", f"select {_K}, {_CYC_SQL} from ({_CLEAN}) c", _CYC_D)
def _(spark, d):
    return P.add_cyclical(_clean(spark, d)).select(*_KEYS, *_CYC_D.split())


@query("constant_features", f"select {_K}, 12 as forecast_horizon, 0 as is_missing_hour from ({_CLEAN}) c")
def _(spark, d):
    return P.add_constant_features(_clean(spark, d)).select(*_KEYS, "forecast_horizon", "is_missing_hour")


_TS_TEXT = "case event_id % 6 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S.%f') when 3 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') when 4 then strftime(ts, '%Y-%m-%d') else 'unknown' end"


@query("parse_timestamp", f"select event_id, try_strptime(t, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%d']) as parsed from (select event_id, {_TS_TEXT} as t from events) e")
def _(spark, d):
    ts, m = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 6
    patterns = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd"]
    text = F.when(m == 5, "unknown")
    for i, p in enumerate(patterns):
        text = text.when(m == i, F.date_format(ts, p))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", S.parse_timestamp(text).alias("parsed"))


@query("time_windows", f"select campaign_name, w as window_start, least(w + interval 5 hour, b) as window_end from (select campaign_name, b, unnest(generate_series(a, b, interval 5 hour)) as w from (select campaign_name, min(event_ts) as a, max(event_ts) as b from ({_TS}) t group by 1) s where a < b) x where w < b")
def _(spark, d):
    spans = _ts(spark, d).groupBy("campaign_name").agg(F.min("event_ts").alias("a"), F.max("event_ts").alias("b"))
    return T.time_windows(spans, "a", "b", 5).select("campaign_name", "window_start", "window_end")


@query("local_time_shift", "select event_id, ts + interval 5 hour + interval 30 minute as local_ts from events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", S.local_time(F.col("ts")).alias("local_ts"))


@query("hour_labels", "select event_id, h as horizon, strftime(ts + to_hours(h - 1), '%I %p') as label from events, range(1, 13) r(h)")
def _(spark, d):
    e = H.cross_join_horizons(spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")))
    later = F.col("ts") + F.make_interval(hours=F.col("horizon") - 1)
    return e.select("event_id", F.col("horizon").cast("bigint").alias("horizon"), S.hour_label(later).alias("label"))


# ---------------------------------------------------------------- 2.5 projections

_RATIO_SQL = "ctr / (cpm + 1e-6) as ctr_cpm_ratio, cpc / (ctr + 1e-6) as cpc_ctr_ratio, clicks / (impressions + 1e-6) as clicks_to_impressions, (add_to_cart + landing_page_view + view_content) / (clicks + 1e-6) as actions_to_clicks, impressions / (spend + 1e-6) as spend_efficiency"
_RATIO_D = "ctr_cpm_ratio cpc_ctr_ratio clicks_to_impressions actions_to_clicks spend_efficiency"
_INTER_SQL = "hour * spend as hour_spend, day_of_week * spend as dayofweek_spend, ctr * cpc as ctr_cpc_interaction, cast(impressions * clicks as double) as impressions_clicks_interaction, is_business_hours * spend as business_hours_spend, is_weekend * spend as weekend_spend"
_INTER_D = "hour_spend dayofweek_spend ctr_cpc_interaction impressions_clicks_interaction business_hours_spend weekend_spend"
_POLY = ["spend", "impressions", "clicks", "ctr", "cpc"]


@query("ratio_features", f"select {_K}, {_RATIO_SQL} from ({_CLEAN}) c", _RATIO_D)
def _(spark, d):
    return P.add_ratio_features(_clean(spark, d)).select(*_KEYS, *_RATIO_D.split())


@query("interaction_features", f"select {_K}, {_INTER_SQL} from ({_CLEAN}) c", _INTER_D)
def _(spark, d):
    return P.add_interaction_features(_clean(spark, d)).select(*_KEYS, *_INTER_D.split())


@query("polynomial_features", f"select {_K}, {', '.join(f'pow(cast({c} as double), {k}) as {c}_pow_{k}' for c in _POLY for k in (2, 3))} from ({_CLEAN}) c", " ".join(f"{c}_pow_{k}" for c in _POLY for k in (2, 3)))
def _(spark, d):
    return P.add_polynomial_features(_clean(spark, d), 3).select(*_KEYS, *[f"{c}_pow_{k}" for c in _POLY for k in (2, 3)])


_CODE = "case {0} when 'low' then 0 when 'high' then 2 else 1 end as {0}"


@query("ordinal_encode", f"select campaign_name, {_CODE.format('spend_level')}, {_CODE.format('performance_tier')} from ({_tiers_sql(_CLEAN)}) t")
def _(spark, d):
    t = C.campaign_tiers(_clean(spark, d)).select("campaign_name", "spend_level", "performance_tier")
    return C.encode_tiers(C.encode_tiers(t))


@query("select_features", f"select campaign_name, date, hour, impressions, clicks, ctr, target_spend_12h from ({_TARGETED}) t", "ctr target_spend_12h")
def _(spark, d):
    rows, names = model.select_features(R.add_target(_clean(spark, d)))
    kept = [c for c in ("hour", "impressions", "clicks", "ctr") if c in names]
    out = rows.select("campaign_name", "date", *kept, TARGET)
    types = {"hour": "int", "impressions": "bigint", "clicks": "bigint"}
    return out.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


_ERR = "select *, actual - predicted as error, abs(actual - predicted) as abs_error, (actual - predicted) / (actual + 1e-6) * 100 as pct_error from ({}) p"


@query("error_columns", _ERR.format(_PAIRS), "actual predicted error abs_error pct_error")
def _(spark, d):
    return P.add_error_columns(_pairs(spark, d))


@query("clamp_nonnegative", f"select {_K}, greatest(0, actual - predicted) as v from ({_PAIRS}) p", "v")
def _(spark, d):
    return _pairs(spark, d).select(*_KEYS, P.clamp_nonnegative(F.col("actual") - F.col("predicted")).alias("v"))


@query("weight_distribution", _weights_sql(), "predicted_spend")
def _(spark, d):
    return H.weight_distribution(_totals(spark, d), AS_OF.hour)


# ---------------------------------------------------------------- 2.6 aggregations


@query("campaign_stats", _stats_sql(C.STATS, _CLEAN), _spec_doubles(C.STATS))
def _(spark, d):
    return C.campaign_stats(_clean(spark, d))


@query("campaign_profile", _PROFILE, _spec_doubles(C.PROFILE))
def _(spark, d):
    return C.campaign_profile(_clean(spark, d))


@query("spend_volatility", f"select {_K}, stddev_samp(spend) over (partition by campaign_name) as campaign_spend_volatility from ({_CLEAN}) c", "campaign_spend_volatility")
def _(spark, d):
    return C.add_spend_volatility(_clean(spark, d)).select(*_KEYS, "campaign_spend_volatility")


_FREQ = f"select {_K}, cast(count(distinct hour) over (partition by campaign_name, date) as int) as campaign_hourly_frequency from ({_CLEAN}) c"


@query("hourly_frequency", _FREQ)
def _(spark, d):
    return C.add_hourly_frequency(_clean(spark, d)).select(*_KEYS, "campaign_hourly_frequency")


@query("spend_level", f"select campaign_name, spend_level from ({_tiers_sql(_CLEAN)}) t")
def _(spark, d):
    return C.campaign_tiers(_clean(spark, d)).select("campaign_name", "spend_level")


@query("performance_tier", f"select campaign_name, performance_tier from ({_tiers_sql(_CLEAN)}) t")
def _(spark, d):
    return C.campaign_tiers(_clean(spark, d)).select("campaign_name", "performance_tier")


_SPINE = f"select campaign_name, unnest(generate_series(min(event_ts), max(event_ts), interval 1 hour)) as bucket_ts from ({_TS}) t group by 1"


@query("resample_series", f"select s.campaign_name, s.bucket_ts, coalesce(spend, 0) as spend, coalesce(impressions, 0) as impressions, coalesce(clicks, 0) as clicks, ctr, cpc, case when t.campaign_name is null then 1 else 0 end as is_missing_hour from ({_SPINE}) s left join ({_TS}) t on s.campaign_name = t.campaign_name and s.bucket_ts = t.event_ts", "spend ctr cpc")
def _(spark, d):
    return T.resample_series(_ts(spark, d))


_MET_D = "mae rmse r2 smape wmape"


def _metrics_sql(prefix: str = "", where: str = "true") -> str:
    e = "(actual - predicted)"
    half = "((abs(actual) + abs(predicted)) / 2)"
    cols = {
        "mae": f"avg(abs({e}))",
        "rmse": f"sqrt(avg({e} * {e}))",
        "r2": f"1 - sum({e} * {e}) / (var_pop(actual) * count(actual))",
        "smape": f"avg(case when {half} = 0 then 0 else abs({e}) / {half} end) * 100",
        "wmape": f"sum(case when actual <> 0 then abs({e}) else 0 end) / sum(abs(actual)) * 100",
    }
    return "select " + ", ".join(f"{x} as {prefix}{n}" for n, x in cols.items()) + f" from ({_PAIRS}) p where {where}"


_ZERO = f"select count(*) filter (where actual = 0) as zero_actuals, count(*) filter (where predicted = 0) as zero_predictions, count(*) filter (where actual = 0) * 100.0 / count(*) as zero_actuals_pct, count(*) filter (where predicted = 0) * 100.0 / count(*) as zero_predictions_pct from ({_PAIRS}) p"


def _one_metric(name: str) -> None:
    @query(f"metric_{name}", f"select {name} from ({_metrics_sql()}) m", name)
    def _(spark, d):
        return M.regression_metrics(_pairs(spark, d)).select(name)


for _name in _MET_D.split():
    _one_metric(_name)


@query("train_test_metrics", f"select * from ({_metrics_sql('train_', 'day(date) <= 20')}) a, ({_metrics_sql('test_', 'day(date) > 20')}) b", " ".join(f"{s}_{m}" for s in ("train", "test") for m in _MET_D.split()))
def _(spark, d):
    p = _pairs(spark, d)
    return M.train_test_metrics(p.filter(F.dayofmonth("date") <= 20), p.filter(F.dayofmonth("date") > 20))


@query("zero_inflation", f"select *, case when zero_actuals > zero_predictions then 'Under-predicting zeros' when zero_predictions > zero_actuals then 'Over-predicting zeros' else 'Balanced' end as model_bias from ({_ZERO}) z", "zero_actuals_pct zero_predictions_pct")
def _(spark, d):
    return M.zero_inflation(_pairs(spark, d))


@query("target_summary", f"select avg(actual) as mean_target, stddev_samp(actual) as std_target, count(*) as n_samples from ({_PAIRS}) p", "mean_target std_target")
def _(spark, d):
    return M.target_summary(_pairs(spark, d))


@query("residual_stats", f"select avg(r) as mean_residual, stddev_samp(r) as std_residual, max(r) as max_residual, min(r) as min_residual, skewness(r) as residual_skewness, kurtosis(r) as residual_kurtosis from (select actual - predicted as r from ({_PAIRS}) p) x", "mean_residual std_residual max_residual min_residual residual_skewness residual_kurtosis")
def _(spark, d):
    return M.residual_stats(_pairs(spark, d))


@query("campaign_error_report", f"select campaign_name, {_even('avg(actual)', 4)} as actual_mean, count(actual) as actual_count, {_even('avg(predicted)', 4)} as predicted_mean, {_even('avg(error)', 4)} as error_mean, {_even('stddev_samp(error)', 4)} as error_std, {_even('avg(abs_error)', 4)} as abs_error_mean, avg(abs_error) as mae, {_even('median(abs_error)', 4)} as abs_error_median from ({_ERR.format(_PAIRS)}) e group by 1", "actual_mean predicted_mean error_mean error_std abs_error_mean mae abs_error_median")
def _(spark, d):
    return M.campaign_error_report(_pairs(spark, d))


_HOURLY = f"({_weights_sql()}) w"


@query("forecast_totals", f"select campaign_name, sum(predicted_spend) as predicted_spend_12h, avg(predicted_spend) as average_per_hour from {_HOURLY} group by 1", "predicted_spend_12h average_per_hour")
def _(spark, d):
    return H.forecast_totals(H.weight_distribution(_totals(spark, d), AS_OF.hour))


@query("forecast_hour_totals", f"select horizon, sum(predicted_spend) as total_spend, sum(predicted_spend) / count(distinct campaign_name) as average_spend from {_HOURLY} group by 1", "total_spend average_spend")
def _(spark, d):
    return H.forecast_hour_totals(H.weight_distribution(_totals(spark, d), AS_OF.hour))


@query("two_stage_total", f"select campaign_name, sum(greatest(0, actual - predicted)) as expected_spend_12h from ({_PAIRS}) p group by 1", "expected_spend_12h")
def _(spark, d):
    p = _pairs(spark, d).withColumn("prediction", F.col("actual") - F.col("predicted"))
    return H.two_stage_total(p)


@query("residual_histogram", f"with r as (select actual - predicted as r from ({_PAIRS}) p), s as (select min(r) as lo, (max(r) - min(r)) / 50 as w from r), b as (select cast(least(floor((r - lo) / w) + 1, 50) as int) as bin, count(*) as n from r, s group by 1) select cast(g.i as int) as bin, lo + (g.i - 1) * w as lower, lo + g.i * w as upper, coalesce(n, 0) as n from s, range(1, 51) g(i) left join b on b.bin = g.i", "lower upper")
def _(spark, d):
    return M.residual_histogram(_pairs(spark, d))


_LEVELS = "[" + ", ".join(str((i + 0.5) / 100) for i in range(100)) + "]"


@query("residual_qq", f"select cast(i as int) as point, (i - 0.5) / 100 as level, q[i] as residual_quantile from (select quantile_cont(actual - predicted, {_LEVELS}) as q from ({_PAIRS}) p) x, range(1, 101) r(i)", "level residual_quantile")
def _(spark, d):
    return M.residual_qq(_pairs(spark, d)).drop("normal_quantile")


@query("residual_qq_normal")
def _(spark, d):
    return M.residual_qq(_pairs(spark, d))


@query("scatter_pairs", f"select actual, predicted, actual - predicted as residual, (select least(min(actual), min(predicted)) from ({_PAIRS}) x) as line_min, (select greatest(max(actual), max(predicted)) from ({_PAIRS}) y) as line_max from ({_PAIRS}) p", "actual predicted residual line_min line_max")
def _(spark, d):
    return M.scatter_pairs(_pairs(spark, d))


@query("scatter_sample", f"select actual, predicted, actual - predicted as residual, (select least(min(actual), min(predicted)) from ({_PAIRS}) x) as line_min, (select greatest(max(actual), max(predicted)) from ({_PAIRS}) y) as line_max from ({_PAIRS}) p where cast('0x' || substr(md5(concat_ws('|', campaign_name, strftime(date, '%Y-%m-%d'), hourly_window, '42')), 1, 8) as bigint) < {round(0.1 * 2**32)}", "actual predicted residual line_min line_max")
def _(spark, d):
    return M.scatter_pairs(_pairs(spark, d), 0.1, ("campaign_name", "date", "hourly_window"))


@query("scatter_bins", f"select cast(case when y1 > y0 then least(floor((y - y0) / (y1 - y0) * 50), 49) else 0 end as int) as actual_bin, cast(case when p1 > p0 then least(floor((p - p0) / (p1 - p0) * 50), 49) else 0 end as int) as predicted_bin, count(*) as n_rows from (select y, p, min(y) over () as y0, max(y) over () as y1, min(p) over () as p0, max(p) over () as p1 from (select cast(actual as double) as y, cast(predicted as double) as p from ({_PAIRS}) x where actual is not null and predicted is not null) v) w group by 1, 2")
def _(spark, d):
    return M.scatter_bins(_pairs(spark, d))


# ---------------------------------------------------------------- 2.7 joins

_STAT_COLS = ", ".join(f"{c}_{f}" for c, fs in C.STATS.items() for f in fs)


@query("campaign_features", f"select c.campaign_name, c.date, c.hourly_window, {_STAT_COLS} from ({_CLEAN}) c left join ({_stats_sql(C.STATS, _CLEAN)}) s on c.campaign_name = s.campaign_name", _spec_doubles(C.STATS))
def _(spark, d):
    return C.add_campaign_features(_clean(spark, d)).select(*_KEYS, *[f"{c}_{f}" for c, fs in C.STATS.items() for f in fs])


@query("join_campaign_stats", f"select c.campaign_name, c.date, c.hourly_window, spend, spend_mean, spend_count from ({_CLEAN}) c left join ({_stats_sql(C.STATS, _CLEAN)}) s on c.campaign_name = s.campaign_name", "spend spend_mean")
def _(spark, d):
    c = _clean(spark, d)
    return C.join_campaign_stats(c, C.campaign_stats(c)).select(*_KEYS, "spend", "spend_mean", "spend_count")


@query("join_campaign_tiers", f"select c.campaign_name, c.date, c.hourly_window, spend_level, performance_tier from ({_CLEAN}) c left join ({_tiers_sql(_CLEAN)}) t on c.campaign_name = t.campaign_name")
def _(spark, d):
    c = _clean(spark, d)
    tiers = C.campaign_tiers(c).select("campaign_name", "spend_level", "performance_tier")
    return C.join_campaign_stats(c, tiers).select(*_KEYS, "spend_level", "performance_tier")


_MEMBERS = "campaign_name in ('C01', 'C05', 'C12')"


@query("semi_join_members", f"select {_K}, spend from ({_CLEAN}) c where {_MEMBERS}", "spend")
def _(spark, d):
    c = _clean(spark, d)
    return C.semi_join_members(c, C.distinct_campaigns(c).filter(_MEMBERS)).select(*_KEYS, "spend")


@query("anti_join_members", f"select {_K}, spend from ({_CLEAN}) c where not {_MEMBERS}", "spend")
def _(spark, d):
    c = _clean(spark, d)
    return C.anti_join_members(c, C.distinct_campaigns(c).filter(_MEMBERS)).select(*_KEYS, "spend")


@query("cross_join_thresholds", f"with profile as (select campaign_name, {_even('avg(spend)', 6)} as spend_mean, {_even('avg(ctr)', 6)} as ctr_mean, {_even('avg(cpc)', 6)} as cpc_mean from ({_CLEAN}) s group by 1) {_THRESHOLDS} from profile", "s1 s2 c1 c2 p1 p2")
def _(spark, d):
    t = C.tier_thresholds(C.campaign_profile(_clean(spark, d)))
    pick = {"s": "spend_edges", "c": "ctr_edges", "p": "cpc_edges"}
    return t.select(*[F.col(e)[i].alias(f"{n}{i + 1}") for n, e in pick.items() for i in (0, 1)])


@query("cross_join_horizons", f"select {_K}, cast(h as int) as horizon from ({_CLEAN}) c, range(1, 13) r(h)")
def _(spark, d):
    return H.cross_join_horizons(_clean(spark, d).select(*_KEYS))


# ---------------------------------------------------------------- 2.8 windows


def _rolling_sql(source: str, days=(7, 14, 30), metrics=R.ROLLING_METRICS) -> str:
    fn = {"mean": "avg", "std": "stddev_samp"}
    cols = [f"{fn[f]}({c}) {_WR.format(24 * n - 1)} as {c}_rolling_{f}_{n}d" for n in days for c in metrics for f in fn]
    return f"select {_K}, {', '.join(cols)} from ({source}) c"


_ROLL_COLS = [f"{c}_rolling_{f}_{n}d" for n in R.ROLLING_DAYS for c in R.ROLLING_METRICS for f in ("mean", "std")]
_ROLL_D = " ".join(_ROLL_COLS)
_EXP_COLS = [f"{c}_expanding_{f}" for c in R.EXPANDING_METRICS for f in ("mean", "sum")]
_EXP_SQL = f"select {_K}, " + ", ".join(
    f"{'cast(' if f == 'sum' else ''}{ {'mean': 'avg', 'sum': 'sum'}[f] }({c}) {_W.replace('hourly_window)', 'hourly_window rows unbounded preceding)')}{' as double)' if f == 'sum' else ''} as {c}_expanding_{f}"
    for c in R.EXPANDING_METRICS
    for f in ("mean", "sum")
)
_LAG_COLS = [f"{c}_lag_{k}h" for k in R.LAGS for c in R.LAG_METRICS]


def _lag_sql(source: str, metrics=R.LAG_METRICS) -> str:
    return f"select {_K}, " + ", ".join(f"coalesce(lag({c}, {k}) {_W}, 0) as {c}_lag_{k}h" for k in R.LAGS for c in metrics) + f" from ({source}) c"


@query("rolling_rows", _rolling_sql(_CLEAN), _ROLL_D)
def _(spark, d):
    return R.add_rolling_features(_clean(spark, d)).select(*_KEYS, *_ROLL_COLS)


@query("rolling_rows_hot_campaigns", _rolling_sql(_CLEAN), _ROLL_D)
def _(spark, d):
    return R.add_rolling_features(_clean(spark, d), **HOT).select(*_KEYS, *_ROLL_COLS)


_EV_SQL = f"select * replace (coalesce(spend, 0) as spend) from ({_EVENT_FACTS}) f"


@query("rolling_rows_events", _rolling_sql(_EV_SQL), _ROLL_D)
def _(spark, d):
    return R.add_rolling_features(_clean_events(spark, d)).select(*_KEYS, *_ROLL_COLS)


@query("expanding", f"{_EXP_SQL} from ({_CLEAN}) c", " ".join(_EXP_COLS))
def _(spark, d):
    return R.add_expanding_features(_clean(spark, d)).select(*_KEYS, *_EXP_COLS)


@query("expanding_hot_campaigns", f"{_EXP_SQL} from ({_CLEAN}) c", " ".join(_EXP_COLS))
def _(spark, d):
    return R.add_expanding_features(_clean(spark, d), **HOT).select(*_KEYS, *_EXP_COLS)


@query("lag_features", _lag_sql(_CLEAN), " ".join(f"spend_lag_{k}h" for k in R.LAGS))
def _(spark, d):
    return R.add_lag_features(_clean(spark, d)).select(*_KEYS, *_LAG_COLS)


@query("lag_features_events", _lag_sql(_EV_SQL), " ".join(f"spend_lag_{k}h" for k in R.LAGS))
def _(spark, d):
    return R.add_lag_features(_clean_events(spark, d)).select(*_KEYS, *_LAG_COLS)


@query("lag_features_hot_campaigns", _lag_sql(_CLEAN), " ".join(f"spend_lag_{k}h" for k in R.LAGS))
def _(spark, d):
    return R.add_lag_features(_clean(spark, d), **HOT).select(*_KEYS, *_LAG_COLS)


@query("lag_features_ext", _lag_sql(_CLEAN, R.LAG_METRICS_EXT), " ".join(f"{c}_lag_{k}h" for k in R.LAGS for c in ("spend", "ctr", "cpc")))
def _(spark, d):
    return R.add_lag_features_ext(_clean(spark, d)).select(*_KEYS, *[f"{c}_lag_{k}h" for k in R.LAGS for c in R.LAG_METRICS_EXT])


@query("target_lead", f"select {_K}, spend, target_spend_12h from ({_TARGETED}) t", "spend target_spend_12h")
def _(spark, d):
    return R.add_target(_clean(spark, d)).select(*_KEYS, "spend", TARGET)


@query("target_sum", f"select {_K}, s as target_spend_12h from (select *, sum(spend) over (partition by campaign_name order by date, hour, hourly_window rows between 1 following and 12 following) as s, lead(spend, 12) {_W} as t from ({_CLEAN}) c) x where t is not null", "target_spend_12h")
def _(spark, d):
    return R.add_target(_clean(spark, d), how="sum").select(*_KEYS, TARGET)


_TW = "over (partition by campaign_name order by event_ts range between interval {} minute preceding and current row)"
_RT_COLS = [f"{c}_rolling_{f}_{n}" for n in T.TIME_WINDOWS for c in R.ROLLING_METRICS for f in ("mean", "std")]


@query(
    "rolling_time",
    f"select {_K}, " + ", ".join(f"{g}({c}) {_TW.format(h * 60 - 1)} as {c}_rolling_{f}_{n}" for n, h in T.TIME_WINDOWS.items() for c in R.ROLLING_METRICS for f, g in (("mean", "avg"), ("std", "stddev_samp"))) + f" from ({_TS}) t",
    " ".join(_RT_COLS),
)
def _(spark, d):
    return T.rolling_time(_ts(spark, d)).select(*_KEYS, *_RT_COLS)


_EV_TS = f"select *, cast(date as timestamp) + to_microseconds(cast(epoch_us(cast('1970-01-01 ' || left(hourly_window, 15) as timestamp)) as bigint)) as event_ts from ({_EV_SQL}) e"


def _event_times(spark, d):
    """Event rows with the instant of each event, to the microsecond."""
    at = F.concat(F.col("date").cast("string"), F.lit(" "), F.substring("hourly_window", 1, 15)).cast("timestamp_ntz")
    return _clean_events(spark, d).withColumn("event_ts", at)


@query(
    "rolling_time_events",
    f"select {_K}, " + ", ".join(f"{g}({c}) over (partition by campaign_name order by event_ts range between interval {h * 3_600_000_000 - 1} microsecond preceding and current row) as {c}_rolling_{f}_{n}" for n, h in T.TIME_WINDOWS.items() for c in R.ROLLING_METRICS for f, g in (("mean", "avg"), ("std", "stddev_samp"))) + f" from ({_EV_TS}) t",
    " ".join(_RT_COLS),
)
def _(spark, d):
    return T.rolling_time(_event_times(spark, d), hot_rows=0, block_cells=64).select(*_KEYS, *_RT_COLS)


@query("gap_detect_events", f"select campaign_name, count(*) filter (where step > interval 2 hour) as n_gaps from (select campaign_name, event_ts - lag(event_ts) over (partition by campaign_name order by event_ts) as step from (select distinct campaign_name, event_ts from ({_EV_TS}) t) u) s group by 1")
def _(spark, d):
    return T.gap_detect(_event_times(spark, d))


@query("hours_since_positive_spend_events", f"select {_K}, epoch_us(event_ts - max(spent_at) over (partition by campaign_name order by event_ts rows between unbounded preceding and 1 preceding)) / 3600000000 as hours_since_positive_spend from (select campaign_name, event_ts, max(case when spend > 0 then event_ts end) as spent_at from ({_EV_TS}) t group by 1, 2) c join ({_EV_TS}) t using (campaign_name, event_ts)", "hours_since_positive_spend")
def _(spark, d):
    return T.hours_since_positive_spend(_event_times(spark, d)).select(*_KEYS, "hours_since_positive_spend")


@query("spend_changed", f"select {_K}, case when spend = lag(spend) {_W} then 0 else 1 end as hours_since_last_spend from ({_CLEAN}) c")
def _(spark, d):
    return R.add_spend_changed(_clean(spark, d)).select(*_KEYS, "hours_since_last_spend")


@query("hours_since_positive_spend", f"select {_K}, epoch(event_ts - max(case when spend > 0 then event_ts end) over (partition by campaign_name order by event_ts rows between unbounded preceding and 1 preceding)) / 3600 as hours_since_positive_spend from ({_TS}) t", "hours_since_positive_spend")
def _(spark, d):
    return T.hours_since_positive_spend(_ts(spark, d)).select(*_KEYS, "hours_since_positive_spend")


@query("latest_row", f"select {_K}, spend from (select *, {_NEWEST} as rn from ({_CLEAN}) c) x where rn = 1", "spend")
def _(spark, d):
    return R.latest_row(_clean(spark, d)).select(*_KEYS, "spend")


@query("tail_rows", f"select {_K}, spend from (select *, {_NEWEST} as rn from ({_EV_SQL}) c) x where rn <= 24", "spend")
def _(spark, d):
    return R.tail_rows(_clean_events(spark, d)).select(*_KEYS, "spend")


# ---------------------------------------------------------------- 2.9 sort, top-k, set operations


@query("sort_dataset", f"select {_K}, spend from ({_FACTS}) f order by 1, 2, 3", "spend")
def _(spark, d):
    return insights.sort_dataset(_facts(spark, d)).select(*_KEYS, "spend")


@query("sort_series", f"select {_K}, hour, row_number() {_W} as position from ({_CLEAN}) c")
def _(spark, d):
    from hourloom.operators.lanes import over_series

    step = lambda lane: lane.with_windows({"position": f"CAST(row_number() {lane.over()} AS BIGINT)"})
    return over_series(_clean(spark, d), step).select(*_KEYS, "hour", "position")


_IMP = f"select campaign_name as feature, avg(spend) as importance from ({_CLEAN}) c group by 1"
_IMP2 = f"select campaign_name as feature, avg(ctr) as importance from ({_CLEAN}) c group by 1"


def _importance(spark, d):
    c = _clean(spark, d)
    a, b = (c.groupBy(F.col("campaign_name").alias("feature")).agg(F.avg(m).alias("importance")) for m in ("spend", "ctr"))
    return M.union_importance({"built_in": a, "permutation": b})


@query("union_importance", f"select *, 'built_in' as method from ({_IMP}) a union all select *, 'permutation' as method from ({_IMP2}) b", "importance")
def _(spark, d):
    return _importance(spark, d)


@query("top_features", f"select *, 'built_in' as method from ({_IMP}) a order by importance desc limit 10", "importance")
def _(spark, d):
    return M.top_features(_importance(spark, d), 10, "built_in")


@query("distinct_campaigns", f"select distinct campaign_name from ({_CLEAN}) c")
def _(spark, d):
    return C.distinct_campaigns(_clean(spark, d))


# ---------------------------------------------------------------- 2.10 splits

_ORDER = "order by date, hour, md5(concat(campaign_name, '#', hourly_window))"


@query("split_by_campaign", f"with r as (select campaign_name, row_number() over (order by md5(concat(campaign_name, '#42'))) as rn, count(*) over () as n from (select distinct campaign_name from ({_CLEAN}) c) u) select c.campaign_name, date, hourly_window, case when rn <= floor(n * 0.2) then 'test' else 'train' end as split from ({_CLEAN}) c join r on c.campaign_name = r.campaign_name")
def _(spark, d):
    return X.label_by_campaign(_clean(spark, d)).select(*_KEYS, "split")


@query("split_by_time", f"select {_K}, case when rn <= floor(n * 0.8) then 'train' else 'test' end as split from (select *, row_number() over ({_ORDER}) as rn, count(*) over () as n from ({_CLEAN}) c) x")
def _(spark, d):
    return X.label_by_time(_clean(spark, d)).select(*_KEYS, "split")


_CUT = f"(select max(event_ts) from (select event_ts, row_number() over ({_ORDER}) as rn, count(*) over () as n from ({_TS}) t) x where rn <= floor(n * 0.8))"


@query("split_series_gap", f"select {_K}, case when event_ts <= {_CUT} then 'train' else 'test' end as split from ({_TS}) t where event_ts <= {_CUT} or event_ts >= {_CUT} + interval 48 hour")
def _(spark, d):
    train, test = X.split_series_gap(_clean(spark, d), 0.2, 48)
    mark = lambda df, s: df.select(*_KEYS, F.lit(s).alias("split"))
    return mark(train, "train").unionByName(mark(test, "test"))


@query("rolling_origin_folds", f"select {_K}, cast(greatest(0, 5 - (n - rn) // (n // 6)) as int) as fold from (select *, row_number() over ({_ORDER}) as rn, count(*) over () as n from ({_CLEAN}) c) x")
def _(spark, d):
    return X.rolling_origin_folds(_clean(spark, d), 5).select(*_KEYS, "fold")


# ---------------------------------------------------------------- 2.11 model jobs


TRIALS, FOLDS = 4, 5


def _model_rows(spark, d):
    """The labelled feature table; search, fit and scoring each read it."""
    return durable(prepare.feature_table(_facts(spark, d)))


def _fit(rows):
    fitted, meta = model.train_gbt(rows, n_trials=TRIALS, cv_folds=FOLDS, space=SMALL)
    return fitted, meta["feature_names"], meta


@query("train_gbt")
def _(spark, d):
    rows = _model_rows(spark, d)
    train, test = X.split_data(rows, 0.2, "campaign")
    fitted, names, _meta = _fit(train)
    return M.train_test_metrics(model.predictions(fitted, train, names), model.predictions(fitted, test, names))


@query("train_job")
def _(spark, d):
    data = files.sink_processed(_model_rows(spark, d), scratch_path(spark, "processed.parquet"))
    return model.train_job(spark, data, scratch_path(spark, "model"), TRIALS, FOLDS, SMALL)[1]


@query("model_save_load")
def _(spark, d):
    rows = _model_rows(spark, d)
    fitted, names, meta = _fit(rows)
    path = files.model_save(spark, fitted, scratch_path(spark, "model"), meta)
    loaded, features = model.load_for_scoring(spark, path)
    return model.predictions(loaded, rows, features)


@query("score_12h")
def _(spark, d):
    rows = _model_rows(spark, d)
    fitted, names, _meta = _fit(rows)
    return model.score_12h(fitted, rows, names)


_FUT = "cast(date as timestamp) + to_hours(hour + h)"


@query("build_horizon_frame", f"select campaign_name, cast(h as int) as horizon, cast(f as date) as date, cast(hour(f) as int) as hour, cast(isodow(f) - 1 as int) as day_of_week, cast(day(f) as int) as day_of_month, cast(month(f) as int) as month, cast(isodow(f) >= 6 as int) as is_weekend, cast(hour(f) between 9 and 17 as int) as is_business_hours, spend, hour(f) * spend as hour_spend from (select *, cast({_FUT} as timestamp) as f from (select *, {_NEWEST} as rn from ({_CLEAN}) c) x, range(1, 13) r(h) where rn = 1) y", "spend hour_spend")
def _(spark, d):
    latest = R.latest_row(P.add_interaction_features(_clean(spark, d)))
    return H.build_horizon_frame(latest).select("campaign_name", "horizon", "date", "hour", "day_of_week", "day_of_month", "month", "is_weekend", "is_business_hours", "spend", "hour_spend")


# Campaigns whose newest hours differ: each value stands under its own clock hour.
_BY_CLOCK = f"select campaign_name, spend + h as v, cast(date_diff('hour', timestamp '2024-01-31 02:00:00', {_FUT}) as int) + 1 as slot from (select *, {_NEWEST} as rn from ({_CLEAN}) c) x, range(1, 13) r(h) where rn = 1"


@query(
    "forecast_wide",
    "select campaign_name as \"Campaign\", "
    + ", ".join(f'coalesce(max(case when slot = {i} then v end), 0) as "{label}"' for i, label in enumerate(H.hour_labels(FORECAST_START), 1))
    + f" from (select campaign_name, slot, {_even('v', 2)} as v from ({_BY_CLOCK}) b) x group by 1",
)
def _(spark, d):
    rows = H.build_horizon_frame(R.latest_row(_clean(spark, d)))
    return H.forecast_wide(rows.withColumn("predicted_spend", F.col("spend") + F.col("horizon")), FORECAST_START)


@query("score_hourly")
def _(spark, d):
    rows = _model_rows(spark, d)
    fitted, names, _meta = _fit(rows)
    return model.score_hourly(fitted, rows, names)


@query("predict_two_stage")
def _(spark, d):
    rows = _model_rows(spark, d)
    fitted, names, _meta = _fit(rows)
    return model.predict_two_stage(fitted, rows, names)


@query("fallback_distribution")
def _(spark, d):
    rows = _model_rows(spark, d)
    fitted, names, _meta = _fit(rows)
    return model.fallback_hourly_distribution(fitted, rows, names, AS_OF.hour)


@query("forecast_job")
def _(spark, d):
    fitted, _names, meta = _fit(_model_rows(spark, d))
    saved = files.model_save(spark, fitted, scratch_path(spark, "model"), meta)
    newest = files.sink_any(prepare.scoring_rows(_facts(spark, d)), scratch_path(spark, "scoring.parquet"), "parquet")
    return jobs.forecast_job(spark, newest, saved, scratch_path(spark, "forecast"), AS_OF)


@query("predict_interval")
def _(spark, d):
    rows = _model_rows(spark, d)
    train, test = X.split_data(rows, 0.2, "campaign")
    fitted, names, _meta = _fit(train)
    return model.predict_interval(model.score_12h(fitted, rows, names), model.predictions(fitted, test, names))


_DRAWS = f"""
    with residuals as (select actual - predicted as residual from ({_PAIRS}) p where actual is not null and predicted is not null),
      pool as (select residual, row_number() over (order by residual) - 1 as rank, count(*) over () as n from residuals),
      draws as (select campaign_name, predicted_spend_12h as prediction,
          cast('0x' || substr(md5(concat_ws('|', campaign_name, b, 42)), 1, 12) as bigint) % (select max(n) from pool) as rank
        from ({_TOTALS}) t, range(1, 101) r(b))
    select campaign_name, max(prediction) as prediction, quantile_cont(prediction + residual, 0.025) as lower_95,
      quantile_cont(prediction + residual, 0.975) as upper_95, stddev_pop(prediction + residual) as std
    from draws join pool using (rank) group by 1"""


@query("predict_interval_residuals", _DRAWS, "prediction lower_95 upper_95 std")
def _(spark, d):
    return model.predict_interval(_totals(spark, d), _pairs(spark, d))


_HALF = "cast(right(campaign_name, 2) as int) % 2 = 0"


@query(
    "fill_forecast",
    f"""
    select campaign_name, cast(horizon as int) as horizon, target_ts, predicted_spend, source from (
      select campaign_name, h as horizon, timestamp '{FORECAST_START}' + to_hours(cast(h - 1 as int)) as target_ts, spend + h as predicted_spend, 'model' as source
      from (select *, {_NEWEST} as rn from ({_CLEAN}) c) x, range(1, 13) r(h) where rn = 1 and {_HALF}
      union all
      select campaign_name, horizon, timestamp '{FORECAST_START}' + to_hours(horizon - 1), predicted_spend, 'fallback'
      from ({_weights_sql(start=FORECAST_START.hour)}) w where not ({_HALF})) f
    """,
    "predicted_spend",
)
def _(spark, d):
    latest = R.latest_row(_clean(spark, d)).where(F.substring("campaign_name", 2, 2).cast("int") % 2 == 0)
    hourly = H.build_horizon_frame(latest, start=FORECAST_START).withColumn("predicted_spend", F.col("spend") + F.col("horizon"))
    return H.fill_forecast(hourly, _totals(spark, d), FORECAST_START)


_SINCE = "hours_since_positive_spend"


@query(
    "missing_indicators",
    f"select {_K}, coalesce({_SINCE}, 0) as {_SINCE}, cast({_SINCE} is null as double) as {_SINCE}_is_null from (select {_K}, epoch(event_ts - max(case when spend > 0 then event_ts end) over (partition by campaign_name order by event_ts rows between unbounded preceding and 1 preceding)) / 3600 as {_SINCE} from ({_TS}) t) s",
    _SINCE,
)
def _(spark, d):
    rows, names = model.select_features(T.hours_since_positive_spend(_ts(spark, d)).drop("event_ts"), indicators=True)
    flags = [n for n in names if n.endswith(model.MISSING)]
    return rows.select(*_KEYS, *[n.removesuffix(model.MISSING) for n in flags], *flags)


@query("importance_builtin")
def _(spark, d):
    fitted, names, _meta = _fit(_model_rows(spark, d))
    return model.importance_builtin(spark, fitted, names)


@query("importance_permutation")
def _(spark, d):
    train, test = X.split_data(_model_rows(spark, d), 0.2, "campaign")
    fitted, names, _meta = _fit(train)
    return model.importance_permutation(fitted, test, names)


@query("evaluation_report")
def _(spark, d):
    train, test = X.split_data(_model_rows(spark, d), 0.2, "campaign")
    fitted, names, _meta = _fit(train)
    report = jobs.evaluation_report(spark, fitted, names, test, train)
    tables = [df.withColumn("report_table", F.lit(name)) for name, df in report.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


# ---------------------------------------------------------------- 2.12 composed features

_PREP = f"""
with c as ({_CLEAN}), s as ({_stats_sql(C.STATS, _CLEAN)}),
l as (select c.*, {', '.join(f'coalesce(lag({m}, {k}) {_W}, 0) as {m}_lag_{k}h' for k in R.LAGS for m in R.LAG_METRICS)}, lead(spend, 12) {_W} as target_spend_12h from c)
select l.*, {_STAT_COLS} from l join s on l.campaign_name = s.campaign_name where target_spend_12h is not null
"""
_PREP_D = f"{_FLAT_D} target_spend_12h {_spec_doubles(C.STATS)} " + " ".join(f"spend_lag_{k}h" for k in R.LAGS)


@query("prepare_features", _PREP, _PREP_D)
def _(spark, d):
    return prepare.prepare_features(_facts(spark, d))


_GAP_COLS = f"case when spend = lag(spend) {_W} then 0 else 1 end as hours_since_last_spend, 0 as is_missing_hour, stddev_samp(spend) over (partition by campaign_name) as campaign_spend_volatility, cast(count(distinct hour) over (partition by campaign_name, date) as int) as campaign_hourly_frequency"


@query("gap_features", f"select {_K}, {_GAP_COLS} from ({_CLEAN}) c", "campaign_spend_volatility")
def _(spark, d):
    return prepare.gap_features(_clean(spark, d)).select(*_KEYS, "hours_since_last_spend", "is_missing_hour", "campaign_spend_volatility", "campaign_hourly_frequency")


@query("gap_features_hot_campaigns", f"select {_K}, {_GAP_COLS} from ({_CLEAN}) c", "campaign_spend_volatility")
def _(spark, d):
    return prepare.gap_features(_clean(spark, d), **HOT).select(*_KEYS, "hours_since_last_spend", "is_missing_hour", "campaign_spend_volatility", "campaign_hourly_frequency")


@query("seasonal_features", f"select {_K}, {_CYC_SQL}, 12 as forecast_horizon, {_GAP_COLS} from ({_CLEAN}) c", f"{_CYC_D} campaign_spend_volatility")
def _(spark, d):
    return prepare.seasonal_features(_clean(spark, d)).select(*_KEYS, *_CYC_D.split(), "forecast_horizon", "hours_since_last_spend", "is_missing_hour", "campaign_spend_volatility", "campaign_hourly_frequency")


@query("campaign_clusters", f"select c.campaign_name, c.date, c.hourly_window, {_CODE.format('spend_level')}, {_CODE.format('performance_tier')} from ({_CLEAN}) c join ({_tiers_sql(_CLEAN)}) t on c.campaign_name = t.campaign_name")
def _(spark, d):
    return C.add_campaign_clusters(_clean(spark, d)).select(*_KEYS, "spend_level", "performance_tier")


def _on_prepared(fragment: str) -> str:
    return fragment.replace("(" + _CLEAN + ") c", "prep c")


_FEATURES = f"""
with prep as ({_PREP}),
roll as ({_on_prepared(_rolling_sql(_CLEAN))}),
expd as ({_EXP_SQL} from prep c),
tier as ({_tiers_sql('select * from prep')})
select p.*, roll.* exclude (campaign_name, date, hourly_window), expd.* exclude (campaign_name, date, hourly_window),
  {_RATIO_SQL}, {_INTER_SQL}, {', '.join(f'pow(cast({c} as double), 2) as {c}_pow_2' for c in _POLY)}, {_CYC_SQL},
  12 as forecast_horizon, {_GAP_COLS.replace('campaign_name', 'p.campaign_name').replace('date,', 'p.date,').replace(', date)', ', p.date)').replace('hourly_window)', 'p.hourly_window)')}, {_CODE.format('spend_level')}, {_CODE.format('performance_tier')}
from prep p
join roll on p.campaign_name = roll.campaign_name and p.date = roll.date and p.hourly_window = roll.hourly_window
join expd on p.campaign_name = expd.campaign_name and p.date = expd.date and p.hourly_window = expd.hourly_window
join tier on p.campaign_name = tier.campaign_name
"""
_FEATURES_D = f"{_PREP_D} {_ROLL_D} {' '.join(_EXP_COLS)} {_RATIO_D} {_INTER_D} {' '.join(f'{c}_pow_2' for c in _POLY)} {_CYC_D} campaign_spend_volatility"


@query("engineer_features", _FEATURES, _FEATURES_D)
def _(spark, d):
    return prepare.engineer_features(prepare.prepare_features(_facts(spark, d)))


@query("feature_table", _FEATURES, _FEATURES_D)
def _(spark, d):
    return prepare.feature_table(_facts(spark, d))


_SCORING_COLS = ["spend_lag_24h", "spend_rolling_mean_7d", "spend_expanding_sum", "hours_since_last_spend"]


@query(
    "scoring_rows",
    f"select {_K}, {', '.join(_SCORING_COLS)} from (select {_K}, coalesce(lag(spend, 24) {_W}, 0) as spend_lag_24h, avg(spend) {_WR.format(167)} as spend_rolling_mean_7d, sum(spend) {_W.replace('hourly_window)', 'hourly_window rows unbounded preceding)')} as spend_expanding_sum, case when spend = lag(spend) {_W} then 0 else 1 end as hours_since_last_spend, {_NEWEST} as rn, max(date) over () as newest from ({_CLEAN}) c) x where rn = 1 and date = newest",
    "spend_lag_24h spend_rolling_mean_7d spend_expanding_sum",
)
def _(spark, d):
    return prepare.scoring_rows(_facts(spark, d)).select(*_KEYS, *_SCORING_COLS)


@query("feature_table_hot_campaigns", _FEATURES, _FEATURES_D)
def _(spark, d):
    return prepare.feature_table(_facts(spark, d), hot_rows=10, block_rows=300)


@query("prepare_dataset", _FEATURES, _FEATURES_D)
def _(spark, d):
    raw = files.sink_any(_facts(spark, d), scratch_path(spark, "raw.csv"), "csv")
    return prepare.prepare_dataset(spark, raw, scratch_path(spark, "processed.parquet"))


@query("run_pipeline")
def _(spark, d):
    results = jobs.run_pipeline(
        spark,
        pages_path=_landed_pages(spark, d),
        raw_path=scratch_path(spark, "raw.csv"),
        processed_path=scratch_path(spark, "processed.parquet"),
        model_path=scratch_path(spark, "model"),
        scoring_path=scratch_path(spark, "scoring.parquet"),
        predictions_path=scratch_path(spark, "forecast"),
        report_path=scratch_path(spark, "report"),
        start=AS_OF,
        n_trials=TRIALS,
        cv_folds=FOLDS,
        space=SMALL,
    )
    return results["predictions"]


# ---------------------------------------------------------------- contract


def entry(spark: SparkSession) -> DataFrame:
    """The whole feature table at the smallest scale."""
    return prepare.feature_table(campaign_hourly(spark, "/root/testdata/sf0.001"))


try:
    from corpus_pipeline import ORACLE_SQL as _PIPELINE_SQL
    from corpus_pipeline import run as _pipeline
    from hourloom.llm.queries import ORACLES as _LLM_ORACLES
    from hourloom.llm.queries import QUERIES as _LLM_QUERIES
except ImportError as error:
    # The training-data operators can be left out; anything else that is missing is a fault.
    if error.name not in ("corpus_pipeline", "hourloom.llm", "hourloom.llm.queries"):
        raise
else:
    _QUERIES.update(_LLM_QUERIES)
    _ORACLES.update(_LLM_ORACLES)
    _QUERIES["pipeline"] = _pipeline
    if _PIPELINE_SQL is not None:
        _ORACLES["pipeline"] = _PIPELINE_SQL


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
