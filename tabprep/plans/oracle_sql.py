"""DuckDB SQL for the flight plan, stage by stage, used as an independent
oracle for the Spark queries.

Each stage is a CTE over the pre-registered driver tables; a query's SQL is
``WITH <all stage CTEs> SELECT ...``. Floats are rounded to ``DIGITS``
decimals (and ``+ 0.0`` folds -0.0 into 0.0) on both sides, since summation
order differs between engines.
"""

from __future__ import annotations

from tabprep.sources.fixtures import flights_sql_ctes

DIGITS = 6

NUMERIC_BASE = ["crs_dep_time", "crs_arr_time", "crs_elapsed_time", "distance"]
BASE_FEATURES = ["fl_date", "airline_code", "origin", "dest", "crs_dep_time", "crs_arr_time",
                 "crs_elapsed_time", "distance"]
NUMERICAL = ["crs_dep_time", "crs_arr_time", "crs_elapsed_time", "distance",
             "crs_dep_hour", "crs_arr_hour", "planned_speed", "avg_delay_per_hour"]
CATEGORICAL = ["airline_code", "origin", "dest", "month", "day_of_week", "is_weekend",
               "season", "is_holiday_month", "time_of_day", "flight_type", "route"]
LEAKAGE_PRESENT = ["cancelled", "diverted", "dep_delay", "cancellation_code"]


def r(expr: str, digits: int = DIGITS) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def _hour(col: str) -> str:
    return (f"cast(case when floor({col} / 100e0) = 24 then 0 "
            f"else floor({col} / 100e0) end as int)")


def _features(src: str) -> str:
    return f"""select *,
    cast(case when crs_dep_hour > -1 and crs_dep_hour <= 5 then 0
              when crs_dep_hour > 5 and crs_dep_hour <= 11 then 1
              when crs_dep_hour > 11 and crs_dep_hour <= 18 then 2
              when crs_dep_hour > 18 and crs_dep_hour <= 25 then 3 end as int) as time_of_day
  from (select *,
    cast(month(fl_date) as int) as month,
    cast(isodow(fl_date) - 1 as int) as day_of_week,
    cast(case when isodow(fl_date) - 1 >= 5 then 1 else 0 end as int) as is_weekend,
    cast(case when month(fl_date) in (12, 1, 2) then 1 when month(fl_date) in (3, 4, 5) then 2
              when month(fl_date) in (6, 7, 8) then 3 else 4 end as int) as season,
    cast(case when month(fl_date) in (7, 8, 12) then 1 else 0 end as int) as is_holiday_month,
    {_hour('crs_dep_time')} as crs_dep_hour,
    origin || '_' || dest as route,
    case when distance > -1 and distance <= 500 then 0e0
         when distance > 500 and distance <= 1500 then 1e0
         when distance > 1500 then 2e0 end as flight_type,
    {_hour('crs_arr_time')} as crs_arr_hour,
    distance / (crs_elapsed_time + 0.001) as planned_speed
  from {src})"""


def _not_null(cols) -> str:
    return " and ".join(f"{c} is not null" for c in cols)


def _zflag(i: int, c: str, t: float = 2.0) -> str:
    return f"coalesce(abs((t.{c} - o.m{i}) / nullif(o.s{i}, 0)) > {t}, false)"


def stage_ctes() -> str:
    ost = ", ".join(f"avg({c}) as m{i}, stddev_samp({c}) as s{i}"
                    for i, c in enumerate(NUMERIC_BASE))
    oflag = " or ".join(_zflag(i, c) for i, c in enumerate(NUMERIC_BASE))
    cat_union = ", ".join(CATEGORICAL)
    code_parts = " union all ".join(
        f"select '{c}' as feature, cast(v as varchar) as value, "
        f"cast(row_number() over (order by v) - 1 as int) as code "
        f"from (select distinct {c} as v from cat_union where {c} is not null)"
        for c in CATEGORICAL)
    std_agg = ", ".join(f"avg({c}) as m{i}, stddev_pop({c}) as s{i}"
                        for i, c in enumerate(NUMERICAL))
    std_rows = " union all ".join(
        f"select '{c}' as feature, m{i} as mean, "
        f"case when s{i} = 0 or s{i} is null then 1e0 else s{i} end as scale from std_agg"
        for i, c in enumerate(NUMERICAL))
    enc_cols = ", ".join(f"cast(c_{c}.code as int) as {c}" for c in CATEGORICAL)
    enc_joins = " ".join(
        f"left join (select value, code from codes where feature = '{c}') c_{c} "
        f"on cast(f.{c} as varchar) = c_{c}.value" for c in CATEGORICAL)
    num_keep = ", ".join(f"f.{c}" for c in NUMERICAL)
    mm_agg = ", ".join(f"min(cast({c} as double)) as lo{i}, max(cast({c} as double)) as hi{i}"
                       for i, c in enumerate(CATEGORICAL))
    mm_rows = " union all ".join(
        f"select '{c}' as feature, lo{i} as mean, "
        f"case when hi{i} - lo{i} = 0 or hi{i} is null then 1e0 else hi{i} - lo{i} end as scale "
        f"from mm_agg" for i, c in enumerate(CATEGORICAL))
    scaled = ", ".join(
        [f"(cast({c} as double) - (select mean from std_params where feature = '{c}')) / "
         f"(select scale from std_params where feature = '{c}') as {c}" for c in NUMERICAL]
        + [f"(cast({c} as double) - (select mean from mm_params where feature = '{c}')) / "
           f"(select scale from mm_params where feature = '{c}') as {c}" for c in CATEGORICAL])
    return f"""{flights_sql_ctes()},
completed as (select * from flights_v where cancelled = 0 and diverted = 0),
clipped as (select * replace (case when arr_delay < 0 then 0e0 else arr_delay end as arr_delay)
            from completed),
cls as (select count(*) as n_all,
               cast(sum(case when arr_delay > 0 then 1 else 0 end) as bigint) as n_pos,
               cast(sum(case when arr_delay = 0 then 1 else 0 end) as bigint) as n_neg
        from clipped),
bal_rank as (select *, row_number() over (
               partition by arr_delay > 0
               order by md5('balance:42:' || cast(row_id as varchar)), row_id) as _br
             from clipped where arr_delay >= 0),
balanced as (select * exclude (_br) from bal_rank
             where _br <= (select least(n_pos, n_neg) from cls)),
split_rank as (select *, row_number() over (
                 order by md5('split:42:' || cast(row_id as varchar)), row_id) as _sr
               from balanced),
n_test as (select cast(ceil(0.2e0 * count(*)) as bigint) as n from balanced),
test0 as (select * exclude (_sr) from split_rank where _sr <= (select n from n_test)),
train0 as (select * exclude (_sr) from split_rank where _sr > (select n from n_test)),
train1 as (select * exclude ({', '.join(LEAKAGE_PRESENT)}) from train0),
test1 as (select * exclude ({', '.join(LEAKAGE_PRESENT)}) from test0),
train2 as (select * from train1 qualify row_number() over (
             partition by {', '.join(BASE_FEATURES)} order by row_id) = 1),
train3 as (select * from train2 where {_not_null(BASE_FEATURES)}),
test3 as (select * from test1 where {_not_null(BASE_FEATURES)}),
ostats as (select {ost} from train3),
train4 as (select t.* from train3 t, ostats o where not ({oflag})),
ftrain0 as ({_features('train4')}),
ftest0 as ({_features('test3')}),
hmap as (select crs_dep_hour, avg(arr_delay) as avg_delay_per_hour from ftrain0
         where crs_dep_hour is not null group by crs_dep_hour),
hdef as (select coalesce(avg(avg_delay_per_hour), 0e0) as d from hmap),
ftrain as (select f.*, coalesce(h.avg_delay_per_hour, (select d from hdef)) as avg_delay_per_hour
           from ftrain0 f left join hmap h on f.crs_dep_hour = h.crs_dep_hour),
ftest as (select f.*, coalesce(h.avg_delay_per_hour, (select d from hdef)) as avg_delay_per_hour
          from ftest0 f left join hmap h on f.crs_dep_hour = h.crs_dep_hour),
cat_union as (select {cat_union} from ftrain union all select {cat_union} from ftest),
codes as ({code_parts}),
etrain as (select f.row_id, f.fl_date, f.arr_delay, {num_keep}, {enc_cols} from ftrain f {enc_joins}),
etest as (select f.row_id, f.fl_date, f.arr_delay, {num_keep}, {enc_cols} from ftest f {enc_joins}),
std_agg as (select {std_agg} from etrain),
std_params as ({std_rows}),
mm_agg as (select {mm_agg} from etrain),
mm_params as ({mm_rows}),
ptrain as (select row_id, fl_date, arr_delay, {scaled} from etrain),
ptest as (select row_id, fl_date, arr_delay, {scaled} from etest)"""


def with_stages(select: str) -> str:
    return f"with {stage_ctes()}\n{select}"


def with_flights(select: str) -> str:
    return f"with {flights_sql_ctes()}\n{select}"
