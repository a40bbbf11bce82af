"""Scalar feature functions (Column in, Column out).

Each is a built-in expression (``when`` chains, ``floor``, ``concat``), so the
whole feature stage is one projection inside whole-stage codegen. A NULL input
makes a condition false, so flags become 0 and the season becomes 4.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def flight_date(c: Column, lenient: bool = False) -> Column:
    """text or timestamp to date. Bad text raises (ANSI) unless lenient."""
    return F.try_to_date(c) if lenient else F.to_date(c)


def month_of(d: Column) -> Column:
    """month 1-12."""
    return F.month(d)


def day_of_week(d: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(d)


def is_weekend(dow: Column) -> Column:
    """1 for Saturday/Sunday (day >= 5), else 0."""
    return F.when(dow >= 5, 1).otherwise(0)


# Month -> season (1 = Dec-Feb, 2 = Mar-May, 3 = Jun-Aug, else 4)
# and the holiday months.
WINTER_MONTHS = [12, 1, 2]
SPRING_MONTHS = [3, 4, 5]
SUMMER_MONTHS = [6, 7, 8]
HOLIDAY_MONTHS = [7, 8, 12]


def season(month: Column) -> Column:
    """1 winter, 2 spring, 3 summer, 4 otherwise (NULL -> 4)."""
    return (F.when(month.isin(WINTER_MONTHS), 1)
            .when(month.isin(SPRING_MONTHS), 2)
            .when(month.isin(SUMMER_MONTHS), 3)
            .otherwise(4))


def is_holiday_month(month: Column) -> Column:
    """1 in July, August, December, else 0."""
    return F.when(month.isin(HOLIDAY_MONTHS), 1).otherwise(0)


def floor_div(c: Column, n: int) -> Column:
    """floor division (not a truncating cast)."""
    return F.floor(c / F.lit(float(n)))


def replace_value(c: Column, old, new) -> Column:
    """one value replaced by another, everything else kept."""
    return F.when(c == F.lit(old), F.lit(new)).otherwise(c)


def hour_of(hhmm: Column) -> Column:
    """hour of an hhmm clock value, 24 -> 0."""
    return replace_value(floor_div(hhmm, 100), 24, 0).cast("int")


def cut(c: Column, edges: Sequence[float], labels: Sequence | None = None,
        right: bool = True) -> Column:
    """general binning on ``edges``; right-closed ``(a, b]`` by default.
    Bin i gets ``labels[i]`` (default i); values outside every bin, and NULL,
    get NULL."""
    labels = list(range(len(edges) - 1)) if labels is None else list(labels)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = F.lit(edges[i]), F.lit(edges[i + 1])
        inside = (c > lo) & (c <= hi) if right else (c >= lo) & (c < hi)
        expr = F.when(inside, F.lit(labels[i])) if expr is None else expr.when(
            inside, F.lit(labels[i]))
    return expr


# Time-of-day bins (-1,5] (5,11] (11,18] (18,25] -> 0..3.
TIME_OF_DAY_EDGES = [-1, 5, 11, 18, 25]


def time_of_day(hour: Column) -> Column:
    """F8: 0 night, 1 morning, 2 afternoon, 3 evening; NULL outside."""
    return cut(hour, TIME_OF_DAY_EDGES).cast("int")


def route(origin: Column, dest: Column) -> Column:
    """``ORIGIN_DEST``; NULL when either side is NULL (``concat``, not
    ``concat_ws``)."""
    return F.concat(origin, F.lit("_"), dest)


# Distance classes (-1,500] -> 0, (500,1500] -> 1, above -> 2.
SHORT_HAUL_MAX = 500
MEDIUM_HAUL_MAX = 1500


def flight_type(distance: Column) -> Column:
    """0 short, 1 medium, 2 long haul, as a double; the top class has no
    upper edge (every value is below the maximum plus one)."""
    return (F.when((distance > -1) & (distance <= SHORT_HAUL_MAX), 0.0)
            .when((distance > SHORT_HAUL_MAX) & (distance <= MEDIUM_HAUL_MAX), 1.0)
            .when(distance > MEDIUM_HAUL_MAX, 2.0)
            .cast("double"))


def planned_speed(distance: Column, elapsed: Column) -> Column:
    """distance per planned minute, ``distance / (elapsed + 0.001)``."""
    return F.try_divide(distance, elapsed + F.lit(0.001))
