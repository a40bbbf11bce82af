"""Column functions for the scalar features."""

from tabprep.functions.features import (  # noqa: F401
    cut,
    day_of_week,
    flight_date,
    flight_type,
    floor_div,
    hour_of,
    is_holiday_month,
    is_weekend,
    month_of,
    planned_speed,
    replace_value,
    route,
    season,
    time_of_day,
)
