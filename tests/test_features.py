"""Edge rows for the scalar features and filters."""

import datetime as dt

from pyspark.sql import functions as F

from tabprep.functions import features as ff
from tabprep.operators import features, filters


def test_clock_bins_and_flags(spark):
    rows = [(1, "2024-01-01", 2400, 2359, 100.0, 60.0, "A", "B"),     # Monday, 24:00
            (2, "2024-07-06", 500, 559, 500.0, 0.0, "A", None),       # Saturday
            (3, "2024-12-01", 1159, 1800, 1500.0, None, None, "B"),   # Sunday
            (4, "2024-03-15", 1901, 600, 1500.01, 90.0, "C", "D")]
    df = spark.createDataFrame(rows, "row_id long, fl_date string, crs_dep_time int, "
                                     "crs_arr_time int, distance double, crs_elapsed_time double, "
                                     "origin string, dest string")
    out = {r["row_id"]: r for r in features.engineer_features(df).collect()}
    assert out[1]["crs_dep_hour"] == 0 and out[1]["crs_arr_hour"] == 23
    assert out[1]["day_of_week"] == 0 and out[1]["is_weekend"] == 0
    assert out[1]["season"] == 1 and out[1]["is_holiday_month"] == 0
    assert out[1]["time_of_day"] == 0            # hour 0 in (-1, 5]
    assert out[2]["time_of_day"] == 0            # hour 5 in (-1, 5]
    assert out[2]["day_of_week"] == 5 and out[2]["is_weekend"] == 1
    assert out[2]["season"] == 3 and out[2]["is_holiday_month"] == 1
    assert out[2]["route"] is None               # concat, not concat_ws
    assert out[2]["flight_type"] == 0.0          # 500 in (-1, 500]
    assert out[3]["time_of_day"] == 1            # 11 in (5, 11]
    assert out[3]["flight_type"] == 1.0          # 1500 in (500, 1500]
    assert out[3]["planned_speed"] is None
    assert out[4]["time_of_day"] == 3 and out[4]["flight_type"] == 2.0
    assert out[4]["season"] == 2
    assert out[1]["planned_speed"] == 100.0 / 60.001
    assert out[1]["fl_date"] == dt.date(2024, 1, 1)


def test_cut_right_closed_null_outside(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (5.5,), (25.0,), (26.0,), (None,)], "h double")
    got = [r[0] for r in df.select(ff.cut(F.col("h"), [-1, 5, 11, 18, 25])).collect()]
    assert got == [None, 0, 0, 1, 3, None, None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1, -3.0), (2, None), (3, 4.0)], "row_id long, y double")
    got = dict(filters.clip_lower(df, "y", 0.0).collect())
    assert got == {1: 0.0, 2: None, 3: 4.0}


def test_binary_label_and_completed(spark):
    df = spark.createDataFrame([(1, 15.0, 0, 0), (2, 15.5, 0, 0), (3, None, 1, 0), (4, 3.0, None, 0)],
                               "row_id long, y double, cancelled int, diverted int")
    assert [r[0] for r in filters.keep_completed(df).select("row_id").collect()] == [1, 2]
    got = dict(filters.binary_label(df, "y").select("row_id", "label_binary").collect())
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


def test_target_mean_unseen_hour(spark):
    train = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 60.0), (None, 99.0)], "crs_dep_hour int, arr_delay double")
    test = spark.createDataFrame([(1,), (3,)], "crs_dep_hour int")
    tm = features.fit_target_mean(train)
    assert tm.default == (15.0 + 60.0) / 2           # mean of hour means, null key not a group
    got = dict(features.apply_target_mean(test, tm).collect())
    assert got == {1: 15.0, 3: 37.5}


def test_drop_leakage_strict(spark):
    import pytest
    from tabprep.errors import MissingColumnsError
    df = spark.createDataFrame([(1, 2.0, 0)], "row_id long, dep_delay double, cancelled int")
    assert filters.drop_leakage(df).columns == ["row_id"]
    with pytest.raises(MissingColumnsError):
        filters.drop_leakage(df, strict=True)
