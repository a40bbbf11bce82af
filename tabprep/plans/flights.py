"""The flight-delay plan, end to end, as functions over DataFrames.

Stages (each returns new DataFrames; nothing is mutated):

1. ``load_and_split``  P1 completed -> P2 clip -> P9 classes -> M1 balance -> M4 split
2. ``clean``           P3 leakage -> C1 duplicates (train) -> C7 nulls -> C10 outliers (train)
3. ``add_features``    F1-F11, then E4 fitted on train and applied to both
4. ``preprocess``      E1 codes (train ∪ test), E2 standard, E3 min-max (fitted on train)

Stage outputs that later stages read several times are written to the
checkpoint folder (``materialize``): the balanced set, the cleaned and
feature-engineered splits (the first checkpoint) and the preprocessed splits
(the second). Flight column names live only in this module.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.operators import cleaning, encoding, features, filters, sampling
from tabprep.session import materialize
from tabprep.sources.readers import REQUIRED_COLUMNS, require_columns
from tabprep.splits import Splits

KEY = "row_id"
LABEL = "arr_delay"
SEED = 42
TEST_SIZE = 0.2
OUTLIER_THRESHOLD = 2.0

# The model columns of the studied pipeline (8 numeric, 11 categorical).
NUMERICAL = ["crs_dep_time", "crs_arr_time", "crs_elapsed_time", "distance",
             "crs_dep_hour", "crs_arr_hour", "planned_speed", "avg_delay_per_hour"]
CATEGORICAL = ["airline_code", "origin", "dest", "month", "day_of_week", "is_weekend",
               "season", "is_holiday_month", "time_of_day", "flight_type", "route"]
FEATURES = NUMERICAL + CATEGORICAL


class LoadInfo(NamedTuple):
    n_completed: int
    n_positive: int
    n_zero: int
    n_balanced: int
    n_train: int
    n_test: int


def load_and_split(df: DataFrame, seed: int = SEED, test_size: float = TEST_SIZE,
                   keep: bool = True) -> tuple[Splits, LoadInfo]:
    """Stage 1. Raises typed errors on a missing column, an empty table, no
    completed flights, or an empty class."""
    from tabprep.errors import EmptyInputError

    require_columns(df, REQUIRED_COLUMNS)
    # one aggregate gives the raw size, the completed size, the class sizes
    # and the balance-order prefix histograms (the clip commutes with P1)
    done = (F.col("cancelled") == 0) & (F.col("diverted") == 0)
    counts, hist = sampling.class_prefix_counts(
        filters.clip_lower(df, LABEL, 0.0), LABEL, KEY, seed, "balance", scope=done)
    if counts["raw"] == 0:
        raise EmptyInputError("the loaded table has no rows")
    clipped = filters.clip_lower(filters.keep_completed(df), LABEL, 0.0)
    if counts["all"] == 0:
        raise EmptyInputError("no rows left after removing cancelled and diverted flights")
    if keep:
        # write the rows that can be in the balanced set (known from the
        # histograms), then find the exact boundary on the written rows: two
        # reads of the source instead of three or more
        superset = materialize(sampling.balance_superset(
            clipped, LABEL, KEY, seed, counts, hist), "balanced")
        balanced = sampling.balance_classes(superset, LABEL, KEY, seed, counts=counts, hist=hist)
    else:
        balanced = sampling.balance_classes(clipped, LABEL, KEY, seed, counts=counts, hist=hist)
    n = 2 * min(counts["pos"], counts["neg"])
    splits = sampling.train_test_split(balanced, test_size, KEY, seed, n=n)
    n_train, n_test = sampling.split_sizes(n, test_size)
    return splits, LoadInfo(counts["all"], counts["pos"], counts["neg"], n, n_train, n_test)


def clean(splits: Splits, threshold: float = OUTLIER_THRESHOLD, keep: bool = True) -> Splits:
    """Stage 2, in the order that matters: leakage columns go before null
    dropping (they are empty for most completed flights). With ``keep`` the
    deduplicated, complete rows are written, so that the outlier statistics and
    all later passes read them instead of shuffling the duplicates again."""
    s = splits.map(filters.drop_leakage)
    feats = filters.feature_columns(s.train, KEY, LABEL)
    s = Splits(cleaning.drop_duplicate_rows(s.train, feats, KEY, LABEL), s.test)
    s = cleaning.fill_missing(s, "drop", key=KEY, label=LABEL)
    if keep:
        s = checkpoint(s, "complete")
    return cleaning.remove_outliers(s, threshold, key=KEY, label=LABEL)


def add_features(splits: Splits) -> tuple[Splits, features.TargetMean]:
    """Stage 3: features on both splits; the hour map is fitted on train."""
    eng = splits.map(features.engineer_features)
    hour_map = features.fit_target_mean(eng.train, "crs_dep_hour", LABEL, "avg_delay_per_hour")
    return eng.map(lambda d: features.apply_target_mean(d, hour_map)), hour_map


def checkpoint(splits: Splits, name: str) -> Splits:
    return splits.map(lambda d: materialize(d, name))


def preprocess(splits: Splits):
    """Stage 4: encode, then scale; returns ``(Splits, Preprocessor)``."""
    return encoding.preprocess(splits, NUMERICAL, CATEGORICAL)


class FlightRun(NamedTuple):
    loaded: Splits
    cleaned: Splits
    featured: Splits
    preprocessed: Splits | None
    info: LoadInfo
    hour_map: features.TargetMean
    prep: encoding.Preprocessor | None


def run_flights(df: DataFrame, through: str = "preprocess", keep: bool = True) -> FlightRun:
    """Run the stages up to ``through`` (``features`` or ``preprocess``)."""
    loaded, info = load_and_split(df, keep=keep)
    cleaned = clean(loaded, keep=keep)
    featured, hour_map = add_features(cleaned)
    if keep:
        featured = checkpoint(featured, "cleaned")
    pre, prep = (None, None)
    if through == "preprocess":
        pre, prep = preprocess(featured)
        if keep:
            pre = checkpoint(pre, "preprocessed")
    return FlightRun(loaded, cleaned, featured, pre, info, hour_map, prep)


def flights_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabprep.sources.fixtures import flights_view
    return flights_view(spark, sf_dir)
