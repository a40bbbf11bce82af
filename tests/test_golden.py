"""Golden counts and statistics of the flight plan (FIXTURES.md, sf 0.001)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.operators import describe, features, hypothesis


def test_stage_counts(run001, flights001):
    info = run001.info
    assert flights001.count() == 1529
    assert info.n_completed == 1483
    assert (info.n_positive, info.n_zero) == (353, 1104)
    assert info.n_balanced == 706
    assert (run001.loaded.train.count(), run001.loaded.test.count()) == (564, 142)
    assert run001.cleaned.train.count() == 504
    assert run001.cleaned.test.count() == 135
    assert run001.preprocessed.train.count() == 504


def test_splits_disjoint_and_complete(run001):
    tr = {r[0] for r in run001.loaded.train.select("row_id").collect()}
    te = {r[0] for r in run001.loaded.test.select("row_id").collect()}
    assert not tr & te
    assert len(tr | te) == 706


def test_kruskal_airline(run001):
    k = hypothesis.kruskal_table(run001.featured.train, ["airline_code"], "arr_delay").first()
    assert k["df"] == 4
    assert k["statistic"] == pytest.approx(3.448745, abs=1e-5)


def test_hour_means(run001):
    hm = run001.hour_map
    assert hm.n_keys == 24
    assert hm.default == pytest.approx(259.525924, abs=1e-5)
    row_mean = run001.featured.train.agg(F.avg("arr_delay")).first()[0]
    assert row_mean == pytest.approx(257.505952, abs=1e-5)


def test_welch_holiday(run001):
    w = hypothesis.welch_table(run001.featured.train, ["is_holiday_month"], "arr_delay").first()
    assert w["statistic"] == pytest.approx(0.65579, abs=1e-5)
    assert w["df"] == pytest.approx(207.8044, abs=1e-3)


def test_density_area_peak(run001):
    d = describe.density(run001.cleaned.train, ["crs_elapsed_time"]).orderBy("i").toPandas()
    x, y = d["x"].to_numpy(), d["density"].to_numpy()
    area = float(np.sum((y[1:] + y[:-1]) / 2 * np.diff(x)))
    assert area == pytest.approx(0.99998, abs=1e-5)
    assert y.max() == pytest.approx(0.0068858, abs=1e-7)
