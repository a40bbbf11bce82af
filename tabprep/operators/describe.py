"""Descriptive statistics over whole tables (no row caps).

All per-column work stacks the columns into ``(k, x)`` pairs with one
``inline(array(struct...))`` projection, so a table is scanned once per pass
whatever the number of columns.

Exact quantiles (linear interpolation, ``pos = p * (n - 1)``) use distributed
selection instead of an in-memory percentile buffer: each pass counts rows
per value bucket (at most 4,096 buckets per pending interval, partial
aggregation) and narrows every wanted rank to one bucket; a bucket holding one
value answers directly, a small one is fetched as distinct ``(value, count)``
pairs. Memory stays bounded by the bucket table whatever the row count or the
skew (a value held by a third of the rows is one bucket with min = max).
"""

from __future__ import annotations

import datetime
import math
import sys
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
# driver-side bounds per selection pass: rows of the bucket table and
# (value, count) pairs fetched, summed over all pending intervals
TABLE_ROWS = 262_144
FETCH_ROWS = 100_000
#: Part of a bin's width by which a value may lie below an edge and still be on it.
EDGE = 1e-9
MAX_DOUBLE = sys.float_info.max


def _num(c: str) -> Column:
    """The column as a double with NaN treated as missing (as pandas does)."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def stacked(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``k`` (column index), ``x`` (double) rows for the non-missing values."""
    structs = [F.struct(F.lit(i).alias("k"), _num(c).alias("x"))
               for i, c in enumerate(cols)]
    return (df.select(*keep, F.inline(F.array(*structs)))
            .where(F.col("x").isNotNull()))


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict:
    """count, mean, sample std, min, max per column: one grouped aggregate over
    the stacked ``(k, x)`` rows (five aggregate functions whatever the number
    of columns, so the plan stays small; partial aggregation leaves one row
    per column per partition)."""
    rows = (stacked(df, cols).groupBy("k")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"),
                 F.stddev_samp("x").alias("s"), F.min("x").alias("lo"),
                 F.max("x").alias("hi")).collect())
    by_k = {r["k"]: r for r in rows}
    out = {}
    for i, c in enumerate(cols):
        r = by_k.get(i)
        out[c] = (dict(n=r["n"], mean=r["m"], std=r["s"], min=r["lo"], max=r["hi"]) if r
                  else dict(n=0, mean=None, std=None, min=None, max=None))
    return out


def _select_ranks(df: DataFrame, cols: Sequence[str], wanted: dict, stats: dict) -> dict:
    """Value at each wanted 0-based rank: ``wanted[k] = set(ranks)`` ->
    ``{(k, rank): value}``."""
    data = stacked(df, cols)
    # pending[(k, lo, hi, before)] = ranks inside that closed interval
    pending = {}
    for k, ranks in wanted.items():
        st = stats[cols[k]]
        if ranks:
            pending[(k, st["min"], st["max"], 0)] = sorted(ranks)
    result = {}
    while pending:
        to_fetch, to_split = {}, {}
        for iv, ranks in pending.items():
            k, lo, hi, before = iv
            if lo == hi:
                for r in ranks:
                    result[(k, r)] = lo
            else:
                to_split[iv] = ranks
        if not to_split:
            break
        # at most TABLE_ROWS / 2 intervals a pass, so the bucket table is bounded
        ivs = list(to_split)[: TABLE_ROWS // 2]
        waiting = {iv: to_split[iv] for iv in list(to_split)[TABLE_ROWS // 2:]}
        n_buckets = min(BUCKETS, max(2, TABLE_ROWS // len(ivs)))
        tagged = _tag_intervals(data, ivs)
        # infinities get buckets of their own; a range too wide for a double is halved
        lo, hi = F.greatest("_lo", F.lit(-MAX_DOUBLE)), F.least("_hi", F.lit(MAX_DOUBLE))
        wide = hi - lo
        part = F.when(wide <= F.lit(MAX_DOUBLE), (F.col("x") - lo) / wide).otherwise(
            (F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2))
        bucket = (F.when(F.col("x") == float("inf"), F.lit(n_buckets))
                  .when(F.col("x") == float("-inf"), F.lit(-1))
                  .otherwise(F.least(F.floor(part * F.lit(n_buckets)), F.lit(n_buckets - 1))))
        rows = (tagged.groupBy("iv", bucket.alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("bmin"),
                     F.max("x").alias("bmax")).collect())
        by_iv = {}
        for r in rows:
            by_iv.setdefault(r["iv"], []).append(r)
        nxt = waiting
        fetched = 0
        for j, iv in enumerate(ivs):
            k, _, _, before = iv
            run = before
            buckets = sorted(by_iv.get(j, []), key=lambda r: r["b"])
            ranks = list(to_split[iv])
            for r in buckets:
                inside = [q for q in ranks if run <= q < run + r["n"]]
                if inside:
                    child = (k, r["bmin"], r["bmax"], run)
                    if r["bmin"] == r["bmax"]:
                        for q in inside:
                            result[(k, q)] = r["bmin"]
                    elif fetched + r["n"] <= FETCH_ROWS:
                        # small enough to rank on the driver, within the
                        # pass's total budget; the rest is refined again
                        to_fetch[child] = inside
                        fetched += r["n"]
                    else:
                        nxt[child] = inside
                run += r["n"]
        if to_fetch:
            _fetch(data, to_fetch, result)
        pending = nxt
    return result


def _tag_intervals(data: DataFrame, ivs: list) -> DataFrame:
    """Rows of ``data`` (``k, x``) inside one of the pending closed value
    intervals ``(k, lo, hi, _)``, with its index ``iv`` and bounds ``_lo``,
    ``_hi``. Intervals of one column are disjoint (they are distinct value
    buckets), so a row matches at most one. The interval table has at most
    (columns x wanted ranks) rows: a broadcast of proven size, joined on the
    column index with the range as a join condition."""
    table = data.sparkSession.createDataFrame(
        [(j, int(k), float(lo), float(hi)) for j, (k, lo, hi, _) in enumerate(ivs)],
        "iv int, _k int, _lo double, _hi double")
    cond = ((data["k"] == table["_k"]) & (data["x"] >= table["_lo"])
            & (data["x"] <= table["_hi"]))
    return data.join(F.broadcast(table), cond).drop("_k")


def _fetch(data: DataFrame, intervals: dict, result: dict) -> None:
    """Distinct (value, count) pairs of small intervals, ranked on the driver."""
    ivs = list(intervals)
    rows = (_tag_intervals(data, ivs)
            .groupBy("iv", "x").agg(F.count(F.lit(1)).alias("n")).collect())
    by_iv = {}
    for r in rows:
        by_iv.setdefault(r["iv"], []).append((r["x"], r["n"]))
    for j, iv in enumerate(ivs):
        k, _, _, before = iv
        run = before
        for x, n in sorted(by_iv.get(j, [])):
            for q in intervals[iv]:
                if run <= q < run + n:
                    result[(k, q)] = x
            run += n


def _lerp(a: float, b: float, t: float) -> float:
    return a if t == 0 or a == b else a + (b - a) * t


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    stats: dict | None = None) -> dict:
    """``{col: [quantile per prob]}``, linear interpolation between order
    statistics (the pandas/numpy default); NULLs ignored; empty -> None."""
    stats = stats or column_stats(df, cols)
    wanted = {}
    plan = {}
    for k, c in enumerate(cols):
        n = stats[c]["n"]
        if not n:
            continue
        for p in probs:
            pos = p * (n - 1)
            lo, hi = int(math.floor(pos)), int(math.ceil(pos))
            wanted.setdefault(k, set()).update({lo, hi})
            plan[(k, p)] = (lo, hi, pos - lo)
    values = _select_ranks(df, cols, wanted, stats) if wanted else {}
    out = {}
    for k, c in enumerate(cols):
        qs = []
        for p in probs:
            if (k, p) not in plan:
                qs.append(None)
                continue
            lo, hi, t = plan[(k, p)]
            qs.append(_lerp(values[(k, lo)], values[(k, hi)], t))
        out[c] = qs
    return out


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     accuracy: int = 10_000) -> dict:
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy)
                   .alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
            for i, c in enumerate(cols)}


def describe_table(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """A2: ``feature, count, mean, std, min, q25, q50, q75, max`` per column
    (sample std; quartiles by linear interpolation). The moments come from one
    grouped aggregate, the quartiles from the selection passes; the result is
    the one-row-per-column table Spark reduced the input to (no second scan)."""
    stats = column_stats(df, cols)
    probs = [0.25, 0.5, 0.75]
    q = approx_quantiles(df, cols, probs) if approx else exact_quantiles(df, cols, probs, stats)
    rows = [(c, int(stats[c]["n"]), _f(stats[c]["mean"]), _f(stats[c]["std"]),
             _f(stats[c]["min"]), _f(q[c][0]), _f(q[c][1]), _f(q[c][2]), _f(stats[c]["max"]))
            for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "feature string, count bigint, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")


def describe_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2 for date and timestamp columns: ``feature, count, mean, min, q25, q50,
    q75, max`` as timestamp texts (to the second, UTC), by the same passes over
    the days since 1970-01-01. A column without values has NULLs."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def days(c: str) -> Column:
        if isinstance(types[c], T.DateType):
            return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("double")
        return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(86_400e6)

    def text(v: float | None) -> str | None:
        if v is None:
            return None
        moment = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=round(v * 86_400))
        return moment.strftime("%Y-%m-%d %H:%M:%S")

    numbers = df.select(*[days(c).alias(c) for c in cols])
    stats = column_stats(numbers, cols)
    q = exact_quantiles(numbers, cols, [0.25, 0.5, 0.75], stats)
    rows = [(c, int(stats[c]["n"]), *map(text, (stats[c]["mean"], stats[c]["min"], *q[c], stats[c]["max"])))
            for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "feature string, count bigint, mean string, min string, q25 string, q50 string, q75 string, max string")


def _f(v) -> float | None:
    return None if v is None else float(v)


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """A3: ``feature, bin, lo, hi, n`` - equal-width bins from min to max, the
    last one closed on the right, empty bins included (n = 0). A constant
    column spans ``[v - 0.5, v + 0.5]``. Infinite values have no bin and are left
    out; a column without finite values has no rows."""
    finite = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c) for c in cols]
    df = df.select(*finite)
    stats = column_stats(df, cols)
    live = [(k, c) for k, c in enumerate(cols) if stats[c]["n"]]
    if not live:
        return df.sparkSession.createDataFrame([], "feature string, bin int, lo double, hi double, n bigint")
    lo_l, hi_l = [], []
    for _, c in live:
        lo, hi = stats[c]["min"], stats[c]["max"]
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        lo_l.append(lo)
        hi_l.append(hi)
    ks = [k for k, _ in live]
    idx = F.array_position(F.array(*[F.lit(k) for k in ks]), F.col("k")).cast("int")
    lo_c = F.element_at(F.array(*[F.lit(float(v)) for v in lo_l]), idx)
    hi_c = F.element_at(F.array(*[F.lit(float(v)) for v in hi_l]), idx)
    # a value on an edge belongs to the bin that begins there, whatever rounding did to it
    b = F.least(F.floor((F.col("x") - lo_c) / (hi_c - lo_c) * F.lit(bins) + F.lit(EDGE)), F.lit(bins - 1))
    counts = (stacked(df, cols).where(F.col("k").isin(ks))
              .groupBy("k", b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    grid_rows = [F.struct(F.lit(k).alias("k"), F.lit(cols[k]).alias("feature"),
                          F.lit(float(lo)).alias("f_lo"), F.lit(float(hi)).alias("f_hi"))
                 for k, lo, hi in zip(ks, lo_l, hi_l)]
    # every (feature, bin) cell, so empty bins are reported too
    grid = (df.sparkSession.range(1).select(F.inline(F.array(*grid_rows)))
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))))
    width = (F.col("f_hi") - F.col("f_lo")) / F.lit(bins)
    return (grid.join(counts, ["k", "bin"], "left")
            .select("feature", "bin",
                    (F.col("f_lo") + F.col("bin") * width).alias("lo"),
                    (F.col("f_lo") + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: ``a, b, r, n`` for every ordered pair, Pearson over the pairwise
    complete rows; a constant column gives NULL (not an error).

    Tasks reduce their rows to p x p sums (an Arrow pass of numpy products over
    masked, centred columns), a grouped sum merges them and r is a column
    expression over the p x p result. Columns are centred at their mean (a
    constant one at its value), so the sums keep their digits. A pair with no
    complete row has ``n = 0`` and ``r`` NULL."""
    spark = df.sparkSession
    stats = column_stats(df, cols)
    shift = [0.0 if s["mean"] is None or not math.isfinite(s["mean"]) else
             s["min"] if s["min"] == s["max"] else s["mean"] for s in (stats[c] for c in cols)]
    p = len(cols)

    def products(batches):
        sums = np.zeros((4, p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            mask = (~np.isnan(x)).astype(float)
            x = np.where(mask > 0, x - np.array(shift), 0.0)
            sums += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        i, j = np.indices((p, p))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), **{k: sums[q].ravel() for q, k in enumerate(
            ["n", "sx", "sxx", "sxy"])}}).astype({"i": "int32", "j": "int32"})

    parts = df.select(*[_num(c).alias(f"_x{i}") for i, c in enumerate(cols)]).mapInPandas(
        products, "i int, j int, n double, sx double, sxx double, sxy double")
    total = parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in ["n", "sx", "sxx", "sxy"]])
    other = total.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("sx").alias("sy"),
                         F.col("sxx").alias("syy"))
    both = total.join(other, ["i", "j"])

    def spread(square: str, plain: str) -> Column:
        # what rounding leaves of a constant column's squares is no spread
        v = F.col(square) - F.try_divide(F.col(plain) * F.col(plain), F.col("n"))
        return F.when(v > F.col(square) * 1e-13, v)

    r = (F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))) / F.sqrt(
        spread("sxx", "sx") * spread("syy", "sy"))
    names = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)],
                                  "i int, j int, a string, b string")
    return (names.join(both, ["i", "j"], "left")
            .select("a", "b", r.alias("r"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def box_stats(df: DataFrame, cols: Sequence[str], whis: float = 1.5) -> DataFrame:
    """A5: ``feature, q1, med, q3, lo_whisker, hi_whisker, n_out``. Whiskers
    are the most extreme data points within ``whis * IQR`` of the quartiles.
    After the quartiles, one grouped aggregate over the stacked ``(k, x)``
    rows finds the whiskers and outlier counts of every column (the fences
    are literals picked by the column index)."""
    stats = column_stats(df, cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], stats)
    live = [k for k, c in enumerate(cols) if q[c][0] is not None]
    found = {}
    if live:
        fences = {k: (q[cols[k]][0] - whis * (q[cols[k]][2] - q[cols[k]][0]),
                      q[cols[k]][2] + whis * (q[cols[k]][2] - q[cols[k]][0])) for k in live}
        idx = F.array_position(F.array(*[F.lit(k) for k in live]), F.col("k")).cast("int")
        lo_f = F.element_at(F.array(*[F.lit(float(fences[k][0])) for k in live]), idx)
        hi_f = F.element_at(F.array(*[F.lit(float(fences[k][1])) for k in live]), idx)
        x = F.col("x")
        rows = (stacked(df, cols).where(F.col("k").isin(live))
                .groupBy("k")
                .agg(F.min(F.when(x >= lo_f, x)).alias("lw"), F.max(F.when(x <= hi_f, x)).alias("hw"),
                     F.count(F.when((x < lo_f) | (x > hi_f), 1)).alias("no"))
                .collect())
        found = {r["k"]: r for r in rows}
    out = []
    for k, c in enumerate(cols):
        r = found.get(k)
        out.append((c, _f(q[c][0]), _f(q[c][1]), _f(q[c][2]), _f(r["lw"]) if r else None,
                    _f(r["hw"]) if r else None, int(r["no"]) if r else 0))
    return df.sparkSession.createDataFrame(
        out, "feature string, q1 double, med double, q3 double, lo_whisker double, "
             "hi_whisker double, n_out bigint")


def density(df: DataFrame, cols: Sequence[str], grid: int = 200, cut: float = 3.0,
            bw_adjust: float = 1.0) -> DataFrame:
    """``feature, i, x, density`` - Gaussian kernel density on ``grid``
    points from ``min - cut*bw`` to ``max + cut*bw``; Scott bandwidth
    ``std * n ** (-1/5)`` (sample std). Each task adds up its rows' terms (an
    Arrow pass) and only ``grid`` sums per column and task are shuffled. Columns
    with fewer than 2 values or without a finite, positive spread get no curve."""
    stats = column_stats(df, cols)
    live = []
    for k, c in enumerate(cols):
        s = stats[c]
        if s["n"] and s["n"] >= 2 and s["std"] and math.isfinite(s["std"]):
            bw = s["std"] * s["n"] ** (-1.0 / 5.0) * bw_adjust
            lo, hi = s["min"] - cut * bw, s["max"] + cut * bw
            live.append((k, c, bw, lo, (hi - lo) / (grid - 1), s["n"]))
    if not live:
        return df.sparkSession.createDataFrame(
            [], "feature string, i int, x double, density double")
    curves = {k: (bw, lo + np.arange(grid) * step) for k, _, bw, lo, step, _ in live}

    def terms(batches):
        sums = {k: np.zeros(grid) for k in curves}
        for pdf in batches:
            for k, xs in pdf.groupby("k")["x"]:
                if k not in curves:
                    continue
                bw, gx = curves[k]
                values, n = np.unique(xs.to_numpy(), return_counts=True)
                for a in range(0, len(values), 2000):
                    z = (gx[None, :] - values[a: a + 2000, None]) / bw
                    sums[k] += n[a: a + 2000] @ np.exp(-0.5 * z * z)
        yield pd.DataFrame({"k": np.repeat(list(sums), grid), "i": np.tile(np.arange(grid), len(sums)),
                            "d": np.concatenate(list(sums.values()))}).astype({"k": "int32", "i": "int32"})

    parts = stacked(df, cols).mapInPandas(terms, "k int, i int, d double")
    scale = df.sparkSession.createDataFrame(
        [(k, c, float(lo), float(step), 1.0 / (n * bw * math.sqrt(2 * math.pi))) for k, c, bw, lo, step, n in live],
        "k int, feature string, lo double, step double, norm double")
    return (parts.groupBy("k", "i").agg(F.sum("d").alias("d")).join(F.broadcast(scale), "k")
            .select("feature", "i", (F.col("lo") + F.col("i") * F.col("step")).alias("x"),
                    (F.col("d") * F.col("norm")).alias("density")))
