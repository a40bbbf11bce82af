"""PCA, LDA and labelled projections (R1-R3 are in :mod:`forest`).

Second moments (covariance, within-class scatter) come from two distributed
passes: every partition reduces its rows to ``n`` and ``sum x``, then to
``sum (x - mean)(x - mean)^T`` with numpy (``mapInPandas``); the
partials are summed by a grouped aggregate over their flattened entries, and
only the ``p x p`` result reaches the driver, where the small eigenproblem is
solved. Class means are a table that the rows are joined with, so the within-class
scatter is pooled inside the tasks whatever the number of classes, and the between-class
scatter is that of the table. Beyond ``WIDE`` features no ``p x p`` matrix is made:
a randomised range finder multiplies the rows with a sketch of a few columns, and the
driver sees ``p x k`` numbers. Scores are then a column
expression (a dot product with literal loadings), so projecting the whole
table needs no row cap and no further shuffle.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.operators.joins import sized_broadcast
from tabprep.session import materialize
from tabprep.operators.forest import fit_forest, permutation_importance  # noqa: F401 - R1-R3

#: Features beyond which no p x p matrix is made.
WIDE = 1024


def _vector_cols(df: DataFrame, features: Sequence[str] | str) -> list[Column]:
    """Feature columns as doubles; an array column expands to its elements."""
    if isinstance(features, str):
        size = df.select(F.size(features).alias("s")).where("s > 0").first()["s"]
        return [F.col(features)[i].cast("double").alias(f"_x{i}") for i in range(size)]
    return [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]


def _vector(df: DataFrame, features: Sequence[str] | str, group: str | None) -> DataFrame:
    """``_g, _v``: the group and the feature vector as one ``array<double>``,
    complete rows only (kept as one array column: a filter over dozens of
    derived columns makes the optimizer's constraint inference explode)."""
    if isinstance(features, str):
        v = F.transform(F.col(features), lambda x: x.cast("double"))
    else:
        v = F.array(*[F.col(c).cast("double") for c in features])
    g = F.col(group).cast("string") if group else F.lit("all")
    return (df.select(g.alias("_g"), v.alias("_v"))
            .where(F.col("_v").isNotNull() & F.col("_g").isNotNull()
                   & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x))))


class Moments(NamedTuple):
    groups: list
    n: dict          # group -> count
    mean: dict       # group -> (p,) mean
    scatter: dict    # group -> (p, p) sum of centred outer products


def _sum_partials(parts: DataFrame, col: str) -> dict:
    """Element-wise sum per group of per-partition arrays (grouped aggregate
    over the flattened entries; the driver receives groups x size numbers)."""
    rows = (parts.select("_g", F.posexplode(col).alias("pos", "v"))
            .groupBy("_g", "pos").agg(F.sum("v").alias("v")).collect())
    out = {}
    for r in rows:
        out.setdefault(r["_g"], {})[r["pos"]] = r["v"]
    return {g: np.array([d[i] for i in range(len(d))]) for g, d in out.items()}


def moments(df: DataFrame, features: Sequence[str] | str, group: str | None = None) -> Moments:
    """Per-group count, mean and centred scatter matrix of complete rows, for few groups.

    Two passes, each a per-partition numpy reduction (``mapInPandas``) whose
    partials are summed by a grouped aggregate: first ``n`` and ``sum x``,
    then ``sum (x - mean)(x - mean)^T`` around the exact group means (no
    subtraction of two large sums).
    """
    data = _vector(df, features, group)

    def partial_sums(batches):
        acc = {}
        for pdf in batches:
            for g, part in pdf.groupby("_g"):
                x = np.stack(part["_v"].to_numpy()).astype(float)
                n, s = acc.get(g, (0, 0.0))
                acc[g] = (n + len(x), s + x.sum(0))
        for g, (n, s) in acc.items():
            yield pd.DataFrame({"_g": [g], "n": [n], "s": [[float(n)] + s.tolist()]})

    sums = _sum_partials(data.mapInPandas(partial_sums, "_g string, n long, s array<double>"), "s")
    counts = {g: int(v[0]) for g, v in sums.items()}
    means = {g: v[1:] / v[0] for g, v in sums.items()}
    shift = {g: m.tolist() for g, m in means.items()}

    def partial_gram(batches):
        acc = {}
        for pdf in batches:
            for g, part in pdf.groupby("_g"):
                x = np.stack(part["_v"].to_numpy()).astype(float) - np.asarray(shift[g])
                gram = x.T @ x
                acc[g] = gram if g not in acc else acc[g] + gram
        for g, gram in acc.items():
            yield pd.DataFrame({"_g": [g], "ss": [gram.ravel().tolist()]})

    parts = data.mapInPandas(partial_gram, "_g string, ss array<double>")
    scatter = {}
    for g, flat in _sum_partials(parts, "ss").items():
        p = int(round(len(flat) ** 0.5))
        scatter[g] = flat.reshape(p, p)
    groups = sorted(means)
    return Moments(groups, counts, means, scatter)


def covariance(df: DataFrame, features: Sequence[str] | str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sample covariance (``n - 1``), mean and row count of complete rows."""
    m = moments(df, features)
    if not m.groups:
        raise ValueError("no complete rows")
    g = m.groups[0]
    n = m.n[g]
    return m.scatter[g] / max(n - 1, 1), m.mean[g], n


def _orient(vecs: np.ndarray) -> np.ndarray:
    """Columns with their largest-magnitude entry made positive."""
    out = vecs.copy()
    for j in range(out.shape[1]):
        i = int(np.argmax(np.abs(out[:, j])))
        if out[i, j] < 0:
            out[:, j] = -out[:, j]
    return out


def _scores(df: DataFrame, features, weights: np.ndarray, center: np.ndarray,
            names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    if len(center) > WIDE:  # thousands of terms are no expression any more
        wide = df.sparkSession.sparkContext.broadcast((center, weights))
        types = dict(df.dtypes)

        def run(batches):
            center, weights = wide.value
            for pdf in batches:
                out = pdf[list(keep)].copy()
                got = np.array([[np.nan if e is None else e for e in v] for v in pdf["_v"]], float).reshape(len(pdf), -1)
                out[list(names)] = (got - center) @ weights
                yield out
        v = (F.transform(F.col(features), lambda x: x.cast("double")) if isinstance(features, str)
             else F.array(*[F.col(c).cast("double") for c in features]))
        schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} double" for c in names)])
        return df.select(*keep, v.alias("_v")).where(F.col("_v").isNotNull()).mapInPandas(run, schema)
    xs = _vector_cols(df, features)
    exprs = []
    for j, nm in enumerate(names):
        e = None
        for i, x in enumerate(xs):
            term = (x - F.lit(float(center[i]))) * F.lit(float(weights[i, j]))
            e = term if e is None else e + term
        exprs.append(e.alias(nm))
    return df.select(*keep, *exprs)


class PCAModel(NamedTuple):
    mean: np.ndarray
    components: np.ndarray      # p x k loadings, columns oriented
    explained_variance: np.ndarray
    explained_ratio: np.ndarray
    n: int


def _centred_product(data: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``sum (x - mean) ((x - mean)^T q)``: a p x k matrix per task, summed by Spark in
    one row per column of ``q``."""
    side = data.sparkSession.sparkContext.broadcast((mean, q))

    def partial(batches):
        mean, q = side.value
        total = np.zeros(q.shape)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["_v"].to_numpy()).astype(float) - mean
                total += x.T @ (x @ q)
        yield pd.DataFrame({"_g": [str(j) for j in range(q.shape[1])], "s": [c.tolist() for c in total.T]})

    sums = _sum_partials(data.mapInPandas(partial, "_g string, s array<double>"), "s")
    return np.stack([sums[str(j)] for j in range(q.shape[1])], axis=1)


def fit_pca_wide(df: DataFrame, features: Sequence[str] | str, k: int = 2, extra: int = 8, passes: int = 60,
                 tolerance: float = 1e-10, seed: int = 42) -> PCAModel:
    """R4 for many features: a randomised range finder with subspace iteration (one
    pass over the rows each) until the leading eigenvalues stand still."""
    data = materialize(_vector(df, features, None), "wide")
    means = class_means(data).first()
    if means is None:
        raise ValueError("no complete rows")
    n, mean = means["n"], np.array(means["m"])
    p = len(mean)
    spread = data.select(F.posexplode("_v").alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("v"))
    total = spread.agg(F.sum("v")).first()[0] or 0.0
    width = min(p, k + extra)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, width)))[0]
    before = np.zeros(k)
    for _ in range(passes):
        y = _centred_product(data, mean, q) / max(n - 1, 1)     # covariance times the basis
        vals, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        order = np.argsort(vals)[::-1]
        vals, axes = vals[order][:k], (q @ turn[:, order])[:, :k]
        if np.abs(vals - before).max() <= tolerance * max(np.abs(vals).max(), 1e-300):
            break
        before, q = vals, np.linalg.qr(y)[0]
    return PCAModel(mean, _orient(axes), vals, vals / total if total > 0 else vals * 0, n)


def _width(df: DataFrame, features: Sequence[str] | str) -> int:
    if not isinstance(features, str):
        return len(features)
    first = df.select(F.size(features).alias("s")).where("s > 0").first()
    return first["s"] if first else 0


def fit_pca(df: DataFrame, features: Sequence[str] | str, k: int = 2) -> PCAModel:
    """R4 fit: centred (not scaled) principal axes from the covariance, or by
    :func:`fit_pca_wide` beyond ``WIDE`` features."""
    if _width(df, features) > WIDE:
        return fit_pca_wide(df, features, k)
    cov, mean, n = covariance(df, features)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:k]
    comps = _orient(vecs[:, order])
    total = float(np.trace(cov))
    ev = vals[order]
    return PCAModel(mean, comps, ev, ev / total if total > 0 else ev * 0, n)


def pca(df: DataFrame, features: Sequence[str] | str, k: int = 2,
        key: str = "row_id") -> tuple[DataFrame, PCAModel]:
    """``key, pc1..pck`` for every row (no row cap) and the model."""
    model = fit_pca(df, features, k)
    names = [f"pc{j + 1}" for j in range(k)]
    return _scores(df, features, model.components, model.mean, names, [key]), model


def pca_loadings(model: PCAModel, spark, names: Sequence[str]) -> DataFrame:
    rows = [(nm, j + 1, float(model.components[i, j]), float(model.explained_ratio[j]))
            for j in range(model.components.shape[1]) for i, nm in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, component int, loading double, "
                                       "explained_ratio double")


class LDAModel(NamedTuple):
    mean: np.ndarray
    scalings: np.ndarray      # p x k
    eigenvalues: np.ndarray
    within: np.ndarray        # within-class scatter
    between: np.ndarray       # between-class scatter
    n_classes: int


def class_means(data: DataFrame) -> DataFrame:
    """``_g, n, m``: count and mean vector of each group of ``_g, _v`` rows. Tasks
    reduce their rows to sums per group (a bounded number of groups at a time)."""
    def sums(batches):
        for pdf in batches:
            code, groups = pd.factorize(pdf["_g"])
            x = np.stack(pdf["_v"].to_numpy()).astype(float)
            total = np.zeros((len(groups), x.shape[1]))
            np.add.at(total, code, x)
            yield pd.DataFrame({"_g": groups, "n": np.bincount(code, minlength=len(groups)), "s": list(total)})

    parts = data.mapInPandas(sums, "_g string, n long, s array<double>")
    n = parts.groupBy("_g").agg(F.sum("n").alias("n"))
    each = parts.select("_g", F.posexplode("s").alias("pos", "v")).groupBy("_g", "pos").agg(F.sum("v").alias("v"))
    total = each.groupBy("_g").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("s"))
    return total.join(n, "_g").select("_g", "n", F.transform("s", lambda v: v / F.col("n")).alias("m"))


def gram(rows: DataFrame) -> np.ndarray:
    """``sum v v^T`` of the vectors ``_v``: one matrix per task, summed by Spark."""
    def partial(batches):
        total = None
        for pdf in batches:
            x = np.stack(pdf["_v"].to_numpy()).astype(float) if len(pdf) else None
            if x is not None:
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"_g": ["all"], "ss": [total.ravel().tolist()]})

    flat = _sum_partials(rows.select("_v").mapInPandas(partial, "_g string, ss array<double>"), "ss")["all"]
    p = int(round(len(flat) ** 0.5))
    return flat.reshape(p, p)


def fit_lda(df: DataFrame, features: Sequence[str] | str, class_col: str,
            k: int | None = None) -> LDAModel:
    """R5 fit: Fisher discriminant axes, ``k <= classes - 1``. The generalised
    eigenproblem ``S_B v = l S_W v`` is solved on the driver (p x p), axes scaled to
    unit within-class variance. Neither means nor scatters of single classes leave the tasks."""
    data = _vector(df, features, class_col)
    means = materialize(class_means(data), "class-means")
    c, n_tot = means.agg(F.count("*"), F.sum("n")).first()
    if c < 2:
        raise ValueError("LDA needs at least two classes")
    k = (c - 1) if k is None else k
    if k > c - 1:
        raise ValueError(f"k={k} exceeds classes - 1 = {c - 1}")
    whole = means.select(F.lit("all").alias("_g"), F.transform("m", lambda v: v * F.col("n")).alias("s"))
    mu = _sum_partials(whole, "s")["all"] / n_tot
    center = F.array(*[F.lit(float(v)) for v in mu])
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    sw = gram(data.join(sized_broadcast(means.select("_g", "m"), c), "_g").select(minus("_v", "m").alias("_v")))
    sb = gram(means.select(F.transform(minus(F.col("m"), center), lambda v: v * F.sqrt("n")).alias("_v")))
    vals_w, vecs_w = np.linalg.eigh(sw)
    keep = vals_w > vals_w.max() * 1e-12
    w_inv_sqrt = vecs_w[:, keep] / np.sqrt(vals_w[keep])
    vals, vecs = np.linalg.eigh(w_inv_sqrt.T @ sb @ w_inv_sqrt)
    order = np.argsort(vals)[::-1][:k]
    axes = w_inv_sqrt @ vecs[:, order]
    axes = axes * np.sqrt(max(n_tot - c, 1))       # unit within-class variance
    return LDAModel(mu, _orient(axes), vals[order], sw, sb, c)


def lda_projection(df: DataFrame, features: Sequence[str] | str, class_col: str,
                   k: int | None = None, key: str = "row_id") -> tuple[DataFrame, LDAModel]:
    """``key, ld1..ldk`` for every row and the model."""
    model = fit_lda(df, features, class_col, k)
    names = [f"ld{j + 1}" for j in range(model.scalings.shape[1])]
    return _scores(df, features, model.scalings, model.mean, names, [key]), model


def projection_with(proj: DataFrame, df: DataFrame, cols: Sequence[str],
                    key: str = "row_id") -> DataFrame:
    """The projection table with columns of the source rows (label,
    features to colour by), joined on the key."""
    return proj.join(df.select(key, *cols), key)


# --------------------------------------------------------------------------- forest
def r2_score(pred: DataFrame, label: str, prediction: str = "_pred",
             group: Sequence[str] = ()) -> DataFrame:
    """Coefficient of determination, optionally per group (one aggregate)."""
    y, yh = F.col(label), F.col(prediction)
    agg = pred.groupBy(*group).agg(
        F.sum((y - yh) * (y - yh)).alias("ss_res"),
        (F.var_pop(y) * F.count(y)).alias("ss_tot"))
    return agg.withColumn("r2", F.lit(1.0) - F.try_divide(F.col("ss_res"), F.col("ss_tot")))
