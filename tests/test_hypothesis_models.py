"""p-values against closed forms, Kruskal-Wallis against brute force, models."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.functions import tails
from tabprep.operators import forest, hypothesis, models, projection

from .conftest import SF001


def tail(spark, column, rows):
    df = spark.createDataFrame(rows, "v double, df double")
    return [r.p for r in df.select(column(F.col("v"), F.col("df")).alias("p")).collect()]


def test_chi2_closed_forms(spark):
    xs = [0.1, 1.0, 3.7, 12.0, 40.0, 700.0]
    two, four, one = (tail(spark, tails.ln_chi2_tail, [(x, k) for x in xs]) for k in (2.0, 4.0, 1.0))
    for x, p2, p4, p1 in zip(xs, two, four, one):
        assert p2 == pytest.approx(-x / 2, rel=1e-11)
        assert p4 == pytest.approx(-x / 2 + math.log1p(x / 2), rel=1e-11)
        assert math.exp(p1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
    many = tail(spark, tails.ln_chi2_tail, [(900.0, 1000.0), (5000.0, 1000.0), (0.0, 3.0), (1.0, 0.0)])
    poisson = sum(math.exp(j * math.log(450) - 450 - math.lgamma(j + 1)) for j in range(500))
    assert math.exp(many[0]) == pytest.approx(poisson, rel=1e-10)
    assert many[1] < -700 and many[2:] == [0.0, None]


def test_t_closed_forms(spark):
    ts = [0.0, 0.5, 2.0, 10.0, 1e4]
    one, two, five = (tail(spark, tails.ln_t_two_sided, [(t, k) for t in ts]) for k in (1.0, 2.0, 5.0))
    for t, p1, p2, p5 in zip(ts, one, two, five):
        assert math.exp(p1) == pytest.approx(2 / math.pi * math.atan2(1, t), rel=1e-11)
        assert math.exp(p2) == pytest.approx(2 / (math.sqrt(2 + t * t) * (math.sqrt(2 + t * t) + t)), rel=1e-11)
        if t < 100:
            a = math.atan(t / math.sqrt(5))
            c = math.cos(a)
            assert math.exp(p5) == pytest.approx(1 - 2 / math.pi * (a + math.sin(a) * (c + 2 / 3 * c ** 3)), abs=1e-13)
    far = tail(spark, tails.ln_t_two_sided, [(1.5, 9.9e5), (1.5, 1.1e6), (80.0, 5000.0), (float("inf"), 3.0),
                                             (float("nan"), 3.0), (1.0, 0.0)])
    normal = math.erfc(1.5 / math.sqrt(2))
    assert math.exp(far[0]) == pytest.approx(normal, rel=1e-5) and math.exp(far[1]) == pytest.approx(normal, rel=1e-5)
    assert far[2] < -1500 and far[3] == float("-inf") and far[4:] == [None, None]


def test_kruskal_brute_force(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 400), "y": rng.integers(0, 6, 400).astype(float)})
    df = spark.createDataFrame(pdf)
    got = hypothesis.kruskal(df, ["g"], "y").first()
    ranks = pdf["y"].rank()                          # midranks
    n = len(pdf)
    h = 12 / (n * (n + 1)) * sum(ranks[pdf.g == c].sum() ** 2 / (pdf.g == c).sum()
                                 for c in range(4)) - 3 * (n + 1)
    t = pdf["y"].value_counts().to_numpy()
    h /= 1 - (t ** 3 - t).sum() / (n ** 3 - n)
    assert got["statistic"] == pytest.approx(h, rel=1e-12)
    x = h / 2  # three degrees of freedom
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(x)) + 2 * math.sqrt(x / math.pi) * math.exp(-x))
    assert got["log10_p"] == pytest.approx(math.log10(got["p_value"]))


def test_welch_sign_and_skips(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 10.0), (1, 12.0), (1, 17.0)],
                               "b int, y double")
    w = hypothesis.welch_t(df, ["b"], "y").first()
    assert w["statistic"] < 0 and w["status"] == "ok"
    tri = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "b int, y double")
    assert hypothesis.welch_t(tri, ["b"], "y").first()["status"] == "skipped: not binary"
    assert hypothesis.kruskal(df, ["b"], "y").first()["status"] == "skipped: needs 3+ categories"


def test_pca_properties(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    scores, model = models.pca(emb, "embedding", 3, key="vec_id")
    c = model.components
    assert np.allclose(c.T @ c, np.eye(3), atol=1e-10)
    s = scores.toPandas()
    assert abs(s.pc1.mean()) < 1e-9
    x = np.stack(emb.toPandas().embedding.to_numpy()).astype(float)
    assert np.allclose(np.cov(x, rowvar=False), models.covariance(emb, "embedding")[0], atol=1e-10)
    assert s.pc1.var() >= s.pc2.var() >= s.pc3.var()


def test_lda_components_limit(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(i * 0.3 % 1), i % 2) for i in range(40)],
                               "row_id long, a double, b double, c int")
    proj, model = models.lda_projection(df, ["a", "b"], "c", 1)
    assert proj.count() == 40
    with pytest.raises(ValueError):
        models.fit_lda(df, ["a", "b"], "c", 2)


def test_pca_of_thousands_of_features(spark):
    rng = np.random.default_rng(12)
    n, p = 60, 5000
    x = rng.normal(size=(n, 3)) @ (rng.normal(size=(3, p)) * np.array([[9.0], [5.0], [2.0]])) + 0.01 * rng.normal(size=(n, p)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, v array<double>").repartition(3)
    scores, model = models.pca(df, "v", 2)
    centred = x - x.mean(0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.explained_variance, s[:2] ** 2 / (n - 1), rtol=1e-8)
    assert np.allclose(model.explained_ratio, s[:2] ** 2 / (s ** 2).sum(), rtol=1e-8)
    for j in range(2):
        assert abs(vt[j] @ model.components[:, j]) == pytest.approx(1, abs=1e-8)
    got = scores.toPandas().sort_values("row_id")
    assert np.allclose(got[["pc1", "pc2"]], centred @ model.components, atol=1e-6)


def test_lda_of_ten_thousand_classes(spark):
    rng = np.random.default_rng(13)
    c, p = 10_000, 4
    g = np.repeat(np.arange(c), 2)
    x = rng.normal(size=(c, p))[g] * np.array([4.0, 1, 1, 1]) + 0.1 * rng.normal(size=(2 * c, p))
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(2 * c), "g": g, **{f"x{j}": x[:, j] for j in range(p)}}))
    _, model = models.lda_projection(df, [f"x{j}" for j in range(p)], "g", 2)
    m = (x[::2] + x[1::2]) / 2
    d = x - m[g]
    assert model.n_classes == c and np.allclose(model.within, d.T @ d)
    centred = m - x.mean(0)
    assert np.allclose(model.between, 2 * centred.T @ centred)


@pytest.mark.parametrize("pivots,spread", [(1, 0), (8, 0), (8, 24)])
def test_knn_exact_against_brute_force(spark, pivots, spread):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    if spread:
        # many input partitions: the per-pivot radii merge many partial lists
        emb = emb.repartition(spread, "vec_id")
    g = projection.knn_graph(emb, "embedding", 5, key="vec_id", n_pivots=pivots).toPandas()
    pdf = emb.toPandas()
    x = np.stack(pdf.embedding.to_numpy()).astype(float)
    keys = pdf.vec_id.to_numpy()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(keys)):
        order = np.lexsort((keys, d[i]))[:5]
        got = g[g.src == keys[i]].sort_values("rank")
        assert list(got.dst) == list(keys[order])
        assert np.allclose(got.dist, d[i][order])


def test_permutation_importance_planted(spark):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"row_id": np.arange(n), "signal": rng.normal(size=n),
                        "noise": rng.normal(size=n), "const": np.ones(n)})
    pdf["y"] = 3 * pdf.signal + 0.1 * rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    feats = ["signal", "noise", "const"]
    model = models.fit_forest(df, feats, "y", trees=5, max_depth=5)
    imp = {r["feature"]: r["importance_mean"]
           for r in models.permutation_importance(model, df, feats, "y", 2).collect()}
    assert imp["signal"] > 0.5
    assert imp["const"] == pytest.approx(0.0, abs=1e-12)
    assert imp["signal"] == max(imp.values())


def planted(spark, n=1500):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 40, (n, 4)).astype(float)
    x[:, 3] = np.arange(n)                              # rows differ, so leaves can be pure
    y = np.round(x[:, 0] * x[:, 1] + 5 * rng.normal(size=n), 3)
    pdf = pd.DataFrame({"row_id": np.arange(n), **{f"f{j}": x[:, j] for j in range(4)}, "y": y})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("leaf_rows", [10_000, 200])
def test_forest_leaves_are_pure(spark, leaf_rows):
    df, pdf = planted(spark)
    feats = ["f0", "f1", "f2", "f3"]
    model = forest.fit_forest(df, feats, "y", trees=2, leaf_rows=leaf_rows, bootstrap=False)
    got = forest.predict(model, df, ["row_id"]).toPandas().set_index("row_id").prediction
    assert np.allclose(got.loc[pdf.row_id], pdf.y, atol=1e-9)
    assert model.nodes.filter("feature = -1 and tree = 0").count() > 1000


def test_large_forests_give_the_same_by_routing(spark, monkeypatch):
    df, _ = planted(spark, 600)
    feats = ["f0", "f1", "f2", "f3"]
    model = forest.fit_forest(df, feats, "y", trees=3, leaf_rows=80)
    near = forest.predict(model, df, ["row_id"]).toPandas().set_index("row_id").prediction.sort_index()
    imp = forest.permutation_importance(model, df, feats, "y").collect()
    monkeypatch.setattr(forest, "FOREST_BYTES", 0)
    far = forest.predict(model, df, ["row_id"]).toPandas().set_index("row_id").prediction.sort_index()
    assert np.allclose(near, far, atol=1e-12) and near.nunique() > 100
    for a, b in zip(imp, forest.permutation_importance(model, df, feats, "y").collect()):
        assert a.feature == b.feature and a.importance_mean == pytest.approx(b.importance_mean, abs=1e-9)
    assert {imp[-1].feature, imp[-2].feature} == {"f0", "f1"}


def test_variants_are_walked_from_where_they_leave_the_path(spark):
    df, pdf = planted(spark, 500)
    feats = ["f0", "f1", "f2", "f3"]
    model = forest.fit_forest(df, feats, "y", trees=3, leaf_rows=80)
    x = pdf[feats].to_numpy()
    donor = np.random.default_rng(4).permutation(x)
    scorer, plain = forest._scorer(model, forest._parts(model)[0]), forest._broadcast(model).value
    got = scorer.sums(x, donor) / 3
    for f in range(5):
        changed = x.copy()
        if f < 4:
            changed[:, f] = donor[:, f]
        assert np.array_equal(got[:, f], plain.predict(changed))
    steps = sum(len(scorer.leaves(np.concatenate((x, donor), axis=1), r)[1]) for r in scorer.root)
    assert 0 < steps < 3 * 4 * len(x)                  # fewer than all variants in all trees


@pytest.mark.parametrize("fetch", [300, 3_000_000])
def test_importance_of_a_forest_in_parts_moves_sums_only(spark, monkeypatch, fetch):
    df, _ = planted(spark, 600)
    feats = ["f0", "f1", "f2", "f3"]
    model = forest.fit_forest(df, feats, "y", trees=3, leaf_rows=80)
    near = forest.permutation_importance(model, df, feats, "y").collect()
    monkeypatch.setattr(forest, "FOREST_BYTES", 700 * forest.SCORER_BYTES)
    monkeypatch.setattr(forest, "FETCH_NODES", fetch)
    parts = forest._parts(model)
    assert 3 <= len(parts) <= 12 and sum(g[2] for p in parts for g in p) == model.n_nodes
    monkeypatch.setattr(forest, "_routed", None)        # rows are not sent to the leaves any more
    far = forest.permutation_importance(model, df, feats, "y").collect()
    for a, b in zip(near, far):
        assert a.feature == b.feature and a.importance_mean == pytest.approx(b.importance_mean, abs=1e-9)
        assert a.importance_std == pytest.approx(b.importance_std, abs=1e-9)


def test_grown_tree_splits_as_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        x, y, w = rng.integers(0, 6, (n, 3)).astype(float), rng.integers(0, 4, n).astype(float), rng.integers(1, 4, n).astype(float)
        feature, cut, left, right, value = forest.grow(x, y, w)

        def error(rows):
            return (w[rows] * (y[rows] - np.average(y[rows], weights=w[rows])) ** 2).sum() if len(rows) else 0.0

        def check(k, rows):
            assert value[k] == pytest.approx(np.average(y[rows], weights=w[rows]))
            options = [error(rows[x[rows, j] <= v]) + error(rows[x[rows, j] > v])
                       for j in range(3) for v in np.unique(x[rows, j])[:-1]]
            if feature[k] < 0:
                assert not options or len(set(y[rows])) == 1
                return
            goes = x[rows, feature[k]] <= cut[k]
            assert error(rows[goes]) + error(rows[~goes]) == pytest.approx(min(options), abs=1e-9)
            check(left[k], rows[goes])
            check(right[k], rows[~goes])
        check(0, np.arange(n))


def test_knn_hot_cell_blocks(spark):
    # a dense cluster holding a third of the rows, split into 3x3 blocks
    rng = np.random.default_rng(11)
    n = 300
    x = rng.normal(size=(n, 4))
    x[::3] = rng.normal(scale=1e-3, size=(n // 3 + (n % 3 > 0), 4)) + 5.0
    pdf = pd.DataFrame({"row_id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d": x[:, 3]})
    df = spark.createDataFrame(pdf)
    g = projection.knn_graph(df, ["a", "b", "c", "d"], 4, n_pivots=3, block_rows=40).toPandas()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    keys = np.arange(n)
    assert len(g) == 4 * n
    for i in range(n):
        order = np.lexsort((keys, d[i]))[:4]
        got = g[g.src == i].sort_values("rank")
        assert list(got.dst) == list(order)


@pytest.mark.parametrize("shape", ["uniform", "clusters", "equal"])
def test_space_cells_are_exact(spark, shape, monkeypatch):
    """Many small cells; tight clusters with far points between; hundreds of equal points."""
    from tabprep.operators import space

    rng = np.random.default_rng(21)
    n, k = 700, 4
    x = rng.random((n, 2))
    if shape == "clusters":
        x = rng.normal(scale=1e-3, size=(n, 2)) + rng.integers(0, 3, (n, 1))
        x[:9] = rng.random((9, 2)) * 50
    if shape == "equal":
        x[100:400] = 0.5
        x[400:500, 0] = 0.25
    monkeypatch.setattr(space, "CHUNK_ROWS", 60)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_key long, _v array<double>")
    g = space.knn_cells(df, n, 2, k, cell_rows=30).toPandas().sort_values(["src", "rank"])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.stack([np.lexsort((np.arange(n), d[i]))[:k] for i in range(n)])
    assert (g.dst.to_numpy().reshape(n, k) == want).all() and (g["rank"].to_numpy().reshape(n, k) == np.arange(1, k + 1)).all()
    assert np.allclose(g.dist.to_numpy().reshape(n, k), np.take_along_axis(d, want, 1))
