import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentia.operators import metrics, models, neighbors, pivots


def brute(train, points, cols, k):
    t = train.sort_values("key")
    d = sum((points[c].to_numpy()[:, None] - t[c].to_numpy()) ** 2 for c in cols)
    best = d.argsort(axis=1, kind="stable")[:, :k]
    return t.y.to_numpy()[best].mean(axis=1)


@pytest.mark.parametrize(
    "shape, k, cell_rows, per_task",
    [("spread", 5, 16, 50), ("crowded", 5, 8, 7), ("crowded", 3, 512, 20_000), ("line", 5, 4, 10)],
)
def test_neighbours_equal_brute_force(spark, shape, k, cell_rows, per_task):
    rng = np.random.default_rng(11)
    n = 300
    xy = {
        "spread": rng.normal(size=(n + 120, 2)) * [1, 40],
        # Few distinct points, one of them a third of all rows.
        "crowded": np.where(rng.random((n + 120, 1)) < 0.33, 2, rng.integers(0, 6, (n + 120, 2))).astype(float),
        "line": np.column_stack([rng.random(n + 120), np.zeros(n + 120)]),
    }[shape]
    train = pd.DataFrame({"key": np.arange(n), "a": xy[:n, 0], "b": xy[:n, 1], "y": rng.integers(0, 2, n)})
    test = pd.DataFrame({"id": np.arange(120), "a": xy[n:, 0], "b": xy[n:, 1]})
    got = neighbors.knn_score(
        spark.createDataFrame(train), spark.createDataFrame(test), ["a", "b"], "y", "key", k,
        cell_rows=cell_rows, points_per_task=per_task,
    ).toPandas().sort_values("id")
    assert len(got) == 120
    np.testing.assert_allclose(got.p, brute(train, test, ["a", "b"], k))


def wide_points(shape, n, d=20):
    rng = np.random.default_rng(12)
    if shape == "clusters":
        centres = rng.normal(size=(12, d)) * 10
        return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d))
    if shape == "plane":
        return rng.normal(size=(n, 2)) @ rng.normal(size=(2, d)) + 0.01 * rng.normal(size=(n, d))
    # Few distinct points, one of them a third of all rows, and ties everywhere.
    return np.where(rng.random((n, 1)) < 0.33, 2, rng.integers(0, 2, (n, d))).astype(float)


@pytest.mark.parametrize("shape", ["clusters", "plane", "crowded"])
@pytest.mark.parametrize(("k", "count", "per_task"), [(5, None, 5000), (7, 40, 9)])
def test_neighbours_in_many_columns_equal_brute_force(spark, shape, k, count, per_task):
    x, cols = wide_points(shape, 700), [f"c{i}" for i in range(20)]
    rng = np.random.default_rng(13)
    both = pd.DataFrame(x, columns=cols)
    train = both[:500].assign(key=rng.permutation(500), y=rng.integers(0, 2, 500))
    test = both[500:].reset_index(drop=True).assign(id=np.arange(200))
    got = neighbors.knn_score(
        spark.createDataFrame(train), spark.createDataFrame(test), cols, "y", "key", k, pivots=count, points_per_task=per_task
    ).toPandas().sort_values("id")
    assert len(got) == 200
    np.testing.assert_allclose(got.p, brute(train, test, cols, k))


def test_pivots_compare_few_pairs(spark):
    x, cols = wide_points("clusters", 3000), [f"c{i}" for i in range(20)]
    both = pd.DataFrame(x, columns=cols)
    train = spark.createDataFrame(both[:2500].assign(key=np.arange(2500), y=0.0))
    found = pivots.found_rows(train, spark.createDataFrame(both[2500:]), cols, "key", "y")
    pairs = found.groupBy(*cols, "_cell").agg(F.max("_pairs").alias("n")).agg(F.sum("n")).first()[0]
    assert pairs < 0.2 * 500 * 2500


def test_pivots_with_fewer_rows_than_k(spark):
    cols = [f"c{i}" for i in range(6)]
    train = spark.createDataFrame([(1, *[0.0] * 6, 1), (2, *[5.0] * 6, 0)], ["key", *cols, "y"])
    test = spark.createDataFrame([(*[9.0] * 6,)], cols)
    assert neighbors.knn_score(train, test, cols, "y", "key", 5).first()["p"] == 0.5


def test_neighbours_with_fewer_rows_than_k(spark):
    train = spark.createDataFrame([(1, 0.0, 1), (2, 5.0, 0)], "key int, a double, y int")
    test = spark.createDataFrame([(9.0,)], "a double")
    assert neighbors.knn_score(train, test, ["a"], "y", "key", 5).first()["p"] == 0.5


@pytest.fixture(scope="module")
def planted(spark):
    h = lambda s: (F.abs(F.xxhash64(F.lit(s), "id")) % 1000) / 1000 - 0.5
    df = spark.range(900).select(F.col("id").alias("k"), h("a").alias("a"), h("b").alias("b"), h("e").alias("e"))
    df = df.withColumn("y", (F.col("a") + F.col("b") + F.col("e") * 0.4 > 0).cast("int")).drop("e")
    return df.where("k < 600"), df.where("k >= 600")


def test_all_models_find_the_signal_and_repeat(spark, planted):
    train, test = planted
    fitted = models.fit_models(train, ["a", "b"], "y", "k", trees=20, rounds=10)
    assert set(fitted) == set(models.MODEL_NAMES)
    scored = models.score(fitted, test, ["a", "b"], "y", "k")
    assert scored.columns == ["model", "k", "label", "p", "pred"]
    assert scored.count() == 300 * len(fitted)
    assert scored.where("p is null or p < 0 or p > 1").count() == 0
    auc = {r["model"]: r["roc_auc"] for r in metrics.roc_auc(scored, ["model"]).collect()}
    assert min(auc.values()) > 0.8, auc
    names = ["random_forest", "log_reg"]
    again = models.fit_models(train, ["a", "b"], "y", "k", names=names, trees=20)
    second = models.score(again, test, ["a", "b"], "y", "k").toPandas()
    first = scored.where(F.col("model").isin(names)).toPandas()
    order = ["model", "k"]
    np.testing.assert_allclose(
        first.sort_values(order).p.to_numpy(), second.sort_values(order).p.to_numpy(), atol=1e-9
    )


def test_comparison_has_every_model_split_and_metric(spark, planted):
    train, test = planted
    fitted = models.fit_models(train, ["a", "b"], "y", "k", names=["log_reg", "naive_bayes"])
    got = models.compare_models(fitted, {"train": train, "test": test}, ["a", "b"], "y", "k")
    assert got.count() == 2 * 2 * 6
    weights = dict(models.coefficients(fitted["log_reg"]))
    assert weights["a"] > 0 and weights["b"] > 0


def test_unknown_model_is_refused(spark, planted):
    with pytest.raises(ValueError):
        models.fit_models(planted[0], ["a", "b"], "y", "k", names=["svm"])


def test_logistic_weights_equal_newton_steps(spark, planted):
    train, _ = planted
    fitted = models.fit_models(train, ["a", "b"], "y", "k", names=["log_reg"])["log_reg"]
    pdf = train.toPandas()
    x = np.column_stack([pdf.a, pdf.b, np.ones(len(pdf))])
    y, w, ridge = pdf.y.to_numpy(), np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge @ w)
    np.testing.assert_allclose([*fitted.weights, fitted.intercept], w, rtol=1e-6)


def test_tree_models_are_scored_by_one_python_step(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=2)), int(rng.random() < 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "key bigint, a double, b double, y int")
    names = ["decision_tree", "random_forest", "boosted_trees"]
    fitted = models.fit_models(df, ["a", "b"], "y", "key", names, trees=3, rounds=3)
    scored = models.score(fitted, df, ["a", "b"], "y", "key")
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r.model, r.key): r.p for r in scored.collect()}
    for name in names:
        assert {k: p for (m, k), p in got.items() if m == name} == {r.key: r.p for r in fitted[name].score(df, "p").collect()}
    assert len(got) == 600
