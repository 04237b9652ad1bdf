"""Elimination against Newton steps on the penalised loss, written out."""

import numpy as np
import pytest

from retentia.operators import logistic, selection


def newton(x, y):
    """Weights of the logistic regression with C = 1 of a summed loss, and the free intercept; steps are halved as needed."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [0.0])

    def loss(w):
        m = x @ w
        return np.logaddexp(0, m).sum() - y @ m + 0.5 * w @ ridge @ w

    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (p - y) + ridge @ w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-12:
            step /= 2
        w = w - step
    return w


def frame(spark, x, y, cols):
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "y"])).repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 4))
    x[:, 3] = 0.7 * x[:, 0] + 0.5 * x[:, 3]
    y = (x @ [2.5, -1.0, 0.2, 0.6] + rng.normal(size=160) > 0).astype(int)
    cols = ["a", "b", "c", "d"]
    return x, y, cols, frame(spark, x, y, cols)


def ranks(x, y, cols):
    left, dropped = list(range(len(cols))), []
    while len(left) > 1:
        dropped.append(left.pop(int((newton(x[:, left], y)[:-1] ** 2).argmin())))
    return [cols[i] for i in left + dropped[::-1]]


def test_a_fit_ends_at_the_optimum_in_few_passes(rows):
    x, y, cols, df = rows
    fit = logistic.fit_logistic(df, cols, "y")
    np.testing.assert_allclose([*fit.weights, fit.intercept], newton(x, y), rtol=1e-6)
    assert fit.passes < 10
    # From where the curvature points, the fit without a column takes a pass or two.
    again = logistic.fit_logistic(df, ["a", "b", "d"], "y", start=fit.without(2))
    np.testing.assert_allclose([*again.weights, again.intercept], newton(x[:, [0, 1, 3]], y), rtol=1e-6)
    assert again.passes <= 2


def test_ranks_equal_newton_steps(rows):
    x, y, cols, df = rows
    assert [r["feature"] for r in selection.rfe_rank(df, cols, "y").collect()] == ranks(x, y, cols)


@pytest.mark.parametrize("n", [400, 2000])
def test_a_separating_column_has_a_finite_optimum(spark, n):
    rng = np.random.default_rng(7)
    y = np.arange(n) % 2
    x = rng.normal(size=(n, 3))
    x[:, 1] = np.where(y == 1, 3 + rng.random(n), -3 - rng.random(n))
    cols = ["a", "gap", "c"]
    df = frame(spark, x, y, cols)
    fit = logistic.fit_logistic(df, cols, "y")
    np.testing.assert_allclose([*fit.weights, fit.intercept], newton(x, y), rtol=1e-5, atol=1e-7)
    assert [r["feature"] for r in selection.rfe_rank(df, cols, "y").collect()] == ranks(x, y, cols)


def test_far_starts_and_wide_scales_settle(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [50, 0.01]
    y = (x[:, 0] > 40).astype(int)
    fit = logistic.fit_logistic(frame(spark, x, y, ["a", "b"]), ["a", "b"], "y", start=np.array([8.0, -300.0, 40.0]))
    np.testing.assert_allclose([*fit.weights, fit.intercept], newton(x, y), rtol=1e-4, atol=1e-6)


def test_constant_columns_go_first_and_bad_rows_are_named(spark):
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=(80, 2)), np.zeros(80)]
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(int)
    df = frame(spark, x, y, ["a", "b", "none"])
    assert [r["feature"] for r in selection.rfe_rank(df, ["none", "a", "b"], "y").collect()][-1] == "none"
    with pytest.raises(Exception, match="both classes"):
        selection.rfe_rank(df.where("y = 1"), ["a", "b"], "y")
    with pytest.raises(Exception, match="without null"):
        selection.rfe_rank(df.selectExpr("a", "if(b > 0, b, null) as b", "y"), ["a", "b"], "y")
