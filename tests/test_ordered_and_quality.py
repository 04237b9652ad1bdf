import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentia.operators import quality
from retentia.operators.ordered import first_rows, row_positions, running_totals
from retentia.plans import views as v


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, limit, descending):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "x": rng.permutation(3000) / 7.0, "n": rng.integers(0, 9, 3000)})
    got = running_totals(
        spark.createDataFrame(pdf), ["x"], {"upto": F.col("n")}, by=["g"], descending=descending, one_task_rows=limit
    ).toPandas()
    want = pdf.sort_values("x", ascending=not descending)
    want["upto"] = want.groupby("g").n.cumsum()
    a = got.sort_values("x").reset_index(drop=True)[["g", "x", "n", "upto"]]
    b = want.sort_values("x").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_row_positions_on_text_and_number(spark, limit):
    df = spark.range(500).select((F.col("id") % 5).cast("string").alias("t"), (-F.col("id")).alias("i"))
    got = row_positions(df, ["t", "i"], one_task_rows=limit).toPandas()
    want = df.toPandas().sort_values(["t", "i"]).reset_index(drop=True)
    got = got.sort_values("position").reset_index(drop=True)
    assert list(got.position) == list(range(500))
    assert list(got.i) == list(want.i) and list(got.t) == list(want.t)


def test_first_rows_and_tail(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (2,)], "x int")
    assert [r[0] for r in first_rows(df, ["x"], 2).collect()] == [1, 2]
    assert [r[0] for r in first_rows(df, ["x"], 2, tail=True).collect()] == [3, 2]


@pytest.mark.parametrize("nulls", ["null", "NaN"])
def test_summary_matches_describe(spark, nulls):
    rng = np.random.default_rng(5)
    wide = np.where(rng.random(401) < 0.5, -1, 1) * 10.0 ** rng.integers(-300, 300, 401)
    close = 1 + rng.integers(0, 401, 401) * 2.0**-52
    pdf = pd.DataFrame(
        {"a": rng.integers(0, 5, 401).astype(float), "b": rng.normal(size=401), "c": 1.0, "d": close, "e": np.round(rng.normal(size=401)) * 0.0}
    )
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).repartition(3)
    if nulls == "null":
        df = df.replace(float("nan"), None)
    got = quality.summary_long(df).toPandas().set_index("column").sort_index()
    want = pdf.describe().T.sort_index()
    for ours, theirs in zip(
        ["count", "mean", "stddev", "min", "p25", "p50", "p75", "max"],
        ["count", "mean", "std", "min", "25%", "50%", "75%", "max"],
        strict=True,
    ):
        np.testing.assert_allclose(got[ours].astype(float), want[theirs], rtol=1e-9, atol=1e-12)
    # Values of all magnitudes and signs, infinities among them, at any rank.
    table = spark.createDataFrame([(float(x),) for x in [*wide, np.inf, -np.inf, 0.0]], "w double")
    ranks = [0, 1, 7, 200, 201, 390, 402, 403]
    values = quality.ranked_values(table, ["w"], {0: set(ranks)})
    inorder = np.sort([*wide, np.inf, -np.inf, 0.0])
    assert [values[0, r] for r in ranks] == [inorder[r] for r in ranks]


def test_summary_makes_no_order_over_the_values(spark):
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(100)], "k int, x double")
    row = quality.summary_long(df, ["x", "k"], percentiles=(0, 10, 99, 100)).where("column = 'x'").first()
    assert (row["p0"], row["p10"], row["p99"], row["p100"]) == (0.0, pytest.approx(9.9), pytest.approx(98.01), 99.0)


def test_summary_of_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    row = quality.summary_long(df).first()
    assert row["count"] == 0 and row["p50"] is None and row["mean"] is None


def test_cardinality_and_duplicates(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 1)], "k int, d int")
    assert tuple(quality.key_cardinality(df, ["k", "d"]).first()) == (3, 2)
    assert tuple(quality.key_cardinality(df, "k", keep_null=True).first()) == (4, 3)
    assert [tuple(r) for r in quality.duplicate_keys(df, ["k", "d"]).collect()] == [(1, 1, 2)]
    assert quality.duplicate_keys(df, "k", n=9).count() == 0
    counts = {r["column"]: r["n_distinct"] for r in quality.distinct_counts(df, ["k", "d"]).collect()}
    assert counts == {"k": 2, "d": 1}


def test_profile_and_negatives(spark):
    df = spark.createDataFrame([(1, None, -2.0), (2, "x", 3.0)], "a int, b string, c double")
    assert [tuple(r) for r in quality.profile(df).collect()] == [
        ("a", "int", 2), ("b", "string", 1), ("c", "double", 2),
    ]
    assert [tuple(r) for r in quality.negative_counts(df, ["a", "c"]).collect()] == [
        ("a", 0, 1.0), ("c", 1, -2.0),
    ]


def test_value_counts_and_rates_leave_null_groups_out(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("y", 0), (None, 1)], "k string, y int")
    assert [tuple(r) for r in quality.value_counts(df, "k").collect()] == [("x", 2), ("y", 1)]
    assert [tuple(r) for r in quality.rate_by(df, "k", "y", 100.0).collect()] == [("x", 100.0), ("y", 0.0)]


def test_coverage(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (9,)], "k int")
    assert tuple(quality.coverage(a, b, "k").first()) == (4, 1, 0.25)


def test_histogram_holds_every_value(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 9, 10]] + [(None,)], "x double")
    got = {r["bin"]: r["n"] for r in quality.histogram(df, "x", 5).collect()}
    assert got == {0: 2, 1: 1, 2: 0, 3: 0, 4: 2}
    with_nan = df.unionByName(spark.createDataFrame([(float("nan"),)], "x double"))
    assert {r["bin"]: r["n"] for r in quality.histogram(with_nan, "x", 5).collect()} == got
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["n"] for r in quality.histogram(same, "x", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_label_table_is_unique(spark, sf_dir):
    row = quality.key_cardinality(v.target(spark, sf_dir), v.KEY).first()
    assert row["row_count"] == row["key_count"]
