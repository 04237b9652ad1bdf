"""Null keys, ties, groups and labels, zeros of both signs, empty bins."""

from pyspark.sql import functions as F

from retentia.functions import columns as c
from retentia.operators import activity, joins, metrics, ordered, quality, sampling
from retentia.plans import reports


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_running_totals_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, o int")
    want = [("a", 1, 1), (None, 1, 1), (None, 2, 2)]
    for limit in (0, 100):
        got = ordered.running_totals(df, ["o"], {"n": F.lit(1)}, by=["g"], one_task_rows=limit)
        assert rows(got) == sorted(want, key=repr)


def test_curves_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 0.9, 1), (None, 0.1, 0), ("a", 0.2, 1), ("a", 0.8, 0)], "g string, p double, label int")
    for limit in (0, 100):
        assert rows(metrics.roc_auc(df, ["g"], one_task_rows=limit)) == sorted([("a", 0.0), (None, 1.0)], key=repr)
        assert metrics.roc_curve(df, ["g"], one_task_rows=limit).where("g IS NULL").count() == 3
        assert metrics.pr_curve(df, ["g"], one_task_rows=limit).where("g IS NULL").count() == 3


def test_gaps_with_null_ties_and_keys(spark):
    df = spark.createDataFrame(
        [(1, "2015-01-01", 7), (1, "2015-06-01", None), (1, "2015-08-01", 9), (None, "2015-01-01", 1), (None, "2015-02-01", 2)],
        "k int, day string, tie int",
    ).withColumn("day", F.col("day").cast("date"))
    got = activity.gaps(df, "k", "day", "tie").select("k", "tie", "months_since_prev")
    assert rows(got) == sorted([(1, 7, None), (1, None, 5.0), (1, 9, 2.0), (None, 1, None), (None, 2, 1.0)], key=repr)


def test_a_null_key_counts_no_rows(spark):
    df = spark.createDataFrame([(None, d, 1) for d in (1, 2, 3)] + [(5, d, 1) for d in (1, 2, 3)], "k int, d int, x int")
    sums = activity.lifetime_sums(df, "k", {"x": F.col("x")})
    assert rows(sums) == sorted([(None, 0, 3), (5, 3, 3)], key=repr)
    assert [r.k for r in activity.last_k_sums(df, "k", "d", 3, {"x": F.col("x")}).collect()] == [5]


def test_zeros_empty_bins_and_unknown_ratios(spark):
    df = spark.createDataFrame([(0.0, 1.0), (-0.0, None), (10.0, 0.0)], "a double, b double")
    assert rows(quality.distinct_counts(df, ["a"])) == [("a", 2)]
    assert [r.n for r in quality.histogram(df, "a", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    ratios = df.select(c.log_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in ratios] == [0.0, None, 0.0]


def test_lookup_takes_rows_with_maps(spark):
    df = spark.range(50).select((F.col("id") % 5).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    lookup = spark.range(4).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert joins.lookup_join(df, lookup, "k", max_rows=2).where("v IS NULL").count() == 10


def test_wide_table_leaves_label_key_and_like_named_columns(spark):
    base = spark.createDataFrame([(1, None, 3.0, None), (2, 1, None, 4.0)], "k int, is_churn_final int, date_joined double, abs_balance double")
    logs = spark.createDataFrame([(1, 5, 2.0, 9.0)], "k int, row_count int, abs_total_secs_last double, total_secs_clean_last double")
    got = reports.wide_features(base, [logs], "k")
    assert got.columns == ["k", "is_churn_final", "date_joined", "abs_balance", "total_secs_clean_last"]
    assert rows(got) == sorted([(1, None, 3.0, -5.0, 9.0), (2, 1, -5.0, 4.0, -5.0)], key=repr)


def test_samples_cut_exactly_and_leave_out_unlabelled_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.expr("CASE WHEN id % 10 = 0 THEN 1 WHEN id % 10 = 5 THEN NULL ELSE 0 END").alias("y"))
    under = sampling.undersample(df, "y", "k").groupBy("y").count()
    assert rows(under) == [(0, 100), (1, 100)]
    over = sampling.oversample(df, "y", "k").groupBy("y").count()
    assert rows(over) == [(0, 800), (1, 800)]
