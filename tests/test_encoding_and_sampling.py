import math

import pytest
from pyspark.sql import functions as F

from retentia.operators import sampling, selection, woe
from retentia.plans import reports
from retentia.plans import views as v


def woe_rows(spark):
    data = [("a", 1), ("a", 0), ("a", 0), ("b", 0), ("c", 1), (None, 0), (None, 1), ("a", None)]
    return spark.createDataFrame(data, "f string, y int")


def test_woe_formula_with_null_zero_cells_and_missing_target(spark):
    got = {r["value"]: r for r in woe.woe_fit(woe_rows(spark), "f", "y").collect()}
    assert set(got) == {"a", "b", "c", "NULL"}
    a = got["a"]
    assert (a["all"], a["good"], a["bad"]) == (4, 2, 1)
    assert math.isclose(a["distribution_good"], 3 / 5) and math.isclose(a["distribution_bad"], 1 / 3)
    assert math.isclose(a["woe"], math.log((3 / 5) / (1 / 3)))
    assert math.isclose(a["iv"], a["woe"] * (3 / 5 - 1 / 3))
    assert got["b"]["woe"] == 0.0 and got["c"]["woe"] == 0.0


def test_woe_without_any_bad_is_null(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "f string, y int")
    assert [r["woe"] for r in woe.woe_fit(df, "f", "y").collect()] == [None, None]


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_woe_apply_unseen_is_null_and_rows_stay(spark, max_rows):
    fitted = woe.woe_fit(woe_rows(spark), "f", "y")
    new = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id int, f string")
    got = {r["id"]: r for r in woe.woe_apply(new, fitted, ["f"], max_rows).collect()}
    assert len(got) == 3
    assert got[2]["f_woe"] is None and got[3]["f"] == "NULL" and got[3]["f_woe"] is not None


def test_iv_ranks_the_informative_feature_first(spark):
    df = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("y"),
        F.when(F.col("id") % 8 < 6, F.col("id") % 2).otherwise(1 - F.col("id") % 2).alias("signal"),
        (F.col("id") % 5).alias("noise"),
    )
    ranked = woe.iv_table(woe.woe_fit(df, ["noise", "signal"], "y")).collect()
    assert ranked[0]["variable"] == "signal" and ranked[0]["iv"] > ranked[1]["iv"]


def test_encoding_keeps_rows_and_users(spark, sf_dir):
    members = v.clean_members(spark, sf_dir)
    encoded = reports.encoded_members(members, v.KEY)
    assert encoded.count() == members.count() == encoded.select(v.KEY).distinct().count()


def test_split_is_stable_complete_and_near_its_share(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in sampling.hash_split(df, "k").collect()}
    b = {r["k"]: r["split"] for r in sampling.hash_split(df.repartition(7), "k").collect()}
    assert a == b and len(a) == 5000
    assert abs(sum(s == "test" for s in a.values()) / 5000 - 0.4) < 0.03
    assert a != {r["k"]: r["split"] for r in sampling.hash_split(df, "k", salt="x").collect()}


def test_random_split_is_complete(spark):
    train, test = sampling.random_split(spark.range(1000), 40)
    assert train.count() + test.count() == 1000 and train.join(test, "id").count() == 0


def labelled(spark, positives, negatives):
    n = positives + negatives
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") < positives).cast("int").alias("y"))


def test_undersample_takes_exactly_the_minority_size(spark):
    got = sampling.undersample(labelled(spark, 37, 500), "y", "k")
    assert {r["y"]: r["count"] for r in got.groupBy("y").count().collect()} == {0: 37, 1: 37}
    assert got.select("k").distinct().count() == 74
    again = sampling.undersample(labelled(spark, 37, 500).repartition(5), "y", "k")
    assert {r["k"] for r in got.collect()} == {r["k"] for r in again.collect()}


def test_undersample_of_equal_classes_changes_nothing(spark):
    assert sampling.undersample(labelled(spark, 20, 20), "y", "k").count() == 40


def test_oversample_reaches_the_majority_size(spark):
    got = sampling.oversample(labelled(spark, 37, 500), "y", "k")
    assert {r["y"]: r["count"] for r in got.groupBy("y").count().collect()} == {0: 500, 1: 500}
    per_key = got.where("y = 1").groupBy("k").count().agg(F.min("count"), F.max("count"), F.count("*"))
    assert tuple(per_key.first()) == (13, 14, 37)


def test_split_report(spark):
    df = sampling.hash_split(labelled(spark, 100, 300), "k")
    report = {r["split"]: r for r in sampling.split_report(df, "k", "y").collect()}
    assert sum(r["row_count"] for r in report.values()) == 400
    assert all(r["row_count"] == r["key_count"] for r in report.values())


def test_scaling_uses_population_std_and_survives_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    params = selection.scale_fit(df, ["a", "b"])
    assert [tuple(r) for r in params.collect()] == [("a", 2.0, 1.0), ("b", 5.0, 0.0)]
    got = [tuple(r) for r in selection.scale_apply(df, params).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def test_correlations(spark):
    df = spark.range(50).select(
        F.col("id").alias("a"), (F.col("id") * -2).alias("b"), F.lit(1).alias("c")
    )
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in selection.corr_long(df, ["a", "b", "c"]).collect()}
    assert math.isclose(got[("a", "b")], -1.0) and got[("a", "c")] is None
    assert selection.collinear_pairs(selection.corr_long(df, ["a", "b", "c"])).count() == 1


def test_elimination_ranks_planted_features(spark):
    h = lambda s: (F.abs(F.xxhash64(F.lit(s), "id")) % 1000) / 1000 - 0.5
    df = spark.range(800).select("id", h("a").alias("a"), h("b").alias("b"), h("c").alias("c"), h("e").alias("e"))
    df = df.withColumn("y", (F.col("a") * 4 + F.col("b") + F.col("e") * 0.3 > 0).cast("int"))
    scaled = selection.scale_apply(df, selection.scale_fit(df, ["a", "b", "c"]))
    ranked = [r["feature"] for r in selection.rfe_rank(scaled, ["c", "b", "a"], "y").collect()]
    assert ranked == ["a", "b", "c"]


def ranks(spark, names):
    return spark.createDataFrame(list(enumerate(names, 1)), "rank int, feature string")


def pairs(spark, *names):
    return spark.createDataFrame([tuple(n) for n in names], "feature_a string, feature_b string")


def kept(df):
    return [r["feature"] for r in df.collect()]


def test_second_of_each_collinear_neighbour_goes_at_once(spark):
    near = pairs(spark, "ab", "cb")
    once = selection.drop_adjacent_collinear(ranks(spark, "abcd"), near, rounds=1)
    assert kept(once) == ["a", "d"]


def test_later_rounds_reach_pairs_that_became_neighbours(spark):
    near = pairs(spark, "ab", "ca")
    assert kept(selection.drop_adjacent_collinear(ranks(spark, "abcd"), near, rounds=1)) == ["a", "c", "d"]
    fixed = selection.drop_adjacent_collinear(ranks(spark, "abcd"), near)
    assert kept(fixed) == ["a", "d"]
    assert kept(selection.drop_adjacent_collinear(fixed, near, rounds=1)) == ["a", "d"]
