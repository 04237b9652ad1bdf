from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F

from retentia.operators import activity
from retentia.plans import views as v

DAY = date(2020, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def logs(spark):
    data = [("a", DAY + timedelta(i), i, -float(i)) for i in range(5)] + [("b", DAY, 9, 4.0)]
    return spark.createDataFrame(data, "u string, date date, n int, secs double")


def test_nth_last_row(spark):
    m = {"n": F.col("n")}
    got = activity.nth_last_row(logs(spark), "u", "date", 2, m, "2ndlast")
    assert got.columns == ["u", "date_2ndlast", "n_2ndlast"]
    assert rows(got) == [("a", DAY + timedelta(3), 3)]
    assert rows(activity.nth_last_row(logs(spark), "u", "date", 1, m, "last"))[1] == ("b", DAY, 9)


def test_ties_go_by_the_tie_breaker(spark):
    df = spark.createDataFrame([("a", DAY, i) for i in (3, 1, 2)], "u string, date date, n int")
    got = activity.nth_last_row(df, "u", "date", 1, {"n": F.col("n")}, "last", tie=["n"])
    assert rows(got) == [("a", DAY, 3)]


def test_rank_limit_comes_before_the_shuffle(spark):
    plan = activity.recent_rows(logs(spark), "u", "date", 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_last_k_sums_only_for_full_keys(spark):
    m = activity.activity_measures(["n"], "secs")
    got = activity.last_k_sums(logs(spark), "u", "date", 3, m)
    assert rows(got) == [("a", 3, 9, 0.0, 9.0)]
    every = activity.last_k_sums(logs(spark), "u", "date", 3, m, require_k=False)
    assert [r[:2] for r in rows(every)] == [("a", 3), ("b", 1)]


def test_activity_features_match_their_parts(spark, sf_dir):
    table, m = v.logs(spark, sf_dir), activity.activity_measures()
    got = activity.activity_features(table, v.KEY, "date")
    parts = (
        activity.lifetime_sums(table, v.KEY, m)
        .join(activity.last_n_wide(table, v.KEY, "date", m), v.KEY, "left")
        .join(activity.last_k_sums(table, v.KEY, "date", 3, m), v.KEY, "left")
    )
    a = got.toPandas().set_index(v.KEY).sort_index()
    b = parts.toPandas().set_index(v.KEY).sort_index()[list(a.columns)]
    pd.testing.assert_frame_equal(a, b)


def test_short_keys_get_no_last_3_sums(spark):
    m = activity.activity_measures(["n"], "secs")
    got = {r["u"]: r for r in activity.activity_features(logs(spark), "u", "date", m).collect()}
    assert got["b"]["sum_n_3last"] is None and got["b"]["row_count_3last"] is None
    assert got["b"]["sum_n"] == 9 and got["b"]["n_2ndlast"] is None
    assert got["a"]["sum_n_3last"] == 9 and got["a"]["sum_secs_clean"] == 0.0


def test_gaps_follow_lag(spark):
    data = [("a", date(2020, 1, 31), 2), ("a", date(2020, 1, 31), 1), ("a", date(2020, 2, 29), 3)]
    data += [("b", date(2020, 5, 5), 1), ("b", None, 2)]
    df = spark.createDataFrame(data, "u string, d date, id int")
    got = {(r["u"], r["id"]): (r["prev_d"], r["months_since_prev"]) for r in activity.gaps(df, "u", "d", "id").collect()}
    assert got[("a", 1)] == (None, None)
    assert got[("a", 2)] == (date(2020, 1, 31), 0.0)
    assert got[("a", 3)] == (date(2020, 1, 31), 1.0)
    assert got[("b", 1)] == (None, None) and got[("b", 2)] == (None, None)


def test_first_and_last_skip_nulls(spark):
    data = [("a", 1, None, 5), ("a", 2, 1, None), ("a", 3, 0, 6), ("a", 4, None, None), (None, 1, 1, 1)]
    df = spark.createDataFrame(data, "u string, t int, x int, y int")
    assert rows(activity.first_by(df, "u", ["t"], ["x", "y"])) == [("a", 1, 5)]
    assert rows(activity.last_by(df, "u", ["t"], ["x", "y"])) == [("a", 0, 6)]


def test_logs_are_unique_per_user_and_day(spark, sf_dir):
    table = v.logs(spark, sf_dir)
    assert table.count() == table.select(v.KEY, "date").distinct().count()
    measures = activity.activity_measures()
    low = table.agg(F.min(measures["total_secs_clean"])).first()[0]
    assert low >= 0 and table.agg(F.min("total_secs")).first()[0] < 0
