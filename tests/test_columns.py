from datetime import date

from pyspark.sql import functions as F

from retentia.functions import columns as c


def one(spark, ddl, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def test_clamp_keeps_null(spark):
    got = one(spark, "x double", [(-1.5,), (0.0,), (2.0,), (None,)], c.clamp0("x"))
    assert got == [(0.0,), (0.0,), (2.0,), (None,)]


def test_int_date_bad_values_become_null(spark):
    got = one(spark, "x int", [(20170228,), (20170231,), (7,), (None,)], c.int_date("x"))
    assert got == [(date(2017, 2, 28),), (None,), (None,), (None,)]


def test_date_int_round_trip(spark):
    got = one(spark, "x int", [(20161231,)], c.date_int(c.int_date("x")))
    assert got == [(20161231,)]


def test_newest_prefers_update(spark):
    rows = [(0, 1), (1, None), (None, 0), (None, None)]
    assert one(spark, "a int, b int", rows, c.newest("a", "b")) == [(1,), (1,), (0,), (None,)]


def test_valid_or_bounds_and_null(spark):
    rows = [(11,), (12,), (85,), (86,), (None,)]
    got = one(spark, "x int", rows, c.valid_or("x", 12, 85, 999))
    assert got == [(999,), (12,), (85,), (999,), (999,)]


def test_flags_are_strict_and_inclusive(spark):
    rows = [(23.0,), (24.0,), (25.0,), (None,)]
    got = one(spark, "x double", rows, c.at_least("x", 24), c.above("x", 24))
    assert got == [(0, 0), (1, 0), (1, 1), (0, 0)]


def test_log_ratio_infinite_is_zero(spark):
    rows = [(0.0, 1.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert one(spark, "a double, b double", rows, c.log_ratio("a", "b")) == [(0.0,)] * 4


def test_map_groups_default(spark):
    rows = [("8",), ("3",), ("99",), (None,)]
    got = one(spark, "x string", rows, c.map_groups("x", {1: ["8"], 2: ["3", "4"]}, 6))
    assert got == [(1,), (2,), (6,), (6,)]


def test_date_parts_names(spark):
    df = spark.createDataFrame([(date(2017, 1, 1),), (None,)], "d date")
    got = [tuple(r) for r in c.date_parts(df, "d", "y", "m", "w").collect()]
    assert got == [(date(2017, 1, 1), 2017, "January", "Sunday"), (None, None, None, None)]


def test_clean_and_suffix_columns_leave_input_alone(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["  My Key ", "A\t b  C", "x"])
    assert c.clean_columns(df).columns == ["my_key", "a_b_c", "x"]
    assert c.suffix_columns(df, "_update", ["x"]).columns[-1] == "x"
    assert df.columns == ["  My Key ", "A\t b  C", "x"]


def test_fill_all_by_type(spark):
    df = spark.createDataFrame([(None, None, 1.5)], "a string, b int, c double")
    assert tuple(c.fill_all(df, text="NULL", number=-5).first()) == ("NULL", -5, 1.5)


def test_rounding_half_up_and_half_even(spark):
    rows = [(0.125,), (0.375,)]
    got = one(spark, "x double", rows, F.round("x", 2), F.bround("x", 2))
    assert got == [(0.13, 0.12), (0.38, 0.38)]
