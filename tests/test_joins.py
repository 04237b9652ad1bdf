import pytest
from pyspark.sql import functions as F

from retentia.operators import joins
from retentia.plans import views as v


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_full_join_checks_its_keys(spark):
    a = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (None, 5, "n"), (None, 5, "n"), (3, None, "m")], "k int, d int, x string")
    b = spark.createDataFrame([(1, 5, 7), (4, 1, 8), (None, 5, 9)], "k int, d int, y int")
    got = joins.full_join(a, b, ["k", "d"])
    assert got.columns == a.join(b, ["k", "d"], "full").columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, a.join(b, ["k", "d"], "full").collect())))
    assert rows(joins.full_join(a.select("k", "d").where("k IS NOT NULL"), b.where("k > 0"), ["k", "d"]).select("k"))
    twice = b.unionByName(spark.createDataFrame([(4, 1, 8)] * 50, b.schema))
    for first, second, name in ((a, twice, "second table"), (twice, a, "first table")):
        # The key is named, also where only its columns are used.
        with pytest.raises(Exception, match=f'{name}.*"k":4,"d":1'):
            joins.full_join(first, second, ["k", "d"]).count()


def test_full_join_detail_is_a_full_join(spark):
    detail = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (2, 5, "c")], "k int, d int, x string")
    unique = spark.createDataFrame([(1, 10, 7), (3, 1, 8)], "k int, d int, y int")
    got = joins.full_join_detail(detail, unique, ["k", "d"])
    assert rows(got) == rows(detail.join(unique, ["k", "d"], "full"))
    only_keys = unique.select("k", "d")
    assert rows(joins.full_join_detail(detail, only_keys, ["k", "d"])) == rows(
        detail.join(only_keys, ["k", "d"], "full")
    )


def test_left_join_detail_keeps_unmatched(spark):
    unique = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, x string")
    detail = spark.createDataFrame([(1, 5), (1, 6), (3, 7), (None, 8)], "k int, y int")
    assert rows(joins.left_join_detail(unique, detail, "k")) == rows(unique.join(detail, "k", "left"))


def test_lookup_join_small_and_large_agree(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(0, 2000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = joins.lookup_join(df, lookup, "k")
    large = joins.lookup_join(df, lookup, "k", max_rows=10)
    assert rows(small.select("id", "k", "v")) == rows(large.select("id", "k", "v"))
    assert large.count() == 2000
    assert "Broadcast" in small._jdf.queryExecution().toString()


def test_left_join_all_keeps_row_count(spark, sf_dir):
    base = v.clean_members(spark, sf_dir)
    wide = joins.left_join_all(
        base.select(v.KEY), [v.target_a(spark, sf_dir), v.target_b(spark, sf_dir)], v.KEY
    )
    assert wide.count() == base.count()


def test_semi_filter_does_not_multiply(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    keys = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(joins.semi_filter(df, keys, "k")) == [(1,)]


def test_key_overlap_and_difference(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "k int, d int")
    b = spark.createDataFrame([(2, 1), (3, 1)], "k int, d int")
    assert tuple(joins.key_overlap(a, b, ["k", "d"]).first()) == (2, 2, 1, 3, False)
    assert tuple(joins.key_overlap(a, b.where("k = 3"), ["k", "d"]).first()) == (2, 1, 0, 3, True)
    assert rows(joins.key_difference(a, b, ["k", "d"])) == [(1, 1)]
    assert rows(joins.key_intersection(a, b, "k")) == [(2,)]


def test_unions_keep_all_rows(spark, sf_dir):
    a, b = v.logs_a(spark, sf_dir), v.logs_b(spark, sf_dir)
    assert joins.union_by_position(a, b).count() == a.count() + b.count()
    x = spark.createDataFrame([(1, 2)], "k int, p int")
    y = spark.createDataFrame([(3, 4)], "q int, k int")
    assert rows(joins.union_by_name(x, y)) == [(1, 2, None), (4, None, 3)]
