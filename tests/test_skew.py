"""One key with a third of all rows: the skew-safe forms against the plain ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retentia.operators import activity, joins, survival
from retentia.sources.tables import materialize


@pytest.fixture(scope="module")
def events(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(997))
    df = spark.range(30_000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 701).cast("bigint").alias("u"),
        F.date_add(F.lit("2015-01-01").cast("date"), h.cast("int")).alias("d"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("int")).alias("y"),
    )
    return materialize(df, "events")


def differing(a, b):
    names = sorted(a.columns)
    a, b = a.select(*names), b.select(*names)
    return a.exceptAll(b).count() + b.exceptAll(a).count()


def test_gaps(events):
    order = Window.partitionBy("u").orderBy("d", "id")
    plain = events.withColumn("prev_d", F.lag("d").over(order)).withColumn(
        "months_since_prev", F.months_between("d", "prev_d")
    )
    assert differing(activity.gaps(events, "u", "d", "id"), plain) == 0


def test_tenure(events):
    order = Window.partitionBy("u").orderBy("d", "id")
    plain = (
        events.withColumn("gap", F.months_between("d", F.lag("d").over(order)))
        .groupBy("u")
        .agg(
            F.round(F.sum("gap"), 0).alias("month"),
            F.min_by("y", F.when(F.col("y").isNotNull(), F.struct("d", "id"))).alias("y"),
            F.count("gap").alias("gaps"),
        )
        .where("gaps > 0")
        .drop("gaps")
    )
    assert differing(survival.tenure(events, "u", "d", "y", tie="id"), plain) == 0


def test_recent_rows(events):
    order = Window.partitionBy("u").orderBy(F.desc("d"), F.desc("id"))
    # IN (1, 2, 3) keeps Spark from cutting before the shuffle.
    plain = events.withColumn("recency", F.row_number().over(order)).where("recency IN (1, 2, 3)")
    assert differing(activity.recent_rows(events, "u", "d", 3, tie=["id"]), plain) == 0


def test_joins(spark, events):
    users = spark.range(-1, 800).select(F.col("id").alias("u"), (F.col("id") * 3).alias("v"))
    assert differing(joins.left_join_detail(users, events, "u"), users.join(events, "u", "left")) == 0
    assert differing(joins.full_join_detail(events, users, "u"), events.join(users, "u", "full")) == 0
    looked_up = joins.lookup_join(events, users, "u", max_rows=100)
    assert differing(looked_up, events.join(users, "u", "left")) == 0


def test_cohort(spark, events):
    members = spark.range(-1, 800).select(
        F.col("id").alias("u"),
        F.lit("2015-01-01").cast("date").alias("reg"),
        F.when(F.col("id") % 2 == 0, 2014).otherwise(2015).alias("reg_year"),
    )
    got = survival.cohort(events, members, 2015, "u", "d", "reg", "reg_year")
    since = members.where("reg_year >= 2015")
    kept = events.join(since, "u", "left_semi")
    plain = kept.join(since.select("u", F.col("reg").alias("d")), ["u", "d"], "full")
    assert differing(got, plain) == 0
