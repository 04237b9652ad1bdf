"""Subscription tables seen in the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.columns import date_int
from retentia.plans import reports
from retentia.sources.tables import materialize

KEY = "user_id"
COHORT_YEAR = 1996


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(spark, sf_dir) -> DataFrame:
    """First and last order date of every customer that ordered."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias(KEY))
        .agg(
            F.min("o_orderdate").cast("date").alias("first_date"),
            F.max("o_orderdate").cast("date").alias("last_date"),
        )
    )


def target_a(spark, sf_dir) -> DataFrame:
    """Customers of the first year; churned without an order from 2000-07 on."""
    spans = _spans(spark, sf_dir).where(F.col("first_date") < F.lit("1996-01-01").cast("date"))
    return spans.select(
        KEY, (F.col("last_date") < F.lit("2000-07-01").cast("date")).cast("int").alias("is_churn")
    )


def target_b(spark, sf_dir) -> DataFrame:
    """Customers seen since 2000; churned without an order from 2001 on."""
    spans = _spans(spark, sf_dir).where(F.col("last_date") >= F.lit("2000-01-01").cast("date"))
    return spans.select(
        KEY,
        (F.col("last_date") < F.lit("2001-01-01").cast("date")).cast("int").alias("is_churn_update"),
    )


def target(spark, sf_dir) -> DataFrame:
    return reports.churn_target(target_a(spark, sf_dir), target_b(spark, sf_dir), KEY)


def members(spark, sf_dir) -> DataFrame:
    """Customers with a non-negative balance; registered on the first of the month of
    their first order."""
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    customer = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    rows = customer.select(
        F.col("c_custkey").alias(KEY),
        F.col("c_nationkey").alias("city"),
        F.floor(F.col("c_acctbal") / 100).cast("int").alias("bd"),
        F.when(cents % 3 == 0, "male").when(cents % 3 == 1, "female").alias("gender"),
        F.col("c_mktsegment").alias("registered_via"),
    )
    spans = _spans(spark, sf_dir)
    return rows.join(spans, KEY, "left").select(
        *rows.columns,
        date_int(F.trunc("first_date", "month")).alias("registration_init_time"),
    )


_SECOND_FILE_FROM = "2000-01-01 00:00:00"


def _transactions(spark, sf_dir, period: Column) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    price = F.col("o_totalprice")
    paid = F.when(F.col("o_orderstatus") == "F", price).otherwise(price - F.lit(25.0))
    orders = table(spark, sf_dir, "orders").where(period)
    return orders.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias(KEY),
        date_int(day).alias("transaction_date"),
        date_int(F.date_add(day, 30)).alias("membership_expire_date"),
        price.alias("plan_list_price"),
        paid.alias("actual_amount_paid"),
    )


def transactions_a(spark, sf_dir) -> DataFrame:
    return _transactions(spark, sf_dir, F.col("o_orderdate") < _SECOND_FILE_FROM)


def transactions_b(spark, sf_dir) -> DataFrame:
    return _transactions(spark, sf_dir, F.col("o_orderdate") >= _SECOND_FILE_FROM)


def transactions(spark, sf_dir) -> DataFrame:
    return transactions_a(spark, sf_dir).unionByName(transactions_b(spark, sf_dir))


def _daily(spark, sf_dir) -> DataFrame:
    """One activity row per user and day."""
    kind = F.col("event_type")
    counts = {
        "num_25": "click",
        "num_50": "view",
        "num_75": "signup",
        "num_985": "error",
        "num_100": "purchase",
    }
    return (
        table(spark, sf_dir, "events")
        .groupBy(KEY, F.col("ts").cast("date").alias("date"))
        .agg(
            *[F.count_if(kind == v).alias(c) for c, v in counts.items()],
            F.count_distinct("props").alias("num_unq"),
            (F.round(F.sum("value"), 2) - F.lit(100.0)).alias("total_secs"),
        )
    )


def logs(spark, sf_dir) -> DataFrame:
    return _daily(spark, sf_dir)


def logs_a(spark, sf_dir) -> DataFrame:
    return _daily(spark, sf_dir).where(F.col("date") < F.lit("2024-01-16").cast("date"))


def logs_b(spark, sf_dir) -> DataFrame:
    return _daily(spark, sf_dir).where(F.col("date") >= F.lit("2024-01-16").cast("date"))


def labelled_transactions(spark, sf_dir) -> DataFrame:
    parts = [transactions_a(spark, sf_dir), transactions_b(spark, sf_dir)]
    labels = materialize(target(spark, sf_dir), "target")
    return reports.labelled_transactions(labels, parts, KEY)


def clean_members(spark, sf_dir) -> DataFrame:
    return reports.clean_members(target(spark, sf_dir), members(spark, sf_dir), KEY)


def cohort_transactions(spark, sf_dir) -> DataFrame:
    # Both inputs are outputs of earlier steps, read from written tables.
    labelled = materialize(labelled_transactions(spark, sf_dir), "labelled")
    cleaned = materialize(clean_members(spark, sf_dir), "members")
    return reports.cohort_transactions(labelled, cleaned, COHORT_YEAR, KEY)


def survival(spark, sf_dir) -> DataFrame:
    return reports.survival_table(cohort_transactions(spark, sf_dir), KEY)


def grouped_scores(spark, sf_dir) -> DataFrame:
    """``scores`` with a group that is null for some customers."""
    group = F.expr("nullif(c_nationkey % 5, 0)").cast("int").alias("grp")
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY), group)
    return scores(spark, sf_dir).join(groups, KEY)


def dated_rows(spark, sf_dir) -> DataFrame:
    """Orders and, between them, one row without an order number per customer: 200 days after the first order."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias(KEY),
        F.col("o_orderdate").cast("date").alias("day"),
    )
    extra = orders.groupBy(KEY).agg(F.date_add(F.min("day"), 200).alias("day"))
    return orders.unionByName(extra, allowMissingColumns=True)


def scores(spark, sf_dir) -> DataFrame:
    """A scored frame: the account balance, scaled to 0..1, as score of one market segment."""
    p = (F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11000.0)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(KEY),
        (F.col("c_mktsegment") == "MACHINERY").cast("int").alias("label"),
        p.alias("p"),
        (p > 0.5).cast("int").alias("pred"),
    )
