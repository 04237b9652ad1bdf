"""Sources, sinks and views: tables go out through the writer and come back by a scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.checks.registry import add
from retentia.functions.columns import date_int
from retentia.plans import views as v
from retentia.sources.tables import read_parts, read_table, register, scratch_path, write_table

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
LOGS_SQL = "SELECT user_id, date, num_25, num_50, num_75, num_985, num_100, num_unq, total_secs FROM logs"


def _csv(spark, df, label):
    return write_table(df, scratch_path(spark, label), fmt="csv")


def s1(spark, sf):
    path = _csv(spark, v.table(spark, sf, "customer"), "customer")
    return read_table(spark, path, schema=CUSTOMER, fmt="csv")


def s2(spark, sf):
    path = _csv(spark, v.table(spark, sf, "customer"), "customer")
    uri = path if ":" in path else f"file://{path}"
    return read_table(spark, uri, schema=CUSTOMER, fmt="csv")


def s3(spark, sf):
    path = _csv(spark, v.logs(spark, sf), "logs")
    inferred = read_table(spark, path, fmt="csv")
    return inferred.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        "date",
        *[F.col(c).cast("bigint").alias(c) for c in inferred.columns if c.startswith("num_")],
        "total_secs",
    )


def s4(spark, sf):
    path = _csv(spark, v.table(spark, sf, "customer"), "customer")
    return read_table(
        spark, path, schema=CUSTOMER, fmt="csv", limit=1000, order_by=["c_acctbal", "c_custkey"]
    )


def s5(spark, sf):
    iso = v.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate")
    )
    path = _csv(spark, iso, "orders")
    return read_table(
        spark, path, schema="o_orderkey bigint, o_orderdate string", fmt="csv", dates=["o_orderdate"]
    )


def s5_int(spark, sf):
    ints = v.table(spark, sf, "orders").select("o_orderkey", date_int("o_orderdate").alias("day"))
    path = write_table(ints, scratch_path(spark, "orders"))
    return read_table(spark, path, dates=["day"])


def s6(spark, sf):
    logs = v.logs(spark, sf).repartition(5, "user_id")
    path = _csv(spark, logs, "parts")
    schema = ", ".join(f"{n} {t}" for n, t in logs.dtypes)
    return read_table(spark, path, schema=schema, fmt="csv")


def s6_by_header(spark, sf):
    """One folder of part files: a third as they are, a third in another order, a third without two columns."""
    logs = v.logs(spark, sf)
    path = scratch_path(spark, "parts")
    third = F.pmod(F.col("user_id"), F.lit(3))
    for i, cols in enumerate((logs.columns, logs.columns[::-1], [c for c in logs.columns if c not in ("num_unq", "total_secs")])):
        write_table(logs.where(third == i).select(*cols).coalesce(1), path, fmt="csv", mode="append")
    schema = ", ".join(f"{n} {t}" for n, t in logs.dtypes)
    return read_parts(spark, path, schema=schema)


def s7(spark, sf):
    logs = v.logs(spark, sf)
    path = write_table(logs, scratch_path(spark, "out"), fmt="csv", header=True)
    schema = ", ".join(f"{n} {t}" for n, t in logs.dtypes)
    return read_table(spark, path, schema=schema, fmt="csv")


def s8(spark, sf):
    tenure = v.survival(spark, sf)
    path = write_table(tenure, scratch_path(spark, "survival"), fmt="csv")
    return read_table(
        spark, path, schema="user_id bigint, is_churn_final int, month double", fmt="csv"
    )


def s9(spark, sf):
    path = write_table(v.clean_members(spark, sf), scratch_path(spark, "members"))
    return read_table(spark, path)


def s10(spark, sf):
    register(v.logs(spark, sf), "all_logs")
    return spark.sql("SELECT user_id, count(*) AS n, max(date) AS latest FROM all_logs GROUP BY user_id")


add("s1_csv_scan", s1, CUSTOMER_SQL)
add("s2_uri_scan", s2, CUSTOMER_SQL)
add("s3_inferred_csv_scan", s3, LOGS_SQL)
add("s4_bounded_scan", s4, f"{CUSTOMER_SQL} ORDER BY c_acctbal, c_custkey LIMIT 1000")
add("s5_date_scan", s5, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
add("s5_int_date_scan", s5_int, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
add("s6_part_files_scan", s6, LOGS_SQL)
add(
    "s6_part_files_by_header",
    s6_by_header,
    "SELECT user_id, date, num_25, num_50, num_75, num_985, num_100, CASE WHEN user_id % 3 <> 2 THEN num_unq END AS num_unq, "
    "CASE WHEN user_id % 3 <> 2 THEN total_secs END AS total_secs FROM logs",
)
add("s7_write_csv_parts", s7, LOGS_SQL)
add("s8_write_survival", s8, "SELECT user_id, is_churn_final, month FROM survival")
add("s9_write_table", s9, "SELECT * FROM clean")
add("s10_view", s10, "SELECT user_id, count(*) AS n, max(date) AS latest FROM logs GROUP BY 1")
