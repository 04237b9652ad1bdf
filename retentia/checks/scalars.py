"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.checks.registry import add, months_between, r6, ymd
from retentia.functions import columns as c
from retentia.plans import reports
from retentia.plans import views as v

K = v.KEY

add(
    "f1_clamp",
    lambda s, d: v.logs(s, d).select(K, "date", c.clamp0("total_secs").alias("secs")),
    "SELECT user_id, date, CASE WHEN total_secs < 0 THEN 0 ELSE total_secs END AS secs FROM logs",
)
add(
    "f2_abs",
    lambda s, d: v.logs(s, d).select(K, "date", F.abs("total_secs").alias("secs")),
    "SELECT user_id, date, abs(total_secs) AS secs FROM logs",
)
add(
    "f3_months_between",
    lambda s, d: v._spans(s, d).select(K, F.months_between("last_date", "first_date").alias("months")),
    f"SELECT user_id, {months_between('last_date', 'first_date')} AS months FROM spans",
)
# Eighths are exact in binary, so a half is a half in every engine.
add(
    "f4_round",
    lambda s, d: v.table(s, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.col("l_quantity") / 8, 0).alias("whole"),
        F.round(F.col("l_quantity") / 8, 2).alias("two"),
    ),
    "SELECT l_orderkey, l_linenumber, round(l_quantity / 8, 0) AS whole, round(l_quantity / 8, 2) AS two "
    "FROM lineitem",
)
add(
    "f4_round_half_even",
    lambda s, d: v.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 1).alias("quarter")
    ),
    "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS quarter FROM lineitem",
)
add(
    "f5_int_to_date",
    lambda s, d: v.transactions(s, d).select(
        "transaction_id", c.int_date("transaction_date").alias("day")
    ),
    f"SELECT transaction_id, {ymd('transaction_date')} AS day FROM transactions",
)
add(
    "f6_year",
    lambda s, d: v._spans(s, d).select(K, F.year("first_date").alias("y")),
    "SELECT user_id, CAST(year(first_date) AS INTEGER) AS y FROM spans",
)
add(
    "f7_month_name",
    lambda s, d: v._spans(s, d).select(K, F.date_format("first_date", "MMMM").alias("m")),
    "SELECT user_id, monthname(first_date) AS m FROM spans",
)
add(
    "f8_weekday_name",
    lambda s, d: v._spans(s, d).select(K, F.date_format("first_date", "EEEE").alias("w")),
    "SELECT user_id, dayname(first_date) AS w FROM spans",
)
add(
    "f8_date_parts",
    lambda s, d: c.date_parts(v._spans(s, d).select(K, "last_date"), "last_date", "y", "m", "w"),
    "SELECT user_id, last_date, CAST(year(last_date) AS INTEGER) AS y, monthname(last_date) AS m, "
    "dayname(last_date) AS w FROM spans",
)
add(
    "f9_cast_to_text",
    lambda s, d: v.transactions(s, d).select(
        "transaction_id", F.col("transaction_date").cast("string").alias("text")
    ),
    "SELECT transaction_id, CAST(transaction_date AS VARCHAR) AS text FROM transactions",
)
add(
    "f10_fill_per_column",
    lambda s, d: c.fill_sentinels(
        v.target(s, d).join(v.members(s, d), K, "left").select(K, "gender", "city", "bd"),
        {"gender": "unknown", "city": 999, "bd": 999},
    ),
    "SELECT user_id, coalesce(gender, 'unknown') AS gender, coalesce(city, 999) AS city, "
    "coalesce(bd, 999) AS bd FROM target LEFT JOIN members USING (user_id)",
)
add(
    "f11_fill_all",
    lambda s, d: c.fill_all(
        v.target(s, d).join(v.members(s, d), K, "left").select(K, "is_churn", "gender", "registered_via", "bd"),
        text="NULL",
        number=-5,
    ),
    "SELECT user_id, coalesce(is_churn, -5) AS is_churn, coalesce(gender, 'NULL') AS gender, "
    "coalesce(registered_via, 'NULL') AS registered_via, coalesce(bd, -5) AS bd "
    "FROM target LEFT JOIN members USING (user_id)",
)
add(
    "f12_newest_label",
    lambda s, d: v.target(s, d).select(K, c.newest("is_churn", "is_churn_update").alias("label")),
    "SELECT user_id, coalesce(is_churn_update, is_churn) AS label FROM target",
)
add(
    "f13_valid_range",
    lambda s, d: v.members(s, d).select(K, c.valid_or("bd", 12, 85, 999).alias("age")),
    "SELECT user_id, CASE WHEN bd BETWEEN 12 AND 85 THEN bd ELSE 999 END AS age FROM members",
)
add(
    "f14_map_groups",
    lambda s, d: v.members(s, d).select(
        K,
        c.map_groups(
            F.col("city").cast("string"), reports.CITY_GROUPS, reports.OTHER_CITY_GROUP
        ).alias("city_group"),
    ),
    """SELECT user_id, CASE WHEN city IN (8, 12, 21) THEN 1 WHEN city IN (3, 4, 5, 6, 10, 15) THEN 2
        WHEN city IN (9, 11, 13, 18, 22) THEN 3 WHEN city IN (14, 16, 19, 20) THEN 4
        WHEN city IN (7, 17) THEN 5 ELSE 6 END AS city_group FROM members""",
)
add(
    "f15_threshold_flag",
    lambda s, d: v.members(s, d).select(K, c.at_least("bd", 24).alias("is_24_or_older")),
    "SELECT user_id, CASE WHEN bd >= 24 THEN 1 ELSE 0 END AS is_24_or_older FROM members",
)
add(
    "f16_log_ratio",
    lambda s, d: v.logs(s, d).select(K, "date", r6(c.log_ratio("num_25", "num_50")).alias("ratio")),
    "SELECT user_id, date, round(CASE WHEN num_25 = 0 OR num_50 = 0 THEN 0 "
    "ELSE ln(num_25 / num_50) END, 6) AS ratio FROM logs",
)
add(
    "f17_percent",
    lambda s, d: v.scores(s, d).select(K, r6(c.percent("p")).alias("pct")),
    "SELECT user_id, round(p * 100, 6) AS pct FROM scores",
)
add(
    "f18_score_cut",
    lambda s, d: v.scores(s, d).select(K, c.above("p", 0.3).alias("pred")),
    "SELECT user_id, CAST(p > 0.3 AS INTEGER) AS pred FROM scores",
)
