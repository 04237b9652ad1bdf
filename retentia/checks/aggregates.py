"""Aggregation and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.checks.registry import COUNTS, MEASURES, add, months_between, r6, rounded
from retentia.operators import activity, quality
from retentia.operators.ordered import running_totals
from retentia.plans import views as v

K = v.KEY
DOUBLES = ("total_secs_clean", "abs_total_secs")


def _rounded_sums(df, suffix=""):
    return rounded(df, *[f"sum_{c}{suffix}" for c in DOUBLES])


def _summary_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min, "
        f"CAST(max({c}) AS DOUBLE) AS max, "
        + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p / 100}), 6) AS p{p}" for p in (25, 50, 75))
        + f" FROM {table}"
        for c in cols
    )


add("a1_row_count", lambda s, d: v.logs(s, d).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM logs")
add(
    "a2_key_cardinality",
    lambda s, d: quality.key_cardinality(v.logs(s, d), [K, "date"]),
    "SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT user_id, date FROM logs)) "
    "AS key_count FROM logs",
)
add(
    "a2_repeated_key_cardinality",
    lambda s, d: quality.key_cardinality(v.transactions(s, d), [K, "transaction_date"]),
    "SELECT count(*) AS row_count, count(DISTINCT (user_id, transaction_date)) AS key_count "
    "FROM transactions",
)
add(
    "a3_distinct_counts",
    lambda s, d: quality.distinct_counts(
        v.members(s, d), ["user_id", "city", "gender", "registered_via", "registration_init_time"]
    ),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM members"
        for c in ["user_id", "city", "gender", "registered_via", "registration_init_time"]
    ),
)
add(
    "a4_lifetime_sums",
    lambda s, d: _rounded_sums(activity.lifetime_sums(v.logs(s, d), K, activity.activity_measures())),
    "SELECT * FROM log_totals",
)
add(
    "a5_last_3_sums",
    lambda s, d: _rounded_sums(
        activity.last_k_sums(v.logs(s, d), K, "date", 3, activity.activity_measures()), "_3last"
    ),
    "SELECT * FROM log_recent",
)
add(
    # Some customers have fewer than three orders: they must not appear.
    "a6_last_3_order_sums",
    lambda s, d: rounded(
        activity.last_k_sums(
            v.transactions(s, d),
            K,
            "transaction_date",
            3,
            {"paid": F.col("actual_amount_paid")},
            tie=["transaction_id"],
        ),
        "sum_paid_3last",
        digits=4,
    ),
    """SELECT user_id, count(*) AS row_count_3last, round(sum(actual_amount_paid), 4) AS sum_paid_3last
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY transaction_date DESC, transaction_id DESC) AS rn FROM transactions)
    WHERE rn IN (1, 2, 3) GROUP BY user_id HAVING count(*) = 3""",
)
add(
    "a7_duplicate_keys",
    lambda s, d: quality.duplicate_keys(v.transactions(s, d), [K, "transaction_date"]),
    "SELECT user_id, transaction_date, count(*) AS n FROM transactions GROUP BY 1, 2 HAVING count(*) <> 1",
)
add(
    "a7_keys_seen_n_times",
    lambda s, d: quality.duplicate_keys(v.transactions(s, d), K, n=9),
    "SELECT user_id, count(*) AS n FROM transactions GROUP BY 1 HAVING count(*) = 9",
)
add(
    "a7_largest_repeat",
    lambda s, d: v.transactions(s, d).groupBy(K).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")),
    "SELECT max(n) AS n FROM (SELECT count(*) AS n FROM transactions GROUP BY user_id)",
)
add(
    "a8_label_rate",
    lambda s, d: v.target(s, d).agg(*[r6(F.avg(c)).alias(c) for c in ("is_churn", "is_churn_final")]),
    "SELECT round(avg(is_churn), 6) AS is_churn, round(avg(is_churn_final), 6) AS is_churn_final FROM target",
)
add(
    "a9_rate_by_one_key",
    lambda s, d: rounded(
        quality.rate_by(v.target(s, d).join(v.members(s, d), K, "left"), "gender", "is_churn_final"), "rate"
    ),
    "SELECT gender, round(avg(is_churn_final), 6) AS rate FROM target LEFT JOIN members USING (user_id) "
    "WHERE gender IS NOT NULL GROUP BY 1",
)
add(
    "a10_rate_by_three_keys",
    lambda s, d: rounded(
        quality.rate_by(v.clean_members(s, d), ["gender", "registered_via", "reg_year"], "is_churn_final"),
        "rate",
    ),
    "SELECT gender, registered_via, reg_year, round(avg(is_churn_final), 6) AS rate FROM clean GROUP BY 1, 2, 3",
)
add(
    "a11_mean_of_all",
    lambda s, d: rounded(
        quality.mean_by(v.logs(s, d), [K]), *[f"avg_{c}" for c in [*COUNTS, "total_secs"]]
    ),
    "SELECT user_id, "
    + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in [*COUNTS, "total_secs"])
    + " FROM logs GROUP BY 1",
)


def _edge_sql(fn: str) -> str:
    ordering = "struct_pack(a := transaction_date, b := coalesce(transaction_id, -1))"
    cols = ["is_churn_final", "transaction_id", "plan_list_price"]
    return (
        "SELECT user_id, "
        + ", ".join(f"{fn}({c}, {ordering}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in cols)
        + " FROM cohort GROUP BY 1"
    )


_EDGE_COLS = ["is_churn_final", "transaction_id", "plan_list_price"]
add(
    "a12_first_value",
    lambda s, d: activity.first_by(
        v.cohort_transactions(s, d), K, ["transaction_date", "transaction_id"], _EDGE_COLS
    ),
    _edge_sql("arg_min"),
)
add(
    "a13_last_value",
    lambda s, d: activity.last_by(
        v.cohort_transactions(s, d), K, ["transaction_date", "transaction_id"], _EDGE_COLS
    ),
    _edge_sql("arg_max"),
)
add(
    "a14_summed_gaps",
    lambda s, d: activity.gaps(v.cohort_transactions(s, d), K, "transaction_date", "transaction_id")
    .groupBy(K)
    .agg(F.round(F.sum("months_since_prev"), 0).alias("months")),
    f"SELECT user_id, round(sum({months_between('transaction_date', 'prev')}), 0) AS months "
    "FROM cohort_gaps GROUP BY 1",
)
add(
    "a15_min_max",
    lambda s, d: v.cohort_transactions(s, d).agg(
        F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last")
    ),
    "SELECT min(transaction_date) AS first, max(transaction_date) AS last FROM cohort",
)
add(
    "a16_value_counts",
    lambda s, d: quality.value_counts(v.members(s, d), "gender"),
    "SELECT gender, count(*) AS n FROM members WHERE gender IS NOT NULL GROUP BY 1",
)
add(
    "a17_summary",
    lambda s, d: rounded(
        quality.summary_long(v.logs(s, d), [*COUNTS, "total_secs"]), "mean", "stddev", "p25", "p50", "p75"
    ),
    _summary_sql("logs", [*COUNTS, "total_secs"]),
)
add(
    "a17_describe",
    lambda s, d: rounded(quality.summary_long(v.logs(s, d), percentiles=()), "mean", "stddev"),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min, "
        f"CAST(max({c}) AS DOUBLE) AS max FROM logs"
        for c in ["user_id", *COUNTS, "total_secs"]
    ),
)
add(
    "a17_summary_in_ranges",
    lambda s, d: rounded(
        quality.summary_long(v.transactions(s, d), ["plan_list_price", "transaction_date"]),
        "mean",
        "stddev",
        "p25",
        "p50",
        "p75",
    ),
    _summary_sql("transactions", ["plan_list_price", "transaction_date"]),
)
add(
    "a18_profile",
    lambda s, d: quality.profile(v.members(s, d)),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null FROM members"
        for c, t in [
            ("user_id", "bigint"),
            ("city", "int"),
            ("bd", "int"),
            ("gender", "string"),
            ("registered_via", "string"),
            ("registration_init_time", "int"),
        ]
    ),
)
add(
    "a19_coverage",
    lambda s, d: rounded(quality.coverage(v.target(s, d), v.members(s, d), K), "share"),
    "SELECT count(*) AS row_count, count(m.user_id) AS covered, round(count(m.user_id) / count(*), 6) AS share "
    "FROM target t LEFT JOIN members m ON t.user_id = m.user_id",
)
add(
    "a20_negative_values",
    lambda s, d: quality.negative_counts(v.logs(s, d), ["num_25", "total_secs"]),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < 0) AS negatives, "
        f"CAST(min({c}) AS DOUBLE) AS minimum FROM logs"
        for c in ["num_25", "total_secs"]
    ),
)
add(
    "a21_histogram",
    lambda s, d: rounded(quality.histogram(v.survival(s, d), "month", 10), "low", "high"),
    """SELECT CAST(bin AS INTEGER) AS bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high,
        count(month) AS n
    FROM range(10) b(bin), (SELECT min(month) AS lo, (max(month) - min(month)) / 10 AS w FROM survival)
    LEFT JOIN survival ON bin = least(floor((month - lo) / w), 9)
    GROUP BY 1, 2, 3""",
)
add(
    "a22_counts_per_category",
    lambda s, d: v.clean_members(s, d)
    .groupBy("city")
    .agg(
        F.count("*").alias("n"),
        F.count_if(F.col("is_churn_final") == 0).alias("good"),
        F.count_if(F.col("is_churn_final") == 1).alias("bad"),
    ),
    "SELECT city, count(*) AS n, count(*) FILTER (WHERE is_churn_final = 0) AS good, "
    "count(*) FILTER (WHERE is_churn_final = 1) AS bad FROM clean GROUP BY 1",
)

# Windows


def _nth_sql(n: int, suffix: str) -> str:
    cols = ", ".join(f"{e} AS {c}_{suffix}" for c, e in {"date": "date", **MEASURES}.items())
    return f"SELECT user_id, {cols} FROM ranked_logs WHERE rn = {n}"


for _n, _suffix in enumerate(activity.RECENCY_SUFFIXES, start=1):
    add(
        f"w1_row_{_suffix}",
        lambda s, d, n=_n, suffix=_suffix: activity.nth_last_row(
            v.logs(s, d), K, "date", n, activity.activity_measures(), suffix
        ),
        _nth_sql(_n, _suffix),
    )
add(
    "w2_last_3_wide",
    lambda s, d: activity.last_n_wide(v.logs(s, d), K, "date", activity.activity_measures()),
    "SELECT * FROM log_wide",
)
add(
    "w3_previous_event_null_tie",
    lambda s, d: activity.gaps(v.dated_rows(s, d), K, "day", "transaction_id"),
    f"""SELECT transaction_id, user_id, day, prev AS prev_day,
        {months_between('day', 'prev')} AS months_since_prev
    FROM (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day, transaction_id NULLS FIRST) AS prev
        FROM dated_rows)""",
)
add(
    "w3_previous_event",
    lambda s, d: activity.gaps(
        v.transactions(s, d)
        .withColumn("day", F.to_date(F.col("transaction_date").cast("string"), "yyyyMMdd"))
        .select("transaction_id", K, "day"),
        K,
        "day",
        "transaction_id",
    ),
    f"""SELECT transaction_id, user_id, day, prev AS prev_day,
        {months_between('day', 'prev')} AS months_since_prev
    FROM (SELECT o_orderkey AS transaction_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day,
        lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev
        FROM orders)""",
)
add(
    "w4_running_totals",
    lambda s, d: running_totals(
        v.transactions(s, d).groupBy("transaction_date").agg(F.count("*").alias("n")),
        ["transaction_date"],
        {"so_far": F.col("n")},
        one_task_rows=0,
    ),
    "SELECT transaction_date, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY transaction_date) AS BIGINT) "
    "AS so_far FROM transactions GROUP BY 1",
)
