"""The registry, and the test views as SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    """Register a query and, if there is one, the SQL that must give the same rows."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = with_views(sql)


def r6(c: str | Column, digits: int = 6) -> Column:
    """Rounded, so that the order of summation does not show."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def ymd(c: str) -> str:
    return f"CAST(strptime(CAST({c} AS VARCHAR), '%Y%m%d') AS DATE)"


def months_between(a: str, b: str) -> str:
    whole = f"((year({a}) - year({b})) * 12 + month({a}) - month({b}))"
    return (
        f"CASE WHEN day({a}) = day({b}) OR ({a} = last_day({a}) AND {b} = last_day({b})) "
        f"THEN CAST({whole} AS DOUBLE) "
        f"ELSE round({whole} + (day({a}) - day({b})) / 31.0::DOUBLE, 8) END"
    )


def slot(key: str) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT % 100"


COUNTS = ["num_25", "num_50", "num_75", "num_985", "num_100", "num_unq"]
CLEAN_SECS = "CASE WHEN total_secs < 0 THEN 0 ELSE total_secs END"
MEASURES = {**{c: c for c in COUNTS}, "total_secs_clean": CLEAN_SECS, "abs_total_secs": "abs(total_secs)"}
CATEGORICAL = ["city", "gender", "registered_via", "reg_month", "reg_day_of_week"]

_TRANSACTIONS = """
    SELECT o_orderkey AS transaction_id, o_custkey AS user_id,
        CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS transaction_date,
        CAST(strftime(o_orderdate + INTERVAL 30 DAY, '%Y%m%d') AS INTEGER) AS membership_expire_date,
        o_totalprice AS plan_list_price,
        CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice - 25.0::DOUBLE END
            AS actual_amount_paid
    FROM orders"""


def _sums(suffix: str) -> str:
    cols = [f"count(*) AS row_count{suffix}"]
    for name, expr in MEASURES.items():
        cast = f"CAST(sum({expr}) AS BIGINT)" if name in COUNTS else f"round(sum({expr}), 6)"
        cols.append(f"{cast} AS sum_{name}{suffix}")
    return ", ".join(cols)


_CELLS = " UNION ALL ".join(
    f"SELECT '{f}' AS variable, coalesce({f}, 'NULL') AS value, is_churn_final AS y "
    "FROM tagged WHERE split = 'train'"
    for f in CATEGORICAL
)
_ENCODED_JOINS = " ".join(
    f"LEFT JOIN woe w{i} ON w{i}.variable = '{f}' AND w{i}.value = t.{f}"
    for i, f in enumerate(CATEGORICAL)
)
_ENCODED_COLS = ", ".join(f"w{i}.woe AS {f}_woe" for i, f in enumerate(CATEGORICAL))
_WIDE_COLS = ", ".join(
    f"max(CASE WHEN rn = {n} THEN {expr} END) AS {name}_{suffix}"
    for n, suffix in enumerate(["last", "2ndlast", "3rdlast"], start=1)
    for name, expr in {"date": "date", **MEASURES}.items()
)

VIEWS = {
    "spans": "SELECT o_custkey AS user_id, CAST(min(o_orderdate) AS DATE) AS first_date, "
    "CAST(max(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY 1",
    "target_a": "SELECT user_id, CAST(last_date < DATE '2000-07-01' AS INTEGER) AS is_churn "
    "FROM spans WHERE first_date < DATE '1996-01-01'",
    "target_b": "SELECT user_id, CAST(last_date < DATE '2001-01-01' AS INTEGER) AS is_churn_update "
    "FROM spans WHERE last_date >= DATE '2000-01-01'",
    "target": "SELECT coalesce(a.user_id, b.user_id) AS user_id, is_churn, is_churn_update, "
    "CASE WHEN is_churn_update IS NULL THEN is_churn ELSE is_churn_update END AS is_churn_final "
    "FROM target_a a FULL JOIN target_b b ON a.user_id = b.user_id",
    "members": """SELECT c_custkey AS user_id, c_nationkey AS city,
        CAST(floor(c_acctbal / 100) AS INTEGER) AS bd,
        CASE CAST(round(c_acctbal * 100) AS BIGINT) % 3
            WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender,
        c_mktsegment AS registered_via,
        CAST(strftime(date_trunc('month', first_date), '%Y%m%d') AS INTEGER)
            AS registration_init_time
    FROM customer LEFT JOIN spans ON c_custkey = user_id WHERE c_acctbal >= 0""",
    "transactions_a": _TRANSACTIONS + " WHERE o_orderdate < TIMESTAMP '2000-01-01'",
    "transactions_b": _TRANSACTIONS + " WHERE o_orderdate >= TIMESTAMP '2000-01-01'",
    "transactions": _TRANSACTIONS,
    "logs": """SELECT user_id, CAST(ts AS DATE) AS date,
        count(*) FILTER (WHERE event_type = 'click') AS num_25,
        count(*) FILTER (WHERE event_type = 'view') AS num_50,
        count(*) FILTER (WHERE event_type = 'signup') AS num_75,
        count(*) FILTER (WHERE event_type = 'error') AS num_985,
        count(*) FILTER (WHERE event_type = 'purchase') AS num_100,
        count(DISTINCT props) AS num_unq,
        round(sum(value), 2) - 100.0::DOUBLE AS total_secs
    FROM events GROUP BY 1, 2""",
    "logs_a": "SELECT * FROM logs WHERE date < DATE '2024-01-16'",
    "logs_b": "SELECT * FROM logs WHERE date >= DATE '2024-01-16'",
    "labelled": f"""SELECT t.user_id, is_churn_final, transaction_id,
        {ymd('transaction_date')} AS transaction_date,
        {ymd('membership_expire_date')} AS membership_expire_date,
        plan_list_price, actual_amount_paid, plan_list_price - actual_amount_paid AS outstanding_bal
    FROM target t LEFT JOIN transactions x ON t.user_id = x.user_id""",
    "clean": f"""SELECT t.user_id, is_churn_final,
        coalesce(CAST(city AS VARCHAR), '999') AS city,
        CASE WHEN bd >= 12 AND bd <= 85 THEN bd ELSE 999 END AS bd,
        coalesce(gender, 'unknown') AS gender, coalesce(registered_via, '999') AS registered_via,
        {ymd('registration_init_time')} AS registration_init_time,
        CAST(coalesce(registration_init_time // 10000, 999) AS INTEGER) AS reg_year,
        coalesce(monthname({ymd('registration_init_time')}), '999') AS reg_month,
        coalesce(dayname({ymd('registration_init_time')}), '999') AS reg_day_of_week
    FROM target t LEFT JOIN members m ON t.user_id = m.user_id""",
    "since": "SELECT * FROM clean WHERE reg_year >= 1996",
    "cohort": """SELECT user_id, transaction_date, is_churn_final, transaction_id,
        membership_expire_date, plan_list_price, actual_amount_paid, outstanding_bal
    FROM (SELECT * FROM labelled WHERE user_id IN (SELECT user_id FROM since))
    FULL JOIN (SELECT user_id, registration_init_time AS transaction_date FROM since)
    USING (user_id, transaction_date)""",
    "cohort_gaps": "SELECT *, lag(transaction_date) OVER (PARTITION BY user_id "
    "ORDER BY transaction_date, transaction_id) AS prev FROM cohort",
    "survival": f"""SELECT user_id, CAST(max(is_churn_final) AS INTEGER) AS is_churn_final,
        round(sum({months_between('transaction_date', 'prev')}), 0) AS month
    FROM cohort_gaps WHERE prev IS NOT NULL GROUP BY user_id""",
    "scores": """SELECT c_custkey AS user_id, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS label,
        (c_acctbal + 1000) / 11000 AS p,
        CAST((c_acctbal + 1000) / 11000 > 0.5 AS INTEGER) AS pred FROM customer""",
    "grouped_scores": """SELECT s.*, CAST(nullif(c_nationkey % 5, 0) AS INTEGER) AS grp
        FROM scores s JOIN customer ON c_custkey = user_id""",
    "grouped_curve": """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
        sum(pos) OVER g AS positives, sum(neg) OVER g AS negatives
    FROM (SELECT grp, p, count(*) FILTER (WHERE label = 1) AS pos,
            count(*) FILTER (WHERE label = 0) AS neg FROM grouped_scores GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY grp ORDER BY p DESC), g AS (PARTITION BY grp)""",
    "dated_rows": """SELECT o_orderkey AS transaction_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day FROM orders
        UNION ALL SELECT NULL, o_custkey, CAST(min(CAST(o_orderdate AS DATE)) + INTERVAL 200 DAY AS DATE)
        FROM orders GROUP BY o_custkey""",
    "tagged": f"SELECT *, CASE WHEN {slot('user_id')} < 60 THEN 'train' ELSE 'test' END AS split FROM clean",
    "woe_counts": 'SELECT variable, value, count(*) AS "all", count(*) FILTER (WHERE y = 0) AS good, '
    f"count(*) FILTER (WHERE y = 1) AS bad FROM ({_CELLS}) GROUP BY 1, 2",
    "woe_shares": """SELECT *, "all" / sum("all") OVER v AS share, bad / "all" AS bad_rate,
        ("all" - bad) / nullif(sum("all" - bad) OVER v, 0) AS distribution_good,
        bad / nullif(sum(bad) OVER v, 0) AS distribution_bad
    FROM woe_counts WINDOW v AS (PARTITION BY variable)""",
    "woe": """SELECT *, woe * (distribution_good - distribution_bad) AS iv FROM (
        SELECT *, CASE WHEN distribution_good IS NULL OR distribution_bad IS NULL THEN NULL
            WHEN distribution_good = 0 OR distribution_bad = 0 THEN 0
            ELSE ln(distribution_good / distribution_bad) END AS woe FROM woe_shares)""",
    "encoded": f"SELECT t.user_id, t.is_churn_final, {_ENCODED_COLS}, bd, reg_year "
    f"FROM tagged t {_ENCODED_JOINS}",
    "ranked_logs": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS rn FROM logs",
    "log_totals": f"SELECT user_id, {_sums('')} FROM logs GROUP BY 1",
    "log_recent": f"SELECT user_id, {_sums('_3last')} FROM ranked_logs WHERE rn <= 3 "
    "GROUP BY 1 HAVING count(*) = 3",
    "log_wide": f"SELECT user_id, {_WIDE_COLS} FROM ranked_logs GROUP BY 1",
    "life": """SELECT timeline, removed, observed,
        CAST(sum(removed) OVER (ORDER BY timeline DESC) AS BIGINT) AS at_risk
    FROM (SELECT timeline, CAST(sum(removed) AS BIGINT) AS removed,
            CAST(sum(observed) AS BIGINT) AS observed
        FROM (SELECT month AS timeline, 1 AS removed, is_churn_final AS observed FROM survival
            WHERE month IS NOT NULL AND is_churn_final IS NOT NULL
            UNION ALL SELECT 0.0::DOUBLE, 0, 0) GROUP BY 1)""",
    "km": """SELECT *, CASE WHEN dead > 0 THEN 0 ELSE exp(log_s) END AS km_estimate FROM (
        SELECT *, sum(CASE WHEN observed < at_risk THEN ln(1 - observed / at_risk) ELSE 0 END)
                OVER (ORDER BY timeline) AS log_s,
            sum(CASE WHEN observed > 0 AND observed = at_risk THEN 1 ELSE 0 END)
                OVER (ORDER BY timeline) AS dead,
            sum(CASE WHEN observed < at_risk
                THEN observed / (CAST(at_risk AS DOUBLE) * (at_risk - observed)) ELSE 0 END)
                OVER (ORDER BY timeline) AS var_sum
        FROM life)""",
    "hazard": """SELECT *, sum(CASE WHEN observed > 0 THEN
            list_sum(list_transform(range(0, observed), lambda k: 1.0::DOUBLE / (at_risk - k)))
            ELSE 0 END) OVER (ORDER BY timeline) AS cumulative_hazard
    FROM life""",
    "curve": """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
        sum(pos) OVER () AS positives, sum(neg) OVER () AS negatives
    FROM (SELECT p, count(*) FILTER (WHERE label = 1) AS pos,
            count(*) FILTER (WHERE label = 0) AS neg FROM scores GROUP BY 1)
    WINDOW w AS (ORDER BY p DESC)""",
}


def with_views(sql: str) -> str:
    """``sql`` after the definitions of just those views it needs, in order."""
    needed: set[str] = set()

    def collect(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"(FROM|JOIN)\s+\(?{name}\b", text):
                needed.add(name)
                collect(VIEWS[name])

    collect(sql)
    if not needed:
        return sql
    parts = ", ".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    body = sql.strip()
    return f"WITH {parts}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {parts} {body}"
