"""Projection, filters, joins, unions, sort and top-k."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.checks.registry import COUNTS, MEASURES, add, rounded
from retentia.functions.columns import clean_columns, suffix_columns
from retentia.operators import joins, selection
from retentia.operators.activity import COUNT_COLUMNS, activity_measures
from retentia.operators.ordered import first_rows, row_positions
from retentia.operators.quality import rate_by
from retentia.operators.sampling import hash_split
from retentia.operators.woe import iv_table, woe_apply, woe_fit, woe_lookup
from retentia.plans import reports
from retentia.plans import views as v

K = v.KEY


def tagged(spark, sf):
    return hash_split(v.clean_members(spark, sf), K)


def fitted(spark, sf):
    train = tagged(spark, sf).where(F.col("split") == "train")
    return woe_fit(train, reports.CATEGORICAL, reports.LABEL)


def _vector_parts(df):
    x = vector_to_array("features")
    return df.select(K, x[0].alias("x0"), x[1].alias("x1"), "label")


# Projection, rename, filter

add(
    "p1_select",
    lambda s, d: v.labelled_transactions(s, d).select(K, "is_churn_final", "transaction_date"),
    "SELECT user_id, is_churn_final, transaction_date FROM labelled",
)
add(
    "p2_drop",
    lambda s, d: v.clean_members(s, d).drop("registration_init_time", "bd", "reg_year"),
    "SELECT * EXCLUDE (registration_init_time, bd, reg_year) FROM clean",
)
add(
    "p3_lookup_columns",
    lambda s, d: rounded(woe_lookup(fitted(s, d), "city"), "city_woe"),
    "SELECT value AS city, round(woe, 6) AS city_woe FROM woe WHERE variable = 'city'",
)
add(
    "p4_rename_by_list",
    lambda s, d: v.target_b(s, d).toDF("member", "churn_update"),
    "SELECT user_id AS member, is_churn_update AS churn_update FROM target_b",
)
add(
    "p5_rename_by_map",
    lambda s, d: v.members(s, d).withColumnsRenamed({"bd": "age", "city": "city_code"}),
    "SELECT user_id, city AS city_code, bd AS age, gender, registered_via, registration_init_time FROM members",
)
add(
    "p6_suffix_columns",
    lambda s, d: suffix_columns(v.logs_b(s, d), "_update", [K, "date"]),
    "SELECT user_id, date, "
    + ", ".join(f"{c} AS {c}_update" for c in [*COUNTS, "total_secs"])
    + " FROM logs_b",
)
add(
    "p7_clean_columns",
    lambda s, d: clean_columns(
        v.table(s, d, "customer").toDF(" Cust Key", "Full   Name", "NATION key ", "Acct\tBal", "Segment")
    ),
    "SELECT c_custkey AS cust_key, c_name AS full_name, c_nationkey AS nation_key, "
    "c_acctbal AS acct_bal, c_mktsegment AS segment FROM customer",
)
add(
    "p8_suffixed_projection",
    lambda s, d: v.logs(s, d).select(
        K, *[c.alias(f"{n}_last") for n, c in activity_measures(COUNT_COLUMNS).items()]
    ),
    "SELECT user_id, " + ", ".join(f"{e} AS {n}_last" for n, e in MEASURES.items()) + " FROM logs",
)
add(
    "p9_derived_column",
    lambda s, d: v.transactions(s, d).select(
        "transaction_id",
        (F.col("plan_list_price") - F.col("actual_amount_paid")).alias("outstanding_bal"),
    ),
    "SELECT transaction_id, plan_list_price - actual_amount_paid AS outstanding_bal FROM transactions",
)
add(
    "p10_copied_column",
    lambda s, d: v.clean_members(s, d)
    .select(K, "registration_init_time")
    .withColumn("transaction_date", F.col("registration_init_time")),
    "SELECT user_id, registration_init_time, registration_init_time AS transaction_date FROM clean",
)
add(
    "p11_not_null_filter",
    lambda s, d: v.target(s, d).where(F.col("is_churn").isNotNull()),
    "SELECT * FROM target WHERE is_churn IS NOT NULL",
)
add(
    "p12_inequality_filter",
    lambda s, d: v.clean_members(s, d).where(F.col("bd") != 999).select(K, "bd"),
    "SELECT user_id, bd FROM clean WHERE bd <> 999",
)
add(
    "p13_range_filter",
    lambda s, d: v.clean_members(s, d)
    .where((F.col("reg_year") >= 1996) & F.col("bd").between(15, 55))
    .select(K, "bd", "reg_year"),
    "SELECT user_id, bd, reg_year FROM clean WHERE reg_year >= 1996 AND bd >= 15 AND bd <= 55",
)
add(
    "p14_three_way_mask",
    lambda s, d: v.transactions(s, d)
    .where(
        (F.col("transaction_date") == 19970528)
        & (F.col("membership_expire_date") == 19970627)
        & (F.col("plan_list_price") == F.col("actual_amount_paid"))
    )
    .select("transaction_id", K),
    "SELECT transaction_id, user_id FROM transactions WHERE transaction_date = 19970528 "
    "AND membership_expire_date = 19970627 AND plan_list_price = actual_amount_paid",
)
add(
    "p15_in_list",
    lambda s, d: v.survival(s, d).where(F.col("month").isin(6, 12, 18, 24, 60)),
    "SELECT * FROM survival WHERE month IN (6, 12, 18, 24, 60)",
)
add(
    "p16_features_and_label",
    lambda s, d: _vector_parts(
        selection.features_and_label(v.clean_members(s, d), ["bd", "reg_year"], "is_churn_final", [K])
    ),
    "SELECT user_id, CAST(bd AS DOUBLE) AS x0, CAST(reg_year AS DOUBLE) AS x1, "
    "CAST(is_churn_final AS DOUBLE) AS label FROM clean",
)

add(
    "p17_row_slice",
    lambda s, d: row_positions(
        v.labelled_transactions(s, d).select(K, "transaction_date", "transaction_id"),
        [K, "transaction_date", "transaction_id"],
    )
    .where(F.col("position").between(2, 14)),
    "SELECT * FROM (SELECT user_id, transaction_date, transaction_id, row_number() OVER "
    "(ORDER BY user_id, transaction_date, transaction_id) - 1 AS position FROM labelled) "
    "WHERE position BETWEEN 2 AND 14",
)

# Joins

add("j1_full_join", lambda s, d: v.target(s, d), "SELECT * FROM target")
add(
    "j2_full_join_two_keys",
    lambda s, d: joins.full_join_detail(
        v.labelled_transactions(s, d).select(K, "transaction_date", "transaction_id"),
        v.clean_members(s, d).select(
            K, F.col("registration_init_time").alias("transaction_date"), "reg_month"
        ),
        [K, "transaction_date"],
    ),
    "SELECT user_id, transaction_date, transaction_id, reg_month FROM labelled FULL JOIN "
    "(SELECT user_id, registration_init_time AS transaction_date, reg_month FROM clean) "
    "USING (user_id, transaction_date)",
)
add(
    "j3_inner_join",
    lambda s, d: v.target(s, d).join(v.members(s, d), K),
    "SELECT * FROM target JOIN members USING (user_id)",
)
add(
    "j4_left_join",
    lambda s, d: v.target(s, d).join(v.members(s, d), K, "left"),
    "SELECT * FROM target LEFT JOIN members USING (user_id)",
)
add(
    "j4_left_join_detail",
    lambda s, d: joins.left_join_detail(
        v.members(s, d).select(K, "city"),
        v.transactions_b(s, d).select(K, "transaction_id", "plan_list_price"),
        K,
    ),
    "SELECT user_id, city, transaction_id, plan_list_price FROM members "
    "LEFT JOIN transactions_b USING (user_id)",
)
add(
    "j5_left_join_all",
    lambda s, d: joins.left_join_all(
        v.clean_members(s, d).select(K, "city"),
        [v.target_a(s, d), v.target_b(s, d), v.members(s, d).select(K, "gender"), v.survival(s, d).select(K, "month")],
        K,
    ),
    "SELECT user_id, c.city, is_churn, is_churn_update, m.gender, month FROM clean c "
    "LEFT JOIN target_a USING (user_id) LEFT JOIN target_b USING (user_id) "
    "LEFT JOIN members m USING (user_id) LEFT JOIN survival USING (user_id)",
)
add(
    "j6_semi_join",
    lambda s, d: joins.semi_filter(v.transactions(s, d), v.target_a(s, d), K),
    "SELECT * FROM transactions WHERE user_id IN (SELECT user_id FROM target_a)",
)
add(
    "j7_lookup_join",
    lambda s, d: rounded(
        woe_apply(v.clean_members(s, d).select(K, "city"), fitted(s, d), ["city"]), "city_woe"
    ),
    "SELECT user_id, city, round(woe, 6) AS city_woe FROM clean "
    "LEFT JOIN woe ON variable = 'city' AND value = city",
)
add(
    "j7_lookup_join_large",
    lambda s, d: joins.lookup_join(
        v.transactions(s, d).select("transaction_id", K), v.target(s, d), K, max_rows=0
    ),
    "SELECT user_id, transaction_id, is_churn, is_churn_update, is_churn_final "
    "FROM transactions LEFT JOIN target USING (user_id)",
)
add(
    "j8_join_by_key",
    lambda s, d: v.clean_members(s, d)
    .select(K, "bd", "reg_year")
    .join(v.target(s, d).select(K, "is_churn_final"), K),
    "SELECT user_id, bd, reg_year, is_churn_final FROM clean",
)
add(
    "j9_key_overlap",
    lambda s, d: joins.key_overlap(v.target_a(s, d), v.target_b(s, d), K),
    "SELECT count(a.user_id) AS keys_a, count(b.user_id) AS keys_b, "
    "count(*) FILTER (WHERE a.user_id = b.user_id) AS keys_both, count(*) AS keys_all, "
    "count(*) FILTER (WHERE a.user_id = b.user_id) = 0 AS disjoint "
    "FROM target_a a FULL JOIN target_b b ON a.user_id = b.user_id",
)
add(
    "j9_disjoint_keys",
    lambda s, d: joins.key_overlap(
        v.transactions_a(s, d),
        v.transactions_b(s, d),
        [K, "transaction_date", "membership_expire_date"],
    ),
    """WITH a AS (SELECT DISTINCT user_id, transaction_date, membership_expire_date FROM transactions_a),
        b AS (SELECT DISTINCT user_id, transaction_date, membership_expire_date FROM transactions_b)
    SELECT (SELECT count(*) FROM a) AS keys_a, (SELECT count(*) FROM b) AS keys_b,
        (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS keys_both,
        (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS keys_all,
        (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) = 0 AS disjoint""",
)
add(
    "j9_key_difference",
    lambda s, d: joins.key_difference(v.target_a(s, d), v.target_b(s, d), K),
    "SELECT user_id FROM target_a EXCEPT SELECT user_id FROM target_b",
)

# Set operations

add(
    "u1_union_by_position",
    lambda s, d: joins.union_by_position(v.logs_a(s, d), v.logs_b(s, d)),
    "SELECT * FROM logs",
)
add(
    "u2_union_by_name",
    lambda s, d: joins.union_by_name(v.target_a(s, d), v.target_b(s, d)),
    "SELECT user_id, is_churn, CAST(NULL AS INTEGER) AS is_churn_update FROM target_a "
    "UNION ALL SELECT user_id, NULL, is_churn_update FROM target_b",
)
add(
    "u3_intersection",
    lambda s, d: joins.key_intersection(v.target_a(s, d), v.target_b(s, d), K),
    "SELECT user_id FROM target_a INTERSECT SELECT user_id FROM target_b",
)

# Sort, limit, top-k


def _registration_rates(s, d):
    return rate_by(v.clean_members(s, d), "registered_via", "is_churn_final")


add(
    "o1_sort_by_rate",
    lambda s, d: rounded(_registration_rates(s, d), "rate"),
    "SELECT registered_via, round(avg(is_churn_final), 6) AS rate FROM clean GROUP BY 1 ORDER BY 2 DESC",
)
add(
    "o2_sort_two_columns",
    lambda s, d: fitted(s, d).select("variable", "value", "all").orderBy("variable", "value"),
    'SELECT variable, value, "all" FROM woe ORDER BY 1, 2',
)
add(
    "o3_renumber",
    lambda s, d: row_positions(
        rate_by(v.clean_members(s, d), ["registered_via", "reg_year"], "is_churn_final").select(
            "registered_via", "reg_year"
        ),
        ["reg_year", "registered_via"],
    ),
    "SELECT registered_via, reg_year, row_number() OVER (ORDER BY reg_year, registered_via) - 1 "
    "AS position FROM (SELECT DISTINCT registered_via, reg_year FROM clean)",
)
add(
    "o4_head",
    lambda s, d: first_rows(
        v.transactions(s, d).select("transaction_id", "plan_list_price"),
        ["plan_list_price", "transaction_id"],
        10,
    ),
    "SELECT transaction_id, plan_list_price FROM transactions "
    "ORDER BY plan_list_price, transaction_id LIMIT 10",
)
add(
    "o4_tail",
    lambda s, d: first_rows(
        v.transactions(s, d).select(K, "transaction_id"), [K, "transaction_id"], 10, tail=True
    ),
    "SELECT user_id, transaction_id FROM transactions ORDER BY user_id DESC, transaction_id DESC LIMIT 10",
)
add(
    "o5_feature_ranking",
    lambda s, d: selection.rank_features(iv_table(fitted(s, d)), "variable", "iv"),
    "SELECT CAST(row_number() OVER (ORDER BY sum(iv) DESC, variable) AS INTEGER) AS rank, "
    "variable AS feature FROM woe GROUP BY variable",
)
