"""User-level outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.checks import fits
from retentia.checks.registry import CATEGORICAL, COUNTS, MEASURES, VIEWS, add, rounded, slot
from retentia.operators import activity, log_state, neighbors
from retentia.plans import reports
from retentia.plans import views as v
from retentia.sources.tables import materialize, scratch_path

K = v.KEY
LABEL = reports.LABEL
_SECS = ("total_secs_clean", "abs_total_secs")
_ENCODED_SQL = "SELECT user_id, is_churn_final, bd, reg_year, " + ", ".join(
    f"round({f}_woe, 6) AS {f}_woe" for f in CATEGORICAL
)


def encoded(s, d):
    # The fit and the encoding both read the cleaned members, as a written table.
    members = materialize(v.clean_members(s, d), "members")
    return reports.encoded_members(members, K)


def log_features(s, d):
    # Lifetime and recent rows are two passes over the log, so it is written first.
    return activity.activity_features(materialize(v.logs(s, d), "logs"), K, "date")


def wide(s, d):
    features = log_features(s, d)
    return reports.wide_features(encoded(s, d), [features], K)


def activity_table(s, d):
    return rounded(log_features(s, d), *[f"sum_{c}{x}" for c in _SECS for x in ("", "_3last")])


add("q1_churn_target", lambda s, d: v.target(s, d), "SELECT * FROM target")
add("q2_labelled_transactions", lambda s, d: v.labelled_transactions(s, d), "SELECT * FROM labelled")
add(
    "q3_transaction_checks",
    lambda s, d: reports.transaction_checks(v.transactions_a(s, d), v.transactions_b(s, d), K),
    """WITH a AS (SELECT DISTINCT user_id, transaction_date, membership_expire_date FROM transactions_a),
        b AS (SELECT DISTINCT user_id, transaction_date, membership_expire_date FROM transactions_b),
        n AS (SELECT count(*) AS n FROM transactions
            GROUP BY user_id, transaction_date, membership_expire_date)
    SELECT (SELECT count(*) FROM a) AS keys_a, (SELECT count(*) FROM b) AS keys_b,
        (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS keys_both,
        (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS keys_all,
        (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) = 0 AS disjoint,
        CAST(sum(n) AS BIGINT) AS row_count, count(*) FILTER (WHERE n <> 1) AS repeated_keys,
        max(n) AS max_repeats FROM n""",
)
add("q4_cohort_transactions", lambda s, d: v.cohort_transactions(s, d), "SELECT * FROM cohort")
add(
    "q5_log_checks",
    lambda s, d: reports.log_checks(v.logs_a(s, d), v.logs_b(s, d), K),
    """SELECT count(*) FILTER (WHERE a > 0) AS keys_a, count(*) FILTER (WHERE b > 0) AS keys_b,
        count(*) FILTER (WHERE a > 0 AND b > 0) AS keys_both, count(*) AS keys_all,
        count(*) FILTER (WHERE a > 0 AND b > 0) = 0 AS disjoint,
        CAST(sum(a) AS BIGINT) AS rows_a, CAST(sum(b) AS BIGINT) AS rows_b,
        CAST(sum(a + b) AS BIGINT) AS row_count, count(*) FILTER (WHERE a + b <> 1) AS repeated_keys,
        CAST(sum(na) AS BIGINT) AS negatives_a, CAST(sum(nb) AS BIGINT) AS negatives_b
    FROM (SELECT user_id, date, count(*) FILTER (WHERE f = 0) AS a, count(*) FILTER (WHERE f = 1) AS b,
            count(*) FILTER (WHERE f = 0 AND total_secs < 0) AS na,
            count(*) FILTER (WHERE f = 1 AND total_secs < 0) AS nb
        FROM (SELECT *, 0 AS f FROM logs_a UNION ALL SELECT *, 1 AS f FROM logs_b) GROUP BY 1, 2)""",
)
add(
    "q5_consolidated_logs",
    lambda s, d: reports.consolidated_logs(v.logs_a(s, d), v.logs_b(s, d), v.target(s, d), K),
    "SELECT user_id, date, "
    + ", ".join(f"a.{c}, b.{c} AS {c}_update" for c in [*COUNTS, "total_secs"])
    + ", is_churn_final FROM logs_a a FULL JOIN logs_b b USING (user_id, date) "
    "LEFT JOIN target USING (user_id)",
)
for _i, (_n, _suffix) in enumerate(enumerate(activity.RECENCY_SUFFIXES, start=1)):
    add(
        f"q{6 + _i}_logs_{_suffix}_row",
        lambda s, d, n=_n, suffix=_suffix: activity.nth_last_row(
            v.logs_a(s, d).union(v.logs_b(s, d)), K, "date", n, activity.activity_measures(), suffix
        ),
        "SELECT user_id, "
        + ", ".join(f"{e} AS {c}_{_suffix}" for c, e in {"date": "date", **MEASURES}.items())
        + f" FROM ranked_logs WHERE rn = {_n}",
    )
add(
    "q9_logs_lifetime_sums",
    lambda s, d: rounded(
        activity.lifetime_sums(v.logs_a(s, d).union(v.logs_b(s, d)), K, activity.activity_measures()),
        *[f"sum_{c}" for c in _SECS],
    ),
    "SELECT * FROM log_totals",
)
add(
    "q10_logs_last_3_sums",
    lambda s, d: rounded(
        activity.last_k_sums(
            v.logs_a(s, d).union(v.logs_b(s, d)), K, "date", 3, activity.activity_measures()
        ),
        *[f"sum_{c}_3last" for c in _SECS],
    ),
    "SELECT * FROM log_recent",
)
add(
    "q10_activity_features",
    activity_table,
    "SELECT * FROM log_totals LEFT JOIN log_wide USING (user_id) LEFT JOIN log_recent USING (user_id)",
)


def log_files(s, d):
    """The logs as an old and a new file: some days of some users come late, and one day comes twice."""
    logs = materialize(v.logs(s, d), "logs")
    new = F.col("date") >= F.lit("2024-01-16").cast("date")
    late = (F.col("user_id") % 5 == 0) & (F.col("date") < F.lit("2024-01-08").cast("date"))
    twice = F.col("date") == F.lit("2024-01-15").cast("date")
    return logs.where(~new & ~late), logs.where(new | late | twice)


def updated_features(s, d):
    folder = scratch_path(s, "log-state")
    old, new = log_files(s, d)
    log_state.update(s, folder, old, "old", K, "date")
    log_state.update(s, folder, new, "new", K, "date")
    # A file that is delivered again changes nothing.
    state = log_state.update(s, folder, new, "new", K, "date")
    return rounded(log_state.features_of(state, K, "date"), *[f"sum_{c}{x}" for c in _SECS for x in ("", "_3last")])


_ALL_FILES = """all_files AS (SELECT * FROM logs UNION ALL SELECT * FROM logs WHERE date = DATE '2024-01-15'
        AND NOT (user_id % 5 = 0 AND date < DATE '2024-01-08'))"""
add(
    "q10_updated_features",
    updated_features,
    f"""WITH {_ALL_FILES},
    ranked_files AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS rn FROM all_files),
    totals AS ({VIEWS['log_totals'].replace('FROM logs', 'FROM all_files')}),
    latest AS ({VIEWS['log_wide'].replace('ranked_logs', 'ranked_files')}),
    three AS ({VIEWS['log_recent'].replace('ranked_logs', 'ranked_files')})
    SELECT * FROM totals LEFT JOIN latest USING (user_id) LEFT JOIN three USING (user_id)""",
)
add("q11_clean_members", lambda s, d: v.clean_members(s, d), "SELECT * FROM clean")
add(
    "q12_encoded_members",
    lambda s, d: rounded(encoded(s, d), *[f"{f}_woe" for f in CATEGORICAL]),
    f"{_ENCODED_SQL} FROM encoded",
)

_WIDE = [f"{c}_{x}" for x in activity.RECENCY_SUFFIXES for c in [*COUNTS, "total_secs_clean"]]
_WIDE += [f"sum_{c}{x}" for x in ("", "_3last") for c in [*COUNTS, "total_secs_clean"]]
_WOE = [f"{f}_woe" for f in CATEGORICAL]
_ROUNDED = [*_WOE, *[c for c in _WIDE if "total_secs" in c]]
add(
    "q13_wide_features",
    lambda s, d: rounded(wide(s, d), *_ROUNDED),
    "SELECT user_id, is_churn_final, bd, reg_year, "
    + ", ".join(
        f"round(coalesce({c}, -5), 6) AS {c}" if c in _ROUNDED else f"coalesce({c}, -5) AS {c}"
        for c in [*_WOE, *_WIDE]
    )
    + " FROM encoded LEFT JOIN log_totals USING (user_id) LEFT JOIN log_wide USING (user_id) "
    "LEFT JOIN log_recent USING (user_id)",
)
add("q14_reduced_features", lambda s, d: reports.reduced_features(wide(s, d), K))

# Three features, so that the elimination has an SQL form; a row per user and feature that is kept.
_THREE = ["bd", "sum_num_25", "sum_num_50"]


def _q14_of_three(s, d):
    kept = reports.reduced_features(wide(s, d).select(K, LABEL, *_THREE), K)
    names = [c for c in kept.columns if c in _THREE]
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names]
    return kept.select(K, LABEL, F.explode(F.array(*cells)).alias("_cell")).select(K, LABEL, "_cell.*")


_THREE_SQL = [
    f"""three AS MATERIALIZED (SELECT user_id, is_churn_final, {', '.join(f'coalesce({c}, -5) AS {c}' for c in _THREE)},
        {slot('user_id')} < 60 AS is_train FROM encoded LEFT JOIN log_totals USING (user_id))""",
    *fits.balanced("three", _THREE, LABEL),
    *fits.elimination("train", _THREE, LABEL),
    "near AS (SELECT a, b FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM three" for a in _THREE for b in _THREE if a != b)
    + ") WHERE abs(r) > 0.5)",
    "k0 AS (SELECT * FROM ranks)",
    *[
        f"""k{i + 1} AS (SELECT feature, rank FROM (SELECT *, lag(feature) OVER (ORDER BY rank) AS before FROM k{i}) AS x
        WHERE NOT EXISTS (SELECT 1 FROM near WHERE a = before AND b = feature))"""
        for i in range(3)
    ],
]
add(
    "q14_reduced_of_three",
    _q14_of_three,
    f"WITH {', '.join(_THREE_SQL)} "
    + " UNION ALL ".join(
        f"SELECT user_id, is_churn_final, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM three WHERE '{c}' IN (SELECT feature FROM k3)"
        for c in _THREE
    ),
)
_TWENTY = [f"{c}_{x}" for x in activity.RECENCY_SUFFIXES for c in COUNTS] + ["sum_num_25", "sum_num_50"]


def m3_wide(s, d):
    train, test = (materialize(part, "sample") for part in reports.train_sample(wide(s, d).select(K, LABEL, *_TWENTY), K))
    return rounded(neighbors.knn_score(train, test, _TWENTY, LABEL, K, k=5), "p").select(K, "p")


# Twenty columns: counts, whose distances are exact in both engines.
add(
    "m3_nearest_neighbours_wide",
    m3_wide,
    "WITH points AS MATERIALIZED (SELECT user_id, is_churn_final, "
    + ", ".join(f"CAST(coalesce({c}, -5) AS DOUBLE) AS {c}" for c in _TWENTY)
    + f", {slot('user_id')} < 60 AS is_train FROM encoded LEFT JOIN log_totals USING (user_id) LEFT JOIN log_wide USING (user_id)), "
    + ", ".join(fits.balanced("points", _TWENTY, LABEL, scaled=False))
    + ", near AS (SELECT t.user_id, r.is_churn_final AS vote, row_number() OVER (PARTITION BY t.user_id ORDER BY "
    + " + ".join(f"(t.{c} - r.{c}) * (t.{c} - r.{c})" for c in _TWENTY)
    + ", r.user_id) AS rank FROM points t, train r WHERE NOT t.is_train) "
    "SELECT user_id, round(avg(vote), 6) AS p FROM near WHERE rank <= 5 GROUP BY 1",
)
add("q15_model_comparison", lambda s, d: reports.model_comparison(encoded(s, d), K))
add("q16_survival_table", lambda s, d: v.survival(s, d), "SELECT * FROM survival")
_CURVES = ["km_estimate", "km_lower", "km_upper", "cumulative_density", "cumulative_hazard"]
_Z = 1.959963984540054
add(
    "q16_survival_curves",
    lambda s, d: rounded(reports.survival_curves(v.survival(s, d)), *_CURVES),
    "SELECT timeline, removed, observed, at_risk, round(km_estimate, 6) AS km_estimate, "
    + ", ".join(
        "round(CASE WHEN dead > 0 THEN NULL WHEN log_s = 0 THEN 1 "
        f"ELSE exp(-exp(ln(-log_s) {sign} {_Z} * sqrt(var_sum) / log_s)) END, 6) AS {name}"
        for sign, name in (("-", "km_lower"), ("+", "km_upper"))
    )
    + ", round(1 - km_estimate, 6) AS cumulative_density, "
    "round(cumulative_hazard, 6) AS cumulative_hazard "
    "FROM km JOIN (SELECT timeline, cumulative_hazard FROM hazard) USING (timeline)",
)
_SEGMENTS = """SELECT *, CASE WHEN bd >= 24 THEN 1 ELSE 0 END AS is_24_or_older,
    CASE WHEN city IN ('8', '12', '21') THEN 1 WHEN city IN ('3', '4', '5', '6', '10', '15') THEN 2
        WHEN city IN ('9', '11', '13', '18', '22') THEN 3 WHEN city IN ('14', '16', '19', '20') THEN 4
        WHEN city IN ('7', '17') THEN 5 ELSE 6 END AS city_groups FROM clean"""
add(
    "q17_churn_by_registration",
    lambda s, d: rounded(reports.churn_by_registration(v.clean_members(s, d)), "rate"),
    "SELECT registered_via, round(avg(is_churn_final) * 100, 6) AS rate FROM clean GROUP BY 1",
)
add(
    "q17_churn_by_age",
    lambda s, d: rounded(reports.churn_by_age(v.clean_members(s, d)), "rate"),
    "SELECT bd, round(avg(is_churn_final) * 100, 6) AS rate FROM clean WHERE bd <> 999 "
    "AND bd BETWEEN 15 AND 55 GROUP BY 1",
)
add(
    "q17_churn_by_city",
    lambda s, d: rounded(reports.churn_by_city(v.clean_members(s, d)), "rate"),
    "SELECT city, round(avg(is_churn_final) * 100, 6) AS rate FROM clean GROUP BY 1",
)
add(
    "q17_churn_by_city_group",
    lambda s, d: rounded(reports.churn_by_city_group(v.clean_members(s, d)), "rate"),
    f"SELECT CAST(city_groups AS VARCHAR) AS city_groups, round(avg(is_churn_final) * 100, 6) AS rate "
    f"FROM ({_SEGMENTS}) GROUP BY 1",
)
add(
    "q17_churn_by_segment",
    lambda s, d: rounded(reports.churn_by_segment(v.clean_members(s, d)), "rate"),
    f"SELECT is_24_or_older, city_groups, registered_via, round(avg(is_churn_final), 6) AS rate "
    f"FROM ({_SEGMENTS}) GROUP BY 1, 2, 3",
)
