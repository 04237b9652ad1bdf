"""Weight of evidence, sampling, scaling, correlation and feature elimination."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from retentia.checks import fits
from retentia.checks.registry import CATEGORICAL, MEASURES, add, rounded, slot
from retentia.checks.relational import fitted, tagged
from retentia.operators import activity, logistic, sampling, selection, woe
from retentia.plans import reports
from retentia.plans import views as v
from retentia.sources.tables import materialize

K = v.KEY
LABEL = reports.LABEL
_WOE = ("share", "bad_rate", "distribution_good", "distribution_bad", "woe", "iv")
_WOE_SQL = (
    'SELECT variable, value, "all", good, bad, '
    + ", ".join(f"round({c}, 6) AS {c}" for c in _WOE)
    + " FROM woe"
)


def _train(s, d):
    return tagged(s, d).where(F.col("split") == "train")


add(
    "e1_woe_one_feature",
    lambda s, d: rounded(woe.woe_fit(_train(s, d), "city", LABEL), *_WOE),
    _WOE_SQL + " WHERE variable = 'city'",
)
add(
    "e2_woe_lookup",
    lambda s, d: rounded(woe.woe_lookup(fitted(s, d), "gender"), "gender_woe"),
    "SELECT value AS gender, round(woe, 6) AS gender_woe FROM woe WHERE variable = 'gender'",
)
add("e3_woe_many_features", lambda s, d: rounded(fitted(s, d), *_WOE), _WOE_SQL)
add(
    "e4_woe_apply_one",
    lambda s, d: rounded(
        woe.woe_apply(
            tagged(s, d).where(F.col("split") == "test").select(K, "reg_month"), fitted(s, d), ["reg_month"]
        ),
        "reg_month_woe",
    ),
    "SELECT user_id, reg_month, round(woe, 6) AS reg_month_woe FROM tagged "
    "LEFT JOIN woe ON variable = 'reg_month' AND value = reg_month WHERE split = 'test'",
)
add(
    "e5_woe_apply_many",
    lambda s, d: rounded(
        reports.encoded_members(v.clean_members(s, d), K), *[f"{f}_woe" for f in CATEGORICAL]
    ),
    "SELECT user_id, is_churn_final, bd, reg_year, "
    + ", ".join(f"round({f}_woe, 6) AS {f}_woe" for f in CATEGORICAL)
    + " FROM encoded",
)
add(
    "e6_information_value",
    lambda s, d: rounded(woe.iv_table(fitted(s, d)), "iv"),
    "SELECT variable, round(sum(iv), 6) AS iv FROM woe GROUP BY 1",
)

# Sampling

add(
    "r1_hash_split",
    lambda s, d: tagged(s, d).select(K, "split"),
    "SELECT user_id, split FROM tagged",
)
add(
    "r1_hash_split_salted",
    lambda s, d: sampling.hash_split(v.target(s, d), K, test_pct=25, salt="a").select(K, "split"),
    "SELECT user_id, CASE WHEN ('0x' || substr(md5('a' || CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 100 "
    "< 75 THEN 'train' ELSE 'test' END AS split FROM target",
)
add(
    "r2_undersample",
    lambda s, d: sampling.undersample(_train(s, d), LABEL, K).select(K, LABEL),
    """SELECT user_id, is_churn_final FROM (SELECT *,
        row_number() OVER (PARTITION BY is_churn_final ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) AS rn
        FROM tagged WHERE split = 'train')
    WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM tagged WHERE split = 'train'
        GROUP BY is_churn_final))""",
)
add(
    "r3_oversample",
    lambda s, d: sampling.oversample(_train(s, d), LABEL, K).select(K, LABEL, "copy"),
    """SELECT user_id, is_churn_final, unnest(range(1, copies + 1)) AS copy FROM (
        SELECT user_id, is_churn_final,
            largest // n + CASE WHEN rn <= largest % n THEN 1 ELSE 0 END AS copies
        FROM (SELECT *, max(n) OVER () AS largest FROM (SELECT *,
            count(*) OVER (PARTITION BY is_churn_final) AS n,
            row_number() OVER (PARTITION BY is_churn_final
                ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) AS rn
            FROM tagged WHERE split = 'train')))""",
)
add(
    "r4_split_report",
    lambda s, d: rounded(sampling.split_report(tagged(s, d), K, LABEL), "label_rate"),
    "SELECT split, count(*) AS row_count, count(DISTINCT user_id) AS key_count, "
    "round(avg(is_churn_final), 6) AS label_rate FROM tagged GROUP BY 1",
)

# Scaling, correlation, elimination

_NUMERIC = ["bd", "reg_year"]
add(
    "x1_scale_fit",
    lambda s, d: rounded(selection.scale_fit(_train(s, d), _NUMERIC), "mean", "std"),
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std "
        "FROM tagged WHERE split = 'train'"
        for c in _NUMERIC
    ),
)
add(
    "x1_scale_apply",
    lambda s, d: rounded(
        selection.scale_apply(
            tagged(s, d).select(K, "split", *_NUMERIC), selection.scale_fit(_train(s, d), _NUMERIC)
        ),
        *_NUMERIC,
    ),
    "WITH p AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _NUMERIC)
    + " FROM tagged WHERE split = 'train') SELECT user_id, split, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _NUMERIC)
    + " FROM tagged, p",
)

_SUMS = [f"sum_{c}" for c in MEASURES]


def _totals(s, d):
    return activity.lifetime_sums(v.logs(s, d), K, activity.activity_measures())


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM log_totals"
    for a, b in combinations(_SUMS, 2)
)


def _ranked(s, d):
    """Features by the strength of their correlation with the number of rows."""
    rates = selection.corr_long(_totals(s, d), ["row_count", *_SUMS]).where(
        F.col("feature_a") == "row_count"
    )
    return selection.rank_features(
        rates.withColumn("strength", F.round(F.abs("corr"), 6)), "feature_b", "strength"
    )


_RANK_SQL = (
    "SELECT feature, row_number() OVER (ORDER BY strength DESC, feature) AS rank FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(abs(corr(row_count, {c})), 6) AS strength FROM log_totals"
        for c in _SUMS
    )
    + ")"
)


def _prune_sql(rounds: int) -> str:
    steps = [
        f"near AS (SELECT feature_a AS a, feature_b AS b FROM ({_PAIRS_SQL}) WHERE abs(r) > 0.5 "
        f"UNION ALL SELECT feature_b, feature_a FROM ({_PAIRS_SQL}) WHERE abs(r) > 0.5)",
        f"k0 AS ({_RANK_SQL})",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"k{i} AS (SELECT feature, rank FROM (SELECT *, lag(feature) OVER (ORDER BY rank) AS before "
            f"FROM k{i - 1}) AS x WHERE NOT EXISTS (SELECT 1 FROM near WHERE a = before AND b = feature))"
        )
    return f"WITH {', '.join(steps)} SELECT CAST(rank AS INTEGER) AS rank, feature FROM k{rounds}"


add(
    "x2_correlations",
    lambda s, d: rounded(selection.corr_long(_totals(s, d), _SUMS), "corr"),
    f"SELECT feature_a, feature_b, round(r, 6) AS corr FROM ({_PAIRS_SQL})",
)
add(
    "x3_collinear_pairs",
    lambda s, d: selection.collinear_pairs(selection.corr_long(_totals(s, d), _SUMS)).select(
        "feature_a", "feature_b"
    ),
    f"SELECT feature_a, feature_b FROM ({_PAIRS_SQL}) WHERE abs(r) > 0.5",
)


_ELIMINATED = ["bd", "reg_year", "month_length", "is_male", "city"]


def _elimination_sample(s, d, cols):
    table = v.clean_members(s, d).select(
        K,
        LABEL,
        "bd",
        "reg_year",
        F.length("reg_month").alias("month_length"),
        F.when(F.col("gender") == "male", 1).otherwise(0).alias("is_male"),
        F.col("city").cast("double").alias("city"),
    )
    train, _ = reports.train_sample(table.select(K, LABEL, *cols), K)
    train = materialize(train, "train")
    return selection.scale_apply(train, selection.scale_fit(train, cols))


_THREE = ["bd", "is_male", "city"]
_SAMPLE_SQL = [
    f"""sample AS (SELECT user_id, is_churn_final, bd, reg_year, length(reg_month) AS month_length,
        CAST(gender = 'male' AS INTEGER) AS is_male, CAST(city AS DOUBLE) AS city, {slot('user_id')} < 60 AS is_train FROM clean)"""
]


def x4_weights(s, d):
    train = _elimination_sample(s, d, _THREE).select(*[F.col(c).cast("double").alias(c) for c in [*_THREE, LABEL]])
    fit = logistic.fit_logistic(materialize(train, "train"), _THREE, LABEL)
    rows = [(c, round(float(w), 5)) for c, w in zip([*_THREE, "intercept"], [*fit.weights, fit.intercept], strict=True)]
    return s.createDataFrame(rows, "feature string, weight double")


add(
    "x4_feature_elimination",
    lambda s, d: selection.rfe_rank(_elimination_sample(s, d, _ELIMINATED), _ELIMINATED, LABEL),
    "WITH "
    + ", ".join([*_SAMPLE_SQL, *fits.balanced("sample", _ELIMINATED, LABEL), *fits.elimination("train", _ELIMINATED, LABEL)])
    + " SELECT rank, feature FROM ranks",
)
add(
    "x4_newton_weights",
    x4_weights,
    "WITH one AS (SELECT "
    + ", ".join(f"1 AS m{i}" for i in range(len(_THREE)))
    + "), "
    + ", ".join([*_SAMPLE_SQL, *fits.balanced("sample", _THREE, LABEL), *fits.newton("train", _THREE, LABEL, "fit", "one")])
    + " "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(w{i}, 5) AS weight FROM fit8" for i, c in enumerate([*_THREE, "intercept"])),
)
add(
    "x5_drop_collinear_once",
    lambda s, d: selection.drop_adjacent_collinear(
        _ranked(s, d), selection.collinear_pairs(selection.corr_long(_totals(s, d), _SUMS)), rounds=1
    ),
    _prune_sql(1),
)
add(
    "x6_drop_collinear_to_fixed_point",
    lambda s, d: selection.drop_adjacent_collinear(
        _ranked(s, d), selection.collinear_pairs(selection.corr_long(_totals(s, d), _SUMS))
    ),
    # A round that drops nothing changes nothing, so as many rounds as features suffice.
    _prune_sql(len(_SUMS)),
)
