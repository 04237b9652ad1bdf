"""User-level outputs: each takes its input tables and returns one lazy table.

Column names follow the subscription tables: ``is_churn`` and ``is_churn_update``
are the two label versions, ``bd`` the age as entered, ``registered_via`` the
registration method. The key column is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import (
    at_least,
    date_parts,
    fill_all,
    fill_sentinels,
    int_date,
    map_groups,
    newest,
    suffix_columns,
    text_or,
    valid_or,
)
from retentia.operators import metrics, models, quality, sampling, selection, survival
from retentia.operators.activity import RECENCY_SUFFIXES, SECONDS_COLUMN
from retentia.operators.joins import (
    full_join,
    key_presence,
    left_join_all,
    left_join_detail,
    overlap_counts,
    union_by_name,
)
from retentia.operators.logistic import fit_logistic
from retentia.operators.woe import woe_apply, woe_fit
from retentia.sources.tables import materialize

LABEL = "is_churn_final"
# The absolute seconds among the activity measures (fixed value).
ABSOLUTE = "abs_total_secs"

# Sentinels for what is missing, and the ages taken as valid.
UNKNOWN_CODE = "999"
UNKNOWN_NUMBER = 999
UNKNOWN_GENDER = "unknown"
AGE_RANGE = (12, 85)
MISSING_FEATURE = -5

# City code -> part of the country (1 south-west, 2 mid-west,
# 3 south-east, 4 north-west, 5 north-east, all others 6 south).
CITY_GROUPS = {
    1: ["8", "12", "21"],
    2: ["3", "4", "5", "6", "10", "15"],
    3: ["9", "11", "13", "18", "22"],
    4: ["14", "16", "19", "20"],
    5: ["7", "17"],
}
OTHER_CITY_GROUP = 6

# The categorical features, and the columns that models are fitted on.
CATEGORICAL = ("city", "gender", "registered_via", "reg_month", "reg_day_of_week")
MODEL_COLUMNS = ("registered_via_woe", "bd", "city_woe")


def churn_target(first: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """One row per user with both label versions and the final one."""
    return full_join(first, update, key).withColumn(LABEL, newest("is_churn", "is_churn_update"))


def labelled_transactions(
    target: DataFrame, transactions: Sequence[DataFrame], key: str
) -> DataFrame:
    """All transactions of labelled users with dates parsed and the open balance.

    Labelled users without any transaction stay, with nulls.
    """
    merged = union_by_name(*transactions).withColumn(
        "outstanding_bal", F.col("plan_list_price") - F.col("actual_amount_paid")
    )
    joined = left_join_detail(target.select(key, LABEL), merged, key)
    return joined.withColumns(
        {c: int_date(c) for c in ("transaction_date", "membership_expire_date")}
    )


def transaction_checks(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: whether the two files repeat each other's keys, and how often keys repeat."""
    keys = [key, "transaction_date", "membership_expire_date"]
    repeats = F.col("n_a") + F.col("n_b")
    return key_presence(first, second, keys).agg(
        *overlap_counts(),
        F.sum(repeats).alias("row_count"),
        F.count_if(repeats != 1).alias("repeated_keys"),
        F.max(repeats).alias("max_repeats"),
    )


def cohort_transactions(
    transactions: DataFrame, members: DataFrame, since_year: int, key: str
) -> DataFrame:
    """Transactions of the users registered since a year, registration as first row."""
    return survival.cohort(
        transactions,
        members,
        since_year,
        key,
        "transaction_date",
        "registration_init_time",
        "reg_year",
    )


def log_checks(
    first: DataFrame, second: DataFrame, key: str, date: str = "date", seconds: str = SECONDS_COLUMN
) -> DataFrame:
    """One row: rows of the two log files, users and days that repeat, in a file or in both, and
    rows with negative seconds. One pass over each file."""
    sides = {"a": first, "b": second}
    tagged = union_by_name(
        *[df.select(key, date, F.lit(side).alias("_side"), (F.col(seconds) < 0).alias("_neg")) for side, df in sides.items()]
    )
    per_day = tagged.groupBy(key, date).agg(
        *[F.count_if(F.col("_side") == side).alias(f"n_{side}") for side in sides],
        *[F.count_if((F.col("_side") == side) & F.col("_neg")).alias(f"neg_{side}") for side in sides],
    )
    repeats = F.col("n_a") + F.col("n_b")
    return per_day.agg(
        *overlap_counts(),
        *[F.sum(f"n_{side}").alias(f"rows_{side}") for side in sides],
        F.sum(repeats).alias("row_count"),
        F.count_if(repeats != 1).alias("repeated_keys"),
        *[F.sum(f"neg_{side}").alias(f"negatives_{side}") for side in sides],
    )


def consolidated_logs(
    first: DataFrame, second: DataFrame, target: DataFrame, key: str, date: str = "date"
) -> DataFrame:
    """Both log files side by side per user and day, with the user's label.

    Columns of the second file carry ``_update``.
    """
    update = suffix_columns(second, "_update", [key, date])
    both = full_join(first, update, [key, date])
    return both.join(target.select(key, LABEL), key, "left")


def clean_members(target: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Labelled users with cleaned member data and registration date parts."""
    joined = target.select(key, LABEL).join(members, key, "left")
    cleaned = joined.withColumns(
        {
            "city": text_or("city", UNKNOWN_CODE),
            "registered_via": text_or("registered_via", UNKNOWN_CODE),
            "bd": valid_or("bd", *AGE_RANGE, UNKNOWN_NUMBER),
            "registration_init_time": int_date("registration_init_time"),
        }
    )
    parts = date_parts(
        cleaned, "registration_init_time", "reg_year", "reg_month", "reg_day_of_week"
    )
    return fill_sentinels(
        parts,
        {
            "gender": UNKNOWN_GENDER,
            "reg_year": UNKNOWN_NUMBER,
            "reg_month": UNKNOWN_CODE,
            "reg_day_of_week": UNKNOWN_CODE,
        },
    )


def encoded_members(
    members: DataFrame, key: str, features: Sequence[str] = CATEGORICAL, test_pct: int = 40
) -> DataFrame:
    """Members with categorical features as weight of evidence, fitted on the train split.

    Train and test rows get the same encoding, so both are encoded in one pass.
    """
    return encode(members, encoding_table(members, key, features, test_pct), key, features)


def encoding_table(
    members: DataFrame, key: str, features: Sequence[str] = CATEGORICAL, test_pct: int = 40
) -> DataFrame:
    """The weight of evidence of every category, fitted on the train split."""
    table = sampling.hash_split(members, key, test_pct)
    return woe_fit(table.where(F.col("split") == "train"), features, LABEL)


def encode(
    members: DataFrame, fitted: DataFrame, key: str, features: Sequence[str] = CATEGORICAL
) -> DataFrame:
    """Members, also new ones, with the categories of a fitted encoding table."""
    encoded = woe_apply(members, fitted, features)
    return encoded.select(key, LABEL, *[f"{f}_woe" for f in features], "bd", "reg_year")


def wide_features(
    encoded: DataFrame, activity: Sequence[DataFrame], key: str, date: str = "date"
) -> DataFrame:
    """Encoded members left join their activity tables, with gaps filled with -5.

    The activity tables' dates, row counts and absolute seconds are left out. Key and
    label are not filled: a missing label is no class.
    """
    joined = left_join_all(encoded, activity, key)
    k = len(RECENCY_SUFFIXES)
    left_out = {f"{c}_{s}" for c in (date, ABSOLUTE) for s in RECENCY_SUFFIXES}
    left_out |= {f"{c}{s}" for c in ("row_count", f"sum_{ABSOLUTE}") for s in ("", f"_{k}last")}
    kept = [c for c in joined.columns if c not in left_out]
    return fill_all(joined.select(*kept), number=MISSING_FEATURE, except_=(key, LABEL))


def train_sample(features: DataFrame, key: str, test_pct: int = 40) -> tuple[DataFrame, DataFrame]:
    """A class-balanced train part and the untouched test part."""
    tagged = sampling.hash_split(features, key, test_pct)
    train = tagged.where(F.col("split") == "train").drop("split")
    return sampling.undersample(train, LABEL, key), tagged.where(F.col("split") == "test").drop("split")


def feature_columns(wide: DataFrame, key: str) -> list[str]:
    return [c for c in wide.columns if c not in (key, LABEL)]


def feature_ranking(wide: DataFrame, key: str) -> DataFrame:
    """``(rank, feature)`` of the wide table's features by elimination on a balanced, scaled train part."""
    cols = feature_columns(wide, key)
    table = materialize(wide.where(F.col(LABEL).isNotNull()), "labelled")
    train = materialize(train_sample(table, key)[0], "train")
    scaled = selection.scale_apply(train, selection.scale_fit(train, cols))
    return selection.rfe_rank(scaled, cols, LABEL)


def reduced_features(
    wide: DataFrame, key: str, limit: float = 0.5, rounds: int | None = None, ranked: DataFrame | None = None
) -> DataFrame:
    """The wide table without features collinear with a better ranked neighbour; ``ranked`` is its ranking, if made."""
    table = materialize(wide, "wide")
    ranked = feature_ranking(table, key) if ranked is None else ranked
    pairs = selection.collinear_pairs(selection.corr_long(table, feature_columns(table, key)), limit)
    kept = selection.drop_adjacent_collinear(ranked, pairs, rounds)
    names = [r["feature"] for r in kept.collect()]  # feature names
    return table.select(*names, key, LABEL)


def model_coefficients(features: DataFrame, key: str, cols: Sequence[str] = MODEL_COLUMNS) -> DataFrame:
    """``(feature, weight)`` of the logistic regression on the balanced, scaled train part, and its ``intercept``."""
    table = fill_all(features.where(F.col(LABEL).isNotNull()).select(key, LABEL, *cols), number=MISSING_FEATURE, except_=(key, LABEL))
    train = materialize(train_sample(materialize(table, "features"), key)[0], "train")
    scaled = selection.scale_apply(train, selection.scale_fit(train, list(cols)))
    doubles = [F.col(c).cast("double").alias(c) for c in (*cols, LABEL)]
    fit = fit_logistic(materialize(scaled.select(*doubles), "scaled"), list(cols), LABEL)
    rows = [(c, float(w)) for c, w in zip(cols, fit.weights, strict=True)]
    return features.sparkSession.createDataFrame([*rows, ("intercept", fit.intercept)], "feature string, weight double")


def scored_models(
    features: DataFrame,
    key: str,
    cols: Sequence[str] = MODEL_COLUMNS,
    names: Sequence[str] = models.MODEL_NAMES,
    **settings,
) -> DataFrame:
    """``(split, model, key, label, p, pred)``: the balanced train and the test part, scored by every model."""
    cols = list(cols)
    table = materialize(
        features.where(F.col(LABEL).isNotNull()).select(key, LABEL, *cols), "features"
    )
    train, test = train_sample(fill_all(table, number=MISSING_FEATURE, except_=(key, LABEL)), key)
    train = materialize(train, "train")
    scaler = materialize(selection.scale_fit(train, cols), "scaler")
    train, test = selection.scale_apply(train, scaler), selection.scale_apply(test, scaler)
    fitted = models.fit_models(train, cols, LABEL, key, names, **settings)
    return models.score_splits(fitted, {"train": train, "test": test}, cols, LABEL, key)


def model_comparison(
    features: DataFrame,
    key: str,
    cols: Sequence[str] = MODEL_COLUMNS,
    names: Sequence[str] = models.MODEL_NAMES,
    **settings,
) -> DataFrame:
    """``(model, split, metric, value)``: every model on the balanced train and the test part."""
    scored = scored_models(features, key, cols, names, **settings)
    return metrics.model_report(scored, by=["model", "split"])


def survival_table(cohort: DataFrame, key: str, keep_single: bool = False) -> DataFrame:
    """Months of membership and final label per user of a cohort."""
    return survival.tenure(cohort, key, "transaction_date", LABEL, keep_single)


def survival_curves(table: DataFrame, ci: float = 0.95) -> DataFrame:
    """Survival function and cumulative hazard of a survival table, per month."""
    return survival.survival_curves(table, "month", LABEL, ci)


def churn_by_registration(members: DataFrame) -> DataFrame:
    return quality.rate_by(members, "registered_via", LABEL, 100.0)


def churn_by_age(members: DataFrame, low: int = 15, high: int = 55) -> DataFrame:
    """Churn per age inside a range, oldest first; unknown ages left out."""
    known = members.where((F.col("bd") != UNKNOWN_NUMBER) & F.col("bd").between(low, high))
    return quality.rate_by(known, "bd", LABEL, 100.0).orderBy(F.col("bd").desc())


def churn_by_city(members: DataFrame) -> DataFrame:
    return quality.rate_by(members, "city", LABEL, 100.0)


def with_segments(members: DataFrame, age: int = 24) -> DataFrame:
    """Adds the age flag and the city group."""
    return members.withColumns(
        {
            f"is_{age}_or_older": at_least("bd", age),
            "city_groups": map_groups("city", CITY_GROUPS, OTHER_CITY_GROUP),
        }
    )


def churn_by_city_group(members: DataFrame) -> DataFrame:
    rates = quality.rate_by(with_segments(members), "city_groups", LABEL, 100.0)
    return rates.withColumn("city_groups", F.col("city_groups").cast("string"))


def churn_by_segment(members: DataFrame) -> DataFrame:
    """Churn per age flag, city group and registration method, highest first."""
    keys = ["is_24_or_older", "city_groups", "registered_via"]
    return quality.rate_by(with_segments(members), keys, LABEL)
