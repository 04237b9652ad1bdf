import os
import re

import pandas as pd
import pytest

from retentia.checks import QUERIES
from retentia.plans import reports
from retentia.plans import views as v
from retentia.plans.jobs import OUTPUTS, THRESHOLDS, Job, run
from retentia.sources.tables import materialize, scratch_scope


def job(spark, sf_dir, out, **settings):
    return Job(
        spark,
        str(out),
        v.target_a(spark, sf_dir),
        v.target_b(spark, sf_dir),
        v.members(spark, sf_dir),
        [v.transactions_a(spark, sf_dir), v.transactions_b(spark, sf_dir)],
        [v.logs_a(spark, sf_dir), v.logs_b(spark, sf_dir)],
        key=v.KEY,
        since_year=v.COHORT_YEAR,
        model_settings={"names": ["log_reg", "naive_bayes"]},
        **settings,
    )


def same(a, b, digits=6):
    a, b = a.toPandas().round(digits), b.toPandas().round(digits)
    names = sorted(a.columns)
    a, b = a[names].sort_values(names), b[names].sort_values(names)
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True), check_dtype=False)


def test_all_outputs_are_written_and_match_the_queries(spark, sf_dir, tmp_path):
    j = job(spark, sf_dir, tmp_path)
    before = list(OUTPUTS)
    after = before[before.index("reduced_features") + 1 :]
    paths = run(j, before[: before.index("reduced_features") + 1])
    ranked = j.read("feature_ranking").toPandas().sort_values("rank")
    assert list(ranked["rank"]) == list(range(1, len(j.read("wide_features").columns) - 1))
    assert set(j.read("reduced_features").columns) - {v.KEY, reports.LABEL} <= set(ranked.feature)
    # The models are given their columns whatever the elimination kept.
    j.write("reduced_features", j.read("wide_features").select(v.KEY, reports.LABEL, *reports.MODEL_COLUMNS))
    paths |= run(job(spark, sf_dir, tmp_path), after)
    assert len(paths) == len(OUTPUTS)
    assert {r["feature"] for r in j.read("model_coefficients").collect()} == {*reports.MODEL_COLUMNS, "intercept"}
    for output, query in {
        "churn_target": "q1_churn_target",
        "cohort_transactions": "q4_cohort_transactions",
        "activity_2ndlast": "q7_logs_2ndlast_row",
        "wide_features": "q13_wide_features",
        "survival_curves": "q16_survival_curves",
        "churn_by_segment": "q17_churn_by_segment",
        "log_checks": "q5_log_checks",
        "activity_last_3_sums": "q10_logs_last_3_sums",
        "median_survival": "k4_median_survival",
        "hazard_at_months": "k7_curve_at_times",
        "month_histogram": "a21_histogram",
        "encoded_members": "q12_encoded_members",
    }.items():
        same(j.read(output), QUERIES[query](spark, sf_dir))
    assert j.read("model_comparison").count() == 2 * 2 * 6
    assert j.read("model_threshold_sweep").count() == 2 * 2 * len(THRESHOLDS)
    starts = j.read("model_roc_curves").where("threshold IS NULL")
    assert starts.count() == j.read("model_pr_curves").where("threshold IS NULL").count() == 2 * 2
    values = {r["variable"]: r["iv"] for r in j.read("information_value").collect()}
    assert set(values) == set(reports.CATEGORICAL)


def test_csv_outputs_come_back_with_their_types(spark, sf_dir, tmp_path):
    j = job(spark, sf_dir, tmp_path, fmt="csv")
    run(j, ["churn_target", "clean_members", "churn_by_age"])
    same(j.read("clean_members"), QUERIES["q11_clean_members"](spark, sf_dir))


def test_a_new_job_takes_up_csv_outputs_with_their_types(spark, sf_dir, tmp_path):
    labels = spark.createDataFrame([("007", 1), ("010", 0)], "user_id string, is_churn int")
    updates = spark.createDataFrame([("007", 0)], "user_id string, is_churn int")
    first = job(spark, sf_dir, tmp_path, fmt="csv")
    first.labels, first.updates = labels, updates
    run(first, ["churn_target"])
    again = job(spark, sf_dir, tmp_path, fmt="csv").read("churn_target")
    assert {(r["user_id"], r[reports.LABEL]) for r in again.collect()} == {("007", 0), ("010", 0)}


def test_scratch_tables_of_a_scope_go(spark):
    with scratch_scope(spark):
        inner = materialize(spark.range(3), "inner")
        folder = inner.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
        assert inner.count() == 3 and os.path.isdir(re.sub("^/+", "/", folder))
    assert not os.path.exists(re.sub("^/+", "/", folder))


def test_reduced_features_keep_rows_key_and_label(spark, sf_dir):
    wide = QUERIES["q13_wide_features"](spark, sf_dir).select(
        v.KEY, reports.LABEL, "bd", "reg_year", "city_woe", "sum_num_25", "sum_num_50"
    )
    reduced = reports.reduced_features(wide, v.KEY)
    assert set(reduced.columns) <= set(wide.columns)
    assert {v.KEY, reports.LABEL} <= set(reduced.columns) and reduced.count() == wide.count()


def test_unknown_output_is_refused(spark, sf_dir, tmp_path):
    with pytest.raises(ValueError):
        run(job(spark, sf_dir, tmp_path), ["nothing"])
