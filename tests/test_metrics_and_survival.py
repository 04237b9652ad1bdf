import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentia.operators import metrics, survival
from retentia.plans import views as v


def scored(spark, pairs):
    df = spark.createDataFrame([(y, float(p)) for y, p in pairs], "label int, p double")
    return metrics.cut_scores(df)


def test_cut_is_strict(spark):
    got = [r["pred"] for r in scored(spark, [(0, 0.5), (0, 0.51)]).collect()]
    assert got == [0, 1]


def test_binary_metrics_of_nothing_predicted(spark):
    row = metrics.binary_metrics(scored(spark, [(1, 0.1), (0, 0.2)])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_confusion_has_all_cells(spark):
    got = {(r["label"], r["pred"]): r["n"] for r in metrics.confusion(scored(spark, [(1, 0.9), (1, 0.8)])).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_auc_against_all_pairs(spark, limit):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 400), rng.integers(0, 40, 400) / 40
    df = scored(spark, zip(y.tolist(), p.tolist(), strict=True))
    diff = p[y == 1][:, None] - p[y == 0]
    want = ((diff > 0) + 0.5 * (diff == 0)).mean()
    got = metrics.roc_auc(df, digits=12, one_task_rows=limit).first()[0]
    assert math.isclose(got, want, abs_tol=1e-10)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_corners_leave_the_curve_as_it_is(spark, limit):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(500), 2)
    y = (rng.random(500) < np.where(p > 0.7, 1, np.where(p < 0.3, 0, 0.5))).astype(int)
    df = scored(spark, zip(y.tolist(), p.tolist(), strict=True))
    every = metrics.roc_curve(df, one_task_rows=limit).toPandas().sort_values(["fpr", "tpr"])
    thin = metrics.roc_curve(df, thin=True, one_task_rows=limit).toPandas()
    # The rule of the usual library: second differences of both counts.
    counts = [(int(((p == c) & (y == 1)).sum()), int(((p == c) & (y == 0)).sum())) for c in np.unique(p)[::-1]]
    keep = [i for i in range(len(counts)) if i in (0, len(counts) - 1) or counts[i] != counts[i + 1]]
    assert sorted(thin.threshold.dropna(), reverse=True) == [np.unique(p)[::-1][i] for i in keep]
    assert len(thin) < len(every)


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(scored(spark, [(1, 0.3), (1, 0.4)])).first()[0] is None


def test_perfect_scores(spark):
    df = scored(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)])
    report = {r["metric"]: r["value"] for r in metrics.model_report(df).collect()}
    assert report == dict.fromkeys(["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"], 1.0)


def test_curves_start_and_end(spark):
    df = scored(spark, [(0, 0.1), (1, 0.6), (0, 0.6), (1, 0.9)])
    roc = [(r["fpr"], r["tpr"]) for r in metrics.roc_curve(df).orderBy("fpr", "tpr").collect()]
    assert roc == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]
    pr = [(r["recall"], round(r["precision"], 4)) for r in metrics.pr_curve(df).orderBy("recall", F.col("precision").desc()).collect()]
    assert pr == [(0.0, 1.0), (0.5, 1.0), (1.0, 0.6667), (1.0, 0.5)]


def test_sweep_equals_single_cuts_by_group(spark):
    df = v_scores(spark)
    cuts = [0.2, 0.5, 2.0]
    got = {(r["g"], r["threshold"]): (r["tp"], r["fp"], r["tn"], r["fn"]) for r in metrics.threshold_sweep(df, cuts, ["g"]).collect()}
    for t in cuts:
        for r in metrics.binary_metrics(metrics.cut_scores(df, t), ["g"]).collect():
            assert got[(r["g"], t)] == (r["tp"], r["fp"], r["tn"], r["fn"])


def v_scores(spark):
    return spark.range(300).select(
        (F.col("id") % 2).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("label"), ((F.col("id") * 37 % 101) / 101).alias("p")
    )


@pytest.mark.parametrize("limit", [0, 10**6])
def test_report_by_group_matches_single_reports(spark, limit):
    df = metrics.cut_scores(v_scores(spark))
    both = {(r["g"], r["metric"]): r["value"] for r in metrics.model_report(df, ["g"], one_task_rows=limit).collect()}
    for g in (0, 1):
        for r in metrics.model_report(df.where(F.col("g") == g)).collect():
            assert math.isclose(both[(g, r["metric"])], r["value"], abs_tol=1e-9)


def transactions(spark):
    data = [
        ("single", date(2016, 1, 5), 0),
        ("twice", date(2016, 1, 5), 1),
        ("twice", date(2016, 1, 5), 1),
        ("month", date(2016, 1, 31), None),
        ("month", date(2016, 2, 29), 1),
        ("month", date(2016, 3, 31), 1),
        ("half", date(2016, 1, 1), 0),
        ("half", date(2016, 1, 10), 0),
        ("undated", None, 1),
    ]
    return spark.createDataFrame(data, "u string, d date, y int")


def test_tenure(spark):
    got = {r["u"]: (r["month"], r["y"]) for r in survival.tenure(transactions(spark), "u", "d", "y").collect()}
    assert got == {"twice": (0.0, 1), "month": (2.0, 1), "half": (0.0, 0)}
    kept = {r["u"]: r["month"] for r in survival.tenure(transactions(spark), "u", "d", "y", keep_single=True).collect()}
    assert kept["single"] == 0.0 and len(kept) == 4


def textbook(spark):
    # Times with an event flag: 6, 6, 6 events, 6 censored, 7 event, 9 censored, 10 event, 10 censored.
    data = [(6, 1), (6, 1), (6, 1), (6, 0), (7, 1), (9, 0), (10, 1), (10, 0)]
    return spark.createDataFrame([(float(t), e) for t, e in data] + [(5.0, None)], "t double, e int")


@pytest.mark.parametrize("limit", [0, 10**6])
def test_kaplan_meier_by_hand(spark, limit):
    km = survival.kaplan_meier(textbook(spark), "t", "e", one_task_rows=limit)
    got = [(r["timeline"], r["at_risk"], round(r["km_estimate"], 10)) for r in km.orderBy("timeline").collect()]
    s6, s7 = 5 / 8, 5 / 8 * 3 / 4
    assert got == [
        (0.0, 8, 1.0),
        (6.0, 8, round(s6, 10)),
        (7.0, 4, round(s7, 10)),
        (9.0, 3, round(s7, 10)),
        (10.0, 2, round(s7 / 2, 10)),
    ]
    band = {r["timeline"]: (r["km_lower"], r["km_upper"]) for r in km.collect()}
    assert band[0.0] == (1.0, 1.0)
    var = 3 / (8 * 5)
    spread = 1.959963984540054 * math.sqrt(var) / math.log(s6)
    want = sorted(math.exp(-math.exp(math.log(-math.log(s6)) + x)) for x in (spread, -spread))
    assert np.allclose(sorted(band[6.0]), want) and band[6.0][0] < s6 < band[6.0][1]
    assert survival.median_survival(km).first()[0] == 7.0


def test_survival_reaches_zero_and_median_may_be_infinite(spark):
    dead = spark.createDataFrame([(1.0, 1), (2.0, 1)], "t double, e int")
    km = survival.kaplan_meier(dead, "t", "e").orderBy("timeline").collect()
    assert [r["km_estimate"] for r in km][-1] == 0.0 and km[-1]["km_lower"] is None
    assert survival.median_survival(survival.kaplan_meier(dead, "t", "e")).first()[0] == 1.0
    alive = spark.createDataFrame([(1.0, 0)], "t double, e int")
    assert survival.median_survival(survival.kaplan_meier(alive, "t", "e")).first()[0] == math.inf


def test_nelson_aalen_ties(spark):
    plain = survival.nelson_aalen(textbook(spark), "t", "e", ties="plain").orderBy("timeline").collect()
    assert math.isclose(plain[1]["cumulative_hazard"], 3 / 8)
    fh = survival.nelson_aalen(textbook(spark), "t", "e").orderBy("timeline").collect()
    assert math.isclose(fh[1]["cumulative_hazard"], 1 / 8 + 1 / 7 + 1 / 6)
    with pytest.raises(ValueError):
        survival.nelson_aalen(textbook(spark), "t", "e", ties="other")


def test_harmonic_difference(spark):
    pairs = [(1, 0), (5, 5), (8, 5), (31, 0), (32, 1), (33, 31), (40, 2), (1000, 0), (1000, 999), (5000, 4000)]
    df = spark.createDataFrame(pairs, "n bigint, m bigint")
    got = df.select("n", "m", survival.harmonic_difference(F.col("n"), F.col("m")).alias("h")).collect()
    for r in got:
        want = math.fsum(1 / k for k in range(r["m"] + 1, r["n"] + 1))
        assert math.isclose(r["h"], want, rel_tol=1e-9, abs_tol=1e-13), r
    big = spark.createDataFrame([(10**12, 10**12 - 1)], "n bigint, m bigint")
    assert math.isclose(big.select(survival.harmonic_difference(F.col("n"), F.col("m"))).first()[0], 1e-12, rel_tol=1e-3)


def test_curve_at(spark):
    curve = spark.createDataFrame([(0.0, 0.0), (5.0, 0.5), (12.0, 0.9)], "timeline double, h double")
    got = {r["timeline"]: r["h"] for r in survival.curve_at(curve, [6, 12, 18, -1], "h").collect()}
    assert got == {6.0: 0.5, 12.0: 0.9, 18.0: 0.9, -1.0: None}
    exact = survival.curve_at(curve, [6, 12], "h", exact=True).collect()
    assert [tuple(r) for r in exact] == [(12.0, 0.9)]


def test_cohort_adds_registrations_once(spark):
    tx = spark.createDataFrame(
        [("a", date(2016, 1, 1), 1), ("a", date(2016, 2, 1), 1), ("old", date(2016, 1, 1), 0)],
        "u string, d date, y int",
    )
    members = spark.createDataFrame(
        [("a", date(2016, 1, 1), 2016), ("b", date(2015, 3, 1), 2015), ("old", date(2010, 1, 1), 2010)],
        "u string, reg date, reg_year int",
    )
    got = survival.cohort(tx, members, 2015, "u", "d", "reg", "reg_year")
    assert sorted((r["u"], r["d"], r["y"]) for r in got.collect() if r["u"] == "a") == [
        ("a", date(2016, 1, 1), 1), ("a", date(2016, 2, 1), 1),
    ]
    assert [tuple(r) for r in got.where("u = 'b'").select("d", "y").collect()] == [(date(2015, 3, 1), None)]
    assert got.where("u = 'old'").count() == 0


def test_registrations_come_first_in_the_cohort(spark, sf_dir):
    before = v.labelled_transactions(spark, sf_dir).join(v.cohort_transactions(spark, sf_dir).select(v.KEY).distinct(), v.KEY)
    low = before.agg(F.min("transaction_date")).first()[0]
    assert v.cohort_transactions(spark, sf_dir).agg(F.min("transaction_date")).first()[0] <= low


def test_km_curve_only_falls(spark, sf_dir):
    km = survival.kaplan_meier(v.survival(spark, sf_dir), "month", "is_churn_final").orderBy("timeline").toPandas()
    assert (km.km_estimate.diff().dropna() <= 1e-12).all() and isinstance(km, pd.DataFrame)
    assert km.at_risk.iloc[0] == km.removed.sum()
