"""Models, evaluation and survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.checks import fits
from retentia.checks.registry import add, r6, rounded, slot
from retentia.functions.columns import fill_all
from retentia.operators import metrics, models, neighbors, selection, survival, trees
from retentia.plans import reports
from retentia.plans import views as v
from retentia.sources.tables import materialize

K = v.KEY
LABEL = reports.LABEL
COLS = ["registered_via_woe", "bd", "city_woe"]

# Models


def _samples(s, d):
    """Balanced, scaled train part and scaled test part of the encoded members."""
    members = materialize(v.clean_members(s, d), "members")
    encoded = reports.encoded_members(members, K)
    table = materialize(
        fill_all(encoded.select(K, LABEL, *COLS), number=reports.MISSING_FEATURE, except_=(K, LABEL)),
        "features",
    )
    train, test = reports.train_sample(table, K)
    train = materialize(train, "train")
    scaler = selection.scale_fit(train, COLS)
    return selection.scale_apply(train, scaler), selection.scale_apply(test, scaler)


def _scored(name):
    def run(s, d):
        train, test = _samples(s, d)
        fitted = models.fit_models(train, COLS, LABEL, K, [name])
        return models.score(fitted, test, COLS, LABEL, K)

    return run


def m1_coefficients(s, d):
    train, _ = _samples(s, d)
    fit = models.fit_models(train, COLS, LABEL, K, ["log_reg"])["log_reg"]
    return s.createDataFrame(models.coefficients(fit), "feature string, weight double")


add("m1_logistic_regression", _scored("log_reg"))
add("m1_coefficients", m1_coefficients)
add("m2_decision_tree", _scored("decision_tree"))


def m3(s, d):
    members = v.members(s, d).join(v.target(s, d), K)
    x, y = F.col("bd").cast("double").alias("x"), F.col("city").cast("double").alias("y")
    points = materialize(members.select(K, LABEL, x, y), "points")
    train, test = reports.train_sample(points, K)
    return neighbors.knn_score(train, test, ["x", "y"], LABEL, K, k=5).select(K, r6("p").alias("p"))


add(
    "m3_nearest_neighbours",
    m3,
    """WITH points AS (SELECT user_id, is_churn_final AS label, CAST(bd AS DOUBLE) AS x,
            CAST(city AS DOUBLE) AS y,
            ('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 60 AS is_train
        FROM members JOIN target USING (user_id)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY label
            ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) AS rn FROM points WHERE is_train),
    train AS (SELECT * FROM numbered
        WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM numbered GROUP BY label))),
    near AS (SELECT t.user_id, r.label, row_number() OVER (PARTITION BY t.user_id
            ORDER BY (t.x - r.x) * (t.x - r.x) + (t.y - r.y) * (t.y - r.y), r.user_id) AS rank
        FROM points t, train r WHERE NOT t.is_train)
    SELECT user_id, round(avg(label), 6) AS p FROM near WHERE rank <= 5 GROUP BY 1""",
)
add("m3_nearest_neighbours_scaled", _scored("knn"))
add("m4_random_forest", _scored("random_forest"))
# The posterior does not change when a feature is shifted and scaled, so the SQL does
# without the scaling.
_FEATURES_SQL = f"""features AS (SELECT user_id, is_churn_final AS label,
        coalesce(registered_via_woe, -5) AS a, CAST(coalesce(bd, -5) AS DOUBLE) AS b,
        coalesce(city_woe, -5) AS c, {slot('user_id')} < 60 AS is_train FROM encoded),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) AS rn FROM features WHERE is_train),
    train AS (SELECT * FROM numbered
        WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM numbered GROUP BY label)))"""
add(
    "m5_naive_bayes",
    lambda s, d: rounded(_scored("naive_bayes")(s, d), "p", digits=5),
    f"""WITH {_FEATURES_SQL},
    stats AS (SELECT label AS y, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc,
        var_pop(a) AS va, var_pop(b) AS vb, var_pop(c) AS vc FROM train GROUP BY 1),
    logs_of AS (SELECT user_id, label, y, -(ln(va * vb * vc) + (a - ma) ^ 2 / va + (b - mb) ^ 2 / vb
        + (c - mc) ^ 2 / vc) / 2 AS l FROM features, stats WHERE NOT is_train),
    posterior AS (SELECT user_id, label, 1 / (1 + exp(max(l) FILTER (WHERE y = 0) - max(l) FILTER (WHERE y = 1)))
        AS p FROM logs_of GROUP BY 1, 2)
    SELECT 'naive_bayes' AS model, user_id, label, round(p, 5) AS p, CAST(p > 0.5 AS INTEGER) AS pred
    FROM posterior""",
)
add("m6_boosted_trees", _scored("boosted_trees"))


def m7(s, d):
    train, test = _samples(s, d)
    names = ["log_reg", "decision_tree", "naive_bayes", "knn"]
    fitted = models.fit_models(train, COLS, LABEL, K, names)
    return models.compare_models(fitted, {"train": train, "test": test}, COLS, LABEL, K)


add("m7_model_registry", m7)


def m8(s, d):
    train, test = _samples(s, d)
    fitted = models.fit_models(train, COLS, LABEL, K, ["log_reg", "naive_bayes"])
    return models.score(fitted, test, COLS, LABEL, K)


add("m8_batch_scoring", m8)


def m1_gradient(s, d):
    """The slope of the penalised loss at the fitted weights, which is zero for every feature at the optimum."""
    train, _ = _samples(s, d)
    train = materialize(train, "scaled")
    fit = models.fit_models(train, COLS, LABEL, K, ["log_reg"])["log_reg"]
    weights = dict(models.coefficients(fit))
    margin = sum((F.col(c) * F.lit(w) for c, w in weights.items()), F.lit(float(fit.intercept)))
    miss = 1 / (1 + F.exp(-margin)) - F.col(LABEL)
    slopes = [F.struct(F.lit(c).alias("feature"), (F.avg(miss * F.col(c)) + F.lit(w) / F.count("*")).alias("slope")) for c, w in weights.items()]
    rows = train.agg(F.array(*slopes).alias("all")).select(F.explode("all").alias("one")).select("one.*")
    return rows.select("feature", (F.abs("slope") < 1e-5).alias("is_zero"))


add(
    "m1_logistic_gradient",
    m1_gradient,
    " UNION ALL ".join(f"SELECT '{c}' AS feature, true AS is_zero" for c in COLS),
)


def _rounded_members(s, d):
    # Categories with equal shares differ in the last digit of their weight, each engine its own way; rounded
    # weights tie in both, which cuts, neighbours and the areas under the curves depend on.
    members = materialize(v.clean_members(s, d), "members")
    encoded = rounded(reports.encoded_members(members, K), "registered_via_woe", "city_woe", digits=9)
    return materialize(encoded, "encoded")


def _rounded_samples(s, d):
    """As ``_samples``, with features that are the same numbers in both engines."""
    filled = fill_all(_rounded_members(s, d).select(K, LABEL, *COLS), number=reports.MISSING_FEATURE, except_=(K, LABEL))
    train, test = reports.train_sample(filled, K)
    train = materialize(train, "train")
    scaler = selection.scale_fit(train, COLS)
    return tuple(rounded(selection.scale_apply(part, scaler), *COLS) for part in (train, test))


_ROUNDED_SQL = _FEATURES_SQL
for _c in ("registered_via_woe", "city_woe"):
    _ROUNDED_SQL = _ROUNDED_SQL.replace(f"coalesce({_c}, -5)", f"round(coalesce({_c}, -5), 9)")
_SCALED_SQL = f"""{_ROUNDED_SQL},
    scale AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, coalesce(nullif(stddev_pop(a), 0), 1) AS sa,
        coalesce(nullif(stddev_pop(b), 0), 1) AS sb, coalesce(nullif(stddev_pop(c), 0), 1) AS sc FROM train),
    parts AS (SELECT true AS is_train, user_id, label, a, b, c FROM train
        UNION ALL SELECT false, user_id, label, a, b, c FROM features WHERE NOT is_train),
    samples AS MATERIALIZED (SELECT is_train, user_id, label, round((a - ma) / sa, 6) AS a, round((b - mb) / sb, 6) AS b,
        round((c - mc) / sc, 6) AS c FROM parts, scale)"""


def _by_value(fit, name, on_train=False, digits=6):
    """Scores of one model on the test (or the train) part, rounded."""

    def run(s, d):
        train, test = (materialize(part, "sample") for part in _rounded_samples(s, d))
        scored = models.score({name: fit(train)}, train if on_train else test, COLS, LABEL, K)
        return rounded(scored, "p", digits=digits)

    return run


def _one(name):
    return lambda train: models.fit_models(train, COLS, LABEL, K, [name])[name]


def _scores_sql(name, steps, p, source, where="NOT is_train", digits=6):
    return (
        f"WITH {_SCALED_SQL}, {', '.join(steps)} SELECT '{name}' AS model, user_id, label, round(p, {digits}) AS p, "
        f"CAST(p > 0.5 AS INTEGER) AS pred FROM (SELECT user_id, label, {p} AS p FROM {source} WHERE {where})"
    )


_ABC = ["a", "b", "c"]
_ONES = "every AS (SELECT 1 AS m0, 1 AS m1, 1 AS m2)"
_NEWTON = [_ONES, "fit_on AS (SELECT * FROM samples WHERE is_train)", *fits.newton("fit_on", _ABC, "label", "fit", "every")]
_LOGISTIC = "1 / (1 + exp(-(w0 * a + w1 * b + w2 * c + w3)))"
_GINI = fits.tree(
    "(SELECT *, 1.0::DOUBLE - label AS s0, CAST(label AS DOUBLE) AS s1 FROM samples)", _ABC, 2,
    "({0} * {0} + {1} * {1}) / ({0} + {1})", "{0} + {1} > 0", "{0} > 0 AND {1} > 0", "true",
)
add("m1_logistic_rows", _by_value(_one("log_reg"), "log_reg"), _scores_sql("log_reg", _NEWTON, _LOGISTIC, "samples, fit8"))
add(
    "m2_tree_rows",
    _by_value(lambda train: trees.fit_trees(train, COLS, LABEL, K, depth=2), "decision_tree"),
    _scores_sql("decision_tree", _GINI, "t1 / (t0 + t1)", "fitted"),
)
# The levels above small nodes, which take another way to the same tree.
add(
    "m2_tree_in_levels",
    _by_value(lambda train: trees.fit_trees(train, COLS, LABEL, K, depth=2, small=1), "decision_tree"),
    _scores_sql("decision_tree", _GINI, "t1 / (t0 + t1)", "fitted"),
)
_PURE_SQL = ["alike AS (SELECT *, avg(label) OVER (PARTITION BY a, b, c) AS mean FROM samples WHERE is_train)"]
# Leaves are pure or hold rows that agree in all features.
add(
    "m2_pure_tree",
    _by_value(_one("decision_tree"), "decision_tree", on_train=True),
    _scores_sql("decision_tree", _PURE_SQL, "mean", "alike", "true"),
)
add(
    "m3_scaled_neighbours_rows",
    _by_value(_one("knn"), "knn"),
    _scores_sql(
        "knn",
        ["""near AS (SELECT t.user_id, t.label, r.label AS vote, row_number() OVER (PARTITION BY t.user_id
            ORDER BY (t.a - r.a) * (t.a - r.a) + (t.b - r.b) * (t.b - r.b) + (t.c - r.c) * (t.c - r.c), r.user_id) AS place
        FROM samples t, samples r WHERE NOT t.is_train AND r.is_train)""",
        "votes AS (SELECT user_id, label, avg(vote) AS mean FROM near WHERE place <= 5 GROUP BY 1, 2)"],
        "mean", "votes", "true",
    ),
)
# Without a bootstrap every tree has pure leaves, whichever features its nodes drew.
add(
    "m4_forest_rows",
    _by_value(lambda train: trees.fit_trees(train, COLS, LABEL, K, trees=5, share=1), "random_forest", on_train=True),
    _scores_sql("random_forest", _PURE_SQL, "mean", "alike", "true"),
)


def _boosted_sql(depth: int) -> list[str]:
    return fits.tree(
        "(SELECT *, 0.5::DOUBLE - label AS s0, 0.25::DOUBLE AS s1 FROM samples)", _ABC, depth,
        "{0} * {0} / ({1} + 1)", "{1} >= 1", "{1} >= 2", "quality - whole > 1e-6",
    )


for _query, _depth, _small in (("m6_boosted_stump", 1, trees.SMALL), ("m6_boosted_rows", 2, trees.SMALL), ("m6_boosted_in_passes", 2, 1)):
    add(
        _query,
        _by_value(lambda train, n=_depth, small=_small: trees.fit_boosted(train, COLS, LABEL, K, rounds=1, depth=n, small=small), "boosted_trees"),
        _scores_sql("boosted_trees", _boosted_sql(_depth), "1 / (1 + exp(0.1::DOUBLE * t0 / (t1 + 1)))", "fitted"),
    )


def _batch(s, d):
    train, test = (materialize(part, "sample") for part in _rounded_samples(s, d))
    fitted = models.fit_models(train, COLS, LABEL, K, ["log_reg", "naive_bayes"])
    return rounded(models.score(fitted, test, COLS, LABEL, K), "p", digits=5)


_BAYES = """stats AS (SELECT label AS y, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc,
        var_pop(a) AS va, var_pop(b) AS vb, var_pop(c) AS vc FROM samples WHERE is_train GROUP BY 1),
    logs_of AS (SELECT user_id, label, y, -(ln(va * vb * vc) + (a - ma) ^ 2 / va + (b - mb) ^ 2 / vb
        + (c - mc) ^ 2 / vc) / 2 AS l FROM samples, stats WHERE NOT is_train),
    bayes AS (SELECT user_id, label, 1 / (1 + exp(max(l) FILTER (WHERE y = 0) - max(l) FILTER (WHERE y = 1))) AS p
        FROM logs_of GROUP BY 1, 2)"""
add(
    "m8_batch_rows",
    _batch,
    f"WITH {_SCALED_SQL}, {', '.join(_NEWTON)}, {_BAYES} SELECT model, user_id, label, round(p, 5) AS p, "
    "CAST(p > 0.5 AS INTEGER) AS pred FROM (SELECT 'naive_bayes' AS model, user_id, label, p FROM bayes "
    f"UNION ALL SELECT 'log_reg', user_id, label, {_LOGISTIC} FROM samples, fit8 WHERE NOT is_train)",
)

_CELLS = (
    "count(*) FILTER (WHERE label = 1 AND {hat}) AS tp, count(*) FILTER (WHERE label = 0 AND {hat}) AS fp, "
    "count(*) FILTER (WHERE label = 0 AND NOT {hat}) AS tn, count(*) FILTER (WHERE label = 1 AND NOT {hat}) AS fn"
)
_RATE_COLS = {
    "accuracy": "(tp + tn) / nullif(tp + fp + tn + fn, 0)",
    "precision": "tp / nullif(tp + fp, 0)",
    "recall": "tp / nullif(tp + fn, 0)",
    "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)",
}


def _rates(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round(coalesce({_RATE_COLS[n]}, 0), {digits}) AS {n}" for n in names)


# Every metric of the one model whose scores have an SQL form, on both parts.
_REPORT_SQL = f"""WITH {_ROUNDED_SQL},
    stats AS (SELECT label AS y, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc,
        var_pop(a) AS va, var_pop(b) AS vb, var_pop(c) AS vc FROM train GROUP BY 1),
    parts AS (SELECT 'train' AS split, user_id, label, a, b, c FROM train
        UNION ALL SELECT 'test', user_id, label, a, b, c FROM features WHERE NOT is_train),
    logs_of AS (SELECT split, user_id, label, y, -(ln(va * vb * vc) + (a - ma) ^ 2 / va + (b - mb) ^ 2 / vb
        + (c - mc) ^ 2 / vc) / 2 AS l FROM parts, stats),
    posterior AS (SELECT split, user_id, label,
        1 / (1 + exp(max(l) FILTER (WHERE y = 0) - max(l) FILTER (WHERE y = 1))) AS p FROM logs_of GROUP BY 1, 2, 3),
    rates AS (SELECT split, {_rates('accuracy', 'precision', 'recall', 'f1', digits=4)}
        FROM (SELECT split, {_CELLS.format(hat='p > 0.5')} FROM posterior GROUP BY 1)),
    summed AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
        FROM (SELECT split, p, count(*) FILTER (WHERE label = 1) AS pos,
            count(*) FILTER (WHERE label = 0) AS neg FROM posterior GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY split ORDER BY p DESC)),
    areas AS (SELECT split, round(sum(neg * (tp - pos / 2)) / (sum(pos)::DOUBLE * sum(neg)), 4) AS roc_auc,
        round(sum(pos * (tp / (tp + fp) + coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), 1)) / 2) / sum(pos), 4)
            AS pr_auc FROM summed GROUP BY 1)
    SELECT 'naive_bayes' AS model, split, metric, value FROM (rates JOIN areas USING (split))
        UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1, roc_auc, pr_auc))"""


def _registry_report(s, d):
    filled = fill_all(_rounded_members(s, d).select(K, LABEL, *COLS), number=reports.MISSING_FEATURE, except_=(K, LABEL))
    train, test = reports.train_sample(filled, K)
    train = materialize(train, "train")
    scaler = selection.scale_fit(train, COLS)
    train, test = selection.scale_apply(train, scaler), selection.scale_apply(test, scaler)
    fitted = models.fit_models(train, COLS, LABEL, K, ["naive_bayes"])
    return models.compare_models(fitted, {"train": train, "test": test}, COLS, LABEL, K)


add("m7_registry_report", lambda s, d: rounded(_registry_report(s, d), "value", digits=4), _REPORT_SQL)


def _comparison(s, d):
    return reports.model_comparison(_rounded_members(s, d), K, names=["naive_bayes"])


add("q15_comparison_report", lambda s, d: rounded(_comparison(s, d), "value", digits=4), _REPORT_SQL)

# Evaluation


add(
    "v1_binary_metrics",
    lambda s, d: rounded(metrics.binary_metrics(v.scores(s, d)), "accuracy", "precision", "recall", "f1"),
    f"SELECT tp, fp, tn, fn, {_rates('accuracy', 'precision', 'recall', 'f1')} "
    f"FROM (SELECT {_CELLS.format(hat='pred = 1')} FROM scores)",
)
add(
    "v2_confusion",
    lambda s, d: metrics.confusion(v.scores(s, d)),
    "SELECT label, pred, count(user_id) AS n FROM (SELECT * FROM (VALUES (0), (1)) a(label), "
    "(VALUES (0), (1)) b(pred)) LEFT JOIN scores USING (label, pred) GROUP BY 1, 2",
)
_CUTS = [0.1, 0.25, 0.5, 0.75, 0.9, 1.5]
add(
    "v3_threshold_sweep",
    lambda s, d: rounded(metrics.threshold_sweep(v.scores(s, d), _CUTS), "accuracy", "precision", "recall"),
    f"SELECT threshold, tp, fp, tn, fn, {_rates('accuracy', 'precision', 'recall')} FROM ("
    + " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS threshold, {_CELLS.format(hat=f'p > {t}')} FROM scores" for t in _CUTS
    )
    + ")",
)
_AUC_SQL = """SELECT round(sum(neg * (tp - pos / 2)) / (any_value(positives)::DOUBLE * any_value(negatives)), 6)
    AS roc_auc FROM curve"""
add("v4_roc_auc", lambda s, d: metrics.roc_auc(v.scores(s, d)), _AUC_SQL)
add(
    "v4_roc_auc_in_ranges",
    lambda s, d: metrics.roc_auc(v.scores(s, d), one_task_rows=0),
    """SELECT round(sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6)
        AS roc_auc
    FROM (SELECT p FROM scores WHERE label = 1) a, (SELECT p FROM scores WHERE label = 0) b""",
)
add(
    "v5_roc_curve",
    lambda s, d: rounded(metrics.roc_curve(v.scores(s, d)), "threshold", "fpr", "tpr"),
    "SELECT round(p, 6) AS threshold, round(fp / negatives, 6) AS fpr, round(tp / positives, 6) AS tpr FROM curve "
    "UNION ALL SELECT NULL, 0, 0",
)
# Points within a run of equal steps are left out, the first and the last score stay.
for _suffix, _rows in (("", {}), ("_in_ranges", {"one_task_rows": 0})):
    add(
        f"v5_roc_corners{_suffix}",
        lambda s, d, kw=_rows: rounded(metrics.roc_curve(v.grouped_scores(s, d), by=["grp"], thin=True, **kw), "threshold", "fpr", "tpr"),
        """WITH steps AS (SELECT *, lead(pos) OVER w AS pos1, lead(neg) OVER w AS neg1, lag(p) OVER w AS p0, lead(p) OVER w AS p1
            FROM grouped_curve WINDOW w AS (PARTITION BY grp ORDER BY p DESC))
        SELECT grp, round(p, 6) AS threshold, round(fp / negatives, 6) AS fpr, round(tp / positives, 6) AS tpr FROM steps
        WHERE p0 IS NULL OR p1 IS NULL OR pos <> pos1 OR neg <> neg1
        UNION ALL SELECT DISTINCT grp, NULL, 0, 0 FROM grouped_curve""",
    )
add(
    "v6_pr_curve",
    lambda s, d: rounded(metrics.pr_curve(v.scores(s, d)), "threshold", "precision", "recall"),
    "SELECT round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / positives, 6) AS recall "
    "FROM curve UNION ALL SELECT NULL, 1, 0",
)
_BY = ["grp"]
for _suffix, _rows in (("", {}), ("_in_ranges", {"one_task_rows": 0})):
    add(
        f"v4_roc_auc_by_group{_suffix}",
        lambda s, d, kw=_rows: metrics.roc_auc(v.grouped_scores(s, d), by=_BY, **kw),
        """SELECT grp, round(sum(neg * (tp - pos / 2)) / (any_value(positives)::DOUBLE * any_value(negatives)), 6)
            AS roc_auc FROM grouped_curve GROUP BY grp""",
    )
    add(
        f"v5_roc_curve_by_group{_suffix}",
        lambda s, d, kw=_rows: rounded(
            metrics.roc_curve(v.grouped_scores(s, d), by=_BY, **kw), "threshold", "fpr", "tpr"
        ),
        "SELECT grp, round(p, 6) AS threshold, round(fp / negatives, 6) AS fpr, round(tp / positives, 6) AS tpr "
        "FROM grouped_curve UNION ALL SELECT DISTINCT grp, NULL, 0, 0 FROM grouped_curve",
    )
    add(
        f"v6_pr_curve_by_group{_suffix}",
        lambda s, d, kw=_rows: rounded(
            metrics.pr_curve(v.grouped_scores(s, d), by=_BY, **kw), "threshold", "precision", "recall"
        ),
        "SELECT grp, round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, "
        "round(tp / positives, 6) AS recall FROM grouped_curve "
        "UNION ALL SELECT DISTINCT grp, NULL, 1, 0 FROM grouped_curve",
    )
add(
    "v3_threshold_sweep_by_group",
    lambda s, d: rounded(
        metrics.threshold_sweep(v.grouped_scores(s, d), _CUTS, by=_BY), "accuracy", "precision", "recall"
    ),
    f"SELECT grp, threshold, tp, fp, tn, fn, {_rates('accuracy', 'precision', 'recall')} FROM ("
    + " UNION ALL ".join(
        f"SELECT grp, {t}::DOUBLE AS threshold, {_CELLS.format(hat=f'p > {t}')} FROM grouped_scores GROUP BY grp"
        for t in _CUTS
    )
    + ")",
)
add(
    "v7_pr_auc",
    lambda s, d: metrics.pr_auc(v.scores(s, d)),
    """SELECT round(sum((recall - r0) * (precision + p0) / 2), 6) AS pr_auc FROM (
        SELECT tp / (tp + fp) AS precision, tp / positives AS recall,
            coalesce(lag(tp / (tp + fp)) OVER (ORDER BY p DESC), 1) AS p0,
            coalesce(lag(tp / positives) OVER (ORDER BY p DESC), 0) AS r0
        FROM curve)""",
)
add(
    "v8_metric_report",
    lambda s, d: rounded(metrics.model_report(v.scores(s, d)), "value"),
    f"""WITH cut AS (SELECT {_rates('accuracy', 'precision', 'recall', 'f1')}
            FROM (SELECT {_CELLS.format(hat='pred = 1')} FROM scores)),
        roc AS ({_AUC_SQL}),
        pr AS (SELECT round(sum((recall - r0) * (precision + p0) / 2), 6) AS pr_auc FROM (
            SELECT tp / (tp + fp) AS precision, tp / positives AS recall,
                coalesce(lag(tp / (tp + fp)) OVER (ORDER BY p DESC), 1) AS p0,
                coalesce(lag(tp / positives) OVER (ORDER BY p DESC), 0) AS r0
            FROM curve))
    SELECT 'accuracy' AS metric, accuracy AS value FROM cut UNION ALL SELECT 'precision', precision FROM cut
    UNION ALL SELECT 'recall', recall FROM cut UNION ALL SELECT 'f1', f1 FROM cut
    UNION ALL SELECT 'roc_auc', roc_auc FROM roc UNION ALL SELECT 'pr_auc', pr_auc FROM pr""",
)

# Survival

add("k1_tenure", lambda s, d: v.survival(s, d), "SELECT * FROM survival")
_Z = 1.959963984540054
_KM_COLS = ["km_estimate", "km_lower", "km_upper", "cumulative_density"]


def _km(s, d, **kw):
    return survival.kaplan_meier(v.survival(s, d), "month", LABEL, **kw)


def _band(sign: str) -> str:
    return (
        "round(CASE WHEN dead > 0 THEN NULL WHEN log_s = 0 THEN 1 "
        f"ELSE exp(-exp(ln(-log_s) {sign} {_Z} * sqrt(var_sum) / log_s)) END, 6)"
    )


add(
    "k2_kaplan_meier",
    lambda s, d: rounded(_km(s, d), "km_estimate").select(
        "timeline", "removed", "observed", "at_risk", "km_estimate"
    ),
    "SELECT timeline, removed, observed, at_risk, round(km_estimate, 6) AS km_estimate FROM km",
)
add(
    "k2_kaplan_meier_in_ranges",
    lambda s, d: rounded(_km(s, d, one_task_rows=0), "km_estimate").select("timeline", "at_risk", "km_estimate"),
    "SELECT timeline, at_risk, round(km_estimate, 6) AS km_estimate FROM km",
)
add(
    "k3_cumulative_density",
    lambda s, d: rounded(_km(s, d), "cumulative_density").select("timeline", "cumulative_density"),
    "SELECT timeline, round(1 - km_estimate, 6) AS cumulative_density FROM km",
)
add(
    "k4_median_survival",
    lambda s, d: survival.median_survival(_km(s, d)),
    "SELECT coalesce(min(timeline) FILTER (WHERE km_estimate <= 0.5), 'inf'::DOUBLE) AS median FROM km",
)
add(
    "k5_confidence_band",
    lambda s, d: rounded(_km(s, d), "km_lower", "km_upper").select("timeline", "km_lower", "km_upper"),
    f"SELECT timeline, {_band('-')} AS km_lower, {_band('+')} AS km_upper FROM km",
)
add(
    "k6_nelson_aalen",
    lambda s, d: rounded(
        survival.nelson_aalen(v.survival(s, d), "month", LABEL), "cumulative_hazard"
    ),
    "SELECT timeline, removed, observed, at_risk, round(cumulative_hazard, 6) AS cumulative_hazard FROM hazard",
)
add(
    "k6_nelson_aalen_plain",
    lambda s, d: rounded(
        survival.nelson_aalen(v.survival(s, d), "month", LABEL, ties="plain"), "cumulative_hazard"
    ).select("timeline", "cumulative_hazard"),
    "SELECT timeline, round(sum(observed / at_risk) OVER (ORDER BY timeline), 6) AS cumulative_hazard FROM life",
)
_TIMES = [6, 12, 18, 24]
add(
    "k7_curve_at_times",
    lambda s, d: rounded(
        survival.curve_at(
            survival.nelson_aalen(v.survival(s, d), "month", LABEL), _TIMES, "cumulative_hazard"
        ),
        "cumulative_hazard",
    ),
    "SELECT x AS timeline, round(arg_max(cumulative_hazard, timeline) FILTER (WHERE timeline <= x), 6) "
    "AS cumulative_hazard FROM hazard, (SELECT unnest([6, 12, 18, 24])::DOUBLE AS x) GROUP BY 1",
)
add(
    "k7_curve_at_exact_times",
    lambda s, d: rounded(
        survival.curve_at(
            survival.nelson_aalen(v.survival(s, d), "month", LABEL), _TIMES, "cumulative_hazard", exact=True
        ),
        "cumulative_hazard",
    ),
    "SELECT timeline, round(cumulative_hazard, 6) AS cumulative_hazard FROM hazard "
    "WHERE timeline IN (6, 12, 18, 24)",
)
add("k8_cohort", lambda s, d: v.cohort_transactions(s, d), "SELECT * FROM cohort")
