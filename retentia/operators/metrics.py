"""Evaluation of scored rows.

A scored frame has a 0/1 ``label``, a score ``p`` and, for the cut metrics, a 0/1
``pred``; ``by`` names columns (say ``model`` and ``split``) to report by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import above
from retentia.operators.joins import join_by
from retentia.operators.ordered import ONE_TASK_ROWS, next_values, running_totals


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def cut_scores(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``pred``: 1 where the score is above the threshold."""
    return scored.withColumn("pred", above("p", threshold))


def _cells(label: str, pred: str) -> list[Column]:
    y, hat = F.col(label), F.col(pred)
    return [
        F.count_if((y == 1) & (hat == 1)).alias("tp"),
        F.count_if((y == 0) & (hat == 1)).alias("fp"),
        F.count_if((y == 0) & (hat == 0)).alias("tn"),
        F.count_if((y == 1) & (hat == 0)).alias("fn"),
    ]


def _rates() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return {
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Accuracy, precision, recall and F1 with the four counts, from one aggregation."""
    return scored.groupBy(*by).agg(*_cells(label, pred)).withColumns(_rates())


def confusion(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred"
) -> DataFrame:
    """``(label, pred, n)`` with all four cells, empty ones included."""
    counts = scored.groupBy(*by).agg(*_cells(label, pred))
    cells = [
        F.struct(F.lit(y).alias("label"), F.lit(hat).alias("pred"), F.col(c).alias("n"))
        for y, hat, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ]
    return counts.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")


def threshold_sweep(
    scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Counts, accuracy, precision and recall at every threshold.

    A row is counted once, under the number of thresholds its score is above;
    the sums per threshold are then made on those few counts.
    """
    cuts = sorted(float(t) for t in set(thresholds))
    passed = sum((above("p", t) for t in cuts), F.lit(0))
    grouped = scored.groupBy(*by, passed.alias("passed")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    levels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(cuts)])
    each = grouped.withColumn("_cut", F.explode(levels)).withColumn(
        "over", F.col("passed") > F.col("_cut.i")
    )
    counts = each.groupBy(*by, F.col("_cut.t").alias("threshold")).agg(
        F.sum(F.when(F.col("over"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("over"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("over"), 0).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.when(F.col("over"), 0).otherwise(F.col("pos"))).alias("fn"),
    )
    rates = _rates()
    return counts.withColumns({c: rates[c] for c in ("accuracy", "precision", "recall")})


def score_totals(
    scored: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Per distinct score, from high to low: its positives and negatives (``pos``, ``neg``)
    and those at or above it (``tp``, ``fp``). All curves are read off this table."""
    counted = scored.groupBy(*by, "p").agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return running_totals(
        counted,
        ["p"],
        {"tp": F.col("pos"), "fp": F.col("neg")},
        by=by,
        descending=True,
        one_task_rows=one_task_rows,
    )


def _with_class_sizes(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    sizes = totals.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    if by:
        return join_by(totals, sizes, list(by))
    one = F.lit(1)
    return (
        totals.withColumn("_one", one)
        .join(F.broadcast(sizes.withColumn("_one", one)), "_one")
        .drop("_one")
    )


def _corners(totals: DataFrame, by: Sequence[str], one_task_rows: int) -> DataFrame:
    """Of the totals per score the ends, and where the step to the next point is not the same again."""
    stepped = next_values(totals, ["p"], ["pos", "neg"], by, descending=True, one_task_rows=one_task_rows)
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    same = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
    return stepped.where(first | ~F.coalesce(same, F.lit(False))).drop("next_pos", "next_neg")


def roc_curve(
    scored: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    thin: bool = False,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """``(threshold, fpr, tpr)`` at every distinct score, and the start (null, 0, 0).

    With ``thin`` points within a run of equal steps are left out; the line through the others is the same.
    """
    totals = score_totals(scored, by, label, one_task_rows=one_task_rows)
    sized = _with_class_sizes(totals, by)
    if thin:
        sized = _corners(sized, by, one_task_rows)
    points = sized.select(
        *by,
        F.col("p").alias("threshold"),
        F.try_divide("fp", "negatives").alias("fpr"),
        F.try_divide("tp", "positives").alias("tpr"),
    )
    start = (
        sized.groupBy(*by)
        .agg(F.count("*").alias("_n"))
        .select(
            *by,
            F.lit(None).cast("double").alias("threshold"),
            F.lit(0.0).alias("fpr"),
            F.lit(0.0).alias("tpr"),
        )
    )
    return points.unionByName(start)


def _roc_area() -> Column:
    # Trapezoid: each score's negatives times the mean of tp before and after it.
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg"))


def roc_auc(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", digits: int = 6, **kw
) -> DataFrame:
    """Exact area under the ROC curve; null where a class is missing."""
    totals = score_totals(scored, by, label, **kw)
    return totals.groupBy(*by).agg(F.round(_roc_area(), digits).alias("roc_auc"))


def _precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))


def pr_curve(scored: DataFrame, by: Sequence[str] = (), label: str = "label", **kw) -> DataFrame:
    """``(threshold, precision, recall)`` at every distinct score, and the end (null, 1, 0)."""
    sized = _with_class_sizes(score_totals(scored, by, label, **kw), by)
    points = sized.select(
        *by,
        F.col("p").alias("threshold"),
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
        F.try_divide("tp", "positives").alias("recall"),
    )
    end = (
        sized.groupBy(*by)
        .agg(F.count("*").alias("_n"))
        .select(
            *by,
            F.lit(None).cast("double").alias("threshold"),
            F.lit(1.0).alias("precision"),
            F.lit(0.0).alias("recall"),
        )
    )
    return points.unionByName(end)


def _pr_area() -> Column:
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    mean_precision = (_precision(tp, fp) + _precision(tp - pos, fp - neg)) / 2.0
    return F.try_divide(F.sum(pos * mean_precision), F.sum("pos"))


def pr_auc(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", digits: int = 6, **kw
) -> DataFrame:
    """Area under the precision-recall curve, trapezoids over recall."""
    totals = score_totals(scored, by, label, **kw)
    return totals.groupBy(*by).agg(F.round(_pr_area(), digits).alias("pr_auc"))


def model_report(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred", **kw
) -> DataFrame:
    """Accuracy, precision, recall, F1, ROC AUC and PR AUC as ``(metric, value)`` rows."""
    by = list(by)
    key = by or ["_all"]
    frame = scored if by else scored.withColumn("_all", F.lit(0))
    # One reduction by group and score feeds both kinds of metric.
    counted = frame.groupBy(*key, "p").agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
        *_cells(label, pred),
    )
    cells = ["tp", "fp", "tn", "fn"]
    renamed = counted.withColumnsRenamed({c: f"cut_{c}" for c in cells})
    totals = running_totals(
        renamed, ["p"], {"tp": F.col("pos"), "fp": F.col("neg")}, by=key, descending=True, **kw
    )
    summed = totals.groupBy(*key).agg(
        *[F.sum(f"cut_{c}").alias(c) for c in cells],
        F.round(_roc_area(), 6).alias("roc_auc"),
        F.round(_pr_area(), 6).alias("pr_auc"),
    )
    wide = summed.withColumns(_rates())
    names = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
    return wide.unpivot(key, names, "metric", "value").select(*by, "metric", "value")
