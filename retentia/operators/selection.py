"""Scaling, correlation and feature elimination.

What comes to the driver is of the size of the feature list (means, a
correlation matrix, a ranking), never of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.operators.logistic import fit_logistic
from retentia.sources.tables import materialize


def features_and_label(df: DataFrame, cols: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., features vector, label)``; the label comes back as a double."""
    assembled = VectorAssembler(inputCols=list(cols), outputCol="features").transform(
        df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols], F.col(label).cast("double").alias("label"))
    )
    return assembled.select(*keep, "features", "label")


def scale_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, mean, std)`` with the population standard deviation."""
    row = df.agg(
        *[F.avg(c).alias(f"mean:{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"std:{c}") for c in cols],
    )
    cells = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"mean:{c}").alias("mean"), F.col(f"std:{c}").alias("std")
        )
        for c in cols
    ]
    return row.select(F.explode(F.array(*cells)).alias("_f")).select("_f.*")


def scale_apply(df: DataFrame, params: DataFrame) -> DataFrame:
    """(x - mean) / std for the fitted columns; a constant column becomes 0."""
    scaled = {
        p["feature"]: (F.col(p["feature"]) - F.lit(p["mean"])) / F.lit(p["std"] or 1.0)
        for p in params.collect()
    }
    return df.withColumns(scaled)


def corr_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs as ``(feature_a, feature_b, corr)``, from one pass.

    Columns must be free of nulls (fill them first). A pair with a constant
    column gets null.
    """
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    )
    matrix = Correlation.corr(vectors, "_v", "pearson").first()[0].toArray()
    rows = [
        (cols[i], cols[j], None if matrix[i, j] != matrix[i, j] else float(matrix[i, j]))
        for i in range(len(cols))
        for j in range(i + 1, len(cols))
    ]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def collinear_pairs(corr: DataFrame, limit: float = 0.5) -> DataFrame:
    """Pairs with an absolute correlation above ``limit`` (strict)."""
    return corr.where(F.abs("corr") > limit)


def rfe_rank(df: DataFrame, cols: Sequence[str], label: str, penalty: float = 1.0) -> DataFrame:
    """Recursive feature elimination: ``(rank, feature)``, rank 1 is dropped last.

    Each round fits a logistic regression (C = 1 / ``penalty`` of a summed loss) on what is left
    and drops the feature with the smallest squared weight, of equal ones the first. Expects scaled columns
    without nulls and balanced classes. A round starts where the curvature of the round before says
    that the weights go without the dropped feature, and so reads the rows once or twice.
    """
    table = materialize(
        df.select(
            *[F.col(c).cast("double").alias(c) for c in cols],
            F.col(label).cast("double").alias("label"),
        ),
        "rfe",
    )
    left, dropped, start = list(cols), [], None
    while len(left) > 1:
        fit = fit_logistic(table, left, "label", penalty, start)
        least = int((fit.weights**2).argmin())
        start = fit.without(least)
        dropped.append(left.pop(least))
    ranked = left + dropped[::-1]
    return df.sparkSession.createDataFrame(
        list(enumerate(ranked, start=1)), "rank int, feature string"
    ).orderBy("rank", "feature")


def rank_features(scores: DataFrame, feature: str, score: str) -> DataFrame:
    """``(rank, feature)`` from any score per feature, highest first."""
    best_first = Window.orderBy(F.col(score).desc_nulls_last(), F.col(feature))  # one row per feature
    return scores.select(F.row_number().over(best_first).alias("rank"), F.col(feature).alias("feature"))


def drop_adjacent_collinear(
    rank_df: DataFrame, pairs: DataFrame, rounds: int | None = None
) -> DataFrame:
    """Drops features collinear with the one ranked just before them.

    In a round all second members of collinear neighbours go at once, also where
    the first goes too; neighbours are then formed anew. Runs ``rounds`` times,
    or until nothing changes.
    """
    both = pairs.select("feature_a", "feature_b").unionByName(
        pairs.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"))
    )
    both = materialize(both, "pairs")
    kept = materialize(rank_df.select("rank", "feature"), "rank")
    size, done = kept.count(), 0
    by_rank = Window.orderBy("rank")  # one row per feature
    while rounds is None or done < rounds:
        neighbours = kept.withColumn("feature_a", F.lag("feature").over(by_rank))
        excluded = neighbours.join(
            both.withColumnRenamed("feature_b", "feature"),
            ["feature_a", "feature"],
            "left_semi",
        ).select("feature")
        kept = materialize(kept.join(excluded, "feature", "left_anti"), "rank")
        done += 1
        now = kept.count()
        if now == size:
            break
        size = now
    return kept.select("rank", "feature").orderBy("rank")
