"""Weight-of-evidence encoding and information value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import log_ratio, text_or
from retentia.operators.joins import LOOKUP_ROWS, lookup_join
from retentia.sources.tables import materialize

# Category of a missing value (fixed value).
NULL_CATEGORY = "NULL"


def woe_fit(df: DataFrame, features: str | Sequence[str], target: str) -> DataFrame:
    """The encoding table of one or many features, from one aggregation run at once.

    Columns: variable, value, all, good, bad, share, bad_rate, distribution_good,
    distribution_bad, woe, iv. A missing value is a category of its own. Rows
    without a target count as not bad in the distributions. A category with no
    bad or no good rows gets 0; if that holds for the whole feature, null.
    """
    features = [features] if isinstance(features, str) else list(features)
    cells = df.select(
        F.col(target).alias("_y"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("variable"), text_or(f, NULL_CATEGORY).alias("value"))
                    for f in features
                ]
            )
        ).alias("_cell"),
    ).select("_y", "_cell.variable", "_cell.value")
    counts = materialize(
        cells.groupBy("variable", "value").agg(
            F.count("*").alias("all"),
            F.count_if(F.col("_y") == 0).alias("good"),
            F.count_if(F.col("_y") == 1).alias("bad"),
        ),
        "woe_counts",
    )
    # One row per feature: broadcast is bounded by the number of features.
    totals = counts.groupBy("variable").agg(F.sum("all").alias("_all"), F.sum("bad").alias("_bad"))
    not_bad, all_not_bad = F.col("all") - F.col("bad"), F.col("_all") - F.col("_bad")
    table = counts.join(F.broadcast(totals), "variable").select(
        "variable",
        "value",
        "all",
        "good",
        "bad",
        (F.col("all") / F.col("_all")).alias("share"),
        (F.col("bad") / F.col("all")).alias("bad_rate"),
        F.try_divide(not_bad, all_not_bad).alias("distribution_good"),
        F.try_divide(F.col("bad"), F.col("_bad")).alias("distribution_bad"),
    )
    good, bad = F.col("distribution_good"), F.col("distribution_bad")
    woe = F.when(good.isNotNull() & bad.isNotNull(), log_ratio(good, bad))
    return table.withColumn("woe", woe).withColumn("iv", F.col("woe") * (good - bad))


def woe_lookup(woe_df: DataFrame, feature: str) -> DataFrame:
    """The two columns that encode one feature: its value and ``<feature>_woe``."""
    return woe_df.where(F.col("variable") == feature).select(
        F.col("value").alias(feature), F.col("woe").alias(f"{feature}_woe")
    )


def woe_apply(
    df: DataFrame, woe_df: DataFrame, features: Sequence[str], max_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Adds ``<feature>_woe`` for each feature; a value never seen in the fit gets null.

    The features come back as text with missing values as their own category,
    which is how they are encoded. The encoding table is written once and its
    size per feature decides how it is joined.
    """
    fitted = materialize(woe_df.select("variable", "value", "woe"), "woe")
    sizes = {r["variable"]: r["count"] for r in fitted.groupBy("variable").count().collect()}
    out = df.withColumns({f: text_or(f, NULL_CATEGORY) for f in features})
    for feature in features:
        out = lookup_join(
            out, woe_lookup(fitted, feature), feature, max_rows, rows=sizes.get(feature, 0)
        )
    return out.select(*df.columns, *[f"{f}_woe" for f in features])


def iv_table(woe_df: DataFrame) -> DataFrame:
    """Information value per feature, strongest first."""
    return (
        woe_df.groupBy("variable")
        .agg(F.sum("iv").alias("iv"))
        .orderBy(F.col("iv").desc_nulls_last(), "variable")
    )
