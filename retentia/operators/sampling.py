"""Splits and class balancing by key hash: repeatable on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.columns import key_hash
from retentia.sources.tables import materialize


def hash_split(df: DataFrame, key: str, test_pct: int = 40, salt: str = "") -> DataFrame:
    """Adds ``split`` (train/test); all rows of one key fall on the same side."""
    slot = F.conv(F.substring(key_hash(key, salt), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(slot < 100 - test_pct, "train").otherwise("test"))


def random_split(df: DataFrame, test_pct: int = 40, seed: int = 19) -> tuple[DataFrame, DataFrame]:
    """Train and test by Spark's seeded split: cheaper, but tied to the partitioning."""
    train, test = df.randomSplit([100.0 - test_pct, float(test_pct)], seed)
    return train, test


def _drawn(df: DataFrame, label: str, key: str, quota: Column, salt: str) -> DataFrame:
    """The labelled rows of ``df`` plus ``_size`` and ``_max``, the sizes of their class and of the largest,
    and ``_in``: whether the row is among its class's quota of rows of lowest key hash.

    ``quota`` may use ``_size``, ``_max`` and the smallest class size ``_min``. ``key`` must be
    unique. The cut, one hash and key per class, is found at once: a histogram of 65,536 hash
    ranges per class names the range that holds it, and only that range is ranked. All of
    that reads a narrow written index of class, hash and key; ``df`` itself is read twice, for the
    index and for the rows.
    """
    hashed = df.where(F.col(label).isNotNull()).withColumn("_hash", key_hash(key, salt))
    index = hashed.select(F.col(label), "_hash", F.col(key).alias("_key"), F.substring("_hash", 1, 4).alias("_range"))
    index = materialize(index, "index")
    ranges = materialize(index.groupBy(label, "_range").agg(F.count("*").alias("_n")), "ranges")
    everything = Window.partitionBy()  # over one row per class
    sizes = (
        ranges.groupBy(label)
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_min", F.min("_size").over(everything))
        .withColumn("_max", F.max("_size").over(everything))
        .withColumn("_quota", quota.cast("bigint"))
    )
    upto = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_upto") - F.col("_n")
    holds = (F.col("_quota") > before) & (F.col("_quota") <= F.col("_upto"))
    cut = materialize(
        ranges.withColumn("_upto", F.sum("_n").over(upto))
        .join(sizes.select(label, "_quota"), label)
        .where(holds)
        .select(F.col(label).alias("_class"), F.col("_range").alias("_at"), (F.col("_quota") - before).alias("_room")),
        "cut",
    )
    # One row per class, as in ``classes``: Spark sees the sizes of both and broadcasts them if they are small.
    same = (F.col(label) == F.col("_class")) & (F.col("_range") == F.col("_at"))
    inside = index.join(cut, same).select("_class", "_room", "_hash", "_key")
    in_order = Window.partitionBy("_class").orderBy("_hash", "_key")
    last = (
        inside.withColumn("_rank", F.row_number().over(in_order))
        .where(F.col("_rank") == F.col("_room"))
        .select("_class", F.struct("_hash", "_key").alias("_last"))
    )
    classes = sizes.withColumnRenamed(label, "_of").join(last, F.col("_of") == F.col("_class"), "left")
    classes = materialize(classes.select("_of", "_size", "_max", "_last"), "cuts")
    placed = hashed.join(classes, F.col(label) == F.col("_of"))
    here = F.struct(F.col("_hash"), F.col(key).alias("_key"))
    return placed.withColumn("_in", F.coalesce(here <= F.col("_last"), F.lit(False)))


def undersample(df: DataFrame, label: str, key: str, salt: str = "") -> DataFrame:
    """As many rows of every class as the smallest class has, lowest key hash first.

    Rows without a label belong to no class and are left out.
    """
    drawn = _drawn(df, label, key, F.col("_min"), salt)
    return drawn.where("_in").select(*df.columns)


def oversample(df: DataFrame, label: str, key: str, salt: str = "") -> DataFrame:
    """Rows of smaller classes repeated until every class has as many as the largest.

    Each row is kept and repeated equally often; the remainder goes to the rows
    of lowest key hash. Rows without a label belong to no class and are left out.
    """
    drawn = _drawn(df, label, key, F.col("_max") % F.col("_size"), salt)
    copies = F.floor(F.col("_max") / F.col("_size")) + F.col("_in").cast("bigint")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(
        *df.columns, F.col("copy").cast("bigint").alias("copy")
    )


def split_report(df: DataFrame, key: str, label: str) -> DataFrame:
    """Per split: rows, distinct keys and label rate."""
    per_key = df.groupBy("split", key).agg(
        F.count("*").alias("n"), F.sum(label).alias("positives"), F.count(label).alias("labelled")
    )
    return per_key.groupBy("split").agg(
        F.sum("n").alias("row_count"),
        F.count(key).alias("key_count"),
        F.try_divide(F.sum("positives"), F.sum("labelled")).alias("label_rate"),
    )
