"""Per-user activity features: recent rows, lifetime totals, gaps.

``key`` may be one column or several; ``measures`` maps output names to column
expressions, so cleaning (clamp, abs) is part of the same pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.columns import clamp0
from retentia.operators.joins import join_by

# Column names of an activity log (fixed values).
COUNT_COLUMNS = ("num_25", "num_50", "num_75", "num_985", "num_100", "num_unq")
SECONDS_COLUMN = "total_secs"
# Suffixes of the most recent, second and third most recent row (fixed values).
RECENCY_SUFFIXES = ("last", "2ndlast", "3rdlast")


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def activity_measures(
    counts: Sequence[str] = COUNT_COLUMNS, seconds: str = SECONDS_COLUMN
) -> dict[str, Column]:
    """The counts as they are, the seconds once clamped at 0 and once absolute."""
    measures = {c: F.col(c) for c in counts}
    measures[f"{seconds}_clean"] = clamp0(seconds)
    measures[f"abs_{seconds}"] = F.abs(F.col(seconds))
    return measures


def recent_rows(
    df: DataFrame, key: str | Sequence[str], order: str, k: int, tie: Sequence[str] = ()
) -> DataFrame:
    """Rows with recency 1..k per key (1 = latest), in a ``recency`` column.

    The ``<= k`` form lets Spark keep only k rows per key in every map task
    before the shuffle, so a key with any number of rows sends at most
    k per task.
    """
    latest_first = Window.partitionBy(*_keys(key)).orderBy(
        F.col(order).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tie]
    )
    return df.withColumn("recency", F.row_number().over(latest_first)).where(F.col("recency") <= k)


def nth_last_row(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    n: int,
    measures: Mapping[str, Column],
    suffix: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """The n-th most recent row per key, its columns named with ``suffix``."""
    return nth_of_recent(recent_rows(df, key, order, n, tie), key, order, n, measures, suffix)


def nth_of_recent(
    recent: DataFrame,
    key: str | Sequence[str],
    order: str,
    n: int,
    measures: Mapping[str, Column],
    suffix: str,
) -> DataFrame:
    """``nth_last_row`` from rows that ``recent_rows`` has found."""
    return recent.where(F.col("recency") == n).select(
        *_keys(key),
        F.col(order).alias(f"{order}_{suffix}"),
        *[c.alias(f"{name}_{suffix}") for name, c in measures.items()],
    )


def _wide_columns(names: Sequence[str], suffixes: Sequence[str]) -> list[Column]:
    return [
        F.max(F.when(F.col("recency") == n, F.col(name))).alias(f"{name}_{suffix}")
        for n, suffix in enumerate(suffixes, start=1)
        for name in names
    ]


def last_n_wide(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    measures: Mapping[str, Column],
    suffixes: Sequence[str] = RECENCY_SUFFIXES,
    tie: Sequence[str] = (),
) -> DataFrame:
    """The last rows of every key side by side: one scan and one shuffle for all."""
    rows = recent_rows(df, key, order, len(suffixes), tie).select(
        *_keys(key), "recency", order, *[c.alias(name) for name, c in measures.items()]
    )
    return rows.groupBy(*_keys(key)).agg(*_wide_columns([order, *measures], suffixes))


def _rows(key: str | Sequence[str]) -> Column:
    """The rows of a group whose key is known."""
    known = [F.col(c).isNotNull() for c in _keys(key)]
    return F.count_if(reduce(lambda a, b: a & b, known))


def lifetime_sums(
    df: DataFrame, key: str | Sequence[str], measures: Mapping[str, Column], suffix: str = ""
) -> DataFrame:
    """Row count and sum of every measure per key; a null key counts 0 rows, as it names no user."""
    return df.groupBy(*_keys(key)).agg(
        _rows(key).alias(f"row_count{suffix}"),
        *[F.sum(c).alias(f"sum_{name}{suffix}") for name, c in measures.items()],
    )


def last_k_sums(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    k: int,
    measures: Mapping[str, Column],
    require_k: bool = True,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Sums over the k most recent rows; with ``require_k`` only for keys that have k."""
    return sums_of_recent(recent_rows(df, key, order, k, tie), key, k, measures, require_k)


def sums_of_recent(
    recent: DataFrame,
    key: str | Sequence[str],
    k: int,
    measures: Mapping[str, Column],
    require_k: bool = True,
) -> DataFrame:
    """``last_k_sums`` from rows that ``recent_rows`` has found."""
    suffix = f"_{k}last"
    sums = lifetime_sums(recent.where(F.col("recency") <= k), key, measures, suffix)
    return sums.where(F.col(f"row_count{suffix}") == k) if require_k else sums


def activity_features(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    measures: Mapping[str, Column] | None = None,
    suffixes: Sequence[str] = RECENCY_SUFFIXES,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Last rows, last-k sums and lifetime sums of every key in one table.

    The last rows and their sums come from one aggregation over the k most recent
    rows, the lifetime sums from another; both hash on ``key``, so joining them
    moves nothing. The last-k sums are null for keys with fewer than k rows.
    """
    keys = _keys(key)
    measures = activity_measures() if measures is None else measures
    k = len(suffixes)
    rows = recent_rows(df, keys, order, k, tie).select(
        *keys, "recency", order, *[c.alias(name) for name, c in measures.items()]
    )
    full = _rows(keys) == k
    recent = rows.groupBy(*keys).agg(
        *_wide_columns([order, *measures], suffixes),
        F.when(full, _rows(keys)).alias(f"row_count_{k}last"),
        *[F.when(full, F.sum(name)).alias(f"sum_{name}_{k}last") for name in measures],
    )
    return lifetime_sums(df, keys, measures).join(recent, keys, "left")


def gaps(
    df: DataFrame, key: str | Sequence[str], date: str, tie: str, out: str = "months_since_prev"
) -> DataFrame:
    """Every row with the date of the previous row of its key and the months between.

    Rows are ordered by ``date`` and then ``tie`` (null first), which must be unique
    among the rows of one key and date; rows with a null key form one group. The previous date is looked up among the distinct
    dates of the key (no more than days in the calendar), so that a key with very
    many rows is never sorted in one task.
    """
    keys = _keys(key)
    # A null tie ranks before all others, and is compared as a value.
    rank = F.struct(F.col(tie).isNotNull().alias("known"), F.col(tie).alias("tie"))
    days = df.where(F.col(date).isNotNull()).groupBy(*keys, date).agg(F.min(rank).alias("_first"))
    by_day = Window.partitionBy(*keys).orderBy(date)
    days = days.withColumn("_earlier", F.lag(date).over(by_day))
    previous = F.when(F.col(tie).eqNullSafe(F.col("_first.tie")), F.col("_earlier")).otherwise(F.col(date))
    return (
        join_by(df, days, [*keys, date], "left")
        .withColumn(f"prev_{date}", previous)
        .withColumn(out, F.months_between(date, f"prev_{date}"))
        .select(*df.columns, f"prev_{date}", out)
    )


def first_by(
    df: DataFrame, key: str | Sequence[str], order: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Per key and column the first non-null value in ``order`` (null keys dropped)."""
    return _edge_by(df, key, order, cols, F.min_by)


def last_by(
    df: DataFrame, key: str | Sequence[str], order: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Per key and column the last non-null value in ``order`` (null keys dropped)."""
    return _edge_by(df, key, order, cols, F.max_by)


def _edge_by(df, key, order, cols, pick) -> DataFrame:
    # min_by/max_by skip rows whose order is null: that is how null values are left out.
    rank = F.struct(*[F.col(c) for c in order])
    present = df.na.drop(subset=_keys(key))
    return present.groupBy(*_keys(key)).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in cols]
    )
