"""Counts, summaries and data-quality checks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from retentia.sources.tables import materialize


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def key_cardinality(df: DataFrame, keys: str | Sequence[str], keep_null: bool = False) -> DataFrame:
    """One row: how many rows and how many distinct keys (equal = keys are unique)."""
    keys = _keys(keys)
    source = df if keep_null else df.na.drop(subset=keys)
    per_key = source.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("*").alias("key_count")
    )


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact number of distinct non-null values of each column, as ``(column, n_distinct)``.

    The values are reduced as ``(column, value)`` pairs, so the work of one column
    is spread over all tasks. Zeros of either sign are one value.
    """
    floats = [c for c, kind in df.dtypes if c in set(cols) and kind in ("double", "float")]
    df = df.withColumns({c: F.col(c) + F.lit(0.0) for c in floats})
    pairs = _long(df, cols, "string").where(F.col("value").isNotNull()).distinct()
    counted = pairs.groupBy("column").agg(F.count("*").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counted, "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")
    )


def _long(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    return df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value"))
                    for c in cols
                ]
            )
        ).alias("_cell")
    ).select("_cell.column", "_cell.value")


def duplicate_keys(df: DataFrame, keys: str | Sequence[str], n: int | None = None) -> DataFrame:
    """Keys that occur more than once (or exactly ``n`` times), with their count."""
    counted = df.groupBy(*_keys(keys)).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") != 1) if n is None else counted.where(F.col("n") == n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first; null is not a value."""
    counted = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), F.col(col))


def _unpivot_row(row: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A one-row frame with columns ``field:col`` as one row per ``col``."""
    cells = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{f}:{c}").alias(f) for f in fields])
        for c in cols
    ]
    return row.select(F.explode(F.array(*cells)).alias("_r")).select("_r.*")


def profile(df: DataFrame) -> DataFrame:
    """``(column, type, non_null)`` for every column, from one pass."""
    types = dict(df.dtypes)
    row = df.agg(*[F.count(F.col(c)).alias(f"non_null:{c}") for c in df.columns])
    row = row.withColumns({f"type:{c}": F.lit(types[c]) for c in df.columns})
    return _unpivot_row(row, df.columns, ["type", "non_null"])


def negative_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, negatives, minimum)`` per column, from one pass."""
    row = df.agg(
        *[F.count_if(F.col(c) < 0).alias(f"negatives:{c}") for c in cols],
        *[F.min(F.col(c).cast("double")).alias(f"minimum:{c}") for c in cols],
    )
    return _unpivot_row(row, cols, ["negatives", "minimum"])


def coverage(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row: rows of ``a``, those whose key is in ``b``, and their share."""
    keys = _keys(key)
    known = b.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return (
        a.select(*keys)
        .join(known, keys, "left")
        .agg(F.count("*").alias("row_count"), F.count("_hit").alias("covered"))
        .withColumn("share", F.try_divide(F.col("covered"), F.col("row_count")))
    )


def rate_by(
    df: DataFrame, keys: str | Sequence[str], label: str, scale: float = 1.0, out: str = "rate"
) -> DataFrame:
    """Mean label per group, highest first; groups with a null key are left out."""
    keys = _keys(keys)
    rates = df.na.drop(subset=keys).groupBy(*keys).agg((F.avg(label) * F.lit(scale)).alias(out))
    return rates.orderBy(F.col(out).desc_nulls_last(), *keys)


def mean_by(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Mean of every numeric column that is not a key, per group."""
    keys = _keys(keys)
    cols = [c for c in numeric_columns(df) if c not in keys]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def known(df: DataFrame, c: str) -> Column:
    """A column whose NaN count as null, as they do in a table that was read from text."""
    if dict(df.dtypes)[c] in ("double", "float"):
        return F.when(~F.isnan(c), F.col(c))
    return F.col(c)


def summary_long(df: DataFrame, cols: Sequence[str] | None = None, percentiles: Sequence[int] = (25, 50, 75)) -> DataFrame:
    """Count, mean, standard deviation, minimum, percentiles and maximum per column; NaN counts as null.

    The percentiles are exact, interpolated between neighbours, for all columns at once; ``ranked_values`` says how.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    plain = df.select(*[known(df, c).alias(c) for c in cols])
    # The counts and the passes for the percentiles must see the same rows.
    plain = materialize(plain, "columns") if percentiles else plain
    stats = plain.agg(
        *[F.count(F.col(c)).alias(f"count:{c}") for c in cols],
        *[F.avg(F.col(c)).alias(f"mean:{c}") for c in cols],
        *[F.stddev_samp(F.col(c)).alias(f"stddev:{c}") for c in cols],
        *[F.min(F.col(c).cast("double")).alias(f"min:{c}") for c in cols],
        *[F.max(F.col(c).cast("double")).alias(f"max:{c}") for c in cols],
    )
    if not percentiles:
        return _unpivot_row(stats, cols, ["count", "mean", "stddev", "min", "max"])
    stats = materialize(stats, "stats")  # one row
    counts = stats.first()
    wanted, parts = {}, {}
    for i, c in enumerate(cols):
        n = counts[f"count:{c}"]
        for p in percentiles if n else ():
            at = p / 100.0 * (n - 1)
            low = math.floor(at)
            parts[i, p] = (low, math.ceil(at), at - low)
            wanted.setdefault(i, set()).update(parts[i, p][:2])
    values = ranked_values(plain, cols, wanted)
    rows = []
    for i, c in enumerate(cols):
        cells = []
        for p in percentiles:
            low, high, part = parts.get((i, p), (None, None, 0.0))
            cells.append(None if low is None else values[i, low] + (values[i, high] - values[i, low]) * part)
        rows.append((c, *cells))
    fields = ", ".join(f"p{p} double" for p in percentiles)
    quantiles = df.sparkSession.createDataFrame(rows, f"column string, {fields}")
    return _unpivot_row(stats, cols, ["count", "mean", "stddev", "min", "max"]).join(quantiles, "column", "left")


#: Bits of a value that one pass tells apart; three passes cover all 64.
_PASS_BITS = (22, 21, 21)


def _bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; zeros of both signs are one."""
    raw = (values + 0.0).view(np.int64)
    return raw ^ ((raw >> np.int64(63)) & np.int64(2**63 - 1))


def _value(bits: int) -> float:
    raw = np.array([bits], dtype=np.int64)
    return float((raw ^ ((raw >> np.int64(63)) & np.int64(2**63 - 1))).view(np.float64)[0])


def _ranges(cols: Sequence[str], open_ranges: dict[int, list[int]], seen: int, bits: int) -> Callable:
    """Per task the rows by column and range, the first ``seen + bits`` bits, inside the ``open_ranges`` of ``seen`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, pd.DataFrame] = {}
        for batch in batches:
            for i, inside in open_ranges.items():
                column = batch.column(cols[i]).drop_null()
                v = _bits(column.to_numpy(zero_copy_only=False).astype(np.float64))
                before = v >> np.int64(64 - seen) if seen else np.zeros(len(v), dtype=np.int64)
                on = np.isin(before, inside)
                v = v[on]
                part = pd.DataFrame({"parent": before[on], "range": v >> np.int64(64 - seen - bits), "n": 1, "low": v, "high": v})
                if i in kept:
                    part = pd.concat([kept[i], part])
                kept[i] = part.groupby(["parent", "range"], as_index=False).agg({"n": "sum", "low": "min", "high": "max"})
        for i, part in kept.items():
            part.insert(0, "place", np.full(len(part), i, dtype=np.int32))
            yield pa.RecordBatch.from_pandas(part, preserve_index=False)

    return run


def ranked_values(df: DataFrame, cols: Sequence[str], wanted: Mapping[int, set[int]]) -> dict[tuple[int, int], float]:
    """The values at the ``wanted`` 0-based ranks of the non-null values per place in ``cols``: (place, rank) -> value.

    A pass counts the rows of all columns by the leading bits of their values, and finds the
    ranges that hold a wanted rank; the next pass looks only into these, at the bits that follow, until
    a range holds one value. No task or buffer holds a column, and no order over its values is made.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names, found = [f"c{i}" for i in range(len(cols))], {}
    # Per column and open range: the rows below it, and the ranks looked for in it.
    open_ = {(i, 0): (0, sorted(ranks)) for i, ranks in wanted.items() if ranks}
    seen = 0
    for bits in _PASS_BITS:
        if not open_:
            break
        inside: dict[int, list[int]] = {}
        for i, parent in open_:
            inside.setdefault(i, []).append(parent)
        cells = doubles.mapInArrow(_ranges(names, inside, seen, bits), "place int, parent bigint, range bigint, n bigint, low bigint, high bigint")
        cells = cells.groupBy("place", "parent", "range").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        looked = df.sparkSession.createDataFrame(
            [(i, parent, below, ranks) for (i, parent), (below, ranks) in open_.items()], "place int, parent bigint, below bigint, ranks array<bigint>"
        )
        # At most 2^bits ranges in a window.
        upto = F.sum("n").over(Window.partitionBy("place", "parent").orderBy("range"))
        placed = cells.join(F.broadcast(looked), ["place", "parent"]).withColumn("last", F.col("below") + upto)
        here = F.filter("ranks", lambda r: (r < F.col("last")) & (r >= F.col("last") - F.col("n")))
        hits = placed.withColumn("here", here).where(F.size("here") > 0).collect()  # a row per wanted rank at most
        open_ = {}
        seen += bits
        for row in hits:
            if row["low"] == row["high"]:
                found |= {(row["place"], r): _value(row["low"]) for r in row["here"]}
            else:
                open_[row["place"], row["range"]] = (row["last"] - row["n"], list(row["here"]))
    return found


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Rows per equal-width bin between minimum and maximum (the last bin is closed); empty bins count 0.

    NaN counts as null.
    """
    df = df.select(known(df, col).alias(col))
    low, high = df.agg(
        F.min(F.col(col)).cast("double"), F.max(F.col(col)).cast("double")
    ).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    width = (high - low) / bins or 1.0
    bin_of = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counted = df.where(F.col(col).isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(counted, "bin", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
            (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
            "n",
        )
    )
