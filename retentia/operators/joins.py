"""Joins and unions.

Spark can split a skewed shuffle partition only on the preserved side of an
outer join, so each function says which side may be skewed, and the ones with
a many-rows side are shaped to leave that side splittable.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.sources.tables import materialize

# A lookup is broadcast only up to this many rows (checked, not assumed).
LOOKUP_ROWS = 100_000


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def join_by(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``by`` where a null equals a null; the columns of ``left``, then the others of ``right``."""
    right = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [left[c].eqNullSafe(right[f"_by_{c}"]) for c in by]
    return left.join(right, reduce(lambda a, b: a & b, same), how).drop(*[f"_by_{c}" for c in by])


def checked_unique(df: DataFrame, keys: str | Sequence[str], name: str = "table") -> DataFrame:
    """``df``, whose rows have known ``keys``, reduced to a row per key; a key that repeats is an error that names it.

    The reduction runs in the map tasks too, so a key that repeats very often is no burden before it is
    found. The check is a filter of the plan, which Spark never leaves out.
    """
    keys = _keys(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1).alias("_none"))
    reduced = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(row).alias("_row"))
    message = F.concat(F.lit(f"{name}: a key repeats in a join that needs unique keys: "), F.to_json(F.struct(*keys)))
    once = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return reduced.where(once).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def full_join(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Full outer join of two tables that are both unique by ``keys``; a repeated key raises when the rows are made.

    Spark cannot split a full join, so both sides are reduced to a row per key first, which is
    also where the check is. Rows with a null among their keys meet nothing and are added as they are.
    """
    keys = _keys(keys)
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in keys])
    left, right = (checked_unique(df.where(known), keys, name) for df, name in ((a, "first table"), (b, "second table")))
    joined = left.join(right, keys, "full")
    for df in (a, b):
        if any(f.nullable for f in df.schema if f.name in keys):
            joined = joined.unionByName(df.where(~known), allowMissingColumns=True)
    return joined


def full_join_detail(detail: DataFrame, unique: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Full outer join where ``detail`` may hold any number of rows per key.

    A full join cannot be split on either side. Written as a left join (its
    detail side can be split) plus the rows of ``unique`` that met nothing.
    """
    keys = _keys(keys)
    adds_columns = set(unique.columns) != set(keys)
    matched = detail.join(unique, keys, "left") if adds_columns else detail
    unmet = unique.join(detail.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(unmet, allowMissingColumns=True)


def left_join_detail(unique: DataFrame, detail: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """``unique`` left join ``detail``, where ``detail`` may have hot keys.

    The detail side of a left join cannot be split, that of an inner join can;
    the rows without detail are added from an anti join on pre-reduced keys.
    """
    keys = _keys(keys)
    matched = unique.join(detail, keys, "inner")
    unmet = unique.join(detail.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(unmet, allowMissingColumns=True)


def left_join_all(base: DataFrame, others: Sequence[DataFrame], key: str | Sequence[str]) -> DataFrame:
    """``base`` left join each of ``others`` on one key (each unique by it).

    All joins hash on the same key, so every input is shuffled at most once.
    """
    return reduce(lambda left, right: left.join(right, _keys(key), "left"), others, base)


def semi_filter(df: DataFrame, keys_df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys_df``."""
    return df.join(keys_df.select(*_keys(key)).distinct(), _keys(key), "left_semi")


def key_presence(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Every key of either table with its number of rows in each (``n_a``, ``n_b``)."""
    keys = _keys(keys)
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    return tagged.groupBy(*keys).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))


def overlap_counts() -> list[Column]:
    """Aggregates over ``key_presence``: distinct keys in a, in b, in both, in either."""
    in_a, in_b = F.col("n_a") > 0, F.col("n_b") > 0
    return [
        F.count_if(in_a).alias("keys_a"),
        F.count_if(in_b).alias("keys_b"),
        F.count_if(in_a & in_b).alias("keys_both"),
        F.count("*").alias("keys_all"),
        (F.count_if(in_a & in_b) == 0).alias("disjoint"),
    ]


def key_overlap(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row: distinct keys in a, in b, in both and in either, and whether disjoint."""
    return key_presence(a, b, keys).agg(*overlap_counts())


def key_difference(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` does not have."""
    keys = _keys(keys)
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def union_by_position(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Union all with columns aligned by name; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_intersection(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    keys = _keys(keys)
    return a.select(*keys).intersect(b.select(*keys))


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    key: str | Sequence[str],
    max_rows: int = LOOKUP_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Left join to a lookup table that is unique by ``key``.

    The lookup is counted first. Up to ``max_rows`` it is broadcast and ``df``
    is not shuffled. A larger one is joined by shuffle; one key may hold most of
    the rows of ``df``, which is the side of a left join that Spark can split.
    Give ``rows`` if the lookup is a written table whose size is known.
    """
    keys = _keys(key)
    if rows is None:
        lookup = materialize(lookup, "lookup")
        rows = lookup.count()
    if rows <= max_rows:
        return df.join(F.broadcast(lookup), keys, "left")
    return df.join(lookup, keys, "left")
