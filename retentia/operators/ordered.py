"""Running totals and positions over an ordering of the whole table.

An unpartitioned window would send the table to one task. Here the rows are cut
into ranges of the order key, each range is summed on its own, and the totals of
the ranges before it (one row per range) are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.operators.joins import join_by
from retentia.sources.tables import materialize

# Up to this many rows one ordinary window does the work.
ONE_TASK_ROWS = 200_000


def _ordering(order: Sequence[str], descending: bool) -> list[Column]:
    if descending:
        return [F.col(c).desc_nulls_last() for c in order]
    return [F.col(c).asc_nulls_last() for c in order]


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    one_task_rows: int = ONE_TASK_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """``df`` plus, per group ``by``, running sums (own row included) along ``order``.

    ``order`` must be unique inside a group: aggregate by it first. Rows whose ``by``
    is null form groups like any other. Runs a job, because the rows have to be the same for the totals
    of the ranges and for the sums inside them; they are therefore written once. Give
    ``rows`` if the number of rows is known from a count: few rows are then not written.
    """
    by, order = list(by), list(order)
    known_small = rows is not None and rows <= one_task_rows
    table = df if known_small else materialize(df, "ordered")
    ordering = _ordering(order, descending)
    if known_small or (rows is None and table.count() <= one_task_rows):
        upto = Window.partitionBy(*by).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
        return table.select("*", *[F.sum(c).over(upto).alias(name) for name, c in sums.items()])

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(
        table.repartitionByRange(parts, *[F.col(c) for c in by], *ordering).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranges",
    )
    inside = (
        Window.partitionBy(*by, "_part")
        .orderBy(*ordering)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "_part")
        .agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
        .select(
            *by,
            "_part",
            *[
                F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}")
                for name in sums
            ],
        )
    )
    local = ranged.select("*", *[F.sum(c).over(inside).alias(name) for name, c in sums.items()])
    joined = join_by(local, offsets, [*by, "_part"])
    return joined.select(
        *df.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums]
    )


def row_positions(
    df: DataFrame,
    order: Sequence[str],
    name: str = "position",
    descending: bool = False,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """``df`` plus its 0-based position in ``order`` (which must be unique)."""
    numbered = running_totals(
        df, order, {name: F.lit(1)}, descending=descending, one_task_rows=one_task_rows
    )
    return numbered.withColumn(name, F.col(name) - 1)


def next_values(
    df: DataFrame,
    order: Sequence[str],
    cols: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """``df`` plus ``next_{c}``: the value of the row that follows in its group (null for the last).

    ``order`` must be unique inside a group. Beyond ``one_task_rows`` rows the table is cut into ranges; the
    last row of a range takes its value from the first one of the next range of its group.
    """
    by, order = list(by), list(order)
    table, ordering = materialize(df, "ordered"), _ordering(order, descending)
    if table.count() <= one_task_rows:
        after = Window.partitionBy(*by).orderBy(*ordering)
        return table.select("*", *[F.lead(c).over(after).alias(f"next_{c}") for c in cols])
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = table.repartitionByRange(parts, *[F.col(c) for c in by], *ordering)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*by, "_part").orderBy(*ordering)
    local = ranged.withColumns({f"_next_{c}": F.lead(c).over(inside) for c in cols})
    local = local.withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
    heads = ranged.withColumn("_place", F.row_number().over(inside)).where("_place = 1")
    # One row per range and group in it.
    across = Window.partitionBy(*by).orderBy("_part")
    heads = heads.select(*by, "_part", *[F.lead(c).over(across).alias(f"_over_{c}") for c in cols])
    joined = join_by(local, heads, [*by, "_part"])
    return joined.select(
        *df.columns, *[F.when(F.col("_last"), F.col(f"_over_{c}")).otherwise(F.col(f"_next_{c}")).alias(f"next_{c}") for c in cols]
    )


def first_rows(df: DataFrame, order: Sequence[str], n: int, tail: bool = False) -> DataFrame:
    """The first (or last) ``n`` rows in ``order``: a top-k, never a full sort."""
    return df.orderBy(*_ordering(order, tail)).limit(n)
