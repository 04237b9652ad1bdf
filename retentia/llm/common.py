"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that count as white space in the operators' contracts: space, tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column whose nulls count as the empty text."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces whose texts hold about ``chars`` bytes (one row at least)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n) + 1
        if start < batch.num_rows:
            yield batch.slice(start)


def without(docs: DataFrame, dropped: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Rows of ``docs`` but those whose (id, key) is in ``dropped`` (``doc_id``, ``key``); null ids are equal.

    ``dropped`` is a written table, so Spark knows its size: it is broadcast below the
    session's threshold and joined by a shuffle beyond it.
    """
    mark = fresh(docs, "row_key")
    gone = dropped.select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key"))
    marked = docs.withColumn(mark, key)
    same = (marked[mark] == gone["_gone_key"]) & marked[f"`{id_col}`"].eqNullSafe(gone["_gone_id"])
    return marked.join(gone, same, "left_anti").drop(mark)


def one_of_each(docs: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of ``docs`` in ``order`` for each ``key``."""
    name = "_".join(["repeat", *docs.columns])
    first = Window.partitionBy(name).orderBy(order)
    ranked = docs.withColumn(name, key).withColumn(f"{name}_n", F.row_number().over(first))
    return ranked.filter(F.col(f"{name}_n") == 1).drop(name, f"{name}_n")
