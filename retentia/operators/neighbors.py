"""Exact k nearest neighbours without comparing all pairs.

Training rows are cut into cells of near-equal size by a tree. From the box and the
row count of every node follows, for a point, a radius that surely holds k rows;
only nodes whose box touches that radius are walked into. Points meet the rows of
just the cells reached, and the k best per cell are merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from retentia.operators.joins import lookup_join
from retentia.operators.pivots import nearest_by_pivots
from retentia.sources.tables import materialize

CELL_ROWS = 512
MAX_DEPTH = 16  # at most 65,536 cells, so the table of boxes stays at a few megabytes
SAMPLE_ROWS = 200_000
POINTS_PER_TASK = 20_000
#: Columns up to which boxes are searched; beyond, pivots.
TREE_COLUMNS = 5


def _splits(sample: np.ndarray, depth: int) -> np.ndarray:
    """Heap-ordered (axis, value) rows: below value goes left. Axis -1 sends all left."""
    tree = np.full((2**depth, 2), -1.0)
    groups = {1: sample}
    for node in range(1, 2**depth):
        points = groups.pop(node, sample[:0])
        left = right = points
        if len(points):
            spread = points.max(axis=0) - points.min(axis=0)
            axis = int(spread.argmax())
            if spread[axis] > 0:
                value = float(np.median(points[:, axis]))
                if value == points[:, axis].min():
                    value = float(points[points[:, axis] > value, axis].min())
                tree[node] = axis, value
                below = points[:, axis] < value
                left, right = points[below], points[~below]
        groups[2 * node], groups[2 * node + 1] = left, right
    return tree


def _cell_of(points: np.ndarray, tree: np.ndarray) -> np.ndarray:
    node = np.ones(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    while len(points) and node[0] < len(tree):
        axis = tree[node, 0].astype(int)
        right = (axis >= 0) & (points[rows, np.maximum(axis, 0)] >= tree[node, 1])
        node = 2 * node + right
    return node


def _with_cell(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("_cell", LongType())])


def _add_cells(df: DataFrame, cols: Sequence[str], tree: np.ndarray) -> DataFrame:
    cols = list(cols)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(_cell=_cell_of(batch[cols].to_numpy(float), tree))

    return df.mapInPandas(assign, _with_cell(df))


def _heap(boxes: pd.DataFrame, d: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, lower and upper corner of every node of the tree, from those of its cells."""
    n = np.zeros(2 ** (depth + 1), dtype=np.int64)
    low, high = np.full((len(n), d), np.inf), np.full((len(n), d), -np.inf)
    cell = boxes["_cell"].to_numpy()
    n[cell] = boxes["n"]
    low[cell] = boxes[[f"lo{i}" for i in range(d)]]
    high[cell] = boxes[[f"hi{i}" for i in range(d)]]
    for level in range(depth - 1, -1, -1):
        node = np.arange(2**level, 2 ** (level + 1))
        n[node] = n[2 * node] + n[2 * node + 1]
        low[node] = np.minimum(low[2 * node], low[2 * node + 1])
        high[node] = np.maximum(high[2 * node], high[2 * node + 1])
    return n, low, high


def _candidate_cells(
    points: DataFrame, cols: Sequence[str], boxes: pd.DataFrame, k: int, depth: int
) -> DataFrame:
    """Each point once per cell that may hold one of its k nearest rows.

    Walks down the tree: a node with k rows bounds the distance of the k-th nearest by
    that of its farthest corner, and nodes beyond the bound are not entered.
    """
    cols = list(cols)
    n, low, high = _heap(boxes, len(cols), depth)

    def walk(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        radius = np.full(len(x), np.inf)
        point, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        for level in range(depth + 1):
            at, lo, hi = x[point], low[node], high[node]
            nearest = (np.maximum(np.maximum(lo - at, at - hi), 0) ** 2).sum(axis=1)
            farthest = (np.maximum(np.abs(at - lo), np.abs(at - hi)) ** 2).sum(axis=1)
            sure = n[node] >= k
            np.minimum.at(radius, point[sure], farthest[sure])
            # A little slack: the two distances are rounded differently.
            keep = (n[node] > 0) & (nearest <= radius[point] * (1 + 1e-9))
            point, node = point[keep], node[keep]
            if level < depth:
                point, node = np.repeat(point, 2), (2 * node[:, None] + [0, 1]).ravel()
        return point, node

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.iloc[start : start + 256]
                point, node = walk(batch[cols].to_numpy(float))
                yield batch.iloc[point].assign(_cell=node)

    return points.mapInPandas(spread, _with_cell(points))


def nearest_rows(
    train: DataFrame,
    points: DataFrame,
    cols: Sequence[str],
    key: str,
    carry: str,
    k: int = 5,
    cell_rows: int = CELL_ROWS,
    points_per_task: int = POINTS_PER_TASK,
) -> DataFrame:
    """The k rows of ``train`` nearest to each distinct point: points' ``cols``, ``rank``,
    ``distance``, the row's ``key`` and ``carry``. Equal distances go by ``key``.

    Exact for any data, but boxes tell little in many dimensions, where every cell would be
    a candidate: ``knn_score`` takes pivots there. The tree is
    shaped by at most ``2 * SAMPLE_ROWS`` rows and has at most ``2 ** MAX_DEPTH`` cells, so
    beyond some 30 million distinct rows the cells grow.
    """
    cols = list(cols)
    # Of equal rows only the k first by key can be among the neighbours of anything.
    same = Window.partitionBy(*cols).orderBy(key)
    rows = materialize(
        train.select(*cols, key, F.col(carry).cast("double").alias(carry))
        .withColumn("_n", F.row_number().over(same))
        .where(F.col("_n") <= k)
        .drop("_n"),
        "rows",
    )
    total = rows.count()
    if not total:
        raise ValueError("no training rows")
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(total, 1) / cell_rows)))))
    step = total // SAMPLE_ROWS + 1
    # The sample only shapes the cells; the search below is exact for any cells.
    sample = (
        rows.where(F.pmod(F.xxhash64(*cols, key), F.lit(step)) == 0)
        .select(*cols)
        .limit(2 * SAMPLE_ROWS)
        .toPandas()
    )
    tree = _splits(np.unique(sample.to_numpy(float), axis=0), depth)
    placed = materialize(_add_cells(rows, cols, tree), "cells")
    boxes = (
        placed.groupBy("_cell")
        .agg(
            F.count("*").alias("n"),
            *[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
            *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)],
        )
        .toPandas()  # one row per cell
    )
    wanted = materialize(
        _candidate_cells(points.select(*cols).distinct(), cols, boxes, k, depth), "candidates"
    )
    # A crowded cell is searched by several tasks, each with a part of the points.
    parts = wanted.groupBy("_cell").agg(
        F.ceil(F.count("*") / F.lit(float(points_per_task))).cast("int").alias("_parts")
    )
    chunk = F.pmod(F.xxhash64(*cols), F.col("_parts").cast("bigint")).cast("int")
    left = wanted.join(F.broadcast(parts), "_cell").withColumn("_part", chunk).drop("_parts")
    right = (
        placed.join(F.broadcast(parts), "_cell")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .drop("_parts")
    )
    key_type = dict(train.dtypes)[key]

    def search(targets: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(key, kind="stable")
        base = pool[cols].to_numpy(float)
        out = []
        # Bounds the matrix of distances to some tens of megabytes.
        step = max(1, 4_000_000 // max(1, len(base)))
        for start in range(0, len(targets) if len(base) else 0, step):
            batch = targets.iloc[start : start + step]
            x = batch[cols].to_numpy(float)
            d = np.zeros((len(x), len(base)))
            for i in range(len(cols)):
                d += (x[:, i : i + 1] - base[:, i]) ** 2
            reach = min(k, len(base)) - 1
            point, row = np.nonzero(d <= np.partition(d, reach, axis=1)[:, reach : reach + 1])
            order = np.lexsort((row, d[point, row], point))
            point, row = point[order], row[order]
            place = np.arange(len(point)) - np.searchsorted(point, point)
            point, row = point[place <= reach], row[place <= reach]
            found = batch[cols].iloc[point].reset_index(drop=True)
            found["distance"] = d[point, row]
            found[key] = pool[key].to_numpy()[row]
            found[carry] = pool[carry].to_numpy()[row]
            out.append(found)
        if out:
            return pd.concat(out, ignore_index=True)
        return pd.DataFrame(columns=[*cols, "distance", key, carry])

    doubles = ", ".join(f"`{c}` double" for c in cols)
    found = (
        left.groupBy("_cell", "_part")
        .cogroup(right.groupBy("_cell", "_part"))
        .applyInPandas(search, f"{doubles}, distance double, `{key}` {key_type}, `{carry}` double")
    )
    best_first = Window.partitionBy(*cols).orderBy("distance", key)
    return (
        found.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select(*cols, "rank", F.sqrt("distance").alias("distance"), key, carry)
    )


def knn_score(
    train: DataFrame,
    test: DataFrame,
    cols: Sequence[str],
    label: str,
    key: str,
    k: int = 5,
    **kw,
) -> DataFrame:
    """``test`` plus ``p``: the mean label of the k nearest training rows."""
    cols = list(cols)
    doubles = {c: F.col(c).cast("double") for c in cols}
    train, test = train.withColumns(doubles), test.withColumns(doubles)
    search = nearest_rows if len(cols) <= TREE_COLUMNS else nearest_by_pivots
    nearest = search(train, test, cols, key, label, k, **kw)
    votes = nearest.groupBy(*cols).agg(F.avg(label).alias("p"))
    return lookup_join(test, votes, cols)
