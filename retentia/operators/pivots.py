"""Exact k nearest neighbours in many columns, by pivots and the triangle inequality.

Every training row belongs to the cell of its nearest pivot and knows its distance to it. A point
first searches the cell of its own nearest pivot, whose k-th distance R bounds the search from then
on. Another cell, with pivot p at distance D from the point, can only hold nearer rows at a distance
between D - R and D + R from p, and none if the plane halfway between p and the point's own
pivot is farther than R; in the cells that are left only that window of rows is compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.sources.tables import materialize

#: Pivots at most, and the rows that shape them; a pivot stands for the square root of the rows up to that.
MOST_PIVOTS = 2048
SAMPLE_ROWS = 50_000
POINTS_PER_TASK = 5_000
# Bounds and distances are rounded differently.
_SLACK = 1e-9


def squared(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Squared distances, summed column after column so that they are the same wherever they are computed."""
    d = np.zeros((len(x), len(base)))
    for i in range(x.shape[1]):
        d += (x[:, i : i + 1] - base[:, i]) ** 2
    return d


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of the sample: rows spread over it, moved to the mean of their cells three times."""
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(count, len(distinct))).astype(int)]
    for _ in range(3):
        own = np.concatenate([squared(sample[i : i + 2000], centres).argmin(axis=1) for i in range(0, len(sample), 2000)])
        for j in np.unique(own):
            centres[j] = sample[own == j].mean(axis=0)
    return np.unique(centres, axis=0)


def _placed(df: DataFrame, cols: list[str], pivots: np.ndarray) -> DataFrame:
    """``df`` with ``_cell``, its nearest pivot, and ``_r``, the distance to it."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.iloc[start : start + 1000]
                d = squared(batch[cols].to_numpy(float), pivots)
                cell = d.argmin(axis=1)
                yield batch.assign(_cell=cell.astype(np.int32), _r=np.sqrt(d[np.arange(len(d)), cell]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(place, f"{fields}, _cell int, _r double")


def _other_cells(points: DataFrame, cols: list[str], pivots: np.ndarray, cells: pd.DataFrame, k: int) -> DataFrame:
    """Each point (with ``_cell`` and ``_reach``, its bound or null) once per other cell that may hold nearer rows."""
    number = cells["_cell"].to_numpy()
    rows, low, high = cells["n"].to_numpy(), cells["low"].to_numpy(), cells["high"].to_numpy()
    at = pivots[number]
    between = np.sqrt(squared(at, at))
    place_of = np.full(len(pivots), -1)
    place_of[number] = np.arange(len(number))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.iloc[start : start + 256]
                d2 = squared(batch[cols].to_numpy(float), at)
                d = np.sqrt(d2)
                # A point whose own cell holds too few rows: cells that surely hold k rows bound it.
                far = d + high
                order = far.argsort(axis=1)
                enough = (rows[order].cumsum(axis=1) >= k).argmax(axis=1)
                sure = far[np.arange(len(d)), order[np.arange(len(d)), enough]]
                sure = np.where(rows.sum() >= k, sure, np.inf)
                reach = np.where(batch["_reach"].isna(), sure, batch["_reach"].fillna(0.0)) * (1 + _SLACK)
                home = place_of[batch["_cell"].to_numpy()]
                near = (d - reach[:, None] <= high * (1 + _SLACK)) & (d + reach[:, None] >= low * (1 - _SLACK))
                known = np.flatnonzero(home >= 0)
                h = home[known]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d2[known] - d2[known, h][:, None]) / (2 * between[h])
                near[known] &= ~(plane > reach[known][:, None] * (1 + _SLACK) + _SLACK * d[known])
                near[known, h] = False
                point, cell = near.nonzero()
                out = batch[cols].iloc[point].reset_index(drop=True)
                out["_cell"] = number[cell].astype(np.int32)
                out["_from"] = d[point, cell] - reach[point] - _SLACK * (1 + d[point, cell])
                out["_to"] = d[point, cell] + reach[point] + _SLACK * (1 + d[point, cell])
                yield out

    doubles = ", ".join(f"`{c}` double" for c in cols)
    return points.mapInPandas(spread, f"{doubles}, _cell int, _from double, _to double")


def _searched(wanted: DataFrame, placed: DataFrame, cols: list[str], key: str, carry: str, k: int, per_task: int) -> DataFrame:
    """For each point and cell of ``wanted`` the k best rows of its window, and ``_pairs``, how many were compared."""
    parts = wanted.groupBy("_cell").agg(F.ceil(F.count("*") / F.lit(float(per_task))).cast("int").alias("_parts"))
    left = wanted.join(parts, "_cell").withColumn("_part", F.pmod(F.xxhash64(*cols), F.col("_parts").cast("bigint")).cast("int")).drop("_parts")
    right = placed.join(parts, "_cell").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def search(targets: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        names = [*cols, "distance", key, carry, "_cell", "_pairs"]
        pool = pool.sort_values(["_r", key], kind="stable")
        base, r = pool[cols].to_numpy(float), pool["_r"].to_numpy()
        if not len(base) or not len(targets):
            return pd.DataFrame(columns=names)
        first = np.searchsorted(r, targets["_from"].to_numpy(), side="left")
        last = np.searchsorted(r, targets["_to"].to_numpy(), side="right")
        x = targets[cols].to_numpy(float)
        keys = pool[key].to_numpy()
        rank = np.empty(len(keys), dtype=np.int64)
        rank[np.argsort(keys, kind="stable")] = np.arange(len(keys))
        point, row, distance = [], [], []
        for i, (a, b) in enumerate(zip(first, last, strict=True)):
            if a < b:
                d = squared(x[i : i + 1], base[a:b])[0]
                best = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                best = best[np.lexsort((rank[a + best], d[best]))][:k]
                point.append(np.full(len(best), i))
                row.append(a + best)
                distance.append(d[best])
        if not point:
            return pd.DataFrame(columns=names)
        point, row = np.concatenate(point), np.concatenate(row)
        found = targets[cols].iloc[point].reset_index(drop=True)
        found["distance"] = np.concatenate(distance)
        found[key] = keys[row]
        found[carry] = pool[carry].to_numpy()[row]
        found["_cell"] = targets["_cell"].to_numpy()[point]
        found["_pairs"] = (last - first)[point]
        return found

    doubles = ", ".join(f"`{c}` double" for c in cols)
    schema = f"{doubles}, distance double, `{key}` {dict(placed.dtypes)[key]}, `{carry}` double, _cell int, _pairs bigint"
    by = ("_cell", "_part")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, schema)


def found_rows(
    train: DataFrame,
    points: DataFrame,
    cols: Sequence[str],
    key: str,
    carry: str,
    k: int = 5,
    pivots: int | None = None,
    points_per_task: int = POINTS_PER_TASK,
) -> DataFrame:
    """For each distinct point and cell searched the best rows found there, the k nearest among them.

    Gives the points' ``cols``, squared ``distance``, the row's ``key`` and ``carry``, ``_cell``, and ``_pairs``,
    the rows compared there. ``train`` and ``points`` have ``cols`` as doubles.
    """
    cols = list(cols)
    # Of equal rows only the k first by key can be among the neighbours of anything.
    same = Window.partitionBy(*cols).orderBy(key)
    rows = train.select(*cols, key, F.col(carry).cast("double").alias(carry)).withColumn("_n", F.row_number().over(same))
    rows = materialize(rows.where(F.col("_n") <= k).drop("_n"), "rows")
    total = rows.count()
    if not total:
        raise ValueError("no training rows")
    # The sample only shapes the cells; the search is exact for any pivots.
    step = total // SAMPLE_ROWS + 1
    drawn = rows.where(F.pmod(F.xxhash64(*cols, key), F.lit(step)) == 0).select(*cols).limit(2 * SAMPLE_ROWS)
    sample = drawn.toPandas().to_numpy(float)
    if not len(sample):
        sample = rows.select(*cols).limit(1).toPandas().to_numpy(float)
    centres = _pivots(sample, pivots or min(MOST_PIVOTS, max(8, int(total**0.5))))
    placed = materialize(_placed(rows, cols, centres), "cells")
    stats = placed.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_r").alias("low"), F.max("_r").alias("high"))
    cells = stats.toPandas().sort_values("_cell").reset_index(drop=True)  # one row per cell
    homes = materialize(_placed(points.select(*cols).distinct(), cols, centres), "points")
    everything = homes.select(*cols, "_cell", F.lit(float("-inf")).alias("_from"), F.lit(float("inf")).alias("_to"))
    home = materialize(_searched(everything, placed, cols, key, carry, k, points_per_task), "home")
    reach = home.groupBy(*cols).agg(F.when(F.count("*") >= k, F.sqrt(F.max("distance"))).alias("_reach"))
    bounded = homes.drop("_r").join(reach, cols, "left")
    wanted = materialize(_other_cells(bounded, cols, centres, cells, k), "wanted")
    return home.unionByName(_searched(wanted, placed, cols, key, carry, k, points_per_task))


def nearest_by_pivots(train: DataFrame, points: DataFrame, cols: Sequence[str], key: str, carry: str, k: int = 5, **kw) -> DataFrame:
    """The k rows of ``train`` nearest to each distinct point: ``cols``, ``rank``, ``distance``, ``key`` and ``carry``.

    Equal distances go by ``key``.
    """
    found = found_rows(train, points, cols, key, carry, k, **kw)
    best_first = Window.partitionBy(*cols).orderBy("distance", key)
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select(*cols, "rank", F.sqrt("distance").alias("distance"), key, carry)
