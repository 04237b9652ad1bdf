"""Centroid clustering in exact integers, nearest centroids by a Walsh-Hadamard progressive search.

A vector of 64 components becomes integers (floor of 256 times the component) and then its
64 Walsh-Hadamard coefficients, coarse ones first: the first 2^k of them describe the means
of 2^k blocks of components. The transform keeps distances but for the factor 64, so the
squared differences of the first coefficients are a lower bound of the whole distance, and
a centroid whose bound is above the whole distance to another one is strictly worse. What
is left is finished over all 64 coefficients; of equal distances the smallest number wins.
Sums of coefficients transform back exactly, so the vectors are only kept transformed.

Numbers stay exact: doubles are used while all squared sums are integers below 2^53, Python
integers beyond. Vectors of another length, null vectors and vectors with a null or
non-finite component are left out. A component of 2^49 or more in magnitude and a distance
beyond a long are errors. Null ids rank last among the first centroids, rows that repeat
an id as their coefficients; each row counts as a vector. With fewer vectors than centroids
each vector starts one; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.sources.tables import materialize

DIMS = 64
SCALE = 256
#: Coefficients at which the search drops centroids.
LEVELS = [(0, 4), (4, 8), (8, 16), (16, 32), (32, 64)]
#: Up to this magnitude of coefficients all squared sums are below 2^53.
EXACT = 1 << 22
WIDEST = 1 << 57


def walsh() -> np.ndarray:
    """The Walsh functions as rows of signs, from coarse to fine; its own inverse but for the factor 64 and its transpose."""
    bits = DIMS.bit_length() - 1
    reverse = [int(f"{i:0{bits}b}"[::-1], 2) for i in range(DIMS)]
    return np.array([[-1 if (i & j).bit_count() & 1 else 1 for j in range(DIMS)] for i in reverse], dtype=np.int64)


def _integers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the batch are vectors, and their components as integers."""
    lists = batch.column("vector")
    fits = pc.equal(pc.list_value_length(lists), DIMS).fill_null(False)
    values = pc.list_flatten(lists.filter(fits)).to_numpy(zero_copy_only=False).astype(np.float64)
    values = values.reshape(-1, DIMS)
    whole = np.isfinite(values).all(axis=1)
    kept = np.flatnonzero(fits.to_numpy(zero_copy_only=False))[whole]
    # Times 256 is exact in doubles, short of infinity.
    scaled = np.floor(values[whole] * SCALE)
    if scaled.size and np.abs(scaled).max() >= WIDEST:
        raise ValueError("a component of a vector is 2^49 or more in magnitude")
    return kept, scaled.astype(np.int64)


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signs = walsh()
    for batch in batches:
        kept, whole = _integers(batch)
        if not len(kept):
            continue
        if np.abs(whole).max() < EXACT:
            coefs = (whole.astype(np.float64) @ signs.T.astype(np.float64)).astype(np.int64)
        else:
            coefs = whole @ signs.T
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(kept)), _lists(coefs)], names=["vec_id", "coefs"]
        )


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, rows.size + 1, DIMS, dtype=np.int32)), pa.array(rows.reshape(-1), pa.int64())
    )


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("coefs").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``x`` the number of the nearest row of ``c`` and the squared distance, both transformed."""
    exact = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT
    kind = np.float64 if exact else object
    x, c = x.astype(kind), c.astype(kind)
    part = np.zeros((len(x), len(c)), dtype=kind)
    alive = np.ones(part.shape, dtype=bool)
    least = np.full(len(x), np.inf, dtype=kind)
    for low, high in LEVELS:
        xs, cs = x[:, low:high], c[:, low:high]
        if alive.sum() * 4 > alive.size:
            part += (xs * xs).sum(axis=1)[:, None] + (cs * cs).sum(axis=1)[None, :] - 2 * (xs @ cs.T)
        else:
            row, number = alive.nonzero()
            gap = xs[row] - cs[number]
            part[row, number] += (gap * gap).sum(axis=1)
        if high < DIMS:
            # The whole distance to the centroid that leads so far bounds that to the nearest one.
            gap = x - c[np.where(alive, part, np.inf).argmin(axis=1)]
            least = np.minimum(least, (gap * gap).sum(axis=1))
            alive &= (part <= least[:, None]).astype(bool)
    part = np.where(alive, part, np.inf)
    number = part.argmin(axis=1)
    distance = part[np.arange(len(x)), number] // DIMS
    return number.astype(np.int32), distance.astype(np.int64)


_SUMS = "cluster int, place int, n bigint, total decimal(38,0)"


def _sums_of(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * len(centroids)
        sums = np.zeros(centroids.shape, dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch)
            number, _ = nearest(x, centroids)
            wide = x if np.abs(x).max() < EXACT else x.astype(object)
            for j in np.unique(number):
                own = wide[number == j]
                counts[j] += len(own)
                sums[j] += np.array([int(s) for s in own.sum(axis=0)], dtype=object)
        cells = [(j, i, counts[j], Decimal(sums[j][i])) for j in range(len(counts)) if counts[j] for i in range(DIMS)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        columns = list(zip(*cells, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "place", "n", "total"]
        )

    return run


def _assigned_to(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = nearest(_rows(batch), centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(number), pa.array(distance)], names=["vec_id", "cluster", "distance"]
                )

    return run


def transformed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``vec_id``, ``coefs``) of every vector that can be clustered, written."""
    plain = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    )
    return materialize(plain.mapInArrow(_transformed, "vec_id bigint, coefs array<bigint>"), "vectors")


def components(coefs: np.ndarray) -> np.ndarray:
    """The integer components of transformed rows, as Python integers."""
    return (coefs.astype(object) @ walsh().astype(object)) // DIMS


def start(table: DataFrame, k: int, salt: str) -> np.ndarray:
    """The transformed vectors that come first by the digest of salt and id: the first centroids, ``k`` rows at most."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = table.orderBy(digest.asc_nulls_last(), "coefs").limit(k).collect()
    return np.array([r.coefs for r in first], dtype=np.int64).reshape(-1, DIMS)


def fit(table: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2:") -> np.ndarray:
    """The transformed centroids after ``rounds`` rounds over the written ``table``.

    A task reduces its vectors to a count and 64 sums per centroid, and what reaches the
    driver is one row per centroid and coefficient.
    """
    centroids, signs = start(table, k, salt), walsh().astype(object)
    for _ in range(rounds if len(centroids) else 0):
        parts = table.mapInArrow(_sums_of(centroids), _SUMS).groupBy("cluster", "place")
        totals = parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        sums = np.zeros(centroids.shape, dtype=object)
        moved = centroids.copy()
        for row in totals:
            sums[row.cluster, row.place] = int(row.total)
        for j, n in {row.cluster: row.n for row in totals}.items():
            means = (sums[j] @ signs // DIMS) // n
            moved[j] = (signs @ means).astype(np.int64)
        if (moved == centroids).all():
            break  # further rounds would change nothing either
        centroids = moved
    return centroids


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    salt: str = "2:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid."""
    spark = vectors.sparkSession
    table = transformed(vectors, id_col, vector_col)
    centroids = fit(table, k, rounds, salt)
    assigned = materialize(
        table.mapInArrow(_assigned_to(centroids), "vec_id bigint, cluster int, distance bigint")
        if len(centroids)
        else table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")),
        "assigned",
    )
    sums = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = []
    for j, whole in enumerate(components(centroids)):
        digest = hashlib.sha256(",".join(str(v) for v in whole).encode()).hexdigest()
        rows.append((j, sums.get(j, 0), sum(sums.values()), digest, [int(v) for v in whole]))
    facts = spark.createDataFrame(
        rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
    )
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )
