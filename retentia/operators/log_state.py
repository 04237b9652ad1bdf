"""Activity features that a new log file updates without reading the old ones again.

The state has one row per key: the number of rows, the sum of every measure, and the ``k`` latest
rows. States add up: the state of a new file, merged with the one before, is the state of all
files together, also where days come late or repeat. Versions are written beside each other with the names of the
files they hold, so an update that is run twice, or again after it was cut off, changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators.activity import RECENCY_SUFFIXES, activity_measures, recent_rows
from retentia.sources.tables import hadoop_path, write_table


def _known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    return known


def state_of(
    logs: DataFrame,
    key: str | Sequence[str],
    order: str,
    measures: Mapping[str, Column] | None = None,
    k: int = len(RECENCY_SUFFIXES),
    tie: Sequence[str] = (),
) -> DataFrame:
    """(key, ``rows``, ``sums`` by measure, ``recent``: the ``k`` latest rows, latest first) per key of ``logs``.

    Rows of equal ``order`` and ``tie`` go by their measures, so that the latest rows do not depend
    on which file a row came with. A null key names no user: it counts 0 rows and has no latest ones.
    """
    keys = [key] if isinstance(key, str) else list(key)
    measures = activity_measures() if measures is None else dict(measures)
    kept = list(dict.fromkeys([order, *tie]))
    plain = logs.select(*keys, *[F.col(c) for c in kept], *[m.alias(f"m_{name}") for name, m in measures.items()])
    names = [f"m_{name}" for name in measures]
    latest = recent_rows(plain, keys, order, k, [*tie, *names])
    recent = latest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("recency", *kept, *names))).alias("recent"))
    recent = recent.withColumn("recent", F.transform("recent", lambda r: F.struct(*[r[c].alias(c) for c in (*kept, *names)])))
    totals = plain.groupBy(*keys).agg(
        F.count_if(_known(keys)).alias("rows"), F.struct(*[F.sum(n).alias(name) for n, name in zip(names, measures, strict=True)]).alias("sums")
    )
    # Both hash on the key, so joining them moves nothing; a null key has no latest rows.
    return totals.join(recent, keys, "left").select(*keys, "rows", "sums", "recent")


def merge(first: DataFrame, second: DataFrame, key: str | Sequence[str], k: int = len(RECENCY_SUFFIXES)) -> DataFrame:
    """The state of both states' rows together; each has a row per key, so no key is large."""
    keys = [key] if isinstance(key, str) else list(key)
    names = [f.name for f in first.schema["sums"].dataType]
    both = first.unionByName(second.select(*first.columns))
    # From the latest down; within the array nulls come last, as in the order of the rows.
    latest = F.slice(F.sort_array(F.flatten(F.collect_list("recent")), asc=False), 1, k)
    return both.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.struct(*[F.sum(f"sums.{n}").alias(n) for n in names]).alias("sums"), latest.alias("recent")
    )


def features_of(
    state: DataFrame, key: str | Sequence[str], order: str, suffixes: Sequence[str] = RECENCY_SUFFIXES
) -> DataFrame:
    """The activity features of a state: last rows, last-k sums (null for keys with fewer rows) and lifetime sums."""
    keys, k = [key] if isinstance(key, str) else list(key), len(suffixes)
    names = [f.name for f in state.schema["sums"].dataType]
    full = (F.size("recent") == k) & _known(keys)
    out = [F.col("rows").alias("row_count"), *[F.col(f"sums.{n}").alias(f"sum_{n}") for n in names]]
    for i, suffix in enumerate(suffixes):
        row = F.get("recent", F.lit(i))
        out += [row[order].alias(f"{order}_{suffix}"), *[row[f"m_{n}"].alias(f"{n}_{suffix}") for n in names]]
    out.append(F.when(full, F.lit(k).cast("bigint")).alias(f"row_count_{k}last"))
    for n in names:
        values = F.filter(F.col(f"recent.m_{n}"), lambda v: v.isNotNull())
        first, rest = F.get(values, F.lit(0)), F.slice(values, 2, k)
        out.append(F.when(full, F.aggregate(rest, first, lambda a, v: a + v)).alias(f"sum_{n}_{k}last"))
    return state.select(*keys, *out)


def _version(spark: SparkSession, folder: str) -> int:
    """The number of the last version that was finished, 0 for none."""
    path, files = hadoop_path(spark, folder)
    if not files.exists(path):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(path)]
    done = [int(n[len("files-") :]) for n in names if n.startswith("files-") and files.exists(hadoop_path(spark, f"{folder}/{n}/_SUCCESS")[0])]
    return max(done, default=0)


def read_state(spark: SparkSession, folder: str) -> DataFrame | None:
    number = _version(spark, folder)
    return spark.read.parquet(f"{folder}/state-{number}") if number else None


def update(
    spark: SparkSession,
    folder: str,
    logs: DataFrame,
    name: str,
    key: str | Sequence[str],
    order: str,
    measures: Mapping[str, Column] | None = None,
    k: int = len(RECENCY_SUFFIXES),
    tie: Sequence[str] = (),
) -> DataFrame:
    """Merges the log file ``name`` into the state kept in ``folder`` and returns the new state.

    A file that the state already holds is not counted again. The list of files is written after
    the state and makes its version valid; one update runs at a time.
    """
    folder, number = folder.rstrip("/"), _version(spark, folder)
    held = [r["name"] for r in spark.read.parquet(f"{folder}/files-{number}").collect()] if number else []
    if name not in held:
        state = state_of(logs, key, order, measures, k, tie)
        if number:
            state = merge(spark.read.parquet(f"{folder}/state-{number}"), state, key, k)
        write_table(state, f"{folder}/state-{number + 1}")
        write_table(spark.createDataFrame([(n,) for n in [*held, name]], "name string").coalesce(1), f"{folder}/files-{number + 1}")
    return read_state(spark, folder)
