"""Reading, writing, views and materialised intermediates."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from retentia.functions.columns import int_date


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    fmt: str = "parquet",
    limit: int | None = None,
    order_by: str | Sequence[str] | None = None,
    dates: Sequence[str] = (),
    header: bool = True,
    nan_as_null: bool | None = None,
) -> DataFrame:
    """Scan a file, a directory of part files, or a list of either.

    ``path`` may be any Hadoop URI (``file:``, ``hdfs:``, ``s3a:``); names that
    start with ``_`` or ``.`` inside a directory are skipped by Spark itself.
    A CSV scan without ``schema`` infers one, which reads the data twice, so
    declare it for anything large. ``dates`` are parsed while reading: declared
    as dates where a schema is given, or converted from ``yyyyMMdd`` integers
    or ISO text after it. ``limit`` needs ``order_by``: files have no row order
    across partitions, so "the first n" is only defined by a sort key.
    """
    reader = spark.read
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if schema is not None and fmt == "csv" and dates:
        schema = StructType(
            [StructField(f.name, DateType() if f.name in dates else f.dataType, True) for f in schema]
        )
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        # With a declared schema the header is checked against it, not ignored.
        reader = reader.options(header=header, inferSchema=schema is None, enforceSchema=False)
    df = reader.format(fmt).load(path)
    if fmt in ("csv", "json") if nan_as_null is None else nan_as_null:
        df = nan_to_null(df)
    types = dict(df.dtypes)
    for name in dates:
        if types[name] in ("int", "bigint"):
            df = df.withColumn(name, int_date(name))
        elif types[name] != "date":
            df = df.withColumn(name, F.col(name).cast("date"))
    if limit is not None:
        if not order_by:
            raise ValueError("limit needs order_by: there is no row order across files")
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        df = df.orderBy(*keys).limit(limit)
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns as null, so that counts, means and orders leave it out."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def _part_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder, or the file itself; names that start with ``_`` or ``.`` are left out."""
    at, files = hadoop_path(spark, path)
    if not files.getFileStatus(at).isDirectory():
        return [at.toString()]
    found = [s.getPath() for s in files.listStatus(at) if s.isFile()]
    return sorted(p.toString() for p in found if not p.getName().startswith(("_", ".")))


def _header(spark: SparkSession, path: str) -> tuple[str, ...] | None:
    """The column names in the first line of a file, unpacked if its name says so; None for an empty file."""
    java = spark.sparkContext._jvm.java
    at, files = hadoop_path(spark, path)
    stream = files.open(at)
    try:
        factory = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory
        codec = factory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(at)
        plain = codec.createInputStream(stream) if codec is not None else stream
        line = java.io.BufferedReader(java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]), ())) if line else None


def read_parts(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    dates: Sequence[str] = (),
    readers: int = 32,
) -> DataFrame:
    """Scan CSV part files, each by its own header: columns are matched by name, and missing ones are null.

    Only first lines are read ahead, by ``readers`` threads; files with equal headers are one scan, and
    the scans are united by name. With ``schema`` just its columns are returned, in its order; without, the types of each scan
    are inferred and the columns are those of all headers, in the order of their first file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    names = [f for p in paths for f in _part_files(spark, p)]
    with ThreadPoolExecutor(readers) as pool:
        headers = list(pool.map(lambda f: _header(spark, f), names))
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, header in zip(names, headers, strict=True):
        if header is not None:
            groups.setdefault(header, []).append(name)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if not groups:
        if schema is None:
            raise ValueError("no part file has a header")
        return spark.createDataFrame([], schema)
    types = {f.name: f.dataType for f in schema} if schema is not None else {}
    united = None
    for header, files in groups.items():
        own = StructType([StructField(c, types.get(c, StringType()), True) for c in header]) if types else None
        known = [c for c in dates if c in header]
        scan = read_table(spark, files, schema=own, fmt="csv", dates=known)
        if types:
            scan = scan.select(*[c for c in header if c in types])
        united = scan if united is None else united.unionByName(scan, allowMissingColumns=True)
    if schema is None:
        return united
    missing = [c for c in types if c not in united.columns]
    united = united.withColumns({c: F.lit(None).cast(DateType() if c in dates else types[c]) for c in missing}) if missing else united
    return united.select(*types)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", header: bool = True, mode: str = "overwrite"
) -> str:
    """Write part files from the executors; nothing goes through the driver."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", header)
    writer.save(path)
    return path


def register(df: DataFrame, name: str) -> DataFrame:
    """Give ``df`` a view name for SQL text and hand it back."""
    df.createOrReplaceTempView(name)
    return df


# Paths made by the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, so that any storage Spark can write can also be cleaned."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # A local session without a folder of its own gets one in its warehouse that goes with the JVM.
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{context.applicationId}"
    path, files = hadoop_path(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``."""
    path = f"{_shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables made inside it.

    Results that are still to be computed from them must be written before that.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            path, files = hadoop_path(spark, path)
            files.delete(path, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result is read more than once and must be the same each time.
    A written table survives the loss of any executor, and unlike a cached one
    it brings exact sizes to the planner and keeps column pruning.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
