"""Exact duplicates by a tree merge of sorted digest runs.

Every partition turns its rows into runs: sorted by digest, one record per digest, which
holds the best row so far and the number of rows. Runs are cut into digest ranges, and the
partitions exchange them in rounds of a binomial tree (``FAN_IN`` runs of a range become one).
A task lays the runs of a range beside each other and merges them multiway, in one pass over the
least records, retaining the best row of each digest. It never holds more than one range of
``FAN_IN`` runs, and a digest that a third of all rows share is one record per run from the
start. Records are merged only if the SHA-256, a second 64-bit hash and the length of the
normalised text all agree.

Null texts are empty texts; empty texts are equal to each other. Ids are whole numbers; a null id ranks
after all others. Rows that repeat an id and a text count as copies; ``keep_one`` leaves one row of each
group: most code points, smallest id, then the text that sorts first. An empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import merge

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import WHITE, one_of_each, text_of, without
from retentia.sources.tables import materialize

#: Runs that one merge takes in; a power of two, so that a round is three steps of a binomial tree.
FAN_IN = 8
KEY = ["sha", "second", "n_bytes"]
RECORD = "run int, sha binary, second bigint, n_bytes int, n_chars int, no_id boolean, doc_id bigint, copies bigint"


def normalised(text_col: str) -> Column:
    """The text without white space; plain replacement is faster here than a pattern."""
    out = text_of(text_col)
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digest(text_col: str) -> Column:
    return F.unhex(F.sha2(normalised(text_col), 256))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as a sorted run: the best row of every digest, and how many rows have it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).append_column("copies", pa.array([1] * batch.num_rows, pa.int64()))
        order = [("sha", "ascending"), ("second", "ascending"), ("n_bytes", "ascending"), ("n_chars", "descending"), ("no_id", "ascending"), ("doc_id", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order)).combine_chunks()
        sha, second, size = (rows.column(c).combine_chunks() for c in KEY)
        new = pc.or_(
            pc.or_(pc.not_equal(sha[1:], sha[:-1]), pc.not_equal(second[1:], second[:-1])),
            pc.not_equal(size[1:], size[:-1]),
        ).to_numpy(zero_copy_only=False)
        firsts = [0, *(new.nonzero()[0] + 1).tolist()]
        out = rows.take(firsts)
        counts = [b - a for a, b in zip(firsts, [*firsts[1:], rows.num_rows], strict=True)]
        out = out.set_column(out.schema.get_field_index("copies"), "copies", pa.array(counts, pa.int64()))
        yield from out.to_batches()


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written record per row: id, code points of the text, digests of the normalised text."""
    clean = normalised(text_col)
    return materialize(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.length(text_of(text_col)).alias("n_chars"),
            F.unhex(F.sha2(clean, 256)).alias("sha"),
            F.xxhash64(clean).alias("second"),
            F.octet_length(clean).alias("n_bytes"),
        ),
        "digests",
    )


_MERGED = "part int, run int, sha binary, second bigint, n_bytes int, less int, no_id boolean, doc_id bigint, copies bigint"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of each (part, to), which follow each other, into one run per (part, to)."""
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    names = ["part", "run", *KEY, "less", "no_id", "doc_id", "copies"]
    place, runs = None, {}

    def merged() -> Iterator[pa.RecordBatch]:
        rows, best, copies = [], None, 0
        # Records are (sha, second, n_bytes, less, no_id, doc_id, copies), so the best of a digest comes first.
        for record in merge(*runs.values()):
            if best is not None and record[:3] == best[:3]:
                copies += record[6]
                continue
            if best is not None:
                rows.append((*place, *best[:5], None if best[4] else best[5], copies))
            best, copies = record, record[6]
        if best is not None:
            rows.append((*place, *best[:5], None if best[4] else best[5], copies))
        runs.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "to", "run", *KEY, "less", "no_id", "doc_id", "copies")]
        for part, to, run, sha, second, size, less, no_id, doc_id, copies in zip(*columns, strict=True):
            if (part, to) != place:
                yield from merged()
                place = (part, to)
            runs.setdefault(run, []).append((sha, second, size, less, no_id, 0 if no_id else doc_id, copies))
    yield from merged()


def merge_runs(records: DataFrame) -> DataFrame:
    """One record per digest: the row that stays, its code points and the number of rows."""
    spark = records.sparkSession
    runs = max(1, records.rdd.getNumPartitions())
    width = max(runs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 1 << max(4, math.ceil(math.log2(4 * width)))
    out = records.select(
        F.spark_partition_id().alias("run"), *KEY, "n_chars", F.col("doc_id").isNull().alias("no_id"), "doc_id"
    ).mapInArrow(_runs, RECORD)
    # The batches of a partition are runs that the first exchange sorts into one.
    # Leading bits of the digest: a range holds neighbouring digests of every run.
    lead = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("bigint")
    out = out.withColumns({"part": F.floor(lead * ranges / F.lit(2**32)).cast("int"), "less": -F.col("n_chars")})
    order = [*KEY, "less", "no_id", "doc_id"]
    rounds = max(1, math.ceil(math.log(runs, FAN_IN))) if runs > 1 else 1
    for k in range(rounds):
        # The last round has one run left, whatever the number of partitions came to be.
        to = F.lit(0) if k == rounds - 1 else F.floor(F.col("run") / FAN_IN).cast("int")
        dealt = out.withColumn("to", to).repartition(width, "part", "to").sortWithinPartitions("part", "to", "run", *order)
        out = dealt.select("part", "to", "run", *KEY, "less", "no_id", "doc_id", "copies").mapInArrow(_merge, _MERGED)
    return out.select(*KEY, F.col("doc_id").alias("keep_id"), (-F.col("less")).alias("keep_chars"), F.col("copies").alias("group_size"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest id stays.
    """
    return _decided(digest_table(docs, id_col, text_col)).drop("sha", "n_chars", "keep_chars")


def _decided(records: DataFrame) -> DataFrame:
    merged = merge_runs(records)
    # The records' side may hold a hot digest; it is the side that Spark splits.
    joined = records.join(merged, KEY, "inner")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "sha",
        "n_chars",
        "keep_chars",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    # A row is known by its id, digest and code points: rows that repeat an id may differ in white space.
    key = F.concat("sha", F.col("n_chars").cast("string").cast("binary")).alias("key")
    stays = (F.col("kept") & (F.col("n_chars") == F.col("keep_chars"))).alias("stays")
    decided = materialize(_decided(digest_table(docs, id_col, text_col)).select("doc_id", stays, key), "decided")
    mark = F.concat(digest(text_col), F.length(text_of(text_col)).cast("string").cast("binary"))
    left = without(docs, decided.filter(~F.col("stays")), mark, id_col)
    repeats = decided.filter("stays").groupBy("key").count().filter("count > 1")
    if repeats.isEmpty():
        return left
    # Rows that repeat the id and code points of the row that stays: one is left, also among null ids.
    return one_of_each(left, mark, text_of(text_col))
