"""Merkle manifest of a dataset from levels that are kept as strings.

Every row is a leaf, and per group the leaves, in the order of their ids, form a binary tree
of SHA-256 digests written as hexadecimal text: two neighbours are hashed together, a last
one alone, until one node, the group's subroot, is left. The subroots form such a tree too.

Leaves are placed without sending a group to one task: rows are cut into ranges of group and
id, numbered inside their range, and the counts of the ranges before are added. Aligned blocks
of 256 leaves then keep each of their levels as one string of digests: a fixed-width substring
of two digests is hashed to a parent, and the substrings beside a node are its siblings. The
roots of the blocks are the leaves of the next tier, until one block per group is left, and
the tiers' siblings joined together are the proof of a leaf.

Null ids come before all others and rows that repeat an id are ordered by their leaf; a null
group is a group of its own, before all others. An empty table gives an empty result; columns
that are not named as fields are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.sources.tables import materialize

#: Characters of a digest, and levels that one block spans.
WIDTH = 64
LEVELS = 8
BLOCK = 1 << LEVELS


def leaf(values: Sequence[Column]) -> Column:
    """Digest of the values: each ``-`` if null, else the bytes of its UTF-8 text, a colon and the text."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _placed(rows: DataFrame, grp: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``rows`` (written) with ``pos``, the place inside the group, and ``n``, the group's size; and the largest size."""
    ranged = materialize(
        rows.repartitionByRange(grp, *order)
        .sortWithinPartitions(grp, *order)
        .withColumns({"range": F.spark_partition_id(), "row": F.monotonically_increasing_id()}),
        "ranged",
    )
    group = Window.partitionBy(grp)
    earlier = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and group in it.
    starts = (
        ranged.groupBy(grp, "range")
        .agg(F.count("*").alias("c"), F.min("row").alias("first"))
        .select(
            F.col(grp).alias("_grp"),
            F.col("range").alias("_range"),
            (F.coalesce(F.sum("c").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("c").over(group).alias("n"),
        )
    )
    same = (ranged[grp] == starts["_grp"]) & (ranged["range"] == starts["_range"])
    placed = ranged.join(starts, same).withColumn("pos", F.col("row") + F.col("shift"))
    return placed.drop("_grp", "_range", "range", "row", "shift"), starts.agg(F.max("n")).first()[0] or 0


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _nodes(level: Column, start: Column, count: Column) -> Column:
    """``count`` digests of a level from number ``start`` on; levels are bytes, which substring finds at once."""
    return F.substring(level, (start * WIDTH + 1).cast("int"), (count * WIDTH).cast("int"))


def _parents(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), ((F.octet_length(level) / WIDTH - 1) / 2).cast("int"))
    hashed = F.transform(pairs, lambda i: F.sha2(_nodes(level, i * 2, F.lit(2)), 256))
    return F.array_join(hashed, "").cast("binary")


def _siblings(levels: Column, place: Column, tall: Column) -> Column:
    """Per level what stands beside the node above ``place`` in its pair: text before it, text after it."""

    def beside(k: Column) -> Column:
        level, node = F.element_at(levels, k), F.call_function("shiftright", place, k - 1)
        odd = node % 2
        return F.struct(
            _nodes(level, node - odd, odd).cast("string").alias("before"),
            _nodes(level, node + 1, 1 - odd).cast("string").alias("after"),
        )

    return F.transform(_upto(tall), beside)


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


_PROOF = "array<struct<before:string,after:string>>"


def _climbed(nodes: DataFrame, largest: int, carry: Sequence[str]) -> DataFrame:
    """The blocks of ``nodes`` (grp, pos, n, node and ``carry``), with what lies above them.

    Gives grp, block, members (an array of pos, node and ``carry``), levels, tall (levels that
    the block spans), above (the siblings of the block's root) and root (of the group).
    """
    blocks = nodes.groupBy("grp", F.call_function("shiftright", F.col("pos"), F.lit(LEVELS)).alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", *carry))).alias("members")
    )
    base = F.array(F.array_join(F.col("members.node"), "").cast("binary"))
    blocks = blocks.withColumn("tall", F.least(_height(F.col("n")), F.lit(LEVELS)).cast("int")).withColumn(
        "levels",
        F.aggregate(_upto(F.col("tall")), base, lambda have, _: F.concat(have, F.array(_parents(F.element_at(have, -1))))),
    )
    blocks = materialize(blocks, "blocks")
    top = F.element_at("levels", -1).cast("string")
    if largest <= BLOCK:
        return blocks.withColumns({"above": F.array().cast(_PROOF), "root": top})
    roots = blocks.select(
        "grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("bigint").alias("n"), top.alias("node")
    )
    above = _opened(_climbed(roots, -(-largest // BLOCK), []))
    above = above.select(
        F.col("grp").alias("_grp"), F.col("pos").alias("_pos"), F.col("siblings").alias("above"), "root"
    )
    return blocks.join(above, (blocks["grp"] == above["_grp"]) & (blocks["block"] == above["_pos"])).drop("_grp", "_pos")


def _opened(blocks: DataFrame) -> DataFrame:
    """One row per member of the blocks: grp, its own columns, siblings and root."""
    # Siblings are cut out before the block is opened, so that its levels are not copied to every row.
    members = F.transform(
        "members",
        lambda m, i: F.struct(m.alias("m"), _siblings(F.col("levels"), i, F.col("tall")).alias("own")),
    )
    rest = [c for c in blocks.columns if c not in ("block", "n", "members", "levels", "tall", "above")]
    opened = blocks.select(*rest, "above", F.explode(members).alias("_one"))
    return opened.select(*rest, "_one.m.*", F.concat("_one.own", "above").alias("siblings"))


def fold(node: Column, siblings: Column) -> Column:
    """The root that follows from a leaf and its siblings, from the lowest level up."""
    return F.aggregate(siblings, node, lambda have, s: F.sha2(F.concat(s["before"], have, s["after"]), 256))


def proof_digest(siblings: Column) -> Column:
    """Digest of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang",
    id_col: str = "doc_id",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, siblings (lowest first), and the columns of ``extra``."""
    extra = dict(extra or {})
    leaves = materialize(
        docs.select(
            F.coalesce(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("grp"),
            F.col(f"`{id_col}`").alias("id"),
            leaf([F.col(f"`{c}`") for c in fields]).alias("node"),
            *[c.alias(f"x_{name}") for name, c in extra.items()],
        ),
        "leaves",
    )
    carry = ["id", *[f"x_{name}" for name in extra]]
    placed, largest = _placed(leaves, "grp", ["id", "node"])
    blocks = _climbed(placed, largest, carry)
    # The subroots: one row per group.
    tops = materialize(
        blocks.filter("block = 0").select(F.lit(0).alias("all"), F.col("grp").alias("name"), F.col("root").alias("node")), "subroots"
    )
    tops, groups = _placed(tops, "all", ["name"])
    tops = tops.select(F.lit("").alias("grp"), "pos", "n", "node", "name")
    tops = _opened(_climbed(tops, groups, ["name"])).select(
        "name", F.col("root").alias("whole"), F.col("siblings").alias("last")
    )
    rows = _opened(blocks.join(tops, F.col("grp") == F.col("name")))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("node").alias("leaf"),
        F.col("root").alias("subroot"),
        F.col("whole").alias("root"),
        F.concat("siblings", "last").alias("siblings"),
        *[F.col(f"x_{name}").alias(name) for name in extra],
    )


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, and which rows still lead to its root once every seventh id's n_chars is one more.

    Gives doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    made = manifest(docs, extra={"changed": F.when(hit, changed)})
    folded = made.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("siblings")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("siblings")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
