"""Decision trees, forests and second-order boosting, fitted on the executors.

A tree is grown level by level from sums per node, feature and value. While a node has many
rows, its rows are summed by the tasks into at most ``max_bins`` ranges of values per feature, and Spark
adds the tasks' sums; once a node has ``small`` rows or fewer, they go to one task, which grows the
rest of that subtree over all their values. Both use the same search, so a table of few rows, or of few
distinct values, gives the same tree either way.

Rows with a value below the threshold go left, the threshold being halfway between the values
beside it; nulls go to the side that the split gained more by, and right where it saw none. Of splits
equally good to ten digits the first feature and then the lowest threshold is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from retentia.sources.tables import materialize

#: Rows of a node that one task may hold.
SMALL = 100_000
MAX_BINS = 256
#: Nodes of a model up to which it is sent to every task; beyond, rows travel to the subtrees.
SENT_NODES = 2_000_000
_TIE = 1e-10


@dataclass(frozen=True)
class Gini:
    """Sums are the weights of class 0 and 1; nodes are split until they are pure."""

    def part(self, s: np.ndarray) -> np.ndarray:
        total = s.sum(axis=-1)
        return (s**2).sum(axis=-1) / np.where(total > 0, total, 1.0)

    def allowed(self, s: np.ndarray) -> np.ndarray:
        return s.sum(axis=-1) > 0

    def opened(self, s: np.ndarray) -> np.ndarray:
        return (s > 0).all(axis=-1)

    def gains(self, best: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """A split that parts the rows is taken even if it gains nothing by itself."""
        return np.isfinite(best)

    def value(self, s: np.ndarray) -> np.ndarray:
        total = s.sum(axis=-1)
        return s[..., 1] / np.where(total > 0, total, 1.0)


@dataclass(frozen=True)
class SecondOrder:
    """Sums are gradients and Hessians of the log loss; leaves are shrunk by ``penalty``."""

    penalty: float = 1.0
    least: float = 1.0
    rate: float = 0.1

    def part(self, s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / (s[..., 1] + self.penalty)

    def allowed(self, s: np.ndarray) -> np.ndarray:
        return s[..., 1] >= self.least

    def opened(self, s: np.ndarray) -> np.ndarray:
        return s[..., 1] >= 2 * self.least

    def gains(self, best: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return best - self.part(whole) > 1e-6

    def value(self, s: np.ndarray) -> np.ndarray:
        return -self.rate * s[..., 0] / (s[..., 1] + self.penalty)


@dataclass
class Nodes:
    """Nodes of one or more trees; ``feature`` is -1 in a leaf, children are places in the same arrays."""

    feature: np.ndarray
    threshold: np.ndarray
    null_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    FIELDS = ("feature", "threshold", "null_left", "left", "right", "value")

    @classmethod
    def empty(cls) -> Nodes:
        kinds = (np.int32, np.float64, bool, np.int32, np.int32, np.float64)
        return cls(*[np.zeros(0, dtype=k) for k in kinds])

    def __len__(self) -> int:
        return len(self.feature)

    def add(self, values: np.ndarray) -> np.ndarray:
        """New leaves; gives their places."""
        n, start = len(values), len(self)
        fresh = (np.full(n, -1), np.zeros(n), np.zeros(n, dtype=bool), np.zeros(n), np.zeros(n), values)
        for name, more in zip(self.FIELDS, fresh, strict=True):
            have = getattr(self, name)
            setattr(self, name, np.concatenate([have, np.asarray(more).astype(have.dtype)]))
        return np.arange(start, start + n)

    def graft(self, place: int, other: Nodes) -> None:
        """Puts a tree, its root first, in the place of a leaf."""
        shift = len(self) - 1
        at = np.append(place, np.arange(len(self), len(self) + len(other) - 1)).astype(np.int64)
        self.add(np.zeros(len(other) - 1))
        for name in self.FIELDS:
            got = getattr(other, name)
            if name in ("left", "right"):
                got = np.where(other.feature >= 0, got + shift, 0)
            getattr(self, name)[at] = got

    def leaf_of(self, x: np.ndarray, root: int = 0) -> np.ndarray:
        """The leaf that each row of ``x`` (null is NaN) ends in."""
        node = np.full(len(x), root, dtype=np.int64)
        moving = np.flatnonzero(self.feature[node] >= 0)
        while len(moving):
            at = node[moving]
            v = x[moving, self.feature[at]]
            below = np.where(np.isnan(v), self.null_left[at], v < self.threshold[at])
            node[moving] = np.where(below, self.left[at], self.right[at])
            moving = moving[self.feature[node[moving]] >= 0]
        return node


def _best(slot, low, high, sums, totals, nulls, rule):
    """Per slot the best split of one feature, from cells sorted by slot and value (NaN left out).

    ``totals`` are the slots' sums over all rows and ``nulls`` those over rows without a value, None for
    no such rows. Gives the quality, threshold, side of nulls and sums of the left side.
    """
    k = len(totals)
    quality, threshold = np.full(k, -np.inf), np.zeros(k)
    null_left, left = np.zeros(k, dtype=bool), np.zeros((k, 2))
    if not len(slot):
        return quality, threshold, null_left, left
    first = np.append(True, slot[1:] != slot[:-1])
    upto = sums.cumsum(axis=0)
    upto = upto - (upto - sums)[first][np.cumsum(first) - 1]
    last = np.append(first[1:], True)
    edge = ~last & np.append(high[:-1] < low[1:], False)
    with np.errstate(invalid="ignore"):
        middle = high + (np.append(low[1:], np.inf) - high) / 2
    # Halfway may round down to the value on the left.
    middle = np.where(middle > high, middle, np.append(low[1:], np.inf))
    middle[last] = np.inf
    has_null = nulls is not None and (nulls != 0).any(axis=1)
    for side in (False, True) if nulls is not None else (False,):
        at = edge.copy()
        if nulls is not None:
            # Where there are nulls, they may also stand against all values; without, only one side counts.
            at = np.where(has_null[slot], edge | (last & (not side)), edge & (not side))
        at = np.flatnonzero(at)
        if not len(at):
            continue
        part = upto[at] + (nulls[slot[at]] if side else 0)
        rest = totals[slot[at]] - part
        good = np.where(rule.allowed(part) & rule.allowed(rest), rule.part(part) + rule.part(rest), -np.inf)
        heads = np.flatnonzero(np.append(True, slot[at][1:] != slot[at][:-1]))
        top = np.maximum.reduceat(good, heads)
        reach = np.where(np.isfinite(top), top - _TIE * np.abs(top), np.inf)
        length = np.diff(np.append(heads, len(at)))
        ties = np.flatnonzero(good >= np.repeat(reach, length))
        owner, place = np.unique(slot[at][ties], return_index=True)
        chosen = ties[place]
        better = good[chosen] > quality[owner] + _TIE * np.abs(np.where(np.isfinite(quality[owner]), quality[owner], 0))
        owner, chosen = owner[better], chosen[better]
        quality[owner], threshold[owner] = good[chosen], middle[at[chosen]]
        null_left[owner], left[owner] = side, part[chosen]
    return quality, threshold, null_left, left


def _mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers of others (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _child(path: np.ndarray, side: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(path * np.uint64(2) + np.uint64(side + 1))


def _root_path(seed: int, tree: int) -> np.uint64:
    return _mix(np.array([(seed * 1_000_003 + tree) % 2**63], dtype=np.uint64))[0]


def _choose(found: list, whole: np.ndarray, paths: np.ndarray, rule, share: int | None):
    """The best of the features' splits per slot, or -1; with ``share`` among that many drawn features that can split."""
    quality = np.array([f[0] for f in found])
    if share is not None and share < len(found):
        with np.errstate(over="ignore"):
            draw = np.array([_mix(paths ^ _mix(np.full(len(paths), i + 1, dtype=np.uint64))) for i in range(len(found))])
        usable = np.isfinite(quality)
        draw = np.where(usable, draw >> np.uint64(1), np.uint64(2**63))
        quality = np.where(usable & (draw.argsort(axis=0).argsort(axis=0) < share), quality, -np.inf)
    top = quality.max(axis=0)
    reach = np.where(np.isfinite(top), top - _TIE * np.abs(top), np.inf)
    feature = (quality >= reach).argmax(axis=0)
    pick = np.arange(quality.shape[1])
    threshold, null_left, left = (np.array([f[i] for f in found])[feature, pick] for i in (1, 2, 3))
    taken = np.isfinite(top) & rule.gains(top, whole)
    return np.where(taken, feature, -1), threshold, null_left, left


def grow(x, sums, rule, depth=None, share=None, path=np.uint64(1)):
    """A tree over the rows of ``x`` with their ``sums``: its nodes, root first, and the leaf of each row."""
    n, d = x.shape
    nodes, node_of = Nodes.empty(), np.zeros(n, dtype=np.int64)
    whole = sums.sum(axis=0)[None, :]
    places, paths = nodes.add(rule.value(whole)), np.array([path], dtype=np.uint64)
    # Values in order once; a level only regroups them by node.
    orders = [np.argsort(x[:, f], kind="stable") for f in range(d)]
    missing = np.isnan(x)
    rows = np.arange(n)
    while len(places) and (depth is None or depth > 0):
        opened = rule.opened(whole)
        places, paths, whole = places[opened], paths[opened], whole[opened]
        if not len(places):
            break
        slot_of = np.full(len(nodes), -1)
        slot_of[places] = np.arange(len(places))
        slot = slot_of[node_of]
        found = []
        for f in range(d):
            at = orders[f][slot[orders[f]] >= 0]
            at = at[np.argsort(slot[at], kind="stable")]
            gone = missing[at, f]
            nulls = None
            if gone.any():
                nulls = np.stack([np.bincount(slot[at[gone]], sums[at[gone], i], len(places)) for i in (0, 1)], axis=1)
                at = at[~gone]
            v = x[at, f]
            found.append(_best(slot[at], v, v, sums[at], whole, nulls, rule))
        feature, threshold, null_left, left = _choose(found, whole, paths, rule, share)
        split = np.flatnonzero(feature >= 0)
        places, paths, whole = places[split], paths[split], whole[split]
        feature, threshold, null_left, left = feature[split], threshold[split], null_left[split], left[split]
        right = whole - left
        nodes.feature[places], nodes.threshold[places], nodes.null_left[places] = feature, threshold, null_left
        nodes.left[places] = nodes.add(rule.value(left))
        nodes.right[places] = nodes.add(rule.value(right))
        moved = rows[np.isin(node_of, places)]
        at = node_of[moved]
        v = x[moved, nodes.feature[at]]
        below = np.where(np.isnan(v), nodes.null_left[at], v < nodes.threshold[at])
        node_of[moved] = np.where(below, nodes.left[at], nodes.right[at])
        whole = np.concatenate([left, right])
        paths = np.concatenate([_child(paths, 0), _child(paths, 1)])
        places = np.concatenate([nodes.left[places], nodes.right[places]]).astype(np.int64)
        depth = None if depth is None else depth - 1
    return nodes, node_of


def _matrix(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    """The columns as doubles; null is NaN."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols])


def bin_starts(table: DataFrame, cols: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Per column the lowest values of its bins: all distinct values if they are few, else quantiles."""
    cells = [F.struct(F.lit(i).alias("place"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)]
    values = table.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").where("v IS NOT NULL AND NOT isnan(v)")
    numbered = F.row_number().over(Window.partitionBy("place").orderBy("v"))
    few = values.distinct().withColumn("n", numbered).where(F.col("n") <= max_bins + 1)
    starts: list[list[float]] = [[] for _ in cols]
    for row in few.select("place", "v").collect():
        starts[row["place"]].append(row["v"])
    many = [i for i, s in enumerate(starts) if len(s) > max_bins]
    if many:
        parts = [j / max_bins for j in range(1, max_bins)]
        cuts = [F.percentile_approx(F.col(cols[i]).cast("double"), parts, 10_000).alias(f"q{i}") for i in many]
        row = table.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols]).agg(*cuts).first()
        for i in many:
            starts[i] = row[f"q{i}"]
    return [np.unique(np.array(s, dtype=float)) for s in starts]


#: Sums by tree, node, feature and bin that a task holds before it hands them on, about.
HELD_CELLS = 400_000
_CELL = "tree int, node int, place int, bin int, a double, b double, low double, high double"


def _cells_of(cols: Sequence[str], starts: list[np.ndarray], rows_of: Callable) -> Callable:
    """Per task the sums by tree, node, feature and bin (bin -1 for nulls).

    ``rows_of(batch, x)`` gives, per tree, its number, the node and two sums of every row (rows of
    negative node do not count), and the ranges of its nodes: (node, feature, lowest and highest value)
    where a node has equal-width bins of its own, NaN where it has the common ones; or None.
    """

    def handed(kept: dict[tuple[int, int], pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for (tree, f), part in kept.items():
            part.insert(0, "place", f)
            part.insert(0, "tree", tree)
            yield pa.RecordBatch.from_pandas(part[["tree", "node", "place", "bin", "a", "b", "low", "high"]].astype({c: "int32" for c in ("tree", "node", "place", "bin")}), preserve_index=False)
        kept.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], pd.DataFrame] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, cols)
            bins = [np.where(np.isnan(x[:, f]), -1, np.searchsorted(starts[f], x[:, f], side="right")) for f in range(len(cols))]
            for tree, node, a, b, ranges in rows_of(batch, x):
                on = node >= 0
                for f in range(len(cols)):
                    v, own = x[on, f], bins[f][on]
                    if ranges is not None:
                        low, high = ranges[node[on], f, 0], ranges[node[on], f, 1]
                        with np.errstate(invalid="ignore", divide="ignore"):
                            place = np.floor((v - low) / (high - low) * MAX_BINS)
                        fine = np.where(high > low, np.clip(np.nan_to_num(place), 0, MAX_BINS - 1), 0).astype(np.int64)
                        own = np.where(np.isnan(low) | np.isnan(v), own, fine)
                    part = pd.DataFrame({"node": node[on], "bin": own, "a": a[on], "b": b[on], "low": v, "high": v})
                    if (tree, f) in kept:
                        part = pd.concat([kept[tree, f], part])
                    kept[tree, f] = part.groupby(["node", "bin"], as_index=False).agg({"a": "sum", "b": "sum", "low": "min", "high": "max"})
            if sum(map(len, kept.values())) > HELD_CELLS:
                yield from handed(kept)
        yield from handed(kept)

    return run


def _added(cells: DataFrame) -> DataFrame:
    return cells.groupBy("tree", "node", "place", "bin").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _split_cells(cells: pd.DataFrame, d: int, rule, paths: np.ndarray, share: int | None):
    """The splits of the nodes in ``cells``: their numbers in order, and what ``_choose`` gives, and their sums."""
    numbers, slot = np.unique(cells["node"].to_numpy(), return_inverse=True)
    cells = cells.assign(slot=slot)
    one = cells[cells["place"] == 0]
    whole = np.stack([np.bincount(one["slot"], one[c], len(numbers)) for c in "ab"], axis=1)
    found = []
    for f in range(d):
        own = cells[cells["place"] == f].sort_values(["slot", "low"])
        gone = own["bin"].to_numpy() < 0
        nulls = None
        if gone.any():
            lost = own[gone]
            nulls = np.stack([np.bincount(lost["slot"], lost[c], len(numbers)) for c in "ab"], axis=1)
            own = own[~gone]
        found.append(
            _best(own["slot"].to_numpy(), own["low"].to_numpy(), own["high"].to_numpy(), own[["a", "b"]].to_numpy(float), whole, nulls, rule)
        )
    return numbers, _choose(found, whole, paths[numbers], rule, share), whole


_SUBTREE = (
    "tree int, leaf int, feature array<int>, threshold array<double>, null_left array<boolean>, "
    "left array<int>, right array<int>, value array<double>"
)


def _as_row(tree: int, leaf: int, nodes: Nodes) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.float64())
    columns = [pa.array([tree], pa.int32()), pa.array([leaf], pa.int32())]
    columns += [pa.array([getattr(nodes, name)], pa.list_(k)) for name, k in zip(Nodes.FIELDS, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", *Nodes.FIELDS])


def _from_row(row) -> Nodes:
    kinds = (np.int32, np.float64, bool, np.int32, np.int32, np.float64)
    return Nodes(*[np.array(row[name], dtype=k) for name, k in zip(Nodes.FIELDS, kinds, strict=True)])


def _poisson(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap: a Poisson draw of mean 1 from the hash of its key."""
    mixed = _mix(hashes.view(np.uint64) ^ _mix(np.array([seed * 7_919 + tree + 1], dtype=np.uint64)))
    u = (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53
    steps, term, total = [], np.exp(-1.0), 0.0
    for k in range(1, 20):
        total += term
        steps.append(total)
        term /= k
    return np.searchsorted(np.array(steps), u, side="right").astype(np.float64)


@dataclass
class TreeModel:
    """Trees over ``cols``; ``tops`` has one root per tree, and ``subtrees`` what is below their numbered leaves.

    ``subtrees`` is None if all nodes are in ``tops``.
    """

    cols: list[str]
    tops: list[Nodes]
    subtrees: DataFrame | None
    boosted: bool = False

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` plus ``name``: the probability of class 1, averaged over the trees (or from summed margins)."""
        if self.subtrees is None:
            return score_sent({name: self}, df)
        return self._score_by_subtrees(df, name)

    def _score_by_subtrees(self, df: DataFrame, name: str) -> DataFrame:
        """Each row goes to the subtree it falls into in every tree; a leaf with many rows is dealt to several tasks."""
        cols, tops = self.cols, self.tops
        doubles = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        inputs, xs = rows.select("_row", *doubles), [f"_x{i}" for i in range(len(cols))]

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, xs)
                for tree, top in enumerate(tops):
                    leaf = top.leaf_of(x) if batch.num_rows else np.zeros(0)
                    columns = [pa.array(np.full(batch.num_rows, tree, dtype=np.int32)), pa.array(leaf.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, *batch.columns], names=["tree", "leaf", "_row", *xs])

        numbers = ", ".join(f"{c} double" for c in xs)
        wanted = materialize(inputs.mapInArrow(routed, f"tree int, leaf int, _row bigint, {numbers}"), "wanted")
        lots = wanted.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / F.lit(float(SMALL))).cast("bigint").alias("_lots"))
        below = self.subtrees.join(lots, ["tree", "leaf"]).withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_lots") - 1))).drop("_lots")
        asked = wanted.join(lots, ["tree", "leaf"]).withColumn("_lot", F.pmod(F.xxhash64("_row"), F.col("_lots"))).drop("_lots")

        def vote(left: pa.Table, right: pa.Table) -> pa.Table:
            schema = pa.schema([("_row", pa.int64()), ("_p", pa.float64())])
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            nodes = _from_row(right.to_pylist()[0])
            x = np.column_stack([left.column(c).to_numpy() for c in xs])
            return pa.table([left.column("_row"), pa.array(nodes.value[nodes.leaf_of(x)])], schema=schema)

        by = ("tree", "leaf", "_lot")
        votes = asked.groupBy(*by).cogroup(below.groupBy(*by)).applyInArrow(vote, "_row bigint, _p double")
        return rows.join(votes.groupBy("_row").agg(F.avg("_p").alias(name)), "_row", "left").drop("_row")


def score_sent(models: Mapping[str, TreeModel], df: DataFrame) -> DataFrame:
    """``df`` plus a probability per name, all in one pass; the nodes (no model has subtrees) are broadcast, once per Python worker."""
    # Bare arrays, as workers need not find this package.
    sent = [(m.cols, [[getattr(top, field) for field in Nodes.FIELDS] for top in m.tops], m.boosted) for m in models.values()]
    names, shared = list(models), df.sparkSession.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cols, tops, boosted in shared.value:
                x = _matrix(batch, cols) if batch.num_rows else np.zeros((0, len(cols)))
                total = np.zeros(len(x))
                for arrays in tops:
                    top = Nodes(*arrays)
                    total += top.value[top.leaf_of(x)]
                found.append(pa.array(0.5 * (1 + np.tanh(total / 2)) if boosted else total / max(1, len(tops))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in names)]))


def _prepared(train: DataFrame, cols: Sequence[str], label: str, key: str) -> DataFrame:
    doubles = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    known = train.where(F.col(label).isNotNull())
    return materialize(known.select(F.xxhash64(key).alias("h"), *doubles, F.col(label).cast("double").alias("y")), "rows")


def fit_trees(
    train: DataFrame,
    cols: Sequence[str],
    label: str,
    key: str,
    trees: int = 1,
    bootstrap: bool = False,
    share: int | None = None,
    depth: int | None = None,
    seed: int = 19,
    small: int = SMALL,
    max_bins: int = MAX_BINS,
    sent_nodes: int = SENT_NODES,
) -> TreeModel:
    """Classification trees by the Gini index, grown until their leaves are pure or ``depth`` is reached.

    With ``bootstrap`` each tree weights the rows by a Poisson draw from the key's hash, and with
    ``share`` each node looks at that many features, drawn anew, that can split it. ``key`` only feeds the
    draws. A tree of pure leaves can have as many nodes as the rows: above ``small`` rows a node is split
    by sums over bins (over its own values once the common bins cannot part it), and its place in the tree
    is all that the driver holds; below, one task takes its rows.
    """
    cols, rule = list(cols), Gini()
    rows, xs = _prepared(train, cols, label, key), [f"x{i}" for i in range(len(cols))]
    tops = [Nodes.empty() for _ in range(trees)]
    size = rows.count()
    if not size:
        raise ValueError("no training rows")
    # Per tree the leaves that are still to be split: their paths (for the draws), depths and weights.
    paths = [np.array([_root_path(seed, t)], dtype=np.uint64) for t in range(trees)]
    levels = [np.zeros(1, dtype=np.int64) for _ in range(trees)]
    weights = [np.array([float(size)]) for _ in range(trees)]
    ranges = [np.full((1, len(cols), 2), np.nan) for _ in range(trees)]
    for top in tops:
        top.add(np.zeros(1))

    def weighed(batch: pa.RecordBatch, tree: int) -> np.ndarray:
        if not bootstrap:
            return np.ones(batch.num_rows)
        return _poisson(batch.column("h").to_numpy(), tree, seed)

    starts = bin_starts(rows, xs, max_bins) if size > small else []
    while any((w > small).any() for w in weights):
        large = [w > small for w in weights]

        def rows_of(batch, x, tops=tops, large=large):
            y = batch.column("y").to_numpy()
            for tree, top in enumerate(tops):
                if large[tree].any():
                    w = weighed(batch, tree)
                    node = top.leaf_of(x)
                    own = None if np.isnan(ranges[tree]).all() else ranges[tree]
                    yield tree, np.where(large[tree][node] & (w > 0), node, -1), w * (1 - y), w * y, own

        cells = _added(rows.mapInArrow(_cells_of(xs, starts, rows_of), _CELL))

        def splits(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            _, (feature, threshold, null_left, left), whole = _split_cells(pdf, len(cols), rule, paths[tree], share)
            known = pdf[pdf["bin"] >= 0]
            low, high = ([known[known["place"] == f][c].agg(how) for f in range(len(cols))] for c, how in (("low", "min"), ("high", "max")))
            one = (tree, node, feature[0], threshold[0], null_left[0], *left[0], *whole[0], low, high)
            return pd.DataFrame([one], columns=["tree", "node", "feature", "threshold", "null_left", "l0", "l1", "w0", "w1", "low", "high"])

        schema = (
            "tree int, node int, feature int, threshold double, null_left boolean, l0 double, l1 double, w0 double, w1 double, "
            "low array<double>, high array<double>"
        )
        found = cells.groupBy("tree", "node").applyInPandas(splits, schema).toPandas().sort_values(["tree", "node"])
        for tree in range(trees):
            weights[tree][large[tree]] = 0.0  # done, unless split below
        for tree, part in found.groupby("tree"):
            top, whole = tops[tree], part[["w0", "w1"]].to_numpy(float)
            node = part["node"].to_numpy()
            top.value[node] = rule.value(whole)
            open_ = rule.opened(whole) & (part["feature"].to_numpy() >= 0)
            if depth is not None:
                open_ &= levels[tree][node] < depth
            # Impure, but each feature has all its values in one bin: it gets bins over its own values next time,
            # unless it has one value of each and cannot be split.
            low, high = (np.array(part[c].tolist(), dtype=float).reshape(len(part), -1) for c in ("low", "high"))
            stuck = rule.opened(whole) & (part["feature"].to_numpy() < 0) & (low < high).any(axis=1)
            if depth is not None:
                stuck &= levels[tree][node] < depth
            weights[tree][node[stuck]] = whole[stuck].sum(axis=1)
            ranges[tree][node[stuck]] = np.stack([low[stuck], high[stuck]], axis=2)
            part, node, whole = part[open_], node[open_], whole[open_]
            left = part[["l0", "l1"]].to_numpy(float)
            top.feature[node], top.threshold[node], top.null_left[node] = part["feature"], part["threshold"], part["null_left"]
            for side, sums in ((0, left), (1, whole - left)):
                places = top.add(rule.value(sums))
                (top.right if side else top.left)[node] = places
                paths[tree] = np.append(paths[tree], _child(paths[tree][node], side))
                levels[tree] = np.append(levels[tree], levels[tree][node] + 1)
                ranges[tree] = np.concatenate([ranges[tree], ranges[tree][node]])
                weights[tree] = np.append(weights[tree], np.where(rule.opened(sums), sums.sum(axis=1), 0.0))
    left_open = [w > 0 for w in weights]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch, xs), batch.column("y")
            for tree, top in enumerate(tops):
                w, leaf = weighed(batch, tree), top.leaf_of(x)
                on = np.flatnonzero(left_open[tree][leaf] & (w > 0))
                columns = [pa.array(np.full(len(on), tree, dtype=np.int32)), pa.array(leaf[on].astype(np.int32)), pa.array(w[on])]
                columns += [pa.array(x[on, i], from_pandas=True) for i in range(len(xs))] + [y.take(pa.array(on))]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "w", *xs, "y"])

    def finished(group: pa.Table) -> pa.Table:
        tree, leaf = group.column("tree")[0].as_py(), group.column("leaf")[0].as_py()
        x = np.column_stack([group.column(c).to_numpy().astype(np.float64) for c in xs])
        w, y = group.column("w").to_numpy(), group.column("y").to_numpy()
        sums = np.column_stack([w * (1 - y), w * y])
        left = None if depth is None else int(depth - levels[tree][leaf])
        nodes, _ = grow(x, sums, rule, left, share, paths[tree][leaf])
        return pa.Table.from_batches([_as_row(tree, leaf, nodes)])

    doubles = ", ".join(f"{c} double" for c in xs)
    handed = rows.mapInArrow(dealt, f"tree int, leaf int, w double, {doubles}, y double")
    subtrees = materialize(handed.groupBy("tree", "leaf").applyInArrow(finished, _SUBTREE), "subtrees")
    nodes = subtrees.agg(F.sum(F.size("feature"))).first()[0] or 0
    if nodes > sent_nodes:
        done = [(t, i, *[[v] for v in (-1, 0.0, False, 0, 0, float(top.value[i]))]) for t, top in enumerate(tops) for i in np.flatnonzero((top.feature < 0) & ~left_open[t])]
        rest = train.sparkSession.createDataFrame([(int(t), int(i), *v) for t, i, *v in done], _SUBTREE)
        return TreeModel(cols, tops, subtrees.unionByName(rest))
    for row in subtrees.collect():  # at most ``sent_nodes`` nodes
        tops[row["tree"]].graft(row["leaf"], _from_row(row))
    return TreeModel(cols, tops, None)


def fit_boosted(
    train: DataFrame,
    cols: Sequence[str],
    label: str,
    key: str,
    rounds: int = 100,
    depth: int = 3,
    rate: float = 0.1,
    penalty: float = 1.0,
    least: float = 1.0,
    small: int = SMALL,
    max_bins: int = MAX_BINS,
) -> TreeModel:
    """Boosted trees on gradients and Hessians of the log loss, from margin 0.

    A split's quality is G^2 / (H + ``penalty``) of its sides, each with a Hessian sum of ``least`` or
    more, and a leaf adds -``rate`` G / (H + ``penalty``). Up to ``small`` rows one task runs all rounds
    over all values; beyond, rows of the same bins are merged, and one task runs all rounds if that leaves ``small`` or
    fewer. Otherwise every level of every tree is a pass that sums over bins, and margins are written every ten trees.
    """
    cols, rule = list(cols), SecondOrder(penalty, least, rate)
    rows, xs = _prepared(train, cols, label, key), [f"x{i}" for i in range(len(cols))]
    size = rows.count()
    if not size:
        raise ValueError("no training rows")
    if size <= small:

        def all_rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            # One order of the rows, whatever the partitions were, so that sums repeat to the last digit.
            order = np.lexsort([table.column(c).to_numpy() for c in ("y", *xs, "h")])
            x = np.column_stack([table.column(c).to_numpy().astype(np.float64) for c in xs])[order]
            y, margin = table.column("y").to_numpy()[order], np.zeros(table.num_rows)
            for tree in range(rounds):
                p = 0.5 * (1 + np.tanh(margin / 2))
                nodes, leaf = grow(x, np.column_stack([p - y, p * (1 - p)]), rule, depth)
                margin += nodes.value[leaf]
                yield _as_row(tree, 0, nodes)

        made = rows.repartition(1).mapInArrow(all_rounds, _SUBTREE).collect()
        return TreeModel(cols, [_from_row(r) for r in sorted(made, key=lambda r: r["tree"])], None, boosted=True)

    starts, trees = bin_starts(rows, xs, max_bins), []
    cells, lows = materialize(_merged(rows, xs, starts), "cells"), [f"l{i}" for i in range(len(cols))]
    if cells.count() <= small:

        def on_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            order = np.lexsort([table.column(f"c{i}").to_numpy() for i in range(len(cols))])
            batch = table.take(pa.array(order)).combine_chunks().to_batches()[0]
            x, margin = _matrix(batch, lows), np.zeros(batch.num_rows)
            for tree in range(rounds):
                top, last = Nodes.empty(), np.zeros(1, dtype=np.int64)
                top.add(np.zeros(1))
                for _ in range(depth):
                    sums = _Sums(len(cols), last, len(top), max_bins)
                    sums.add(batch, top.leaf_of(x), margin)
                    last = _grow_level(top, sums.cells(), len(cols), rule)
                    if not len(last):
                        break
                margin += top.value[top.leaf_of(x)]
                yield _as_row(tree, 0, top)

        made = cells.repartition(1).mapInArrow(on_cells, _SUBTREE).collect()
        return TreeModel(cols, [_from_row(r) for r in sorted(made, key=lambda r: r["tree"])], None, boosted=True)

    written = cells.withColumn("m", F.lit(0.0))
    for number in range(rounds):
        if number and number % 10 == 0:
            written = materialize(written.mapInArrow(_with_margin(lows, trees[-10:]), written.schema), "margins")
        top, recent = Nodes.empty(), trees[number - number % 10 :]
        last = top.add(np.zeros(1))
        for _ in range(depth):

            def summed(batches, top=top, last=last, recent=recent):
                sums = _Sums(len(cols), last, len(top), max_bins)
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x, margin = _matrix(batch, lows), batch.column("m").to_numpy().copy()
                    for tree in recent:
                        margin += tree.value[tree.leaf_of(x)]
                    sums.add(batch, top.leaf_of(x), margin)
                yield pa.RecordBatch.from_pandas(sums.cells(), preserve_index=False)

            # At most 2^depth nodes, with a row per feature and bin.
            last = _grow_level(top, _added(written.mapInArrow(summed, _CELL)).toPandas(), len(cols), rule)
            if not len(last):
                break
        trees.append(top)
    return TreeModel(cols, trees, None, boosted=True)


def _merged(rows: DataFrame, xs: list[str], starts: list[np.ndarray]) -> DataFrame:
    """``rows`` with the same bin of every feature (``c0``..., -1 for nulls) as one: their number ``n``, labels summed to ``y``, lowest and highest values ``l0``... and ``g0``....

    Splits lie between bins, so such rows are never parted and keep one margin.
    """
    places = range(len(xs))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, xs) if batch.num_rows else np.zeros((0, len(xs)))
            codes = [np.where(np.isnan(x[:, f]), -1, np.searchsorted(starts[f], x[:, f], side="right")).astype(np.int32) for f in places]
            yield pa.RecordBatch.from_arrays([*map(pa.array, codes), *batch.select(xs).columns, batch.column("y")], [*(f"c{f}" for f in places), *xs, "y"])

    kinds = [*(f"c{f} int" for f in places), *(f"{c} double" for c in xs), "y double"]
    ends = [e(f"x{f}").alias(f"{name}{f}") for name, e in (("l", F.min), ("g", F.max)) for f in places]
    by = [f"c{f}" for f in places]
    return rows.mapInArrow(coded, ", ".join(kinds)).groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y"), *ends)


class _Sums:
    """Gradients and Hessians of the nodes ``last`` by feature and bin, added up batch by batch."""

    def __init__(self, d: int, last: np.ndarray, nodes: int, max_bins: int):
        self.last, self.width, shape = last, max_bins + 2, (d, len(last) * (max_bins + 2))
        self.slot = np.full(nodes, -1)
        self.slot[last] = np.arange(len(last))
        self.n, self.a, self.b = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.low, self.high = np.full(shape, np.inf), np.full(shape, -np.inf)

    def add(self, batch: pa.RecordBatch, node: np.ndarray, margin: np.ndarray) -> None:
        n, y = batch.column("n").to_numpy(), batch.column("y").to_numpy()
        p, slot = 0.5 * (1 + np.tanh(margin / 2)), self.slot[node]
        on = np.flatnonzero(slot >= 0)
        a, b, n, first = (n * p - y)[on], (n * p * (1 - p))[on], n[on], slot[on] * self.width + 1
        for f in range(len(self.n)):
            at = first + batch.column(f"c{f}").to_numpy()[on]
            for total, each in ((self.n, n), (self.a, a), (self.b, b)):
                total[f] += np.bincount(at, each, total.shape[1])
            ends = (batch.column(f"{c}{f}").to_numpy(zero_copy_only=False).astype(float)[on] for c in "lg")
            np.minimum.at(self.low[f], at, next(ends))
            np.maximum.at(self.high[f], at, next(ends))

    def cells(self) -> pd.DataFrame:
        place, at = np.nonzero(self.n)
        slot, code = np.divmod(at, self.width)
        keys = {"tree": 0 * at, "node": self.last[slot], "place": place, "bin": code - 1}
        values = {name: total[place, at] for name, total in (("a", self.a), ("b", self.b), ("low", self.low), ("high", self.high))}
        return pd.DataFrame({**{k: v.astype(np.int32) for k, v in keys.items()}, **values})


def _grow_level(top: Nodes, cells: pd.DataFrame, d: int, rule) -> np.ndarray:
    """Splits the nodes of ``top`` that ``cells`` has sums of, where that gains; gives their children."""
    node, (feature, threshold, null_left, left), whole = _split_cells(cells, d, rule, np.zeros(len(top), dtype=np.uint64), None)
    top.value[node] = rule.value(whole)
    split = np.flatnonzero((feature >= 0) & rule.opened(whole))
    node = node[split]
    top.feature[node], top.threshold[node], top.null_left[node] = feature[split], threshold[split], null_left[split]
    one, other = top.add(rule.value(left[split])), top.add(rule.value(whole[split] - left[split]))
    top.left[node], top.right[node] = one, other
    return np.concatenate([one, other])


def _with_margin(xs: list[str], trees: list[Nodes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, xs) if batch.num_rows else np.zeros((0, len(xs)))
            margin = batch.column("m").to_numpy().copy()
            for tree in trees:
                margin += tree.value[tree.leaf_of(x)]
            yield batch.set_column(batch.schema.names.index("m"), "m", pa.array(margin))

    return run
