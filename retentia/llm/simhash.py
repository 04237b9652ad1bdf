"""Near-duplicates by SimHash fingerprints that differ in few bits.

Fingerprints are cut into 32 segments of two bits and mapped to the number of set bits per
segment. The Manhattan distance of these counts never exceeds the number of differing bits,
so it prunes without losing a pair. The counts are written in unary (0, 01, 11), so that the
distance is the popcount of an exclusive or. Segments form ``b`` blocks; a distance of at
most ``bits`` leaves ``b - bits`` blocks with equal counts, so two linked fingerprints share a
cell in one of the grids, one per choice of ``b - bits`` blocks. There are 15 grids for four bits up to
10^10 distinct fingerprints, so the copies of a fingerprint that are shuffled do not grow with the table. Cells do,
and one of over ``FEW`` members is split again in its task: the segments in which its members may differ form blocks
once more, as many as leave a few members to a finer cell, and each choice of them is one sort. Where that compares no fewer
pairs, as among near copies, the cell is compared as a whole, or taken for crowded. A cell of
over ``MOST`` members, too many for a task, is dealt by finer grids in a second shuffle. Pairs within a
cell are kept if the Manhattan distance and then the bits themselves allow it.

Cells emit a spanning forest, never all pairs. The members of a finer cell with over ``CROWDED``
fingerprints are linked through the balls around them instead: two fingerprints differ in at
most ``bits`` bits exactly if some value lies within half of that of both, and all that share
such a value are linked, which costs the same for each member however many there are.

Null texts are empty; a text without words has fingerprint zero and is linked like any
other. Rows with equal fingerprints are one node. ``component_id`` is the smallest
id of the component (null only if no row of it has an id). Rows that repeat an id get the same result each.
An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import one_of_each, slices, text_of, without
from retentia.llm.components import components
from retentia.sources.tables import materialize

SEGMENTS = 32
#: Fingerprints of a finer cell above which its members are linked by balls and not by pairs.
CROWDED = 16_384
#: Fingerprints above which a cell is split again in its task, and above which in a second shuffle.
FEW, MOST = 512, 1 << 20
#: Logarithms of how many random fingerprints a cell may hold: a shuffled one, and a finer one within a task.
WIDE, NARROW = 19, 3
#: Shingles whose bits are counted at once, and rows of cells compared at once.
CHUNK, ROWS = 32_768, 65_536


def fingerprint(text: str, words: int, seed: int) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(words, len(parts))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(parts) - k] + 1).tolist()]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        some = [digest(line[a:b], seed) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)]
        octets = np.array(some, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42
) -> DataFrame:
    """A written row per row of ``docs``: id, fingerprint, and a hash of the text as ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            marks = [fingerprint(t, words, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(marks, pa.int64()), batch.column("key")], ["doc_id", "fp", "key"]
            )

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"), text_key(text_col).alias("key")
    )
    return materialize(rows.mapInArrow(run, "doc_id bigint, fp bigint, key bigint"), "fingerprints")


def text_key(text_col: str) -> Column:
    return F.xxhash64(text_of(text_col))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def embed(fp: Column) -> Column:
    """The bits set in each two-bit segment, in unary."""
    low = F.lit(_signed(0x5555555555555555))
    next_bit = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseOR(next_bit).bitwiseAND(low)
    two = fp.bitwiseAND(next_bit).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def grids(n: int, bits: int, taken: int = 0, spare: int = WIDE) -> list[int]:
    """The masks of the blocks that each grid compares, for ``n`` distinct fingerprints.

    They leave out the segments of the mask ``taken``, in which the fingerprints agree already.
    """
    free = [s for s in range(SEGMENTS) if not taken >> 2 * s & 3]
    need = math.log2(max(n, 2)) - spare
    blocks = bits + 2
    # Two random segments agree in their counts with probability 3/8.
    while blocks < len(free) and (blocks - bits) / blocks * len(free) * 1.415 < need:
        blocks += 1
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(3 << 2 * s for s in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_signed(sum(chosen)) for chosen in combinations(parts, blocks - bits)]


def _forest(cell: np.ndarray, fp: np.ndarray, near: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root row) of a spanning forest over the linked rows of each cell; rows are sorted by cell."""
    n = len(fp)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, step = np.arange(n), 1
    while True:
        left = left[left + step < n]
        left = left[cell[left] == cell[left + step]]
        if not len(left):
            break
        a = left[root[left] != root[left + step]]
        b = a + step
        close = np.bitwise_count(near[a] ^ near[b]) <= bits
        a, b = a[close], b[close]
        linked = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        a, b = a[linked], b[linked]
        if len(a):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
            while not np.array_equal(up := root[root], root):
                root = up
        step += 1
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def links_in_cells(bits: int, crowded: int, masks: dict[int, int], most: int, again: bool):
    """The worker function over rows sorted by grid and cell; ``masks`` are those of the grids.

    Links come out as (u, v), members of crowded finer cells as (fp, null). Cells of over ``most`` members come out as
    (fp, null, grid, cell) to be dealt ``again``, or else as crowded ones.
    """
    few = min(FEW, crowded)

    def out(u: np.ndarray, v: np.ndarray | None = None, grid: np.ndarray | None = None, cell: np.ndarray | None = None):
        columns = [pa.array(u.view(np.int64))]
        columns.append(pa.nulls(len(u), pa.int64()) if v is None else pa.array(v.view(np.int64)))
        columns.append(pa.nulls(len(u), pa.int32()) if grid is None else pa.array(grid, pa.int32()))
        columns.append(pa.nulls(len(u), pa.int64()) if cell is None else pa.array(cell, pa.int64()))
        return pa.RecordBatch.from_arrays(columns, ["u", "v", "grid", "cell"])

    def pays(finer: list[int], near: np.ndarray) -> bool:
        """Whether the pairs within finer cells are fewer than those that the cell, or one of ``crowded`` each, would have."""
        bound, pairs = len(near) * min(len(near), crowded), 0
        for mask in finer:
            cells = np.sort(near & np.uint64(mask % (1 << 64)))
            widths = np.diff(np.r_[np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]), len(cells)])
            pairs += int((widths[widths <= crowded] ** 2).sum())
            if pairs >= bound:
                return False
        return True

    def split(grid: int, fp: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        links, dense = [], []
        finer_masks = grids(len(fp), bits, masks[grid], NARROW)
        if not pays(finer_masks, near):
            # Members that differ in a few segments only, as near copies do, meet again in most finer cells.
            if len(fp) > crowded:
                yield out(fp)
                return
            rows, roots = _forest(np.zeros(len(fp), np.int64), fp, near, bits)
            if len(rows):
                yield out(fp[rows], fp[roots])
            return
        for mask in finer_masks:
            finer = near & np.uint64(mask % (1 << 64))
            order = np.argsort(finer, kind="stable")
            finer = finer[order]
            new = np.r_[True, finer[1:] != finer[:-1]]
            widths = np.diff(np.r_[np.flatnonzero(new), len(finer)])
            thin = np.repeat(widths <= crowded, widths)
            dense.append(fp[order[~thin]])
            some = fp[order[thin]]
            rows, roots = _forest(np.cumsum(new)[thin], some, near[order[thin]], bits)
            links.append(np.stack([some[rows], some[roots]]))
        pairs, crowd = np.unique(np.concatenate(links, axis=1), axis=1), np.unique(np.concatenate(dense))
        if pairs.shape[1]:
            yield out(pairs[0].copy(), pairs[1].copy())
        if len(crowd):
            yield out(crowd)

    def solve(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        grid, cell, fp, near = (np.concatenate(x) for x in zip(*pieces, strict=True))
        new = np.r_[True, (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])]
        starts = np.flatnonzero(new)
        widths = np.diff(np.r_[starts, len(fp)])
        small = np.repeat(widths <= few, widths)
        some = fp[small]
        rows, roots = _forest(np.cumsum(new)[small], some, near[small], bits)
        if len(rows):
            yield out(some[rows], some[roots])
        for a, n in zip(starts[widths > few].tolist(), widths[widths > few].tolist(), strict=True):
            yield from split(int(grid[a]), fp[a : a + n], near[a : a + n])

    def alone(pieces: list[tuple]) -> pa.RecordBatch:
        grid, cell, fp, _ = (np.concatenate(x) for x in zip(*pieces, strict=True))
        return out(fp, None, grid, cell) if again else out(fp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []  # complete cells that wait
        held = 0
        last: list[tuple] = []  # the cell that may go on in the next batch
        at, size, over = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("grid", "cell", "fp", "near")]
            columns[2], columns[3] = columns[2].view(np.uint64), columns[3].view(np.uint64)
            grid, cell = columns[:2]
            edges = np.flatnonzero((grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])) + 1
            bounds = [0, *edges.tolist(), len(grid)]
            # The first piece may belong to the cell of the batch before; the last may go on.
            middle = (bounds[1], bounds[-2]) if len(bounds) > 3 else None
            pieces = [(bounds[0], bounds[1])] + ([(bounds[-2], bounds[-1])] if len(bounds) > 2 else [])
            for k, (a, b) in enumerate(pieces):
                here = (int(grid[a]), int(cell[a]))
                if here != at:
                    if last and not over:
                        whole += last
                        held += size
                    elif last:
                        yield alone(last)
                    last, size, over, at = [], 0, False, here
                last.append(tuple(c[a:b] for c in columns))
                size += b - a
                if size > most:
                    over = True
                    yield alone(last)
                    last = [tuple(c[:0] for c in columns)]
                if k == 0 and middle:
                    if last and not over:
                        whole += last
                        held += size
                    last, size, over, at = [], 0, False, None
                    widths = np.diff([*[x for x in bounds if middle[0] <= x <= middle[1]]])
                    if widths.max(initial=0) > most:
                        for lo, hi in zip(bounds[1:-2], bounds[2:-1], strict=True):
                            piece = tuple(c[lo:hi] for c in columns)
                            if hi - lo > most:
                                yield alone([piece])
                            else:
                                whole.append(piece)
                                held += hi - lo
                    else:
                        whole.append(tuple(c[middle[0] : middle[1]] for c in columns))
                        held += middle[1] - middle[0]
            if held >= ROWS:
                yield from solve(whole)
                whole, held = [], 0
        if last and not over:
            whole += last
        if whole:
            yield from solve(whole)

    return run


def _by_balls(members: DataFrame, bits: int) -> DataFrame:
    """Links among ``fp`` through the values within half of ``bits`` of them."""
    half, masks = bits // 2, [0]
    for k in range(1, half + 1):
        masks += [_signed(sum(1 << i for i in c)) for c in combinations(range(64), k)]
    shared = F.array(*[F.lit(m) for m in masks])
    centres = members.select("fp", F.explode(shared).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"), "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            centre, fp = (batch.column(c).to_numpy() for c in ("centre", "fp"))
            new = np.r_[centre[0] != at, centre[1:] != centre[:-1]]
            starts = np.where(new, np.arange(len(fp)), -1)
            starts = np.maximum.accumulate(starts)
            head = np.where(starts < 0, first if first is not None else 0, fp[np.maximum(starts, 0)])
            at, first = centre[-1], head[-1]
            keep = fp != head
            yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array(head[keep])], ["u", "v"])

    rows = centres.repartition("centre").sortWithinPartitions("centre", "fp")
    return rows.mapInArrow(run, "u bigint, v bigint").distinct()


def _search(cells: DataFrame, bits: int, crowded: int, masks: dict[int, int], again: bool) -> DataFrame:
    """What ``links_in_cells`` finds in the rows (``fp``, ``near``, ``grid``, ``cell``), written."""
    dealt = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp")
    work = links_in_cells(bits, crowded, masks, MOST, again)
    return materialize(dealt.mapInArrow(work, "u bigint, v bigint, grid int, cell bigint"), "links")


def link(nodes: DataFrame, bits: int = 4, crowded: int = CROWDED) -> DataFrame:
    """Links (``u``, ``v``) that connect what differs in at most ``bits`` bits (even) among distinct ``fp``."""
    if bits % 2:
        raise ValueError("bits must be even")
    masks = dict(enumerate(grids(nodes.count(), bits)))
    near = embed(F.col("fp"))
    cells = nodes.select("fp", near.alias("near")).select(
        "fp", "near", F.posexplode(F.array(*[F.col("near").bitwiseAND(F.lit(m)) for m in masks.values()])).alias("grid", "cell")
    )
    found = _search(cells, bits, crowded, masks, again=True)
    wide = found.filter("v IS NULL AND grid IS NOT NULL")
    largest = wide.groupBy("grid", "cell").count().agg(F.max("count")).first()[0]
    if largest:
        finer = [[m | x for x in grids(largest, bits, m)] for m in masks.values()]
        count = max(map(len, finer))
        below = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in some]) for some in finer])
        cells = wide.select(F.col("u").alias("fp"), embed(F.col("u")).alias("near"), "grid", F.posexplode(below[F.col("grid")])).select(
            "fp", "near", (F.col("grid") * count + F.col("pos")).alias("grid"), F.col("near").bitwiseAND(F.col("col")).alias("cell")
        )
        masks = {k * count + i: x for k, some in enumerate(finer) for i, x in enumerate(some)}
        found = found.filter("v IS NOT NULL OR grid IS NULL").unionByName(_search(cells, bits, crowded, masks, again=False))
    pairs = found.filter("v IS NOT NULL").select("u", "v")
    dense = found.filter("v IS NULL").filter("grid IS NULL").select(F.col("u").alias("fp")).distinct()
    if dense.isEmpty():
        return pairs
    # Links between a crowded cell's members; those to others are found in the others' cells or here.
    return pairs.unionByName(_by_balls(materialize(dense, "dense"), bits))


def group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    bits: int = 4,
    seed: int = 42,
    crowded: int = CROWDED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, fp, fingerprint, component_id, stays.

    ``stays`` marks the smallest id of each component (of rows that repeat it, those whose text
    has the smallest hash; the same among null ids if there are no others).
    """
    marks = fingerprints(docs, id_col, text_col, words, seed)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("least")
    nodes = materialize(marks.groupBy("fp").agg(least), "nodes")
    roots = components(link(nodes.select("fp"), bits, crowded))
    named = materialize(
        nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "named",
    )
    # Written, so that both sides of the join are plain exchanges and Spark can split a hot root.
    best = materialize(named.groupBy("root").agg(F.min("least").alias("best")), "best")
    chosen = named.select("fp", "root").join(best, "root").select("fp", "best")
    return marks.join(chosen, "fp").select(
        "doc_id",
        "key",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))).alias("stays"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4, seed: int = 42
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each component.

    Of rows that repeat both the id and the text of the document that stays, any one stays.
    """
    found = materialize(group(docs, id_col, text_col, words, bits, seed).select("doc_id", "key", "stays"), "decided")
    left = without(docs, found.filter(~F.col("stays")), text_key(text_col), id_col)
    if found.filter("stays").groupBy("doc_id", "key").count().filter("count > 1").isEmpty():
        return left
    key = F.struct(F.col(f"`{id_col}`"), text_key(text_col))
    return one_of_each(left, key, text_of(text_col))
