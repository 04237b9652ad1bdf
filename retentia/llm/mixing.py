"""Mixing sources to target weights by pivotal dependent rounding.

The size of a document is its number of words, and a source's target its share of a multiple
of all words by weight, at most ``limit`` times its own words; what is above that is shared anew
by weight until no source is above. A document is then due target / source size copies. The
whole copies are certain; the rest is a probability, rounded to 0 or 1 so that the words of a
source stay what they are: of two documents one gives words to the other until one of them is
integral, in the direction that a random number says and with odds that keep every probability.

Documents of a source are dealt to lots by a hash. A lot is read as a sorted stream in which
an open document meets the next one whose size has as many bits, so that a lot leaves one open
for each power of two at most; those of neighbouring lots meet in the next round, up to one lot
per source. Its few open documents are settled from the largest down: drawn where the smaller
ones can make up for either outcome, else whichever ends nearer to the target. Long documents
come first, and what their words are off the target is shared out over the probabilities of
the shorter ones before these are rounded, so a source misses its target by part of a short
document. No task holds a lot in memory, and a source with a third of all rows is spread like
any other. Random numbers are hashes of id, size and source: reruns agree.

Rows that agree in id, size and source are counted first and share one row until the end: the
whole part of what they are due together is certain, one is rounded. Null texts and texts without
words have size 0 and are taken with 0 words; a null source is a source of its own, the last one.
Null ids are allowed. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import text_of
from retentia.operators.ordered import row_positions
from retentia.sources.tables import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of all sources that a lot holds on average, and lots that meet in a round (as bits).
LOT = 512
STEP = 5
#: Documents are rounded in turns, those above so many times their source's mean size first.
TURNS = (2.0, 0.25, 0.0)


def _key(source: str) -> Column:
    """A source as a text that is never null; the null source comes after all others."""
    text = F.col(f"`{source}`").cast("string")
    return F.when(text.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), text))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """(``key``, ``source_size``, ``mean_size``, ``target``) of every source of ``sizes`` (``key``, ``size``, ``copies``), written.

    A job per round in which a source reaches its limit; the sources themselves stay in Spark.
    """
    words = F.sum(F.col("size") * F.col("copies")).cast("bigint")
    sources = sizes.groupBy("key").agg(words.alias("source_size"), (words / F.sum("copies")).alias("mean_size"))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = row_positions(sources, ["key"], "place")
    ranked = materialize(ranked.withColumn("weight", F.get(weight, (F.col("place") % len(weights)).cast("int"))), "sources")
    most = F.col("source_size") * limit
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        # Sources whose weight asks for more than their limit at this level stay at it; the others share the rest.
        row = ranked.agg(
            F.count_if(F.col("weight") * level >= most).alias("full"),
            F.sum(F.when(F.col("weight") * level >= most, most)).alias("held"),
            F.sum(F.when(F.col("weight") * level < most, F.col("weight"))).alias("weights"),
        ).first()
        if row.full == full or not row.weights:
            break
        level, full = max(0.0, total - (row.held or 0.0)) / row.weights, row.full
    return ranked.select("key", "source_size", "mean_size", F.least(F.col("weight") * level, most).alias("target"))


_OPEN = "key string, rank bigint, doc_id bigint, size bigint, copies bigint, mass double, up boolean"


def _meet(first: tuple, second: tuple, chance: float) -> tuple[float, float]:
    """The masses of two open documents (size, mass) after one gave to the other until one is integral."""
    (size, own), (other, mass) = first, second
    room, space = size - own, other - mass
    rise, fall = min(room, mass), min(own, space)
    if chance * (rise + fall) < fall:
        return (size, mass - room) if room <= mass else (own + mass, 0)
    return (own - space, other) if space <= own else (0, own + mass)


def settled(open_docs: list[tuple]) -> list[bool]:
    """Which of the last open documents of a source, (size, mass, draw) by falling size, are taken."""
    left, rest, taken = sum(m for _, m, _ in open_docs), sum(n for n, _, _ in open_docs), []
    for size, mass, draw in open_docs:
        rest -= size
        if size <= left <= rest:
            up = draw * size < mass
        elif left <= rest:
            up = False
        else:
            up = abs(left - size) <= left - rest
        taken.append(up)
        left -= size if up else 0
    return taken


def _pivot(last: bool):
    """Rounds the open documents of each group (key, lot) of a sorted stream; in the ``last`` round all of them.

    ``mass`` is the words that a document may still get, between 0 and its size; it is null,
    and ``up`` says which, once the document is integral.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, {}, []

        def close():
            left = [held[bits] for bits in sorted(held, reverse=True)]
            if last:
                ups = settled([(row[3], mass, draw) for row, mass, draw in left])
                out.extend((*row, None, up) for (row, _, _), up in zip(left, ups, strict=True))
            else:
                out.extend((*row, mass, None) for row, mass, _ in left)
            held.clear()

        def flush():
            columns = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            names = ["key", "rank", "doc_id", "size", "copies", "mass", "up"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        names = ("key", "lot", "rank", "doc_id", "size", "copies", "mass", "chance", "draw")
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            for key, lot, rank, doc_id, size, copies, mass, chance, draw in zip(*columns, strict=True):
                if (key, lot) != group:
                    close()
                    group = (key, lot)
                row, bits = (key, rank, doc_id, size, copies), size.bit_length()
                pair = [(row, mass, draw)]
                if bits in held:
                    first, own, other = held.pop(bits)
                    own, mass = _meet((first[3], own), (size, mass), chance)
                    pair = [(first, own, other), (row, mass, draw)]
                for one in pair:
                    if 0 < one[1] < one[0][3]:
                        held[bits] = one
                    else:
                        out.append((*one[0], None, one[1] > 0))
            yield flush()
        close()
        yield flush()

    return run


def _chance(seed: int, salt: str) -> Column:
    """A number from 0 to 1 that a document always gets."""
    drawn = F.xxhash64(F.lit(seed), F.lit(salt), "key", "doc_id", "size")
    return F.shiftrightunsigned(drawn, 11) / F.lit(float(1 << 53))


def _rounded(due: DataFrame, seed: int) -> DataFrame:
    """Documents of ``due`` (key, doc_id, size, copies, mass) with ``up``: whether the open part is taken."""
    rank = F.xxhash64(F.lit(seed), F.lit("rank"), "key", "doc_id", "size")
    left = due.filter("mass > 0 AND mass < size").withColumn("rank", rank)
    bits = max(0, math.ceil(math.log2(max(1, left.count()) / LOT)))
    done = due.filter("mass <= 0 OR mass >= size").select("key", "doc_id", "size", "copies", (F.col("mass") > 0).alias("up"))
    rounds = -(-bits // STEP) + 1
    for turn in range(rounds):
        now = max(0, bits - STEP * turn)
        lot = F.shiftrightunsigned("rank", 64 - now) if now else F.lit(0).cast("bigint")
        dealt = (
            left.select("key", lot.alias("lot"), "rank", "doc_id", "size", "copies", "mass")
            .withColumns({"chance": _chance(seed, f"turn {turn}"), "draw": _chance(seed, "last")})
            .repartition("key", "lot")
            .sortWithinPartitions("key", "lot", "rank", "doc_id", "size")
        )
        met = materialize(dealt.mapInArrow(_pivot(turn == rounds - 1), _OPEN), "met")
        done = done.unionByName(met.filter("mass IS NULL").select("key", "doc_id", "size", "copies", "up"))
        left = met.filter("mass IS NOT NULL")
    return done


def _in_turns(due: DataFrame, seed: int) -> DataFrame:
    """``_rounded`` for one turn after the other, each making up for what the ones before are off."""
    done = None
    for turn in range(len(TURNS)):
        part = due.filter(F.col("turn") == turn).select("key", "doc_id", "size", "copies", "mass")
        if done is not None:
            is_open = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
            off = (
                due.filter(F.col("turn") < turn)
                .select("key", F.col("mass").alias("off"), F.lit(0).cast("bigint").alias("words"))
                .unionByName(done.filter("up").select("key", (-F.col("size")).cast("double").alias("off"), F.lit(0).cast("bigint").alias("words")))
                .unionByName(part.filter(is_open).select("key", F.lit(0.0).alias("off"), F.col("size").alias("words")))
            )
            off = materialize(off.groupBy("key").agg(F.try_divide(F.sum("off"), F.sum("words")).alias("shift")).filter("shift IS NOT NULL"), "off")
            moved = F.greatest(F.lit(0.0), F.least(F.col("mass") + F.col("shift") * F.col("size"), F.col("size").cast("double")))
            part = part.join(off, "key", "left").withColumn("mass", F.when(is_open & F.col("shift").isNotNull(), moved).otherwise(F.col("mass")))
        now = _rounded(part.select("key", "doc_id", "size", "copies", "mass"), seed + turn)
        done = now if done is None else done.unionByName(now)
    return done


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    limit: int = 2,
    seed: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, taken, copies.

    ``weights`` belong to the sources in code point order, repeating; ``share`` is the size of
    the mix as a part of all words, and ``limit`` the most copies of a document.
    """
    sized = docs.select(
        _key(source_col).alias("key"),
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint").alias("size"),
    )
    sized = materialize(sized.groupBy("key", "doc_id", "size").agg(F.count("*").alias("copies")), "sizes")
    aims = targets(sized, weights, share, limit)
    due = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(0.0)
    # What rows that agree are due beyond their whole copies: some of them one more, one of them perhaps.
    spare = F.col("copies") * (due - F.floor(due))
    turn = F.lit(len(TURNS) - 1)
    for n in range(len(TURNS) - 2, -1, -1):
        turn = F.when(F.col("size") > F.col("mean_size") * TURNS[n], n).otherwise(turn)
    odd = (F.col("size") * (spare - F.floor(spare))).alias("mass")
    open_part = sized.join(aims, "key").select("key", "doc_id", "size", "copies", odd, turn.alias("turn"))
    rows = _in_turns(materialize(open_part, "due"), seed).join(aims, "key")
    more = F.floor(spare) + F.col("up").cast("bigint")
    each = rows.withColumns({"whole": F.floor(due), "more": more}).withColumn("one", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    taken = F.col("whole") + (F.col("one") <= F.col("more")).cast("bigint")
    return each.select(
        "doc_id",
        "size",
        F.when(F.col("key") != "1", F.substring("key", 2, 2**31 - 1)).alias("source"),
        "source_size",
        "target",
        (taken * F.col("size")).alias("taken"),
        taken.alias("copies"),
    )
