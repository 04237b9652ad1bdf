"""Benchmark items that occur in documents, also reworded, by latent semantic retrieval.

Passages are windows of 32 and 64 words that move by 16 words over the whole text. Words are hashed into
``BUCKETS`` and weighted by how few passages of the whole corpus hold them. A randomised SVD of
the TF-IDF matrix of all passages of all documents gives a latent space, whitened so that
common directions do not make everything alike; its products run on the executors, over the passages' buckets
that are written once, and only matrices of a fixed size reach the driver. Every passage of every document is then projected (the
projection is a sum over its words, each counted once, so that repeats cannot outweigh the others) and compared with the items by cosine; items
longer than ``PIECE`` words are searched in pieces. What is similar is checked on the words themselves: the passage must
hold, with its surroundings, ``LOOSE`` of the words of the item, in any order, as every match does, and then the longest common subsequence of item and surroundings must cover ``COVER`` of the item, or ``LOOSE`` of it
if it also covers ``COVER`` of the item's answer, its last sentence.

Words are runs of letters and digits in lower case; in scripts without spaces between words every character is one.
Items below ``LEAST`` words, of such characters twice as many, match only as a whole: all their words in a row. A
single word so matches wherever it stands. Null texts are empty; texts and items without
words match nothing. Items are
compared in blocks of ``BLOCK``. Rows that repeat get the same result each. An empty table gives an empty result; without
items nothing is contaminated. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import fresh, slices, text_of
from retentia.sources.tables import materialize

BUCKETS, RANK, OVER, ROUNDS = 1 << 14, 128, 8, 2
STEP, WIDTHS, PIECE = 16, (2, 4), 48
#: Items per block; words of the shortest item that may be reworded.
BLOCK, LEAST = 1_000, 8
#: Passages that a task multiplies at a time; a bucket that more than one in ``HEAD`` of them holds is common.
CHUNK, HEAD = 8192, 32
#: Rows of a matrix that are added at a time.
ROWS = 256
#: The least cosine, and the shares of an item's words.
COSINE, COVER, LOOSE = 0.25, 0.8, 0.6
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Thai to Myanmar, Khmer, Tai and Lao scripts, kana, ideographs.
UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x1AB0), (0x3005, 0x3008), (0x3040, 0x3130), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xA9E0, 0xAA00), (0xAA60, 0xAAE0), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x40000))


#: A factor for each place in a word.
FACTORS = np.random.default_rng(5).integers(0, 1 << 64, 1 << 12, np.uint64) | np.uint64(1)


def folding() -> np.ndarray:
    """For every character its lower case, or 0 if it is no letter or digit."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def unspaced(code: np.ndarray) -> np.ndarray:
    """Which characters belong to a script without spaces between words."""
    out = np.zeros(len(code), bool)
    high = np.flatnonzero(code >= UNSPACED[0][0])
    for a, b in UNSPACED if len(high) else ():
        out[high] |= (code[high] >= a) & (code[high] < b)
    return out


def hashes(texts: list[str], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and where each text's words begin (one more at the end)."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = fold.take(code.astype(np.int64), mode="clip")
    inside = low > 0
    begins = np.r_[True, ~inside[:-1]]
    if (alone := unspaced(code)).any():
        begins |= alone | np.r_[False, alone[:-1]]
    start = np.flatnonzero(inside & begins)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    bounds = np.r_[0, np.searchsorted(start, ends)]
    if not len(start):
        return np.zeros(0, np.uint64), bounds
    place = np.arange(len(low))
    place[start[0] :] -= np.repeat(start, np.diff(np.r_[start, len(low)]))
    place &= len(FACTORS) - 1
    # Factors of one progression would give words of equal weighted sums the same hash.
    mixed = FACTORS.take(place, mode="clip")
    mixed *= low
    # Separators are zero, so a word's sum may run on to the next word.
    word = np.add.reduceat(mixed, start)
    return word ^ (word >> np.uint64(29)), bounds


def buckets(words: np.ndarray) -> np.ndarray:
    return ((words * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all blocks of ``STEP`` words, and the text of each."""
    size = np.diff(bounds)
    count = -(-size // STEP)
    text = np.repeat(np.arange(len(size)), count)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return bounds[:-1][text] + number * STEP, text


def repeats(b: np.ndarray, start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its block, where the same bucket came last in its text (-1 if never), and how many blocks before (many if never)."""
    block = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(b)]))
    bits = max(1, int(len(b)).bit_length())
    packed = np.sort((text[block] * BUCKETS + b) << bits | np.arange(len(b)))
    at, key = packed & ((1 << bits) - 1), packed >> bits
    again = np.flatnonzero(key[1:] == key[:-1])
    before = np.full(len(b), -1)
    before[at[again + 1]] = at[again]
    return block, before, np.where(before < 0, len(start) + max(WIDTHS), block - block[before])


def layers(b: np.ndarray, block: np.ndarray, gap: np.ndarray, start: np.ndarray, ends: np.ndarray, projection: np.ndarray) -> list[np.ndarray]:
    """For each k below the widest window the sums over each block's buckets that the k blocks before do not hold."""
    # The row behind the last bucket is zero.
    out = [projected(np.where(gap > 0, b, BUCKETS), start, ends, projection)]
    for k in range(1, max(WIDTHS)):
        again = np.flatnonzero(gap == k)
        less, at, word = out[-1].copy(), block[again], b[again]
        # The first such word of each block, then the second, and so on, so that no block comes twice at once.
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        for r in range(int(rank.max(initial=-1)) + 1):
            i = np.flatnonzero(rank == r)
            for lo in range(0, len(i), 2048):
                j = i[lo : lo + 2048]
                less[at[j]] -= projection[word[j]]
        out.append(less)
    return out


def windows(values: list[np.ndarray], text: np.ndarray, width: int) -> np.ndarray:
    """Sums over ``width`` blocks from each block on, within its text; every bucket of a window counts once."""
    out = values[0].copy()
    for k in range(1, width):
        other = np.flatnonzero(text[k:] != text[:-k])
        kept = out[other]
        out[:-k] += values[k][k:]
        out[other] = kept
    return out


def projected(b: np.ndarray, start: np.ndarray, ends: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The sum over each block's words of their rows; one word of ``ROWS`` blocks at a time, which stay in the processor's cache."""
    out = np.empty((len(start), projection.shape[1]), np.float32)
    one = np.empty((ROWS, projection.shape[1]), np.float32)
    for lo in range(0, len(start), ROWS):
        part = out[lo : lo + ROWS]
        place = start[lo : lo + ROWS] + np.arange(STEP)[:, None]
        # Behind a block's last word comes the row of zeros.
        word = np.where(place < ends[lo : lo + ROWS], b.take(place, mode="clip"), BUCKETS)
        projection.take(word[0], axis=0, out=part, mode="clip")
        for k in range(1, STEP):
            part += projection.take(word[k], axis=0, out=one[: len(part)], mode="clip")
    return out


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(text_of(text_col).alias("text"))


def _distinct(number: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a number (ascending) and a bucket, in order and each once."""
    kind = np.uint32 if number[-1] < (1 << 32) // BUCKETS else np.uint64
    key = np.sort(number.astype(kind) * kind(BUCKETS) + b.astype(kind))
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key // kind(BUCKETS)).astype(np.int64), (key % kind(BUCKETS)).astype(np.uint16)


_PASSAGES = "bucket bigint, n bigint, size binary, words binary"


def passages(docs: DataFrame, text_col: str = "text", used: Column | None = None) -> DataFrame:
    """Written once, from one pass over the texts: per task and ``bucket`` the ``n`` blocks that hold it (their number under -1),
    and per text the distinct buckets of its passages, as ``size`` of each and all their ``words``; these of ``used`` texts only."""
    fold, wide = folding(), STEP * WIDTHS[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(BUCKETS, np.int64), 0

        def rows(bucket, n, size, words) -> pa.RecordBatch:
            columns = [pa.array(x, k) for x, k in ((bucket, pa.int64()), (n, pa.int64()), (size, pa.binary()), (words, pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "n", "size", "words"])

        for batch in slices(batches, "text", 1 << 17):
            words, bounds = hashes(batch.column("text").to_pylist(), fold)
            start, _ = blocks(bounds)
            if not len(start):
                continue
            b = buckets(words)
            _, bucket = _distinct(np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(b)])), b)
            held += np.bincount(bucket, minlength=BUCKETS)
            total += len(start)
            count = np.diff(bounds)
            ends = np.cumsum(-(-count // wide))
            first = np.r_[0, ends[:-1]]
            row, bucket = _distinct(np.repeat(first, count) + (np.arange(len(b)) - np.repeat(bounds[:-1], count)) // wide, b)
            size = np.bincount(row, minlength=ends[-1]).astype(np.uint8)
            upto = np.r_[0, np.cumsum(size, dtype=np.int64)]
            on = np.flatnonzero((count > 0) & batch.column("used").to_numpy(zero_copy_only=False).astype(bool))
            x, y = first[on], ends[on]
            packed = [size[i:j].tobytes() for i, j in zip(x, y, strict=True)], [bucket[i:j].tobytes() for i, j in zip(upto[x], upto[y], strict=True)]
            yield rows([None] * len(on), [None] * len(on), *packed)
        seen = np.flatnonzero(held)
        none = [None] * (len(seen) + 1)
        yield rows(np.r_[-1, seen], np.r_[total, held[seen]], none, none)

    marked = _texts(docs, text_col).withColumn("used", F.lit(True) if used is None else used)
    return materialize(marked.mapInArrow(run, _PASSAGES), "passages")


def passage_counts(written: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket, the blocks of all documents that hold it; and their number."""
    sums = written.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("n").alias("n"))
    got = {r["bucket"]: r["n"] for r in sums.collect()}  # one row per bucket
    out = np.zeros(BUCKETS)
    for k, n in got.items():
        if k >= 0:
            out[k] = n
    return out, int(got.get(-1, 0))


def _back(batch: pa.RecordBatch, basis: np.ndarray, square: np.ndarray) -> np.ndarray:
    """The transpose times the matrix times the basis, for a batch of passages whose TF-IDF rows have length one.

    ``basis`` comes with the words' weights in it, whose squares are ``square``; the result lacks the transpose's weights.
    """
    out = np.zeros(basis.shape, np.float32)
    size = np.frombuffer(b"".join(batch.column("size").to_pylist()), np.uint8)
    # A word that a passage repeats counts once, as in the search.
    words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint16)
    ends = np.cumsum(size, dtype=np.int64)
    for lo in range(0, len(size), CHUNK):
        count = size[lo : lo + CHUNK].astype(np.int64)
        column = words[ends[lo] - count[0] : ends[lo + len(count) - 1]]
        row = np.repeat(np.arange(len(count)), count)
        squared = np.add.reduceat(square[column], np.cumsum(count) - count)[:, None]
        # Common buckets go by a dense product, the others word by word.
        head = np.flatnonzero(np.bincount(column, minlength=BUCKETS) * HEAD > len(count))
        place = np.full(BUCKETS, -1)
        place[head] = np.arange(len(head))
        at = place[column]
        dense = np.zeros((len(count), len(head)), np.float32)
        dense[row[at >= 0], at[at >= 0]] = 1
        row, column = row[at < 0], column[at < 0]
        y = dense @ basis[head]
        _add_rows(y, row, basis, column)
        y /= squared
        out[head] += dense.T @ y
        order = np.argsort(column, kind="stable")
        rare, group = np.unique(column[order], return_inverse=True)
        part = np.zeros((len(rare), basis.shape[1]), np.float32)
        _add_rows(part, group, y, row[order])
        out[rare] += part
    return out


def _add_rows(out: np.ndarray, group: np.ndarray, source: np.ndarray, at: np.ndarray) -> None:
    """Adds to the rows of ``out`` those of ``source`` that belong to them (``group`` ascends), one for ``ROWS`` rows at a time."""
    count = np.bincount(group, minlength=len(out))
    by = np.argsort(-count, kind="stable")
    first, falling = (np.cumsum(count) - count)[by], -count[by]
    total = np.zeros(out.shape, np.float32)
    one = np.empty((ROWS, out.shape[1]), np.float32)
    for lo in range(0, int(np.searchsorted(falling, 0)), ROWS):
        place, part, left = first[lo : lo + ROWS], total[lo : lo + ROWS], falling[lo : lo + ROWS]
        for k in range(-int(left[0])):
            m = int(np.searchsorted(left, -k))
            part[:m] += source.take(at[place[:m] + k], axis=0, out=one[:m], mode="clip")
    out[by] += total


def _summed(rows: DataFrame, function, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all batches of a matrix of fixed shape, added up on the executors in strips."""
    strips = 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = function(batch)
                total = part if total is None else total + part
        if total is not None:
            rows = [s.astype(np.float32).tobytes() for s in np.array_split(total, strips)]
            yield pa.RecordBatch.from_arrays([pa.array(range(strips), pa.int32()), pa.array(rows, pa.binary())], ["strip", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("strip").to_pylist(), batch.column("x").to_pylist(), strict=True):
                x = np.frombuffer(x, np.float32)
                held[k] = held[k] + x if k in held else x
        rows = [x.tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(rows, pa.binary())], ["strip", "x"])

    kind = "strip int, x binary"
    parts = rows.mapInArrow(run, kind).repartition("strip").mapInArrow(add, kind).collect()
    if not parts:
        return np.zeros(shape)
    return np.concatenate([np.frombuffer(r["x"], np.float32) for r in sorted(parts, key=lambda r: r["strip"])]).reshape(shape).astype(float)


def fit(docs: DataFrame, text_col: str = "text", size: int | None = None) -> np.ndarray:
    """The projection of word buckets to the latent space (``BUCKETS`` x ``RANK`` and a row of zeros), weights included.

    The space is that of all passages; with ``size``, of those of about so many distinct texts. After ``ROUNDS`` products of
    the matrix's transpose and the matrix with a basis, the last gives its leading directions (Nystrom's approximation).
    """
    spark, used = docs.sparkSession, None
    if size is not None:
        distinct = _texts(docs, text_col).filter(F.col("text").rlike(r"[\p{L}\p{N}]")).agg(F.approx_count_distinct(F.xxhash64("text"), 0.02))
        share = min(1.0, size / max(1, distinct.first()[0]))
        used = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)
    written = passages(docs, text_col, used)
    held, total = passage_counts(written)
    weight = np.log((total + 1) / (held + 1)) + 0.1
    # Every task hands on a matrix, so their number does not grow with the table.
    rows = written.filter(F.col("words").isNotNull()).select("size", "words").coalesce(max(8, spark.sparkContext.defaultParallelism))
    image = np.random.default_rng(11).standard_normal((BUCKETS, RANK + OVER))
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(image)
        shared = spark.sparkContext.broadcast(((weight[:, None] * basis).astype(np.float32), weight.astype(np.float32) ** 2))
        image = weight[:, None] * _summed(rows, lambda batch, shared=shared: _back(batch, *shared.value), basis.shape)
        shared.unpersist()
    core = basis.T @ image
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    # Directions in which there is nothing but rounding are left out.
    sure = values > max(values.max(), 1e-9) * 1e-6
    directions, length, _ = np.linalg.svd(image @ (vectors[:, sure] / np.sqrt(values[sure])), full_matrices=False)
    directions, length = directions[:, :RANK], length[:RANK]
    projection = np.zeros((BUCKETS + 1, RANK), np.float32)
    projection[:-1, : len(length)] = weight[:, None] * directions / np.maximum(length, length.max(initial=1e-9) * 1e-3)
    return projection


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words in a row from each word on."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return out


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str]], projection: np.ndarray, fold: np.ndarray):
        self.ids, self.masks, self.sizes, self.answers = [], [], [], []
        queries: dict[int, list] = {w: [] for w in WIDTHS}
        owners: dict[int, list[int]] = {w: [] for w in WIDTHS}
        self.words: list[np.ndarray] = []
        #: Short items by their number of words and the hash of all of them.
        self.short: dict[int, dict[int, list[int]]] = {}
        self.counts: np.ndarray | None = None
        for item, text in rows:
            words, _ = hashes([text], fold)
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            alone = np.count_nonzero(unspaced(code) & (fold[code] > 0))
            if len(words) - alone / 2 < LEAST:
                if len(words):
                    self.short.setdefault(len(words), {}).setdefault(int(runs(words, len(words))[0]), []).append(item)
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.sizes.append(len(words))
            self.words.append(buckets(words))
            self.masks.append(self._mask(words))
            last = [s for s in SENTENCE.split(text.strip()) if s][-1]
            answer, _ = hashes([last], fold)
            self.answers.append((self._mask(answer), len(answer)))
            pieces = -(-len(words) // PIECE)
            for piece in np.array_split(words, pieces):
                width = next((w for w in WIDTHS if len(piece) <= 0.75 * w * STEP), WIDTHS[-1])
                queries[width].append(projection[np.unique(buckets(piece))].sum(axis=0))
                owners[width].append(k)
        self.queries = {w: _unit(np.array(q, np.float32)) for w, q in queries.items() if q}
        self.owners = {w: np.array(o) for w, o in owners.items()}

    @staticmethod
    def _mask(words: np.ndarray) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            out[w] = out.get(w, 0) | 1 << i
        return out

    @staticmethod
    def _common(mask: dict[int, int], n: int, words: list[int]) -> int:
        """The length of the longest common subsequence, one word of the text at a time on bit vectors."""
        full = row = (1 << n) - 1
        for w in words:
            if m := mask.get(w):
                u = row & m
                row = ((row + u) | (row - u)) & full
        return n - row.bit_count()

    def cover(self, k: int, words: list[int]) -> float:
        """The share of item ``k`` that ``words`` cover, 0 if it does not count as a match."""
        share = self._common(self.masks[k], self.sizes[k], words) / self.sizes[k]
        if share >= COVER:
            return share
        mask, n = self.answers[k]
        return share if share >= LOOSE and n and self._common(mask, n, words) >= COVER * n else 0.0

    def find(self, texts: list[str], projection: np.ndarray, fold: np.ndarray, cosine: float) -> list[dict[int, float]]:
        """For each text the items that it contains and how much of them."""
        out: list[dict[int, float]] = [{} for _ in texts]
        words, bounds = hashes(texts, fold)
        start, text = blocks(bounds)
        if not len(start):
            return out
        whole = self._whole(words, bounds)
        if not self.ids:
            return whole
        b = buckets(words)
        ends = bounds[1:][text]
        block, before, gap = repeats(b, start, text)
        values = layers(b, block, gap, start, ends, projection)
        part, near = self._near(b, bounds)
        listed: list[int] | None = None
        for width, queries in self.queries.items():
            latent = _unit(windows(values, text, width))
            for lo in range(0, len(latent), 2048):
                at, q = np.divmod(np.flatnonzero(latent[lo : lo + 2048] @ queries.T >= cosine), len(queries))
                at += lo
                owner = self.owners[width][q]
                size = np.array(self.sizes)[owner]
                first = np.maximum(bounds[text[at]], start[at] - size)
                last = np.minimum(ends[at], start[at] + width * STEP + size)
                able = near[part[first], owner]
                able[able] = self._able(owner[able], first[able], last[able], b, before)
                for i, k, first, last in zip(*(x[able].tolist() for x in (at, owner, first, last)), strict=True):
                    doc = int(text[i])
                    if out[doc].get(k, 0) >= COVER:
                        continue
                    listed = words.tolist() if listed is None else listed
                    if (share := self.cover(k, listed[first:last])) > out[doc].get(k, 0):
                        out[doc][k] = share
        return [{self.ids[k]: v for k, v in found.items()} | more for found, more in zip(out, whole, strict=True)]

    def _whole(self, words: np.ndarray, bounds: np.ndarray) -> list[dict[int, float]]:
        """For each text the short items whose words it holds in a row."""
        out: list[dict[int, float]] = [{} for _ in bounds[1:]]
        for n, known in self.short.items():
            hashed = runs(words, n)
            at = np.flatnonzero(np.isin(hashed, np.array(list(known), np.uint64)))
            text = np.searchsorted(bounds, at, side="right") - 1
            same = at + n <= bounds[text + 1]
            for i, doc in zip(hashed[at[same]].tolist(), text[same].tolist(), strict=True):
                out[doc].update(dict.fromkeys(known[i], 1.0))
        return out

    def _count(self) -> None:
        """Counts each item's buckets, once; only buckets of items have a place, all others share the last one."""
        if self.counts is None:
            known = np.unique(np.concatenate(self.words))
            self.place = np.full(BUCKETS, len(known), np.int32)
            self.place[known] = np.arange(len(known))
            self.counts = np.array([np.bincount(self.place[w], minlength=len(known) + 1) for w in self.words])
            # The fewest words of each item that are a share of ``LOOSE``.
            self.least = np.array([next(c for c in range(n + 1) if c / n >= LOOSE) for n in self.sizes], np.float32)
            self.weights = self.counts[:, :-1].T.astype(np.float32)
            self.counts = self.counts.astype(np.uint8 if self.counts.max() < 256 else np.uint32)

    def _near(self, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of its text that each word belongs to, and whether a part and the next hold so many words of an item that it may match there.

        No surroundings of an item are longer than a part, so that those that begin in it end in the next at the latest.
        """
        self._count()
        # Twice the widest surroundings: fewer parts cost less than they let through.
        length = 2 * (WIDTHS[-1] * STEP + 2 * max(self.sizes))
        count = np.diff(bounds)
        parts = -(-count // length)
        upto = np.cumsum(parts)
        part = np.repeat(upto - parts, count) + (np.arange(len(b)) - np.repeat(bounds[:-1], count)) // length
        text = np.repeat(np.arange(len(count)), parts)
        # Where each part's words begin; a text's last part ends where the text does.
        begins = np.r_[np.searchsorted(part, np.arange(len(text))), len(b)]
        out = np.zeros((len(text), len(self.sizes)), bool)
        for lo in range(0, len(text), ROWS):
            hi = min(lo + ROWS, len(text))
            more = min(hi + 1, len(text))
            x, y = begins[lo], begins[more]
            held = np.zeros((more - lo, len(self.weights) + 1), np.float32)
            held[part[x:y] - lo, self.place[b[x:y]]] = 1
            both = held[: hi - lo].copy()
            last = more - lo - 1
            on = np.flatnonzero(text[lo + 1 : more] == text[lo : lo + last])
            both[on] = np.maximum(both[on], held[on + 1])
            out[lo:hi] = both[:, :-1] @ self.weights >= self.least
        return part, out

    def _able(self, owner, first, last, b, before) -> np.ndarray:
        """Whether the words from ``first`` to ``last`` hold so many words of the item ``owner``, in any order, that it may match."""
        size = np.array(self.sizes)
        b, before = self.place[b], before.astype(np.int32 if len(before) < 1 << 31 else np.int64)
        flat, out = self.counts.ravel(), np.zeros(len(owner), bool)
        reach = last - first
        # Those of like reach together, as a block is as wide as its widest.
        order = np.argsort(reach, kind="stable")
        for lo in range(0, len(owner), 1024):
            at = order[lo : lo + 1024]
            k, x, width = owner[at], first[at].astype(before.dtype), reach[at]
            step = np.arange(width[-1], dtype=before.dtype)
            place = x[:, None] + step
            got = flat.take(b.take(place, mode="clip") + (k * self.counts.shape[1]).astype(np.int32 if len(flat) < 1 << 31 else np.int64)[:, None])
            got *= before.take(place, mode="clip") < x[:, None]
            if width[0] < width[-1]:
                got *= step < width[:, None]
            out[at] = got.sum(axis=1, dtype=np.int32) / size[k] >= LOOSE
        return out


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block``, one block on the driver at a time."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), text_of(text_col).alias("text"))
    n = -(-items.count() // block)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def match(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    cosine: float = COSINE,
    sample: int | None = None,
    block: int = BLOCK,
) -> tuple[DataFrame, str]:
    """``docs`` with a column that maps the items found to the share covered; and that column's name."""
    spark, name = docs.sparkSession, fresh(docs, "leaks")
    fold, projection = folding(), fit(docs, text_col, sample)
    shared = spark.sparkContext.broadcast((projection, fold))
    out = docs.withColumn(name, F.create_map().cast("map<bigint,double>"))
    for rows in _blocks_of(benchmark, item_col, item_text_col, block):
        items = Items(rows, projection, fold)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            projection, fold = shared.value
            # Slices so small that their sums stay in the processor's cache.
            for batch in slices(batches, text_col, 1 << 17):
                found = items.find([t or "" for t in batch.column(text_col).to_pylist()], projection, fold, cosine)
                at = batch.schema.get_field_index(name)
                before = batch.column(at).to_pylist()
                both = [sorted({**dict(a or ()), **b}.items(), key=lambda x: (x[0] is None, x[0] or 0)) for a, b in zip(before, found, strict=True)]
                # An item without id counts under -1, as a map takes no null key.
                column = pa.array([[(-1 if k is None else k, v) for k, v in x] for x in both], pa.map_(pa.int64(), pa.float64()))
                columns = [column if i == at else batch.column(i) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out, name


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, item_ids (sorted), cover (the largest share, 0 if none)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    found, name = match(rows, benchmark, "text", **options)
    keys = F.map_keys(name)
    return found.select(
        "doc_id",
        (F.size(keys) > 0).alias("contaminated"),
        F.array_sort(keys).alias("item_ids"),
        F.coalesce(F.array_max(F.map_values(name)), F.lit(0.0)).alias("cover"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns and without a shuffle."""
    found, name = match(docs, benchmark, text_col, **options)
    return found.filter(F.size(F.map_keys(name)) == 0).drop(name)
