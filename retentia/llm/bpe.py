"""Byte-level BPE encoding and decoding: speculate, verify, and merge only what fails.

Words are cut off by the vocabulary's pattern. For each new word a greedy longest match
proposes tokens. The proposal is the encoding exactly if every two neighbouring tokens are
compatible, that is if no merge across their border would have come first; the neighbours of
all words of a batch are tested together in numpy. Only words with a pair that fails, or with
a token that the merges do not build from its own bytes, are merged exactly.

Null texts are empty and give no tokens. The added tokens of the vocabulary are matched in
the text first, longest first, as the ``tokenizers`` library does by default. Decoding replaces
invalid UTF-8. An empty table gives an empty result; rows and other columns are left as they are.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import slices, text_of

#: Fixed value: the pattern that cuts a text into words before the merges of this kind of vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of text whose tokens one task remembers, and the longest piece that it remembers.
REMEMBERED, LONGEST = 150_000, 256
#: Bytes of a word up to which exact merging runs on many words at once.
SHORT = 48
#: A space that does not begin a word.
GAP = re.compile(r" (?:\s|\Z)")
#: The first character from which on the library's own character classes decide.
WIDE = "\u0250"
NEVER = np.int64(1) << 40


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """The vocabulary of a byte-level ``tokenizers`` file, read on the driver and sent to the tasks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
    letters = _byte_letters()
    raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {
        "ids": {raw[t]: i for t, i in model["vocab"].items()},
        "merges": [(raw[a], raw[b]) for a, b in merges],
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class Memory(dict):
    """Tokens by piece of text; a piece that is not there gets an empty list, which is filled later."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> list[int]:
        self.new.append(piece)
        out = self[piece] = []
        return out


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: dict):
        ids, merges = vocabulary["ids"], vocabulary["merges"]
        self.ids, self.added = ids, vocabulary["added"]
        size = max([*ids.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for b, i in ids.items():
            self.bytes[i] = b
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        self.numbers = [str(i) for i in range(size)]
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges)}
        codes = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.made = np.array([made for _, made in self.rank.values()], np.int64)
        self.of_byte = np.array([ids[bytes([i])] for i in range(256)], np.int64)
        # The parts that lie at a token's left and right end while it is built, and when each ends.
        left, right, built = [-1] * size, [-1] * size, [NEVER] * size
        for (a, b), (r, made) in self.rank.items():
            left[made], right[made], built[made] = a, b, r
        self.left, self.right, self.built = (np.array(x, np.int64) for x in (left, right, built))
        self._grow_trie()
        self.pattern = regex.compile(PATTERN)
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.cut = tokenizers.pre_tokenizers.Split(tokenizers.Regex(PATTERN), "isolated").pre_tokenize_str
        self.memory = Memory()
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        # Tokens that the merges do not build from their bytes: a proposal with one is never accepted.
        self.odd = np.zeros(size, bool)
        for b, i in ids.items():
            if len(b) > 1 and left[i] < 0:
                self.odd[i] = True
        whole = [(b, i) for b, i in ids.items() if len(b) > 1 and not self.odd[i]]
        split = np.array([[left[i], right[i]] for _, i in whole], np.int64)
        halves = self.before(split[:, 0], split[:, 1]) < np.array([built[i] for _, i in whole])
        for (b, i), suspect in zip(whole, halves.tolist(), strict=True):
            if suspect and self.merge(b) != [i]:
                self.odd[i] = True

    def _grow_trie(self) -> None:
        """The vocabulary as a trie in arrays: an edge is (node, byte), sorted; tokens by node."""
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[tuple[int, int]] = []
        for b in self.ids:
            for n in range(1, len(b) + 1):
                if b[:n] not in nodes:
                    nodes[b[:n]] = len(nodes)
                    edges.append((nodes[b[: n - 1]] << 8 | b[n - 1], nodes[b[:n]]))
        edges.sort()
        self.edges, self.ends = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.token = np.full(len(nodes), -1, np.int64)
        for b, i in self.ids.items():
            self.token[nodes[b]] = i

    def propose(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: tokens, and the word that each belongs to."""
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        stop = np.repeat(np.cumsum(sizes), sizes)
        found, length = np.empty(len(flat), np.int64), np.zeros(len(flat), np.int64)
        at, node, depth = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0
        while len(at):
            code = node << 8 | flat[at + depth]
            edge = np.minimum(np.searchsorted(self.edges, code), len(self.edges) - 1)
            on = self.edges[edge] == code
            at, node, depth = at[on], self.ends[edge[on]], depth + 1
            hit = self.token[node] >= 0
            found[at[hit]], length[at[hit]] = self.token[node[hit]], depth
            on = at + depth < stop[at]
            at, node = at[on], node[on]
        starts, steps = (np.cumsum(sizes) - sizes)[sizes > 0], []
        while len(starts):
            steps.append(starts)
            after = starts + length[starts]
            starts = after[after < stop[starts]]
        chosen = np.sort(np.concatenate(steps)) if steps else np.zeros(0, np.int64)
        return found[chosen], np.repeat(np.arange(len(raw)), sizes)[chosen]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NEVER)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the first merge across the border of tokens a and b that comes before either is whole."""
        first = np.full(len(a), NEVER)
        x, until_x, rows_x = a.copy(), np.full(len(a), NEVER), np.arange(len(a))
        while len(rows_x):
            y, until_y, rows = b[rows_x].copy(), np.full(len(rows_x), NEVER), np.arange(len(rows_x))
            while len(rows):
                r = self.rank_of(x[rows], y)
                # Of equal ranks the merge further left comes first: within a before the border, the border before b.
                real = (r < until_x[rows]) & (r <= until_y) & (r < NEVER)
                np.minimum.at(first, rows_x[rows[real]], r[real])
                until_y, y = self.built[y], self.left[y]
                more = y >= 0
                rows, y, until_y = rows[more], y[more], until_y[more]
            until_x, x = self.built[x], self.right[x]
            more = x >= 0
            rows_x, x, until_x = rows_x[more], x[more], until_x[more]
        return first

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals, with a heap over a linked list."""
        tok = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(tok)
        after, prior, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        heap = [(*found, i, tok[i], tok[i + 1]) for i in range(n - 1) if (found := self.rank.get((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or tok[i] != a or tok[j] != b:
                continue
            tok[i], alive[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                prior[after[j]] = i
            for p, q in ((prior[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (found := self.rank.get((tok[p], tok[q]))):
                    heapq.heappush(heap, (*found, p, tok[p], tok[q]))
        return [t for t, is_left in zip(tok, alive, strict=True) if is_left]

    def merge_all(self, raw: list[bytes]) -> list[list[int]]:
        """Exact merging of many short words at once: every round merges the first pair of lowest rank in each."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        wide = int(sizes.max()) + 1
        flat = np.frombuffer(b"".join(raw), np.uint8)
        tok = np.full((len(raw), wide), -1, np.int64)
        tok[np.arange(wide) < sizes[:, None]] = self.of_byte[flat]
        rank = np.full(tok.shape, NEVER)
        pair = np.arange(wide) < sizes[:, None] - 1
        rank[pair] = self.rank_of(tok[pair], np.roll(tok, -1, axis=1)[pair])
        out: list[list[int]] = [[]] * len(raw)
        rows, columns = np.arange(len(raw)), np.arange(wide)
        while len(rows):
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), at]
            if (done := low == NEVER).any():
                for i, ids in zip(rows[done].tolist(), tok[done].tolist(), strict=True):
                    out[i] = ids[: ids.index(-1)]
                rows, tok, rank, at, low = (x[~done] for x in (rows, tok, rank, at, low))
                if not len(rows):
                    break
            each = np.arange(len(rows))
            shift = np.minimum(columns + (columns > at[:, None]), wide - 1)
            tok, rank = np.take_along_axis(tok, shift, axis=1), np.take_along_axis(rank, shift, axis=1)
            tok[each, at] = self.made[low]
            rank[:, -1] = NEVER
            for side in (at - 1, at):
                ok = side >= 0
                a = tok[each[ok], side[ok]]
                b = tok[each[ok], side[ok] + 1]
                rank[each[ok], side[ok]] = np.where(b >= 0, self.rank_of(a, np.maximum(b, 0)), NEVER)
        return out

    def words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word: proposals where all neighbours agree, else exact merging."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat, owner = self.propose(raw)
        bounds = np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
        listed = flat.tolist()
        out = [listed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        wrong = owner[self.odd[flat]]
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        codes, back = np.unique(flat[pair] << 32 | flat[pair + 1], return_inverse=True)
        apart = self.before(codes >> 32, codes & 0xFFFFFFFF) == NEVER
        failing = np.union1d(wrong, owner[pair[~apart[back]]]).tolist()
        short = [i for i in failing if len(raw[i]) <= SHORT]
        if short:
            for i, ids in zip(short, self.merge_all([raw[i] for i in short]), strict=True):
                out[i] = ids
        for i in failing:
            if len(raw[i]) > SHORT:
                out[i] = self.merge(raw[i])
        return out

    def _cut(self, text: str) -> list[str]:
        """Words by the pattern; the library's own character classes decide beyond Latin letters."""
        if text.isascii() or max(text) < WIDE:
            return self.pattern.findall(text)
        return [w for w, _ in self.cut(text)] if text else []

    def _pieces(self, text: str) -> list[str]:
        """The text cut where every word ends: before each space that a visible character follows."""
        if "\0" in text or GAP.search(text):
            return self._cut(text)
        pieces = text.replace(" ", "\0 ").split("\0")
        return pieces if pieces[0] else pieces[1:]

    def _learn(self, pieces: list[str]) -> None:
        """Fills in the tokens of new pieces."""
        # Pieces that begin with a space are cut together: a word never crosses into the next of them.
        together = [p for p in pieces if p[:1] == " " and not GAP.match(p)]
        joined = "".join(together)
        if joined and max(joined) >= WIDE:
            together = [p for p in together if max(p) < WIDE]
            joined = "".join(together)
        words = self.pattern.findall(joined)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        stops = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, together), np.int64, len(together)))) + 1
        apart = set(pieces).difference(together)
        cut = {p: self._cut(p) for p in apart}
        new = set(words).union(*cut.values()).difference(self.known)
        if new:
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
            again = {w: self.older[w] for w in new if w in self.older}
            self.known.update(again)
            new = list(new.difference(again))
            if new:
                self.known.update(zip(new, self.words(new), strict=True))
        of = [self.known.get(w) or self.older[w] for w in words]
        start, memory = 0, self.memory
        for p, stop in zip(together, stops.tolist(), strict=True):
            fill = memory[p].extend
            for ids in of[start:stop]:
                fill(ids)
            start = stop
        for p, ws in cut.items():
            for w in ws:
                memory[p].extend(self.known.get(w) or self.older[w])
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.memory) > REMEMBERED:
            self.memory = Memory()
        of = self.memory.__getitem__
        found: list[list] = []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            found.append([[[self.added[p]]] if k % 2 else list(map(of, self._pieces(p))) for k, p in enumerate(parts)])
        new, self.memory.new = self.memory.new, []
        if new:
            self._learn(new)
        for p in new:
            if len(p) > LONGEST:
                del self.memory[p]
        flat = chain.from_iterable
        return [list(flat(flat(parts))) for parts in found]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _codec(vocabulary) -> Codec:
    """Made once per worker process: the value of a broadcast stays there between tasks."""
    held = vocabulary.value
    gc.disable()  # millions of small lists without cycles: the collector would walk them again and again
    if "codec" not in held:
        held["codec"] = Codec(held)
    return held["codec"]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in slices(batches, "text", 1 << 20):
            ids = codec.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: doc_id, text. Null ids give an empty text; unknown ids are an error."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            texts = [codec.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = tokens.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes what came out, and returns per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        number = codec.numbers.__getitem__
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for ids in codec.encode(batch.column("text").to_pylist()):
                listed = ",".join(map(number, ids)).encode()
                text = codec.decode(ids).encode("utf-8", "surrogatepass")
                out.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()))
            n, listed, text = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(listed), pa.array(text)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
