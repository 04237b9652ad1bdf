"""Secrets in texts: three patterns, and random strings found by token efficiency.

Ordinary words and names come out of a tokenizer as few long tokens, random strings as
many short ones. Every run of key characters with few characters per token is reported, fewer if it has
no digit, unless it is a known digest (hexadecimal of a usual digest length, base64 behind the digest's name), a UUID,
a ULID, a pod's name, a number, a date, a version, a path, an alphabet, or spelled with four letters. The patterns'
matches are always reported; of a run that overlaps them what is left is looked at. A run that is not random as a whole,
or that consists of readable words and numbers for the most part, is looked at again without the
readable words at its ends, then part by part between its separators.

Offsets are code points, the end is exclusive. Null texts are empty and have no spans. Repeated
rows each get their own result. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.bpe import PATTERN
from retentia.llm.common import slices, text_of

#: The patterns of the three kinds, and the least length of a match (of its last group, if any).
KINDS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, True),
    "access": (r"AKIA[A-Z0-9]+", 18, False),
    "hex": (r"[0-9a-f]+", 16, False),
}
#: A run of key characters that may be random, its least length, and the most characters per token, with and without digits.
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
LEAST, RATIO, PLAIN = 16, 2.0, 1.85
HEX = re.compile(r"[0-9a-fA-F]+")
PART = re.compile(r"[A-Za-z0-9]+")
#: A part that may be a word or a number.
READABLE = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+")
DIGESTS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")
KNOWN = re.compile(
    r"[0-9_+=/-]+"  # numbers, dates, rulers
    r"|(https?|ftp)?/?/[a-z0-9/_-]+"  # paths
    r"|0[0-3][0-9A-HJKMNP-TV-Z]{24}"  # ULIDs of the years 1970 to 2109
)
#: Names of pods: words, a hash and a suffix in letters that cannot spell.
POD = re.compile(
    r"(?<![A-Za-z0-9-])(?:[a-z]{1,20}[0-9]{0,3}-)+[bcdfghjklmnpqrstvwxz2456789]{8,10}-[bcdfghjklmnpqrstvwxz2456789]{5}(?![A-Za-z0-9-])"
)
#: Digests in base64 behind their names, as in subresource integrity.
NAMED_DIGEST = re.compile(
    r"(?<![A-Za-z0-9])(?:sha-?256[-_=/:]?[A-Za-z0-9+/_-]{43}=?|sha-?384[-_=/:]?[A-Za-z0-9+/_-]{64}"
    r"|sha-?512[-_=/:]?[A-Za-z0-9+/_-]{86}={0,2})(?![A-Za-z0-9+/])",
    re.IGNORECASE | re.ASCII,
)


def alphabet(run: str) -> bool:
    """Whether a run counts up, repeats, or is spelled with four letters."""
    codes = [ord(c) for c in run]
    steps = sum(-1 <= b - a <= 1 for a, b in pairwise(codes))
    return 2 * steps >= len(run) or len(set(run.lower())) <= 4


def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Scanner:
    """Finds the spans of one text."""

    def __init__(self, mergeable: dict[bytes, int], least: int = LEAST, ratio: float = RATIO, plain: float = PLAIN):
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=mergeable, special_tokens={})
        self.least, self.ratio, self.plain = least, ratio, min(plain, ratio)
        self.assign = re.compile(KINDS["assign"][0], re.ASCII | re.IGNORECASE)
        # With a least length in the pattern only whole runs can match, as runs end where the class ends.
        self.access = re.compile(r"AKIA[A-Z0-9]{%d,}" % (KINDS["access"][1] - 4))
        self.hex = re.compile(r"[0-9a-f]{%d,}" % KINDS["hex"][1])
        self.run = re.compile(RUN % least)
        self.hint = re.compile(r"[:=]")

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """(start, order of the kind, end) of the patterns' matches."""
        out = []
        if self.hint.search(text):
            out += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= KINDS["assign"][1]]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(out)

    def dense(self, run: str, ratio: float) -> bool:
        return len(run) <= ratio * len(self.encoding.encode_ordinary(run))

    def key(self, run: str) -> bool:
        """Whether a run is long and random as a whole."""
        if len(run) < self.least or KNOWN.fullmatch(run) or alphabet(run):
            return False
        parts = PART.findall(run)
        # Part numbers, names and paths: words and numbers shorter than a key hold half of the run or more.
        if 2 * sum(len(p) for p in parts if len(p) < self.least and READABLE.fullmatch(p)) >= sum(map(len, parts)):
            return False
        if re.search(r"[0-9]", run):
            return self.dense(run, self.ratio)
        # Spelled-out letters (a-b-c) are no key.
        return any(2 * len(p) >= self.least for p in parts) and self.dense(run, self.plain)

    def keys(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """The random strings in a run: all of it, or without the readable parts at its ends, or single parts."""
        if b - a < self.least:
            return []
        if self.key(text[a:b]):
            return [(a, b)]
        parts = [m.span() for m in PART.finditer(text, a, b)]
        whole = [self.key(text[x:y]) for x, y in parts]
        odd = [k for k, (x, y) in enumerate(parts) if whole[k] or not (READABLE.fullmatch(text, x, y) or not self.dense(text[x:y], self.ratio))]
        if odd and (inner := (parts[odd[0]][0], parts[odd[-1]][1])) != (a, b) and self.key(text[slice(*inner)]):
            return [inner]
        return [span for span, is_key in zip(parts, whole, strict=True) if is_key]

    def random(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Runs with few characters per token outside the matches of the patterns."""
        out = []
        # The farthest end of the matches up to each one, so that overlaps are found by bisection.
        starts = [s for s, _, _ in base]
        reach = list(accumulate((e for _, _, e in base), max))
        for m in self.run.finditer(text):
            a, b = m.span()
            taken = [u.span() for known in (UUID, POD) for u in known.finditer(text, a, b)]
            # The name of a digest may stand before the run, behind a colon.
            taken += [d.span() for d in NAMED_DIGEST.finditer(text, max(0, a - 8), b)]
            taken += [d.span() for d in PART.finditer(text, a, b) if len(d[0]) in DIGESTS and HEX.fullmatch(d[0])]
            # Matches that reach into the run: from the first whose reach passes its start.
            taken += [(s, e) for s, _, e in base[bisect_right(reach, a) : bisect_left(starts, b)]]
            for s, e in sorted(taken):
                if s > a:
                    out += [(x, 3, y) for x, y in self.keys(text, a, s)]
                a = max(a, e)
            out += [(x, 3, y) for x, y in self.keys(text, a, b)]
        return out


NAMES = [*KINDS, "random"]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


def scan(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, ratio: float = RATIO
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, secrets.

    ``path`` names a tiktoken vocabulary. ``secrets`` holds kind, start, end and text of each span.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, least, ratio)
        for batch in slices(batches, "text", 1 << 22):
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                base = scanner.base(text)
                every = sorted(chain(base, scanner.random(text, base)))
                kinds = [k for _, k, _ in every]
                found = [{"kind": NAMES[k], "start": a, "end": b, "text": text[a:b]} for a, k, b in every]
                row = (
                    *map(kinds.count, range(3)),
                    hashlib.sha256(_listed(base).encode()).hexdigest(),
                    _listed(every),
                    kinds.count(3),
                    found,
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            kinds.append(pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])))
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "secrets"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
        "n_random bigint, secrets array<struct<kind:string,start:bigint,end:bigint,text:string>>",
    )
