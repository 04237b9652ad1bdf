"""WARC archives of pages, and one globally ordered index of their captures.

Writing: records with equal payloads are found by SHA-1, a second hash and size; the one of the smallest id is a
response, the others are revisits that refer to it. Pages are dealt to archives at random by
id and sorted by URL key, time and id within each, so every archive is a sorted run. Each record is a gzip
member of its own, so that a reader can seek to an offset of the index and unpack that record alone. The text
writer commits them through Spark, so the archives can lie in any file system and survive lost executors; the
separator that it puts behind each row is the zero byte that a member ends with.

Reading: each archive is parsed record by record by its content lengths, payload digests are
checked, and the captures (with file, offset and length) form one sorted run per archive. Offset and length are
the record's member's, in an archive that is not packed the record's. Runs are
cut by key range and the pieces of a range are merged by a loser tree, which gives the capture history of every
URL in order, range after range.

A null page is an empty payload. A null id is written as an empty one and comes back null; it ranks after all ids, and
without any id all equal payloads are responses. Rows that repeat the smallest id of a payload are responses too. Null URLs
have an empty key. Captures without a time get ``EPOCH``. An empty table gives an empty
archive and an empty index; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import slices, text_of
from retentia.sources.tables import materialize, scratch_path

#: The time of captures that have none of their own.
EPOCH = "2024-01-01T00:00:00Z"
RECORD_ID = "urn:capture:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload bytes of one archive, and captures that one merging task holds, about.
ARCHIVE, RANGE = 128 << 20, 200_000
#: Bytes of records packed at once, and bytes of a member unpacked at once.
PACK, UNPACK = 1 << 22, 1 << 16
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 in base32: forty bits at a time, eight letters each."""
    digest = F.sha1(payload)
    out = []
    for k in range(4):
        bits = F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("bigint")
        out += [F.substring(F.lit(LETTERS), F.shiftright(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(7, -1, -1)]
    return F.concat(*out)


def url_key(url: str) -> Column:
    """The host's labels from the last to the first, then the path and query: neighbours are pages of one site."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(text, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    # Paths and queries tell letters of both cases apart.
    rest = F.regexp_replace(F.regexp_replace(text, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"(?s)#.*$", "")
    labels = F.reverse(F.split(F.regexp_replace(host, r"^www\.", ""), r"\."))
    return F.concat(F.array_join(labels, ","), F.lit(")"), rest)


def _header(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF))


def member(record: bytes) -> bytes:
    """The record as a gzip member that ends with a zero byte."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    # The last four bytes are the size, lowest byte first. From 16 MB on an empty member follows, whose size is zero.
    return out if out[-1] == 0 else out + member(b"")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The member of each record without its last byte, which the writer adds."""
    for batch in slices(batches, "value", PACK):
        members = [member(r)[:-1] for r in batch.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["value"])


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    time_col: str | None = None,
    least: int = 0,
    archive: int = ARCHIVE,
) -> str:
    """Writes the archives below ``path``, a gzip member per record. Payloads below ``least`` bytes are never revisits."""
    when = F.date_format(F.col(time_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_col else F.lit(None)
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"),
        url_key(url_col).alias("key"),
        F.coalesce(when, F.lit(EPOCH)).alias("time"),
        text_of(html_col).alias("html"),
    ).withColumns({"bytes": F.octet_length("html").cast("bigint"), "digest": base32_sha1(F.col("html")), "second": F.xxhash64("html")})
    # Digests and sizes are found once; only they are grouped and joined, never the pages.
    marks = materialize(rows.select("id", "bytes", "digest", "second"), "digests")
    several = (
        marks.filter(F.col("bytes") >= least)
        .groupBy("digest", "second", "bytes")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("d"), F.col("second").alias("s"), F.col("bytes").alias("b"), "first")
    )
    # Only digests that more than one page has: broadcast while Spark finds them small, else joined by a shuffle.
    several = materialize(several, "several")
    size = marks.agg(F.sum("bytes")).first()[0] or 0
    same = (F.col("digest") == F.col("d")) & (F.col("second") == F.col("s")) & (F.col("bytes") == F.col("b"))
    rows = rows.join(several, same, "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}"), _header("Content-Type", "text/html; charset=utf-8"),
        _header("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF),
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", name(F.col("id"))),
        _header("WARC-Date", F.col("time")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(_header("WARC-Profile", PROFILE), _header("WARC-Refers-To", name(F.col("first"))))).otherwise(""),
        _header("Content-Type", "application/http; msgtype=response"),
        _header("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
        F.col("block"),
        F.lit(CRLF * 2),
    ).cast("binary")
    dealt = rows.withColumn("block", block).select(
        "key", "time", "id", record.alias("value"), F.xxhash64("id", "digest", "url").alias("deal")
    )
    # Small inputs are written by all cores, in archives of 8 MB or more.
    files = max(-(-size // archive), min(pages.sparkSession.sparkContext.defaultParallelism, -(-size // (8 << 20))), 1)
    dealt = dealt.repartition(files, "deal").sortWithinPartitions("key", "time", "id")
    packed = dealt.select("value").mapInArrow(_packed, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    return path


HEAD = re.compile(rb"WARC/1\.\d\r\n((?:[^\r\n]+\r\n)*)\r\n")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of every record of unpacked bytes; raises on a broken one."""
    at = 0
    while at < len(data):
        m = HEAD.match(data, at)
        if not m:
            raise ValueError(f"no record at byte {at}")
        lines = m[1].decode("utf-8").split(CRLF)[:-1]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        end = m.end() + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end at byte {end}")
        yield headers, data[m.end() : end], at, end - at
        at = end + 4


def members(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(unpacked bytes, offset, length) of every gzip member; raises on one that is broken or cut off."""
    view, at = memoryview(data), 0
    while at < len(data):
        start, unpack, out = at, zlib.decompressobj(31), []
        while not unpack.eof:
            piece = view[at : at + UNPACK]
            if not len(piece):
                raise ValueError(f"the member at byte {start} is cut off")
            try:
                out.append(unpack.decompress(piece))
            except zlib.error as error:
                raise ValueError(f"no member at byte {start}") from error
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(out), start, at - start


def archived(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """The records of an archive. In a packed one, offset and length are those of the member that holds the record."""
    if data[:2] != b"\x1f\x8b":
        yield from records(data)
        return
    for content, offset, length in members(data):
        for headers, block, _, _ in records(content):
            yield headers, block, offset, length


CAPTURE = (
    "key string, time string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, file string, offset bigint, length bigint"
)


def _number(name: str | None) -> int | None:
    digits = (name or "").strip("<>").removeprefix(RECORD_ID)
    return int(digits) if digits else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record below ``path``, in the order of its archive; with ``payloads`` the text of responses too."""
    schema = CAPTURE + (", payload string" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, rows = batch.column("path")[k].as_py(), []
                for h, block, offset, length in archived(batch.column("content")[k].as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest or size != len(payload):
                            raise ValueError(f"the payload at byte {offset} of {file} has another digest")
                    row = (
                        "", h["warc-date"], _number(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"],
                        _number(h.get("warc-refers-to")), size, digest, file, offset, length,
                    )
                    rows.append((*row, payload.decode() if h["warc-type"] == "response" else None) if payloads else row)
                if rows:
                    frame = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)
                    yield from frame.to_batches()

    plain = {"string": pa.string(), "bigint": pa.int64()}
    kinds = pa.schema([(x.split()[0], plain[x.split()[1]]) for x in schema.split(", ")])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema).withColumn("key", url_key("url"))


class LoserTree:
    """Merges sorted runs: each inner node holds the run that lost there, the root the run with the smallest head."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads += [None] * (self.size - len(runs))
        winners = list(range(self.size))
        self.losers = [0] * self.size
        level = self.size
        while level > 1:
            level //= 2
            pairs = [(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
            winners = []
            for i, (a, b) in enumerate(pairs):
                win, lose = (a, b) if self._first(a, b) else (b, a)
                self.losers[level + i] = lose
                winners.append(win)
        self.winner = winners[0]

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            run = self.winner
            self.heads[run] = next(self.runs[run], None) if run < len(self.runs) else None
            node = (run + self.size) // 2
            while node >= 1:
                if self._first(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def index(captures: DataFrame) -> DataFrame:
    """All captures ordered by URL key, time and id over the partitions: the runs of the archives, merged.

    A hot URL is cut by time and id like any other stretch of keys.
    """
    spark = captures.sparkSession
    names, schema = captures.columns, ", ".join(f"{n} {t}" for n, t in captures.dtypes)
    order = [names.index(c) for c in ("key", "time", "page_id", "file", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        kinds = None
        for batch in batches:
            kinds = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rank = tuple((row[k] is None, row[k] if row[k] is not None else 0) for k in order)
                runs.setdefault(row[order[3]], []).append((rank, row))
        if not runs:
            return
        merged, block = LoserTree(list(runs.values())), []
        for _, row in merged:
            block.append(row)
            if len(block) == 8192:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in block], schema=kinds)
                block = []
        if block:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in block], schema=kinds)

    # Ranges of the global order, ``RANGE`` captures or fewer in each; the pieces of each archive's run come sorted by offset.
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // RANGE))
    ranged = captures.repartitionByRange(width, "key", "time", F.col("page_id").asc_nulls_last(), "file", "offset")
    return ranged.sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def archive(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    time_col: str | None = None, least: int = 0, size: int = ARCHIVE,
) -> DataFrame:
    """Writes the archives, reads them back and returns the merged index of all captures."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path, id_col, url_col, html_col, time_col, least, size)
    # The ranges are found by a look at the captures first; they are parsed once.
    return index(materialize(read(spark, path), "captures"))
