"""WARC archives: a writer, and a reader that splits compressed archives by byte ranges.

``write`` makes one gzip member for each record, so that a reader may start at any member. Of rows with equal payloads of at least ``LEAST`` bytes those with the largest id are written
whole (response); the others are revisits that refer to it and carry its digest and size, without the payload. Shorter payloads are always written whole.

``read`` lets Spark split files by bytes. Its tasks scan their range for the gzip magic, which is the line end of the text source; what follows a magic is a candidate.
A candidate is a member if its gzip header decodes and the bytes behind it unpack to the start of a WARC record; else the magic is chance, a part of the compressed data.
From the first member on the range is unpacked member by member, with size and checksum. A task owns the records that start inside its range. One that runs on into the next ranges is stitched:
each range hands on the bytes before its first member and those of its last, open one, and a scan over the ranges of a file joins them.

Files are named by Spark, without ``.gz``: a file whose name ends so would be unpacked by the source itself and cannot be split; ``read`` raises an error on it, as on other data
that are no members, a cut off record or a wrong size.

A null html is an empty payload. A row without an id has a record without a number; its ``page_id`` and those that refer to it read back as null. Repeated rows are a record each; rows that
carry the largest id of their payload are all responses. Control characters and spaces of a url are written as percent codes; a row without url has no target. An empty table gives an empty archive. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, shared_folder, table, written

MAGIC = b"\x1f\x8b"
#: Payloads of fewer bytes are written whole every time.
LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A table of copies is broadcast if its rows, of so many bytes each, take no more than this. Beyond, only payloads on at least one of HOT rows are: at most HOT rows.
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 80
HOT = 1024
#: The last byte of a member is the topmost one of its record's size: zero below 16 MB. A record is its payload, the url and some hundreds of bytes.
SMALL_RECORD = (1 << 24) - (1 << 16)
RECORD = "page_id long, record_type string, refers_to long, url string, date string, payload_bytes long, payload_digest string, payload binary"


# ---- writing

def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, level: int = 6) -> bytes:
    """One record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:x-page:{'' if i is None else int(i)}>"
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page_id), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to)}
    head |= {"WARC-Payload-Digest": "sha1:" + hashlib.sha1(payload).hexdigest(), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    start = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return pack.compress(start.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def with_originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to): which rows are revisits, and of which row.

    Copies are found by a digest of the payload, grouped without it. Where the groups are too many to send round, those on a large share of all rows still are:
    no more than ``HOT`` payloads can be; the rest is joined by digest, and rows that are alone in having no need of the join are dealt out by a salt.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    d = pages.select("page_id", "url", payload.alias("payload"))
    d = d.withColumn("key", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    seen = d.groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("original"))
    groups = written(seen.filter((F.col("n") > 1) | F.col("key").isNull()), "copies")
    copies = groups.filter("key IS NOT NULL AND original IS NOT NULL")
    if copies.count() * ROW_BYTES <= BROADCAST_BYTES:
        found = d.join(F.broadcast(copies.drop("n")), "key", "left")
    else:
        often = F.col("n") * HOT >= pages.count()
        hot, cold = copies.filter(often), copies.filter(~often)
        d = d.join(F.broadcast(hot.select("key", F.col("original").alias("__hot"))), "key", "left")
        rare = F.col("key").isNotNull() & F.col("__hot").isNull()
        d = d.withColumns({"__key": F.when(rare, F.col("key")), "__salt": F.when(rare, 0).otherwise(F.xxhash64("page_id", "url"))})
        found = d.join(cold.select(F.col("key").alias("__key"), F.lit(0).cast("bigint").alias("__salt"), F.col("original").alias("__cold")), ["__key", "__salt"], "left")
        found = found.withColumn("original", F.coalesce("__hot", "__cold"))
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    return found.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("original")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> str:
    """Archives of ``pages`` (page_id, url, html) in folder ``path``, one file for each partition.

    The text sink writes bytes as they are and ends each line: a member goes without its last byte, and that byte is the line end. It is zero for all records but those of 16 MB and more, which
    are written by their last byte; the sizes that a row can have allow 128 of these at most.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "payload", 1 << 22):
            made = [member(r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"], date, level) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in made], pa.binary()), pa.array([m[-1] for m in made], pa.int32())], names=["bytes", "last"])

    def put(rows: DataFrame, last: int, mode: str) -> None:
        rows.select(F.col("bytes").cast("string").alias("value")).write.mode(mode).option("lineSep", chr(last)).option("encoding", "ISO-8859-1").text(path)

    size = F.octet_length("payload") + 3 * F.coalesce(F.octet_length("url"), F.lit(0))
    rows = with_originals(pages, least)
    put(rows.filter(size < SMALL_RECORD).mapInArrow(build, "bytes binary, last int"), 0, "errorifexists")
    if pages.filter(F.coalesce(F.octet_length("html"), F.lit(0)) + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) >= SMALL_RECORD).limit(1).count():
        large = written(rows.filter(size >= SMALL_RECORD).mapInArrow(build, "bytes binary, last int"), "large-records")
        for (last,) in large.select("last").distinct().collect():
            put(large.filter(F.col("last") == last), last, "append")
    return path


# ---- reading

def is_member(data: bytes) -> bool:
    """Whether ``data``, the bytes from a magic to the next one, can be the start of a record's member."""
    if data[2:3] not in (b"\x08", b"") or (len(data) > 3 and data[3] & 0xE0):
        return False
    try:
        start = zlib.decompressobj(31).decompress(data, 7)
    except zlib.error:
        return False
    # A short piece may unpack to less than the start of a record; what follows decides.
    return start == b"WARC/1." or (len(data) < 512 and b"WARC/1.".startswith(start))


class Members:
    """Members out of the pieces between magics, in the order of the range."""

    def __init__(self) -> None:
        self.head: list[bytes] = []       # before the first member: the end of a record of an earlier range
        self.open: list[bytes] = []       # pieces of the member at hand
        self.started = False
        self._restart()

    def _restart(self) -> None:
        self.unpack, self.out = zlib.decompressobj(31), []

    def _feed(self, piece: bytes) -> Iterator[bytes]:
        self.open.append(piece)
        try:
            self.out.append(self.unpack.decompress(piece))
        except zlib.error:
            if self.started:
                raise ValueError("a member of the archive cannot be unpacked") from None
            # The candidate was chance: its first piece belongs to the head, the next ones are candidates again.
            first, *rest = self.open
            self.head.append(first)
            self.open = []
            self._restart()
            for p in rest:
                yield from self.add(p)
            return
        if self.unpack.eof:
            if self.unpack.unused_data:
                raise ValueError("data between the members of the archive")
            whole, self.open, self.started = b"".join(self.out), [], True
            self._restart()
            yield whole

    def ends(self) -> tuple[bool, list[bytes], list[bytes]]:
        """Whether a member starts in the range, the pieces before the first one and those of the open last one.

        Where so little of a candidate is seen that it may be chance, all is head: then the record before it decides."""
        if self.started or b"".join(self.out)[:7] == b"WARC/1.":
            return True, self.head, self.open
        return False, self.head + self.open, []

    def add(self, piece: bytes) -> Iterator[bytes]:
        """Records that end with this piece (which begins with a magic)."""
        if self.open:
            yield from self._feed(piece)
        elif is_member(piece):
            yield from self._feed(piece)
        elif self.started:
            raise ValueError("data between the members of the archive")
        else:
            self.head.append(piece)


def parse(record: bytes) -> tuple:
    """A row of ``RECORD`` out of an unpacked record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if not version.startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record of another size than it says")
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    revisit = fields.get("warc-type") == "revisit"
    told = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    page = lambda name: (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(name, ""))) and int(m[1])
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (page("warc-record-id"), fields.get("warc-type"), page("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"),
            (int(told[1]) if told else None) if revisit else len(payload), digest if revisit else hashlib.sha1(payload).hexdigest(), None if revisit else payload)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, split, piece): what lies between gzip magics, by byte ranges of the files, in their order."""
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    meta = lambda x: F.col(f"_metadata.{x}")
    return lines.select(meta("file_path").alias("file"), meta("file_block_start").alias("block"),
                        (meta("file_block_length") < meta("file_size")).alias("split"), F.col("value").cast("binary").alias("piece"))


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, Members, list[bytes] | None]]:
    """(file, block, split, members, unpacked records) of the ranges of a task, some records at a time; None after the last ones of a range."""
    now, found = None, Members()
    for b in batches:
        files, blocks, splits, column = (b.column(c) for c in ("file", "block", "split", "piece"))
        at = 0
        while at < b.num_rows:
            here = (files[at].as_py(), blocks[at].as_py(), splits[at].as_py())
            to = at + 1
            while to < b.num_rows and (files[to].as_py(), blocks[to].as_py()) == here[:2]:
                to += 1
            first = at
            if here != now:
                if now:
                    yield *now, found, None
                now, found = here, Members()
                if here[1] == 0:  # what stands before a file's first magic
                    if len(column[at].as_buffer()):
                        raise ValueError(f"{here[0]} does not begin with a gzip member, or was unpacked by the source because of its name")
                    found.started, first = True, at + 1
            for i in range(first, to):
                records = list(found.add(MAGIC + column[i].as_py()))
                if records:
                    yield *now, found, records
            at = to
    if now:
        yield *now, found, None


def whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie within the ranges of a task."""
    rows, held = [], 0
    for file, _, split, found, records in ranges(batches):
        if records is None and found.open and not split:
            raise ValueError(f"{file} ends within a record")
        for r in records or ():
            rows.append(parse(r))
            held += len(r)
        if held > 1 << 22 or len(rows) >= 1000:
            yield batch_of(rows)
            rows, held = [], 0
    if rows:
        yield batch_of(rows)


SEAM = "file string, block long, starts boolean, head binary, tail binary"


def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range the bytes before its first member and those of its open last one."""
    for file, block, _, found, records in ranges(batches):
        if records is None:
            starts, head, tail = found.ends()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([starts]), pa.array([b"".join(head)], pa.binary()), pa.array([b"".join(tail)], pa.binary())],
                                             names=["file", "block", "starts", "head", "tail"])


def stitched(cut: DataFrame) -> DataFrame:
    """Records that run over range ends: the open tail of a range and the heads of the ranges up to the next member."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Where each piece belongs: to the last range before it that a member starts in.
    owner = F.max(F.when(F.col("starts"), F.col("block"))).over(before)
    placed = cut.select("file", "block", "starts", owner.alias("owner"))
    whole = cut.join(placed.drop("starts"), ["file", "block"])
    parts = whole.filter("octet_length(head) > 0").select("file", F.coalesce("owner", F.lit(-1)).alias("owner"), "block", F.col("head").alias("bytes")).unionByName(
        whole.filter("octet_length(tail) > 0").select("file", F.col("block").alias("owner"), "block", F.col("tail").alias("bytes")))

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data, records = b"".join(rows.sort_values("block")["bytes"]), []
        while data:  # one record, or more where a range could not tell that another one starts
            unpack = zlib.decompressobj(31)
            try:
                records.append(parse(unpack.decompress(data)) if is_member(data) else None)
            except zlib.error:
                records.append(None)
            if not unpack.eof or records[-1] is None:
                raise ValueError(f"{key[0]} ends within a record, or holds other data, after the range at {key[1]}")
            data = unpack.unused_data
        return batch_of(records).to_pandas()

    return parts.groupBy("file", "owner").applyInPandas(join, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives in ``path``, see ``RECORD``. Payload, size and digest of a response come from its bytes, size and digest of a revisit from its headers."""
    found = candidates(spark, path)
    inside = found.mapInArrow(whole_records, RECORD)
    cut = written(found.filter("split").mapInArrow(seams, SEAM), "seams")
    return inside.unionByName(stitched(cut))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), shared_folder(spark, "warc"))
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS b FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN b >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 1000 AND page_id < top THEN top END AS refers_to FROM m"""
