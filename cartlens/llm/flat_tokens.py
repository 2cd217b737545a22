"""Token counts of the documents in flat, unindexed token files.

A file is a run of token ids of ``WIDTH`` bytes, little-endian, with ``END`` after each document; nothing else says where documents lie. Spark splits files by bytes: the first byte of the
separator is the line end of the text source, so that a task reads its range up to the line over the range's end and a line is at most a document. The lines of a range are put together and cut into
blocks of ``BLOCK`` ids at most regardless of documents. In each block all bytes that look like a separator are found by one vectorised search; where ids begin, and which of these are separators, follows from
the bytes before the block. A prefix scan over the blocks of a file carries the bytes, and then the ids, the documents and the last separator before each block, so that ids, separators and documents are
stitched across any number of blocks and ranges.

Empty documents have no tokens and count; ids after a file's last separator are a document of their own. An empty file has no documents. A file that ends
within an id raises an error, as does one that the source unpacks because its name ends in ``.gz`` or the like.

``write`` makes such files: the text sink puts each document's bytes into a file with the separator id as the line end.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import pieces, shared_folder, table, utf8

WIDTH = 2
#: The id after the last one of the vocabulary ends a document.
END = 50256
BLOCK = 1 << 18
#: The text source leaves these bytes out at the start of a file.
BOM = b"\xef\xbb\xbf"


def write(docs: DataFrame, path: str, text_col: str = "text") -> str:
    """Flat files of ``docs``, one for each partition."""
    end = int(END).to_bytes(WIDTH, "little").decode("latin-1")
    ids = tokens.encode(docs.select(text_col), text_col, width=WIDTH)
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1").text(path)
    return path


def search(end: int, width: int, block: int):
    """Batches of (path, at, size, value), the lines of byte ranges in their order, to (path, file, at, part, size, bytes, hits, head, tail) of each block of at most ``block * width`` bytes.

    ``hits`` are the places of all bytes that look like a separator within the block, on or between the ids: where ids begin is known only when all ranges before are counted.
    """
    mark, most = int(end).to_bytes(width, "little"), block * width

    def row(path: str, at: int, part: int, size: int, data: np.ndarray) -> pa.RecordBatch:
        hits = np.flatnonzero(data[:max(0, len(data) - width + 1)] == mark[0])
        for i in range(1, width):
            hits = hits[data[hits + i] == mark[i]]
        seam = width - 1
        return pa.RecordBatch.from_arrays([
            pa.array([path]), pa.array([unquote(path.rsplit("/", 1)[-1])]), pa.array([at]), pa.array([part]), pa.array([size]), pa.array([len(data)]), pa.array([hits.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([data[:seam].tobytes()], pa.binary()), pa.array([data[max(0, len(data) - seam):].tobytes()], pa.binary())], names=["path", "file", "at", "part", "size", "bytes", "hits", "head", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n, part = None, [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            ats, paths = b.column("at").to_numpy(), b.column("path")
            # A range is a run of equal places: two files of a task can follow each other with the same one.
            same = (ats[1:] == ats[:-1]) & pc.equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(~same) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                here = (paths[lo].as_py(), int(ats[lo]), b.column("size")[lo].as_py())
                if here != now:
                    if held:
                        yield row(now[0], now[1], part, now[2], np.concatenate(held))
                    now, held, n, part = here, [], 0, 0
                    if here[2] % width:
                        raise ValueError(f"{unquote(here[0].rsplit('/', 1)[-1])} ends within an id")
                for piece in pieces(iter([b.slice(lo, hi - lo)]), "value", most):
                    data, bounds = utf8(piece.column("value"))
                    held.append(np.insert(data, bounds[1:], mark[0]))
                    n += len(held[-1])
                    if n >= most:
                        whole = np.concatenate(held)
                        for i in range(0, n - most + 1, most):
                            yield row(now[0], now[1], part, now[2], whole[i:i + most])
                            part += 1
                        n %= most
                        held = [whole[-n:].copy()] if n else []
        if held:
            yield row(now[0], now[1], part, now[2], np.concatenate(held))

    return run


def blocks(spark: SparkSession, path: str, block: int = BLOCK, end: int = END, width: int = WIDTH) -> DataFrame:
    """(file, block, ids, ends): number of ids of each block, and the places of its separators. An id belongs to the block that holds its last byte."""
    mark = int(end).to_bytes(width, "little")
    meta = lambda x: F.col(f"_metadata.{x}")
    lines = spark.read.option("lineSep", mark[:1].decode("latin-1")).option("encoding", "ISO-8859-1").text(path).select(
        meta("file_path").alias("path"), meta("file_block_start").alias("at"), meta("file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    found = lines.mapInArrow(search(end, width, block), "path string, file string, at long, part long, size long, bytes long, hits array<int>, head binary, tail binary")
    order = Window.partitionBy("path").orderBy("at", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_of = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(b"")
    # Each byte of a file comes once, but for the line end that is counted behind the last line of a file that does not end with one, and a byte order mark that the source leaves out.
    over = F.sum("bytes").over(all_of) - F.col("size")
    gone = F.when(over.isin(0, 1), 0).when(over.isin(-3, -2), len(BOM)).otherwise(
        F.raise_error(F.concat("file", F.lit(" was not read as it is: the source unpacks files by the end of their name"))).cast("int"))
    last = [F.coalesce(F.lag("tail", i).over(order), none) for i in range(width - 1, 0, -1)]  # a block can be shorter than a seam
    placed = found.select("file", "size", "bytes", "hits", "head", (F.row_number().over(order) - 1).cast("long").alias("block"), gone.alias("gone"),
                          F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("read"), F.concat(none, *last).alias("last"))
    placed = placed.withColumn("start", F.col("read") + F.col("gone"))
    whole_ids = lambda x: F.floor(x / width)
    first = whole_ids(F.when(F.col("block") == 0, 0).otherwise(F.col("start")))
    # The id that began before the block, if its last byte is here.
    begun = F.col("start") % width
    seam = F.concat(F.substring("last", (F.octet_length("last") - begun + 1).cast("int"), begun.cast("int")), F.substring("head", F.lit(1), (width - begun).cast("int")))
    stitched = (begun > 0) & (begun <= F.octet_length("last")) & (F.col("start") - begun + width <= F.col("size")) & (seam == F.lit(mark))
    inside = F.filter("hits", lambda p: ((F.col("start") + p) % width == 0) & (F.col("start") + p + width <= F.col("size")))
    ends = F.concat(F.when(stitched, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.transform(inside, lambda p: (whole_ids(F.col("start") + p) - first).cast("int")))
    ids = whole_ids(F.least(F.col("start") + F.col("bytes"), F.col("size"))) - first
    return placed.select("file", "block", ids.alias("ids"), ends.alias("ends")).filter("ids > 0")


def counts(cut: DataFrame) -> DataFrame:
    """(file, doc_no, first_id, n_tokens) of every document, from the blocks of each file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = cut.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).withColumn("final", F.max("block").over(last))
    # A file's end closes a document that has ids but no separator.
    open_end = (F.col("block") == F.col("final")) & (F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(-1)) < F.col("ids") - 1)
    closed = placed.withColumn("ends", F.when(open_end, F.concat("ends", F.array(F.col("ids").cast("int")))).otherwise(F.col("ends")))
    final = F.col("start") + F.element_at("ends", -1)
    known = closed.withColumn("final_end", F.when(F.size("ends") > 0, final)).withColumn("n", F.size("ends"))
    carried = known.select("file", "start", "ends", F.coalesce(F.max("final_end").over(before), F.lit(-1)).alias("open"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs"))
    each = carried.select("file", "docs", "start", "open", "ends", F.posexplode("ends").alias("i", "at"))
    first = F.when(F.col("i") == 0, F.col("open") + 1).otherwise(F.col("start") + F.get("ends", F.col("i") - 1) + 1)
    return each.select("file", (F.col("docs") + F.col("i")).cast("long").alias("doc_no"), first.cast("long").alias("first_id"),
                       (F.col("start") + F.col("at") - first).cast("long").alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(table(spark, sf_dir, "documents").select("text"), shared_folder(spark, "flat-tokens"))
    return counts(blocks(spark, path)).withColumn("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
