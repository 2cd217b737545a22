"""Shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, record number): equal texts are neighbours, and a group of copies of any size can still be cut
between two of its records. Keys are drawn with a chance in proportion to their record's size, so that quantiles of the drawn keys are
quantiles of the bytes. They are the splitters of the ranges; a range that holds more than ``OVERFULL`` times its share is
subdivided by splitters drawn from it alone, until none is overfull or its records are single. Ranges are sorted by a task each, their exact sizes are added up, and a record's
place among all bytes gives its shard. So shard sizes differ by less than two of the largest records, and the number of ranges grows with the input.

Null text: 16 bytes, the checksum of nothing. Null or repeated ids and repeated rows are records like any other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import replace_column, shared_folder, table, written

#: Bytes of text that a range should hold (its rows are sorted without their texts), and the fewest ranges for each shard.
RANGE_BYTES = 512 << 20
RANGES_PER_SHARD = 4
#: Keys drawn for each range; a range with this many times its share is subdivided.
DRAWN = 32
OVERFULL = 2.0


def _sortable(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Pairs of signed 64-bit numbers as 16 bytes that sort like the pairs."""
    flip = np.int64(-(1 << 63))
    pair = np.stack([high ^ flip, low ^ flip], axis=1).astype(">i8")
    return np.ascontiguousarray(pair).view("S16").ravel()


def with_range(keyed: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds ``range``: the number of splitters at or below (high, low)."""
    schema = T.StructType([*keyed.schema.fields, T.StructField("range", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _sortable(b.column("high").to_numpy(), b.column("low").to_numpy())
            found = np.searchsorted(splitters, key, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*b.schema.names, "range"])

    return keyed.mapInArrow(place, schema)


def _draw(keyed: DataFrame, rate: float, seed: int) -> np.ndarray:
    """Keys drawn with the chance size * rate, by a hash of the record number; sorted."""
    chance = F.expr(f"pmod(xxhash64(low, {seed}), 1073741824) / 1073741824D")
    rows = keyed.filter(chance < F.col("size") * rate).select("high", "low").toPandas()
    return np.sort(_sortable(rows.high.to_numpy(np.int64), rows.low.to_numpy(np.int64)))


def _quantiles(drawn: np.ndarray, parts: int) -> np.ndarray:
    return drawn[(np.arange(1, parts) * len(drawn)) // parts] if len(drawn) else drawn


def splitters_for(keyed: DataFrame, ranges: int, total: int) -> np.ndarray:
    """Sorted splitters of about ``ranges`` ranges; ``keyed`` has size, high and low. The driver holds ``ranges`` * ``DRAWN`` keys."""
    share = total / ranges
    found = np.unique(_quantiles(_draw(keyed, DRAWN / share, 0), ranges))
    for turn in range(1, 20):
        sizes = with_range(keyed, found).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        overfull = {r.range: r.bytes for r in sizes.filter((F.col("bytes") > OVERFULL * share) & (F.col("n") > 1)).collect()}
        if not overfull:
            break
        inside = with_range(keyed, found).filter(F.col("range").isin(list(overfull)))
        more = [_quantiles(drawn, int(np.ceil(overfull[k] / share)) + 1)
                for k, drawn in _by_range(_draw(inside, DRAWN / share, turn), found) if k in overfull]
        grown = np.unique(np.concatenate([found, *more])) if more else found
        if len(grown) == len(found):
            break  # what is left are single large records
        found = grown
    return found


def _by_range(drawn: np.ndarray, splitters: np.ndarray) -> list[tuple[int, np.ndarray]]:
    at = np.searchsorted(splitters, drawn, "right")
    return [(int(k), drawn[at == k]) for k in np.unique(at)]


def assign(records: DataFrame, shards: int, text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``records`` without the text, plus size, text_crc32, law, shard, slot and grown_shard."""
    own = [c for c in replace_column(records, "size", "text_crc32", "law", "shard", "slot", "grown_shard") if c != text_col]
    text = F.col(f"`{text_col}`")
    # The record number is fixed by writing it; a lost task reads the same number again.
    keyed = written(records.select(
        *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)],
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(text).alias("high"),
        F.monotonically_increasing_id().alias("low")), "keyed")
    total = keyed.agg(F.sum("size")).head()[0] or 0
    ranges = max(shards * RANGES_PER_SHARD, -(-total // range_bytes))
    found = splitters_for(keyed.select("size", "high", "low"), ranges, max(1, total))

    spread = with_range(keyed, found)
    sizes = spread.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row for each range: a running sum over them is small.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range").orderBy("high", "low").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (spread.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .withColumn("nth", F.coalesce(F.count("*").over(inside), F.lit(0))).join(base, "range"))
    middle = F.col("bytes_before") + F.col("at") + F.col("size") / 2
    placed = written(ranked.select(
        *[f"own_{i}" for i in range(len(own))], "size", "text_crc32",
        F.least(F.floor(middle * shards / F.lit(float(max(1, total)))), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth")).alias("nth")), "placed")
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        *[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("nth") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(records: DataFrame, shards: int, path: str | None = None, text_col: str = "text") -> str:
    """Write whole records as Parquet, a folder for each shard; returns the path. Ids must be unique, as ``doc_id``."""
    path = path or shared_folder(records.sparkSession, "shards")
    where = assign(records.select("doc_id", text_col), shards, text_col).select("doc_id", "shard", "slot")
    records.join(where, "doc_id").hint("rebalance", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
