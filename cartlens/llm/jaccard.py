"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes that its links form.

A text's set holds the hashes of its distinct shingles of ``WIDTH`` words. Equal sets are one class of rows; only classes are joined. Tokens (shingles) are
ordered by an estimate of how many texts hold them, rare ones first. Two sets that link share at least ``l`` tokens of their prefixes of
``n - ceil(n * percent / 100) + l`` tokens. Each set chooses its ``l`` from 1 to ``DEPTHS``: a longer prefix asks for more shared tokens before a pair is
verified, and the least estimated cost (prefix lists to read, plus pairs left to verify) wins. A pair must share as many as the lower of both asks for, and as many as the
two sizes and what lies behind both prefixes leave no way around.

No pairs are made within a group of near copies. First each set is compared with the hubs of its prefix tokens (per token one set, by one of
eight orders), which links most of a group in a star. Then all pairs are made that share enough prefix tokens and are not in one class yet,
so that no two linked texts stay apart. Candidates are verified on their whole sets. Classes come from alternating large and small stars, each round written to the shared folder.

The order's estimate is a count sketch of fixed size. It only orders tokens: any order gives the same links. Hashes have 64 bits.

Null texts and texts without words have no set and link with nothing. Repeated rows and ids each get a row; of equal ids each row has the class of its own
text. A row without an id can carry the class of others, but never names it.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, pieces, runs, span_hashes, table, utf8, written

WIDTH = 5
PERCENT = 75
DEPTHS = 4
SKETCH_BITS = 20
SLICES = 64
HUBS = 3
#: A hub is compared if one in so many of the set's tokens is shared within the prefixes by the hub's order.
FEWEST = 64
BROADCAST_BYTES = 8 << 20

_random = random.Random(1)
#: Odd factors for the words of a shingle, and the masks of the orders in which hubs are chosen.
FACTORS = np.array([_random.getrandbits(64) | 1 for _ in range(64)], np.uint64)
MASKS = [_random.getrandbits(62) for _ in range(8)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def shingles(data: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    starts, ends = runs(~SPACE[data], bounds)
    word = span_hashes(LOWER[data], starts, ends)
    first = np.searchsorted(starts, bounds)  # index of each row's first word
    full = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for j in range(width):
        full += word[j:j + len(full)] * FACTORS[j]
    full = mix(full)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(full[lo:hi - width + 1]))
        elif hi > lo:  # the whole sequence; its length is part of the hash
            out.append(mix(np.array([(word[lo:hi] * FACTORS[width:width + hi - lo]).sum() + np.uint64(hi - lo)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def choose_prefix(tokens: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[int, np.ndarray]:
    """(l, prefix): tokens in global order and the least costly of the prefixes for 1 to ``DEPTHS`` shared tokens."""
    load = counts[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort([tokens, load])
    n = len(tokens)
    short = n - -(-n * percent // 100)
    lists = np.cumsum(np.maximum(1.0, load[order[:short + DEPTHS]] - noise))
    # A list entry costs 1, a pair n; of the entries of a prefix at most one in l can be a pair that shares l.
    cost = [lists[short + l - 1] * (1 + n / l) if short + l <= n else np.inf for l in range(1, DEPTHS + 1)]
    depth = 1 + int(np.argmin(cost))
    return depth, tokens[order[:short + depth]]


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` to broadcast, if its rows of about ``row_bytes`` are few enough; as it is otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def components(links: DataFrame) -> DataFrame:
    """(v, r) of every vertex of (a, b) but the least of its component, which is r."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("r")).distinct(), "edges")
    while True:
        twice = edges.groupBy("v").count().filter("count > 1").select("v")
        chained = edges.select(F.col("r").alias("v")).join(edges, "v", "left_semi")
        if twice.unionByName(chained).isEmpty():
            return edges
        both = edges.unionByName(edges.select(F.col("r").alias("v"), F.col("v").alias("r")))
        least = both.groupBy("v").agg(F.min("r").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("r > v").select(F.col("r").alias("v"), F.col("m").alias("r")).distinct()
        low = large.groupBy("v").agg(F.min("r").alias("m"))
        step = large.join(low, "v").select(F.col("r").alias("v"), F.col("m").alias("r")).unionByName(low.select("v", F.col("m").alias("r")))
        edges = written(step.filter("v <> r").distinct(), "edges")


def _sum_counts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
    for c in rows.counts:
        total += np.frombuffer(c, "<u8")
    return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})


def sketch_of(sets: DataFrame) -> np.ndarray:
    """Token counts of the whole table by bucket: 2**SKETCH_BITS numbers whatever the table's size."""
    parts = sets.filter("slice is not null").withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(32)))
    for keys in (["slice", "salt"], ["slice"]):
        parts = parts.groupBy(*keys).applyInPandas(_sum_counts, "slice int, counts binary")
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint64)
    for r in parts.collect():
        counts[r.slice] = np.frombuffer(r.counts, "<u8")
    return counts.ravel().astype(np.float64)


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets reach the threshold."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    wanted = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c").select("c", "digest", "key")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            sets = shingles(*utf8(b.column("text")), width)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([digest(t) for t in sets], pa.binary()),
                                              pa.array([t.view(np.int64) for t in sets], pa.list_(pa.int64()))], names=["key", "digest", "tokens"])

    wanted = written(wanted, "wanted")
    texts = rows.select("key", "text").join(small(wanted.select("key").distinct(), 24), "key", "left_semi")
    sets = written(texts.mapInArrow(whole, "key long, digest binary, tokens array<long>").join(wanted, ["key", "digest"])
                   .select("c", "tokens").dropDuplicates(["c"]), "sets")
    both = (pairs.join(sets.select(F.col("c").alias("a"), F.col("tokens").alias("x")), "a")
            .join(sets.select(F.col("c").alias("b"), F.col("tokens").alias("y")), "b"))
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"), (F.size("x") + F.size("y")).alias("both"))
    return shared.filter(f"100 * cast(o as bigint) >= {percent} * cast(both - o as bigint)").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None, width: int = WIDTH,
                    percent: int = PERCENT) -> DataFrame:
    """(id, tag, n_shingles, component_id, root) of each row; ``tag`` is a long column of ``docs`` that is handed on.

    ``root`` is unique for each component, also where ids are missing or repeat (null without a set); its values differ from run to run.
    """
    ident = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(ident.alias("id"), F.coalesce(ident, F.lit(-(1 << 63))).alias("key"), (tag if tag is not None else F.lit(0)).cast("long").alias("tag"),
                       F.col(f"`{text_col}`").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "tag", "n", "digest", "slice", "counts"]
        counts = np.zeros(1 << SKETCH_BITS, np.uint64)
        for b in pieces(batches, "text"):
            sets = shingles(*utf8(b.column("text")), width)
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("tag"), pa.array([len(t) for t in sets], pa.int64()), pa.array([digest(t) for t in sets], pa.binary()),
                 pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names=names)
        used = [(i, c) for i, c in enumerate(counts.reshape(SLICES, -1)) if c.any()]
        empty = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, pa.nulls(len(used), pa.binary()), pa.array([i for i, _ in used], pa.int32()),
                                          pa.array([c.tobytes() for _, c in used], pa.binary())], names=names)

    sets = written(rows.select("id", "tag", "text").mapInArrow(measure, "id long, tag long, n long, digest binary, slice int, counts binary"), "sets")
    members = sets.filter("slice is null").drop("slice", "counts")
    classes = written(members.filter("n > 0").groupBy("digest").agg(F.min("id").alias("first"), F.min("n").alias("n"))
                      .withColumn("key", F.coalesce("first", F.lit(-(1 << 63)))).withColumn("c", F.monotonically_increasing_id()), "classes")
    counts = sketch_of(sets)
    mean = counts.mean()
    noise, held = mean + 3 * mean ** 0.5, docs.sparkSession.sparkContext.broadcast(counts.astype(np.float32))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = held.value
        for b in pieces(batches, "text"):
            kept, made = [], []
            for i, t in enumerate(shingles(*utf8(b.column("text")), width)):
                if len(t):
                    kept.append(i)
                    made.append((digest(t), *choose_prefix(t, loads, noise, percent)))
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(kept, pa.int64())), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int32()),
                 pa.array([m[2].view(np.int64) for m in made], pa.list_(pa.int64()))], names=["key", "digest", "depth", "tokens"])

    chosen = rows.select("key", "text").mapInArrow(prefixes, "key long, digest binary, depth int, tokens array<long>").dropDuplicates(["key", "digest"])
    prefixed = written(chosen.join(classes, ["key", "digest"]).select("c", F.col("depth").cast("tinyint").alias("depth"), "tokens"), "prefixes")
    # Read twice: to count each token, and to keep the tokens that two classes or more have.
    postings = prefixed.select("c", "depth", F.posexplode("tokens").alias("pos", "token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1").select("token")
    kept = written(postings.join(shared, "token"), "kept")
    # ``alone`` tokens of a prefix are in no other prefix. Such a token can still lie behind the end of another set's prefix.
    each = kept.groupBy("c").agg(F.count("*").alias("known"), F.first("depth").alias("depth"))
    each = each.join(classes.select("c", F.col("n").cast("int").alias("n")), "c").select(
        "c", "n", "depth", (F.col("n") - F.ceil(F.col("n") * percent / 100) + F.col("depth") - F.col("known")).cast("int").alias("alone"))
    live = written(kept.select("c", "pos", "token").join(each, "c"), "live")

    # First the hubs that share most tokens with a class, if they are not too few for a near copy; what this passes over is left to the pairs below.
    # The hub of a token is a set with the fewest tokens of its own: in a group of near copies one that little was changed in.
    mask = F.element_at(F.lit(MASKS), (F.col("token").bitwiseAND(F.lit(7)) + 1).cast("int"))
    hubs = live.groupBy("token").agg(F.min(F.struct("alone", F.col("c").bitwiseXOR(mask).alias("c"))).alias("hub")).select(
        "token", F.col("hub.c").bitwiseXOR(mask).alias("hub"))
    met = live.join(hubs, "token").filter("hub <> c").groupBy("c", "n", "hub").agg(F.count("*").alias("m")).filter(f"m * {FEWEST} >= n")
    best = met.withColumn("nth", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("m"), "hub"))).filter(F.col("nth") <= HUBS)
    stars = written(_verified(best.select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")), classes, rows, width, percent), "stars")
    joined = components(stars)

    # Then every pair between different components that shares enough of both prefixes.
    root = F.coalesce("r", "c")
    rooted = live.join(joined.withColumnRenamed("v", "c"), "c", "left").withColumn("root", root).drop("r")
    apart = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
    left = written(rooted.join(apart, "token", "left_semi"), "apart")
    # A pair needs ``overlap`` tokens in common. The first of them lies where both sets have room for that many from there on. Of the set whose prefix ends first in
    # the order, what the other has of that prefix is in the other's prefix too: there, tokens alone are in no overlap. Which of the two that is, is not known here, so
    # one set with room for the overlap besides its tokens alone is enough.
    # Such pairs must then share, in both prefixes, what the lower depth asks for and what the tokens behind the prefixes leave open.
    x, y = left.alias("x"), left.alias("y")
    overlap = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent) - 1e-6)
    early = lambda s: F.col(f"{s}.pos") <= F.col(f"{s}.n") - overlap
    room = lambda s: F.col(f"{s}.n") - F.col(f"{s}.alone") >= overlap
    behind = lambda s: F.ceil(F.col(f"{s}.n") * percent / 100) - F.col(f"{s}.depth")
    least = F.greatest(F.least("x.depth", "y.depth"), overlap - F.greatest(behind("x"), behind("y")))
    apart_now = (F.col("x.c") < F.col("y.c")) & (F.col("x.root") != F.col("y.root"))
    near = (x.join(y, (F.col("x.token") == F.col("y.token")) & apart_now & early("x") & early("y") & (room("x") | room("y")))
            .select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), least.alias("least")).distinct())
    prefix = live.groupBy("c").agg(F.collect_list("token").alias("tokens"))  # no longer than the prefix of one text
    shares = (near.join(prefix.select(F.col("c").alias("a"), F.col("tokens").alias("p")), "a")
              .join(prefix.select(F.col("c").alias("b"), F.col("tokens").alias("q")), "b"))
    pairs = shares.filter(F.size(F.array_intersect("p", "q")) >= F.col("least"))
    bridges = _verified(pairs, classes, rows, width, percent)
    final = components(stars.unionByName(bridges))

    named = classes.join(final.withColumnRenamed("v", "c"), "c", "left").withColumn("root", root)
    least_id = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_digest = named.join(least_id, "root").select("digest", "component_id", "root")
    return members.join(of_digest, "digest", "left").select(
        "id", "tag", F.col("n").alias("n_shingles"), F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "root")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM doc),
size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS o FROM shingle a JOIN shingle b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT x, y FROM shared JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
reach(r, t) AS (SELECT r, r FROM doc UNION SELECT reach.r, y FROM reach JOIN link ON t = x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM doc d JOIN reach USING (r) JOIN doc e ON e.r = t LEFT JOIN size ON size.r = d.r GROUP BY d.r, d.doc_id
"""
