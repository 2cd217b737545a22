"""Approximate nearest neighbours: inverted lists scanned with adaptive dimension sampling.

Lists: k-means centroids of a bounded sample (``sample_per_list`` rows for each list), every row in the list of its nearest centroid. A query probes the
``probes`` nearest lists, and further ones until they hold ``k`` rows besides its own. Unless given, ``probes`` is the least number that reaches ``target`` of
the true neighbours of ``TRIALS`` rows, which are measured against all rows: few for clustered vectors, many for vectors without structure. Rows of a list are dealt into blocks of about ``BLOCK``
rows and its queries into blocks of about ``QUERY_BLOCK``, so a list that holds a third of all rows is many tasks.

Scan: vectors are rotated by one random orthogonal matrix, so that any first d of D columns are a random projection. Columns are read in steps of
``STEP``; a candidate whose partial square distance exceeds ``(d / D) * (1 + EPSILON / sqrt(d))**2`` times that of the k-th best so far is abandoned (the test errs with a
chance that falls as exp(-c * EPSILON**2)). Survivors are measured on the original vectors in double precision; ties go to the smaller id.

Rows without an id, null or zero vectors, and vectors with null or non-finite components take no part. There is a distance between vectors of one length only: each length is searched by itself.
Identical rows count once; a query finds all rows but its own, another vector of its id too. Tables without vectors give no rows, small ones all candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCK = 1024
QUERY_BLOCK = 256
STEP = 16
EPSILON = 2.1
TRIALS = 96
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v double array) of the rows that take part, each once."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("id is not null and size(v) > 0").filter(
        "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return rows.dropDuplicates(["id", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def centroids_of(sample: np.ndarray, lists: int, turns: int = 12) -> np.ndarray:
    """k-means by Lloyd's turns from evenly spaced rows of the sample; an empty list keeps its centroid."""
    sample = sample[np.lexsort(sample.T[::-1])]
    at = sample[np.random.default_rng(0).permutation(len(sample))[:lists]].copy()
    for _ in range(turns):
        near = nearest(sample, at, 1)[:, 0]
        n = np.bincount(near, minlength=len(at))
        total = np.zeros_like(at)
        np.add.at(total, near, sample)
        at[n > 0] = total[n > 0] / n[n > 0, None]
    return at


def nearest(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    out = np.empty((len(x), k), np.int64)
    norm = (centroids ** 2).sum(1)
    for i in range(0, len(x), 4096):
        d = norm - 2 * (x[i:i + 4096] @ centroids.T)
        best = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(centroids) else np.tile(np.arange(k), (len(d), 1))
        out[i:i + 4096] = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
    return out


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def scan(query: np.ndarray, turned_query: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, turned: np.ndarray, k: int,
         step: int = STEP, epsilon: float = EPSILON, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of one block: (ids, distances). ``turned`` holds the rotated vectors, ``x`` the original ones."""
    width = x.shape[1]
    best_id, best = np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, len(ids), chunk):
        at = np.arange(lo, min(lo + chunk, len(ids)))
        same = ids[at] == own
        if same.any():
            at = at[~(same & (x[at] == query).all(1))]
        limit = best[k - 1] ** 2 if len(best) >= k else np.inf
        part = np.zeros(len(at))
        for d in range(0, width, step) if np.isfinite(limit) else ():
            to = min(d + step, width)
            part += ((turned[at, d:to] - turned_query[d:to]) ** 2).sum(1)
            keep = part <= limit * min(1.0, to / width * (1 + epsilon / np.sqrt(to)) ** 2) * (1 + 1e-9) if to < width else part <= limit * (1 + 1e-9)
            at, part = at[keep], part[keep]
        if len(at):
            best_id = np.concatenate([best_id, ids[at]])
            best = np.concatenate([best, np.sqrt(((x[at] - query) ** 2).sum(1))])
            order = np.lexsort([best_id, best])[:k]
            best_id, best = best_id[order], best[order]
    return best_id, best


def probes_for(indexed: DataFrame, own: np.ndarray, trials: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """Least number of probes that finds ``target`` of the k nearest rows of ``trials``, whose ids are ``own``; each task hands on k rows for each of them."""

    def near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            if not b.num_rows:
                continue
            x, of = _matrix(b.column("v")), b.column("list").to_numpy()
            d = (trials ** 2).sum(1)[:, None] - 2 * trials @ x.T + (x ** 2).sum(1)
            d[own[:, None] == b.column("id").to_numpy()] = np.inf  # the trial itself
            of = np.broadcast_to(of, d.shape)
            if best is not None:
                d, of = np.concatenate([best[0], d], 1), np.concatenate([best[1], of], 1)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(d, order, 1), np.take_along_axis(of, order, 1)
        if best is not None:
            trial = np.repeat(np.arange(len(trials), dtype=np.int32), best[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(trial), pa.array(best[0].ravel()), pa.array(best[1].ravel().astype(np.int32))],
                                             names=["trial", "d", "list"])

    rows = indexed.select("id", "v", "list").mapInArrow(near_rows, "trial int, d double, list int")
    found = (rows.withColumn("n", F.row_number().over(Window.partitionBy("trial").orderBy("d"))).filter((F.col("n") <= k) & (F.col("d") < float("inf")))
             .select("trial", "list").toPandas())
    rank = np.argsort(nearest(trials, centroids, len(centroids)), axis=1)
    needed = np.sort(rank[found.trial.to_numpy(int), found["list"].to_numpy(int)]) if len(found) else np.zeros(1, int)
    return 1 + int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))])


def search(vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None,
           target: float = 0.97, lists: int | None = None, max_lists: int = 4096, sample_per_list: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``is_query`` (SQL over ``id``) holds."""
    every = written(usable(vectors, id_col, vector_col).withColumn("width", F.size("v")), "vectors")
    widths = sorted(r[0] for r in every.select("width").distinct().collect())
    found = None
    for w in widths:
        part = _search(every.filter(F.col("width") == w).drop("width"), is_query, k, probes, target, lists, max_lists, sample_per_list)
        found = part if found is None else found.unionByName(part)
    return vectors.sparkSession.createDataFrame([], RESULT) if found is None else found


def _search(rows: DataFrame, is_query: str, k: int, probes: int | None, target: float, lists: int | None, max_lists: int, sample_per_list: int) -> DataFrame:
    """``search`` among vectors of one length."""
    total = rows.count()
    lists = max(1, min(max_lists, lists or int(total ** 0.5 / 2), total))
    drawn = min(1.0, 1.25 * sample_per_list * lists / max(1, total))
    drawn_rows = rows.filter(F.expr("pmod(xxhash64(id, v), 1048576)") < int(1048576 * drawn)).select("id", "v").collect() or rows.select(
        "id", "v").limit(lists).collect()
    sample = [r.v for r in drawn_rows]
    centroids = centroids_of(np.array(sample), lists)
    lists, turn = len(centroids), rotation(len(centroids[0]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest(_matrix(b.column("v")), centroids, 1)[:, 0] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near.astype(np.int32))], names=["id", "v", "list"])

    indexed = written(rows.mapInArrow(place, "id long, v array<double>, list int"), "lists")
    held = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}  # a row for each list
    n_of = np.array([held.get(i, 0) for i in range(lists)])
    blocks = np.maximum(1, -(-n_of // BLOCK))

    if probes is None:
        probes = probes_for(indexed, np.array([r.id for r in drawn_rows[:TRIALS]]), np.array(sample[:TRIALS]), centroids, k, target)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest(_matrix(b.column("v")), centroids, lists) if b.num_rows else np.zeros((0, lists), np.int64)
            seen = np.cumsum(n_of[near], axis=1)
            need = np.maximum(min(probes, lists), 1 + (seen < k + 1).sum(1))
            row, col = np.nonzero(np.arange(lists) < np.minimum(need, lists)[:, None])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("v").take(pa.array(row)),
                                              pa.array(near[row, col].astype(np.int32))], names=["id", "v", "list"])

    asked = written(indexed.filter(is_query).select("id", "v").mapInArrow(probe, "id long, v array<double>, list int"), "probes")
    wanted = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    query_blocks = [max(1, -(-wanted.get(i, 0) // QUERY_BLOCK)) for i in range(lists)]
    of_list = lambda values: F.element_at(F.lit([int(x) for x in values]), F.col("list") + 1)
    deal = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    cand = indexed.filter(F.col("list").isin([i for i in wanted])).select(
        "list", deal(of_list(blocks), 1).alias("block"), every(of_list(query_blocks)).alias("query_block"), F.lit(False).alias("asks"), "id", "v")
    ask = (asked.withColumn("query_block", deal(of_list(query_blocks), 2))
           .select("list", every(of_list(blocks)).alias("block"), "query_block", F.lit(True).alias("asks"), "id", "v"))

    def scan_block(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        asks, ids = group.asks.to_numpy(), group.id.to_numpy()
        x = np.array(group.v.tolist(), np.float64)
        turned = x @ turn
        mine, base, base_turned, out = ids[~asks], x[~asks], turned[~asks], []
        for i in np.flatnonzero(asks):
            found, score = scan(x[i], turned[i], ids[i], mine, base, base_turned, k)
            out.append(pd.DataFrame({"query_id": ids[i], "v": [x[i].tobytes()] * len(found), "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "v": [], "vec_id": [], "score": []})

    found = cand.unionByName(ask).groupBy("list", "block", "query_block").applyInPandas(
        scan_block, "query_id long, v binary, vec_id long, score double")
    best = Window.partitionBy("query_id", "v").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "id % 100 = 0")
