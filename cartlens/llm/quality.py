"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A word is a run of letters, digits and bytes above 127, or a run of other characters that are not white space. Three families of n-grams
are hashed: words, pairs of words, and triples of word shapes (capital, upper, lower, with digits, repeats one of the last two words; punctuation
stands for itself). The shapes carry over to words that training never saw. A feature's value is its share of the text's n-grams of its family, times
a constant. A score is the sparse dot product of these values and the weights, through the logistic function.

Training reads a bounded sample of labelled rows (``max_rows``, chosen by a hash of the id). The sample is dealt into ``shards``; each
runs the updates over its rows ``epochs`` times in a fixed order, and the weights are averaged. Scores read nothing but the text.

Null and empty texts have no features and get the score of the bias. Null labels are left out; of several labels for one id the mean decides.
Rows without an id are never trained on. Without labelled rows every score is 0.5. Repeated rows are scored each; a clashing ``score`` column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_pieces, mix, replace_column, runs, span_hashes, table, utf8

SCALE = 10.0
FAMILIES = 3


def _byte_class() -> np.ndarray:
    """0 white space, 1 other, 2 lower or above 127, 3 digit, 4 upper."""
    kind = np.ones(256, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[128:] = kind[97:123] = 2
    kind[48:58] = 3
    kind[65:91] = 4
    return kind


BYTE_CLASS = _byte_class()


def features(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows: (row of each, bucket of each family in columns, -1 where there is none)."""
    kind = BYTE_CLASS[data]
    word, space = kind >= 2, kind == 0
    starts, ends = runs(word, bounds)
    others = runs(~word & ~space, bounds)
    is_word = np.concatenate([np.ones(len(starts), bool), np.zeros(len(others[0]), bool)])
    starts, ends = np.concatenate([starts, others[0]]), np.concatenate([ends, others[1]])
    order = np.argsort(starts, kind="stable")
    starts, ends, is_word = starts[order], ends[order], is_word[order]
    row = np.searchsorted(bounds, starts, "right") - 1
    # Rows without bytes share their bound with the next row; the last of them holds the bytes.
    h = span_hashes(data, starts, ends)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    uppers, digits = count(kind == 4), count(kind == 3)
    n_up, n_dig = uppers[ends] - uppers[starts], digits[ends] - digits[starts]
    same = np.zeros(len(h), bool)
    same[1:] |= (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    same[2:] |= (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    shape = np.where(n_dig > 0, 4, np.where(n_up == 0, 1, np.where(n_up == 1, 2, 3))) + 8 * (same & is_word)
    shape = np.where(is_word, shape.astype(np.uint64), h)
    size, mask = len(h), np.uint64((1 << bits) - 1)
    out = np.full((size, FAMILIES), -1, np.int64)
    out[:, 0] = (h & mask).astype(np.int64)
    two = row[1:] == row[:-1]
    out[1:, 1][two] = (mix(h[1:] * np.uint64(3) + h[:-1] * np.uint64(5) + np.uint64(1)) & mask).astype(np.int64)[two]
    if size > 2:
        three = row[2:] == row[:-2]
        s = mix(shape[2:] * np.uint64(7) + mix(shape[1:-1] * np.uint64(11) + mix(shape[:-2] + np.uint64(13))))
        out[2:, 2][three] = (s & mask).astype(np.int64)[three]
    return row, out


@dataclass
class Model:
    bits: int
    bias: float
    weights: np.ndarray  # one for each bucket

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row, grams = features(data, bounds, self.bits)
        total = np.full(len(bounds) - 1, self.bias)
        for k in range(FAMILIES):
            have = grams[:, k] >= 0
            at = row[have]
            n = np.bincount(at, minlength=len(total))
            total += SCALE * np.bincount(at, self.weights[grams[have, k]], len(total)) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _ftrl(rows: pd.DataFrame, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader over one shard's rows, in the order of their hashes. The last slot is the bias."""
    rows = rows.sort_values(["order", "text"])
    examples = []
    for text, y in zip(rows.text, rows.quality):
        data = np.frombuffer((text or "").encode(), np.uint8)
        _, grams = features(data, np.array([0, len(data)]), bits)
        idx, value = [], []
        for k in range(FAMILIES):
            u, c = np.unique(grams[grams[:, k] >= 0, k], return_counts=True)
            idx.append(u)
            value.append(SCALE * c / max(1, c.sum()))
        idx, value = np.concatenate(idx), np.concatenate(value)
        uniq, back = np.unique(idx, return_inverse=True)
        examples.append((np.append(uniq, 1 << bits), np.append(np.bincount(back, value, len(uniq)), 1.0), y))
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for idx, value, y in examples:
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] = zi + g - sigma * w
            n[idx] = ni + g * g
    w = weights(z, n)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 16000, shards: int = 8, epochs: int = 3, alpha: float = 0.5,
          beta: float = 0.1, l1: float = 0.01, l2: float = 0.001, learn: str = "crc32(cast(doc_id as string)) % 3 <> 1") -> Model:
    """Model from (doc_id, text) and (doc_id, quality), from at most about ``max_rows`` labelled rows for which ``learn`` holds.

    Where many rows carry one labelled id, rows are chosen by a hash of id and text, equal rows count once, and they are dealt to the shards by that hash.
    """
    marked = (labels.filter("doc_id is not null and quality is not null").filter(learn)
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("quality"))
              .withColumn("order", F.xxhash64("doc_id")))
    found = marked.count()
    if found > max_rows:
        marked = marked.filter(F.expr("pmod(`order`, 1048576)") < int(1048576 * max_rows / found))
    sample = docs.select("doc_id", "text").join(marked, "doc_id")
    rows = docs.select("doc_id").join(marked, "doc_id").count()
    if rows > 1.05 * max_rows:
        sample = sample.withColumn("order", F.xxhash64("doc_id", "text")).filter(F.expr("pmod(`order`, 1048576)") < int(1048576 * max_rows / rows)).dropDuplicates(["doc_id", "text"])
    sample = sample.withColumn("shard", F.expr(f"pmod(shiftright(`order`, 24), {shards})"))

    def learn_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, bias = _ftrl(rows, bits, epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        return pd.DataFrame({"bias": [bias], "at": [at.astype("<i4").tobytes()], "w": [w[at].astype("<f8").tobytes()]})

    total, bias = np.zeros(1 << bits), 0.0
    # At most ``shards`` rows of at most 2**bits weights each.
    parts = sample.groupBy("shard").applyInPandas(learn_shard, "bias double, at binary, w binary").collect()
    for p in sorted(parts, key=lambda p: (p.bias, bytes(p.w))):
        total[np.frombuffer(p["at"], "<i4")] += np.frombuffer(p.w, "<f8")
        bias += p.bias
    return Model(bits, bias / max(1, len(parts)), total / max(1, len(parts)))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and ``score``."""
    keep = replace_column(docs.select(*[f"`{c}`" for c in keep]) if keep is not None else docs, "score")

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return in_pieces(text, lambda part: pa.array(model.score(*utf8(part))))

    return docs.select(*[F.col(f"`{c}`") for c in keep], score(F.col(f"`{text_col}`")).alias("score"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(True))
    return with_score(docs, model, keep=["doc_id"]).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
