"""Byte-level BPE encoding and decoding in overlapping chunks.

Texts of at most ``CHUNK`` characters are encoded as they are. A longer text is cut into chunks of ``CHUNK`` characters
that each run ``OVERLAP`` characters into the next one. Every chunk is a row and is pre-tokenised on its own.
A place where the pre-token starts of both neighbours agree in the overlap is where they have resynchronised: the pattern looks only
forward, so from there on both give the same pre-tokens. The pieces between such places are encoded alone and their ids joined.
A cut is made only after a character that is not white space; then the pattern's look-ahead sees the same in the piece as in the text.
Where no such place lies in an overlap, the chunk is joined with the next one and cut later.

Null text: no ids, the digests of nothing. Repeated rows and repeated ids give one row each. Clashing columns are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, replace_column, table, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK = 65536
OVERLAP = 2048
#: The seams of all chunks are broadcast if they take no more than this, at so many bytes for each; beyond that the join shuffles.
BROADCAST_BYTES = 16 << 20
SEAM_BYTES = 80
_pattern = regex.compile(public_tokenizers.PATTERN)


@functools.lru_cache(maxsize=2)
def encoder(ranks: str = RANKS) -> tiktoken.Encoding:
    """One encoder for each Python worker and vocabulary file (the file lies on every machine)."""
    with open(ranks, "rb") as lines:
        table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_of, special_tokens={})


def to_bytes(ids: list[int], width: int = 4) -> bytes:
    return np.asarray(ids, f"<u{width}").tobytes()


def decode(ids: bytes, ranks: str = RANKS) -> bytes:
    """Raw bytes of the ids, one after another."""
    return encoder(ranks).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def safe_starts(text: str, lo: int, hi: int) -> list[int]:
    """Pre-token starts in [lo, hi) of ``text`` that follow a character other than white space."""
    return [m.start() for m in _pattern.finditer(text) if lo <= m.start() < hi and m.start() and not text[m.start() - 1].isspace()]


def encode_long(df: DataFrame, chunk: int, overlap: int, ranks: str, width: int) -> DataFrame:
    """(key, text) of long texts, to (key, ids): chunks, their stitches, the pieces, and the ids joined again.

    Only the places of pre-token starts in the overlaps are exchanged between tasks, not the texts.
    """
    step = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int")))
    cut = (df.select("key", "text", step.alias("part"))
           .select("key", "part", F.expr(f"substring(text, part * {chunk} + 1, {chunk + overlap})").alias("text")))

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [safe_starts(t, 0, len(t) - overlap // 4 if len(t) == chunk + overlap else len(t)) for t in b.text]
            yield pd.DataFrame({
                "key": b.key, "part": b.part,
                "head": [[x for x in f if x < overlap] if p else [] for p, f in zip(b.part, found)],
                "tail": [[x - chunk for x in f if x >= chunk] for f in found]})

    # Both neighbours name the starts in their common characters, counted from the later chunk's first one; copies of a text name the same.
    marks = written(cut.mapInPandas(starts, "key binary, part int, head array<int>, tail array<int>").dropDuplicates(["key", "part"]), "marks")
    before = marks.select("key", (F.col("part") + 1).alias("part"), F.col("tail").alias("before"))
    after = marks.select("key", (F.col("part") - 1).alias("part"), F.col("head").alias("after"))
    seams = marks.join(before, ["key", "part"], "left").join(after, ["key", "part"], "left").select(
        "key", "part", F.expr("array_min(array_intersect(head, before))").alias("first"),
        F.expr("array_min(array_intersect(tail, after))").alias("last"), F.col("after").isNull().alias("end"))
    seams = F.broadcast(seams) if marks.count() * SEAM_BYTES <= BROADCAST_BYTES else seams
    ready = cut.join(seams, ["key", "part"]).select("key", "part", "text", "first", "last", "end")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks)
        for b in batches:
            rows = []
            for key, part, text, first, last, end in b.itertuples(index=False):
                lo = 0 if part == 0 or pd.isna(first) else int(first)
                hi = len(text) if end else chunk if pd.isna(last) else chunk + int(last)
                if (part == 0 or pd.notna(first)) and (end or pd.notna(last)):
                    rows.append((key, part, True, to_bytes(enc.encode_ordinary(text[lo:hi]), width), None))
                else:
                    rows.append((key, part, False, None, text[lo:hi]))
            yield pd.DataFrame(rows, columns=["key", "part", "done", "ids", "text"])

    done = ready.mapInPandas(encode, "key binary, part int, done boolean, ids binary, text string").dropDuplicates(["key", "part"])

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Pieces that found no stitch at one side are neighbours: their texts are put together and encoded as one.
        enc, out, rest = encoder(ranks), [], []
        for r in rows.sort_values("part").itertuples(index=False):
            if r.done and not rest:
                out.append(r.ids)
            elif r.done:
                out += [to_bytes(enc.encode_ordinary("".join(rest)), width), r.ids]
                rest = []
            else:
                rest.append(r.text)
        if rest:
            out.append(to_bytes(enc.encode_ordinary("".join(rest)), width))
        return pd.DataFrame({"key": [key[0]], "ids": [b"".join(out)]})

    return done.groupBy("key").applyInPandas(join, "key binary, ids binary")


def encode(docs: DataFrame, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, ranks: str = RANKS,
           width: int = 4) -> DataFrame:
    """``docs`` without its text, plus ``ids``: the token ids as little-endian unsigned integers of ``width`` bytes."""
    if not 16 <= overlap <= chunk:
        raise ValueError("overlap must lie between 16 and chunk")
    keep = [c for c in replace_column(docs, "ids") if c != text_col]
    cols = [F.col(f"`{c}`") for c in keep]
    text = F.col(f"`{text_col}`")
    is_long = F.coalesce(F.length(text), F.lit(0)) > chunk
    short = docs.filter(~is_long).select(*cols, text.alias("__text"))
    schema = short.drop("__text").schema.add("ids", "binary")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for b in pieces(batches, "__text"):
            ids = pa.array([to_bytes(enc.encode_ordinary(t), width) if t else b"" for t in b.column("__text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids], names=[*keep, "ids"])

    key = F.unhex(F.sha2(text, 256)).alias("__key")
    long = docs.filter(is_long)
    ids = encode_long(long.select(key.alias("key"), text.alias("text")), chunk, overlap, ranks, width)
    return short.mapInArrow(plain, schema).unionByName(
        long.select(*cols, key).join(ids.withColumnRenamed("key", "__key"), "__key").select(*cols, "ids"))


def digests(encoded: DataFrame, ranks: str = RANKS, keep_ids: bool = False) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded bytes, for rows that hold ``ids``."""

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: hashlib.sha256(decode(bytes(x), ranks)).hexdigest())

    return encoded.select(
        *[F.col(f"`{c}`") for c in replace_column(encoded, "ids", "n_tokens", "ids_sha256", "decoded_sha256")],
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        decoded("ids").alias("decoded_sha256"), *(["ids"] if keep_ids else []))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
