import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from cartlens.llm import tokens

ROWS = [(1, "Hello  world\n\n it's 12345 naïve  "), (2, ""), (3, None), (4, " \n " * 3000), (5, "a" * 20000), (6, "x  \n\n y'll " * 2000),
        (1, "Hello  world\n\n it's 12345 naïve  "), (None, "no id"), (7, "日本語 текст " * 500), (5, "a" * 20000), (8, "<|endoftext|>")]


def expect(text):
    ids = tokens.encoder().encode_ordinary(text or "")
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (100, 100), (4096, 256)])
def test_chunks_give_the_ids_of_the_whole_text(spark, chunk, overlap):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = tokens.encode(df.withColumn("n", F.length("text")).withColumn("IDS", F.lit("clash")), chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "n", "ids"]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got.collect()), key=key) == sorted(((i, expect(t)) for i, t in ROWS), key=key)


def test_overlap_is_checked(spark):
    with pytest.raises(ValueError):
        tokens.encode(spark.createDataFrame(ROWS, "doc_id long, text string"), chunk=8, overlap=16)


def test_digests_and_round_trip(spark):
    got = tokens.digests(tokens.encode(spark.createDataFrame(ROWS, "doc_id long, text string"))).collect()
    want = {i: (len(expect(t)) // 4, hashlib.sha256(expect(t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS}
    assert len(got) == len(ROWS) and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)


def test_empty_table(spark):
    got = tokens.digests(tokens.encode(spark.createDataFrame([], "doc_id long, text string")))
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
