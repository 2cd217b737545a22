import zlib

import pytest

from cartlens.llm import sharding

ROWS = ([(i, f"text number {i} " * (i % 17)) for i in range(900)] + [(5000 + i, "copy of one text") for i in range(600)]
        + [(None, None), (None, None), (1, ""), (9, "y" * 40000)] + [(77, "same row")] * 300)


def test_law_and_slots(spark):
    got = sharding.assign(spark.createDataFrame(ROWS, "doc_id long, text string").withColumnRenamed("doc_id", "id"), 8, range_bytes=2000).toPandas()
    assert list(got.columns) == ["id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(got) == len(ROWS)
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 8 and per.max() - per.min() <= 2 * got["size"].max() and (got.law == "bytes").all() and got.grown_shard.isna().all()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in ROWS)
    assert sorted(zip(got["size"], got.text_crc32)) == want


def test_copies_are_spread_when_they_exceed_a_shard(spark):
    got = sharding.assign(spark.createDataFrame([(1, "z" * 100)] * 4000, "doc_id long, text string"), 10, range_bytes=1000).toPandas()
    per = got.groupby("shard").size()
    assert len(per) == 10 and per.max() - per.min() <= 1


@pytest.mark.parametrize("rows", [[], [(1, "only")]])
def test_few_rows(spark, rows):
    assert sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 40).count() == len(rows)


def test_clashing_columns_and_written_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "old", 3) for i in range(50)], "doc_id long, text string, SHARD string, size int")
    got = sharding.assign(df, 4)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    path = sharding.write_shards(df.drop("SHARD", "size"), 4, str(tmp_path / "s"))
    assert spark.read.parquet(path).select("doc_id", "text").exceptAll(df.select("doc_id", "text")).count() == 0
