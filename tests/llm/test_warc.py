import gzip
import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartlens.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows):
    out = []
    for k, url, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        revisit = len(data) >= 1000 and bool(same) and k != max(same)
        out.append((k, "revisit" if revisit else "response", max(same) if revisit else None, len(data), hashlib.sha1(data).hexdigest(), None if revisit else data))
    return sorted(out, key=str)


def read_back(spark, path):
    return sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in warc.read(spark, path).collect()), key=str)


def noise(rng, n):
    """Text that hardly shrinks, so that magics turn up by chance in its compressed form."""
    return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))


def some_pages(rng, n):
    long = [noise(rng, rng.choice([400, 3000])) for _ in range(4)] + ["a" * 1000, "a" * 999]
    rows = [(i, f"http://h/{i} ä\r\nX: 1", rng.choice([None, "", "short", rng.choice(long), noise(rng, rng.randrange(40_000))])) for i in range(n)]
    return rows + [(5, "again", long[0]), (5, "again", long[0]), (None, None, long[0]), (None, None, long[1]), (-3, "minus", "b" * 2000), (None, "u", "b" * 2000)]


@pytest.mark.parametrize("part_bytes", ["2k", "5k", "64k", "128m"])
def test_round_trip_over_any_ranges(spark, tmp_path, part_bytes):
    rows = some_pages(random.Random(1), 40)
    d = spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit(1), "key": F.lit("x")}).repartition(2)
    path = warc.write(d, str(tmp_path / "out"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part_bytes)
    try:
        assert read_back(spark, path) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def cut_into_ranges(data, size):
    """What the text source gives for each range of ``size`` bytes: the pieces whose magic starts in it."""
    at = [i for i in range(len(data)) if data.startswith(warc.MAGIC, i)]
    rows = [("f", 0, True, data[:at[0]])]
    rows += [("f", a // size * size, True, data[a + 2:b]) for a, b in zip(at, [*at[1:], len(data)])]
    return rows


def test_every_range_size(spark):
    """The reader's own steps, without the source: ranges of any size that begin and end anywhere."""
    rng = random.Random(8)
    data = b"".join(warc.member(i, None, noise(rng, rng.choice([0, 5, 300, 3000, 30_000])).encode(), None, False, "d") for i in range(120))
    assert data.count(warc.MAGIC) > 125
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("split", pa.bool_()), ("piece", pa.binary())])
    for size in [64, 200, 999, 1500, 4096, 7777, 30_000, 100_001, 10 ** 7]:
        rows = cut_into_ranges(data, size)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        batches = [batch.slice(i, 37) for i in range(0, len(rows), 37)]
        inside = [r["page_id"] for b in warc.whole_records(iter(batches)) for r in b.to_pylist()]
        cut = spark.createDataFrame(pa.Table.from_batches(list(warc.seams(iter(batches)))).to_pandas(), warc.SEAM)
        outside = [r.page_id for r in warc.stitched(cut).collect()]
        assert sorted(inside + outside) == list(range(120)), size
        assert size != 999 or len(outside) > 10


def test_files_are_plain_gzip_and_magics_occur_by_chance(spark, tmp_path):
    rows = [(i, "u", noise(random.Random(i), 60_000)) for i in range(30)]
    path = warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    data = file.read_bytes()
    assert data.count(warc.MAGIC) > 30
    whole = gzip.decompress(data)
    assert whole.count(b"WARC/1.1\r\n") == 30 and whole.endswith(b"\r\n\r\n")
    assert read_back(spark, path) == brute(rows)


def test_foreign_members(spark, tmp_path):
    """Other writers: gzip header with a name, stored blocks, records without http, other types."""
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    named = b"\x1f\x8b\x08\x08\0\0\0\0\0\x03name\0" + zlib.compress(record, 0, -15) + zlib.crc32(record).to_bytes(4, "little") + len(record).to_bytes(4, "little")
    (tmp_path / "a.warc").write_bytes(named * 3 + gzip.compress(record))
    got = warc.read(spark, str(tmp_path)).collect()
    assert [(r.page_id, r.record_type, r.payload_bytes, bytes(r.payload)) for r in got] == [(None, "warcinfo", 4, b"abcd")] * 4


@pytest.mark.parametrize("bad", [b"no gzip at all", gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabcd\r\n\r\n"), gzip.compress(b"no record")])
def test_broken_archives_are_errors(spark, tmp_path, bad):
    (tmp_path / "bad").write_bytes(bad)
    with pytest.raises(Exception, match="gzip member|size|cannot be unpacked|between"):
        warc.read(spark, str(tmp_path)).collect()


def test_cut_off_record_is_an_error(spark, tmp_path):
    whole = warc.member(1, "u", b"x" * 5000, None, False, "d")
    (tmp_path / "cut").write_bytes(whole + whole[:-9])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, str(tmp_path)).collect()


def test_records_beyond_16_mb(spark, tmp_path):
    rows = [(1, "u", "x" * (1 << 24)), (2, "u", "y" * ((1 << 24) - 300)), (3, "u", "z" * (33 << 20)), (4, "u", "small"), (5, "u", "z" * (33 << 20))]
    d = spark.createDataFrame([(k, u, h[0], len(h)) for k, u, h in rows], "page_id long, url string, c string, n int").selectExpr("page_id", "url", "if(n < 10, 'small', repeat(c, n)) AS html")
    path = warc.write(d, str(tmp_path / "out"))
    got = warc.read(spark, path).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()
    assert sorted((tuple(r) for r in got), key=str) == [b[:5] for b in brute(rows)]


def test_many_groups_of_copies_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(warc, "HOT", 4)
    rows = [(i, "u", "h" * 1500 if i % 3 == 0 else str(i % 20) * 600 if i % 3 == 1 else str(i) * 1000) for i in range(150)] + [(None, None, "s"), (None, "v", "s")]
    path = warc.write(spark.createDataFrame(rows, PAGES), str(tmp_path / "out"))
    assert read_back(spark, path) == brute(rows)


def test_empty_table(spark, tmp_path):
    path = warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "out"))
    assert warc.read(spark, path).count() == 0
