import gzip
import random

import numpy as np
import pytest

from cartlens.llm import flat_tokens as flat
from cartlens.llm import tokens


@pytest.mark.parametrize("block", [1, 7, 64, 10 ** 6])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng, want = random.Random(0), []
    (tmp_path / "in").mkdir()
    for f in range(4):
        docs = [[rng.randrange(flat.END) for _ in range(rng.choice([0, 0, 1, 5, 30, 200]))] for _ in range(20)]
        ids = [x for d in docs for x in (*d, flat.END)]
        if f == 1:
            ids, docs = ids + [5, 6, 7], docs + [[5, 6, 7]]
        np.array(ids, "<u2").tofile(tmp_path / "in" / f"{f}.bin")
        at = 0
        for n, d in enumerate(docs):
            want.append((f"{f}.bin", n, at, len(d)))
            at += len(d) + 1
    (tmp_path / "in" / "empty.bin").touch()
    got = flat.counts(flat.blocks(spark, str(tmp_path / "in"), block=block))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.fixture
def part_bytes(spark):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, old)


def brute(name, data, end, width):
    ids = [int.from_bytes(data[i:i + width], "little") for i in range(0, len(data), width)]
    places = [i for i, x in enumerate(ids) if x == end] + ([len(ids)] if ids and ids[-1] != end else [])
    return [(name, n, a + 1, b - a - 1) for n, (a, b) in enumerate(zip([-1, *places], places))]


@pytest.mark.parametrize("end,width,size,block", [
    (flat.END, 2, 3, 1), (flat.END, 2, 7, 5), (flat.END, 2, 64, 10 ** 6), (flat.END, 2, 10 ** 7, 3), (0, 2, 5, 10 ** 6), (0x5050, 2, 3, 2),
    (10, 1, 4, 3), (flat.END, 4, 3, 1), (flat.END, 4, 50, 7), (0, 4, 3, 10 ** 6), (0x01000100, 4, 7, 1)])
def test_files_are_read_in_byte_ranges_cut_anywhere(spark, tmp_path, part_bytes, end, width, size, block):
    """Bytes of the separator also stand between ids; files begin with a byte order mark or end with a part of a separator."""
    rng, mark, want = random.Random(end + width + size), end.to_bytes(width, "little"), []
    pool = [mark] * 3 + [bytes(rng.choice([*mark, mark[0], 7]) for _ in range(width)) for _ in range(12)] + [b"\r\n\r\n"[:width]]
    for f in range(12):
        data = b"".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 9, 60])))
        if f % 3 == 1:
            data = (flat.BOM + data)[:len(data)] if len(data) > 3 else data
        if f % 3 == 2:
            data += b"\x07" * (width - 1) + mark[:1]
        (tmp_path / f"f {f}+ä%.bin").write_bytes(data)
        want += brute(f"f {f}+ä%.bin", data, end, width)
    part_bytes(size)
    got = flat.counts(flat.blocks(spark, str(tmp_path), block, end, width))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_task_holds_a_whole_file(spark, tmp_path, part_bytes):
    """One large file is searched by several tasks, none of which gets more than its range and the document over the range's end."""
    ids = np.random.default_rng(0).integers(0, flat.END, 400_000)
    ids[::1000] = flat.END
    ids.astype("<u2").tofile(tmp_path / "large.bin")
    part_bytes(100_000)
    cut = flat.blocks(spark, str(tmp_path))
    assert [tuple(r) for r in cut.groupBy("file").agg({"ids": "sum"}).collect()] == [("large.bin", 400_000)]
    assert max(r.ids for r in cut.select("ids").collect()) < 60_000
    want = brute("large.bin", ids.astype("<u2").tobytes(), flat.END, 2)
    assert sorted(map(tuple, flat.counts(cut).collect())) == want


def test_unpacked_file_is_an_error(spark, tmp_path):
    (tmp_path / "some.gz").write_bytes(gzip.compress(np.arange(999, dtype="<u2").tobytes() + bytes(2000)))
    with pytest.raises(Exception, match="not read as it is"):
        flat.blocks(spark, str(tmp_path / "some.gz")).collect()


def test_half_id_is_an_error(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="within an id"):
        flat.blocks(spark, str(tmp_path / "odd.bin")).collect()


def test_written_files_hold_every_document(spark, tmp_path):
    rows = [("some text\n\nwith lines",), ("",), (None,), ("PÄ \n\r" * 900,), ("same",), ("same",), ("x" * 90000,)]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    path = flat.write(df, str(tmp_path / "out"))
    got = sorted(r.n_tokens for r in flat.counts(flat.blocks(spark, path, block=50)).collect())
    assert got == sorted(len(tokens.encoder().encode_ordinary(t or "")) for t, in rows)
    empty = flat.write(df.limit(0), str(tmp_path / "none"))
    assert flat.counts(flat.blocks(spark, empty)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = flat.op8_token_counts(spark, sf).collect()
    assert sorted(r.n_tokens for r in got) == sorted(r.n_tokens for r in tokens.op9_byte_bpe(spark, sf).select("n_tokens").collect())
