import hashlib
import os
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute_llm import base_spans, contamination, jaccard_classes

import corpus_pipeline as pipeline
from cartlens.llm import tokens
from cartlens.llm.common import written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    """The smallest tables with rows of every odd kind added."""
    to = tmp_path_factory.mktemp("sf")
    for t in ("labels", "benchmark"):
        os.symlink(f"{SF}/{t}.parquet", to / f"{t}.parquet")
    docs = pq.read_table(f"{SF}/documents.parquet")
    item = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()[0]["text"]
    plain = docs.to_pylist()[1]["text"]
    odd = [(9001, None), (9002, ""), (9003, plain), (9003, plain), (None, plain), (None, "a nameless text of its own with enough words"), (9004, item),
           (9005, plain + " and more"), (9006, "Some words password=abcdef0123456789ab and AKIA" + "Q" * 16 + " after."), (9007, " \n "), (9002, "")]
    more = pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": "en", "source": None, "n_chars": None if t is None else len(t)} for i, t in odd], docs.schema)
    pq.write_table(pa.concat_tables([docs, more]), to / "documents.parquet")
    return str(to)


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_stage_like_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "byte_level_bpe"]

    good = written(steps["quality_classifier"](spark, docs, sf_dir), "t")
    assert good.columns == COLUMNS
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    kept = {r[0] for r in rows_of(good)}
    judged = [(labels[r.doc_id], r.doc_id in kept) for r in docs.collect() if r.doc_id in labels]
    assert sum(q == k for q, k in judged) / len(judged) >= 0.95
    assert {r[:2] for r in rows_of(good)} <= {(r.doc_id, r.text) for r in docs.collect()}

    single = written(steps["ngram_jaccard_join"](spark, good, sf_dir), "t")
    before = rows_of(good)
    classes = jaccard_classes([(r[0], r[1]) for r in before])
    want, groups = [], {}
    for r, (n, c) in zip(before, classes):
        if n:
            groups.setdefault((c, r[1] if c is None else None), []).append(r)
        else:
            want.append(r)
    assert single.columns == COLUMNS
    got = rows_of(single)
    assert len(got) == len(set(want)) + len(groups) or len(got) == len(want) + len(groups)
    for (c, _), members in groups.items():
        assert sum(r in members for r in got) == 1 and (c is None or min(r[0] for r in members if r[0] is not None) in {r[0] for r in got})

    clean = written(steps["benchmark_decontamination"](spark, single, sf_dir), "t")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    hits = [(r, contamination(r[1], items)) for r in rows_of(single)]
    assert by_key(rows_of(clean)) == by_key([r for r, (n, hit, _) in hits if not (hit and 20 * hit >= n)])
    assert any(hit and 20 * hit >= n for _, (n, hit, _) in hits)

    masked = written(steps["secret_scan"](spark, clean, sf_dir), "t")
    assert masked.columns == COLUMNS and masked.schema["n_chars"].dataType == clean.schema["n_chars"].dataType
    old = {(r[0], r[4] if r[1] is None else len(r[1])): r for r in rows_of(clean)}
    assert masked.count() == clean.count() and not any(base_spans(r[1]) for r in rows_of(masked))
    new = {r[0]: r for r in rows_of(masked)}
    assert all(new[r[0]] == r for r in old.values() if r[0] is not None and not base_spans(r[1]) and "[secret]" not in (new[r[0]][1] or ""))
    if 9006 in new:
        assert new[9006][1] == "Some words [secret] and [secret] after." and new[9006][4] == len(new[9006][1])

    last = steps["byte_level_bpe"](spark, masked, sf_dir)
    texts = [(r[0], r[1]) for r in rows_of(masked)]
    ids = [tokens.encoder().encode_ordinary(t or "") for _, t in texts]
    want = sorted((str(k), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest()) for (k, _), x in zip(texts, ids))
    assert sorted((str(r.doc_id), r.ids_sha256) for r in last.collect()) == want
    assert sorted((str(r.doc_id), r.ids_sha256) for r in pipeline.run(spark, sf_dir).collect()) == want


def test_empty_documents(spark, tmp_path):
    for t in ("labels", "benchmark"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    pq.write_table(pq.read_table(f"{SF}/documents.parquet").slice(0, 0), tmp_path / "documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_groups_do_not_hang_on_ids(spark):
    """Unlinked texts with one id all stay; of near copies none of which has an id one stays."""
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(5, " ".join(f"t{k}w{i}" for i in range(20))) for k in range(4)] + [(None, near), (None, near + " end"), (None, near), (None, "alone " * 6), (8, ""), (5, "x y z"), (6, "x y z"), (None, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r[0] or 0, r[1]) for r in rows_of(pipeline.one_of_each(spark, docs, SF)))
    assert [r for r in got if r[0]] == sorted([*rows[:4], (5, "x y z"), (8, "")])
    nameless = [t for i, t in got if not i]
    assert len(nameless) == 2 and "alone " * 6 in nameless and {near, near + " end"} & set(nameless)
