import hashlib
import random

import duckdb
from brute_llm import contamination as brute

from cartlens.llm import contamination

SF = "/root/testdata/sf0.001"


def check(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as N_hit")
    got = contamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "text", *contamination.RESULTS] and got.count() == len(docs)
    for r in got.collect():
        n, hit, found = brute(r.text, items)
        ids = ",".join(sorted(str(k) for k in found if k is not None))
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found - {None})), r
        assert r.items_sha256 == hashlib.sha256(ids.encode()).hexdigest() and r.contaminated == (hit > 0 and 20 * hit >= n)


def test_like_brute_force(spark):
    """Few distinct words, so that windows overlap themselves and each other."""
    rng = random.Random(1)
    text = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(i, text(rng.choice([2, 5, 13, 14, 20, 40]), rng.choice([2, 50, 500]))) for i in range(12)] + [(100, None), (101, "... !!"), (None, text(15, 50)), (3, "repeated id here")]
    docs = []
    for i in range(60):
        parts = [text(rng.choice([0, 3, 30, 200]), rng.choice([2, 50, 500]))]
        for _ in range(rng.choice([0, 1, 2])):
            w = (rng.choice(items)[1] or "").split()
            lo = rng.randrange(len(w) + 1)
            parts.append(rng.choice([" ", "\n", "--"]).join(w[lo:lo + rng.choice([5, 13, 16, 50])]).upper())
        docs.append((i, " ".join(parts)))
    docs += docs[:4] + [(90, None), (91, ""), (None, items[0][1]), (92, "w0 " * 3000), (93, "é" + (items[5][1] or ""))]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [(1, "some words")], [])
    check(spark, [], [(1, "some words")])


def test_repeated_benchmark_rows(spark):
    check(spark, [(1, "a b c d e"), (1, "a b c d e"), (2, "c d")], [(1, "b c"), (1, "b c"), (2, "c d"), (2, "d e")])


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(contamination.OP6_SQL)
    got = contamination.op6_contamination(spark, SF).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall()) and any(r.contaminated for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x rare y z other q"), (2, "other rare"), (3, "rare a b c d e f g h other")], "doc_id long, text string")
    items, terms = contamination.vocabulary(spark.createDataFrame([(7, "rare one other")], "item_id long, text string"), "item_id", "text")
    index = contamination.build_index(contamination.keyed(docs, "text"), terms)
    # "one" occurs nowhere: no window can be looked up.
    assert contamination.proximity(items, terms, index).count() == 0
    items, terms = contamination.vocabulary(spark.createDataFrame([(7, "rare other")], "item_id long, text string"), "item_id", "text")
    index = contamination.build_index(contamination.keyed(docs, "text"), terms)
    found = contamination.proximity(items, terms, index, slop=3)
    assert found.select("key").distinct().count() == 2 and contamination.occurrences(items, terms, index).count() == 0


def test_a_text_that_repeats_an_item_many_times(spark):
    """Cost goes with the occurrences, not with their number times the length of the text."""
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{item} " * 2000), (2, f"x {item} y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in contamination.contamination(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got == {1: (80_000, 80_000, 1), 2: (42, 40, 1)}
