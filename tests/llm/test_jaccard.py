import random

import numpy as np
import pytest
from brute_llm import jaccard_classes
from pyspark.sql import functions as F

from cartlens.llm import jaccard


def both(spark, rows):
    got = jaccard.near_duplicates(spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "n long, doc_id long, text string"), tag=F.col("n"))
    want = jaccard_classes(rows)
    return [(r.n_shingles, r.component_id) for r in sorted(got.collect(), key=lambda r: r.tag)], want


def text_of(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force(spark, seed):
    """Near copies at all distances, chains, copies, shared passages and short texts."""
    rng = random.Random(seed)
    rows, passage = [], text_of(rng, 60)
    for g in range(12):
        text = text_of(rng, rng.choice([6, 12, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 6, 12])):
            rows.append(" ".join(text))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(400)}"
    rows += [" ".join(passage + text_of(rng, rng.choice([0, 2, 5, 9, 40]))) for _ in range(25)]
    rows += ["", None, " \t\n", "a", "A", "a b c d", "a  B\nc D", "a b c d e", "a b c d e f"] + rows[:10]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    got, want = both(spark, list(zip(ids, rows)))
    assert got == want


def test_ids_that_are_missing_or_repeat(spark):
    a, b = "one two three four five six seven", "alpha beta gamma delta epsilon"
    got, want = both(spark, [(None, a), (7, a), (7, b), (None, b), (3, a), (None, "alone in the world here"), (None, None), (9, ""), (7, a)])
    assert got == want
    assert got[0] == (3, 3) and got[2][1] == 7 and got[5][1] is None and got[7] == (0, 9)


def test_group_of_near_copies_needs_few_pairs(spark):
    """A large group is linked through hubs; nothing is left that would need its pairs."""
    rng = random.Random(5)
    base = text_of(rng, 300, 10 ** 6)
    rows = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(300)] = f"x{i}"
        rows.append((i + 5, " ".join(t)))
    got, _ = [(r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()], None
    assert set(got) == {5}


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(text_of(rng, 60000, 10 ** 6))
    got, want = both(spark, [(2, long), (1, long + " end"), (3, "a" * 100000)])
    assert got == want


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.v: r.r for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if find(v) != v}


def test_prefix_rule():
    """Any two sets that reach the threshold share what both prefixes ask for."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 300, 1 << jaccard.SKETCH_BITS).astype(float)
    for _ in range(200):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop = rng.integers(0, max(1, n // 4) + 1)
        y = np.unique(np.concatenate([x[rng.permutation(len(x))[drop:]], rng.integers(0, 1 << 63, int(rng.integers(0, 6))).astype(np.uint64)]))
        o = len(np.intersect1d(x, y))
        if not len(y) or 100 * o < 75 * (len(x) + len(y) - o):
            continue
        (dx, px), (dy, py) = (jaccard.choose_prefix(t, counts, 50.0, 75) for t in (x, y))
        need = -(-(len(x) + len(y)) * 75 // 175)
        least = max(min(dx, dy), need - max(len(x) - len(px), len(y) - len(py)))
        assert len(np.intersect1d(px, py)) >= least


def test_query_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(jaccard.OP2_SQL)
    got = jaccard.op2_jaccard(spark, sf).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


@pytest.mark.parametrize("seed", range(2))
def test_nested_texts_and_growing_chains(spark, seed):
    """A long text within a longer one shares few tokens of the longer prefix; most of its own prefix lies behind that one's end."""
    rng = random.Random(seed)
    fresh = iter(range(10 ** 6))

    def words(n):
        return [f"v{next(fresh)}" for _ in range(n)]

    rows, start = [], words(304)
    rows += [start, start + words(100)]
    for n in (304, 340, 600, 1204):
        text, more = words(n), words((n - 4) // 3 - rng.choice([0, 1, 4]))
        at = rng.randrange(n)
        rows += [text, rng.choice([more + text, text + more, text[:at] + more[4:] + text[at:]])]
    for _ in range(3):
        text = start[:200] + words(140)
        for _ in range(4):
            rows.append(text)
            text = text + words((len(text) - 4) // 3 - rng.choice([0, 2]))
    rows.append(start[:200] + words(30))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    got, want = both(spark, [(i, " ".join(t)) for i, t in zip(ids, rows)])
    assert got == want and got[0][1] == got[1][1]
