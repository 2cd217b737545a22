import numpy as np
import pyarrow.parquet as pq

from cartlens.llm import neighbours


def brute(ids, x, k):
    out = {}
    for q in np.flatnonzero(np.array(ids) % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[np.array(ids) == ids[q]] = np.inf
        order = np.lexsort([ids, d])[:k]
        out[ids[q]] = [(int(ids[i]), d[i]) for i in order if np.isfinite(d[i])]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    out = {}
    for r in neighbours.search(df, "id % 100 = 0", **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    want = brute(t["vec_id"], np.array(t["embedding"], float), 10)
    got = {}
    for r in neighbours.op10_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in got)
    assert np.mean([len(dict(got[q]).keys() & dict(want[q]).keys()) / 10 for q in want]) >= 0.9
    for q in got:
        true = dict(want[q])
        assert all(abs(s - true[v]) < 1e-9 for v, s in got[q] if v in true) and got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))


def test_all_lists_give_the_exact_result(spark):
    """Ties, a vector that a third of all rows share, and blocks of one list."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[::3] = x[0]
    ids = rng.permutation(3000)
    got = run(spark, [(int(i), v.tolist(), "c") for i, v in zip(ids, x)], lists=6, probes=6)
    want = brute(ids, x.astype(float), 10)
    hits = [len(dict(got[q]).keys() & dict(want[q]).keys()) / 10 for q in want]
    assert got.keys() == want.keys() and np.mean(hits) >= 0.97
    for q in want:
        if q in set(ids[::3]):
            assert [v for v, _ in got[q]] == [v for v, _ in want[q]]


def test_rows_that_take_no_part(spark):
    good = [(i, [float(i), 1.0]) for i in (0, 1, 2, 100, 200)]
    bad = [(3, None), (4, [0.0, 0.0]), (300, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (400, [0.0, 0.0])]
    got = run(spark, [(*r, None) for r in good + bad + good[:2]], lists=3)
    assert got.keys() == {0, 100, 200}
    assert [v for v, _ in got[0]] == [1, 2, 100, 200] and got[0][0][1] == 1.0
    assert run(spark, []) == {} and run(spark, [(0, [1.0], None)]) == {}


def test_small_vectors_are_probed_like_others(spark):
    x = np.random.default_rng(4).standard_normal((1500, 16)).astype(np.float32)
    x *= np.float32(2.0 ** -20)
    want = brute(list(range(1500)), x.astype(float), 10)
    got = run(spark, [(i, v.tolist(), "") for i, v in enumerate(x)])
    assert np.mean([len(dict(got[q]).keys() & dict(want[q]).keys()) / 10 for q in want]) >= 0.9


def test_each_length_is_searched_by_itself(spark):
    rows = [(i, [float(i), 1.0], None) for i in (0, 1, 2, 100)] + [(i, [1.0, 2.0, float(i)], None) for i in (5, 6, 200)] + [(300, [1.0], None)]
    got = run(spark, rows)
    assert {q: [v for v, _ in near] for q, near in got.items()} == {0: [1, 2, 100], 100: [2, 1, 0], 200: [6, 5]}


def test_a_query_finds_other_vectors_of_its_id(spark):
    got = run(spark, [(100, [1.0, 0.0], "a"), (100, [1.0, 0.5], "b"), (7, [1.0, 3.0], "c"), (100, [1.0, 0.0], "a")])
    assert sorted(got[100]) == sorted([(100, 0.5), (7, 3.0), (100, 0.5), (7, 2.5)])
