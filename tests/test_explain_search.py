import itertools
import random

import pytest

from cartlens.operators import mix


def frame(spark, rows, n):
    return spark.createDataFrame(rows, ", ".join(f"d{i} string" for i in range(n)) + ", conversion_impact double")


def noisy(seed, n, size):
    r = random.Random(seed)
    # d1 follows d0, and values are missing now and then.
    out = []
    for _ in range(size):
        v = [r.choice(["a", "b", "c", None])] + [None] + [r.choice("xyz"[:2 + i % 2]) for i in range(n - 2)]
        v[1] = {"a": "p", "b": "p", "c": "q", None: None}[v[0]]
        out.append((*v, r.choice([-1, 1, 2, 4]) * r.random() / 100))
    return out


def brute(src, n, most, share=0.8):
    """(rows needed, rows) of each subset, by the definition."""
    every = {}
    for k in range(n + 1):
        for sub in itertools.combinations(range(n), k):
            g = {}
            for row in src:
                key = tuple(row[i] for i in sub)
                g[key] = g.get(key, 0) + round((row[n] or 0) * 10 ** 12)
            total = sum(g.values())
            run, need = 0, 0
            for v in sorted((v if total > 0 else -v for v in g.values()), reverse=True):
                run += v
                need += run * 10 <= abs(total) * round(share * 10)
            every[sub] = need, len(g)
    free = [s for s in every if s and all(every[t][1] != every[s][1] for t in itertools.combinations(s, len(s) - 1))] if src else []
    return {"+".join(f"d{i}" for i in s): every[s] for s in free if 2 <= every[s][0] <= most and every[s][0] != every[s][1]}


@pytest.mark.parametrize("seed,most", [(1, 100), (2, 5), (3, 3)])
def test_equals_every_subset(spark, seed, most):
    src = noisy(seed, 6, 60)
    want = brute(src, 6, most)
    got = {r["features"]: (r["rows_needed"], r["rows_total"]) for r in mix.search_explanations(frame(spark, src, 6), [f"d{i}" for i in range(6)], most).collect()}
    assert got == want and want


def test_negative_total_and_repeated_leaves(spark):
    src = [(*r[:4], -abs(r[4]) * 2 if i % 3 else r[4]) for i, r in enumerate(noisy(5, 4, 80))] * 2
    got = {r["features"]: (r["rows_needed"], r["rows_total"]) for r in mix.search_explanations(frame(spark, src, 4), [f"d{i}" for i in range(4)], 6).collect()}
    assert got == brute(src, 4, 6) and got


@pytest.mark.parametrize("src", [[], [("a", "x", 0.5), ("b", "y", -0.5)], [("a", "x", None)]])
def test_nothing_to_explain(spark, src):
    out = mix.search_explanations(frame(spark, src, 2), ["d0", "d1"])
    assert out.columns == ["features", "rows_needed", "rows_total", "share_needed", "weight"] and out.collect() == []


def test_twenty_dimensions_stop_early(spark, monkeypatch):
    r = random.Random(7)
    # Seven rows of d0 explain the most; everything else spreads the impact evenly over many values.
    src = [(str(i % 9), *[str(r.randrange(12)) for _ in range(19)], (10 if i % 9 < 7 else 1) / 1000) for i in range(400)]
    tried = []
    real = mix._rows_of_sets
    monkeypatch.setattr(mix, "_rows_of_sets", lambda leaf, dims, sets, *rest: tried.extend(sets) or real(leaf, dims, sets, *rest))
    got = {x["features"]: x["rows_needed"] for x in mix.search_explanations(frame(spark, src, 20), [f"d{i}" for i in range(20)], 6).collect()}
    one = brute([(row[0], row[20]) for row in src], 1, 6)
    assert got.get("d0") == one["d0"][0]
    assert len(tried) < 250   # of 1,048,575


@pytest.mark.parametrize("share,most", [(0, 3), (1, 3), (0.5, 0)])
def test_wrong_parameters(spark, share, most):
    with pytest.raises(ValueError):
        mix.search_explanations(frame(spark, [], 2), ["d0", "d1"], most, share)
