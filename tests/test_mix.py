import itertools
import random

import pytest
from pyspark.sql import functions as F

from cartlens.operators import mix

DIMS = ["a", "b", "c"]


def leaves(seed):
    """Random leaf rows with zero opens in either period, new and vanished leaves;
    dimension c has one value."""
    r = random.Random(seed)
    out = []
    for a, b in itertools.product("xyz", "pqrs"):
        if r.random() < 0.2:
            continue
        o0, o1 = (0 if r.random() < 0.25 else r.randrange(1, 200)), (0 if r.random() < 0.25 else r.randrange(1, 200))
        if o0 + o1:
            out.append((a, b, "only", o0, o1, r.randrange(0, o0 + 1), r.randrange(0, o1 + 1)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, c string, open_pre long, open_post long, submit_pre long, submit_post long")


def step_by_step(rows):
    """The definition: shares level by level, replaced by the new period's one after
    the other; after an empty prefix the new shares stand for the old ones."""
    n0, n1 = sum(r[3] for r in rows), sum(r[4] for r in rows)
    out = {}
    for r in rows:
        s0, s1 = [], []
        for i in range(3):
            up0 = sum(q[3] for q in rows if q[:i] == r[:i])
            up1 = sum(q[4] for q in rows if q[:i] == r[:i])
            in0 = sum(q[3] for q in rows if q[:i + 1] == r[:i + 1])
            in1 = sum(q[4] for q in rows if q[:i + 1] == r[:i + 1])
            s0.append(in0 / up0 if up0 else 0.0)
            s1.append(in1 / up1 if up1 else 0.0)
        for i in range(3):
            if s0[i] == 0:
                s0[i + 1:] = s1[i + 1:]
                break
        cr0 = r[5] / r[3] if r[3] else 0.0
        cr1 = r[6] / r[4] if r[4] else 0.0
        opens = [n0 * s0[0] * s0[1] * s0[2] if r[3] else 0.0]
        for i in range(3):
            v = n0
            for j in range(3):
                v *= s1[j] if j <= i else s0[j]
            opens.append(v)
        impacts = [(opens[i + 1] - opens[i]) * cr0 / n0 for i in range(3)]
        out[r[:3]] = (impacts, (cr1 - cr0) * opens[-1] / n0, opens)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closed_form_equals_steps_and_adds_up(spark, seed):
    src = leaves(seed)
    parts = mix.mix_decompose(frame(spark, src), DIMS).collect()
    want = step_by_step(src)
    n0, n1 = sum(r[3] for r in src), sum(r[4] for r in src)
    for p in parts:
        impacts, conv, opens = want[(p["a"], p["b"], p["c"])]
        assert [p["a_impact"], p["b_impact"], p["c_impact"]] == pytest.approx(impacts, abs=1e-12)
        assert p["conversion_impact"] == pytest.approx(conv, abs=1e-12)
        assert p["mix_opens"] == pytest.approx(opens[-1], abs=1e-9)
    total = sum(p[f"{d}_impact"] for p in parts for d in DIMS) + sum(p["conversion_impact"] for p in parts)
    assert total == pytest.approx(sum(r[6] for r in src) / n1 - sum(r[5] for r in src) / n0, abs=1e-12)
    assert sum(p["mix_opens"] for p in parts) == pytest.approx(n0)
    assert all(p["c_impact"] == pytest.approx(0, abs=1e-12) for p in parts)   # one value cannot shift


def test_summary_runs_from_old_to_new_rate(spark):
    src = leaves(4)
    s = {r["feature"]: r["impact"] for r in mix.mix_summary(mix.mix_decompose(frame(spark, src), DIMS), DIMS).collect()}
    assert s["Pre_CR"] + s["a"] + s["b"] + s["c"] + s["conversion"] == pytest.approx(s["Post_CR"])


@pytest.mark.parametrize("by", [["a"], ["a", "b"]])
def test_volume_plus_rate_is_total(spark, by):
    src = [r for r in leaves(5) if r[3] and r[4]]
    out = mix.vol_rate_impact(frame(spark, src), by).collect()
    for r in out:
        assert r["vol_impact"] + r["rate_impact"] == pytest.approx(r["total_impact"])
    n0, n1 = sum(r[3] for r in src), sum(r[4] for r in src)
    assert sum(r["total_impact"] for r in out) == pytest.approx(sum(r[6] for r in src) / n1 - sum(r[5] for r in src) / n0)


def test_explain_impact_brute_force(spark):
    src = [(a, b, c, 100, 100, 60, 60 - i * 3) for i, (a, b, c) in enumerate(itertools.product("xy", "pqr", "mn"))]
    parts = mix.mix_decompose(frame(spark, src), DIMS)
    got = {r["features"]: (r["rows_needed"], r["rows_total"]) for r in mix.explain_impact(parts, DIMS).collect()}
    vals = {(r["a"], r["b"], r["c"]): round(r["conversion_impact"], 12) for r in parts.collect()}
    want = {}
    for k in (1, 2, 3):
        for sub in itertools.combinations(range(3), k):
            g = {}
            for key, v in vals.items():
                sk = tuple(key[i] for i in sub)
                g[sk] = round(g.get(sk, 0) + v, 12)
            total = sum(g.values())
            run, n = 0.0, 0
            for v in sorted((v if total > 0 else -v for v in g.values()), reverse=True):
                run = round(run + v, 12)
                n += run <= abs(total) * 0.8 + 1e-13
            if n not in (0, 1) and n != len(g):
                want["+".join(DIMS[i] for i in sub)] = (n, len(g))
    assert got == want


def test_leaf_table_fills_missing_periods(spark, rows):
    d = spark.createDataFrame([("x", "Prev", 1, 1), ("x", "Prev", 1, 0), ("y", "Post", 1, 1)], "a string, p string, o int, s int")
    assert rows(mix.leaf_table(d, ["a"], "p", "Prev", "Post", "o", "s")) == [("x", 2, 0, 1, 0), ("y", 0, 1, 0, 1)]


def test_shares_are_of_the_whole(spark):
    out = mix.vol_rate_impact(frame(spark, leaves(6)), ["a"]).agg(F.sum("share_pre"), F.sum("share_post")).first()
    assert out[0] == pytest.approx(1) and out[1] == pytest.approx(1)
