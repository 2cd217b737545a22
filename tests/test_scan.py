"""Chunked scans must equal plain windows, also when one key holds most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartlens.functions import grouped, scan
from cartlens.functions.grouped import exact_quantiles, exact_rank, latest_per_key, value_slot
from cartlens.operators import facts
from cartlens.operators.stats import rows_to_reach

T0 = dt.datetime(2024, 1, 1)


def skewed(n=600, seed=7):
    """A third of the rows in one key, equal times included."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if i % 3 == 0 else r.randrange(1, 25)
        out.append((key, T0 + dt.timedelta(seconds=r.randrange(0, 40_000)), i, r.choice("abc"), r.randrange(-5, 6)))
    return out


@pytest.fixture
def data(spark):
    return spark.createDataFrame(skewed(), "key long, ts timestamp_ntz, id long, e string, x long")


@pytest.mark.parametrize("seconds", [60, 3600, 10**6])
def test_previous_next_sum_ordinal(data, rows, seconds):
    w = Window.partitionBy("key").orderBy("ts", "id")
    chunk = scan.time_chunk("ts", seconds)
    prev = scan.with_previous(data, ["key"], ["ts", "id"], {"pe": "e", "px": "x"}, chunk).select("id", "pe", "px")
    assert rows(prev) == rows(data.select("id", F.lag("e").over(w), F.lag("x").over(w)))
    nxt = scan.with_next(data, ["key"], ["ts", "id"], {"ne": "e"}, chunk).select("id", "ne")
    assert rows(nxt) == rows(data.select("id", F.lead("e").over(w)))
    run = scan.with_running_sum(data, ["key"], ["ts", "id"], {"s": F.col("x")}, chunk).select("id", "s")
    assert rows(run) == rows(data.select("id", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    pos = scan.with_ordinal(data, ["key"], ["ts", "id"], "n", chunk).select("id", "n")
    assert rows(pos) == rows(data.select("id", F.row_number().over(w)))


@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("seconds", [300, 10**6])
def test_as_of_matches_brute_force(spark, rows, equal, seconds):
    src = skewed(300, 3)
    left = [r for r in src if r[3] == "a"]
    right = [r for r in src if r[3] == "b"]
    right += [(r[0], r[1], 1000 + r[2], "b", 0) for r in left[:40]]   # same instants on both sides
    cols = "key long, ts timestamp_ntz, id long, e string, x long"
    ldf = spark.createDataFrame(left, cols).select("key", "ts", "id")
    rdf = spark.createDataFrame(right, cols).select("key", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    got = rows(scan.last_before(ldf, rdf, ["key"], "ts", "rts", {"hit": "rid"}, seconds, equal, ["rid"]).select("id", "hit"))
    ok = (lambda a, b: a <= b) if equal else (lambda a, b: a < b)
    want = []
    for k, ts, i, *_ in left:
        c = [(r[1], r[2]) for r in right if r[0] == k and ok(r[1], ts)]
        want.append((i, max(c)[1] if c else None))
    assert got == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
    got = rows(scan.first_after(ldf, rdf, ["key"], "ts", "rts", {"hit": "rid"}, seconds, equal, ["rid"]).select("id", "hit"))
    want = []
    for k, ts, i, *_ in left:
        c = [(r[1], r[2]) for r in right if r[0] == k and ok(ts, r[1])]
        want.append((i, min(c)[1] if c else None))
    assert got == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_as_of_independent_columns(spark, rows):
    left = spark.createDataFrame([(1, T0 + dt.timedelta(days=9), 1)], "key long, ts timestamp_ntz, id long")
    right = spark.createDataFrame([(1, T0, 5, None), (1, T0 + dt.timedelta(days=3), None, 7)], "key long, rts timestamp_ntz, a long, b long")
    got = scan.last_before(left, right, ["key"], "ts", "rts", {"la": "a", "lb": "b"}, 86400, independent=True)
    assert rows(got.select("la", "lb")) == [(5, 7)]
    got = scan.last_before(left, right, ["key"], "ts", "rts", {"la": "a", "lb": "b"}, 86400)
    assert rows(got.select("la", "lb")) == [(None, 7)]


def test_latest_per_key_equals_row_number(data, rows):
    w = Window.partitionBy("key").orderBy(F.col("ts").desc(), F.col("id").desc())
    want = data.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("key", "id", "e")
    assert rows(latest_per_key(data, ["key"], ["ts", "id"], ["id", "e"])) == rows(want)


VALUES = [0.0, 0.0, -3.5, -3.5, 1e-9, 7.25, 7.25, 7.25, 1e12, -1e12, 2.0, 2.0000001, None, 5.0, 1024.0, 1023.9999]


def test_value_slot_is_monotone(spark):
    d = spark.createDataFrame([(v,) for v in VALUES if v is not None], "v double").orderBy("v")
    slots = [r[0] for r in d.select(value_slot("v")).collect()]
    assert slots == sorted(slots) and len(set(slots)) > 8


@pytest.mark.parametrize("per_octave", [1, 512])
def test_exact_quantiles(spark, per_octave):
    import numpy as np
    r = random.Random(11)
    src = [("hot", r.choice([r.random() * 1000, float(r.randrange(5)), -r.random()])) for _ in range(500)]
    src += [("one", 4.0)] + [("mix", v) for v in VALUES]
    d = spark.createDataFrame(src, "g string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for row in exact_quantiles(d, ["g"], "v", probs, per_octave=per_octave).collect():
        vals = [v for g, v in src if g == row["g"] and v is not None]
        for n, p in probs.items():
            assert row[n] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)
    whole = exact_quantiles(d, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(float(np.quantile([v for _, v in src if v is not None], 0.5)))


def test_crowded_doubles_are_cut_by_digits(spark, monkeypatch):
    """Values within 1e-9 of each other and one far off: parts stay small, results exact."""
    import numpy as np
    monkeypatch.setattr(grouped, "SLOT_LEVELS", 20)
    r = random.Random(2)
    src = [("near", 1 + i * 2.0 ** -52 * r.choice([1, 3])) for i in range(400)] + [("near", 1.0019)] + [("neg", -7.25 - i * 1e-12) for i in range(300)]
    src += [("tiny", i * 5e-324) for i in range(100)] + [("huge", 1.7e308 + i * 1e295) for i in range(100)] + [("ends", v) for v in (float("inf"), float("-inf"), 0.0, 1.0)]
    src += [("wide", r.choice([-1, 1]) * r.random() * 10.0 ** r.randrange(-300, 300)) for _ in range(300)]
    probs = {"p0": 0.0, "p10": 0.1, "p37": 0.37, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {x["g"]: x for x in exact_quantiles(spark.createDataFrame(src, "g string, v double"), ["g"], "v", probs).collect()}
    for g in ("near", "neg", "tiny", "huge", "wide"):
        vals = sorted(v for k, v in src if k == g)
        for n, p in probs.items():
            at = p * (len(vals) - 1)
            lo, hi = vals[int(np.floor(at))], vals[int(np.ceil(at))]
            assert lo <= got[g][n] <= hi and got[g][n] == pytest.approx(lo + (hi - lo) * (at - np.floor(at)), rel=1e-15)
    assert got["ends"]["p0"] == float("-inf") and got["ends"]["p100"] == float("inf")


def test_digits_are_monotone(spark):
    r = random.Random(4)
    vals = sorted({s * v for s in (1, -1) for e in (-1074, -1022, -1, 0, 1, 52, 1023) for v in (2.0 ** e, 2.0 ** e * 1.25, 2.0 ** e * (1 + r.random())) if v != float("inf")})
    slot = value_slot("v")
    for shift in (0, 14, 28):
        d = spark.createDataFrame([(v,) for v in vals], "v double").orderBy("v").select(slot, grouped.slot_digits(F.col("v"), slot, 512, shift)).collect()
        pairs = [tuple(x) for x in d]
        assert pairs == sorted(pairs) and (shift or len(set(pairs)) == len(vals))


def with_gaps(spark):
    r = random.Random(6)
    src = [(k if r.random() < .8 else None, t if r.random() < .8 else None, i, e, x) for k, t, i, e, x in skewed(400)]
    return spark.createDataFrame(src + src[:5], "key long, ts timestamp_ntz, id long, e string, x long")


@pytest.mark.parametrize("once", [False, True])
def test_several_definitions_in_one_scan(spark, rows, once):
    d = with_gaps(spark)
    chunk, order = scan.time_chunk("ts", 3000), ["ts", "id", "x"]
    defs = [scan.previous(order, {"pe": "e"}), scan.following(order, {"ne": "e"}), scan.running({"s": F.col("x"), "n": F.lit(1)}), scan.gaps("g1", "ts", 60), scan.gaps("g2", "ts", 600)]
    got = scan.scan_all(d, ["key"], [F.col(c) for c in order], chunk, defs, once)
    w = Window.partitionBy("key").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    far = lambda s: F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) < s * 10**6, 0).otherwise(1)
    known = d.filter("key IS NOT NULL AND ts IS NOT NULL")
    plain = known.withColumns({"f1": far(60), "f2": far(600)}).select(
        *d.columns, F.lag("e").over(w), F.lead("e").over(w), F.sum("x").over(run), F.row_number().over(w), F.sum("f1").over(run), F.sum("f2").over(run))
    rest = d.filter("key IS NULL OR ts IS NULL").select(*d.columns, *[F.lit(None)] * 6)
    assert rows(got) == rows(plain.union(rest))


def test_two_sessionisations_read_and_shuffle_the_source_once(spark, tmp_path):
    d = with_gaps(spark).select("key", F.col("e").alias("device_id"), F.to_date("ts").alias("dt"), "ts", "id")
    d.write.parquet(str(tmp_path / "e"))
    out = facts.sessionize_many(spark.read.parquet(str(tmp_path / "e")), ["key", "dt", "device_id"], "ts", "id", {"a": 60, "b": 600}, once=True)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1
    assert out.count() == d.count()


def test_names_of_definitions_may_not_clash(spark):
    d = with_gaps(spark)
    with pytest.raises(ValueError, match="two definitions"):
        scan.scan_all(d, ["key"], [F.col("ts")], scan.time_chunk("ts", 60), [scan.gaps("g", "ts", 60), scan.gaps("g", "ts", 90)])


def test_rank_keeps_rows_without_one(spark, rows):
    d = with_gaps(spark).select("key", "id", F.when(F.col("x") != 2, F.col("x").cast("double")).alias("x")).withColumn("x", F.when(F.col("x") == 3, float("nan")).otherwise(F.col("x")))
    known = d.filter("key IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    got = exact_rank(d, ["key"], "x", "up", "down").drop("x")
    w = Window.partitionBy("key")
    want = known.select("key", "id", F.rank().over(w.orderBy("x")), F.rank().over(w.orderBy(F.col("x").desc())))
    assert rows(got) == rows(want.union(d.join(known, ["id"], "left_anti").select("key", "id", F.lit(None), F.lit(None))))


def test_exact_rank(data, rows):
    up = exact_rank(data.select("id", "key", "x"), ["key"], "x", "r").select("id", "r")
    assert rows(up) == rows(data.select("id", F.rank().over(Window.partitionBy("key").orderBy("x"))))
    down = exact_rank(data.select("id", "key", "x"), ["key"], "x", down="r").select("id", "r")
    assert rows(down) == rows(data.select("id", F.rank().over(Window.partitionBy("key").orderBy(F.col("x").desc()))))


def test_rows_to_reach_brute_force(spark):
    from decimal import Decimal
    r = random.Random(5)
    src = [(g, Decimal(r.randrange(-40, 60)) / 8) for g in ("a", "b") for _ in range(60)]
    src += [("neg", -v) for g, v in src if g == "a"] + [("flat", Decimal(2))] * 10
    d = spark.createDataFrame(src, "g string, v decimal(18,4)")
    for row in rows_to_reach(d, ["g"], "v", 0.8).collect():
        vals = [v for g, v in src if g == row["g"]]
        total = sum(vals)
        run, n = Decimal(0), 0
        for v in sorted((v if total > 0 else -v for v in vals), reverse=True):
            run += v
            n += run <= abs(total) * Decimal("0.8")
        assert (row["rows_needed"], row["rows_total"]) == (n, len(vals))
