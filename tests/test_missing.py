"""Rows without a key, time or number: as many rows come out as went in."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cartlens.functions import scan
from cartlens.functions.grouped import exact_quantiles, exact_rank
from cartlens.operators import address, journey, lookup

T0 = dt.datetime(2024, 1, 1)
ROWS = [(1, T0, 1, 5.0), (1, T0 + dt.timedelta(hours=1), 2, 3.0), (None, T0, 3, 1.0), (None, T0, 4, None), (2, None, 5, 2.0), (None, None, 6, 2.0), (2, T0, 7, None), (1, None, 8, 4.0)]


@pytest.fixture
def data(spark):
    return spark.createDataFrame(ROWS, "k long, ts timestamp_ntz, id long, x double")


def test_scans_keep_every_row(data):
    chunk = scan.time_chunk("ts", 60)
    ids = {r[2] for r in ROWS}
    known = {1, 2, 7}
    for out, col in ((scan.with_previous(data, ["k"], ["ts", "id"], {"p": "id"}, chunk), "p"), (scan.with_next(data, ["k"], ["ts", "id"], {"p": "id"}, chunk), "p"),
                     (scan.with_running_sum(data, ["k"], ["ts", "id"], {"p": F.col("x")}, chunk), "p"), (scan.with_ordinal(data, ["k"], ["ts", "id"], "p", chunk), "p")):
        got = out.collect()
        assert {r["id"] for r in got} == ids and len(got) == len(ROWS)
        assert all(r[col] is None for r in got if r["id"] not in known)
    assert {r["id"]: r["p"] for r in scan.with_ordinal(data, ["k"], ["ts", "id"], "p", chunk).collect()}[2] == 2


@pytest.mark.parametrize("look", [scan.last_before, scan.first_after])
def test_as_of_keeps_left_rows(spark, data, look):
    right = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=30), 70), (None, T0, 71), (1, None, 72)], "k long, rt timestamp_ntz, r long")
    got = {r["id"]: r["hit"] for r in look(data, right, ["k"], "ts", "rt", {"hit": "r"}, 600).collect()}
    assert len(got) == len(ROWS) and got[2 if look is scan.last_before else 1] == 70 and got[3] is None and got[5] is None


def test_attribution_keeps_signups(spark):
    s = spark.createDataFrame([(1, T0, 10), (None, T0, 11), (2, None, 12)], "k long, s timestamp_ntz, sid long")
    v = spark.createDataFrame([(1, T0 - dt.timedelta(days=1), 20), (None, T0 - dt.timedelta(days=1), 21), (2, T0, 22), (1, None, 23)], "k long, v timestamp_ntz, vid long")
    got = {r["sid"]: r["first_vid"] for r in lookup.touch_attribution(s, v, "k", "sid", "s", "v", "vid", []).collect()}
    assert got == {10: 20, 11: None, 12: None}
    assert {r["sid"]: r["touches"] for r in lookup.touches_in_window(s, v, "k", "sid", "s", "v").collect()} == {10: 1, 11: 0, 12: 0}


def test_look_back_is_in_whole_days(spark):
    day, hour = dt.timedelta(days=1), dt.timedelta(hours=1)
    back = [60 * day, 60 * day + 23 * hour, 61 * day - dt.timedelta(microseconds=1), 61 * day, 61 * day + hour, dt.timedelta(0), dt.timedelta(microseconds=1)]
    s = spark.createDataFrame([(i, T0, i) for i in range(len(back))], "k long, s timestamp_ntz, sid long")
    v = spark.createDataFrame([(i, T0 - b, i) for i, b in enumerate(back)], "k long, v timestamp_ntz, vid long")
    want = {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
    assert {r["sid"]: r["touches"] for r in lookup.touches_in_window(s, v, "k", "sid", "s", "v").collect()} == want
    got = {r["sid"]: (r["first_vid"], r["last_vid"]) for r in lookup.touch_attribution(s, v, "k", "sid", "s", "v", "vid", []).collect()}
    assert got == {i: ((i, i) if n else (None, None)) for i, n in want.items()}


def test_ranks_keep_every_row(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("a", math.nan), ("a", math.inf), ("a", -math.inf), (None, 1.0), (None, None)]
    got = exact_rank(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "up", "down").collect()
    assert sorted(((r["g"], str(r["x"]), r["up"], r["down"]) for r in got), key=str) == sorted([
        ("a", "1.0", 2, 3), ("a", "1.0", 2, 3), ("a", "3.0", 4, 2), ("a", "inf", 5, 1), ("a", "-inf", 1, 5), ("a", "None", None, None), ("a", "nan", None, None),
        (None, "1.0", None, None), (None, "None", None, None)], key=str)


def test_quantiles_leave_nan_out_and_order_infinity(spark):
    probs = {"p0": 0.0, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    for values in ([0.1, 0.2, 5.0, 9.0, math.nan], [1.0, math.inf, -math.inf, 2.0, 3.0], [math.inf, math.inf], [0.0, -0.0, -5.5]):
        d = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, x double")
        want = d.filter(~F.isnan("x") & F.col("x").isNotNull()).selectExpr(*[f"percentile(x, {p})" for p in probs.values()]).head()
        got = exact_quantiles(d, ["g"], "x", probs).select(*probs).head()
        assert [str(abs(v) if v == 0 else v) for v in got] == [str(abs(v) if v == 0 else v) for v in want], values


def test_quantiles_in_one_narrow_range(spark):
    """A million distinct values within one slot: no task orders more than a share of them."""
    n = 1_000_000
    d = spark.range(n).select(F.lit(1).alias("g"), (1 + F.pmod(F.col("id") * 7919, F.lit(n)) * 1e-10).alias("x"))
    got = exact_quantiles(d, ["g"], "x", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).head()
    assert [got["p10"], got["p50"], got["p99"]] == pytest.approx([1 + q * (n - 1) * 1e-10 for q in (0.1, 0.5, 0.99)], abs=1e-14)
    plan = exact_quantiles(d, ["g"], "x", {"p50": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in plan


def test_totals_hold_unlisted_values(spark):
    d = spark.createDataFrame([(1, "x", dt.date(2024, 1, 2)), (2, "other", dt.date(2024, 1, 3)), (3, None, dt.date(2024, 2, 1))], "id long, source_type string, created_date date")
    got = address.address_inventory(d, dt.date(2024, 1, 1), F.date_format("created_date", "yyyy-MM"), ["x"]).orderBy("added").collect()
    assert [(r["x"], r["total"], r["running_total"]) for r in got] == [(1, 2, 2), (0, 1, 3)]
    m = spark.createDataFrame([("e", 1, "ok"), ("e", 2, "lost"), ("e", 3, None), ("e", 4, "ok")], "e string, m long, s string")
    r = journey.delivery_rate(m, "e", "m", "s", ["ok"], "ok").head()
    assert (r["n_ok"], r["total"], r["delivered_rate"]) == (2, 4, 0.5)
