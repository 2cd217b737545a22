import datetime as dt
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartlens.operators import facts

DAY = dt.datetime(2024, 1, 1, 10)


def at(s, base=DAY):
    return base + dt.timedelta(seconds=s)


EV = "id long, m long, dt date, device_id string, ts timestamp_ntz"


def events(spark, times, device="d"):
    return spark.createDataFrame([(i, 1, t.date(), device, t) for i, t in enumerate(times)], EV)


def numbers(df):
    return [r["session_no"] for r in facts.sessionize(df, ["m", "dt", "device_id"], "ts", "id").orderBy("ts", "id").collect()]


def test_gap_of_exactly_thirty_minutes_splits(spark):
    assert numbers(events(spark, [at(0), at(1799)])) == [1, 1]
    assert numbers(events(spark, [at(0), at(1800)])) == [1, 2]
    assert numbers(events(spark, [at(0), at(1801)])) == [1, 2]


def test_equal_times_and_midnight(spark):
    assert numbers(events(spark, [at(0), at(0), at(0)])) == [1, 1, 1]
    late = dt.datetime(2024, 1, 1, 23, 59, 50)
    assert numbers(events(spark, [late, late + dt.timedelta(seconds=20)])) == [1, 1]   # a new date starts again at 1


def test_missing_device_has_no_session_and_no_row_is_lost(spark):
    d = events(spark, [at(0), at(10)]).unionByName(
        spark.createDataFrame([(7, 1, dt.date(2024, 1, 1), None, at(5)), (8, None, dt.date(2024, 1, 1), "d", at(5)), (9, 1, None, "d", None)], EV))
    out = {r["id"]: r["session_id"] for r in facts.sessionize(d, ["m", "dt", "device_id"], "ts", "id").collect()}
    assert out == {0: "1-2024-01-01-d", 1: "1-2024-01-01-d", 7: None, 8: None, 9: None}


@pytest.mark.parametrize("chunk", [60, 1800, 86400])
def test_hot_device_equals_plain_window(spark, rows, chunk):
    import random
    r = random.Random(2)
    src = [(i, 1, DAY.date(), "hot" if i % 3 else f"d{r.randrange(9)}", at(r.randrange(0, 50_000))) for i in range(500)]
    d = spark.createDataFrame(src, EV)
    w = Window.partitionBy("m", "dt", "device_id").orderBy("ts", "id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    plain = d.withColumn("s", F.when(gap < 1800 * 10**6, 0).otherwise(1)).select("id", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = facts.sessionize(d, ["m", "dt", "device_id"], "ts", "id", chunk_seconds=chunk).select("id", "session_no")
    assert rows(got) == rows(plain)


FACT = "k string, open int, paid int, day date"


def test_upsert_merges_and_is_idempotent(spark, rows):
    old = spark.createDataFrame([("a", 1, 0, dt.date(2024, 1, 1)), ("b", 1, 0, dt.date(2024, 1, 1)), ("c", 0, 0, dt.date(2024, 1, 2))], FACT)
    new = spark.createDataFrame([("a", 0, 1, dt.date(2024, 1, 2)), ("d", 1, 1, dt.date(2024, 1, 2)), ("d", 0, 1, dt.date(2024, 1, 1))], FACT)
    want = [("a", 1, 1, dt.date(2024, 1, 1)), ("b", 1, 0, dt.date(2024, 1, 1)), ("c", 0, 0, dt.date(2024, 1, 2)), ("d", 1, 1, dt.date(2024, 1, 1))]
    once = facts.upsert_fact(old, new, "k", ["open", "paid"], ["day"])
    assert rows(once) == want
    assert rows(facts.upsert_fact(once, new, "k", ["open", "paid"], ["day"])) == want
    assert rows(facts.merge_new_rows(old, new, "k", ["open", "paid"], ["day"])) == want


def test_day_by_day_equals_all_days(spark, rows):
    import random
    r = random.Random(4)
    src = [(f"c{r.randrange(30)}", r.choice(["open", "paid"]), dt.date(2024, 1, 1 + r.randrange(6))) for _ in range(300)]
    e = spark.createDataFrame(src, "k string, e string, day date")
    build = lambda d: facts.build_checkout_fact(
        d, {"open": F.col("e") == "open", "paid": F.col("e") == "paid"}, "k", {"day": F.min("day")})
    fact = build(e.filter("day = '2024-01-01'"))
    for day in range(2, 7):
        fact = facts.upsert_fact(fact, build(e.filter(f"day in ('2024-01-0{day - 1}', '2024-01-0{day}')")), "k", ["open", "paid"], ["day"])
    assert rows(fact) == rows(build(e))


def test_rto_latest_rows_and_flags(spark):
    orders = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 9)], "order_id long, merchant_id long")
    ship = spark.createDataFrame([(1, 5, 1, "rto", 1.0), (1, 5, 2, "delivered", 2.0), (2, 1, 1, "rto", 3.0)],
                                 "order_id long, upd long, ship_date long, status string, charge double")
    score = spark.createDataFrame([(1, 1, "green", "green", "m", True), (1, 2, "green", "red", "m", True), (2, 1, "green", "green", "m", False), (3, 1, None, "green", "m", False)],
                                  "order_id long, at long, ml_flag string, rule_flag string, model_code string, experimentation boolean")
    out = facts.build_rto_fact(orders, ship, score, ship_order=["upd", "ship_date"], score_order=["at"])
    got = {r["order_id"]: (r["status"], r["result_flag"], r["ml_flag"]) for r in out.collect()}
    assert got == {1: ("delivered", "red", "green"), 2: ("rto", "green", "green"), 3: ("not_shipped", "missing", "missing"), 4: ("not_shipped", "missing", "missing")}


def raw_row(name="open", props=None, ctx=None, source="checkoutjs", day=dt.date(2024, 1, 1)):
    p = props if isinstance(props, str) else json.dumps(props or {})
    c = ctx if isinstance(ctx, str) else json.dumps({"library": "CheckoutJS", "checkout_id": "c", "order_id": "order_77", **(ctx or {})})
    return (name, p, c, 1704067200, 1, 1704067200, day, source)


def test_normalize_events_filters_and_looks_up(spark):
    one_click = {"options": {"key": "key_live_abc", "one_click_checkout": "true"}}
    lite = {"data": {"meta": {"is_one_click_checkout_enabled_lite": "TRUE"}, "method": "Card", "data": {"method": "UPI"}}}
    src = [raw_row(props=one_click), raw_row("checkoutCODOptionShown", lite), raw_row("checkoutCODOptionShown", {**lite, "data": {**lite["data"], "disabled": "true"}}),
           raw_row(props="{broken"), raw_row(props={"options": {"one_click_checkout": "false"}}), raw_row(props=one_click, source="server"),
           raw_row(props=one_click, day=dt.date(2024, 2, 1)), raw_row(props=one_click, ctx={"library": "other"})]
    raw = spark.createDataFrame(src, "event_name string, properties string, context string, event_timestamp long, event_timestamp_raw long, "
                                     "producer_timestamp long, producer_created_date date, source string")
    keys = spark.createDataFrame([("abc", "m1"), ("abc", "m2"), (None, "m3")], "id string, merchant_id string")
    meta = spark.createDataFrame([("77", "one_click_checkout", '{"utm_parameters": {"utm_source": "s"}}', 2), ("77", "one_click_checkout", '{"utm_parameters": {"utm_source": "old"}}', 1),
                                  ("77", "other", "{}", 3)], "order_id string, type string, value string, updated_at int")
    out = facts.normalize_events(raw, keys, meta, dt.date(2024, 1, 1), dt.date(2024, 1, 31)).collect()
    assert len(out) == 3
    assert {(r["merchant_id"], r["method"], r["is_order_cod_eligible"], r["utm_source"]) for r in out} == {
        ("m1", None, "no", "s"), (None, "upi", "yes", "s"), (None, "upi", "no", "s")}


def test_experiments(spark, rows):
    e = spark.createDataFrame([("c1", '{"a": "x", "b": "y"}'), ("c1", '{"a": "x"}'), ("c2", "{broken"), ("c3", None)], "c string, arms string")
    exp = facts.explode_experiments(e, "arms", ["c"])
    assert rows(exp) == [("c1", "a", "x"), ("c1", "b", "y")]
    assert rows(facts.pivot_arms(exp, "c", ["a", "b", "z"])) == [("c1", "x", "y", None)]


def test_rto_fact_keeps_prior_orders(spark, rows):
    o = spark.createDataFrame([(1,), (2,)], "order_id long")
    s = spark.createDataFrame([(1, "rto", 1, "x"), (1, "delivered", 2, "y"), (3, "rto", 1, "z")], "order_id long, status string, at int, awb string")
    r = spark.createDataFrame([(1, "green", "green", "m", False, 5)], "order_id long, ml_flag string, rule_flag string, model_code string, experimentation boolean, at int")
    build = lambda orders, prior=None: facts.build_rto_fact(orders, s, r, None, "order_id", ["at"], ["at"], ship_cols=["awb"], ship_count="n", prior=prior)
    first = build(spark.createDataFrame([(2,), (3,)], "order_id long"))
    out = build(o, first).select("order_id", "status", "awb", "n", "result_flag")
    assert rows(out) == [(1, "delivered", "y", 2, "green"), (2, "not_shipped", None, None, "missing"), (3, "rto", "z", 1, "missing")]
