import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cartlens.operators import activity, address, coverage, identity, journey, lookup, revenue, risk, stats, text

D = dt.date


# -- statistics ------------------------------------------------------------
def test_pearson_and_slope_guard_constant_groups(spark):
    d = spark.createDataFrame([("k", 1.0, 2.0), ("k", 1.0, 3.0), ("one", 5.0, 1.0), ("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", None, 9.0), ("nul", None, None)],
                              "g string, x double, y double")
    got = {r["g"]: (r["c"], r["s"]) for r in d.groupBy("g").agg(stats.pearson("x", "y").alias("c"), stats.slope("y", "x").alias("s")).collect()}
    assert got["k"] == (None, None) and got["one"] == (None, None) and got["nul"] == (None, None)
    assert got["ok"][0] == pytest.approx(1) and got["ok"][1] == pytest.approx(2)


@pytest.mark.parametrize("table", [[[10, 20], [30, 5]], [[5, 1], [2, 8], [3, 3]], [[4, 0], [0, 4]]])
def test_chi_square_and_cramers_v(spark, table):
    src = [("g", i, j) for i, r in enumerate(table) for j, n in enumerate(r) for _ in range(n)]
    src += [("single", 0, j % 2) for j in range(6)]
    out = {r["g"]: r for r in stats.chi_square(spark.createDataFrame(src, "g string, x int, y int"), ["g"], "x", "y").collect()}
    n = sum(map(sum, table))
    rows_n, cols_n = [sum(r) for r in table], [sum(c) for c in zip(*table)]
    chi = sum((table[i][j] - rows_n[i] * cols_n[j] / n) ** 2 / (rows_n[i] * cols_n[j] / n) for i in range(len(rows_n)) for j in range(2))
    assert out["g"]["chi2"] == pytest.approx(chi)
    assert out["g"]["cramers_v"] == pytest.approx(math.sqrt(chi / n))
    assert out["single"]["chi2"] is None and out["single"]["cramers_v"] is None


def test_histogram_keeps_outliers(spark, rows):
    d = spark.createDataFrame([(v,) for v in [-5.0, 0.0, 9.9, 10.0, 99.9, 100.0, None]], "v double")
    assert rows(stats.histogram(d, [], "v", 0, 100, 10)) == [(0, 1), (1, 2), (10, 1), (11, 1), (2, 1)]


def test_trend_shape_needs_every_day_and_drops_outliers(spark):
    up = [("up", i, 0.1 * i) for i in range(1, 15)]
    gap = [("gap", i, 1.0) for i in range(1, 14)]
    flip = [("flip", i, -float(i) if i <= 7 else 50.0 + i) for i in range(1, 15)]
    d = spark.createDataFrame(up + gap + flip, "m string, day int, v double")
    out = {r["m"]: r for r in stats.trend_shape(d, "m", "day", "v", last=14).collect()}
    assert set(out) == {"up", "flip"}
    assert out["up"]["category"] == "Trend stayed positive" and out["up"]["slope"] == pytest.approx(0.1) and out["up"]["corr"] == pytest.approx(1)
    assert out["flip"]["category"] == "Slope Increased after the first week"


def test_quantile_tag(spark):
    d = spark.createDataFrame([(float(i),) for i in range(1, 10)] + [(None,)], "v double")
    got = {r["v"]: r["tag"] for r in stats.quantile_tag(d, "v", [0.33, 0.67], ["low", "medium", "high"]).collect()}
    assert got[1.0] == "low" and got[5.0] == "medium" and got[9.0] == "high" and got[None] is None


# -- reimbursement ------------------------------------------------------------
@pytest.mark.parametrize("bucket,charge,manual,tier,eligible,check,owed", [
    ("flat", 10.0, False, "low", True, True, 100.0), ("actual", 0.0, False, "low", True, True, 100.0), ("actual", 99.0, False, "low", True, True, 99.0),
    ("actual", 100.0, False, "low", True, True, 100.0), ("actual", 150.0, False, "low", True, True, 100.0), ("actual", None, False, "low", True, True, 100.0),
    ("actual", 50.0, True, "high", True, True, 0.0), ("actual", 50.0, True, None, True, True, 0.0), ("actual", 50.0, True, "low", True, True, 50.0),
    ("actual", 50.0, False, "high", False, True, 0.0), ("actual", 50.0, False, "high", None, True, 0.0), ("actual", 50.0, False, "high", False, False, 50.0),
    ("flat", 50.0, False, None, None, None, 100.0)])
def test_reimbursement_rules(spark, bucket, charge, manual, tier, eligible, check, owed):
    o = spark.createDataFrame([(1, D(2024, 1, 5), "rto", charge, manual, tier, eligible, check), (1, D(2023, 12, 31), "rto", charge, manual, tier, eligible, check)],
                              "merchant_id long, created_date date, status string, charge double, manual_control boolean, risk_tier string, cod_eligible boolean, check_enabled boolean")
    p = spark.createDataFrame([(1, bucket, 100.0, D(2024, 1, 1))], "merchant_id long, bucket string, max_reimbursement double, start_date date")
    got = revenue.reimbursement(o, p).collect()
    assert len(got) == 1 and float(got[0]["reimbursement"]) == owed   # orders before the start date are out


def test_reimbursement_routes(spark):
    s = spark.createDataFrame([("2024-01", 1, 0.8, 5.0), ("2024-01", 2, 0.9, 0.0), ("2024-01", 3, 0.79, 5.0), ("2024-02", 4, 1.0, 5.0)],
                              "month string, merchant_id long, delivery_share double, rto_amount double")
    got = {r["merchant_id"]: r["route"] for r in revenue.reimbursement_status(s, D(2024, 3, 13)).collect()}
    assert got == {1: "Successful", 2: "Incorrect status", 3: "Pending status", 4: "open"}
    got = {r["merchant_id"]: r["route"] for r in revenue.reimbursement_status(s, D(2024, 3, 14)).collect()}
    assert got[4] == "Successful"


# -- attribution ------------------------------------------------------------
def test_touches_at_the_edges_of_the_window(spark):
    t = dt.datetime(2024, 6, 30, 12)
    ago = lambda **k: t - dt.timedelta(**k)
    visits = [("a", ago(days=61), 1), ("a", ago(days=60), 2), ("a", ago(days=3), 3), ("a", t, 4), ("a", t + dt.timedelta(hours=1), 5), ("b", ago(days=61), 6)]
    v = spark.createDataFrame(visits, "id string, v_ts timestamp_ntz, visit long")
    s = spark.createDataFrame([("a", 1, t), ("a", 2, t), ("a", 3, ago(days=58)), ("b", 4, t), ("c", 5, t)], "id string, s_id long, s_ts timestamp_ntz")
    for chunk in (3600, 10**7):
        got = {r["s_id"]: (r["first_visit"], r["last_visit"]) for r in lookup.touch_attribution(s, v, "id", "s_id", "s_ts", "v_ts", "visit", [], chunk_seconds=chunk).collect()}
        assert got == {1: (2, 3), 2: (2, 3), 3: (1, 2), 4: (None, None), 5: (None, None)}
        n = {r["s_id"]: r["touches"] for r in lookup.touches_in_window(s, v, "id", "s_id", "s_ts", "v_ts", chunk_seconds=chunk).collect()}
        assert n == {1: 2, 2: 2, 3: 2, 4: 0, 5: 0}


def test_last_seen_is_strictly_before(spark, rows):
    a = spark.createDataFrame([("x", D(2024, 1, 5))], "id string, anchor date")
    s = spark.createDataFrame([("x", D(2024, 1, 5), "web"), ("x", D(2024, 1, 4), "web"), ("x", D(2024, 1, 1), "app"), ("x", D(2024, 1, 6), "app")], "id string, d date, ch string")
    assert rows(lookup.last_seen_by_channel(a, s, "id", "anchor", "d", "ch", ["web", "app"])) == [("x", D(2024, 1, 5), D(2024, 1, 4), D(2024, 1, 1))]


def test_days_since_last(spark):
    d = spark.createDataFrame([(D(2024, 1, 1), D(2024, 1, 9), D(2024, 1, 5)), (None, D(2024, 1, 9), D(2024, 1, 5))], "a date, b date, anchor date")
    assert [r["days_since"] for r in lookup.days_since_last(d, ["a", "b"], "anchor").collect()] == [4, None]


def test_null_keys_match_only_on_request(spark, rows):
    a = spark.createDataFrame([(1, "p"), (None, "q")], "k long, x string")
    b = spark.createDataFrame([(1, "r"), (None, "s")], "k long, y string")
    assert rows(lookup.null_matching_join(a, b, ["k"])) == [(1, "p", "r"), (None, "q", "s")]
    assert rows(a.join(b, "k", "left")) == [(1, "p", "r"), (None, "q", None)]


def test_touch_source(spark):
    d = spark.createDataFrame([(None,), ("https://www.Google.com/x",), ("https://shop.example/p",), ("https://bing.com",), ("https://z.org",), ("",)], "r string")
    m, s = journey.touch_source(F.col("r"), ["shop.example"])
    assert [tuple(x) for x in d.select(m, s).collect()] == [
        ("website", "direct"), ("organic", "google"), ("website", "direct"), ("organic", "bing"), ("organic", "others"), ("website", "direct")]


# -- activity ----------------------------------------------------------------
def test_trailing_active_brute_force(spark):
    import random
    r = random.Random(1)
    src = [(r.randrange(8), D(2024, 1, 1) + dt.timedelta(days=r.randrange(120))) for _ in range(90)]
    out = activity.trailing_active(spark.createDataFrame(src, "m long, d date"), "m", "d", 30)
    for row in out.collect():
        lo = row["d"] - dt.timedelta(days=29)
        assert row["active"] == len({m for m, d in src if lo <= d <= row["d"]})


def test_waterfall_ends_match(spark):
    src = [(i, p, i * (1 if p == "Prev" else 2) % 17) for i in range(40) for p in ("Prev", "Post")]
    out = activity.waterfall(spark.createDataFrame(src, "m long, p string, v long"), "m", "v", "p", "Prev", "Post", 5).collect()
    by = {r["label"]: r["value"] for r in out}
    assert len(out) == 8 and by["subtotal"] == by["Prev"] + sum(r["value"] for r in out if 0 < r["seq"] <= 6)


def test_change_class_edges(spark):
    src = [(1, "Prev", 100, 100), (1, "Post", 100, 90), (2, "Prev", 100, 50), (2, "Post", 100, 50), (3, "Prev", 100, 50), (3, "Post", 100, 55), (4, "Post", 10, 1)]
    d = spark.createDataFrame([(m, "s", p, o, k, 1.0) for m, p, o, k in src], "m long, seg string, p string, opens long, paid long, gmv double")
    got = {r["category"]: r["entities"] for r in activity.change_class(d, "m", "seg", "p", "Prev", "Post").collect()}
    assert got == {activity.CHANGE_LABELS[0]: 1, activity.CHANGE_LABELS[1]: 1, activity.CHANGE_LABELS[2]: 1}


def test_churned_needs_earlier_opens(spark, rows):
    f = spark.createDataFrame([(1, "a", 2), (1, "b", 0), (2, "a", 1), (2, "b", 1), (3, "b", 4)], "m long, p string, o int")
    why = spark.createDataFrame([(1, "", None)], "m long, reason string, category string")
    pay = spark.createDataFrame([(1, "a", 10.0)], "m long, p string, g double")
    assert rows(activity.churned(f, why, pay, "m", "p", "a", "b", "o", "g")) == [(1, "Reason not available", "Reason not available", -10.0)]


# -- risk ---------------------------------------------------------------------
def test_classifier_cells(spark):
    src = [("rto", "green", "red"), ("rto", "green", "green"), ("delivered", "red", "green"), (None, "GREEN", "green"), ("rto", None, "green")]
    d = spark.createDataFrame([("t", *r) for r in src], "p string, status string, ml_flag string, rule_flag string")
    r = risk.classifier_quality(d, ["p"]).first()
    assert (r["rto_risky"], r["rto_safe"], r["non_rto_risky"], r["non_rto_safe"]) == (2, 1, 1, 1)
    assert r["precision"] == pytest.approx(2 / 3) and r["recall"] == pytest.approx(2 / 3) and r["f_score"] == pytest.approx(2 / 3)


def test_rto_age_cuts(spark):
    o = spark.createDataFrame([(1, D(2024, 1, 1), "rto"), (1, D(2024, 3, 1), "delivered"), (1, D(2024, 6, 1), "pending"), (1, D(2023, 12, 20), "rto")], "m long, d date, s string")
    live = spark.createDataFrame([(1, D(2024, 1, 1))], "m long, live date")
    r = risk.rto_by_age(o, live, "m", "d", "live", "s", [1, 3, 6]).first()
    assert (r["orders_1"], r["orders_3"], r["orders_6"]) == (2, 3, 4) and (r["rto_1"], r["delivery_3"]) == (2, 3)


def test_availability_bin_edges(spark, rows):
    d = spark.createDataFrame([(1, 0.0), (1, 0.2), (1, 0.20001), (1, 1.0)], "period_start int, availability double")
    assert rows(risk.availability_bins(d)) == [(1, "(-0.1, 0.0]", 1), (1, "(0.0, 0.2]", 1), (1, "(0.2, 0.5]", 1), (1, "(0.9, 1.0]", 1)]


# -- identity, address, coverage --------------------------------------------------
def test_repeat_labels(spark):
    d = spark.createDataFrame([("a", D(2024, 1, 1)), ("a", D(2024, 1, 2)), (None, D(2024, 1, 2))], "dev string, d date")
    assert [r["visitor"] for r in identity.label_repeat(d, "dev", "d").orderBy("dev", "d").collect()] == [None, "new", "repeating"]


def test_identity_overlap_does_not_multiply(spark):
    a = spark.createDataFrame([("x", D(2024, 2, 1), "c1"), ("x", D(2024, 2, 1), "c2"), ("y", D(2024, 2, 1), "c3"), (None, D(2024, 2, 1), "c4")], "p string, d date, c string")
    b = spark.createDataFrame([("x", D(2024, 1, 1), "o1"), ("x", D(2024, 1, 2), "o2"), ("y", D(2024, 1, 31), "o3")], "p string, d date, c string")
    r = identity.identity_overlap(a, b, "p", "d", "c", D(2024, 1, 15)).first()
    assert (r["contacts"], r["known_contacts"], r["checkouts"], r["known_checkouts"]) == (2, 1, 3, 2)


def test_inventory_starts_with_history(spark):
    d = spark.createDataFrame([(1, None, D(2023, 1, 1)), (2, "x", D(2024, 1, 2)), (3, "x", D(2024, 2, 2)), (4, None, D(2024, 2, 3))], "id long, source_type string, created_date date")
    out = address.address_inventory(d, D(2024, 1, 1), F.date_format("created_date", "yyyy-MM"), ["user_saved", "x"]).orderBy("running_total").collect()
    assert [(r["added"], r["total"], r["running_total"]) for r in out] == [("Addresses so far", 1, 1), ("2024-01", 1, 2), ("2024-02", 2, 4)]


def test_partner_count_coercion(spark):
    d = spark.createDataFrame([(1, D(2024, 1, 1), "a", "3", "end", None), (1, D(2024, 1, 1), "b", "x", "end", None), (1, D(2024, 1, 1), "c", None, "otp", "access_address!"), (2, D(2024, 1, 1), "d", "9", "end", None)],
                              "m long, d date, c string, n string, e string, r string")
    ramp = spark.createDataFrame([(2,)], "m long")
    r = address.partner_address(d, ramp, "m", "d", "c", F.col("n"), F.col("e") == "end", F.col("e") == "otp", F.col("r")).first()
    assert (r["checkouts"], r["api_returns_address"], r["access_address_otp"]) == (3, 1, 1)


def test_set_overlap_and_coverage(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    b = spark.createDataFrame([(2,), (3,)], "k long")
    assert tuple(coverage.set_overlap(a, b, "k").first()) == (1, 1, 1, 3)
    ramp = spark.createDataFrame([(1, "live"), (2, "planned")], "k long, status string")
    f = {r["k"]: r for r in coverage.coverage_flags(a.distinct(), a.filter("k = 1"), b, ramp, "k").collect()}
    assert f[1]["eligible_and_live"] and f[2]["all_ineligible"] and not f[2]["both_eligible_and_ineligible"]


def test_null_variants_cover_all_subsets(spark):
    d = spark.createDataFrame([(1, "a", "b", "c")], "id long, x string, y string, z string")
    out = {r["variant"]: (r["x"], r["y"], r["z"]) for r in coverage.null_variants(d, ["x", "y", "z"], 2).collect()}
    assert len(out) == 7 and out["base"] == ("a", "b", "c") and out["x_z_null"] == ("", "b", "")


# -- text -----------------------------------------------------------------------
def test_page_colors(spark):
    html = ('<style>p{color:#FF0000; margin:0}\n.b{background-color : blue}</style><p style="color:#ff0000;border:1px">x</p>'
            "<div class='q' style='font-size:3px; border-color: rgb(1,2,3);'></div><a style='color:green'>no</a>")
    d = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page long, html string")
    got = {(r["value"], r["uses"], r["rank"]) for r in text.page_colors(d, "page", "html").collect()}
    assert got == {("#ff0000", 2, 1), ("blue", 1, 2), ("rgb(1,2,3)", 1, 3)}


def test_brand_colors_skip_invalid(spark):
    d = spark.createDataFrame([("FF0000",), ("FF0000",), ("RK",), (None,), ("zzzzzz",), ("00ff00",)], "c string")
    got = {r["color"]: (r["n"], r["red"], r["green"]) for r in text.brand_colors(d, "c").collect()}
    assert got == {"FF0000": (2, 1.0, 0.0), "00ff00": (1, 0.0, 1.0)}


def test_journey_paths_cross_chunks(spark):
    t = dt.datetime(2024, 1, 1)
    src = [("c", t + dt.timedelta(hours=h), h, e) for h, e in enumerate("abcab")] + [("d", t, 9, "z")]
    out = {r["c"]: (r["path"], r["steps"]) for r in journey.journey_paths(spark.createDataFrame(src, "c string, ts timestamp_ntz, i long, e string"), "c", "ts", "i", "e").collect()}
    assert out == {"c": ("a,b,c,a,b", 5), "d": ("z", 1)}


def test_dwell_skips_repeats(spark):
    t = dt.datetime(2024, 1, 1)
    src = [("c", t, 1, "view"), ("c", t + dt.timedelta(seconds=5), 2, "view"), ("c", t + dt.timedelta(seconds=9), 3, "click"), ("d", t, 4, "view")]
    r = journey.dwell_time(spark.createDataFrame(src, "c string, ts timestamp_ntz, i long, e string"), "c", "ts", "i", "e", "view", {"m": 0.5}).first()
    assert r["m"] == 4.0


def test_left_join_sparse_keeps_rows_without_key(spark, rows):
    from cartlens.functions.grouped import left_join_sparse
    a = spark.createDataFrame([(1, 7), (2, None), (3, None), (4, 8)], "id long, k long")
    b = spark.createDataFrame([(7, "x"), (None, "never")], "k long, v string")
    out = left_join_sparse(a, b, "k", ["id"])
    assert rows(out.select("id", "k", "v")) == [(1, 7, "x"), (2, None, None), (3, None, None), (4, 8, None)]


def test_left_join_sparse_spreads_rows_without_key(spark):
    from cartlens.functions.grouped import left_join_sparse
    s = spark.newSession()
    for k, v in {"autoBroadcastJoinThreshold": "-1", "adaptive.enabled": "false", "shuffle.partitions": "8"}.items():
        s.conf.set(f"spark.sql.{k}", v)
    a = s.range(2000).select("id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("k"))
    b = s.range(0, 2000, 10).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    for spread in (["id"], None):
        out = left_join_sparse(a, b, "k", spread).select("k", "v", F.spark_partition_id().alias("task")).collect()
        assert sorted(r["k"] for r in out if r["v"] == "x") == list(range(0, 2000, 10))
        tasks = [sum(r["k"] is None and r["task"] == i for r in out) for i in range(8)]
        assert sum(tasks) == 1600 and max(tasks) < 400
