import random

import pytest
from pyspark.sql import functions as F

from cartlens.operators import arms
from cartlens.operators import funnel


def data(spark, seed=1):
    r = random.Random(seed)
    c = [(f"c{i}", r.randrange(4), r.randrange(2), r.choice(["v1", "v2"]), r.choice("pq")) for i in range(80)]
    a = [(f"c{r.randrange(80) if i % 3 else 0}", i // 2, bool(i // 2 % 3)) for i in range(200)]   # repeated rows, one hot checkout
    return c, a, (spark.createDataFrame(c, "checkout_id string, merchant_id long, submitted int, arm string, s string"),
                  spark.createDataFrame(a, "checkout_id string, attempt_id long, success boolean"))


def test_l0_metrics_equals_distinct_counts(spark):
    c, a, (cd, ad) = data(spark)
    a = list({(x, f"{x}-{i}", ok) for x, i, ok in a})
    ad = spark.createDataFrame([(x, i, ok) for x, i, ok in a] * 2, "checkout_id string, attempt_id string, success boolean")
    for row in arms.l0_metrics(cd, ad, "arm", ["s"]).collect():
        mine = [x for x in c if x[3] == row["arm"] and x[4] == row["s"]]
        ids = {x[0] for x in mine}
        att = [x for x in a if x[0] in ids]
        assert row["checkouts"] == len(ids)
        assert row["merchants"] == len({x[1] for x in mine})
        assert row["submits"] == sum(x[2] for x in mine)
        assert row["attempts"] == len({x[1] for x in att})
        assert row["successes"] == len({x[1] for x in att if x[2]})
        assert row["paid_checkouts"] == len({x[0] for x in att if x[2]})
        assert row["modified_submits"] == len({x[0] for x in mine if x[2]} | {x[0] for x in att})
        assert row["split_pct"] == pytest.approx(len(ids) / 80)


def test_attempt_slices_keep_checkouts_without_attempt(spark):
    cd = spark.createDataFrame([("a", 1, 1, "v1"), ("b", 1, 0, "v1")], "checkout_id string, merchant_id long, submitted int, arm string")
    ad = spark.createDataFrame([("a", 1, True, "g1"), ("a", 2, False, "g2")], "checkout_id string, attempt_id long, success boolean, gateway string")
    got = {r["gateway"]: (r["checkouts"], r["attempts"], r["successes"]) for r in arms.l0_metrics(cd, ad, "arm", attempt_by=["gateway"]).collect()}
    assert got == {"g1": (1, 1, 1), "g2": (1, 1, 0), None: (1, 0, 0)}


def test_contaminated_entities_are_dropped(spark, rows):
    d = spark.createDataFrame([(1, "v1", "a"), (1, "v2", "b"), (1, "v2", "b"), (2, "v1", "c"), (3, "v2", "d"), (4, None, "e"), (4, "v1", "f")],
                              "m long, arm string, id string")
    out = arms.balanced_entities(d, "arm", "m", ["v1", "v2"], "id")
    assert rows(out) == [(1, 2, 50.0, 50.0)]
    assert {r["m"] for r in arms.only_balanced(d, "arm", "m", ["v1", "v2"], "id").collect()} == {1}


def test_split_check_names_unknown_arms(spark, rows):
    d = spark.createDataFrame([("v1", True, "a"), (None, None, "b"), ("v1", True, "a"), ("v2", False, "c")], "arm string, el boolean, id string")
    got = {(r["arm"], r["el"]): (r["ids"], round(r["share"], 4)) for r in arms.split_check(d, "arm", "el", "id").collect()}
    assert got == {("v1", "true"): (1, 0.3333), ("NA", "NA"): (1, 0.3333), ("v2", "false"): (1, 0.3333)}


def test_submit_attempt_distribution(spark, rows):
    cd = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0), ("d", 1)], "c string, s int")
    ad = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("a", 2, True), ("b", 3, True), ("c", 4, True)], "c string, i long, ok boolean")
    got = {r["attempts"]: r["checkouts"] for r in arms.submit_attempt_ratio(cd, ad, "c", "s", "i", "ok").collect()}
    assert got == {2: 1, 1: 1, 0: 1}


def test_effect_size_zero_and_full_arms(spark):
    import math
    d = spark.createDataFrame([(1, "a", 4, 0), (1, "b", 4, 4), (2, "a", 4, 2)], "m long, arm string, n int, x int")
    out = arms.effect_size(d, "arm", ["a", "b"], ["m"], "n", "x").collect()
    assert len(out) == 1 and out[0]["h"] == pytest.approx(math.pi)


@pytest.mark.parametrize("assigned,seen,changed,arm", [
    ("on", True, True, "test_change_method_clicked"), ("on", True, False, "test"), ("on", False, True, "control_change_method_clicked"), ("on", False, False, "control"),
    ("on", None, True, "on"), ("on", True, None, "test"), ("off", True, True, "off"), ("off", False, False, "off"), (None, True, True, None)])
def test_effective_arm(spark, assigned, seen, changed, arm):
    e = arms.effective_arm(F.lit(assigned), F.lit(seen).cast("boolean"), F.lit(changed).cast("boolean"), "on")
    assert spark.range(1).select(e.alias("x")).first()["x"] == arm


def test_variant_cr_stacks_pre_period(spark):
    cols = "variant string, d string, o int, p int"
    now = spark.createDataFrame([("new", "m1", 1, 1), ("old", "m1", 1, 0), ("new", "m2", 1, 0)], cols)
    pre = spark.createDataFrame([("new", "m1", 1, 1)], cols)
    got = {(r["variant"], r["slice"], r["value"]): r["cr"] for r in arms.variant_cr(now, "variant", {"merchant": F.col("d")}, "o", "p", pre).collect()}
    assert got == {("new", "all", "all"): 0.5, ("old", "all", "all"): 0.0, ("pre", "all", "all"): 1.0, ("new", "merchant", "m1"): 1.0,
                   ("new", "merchant", "m2"): 0.0, ("old", "merchant", "m1"): 0.0, ("pre", "merchant", "m1"): 1.0}


REASONS = [
    (True, True, False, False, False, "Summary Screen CTA clicked"), (False, False, False, False, False, "Summary Screen did not load"),
    (True, False, True, False, True, "Interacted w contact but not coupons"), (True, False, False, True, False, "Interacted w coupons but not contact"),
    (True, False, True, True, False, "Interacted w both coupons and contact"), (True, False, False, False, True, "Bounced w/o any interaction"),
    (True, False, None, False, True, "Exited to Edit Address"), (True, False, None, False, False, "Others")]


@pytest.mark.parametrize("loaded,clicked,contact,coupon,edited,reason", REASONS)
def test_dropoff_reason(spark, loaded, clicked, contact, coupon, edited, reason):
    b = lambda v: F.lit(v).cast("boolean")
    c = funnel.dropoff_reason(b(loaded), b(clicked), b(contact), b(coupon), b(edited))
    assert spark.range(1).select(c.alias("r")).first()["r"] == reason


def test_funnel_counts_ids_once_and_shares_labels(spark, rows):
    d = spark.createDataFrame([("open", "a"), ("open", "a"), ("start", "a"), ("pay", "a"), ("open", "b"), ("other", "c")], "event_type string, id string")
    assert rows(funnel.funnel(d, {"open": "1", "start": "1", "pay": "2"}, "id")) == [("1", 2), ("2", 1)]


def test_dropoffs_without_first_step(spark):
    d = spark.createDataFrame([(1, "a", 4), (1, "b", 1), (2, "b", 3)], "m long, step string, ids long")
    got = {r["m"]: (r["share_b"], r["loss_a_b"]) for r in funnel.funnel_dropoffs(d, "m", ["a", "b"]).collect()}
    assert got == {1: (0.25, 0.75), 2: (None, None)}
