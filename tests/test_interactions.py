import datetime as dt
import json

from cartlens.operators import interactions as op

SCHEMA = "merchant_id string, checkout_id string, producer_created_date date, event_name string, browser_name string, properties string, context string"
DAY = dt.date(2024, 1, 2)


def event(name, data=None, meta=None, platform="browser", merchant="m", checkout="c", day=DAY, text=None):
    doc = {"data": {**(data or {}), **({"meta": meta} if meta else {})}}
    return (merchant, checkout, day, name, "Chrome", text or json.dumps(doc), json.dumps({"platform": platform}))


def fact(spark, *events, **options):
    return {(r["merchant_id"], r["checkout_id"]): r.asDict() for r in op.interaction_fact(spark.createDataFrame(list(events), SCHEMA), **options).collect()}


def set_flags(row):
    return {n for n, *_ in op.all_flags() if row[n] == 1}


def test_every_flag_has_one_name_and_is_set_by_its_event_alone(spark):
    flags = op.all_flags()
    assert len({n for n, *_ in flags}) == len(flags) == 60
    good = {"is": lambda v: v, "is not": lambda v: "x", "in": lambda v: v[1], "is true": lambda v: "true", "above": lambda v: v + 1}
    rows, alone = [], {}
    for name, of, field, how, value in flags:
        data = {}
        if how:
            v = good[how](value)
            data = {"response": {"addresses": [{field: v}]}} if field == "serviceable" else {field: v}
        rows.append(event((of or ["anything"])[-1], data, checkout=name))
        alone[name] = {n for n, of2, f2, how2, v2 in flags if (not of2 and f2 == field) or (set(of2) & set(of[-1:]) and (how2 is None or (f2, how2, v2) == (field, how, value)))}
    got = fact(spark, *rows)
    assert {n: set_flags(got["m", n]) for n in alone} == alone


def test_conditions_that_do_not_hold(spark):
    got = fact(spark, event("behav:1cc_back_button_clicked", {"screen_name": "other"}), event("behav:1cc_coupons_screen_coupon_applied"),
               event("metric:1cc_coupons_screen_coupon_validation_completed", {"is_coupon_valid": False}), event("x", {"count_coupons_available": 0}),
               event("x", {"count_coupons_available": "many"}), event("behav:contact:fill", {"value": ""}), event("behav:email:fill"),
               event(op.SHIPPING, {"response": {"addresses": []}}), event("render:1cc_otp_screen_loaded", {"otp_reason": "other"}), event("submit", text="{broken"))
    assert set_flags(got["m", "c"]) == {"coupon_applied", "pincode_serviceability_successful", "submit"}


def test_state_platform_and_place(spark):
    got = fact(spark, event("open", day=dt.date(2024, 1, 1)), event("render:complete", meta={"is_mobile": "true", "initial_loggedIn": True}),
               event(op.SUMMARY, meta={"initial_hasSavedAddress": False}), event(op.SHIPPING, {"response": {"addresses": [{"zipcode": "560001", "city": "B", "serviceable": True}, {"city": "Z"}]}}),
               event("open", checkout="sdk", platform="mobile_sdk"), event("render:complete", checkout="desk"), event("render:complete", checkout="app", platform="mobile_sdk"),
               event("open", merchant=None), event("open", merchant="test"), exclude=["test"])
    c = got["m", "c"]
    assert (c["producer_created_date"], c["platform"], c["initial_loggedin"], c["initial_hasSavedAddress"]) == (dt.date(2024, 1, 1), "mweb", True, False)
    assert (c["pincode_serviceability_zipcode"], c["pincode_serviceability_city"], c["pincode_serviceability_state"]) == ("560001", "B", "0")
    assert {k[1]: v["platform"] for k, v in got.items()} == {"c": "mweb", "sdk": "NA", "desk": "desktop_browser", "app": "mobile_sdk"}


def test_vendor_name_of_the_code_screens(spark):
    e = event("render:1cc_acme_otp_screen_loaded", {"otp_reason": "save_address"})
    assert set_flags(fact(spark, e, otp="acme_otp")["m", "c"]) == {"save_address_otp_screen_loaded"} and not set_flags(fact(spark, e)["m", "c"])
