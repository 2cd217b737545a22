"""The wide checkout fact: one flag for each interaction of a buyer with the screens of the checkout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag

#: The parts of an event's documents that the fact reads, parsed once per event. Scalars are text, whatever their kind in the document.
PROPERTIES = """struct<data: struct<
  screen_name: string, coupon_source: string, input_source: string, is_coupon_valid: string, count_coupons_available: string,
  prefill_contact_number: string, prefill_email: string, value: string, otp_reason: string,
  response: struct<addresses: array<struct<serviceable: string, zipcode: string, city: string, state: string>>>,
  meta: struct<is_mobile: string, initial_loggedIn: string, initial_hasSavedAddress: string>>>"""
CONTEXT = "struct<platform: string>"

# Flags of the fact in their order, as (flag, events, field of the document, how it is compared, value).
# Without a field the event alone sets the flag; without events any event may.
SUMMARY = "render:1cc_summary_screen_loaded_completed"
SHIPPING = "metric:checkoutshippinginfoapicallcompleted"
FLAGS = [
    ("open", ["open"], None, None, None),
    ("render_complete", ["render:complete"], None, None, None),
    ("summary_screen_loaded", [SUMMARY], None, None, None),
    ("summary_screen_continue_cta_clicked", ["behav:1cc_summary_screen_continue_cta_clicked"], None, None, None),
    ("contact_email_entered", ["behav:1cc_summary_screen_contact_email_entered"], None, None, None),
    ("contact_number_entered", ["behav:1cc_summary_screen_contact_number_entered"], None, None, None),
    ("clicked_change_contact", ["behav:1cc_clicked_change_contact_summary_screen"], None, None, None),
    ("edit_contact_screen_loaded", ["render:1cc_change_contact_screen_loaded"], None, None, None),
    ("edit_contact_screen_back_button_clicked", ["behav:1cc_back_button_clicked"], "screen_name", "is", "details_screen"),
    ("edit_contact_screen_submit_cta_clicked", ["behav:1cc_clicked_change_contact_continue_cta"], None, None, None),
    ("edit_address_clicked", ["behav:1cc_summary_screen_edit_address_clicked"], None, None, None),
    ("logout_clicked", ["behav:1cc_account_screen_logout_clicked", "behav:1cc_account_screen_logout_of_all_devices_clicked"], None, None, None),
    ("coupon_screen_loaded", ["render:1cc_coupons_screen_loaded"], None, None, None),
    ("have_coupon_clicked", ["behav:1cc_summary_screen_have_coupon_clicked"], None, None, None),
    ("remove_coupon_clicked", ["behav:1cc_summary_screen_remove_coupon_clicked"], None, None, None),
    ("custom_coupon_entered", ["behav:1cc_coupons_screen_custom_coupon_entered"], None, None, None),
    ("coupon_applied", ["behav:1cc_coupons_screen_coupon_applied"], None, None, None),
    ("manual_coupon_applied", ["behav:1cc_coupons_screen_coupon_applied"], "coupon_source", "is", "manual"),
    ("merchant_coupon_applied", ["behav:1cc_coupons_screen_coupon_applied"], "coupon_source", "is", "merchant"),
    ("auto_coupon_applied", ["behav:coupon_applied"], "input_source", "is", "auto"),
    ("validation_successful", ["metric:1cc_coupons_screen_coupon_validation_completed"], "is_coupon_valid", "is true", None),
    ("coupon_back_button_clicked", ["behav:1cc_coupons_screen_back_button_clicked"], None, None, None),
    ("coupons_available", [], "count_coupons_available", "above", 0),
    ("load_saved_address_bottom_sheet_shown", ["render:1cc_load_saved_address_bottom_sheet_shown"], None, None, None),
    ("clicked_load_saved_address_bottom_sheet_cta", ["behav:1cc_clicked_load_saved_address_bottom_sheet_cta"], None, None, None),
    ("dismissed_load_saved_address_bottom_sheet", ["behav:1cc_dismissed_load_saved_address_bottom_sheet"], None, None, None),
    ("submit", ["submit"], None, None, None),
    ("prefill_contact_number", [SUMMARY], "prefill_contact_number", "is not", ""),
    ("prefill_email", [SUMMARY], "prefill_email", "is not", ""),
    ("contact_fill_began", ["behav:contact:fill"], "value", "is not", ""),
    ("email_fill_began", ["behav:email:fill"], "value", "is not", ""),
    ("pincode_serviceability_initiated", ["metric:checkoutshippinginfoapicallinitiated"], None, None, None),
    ("pincode_serviceability_successful", [SHIPPING], None, None, None),
    ("pincode_serviceability_true", [SHIPPING], "serviceable", "is true", None),
    ("saved_address_screen_loaded", ["render:1cc_saved_shipping_address_screen_loaded"], None, None, None),
    ("new_address_screen_loaded", ["render:1cc_add_new_address_screen_loaded_completed"], None, None, None),
    ("saved_address_cta_clicked", ["behav:1cc_saved_address_screen_continue_cta_clicked"], None, None, None),
    ("new_address_cta_clicked", ["behav:1cc_add_new_address_screen_continue_cta_clicked"], None, None, None),
    ("new_address_cta_clicked_onsavedaddress", ["checkoutaddnewaddressctaclicked"], None, None, None),
    ("new_address_screen_back_button_clicked", ["behav:1cc_back_button_clicked"], "screen_name", "is", "new_shipping_address_screen"),
    ("saved_address_screen_back_button_clicked", ["behav:1cc_back_button_clicked"], "screen_name", "is", "saved_shipping_address_screen"),
    ("edited_existing_saved_address", ["behav:1cc_clicked_edit_saved_address"], None, None, None),
    ("save_address_option_unchecked", ["checkoutsavenewaddressoptionunchecked"], None, None, None),
    ("save_address_option_checked", ["checkoutsavenewaddressoptionchecked"], None, None, None),
    ("payment_home_screen_loaded", ["render:1cc_payment_home_screen_loaded"], None, None, None),
]
# Why a one-time code is asked for, and what a buyer does on its screen, as (part of the flag's name, part of the event's name).
OTP_REASONS = ["access_address", "mandatory_login", "save_address"]
OTP_ACTIONS = [("screen_loaded", "render", "screen_loaded"), ("screen_submitted", "behav", "submitted"), ("screen_skipped", "behav", "skip_clicked"),
               ("screen_resend", "behav", "resend_clicked"), ("screen_back_clicked", "behav", "back_clicked")]
#: Texts of the address that the delivery check answers with.
PLACES = ["zipcode", "city", "state"]


def all_flags(otp: str = "otp") -> list[tuple]:
    """All flags in the form of ``FLAGS``. The events of the one-time code carry a vendor's name in some logs: ``otp`` is what stands in their names."""
    codes = [(f"{reason}_otp_{name}", [f"{kind}:1cc_{otp}_{action}"], "otp_reason", "in", [reason, f"{reason}_v2"])
             for reason in OTP_REASONS for name, kind, action in OTP_ACTIONS]
    return FLAGS + codes


def _holds(events: Sequence[str], field: Column | None, how: str | None, value) -> Column:
    out = F.col("event_name").isin(list(events)) if events else F.lit(True)
    if how is None:
        return out
    tests = {"is": lambda: field == value, "is not": lambda: field != value, "in": lambda: field.isin(value), "is true": lambda: field.try_cast("boolean"),
             "above": lambda: F.coalesce(field.try_cast("int"), F.lit(0)) > value}
    return out & tests[how]()


def interaction_fact(events: DataFrame, merchant: str = "merchant_id", checkout: str = "checkout_id", day: str = "producer_created_date", otp: str = "otp",
                     exclude: Sequence = ()) -> DataFrame:
    """One row per merchant and checkout: first day, browser, platform, states at the start, all interaction flags and the place of delivery.

    events: merchant, checkout, day, event_name, browser_name, properties and context (JSON texts). A condition that is NULL does not set its
    flag; a document that cannot be read sets none. The documents are parsed once per event; the aggregate keeps one row per checkout in each map task. Events
    without a merchant, or of one of ``exclude``, are left out; a missing place is '0' as soon as the delivery check did not run.
    """
    d = events.filter(F.col(merchant).isNotNull() & ~F.col(merchant).isin(list(exclude)) if exclude else F.col(merchant).isNotNull())
    d = d.select(merchant, checkout, day, "event_name", "browser_name", F.from_json("properties", PROPERTIES)["data"].alias("p"), F.from_json("context", CONTEXT).alias("c"))
    address = F.get("p.response.addresses", F.lit(0))
    field = lambda name: None if name is None else address[name] if name == "serviceable" else F.col("p")[name]
    flags = {name: _holds(of, field(f), how, value) for name, of, f, how, value in all_flags(otp)}
    started = F.col("event_name") == "render:complete"
    browser, mobile = F.col("c.platform") == "browser", F.col("p.meta.is_mobile")
    platform = (F.when(started & (F.col("c.platform") == "mobile_sdk"), "mobile_sdk").when(started & browser & (mobile == "true"), "mweb")
                .when(started & browser & (mobile.isNull() | (mobile == "false")), "desktop_browser").otherwise("NA"))
    checked = F.col("event_name") == SHIPPING
    return d.groupBy(merchant, checkout).agg(
        F.min(day).alias(day), F.max("browser_name").alias("browser_name"), F.max(platform).alias("platform"),
        F.max(F.when(started, F.col("p.meta.initial_loggedIn").try_cast("boolean"))).alias("initial_loggedin"),
        F.max(F.when(F.col("event_name") == SUMMARY, F.col("p.meta.initial_hasSavedAddress").try_cast("boolean"))).alias("initial_hasSavedAddress"),
        *[F.max(flag(c)).alias(n) for n, c in flags.items()],
        *[F.max(F.when(checked, address[x]).otherwise("0")).alias(f"pincode_serviceability_{x}") for x in PLACES])
