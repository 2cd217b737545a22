"""Who came back: sessions, new and repeat devices, overlaps, prefill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag, ratio
from ..functions.grouped import distinct_counts, exact_quantiles, left_join_sparse, pivot_sum, with_report_totals


def session_reconcile(df: DataFrame, old: str, new: str, by: Sequence[str]) -> DataFrame:
    """Distinct ids of two session definitions per slice and their difference."""
    return distinct_counts(df, by, {"old_ids": old, "new_ids": new}, repeated=True).withColumn(
        "diff_pct", ratio(F.col("new_ids") - F.col("old_ids"), "old_ids"))


def new_vs_repeat(events: DataFrame, device: str, day: str, ident: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows labelled 'new' on the device's first day and 'repeating' after it,
    counted per slice: devices, checkouts and their shares of all."""
    d = label_repeat(events.select(*dict.fromkeys([*by, device, day, ident])).distinct(), device, day)
    g = distinct_counts(d, [*by, "visitor"], {"devices": device, "checkouts": ident}, repeated=True)
    g = with_report_totals(g, by, {"__d": F.sum("devices"), "__c": F.sum("checkouts")})
    return g.withColumns({"device_share": ratio("devices", "__d"), "checkout_share": ratio("checkouts", "__c")}).drop("__d", "__c")


def label_repeat(events: DataFrame, device: str, day: str) -> DataFrame:
    first = events.filter(F.col(device).isNotNull()).groupBy(device).agg(F.min(day).alias("first_date"))
    return left_join_sparse(events, first, device).withColumn(
        "visitor", F.when(F.col(day) == F.col("first_date"), "new").when(F.col(day) > F.col("first_date"), "repeating"))


def repeat_rate_percentiles(events: DataFrame, entity: str, device: str, day: str, probs: Mapping[str, float]) -> DataFrame:
    """Distribution over entities of the share of repeating devices (a device can be
    new and repeating within the range, and then counts in both)."""
    d = label_repeat(events, device, day).select(entity, device, "visitor").distinct()
    g = pivot_sum(d, [entity], "visitor", ["new", "repeating"], {"n": F.count(device)})
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    g = g.withColumn("rate", ratio(z("n_repeating"), z("n_new") + z("n_repeating")))
    return exact_quantiles(g, [], "rate", probs)


def repeat_conversion(fact: DataFrame, device: str, day: str, by: Sequence[str], converted: str) -> DataFrame:
    """Conversion of new and repeating visitors per slice (for example AOV band)."""
    return label_repeat(fact, device, day).groupBy(*by, "visitor").agg(
        F.count("*").alias("checkouts"), F.sum(converted).alias("converted")).withColumn("cr", ratio("converted", "checkouts"))


def repeat_share(fact: DataFrame, categories: DataFrame, entity: str, device: str, day: str, by: Sequence[str]) -> DataFrame:
    """Share of repeating checkouts by slice x entity category."""
    d = label_repeat(fact, device, day).join(categories, entity)
    return d.groupBy(*by, "category").agg(F.count("*").alias("checkouts"), F.sum(flag(F.col("visitor") == "repeating")).alias("repeating")).withColumn(
        "repeat_share", ratio("repeating", "checkouts"))


def device_day_counts(df: DataFrame, device: str, day: str, ident: str) -> DataFrame:
    """How many device-days have 1, 2, 3 … checkouts, with shares."""
    per = df.select(device, day, ident).distinct().groupBy(device, day).agg(F.count("*").alias("checkouts"))
    n = per.groupBy("checkouts").agg(F.count("*").alias("device_days"))
    return with_report_totals(n, [], {"__t": F.sum("device_days")}).select("checkouts", "device_days", ratio("device_days", "__t").alias("share"))


def exclude_heavy_devices(df: DataFrame, device: str, day: str, ident: str, limit: int = 20) -> DataFrame:
    """Rows without the devices that had more than ``limit`` checkouts on any day."""
    heavy = df.select(device, day, ident).distinct().groupBy(device, day).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit)
    return df.join(heavy.select(device).distinct(), device, "left_anti")


def identity_overlap(a: DataFrame, b: DataFrame, contact: str, day: str, ident: str, before) -> DataFrame:
    """Contacts of one surface that another surface knew before a date: distinct
    contacts and checkouts in total and known. The other surface is reduced to
    one row per contact first, so the join never multiplies rows."""
    known = b.groupBy(contact).agg(F.min(day).alias("__first")).filter(F.col("__first") < F.lit(before)).select(contact, F.lit(1).alias("__known"))
    mine = a.filter(F.col(contact).isNotNull()).select(contact, ident).distinct().groupBy(contact).agg(F.count("*").alias("n"))
    per = mine.join(known, contact, "left").withColumn("__known", F.coalesce("__known", F.lit(0)))   # a checkout has one contact
    out = per.agg(F.count("*").alias("contacts"), F.sum("__known").alias("known_contacts"), F.sum("n").alias("checkouts"),
                  F.sum(F.col("n") * F.col("__known")).alias("known_checkouts"))
    return out.withColumns({"contact_share": ratio("known_contacts", "contacts"), "checkout_share": ratio("known_checkouts", "checkouts")})


def happiness_index(merchants: DataFrame, fact: DataFrame, orders: DataFrame, as_of, orders_as_of, entity: str = "merchant_id") -> DataFrame:
    """Merchant scorecard: baseline conversion and returns (given, else the first
    three weeks) against the last 30 days, median load and completion times,
    prefill and pre-login percentages.

    merchants: entity, live_date, order_live_date, pre_cr, pre_rto (percent, may be NULL)
    fact:      entity, dt, open, submit, loaded, applicable, prefilled, prelogin, load_s, complete_s
    orders:    entity, created_date, rto
    """
    base = merchants.select(entity, "live_date", "order_live_date", "pre_cr", "pre_rto")
    on = lambda c: F.col(c) == 1
    count = lambda c: F.sum(flag(c))
    pct = lambda hit, of, when: ratio(F.sum(F.when(when, F.col(hit)).otherwise(0)) * 100, F.sum(F.when(when, F.col(of)).otherwise(0)))
    # First days and rates come from counts per entity and day; only the medians need rows.
    days = fact.groupBy(entity, "dt").agg(
        count(on("open")).alias("opens"), count(on("submit")).alias("submits"), count(on("loaded")).alias("loads"),
        count(on("loaded") & on("applicable")).alias("fillable"), count(on("loaded") & on("applicable") & on("prefilled")).alias("filled"),
        count(on("loaded") & on("prelogin")).alias("known")).join(base, entity)
    live = (F.col("dt") >= F.col("live_date")) & (F.col("opens") > 0)
    days = with_report_totals(days, [entity], {"first_day": F.min(F.when(live, F.col("dt")))}).filter("first_day is not null")
    since, ago = F.datediff("dt", "first_day"), F.datediff(F.lit(as_of), F.col("dt"))
    early, recent = since.between(0, 20), ago.between(1, 31)
    late = recent & (F.col("pre_cr").isNotNull() | (since > 20))
    cr = days.groupBy(entity).agg(
        pct("submits", "opens", early).alias("first_cr"), pct("submits", "opens", late).alias("recent_cr"),
        pct("filled", "fillable", recent).alias("prefill_pct"), pct("known", "loads", recent).alias("prelogin_pct"))
    o = orders.groupBy(entity, "created_date").agg(F.count("*").alias("n"), count(on("rto")).alias("back")).join(base, entity)
    first_o = F.min(F.when(F.col("created_date") >= F.col("order_live_date"), F.col("created_date")))
    o = with_report_totals(o, [entity], {"first_order": first_o}).filter("first_order is not null")
    since_o, ago_o = F.datediff("created_date", "first_order"), F.datediff(F.lit(orders_as_of), F.col("created_date"))
    late_o = ago_o.between(15, 44) & (F.col("pre_rto").isNotNull() | (since_o > 20))
    rto = o.groupBy(entity).agg(pct("back", "n", since_o.between(0, 21)).alias("first_rto"), pct("back", "n", late_o).alias("recent_rto"))
    times = fact.filter(recent).join(cr.select(entity), entity, "left_semi").unpivot([entity], ["load_s", "complete_s"], "measure", "v")
    p50 = exact_quantiles(times, [entity, "measure"], "v", {"p50": 0.5}).groupBy(entity).pivot("measure", ["load_s", "complete_s"]).agg(
        F.max("p50")).toDF(entity, "p50_load_s", "p50_completion_s")
    out = base.join(cr, entity, "left").join(rto, entity, "left").join(p50, entity, "left")
    return out.select(
        entity, F.coalesce("pre_cr", "first_cr").alias("baseline_cr"), "recent_cr", F.coalesce("pre_rto", "first_rto").alias("baseline_rto"),
        "recent_rto", "p50_load_s", "p50_completion_s", "prefill_pct", "prelogin_pct")


def coupon_conversion(events: DataFrame, ident: str, by: Sequence[str], available: Column, applied: Column, converted: Column) -> DataFrame:
    """Conversion of checkouts with and without coupons available and applied."""
    per = events.groupBy(*by, ident).agg(F.max(flag(available)).alias("coupon_available"), F.max(flag(applied)).alias("coupon_applied"),
                                         F.max(flag(converted)).alias("__c"))
    return per.groupBy(*by, "coupon_available", "coupon_applied").agg(F.count("*").alias("checkouts"), F.sum("__c").alias("converted")).withColumn(
        "cr", ratio("converted", "checkouts"))
