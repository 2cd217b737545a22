"""Funnels: step counts, arm comparison, drop-offs, reasons, method funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import code_name, first_match, flag, ratio
from ..functions.grouped import count_ids, pivot_sum, with_report_totals


def funnel(df: DataFrame, steps: Mapping[str, str], ident: str, by: Sequence[str] = (),
           event: str = "event_type") -> DataFrame:
    """Distinct ids per funnel step. ``steps`` maps event -> ordered step label;
    several events may share a label."""
    step = code_name(event, steps)
    hits = df.select(*by, ident, step.alias("step")).filter(F.col("step").isNotNull())
    return hits.distinct().groupBy(*by, "step").agg(F.count(ident).alias("ids"))


def funnel_compare(counts: DataFrame, arm: str, arms: Sequence[str], first_step: str,
                   by: Sequence[str] = ()) -> DataFrame:
    """Steps as percent of the arm's first step, one column per arm, and the
    difference last arm - first arm. Works on the small step table."""
    base = counts.filter(F.col("step") == first_step).select(*by, arm, F.col("ids").alias("base"))
    pct = counts.join(base, [*by, arm]).withColumn("pct", ratio(F.col("ids") * 100, "base"))
    out = pivot_sum(pct, [*by, "step"], arm, arms, {"ids": F.sum("ids"), "pct": F.sum("pct")})
    return out.withColumn("pct_diff", F.col(f"pct_{arms[-1]}") - F.col(f"pct_{arms[0]}"))


def funnel_dropoffs(counts: DataFrame, entity: str, steps: Sequence[str]) -> DataFrame:
    """Per entity: ids per step, share of the first step, loss from step to step."""
    wide = counts.groupBy(entity).pivot("step", list(steps)).agg(F.sum("ids"))
    cols = [F.coalesce(F.col(f"`{s}`"), F.lit(0)) for s in steps]
    out = [F.col(entity)]
    for s, c in zip(steps, cols):
        out += [c.alias(f"n_{s}"), ratio(c, cols[0]).alias(f"share_{s}")]
    for a, b, ca, cb in zip(steps, steps[1:], cols, cols[1:]):
        out.append(ratio(ca - cb, ca).alias(f"loss_{a}_{b}"))
    return wide.select(*out)


def dropoff_reason(loaded: Column, clicked: Column, contact: Column, coupon: Column, edited: Column) -> Column:
    """Why a checkout ended on the summary screen.

    Conversion and load failure come first, then which of contact and coupons
    was touched. A checkout known to have touched neither is a bounce; the edit
    exit is left for checkouts whose contact or coupon state is unknown (NULL).
    """
    return first_match([
        (clicked, "Summary Screen CTA clicked"),
        (~loaded, "Summary Screen did not load"),
        (contact & ~coupon, "Interacted w contact but not coupons"),
        (~contact & coupon, "Interacted w coupons but not contact"),
        (contact & coupon, "Interacted w both coupons and contact"),
        (~contact & ~coupon, "Bounced w/o any interaction"),
        (edited, "Exited to Edit Address"),
    ], "Others")


def reason_mix(df: DataFrame, by: Sequence[str], reason: str, ident: str) -> DataFrame:
    """Checkouts per reason and the share within the slice."""
    n = df.groupBy(*by, reason).agg(F.countDistinct(ident).alias("checkouts"))
    out = with_report_totals(n, by, {"slice_total": F.sum("checkouts")})
    return out.withColumn("share", ratio("checkouts", "slice_total"))


def method_funnel(events: DataFrame, key: str, by: Sequence[str], method: Column, methods: Sequence[str],
                  steps: Mapping[str, Column]) -> DataFrame:
    """Per payment method: checkouts that reached each step, step-to-step rates.

    One flag aggregate per checkout and method, then one sum: no scan per method.
    """
    d = events.withColumn("method", method).filter(F.col("method").isin(list(methods)))
    out = count_ids(d, [*by, "method"], key, steps)
    names = list(steps)
    for a, b in zip(names, names[1:]):
        out = out.withColumn(f"{b}_rate", ratio(b, a))
    return out


def path_counts(fact: DataFrame, by: Sequence[str], contact: Column, coupon: Column, converted: Column) -> DataFrame:
    """Contact x coupon paths by slice in one conditional aggregate."""
    paths = {
        "none": ~contact & ~coupon, "contact_only": contact & ~coupon,
        "coupon_only": ~contact & coupon, "both": contact & coupon}
    aggs = []
    for n, c in paths.items():
        aggs.append(F.sum(flag(c)).alias(n))
        aggs.append(F.sum(flag(c & converted)).alias(f"{n}_converted"))
    return fact.groupBy(*by).agg(F.count("*").alias("checkouts"), *aggs)
