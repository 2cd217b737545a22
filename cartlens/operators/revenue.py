"""Reimbursement, fees and amounts by payment type."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_match, flag, plain_number, ratio, sum_money
from ..functions.grouped import left_join_sparse
from ..functions.periods import cutoff_month, month_label
from .lookup import effective_from
from .risk import VALID_STATUS


def reimbursement(orders: DataFrame, policy: DataFrame, entity: str = "merchant_id", day: str = "created_date") -> DataFrame:
    """Amount owed per order under the entity's policy, from its start date on.

    flat pays the maximum; otherwise the charge up to the maximum, and the maximum
    when no charge is known to have been made (0). A missing charge is not below
    the maximum, so it pays the maximum too. Nothing is owed when a manual control
    order was not low risk, or an order was not eligible while the check was on.

    orders: charge, status, manual_control, risk_tier, cod_eligible, check_enabled
    policy: entity, bucket, max_reimbursement, start_date
    """
    d = effective_from(orders, policy, entity, day, "start_date")
    cap, charge = F.col("max_reimbursement").cast("decimal(18,4)"), F.col("charge").cast("decimal(18,4)")
    owed = F.when((F.col("bucket") != "flat") & (charge < cap) & (charge != 0), charge).otherwise(cap)
    # a missing tier differs from 'low', a missing eligibility from true
    blocked = ((F.col("manual_control") & ~F.col("risk_tier").eqNullSafe("low"))
               | (~F.coalesce("cod_eligible", F.lit(False)) & F.col("check_enabled")))
    return d.withColumn("reimbursement", F.when(F.coalesce(blocked, F.lit(False)), F.lit(0).cast("decimal(18,4)")).otherwise(owed))


def reimbursement_summary(owed: DataFrame, entity: str = "merchant_id", day: str = "created_date") -> DataFrame:
    """Per month and entity: orders, with known status, returned, amount owed for returns."""
    known, back = F.col("status").isin(VALID_STATUS), F.col("status") == "rto"
    out = owed.groupBy(month_label(day).alias("month"), entity).agg(
        F.count("*").alias("orders"), F.sum(flag(known)).alias("with_delivery"), F.sum(flag(back)).alias("with_rto"),
        F.coalesce(F.sum(F.when(back, F.col("reimbursement"))), F.lit(0)).cast("double").alias("rto_amount"))
    return out.withColumn("delivery_share", F.round(ratio("with_delivery", "orders"), 4))


def reimbursement_status(summary: DataFrame, as_of: dt.date, enough: float = 0.80) -> DataFrame:
    """Where a month goes: ready to settle, statuses look wrong (nothing returned),
    or waiting for statuses. Months after the cut-off are 'open'."""
    share = F.col("delivery_share")
    return summary.withColumn("route", first_match([
        (F.col("month") > cutoff_month(as_of), "open"), ((share >= enough) & (F.col("rto_amount") != 0), "Successful"),
        (share >= enough, "Incorrect status"), (share < enough, "Pending status")]))


def settlement_details(owed: DataFrame, routed: DataFrame, entity: str = "merchant_id", day: str = "created_date") -> DataFrame:
    """Order lists behind each route: returned orders with an amount, orders without
    a known status, or all orders of a month that looks wrong."""
    r = routed.filter(F.col("route") != "open").select("month", entity, "route")
    d = owed.withColumn("month", month_label(day)).join(r, ["month", entity])
    known = F.coalesce(F.col("status").isin(VALID_STATUS), F.lit(False))
    keep = first_match([
        (F.col("route") == "Successful", (F.col("status") == "rto") & (F.col("reimbursement") != 0)),
        (F.col("route") == "Pending status", ~known)], True)
    return d.filter(keep)


def net_revenue(pay: DataFrame, pricing: DataFrame, reimbursed: DataFrame, month: str, entity: str = "merchant_id") -> DataFrame:
    """Fee on COD amount after the pricing date minus the month's reimbursement.

    pay: entity, created_date, amount (COD payments of one-click orders)
    pricing: entity, cod ('2.5%'), pricing_live_date;  reimbursed: month, entity, rto_amount
    """
    p = pay.filter(month_label("created_date") == month)
    g = effective_from(p, pricing, entity, "created_date", "pricing_live_date").groupBy(entity).agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).alias("__gmv"), F.count("*").alias("cod_orders"), F.max("cod").alias("__fee"))
    fee = plain_number("__fee", "decimal(10,4)") / 100
    r = reimbursed.filter(F.col("month") == month).groupBy(entity).agg(F.sum("rto_amount").alias("__r"))
    out = g.join(r, entity, "left").withColumns({
        "cod_gmv": F.col("__gmv").cast("double"), "fee_rate": fee.cast("double"), "fees": (F.col("__gmv") * fee).cast("double"),
        "reimbursement": F.coalesce("__r", F.lit(0.0))})
    return out.select(entity, "cod_orders", "cod_gmv", "fee_rate", "fees", "reimbursement", (F.col("fees") - F.col("reimbursement")).alias("net_revenue"))


def prepaid_income(pay: DataFrame, fees: DataFrame, pricing: DataFrame, entity: str = "merchant_id") -> DataFrame:
    """Payments, amount and income per entity and pricing rule.

    pay: entity, transaction_id, amount;  fees: transaction_id, fee, rule_id
    pricing: rule_id, percent_rate, fixed_rate, min_fee, max_fee (minor units)
    """
    d = left_join_sparse(pay.join(fees, "transaction_id", "left"), pricing, "rule_id", ["transaction_id"])
    pct, fixed, low, high, fee = (F.col(c) for c in ["percent_rate", "fixed_rate", "min_fee", "max_fee", "fee"])
    rules = [((pct == 0) & (fixed > 0), "Flat Pricing", fixed), ((pct == 0) & (fixed == 0) & (low > 0), "Flat Pricing", low),
             (high.isNotNull() & (fee == high), "Flat Pricing", high),
             (((pct == 0) & (fixed == 0)) | fee.isNull(), "Zero Pricing", F.lit(0))]
    kind = first_match([(c, n) for c, n, _ in rules], "Percentage Pricing")
    rate = first_match([(c, v.cast("double") / 100) for c, _, v in rules], pct.cast("double") / 100)
    return d.groupBy(entity, kind.alias("pricing_type"), rate.alias("pricing_rate")).agg(
        F.count("*").alias("payments"), sum_money("amount").alias("amount"), (F.sum(F.coalesce(fee, F.lit(0))) / 100).cast("double").alias("income"))


def payment_type(method: Column, card_type: Column, upi_type: Column, recurring: Column) -> Column:
    """Payment type over method, card and UPI tables; the first rule wins."""
    card, upi = F.lower(card_type), F.lower(upi_type)
    return first_match([
        (card == "debit", "Debit Card"), (card == "credit", "Credit Card"), (card == "prepaid", "Prepaid Card"),
        ((card_type.isNull() | (card_type == "")) & (method == "card"), "Unknown Card"),
        (upi == "collect", "UPI Collect"), (upi == "pay", "UPI Intent"), (upi_type.isNull() & (method == "upi"), "UPI Unknown"),
        ((method == "emandate") & (recurring == "initial"), "emandate registrations"),
        ((method == "emandate") & (recurring == "auto"), "emandate debits")], method)


def gmv_by_method(pay: DataFrame, cards: DataFrame, upi: DataFrame, entity: str = "merchant_id") -> DataFrame:
    """COD, other and total amount per entity. Cards and UPI rows are one per
    payment; without a known type the payment's method stands."""
    d = left_join_sparse(pay, cards, "card_id", ["payment_id"]).join(upi, "payment_id", "left")
    d = d.withColumn("payment_type", payment_type(F.col("method"), F.col("card_type"), F.col("upi_type"), F.col("recurring_type")))
    cod = F.col("method") == "cod"
    other = (F.col("payment_type") != "cod") & F.col("authorized") & (F.col("method") != "transfer")
    z = lambda c: F.coalesce(sum_money(F.when(c, F.col("amount"))), F.lit(0.0))
    return d.groupBy(entity).agg(z(cod).alias("gmv_cod"), z(other).alias("gmv_non_cod"), z(cod | F.col("authorized")).alias("gmv_total"),
                                 F.countDistinct("payment_type").alias("payment_types"))


