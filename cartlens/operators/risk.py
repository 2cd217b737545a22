"""Return-to-origin risk: flag rates, classifier quality, shipping data, age, association."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bands, first_match, flag, ratio
from ..functions.grouped import with_report_totals

# Shipment states that count as known
VALID_STATUS = ["delivered", "rto", "cancelled", "lost", "partially_delivered", "returned"]


def risk_label(result_flag: Column, experimentation: Column) -> Column:
    """What the buyer saw: red orders in the experiment were still served as safe."""
    return first_match([
        (result_flag == "green", "safe"), ((result_flag == "red") & experimentation, "safe"),
        ((result_flag == "red") & ~experimentation, "risky")], "unknown")


def risky_rate(rto: DataFrame, by: Sequence[str], ident: str = "order_id") -> DataFrame:
    """Orders per label and slice and the risky share of the slice."""
    d = rto.withColumn("label", risk_label(F.col("result_flag"), F.col("experimentation")))
    g = d.groupBy(*by).agg(
        F.count(ident).alias("orders"), *[F.sum(flag(F.col("label") == v)).alias(v) for v in ["risky", "safe", "unknown"]])
    return g.withColumn("risky_rate", ratio("risky", "orders"))


def quality_cells(rto: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion cells of the risk classifier. Risky unless both flags are green;
    a missing shipment state is not a return."""
    risky = ~((F.lower("ml_flag") == "green") & (F.lower("rule_flag") == "green"))
    risky = F.coalesce(risky, F.lit(True))
    back = F.coalesce(F.lower("status") == "rto", F.lit(False))
    cells = {"rto_risky": back & risky, "rto_safe": back & ~risky, "non_rto_risky": ~back & risky, "non_rto_safe": ~back & ~risky}
    return rto.groupBy(*by).agg(F.count("*").alias("orders"), *[F.sum(flag(c)).alias(n) for n, c in cells.items()])


def classifier_quality(rto: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision, recall and F score per period (and slice)."""
    g = quality_cells(rto, by)
    p = ratio("rto_risky", F.col("rto_risky") + F.col("non_rto_risky"))
    r = ratio("rto_risky", F.col("rto_risky") + F.col("rto_safe"))
    g = g.withColumns({"precision": p, "recall": r})
    return g.withColumn("f_score", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rolling_quality(quality: DataFrame, period: str, n: int = 4, measures: Sequence[str] = ("precision", "recall", "f_score")) -> DataFrame:
    """Mean of the last n periods (one row per period in)."""
    w = Window.orderBy(period).rowsBetween(-(n - 1), 0)
    return quality.select(period, *[F.avg(m).over(w).alias(f"{m}_{n}") for m in measures])


def shipping_availability(rto: DataFrame, period: Column, by: Sequence[str], start, end, shift: int = 21) -> DataFrame:
    """Share of orders with a known shipment state. The window lies ``shift`` days
    back, since states arrive late."""
    day = F.col("created_date")
    d = rto.filter((day >= F.date_sub(F.lit(start), shift)) & (day < F.date_sub(F.lit(end), shift))).withColumn("period_start", period)
    known = F.col("status").isin(VALID_STATUS)
    done = F.col("status").isin([s for s in VALID_STATUS if s != "rto"])
    return d.groupBy("period_start", *by).agg(
        F.count("*").alias("orders"), F.sum(flag(known)).alias("with_status"), F.sum(flag(done)).alias("delivered")).withColumn(
        "availability", ratio("with_status", "orders"))


AVAILABILITY_EDGES = [-0.1, 0.0, 0.2, 0.5, 0.8, 0.9, 1.0]


def availability_bins(per_entity: DataFrame, period: str = "period_start") -> DataFrame:
    """Entities per (a, b] bin of their availability."""
    b = bands("availability", AVAILABILITY_EDGES, right_closed=True)
    return per_entity.groupBy(period, b.alias("bin")).agg(F.count("*").alias("entities"))


def rto_by_age(orders: DataFrame, live: DataFrame, entity: str, day: str, live_date: str, status: str,
               cuts: Sequence[int] = (1, 3, 6, 9, 12)) -> DataFrame:
    """Cumulative order, delivery and return counts and rates of an entity up to
    each age in 30-day months since go-live; every cut in one pass."""
    months = F.floor(F.datediff(F.col(day), F.col(live_date)) / 30)
    # partial months before go-live count as month 0, as integer division towards zero does
    months = F.when(F.datediff(F.col(day), F.col(live_date)) < 0, -F.floor(-F.datediff(F.col(day), F.col(live_date)) / 30)).otherwise(months)
    d = orders.join(live, entity).withColumn("__m", months)
    known, back = F.col(status).isin(VALID_STATUS), F.col(status) == "rto"
    aggs = [F.max(live_date).alias(live_date)]
    for c in cuts:
        young = F.col("__m") <= c
        aggs += [F.sum(flag(young)).alias(f"orders_{c}"), F.sum(flag(young & known)).alias(f"delivery_{c}"),
                 F.sum(flag(young & back)).alias(f"rto_{c}")]
    out = d.groupBy(entity).agg(*aggs)
    for c in cuts:
        out = out.withColumns({f"delivery_rate_{c}": F.round(ratio(f"delivery_{c}", f"orders_{c}"), 4),
                               f"rto_rate_{c}": F.round(ratio(f"rto_{c}", f"orders_{c}"), 4)})
    return out


def band_coverage(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Entities per pair of bands, share of all and cumulative share in band order."""
    g = df.groupBy(a.alias("band_a"), b.alias("band_b")).agg(F.count("*").alias("entities"))
    g = with_report_totals(g, [], {"__t": F.sum("entities")}).withColumn("share", ratio("entities", "__t")).drop("__t")
    order = Window.orderBy(F.col("band_a").asc_nulls_last(), F.col("band_b").asc_nulls_last())   # bands x bands rows
    return g.withColumn("cumulative", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def rule_contribution(df: DataFrame, rule: str, outcome: Column) -> DataFrame:
    """Share of all outcomes per rule."""
    g = df.groupBy(rule).agg(F.sum(flag(outcome)).alias("outcomes"))
    return with_report_totals(g, [], {"__t": F.sum("outcomes")}).select(rule, "outcomes", (ratio("outcomes", "__t") * 100).alias("percentage"))
