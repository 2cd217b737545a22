"""Saved addresses and prefill: rates, inventory, utilisation, creation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import flag, label_null, ratio
from ..functions.grouped import count_ids, exact_quantiles, left_join_sparse, pivot_sum, with_report_totals

SO_FAR = "Addresses so far"


def prefill_rate(loaded: DataFrame, period: str, ident: str, applicable: Column, prefilled: Column, source: str) -> DataFrame:
    """Prefilled / loaded checkouts where prefill can apply, in total ('all') and
    by prefill source (all sources share the period's denominator)."""
    d = loaded.filter(applicable).select(period, ident, source, flag(prefilled).alias("__p"))
    per = d.groupBy(period, ident, source).agg(F.max("__p").alias("__p"))
    base = per.select(period, ident).distinct().groupBy(period).agg(F.count("*").alias("loaded"))
    hit = per.filter("__p = 1")
    total = hit.select(period, ident).distinct().groupBy(period).agg(F.count("*").alias("prefilled")).withColumn(source, F.lit("all"))
    by = hit.groupBy(period, F.col(source).cast("string").alias(source)).agg(F.countDistinct(ident).alias("prefilled"))
    return total.unionByName(by).join(base, period).withColumn("rate", ratio("prefilled", "loaded"))


def address_prefill(events: DataFrame, period: str, ident: str, loaded: Column, ready: Column, saved: Column,
                    by: Sequence[str] = ()) -> DataFrame:
    """Saved-address prefill: checkouts logged in with a saved address that never
    saw the saved-address screen, plus those that saw it, over all loaded."""
    keys = [*by, period]
    # one row per checkout and slice; the exclusion looks at the whole checkout
    per = events.groupBy(*keys, ident).agg(F.max(flag(loaded)).alias("l"), F.max(flag(loaded & ready)).alias("r"), F.max(flag(saved)).alias("s"))
    saw = per.filter("s = 1").select(ident).distinct()
    summary = per.filter("r = 1").join(saw, ident, "left_anti").groupBy(*keys).agg(F.count("*").alias("summary_prelogged_in"))
    rest = per.groupBy(*keys).agg(F.sum("l").alias("total"), F.sum("s").alias("saved_screen"))
    out = rest.filter("total > 0").join(summary, keys, "left").na.fill(0, ["summary_prelogged_in"])
    return out.withColumns({
        "summary_rate": ratio("summary_prelogged_in", "total"), "saved_rate": ratio("saved_screen", "total"),
        "prefill_rate": ratio(F.col("summary_prelogged_in") + F.col("saved_screen"), "total")})


def address_inventory(addr: DataFrame, start, period: Column, sources: Sequence[str], source: str = "source_type") -> DataFrame:
    """Addresses added per period and source; everything before ``start`` is one
    opening row. With row total and running total (one row per period); both hold
    every source, those without a column too."""
    label = F.when(F.col("created_date") < F.lit(start), SO_FAR).otherwise(period.cast("string"))
    d = addr.select("id", label.alias("added"), label_null(source, "user_saved").alias("s")).distinct()
    p = d.groupBy("added").agg(*[F.sum(flag((F.col("s") == s) & F.col("id").isNotNull())).cast("bigint").alias(s) for s in sources], F.count("id").alias("total"))
    first = F.when(F.col("added") == SO_FAR, 0).otherwise(1)
    w = Window.orderBy(first, "added").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("running_total", F.sum("total").over(w))


def address_utilization(used: DataFrame, addr: DataFrame, period: str, end, source: str = "source_type") -> DataFrame:
    """Distinct used addresses per source and period over all addresses of the source."""
    u = used.filter(F.col("address_id").isNotNull()).select(period, "address_id").distinct()
    a = addr.select(F.col("id").alias("address_id"), F.col(source))
    n = u.join(a, "address_id", "left").groupBy(label_null(source, "user_saved").alias("address_source"), period).agg(
        F.count("*").alias("addresses_used"))
    t = addr.filter(F.col("created_date") < F.lit(end)).groupBy(label_null(source, "user_saved").alias("address_source")).agg(
        F.countDistinct("id").alias("all_addresses"))
    return t.join(n, "address_source", "left").withColumn("utilization", ratio("addresses_used", "all_addresses"))


def address_distribution(addr: DataFrame, person: str, probs: Mapping[str, float], source: str = "source_type") -> DataFrame:
    """Addresses per person by source: mean and exact percentiles."""
    per = addr.groupBy(label_null(source, "user_saved").alias("address_source"), person).agg(F.countDistinct("id").alias("n"))
    mean = per.groupBy("address_source").agg(ratio(F.sum("n"), F.count("*")).alias("mean"), F.count("*").alias("persons"))
    return mean.join(exact_quantiles(per, ["address_source"], "n", probs), "address_source")


def city_tier_mix(checkouts: DataFrame, addr: DataFrame, tiers: DataFrame, entity: str, city: str, tier: str,
                  values: Sequence[str]) -> DataFrame:
    """Share of an entity's checkouts per city tier; unknown cities are 'No City Tier'."""
    d = left_join_sparse(checkouts, addr.select(F.col("id").alias("address_id"), city), "address_id")
    d = left_join_sparse(d, tiers, city)
    d = d.withColumn(tier, label_null(tier, "No City Tier"))
    n = d.groupBy(entity, tier).agg(F.count("*").alias("n"))
    n = with_report_totals(n, [entity], {"__t": F.sum("n")}).withColumn("share", ratio("n", "__t"))
    return pivot_sum(n, [entity], tier, values, {"share": F.sum("share")})


def creation_rate(addr: DataFrame, traffic: DataFrame, day: str, ident: str, source: str = "source_type") -> DataFrame:
    """New addresses by source and day over the day's distinct checkouts."""
    t = traffic.select(day, ident).distinct().groupBy(day).agg(F.count("*").alias("checkouts"))
    a = addr.groupBy(F.col("created_date").alias(day), label_null(source, "user_saved").alias("address_source")).agg(
        F.countDistinct("id").alias("new_addresses"))
    return t.join(a, day, "left").withColumn("creation_rate", ratio("new_addresses", "checkouts"))


def prelogin_rate(fact: DataFrame, by: Sequence[str], ident: str, logged_in: Column, summary: Column, saved: Column) -> DataFrame:
    """Pre-login rate by slice and how much each prefill route contributes."""
    out = count_ids(fact, by, ident, {"logged_in": logged_in, "logged_out": ~logged_in, "summary": summary, "saved": saved})
    both = F.col("summary") + F.col("saved")
    return out.withColumn("total", F.col("logged_in") + F.col("logged_out")).withColumns({
        "prelogin_rate": ratio("logged_in", "total"), "saved_contribution": ratio("saved", both), "summary_contribution": ratio("summary", both)})


def partner_address(events: DataFrame, ramp: DataFrame, entity: str, day: str, ident: str, count_text: Column, end_event: Column,
                    otp_event: Column, reason: Column) -> DataFrame:
    """Hits of a partner's address service per day, ramped entities excluded. The
    address count arrives as text: what is not a number counts as 0."""
    n = F.coalesce(count_text.try_cast("double"), F.lit(0.0)).cast("int")
    d = events.join(ramp.select(entity).distinct(), entity, "left_anti")
    return count_ids(d, [day], ident, {
        "checkouts": F.lit(True), "api_returns_address": end_event & (n > 0), "access_address_otp": otp_event & reason.contains("access_address")})
