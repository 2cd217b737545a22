"""Traffic and payment activity: active entities, payment tables, churn, change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import first_match, flag, ratio, sum_money
from ..functions.grouped import count_ids, left_join_sparse, pivot_sum, top_n, with_report_totals, with_total_row, with_totals


def waterfall(df: DataFrame, entity: str, measure: str, period: str, pre: str, post: str, n: int = 10) -> DataFrame:
    """Start total, the n biggest movers, the rest as 'Others', end total."""
    p = pivot_sum(df, [entity], period, [pre, post], {"v": F.sum(measure)})
    p = p.select(F.col(entity).cast("string").alias("label"), F.coalesce(f"v_{pre}", F.lit(0)).alias("a"),
                 F.coalesce(f"v_{post}", F.lit(0)).alias("b"))
    p = p.withColumn("change", F.col("b") - F.col("a"))
    top = p.orderBy(F.abs("change").desc(), "label").limit(n)
    # n rows: the ranking window below sees only them
    rank = F.row_number().over(Window.orderBy(F.abs("change").desc(), "label")).cast("bigint")
    row = lambda seq, label, value: F.struct(
        F.lit(seq).cast("bigint").alias("seq"), F.lit(label).alias("label"), value.alias("value"))
    # every mover is taken out of the rest, which starts as the whole change
    movers = top.withColumn("seq", rank).select(F.inline(F.array(
        F.struct("seq", "label", F.col("change").alias("value")), row(n + 1, "Others", -F.col("change")))))
    frame = p.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select(F.inline(F.array(
        row(0, pre, F.col("a")), row(n + 1, "Others", F.col("b") - F.col("a")), row(n + 2, "subtotal", F.col("b")))))
    return movers.unionByName(frame).groupBy("seq", "label").agg(F.sum("value").alias("value"))


def active_entities(pay: DataFrame, entity: str, segment: str, period: str) -> DataFrame:
    """Distinct active entities per segment and period, with a Total row that is
    counted from the rows (distinct counts do not add up)."""
    return with_total_row(pay, [segment, period], {"active": F.countDistinct(entity)})


def trailing_active(df: DataFrame, entity: str, day: str, days: int = 30) -> DataFrame:
    """Distinct entities active within the trailing window, for every day.

    An active day covers the next ``days`` days or until the entity's next active
    day. Counting where these stretches start and end gives the distinct count
    without repeating an entity once per window.
    """
    seen = df.select(entity, F.col(day).alias("d")).distinct()
    nxt = F.lead("d").over(Window.partitionBy(entity).orderBy("d"))   # one row per calendar day
    stop = F.date_add("d", days)
    spans = seen.select("d", F.least(stop, F.coalesce(nxt, stop)).alias("stop"))
    moves = spans.groupBy("d").agg(F.count("*").alias("n")).unionByName(
        spans.groupBy(F.col("stop").alias("d")).agg((-F.count("*")).alias("n")))
    daily = moves.groupBy("d").agg(F.sum("n").alias("n"))   # one row per calendar day
    running = F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    return daily.select(F.col("d").alias(day), running.alias("active"))


def payment_summary(pay: DataFrame, period: str, amount: str, success: Column, cod: Column) -> DataFrame:
    """Payment table per period: attempts, successes, amount, COD split, rates."""
    ok, ok_cod = success, success & cod
    out = pay.groupBy(period).agg(
        F.count("*").alias("attempts"), F.sum(flag(ok)).alias("successes"), sum_money(F.when(ok, F.col(amount))).alias("gmv"),
        F.sum(flag(ok_cod)).alias("cod_success"), F.sum(flag(ok & ~cod)).alias("non_cod_success"),
        F.sum(flag(~cod)).alias("non_cod_attempts"))
    return out.withColumns({
        "cod_share": ratio("cod_success", "successes"), "non_cod_share": ratio("non_cod_success", "successes"),
        "non_cod_sr": ratio("non_cod_success", "non_cod_attempts"), "overall_sr": ratio("successes", "attempts")})


def transpose_measures(df: DataFrame, key: str, keys: Sequence, measures: Sequence[str]) -> DataFrame:
    """Measures as rows and the key's values as columns."""
    d = df.select(F.col(key).cast("string").alias(key), *[F.col(m).cast("double").alias(m) for m in measures])
    return d.unpivot([key], list(measures), "measure", "v").groupBy("measure").pivot(key, [str(k) for k in keys]).agg(F.max("v"))


def method_share_top(pay: DataFrame, entity: str, period: str, cod: Column, n: int = 10) -> DataFrame:
    """COD and other share per period for the n entities with most orders."""
    g = pay.groupBy(entity, period).agg(F.sum(flag(cod)).alias("cod"), F.count("*").alias("orders"))
    top = g.groupBy(entity).agg(F.sum("orders").alias("all_orders")).orderBy(F.col("all_orders").desc(), entity).limit(n)
    return g.join(top, entity).withColumns({
        "cod_share": ratio("cod", "orders"), "non_cod_share": ratio(F.col("orders") - F.col("cod"), "orders")})


def churned(fact: DataFrame, reasons: DataFrame, pay: DataFrame, entity: str, period: str, pre: str, post: str,
            opens: str, amount: str) -> DataFrame:
    """Entities with opens in the earlier period and none in the later one, with
    their reason and category and the change of their paid amount."""
    o = pivot_sum(fact, [entity], period, [pre, post], {"o": F.sum(opens)})
    gone = o.filter((F.coalesce(f"o_{pre}", F.lit(0)) != 0) & (F.coalesce(f"o_{post}", F.lit(0)) == 0)).select(entity)
    g = pivot_sum(pay, [entity], period, [pre, post], {"g": sum_money(amount)})
    g = g.select(entity, (F.coalesce(f"g_{post}", F.lit(0.0)) - F.coalesce(f"g_{pre}", F.lit(0.0))).alias("gmv_impact"))
    blank = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Reason not available")).alias(c)
    return gone.join(reasons, entity, "left").join(g, entity, "left").select(entity, blank("reason"), blank("category"), "gmv_impact")


def churn_by_category(gone: DataFrame, entity: str) -> DataFrame:
    return gone.groupBy("category").agg(F.countDistinct(entity).alias("entities"), F.sum(F.col("gmv_impact").cast("decimal(24,2)")).cast("double").alias("gmv_impact"))


def combined_cr(fact: DataFrame, pay: DataFrame, period: str, by: Sequence[str] = (), opens: str = "open",
                submits: str = "submit") -> DataFrame:
    """Checkout counts joined to payment counts per period (and slice)."""
    keys = [*by, period]
    c = fact.groupBy(*keys).agg(F.sum(opens).alias("initiated"), F.sum(submits).alias("submitted"))
    p = pay.groupBy(*keys).agg(F.sum("attempts").alias("attempts"), F.sum("successes").alias("successes"))
    return c.join(p, keys).withColumns({
        "modal_cr": ratio("submitted", "initiated"), "payment_sr": ratio("successes", "attempts"),
        "overall_cr": ratio("successes", "initiated")})


def net_cr(cr: DataFrame, shipping: DataFrame, period: str) -> DataFrame:
    """Period conversion joined to delivered orders of the same period."""
    return cr.join(shipping, period, "left").withColumn("net_cr", ratio("delivered", "initiated"))


def api_availability(fact: DataFrame, period: str, ident: str, calls: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Success ids / initiated ids per period for each API."""
    conds = {}
    for n, (started, done) in calls.items():
        conds |= {f"{n}_started": started, f"{n}_done": done}
    out = count_ids(fact, [period], ident, conds)
    return out.withColumns({f"{n}_rate": ratio(f"{n}_done", f"{n}_started") for n in calls})


def attribute_availability(fact: DataFrame, period: str, attr: Column, ident: str) -> DataFrame:
    """Share of ids with and without an attribute per period."""
    d = fact.select(period, F.when(attr.isNull(), "missing").otherwise("present").alias("state"), ident).distinct()
    n = d.groupBy(period, "state").agg(F.count("*").alias("ids"))
    return with_report_totals(n, [period], {"all_ids": F.sum("ids")}).withColumn("share", ratio("ids", "all_ids"))


def null_offenders(fact: DataFrame, period: str, entity: str, attr: Column, ident: str, n: int = 5,
                   periods: Sequence[str] = ("Prev", "Post")) -> DataFrame:
    """Entities with most missing values per period: percent missing and share of
    all missing, the periods side by side."""
    g = count_ids(fact, [period, entity], ident, {"nulls": attr.isNull(), "total": F.lit(True)})
    g = with_totals(g, [period], {"all_nulls": F.sum("nulls")})
    top = top_n(g, [period], [F.col("nulls").desc(), F.col(entity)], n)
    top = top.withColumns({"pct_null": ratio("nulls", "total"), "share_of_null": ratio("nulls", "all_nulls")})
    a, b = (top.filter(F.col(period) == p).select(
        entity, F.col("pct_null").alias(f"pct_null_{p}"), F.col("share_of_null").alias(f"share_of_null_{p}")) for p in periods)
    return a.join(b, entity, "full")


def entity_availability(fact: DataFrame, period: str, entity: str, value: Column) -> DataFrame:
    """Distinct entities per attribute value and period, relative to all entities
    of the period. An entity may count under several values."""
    d = fact.select(period, entity, value.alias("value")).distinct()
    n = d.groupBy(period, "value").agg(F.count(entity).alias("entities"))
    alle = d.select(period, entity).distinct().groupBy(period).agg(F.count(entity).alias("all_entities"))
    return n.join(alle, period).withColumn("share", ratio("entities", "all_entities"))


# Bucket limits and labels of the conversion ratio to the baseline
CR_RATIO_BUCKETS = [(1.1, "A. >10%"), (1.05, "B. 5%-10%"), (1.01, "C. 1%-5%"), (1.0, "D. 0%-1%")]


def cr_ratio_buckets(df: DataFrame, period: str, cr: str, baseline: str) -> DataFrame:
    """Entities per bucket of current / baseline rate (two digits), and the
    proportion within the period. A missing ratio falls in the last bucket."""
    r = F.round(ratio(cr, baseline), 2)
    b = first_match([(r >= lim, name) for lim, name in CR_RATIO_BUCKETS], "E. <0%")
    n = df.groupBy(period, b.alias("bucket")).agg(F.count("*").alias("entities"))
    return with_report_totals(n, [period], {"__t": F.sum("entities")}).select(
        period, "bucket", "entities", ratio("entities", "__t").alias("proportion"))


def surface_kpis(fact: DataFrame, by: Sequence[str], entity: str, opens: str, orders: str, amount: str) -> DataFrame:
    """Opens, orders, amount and active stores of one surface; only slices with orders."""
    out = fact.groupBy(*by).agg(
        F.sum(opens).alias("opens"), F.sum(orders).alias("orders"), sum_money(F.when(F.col(orders) > 0, F.col(amount))).alias("gmv"),
        F.countDistinct(F.when(F.col(orders) > 0, F.col(entity))).alias("active_stores"))
    return out.filter("orders > 0").withColumn("cr", ratio("orders", "opens"))


CHANGE_LABELS = ["Decreasing (<= -10%)", "Stable (-10% : 10%)", "Increasing  (>= 10%)"]


def change_class(df: DataFrame, entity: str, segment: str, period: str, pre: str, post: str) -> DataFrame:
    """Entities by how their conversion changed (ratio <= 0.9, stable, >= 1.1), with
    volume and amount change per segment and class. ``df`` has opens, paid, gmv."""
    p = pivot_sum(df, [entity, segment], period, [pre, post], {
        "opens": F.sum("opens"), "paid": F.sum("paid"), "gmv": F.sum("gmv")})
    r = F.try_divide(ratio(f"paid_{post}", f"opens_{post}"), ratio(f"paid_{pre}", f"opens_{pre}"))
    label = first_match([(r <= 0.9, CHANGE_LABELS[0]), (r >= 1.1, CHANGE_LABELS[2]), (r.isNotNull(), CHANGE_LABELS[1])])
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    g = p.withColumn("category", label).filter("category IS NOT NULL").groupBy(segment, "category").agg(
        F.count("*").alias("entities"), *[F.sum(z(f"{m}_{x}")).alias(f"{m}_{x}") for m in ["opens", "gmv"] for x in [pre, post]])
    chg = lambda m: ratio(F.col(f"{m}_{post}") - F.col(f"{m}_{pre}"), f"{m}_{pre}")
    return g.select(segment, "category", "entities", chg("opens").alias("volume_change"), chg("gmv").alias("gmv_change"))


def mom_delta(df: DataFrame, entity: str, month: str, opens: str, paid: str) -> DataFrame:
    """Month-over-month conversion deltas per entity (one row per month)."""
    g = df.groupBy(entity, month).agg(F.sum(opens).alias("opens"), F.sum(paid).alias("paid")).withColumn("cr", ratio("paid", "opens"))
    return g.withColumn("cr_delta", F.col("cr") - F.lag("cr").over(Window.partitionBy(entity).orderBy(month)))


def anomaly_feed(fact: DataFrame, tags: DataFrame, published: DataFrame, entity: str, day: str, slice_col: str,
                 measures: Mapping[str, Column]) -> DataFrame:
    """Daily entity x slice roll-up, small entities folded into one, only rows
    that are not published yet. Published keys of the touched days only."""
    d = left_join_sparse(fact, tags, entity).withColumn(
        entity, F.when(F.col("tag") == "SME", F.lit("SME")).otherwise(F.col(entity).cast("string")))
    rolled = d.groupBy(day, entity, slice_col).agg(*[c.alias(n) for n, c in measures.items()], F.count("*").alias("total"))
    return rolled.join(published.select(day, entity, slice_col).distinct(), [day, entity, slice_col], "left_anti")


def submit_payment_feed(events: DataFrame, pay: DataFrame, entity: str, day: str, submit: Column) -> DataFrame:
    """Submits next to payment attempts per entity and day."""
    s = events.filter(submit).groupBy(day, entity).agg(F.count("*").alias("submits"))
    p = pay.groupBy(day, entity).agg(F.count("*").alias("payment_attempts"))
    return s.join(p, [day, entity], "left")


def order_frequency(pay: DataFrame, customer: str, day: str, amount: str) -> DataFrame:
    """Distribution of customers by average orders per active week."""
    per = pay.groupBy(customer, F.trunc(day, "week").alias("__w")).agg(F.count("*").alias("n"), sum_money(amount).alias("g"))
    c = per.groupBy(customer).agg(F.round(F.sum("n") / F.count("*"), 0).alias("orders_per_week"), F.sum("n").alias("n"),
                                  F.sum(F.col("g").cast("decimal(24,2)")).alias("g"))
    return c.groupBy("orders_per_week").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.sum("g").cast("double").alias("gmv"))


def wallet_share(pay: DataFrame, customer: str, focus: Column, by: Sequence[str], amount: str) -> DataFrame:
    """Users, orders and amount at focus entities against the rest, and the share
    of wallet, for customers that bought at a focus entity."""
    d = pay.withColumn("group", F.when(focus, "focus").otherwise("rest"))
    buyers = d.filter(focus).select(customer).distinct()
    g = d.join(buyers, customer, "left_semi").groupBy(*by, "group").agg(
        F.countDistinct(customer).alias("customers"), F.count("*").alias("orders"), sum_money(amount).alias("gmv"))
    return with_report_totals(g, by, {"__g": F.sum("gmv")}).withColumn("wallet_share", ratio("gmv", "__g")).drop("__g")


def gmv_with_cutover(df: DataFrame, by: Sequence[str], ts: str, cutover, amount: str) -> DataFrame:
    """Amount whose unit changed at a point in time: major before, minor after."""
    a = F.col(amount).cast("decimal(20,4)")
    fixed = F.when(F.col(ts) < F.lit(cutover), a).otherwise((a / 100).cast("decimal(20,4)"))
    return df.groupBy(*by).agg(F.sum(fixed).cast("double").alias("gmv"), F.count("*").alias("orders"))


def category_sr(pay: DataFrame, period: Column, ident: str, success: Column, keep: Column) -> DataFrame:
    """Benchmark success rate of a category and library subset per period."""
    out = count_ids(pay.filter(keep).withColumn("period_start", period), ["period_start"], ident, {"attempts": F.lit(True), "successes": success})
    return out.withColumn("sr", ratio("successes", "attempts"))


def cod_funnel(events: DataFrame, pay: DataFrame, period: str, ident: str, selected: Column, submitted: Column) -> DataFrame:
    """COD select, submit, success per period with step rates."""
    e = count_ids(events, [period], ident, {"selected": selected, "submitted": submitted})
    p = pay.groupBy(period).agg(F.count("*").alias("paid"))
    return e.join(p, period, "left").withColumns({"submit_rate": ratio("submitted", "selected"), "paid_rate": ratio("paid", "submitted")})


def api_payment_join(calls: DataFrame, fact: DataFrame, pay: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """API calls joined to the checkout and its payments: calls per outcome with
    conversion. Calls and payments are counted per checkout first, so no call row is joined; the attempts of a checkout count once for each of its calls."""
    p = pay.groupBy(key).agg(F.count("*").alias("attempts"), F.max(flag(F.col("success"))).alias("paid"))
    c = calls.groupBy(key).agg(F.count("*").alias("__calls"))
    d = c.join(fact, key).join(p, key, "left")
    per = d.groupBy(*by, key).agg(F.sum(F.col("attempts") * F.col("__calls")).alias("attempts"), F.max("paid").alias("paid"))
    return per.groupBy(*by).agg(
        F.count("*").alias("checkouts"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"),
        F.coalesce(F.sum("paid"), F.lit(0)).cast("bigint").alias("paid_checkouts")).withColumn("cr", ratio("paid_checkouts", "checkouts"))
