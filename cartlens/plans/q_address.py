import datetime as dt

from pyspark.sql import functions as F

from ..functions.expr import flag, label_null, rounded
from ..functions.periods import period_start
from ..operators import address as op
from ..operators import identity as who
from ..operators import lookup
from .q_activity import rounded_all
from .registry import query
from .views import AS_OF, sql

# Addresses stand on customers: the id is the customer, the person its nation.
ADDR = """addr AS (SELECT c_custkey AS id, c_nationkey AS entity_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) END AS source_type,
    c_nationkey % 7 AS city, DATE '2023-12-01' + CAST(c_custkey % 61 AS INTEGER) AS created_date FROM customer)"""
SOURCES = ["user_saved", "automobile", "furniture", "household", "machinery"]


def addresses(t):
    seg = F.col("c_mktsegment")
    return t.raw("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("entity_id"), F.when(seg != "BUILDING", F.lower(seg)).alias("source_type"),
        (F.col("c_nationkey") % 7).alias("city"), F.date_add(F.lit(dt.date(2023, 12, 1)), (F.col("c_custkey") % 61).cast("int")).alias("created_date"))


@query("d30_prefill_rate", sql("cf", """
l AS (SELECT dt, checkout_id, CAST(max_k % 3 AS VARCHAR) AS source, min_k % 2 = 1 AS p FROM cf WHERE open = 1 AND os <> 2 AND browser <> 3),
b AS (SELECT dt, count(*) AS loaded FROM l GROUP BY 1),
h AS (SELECT dt, 'all' AS source, count(*) AS prefilled FROM l WHERE p GROUP BY 1 UNION ALL SELECT dt, source, count(*) FROM l WHERE p GROUP BY 1, 2)
SELECT *, round(prefilled::DOUBLE / loaded, 6) AS rate FROM h JOIN b USING (dt)"""), dates="dt")
def _(t):
    c = t.checkouts().filter("open = 1").withColumn("source", (F.col("max_k") % 3).cast("string"))
    out = op.prefill_rate(c, "dt", "checkout_id", (F.col("os") != 2) & (F.col("browser") != 3), F.col("min_k") % 2 == 1, "source")
    return rounded_all(out, ["rate"])


@query("d31_address_prefill", sql("ev", """
s AS (SELECT DISTINCT checkout_id FROM ev WHERE event_type = 'view'),
a AS (SELECT dt, count(DISTINCT checkout_id) AS summary_prelogged_in FROM ev WHERE event_type = 'signup' AND k % 2 = 0 AND checkout_id NOT IN (SELECT checkout_id FROM s) GROUP BY 1),
b AS (SELECT dt, count(DISTINCT checkout_id) FILTER (event_type = 'signup') AS total, count(DISTINCT checkout_id) FILTER (event_type = 'view') AS saved_screen FROM ev GROUP BY 1)
SELECT dt, total, saved_screen, coalesce(summary_prelogged_in, 0) AS summary_prelogged_in, round(coalesce(summary_prelogged_in, 0)::DOUBLE / total, 6) AS summary_rate,
  round(saved_screen::DOUBLE / total, 6) AS saved_rate, round((coalesce(summary_prelogged_in, 0) + saved_screen)::DOUBLE / total, 6) AS prefill_rate FROM b LEFT JOIN a USING (dt) WHERE total > 0"""), dates="dt")
def _(t):
    e = F.col("event_type")
    out = op.address_prefill(t.events(), "dt", "checkout_id", e == "signup", F.col("k") % 2 == 0, e == "view")
    return rounded_all(out, ["summary_rate", "saved_rate", "prefill_rate"])


#: One source has no column of its own; its addresses count in the totals all the same.
LISTED = SOURCES[:-1]


@query("d38_address_inventory", sql("ev", ADDR + """,
g AS (SELECT CASE WHEN created_date < DATE '2023-12-15' THEN 'Addresses so far' ELSE CAST(CAST(date_trunc('week', created_date) AS DATE) AS VARCHAR) END AS added, coalesce(source_type, 'user_saved') AS s FROM addr),
p AS (SELECT added, """ + ", ".join(f"count(*) FILTER (s = '{s}') AS {s}" for s in LISTED) + """, count(*) AS total FROM g GROUP BY 1)
SELECT *, CAST(sum(total) OVER (ORDER BY CASE WHEN added = 'Addresses so far' THEN 0 ELSE 1 END, added) AS BIGINT) AS running_total FROM p"""))
def _(t):
    return op.address_inventory(addresses(t), dt.date(2023, 12, 15), period_start("created_date", "week"), LISTED)


@query("d39_address_utilization", sql("ev", ADDR + """,
u AS (SELECT DISTINCT period, device_id * 10 + k % 10 AS address_id FROM ev WHERE event_type IN ('view', 'click')),
n AS (SELECT coalesce(source_type, 'user_saved') AS address_source, period, count(*) AS addresses_used FROM u LEFT JOIN addr ON address_id = id GROUP BY 1, 2),
a AS (SELECT coalesce(source_type, 'user_saved') AS address_source, count(DISTINCT id) AS all_addresses FROM addr WHERE created_date < DATE '2024-01-20' GROUP BY 1)
SELECT *, round(addresses_used::DOUBLE / all_addresses, 6) AS utilization FROM a LEFT JOIN n USING (address_source)"""))
def _(t):
    used = t.events().filter(F.col("event_type").isin("view", "click")).select("period", (F.col("device_id") * 10 + F.col("k") % 10).alias("address_id"))
    return rounded_all(op.address_utilization(used, addresses(t), "period", dt.date(2024, 1, 20)), ["utilization"])


PROBS = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@query("d40_address_distribution", sql("ev", ADDR + """,
p AS (SELECT coalesce(source_type, 'user_saved') AS address_source, entity_id, count(DISTINCT id) AS n FROM addr GROUP BY 1, 2)
SELECT address_source, round(sum(n)::DOUBLE / count(*), 6) AS mean, count(*) AS persons, """ + ", ".join(f"round(quantile_cont(n, {v}), 6) AS {k}" for k, v in PROBS.items()) + " FROM p GROUP BY 1"))
def _(t):
    return rounded_all(op.address_distribution(addresses(t), "entity_id", PROBS), ["mean", *PROBS])


TIERS = ["1", "2", "No City Tier"]


@query("d40_city_tier_mix", sql("ev", ADDR + """,
c AS (SELECT merchant_id, device_id * 10 + k % 10 AS address_id FROM ev WHERE event_type = 'purchase'),
d AS (SELECT merchant_id, CASE WHEN city < 3 THEN '1' WHEN city < 5 THEN '2' ELSE 'No City Tier' END AS tier FROM c LEFT JOIN addr ON id = address_id),
g AS (SELECT merchant_id, tier, count(*) AS n FROM d GROUP BY 1, 2), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY merchant_id) AS share FROM g)
SELECT merchant_id, """ + ", ".join(f"""round(max(share) FILTER (tier = '{v}'), 6) AS "share_{v}" """ for v in TIERS) + " FROM s GROUP BY 1"))
def _(t):
    c = t.events().filter("event_type = 'purchase'").select("merchant_id", (F.col("device_id") * 10 + F.col("k") % 10).alias("address_id"))
    tiers = addresses(t).select("city").distinct().filter("city < 5").withColumn("tier", F.when(F.col("city") < 3, "1").otherwise("2"))
    out = op.city_tier_mix(c, addresses(t), tiers, "merchant_id", "city", "tier", TIERS)
    return rounded_all(out, [f"share_{v}" for v in TIERS])


@query("d93_creation_rate", sql("ev", ADDR + """,
t AS (SELECT dt, count(DISTINCT checkout_id) AS checkouts FROM ev GROUP BY 1),
a AS (SELECT created_date AS dt, coalesce(source_type, 'user_saved') AS address_source, count(DISTINCT id) AS new_addresses FROM addr GROUP BY 1, 2)
SELECT *, round(new_addresses::DOUBLE / checkouts, 6) AS creation_rate FROM t LEFT JOIN a USING (dt)"""), dates="dt")
def _(t):
    return rounded_all(op.creation_rate(addresses(t), t.events(), "dt", "checkout_id"), ["creation_rate"])


@query("d94_prelogin_rate", sql("cf", """
g AS (SELECT browser, os, count(*) FILTER (min_k % 2 = 0) AS logged_in, count(*) FILTER (min_k % 2 <> 0) AS logged_out, count(*) FILTER (open = 1 AND render = 0) AS summary, count(*) FILTER (render = 1) AS saved FROM cf GROUP BY 1, 2)
SELECT *, logged_in + logged_out AS total, round(logged_in::DOUBLE / (logged_in + logged_out), 6) AS prelogin_rate, round(saved::DOUBLE / (saved + summary), 6) AS saved_contribution,
  round(summary::DOUBLE / (saved + summary), 6) AS summary_contribution FROM g"""))
def _(t):
    out = op.prelogin_rate(t.checkouts(), ["browser", "os"], "checkout_id", F.col("min_k") % 2 == 0, (F.col("open") == 1) & (F.col("render") == 0), F.col("render") == 1)
    return rounded_all(out, ["prelogin_rate", "saved_contribution", "summary_contribution"])


@query("d95_partner_address", sql("ev", """
SELECT dt, count(DISTINCT checkout_id) AS checkouts, count(DISTINCT checkout_id) FILTER (event_type = 'click' AND k % 3 = 1 AND k > 0) AS api_returns_address,
  count(DISTINCT checkout_id) FILTER (event_type = 'error' AND k % 2 = 0) AS access_address_otp FROM ev WHERE merchant_id NOT IN (1, 2) GROUP BY 1"""), dates="dt")
def _(t):
    e = F.col("event_type")
    k = F.col("k")
    text = F.when(k % 3 == 1, k.cast("string")).when(k % 3 == 2, "n/a").otherwise("")
    reason = F.when(k % 2 == 0, "otp_access_address").otherwise("login")
    ramp = t.events().select("merchant_id").distinct().filter(F.col("merchant_id").isin(1, 2))
    return op.partner_address(t.events(), ramp, "merchant_id", "dt", "checkout_id", text, e == "click", e == "error", reason)


@query("d46_happiness_index", sql("cf rto", """
m AS (SELECT DISTINCT merchant_id, DATE '2024-01-02' + CAST(merchant_id % 3 AS INTEGER) AS live, DATE '2001-03-01' + CAST(merchant_id AS INTEGER) AS olive, CASE WHEN merchant_id % 2 = 1 THEN merchant_id * 3.0::DOUBLE END AS pre_cr,
    CASE WHEN merchant_id % 3 = 0 THEN 30.0::DOUBLE END AS pre_rto FROM ev),
f0 AS (SELECT c.*, m.pre_cr, live FROM cf c JOIN m USING (merchant_id)),
fd AS (SELECT merchant_id, min(dt) AS fd FROM f0 WHERE dt >= live AND open = 1 GROUP BY 1),
f AS (SELECT *, date_diff('day', fd, dt) AS since, date_diff('day', dt, DATE '2024-01-31') AS ago FROM f0 JOIN fd USING (merchant_id)),
c AS (SELECT merchant_id, count(*) FILTER (since BETWEEN 0 AND 20 AND submit = 1) * 100.0::DOUBLE / nullif(count(*) FILTER (since BETWEEN 0 AND 20 AND open = 1), 0) AS first_cr,
  count(*) FILTER (ago BETWEEN 1 AND 31 AND (pre_cr IS NOT NULL OR since > 20) AND submit = 1) * 100.0::DOUBLE / nullif(count(*) FILTER (ago BETWEEN 1 AND 31 AND (pre_cr IS NOT NULL OR since > 20) AND open = 1), 0) AS recent_cr,
  count(*) FILTER (ago BETWEEN 1 AND 31 AND render = 1 AND os <> 2 AND min_k % 2 = 1) * 100.0::DOUBLE / nullif(count(*) FILTER (ago BETWEEN 1 AND 31 AND render = 1 AND os <> 2), 0) AS prefill_pct,
  count(*) FILTER (ago BETWEEN 1 AND 31 AND render = 1 AND max_k % 2 = 1) * 100.0::DOUBLE / nullif(count(*) FILTER (ago BETWEEN 1 AND 31 AND render = 1), 0) AS prelogin_pct,
  quantile_cont(max_k / 10.0::DOUBLE, 0.5) FILTER (ago BETWEEN 1 AND 31) AS load, quantile_cont(CAST(gmv AS DOUBLE), 0.5) FILTER (ago BETWEEN 1 AND 31) AS done FROM f GROUP BY 1),
o0 AS (SELECT r.merchant_id % 10 AS merchant_id, created_date, status, olive, pre_rto FROM rto r JOIN m ON m.merchant_id = r.merchant_id % 10),
od AS (SELECT merchant_id, min(created_date) AS fo FROM o0 WHERE created_date >= olive GROUP BY 1),
o AS (SELECT *, date_diff('day', fo, created_date) AS since, date_diff('day', created_date, DATE '2001-08-01') AS ago FROM o0 JOIN od USING (merchant_id)),
r AS (SELECT merchant_id, count(*) FILTER (since BETWEEN 0 AND 21 AND status = 'rto') * 100.0::DOUBLE / nullif(count(*) FILTER (since BETWEEN 0 AND 21), 0) AS first_rto,
  count(*) FILTER (ago BETWEEN 15 AND 44 AND (pre_rto IS NOT NULL OR since > 20) AND status = 'rto') * 100.0::DOUBLE / nullif(count(*) FILTER (ago BETWEEN 15 AND 44 AND (pre_rto IS NOT NULL OR since > 20)), 0) AS recent_rto FROM o GROUP BY 1)
SELECT merchant_id, round(coalesce(pre_cr, first_cr), 6) AS baseline_cr, round(recent_cr, 6) AS recent_cr, round(coalesce(pre_rto, first_rto), 6) AS baseline_rto, round(recent_rto, 6) AS recent_rto,
  round(load, 6) AS p50_load_s, round(done, 6) AS p50_completion_s, round(prefill_pct, 6) AS prefill_pct, round(prelogin_pct, 6) AS prelogin_pct FROM m LEFT JOIN c USING (merchant_id) LEFT JOIN r USING (merchant_id)"""))
def _(t):
    from .q_facts import order_status
    i = F.col("merchant_id")
    m = t.events().select("merchant_id").distinct().select(
        "merchant_id", F.date_add(F.lit(dt.date(2024, 1, 2)), (i % 3).cast("int")).alias("live_date"), F.date_add(F.lit(dt.date(2001, 3, 1)), i.cast("int")).alias("order_live_date"),
        F.when(i % 2 == 1, i * 3.0).alias("pre_cr"), F.when(i % 3 == 0, 30.0).alias("pre_rto"))
    f = t.checkouts().select(
        "merchant_id", "dt", "open", "submit", F.col("render").alias("loaded"), flag(F.col("os") != 2).alias("applicable"), flag(F.col("min_k") % 2 == 1).alias("prefilled"),
        flag(F.col("max_k") % 2 == 1).alias("prelogin"), (F.col("max_k") / 10.0).alias("load_s"), F.col("gmv").cast("double").alias("complete_s"))
    o = order_status(t).select((F.col("merchant_id") % 10).alias("merchant_id"), "created_date", flag(F.col("status") == "rto").alias("rto"))
    out = who.happiness_index(m, f, o, AS_OF, dt.date(2001, 8, 1))
    return rounded_all(out, [c for c in out.columns if c != "merchant_id"])


CHANNELS = ["view", "click", "error"]


@query("d47_last_seen_by_channel", sql("gaps", """
a AS (SELECT DISTINCT device_id, dt AS anchor FROM gaps WHERE event_type = 'purchase')
SELECT device_id, anchor, """ + ", ".join(f"max(e.dt) FILTER (event_type = '{c}') AS last_{c}" for c in CHANNELS) + """
FROM a LEFT JOIN (SELECT DISTINCT device_id AS d2, dt, event_type FROM gaps) e ON a.device_id = e.d2 AND e.dt < anchor GROUP BY 1, 2"""), dates="anchor last_view last_click last_error")
def _(t):
    e = t.gappy_events()
    a = e.filter("event_type = 'purchase'").select("device_id", F.col("dt").alias("anchor")).distinct()
    return lookup.last_seen_by_channel(a, e.select("device_id", "dt", "event_type"), "device_id", "anchor", "dt", "event_type", CHANNELS)


@query("d104_days_since_last", sql("ev", """
d AS (SELECT device_id, max(dt) FILTER (event_type='view') AS a, min(dt) FILTER (event_type='click') AS b, max(dt) FILTER (event_type='error') AS c, max(dt) FILTER (event_type='purchase') AS anchor FROM ev GROUP BY 1),
l AS (SELECT anchor, list_max(list_filter([a, b, c], x -> x < anchor)) AS last FROM d),
g AS (SELECT date_diff('day', last, anchor) AS days_since FROM l) SELECT days_since, count(*) AS devices FROM g GROUP BY 1""").replace("x -> x < anchor", "lambda x: x < anchor"))
def _(t):
    e = F.col("event_type")
    on = lambda n: F.when(e == n, F.col("dt"))
    d = t.events().groupBy("device_id").agg(F.max(on("view")).alias("a"), F.min(on("click")).alias("b"), F.max(on("error")).alias("c"), F.max(on("purchase")).alias("anchor"))
    return lookup.days_since_last(d, ["a", "b", "c"], "anchor").groupBy(F.col("days_since").cast("bigint").alias("days_since")).agg(F.count("*").alias("devices"))


REPEAT = "f AS (SELECT device_id, min(dt) AS fd FROM {s} GROUP BY 1), v AS (SELECT *, CASE WHEN dt = fd THEN 'new' ELSE 'repeating' END AS visitor FROM {s} JOIN f USING (device_id))"


@query("d51_new_vs_repeat", sql("ev", REPEAT.format(s="ev") + """,
g AS (SELECT dt, visitor, count(DISTINCT device_id) AS devices, count(DISTINCT checkout_id) AS checkouts FROM v GROUP BY 1, 2)
SELECT *, round(devices::DOUBLE / sum(devices) OVER (PARTITION BY dt), 6) AS device_share, round(checkouts::DOUBLE / sum(checkouts) OVER (PARTITION BY dt), 6) AS checkout_share FROM g"""), dates="dt")
def _(t):
    return rounded_all(who.new_vs_repeat(t.events(), "device_id", "dt", "checkout_id", ["dt"]), ["device_share", "checkout_share"])


@query("d51_repeat_rate_percentiles", sql("ev", REPEAT.format(s="ev") + """,
g AS (SELECT merchant_id, count(DISTINCT device_id) FILTER (visitor='new') AS n, count(DISTINCT device_id) FILTER (visitor='repeating') AS r FROM v GROUP BY 1)
SELECT """ + ", ".join(f"round(quantile_cont(r::DOUBLE / (n + r), {v}), 6) AS {k}" for k, v in PROBS.items()) + " FROM g"))
def _(t):
    return rounded_all(who.repeat_rate_percentiles(t.events(), "merchant_id", "device_id", "dt", PROBS), list(PROBS))


@query("d51_repeat_conversion", sql("cf", REPEAT.format(s="cf") + """
SELECT aov, visitor, count(*) AS checkouts, CAST(sum(paid) AS BIGINT) AS converted, round(sum(paid)::DOUBLE / count(*), 6) AS cr FROM v GROUP BY 1, 2"""))
def _(t):
    return rounded_all(who.repeat_conversion(t.checkouts(), "device_id", "dt", ["aov"], "paid"), ["cr"])


@query("d110_repeat_share", sql("cf", REPEAT.format(s="cf") + """
SELECT aov, CASE WHEN merchant_id < 4 THEN 'fashion' ELSE 'grocery' END AS category, count(*) AS checkouts, count(*) FILTER (visitor='repeating') AS repeating,
  round(count(*) FILTER (visitor='repeating')::DOUBLE / count(*), 6) AS repeat_share FROM v GROUP BY 1, 2"""))
def _(t):
    cats = t.events().select("merchant_id").distinct().withColumn("category", F.when(F.col("merchant_id") < 4, "fashion").otherwise("grocery"))
    return rounded_all(who.repeat_share(t.checkouts(), cats, "merchant_id", "device_id", "dt", ["aov"]), ["repeat_share"])


# a session of six hours stands for a checkout here, so that a device has several a day
SLOT = "ev2 AS (SELECT *, checkout_id || '-' || (hour(ts) // 2) AS slot FROM ev)"


def slotted(t):
    return t.events().withColumn("slot", F.concat_ws("-", "checkout_id", F.floor(F.hour("ts") / 2)))


@query("d109_device_day_counts", sql("ev", SLOT + """,
p AS (SELECT device_id, dt, count(DISTINCT slot) AS checkouts FROM ev2 GROUP BY 1, 2), g AS (SELECT checkouts, count(*) AS device_days FROM p GROUP BY 1)
SELECT *, round(device_days::DOUBLE / sum(device_days) OVER (), 6) AS share FROM g"""))
def _(t):
    return rounded_all(who.device_day_counts(slotted(t), "device_id", "dt", "slot"), ["share"])


@query("d109_exclude_heavy_devices", sql("ev", SLOT + """,
h AS (SELECT device_id FROM ev2 GROUP BY device_id, dt HAVING count(DISTINCT slot) > 6)
SELECT event_id, device_id FROM ev2 WHERE device_id NOT IN (SELECT device_id FROM h)"""))
def _(t):
    return who.exclude_heavy_devices(slotted(t), "device_id", "dt", "slot", 6).select("event_id", "device_id")


@query("d72_identity_overlap", sql("ev", """
a AS (SELECT device_id, checkout_id FROM ev WHERE dt >= DATE '2024-01-16' AND event_type = 'purchase'),
k AS (SELECT device_id FROM ev WHERE event_type = 'signup' AND merchant_id < 8 GROUP BY 1 HAVING min(dt) < DATE '2024-01-03'),
s AS (SELECT count(DISTINCT device_id) AS contacts, count(DISTINCT device_id) FILTER (device_id IN (SELECT device_id FROM k)) AS known_contacts, count(DISTINCT checkout_id) AS checkouts,
  count(DISTINCT checkout_id) FILTER (device_id IN (SELECT device_id FROM k)) AS known_checkouts FROM a)
SELECT *, round(known_contacts::DOUBLE / contacts, 6) AS contact_share, round(known_checkouts::DOUBLE / checkouts, 6) AS checkout_share FROM s"""))
def _(t):
    e = t.events()
    a = e.filter((F.col("dt") >= F.lit(dt.date(2024, 1, 16))) & (F.col("event_type") == "purchase"))
    b = e.filter("event_type = 'signup' and merchant_id < 8")
    out = who.identity_overlap(a, b, "device_id", "dt", "checkout_id", dt.date(2024, 1, 3))
    return rounded_all(out, ["contact_share", "checkout_share"])


@query("d69_coupon_conversion", sql("cf", """
SELECT arm, CAST(max_k >= 60 AS BIGINT) AS coupon_available, CAST(max_k >= 60 AND submit = 1 AS BIGINT) AS coupon_applied, count(*) AS checkouts, CAST(sum(paid) AS BIGINT) AS converted,
  round(sum(paid)::DOUBLE / count(*), 6) AS cr FROM cf GROUP BY 1, 2, 3"""))
def _(t):
    big = F.col("max_k") >= 60
    out = who.coupon_conversion(t.checkouts(), "checkout_id", ["arm"], big, big & (F.col("submit") == 1), F.col("paid") == 1)
    return rounded_all(out, ["cr"])
