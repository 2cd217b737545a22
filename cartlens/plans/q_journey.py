import datetime as dt

from pyspark.sql import functions as F

from ..functions.expr import flag, money, rounded
from ..functions.grouped import exact_quantiles, with_totals
from ..functions.periods import period_start
from ..operators import journey as op
from ..operators import lookup, stats
from ..functions.expr import bands
from .q_activity import rounded_all
from .q_funnel import REASON_SQL, with_reason
from .q_joins import signups_and_visits
from .registry import query
from .views import sql

PROBS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def pct(c, extra=""):
    return ", ".join(f"round(quantile_cont({c}, {v}){extra}, 9) AS {k}" for k, v in PROBS.items())


@query("d48_delivery_latency", sql("ev", f"""
m AS (SELECT merchant_id AS template, checkout_id, (epoch_us(min(ts) FILTER (event_type='click')) - epoch_us(min(ts) FILTER (event_type='view'))) / 1000000.0::DOUBLE AS latency
  FROM ev GROUP BY 1, 2 HAVING count(*) FILTER (event_type='click') > 0)
SELECT template, count(*) AS messages, count(latency) AS with_latency, {pct("latency")} FROM m GROUP BY 1"""))
def _(t):
    e = t.events().withColumnRenamed("merchant_id", "template")
    k = F.col("event_type")
    return rounded_all(op.delivery_latency(e, "checkout_id", "template", "ts", k == "view", k == "click", PROBS), list(PROBS), 9)


@query("d48_delivery_rate", sql("ev", """
SELECT merchant_id, count(*) FILTER (event_type='purchase') AS n_purchase, count(*) FILTER (event_type='error') AS n_error, count(*) FILTER (event_type='view') AS n_view, count(*) AS total,
  round(count(*) FILTER (event_type='purchase')::DOUBLE / count(*), 6) AS delivered_rate FROM ev GROUP BY 1 HAVING count(*) >= 600"""))
def _(t):
    return rounded_all(op.delivery_rate(t.events(), "merchant_id", "event_id", "event_type", ["purchase", "error", "view"], "purchase", 600), ["delivered_rate"])


@query("d49_journey_paths", sql("ev", "SELECT checkout_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS path, count(*) AS steps FROM ev GROUP BY 1"))
def _(t):
    return op.journey_paths(t.events(), "checkout_id", "ts", "event_id", "event_type")


PATHS = """p AS (SELECT checkout_id, event_type, row_number() OVER w AS depth, string_agg(event_type, ',') OVER (PARTITION BY checkout_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS path,
  lead(ts) OVER w IS NULL AS last FROM gaps WHERE checkout_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY checkout_id ORDER BY ts, event_id))"""


@query("d49_journey_tree", sql("gaps", PATHS + """,
n AS (SELECT path, depth, event_type AS event, count(*) AS checkouts, count(*) FILTER (last) AS ends FROM p GROUP BY 1, 2, 3)
SELECT n.depth, n.event, n.checkouts, n.ends, u.event AS before, u.checkouts AS before_checkouts, u.ends AS before_ends
FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND n.path = u.path || ',' || n.event"""))
def _(t):
    """Nodes of the prefix tree, each beside its parent: names of nodes are hashes, what they stand for is compared."""
    tree = op.journey_tree(t.gappy_events(), "checkout_id", "ts", "event_id", "event_type")
    up = tree.select(F.col("node").alias("parent"), F.col("event").alias("before"), F.col("checkouts").alias("before_checkouts"), F.col("ends").alias("before_ends"))
    return tree.join(up, "parent", "left").drop("node", "parent")


@query("d49_frequent_paths", sql("gaps", PATHS + " SELECT path, count(*) AS checkouts FROM p WHERE last GROUP BY 1 HAVING count(*) >= 2"))
def _(t):
    return op.frequent_paths(t.gappy_events(), "checkout_id", "ts", "event_id", "event_type", 2)


@query("d49_event_positions", sql("gaps", """
r AS (SELECT *, CASE WHEN checkout_id IS NOT NULL AND ts IS NOT NULL THEN row_number() OVER (PARTITION BY checkout_id, ts IS NULL ORDER BY ts, event_id) END AS pos FROM gaps)
SELECT event_type, count(DISTINCT checkout_id) AS checkouts, round(sum(pos)::DOUBLE / count(pos), 6) AS mean_position FROM r GROUP BY 1"""))
def _(t):
    return rounded_all(op.event_positions(t.gappy_events(), "checkout_id", "ts", "event_id", "event_type"), ["mean_position"])


@query("d50_dwell_time", sql("gaps", f"""
n AS (SELECT event_type, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0::DOUBLE AS dwell, lead(event_type) OVER w AS nx FROM gaps WHERE checkout_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY checkout_id ORDER BY ts, event_id))
SELECT {pct("dwell")} FROM n WHERE event_type = 'view' AND nx <> 'view'"""))
def _(t):
    return rounded_all(op.dwell_time(t.gappy_events(), "checkout_id", "ts", "event_id", "event_type", "view", PROBS), list(PROBS), 9)


TREND_DAYS = 28


@query("d52_trend_shape", sql("cf", f"""
g AS (SELECT merchant_id, date_diff('day', DATE '2024-01-01', dt) + 1 AS day_no, sum(paid)::DOUBLE / count(*) AS v FROM cf GROUP BY 1, 2),
d AS (SELECT *, count(v) OVER (PARTITION BY merchant_id) AS days, CASE WHEN day_no <= 7 THEN 1 ELSE 2 END AS part FROM g WHERE day_no BETWEEN 1 AND {TREND_DAYS}),
z AS (SELECT *, abs((v - avg(v) OVER (PARTITION BY merchant_id)) / nullif(stddev_pop(v) OVER (PARTITION BY merchant_id), 0)) AS z0,
  abs((v - avg(v) OVER (PARTITION BY merchant_id, part)) / nullif(stddev_pop(v) OVER (PARTITION BY merchant_id, part), 0)) AS z1 FROM d WHERE days = {TREND_DAYS}),
s AS (SELECT merchant_id, corr(v, day_no) FILTER (z0 < 3) AS corr, regr_slope(v, day_no) AS slope, corr(v, day_no) FILTER (part = 1 AND z1 < 3) AS corr_first, regr_slope(v, day_no) FILTER (part = 1) AS slope_first,
  corr(v, day_no) FILTER (part = 2 AND z1 < 3) AS corr_after, regr_slope(v, day_no) FILTER (part = 2) AS slope_after FROM z GROUP BY 1)
SELECT merchant_id, round(corr, 6) AS corr, round(slope, 6) AS slope, round(corr_first, 6) AS corr_first, round(slope_first, 6) AS slope_first, round(corr_after, 6) AS corr_after, round(slope_after, 6) AS slope_after,
  CASE WHEN slope_first < 0 AND slope > 0 THEN 'Slope Increased after the first week' WHEN slope_first > 0 AND slope < 0 THEN 'Slope Decreased after the first week'
  WHEN slope_first > 0 AND slope > 0 THEN 'Trend stayed positive' WHEN slope_first < 0 AND slope < 0 THEN 'Trend stayed negative' ELSE '' END AS category FROM s"""))
def _(t):
    from ..functions.expr import ratio
    g = t.checkouts().groupBy("merchant_id", (F.datediff("dt", F.lit("2024-01-01")) + 1).alias("day_no")).agg(ratio(F.sum("paid"), F.count("*")).alias("v"))
    out = stats.trend_shape(g, "merchant_id", "day_no", "v", last=TREND_DAYS)
    return rounded_all(out, [c for c in out.columns if c.startswith(("corr", "slope"))])


@query("d53_volume_buckets", sql("cf", f"""
e AS (SELECT device_id, count(*) AS n, sum(paid)::DOUBLE / count(*) AS cr FROM cf GROUP BY 1),
b AS (SELECT *, CASE WHEN n > 0 AND n <= 25 THEN 'small' WHEN n > 25 AND n <= 27 THEN 'middle' WHEN n > 27 AND n <= 1000 THEN 'large' END AS bucket FROM e)
SELECT bucket, count(*) AS entities, round(avg(cr), 6) AS mean, {pct("cr")} FROM b WHERE bucket IS NOT NULL GROUP BY 1"""))
def _(t):
    from ..functions.expr import ratio
    e = t.checkouts().groupBy("device_id").agg(F.count("*").alias("n"), ratio(F.sum("paid"), F.count("*")).alias("cr"))
    out = stats.volume_buckets(e, "n", [0, 25, 27, 1000], ["small", "middle", "large"], "cr", PROBS)
    return rounded_all(rounded_all(out, list(PROBS), 9), ["mean"])


BAND_SQL = """count(*) AS total, round(count(*) FILTER (reason = 'Summary Screen CTA clicked')::DOUBLE / count(*), 6) AS converted, round(count(*) FILTER (reason = 'Summary Screen did not load')::DOUBLE / count(*), 6) AS pre_load_dropoff,
  round(count(*) FILTER (reason = 'Bounced w/o any interaction')::DOUBLE / count(*), 6) AS post_load_bounce,
  round(count(*) FILTER (reason LIKE 'Interacted%')::DOUBLE / count(*), 6) AS post_engagement_dropoff"""
SHARES = ["converted", "pre_load_dropoff", "post_load_bounce", "post_engagement_dropoff"]


@query("d54_aov_profile", sql("cf", f"""
r AS (SELECT *, {REASON_SQL} AS reason, quantile_cont(CAST(gmv AS DOUBLE), 0.5) OVER (PARTITION BY device_id) AS med FROM cf)
SELECT CASE WHEN med > 0 AND med <= 25 THEN '(0, 25]' WHEN med > 25 AND med <= 28 THEN '(25, 28]' WHEN med > 28 AND med <= 500 THEN '(28, 500]' END AS entity_band, os, {BAND_SQL} FROM r GROUP BY 1, 2"""))
def _(t):
    c = with_reason(t.checkouts()).withColumn("gmv", F.col("gmv").cast("double"))
    return rounded_all(op.aov_profile(c, "device_id", "gmv", [0, 25, 28, 500], "os", "checkout_id", "reason"), SHARES)


@query("d54_aov_percentiles", sql("cf", f"SELECT merchant_id, {pct('CAST(gmv AS DOUBLE)')} FROM cf GROUP BY 1"))
def _(t):
    c = t.checkouts().select("merchant_id", F.col("gmv").cast("double").alias("gmv"))
    return rounded_all(exact_quantiles(c, ["merchant_id"], "gmv", PROBS), list(PROBS), 9)


# the load time in ms stands on the checkout's amount
LOAD_SQL = "CAST(gmv AS DOUBLE) * 100"


@query("d55_load_time_profile", sql("cf", f"""
w AS (SELECT CAST(date_trunc('week', dt) AS DATE) AS week, {LOAD_SQL} AS ms FROM cf) SELECT week, count(*) AS loads, {pct("ms")} FROM w GROUP BY 1"""), dates="week")
def _(t):
    c = t.checkouts().select(period_start("dt", "week").alias("week"), (F.col("gmv").cast("double") * 100).alias("ms"))
    out = c.groupBy("week").agg(F.count("*").alias("loads")).join(exact_quantiles(c, ["week"], "ms", PROBS), "week")
    return rounded_all(out, list(PROBS), 9)


@query("d55_conversion_by_load_band", sql("cf", f"""
r AS (SELECT *, {REASON_SQL} AS reason, {LOAD_SQL} AS ms FROM cf)
SELECT CASE WHEN ms > 0 AND ms <= 150 THEN '(0, 150]' WHEN ms > 150 AND ms <= 500 THEN '(150, 500]' WHEN ms > 500 AND ms <= 1000 THEN '(500, 1000]' WHEN ms > 1000 AND ms <= 5000 THEN '(1000, 5000]'
  WHEN ms > 5000 AND ms <= 10000 THEN '(5000, 10000]' WHEN ms > 10000 AND ms <= 60000 THEN '(10000, 60000]' END AS load_band, {BAND_SQL} FROM r GROUP BY 1"""))
def _(t):
    c = with_reason(t.checkouts()).withColumn("load_band", bands(F.col("gmv").cast("double") * 100, op.LOAD_EDGES, right_closed=True))
    return rounded_all(op.conversion_by_band(c, ["load_band"], "checkout_id", "reason"), SHARES)


def partner_report(t):
    """Two days of one partner; payments may belong to orders created before."""
    o = t.raw("orders")
    in_range = F.to_date("o_orderdate") >= F.lit(dt.date(1998, 1, 1))
    orders = o.select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("r"), "o_orderkey").alias("receipt"), in_range.alias("in_range"))
    utm = F.struct(F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("utm_source"), F.concat(F.lit("m"), F.col("o_custkey") % 2).alias("utm_medium"))
    key = F.col("o_custkey")
    meta = o.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("order_id"), F.to_json(F.struct(
        utm.alias("utm_parameters"), F.sequence(F.lit(1).cast("bigint"), key % 5 + 1).alias("line_items"))).alias("value"))
    pay = o.select(F.col("o_orderkey").alias("order_id"), money("o_totalprice").alias("amount"),
                   ((F.col("o_orderstatus") == "F") & (F.to_date("o_orderdate") >= F.lit(dt.date(1997, 12, 1)))).alias("success"))
    return op.partner_orders(orders, meta, pay)


PARTNER = """l AS (SELECT o_orderkey AS l_orderkey, o_custkey % 5 + 1 AS n FROM orders WHERE o_orderkey % 7 <> 0),
r AS (SELECT o_orderkey AS order_id, 'r' || o_orderkey AS receipt, CASE WHEN n IS NOT NULL THEN 's' || (o_custkey % 3) END AS utm_source, CASE WHEN n IS NOT NULL THEN 'm' || (o_custkey % 2) END AS utm_medium,
  CAST(NULL AS VARCHAR) AS utm_campaign, n AS line_items, CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) ELSE 0 END AS order_gmv,
  CAST(o_orderstatus = 'F' AS BIGINT) AS placed FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
  WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' OR (o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) >= DATE '1997-12-01'))"""


@query("d70_partner_orders", "WITH " + PARTNER + " SELECT * FROM r")
def _(t):
    return partner_report(t)


@query("d70_partner_summary", "WITH " + PARTNER + """
SELECT utm_source, utm_medium, utm_campaign, count(*) AS checkout_initiations, CAST(sum(placed) AS BIGINT) AS orders_placed, CAST(sum(CAST(order_gmv AS DECIMAL(18,2))) AS DOUBLE) AS order_gmv FROM r GROUP BY 1, 2, 3""")
def _(t):
    return op.partner_summary(partner_report(t))


@query("d71_partner_hourly", sql("ev", """
r AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-29 07:00:00' AND ts < TIMESTAMP '2024-01-29 12:00:00'),
p AS (SELECT merchant_id, count(DISTINCT checkout_id) AS payments_initiated, count(DISTINCT checkout_id) FILTER (event_type='purchase') AS orders_placed FROM r
  WHERE event_type IN ('purchase','error') AND ts >= TIMESTAMP '2024-01-29 08:00:00' GROUP BY 1)
SELECT r.merchant_id, count(DISTINCT checkout_id) FILTER (event_type='signup') AS initiated, count(DISTINCT checkout_id) FILTER (event_type IN ('view','click')) AS address_done,
  coalesce(max(payments_initiated), 0) AS payments_initiated, coalesce(max(orders_placed), 0) AS orders_placed FROM r LEFT JOIN p ON r.merchant_id = p.merchant_id GROUP BY 1"""))
def _(t):
    e = F.col("event_type")
    pay = t.events().filter(e.isin("purchase", "error")).withColumn("success", e == "purchase")
    return op.partner_hourly(t.events(), pay, "merchant_id", "ts", dt.datetime(2024, 1, 29, 12), 5, "checkout_id",
                             {"initiated": e == "signup", "address_done": e.isin("view", "click")}, "ts", "checkout_id", 4)


@query("d75_touch_attribution", sql("gaps", """
s AS (SELECT device_id, ts AS s_ts, event_id AS signup_id FROM gaps WHERE event_type = 'signup'),
v AS (SELECT device_id, ts AS v_ts, event_id AS visit, k FROM gaps WHERE event_type = 'view')
SELECT signup_id, arg_min(visit, (v_ts, visit)) AS first_visit, arg_min(v, (v_ts, visit)).k AS first_k, arg_max(visit, (v_ts, visit)) AS last_visit, arg_max(v, (v_ts, visit)).k AS last_k FROM s LEFT JOIN v
  ON s.device_id = v.device_id AND v_ts < s_ts AND floor((epoch_us(s_ts) - epoch_us(v_ts)) / 86400000000) <= 3 GROUP BY 1"""))
def _(t):
    s, v = signups_and_visits(t)
    out = lookup.touch_attribution(s, v, "device_id", "signup_id", "s_ts", "v_ts", "visit", ["k"], days=3)
    return out.select("signup_id", "first_visit", "first_k", "last_visit", "last_k")


# What the documents of a page event hold, in SQL that both engines read; k is the event's number, which may be missing.
PAGE = {"medium": "CASE k % 5 WHEN 0 THEN 'cpc' WHEN 1 THEN 'email' END", "source": "CASE k % 4 WHEN 0 THEN 'adnet' END", "adgroup": "CASE WHEN k % 2 = 0 THEN 'group' END", "name": "'c' || CAST(k % 7 AS STRING)",
        "content": "CASE WHEN k % 3 = 0 THEN 'blue' END", "term": "CASE WHEN k % 9 < 4 THEN 'pay' END", "matchtype": "CASE WHEN k % 2 = 1 THEN 'exact' END", "location": "'l' || CAST(k % 3 AS STRING)",
        "network": "CASE k % 4 WHEN 1 THEN 'g' WHEN 2 THEN 's' END", "device": "CASE k % 2 WHEN 0 THEN 'm' ELSE 'c' END", "devicemodel": "CASE k % 8 WHEN 0 THEN 'x1' END",
        "referrer": "CASE k % 6 WHEN 0 THEN 'https://www.Google.com/q' WHEN 1 THEN 'https://bing.com/' WHEN 2 THEN 'https://shop.example/x' WHEN 3 THEN '' WHEN 4 THEN 'https://news.example' END",
        "url": "CASE k % 4 WHEN 0 THEN '/u' END", "title": "CASE k % 4 WHEN 3 THEN 'Title' END", "p_url": "CASE k % 4 WHEN 1 THEN '/p' END", "p_title": "CASE k % 4 WHEN 2 THEN 'Page' END"}
PAGE_SQL = {"acquisition_medium": "coalesce(f_medium, CASE WHEN coalesce(f_referrer, '') = '' OR f_referrer LIKE '%shop.example%' THEN 'website' ELSE 'organic' END)",
            "acquisition_source": "coalesce(f_source, CASE WHEN coalesce(f_referrer, '') = '' OR f_referrer LIKE '%shop.example%' THEN 'direct' WHEN f_referrer ILIKE '%google%' THEN 'google' "
                                  "WHEN f_referrer ILIKE '%bing%' THEN 'bing' ELSE 'others' END)",
            **{n: f"f_{f}" for n, f in op.CAMPAIGN.items()}, "landing_page": "coalesce(f_url, f_p_url, f_p_title, f_title)"}


@query("d75_acquisition", sql("gaps", f"""
s AS (SELECT device_id, ts AS s_ts, event_id AS signup_id FROM gaps WHERE event_type = 'signup'),
p AS (SELECT device_id, ts AS v_ts, event_id AS visit, {", ".join(f"{e} AS f_{n}" for n, e in PAGE.items())} FROM gaps WHERE event_type = 'view' AND device_id IS NOT NULL AND ts IS NOT NULL),
v AS (SELECT device_id, v_ts, visit, {", ".join(f"{e} AS {n}" for n, e in PAGE_SQL.items())} FROM p)
SELECT signup_id, {", ".join(f"arg_min(v, (v_ts, visit)).{c} AS first_{c}, arg_max(v, (v_ts, visit)).{c} AS last_{c}" for c in op.TOUCH)} FROM s LEFT JOIN v
  ON s.device_id = v.device_id AND v_ts < s_ts AND floor((epoch_us(s_ts) - epoch_us(v_ts)) / 86400000000) <= 60 GROUP BY 1"""))
def _(t):
    """First and last touch of each sign-up within 60 days, with medium and source out of the campaign or the referrer."""
    f = {n: F.expr(e) for n, e in PAGE.items()}
    part = lambda names: F.struct(*[f[n].alias(n.removeprefix("p_")) for n in names])
    names = list(PAGE)
    context = F.to_json(F.struct(part(names[:11]).alias("campaign"), part(["referrer", "url", "title"]).alias("page")))
    e = t.gappy_events().filter("event_type = 'view'").select("device_id", F.col("ts").alias("v_ts"), F.col("event_id").alias("visit"), context.alias("context"),
                                                              F.to_json(part(["p_url", "p_title"])).alias("properties"))
    signups = t.gappy_events().filter("event_type = 'signup'").select("device_id", F.col("ts").alias("s_ts"), F.col("event_id").alias("signup_id"))
    visits = op.acquisition_visits(e, "device_id", "v_ts", "visit", ["shop.example"])
    out = lookup.touch_attribution(signups, visits, "device_id", "signup_id", "s_ts", "v_ts", "visit", op.TOUCH, days=60)
    return out.select("signup_id", *[f"{x}_{c}" for c in op.TOUCH for x in ("first", "last")])


# Leads stand on orders: an order is a call to its customer.
@query("d76_lead_enrich", sql("pay", """
c AS (SELECT merchant_id, payment_id, created_date, (['Call later','Mtu done on call','RNR','Others','weird'])[payment_id % 5 + 1] AS status, (['Immediate','7 days','1 month','soon'])[payment_id % 4 + 1] AS go_live,
  (['<10000','1 Cr - 5 Cr','n/a'])[payment_id % 3 + 1] AS potential FROM pay WHERE priority = '1-URGENT'),
w AS (SELECT *, rank() OVER (PARTITION BY merchant_id ORDER BY created_date DESC) AS r, min(created_date) OVER (PARTITION BY merchant_id) AS first_called FROM c),
t AS (SELECT merchant_id, min(created_date) AS ft FROM pay WHERE success GROUP BY 1)
SELECT payment_id, created_date, first_called, first_called + (CASE go_live WHEN 'Immediate' THEN 0 WHEN '7 days' THEN 7 WHEN '1 month' THEN 30 END) AS go_live_date,
  CAST(CASE potential WHEN '<10000' THEN 5000 WHEN '1 Cr - 5 Cr' THEN 25000000 END AS BIGINT) AS potential_amount, CASE status WHEN 'Mtu done on call' THEN 'Interested' WHEN 'RNR' THEN 'Call later' WHEN 'Others' THEN 'Interested' ELSE status END AS status_updated,
  CASE WHEN ft >= first_called THEN 'after_call' WHEN ft < first_called THEN 'before_call' ELSE 'none' END AS activity,
  CASE WHEN w.merchant_id % 4 <> 0 AND w.merchant_id % 50 + coalesce(CASE WHEN w.merchant_id % 3 = 0 THEN 20 END, 0) >= 55 THEN 'HQL' ELSE 'Non-HQL' END AS lead_flag
FROM w LEFT JOIN t ON w.merchant_id = t.merchant_id WHERE r = 1"""), dates="created_date first_called go_live_date")
def _(t):
    p = t.payments()
    pick = lambda names, n: F.element_at(F.array(*[F.lit(v) for v in names]), (F.col("payment_id") % n + 1).cast("int"))
    calls = p.filter("priority = '1-URGENT'").select(
        "merchant_id", "payment_id", "created_date", pick(["Call later", "Mtu done on call", "RNR", "Others", "weird"], 5).alias("status"),
        pick(["Immediate", "7 days", "1 month", "soon"], 4).alias("go_live"), pick(["<10000", "1 Cr - 5 Cr", "n/a"], 3).alias("potential"))
    m = F.col("c_custkey")
    scores = t.raw("customer").filter("c_custkey % 4 <> 0").select(m.alias("merchant_id"), (m % 50).alias("gstin_score"), F.when(m % 3 == 0, 20).alias("domain_score"))
    txn = p.filter("success").groupBy("merchant_id").agg(F.min("created_date").alias("first_txn_date"))
    out = op.lead_enrich(calls, scores, "merchant_id", "created_date", txn)
    return out.select("payment_id", "created_date", "first_called", "go_live_date", "potential_amount", "status_updated", "activity", "lead_flag")


@query("d79_risk_journey", sql("ev", """
st AS (SELECT DISTINCT checkout_id, merchant_id FROM ev WHERE event_type = 'signup' AND merchant_id > 2),
r AS (SELECT checkout_id, arg_max(k % 2 = 0, ts) AS response FROM ev WHERE event_type = 'view' GROUP BY 1),
s AS (SELECT checkout_id, CAST(arg_max(k % 3 = 0, ts) AS BIGINT) AS address_saved FROM ev WHERE event_type = 'click' GROUP BY 1),
m AS (SELECT DISTINCT checkout_id, CASE WHEN k % 5 = 0 THEN 'cod' ELSE 'non-cod' END AS method FROM ev WHERE event_type = 'error'),
b AS (SELECT DISTINCT checkout_id, CASE WHEN k % 5 = 0 THEN 'cod' ELSE 'non-cod' END AS method_submit FROM ev WHERE event_type = 'purchase')
SELECT merchant_id, response, address_saved, method, method_submit, count(DISTINCT checkout_id) AS checkouts FROM st JOIN r USING (checkout_id) JOIN s USING (checkout_id) LEFT JOIN m USING (checkout_id) LEFT JOIN b USING (checkout_id) GROUP BY ALL"""))
def _(t):
    e, k = t.events(), F.col("k")
    on = lambda n: e.filter(F.col("event_type") == n)
    cod = F.when(k % 5 == 0, "cod").otherwise("non-cod")
    return op.risk_journey(
        on("signup").filter("merchant_id > 2"), on("view").withColumn("response", k % 2 == 0), on("click").withColumn("address_saved", flag(k % 3 == 0)),
        on("error").withColumn("method", cod), on("purchase").withColumn("method_submit", cod), "checkout_id", "ts", "event_id", ["merchant_id"])


@query("d83_quantile_tag", sql("pay", """
g AS (SELECT merchant_id, CAST(sum(amount) AS DOUBLE) AS gmv FROM pay GROUP BY 1), q AS (SELECT quantile_cont(gmv, 0.33) AS a, quantile_cont(gmv, 0.67) AS b FROM g)
SELECT merchant_id, gmv, CASE WHEN gmv < a THEN 'low' WHEN gmv < b THEN 'medium' ELSE 'high' END AS tag FROM g, q"""))
def _(t):
    g = t.payments().groupBy("merchant_id").agg(F.sum("amount").cast("double").alias("gmv"))
    return stats.quantile_tag(g, "gmv", [0.33, 0.67], ["low", "medium", "high"])


@query("d89_select_tickets", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'undefined' WHEN conv_id % 4 = 1 THEN 'p' || conv_id WHEN conv_id % 4 = 2 THEN 't' || turn END AS transaction_id, role FROM r WHERE rn = 1)
SELECT conv_id, turn, transaction_id FROM x WHERE role = 'assistant' AND transaction_id IS NOT NULL AND transaction_id <> 'undefined'""")
def _(t):
    c = F.col("conv_id") % 4
    d = t.raw("conversations").withColumns({
        "payment": F.when(c == 0, "undefined").when(c == 1, F.concat(F.lit("p"), "conv_id")), "affected": F.lit(None).cast("string"),
        "txn": F.when(c == 2, F.concat(F.lit("t"), "turn"))})
    out = op.select_tickets(d, "conv_id", ["turn"], ["payment", "affected", "txn"], F.col("role").like("assist%"))
    return out.select("conv_id", "turn", "transaction_id")


@query("d101_cohort_sample", sql("cf", """
SELECT DISTINCT e.merchant_id, e.checkout_id, e.k, s.tier FROM ev e JOIN cf c USING (checkout_id) JOIN (SELECT checkout_id, max_k % 3 AS tier FROM cf WHERE max_k > 20) s USING (checkout_id)
WHERE c.submit = 1 AND (c.open = 1 OR c.render = 1) AND c.paid = 1 AND e.event_type = 'click' AND length(CAST(e.k AS VARCHAR)) = 2 ORDER BY e.checkout_id, e.k LIMIT 200"""))
def _(t):
    c = t.checkouts()
    scores = c.filter("max_k > 20").select("checkout_id", (F.col("max_k") % 3).alias("tier"))
    return op.cohort_sample(c, scores, t.events(), "checkout_id", (F.col("submit") == 1) & ((F.col("open") == 1) | (F.col("render") == 1)) & (F.col("paid") == 1),
                            (F.col("event_type") == "click") & (F.length(F.col("k").cast("string")) == 2), ["merchant_id", "checkout_id", "k", "tier"], 200, ["checkout_id", "k"])


@query("d103_post_ramp", sql("ev", """
SELECT event_id, e.merchant_id FROM ev e WHERE dt > DATE '2024-01-05' + CAST(merchant_id AS INTEGER) AND merchant_id NOT IN (3, 7)"""))
def _(t):
    m = F.col("merchant_id")
    ramp = t.events().select("merchant_id").distinct().select(
        "merchant_id", F.date_add(F.lit(dt.date(2024, 1, 5)), m.cast("int")).alias("ramp_date"), (m == 3).alias("fully"), (m == 7).alias("blocked"))
    out = lookup.post_ramp(t.events(), ramp, "merchant_id", "dt", "ramp_date", F.col("fully"), F.col("blocked"))
    return out.select("event_id", "merchant_id")


@query("d105_cr_by_value", sql("cf", """
SELECT max_k AS value, count(*) AS n, CAST(sum(paid) AS BIGINT) AS converted, round(sum(paid)::DOUBLE / count(*), 6) AS cr FROM cf GROUP BY 1"""))
def _(t):
    return rounded_all(stats.cr_slope(t.checkouts().withColumnRenamed("max_k", "value"), "value", F.col("paid") == 1), ["cr"])


@query("d105_cr_slope", sql("cf", """
g AS (SELECT max_k AS value, sum(paid)::DOUBLE / count(*) AS cr FROM cf GROUP BY 1) SELECT round(regr_slope(cr, value), 8) AS slope FROM g"""))
def _(t):
    g = stats.cr_slope(t.checkouts().withColumnRenamed("max_k", "value"), "value", F.col("paid") == 1)
    return g.agg(rounded(stats.slope("cr", "value"), 8).alias("slope"))
