import datetime as dt

from pyspark.sql import functions as F

from ..functions.expr import rounded, sum_money
from ..functions.grouped import latest_per_key, top_n
from ..operators import lookup
from ..operators.facts import explode_experiments
from .registry import query
from .views import sql


@query("j01_inner", sql("pay ship", """
SELECT p.status, count(*) AS lines, CAST(sum(s.price) AS DOUBLE) AS price FROM pay p JOIN ship s ON p.payment_id = s.order_id
GROUP BY 1"""))
def _(t):
    # lines are reduced per order before they travel
    s = t.shipments().groupBy(F.col("order_id").alias("payment_id")).agg(F.count("*").alias("n"), F.sum("price").alias("p"))
    return t.payments().select("payment_id", "status").join(s, "payment_id").groupBy("status").agg(
        F.sum("n").alias("lines"), F.sum("p").cast("double").alias("price"))


@query("j02_left_chain", """
SELECT s_suppkey, s_name, n_name, r_name, c_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_custkey = s_suppkey * 20""")
def _(t):
    s = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    s = s.join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    s = s.join(t.raw("customer"), F.col("c_custkey") == F.col("s_suppkey") * 20, "left")
    return s.select("s_suppkey", "s_name", "n_name", "r_name", "c_name")


@query("j03_derived_key", """
SELECT o_orderpriority, count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM orders
JOIN customer ON c_custkey = CAST(substr('order_' || o_custkey, 7) AS BIGINT) GROUP BY 1""")
def _(t):
    # the prefix is cut once before the join, so both sides hash on a plain key
    o = t.raw("orders").withColumn("prefixed", F.concat(F.lit("order_"), "o_custkey"))
    o = o.select("o_orderpriority", F.expr("substring(prefixed, 7)").try_cast("bigint").alias("c_custkey"))
    o = o.groupBy("o_orderpriority", "c_custkey").agg(F.count("*").alias("n"))
    return o.join(t.raw("customer"), "c_custkey").groupBy("o_orderpriority").agg(
        F.sum("n").alias("n"), F.countDistinct("c_mktsegment").alias("segments"))


@query("j04_multi_column", sql("ev", """
a AS (SELECT merchant_id, dt, count(*) AS views FROM ev WHERE event_type = 'view' GROUP BY 1, 2),
b AS (SELECT merchant_id, dt, count(*) AS purchases FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT * FROM a JOIN b USING (merchant_id, dt)"""), dates="dt")
def _(t):
    n = lambda e, c: t.events().filter(F.col("event_type") == e).groupBy("merchant_id", "dt").agg(F.count("*").alias(c))
    return n("view", "views").join(n("purchase", "purchases"), ["merchant_id", "dt"])


@query("j05_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    o = t.raw("orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.raw("customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j06_anti_not_in", sql("ev", """
SELECT DISTINCT checkout_id FROM ev WHERE checkout_id NOT IN (SELECT checkout_id FROM ev WHERE event_type = 'error')"""))
def _(t):
    # the intended meaning of NOT IN: a NULL in the list excludes nothing
    e = t.events().select("checkout_id", "event_type")
    return e.select("checkout_id").distinct().join(e.filter("event_type = 'error'"), "checkout_id", "left_anti")


@query("j07_anti_left_null", """
SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL""")
def _(t):
    l = t.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))  # noqa: E741
    return t.raw("orders").join(l, "o_orderkey", "left_anti").select("o_orderkey")


@query("j08_latest_row", sql("pay lship", """
SELECT p.payment_id, p.method, s.status, s.ship_date FROM pay p LEFT JOIN lship s ON p.payment_id = s.order_id"""), dates="ship_date")
def _(t):
    s = t.latest_shipments("status", "ship_date").select(F.col("order_id").alias("payment_id"), F.col("status"), "ship_date")
    return t.payments().select("payment_id", "method").join(s, "payment_id", "left")


def signups_and_visits(t):
    e = t.gappy_events().select("device_id", "ts", "event_id", "event_type", "k")
    s = e.filter("event_type = 'signup'").select("device_id", F.col("ts").alias("s_ts"), F.col("event_id").alias("signup_id"))
    return s, e.filter("event_type = 'view'").select("device_id", F.col("ts").alias("v_ts"), F.col("event_id").alias("visit"), "k")


@query("j09_touches_before_signup", sql("gaps", """
s AS (SELECT device_id, ts AS s_ts, event_id AS signup_id FROM gaps WHERE event_type = 'signup'),
v AS (SELECT device_id, ts AS v_ts FROM gaps WHERE event_type = 'view')
SELECT signup_id, count(v_ts) AS touches FROM s LEFT JOIN v
  ON s.device_id = v.device_id AND v_ts < s_ts AND floor((epoch_us(s_ts) - epoch_us(v_ts)) / 86400000000) <= 10 GROUP BY 1"""))
def _(t):
    s, v = signups_and_visits(t)
    return lookup.touches_in_window(s, v, "device_id", "signup_id", "s_ts", "v_ts", days=10).select("signup_id", "touches")


@query("j10_before_anchor", sql("gaps", """
a AS (SELECT device_id, max(dt) AS anchor FROM gaps WHERE event_type = 'purchase' GROUP BY 1)
SELECT a.device_id, anchor, max(e.dt) AS last_error FROM a LEFT JOIN gaps e
  ON e.device_id = a.device_id AND e.event_type = 'error' AND e.dt < anchor GROUP BY 1, 2"""), dates="anchor last_error")
def _(t):
    e = t.gappy_events().select("device_id", "dt", "event_type")
    a = e.filter("event_type = 'purchase'").groupBy("device_id").agg(F.max("dt").alias("anchor"))
    err = e.filter("event_type = 'error'").select("device_id", "dt").distinct()
    return lookup.last_before(a, err, ["device_id"], "anchor", "dt", {"last_error": "dt"}, 86400)


@query("j11_effective_from", sql("pay", """
d AS (SELECT c_custkey AS merchant_id, DATE '1996-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS live_date FROM customer)
SELECT p.merchant_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS gmv FROM pay p JOIN d ON p.merchant_id = d.merchant_id
  AND p.created_date >= d.live_date GROUP BY 1"""))
def _(t):
    d = t.raw("customer").select(F.col("c_custkey").alias("merchant_id"),
                                 F.date_add(F.lit(dt.date(1996, 1, 1)), (F.col("c_custkey") % 1000).cast("int")).alias("live_date"))
    # per merchant and day first: the join sees at most one row per calendar day
    p = t.payments().groupBy("merchant_id", "created_date").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    p = lookup.effective_from(p, d, "merchant_id", "created_date", "live_date")
    return p.groupBy("merchant_id").agg(F.sum("n").alias("n"), F.sum("amount").cast("double").alias("gmv"))


@query("j12_map_unnest", sql("ev", """
m AS (SELECT checkout_id, 'arm' AS experiment_name, arm AS experiment_value FROM ev UNION ALL SELECT checkout_id, 'kind', event_type FROM ev)
SELECT DISTINCT * FROM m"""))
def _(t):
    e = t.events().withColumn("arms", F.to_json(F.create_map(F.lit("arm"), "arm", F.lit("kind"), "event_type")))
    return explode_experiments(e, "arms", ["checkout_id"])


@query("j13_full_outer", sql("pay", """
g AS (SELECT period, merchant_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS gmv FROM pay GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY gmv DESC, merchant_id) AS rank FROM g),
a AS (SELECT merchant_id, gmv AS gmv_prev FROM r WHERE period = 'Prev' AND rank <= 20),
b AS (SELECT merchant_id, gmv AS gmv_post FROM r WHERE period = 'Post' AND rank <= 20)
SELECT * FROM a FULL JOIN b USING (merchant_id)"""))
def _(t):
    g = t.payments().groupBy("period", "merchant_id").agg(sum_money("amount").alias("gmv"))
    top = top_n(g, ["period"], [F.col("gmv").desc(), F.col("merchant_id")], 20)
    side = lambda p, c: top.filter(F.col("period") == p).select("merchant_id", F.col("gmv").alias(c))
    return side("Prev", "gmv_prev").join(side("Post", "gmv_post"), "merchant_id", "full")


@query("j14_first_last_self", sql("ev", """
SELECT device_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type
FROM ev GROUP BY 1""").replace("SELECT device_id, min(ts) AS first_ts, max(ts) AS last_ts", """SELECT device_id,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts"""))
def _(t):
    return t.events().groupBy("device_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("j15_join_aggregates", sql("cf pay", """
a AS (SELECT date_trunc('month', created_date)::DATE AS month, method, count(*) AS n FROM pay GROUP BY 1, 2),
b AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, count(*) AS shipped FROM lineitem GROUP BY 1)
SELECT * FROM a JOIN b USING (month)"""), dates="month")
def _(t):
    a = t.payments().groupBy(F.trunc("created_date", "month").alias("month"), "method").agg(F.count("*").alias("n"))
    b = t.raw("lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month")).agg(F.count("*").alias("shipped"))
    return a.join(b, "month")


@query("j16_small_dimension", sql("pay mer", """
SELECT segment, tier, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS gmv
FROM pay JOIN (SELECT merchant_id, segment, CAST(tier AS BIGINT) AS tier FROM mer) USING (merchant_id) GROUP BY 1, 2"""))
def _(t):
    # no forced hint: Spark broadcasts the dimension only below its size limit
    # (checked on statistics, and again at run time by adaptive execution)
    m = t.merchants().select("merchant_id", "segment", "tier")
    p = t.payments().groupBy("merchant_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return p.join(m, "merchant_id").groupBy("segment", "tier").agg(F.sum("n").alias("n"), F.sum("amount").cast("double").alias("gmv"))


@query("j17_null_keys_match", """
a AS (SELECT d.doc_id, l.quality AS q, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
b AS (SELECT q, count(*) AS in_group FROM a GROUP BY 1)
SELECT a.doc_id, a.lang, b.in_group FROM a LEFT JOIN b ON a.q IS NOT DISTINCT FROM b.q""".replace("a AS", "WITH a AS", 1))
def _(t):
    a = t.raw("documents").join(t.raw("labels"), "doc_id", "left").select("doc_id", "lang", F.col("quality").alias("q"))
    b = a.groupBy("q").agg(F.count("*").alias("in_group"))
    return lookup.null_matching_join(a, b, ["q"]).select("doc_id", "lang", "in_group")
