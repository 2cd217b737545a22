import datetime as dt

from pyspark.sql import functions as F

from ..functions.expr import flag, money, ratio, rounded
from ..functions.periods import period_start
from ..operators import activity as op
from .registry import query
from .views import ORDERS_CUT, sql

MONTH_SQL = "CAST(date_trunc('month', created_date) AS DATE) AS month"


def monthly(t):
    return t.payments().withColumn("month", period_start("created_date", "month"))


def rounded_all(df, names, n=6):
    return df.withColumns({c: rounded(c, n) for c in names})


@query("d24_waterfall", sql("pay", """
p AS (SELECT CAST(merchant_id AS VARCHAR) AS label, count(*) FILTER (success AND period = 'Prev') AS a, count(*) FILTER (success AND period = 'Post') AS b FROM pay GROUP BY 1),
r AS (SELECT *, b - a AS chg, row_number() OVER (ORDER BY abs(b - a) DESC, label) AS rn FROM p)
SELECT rn AS seq, label, chg AS value FROM r WHERE rn <= 10 UNION ALL SELECT 11, 'Others', CAST(sum(chg) AS BIGINT) FROM r WHERE rn > 10
UNION ALL SELECT 0, 'Prev', CAST(sum(a) AS BIGINT) FROM r UNION ALL SELECT 12, 'subtotal', CAST(sum(b) AS BIGINT) FROM r"""))
def _(t):
    return op.waterfall(t.payments().withColumn("ok", flag(F.col("success"))), "merchant_id", "ok", "period", "Prev", "Post")


@query("d25_active_entities", sql("pay mer", f"""
SELECT CASE WHEN grouping(segment) = 1 THEN 'Total' ELSE segment END AS segment, month, count(DISTINCT merchant_id) AS active
FROM (SELECT *, {MONTH_SQL} FROM pay WHERE success) JOIN mer USING (merchant_id) GROUP BY GROUPING SETS ((segment, month), (month))"""), dates="month")
def _(t):
    active = monthly(t).filter("success").select("merchant_id", "month").distinct()
    p = active.join(t.merchants().select("merchant_id", "segment"), "merchant_id")
    return op.active_entities(p, "merchant_id", "segment", "month")


@query("d26_trailing_active", sql("pay", """
d AS (SELECT DISTINCT created_date AS d FROM pay WHERE success),
SELECT d AS created_date, (SELECT count(DISTINCT merchant_id) FROM pay WHERE success AND created_date <= d AND created_date > d - 30) AS active FROM d
""".replace("pay WHERE success),\nSELECT", "pay WHERE success)\nSELECT")), dates="created_date")
def _(t):
    p = t.payments().filter("success")
    out = op.trailing_active(p, "merchant_id", "created_date", 30)
    # the report lists days with payments; the running count exists for every change
    return out.join(p.select("created_date").distinct(), "created_date", "left_semi")


SUMMARY_SQL = f"""g AS (SELECT month, count(*) AS attempts, count(*) FILTER (ok) AS successes, CAST(sum(amount) FILTER (ok) AS DOUBLE) AS gmv,
  count(*) FILTER (ok AND method = 'cod') AS cod_success, count(*) FILTER (ok AND method <> 'cod') AS non_cod_success, count(*) FILTER (method <> 'cod') AS non_cod_attempts
  FROM (SELECT *, {MONTH_SQL}, success OR method = 'cod' AS ok FROM pay) GROUP BY 1)"""


def summary(t):
    cod = F.col("method") == "cod"
    return op.payment_summary(monthly(t), "month", "amount", F.col("success") | cod, cod)


@query("d27_payment_summary", sql("pay", SUMMARY_SQL + """
SELECT *, round(cod_success::DOUBLE / nullif(successes, 0), 6) AS cod_share, round(non_cod_success::DOUBLE / nullif(successes, 0), 6) AS non_cod_share,
  round(non_cod_success::DOUBLE / nullif(non_cod_attempts, 0), 6) AS non_cod_sr, round(successes::DOUBLE / nullif(attempts, 0), 6) AS overall_sr FROM g"""), dates="month")
def _(t):
    return rounded_all(summary(t), ["cod_share", "non_cod_share", "non_cod_sr", "overall_sr"])


#: Every month of the orders.
MONTHS = [dt.date(1992 + i // 12, i % 12 + 1, 1) for i in range(12 * 10)]


@query("d27_payment_table_transposed", sql("pay", SUMMARY_SQL + """,
l AS (SELECT month, unnest(['attempts', 'successes', 'gmv']) AS measure, unnest([attempts::DOUBLE, successes::DOUBLE, gmv]) AS v FROM g)
SELECT measure, """ + ", ".join(f"max(v) FILTER (month = DATE '{m}') AS \"{m}\"" for m in MONTHS) + " FROM l GROUP BY 1"))
def _(t):
    return op.transpose_measures(summary(t), "month", MONTHS, ["attempts", "successes", "gmv"])


@query("d28_method_share_top", sql("pay", """
g AS (SELECT merchant_id, period, count(*) FILTER (method = 'cod') AS cod, count(*) AS orders FROM pay WHERE success GROUP BY 1, 2),
t AS (SELECT merchant_id, CAST(sum(orders) AS BIGINT) AS all_orders FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT g.*, all_orders, round(cod::DOUBLE / orders, 6) AS cod_share, round((orders - cod)::DOUBLE / orders, 6) AS non_cod_share FROM g JOIN t USING (merchant_id)"""))
def _(t):
    out = op.method_share_top(t.payments().filter("success"), "merchant_id", "period", F.col("method") == "cod")
    return rounded_all(out, ["cod_share", "non_cod_share"])


# Churn on the order table: an urgent order is an open of that merchant.
REASON_SQL = "CASE merchant_id % 4 WHEN 0 THEN 'price' WHEN 1 THEN '' ELSE NULL END"
CHURN_SQL = f"""o AS (SELECT merchant_id, count(*) FILTER (period='Prev') AS a, count(*) FILTER (period='Post') AS b FROM pay WHERE priority = '1-URGENT' AND status = 'P' GROUP BY 1),
  g AS (SELECT merchant_id, coalesce(CAST(sum(amount) FILTER (period='Post') AS DOUBLE), 0) - coalesce(CAST(sum(amount) FILTER (period='Prev') AS DOUBLE), 0) AS gmv_impact FROM pay WHERE success GROUP BY 1),
  x AS (SELECT o.merchant_id, CASE merchant_id % 4 WHEN 0 THEN 'price' ELSE 'Reason not available' END AS reason,
    CASE WHEN merchant_id % 4 = 0 THEN 'commercial' ELSE 'Reason not available' END AS category, gmv_impact FROM o LEFT JOIN g USING (merchant_id) WHERE a <> 0 AND b = 0)"""


def gone(t):
    p = t.payments()
    m = F.col("c_custkey") % 4
    reasons = t.raw("customer").filter("c_custkey % 4 < 2").select(
        F.col("c_custkey").alias("merchant_id"), F.when(m == 0, "price").otherwise("").alias("reason"), F.when(m == 0, "commercial").alias("category"))
    opens = p.filter("priority = '1-URGENT' and status = 'P'").select("merchant_id", "period", F.lit(1).alias("open"))
    return op.churned(opens, reasons, p.filter("success"), "merchant_id", "period", "Prev", "Post", "open", "amount")


@query("d29_churned", sql("pay", CHURN_SQL + " SELECT merchant_id, reason, category, round(gmv_impact, 2) AS gmv_impact FROM x"))
def _(t):
    return gone(t).withColumn("gmv_impact", rounded("gmv_impact", 2))


@query("d29_churn_by_category", sql("pay", CHURN_SQL + """
SELECT category, count(DISTINCT merchant_id) AS entities, CAST(sum(CAST(gmv_impact AS DECIMAL(24,2))) AS DOUBLE) AS gmv_impact FROM x GROUP BY 1"""))
def _(t):
    return op.churn_by_category(gone(t), "merchant_id")


PAYC = """pc AS (SELECT checkout_id, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS successes FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY 1)"""


def attempts(t):
    e = t.events().filter(F.col("event_type").isin("purchase", "error"))
    return e.withColumns({"attempts": F.lit(1), "successes": flag(F.col("event_type") == "purchase")})


def cr_sql(by):
    k = ", ".join(by)
    return f"""a AS (SELECT {k}, CAST(sum(open) AS BIGINT) AS initiated, CAST(sum(submit) AS BIGINT) AS submitted FROM cf GROUP BY ALL),
b AS (SELECT {k}, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS successes FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY ALL),
c AS (SELECT *, round(submitted::DOUBLE / nullif(initiated, 0), 6) AS modal_cr, round(successes::DOUBLE / nullif(attempts, 0), 6) AS payment_sr,
  round(successes::DOUBLE / nullif(initiated, 0), 6) AS overall_cr FROM a JOIN b USING ({k}))"""


@query("d32_combined_cr", sql("cf", cr_sql(["dt"]) + " SELECT * FROM c"), dates="dt")
def _(t):
    return rounded_all(op.combined_cr(t.checkouts(), attempts(t), "dt"), ["modal_cr", "payment_sr", "overall_cr"])


@query("d32_combined_cr_by_merchant", sql("cf", cr_sql(["merchant_id", "period"]) + " SELECT * FROM c"))
def _(t):
    out = op.combined_cr(t.checkouts(), attempts(t), "period", ["merchant_id"])
    return rounded_all(out, ["modal_cr", "payment_sr", "overall_cr"])


@query("d32_combined_cr_by_session", sql("ev", """
s0 AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS st FROM ev WINDOW w AS (PARTITION BY merchant_id, dt, device_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(st) OVER (PARTITION BY merchant_id, dt, device_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) || '-' || dt || '-' || device_id AS session_id FROM s0),
f AS (SELECT session_id, dt, max((event_type='signup')::INT) AS open, max((event_type='click')::INT) AS submit FROM s GROUP BY 1, 2),
a AS (SELECT dt, CAST(sum(open) AS BIGINT) AS initiated, CAST(sum(submit) AS BIGINT) AS submitted FROM f GROUP BY 1),
b AS (SELECT dt, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS successes FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT *, round(submitted::DOUBLE / nullif(initiated, 0), 6) AS modal_cr, round(successes::DOUBLE / nullif(attempts, 0), 6) AS payment_sr,
  round(successes::DOUBLE / nullif(initiated, 0), 6) AS overall_cr FROM a JOIN b USING (dt)"""), dates="dt")
def _(t):
    from .q_facts import sessions
    e = F.col("event_type")
    f = sessions(t).groupBy("session_id", "dt").agg(F.max(flag(e == "signup")).alias("open"), F.max(flag(e == "click")).alias("submit"))
    return rounded_all(op.combined_cr(f, attempts(t), "dt"), ["modal_cr", "payment_sr", "overall_cr"])


@query("d41_api_availability", sql("cf", """
g AS (SELECT dt, count(*) FILTER (render=1) AS shipping_started, count(*) FILTER (render=1 AND failed=0) AS shipping_done, count(*) FILTER (submit=1) AS coupon_started,
  count(*) FILTER (submit=1 AND paid=1) AS coupon_done FROM cf GROUP BY 1)
SELECT *, round(shipping_done::DOUBLE / nullif(shipping_started, 0), 6) AS shipping_rate, round(coupon_done::DOUBLE / nullif(coupon_started, 0), 6) AS coupon_rate FROM g"""), dates="dt")
def _(t):
    on = lambda c: F.col(c) == 1
    out = op.api_availability(t.checkouts(), "dt", "checkout_id", {
        "shipping": (on("render"), on("render") & ~on("failed")), "coupon": (on("submit"), on("submit") & on("paid"))})
    return rounded_all(out, ["shipping_rate", "coupon_rate"])


def utm(fact):
    return F.when(F.col("min_k") % 3 != 0, F.concat(F.lit("src"), F.col("min_k") % 3))


UTM_SQL = "CASE WHEN min_k % 3 <> 0 THEN 'src' || (min_k % 3) END"


@query("d42_attribute_availability", sql("cf", f"""
g AS (SELECT dt, CASE WHEN {UTM_SQL} IS NULL THEN 'missing' ELSE 'present' END AS state, count(DISTINCT checkout_id) AS ids FROM cf GROUP BY 1, 2)
SELECT *, CAST(sum(ids) OVER (PARTITION BY dt) AS BIGINT) AS all_ids, round(ids::DOUBLE / sum(ids) OVER (PARTITION BY dt), 6) AS share FROM g"""), dates="dt")
def _(t):
    return rounded_all(op.attribute_availability(t.checkouts(), "dt", utm(None), "checkout_id"), ["share"])


@query("d43_null_offenders", sql("cf", f"""
g AS (SELECT period, merchant_id, count(*) FILTER ({UTM_SQL} IS NULL) AS nulls, count(*) AS total FROM cf GROUP BY 1, 2),
r AS (SELECT *, sum(nulls) OVER (PARTITION BY period) AS alln, row_number() OVER (PARTITION BY period ORDER BY nulls DESC, merchant_id) AS rn FROM g),
a AS (SELECT merchant_id, round(nulls::DOUBLE / total, 6) AS pct_null_Prev, round(nulls::DOUBLE / alln, 6) AS share_of_null_Prev FROM r WHERE rn <= 5 AND period = 'Prev'),
b AS (SELECT merchant_id, round(nulls::DOUBLE / total, 6) AS pct_null_Post, round(nulls::DOUBLE / alln, 6) AS share_of_null_Post FROM r WHERE rn <= 5 AND period = 'Post')
SELECT * FROM a FULL JOIN b USING (merchant_id)"""))
def _(t):
    out = op.null_offenders(t.checkouts(), "period", "merchant_id", utm(None), "checkout_id")
    return rounded_all(out, [c for c in out.columns if c != "merchant_id"])


@query("d98_entity_availability", sql("cf", f"""
g AS (SELECT period, {UTM_SQL} AS value, count(DISTINCT device_id) AS entities FROM cf GROUP BY 1, 2),
a AS (SELECT period, count(DISTINCT device_id) AS all_entities FROM cf GROUP BY 1)
SELECT g.*, all_entities, round(entities::DOUBLE / all_entities, 6) AS share FROM g JOIN a USING (period)"""))
def _(t):
    return rounded_all(op.entity_availability(t.checkouts(), "period", "device_id", utm(None)), ["share"])


@query("d44_cr_ratio_buckets", sql("cf", """
c AS (SELECT device_id, date_trunc('week', dt)::DATE AS week, sum(paid)::DOUBLE / count(*) AS cr FROM cf GROUP BY 1, 2),
b AS (SELECT device_id, sum(paid)::DOUBLE / count(*) AS base FROM cf GROUP BY 1),
r AS (SELECT week, round(cr / nullif(base, 0), 2) AS r FROM c JOIN b USING (device_id)),
g AS (SELECT week, CASE WHEN r >= 1.1 THEN 'A. >10%' WHEN r >= 1.05 THEN 'B. 5%-10%' WHEN r >= 1.01 THEN 'C. 1%-5%' WHEN r >= 1 THEN 'D. 0%-1%' ELSE 'E. <0%' END AS bucket, count(*) AS entities FROM r GROUP BY 1, 2)
SELECT *, round(entities::DOUBLE / sum(entities) OVER (PARTITION BY week), 6) AS proportion FROM g"""), dates="week")
def _(t):
    c = t.checkouts()
    weekly = c.groupBy("device_id", period_start("dt", "week").alias("week")).agg(ratio(F.sum("paid"), F.count("*")).alias("cr"))
    base = c.groupBy("device_id").agg(ratio(F.sum("paid"), F.count("*")).alias("base"))
    return rounded_all(op.cr_ratio_buckets(weekly.join(base, "device_id"), "week", "cr", "base"), ["proportion"])


@query("d45_surface_kpis", sql("cf", """
SELECT dt, platform, CAST(sum(open) AS BIGINT) AS opens, CAST(sum(paid) AS BIGINT) AS orders, CAST(sum(gmv) FILTER (paid > 0) AS DOUBLE) AS gmv,
  count(DISTINCT merchant_id) FILTER (paid > 0) AS active_stores, round(sum(paid)::DOUBLE / nullif(sum(open), 0), 6) AS cr FROM cf GROUP BY 1, 2 HAVING sum(paid) > 0"""), dates="dt")
def _(t):
    return rounded_all(op.surface_kpis(t.checkouts(), ["dt", "platform"], "merchant_id", "open", "paid", "gmv"), ["cr"])


@query("d73_change_class", sql("pay mer", """
g AS (SELECT merchant_id, segment, count(*) FILTER (period='Prev') AS o0, count(*) FILTER (period='Post') AS o1, count(*) FILTER (period='Prev' AND success) AS p0,
  count(*) FILTER (period='Post' AND success) AS p1, coalesce(sum(amount) FILTER (period='Prev' AND success), 0) AS g0, coalesce(sum(amount) FILTER (period='Post' AND success), 0) AS g1 FROM pay JOIN mer USING (merchant_id) GROUP BY 1, 2),
r AS (SELECT *, (p1::DOUBLE / nullif(o1, 0)) / nullif(p0::DOUBLE / nullif(o0, 0), 0) AS r FROM g),
c AS (SELECT *, CASE WHEN r <= 0.9 THEN 'Decreasing (<= -10%)' WHEN r >= 1.1 THEN 'Increasing  (>= 10%)' WHEN r IS NOT NULL THEN 'Stable (-10% : 10%)' END AS category FROM r)
SELECT segment, category, count(*) AS entities, round((sum(o1) - sum(o0))::DOUBLE / nullif(sum(o0), 0), 6) AS volume_change,
  round((sum(g1) - sum(g0))::DOUBLE / nullif(sum(g0), 0)::DOUBLE, 6) AS gmv_change FROM c WHERE category IS NOT NULL GROUP BY 1, 2"""))
def _(t):
    p = t.payments().groupBy("merchant_id", "period").agg(
        F.count("*").alias("opens"), F.sum(flag(F.col("success"))).alias("paid"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("amount"))), F.lit(0)).alias("gmv"))
    p = p.join(t.merchants().select("merchant_id", "segment"), "merchant_id")
    out = op.change_class(p, "merchant_id", "segment", "period", "Prev", "Post")
    return rounded_all(out, ["volume_change", "gmv_change"])


@query("d74_mom_delta", sql("pay mer", f"""
g AS (SELECT segment, month, count(*) AS opens, count(*) FILTER (success) AS paid FROM (SELECT *, {MONTH_SQL} FROM pay) JOIN mer USING (merchant_id) GROUP BY 1, 2),
c AS (SELECT *, paid::DOUBLE / opens AS cr FROM g)
SELECT segment, month, opens, paid, round(cr, 6) AS cr, round(cr - lag(cr) OVER (PARTITION BY segment ORDER BY month), 6) AS cr_delta FROM c"""), dates="month")
def _(t):
    p = monthly(t).groupBy("merchant_id", "month").agg(F.count("*").alias("o"), F.sum(flag(F.col("success"))).alias("p"))
    p = p.join(t.merchants().select("merchant_id", "segment"), "merchant_id")
    return rounded_all(op.mom_delta(p, "segment", "month", "o", "p"), ["cr", "cr_delta"])


@query("d81_order_frequency", sql("pay", """
w AS (SELECT merchant_id, date_trunc('week', created_date) AS w, count(*) AS n, sum(amount) AS g FROM pay WHERE success GROUP BY 1, 2),
c AS (SELECT merchant_id, round(sum(n)::DOUBLE / count(*), 0) AS orders_per_week, sum(n) AS n, sum(g) AS g FROM w GROUP BY 1)
SELECT orders_per_week, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders, CAST(sum(g) AS DOUBLE) AS gmv FROM c GROUP BY 1"""))
def _(t):
    return op.order_frequency(t.payments().filter("success"), "merchant_id", "created_date", "amount")


@query("d81_wallet_share", sql("pay", """
b AS (SELECT DISTINCT merchant_id FROM pay WHERE priority = '1-URGENT'),
g AS (SELECT period, CASE WHEN priority = '1-URGENT' THEN 'focus' ELSE 'rest' END AS "group", count(DISTINCT merchant_id) AS customers, count(*) AS orders, CAST(sum(amount) AS DOUBLE) AS gmv
  FROM pay WHERE merchant_id IN (SELECT merchant_id FROM b) GROUP BY 1, 2)
SELECT *, round(gmv / sum(gmv) OVER (PARTITION BY period), 6) AS wallet_share FROM g"""))
def _(t):
    out = op.wallet_share(t.payments(), "merchant_id", F.col("priority") == "1-URGENT", ["period"], "amount")
    return rounded_all(out, ["wallet_share"])


@query("d82_gmv_with_cutover", sql("ev", """
SELECT dt, merchant_id, CAST(sum(CASE WHEN ts < TIMESTAMP '2024-01-15 14:00:00' THEN CAST(value AS DECIMAL(20,4)) ELSE CAST(CAST(value AS DECIMAL(20,4)) / 100 AS DECIMAL(20,4)) END) AS DOUBLE) AS gmv,
  count(*) AS orders FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2"""), dates="dt")
def _(t):
    d = t.events().filter("event_type = 'purchase'")
    return op.gmv_with_cutover(d, ["dt", "merchant_id"], "ts", dt.datetime(2024, 1, 15, 14), "value")


@query("d84_anomaly_feed", sql("cf", f"""
t AS (SELECT *, CASE WHEN merchant_id >= 6 THEN 'SME' ELSE CAST(merchant_id AS VARCHAR) END AS m FROM cf),
g AS (SELECT dt, m AS merchant_id, platform, CAST(sum(open) AS BIGINT) AS cnt_open, CAST(sum(submit) AS BIGINT) AS cnt_submit,
  count(*) FILTER (paid = 0 AND open = 1 AND submit = 0 AND failed = 0) AS bounce_off, count(*) AS total FROM t GROUP BY 1, 2, 3)
SELECT * FROM g WHERE NOT (dt <= DATE '2024-01-20' AND merchant_id <> 'SME')"""), dates="dt")
def _(t):
    from .q_funnel import with_reason
    tags = t.events().select("merchant_id").distinct().withColumn("tag", F.when(F.col("merchant_id") >= 6, "SME").otherwise("Key"))
    published = t.checkouts().filter((F.col("dt") <= F.lit(dt.date(2024, 1, 20))) & (F.col("merchant_id") < 6)).select(
        "dt", F.col("merchant_id").cast("string").alias("merchant_id"), "platform")
    return op.anomaly_feed(with_reason(t.checkouts()), tags, published, "merchant_id", "dt", "platform", {
        "cnt_open": F.sum("open"), "cnt_submit": F.sum("submit"), "bounce_off": F.sum(flag(F.col("reason") == "Bounced w/o any interaction"))})


@query("d85_submit_payment_feed", sql("ev", """
s AS (SELECT dt, merchant_id, count(*) AS submits FROM ev WHERE event_type = 'click' GROUP BY 1, 2),
p AS (SELECT dt, merchant_id, count(*) AS payment_attempts FROM ev WHERE event_type IN ('purchase', 'error') AND k > 60 GROUP BY 1, 2)
SELECT * FROM s LEFT JOIN p USING (dt, merchant_id)"""), dates="dt")
def _(t):
    e = t.events()
    return op.submit_payment_feed(e, attempts(t).filter("k > 60"), "merchant_id", "dt", F.col("event_type") == "click")


@query("d90_api_payment_join", sql("cf", PAYC + """
SELECT c.arm, c.platform, count(DISTINCT checkout_id) AS checkouts, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts,
  count(DISTINCT checkout_id) FILTER (successes > 0) AS paid_checkouts, round(count(DISTINCT checkout_id) FILTER (successes > 0)::DOUBLE / count(DISTINCT checkout_id), 6) AS cr
FROM (SELECT checkout_id FROM ev WHERE event_type = 'view') v JOIN cf c USING (checkout_id) LEFT JOIN pc USING (checkout_id) GROUP BY 1, 2"""))
def _(t):
    calls = t.events().filter("event_type = 'view'").select("checkout_id")
    pay = attempts(t).select("checkout_id", (F.col("event_type") == "purchase").alias("success"))
    out = op.api_payment_join(calls, t.checkouts().select("checkout_id", "arm", "platform"), pay, "checkout_id", ["arm", "platform"])
    return rounded_all(out, ["cr"])


@query("d92_cod_funnel", sql("ev", """
e AS (SELECT dt, count(DISTINCT checkout_id) FILTER (event_type='view' AND k%3=0) AS selected, count(DISTINCT checkout_id) FILTER (event_type='click' AND k%3=0) AS submitted FROM ev GROUP BY 1),
p AS (SELECT dt, count(*) AS paid FROM ev WHERE event_type = 'purchase' AND k % 3 = 0 GROUP BY 1)
SELECT *, round(submitted::DOUBLE / nullif(selected, 0), 6) AS submit_rate, round(paid::DOUBLE / nullif(submitted, 0), 6) AS paid_rate FROM e LEFT JOIN p USING (dt)"""), dates="dt")
def _(t):
    e, cod = F.col("event_type"), F.col("k") % 3 == 0
    out = op.cod_funnel(t.events(), t.events().filter((e == "purchase") & cod), "dt", "checkout_id", (e == "view") & cod, (e == "click") & cod)
    return rounded_all(out, ["submit_rate", "paid_rate"])


@query("d96_category_sr", sql("pay", """
SELECT date_trunc('week', created_date)::DATE AS period_start, count(DISTINCT payment_id) AS attempts, count(DISTINCT payment_id) FILTER (success) AS successes,
  round(count(DISTINCT payment_id) FILTER (success)::DOUBLE / count(DISTINCT payment_id), 6) AS sr FROM pay WHERE merchant_id % 9 IN (1, 8) GROUP BY 1"""), dates="period_start")
def _(t):
    from ..functions.expr import code_name
    from ..operators.labels import LIBRARIES
    lib = code_name((F.col("merchant_id") % 9).cast("int"), LIBRARIES, "UNKNOWN")
    out = op.category_sr(t.payments(), period_start("created_date", "week"), "payment_id", F.col("success"), lib.isin("CHECKOUTJS", "HOSTED"))
    return rounded_all(out, ["sr"])


@query("d99_net_cr", sql("cf", cr_sql(["dt"]) + """,
d AS (SELECT dt, count(*) AS delivered FROM ev WHERE event_type = 'purchase' AND k < 70 GROUP BY 1)
SELECT dt, initiated, delivered, round(delivered::DOUBLE / nullif(initiated, 0), 6) AS net_cr FROM c LEFT JOIN d USING (dt)"""), dates="dt")
def _(t):
    cr = op.combined_cr(t.checkouts(), attempts(t), "dt").select("dt", "initiated")
    ship = t.events().filter("event_type = 'purchase' and k < 70").groupBy("dt").agg(F.count("*").alias("delivered"))
    return rounded_all(op.net_cr(cr, ship, "dt"), ["net_cr"]).select("dt", "initiated", "delivered", "net_cr")
