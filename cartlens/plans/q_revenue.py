import datetime as dt

from pyspark.sql import functions as F

from ..functions.expr import flag, rounded
from ..operators import coverage as cov
from ..operators import revenue as op
from ..operators import text
from .q_activity import rounded_all
from .registry import query
from .views import sql

AS_OF = dt.date(1998, 3, 10)   # before the 14th: January is the last settled month


def insured_orders(t):
    """Orders with their latest shipment; rules derived from the order's columns."""
    s = t.latest_shipments("status", "charge", "tax").select(F.col("order_id").alias("payment_id"), F.col("status").alias("ship_status"), "charge", "tax")
    o = t.payments().drop("status").join(s, "payment_id")
    i = F.col("payment_id")
    return o.select(
        F.col("payment_id").alias("order_id"), "merchant_id", "created_date", "amount", F.col("ship_status").alias("status"),
        F.when(i % 9 != 0, F.col("charge")).alias("charge"), (i % 11 == 0).alias("manual_control"),
        F.when(i % 2 == 0, "low").when(i % 3 == 0, "high").alias("risk_tier"), F.when(i % 5 != 0, i % 7 != 0).alias("cod_eligible"), (i % 4 != 0).alias("check_enabled"))


def policies(t):
    m = F.col("c_custkey")
    return t.raw("customer").filter("c_custkey % 3 <> 2").select(
        m.alias("merchant_id"), F.when(m % 6 == 0, "flat").otherwise("actual").alias("bucket"), (m % 5 * 1500 + 500).cast("decimal(18,4)").alias("max_reimbursement"),
        F.date_add(F.lit(dt.date(1996, 1, 1)), (m % 300).cast("int")).alias("start_date"))


OWED = """o AS (SELECT p.payment_id AS order_id, p.merchant_id, p.created_date, p.amount, s.status, CASE WHEN payment_id % 9 <> 0 THEN charge END AS charge, payment_id % 11 = 0 AS manual_control,
    CASE WHEN payment_id % 2 = 0 THEN 'low' WHEN payment_id % 3 = 0 THEN 'high' END AS risk_tier, CASE WHEN payment_id % 5 <> 0 THEN payment_id % 7 <> 0 END AS cod_eligible, payment_id % 4 <> 0 AS check_enabled
  FROM pay p JOIN lship s ON p.payment_id = s.order_id),
pol AS (SELECT c_custkey AS merchant_id, CASE WHEN c_custkey % 6 = 0 THEN 'flat' ELSE 'actual' END AS bucket, CAST(c_custkey % 5 * 1500 + 500 AS DECIMAL(18,4)) AS cap,
    DATE '1996-01-01' + CAST(c_custkey % 300 AS INTEGER) AS start_date FROM customer WHERE c_custkey % 3 <> 2),
w AS (SELECT o.*, CASE WHEN (manual_control AND coalesce(risk_tier, '') <> 'low') OR (coalesce(cod_eligible, FALSE) = FALSE AND check_enabled) THEN 0
    WHEN bucket <> 'flat' AND charge < cap AND charge <> 0 THEN charge ELSE cap END AS owed FROM o JOIN pol USING (merchant_id) WHERE created_date >= start_date),
m AS (SELECT strftime(created_date, '%Y-%m') AS month, merchant_id, count(*) AS orders, count(*) FILTER (status IN ('delivered', 'rto')) AS with_delivery, count(*) FILTER (status = 'rto') AS with_rto,
    coalesce(CAST(sum(owed) FILTER (status = 'rto') AS DOUBLE), 0) AS rto_amount FROM w GROUP BY 1, 2),
mm AS (SELECT *, round(with_delivery::DOUBLE / orders, 4) AS delivery_share FROM m),
rt AS (SELECT *, CASE WHEN month > '1998-01' THEN 'open' WHEN delivery_share >= 0.8 AND rto_amount <> 0 THEN 'Successful' WHEN delivery_share >= 0.8 THEN 'Incorrect status' ELSE 'Pending status' END AS route FROM mm)"""


def owed(t):
    return op.reimbursement(insured_orders(t), policies(t))


@query("d60_reimbursement", sql("pay lship", OWED + " SELECT order_id, merchant_id, CAST(owed AS DOUBLE) AS reimbursement FROM w"))
def _(t):
    return owed(t).select("order_id", "merchant_id", "reimbursement")


@query("d60_reimbursement_summary", sql("pay lship", OWED + " SELECT * FROM mm"))
def _(t):
    return op.reimbursement_summary(owed(t))


@query("d61_reimbursement_status", sql("pay lship", OWED + " SELECT * FROM rt"))
def _(t):
    return op.reimbursement_status(op.reimbursement_summary(owed(t)), AS_OF)


@query("d61_settlement_details", sql("pay lship", OWED + """
SELECT route, order_id, w.status, CAST(owed AS DOUBLE) AS reimbursement FROM w JOIN rt ON strftime(created_date, '%Y-%m') = rt.month AND w.merchant_id = rt.merchant_id
WHERE route <> 'open' AND CASE route WHEN 'Successful' THEN w.status = 'rto' AND owed <> 0 WHEN 'Pending status' THEN w.status NOT IN ('delivered', 'rto') ELSE TRUE END"""))
def _(t):
    w = owed(t)
    routed = op.reimbursement_status(op.reimbursement_summary(w), AS_OF)
    return op.settlement_details(w, routed).select("route", "order_id", "status", "reimbursement")


@query("d62_net_revenue", sql("pay lship", OWED + """,
pr AS (SELECT c_custkey AS merchant_id, DATE '1996-06-01' + CAST(c_custkey % 500 AS INTEGER) AS live, (c_custkey % 4 + 1) * 0.5 AS pct FROM customer WHERE c_custkey % 2 = 0),
g AS (SELECT merchant_id, count(*) AS cod_orders, sum(amount) AS gmv, max(pct) AS pct FROM pay JOIN pr USING (merchant_id) WHERE method = 'cod' AND strftime(created_date, '%Y-%m') = '1997-11' AND created_date >= live GROUP BY 1),
x AS (SELECT g.*, CAST(gmv AS DOUBLE) AS cod_gmv, pct / 100.0::DOUBLE AS fee_rate, CAST(gmv AS DOUBLE) * pct / 100 AS fees, coalesce(rto_amount, 0) AS r FROM g LEFT JOIN (SELECT * FROM mm WHERE month = '1997-11') mm USING (merchant_id))
SELECT merchant_id, cod_orders, cod_gmv, round(fee_rate, 6) AS fee_rate, round(fees, 6) AS fees, r AS reimbursement, round(fees - r, 6) AS net_revenue FROM x"""))
def _(t):
    m = F.col("c_custkey")
    pricing = t.raw("customer").filter("c_custkey % 2 = 0").select(
        m.alias("merchant_id"), F.concat(F.format_string("%.1f", (m % 4 + 1) * 0.5), F.lit("%")).alias("cod"),
        F.date_add(F.lit(dt.date(1996, 6, 1)), (m % 500).cast("int")).alias("pricing_live_date"))
    out = op.net_revenue(t.payments().filter("method = 'cod'"), pricing, op.reimbursement_summary(owed(t)), "1997-11")
    return rounded_all(rounded_all(out, ["fee_rate"]), ["fees", "net_revenue"])


@query("d63_prepaid_income", sql("pay", """
f AS (SELECT payment_id AS transaction_id, merchant_id % 5 AS rule_id, CASE WHEN merchant_id % 5 = 4 THEN 5000 ELSE payment_id % 900 END AS fee FROM pay WHERE payment_id % 3 <> 0),
p AS (SELECT * FROM (VALUES (0, 200, 0, 0, NULL), (1, 0, 300, 0, NULL), (2, 0, 0, 150, NULL), (3, 0, 0, 0, NULL), (4, 250, 0, 0, 5000)) AS v(rule_id, pct, fixed, low, high)),
x AS (SELECT merchant_id % 20 AS merchant_id, amount, fee, CASE WHEN (pct = 0 AND fixed > 0) OR (pct = 0 AND fixed = 0 AND low > 0) OR (high IS NOT NULL AND fee = high) THEN 'Flat Pricing' WHEN (pct = 0 AND fixed = 0) OR fee IS NULL THEN 'Zero Pricing' ELSE 'Percentage Pricing' END AS pricing_type,
  CASE WHEN pct = 0 AND fixed > 0 THEN fixed WHEN pct = 0 AND fixed = 0 AND low > 0 THEN low WHEN high IS NOT NULL AND fee = high THEN high WHEN (pct = 0 AND fixed = 0) OR fee IS NULL THEN 0 ELSE pct END / 100.0::DOUBLE AS pricing_rate
  FROM pay LEFT JOIN f ON payment_id = transaction_id LEFT JOIN p ON f.rule_id = p.rule_id WHERE success)
SELECT merchant_id, pricing_type, pricing_rate, count(*) AS payments, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(coalesce(fee, 0)) / 100.0 AS DOUBLE) AS income FROM x GROUP BY 1, 2, 3"""))
def _(t):
    p = t.payments()
    m, i = F.col("merchant_id"), F.col("payment_id")
    fees = p.filter("payment_id % 3 <> 0").select(i.alias("transaction_id"), (m % 5).alias("rule_id"), F.when(m % 5 == 4, F.lit(5000)).otherwise(i % 900).alias("fee"))
    rule = F.col("rule_id")
    pricing = p.select((m % 5).alias("rule_id")).distinct().select(
        "rule_id", F.when(rule == 0, 200).when(rule == 4, 250).otherwise(0).alias("percent_rate"), F.when(rule == 1, 300).otherwise(0).alias("fixed_rate"),
        F.when(rule == 2, 150).otherwise(0).alias("min_fee"), F.when(rule == 4, 5000).alias("max_fee"))
    paid = p.filter("success").select((m % 20).alias("merchant_id"), i.alias("transaction_id"), "amount")
    return op.prepaid_income(paid, fees, pricing)


@query("d97_gmv_by_method", sql("pay", """
x AS (SELECT *, CASE WHEN priority = '1-URGENT' THEN 'card' WHEN priority = '2-HIGH' THEN 'upi' WHEN priority = '3-MEDIUM' THEN 'emandate' WHEN priority = '5-LOW' THEN 'cod' ELSE 'transfer' END AS mt FROM pay),
y AS (SELECT *, CASE WHEN mt = 'card' AND payment_id % 3 = 0 THEN 'Debit Card' WHEN mt = 'card' AND payment_id % 3 = 1 THEN 'Credit Card' WHEN mt = 'card' THEN 'Unknown Card' WHEN mt = 'upi' AND payment_id % 4 = 0 THEN 'UPI Collect'
  WHEN mt = 'upi' AND payment_id % 4 = 1 THEN 'UPI Intent' WHEN mt = 'upi' THEN 'UPI Unknown' WHEN mt = 'emandate' AND payment_id % 2 = 0 THEN 'emandate registrations' WHEN mt = 'emandate' THEN 'emandate debits' ELSE mt END AS pt FROM x)
SELECT merchant_id, coalesce(CAST(sum(amount) FILTER (mt = 'cod') AS DOUBLE), 0) AS gmv_cod, coalesce(CAST(sum(amount) FILTER (pt <> 'cod' AND success AND mt <> 'transfer') AS DOUBLE), 0) AS gmv_non_cod,
  coalesce(CAST(sum(amount) FILTER (mt = 'cod' OR success) AS DOUBLE), 0) AS gmv_total, count(DISTINCT pt) AS payment_types FROM y GROUP BY 1"""))
def _(t):
    p, i = t.payments(), F.col("payment_id")
    pr = F.col("priority")
    d = p.withColumn("method", F.when(pr == "1-URGENT", "card").when(pr == "2-HIGH", "upi").when(pr == "3-MEDIUM", "emandate").when(pr == "5-LOW", "cod").otherwise("transfer"))
    d = d.select("merchant_id", "payment_id", "amount", "method", F.col("success").alias("authorized"), F.when(F.col("method") == "card", i).alias("card_id"),
                 F.when(i % 2 == 0, "initial").otherwise("auto").alias("recurring_type"))
    cards = p.filter("priority = '1-URGENT' and payment_id % 3 <> 2").select(i.alias("card_id"), F.when(i % 3 == 0, "Debit").otherwise("credit").alias("card_type"))
    upi = p.filter("priority = '2-HIGH' and payment_id % 4 < 2").select("payment_id", F.when(i % 4 == 0, "collect").otherwise("PAY").alias("upi_type"))
    return op.gmv_by_method(d, cards, upi)


COVER = """a AS (SELECT DISTINCT merchant_id FROM pay WHERE period = 'Post' AND priority = '2-HIGH'),
e AS (SELECT DISTINCT merchant_id FROM pay WHERE merchant_id % 3 = 0), n AS (SELECT DISTINCT merchant_id FROM pay WHERE merchant_id % 5 = 0),
r AS (SELECT c_custkey AS merchant_id, CASE WHEN c_custkey % 2 = 0 THEN 'live' ELSE 'planned' END AS status FROM customer WHERE c_custkey % 7 < 5),
f AS (SELECT a.merchant_id, m.segment, e.merchant_id IS NOT NULL AS el, n.merchant_id IS NOT NULL AS ne, coalesce(r.status = 'live', FALSE) AS live, r.status FROM a LEFT JOIN e USING (merchant_id) LEFT JOIN n USING (merchant_id)
  LEFT JOIN r USING (merchant_id) JOIN mer m USING (merchant_id))"""


def flags(t):
    p, m = t.payments(), F.col("c_custkey")
    active = p.filter("period = 'Post' and priority = '2-HIGH'").select("merchant_id").distinct().join(t.merchants().select("merchant_id", "segment"), "merchant_id")
    ramp = t.raw("customer").filter("c_custkey % 7 < 5").select(m.alias("merchant_id"), F.when(m % 2 == 0, "live").otherwise("planned").alias("status"))
    return cov.coverage_flags(active, p.filter("merchant_id % 3 = 0"), p.filter("merchant_id % 5 = 0"), ramp, "merchant_id")


@query("d64_coverage", sql("pay mer", COVER + """
SELECT segment, NOT el AND NOT ne AS not_received_call, el AND live AS eligible_and_live, el AND NOT live AS eligible_and_not_live, ne AND NOT el AS all_ineligible, el AND ne AS both_eligible_and_ineligible,
  count(*) AS entities, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM f), 6) AS percentage FROM f GROUP BY 1, 2, 3, 4, 5, 6"""))
def _(t):
    by = ["segment", "not_received_call", "eligible_and_live", "eligible_and_not_live", "all_ineligible", "both_eligible_and_ineligible"]
    return rounded_all(cov.coverage(flags(t), by, "merchant_id"), ["percentage"])


@query("d64_coverage_by_status", sql("pay mer", COVER + """
SELECT CASE WHEN el THEN TRUE END AS eligible, CASE WHEN ne THEN TRUE END AS not_eligible, status, count(*) AS entities, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM f), 6) AS percentage FROM f GROUP BY 1, 2, 3"""))
def _(t):
    return rounded_all(cov.coverage(flags(t), ["eligible", "not_eligible", "status"], "merchant_id"), ["percentage"])


@query("d65_set_overlap", sql("pay", """
a AS (SELECT DISTINCT merchant_id FROM pay WHERE strftime(created_date, '%Y-%m') = '1997-05'), b AS (SELECT DISTINCT merchant_id FROM pay WHERE strftime(created_date, '%Y-%m') = '1997-06')
SELECT (SELECT count(*) FROM a JOIN b USING (merchant_id)) AS in_both, (SELECT count(*) FROM a ANTI JOIN b USING (merchant_id)) AS only_left, (SELECT count(*) FROM b ANTI JOIN a USING (merchant_id)) AS only_right,
  (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS in_any"""))
def _(t):
    p = t.payments()
    month = lambda m: p.filter(F.date_format("created_date", "yyyy-MM") == m)
    return cov.set_overlap(month("1997-05"), month("1997-06"), "merchant_id")


REASONS = "CASE WHEN text LIKE '%@%' THEN 'email' WHEN text LIKE '%http%' THEN 'link' WHEN n_chars < 800 THEN 'short_text' ELSE '' END"


def reasons(t):
    c = F.col("text")
    return t.raw("documents").select("source", "lang", F.when(c.contains("@"), "email").when(c.contains("http"), "link").when(F.col("n_chars") < 800, "short_text").otherwise("").alias("reason"))


@query("d66_ineligible_reasons", f"""
WITH d AS (SELECT source || '/' || lang AS entity, {REASONS} AS reason FROM documents), g AS (SELECT entity, string_agg(DISTINCT reason, ', ' ORDER BY reason) AS reasons FROM d WHERE reason <> '' GROUP BY 1)
SELECT *, contains(reasons, 'link') OR contains(reasons, 'sdk') AS eligible_now FROM g""")
def _(t):
    return cov.ineligible_reasons(reasons(t).withColumn("entity", F.concat_ws("/", "source", "lang")), "entity", "reason", ["link", "sdk"])


@query("d66_entities_per_reason", f"""
WITH d AS (SELECT source || '/' || lang AS entity, {REASONS} AS reason FROM documents) SELECT reason, count(DISTINCT entity) AS entities FROM d WHERE reason <> '' GROUP BY 1""")
def _(t):
    return cov.entities_per_reason(reasons(t).withColumn("entity", F.concat_ws("/", "source", "lang")), "entity", "reason")


@query("d67_rampup_cumulative", """
WITH s AS (SELECT DATE '2024-01-01' + CAST(c_custkey % 40 AS INTEGER) AS day, c_custkey FROM customer WHERE c_custkey % 6 <> 0), g AS (SELECT day, count(DISTINCT c_custkey) AS entities FROM s GROUP BY 1)
SELECT *, CAST(sum(entities) OVER (ORDER BY day) AS BIGINT) AS ramped_up FROM g""", dates="day")
def _(t):
    m = F.col("c_custkey")
    s = t.raw("customer").select(m.alias("merchant_id"), F.date_add(F.lit(dt.date(2024, 1, 1)), (m % 40).cast("int")).alias("day"), (m % 6 == 0).alias("blocked"))
    return cov.rampup_cumulative(s, "merchant_id", "day", F.col("blocked"))


VARIANTS = {"base": (), "segment_null": ("segment",), "name_null": ("name",), "nation_null": ("nation",), "segment_name_null": ("segment", "name"),
            "segment_nation_null": ("segment", "nation"), "name_nation_null": ("name", "nation")}


def variant_sql(v, cols):
    pick = lambda c, e: f"'' AS {c}" if c in cols else f"{e} AS {c}"
    return f"SELECT merchant_id, {pick('segment', 'segment')}, {pick('name', 'name')}, {pick('nation', 'CAST(nation AS VARCHAR)')}, '{v}' AS variant FROM mer"


def variants(t):
    d = t.merchants().select("merchant_id", "segment", "name", "nation")
    return cov.null_variants(d, ["segment", "name", "nation"], 2)


@query("d86_null_variants", sql("mer", " UNION ALL ".join(variant_sql(v, c) for v, c in VARIANTS.items())))
def _(t):
    return variants(t)


@query("d86_score_pivot", sql("mer", "u AS (" + " UNION ALL ".join(variant_sql(v, c) for v, c in VARIANTS.items()) + """),
s AS (SELECT merchant_id, variant, length(segment) * 3 + length(name) + length(nation) AS score FROM u)
SELECT merchant_id, """ + ", ".join(f"max(score) FILTER (variant = '{v}') AS score_{v}" for v in VARIANTS) + " FROM s GROUP BY 1"))
def _(t):
    scored = variants(t).withColumn("score", (F.length("segment") * 3 + F.length("name") + F.length("nation")).cast("bigint"))
    return cov.score_pivot(scored, "merchant_id", list(VARIANTS))


@query("d87_page_style_values", r"""
WITH c AS (SELECT page_id, unnest(list_concat(regexp_extract_all(lower(html), '(?s)<style[^>]*>(.*?)</style>', 1),
  regexp_extract_all(lower(html), '<(?:style|span|div|p|h1|h2|h3|h4|h5|h6)\b[^>]*?\sstyle=["'']([^"'']*)["'']', 1))) AS css FROM pages),
v AS (SELECT page_id, trim(unnest(regexp_extract_all(css, '(?:^|[;{\s])([a-z-]+)\s*:\s*([^;{}]+)', 2))) AS value FROM c),
g AS (SELECT page_id, value, count(*) AS uses FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY uses DESC, value) AS rank FROM g) SELECT * FROM r WHERE rank <= 5""")
def _(t):
    return text.page_colors(t.raw("pages"), "page_id", "html", prop="[a-z-]+")


HEX_SQL = "printf('%02x%02x%02x', CAST(p_size * 5 AS INTEGER), CAST(p_partkey % 16 * 10 AS INTEGER), CAST(p_size AS INTEGER))"


@query("d88_brand_colors", f"""
WITH g AS (SELECT {HEX_SQL} AS color, count(*) AS n FROM part WHERE p_size <> 7 GROUP BY 1)
SELECT color, n, round(CAST('0x' || substr(color, 1, 2) AS INTEGER) / 255.0::DOUBLE, 6) AS red, round(CAST('0x' || substr(color, 3, 2) AS INTEGER) / 255.0::DOUBLE, 6) AS green,
  round(CAST('0x' || substr(color, 5, 2) AS INTEGER) / 255.0::DOUBLE, 6) AS blue FROM g""")
def _(t):
    hx = F.format_string("%02x%02x%02x", F.col("p_size") * 5, F.col("p_partkey") % 16 * 10, F.col("p_size"))
    p = t.raw("part").select(F.when(F.col("p_size") == 7, "RK").otherwise(hx).alias("c"))
    return rounded_all(text.brand_colors(p, "c"), ["red", "green", "blue"])
