from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import funnel as op
from .registry import query
from .views import STEPS, sql

STEP_SQL = """CASE event_type WHEN 'signup' THEN '1_open' WHEN 'view' THEN '2_render'
  WHEN 'click' THEN '3_submit' WHEN 'purchase' THEN '4_paid' END"""
LABELS = list(STEPS.values())


@query("d09_funnel", sql("ev", f"""
SELECT merchant_id, step, count(DISTINCT checkout_id) AS ids
FROM (SELECT *, {STEP_SQL} AS step FROM ev) WHERE step IS NOT NULL GROUP BY 1, 2"""))
def _(t):
    return op.funnel(t.events(), STEPS, "checkout_id", ["merchant_id"])


@query("d10_funnel_compare", sql("ev", f"""
f AS (SELECT arm, step, count(DISTINCT checkout_id) AS ids
  FROM (SELECT *, {STEP_SQL} AS step FROM ev) WHERE step IS NOT NULL GROUP BY 1, 2),
p AS (SELECT f.*, f.ids * 100 / nullif(CAST(b.ids AS DOUBLE), 0) AS pct FROM f JOIN f b ON f.arm = b.arm AND b.step = '1_open'),
w AS (SELECT step, CAST(sum(ids) FILTER (arm = 'v1') AS BIGINT) AS ids_v1, CAST(sum(ids) FILTER (arm = 'v2') AS BIGINT) AS ids_v2,
  sum(pct) FILTER (arm = 'v1') AS a, sum(pct) FILTER (arm = 'v2') AS b FROM p GROUP BY 1)
SELECT step, ids_v1, ids_v2, round(a, 6) AS pct_v1, round(b, 6) AS pct_v2, round(b - a, 6) AS pct_diff FROM w"""))
def _(t):
    f = op.funnel(t.events(), STEPS, "checkout_id", ["arm"])
    out = op.funnel_compare(f, "arm", ["v1", "v2"], LABELS[0])
    return out.select("step", "ids_v1", "ids_v2", *[rounded(c).alias(c) for c in ["pct_v1", "pct_v2", "pct_diff"]])


@query("d11_funnel_dropoffs", sql("ev", f"""
f AS (SELECT merchant_id, step, count(DISTINCT checkout_id) AS ids
  FROM (SELECT *, {STEP_SQL} AS step FROM ev) WHERE step IS NOT NULL GROUP BY 1, 2),
w AS (SELECT merchant_id, {", ".join(f"CAST(coalesce(sum(ids) FILTER (step = '{s}'), 0) AS BIGINT) AS n_{s}" for s in LABELS)}
  FROM f GROUP BY 1)
SELECT *, {", ".join(f"round(CAST(n_{s} AS DOUBLE) / nullif(n_{LABELS[0]}, 0), 6) AS share_{s}" for s in LABELS)},
  {", ".join(f"round(CAST(n_{a} - n_{b} AS DOUBLE) / nullif(n_{a}, 0), 6) AS loss_{a}_{b}" for a, b in zip(LABELS, LABELS[1:]))}
FROM w"""))
def _(t):
    f = op.funnel(t.events(), STEPS, "checkout_id", ["merchant_id"])
    out = op.funnel_dropoffs(f, "merchant_id", LABELS)
    return out.select(*[rounded(c).alias(c) if c.startswith(("share", "loss")) else F.col(c) for c in out.columns])


# A checkout stands for the summary screen: signup = loaded, purchase = the
# continue click, click = contact touched, error = coupon touched, view = edit.
REASON_SQL = """CASE WHEN paid = 1 THEN 'Summary Screen CTA clicked'
  WHEN open = 0 THEN 'Summary Screen did not load'
  WHEN submit = 1 AND failed = 1 THEN 'Interacted w both coupons and contact'
  WHEN submit = 1 THEN 'Interacted w contact but not coupons'
  WHEN failed = 1 THEN 'Interacted w coupons but not contact'
  ELSE 'Bounced w/o any interaction' END"""


def with_reason(fact):
    is1 = lambda c: F.col(c) == 1
    return fact.withColumn("reason", op.dropoff_reason(is1("open"), is1("paid"), is1("submit"), is1("failed"), is1("render")))


# In this query it is not known of some checkouts whether contact or coupons were touched.
@query("d12_dropoff_mix", sql("cf", """
f AS (SELECT *, CASE WHEN max_k % 7 <> 0 THEN submit END AS contact, CASE WHEN max_k % 5 <> 0 THEN failed END AS coupon FROM cf),
r AS (SELECT platform, CASE WHEN paid = 1 THEN 'Summary Screen CTA clicked' WHEN open = 0 THEN 'Summary Screen did not load'
    WHEN contact = 1 AND coupon = 0 THEN 'Interacted w contact but not coupons' WHEN contact = 0 AND coupon = 1 THEN 'Interacted w coupons but not contact'
    WHEN contact = 1 AND coupon = 1 THEN 'Interacted w both coupons and contact' WHEN contact = 0 AND coupon = 0 THEN 'Bounced w/o any interaction'
    WHEN render = 1 THEN 'Exited to Edit Address' ELSE 'Others' END AS reason, count(DISTINCT checkout_id) AS checkouts FROM f GROUP BY 1, 2)
SELECT platform, reason, checkouts, CAST(sum(checkouts) OVER (PARTITION BY platform) AS BIGINT) AS slice_total,
  round(CAST(checkouts AS DOUBLE) / sum(checkouts) OVER (PARTITION BY platform), 6) AS share FROM r"""))
def _(t):
    known = lambda c, n: F.when(F.col("max_k") % n != 0, F.col(c) == 1)
    c = t.checkouts()
    reason = op.dropoff_reason(F.col("open") == 1, F.col("paid") == 1, known("submit", 7), known("failed", 5), F.col("render") == 1)
    return op.reason_mix(c.withColumn("reason", reason), ["platform"], "reason", "checkout_id").withColumn("share", rounded("share"))


METHODS = ["cod", "card", "upi"]
METHOD_SQL = "CASE k % 3 WHEN 0 THEN 'cod' WHEN 1 THEN 'card' ELSE 'upi' END"


def method_of_event():
    m = F.col("k") % 3
    return F.when(m == 0, "cod").when(m == 1, "card").otherwise("upi")


@query("d91_method_funnel", sql("ev", f"""
c AS (SELECT arm, {METHOD_SQL} AS method, checkout_id, max((event_type='view')::INT) AS shown,
  max((event_type IN ('click','signup'))::INT) AS selected, max((event_type='click')::INT) AS submitted,
  max((event_type IN ('purchase','error'))::INT) AS initiated, max((event_type='purchase')::INT) AS completed
  FROM ev GROUP BY ALL),
s AS (SELECT arm, method, CAST(sum(shown) AS BIGINT) AS shown, CAST(sum(selected) AS BIGINT) AS selected,
  CAST(sum(submitted) AS BIGINT) AS submitted, CAST(sum(initiated) AS BIGINT) AS initiated,
  CAST(sum(completed) AS BIGINT) AS completed FROM c GROUP BY ALL)
SELECT *, round(CAST(selected AS DOUBLE) / nullif(shown, 0), 6) AS selected_rate,
  round(CAST(submitted AS DOUBLE) / nullif(selected, 0), 6) AS submitted_rate,
  round(CAST(initiated AS DOUBLE) / nullif(submitted, 0), 6) AS initiated_rate,
  round(CAST(completed AS DOUBLE) / nullif(initiated, 0), 6) AS completed_rate FROM s"""))
def _(t):
    e = F.col("event_type")
    out = op.method_funnel(t.events(), "checkout_id", ["arm"], method_of_event(), METHODS, {
        "shown": e == "view", "selected": e.isin("click", "signup"), "submitted": e == "click",
        "initiated": e.isin("purchase", "error"), "completed": e == "purchase"})
    return out.select(*[rounded(c).alias(c) if c.endswith("_rate") else F.col(c) for c in out.columns])


@query("d78_path_counts", sql("cf", """
SELECT platform, count(*) AS checkouts,
  count(*) FILTER (submit=0 AND failed=0) AS "none", count(*) FILTER (submit=0 AND failed=0 AND paid=1) AS none_converted,
  count(*) FILTER (submit=1 AND failed=0) AS contact_only, count(*) FILTER (submit=1 AND failed=0 AND paid=1) AS contact_only_converted,
  count(*) FILTER (submit=0 AND failed=1) AS coupon_only, count(*) FILTER (submit=0 AND failed=1 AND paid=1) AS coupon_only_converted,
  count(*) FILTER (submit=1 AND failed=1) AS both, count(*) FILTER (submit=1 AND failed=1 AND paid=1) AS both_converted
FROM cf GROUP BY 1"""))
def _(t):
    return op.path_counts(t.checkouts(), ["platform"], F.col("submit") == 1, F.col("failed") == 1, F.col("paid") == 1)
