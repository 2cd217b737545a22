import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import bands, flag, rounded
from ..functions.periods import period_start
from ..operators import mix, risk as op, stats
from ..operators.labels import MODELS
from .q_activity import rounded_all
from .q_aggregates import CHI_SQL
from .q_facts import order_status, rto_fact
from .q_projection import MODELS_SQL
from ..functions.expr import code_name
from .registry import query
from .views import sql

M = "CAST(date_trunc('month', created_date) AS DATE) AS month"


def monthly(t):
    return rto_fact(t).withColumn("month", period_start("created_date", "month"))


LABEL = "CASE WHEN result_flag = 'green' THEN 'safe' WHEN result_flag = 'red' AND experimentation THEN 'safe' WHEN result_flag = 'red' THEN 'risky' ELSE 'unknown' END"


def risky_sql(by, extra=""):
    k = ", ".join(by)
    return f"""g AS (SELECT *, {M}, {LABEL} AS label, {MODELS_SQL.format(c="model_code")} AS model FROM rto),
      h AS (SELECT {k}, count(*) AS orders, count(*) FILTER (label='risky') AS risky, count(*) FILTER (label='safe') AS safe, count(*) FILTER (label='unknown') AS unknown FROM g GROUP BY ALL)
      SELECT * {extra}, round(risky::DOUBLE / orders, 6) AS risky_rate FROM h"""


@query("d33_risky_rate", sql("rto", risky_sql(["month"])), dates="month")
def _(t):
    return rounded_all(op.risky_rate(monthly(t), ["month"]), ["risky_rate"])


@query("d33_risky_rate_by_tier_model", sql("rto", risky_sql(["period", "tier", "model"], "REPLACE (CAST(tier AS BIGINT) AS tier)")))
def _(t):
    d = rto_fact(t, dims=True).withColumn("model", code_name("model_code", MODELS, "Other"))
    return rounded_all(op.risky_rate(d, ["period", "tier", "model"]), ["risky_rate"])


def quality_sql(by, m=""):
    return f"""g AS (SELECT *, {M}, {MODELS_SQL.format(c="model_code")} AS model, status = 'rto' AS back, NOT (ml_flag = 'green' AND rule_flag = 'green') AS risky FROM rto),
c AS (SELECT {by}, count(*) AS orders, count(*) FILTER (back AND risky) AS rto_risky, count(*) FILTER (back AND NOT risky) AS rto_safe,
  count(*) FILTER (NOT back AND risky) AS non_rto_risky, count(*) FILTER (NOT back AND NOT risky) AS non_rto_safe FROM g GROUP BY 1),
q AS (SELECT *, rto_risky::DOUBLE / nullif(rto_risky + non_rto_risky, 0) AS p, rto_risky::DOUBLE / nullif(rto_risky + rto_safe, 0) AS r FROM c),
f AS (SELECT *, 2 * p * r / nullif(p + r, 0) AS f FROM q)"""


@query("d34_classifier_quality", sql("rto", quality_sql("month") + """
SELECT month, orders, rto_risky, rto_safe, non_rto_risky, non_rto_safe, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f_score FROM f"""), dates="month")
def _(t):
    return rounded_all(op.classifier_quality(monthly(t), ["month"]), ["precision", "recall", "f_score"])


@query("d35_rolling_quality", sql("rto", quality_sql("month") + """
SELECT month, round(avg(p) OVER w, 6) AS precision_4, round(avg(r) OVER w, 6) AS recall_4, round(avg(f) OVER w, 6) AS f_score_4 FROM f WINDOW w AS (ORDER BY month ROWS 3 PRECEDING)"""), dates="month")
def _(t):
    q = op.rolling_quality(op.classifier_quality(monthly(t), ["month"]), "month")
    return rounded_all(q, ["precision_4", "recall_4", "f_score_4"])


def impact_sql(hits, base):
    return f"""b AS (SELECT *, {MODELS_SQL.format(c="model_code")} AS model, status = 'rto' AS back, NOT (ml_flag = 'green' AND rule_flag = 'green') AS risky FROM rto),
l AS (SELECT model, count(*) FILTER (period='Prev' AND {base})::DOUBLE AS a, count(*) FILTER (period='Post' AND {base})::DOUBLE AS b,
  count(*) FILTER (period='Prev' AND {hits})::DOUBLE AS c, count(*) FILTER (period='Post' AND {hits})::DOUBLE AS d FROM b GROUP BY 1),
s AS (SELECT *, coalesce(c / nullif(a, 0), 0) AS r0, coalesce(d / nullif(b, 0), 0) AS r1, a / sum(a) OVER () AS s0, b / sum(b) OVER () AS s1 FROM l)
SELECT model, round(r0, 6) AS cr_pre, round(r1, 6) AS cr_post, round(s0, 6) AS share_pre, round(s1, 6) AS share_post, round(r0 * (s1 - s0) * 100, 6) AS vol_impact,
  round(s1 * (r1 - r0) * 100, 6) AS rate_impact, round((r0 * (s1 - s0) + s1 * (r1 - r0)) * 100, 6) AS total_impact FROM s"""


def model_leaf(t, hits, base):
    return mix.leaf_table(model_rows(t), ["model"], "period", "Prev", "Post", base, hits)


def model_rows(t):
    risky = ~((F.col("ml_flag") == "green") & (F.col("rule_flag") == "green"))
    back = F.col("status") == "rto"
    return rto_fact(t).select("period", code_name("model_code", MODELS, "Other").alias("model"), F.lit(1).alias("orders"),
                              flag(risky).alias("risky"), flag(risky & back).alias("hit"))


IMPACT_OUT = ["cr_pre", "cr_post", "share_pre", "share_post", "vol_impact", "rate_impact", "total_impact"]


@query("d36_model_precision_impact", sql("rto", impact_sql("risky AND back", "risky")))
def _(t):
    return rounded_all(mix.model_impact(model_leaf(t, "hit", "risky"), "model"), IMPACT_OUT).select("model", *IMPACT_OUT)


@query("d36_model_flag_rate_impact", sql("rto", impact_sql("risky", "TRUE")))
def _(t):
    return rounded_all(mix.model_impact(model_leaf(t, "risky", "orders"), "model"), IMPACT_OUT).select("model", *IMPACT_OUT)


START, END = dt.date(1997, 1, 1), dt.date(1998, 1, 1)
AVAIL = """g AS (SELECT CAST(date_trunc('month', created_date) AS DATE) AS period_start, *, {e} AS e FROM rto
    WHERE created_date >= DATE '1997-01-01' - 21 AND created_date < DATE '1998-01-01' - 21),
  a AS (SELECT period_start, e, count(*) AS orders, count(*) FILTER (status IN ('delivered', 'rto')) AS with_status, count(*) FILTER (status = 'delivered') AS delivered FROM g GROUP BY 1, 2)"""


@query("d37_shipping_availability", sql("rto", AVAIL.format(e="segment") + """
SELECT period_start, e AS segment, orders, with_status, delivered, round(with_status::DOUBLE / orders, 6) AS availability FROM a"""), dates="period_start")
def _(t):
    out = op.shipping_availability(rto_fact(t, dims=True), period_start("created_date", "month"), ["segment"], START, END)
    return rounded_all(out, ["availability"])


@query("d37_availability_bins", sql("rto", AVAIL.format(e="merchant_id") + """,
b AS (SELECT *, with_status::DOUBLE / orders AS v FROM a)
SELECT period_start, CASE WHEN v > -0.1 AND v <= 0 THEN '(-0.1, 0.0]' WHEN v <= 0.2 THEN '(0.0, 0.2]' WHEN v <= 0.5 THEN '(0.2, 0.5]' WHEN v <= 0.8 THEN '(0.5, 0.8]'
  WHEN v <= 0.9 THEN '(0.8, 0.9]' ELSE '(0.9, 1.0]' END AS bin, count(*) AS entities FROM b GROUP BY 1, 2"""), dates="period_start")
def _(t):
    return op.availability_bins(op.shipping_availability(rto_fact(t), period_start("created_date", "month"), ["merchant_id"], START, END))


AGES = [1, 3, 6, 9, 12]


@query("d56_rto_by_age", sql("rto", "l AS (SELECT merchant_id, min(created_date) + 45 AS live_date FROM pay GROUP BY 1), o AS (SELECT r.*, live_date, trunc(date_diff('day', live_date, created_date) / 30.0) AS m FROM rto r JOIN l USING (merchant_id)), g AS (SELECT merchant_id, max(live_date) AS live_date, " + ", ".join(
    f"count(*) FILTER (m <= {c}) AS orders_{c}, count(*) FILTER (m <= {c} AND status IN ('delivered', 'rto')) AS delivery_{c}, count(*) FILTER (m <= {c} AND status = 'rto') AS rto_{c}" for c in AGES)
    + " FROM o GROUP BY 1) SELECT *, " + ", ".join(f"round(delivery_{c}::DOUBLE / nullif(orders_{c}, 0), 4) AS delivery_rate_{c}, round(rto_{c}::DOUBLE / nullif(orders_{c}, 0), 4) AS rto_rate_{c}" for c in AGES) + " FROM g"), dates="live_date")
def _(t):
    live = t.payments().groupBy("merchant_id").agg(F.date_add(F.min("created_date"), 45).alias("live_date"))
    return op.rto_by_age(order_status(t), live, "merchant_id", "created_date", "live_date", "status", AGES)


@query("d57_band_coverage", sql("rto", """
e AS (SELECT merchant_id, count(*) AS n, count(*) FILTER (status IN ('delivered', 'rto'))::DOUBLE / count(*) AS d FROM rto GROUP BY 1),
b AS (SELECT CASE WHEN n > 0 AND n <= 8 THEN '(0, 8]' WHEN n > 8 AND n <= 12 THEN '(8, 12]' WHEN n > 12 THEN '(12, 100000]' END AS band_a,
  CASE WHEN d > 0 AND d <= 0.5 THEN '(0, 0.5]' WHEN d > 0.5 AND d <= 0.8 THEN '(0.5, 0.8]' WHEN d > 0.8 THEN '(0.8, 1]' END AS band_b FROM e),
g AS (SELECT band_a, band_b, count(*) AS entities FROM b GROUP BY 1, 2), s AS (SELECT *, entities::DOUBLE / sum(entities) OVER () AS share FROM g)
SELECT band_a, band_b, entities, round(share, 6) AS share, round(sum(share) OVER (ORDER BY band_a NULLS LAST, band_b NULLS LAST ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM s"""))
def _(t):
    e = order_status(t).groupBy("merchant_id").agg(F.count("*").alias("n"), (F.sum(flag(F.col("status").isin(op.VALID_STATUS))) / F.count("*")).alias("d"))
    out = op.band_coverage(e, bands("n", [0, 8, 12, 100000], right_closed=True), bands("d", [0, 0.5, 0.8, 1], right_closed=True))
    return rounded_all(out, ["share", "cumulative"])


FEATURES = ["is_cod", "tier", "big_amount"]


def feature_rows(t):
    return rto_fact(t, dims=True).select(
        "segment", flag(F.col("method") == "cod").alias("is_cod"), F.col("tier").cast("int").alias("tier"), flag(F.col("amount") > 250000).alias("big_amount"),
        flag(F.col("status") == "rto").alias("rto"))


@query("d58_feature_association", sql("rto", """
b AS (SELECT segment, (method = 'cod')::INT AS is_cod, tier::INT AS tier, (amount > 250000)::INT AS big_amount, (status = 'rto')::INT AS y FROM rto),
u AS (SELECT segment, y, unnest(['is_cod', 'tier', 'big_amount']) AS feature, unnest([is_cod, tier, big_amount]) AS x FROM b),
r AS (SELECT segment, feature, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS corr FROM u GROUP BY 1, 2),
c AS (SELECT segment, feature, x, y, count(*) AS n FROM u GROUP BY ALL),
d AS (SELECT *, sum(n) OVER (PARTITION BY segment, feature, x) AS r, sum(n) OVER (PARTITION BY segment, feature, y) AS k FROM c),
e AS (SELECT segment, feature, CAST(sum(n) AS BIGINT) AS n, sum(n::DOUBLE * n / (r * k)) AS s, least(count(DISTINCT x), count(DISTINCT y)) - 1 AS v FROM d GROUP BY 1, 2)
SELECT segment, feature, round(corr, 6) AS corr, n, round(CASE WHEN v > 0 THEN n * greatest(s - 1, 0) END, 4) AS chi2, round(sqrt(CASE WHEN v > 0 THEN greatest(s - 1, 0) / v END), 6) AS cramers_v
FROM r JOIN e USING (segment, feature)"""))
def _(t):
    out = stats.feature_association(feature_rows(t), "segment", FEATURES, "rto")
    return out.select("segment", "feature", rounded("corr").alias("corr"), "n", rounded("chi2", 4).alias("chi2"), rounded("cramers_v").alias("cramers_v"))


@query("d59_rule_contribution", sql("rto", """
g AS (SELECT rule_flag, count(*) FILTER (status = 'rto') AS outcomes FROM rto GROUP BY 1)
SELECT *, round(outcomes::DOUBLE / sum(outcomes) OVER () * 100, 6) AS percentage FROM g"""))
def _(t):
    return rounded_all(op.rule_contribution(rto_fact(t), "rule_flag", F.col("status") == "rto"), ["percentage"])
