from pyspark.sql import functions as F

from ..functions.expr import flag, rounded
from ..operators import arms as op
from .registry import query
from .views import sql

ARMS = ["v1", "v2"]


def checkout_rows(t):
    return t.checkouts().withColumn("submitted", F.col("submit"))


def attempt_rows(t):
    """Payment attempts: purchase and error events; a purchase succeeds."""
    return t.events().filter(F.col("event_type").isin("purchase", "error")).select(
        "checkout_id", F.col("event_id").alias("attempt_id"), (F.col("event_type") == "purchase").alias("success"),
        (F.col("k") % 3).alias("gateway"), (F.col("k") % 7).alias("error_code"),
        (F.col("k") % 2).alias("section"), (F.col("k") % 5).alias("app"), "arm", "merchant_id")


ROWS = """r AS (SELECT c.checkout_id, c.merchant_id, c.device_id, c.arm, c.dt, c.eligible, c.platform, c.browser, c.os, c.submit AS submitted,
    c.open, c.paid, e.event_id AS attempt_id, e.event_type = 'purchase' AS success, e.k % 3 AS gateway, e.k % 7 AS error_code, e.k % 2 AS section, e.k % 5 AS app
  FROM cf c LEFT JOIN ev e ON c.checkout_id = e.checkout_id AND e.event_type IN ('purchase', 'error'))"""


def l0_sql(by, src="r"):
    by = "".join(b + ", " for b in by)
    return f"""m0 AS (SELECT {by}arm, count(DISTINCT checkout_id) AS checkouts, count(DISTINCT merchant_id) AS merchants,
    count(DISTINCT checkout_id) FILTER (submitted = 1) AS submits, count(DISTINCT attempt_id) AS attempts,
    count(DISTINCT attempt_id) FILTER (success) AS successes, count(DISTINCT checkout_id) FILTER (attempt_id IS NOT NULL) AS attempt_checkouts,
    count(DISTINCT checkout_id) FILTER (success) AS paid_checkouts,
    count(DISTINCT checkout_id) FILTER (submitted = 1 OR attempt_id IS NOT NULL) AS modified_submits FROM {src} GROUP BY ALL),
  m AS (SELECT *, round(checkouts::DOUBLE / (SELECT sum(checkouts) FROM m0), 6) AS split_pct, round(submits::DOUBLE / nullif(checkouts, 0), 6) AS modal_cr,
    round(modified_submits::DOUBLE / nullif(checkouts, 0), 6) AS modified_modal_cr, round(successes::DOUBLE / nullif(attempts, 0), 6) AS success_rate,
    round(attempts::DOUBLE / nullif(submits, 0), 6) AS submit_to_attempt, round(paid_checkouts::DOUBLE / nullif(checkouts, 0), 6) AS overall_cr FROM m0)"""


@query("d18_l0_metrics", sql("cf", f"{ROWS}, {l0_sql([], '(SELECT * FROM r WHERE eligible)')} SELECT * FROM m"))
def _(t):
    m = op.l0_metrics(checkout_rows(t).filter("eligible"), attempt_rows(t), "arm")
    return m.withColumns({k: rounded(k) for k in op.KPIS})


def compare_sql(by):
    cols = ", ".join(f"max({c}) FILTER (arm = '{a}') AS {c}_{a}" for a in ARMS for c in
                     ["checkouts", "attempts", "successes", "modal_cr", "success_rate", "submit_to_attempt", "overall_cr"])
    diffs = ", ".join(f"round({c}_v2 - {c}_v1, 6) AS {c}_diff" for c in ["modal_cr", "success_rate", "submit_to_attempt", "overall_cr"])
    names = ", ".join(by)
    return sql("cf", f"{ROWS}, {l0_sql(by)}, w AS (SELECT {names}, {cols} FROM m GROUP BY ALL) SELECT *, {diffs} FROM w")


def compare(t, by, attempt_by):
    m = op.l0_metrics(checkout_rows(t), attempt_rows(t), "arm", by, attempt_by).withColumns({k: rounded(k) for k in op.KPIS})
    out = op.l0_compare(m, [*by, *attempt_by], "arm", ARMS)
    return out.withColumns({c: rounded(c) for c in out.columns if c.endswith("_diff")})


SLICES = {"date": (["dt"], [], "dt"), "merchant": (["merchant_id"], [], ""), "platform_browser": (["platform", "browser"], [], ""),
          "os": (["os"], [], ""), "gateway": ([], ["gateway"], ""), "method_section": ([], ["gateway", "section"], ""), "app": ([], ["app"], "")}
for _slice, (_by, _att, _dates) in SLICES.items():
    query(f"d19_l0_compare_{_slice}", compare_sql(_by + _att), dates=_dates)(lambda t, by=_by, att=_att: compare(t, by, att))


@query("d20_balanced_entities", sql("cf", """
g AS (SELECT merchant_id, count(DISTINCT checkout_id) FILTER (arm = 'v1') AS a, count(DISTINCT checkout_id) FILTER (arm = 'v2') AS b FROM cf GROUP BY 1)
SELECT merchant_id, a + b AS total, round(a * 100.0::DOUBLE / (a + b), 6) AS pct_v1, round(b * 100.0::DOUBLE / (a + b), 6) AS pct_v2 FROM g WHERE a > 0 AND b > 0"""))
def _(t):
    b = op.balanced_entities(t.checkouts(), "arm", "merchant_id", ARMS, "checkout_id")
    return b.withColumns({"pct_v1": rounded("pct_v1"), "pct_v2": rounded("pct_v2")})


@query("d21_split_check", sql("cf", """
g AS (SELECT CASE WHEN n_events = 1 AND failed = 1 THEN 'NA' ELSE arm END AS arm, CASE WHEN min_k > 95 THEN 'NA' ELSE CAST(eligible AS VARCHAR) END AS eligible,
  count(DISTINCT checkout_id) AS ids FROM cf GROUP BY 1, 2)
SELECT *, CAST(sum(ids) OVER () AS BIGINT) AS all_ids, round(ids::DOUBLE / sum(ids) OVER (), 6) AS share FROM g"""))
def _(t):
    c = t.checkouts().select(
        "checkout_id", F.when(~((F.col("n_events") == 1) & (F.col("failed") == 1)), F.col("arm")).alias("arm"),
        F.when(F.col("min_k") <= 95, F.col("eligible")).alias("eligible"))
    return op.split_check(c, "arm", "eligible", "checkout_id").withColumn("share", rounded("share"))


@query("d22_error_mix", sql("cf", ROWS + """,
g AS (SELECT gateway, error_code, arm, count(DISTINCT attempt_id) AS n FROM r WHERE attempt_id IS NOT NULL AND NOT success GROUP BY 1, 2, 3),
s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY arm) AS share FROM g),
w AS (SELECT gateway, error_code, CAST(sum(n) FILTER (arm='v1') AS BIGINT) AS n_v1, CAST(sum(n) FILTER (arm='v2') AS BIGINT) AS n_v2,
  sum(share) FILTER (arm='v1') AS a, sum(share) FILTER (arm='v2') AS b FROM s GROUP BY 1, 2)
SELECT gateway, error_code, n_v1, n_v2, round(a, 6) AS share_v1, round(b, 6) AS share_v2, round(coalesce(b, 0) - coalesce(a, 0), 6) AS share_diff FROM w"""))
def _(t):
    out = op.error_mix(attempt_rows(t).filter("not success"), ["gateway", "error_code"], "arm", ARMS, "attempt_id")
    return out.withColumns({c: rounded(c) for c in ["share_v1", "share_v2", "share_diff"]})


@query("d23_submit_attempt_ratio", sql("cf", ROWS + """,
p AS (SELECT checkout_id, max(submitted) AS s, count(DISTINCT attempt_id) AS attempts FROM r GROUP BY 1),
g AS (SELECT attempts, count(*) AS checkouts FROM p WHERE s = 1 GROUP BY 1)
SELECT *, round(checkouts::DOUBLE / sum(checkouts) OVER (), 6) AS share FROM g"""))
def _(t):
    return op.submit_attempt_ratio(checkout_rows(t), attempt_rows(t), "checkout_id", "submitted", "attempt_id", "success").withColumn("share", rounded("share"))


@query("d68_effect_size", sql("cf", """
g AS (SELECT merchant_id, CAST(sum(open) FILTER (arm='v1') AS BIGINT) AS n_v1, CAST(sum(open*paid) FILTER (arm='v1') AS BIGINT) AS x_v1,
  CAST(sum(open) FILTER (arm='v2') AS BIGINT) AS n_v2, CAST(sum(open*paid) FILTER (arm='v2') AS BIGINT) AS x_v2 FROM cf GROUP BY 1)
SELECT *, round(x_v1::DOUBLE / nullif(n_v1, 0), 6) AS p_v1, round(x_v2::DOUBLE / nullif(n_v2, 0), 6) AS p_v2,
  round(abs(2 * asin(sqrt(x_v1::DOUBLE / nullif(n_v1, 0))) - 2 * asin(sqrt(x_v2::DOUBLE / nullif(n_v2, 0)))), 6) AS h
FROM g WHERE n_v1 IS NOT NULL AND n_v2 IS NOT NULL"""))
def _(t):
    c = t.checkouts().withColumn("won", F.col("open") * F.col("paid"))
    out = op.effect_size(c, "arm", ARMS, ["merchant_id"], "open", "won")
    return out.withColumns({c: rounded(c) for c in ["p_v1", "p_v2", "h"]})


CROSS = "CAST(sum(open) AS BIGINT) AS opens, CAST(sum(open*paid) AS BIGINT) AS paid, round(sum(open*paid)::DOUBLE / nullif(sum(open), 0), 6) AS cr FROM x GROUP BY ALL"


@query("d100_arm_cross", sql("cf", f"""
x AS (SELECT *, CASE device_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS arm_b FROM cf)
SELECT merchant_id, arm, arm_b, {CROSS}"""))
def _(t):
    d = F.col("device_id") % 3
    c = t.checkouts().withColumn("arm_b", F.when(d == 0, "a").when(d == 1, "b").otherwise("c")).withColumn("won", F.col("open") * F.col("paid"))
    return op.arm_cross(c, "arm", "arm_b", ["merchant_id"], "open", "won").withColumn("cr", rounded("cr"))


@query("d106_method_share_by_arm", sql("cf", ROWS + """
SELECT merchant_id, arm, count(*) AS attempts, count(*) FILTER (gateway = 0) AS method_attempts,
  round(count(*) FILTER (gateway = 0)::DOUBLE / count(*), 6) AS method_share FROM r WHERE attempt_id IS NOT NULL GROUP BY 1, 2"""))
def _(t):
    out = op.method_share_by_arm(attempt_rows(t), "merchant_id", "arm", F.col("gateway") == 0)
    return out.withColumn("method_share", rounded("method_share"))


@query("d107_ineligible_sessions", sql("cf", """
b AS (SELECT DISTINCT CASE WHEN max_k >= 80 THEN 'amount_too_high' WHEN failed = 1 THEN 'payment_error' ELSE 'NA' END AS reason, checkout_id FROM cf WHERE NOT eligible),
g AS (SELECT reason, count(*) AS sessions FROM b GROUP BY 1)
SELECT *, round(sessions::DOUBLE / sum(sessions) OVER (), 6) AS share FROM g"""))
def _(t):
    c = t.checkouts().withColumn("reason", F.when(F.col("max_k") >= 80, "amount_too_high").when(F.col("failed") == 1, "payment_error"))
    return op.ineligible_sessions(c, F.col("eligible"), "reason", "checkout_id").withColumn("share", rounded("share"))


@query("d108_effective_arm", sql("cf", """
f AS (SELECT arm, failed, CASE WHEN max_k % 10 <> 0 THEN render = 1 END AS flow FROM cf)
SELECT CASE WHEN arm <> 'v2' OR flow IS NULL THEN arm ELSE (CASE WHEN flow THEN 'test' ELSE 'control' END) || (CASE WHEN failed = 1 THEN '_change_method_clicked' ELSE '' END) END AS effective,
  arm, count(*) AS n FROM f GROUP BY 1, 2"""))
def _(t):
    flow = F.when(F.col("max_k") % 10 != 0, F.col("render") == 1)
    e = op.effective_arm(F.col("arm"), flow, F.col("failed") == 1, "v2")
    return t.checkouts().groupBy(e.alias("effective"), "arm").agg(F.count("*").alias("n"))


@query("d80_variant_cr", sql("cf", """
b AS (SELECT CASE WHEN period = 'Prev' THEN 'pre' ELSE arm END AS variant, open, open*paid AS won, CAST(dt AS VARCHAR) AS day, CAST(merchant_id AS VARCHAR) AS merchant,
  CASE WHEN merchant_id < 5 THEN 'team_a' ELSE 'team_b' END AS team FROM cf),
l AS (SELECT variant, open, won, 'all' AS slice, 'all' AS value FROM b UNION ALL SELECT variant, open, won, 'date', day FROM b
  UNION ALL SELECT variant, open, won, 'team', team FROM b UNION ALL SELECT variant, open, won, 'merchant', merchant FROM b)
SELECT variant, slice, value, CAST(sum(open) AS BIGINT) AS opens, CAST(sum(won) AS BIGINT) AS paid, round(sum(won)::DOUBLE / nullif(sum(open), 0), 6) AS cr FROM l GROUP BY 1, 2, 3"""))
def _(t):
    c = t.checkouts().withColumn("won", F.col("open") * F.col("paid")).withColumn("variant", F.col("arm"))
    slices = {"date": F.col("dt"), "team": F.when(F.col("merchant_id") < 5, "team_a").otherwise("team_b"), "merchant": F.col("merchant_id")}
    out = op.variant_cr(c.filter("period = 'Post'"), "variant", slices, "open", "won", pre=c.filter("period = 'Prev'"))
    return out.withColumn("cr", rounded("cr"))
