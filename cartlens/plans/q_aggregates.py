from pyspark.sql import functions as F

from ..functions.expr import flag, ratio, rounded, sum_money
from ..functions.grouped import (count_ids, distinct_counts, exact_quantiles, latest_per_key, pivot_sum, set_sketches, sketch_totals, with_report_totals,
                                 with_total_row)
from ..operators import stats
from .registry import query
from .views import PRIORITIES, sql

PCTS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
PCT_SQL = ", ".join(f"round(quantile_cont({{c}}, {p}), 6) AS {n}" for n, p in PCTS.items())


def pct_cols():
    return [rounded(n).alias(n) for n in PCTS]


@query("a01_group_agg", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
  min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS mean_qty
FROM lineitem GROUP BY 1, 2""")
def _(t):
    return t.raw("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), sum_money("l_extendedprice").alias("total"), F.min("l_extendedprice").alias("lo"),
        F.max("l_extendedprice").alias("hi"), rounded(sum_money("l_quantity") / F.count("*")).alias("mean_qty"))


@query("a02_conditional_agg", sql("ev", """
SELECT dt, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase' AND k >= 50) AS big,
  CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase'), 0) AS DOUBLE) AS gmv FROM ev GROUP BY 1"""), dates="dt")
def _(t):
    e = F.col("event_type")
    return t.events().groupBy("dt").agg(
        F.count_if(e == "view").alias("views"), F.count_if((e == "purchase") & (F.col("k") >= 50)).alias("big"),
        F.coalesce(sum_money(F.when(e == "purchase", F.col("value"))), F.lit(0.0)).alias("gmv"))


@query("a03_conditional_distinct", sql("ev", """
SELECT merchant_id, count(DISTINCT CASE WHEN event_type = 'view' THEN checkout_id END) AS views,
  count(DISTINCT CASE WHEN event_type = 'purchase' THEN checkout_id END) AS paid,
  count(DISTINCT CASE WHEN event_type = 'error' AND k > 90 THEN checkout_id END) AS hard_errors FROM ev GROUP BY 1"""))
def _(t):
    e = F.col("event_type")
    return count_ids(t.events(), ["merchant_id"], "checkout_id", {
        "views": e == "view", "paid": e == "purchase", "hard_errors": (e == "error") & (F.col("k") > 90)})


@query("a04_flag_rollup", sql("ev", """
SELECT checkout_id, CAST(max(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) AS BIGINT) AS open,
  CAST(max(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS BIGINT) AS paid, min(dt) AS first_date FROM ev GROUP BY 1"""), dates="first_date")
def _(t):
    e = F.col("event_type")
    return t.events().groupBy("checkout_id").agg(
        F.max(flag(e == "signup")).alias("open"), F.max(flag(e == "purchase")).alias("paid"), F.min("dt").alias("first_date"))


@query("a05_any_value_seen", sql("ev", """
SELECT checkout_id, max(CASE WHEN event_type = 'error' THEN CAST(k AS VARCHAR) END) AS error_k,
  max(CASE WHEN event_type = 'view' THEN event_type END) AS seen FROM ev GROUP BY 1"""))
def _(t):
    e = F.col("event_type")
    k = F.get_json_object(F.concat(F.lit('{"k": "'), "k", F.lit('"}')), "$.k")
    return t.events().groupBy("checkout_id").agg(
        F.max(F.when(e == "error", k)).alias("error_k"), F.max(F.when(e == "view", e)).alias("seen"))


@query("a06_sum_distinct", sql("ev", """
SELECT checkout_id, CAST(sum(DISTINCT CAST(event_type = 'view' AS INTEGER)) AS BIGINT) AS viewed,
  CAST(sum(DISTINCT CAST(event_type = 'click' AS INTEGER)) AS BIGINT) AS clicked FROM ev GROUP BY 1"""))
def _(t):
    # distinct values of a 0/1 flag add up to its maximum: no distinct needed
    e = F.col("event_type")
    return t.events().groupBy("checkout_id").agg(
        F.max(flag(e == "view")).cast("bigint").alias("viewed"), F.max(flag(e == "click")).cast("bigint").alias("clicked"))


@query("a07_multi_distinct", sql("ev", """
SELECT arm, event_type, count(DISTINCT checkout_id) AS checkouts, count(DISTINCT merchant_id) AS merchants,
  count(DISTINCT device_id) AS devices, count(DISTINCT k) AS ks, count(DISTINCT dt) AS days FROM ev GROUP BY 1, 2"""))
def _(t):
    return distinct_counts(t.events(), ["arm", "event_type"], {
        "checkouts": "checkout_id", "merchants": "merchant_id", "devices": "device_id", "ks": "k", "days": "dt"})


@query("a07_totals_from_sketches", sql("ev", """
SELECT date_trunc('week', dt)::DATE AS week, event_type, count(DISTINCT checkout_id) AS checkouts, count(DISTINCT device_id) AS devices, TRUE AS close FROM ev GROUP BY 1, 2"""), dates="week")
def _(t):
    """Weekly distinct counts, exact, and whether those added up from stored daily sketches lie within five standard errors."""
    from ..session import scratch_dir
    from ..sources.io import append_partitioned
    idents, e = {"checkouts": "checkout_id", "devices": "device_id"}, t.events().select("dt", "event_type", "checkout_id", "device_id")
    path = scratch_dir(t.spark, "sketches")
    append_partitioned(set_sketches(e, ["dt", "event_type"], idents), path, "dt")
    week = F.to_date(F.date_trunc("week", "dt")).alias("week")
    about = sketch_totals(t.spark.read.parquet(path).select(week, "event_type", *idents), ["week", "event_type"], list(idents))
    exact = distinct_counts(e.select(week, "event_type", *idents.values()), ["week", "event_type"], idents)
    near = F.lit(True)
    for n in idents:
        near = near & (F.abs(F.col(f"a.{n}") - F.col(f"x.{n}")) <= 5 * 1.04 / 128 * F.col(f"x.{n}") + 1)
    return exact.alias("x").join(about.alias("a"), ["week", "event_type"]).select("week", "event_type", "x.checkouts", "x.devices", near.alias("close"))


@query("a08_null_groups", """
a AS (SELECT l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'kept' AS mode, CAST(quality AS BIGINT) AS quality, count(*) AS n FROM a GROUP BY 2
UNION ALL SELECT 'dropped', CAST(quality AS BIGINT), count(*) FROM a WHERE quality IS NOT NULL GROUP BY 2""".replace("a AS", "WITH a AS", 1))
def _(t):
    a = t.raw("documents").join(t.raw("labels"), "doc_id", "left")
    kept = a.groupBy("quality").agg(F.count("*").alias("n"))
    tag = lambda d, m: d.select(F.lit(m).alias("mode"), "quality", "n")
    return tag(kept, "kept").unionByName(tag(kept.dropna(subset=["quality"]), "dropped"))


@query("a09_pivot_one", sql("pay", "SELECT created_date, " + ", ".join(
    f"CAST(sum(amount) FILTER (priority = '{p}') AS DOUBLE) AS gmv_{i}" for i, p in enumerate(PRIORITIES))
    + " FROM pay GROUP BY 1"), dates="created_date")
def _(t):
    p = t.payments().groupBy("created_date").pivot("priority", PRIORITIES).agg(sum_money("amount"))
    return p.toDF("created_date", *[f"gmv_{i}" for i in range(len(PRIORITIES))])


@query("a10_pivot_many", sql("cf", """
SELECT merchant_id, aov, CAST(sum(open) FILTER (period='Prev') AS BIGINT) AS open_prev, CAST(sum(paid) FILTER (period='Prev') AS BIGINT) AS paid_prev,
  CAST(sum(open) FILTER (period='Post') AS BIGINT) AS open_post, CAST(sum(paid) FILTER (period='Post') AS BIGINT) AS paid_post FROM cf GROUP BY 1, 2"""))
def _(t):
    p = pivot_sum(t.checkouts(), ["merchant_id", "aov"], "period", ["Prev", "Post"], {"open": F.sum("open"), "paid": F.sum("paid")})
    return p.toDF("merchant_id", "aov", "open_prev", "paid_prev", "open_post", "paid_post")


@query("a11_stack_unstack", sql("cf", """
g AS (SELECT arm, CAST(sum(open) AS BIGINT) AS open, CAST(sum(submit) AS BIGINT) AS submit, CAST(sum(paid) AS BIGINT) AS paid FROM cf GROUP BY 1),
l AS (UNPIVOT g ON open, submit, paid INTO NAME measure VALUE v)
SELECT measure, max(v) FILTER (arm = 'v1') AS v1, max(v) FILTER (arm = 'v2') AS v2 FROM l GROUP BY 1"""))
def _(t):
    g = t.checkouts().groupBy("arm").agg(*[F.sum(c).alias(c) for c in ["open", "submit", "paid"]])
    return g.unpivot(["arm"], ["open", "submit", "paid"], "measure", "v").groupBy("measure").pivot("arm", ["v1", "v2"]).agg(F.max("v"))


@query("a12_total_row", sql("pay mer", """
SELECT CASE WHEN grouping(segment) = 1 THEN 'Total' ELSE segment END AS segment, period, count(DISTINCT merchant_id) AS merchants, count(*) AS n
FROM pay JOIN mer USING (merchant_id) GROUP BY GROUPING SETS ((segment, period), (period))"""))
def _(t):
    p = t.payments().groupBy("merchant_id", "period").agg(F.count("*").alias("n"))
    d = p.join(t.merchants().select("merchant_id", "segment"), "merchant_id")
    return with_total_row(d, ["segment", "period"], {"merchants": F.countDistinct("merchant_id"), "n": F.sum("n")})


@query("a13_share_of_total", """
g AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT *, round(n::DOUBLE / (SELECT sum(n) FROM g), 6) AS share FROM g""".replace("g AS", "WITH g AS", 1))
def _(t):
    g = t.raw("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return with_report_totals(g, [], {"total": F.sum("n")}).select("o_orderstatus", "n", rounded(ratio("n", "total")).alias("share"))


@query("a14_normalised_rows", sql("pay", """
g AS (SELECT priority, status, count(*) AS n FROM pay GROUP BY 1, 2)
SELECT priority, status, round(n::DOUBLE / sum(n) OVER (PARTITION BY priority), 6) AS row_share,
  round(n::DOUBLE / sum(n) OVER (PARTITION BY status), 6) AS col_share FROM g"""))
def _(t):
    g = t.payments().groupBy("priority", "status").agg(F.count("*").alias("n"))
    g = with_report_totals(g, ["priority"], {"r": F.sum("n")})
    g = with_report_totals(g, ["status"], {"c": F.sum("n")})
    return g.select("priority", "status", rounded(ratio("n", "r")).alias("row_share"), rounded(ratio("n", "c")).alias("col_share"))


@query("a15_safe_ratio", sql("cf", """
SELECT checkout_id, round(paid / nullif(open, 0), 6) AS cr, round(CAST(gmv AS DOUBLE) / nullif(paid, 0), 6) AS gmv_per_paid FROM cf"""))
def _(t):
    return t.checkouts().select("checkout_id", rounded(ratio("paid", "open")).alias("cr"), rounded(ratio("gmv", "paid")).alias("gmv_per_paid"))


@query("a16_exact_percentiles", f"SELECT event_type, {PCT_SQL.format(c='value')} FROM events GROUP BY 1")
def _(t):
    return exact_quantiles(t.raw("events"), ["event_type"], "value", PCTS).select("event_type", *pct_cols())


@query("a17_approx_percentile", sql("ev", "SELECT merchant_id, quantile_disc(k, 0.5) AS p50, quantile_disc(k, 0.9) AS p90 FROM ev GROUP BY 1"))
def _(t):
    p = F.percentile_approx("k", [0.5, 0.9], 10_000)
    return t.events().groupBy("merchant_id").agg(p.alias("p")).select("merchant_id", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"))


@query("a18_describe", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {PCT_SQL.format(c=c)} FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount"]) + ")")
def _(t):
    d = stats.describe(t.raw("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], PCTS)
    return d.select("measure", "n", rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"), "min", "max", *pct_cols())


@query("a19_contingency", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus='F') AS f, count(*) FILTER (o_orderstatus='O') AS o,
  count(*) FILTER (o_orderstatus='P') AS p FROM orders GROUP BY 1""")
def _(t):
    return t.raw("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).toDF(
        "o_orderpriority", "f", "o", "p")


@query("a20_string_list", sql("ev", """
SELECT checkout_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM ev GROUP BY 1"""))
def _(t):
    # a set of event kinds is bounded by the kinds, not by the checkout's events
    return t.events().groupBy("checkout_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("a21_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def _(t):
    return t.raw("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


@query("a22_pearson", sql("ev", """
SELECT merchant_id, round(corr(k, value), 6) AS corr FROM ev GROUP BY 1"""))
def _(t):
    return t.events().groupBy("merchant_id").agg(rounded(stats.pearson("k", "value")).alias("corr"))


@query("a22_pearson_matrix", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in ["l_quantity", "l_extendedprice", "l_tax"] for b in ["l_quantity", "l_extendedprice", "l_tax"]) + ")")
def _(t):
    m = stats.correlation_matrix(t.raw("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return m.withColumn("corr", rounded("corr"))


@query("a23_slope", sql("ev", """
g AS (SELECT merchant_id, dt, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT merchant_id, round(regr_slope(n, date_diff('day', DATE '2024-01-01', dt)), 6) AS slope FROM g GROUP BY 1"""))
def _(t):
    g = t.events().groupBy("merchant_id", "dt").agg(F.count("*").alias("n"))
    return g.groupBy("merchant_id").agg(rounded(stats.slope("n", F.datediff("dt", F.lit("2024-01-01")))).alias("slope"))


CHI_SQL = """
c AS (SELECT {by} AS g, {x} AS x, {y} AS y, count(*) AS n FROM {src} GROUP BY ALL),
d AS (SELECT *, sum(n) OVER (PARTITION BY g, x) AS r, sum(n) OVER (PARTITION BY g, y) AS k FROM c),
e AS (SELECT g, CAST(sum(n) AS BIGINT) AS n, sum(n::DOUBLE * n / (r * k)) AS s, least(count(DISTINCT x), count(DISTINCT y)) - 1 AS v FROM d GROUP BY 1)
SELECT g AS {name}, n, round(CASE WHEN v > 0 THEN n * greatest(s - 1, 0) END, 4) AS chi2,
  round(sqrt(CASE WHEN v > 0 THEN greatest(s - 1, 0) / v END), 6) AS cramers_v FROM e"""


@query("a24_chi_square", sql("ev", CHI_SQL.format(by="merchant_id", x="k % 4", y="event_type", src="ev", name="merchant_id")))
def _(t):
    d = stats.chi_square(t.events().withColumn("x", F.col("k") % 4), ["merchant_id"], "x", "event_type")
    return d.select("merchant_id", "n", rounded("chi2", 4).alias("chi2"), rounded("cramers_v").alias("cramers_v"))


@query("a25_product", """
SELECT l_orderkey, round(product(1 - l_discount) + 1e-12, 8) AS kept FROM lineitem GROUP BY 1""")
def _(t):
    return t.raw("lineitem").groupBy("l_orderkey").agg(rounded(F.product(1 - F.col("l_discount")) + 1e-12, 8).alias("kept"))


@query("a26_all_subsets", sql("cf", """
SELECT arm, CAST(platform AS BIGINT) AS platform, aov, CAST(grouping(arm) * 4 + grouping(platform) * 2 + grouping(aov) AS BIGINT) AS subset,
  count(*) AS checkouts, CAST(sum(paid) AS BIGINT) AS paid FROM cf GROUP BY CUBE (arm, platform, aov)"""))
def _(t):
    # additive measures: the cube multiplies the few leaf rows, not the checkouts
    leaf = t.checkouts().groupBy("arm", "platform", "aov").agg(F.count("*").alias("n"), F.sum("paid").alias("p"))
    return leaf.cube("arm", "platform", "aov").agg(
        F.grouping_id().alias("subset"), F.sum("n").alias("checkouts"), F.sum("p").alias("paid"))


@query("a27_frequency", """
f AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1)
SELECT orders, count(*) AS customers FROM f GROUP BY 1""".replace("f AS", "WITH f AS", 1))
def _(t):
    f = t.raw("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return f.groupBy("orders").agg(F.count("*").alias("customers"))


@query("a28_histogram", sql("ev", """
SELECT event_type, CAST(CASE WHEN k < 10 THEN 0 WHEN k >= 90 THEN 9 ELSE floor((k - 10) / 10) + 1 END AS BIGINT) AS bin, count(*) AS n
FROM ev GROUP BY 1, 2"""))
def _(t):
    return stats.histogram(t.events(), ["event_type"], "k", 10, 90, 8)


@query("a29_nonnull_count", """
SELECT lang, count(*) AS n, count(quality) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def _(t):
    return t.raw("documents").join(t.raw("labels"), "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n"), F.count("quality").alias("labelled"))


@query("a30_first_record", sql("ev", """
SELECT checkout_id, arg_min(event_id, ts) AS event_id, arg_min(event_type, ts) AS event_type FROM ev GROUP BY 1"""))
def _(t):
    return latest_per_key(t.events(), ["checkout_id"], ["ts", "event_id"], ["event_id", "event_type"], earliest=True)
