from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import ratio, rounded, sum_money
from ..functions.grouped import exact_quantiles, exact_rank, latest_per_key, top_n, top_n_with_rest, with_report_totals, with_totals
from ..functions.scan import time_chunk, with_ordinal, with_previous, with_running_sum
from ..operators import lookup, stats
from .registry import query
from .views import sql

# Windows below run either over (key, time chunk), see functions/scan.py, or over
# tables already aggregated to one row per key and calendar day.
CHUNK_S = 300


@query("w01_latest_per_key", sql("ev", """
SELECT checkout_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY checkout_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1"""))
def _(t):
    return latest_per_key(t.events(), ["checkout_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query("w02_gap_to_previous", sql("gaps", """
SELECT event_id, CASE WHEN device_id IS NOT NULL THEN round((epoch_us(ts) - epoch_us(lead(ts) OVER (PARTITION BY device_id, ts IS NULL ORDER BY ts DESC, event_id DESC))) / 1000000, 3) END AS gap FROM gaps"""))
def _(t):
    d = with_previous(t.gappy_events().select("device_id", "ts", "event_id"), ["device_id"], ["ts", "event_id"], {"prev_ts": "ts"},
                      time_chunk("ts", CHUNK_S))
    return d.select("event_id", rounded(lookup.seconds_between("prev_ts", "ts"), 3).alias("gap"))


@query("w03_previous_label", sql("gaps", """
p AS (SELECT event_id, event_type, k, CASE WHEN device_id IS NOT NULL AND ts IS NOT NULL THEN lag(event_type) OVER w END AS prev, lag(k) OVER w AS pk FROM gaps
  WINDOW w AS (PARTITION BY device_id, ts IS NULL ORDER BY ts, event_id))
SELECT event_id, CASE WHEN prev <> event_type THEN prev END AS from_type, CASE WHEN prev <> event_type THEN pk END AS from_k FROM p"""))
def _(t):
    d = with_previous(t.gappy_events().select("device_id", "ts", "event_id", "event_type", "k"), ["device_id"], ["ts", "event_id"],
                      {"prev": "event_type", "pk": "k"}, time_chunk("ts", CHUNK_S))
    changed = F.col("prev") != F.col("event_type")
    return d.select("event_id", F.when(changed, F.col("prev")).alias("from_type"), F.when(changed, F.col("pk")).alias("from_k"))


@query("w04_running_flag_sum", sql("gaps", """
SELECT event_id, CASE WHEN merchant_id IS NOT NULL AND ts IS NOT NULL THEN CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (
  PARTITION BY merchant_id, ts IS NULL ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS block_no FROM gaps"""))
def _(t):
    d = with_running_sum(t.gappy_events().select("merchant_id", "ts", "event_id", "event_type"), ["merchant_id"], ["ts", "event_id"],
                         {"block_no": F.when(F.col("event_type") == "signup", 1).otherwise(0)}, time_chunk("ts", CHUNK_S))
    return d.select("event_id", "block_no")


@query("w05_lag_in_message", """
WITH l AS (SELECT * REPLACE (CASE WHEN l_partkey % 13 <> 0 THEN l_shipdate END AS l_shipdate, CASE WHEN l_suppkey % 11 <> 0 THEN l_orderkey END AS l_orderkey) FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey IS NOT NULL THEN date_diff('day', lag(l_shipdate) OVER (
  PARTITION BY l_orderkey, l_shipdate IS NULL ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey), l_shipdate) END AS days FROM l""")
def _(t):
    l = t.raw("lineitem").select(  # noqa: E741
        F.when(F.col("l_suppkey") % 11 != 0, F.col("l_orderkey")).alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_shipdate")).alias("l_shipdate"))
    d = with_previous(l, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], {"prev": "l_shipdate"},
                      time_chunk("l_shipdate", 86400))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.datediff("l_shipdate", "prev").cast("bigint").alias("days"))


@query("w06_partition_percentile", sql("ev", """
SELECT merchant_id, dt, round(quantile_cont(value, 0.5), 6) AS p50, round(any_value(dp50), 6) AS day_p50 FROM
  (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY dt) AS dp50 FROM ev) GROUP BY 1, 2"""), dates="dt")
def _(t):
    e = t.events().select("merchant_id", "dt", "value")
    a = exact_quantiles(e, ["merchant_id", "dt"], "value", {"p50": 0.5})
    b = exact_quantiles(e, ["dt"], "value", {"day_p50": 0.5})
    return a.join(b, "dt").select("merchant_id", "dt", rounded("p50").alias("p50"), rounded("day_p50").alias("day_p50"))


@query("w07_rank", sql("gaps", """
SELECT event_id, CASE WHEN merchant_id IS NOT NULL AND k IS NOT NULL THEN rank() OVER (PARTITION BY merchant_id, k IS NULL ORDER BY k) END AS up,
  CASE WHEN merchant_id IS NOT NULL AND k IS NOT NULL THEN rank() OVER (PARTITION BY merchant_id, k IS NULL ORDER BY k DESC) END AS down FROM gaps"""))
def _(t):
    return exact_rank(t.gappy_events().select("event_id", "merchant_id", "k"), ["merchant_id"], "k", "up", "down").select("event_id", "up", "down")


@query("w08_first_contact", sql("ev", "SELECT event_id, min(dt) OVER (PARTITION BY device_id) AS first_date FROM ev"), dates="first_date")
def _(t):
    return with_totals(t.events().select("event_id", "device_id", "dt"), ["device_id"], {"first_date": F.min("dt")}).select(
        "event_id", "first_date")


@query("w09_unique_mapping", sql("pay", """
SELECT payment_id, merchant_id FROM (SELECT *, count(*) OVER (PARTITION BY merchant_id, created_date) AS n FROM pay) WHERE n = 1"""))
def _(t):
    p = t.payments().select("payment_id", "merchant_id", "created_date")
    return with_totals(p, ["merchant_id", "created_date"], {"n": F.count("*")}).filter("n = 1").select("payment_id", "merchant_id")


def daily(t):
    return t.events().groupBy("merchant_id", "dt").agg(F.count("*").alias("n"))


def by_day():
    """At most one row per calendar day in each group."""
    return Window.partitionBy("merchant_id").orderBy("dt")


DAILY = "g AS (SELECT merchant_id, dt, count(*) AS n FROM ev GROUP BY 1, 2)"


@query("w10_cumulative_sum", sql("ev", DAILY + """
SELECT merchant_id, dt, CAST(sum(n) OVER (PARTITION BY merchant_id ORDER BY dt) AS BIGINT) AS running FROM g"""), dates="dt")
def _(t):
    return daily(t).select("merchant_id", "dt", F.sum("n").over(by_day().rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


@query("w11_rows_to_threshold", sql("pay", """
g AS (SELECT period, merchant_id, sum(amount) AS gmv FROM pay GROUP BY 1, 2),
c AS (SELECT *, sum(gmv) OVER (PARTITION BY period ORDER BY gmv DESC ROWS UNBOUNDED PRECEDING) AS run, sum(gmv) OVER (PARTITION BY period) AS total FROM g)
SELECT period, count(*) FILTER (run <= total * 0.8) AS rows_needed, count(*) AS rows_total FROM c GROUP BY 1"""))
def _(t):
    g = t.payments().groupBy("period", "merchant_id").agg(F.sum("amount").alias("gmv"))
    return stats.rows_to_reach(g, ["period"], "gmv", 0.8)


@query("w12_rolling_mean", sql("ev", DAILY + """
SELECT merchant_id, dt, round(avg(n) OVER (PARTITION BY merchant_id ORDER BY dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean4 FROM g"""), dates="dt")
def _(t):
    return daily(t).select("merchant_id", "dt", rounded(F.avg("n").over(by_day().rowsBetween(-3, 0))).alias("mean4"))


@query("w13_difference", sql("ev", DAILY + """
SELECT merchant_id, dt, n - lag(n) OVER (PARTITION BY merchant_id ORDER BY dt) AS diff FROM g"""), dates="dt")
def _(t):
    return daily(t).select("merchant_id", "dt", (F.col("n") - F.lag("n").over(by_day())).alias("diff"))


@query("w14_percent_change", sql("ev", DAILY + """
SELECT merchant_id, dt, round(n / CAST(lag(n) OVER (PARTITION BY merchant_id ORDER BY dt) AS DOUBLE) - 1, 6) AS pct FROM g"""), dates="dt")
def _(t):
    return daily(t).select("merchant_id", "dt", rounded(ratio("n", F.lag("n").over(by_day())) - 1).alias("pct"))


@query("w15_ordinal", sql("gaps", """
SELECT event_id, CASE WHEN merchant_id IS NOT NULL AND ts IS NOT NULL THEN row_number() OVER (PARTITION BY merchant_id, ts IS NULL ORDER BY ts, event_id) END AS ordinal FROM gaps"""))
def _(t):
    return with_ordinal(t.gappy_events().select("merchant_id", "ts", "event_id"), ["merchant_id"], ["ts", "event_id"], "ordinal",
                        time_chunk("ts", CHUNK_S)).select("event_id", "ordinal")


@query("w16_days_since_first", sql("ev", DAILY + """
SELECT merchant_id, dt, date_diff('day', min(dt) OVER (PARTITION BY merchant_id), dt) AS day_no FROM g"""), dates="dt")
def _(t):
    d = with_report_totals(daily(t), ["merchant_id"], {"first": F.min("dt")})
    return d.select("merchant_id", "dt", F.datediff("dt", "first").cast("bigint").alias("day_no"))


@query("w17_top_n_per_period", sql("pay", """
g AS (SELECT date_trunc('month', created_date)::DATE AS month, merchant_id, CAST(sum(amount) AS DOUBLE) AS gmv FROM pay GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY gmv DESC, merchant_id) AS rank FROM g) WHERE rank <= 5"""), dates="month")
def _(t):
    g = t.payments().groupBy(F.trunc("created_date", "month").alias("month"), "merchant_id").agg(sum_money("amount").alias("gmv"))
    return top_n(g, ["month"], [F.col("gmv").desc(), F.col("merchant_id")], 5)


@query("w18_ratio_to_first", sql("ev", DAILY + """
SELECT merchant_id, dt, round(n / first_value(n::DOUBLE) OVER (PARTITION BY merchant_id ORDER BY dt), 6) AS to_first,
  round(n / max(n::DOUBLE) OVER (PARTITION BY merchant_id), 6) AS to_max FROM g"""), dates="dt")
def _(t):
    d = with_report_totals(daily(t), ["merchant_id"], {"f": F.min_by("n", "dt"), "m": F.max("n")})
    return d.select("merchant_id", "dt", rounded(ratio("n", "f")).alias("to_first"), rounded(ratio("n", "m")).alias("to_max"))


@query("o01_multi_key_sort", sql("pay", """
SELECT payment_id, method, CAST(amount AS DOUBLE) AS amount FROM pay ORDER BY method, abs(amount - 200000) DESC, payment_id"""))
def _(t):
    return t.payments().select("payment_id", "method", F.col("amount").cast("double").alias("amount")).orderBy(
        "method", F.abs(F.col("amount") - 200000).desc(), "payment_id")


@query("o02_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.raw("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("o03_top_n_others", sql("pay", """
g AS (SELECT CAST(merchant_id AS VARCHAR) AS merchant, count(*) AS n, sum(amount) AS gmv FROM pay GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY gmv DESC, merchant) AS rank FROM g)
SELECT CASE WHEN rank <= 10 THEN merchant ELSE 'Others' END AS merchant, CAST(sum(n) AS BIGINT) AS n, CAST(sum(gmv) AS DOUBLE) AS gmv FROM r GROUP BY 1"""))
def _(t):
    g = t.payments().groupBy(F.col("merchant_id").cast("string").alias("merchant")).agg(
        F.count("*").alias("n"), F.sum("amount").alias("gmv"))
    return top_n_with_rest(g, "merchant", [F.col("gmv").desc(), F.col("merchant")], 10, ["n", "gmv"])


@query("u01_union_all", """
SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def _(t):
    c = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(t.raw("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


def key_sets(t):
    p = t.payments()
    keys = lambda per: p.filter((F.col("period") == per) & (F.col("method") == "cod")).select("merchant_id").distinct()
    return keys("Prev"), keys("Post")


SETS = """a AS (SELECT DISTINCT merchant_id FROM pay WHERE period = 'Prev' AND method = 'cod'),
b AS (SELECT DISTINCT merchant_id FROM pay WHERE period = 'Post' AND method = 'cod')"""


@query("u02_union_distinct", sql("pay", SETS + " SELECT merchant_id FROM a UNION SELECT merchant_id FROM b"))
def _(t):
    a, b = key_sets(t)
    return a.union(b).distinct()


@query("u03_intersect", sql("pay", SETS + " SELECT merchant_id FROM a INTERSECT SELECT merchant_id FROM b"))
def _(t):
    a, b = key_sets(t)
    return a.intersect(b)


@query("u04_except", sql("pay", SETS + """
 SELECT 'left' AS side, merchant_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
 UNION ALL SELECT 'right', merchant_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""))
def _(t):
    a, b = key_sets(t)
    tag = lambda s, d: d.select(F.lit(s).alias("side"), "merchant_id")
    return tag("left", a.subtract(b)).unionByName(tag("right", b.subtract(a)))
