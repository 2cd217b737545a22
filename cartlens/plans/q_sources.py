import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions.expr import sum_money
from ..functions.periods import in_ranges
from ..session import scratch_dir
from ..sources import io
from .registry import query
from .views import sql


def table_name():
    return "t_" + uuid.uuid4().hex


@query("s01_catalog_scan", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    io.publish_view(t.raw("orders"), "s01_orders")
    return io.read_table(t.spark, "s01_orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("s02_event_scan", sql("ev", """
SELECT event_id, checkout_id, k FROM ev
WHERE dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' AND event_type = 'purchase'"""))
def _(t):
    # events carry a timestamp, not a date partition: bounds go on the raw column
    e = t.events().filter((F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-08"))
    d = io.scan_events(e, "dt", dt.date(2024, 1, 5), dt.date(2024, 1, 7), "purchase", "event_type")
    return d.select("event_id", "checkout_id", "k")


@query("s03_parquet_read", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    return io.read_table(t.spark, f"{t.dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")


@query("s04_csv_roundtrip", "SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer")
def _(t):
    path = scratch_dir(t.spark, "csv")
    io.write_csv(t.raw("customer").drop("c_nationkey"), path, sep=";")
    return io.read_csv(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string", ";")


@query("s06_ragged_sheet", "SELECT p_partkey AS part_id, p_brand AS brand, p_retailprice * 1000 AS price_inr FROM part")
def _(t):
    path = scratch_dir(t.spark, "sheet")
    p = t.raw("part").select(
        F.col("p_partkey").cast("string").alias("a"), F.col("p_brand").alias("b"),
        F.format_number(F.col("p_retailprice") * 1000, 2).alias("c"), F.lit("x").alias("d"))
    head = t.spark.createDataFrame([("Price list", None, None, None), ("Part ID", "Brand!", "Price (INR)", "Notes")],
                                   "a string, b string, c string, d string")
    # an exported sheet: a title line, the header line, then the data
    head.coalesce(1).write.option("sep", ";").csv(f"{path}/0_head")
    p.write.option("sep", ";").csv(f"{path}/1_data")
    out = io.clean_sheet(io.read_lines(t.spark, f"{path}/*", 4, sep=";"), 1, drop=["notes"], numbers=["price_inr"])
    return out.withColumn("part_id", F.col("part_id").cast("bigint"))


@query("s07_json_document", """
SELECT CAST(event_id AS VARCHAR) AS key, event_type AS type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(t):
    e = t.events().select(F.to_json(F.create_map(
        F.col("event_id").cast("string"), F.struct(F.col("event_type").alias("type"), "k"))).alias("doc"))
    return io.json_map_rows(e, "doc", "type: string, k: bigint")


@query("s08_partitioned_append", sql("ev", "SELECT dt, event_type, count(*) AS n FROM ev GROUP BY 1, 2"), dates="dt")
def _(t):
    path = scratch_dir(t.spark, "append")
    e = t.events().select("dt", "event_type", "event_id")
    early = F.col("dt") <= F.lit(dt.date(2024, 1, 15))
    io.append_partitioned(e.filter(early), path, "dt")
    io.append_partitioned(e.filter(~early), path, "dt")
    return t.spark.read.parquet(path).groupBy("dt", "event_type").agg(F.count("*").alias("n"))


def _fact_table(t, extra=""):
    name = table_name()
    io.create_partitioned_table(
        t.spark, name, f"checkout_id string, open int, paid int{extra}, dt date", "dt", scratch_dir(t.spark, "table"))
    return name


@query("s09_create_partitioned", sql("cf", "SELECT dt, sum(open)::BIGINT AS opens FROM cf GROUP BY 1"), dates="dt")
def _(t):
    name = _fact_table(t)
    io.insert_select(t.checkouts(), name)
    return t.spark.table(name).groupBy("dt").agg(F.sum("open").alias("opens"))


def event_store(t, columns, buckets=8):
    """The events by day and source, in buckets by checkout; the source is that of the raw events."""
    name = table_name()
    e = t.events().select(*columns, F.when(F.col("k") < 95, "checkoutjs").otherwise("server").alias("source"))
    io.write_event_store(e, name, scratch_dir(t.spark, "events"), "dt", "source", "checkout_id", buckets)
    return t.spark.table(name)


@query("s02_stored_events", sql("ev", """
SELECT dt, count(*) AS n, count(DISTINCT checkout_id) AS checkouts FROM ev WHERE dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND k < 95 GROUP BY 1"""), dates="dt")
def _(t):
    e = io.scan_events(event_store(t, ["checkout_id", "event_id", "dt"]), "dt", dt.date(2024, 1, 5), dt.date(2024, 1, 20), "checkoutjs")
    per = e.groupBy("checkout_id", "dt").agg(F.count("*").alias("n"))           # by bucket, without a shuffle of events
    return per.groupBy("dt").agg(F.sum("n").alias("n"), F.count("*").alias("checkouts"))


@query("s10_insert_select", sql("cf", "SELECT checkout_id, open, paid, dt FROM cf"), dates="dt")
def _(t):
    name = _fact_table(t)
    cut = F.col("dt") <= F.lit(dt.date(2024, 1, 20))
    io.insert_select(t.checkouts().filter(cut), name)
    io.insert_select(t.checkouts().filter(~cut), name)
    return t.spark.table(name)


@query("s11_backup_rebuild", sql("ev", """
SELECT dt, count(*) AS n, count(DISTINCT checkout_id) AS checkouts FROM ev GROUP BY 1"""), dates="dt")
def _(t):
    e = t.events().select("event_id", "checkout_id", "dt")
    last = F.lit(dt.date(2024, 1, 30))
    history = e.filter(F.col("dt") < last)
    stale_today = e.filter((F.col("dt") == last) & (F.col("event_id") % 2 == 0))   # yesterday's partial run
    name, path = table_name(), scratch_dir(t.spark, "rebuild")
    history.unionByName(stale_today).write.option("path", f"{path}/first").saveAsTable(name)
    for _ in range(2):                                                               # every day again, on the same location
        out = io.rebuild_with_today(t.spark, name, e.filter(F.col("dt") == last), "dt", path)
    return out.groupBy("dt").agg(F.count("*").alias("n"), F.countDistinct("checkout_id").alias("checkouts"))


@query("s12_add_columns", sql("cf", """
SELECT checkout_id, open, paid, CASE WHEN dt > DATE '2024-01-15' THEN submit END AS submit,
  CASE WHEN dt > DATE '2024-01-15' THEN failed END AS failed, dt FROM cf"""), dates="dt")
def _(t):
    name = _fact_table(t)
    early = F.col("dt") <= F.lit(dt.date(2024, 1, 15))
    io.insert_select(t.checkouts().filter(early), name)
    io.add_int_columns(t.spark, name, ["submit", "failed", "open"])
    io.insert_select(t.checkouts().filter(~early), name)
    return t.spark.table(name)


@query("s13_delete_keys", sql("cf", "SELECT checkout_id, dt FROM cf WHERE failed = 0"), dates="dt")
def _(t):
    c = t.checkouts()
    return io.without_keys(c, c.filter("failed = 1"), "checkout_id").select("checkout_id", "dt")


@query("s14_temp_view", "SELECT r_name, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def _(t):
    io.publish_view(t.raw("region"), "s14_region")
    io.publish_view(t.raw("nation"), "s14_nation")
    t.spark.catalog.refreshTable("s14_nation")
    return t.spark.sql("SELECT r_name, count(*) AS nations FROM s14_region JOIN s14_nation "
                       "ON r_regionkey = n_regionkey GROUP BY r_name")


@query("s15_backfill", sql("ev", """
SELECT dt, event_type, count(*) AS n FROM ev WHERE dt BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY 1, 2"""), dates="dt")
def _(t):
    path = scratch_dir(t.spark, "backfill")
    daily = lambda d: d.groupBy("dt", "event_type").agg(F.count("*").alias("n"))
    span = (dt.date(2024, 1, 3), dt.date(2024, 1, 28))
    io.backfill(t.events(), "dt", *span, daily, path, "dt")
    io.backfill(t.events(), "dt", dt.date(2024, 1, 10), span[1], daily, path, "dt")   # a re-run replaces, not doubles
    return t.spark.read.parquet(path)


@query("s16_date_ranges", sql("ev", """
SELECT dt, count(*) AS n FROM ev WHERE dt BETWEEN DATE '2024-01-02' AND DATE '2024-01-04'
  OR dt BETWEEN DATE '2024-01-20' AND DATE '2024-01-22' GROUP BY 1"""), dates="dt")
def _(t):
    ranges = [(dt.date(2024, 1, 2), dt.date(2024, 1, 4)), (dt.date(2024, 1, 20), dt.date(2024, 1, 22))]
    return t.events().filter(in_ranges("dt", ranges)).groupBy("dt").agg(F.count("*").alias("n"))


@query("s17_labelled_snapshot", sql("pay", """
SELECT method, period AS run, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS gmv FROM pay GROUP BY 1, 2"""))
def _(t):
    run = lambda p: t.payments().filter(F.col("period") == p).groupBy("method").agg(
        F.count("*").alias("n"), sum_money("amount").alias("gmv"))
    history = io.label_run(run("Prev"), "Prev", "run")
    once = io.append_run(history, run("Post"), "Post", "run")
    return io.append_run(once, run("Post"), "Post", "run")


@query("s18_only_unpublished", sql("ev", """
SELECT dt, merchant_id, count(*) AS n FROM ev WHERE dt > DATE '2024-01-15' OR merchant_id >= 5 GROUP BY 1, 2"""), dates="dt")
def _(t):
    daily = t.events().groupBy("dt", "merchant_id").agg(F.count("*").alias("n"))
    published = daily.filter((F.col("dt") <= F.lit(dt.date(2024, 1, 15))) & (F.col("merchant_id") < 5))
    return io.only_new(daily, published, ["dt", "merchant_id"])
