"""Logical checkout entities bound to the generated tables.

Each entity is a thin lazy view; the SQL twins below define the same rows for
the oracle. ``sql(body, names)`` puts the needed views before a query body.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import flag, money, open_bands
from ..functions.grouped import latest_per_key

EVENTS_CUT = dt.date(2024, 1, 15)     # Prev up to and including this day
ORDERS_CUT = dt.date(1998, 7, 1)      # Prev before this day
AS_OF = dt.date(2024, 1, 31)          # day after the last event
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STEPS = {"signup": "1_open", "view": "2_render", "click": "3_submit", "purchase": "4_paid"}
AOV_CUTS = [20.0, 50.0, 100.0, 200.0]
AOV_LABELS = ["a_lt_20", "b_20_50", "c_50_100", "d_100_200", "e_200_up"]
MODEL_CODES = ["category_5399", "category_5691", "category_5977", "category_infrequent_mcc_group", "acm",
               "merchant_own", "unlisted"]


def arm_of(device: str) -> Column:
    u = F.col(device)
    return F.when((u % 10 == 9) | (F.floor(u / 10) % 2 == 0), "v1").otherwise("v2")


def period_of(day: Column | str) -> Column:
    return F.when((F.col(day) if isinstance(day, str) else day) <= F.lit(EVENTS_CUT), "Prev").otherwise("Post")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- client events -------------------------------------------------
    def events(self) -> DataFrame:
        u = F.col("user_id")
        merchant = u % 10
        day = F.to_date("ts")
        return self.raw("events").select(
            "event_id", "ts", day.alias("dt"), merchant.alias("merchant_id"), u.alias("device_id"),
            F.concat(u.cast("string"), F.lit("-"), day.cast("string")).alias("checkout_id"),
            "event_type", "value",
            F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
            arm_of("user_id").alias("arm"),
            period_of(day).alias("period"),
        )

    def gappy_events(self) -> DataFrame:
        """Events in which ids, times and numbers are missing here and there, as in real click-streams."""
        gap = lambda c, n: F.when(F.col("event_id") % n != 0, F.col(c)).alias(c)
        holes = {"device_id": 17, "merchant_id": 19, "ts": 23, "checkout_id": 29, "k": 13}
        return self.events().select(*[gap(c, holes[c]) if c in holes else c for c in self.events().columns])

    def checkouts(self) -> DataFrame:
        """One row per checkout: funnel flags and attributes."""
        t = F.col("event_type")
        # Grouped by the key alone (its attributes are constant): joins and
        # groupings on checkout_id then need no second shuffle.
        # Arm and period follow from device and day; as texts they would turn the
        # aggregate into a sort.
        same = ["merchant_id", "device_id", "dt"]
        fact = self.events().groupBy("checkout_id").agg(
            *[F.min(c).alias(c) for c in same],
            F.max(flag(t == "signup")).alias("open"),
            F.max(flag(t == "view")).alias("render"),
            F.max(flag(t == "click")).alias("submit"),
            F.max(flag(t == "purchase")).alias("paid"),
            F.max(flag(t == "error")).alias("failed"),
            F.max("k").alias("max_k"),
            F.min("k").alias("min_k"),
            F.count("*").alias("n_events"),
            F.sum(money("value")).alias("gmv"),
        )
        return fact.select(
            "*", arm_of("device_id").alias("arm"), period_of("dt").alias("period"),
            (F.col("max_k") < 50).alias("eligible"),
            (F.col("max_k") % 3).alias("platform"),
            (F.col("min_k") % 4).alias("browser"),
            ((F.col("max_k") + F.col("min_k")) % 3).alias("os"),
            open_bands("gmv", AOV_CUTS, AOV_LABELS).alias("aov"),
        )

    # -- payments ------------------------------------------------------
    def payments(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("payment_id"), F.col("o_custkey").alias("merchant_id"),
            money("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("success"),
            F.when(F.col("o_orderpriority") == "5-LOW", "cod").otherwise("prepaid").alias("method"),
            day.alias("created_date"),
            F.when(day < F.lit(ORDERS_CUT), "Prev").otherwise("Post").alias("period"),
        )

    def merchants(self) -> DataFrame:
        nation = self.raw("nation")
        return self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("merchant_id"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").alias("tier"),
            F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"))

    # -- shipments and risk ----------------------------------------------
    def shipments(self) -> DataFrame:
        """All shipment rows of the orders (several per order)."""
        s = F.col("l_returnflag")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier_id"),
            F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("line"),
            F.to_date("l_shipdate").alias("ship_date"),
            F.when(s == "R", "rto").when(s == "A", "delivered").otherwise("pending").alias("status"),
            (money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)").alias("charge"),
            money("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))

    def latest_shipments(self, *cols: str) -> DataFrame:
        """Columns ``cols`` of each order's latest shipment; no other column is sorted or moved."""
        return latest_per_key(self.shipments(), ["order_id"], ["ship_date", "line", "part_id", "supplier_id"], cols)

    def risk_scores(self) -> DataFrame:
        """Score events per order: two flags, either may be missing."""
        lost = F.col("l_tax").cast("decimal(4,2)")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.to_date("l_shipdate").alias("scored_date"),
            F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.when(lost == 0, F.lit(None)).when(F.col("l_quantity") <= 35, "green").otherwise("red").alias("ml_flag"),
            F.when(lost == F.lit("0.08").cast("decimal(4,2)"), F.lit(None))
            .when(F.col("l_discount").cast("decimal(4,2)") <= F.lit("0.07").cast("decimal(4,2)"), "green")
            .otherwise("red").alias("rule_flag"),
            F.element_at(F.array(*[F.lit(m) for m in MODEL_CODES]), (F.col("l_suppkey") % 7 + 1).cast("int"))
            .alias("model_code"),
            (F.col("l_partkey") % 5 == 0).alias("experimentation"))


# SQL twins ---------------------------------------------------------------
_EV = """ev AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS dt, user_id % 10 AS merchant_id, user_id AS device_id,
    CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS checkout_id,
    event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE WHEN user_id % 10 = 9 OR (user_id // 10) % 2 = 0 THEN 'v1' ELSE 'v2' END AS arm,
    CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-15' THEN 'Prev' ELSE 'Post' END AS period
  FROM events)"""
_GAPS = """gaps AS (
  SELECT * REPLACE (CASE WHEN event_id % 17 <> 0 THEN device_id END AS device_id, CASE WHEN event_id % 19 <> 0 THEN merchant_id END AS merchant_id,
    CASE WHEN event_id % 23 <> 0 THEN ts END AS ts, CASE WHEN event_id % 29 <> 0 THEN checkout_id END AS checkout_id, CASE WHEN event_id % 13 <> 0 THEN k END AS k) FROM ev)"""
_CF = """cf0 AS (
  SELECT checkout_id, merchant_id, device_id, arm, period, dt,
    CAST(max(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) AS BIGINT) AS open,
    CAST(max(CASE WHEN event_type='view' THEN 1 ELSE 0 END) AS BIGINT) AS render,
    CAST(max(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS BIGINT) AS submit,
    CAST(max(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS BIGINT) AS paid,
    CAST(max(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
    max(k) AS max_k, min(k) AS min_k, count(*) AS n_events, sum(CAST(value AS DECIMAL(18,2))) AS gmv
  FROM ev GROUP BY ALL),
cf AS (
  SELECT *, max_k < 50 AS eligible, max_k % 3 AS platform, min_k % 4 AS browser, (max_k + min_k) % 3 AS os,
    CASE WHEN gmv < 20 THEN 'a_lt_20' WHEN gmv < 50 THEN 'b_20_50' WHEN gmv < 100 THEN 'c_50_100'
         WHEN gmv < 200 THEN 'd_100_200' ELSE 'e_200_up' END AS aov
  FROM cf0)"""
_PAY = """pay AS (
  SELECT o_orderkey AS payment_id, o_custkey AS merchant_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    o_orderpriority AS priority, o_orderstatus AS status, o_orderstatus = 'F' AS success,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'cod' ELSE 'prepaid' END AS method,
    CAST(o_orderdate AS DATE) AS created_date,
    CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-07-01' THEN 'Prev' ELSE 'Post' END AS period
  FROM orders)"""
_MER = """mer AS (
  SELECT c_custkey AS merchant_id, c_name AS name, c_mktsegment AS segment, n_regionkey AS tier,
    c_acctbal AS acctbal, c_nationkey AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_SHIP = """ship AS (
  SELECT l_orderkey AS order_id, l_suppkey AS supplier_id, l_partkey AS part_id, l_linenumber AS line,
    CAST(l_shipdate AS DATE) AS ship_date,
    CASE l_returnflag WHEN 'R' THEN 'rto' WHEN 'A' THEN 'delivered' ELSE 'pending' END AS status,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS charge,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
    l_quantity AS quantity, l_discount AS discount, l_tax AS tax
  FROM lineitem)"""
_LSHIP = """lship AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ship_date DESC, line DESC, part_id DESC,
      supplier_id DESC) AS rn FROM ship) WHERE rn = 1)"""
_SCORE = """score AS (
  SELECT l_orderkey AS order_id, CAST(l_shipdate AS DATE) AS scored_date, l_linenumber AS line,
    l_partkey AS part_id, l_suppkey AS supplier_id,
    CASE WHEN CAST(l_tax AS DECIMAL(4,2)) = 0 THEN NULL WHEN l_quantity <= 35 THEN 'green' ELSE 'red' END AS ml_flag,
    CASE WHEN CAST(l_tax AS DECIMAL(4,2)) = 0.08 THEN NULL
         WHEN CAST(l_discount AS DECIMAL(4,2)) <= 0.07 THEN 'green' ELSE 'red' END AS rule_flag,
    (['category_5399', 'category_5691', 'category_5977', 'category_infrequent_mcc_group', 'acm',
      'merchant_own', 'unlisted'])[CAST(l_suppkey % 7 + 1 AS INTEGER)] AS model_code,
    l_partkey % 5 = 0 AS experimentation
  FROM lineitem),
lscore AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY scored_date DESC, line DESC, part_id DESC,
      supplier_id DESC) AS rn FROM score) WHERE rn = 1)"""
_RTO = """rto AS (
  SELECT p.payment_id AS order_id, p.merchant_id, p.created_date, p.amount, p.method, p.period,
    coalesce(s.status, 'not_shipped') AS status, s.ship_date, s.charge,
    CASE WHEN r.ml_flag = 'green' AND r.rule_flag = 'green' THEN 'green'
         WHEN r.ml_flag IS NULL OR r.rule_flag IS NULL THEN 'missing' ELSE 'red' END AS result_flag,
    coalesce(r.ml_flag, 'missing') AS ml_flag, coalesce(r.rule_flag, 'missing') AS rule_flag,
    coalesce(r.model_code, 'none') AS model_code, coalesce(r.experimentation, FALSE) AS experimentation,
    m.tier, m.segment
  FROM pay p LEFT JOIN lship s ON p.payment_id = s.order_id LEFT JOIN lscore r ON p.payment_id = r.order_id
    LEFT JOIN mer m ON p.merchant_id = m.merchant_id)"""

_NEEDS = {
    "ev": (_EV, []), "gaps": (_GAPS, ["ev"]), "cf": (_CF, ["ev"]), "pay": (_PAY, []), "mer": (_MER, []), "ship": (_SHIP, []),
    "lship": (_LSHIP, ["ship"]), "lscore": (_SCORE, []), "rto": (_RTO, ["pay", "lship", "lscore", "mer"]),
}


def sql(names: str, body: str) -> str:
    """WITH the named views (and what they need), then the body. The body may
    start with further ``name AS (...)`` views followed by SELECT."""
    done: list[str] = []

    def need(n):
        if n not in done:
            for d in _NEEDS[n][1]:
                need(d)
            done.append(n)

    for n in names.split():
        need(n)
    head = ",\n".join(_NEEDS[n][0] for n in done)
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {head}\n{body}"
    return f"WITH {head},\n{body}" if head else f"WITH {body}"
