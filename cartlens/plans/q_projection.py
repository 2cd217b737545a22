from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions.grouped import complete_keys, latest_per_key
from ..operators.facts import event_flags
from ..operators.labels import LIBRARIES, MODELS, platform, upi_app
from .registry import query
from .views import sql


@query("p01_json_paths", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'ev' || event_id AS tag,
  CASE WHEN event_id % 2 = 0 THEN event_type ELSE lower(event_type) || '!' END AS method,
  event_id % 3 = 0 AS logged_in, 'm' || event_type AS first_of_list
FROM events""")
def _(t):
    doc = F.to_json(F.struct(
        F.struct(
            F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("method")).alias("data"),
            F.concat("event_type", F.lit("!")).alias("method"),
            F.when(F.col("event_id") % 3 == 0, "true").otherwise("false").alias("loggedIn"),
            F.concat(F.lit("ev"), "event_id").alias("count.tag"),
            F.array(F.concat(F.lit("m"), "event_type"), F.lit("z")).alias("list"),
        ).alias("data")))
    d = t.raw("events").select("event_id", "props", doc.alias("doc"))
    return d.select(
        "event_id", x.json_number("props", "$.missing", "$.k").alias("k"),
        x.json_text("doc", "$.data['count.tag']").alias("tag"),
        x.json_text("doc", "$.data.data.method", "$.data.method").alias("method"),
        x.json_bool("doc", "$.data.loggedIn").alias("logged_in"),
        x.json_text("doc", "$.data.list[0]").alias("first_of_list"))


@query("p02_event_flags", sql("ev", """
SELECT event_id, CAST(event_type = 'signup' AS BIGINT) AS open, CAST(event_type = 'purchase' AND k < 50 AS BIGINT) AS small_paid,
  CAST(event_type IN ('view', 'click') AS BIGINT) AS browse FROM ev"""))
def _(t):
    e = F.col("event_type")
    d = event_flags(t.events(), {"open": e == "signup", "small_paid": (e == "purchase") & (F.col("k") < 50),
                                 "browse": e.isin("view", "click")})
    return d.select("event_id", "open", "small_paid", "browse")


@query("p03_id_on_event", sql("ev", """
SELECT merchant_id, count(DISTINCT CASE WHEN event_type = 'view' THEN checkout_id END) AS viewed,
  count(CASE WHEN event_type = 'purchase' THEN checkout_id END) AS purchases FROM ev GROUP BY 1"""))
def _(t):
    on = lambda n: F.when(F.col("event_type") == n, F.col("checkout_id"))
    d = t.events().select("merchant_id", on("view").alias("v"), on("purchase").alias("p"))
    return d.groupBy("merchant_id").agg(F.countDistinct("v").alias("viewed"), F.count("p").alias("purchases"))


@query("p04_in_list", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(t):
    o = t.raw("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    # a long list is a table: anti join instead of hundreds of literals
    listed = t.raw("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(listed, "o_custkey", "left_anti").select("o_orderkey", "o_orderpriority")


@query("p05_date_ranges", """
SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-02-01'
  OR o_orderdate BETWEEN TIMESTAMP '1999-06-01' AND TIMESTAMP '1999-07-01'""")
def _(t):
    d = F.col("o_orderdate")
    return t.raw("orders").filter(
        d.between(F.lit("1996-01-01"), F.lit("1996-02-01")) | d.between(F.lit("1999-06-01"), F.lit("1999-07-01"))
    ).select("o_orderkey")


@query("p06_contains", """
SELECT doc_id, text LIKE '%@%' AS has_at, contains(lower(text), 'license') AS has_license,
  regexp_matches(text, 'the|http|\\$') AS any_word FROM documents""")
def _(t):
    c = F.col("text")
    return t.raw("documents").select(
        "doc_id", c.like("%@%").alias("has_at"), F.contains(F.lower(c), F.lit("license")).alias("has_license"),
        x.contains_any(c, ["the", "http", "$"]).alias("any_word"))


@query("p07_same_text", """
SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s
  ON c.c_custkey = s.s_suppkey WHERE lower(upper(c.c_mktsegment)) = lower('Building')""")
def _(t):
    c = t.raw("customer").filter(x.same_text(F.upper("c_mktsegment"), F.lit("Building")))
    return c.join(t.raw("supplier"), F.col("c_custkey") == F.col("s_suppkey")).select("c_custkey", "s_suppkey")


@query("p08_not_equal_or_null", """
SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality <> 1 OR l.quality IS NULL""")
def _(t):
    d = t.raw("documents").join(t.raw("labels"), "doc_id", "left")
    return d.filter(x.not_equal_or_null("quality", 1)).select("doc_id", "quality")


@query("p09_scalar_bound", sql("pay", """
SELECT payment_id, CAST(amount AS DOUBLE) AS amount FROM pay
WHERE created_date >= (SELECT max(created_date) FROM pay) - INTERVAL 30 DAY AND amount > (SELECT avg(amount) FROM pay)"""))
def _(t):
    p = t.payments()
    bound = p.agg(F.date_sub(F.max("created_date"), 30).alias("d"))
    mean = p.agg(F.avg(F.col("amount").cast("double")).alias("m"))
    return p.filter((F.col("created_date") >= bound.scalar()) & (F.col("amount") > mean.scalar())).select(
        "payment_id", F.col("amount").cast("double").alias("amount"))


@query("p10_aov_bands", sql("cf", "SELECT checkout_id, CAST(gmv AS DOUBLE) AS gmv, aov FROM cf"))
def _(t):
    return t.checkouts().select("checkout_id", F.col("gmv").cast("double").alias("gmv"), "aov")


@query("p11_right_closed_bins", """
SELECT p_partkey, CASE WHEN p_retailprice > 900 AND p_retailprice <= 950 THEN '(900, 950]'
  WHEN p_retailprice > 950 AND p_retailprice <= 1000 THEN '(950, 1000]'
  WHEN p_retailprice > 1000 AND p_retailprice <= 1010 THEN '(1000, 1010]' END AS bin FROM part""")
def _(t):
    return t.raw("part").select("p_partkey", x.bands("p_retailprice", [900, 950, 1000, 1010], right_closed=True).alias("bin"))


RISK_SQL = """CASE WHEN result_flag = 'green' THEN 'safe' WHEN result_flag = 'red' AND experimentation THEN 'safe'
  WHEN result_flag = 'red' THEN 'risky' ELSE 'unknown' END"""


@query("p12_multi_label", sql("pay lscore", """
SELECT order_id, CASE WHEN ml_flag = 'green' AND rule_flag = 'green' THEN 'safe'
  WHEN ml_flag IS NULL OR rule_flag IS NULL THEN 'unknown' WHEN experimentation THEN 'safe' ELSE 'risky' END AS label FROM lscore"""))
def _(t):
    s = latest_per_key(t.risk_scores(), ["order_id"], ["scored_date", "line", "part_id", "supplier_id"],
                       ["ml_flag", "rule_flag", "experimentation"])
    ml, rule = F.col("ml_flag"), F.col("rule_flag")
    return s.select("order_id", x.first_match([
        ((ml == "green") & (rule == "green"), "safe"), (ml.isNull() | rule.isNull(), "unknown"),
        (F.col("experimentation"), "safe")], "risky").alias("label"))


@query("p13_platform", sql("ev", """
SELECT event_id, CASE WHEN k % 4 = 0 THEN 'mobile_sdk' WHEN k % 4 = 3 THEN 'NA' WHEN k % 3 = 0 THEN 'mweb'
  ELSE 'desktop_browser' END AS platform FROM ev"""))
def _(t):
    k = F.col("k")
    kind = F.when(k % 4 == 0, "mobile_sdk").when(k % 4 == 3, "server").otherwise("browser")
    mobile = F.when(k % 3 == 0, "true").when(k % 3 == 1, "false")
    return t.events().select("event_id", platform(kind, mobile).alias("platform"))


@query("p14_category_fold", """
SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN c_mktsegment ELSE 'Others' END AS segment, count(*) AS n
FROM customer GROUP BY 1""")
def _(t):
    return t.raw("customer").groupBy(x.fold("c_mktsegment", ["BUILDING", "AUTOMOBILE"]).alias("segment")).agg(
        F.count("*").alias("n"))


@query("p15_rule_table", """
t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Collect' ELSE 'pay' END AS kind,
  (['ybl', 'paytm', 'upi', 'apl', 'okaxis', 'Paytm', 'axisb', 'axisbank', 'rapl', 'zzz'])[o_custkey % 10 + 1] AS handle,
  (['com.phonepe.app', 'in.amazon.Shop', 'net.one97.paytm', 'com.dreamplug.x', 'none'])[o_orderkey % 5 + 1] AS package,
  o_custkey % 3 AS library FROM orders)
SELECT id, CASE
  WHEN lower(kind) = 'collect' AND handle = 'ybl' THEN 'Phonepe' WHEN lower(kind) = 'collect' AND handle = 'paytm' THEN 'Paytm'
  WHEN lower(kind) = 'collect' AND handle = 'upi' THEN 'BHIM' WHEN lower(kind) = 'collect' AND handle = 'apl' THEN 'Amazon Pay'
  WHEN lower(kind) = 'collect' AND handle = 'okaxis' THEN 'GooglePay' WHEN kind = 'pay' AND package = 'com.phonepe.app' THEN 'Phonepe'
  WHEN kind = 'pay' AND lower(package) LIKE '%amazon%' THEN 'Amazon Pay' WHEN kind = 'pay' AND package = 'net.one97.paytm' THEN 'Paytm'
  WHEN handle = 'ybl' THEN 'Phonepe' WHEN kind = 'pay' AND package LIKE '%dreamplug%' THEN 'Cred' WHEN handle = 'okaxis' THEN 'GooglePay'
  WHEN handle = 'Paytm' THEN 'Paytm' WHEN handle = 'axisb' THEN 'Cred' WHEN handle = 'axisbank' THEN 'Axis Bank'
  WHEN handle = 'upi' THEN 'BHIM' WHEN handle IN ('apl', 'rapl') THEN 'Amazon Pay' WHEN kind = 'pay' AND library <> 1 THEN 'NA'
  ELSE 'Others' END AS app FROM t""".replace("t AS", "WITH t AS", 1))
def _(t):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(v) for v in names]), (n + 1).cast("int"))
    o = t.raw("orders")
    d = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "Collect").otherwise("pay").alias("kind"),
        pick(["ybl", "paytm", "upi", "apl", "okaxis", "Paytm", "axisb", "axisbank", "rapl", "zzz"], F.col("o_custkey") % 10).alias("handle"),
        pick(["com.phonepe.app", "in.amazon.Shop", "net.one97.paytm", "com.dreamplug.x", "none"], F.col("o_orderkey") % 5).alias("package"),
        (F.col("o_custkey") % 3).alias("library"))
    return d.select("id", upi_app(F.col("kind"), F.col("handle"), F.col("package"), F.col("library")).alias("app"))


LIBRARIES_SQL = "CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LIBRARIES.items()) + " ELSE 'UNKNOWN' END"
MODELS_SQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODELS.items()) + " ELSE 'Other' END"


@query("p16_code_names", sql("lscore", f"""
SELECT {LIBRARIES_SQL.format(c="supplier_id % 12")} AS library, {MODELS_SQL.format(c="model_code")} AS model, count(*) AS n
FROM lscore GROUP BY 1, 2"""))
def _(t):
    s = latest_per_key(t.risk_scores(), ["order_id"], ["scored_date", "line", "part_id", "supplier_id"],
                       ["model_code", "supplier_id"])
    lib = x.code_name((F.col("supplier_id") % 12).cast("int"), LIBRARIES, "UNKNOWN")
    return s.groupBy(lib.alias("library"), x.code_name("model_code", MODELS, "Other").alias("model")).agg(
        F.count("*").alias("n"))


@query("p17_canonical_text", """
WITH m AS (SELECT DISTINCT p_type AS raw, substr(p_type, 1, 4) AS clean, p_size * 10 + 5 AS mid FROM part WHERE p_size <= 3)
SELECT p_partkey, coalesce((SELECT max(clean) FROM m WHERE m.raw = p.p_type AND m.mid = p.p_size * 10 + 5), lower(p_type)) AS label,
  CAST((SELECT max(mid) FROM m WHERE m.raw = p.p_type AND m.mid = p.p_size * 10 + 5) AS BIGINT) AS midpoint FROM part p""")
def _(t):
    p = t.raw("part")
    mapping = p.filter("p_size <= 3").select(
        "p_type", "p_size", F.substring("p_type", 1, 4).alias("clean"), (F.col("p_size") * 10 + 5).alias("midpoint")).distinct()
    return p.join(mapping, ["p_type", "p_size"], "left").select(
        "p_partkey", F.coalesce("clean", F.lower("p_type")).alias("label"), "midpoint")


@query("p18_no_duplicate_names", """
SELECT c.c_custkey AS id, c.c_name AS name, s.s_name AS supplier_name, CAST(c.c_nationkey AS BIGINT) AS nation
FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey""")
def _(t):
    c = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("c")
    s = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("s")
    return c.join(s, "id").select("id", "c.name", F.col("s.name").alias("supplier_name"), "c.nation")


@query("p19_first_identity", """
SELECT doc_id, coalesce(CASE WHEN n_chars > 3000 THEN lang END, CASE WHEN n_chars > 1000 THEN source END, 'none') AS ident FROM documents""")
def _(t):
    n = F.col("n_chars")
    return t.raw("documents").select("doc_id", F.coalesce(
        F.when(n > 3000, F.col("lang")), F.when(n > 1000, F.col("source")), F.lit("none")).alias("ident"))


@query("p20_null_label", """
SELECT coalesce(CAST(l.quality AS VARCHAR), 'user_saved') AS source_type, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def _(t):
    d = t.raw("documents").join(t.raw("labels"), "doc_id", "left")
    return d.groupBy(x.label_null("quality", "user_saved").alias("source_type")).agg(F.count("*").alias("n"))


@query("p21_complete_keys", sql("ev", """
SELECT device_id, event_type, count(*) AS n FROM ev WHERE device_id IN (SELECT device_id FROM ev
  GROUP BY 1 HAVING count(DISTINCT event_type) = 5) GROUP BY 1, 2"""))
def _(t):
    cells = t.events().groupBy("device_id", "event_type").agg(F.count("*").alias("n"))
    return complete_keys(cells, "device_id", "event_type", 5)
