import datetime as dt

from pyspark.sql import functions as F

from ..functions.expr import flag
from ..operators import facts as op
from ..operators import interactions
from ..session import scratch_dir
from ..sources.fact_store import FactStore
from .registry import query
from .views import sql

# Raw client events are derived from the event table: the documents hold the same
# values as JSON, so normalising them must give the table back.
NAMES = {"signup": "open", "view": "render:complete", "click": "submit", "purchase": "checkoutCODOptionShown", "error": "payment:failed"}
NAME_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"


def raw_events(t):
    e = t.events()
    k = F.col("k")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("event_type"))
    meta = F.struct(
        F.when(k % 2 == 0, "true").otherwise("false").alias("loggedIn"), F.when(k % 5 != 0, "true").alias("is_one_click_checkout_enabled_lite"),
        k.cast("string").alias("count.savedCards"), F.lit("home").alias("first_screen"))
    data = F.struct(
        meta.alias("meta"), F.when(k % 3 == 0, F.struct(F.lit("COD").alias("method"))).alias("data"),
        F.when(k % 3 == 1, F.lit("Card")).alias("method"), F.when(k % 4 == 0, "true").when(k % 4 == 1, "false").alias("disabled"))
    options = F.struct(F.concat(F.lit("key_live_"), F.lpad(F.col("merchant_id").cast("string"), 14, "0")).alias("key"),
                       F.when(k % 5 == 0, F.when(k % 10 == 0, "true").otherwise("false")).alias("one_click_checkout"))
    context = F.struct(
        "checkout_id", F.concat(F.lit("order_"), "event_id").alias("order_id"), F.lit("Browser").alias("platform"), F.lit("CheckoutJS").alias("library"),
        F.lit("live").alias("mode"), F.col("device_id").cast("string").alias("device.id"),
        F.struct(F.struct(F.lit("Chrome").alias("family")).alias("user_agent"), F.struct(F.lit("Android").alias("family")).alias("os")).alias("user_agent_parsed"))
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(
        name.alias("event_name"), F.to_json(F.struct(options.alias("options"), data.alias("data"))).alias("properties"),
        F.to_json(context).alias("context"), secs.alias("event_timestamp"), F.col("event_id").alias("event_timestamp_raw"),
        secs.alias("producer_timestamp"), F.col("dt").alias("producer_created_date"), F.when(k < 95, "checkoutjs").otherwise("server").alias("source"))


def key_table(t):
    ids = t.events().select("merchant_id").distinct().filter("merchant_id <> 8")
    return ids.select(F.lpad(F.col("merchant_id").cast("string"), 14, "0").alias("id"), "merchant_id")


def order_meta(t):
    doc = F.to_json(F.struct(F.struct(F.concat(F.lit("src"), F.col("k") % 4).alias("utm_source"), F.lit("ads").alias("utm_medium")).alias("utm_parameters")))
    now = t.events().filter("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("order_id"), F.lit("one_click_checkout").alias("type"),
                                                       F.lit(2).alias("updated_at"), doc.alias("value"))
    # every third order had a document before, which its update replaces
    before = now.filter("cast(order_id as bigint) % 3 = 0").withColumns({"updated_at": F.lit(1), "value": F.lit('{"utm_parameters": {"utm_source": "old"}}')})
    return now.unionByName(before)


#: Columns that no generated document fills.
UNSET = ["is_mandatory_signup", "is_coupons_enabled", "available_coupons_count", "is_address_enabled", "address_screen_type", "saved_address_count", "shown_p13n",
         "otp_reason", "opted_to_save_address", "is_new_address_saved", "is_saved_address", "address_id", "customer_id", "product_type", "utm_campaign"]


@query("d01_normalize_events", sql("ev", f"""
SELECT checkout_id, 'order_' || event_id AS order_id, CASE WHEN merchant_id <> 8 THEN merchant_id END AS merchant_id, event_id AS event_timestamp_raw,
  {NAME_SQL} AS event_name, epoch(ts)::BIGINT - (CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END) AS event_timestamp,
  'browser' AS platform, 'Chrome' AS browser_name, CASE WHEN k % 3 = 0 THEN 'cod' WHEN k % 3 = 1 THEN 'card' END AS method,
  CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS logged_in, CAST(k AS VARCHAR) AS count_saved_cards, CAST(device_id AS VARCHAR) AS device_id,
  CASE WHEN event_type = 'purchase' AND k % 4 <> 0 THEN 'yes' ELSE 'no' END AS is_order_cod_eligible,
  CASE WHEN event_id % 2 = 0 THEN 'src' || (k % 4) END AS utm_source, CASE WHEN event_id % 2 = 0 THEN 'ads' END AS utm_medium, dt AS producer_created_date,
  'key_live_' || lpad(CAST(merchant_id AS VARCHAR), 14, '0') AS merchant_key, epoch_us(ts) // 1000000 AS producer_timestamp,
  strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S.%f') AS producer_time, 'home' AS first_screen_name, 'Android' AS device_os, 'live' AS is_test_mode,
  'checkoutjs' AS library, CAST(-1 AS BIGINT) AS is_storefront, 'true' AS is_one_click, {", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in UNSET)}
FROM ev WHERE dt BETWEEN DATE '2024-01-02' AND DATE '2024-01-28' AND k < 95 AND (k % 5 <> 0 OR k % 10 = 0)"""), dates="producer_created_date")
def _(t):
    d = op.normalize_events(raw_events(t), key_table(t), order_meta(t), dt.date(2024, 1, 2), dt.date(2024, 1, 28))
    return d


SESSIONS = """s0 AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS starts FROM ev
    WINDOW w AS (PARTITION BY merchant_id, dt, device_id ORDER BY ts, event_id)),
  s AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY merchant_id, dt, device_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM s0)"""


def sessions(t, gap=1800):
    return op.sessionize(t.events(), ["merchant_id", "dt", "device_id"], "ts", "event_id", gap)


@query("d02_sessionize", sql("ev", SESSIONS + " SELECT event_id, session_no, session_no || '-' || dt || '-' || device_id AS session_id FROM s"))
def _(t):
    return sessions(t).select("event_id", "session_no", "session_id")


KINDS = ["signup", "view", "click", "purchase", "error"]
FLAGS = [(f"{e}_{b}", e, b) for e in KINDS for b in range(12)]


NAMED = {n: e for e, n in op.CHECKOUT_FLAGS.items()}


@query("d03_checkout_fact", sql("ev", "SELECT checkout_id, " + ", ".join(
    f"CAST(max(CASE WHEN {NAME_SQL} = '{e}' THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, e in NAMED.items()) + ", " + ", ".join(
    f"CAST(max(CASE WHEN event_type = '{e}' AND k % 12 = {b} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, e, b in FLAGS)
    + ", min(dt) AS first_date, count(*) AS events FROM ev GROUP BY 1"), dates="first_date")
def _(t):
    spec = {n: (F.col("event_type") == e) & (F.col("k") % 12 == b) for n, e, b in FLAGS}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("event_type"))
    events = t.events().withColumn("event_name", name)
    return op.build_checkout_fact(events, {**op.checkout_flags(), **spec}, carried={"first_date": F.min("dt"), "events": F.count("*")})


# Documents of the interaction events: what each field holds, in SQL that both engines read; k is the event's number.
NAMES_ALL = sorted({n for _, of, *_ in interactions.all_flags() for n in of})
DOCUMENT = {
    "screen_name": "CASE k % 4 WHEN 0 THEN 'details_screen' WHEN 1 THEN 'new_shipping_address_screen' WHEN 2 THEN 'saved_shipping_address_screen' END",
    "coupon_source": "CASE k % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'merchant' END", "input_source": "CASE WHEN k % 2 = 0 THEN 'auto' ELSE 'typed' END",
    "is_coupon_valid": "CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'n/a' END", "count_coupons_available": "CASE k % 90 WHEN 0 THEN '2' WHEN 1 THEN 'many' WHEN 2 THEN '0' END",
    "prefill_contact_number": "CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN '99' END", "prefill_email": "CASE WHEN k % 2 = 0 THEN '' ELSE 'a@b' END", "value": "CASE WHEN k % 5 > 1 THEN 'x' WHEN k % 5 = 1 THEN '' END",
    "otp_reason": "CASE k % 7 WHEN 0 THEN 'access_address' WHEN 1 THEN 'access_address_v2' WHEN 2 THEN 'mandatory_login' WHEN 3 THEN 'mandatory_login_v2' WHEN 4 THEN 'save_address' WHEN 5 THEN 'save_address_v2' END",
    "serviceable": "CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END", "zipcode": "concat('10', k)", "city": "CASE WHEN k % 4 > 0 THEN concat('c', k % 4) END", "state": "concat('s', k % 3)",
    "is_mobile": "CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END", "initial_loggedIn": "CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END",
    "initial_hasSavedAddress": "CASE WHEN k % 2 = 0 THEN 'true' END", "platform": "CASE k % 3 WHEN 0 THEN 'mobile_sdk' ELSE 'browser' END"}


def interaction_events(t):
    f = {n: F.expr(e) for n, e in DOCUMENT.items()}
    part = lambda *names: F.struct(*[f[n].alias(n) for n in names])
    data = F.struct(*[f[n].alias(n) for n in list(DOCUMENT)[:9]], F.struct(F.array(part("serviceable", "zipcode", "city", "state")).alias("addresses")).alias("response"),
                    part("is_mobile", "initial_loggedIn", "initial_hasSavedAddress").alias("meta"))
    name = F.element_at(F.array(*map(F.lit, NAMES_ALL)), (F.col("event_id") % len(NAMES_ALL)).cast("int") + 1)
    return t.events().select(
        F.when(F.col("merchant_id") != 7, F.col("merchant_id")).alias("merchant_id"), "checkout_id", F.col("dt").alias("producer_created_date"), name.alias("event_name"),
        F.when(F.col("k") % 2 == 0, "Chrome").otherwise("Safari").alias("browser_name"),
        F.when(F.col("k") % 50 == 49, "{broken").otherwise(F.to_json(F.struct(data.alias("data")))).alias("properties"), F.to_json(part("platform")).alias("context"))


def flag_sql(of, field, how, value):
    field = f"f_{field}"
    where = [f"name IN ({', '.join(repr(n) for n in of)})"] if of else []
    if how:
        where.append({"is": f"{field} = '{value}'", "is not": f"{field} <> '{value}'", "in": f"{field} IN ({', '.join(repr(v) for v in value or [])})" if how == "in" else "",
                      "is true": f"{field} = 'true'", "above": f"coalesce(try_cast({field} AS INTEGER), 0) > {value}"}[how])
    return f"CAST(max(CASE WHEN {' AND '.join(where)} THEN 1 ELSE 0 END) AS BIGINT)"


@query("d03_interaction_fact", sql("ev", f"""
n AS (SELECT *, [{", ".join(repr(n) for n in NAMES_ALL)}][CAST(event_id % {len(NAMES_ALL)} AS INTEGER) + 1] AS name, {", ".join(
    f"{e if n == 'platform' else f'CASE WHEN k % 50 <> 49 THEN {e} END'} AS f_{n}" for n, e in DOCUMENT.items())} FROM ev WHERE merchant_id <> 7 AND merchant_id <> 3)
SELECT merchant_id, checkout_id, min(dt) AS producer_created_date, max(CASE WHEN k % 2 = 0 THEN 'Chrome' ELSE 'Safari' END) AS browser_name,
  max(CASE WHEN name <> 'render:complete' THEN 'NA' WHEN f_platform = 'mobile_sdk' THEN f_platform WHEN f_is_mobile = 'true' THEN 'mweb' ELSE 'desktop_browser' END) AS platform,
  max(CASE WHEN name = 'render:complete' THEN CAST(f_initial_loggedIn AS BOOLEAN) END) AS initial_loggedin,
  max(CASE WHEN name = '{interactions.SUMMARY}' THEN CAST(f_initial_hasSavedAddress AS BOOLEAN) END) AS "initial_hasSavedAddress",
  {", ".join(f"{flag_sql(*rest)} AS {n}" for n, *rest in interactions.all_flags())},
  {", ".join(f"max(CASE WHEN name = '{interactions.SHIPPING}' THEN f_{x} ELSE '0' END) AS pincode_serviceability_{x}" for x in interactions.PLACES)}
FROM n GROUP BY 1, 2"""), dates="producer_created_date")
def _(t):
    return interactions.interaction_fact(interaction_events(t), exclude=[3])


@query("d03_bucketed_fact", sql("ev", f"""
SELECT checkout_id, {", ".join(f"CAST(max(CASE WHEN {NAME_SQL} = '{e}' THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, e in NAMED.items())}, min(dt) AS first_date,
  count(*) AS events, count(*) FILTER (event_type IN ('purchase', 'error')) AS attempts FROM ev GROUP BY 1"""), dates="first_date")
def _(t):
    """The fact and its join to the payment attempts, from events stored in buckets by checkout: neither side is shuffled."""
    from .q_sources import event_store
    e = event_store(t, ["checkout_id", "event_type", "dt"])
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("event_type"))
    fact = op.build_checkout_fact(e.withColumn("event_name", name), op.checkout_flags(), carried={"first_date": F.min("dt"), "events": F.count("*")})
    pay = e.filter(F.col("event_type").isin("purchase", "error")).groupBy("checkout_id").agg(F.count("*").alias("attempts"))
    return fact.join(pay, "checkout_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


DEVICE_FACT = """SELECT device_id, """ + ", ".join(f"CAST(max(CASE WHEN event_type = '{e}' THEN 1 ELSE 0 END) AS BIGINT) AS {e}" for e in KINDS) \
    + ", min(dt) AS first_date FROM ev GROUP BY 1"


def device_fact(df):
    return op.build_checkout_fact(df, {e: F.col("event_type") == e for e in KINDS}, "device_id", {"first_date": F.min("dt")})


def upsert_inputs(t):
    e = t.events()
    return (device_fact(e.filter(F.col("dt") <= F.lit(dt.date(2024, 1, 20)))),
            device_fact(e.filter(F.col("dt") >= F.lit(dt.date(2024, 1, 19)))))   # two days of overlap, as a look-back has


def device_store(t):
    return FactStore(t.spark, scratch_dir(t.spark, "fact"), "device_id", "first_date", KINDS, buckets=4)


@query("d04_upsert_fact", sql("ev", DEVICE_FACT), dates="first_date")
def _(t):
    """Through a store that knows the day of each key: the delta is merged twice, which must change nothing the second time."""
    history, delta = upsert_inputs(t)
    store = device_store(t)
    store.upsert(history)
    for _ in range(2):
        store.upsert(delta)
    return store.read()


@query("d04_old_versions", sql("ev", f"""SELECT CAST(1 AS BIGINT) AS version, * FROM ({DEVICE_FACT.replace("FROM ev", "FROM ev WHERE dt <= DATE '2024-01-20'")}) UNION ALL SELECT 2, * FROM ({DEVICE_FACT})"""),
       dates="first_date")
def _(t):
    """The fact before and after a delta, both from the same store."""
    history, delta = upsert_inputs(t)
    store = device_store(t)
    store.upsert(history)
    store.upsert(delta)
    read = lambda v: store.read(v).select(F.lit(v).alias("version"), "*")
    return read(1).unionByName(read(2))


@query("d04_key_locator", sql("ev", "SELECT device_id AS key, min(dt) AS day FROM ev GROUP BY 1"), dates="day")
def _(t):
    """Where the row of each key lies."""
    history, delta = upsert_inputs(t)
    store = device_store(t)
    store.upsert(delta)
    store.upsert(history)       # older rows come later: keys move to earlier days
    return store.locator()


@query("s13_delete_from_store", sql("ev", f"SELECT * FROM ({DEVICE_FACT}) WHERE device_id % 3 <> 0"), dates="first_date")
def _(t):
    """Keys taken out of a fact: only the days that hold them are rewritten."""
    history, delta = upsert_inputs(t)
    store = device_store(t)
    store.upsert(history)
    store.upsert(delta)
    store.delete(store.read().filter("device_id % 3 = 0"))
    return store.read()


@query("d04_upsert_whole", sql("ev", DEVICE_FACT), dates="first_date")
def _(t):
    history, delta = upsert_inputs(t)
    return op.upsert_fact(history, delta, "device_id", KINDS, ["first_date"])


@query("d04_merge_new_rows", sql("ev", DEVICE_FACT), dates="first_date")
def _(t):
    history, delta = upsert_inputs(t)
    return op.merge_new_rows(history, delta, "device_id", KINDS, ["first_date"])


SHIP_ORDER = ["ship_date", "line", "part_id", "supplier_id"]
SCORE_ORDER = ["scored_date", "line", "part_id", "supplier_id"]
RTO_COLS = ["order_id", "merchant_id", "created_date", "amount", "method", "period", "status", "ship_date", "charge", "result_flag",
            "ml_flag", "rule_flag", "model_code", "experimentation"]


def rto_orders(t):
    return t.payments().drop("status").withColumnRenamed("payment_id", "order_id")


def rto_fact(t, dims=False):
    """The risk fact; merchant columns only where a query asks for them."""
    who = t.merchants().select("merchant_id", "tier", "segment") if dims else None
    out = op.build_rto_fact(rto_orders(t), t.shipments(), t.risk_scores(), who, "order_id", SHIP_ORDER, SCORE_ORDER, ship_cols=["ship_date", "charge"])
    return out.select(*RTO_COLS, *(["tier", "segment"] if dims else []))


def order_status(t):
    """Orders with the state of their latest shipment: what needs no risk score does
    not pay for one."""
    s = t.latest_shipments("status")
    o = t.payments().drop("status").withColumnRenamed("payment_id", "order_id")
    return o.join(s, "order_id", "left").withColumn("status", F.coalesce("status", F.lit("not_shipped")))


@query("d05_rto_fact", sql("rto", """
SELECT r.order_id, merchant_id, created_date, CAST(amount AS DOUBLE) AS amount, method, period, r.status, r.ship_date, CAST(r.charge AS DOUBLE) AS charge,
  r.result_flag, r.ml_flag, r.rule_flag, r.model_code, r.experimentation, CAST(tier AS BIGINT) AS tier, segment, s.supplier_id AS shipping_provider, CAST(s.line AS BIGINT) AS awb_line, s.part_id,
  CAST(s.price AS DOUBLE) AS price, s.quantity, l.scored_date, n.shipments
FROM rto r LEFT JOIN lship s ON r.order_id = s.order_id LEFT JOIN lscore l ON r.order_id = l.order_id LEFT JOIN (SELECT order_id, count(*) AS shipments FROM ship GROUP BY 1) n ON r.order_id = n.order_id"""),
       dates="created_date ship_date scored_date")
def _(t):
    """Rebuilt for the orders of the last period; the earlier state of the fact keeps the others."""
    dims = t.merchants().select("merchant_id", "tier", "segment")
    ships = t.shipments().withColumnRenamed("supplier_id", "shipping_provider").withColumnRenamed("line", "awb_line")
    order = ["ship_date", "awb_line", "part_id", "shipping_provider"]

    def build(orders, prior=None):
        return op.build_rto_fact(orders, ships, t.risk_scores(), dims, "order_id", order, SCORE_ORDER,
                                 ship_cols=["ship_date", "charge", "shipping_provider", "awb_line", "part_id", "price", "quantity"], score_cols=["scored_date"],
                                 ship_count="shipments", prior=prior)

    post = F.col("period") == "Post"
    return build(rto_orders(t).filter(post), build(rto_orders(t).filter(~post))).drop("priority", "success")


EXP = """e AS (SELECT DISTINCT checkout_id, 'arm' AS experiment_name, arm AS experiment_value FROM ev
  UNION SELECT DISTINCT checkout_id, 'theme', CASE device_id % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' ELSE 'auto' END FROM ev)"""


def experiments(t):
    theme = F.when(F.col("device_id") % 3 == 0, "dark").when(F.col("device_id") % 3 == 1, "light").otherwise("auto")
    e = t.events().withColumn("arms", F.to_json(F.create_map(F.lit("arm"), "arm", F.lit("theme"), theme)))
    return op.explode_experiments(e, "arms", ["checkout_id"])


@query("d06_experiment_fact", sql("ev", EXP + " SELECT * FROM e"))
def _(t):
    return experiments(t)


@query("d07_experiment_metrics", sql("cf", EXP + """,
p AS (SELECT checkout_id, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS ok FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT experiment_name, experiment_value, dt, platform, CAST(sum(render) AS BIGINT) AS renders, CAST(sum(submit) AS BIGINT) AS submits,
  CAST(coalesce(sum(attempts), 0) AS BIGINT) AS payment_attempts, CAST(coalesce(sum(ok), 0) AS BIGINT) AS payment_success
FROM e JOIN cf USING (checkout_id) LEFT JOIN p USING (checkout_id) GROUP BY 1, 2, 3, 4"""), dates="dt")
def _(t):
    pay = t.events().filter(F.col("event_type").isin("purchase", "error")).select("checkout_id", (F.col("event_type") == "purchase").alias("success"))
    fact = t.checkouts().select("checkout_id", "dt", "platform", "render", "submit")
    return op.experiment_metrics(experiments(t), fact, pay, "checkout_id", ["dt", "platform"])


@query("d08_pivot_arms", sql("ev", EXP + """
SELECT checkout_id, max(experiment_value) FILTER (experiment_name = 'arm') AS arm, max(experiment_value) FILTER (experiment_name = 'theme') AS theme FROM e GROUP BY 1"""))
def _(t):
    return op.pivot_arms(experiments(t), "checkout_id", ["arm", "theme"])


@query("d102_error_events", sql("ev", f"""
SELECT {NAME_SQL} AS event_name, dt AS producer_created_date, checkout_id, CAST(NULL AS VARCHAR) AS error_code, count(*) AS n
FROM ev WHERE event_type IN ('error', 'click') GROUP BY 1, 2, 3"""), dates="producer_created_date")
def _(t):
    d = op.error_events(raw_events(t), ["payment:failed", "submit"])
    return d.groupBy("event_name", "producer_created_date", "checkout_id", "error_code").agg(F.count("*").alias("n"))


@query("d77_session_reconcile", sql("ev", SESSIONS + """,
a AS (SELECT event_id, session_no || '-' || dt || '-' || device_id AS old_id FROM s),
b0 AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 14400000000 THEN 0 ELSE 1 END AS st FROM ev WINDOW w AS (PARTITION BY merchant_id, dt, device_id ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(st) OVER (PARTITION BY merchant_id, dt, device_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) || '-' || dt || '-' || device_id AS new_id FROM b0),
g AS (SELECT dt, event_type, count(DISTINCT old_id) AS old_ids, count(DISTINCT new_id) AS new_ids FROM a JOIN b USING (event_id) GROUP BY 1, 2)
SELECT *, round((new_ids - old_ids) / old_ids::DOUBLE, 6) AS diff_pct FROM g"""), dates="dt")
def _(t):
    from ..operators.identity import session_reconcile
    keys = ["merchant_id", "dt", "device_id"]
    e = t.events().select(*keys, "ts", "event_id", "event_type")
    b = op.sessionize_many(e, keys, "ts", "event_id", {"old_id": 1800, "new_id": 4 * 3600}, once=True)
    out = session_reconcile(b, "old_id", "new_id", ["dt", "event_type"])
    return out.withColumn("diff_pct", F.round("diff_pct", 6))
