"""Fact builders: events, sessions, checkouts, shipments, experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag, json_text
from ..functions.grouped import latest_per_key, left_join_sparse
from ..functions.scan import gaps, scan_all, time_chunk

# The event document, parsed once into a struct instead of once per path.
PROPERTIES_SCHEMA = """
struct<
  options: struct<key: string, one_click_checkout: string>,
  data: struct<
    method: string, disabled: string, otp_reason: string, opted_to_save_address: string,
    addressSaved: string, is_saved_address: string, address_id: string,
    data: struct<method: string>,
    meta: struct<
      first_screen: string, is_mandatory_signup: string, coupons_enabled: string,
      available_coupons_count: string, address_enabled: string, address_screen_type: string,
      saved_address_count: string, `count.savedCards`: string, loggedIn: string, p13n: string,
      is_mobile: string, is_one_click_checkout_enabled_lite: string>>>
"""
CONTEXT_SCHEMA = """
struct<
  checkout_id: string, order_id: string, platform: string, library: string, mode: string,
  `device.id`: string,
  user_agent_parsed: struct<user_agent: struct<family: string>, os: struct<family: string>>>
"""


def normalize_events(raw: DataFrame, keys: DataFrame, order_meta: DataFrame, start, end,
                     source: str = "checkoutjs", version: str = "updated_at") -> DataFrame:
    """Client events with JSON documents -> typed columns, one row per event.

    Keeps one-click events of the source and date range (compared on the
    partition column's own type so partitions are pruned), looks the merchant
    up by API key and the UTM fields by order. An order's document of the greatest
    ``version`` counts, and of several merchants of a key the least, so no event is repeated.
    """
    e = raw.filter((F.col("source") == source) & F.col("producer_created_date").between(F.lit(start), F.lit(end)))
    # Both documents are parsed exactly once per event. The row test sits inside the
    # array filter: as a plain filter it would be pushed below the parsing and parse
    # the documents again for every field it looks at.
    doc = F.array(F.struct(F.from_json("properties", PROPERTIES_SCHEMA).alias("p"), F.from_json("context", CONTEXT_SCHEMA).alias("c")))

    def wanted(d):
        one_click = (d["p"]["data"]["meta"]["is_one_click_checkout_enabled_lite"].try_cast("boolean")
                     | (d["p"]["options"]["one_click_checkout"] == "true"))
        return (F.lower(d["c"]["library"]) == source) & one_click

    e = e.select("event_name", "event_timestamp", "event_timestamp_raw", "producer_timestamp", "producer_created_date",
                 F.inline(F.filter(doc, wanted)))
    meta = F.col("p.data.meta")
    disabled = F.col("p.data.disabled")
    flat = e.select(
        F.col("c.checkout_id").alias("checkout_id"),
        F.col("c.order_id").alias("order_id"),
        F.col("p.options.key").alias("merchant_key"),
        "event_timestamp", "event_timestamp_raw", "event_name", "producer_timestamp", "producer_created_date",
        meta["first_screen"].alias("first_screen_name"),
        meta["is_mandatory_signup"].alias("is_mandatory_signup"),
        meta["coupons_enabled"].alias("is_coupons_enabled"),
        meta["available_coupons_count"].alias("available_coupons_count"),
        meta["address_enabled"].alias("is_address_enabled"),
        meta["address_screen_type"].alias("address_screen_type"),
        meta["saved_address_count"].alias("saved_address_count"),
        meta["count.savedCards"].alias("count_saved_cards"),
        meta["loggedIn"].alias("logged_in"),
        meta["p13n"].alias("shown_p13n"),
        F.lower(F.col("c.platform")).alias("platform"),
        F.col("c.user_agent_parsed.user_agent.family").alias("browser_name"),
        F.col("c.user_agent_parsed.os.family").alias("device_os"),
        F.lower(F.coalesce(F.col("p.data.data.method"), F.col("p.data.method"))).alias("method"),
        F.col("c.mode").alias("is_test_mode"),
        F.when((F.col("event_name") == "checkoutCODOptionShown") & (disabled.isNull() | (disabled == "false")), "yes")
        .otherwise("no").alias("is_order_cod_eligible"),
        F.col("p.data.otp_reason").alias("otp_reason"),
        F.col("p.data.opted_to_save_address").alias("opted_to_save_address"),
        F.col("p.data.addressSaved").alias("is_new_address_saved"),
        F.col("p.data.is_saved_address").alias("is_saved_address"),
        F.col("p.data.address_id").alias("address_id"),
        F.col("c")["device.id"].alias("device_id"),
        F.timestamp_seconds("producer_timestamp").alias("producer_time"),
        F.lit(source).alias("library"),
        F.lit(-1).alias("is_storefront"),
        F.lit("true").alias("is_one_click"),
        F.lit(None).cast("string").alias("customer_id"),
        F.lit(None).cast("string").alias("product_type"),
        F.substring("p.options.key", 10, 14).alias("__key"),
        F.expr("substring(c.order_id, 7)").alias("__order"),
    )
    documents = order_meta.filter((F.col("type") == "one_click_checkout") & F.col("order_id").isNotNull())
    utm = latest_per_key(documents, ["order_id"], [version, "value"], ["value"]).select(
        F.col("order_id").alias("__order"),
        json_text("value", "$.utm_parameters.utm_source").alias("utm_source"),
        json_text("value", "$.utm_parameters.utm_medium").alias("utm_medium"),
        json_text("value", "$.utm_parameters.utm_campaign").alias("utm_campaign"))
    key_dim = keys.filter("id is not null").groupBy(F.col("id").alias("__key")).agg(F.min("merchant_id").alias("merchant_id"))
    where = ["checkout_id", "event_timestamp_raw"]
    d = left_join_sparse(left_join_sparse(flat, key_dim, "__key", where), utm, "__order", where)
    return d.drop("__key", "__order")


def sessionize(df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_seconds: int = 1800,
               chunk_seconds: int = 600, day: str = "dt", device: str = "device_id") -> DataFrame:
    """Add session number and id per key (e.g. merchant x date x device).

    A session starts at the first event of the key or after a gap of at least
    ``gap_seconds``. Events without a device (or time, or another key) have no
    place in a session: their session columns are NULL, and the usual hot key, the
    missing device, is spread over many tasks.
    """
    return sessionize_many(df, keys, ts, tie, {"session": gap_seconds}, chunk_seconds, day, device).withColumnRenamed("session", "session_id")


def sessionize_many(df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_seconds: Mapping[str, int], chunk_seconds: int = 600, day: str = "dt",
                    device: str = "device_id", once: bool = False) -> DataFrame:
    """Several definitions of a session in one scan: for each name and gap the columns ``<name>_no`` and ``<name>``, the id.

    ``once`` reads the source once, see ``scan_all``: for a ``df`` that has only the columns needed.
    """
    chunk = F.when(F.col(device).isNotNull(), time_chunk(ts, chunk_seconds))
    out = scan_all(df, keys, [F.col(ts), F.col(tie)], chunk, [gaps(f"{n}_no", ts, g) for n, g in gap_seconds.items()], once)
    return out.withColumns({n: F.when(F.col(f"{n}_no").isNotNull(), F.concat_ws("-", F.col(f"{n}_no").cast("string"), F.col(day).cast("string"), F.col(device).cast("string")))
                            for n in gap_seconds})


def event_flags(df: DataFrame, spec: Mapping[str, Column]) -> DataFrame:
    """Add one 0/1 column per condition (one-hot of events)."""
    return df.select("*", *[flag(c).alias(n) for n, c in spec.items()])


# Events of the checkout and the fact's flag for each.
CHECKOUT_FLAGS = {
    "open": "open", "render:complete": "checkout_render_complete", "render:contact_page": "contact_page_rendered",
    "render:1cc_payment_home_screen_loaded": "payment_screen_loaded", "behav:contact:fill": "contact_filled",
    "behav:continue:click": "contact_page_cta_clicked", "instrument:selected": "instrument_selected", "submit": "submit",
    "oncomplete": "payment_completed", "method:selected": "method_selected"}


def checkout_flags(event: str = "event_name") -> dict[str, Column]:
    """Conditions of the checkout fact's named flags."""
    return {flag_name: F.col(event) == name for name, flag_name in CHECKOUT_FLAGS.items()}


def build_checkout_fact(events: DataFrame, flag_spec: Mapping[str, Column], key: str = "checkout_id",
                        carried: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per checkout: 'ever happened' flags plus carried aggregates.

    Flags are reduced inside the map tasks, so a checkout with any number of
    events ships one row per task.
    """
    aggs = [F.max(flag(c)).alias(n) for n, c in flag_spec.items()]
    aggs += [c.alias(n) for n, c in (carried or {}).items()]
    return events.groupBy(key).agg(*aggs)


def upsert_fact(existing: DataFrame, delta: DataFrame, key: str, maxes: Sequence[str],
                mins: Sequence[str]) -> DataFrame:
    """History with a delta merged in: rows of touched keys are re-reduced with the
    delta, all others pass through.

    The delta is reduced to one row per key and met with the history, which has one
    row per key, in one full join: both sides are read once. Running the same delta
    again changes nothing. The whole new table is one DataFrame; ``FactStore`` keeps a
    fact by days and rewrites only those that a delta touches.
    """
    new = delta.groupBy(F.col(key).alias("__key")).agg(
        *[F.max(c).alias(f"__{c}") for c in maxes], *[F.min(c).alias(f"__{c}") for c in mins])
    both = existing.select(key, *maxes, *mins).join(new, F.col(key) == F.col("__key"), "full")
    return both.select(
        F.coalesce(key, "__key").alias(key), *[F.greatest(c, f"__{c}").alias(c) for c in maxes],
        *[F.least(c, f"__{c}").alias(c) for c in mins])


def merge_new_rows(existing: DataFrame, delta: DataFrame, key: str, maxes: Sequence[str],
                   mins: Sequence[str]) -> DataFrame:
    """Same table as ``upsert_fact`` in one aggregate and no join: every row is
    re-reduced. Cheaper when the delta touches a large part of the history."""
    cols = [key, *maxes, *mins]
    return existing.select(*cols).unionByName(delta.select(*cols)).groupBy(key).agg(
        *[F.max(c).alias(c) for c in maxes], *[F.min(c).alias(c) for c in mins])


def combined_flag(ml: Column, rule: Column) -> Column:
    """green only when both are green; 'missing' when either is absent."""
    return (F.when(ml.isNull() | rule.isNull(), "missing")
            .when((ml == "green") & (rule == "green"), "green").otherwise("red"))


def build_rto_fact(orders: DataFrame, shipments: DataFrame, scores: DataFrame, dims: DataFrame | None = None,
                   order_id: str = "order_id", ship_order: Sequence[str] = (), score_order: Sequence[str] = (),
                   dim_key: str = "merchant_id", ship_cols: Sequence[str] = (), score_cols: Sequence[str] = (),
                   ship_count: str | None = None, prior: DataFrame | None = None) -> DataFrame:
    """One row per order: latest shipment, latest risk score, combined flag.

    ``ship_cols`` and ``score_cols`` are carried besides the state and the flags, and
    ``ship_count`` names the number of an order's shipments. Latest rows are aggregates
    over only these columns, so both joins meet one narrow row per order. Orders of
    ``prior`` (an earlier state of the fact) that are not among ``orders`` are kept.
    """
    s = latest_per_key(shipments, [order_id], ship_order, ["status", *ship_cols])
    if ship_count:
        s = s.join(shipments.groupBy(order_id).agg(F.count("*").alias(ship_count)), order_id)
    r = latest_per_key(scores, [order_id], score_order, ["ml_flag", "rule_flag", "model_code", "experimentation", *score_cols])
    out = orders.join(s, order_id, "left").join(r, order_id, "left")
    if dims is not None:
        out = out.join(dims, dim_key, "left")
    ml, rule = F.col("ml_flag"), F.col("rule_flag")
    out = out.withColumn("result_flag", combined_flag(ml, rule)).withColumns({
        "status": F.coalesce("status", F.lit("not_shipped")),
        "ml_flag": F.coalesce(ml, F.lit("missing")),
        "rule_flag": F.coalesce(rule, F.lit("missing")),
        "model_code": F.coalesce("model_code", F.lit("none")),
        "experimentation": F.coalesce("experimentation", F.lit(False))})
    if prior is None:
        return out
    kept = prior.join(orders.select(order_id), order_id, "left_anti")
    return out.unionByName(kept.select(*out.columns))


def explode_experiments(events: DataFrame, arms: str, keys: Sequence[str]) -> DataFrame:
    """JSON map {experiment: value} -> one distinct row per key and experiment."""
    m = F.from_json(arms, "map<string,string>")
    return events.select(*keys, F.explode(m).alias("experiment_name", "experiment_value")).distinct()


def pivot_arms(exp: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """One row per checkout, one column per chosen experiment (its arm)."""
    wanted = exp.filter(F.col("experiment_name").isin(list(names)))
    return wanted.groupBy(key).agg(
        *[F.max(F.when(F.col("experiment_name") == n, F.col("experiment_value"))).alias(n) for n in names])


def experiment_metrics(exp: DataFrame, fact: DataFrame, pay: DataFrame, key: str, slices: Sequence[str]) -> DataFrame:
    """Renders, submits, payment attempts and successes by arm x slices.

    Payments are counted per checkout first, so the arm join multiplies
    checkouts by their experiments only, never by payments.
    """
    per_checkout = pay.groupBy(key).agg(
        F.count("*").alias("attempts"), F.sum(flag(F.col("success"))).alias("successes"))
    joined = exp.join(fact, key).join(per_checkout, key, "left")
    return joined.groupBy("experiment_name", "experiment_value", *slices).agg(
        F.sum("render").alias("renders"), F.sum("submit").alias("submits"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("payment_attempts"),
        F.coalesce(F.sum("successes"), F.lit(0)).alias("payment_success"))


def error_events(raw: DataFrame, names: Sequence[str]) -> DataFrame:
    """Extract of error / interaction events with the JSON fields analysts use."""
    return raw.filter(F.col("event_name").isin(list(names))).select(
        "event_name", "producer_created_date", "event_timestamp",
        json_text("context", "$.checkout_id").alias("checkout_id"),
        json_text("properties", "$.data.error.code", "$.data.code").alias("error_code"),
        json_text("properties", "$.data.error.description").alias("error_description"))
