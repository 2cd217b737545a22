"""Paths and timing inside a checkout, partner reports, leads and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bands, code_name, first_match, flag, json_text, ratio, sum_money
from ..functions.grouped import count_ids, exact_quantiles, latest_per_key, with_totals
from ..functions.scan import CHUNK, following, running, scan_all, time_chunk, with_next, with_ordinal
from .lookup import seconds_between


def delivery_latency(sms: DataFrame, message: str, template: str, ts: str, created: Column, received: Column,
                     probs: Mapping[str, float]) -> DataFrame:
    """Seconds from creation to the delivery report, exact percentiles per template.

    One aggregate per message instead of a lag; messages without a creation event
    (started before the range) have no latency and are only counted.
    """
    per = sms.groupBy(template, message).agg(
        F.min(F.when(created, F.col(ts))).alias("__c"), F.min(F.when(received, F.col(ts))).alias("__r"))
    per = per.filter(F.col("__r").isNotNull()).withColumn("latency", seconds_between("__c", "__r"))
    n = per.groupBy(template).agg(F.count("*").alias("messages"), F.count("latency").alias("with_latency"))
    return n.join(exact_quantiles(per, [template], "latency", probs), template, "left")


def delivery_rate(sms: DataFrame, by: str, message: str, status: str, values: Sequence[str], delivered: str,
                  at_least: int = 1) -> DataFrame:
    """Messages per delivery status, delivered share of all messages whatever their
    status; entities above a volume."""
    held = F.col(message).isNotNull()
    out = sms.groupBy(by).agg(*[F.sum(flag(held & (F.col(status) == v))).cast("bigint").alias(f"n_{v}") for v in values], F.count(message).alias("total"))
    return out.filter(F.col("total") >= at_least).withColumn("delivered_rate", ratio(f"n_{delivered}", "total"))


def journey_paths(events: DataFrame, checkout: str, ts: str, tie: str, event: str, chunk_seconds: int = 300) -> DataFrame:
    """Ordered events of a checkout as one text, e.g. 'view,click,purchase'.

    Pieces are put together per time chunk first, so a checkout with very many
    events is sorted in many tasks and only its text is joined at the end. An event without a checkout or a time has no place in a path and is left
    out. A path is one value: where a checkout may have millions of events, use ``journey_tree``.
    """
    d = events.filter(F.col(checkout).isNotNull() & F.col(ts).isNotNull()).withColumn(CHUNK, time_chunk(ts, chunk_seconds))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ts), F.col(tie), F.col(event).alias("e"))))
    piece = d.groupBy(checkout, CHUNK).agg(F.array_join(F.transform(ordered, lambda x: x["e"]), ",").alias("p"), F.count("*").alias("n"))
    pieces = F.array_sort(F.collect_list(F.struct(CHUNK, "p")))
    return piece.groupBy(checkout).agg(F.array_join(F.transform(pieces, lambda x: x["p"]), ",").alias("path"), F.sum("n").alias("steps"))


#: Seeds of the two hashes that name a node of the tree.
NODE_SEEDS = (1, 2)


def path_steps(events: DataFrame, checkout: str, ts: str, tie: str, event: str, chunk_seconds: int = 300) -> DataFrame:
    """(checkout, event, depth, node, parent, last) of every event that has a checkout and a time.

    ``node`` names the path up to the event, whatever the checkout: the exclusive or of hashes of (depth, event) over the path. So it can be carried from chunk to chunk like a
    sum, and the node before it is known without a look at the previous row. Two hashes of 64 bits make two paths with one name unlikely for 10^15 of them.
    """
    e = events.filter(F.col(checkout).isNotNull() & F.col(ts).isNotNull()).select(checkout, ts, tie, F.col(event).alias("event"))
    order, chunk = [F.col(ts), F.col(tie)], time_chunk(ts, chunk_seconds)
    placed = scan_all(e, [checkout], order, chunk, [running({"depth": F.lit(1)}), following([ts, tie], {"__next": ts})], once=True)
    own = [F.xxhash64(F.lit(s), "depth", "event") for s in NODE_SEEDS]
    named = scan_all(placed, [checkout], order, chunk, [running({f"__h{s}": h for s, h in zip(NODE_SEEDS, own)}, F.bit_xor, F.lit(0).cast("bigint"))], once=True)
    names = [F.col(f"__h{s}") for s in NODE_SEEDS]
    return named.select(checkout, "event", "depth", F.struct(*[n.alias(f"h{s}") for s, n in zip(NODE_SEEDS, names)]).alias("node"),
                        F.struct(*[n.bitwiseXOR(o).alias(f"h{s}") for s, n, o in zip(NODE_SEEDS, names, own)]).alias("parent"), F.col("__next").isNull().alias("last"))


def journey_tree(events: DataFrame, checkout: str, ts: str, tie: str, event: str, chunk_seconds: int = 300) -> DataFrame:
    """Paths of all checkouts as a prefix tree: a row for each node, with its ``parent`` (both names are 0, 0 at the root), ``depth``, ``event``, the number of
    ``checkouts`` whose path goes through it, and of those whose path ``ends`` there.

    The number of checkouts with a path is the ``ends`` of its node. No path is ever held as a whole: the rows are one for each event before the aggregate, which
    combines them in the map tasks, and a checkout with any number of events is spread over its chunks.
    """
    steps = path_steps(events, checkout, ts, tie, event, chunk_seconds)
    return steps.groupBy("node", "parent", "depth", "event").agg(F.count("*").alias("checkouts"), F.sum(flag(F.col("last"))).cast("bigint").alias("ends"))


def frequent_paths(events: DataFrame, checkout: str, ts: str, tie: str, event: str, at_least: int, chunk_seconds: int = 300) -> DataFrame:
    """(path, checkouts) of the paths that at least so many checkouts have from end to end.

    Paths are counted as nodes; only one checkout of each frequent node is written out as text.
    """
    steps = path_steps(events, checkout, ts, tie, event, chunk_seconds)
    ends = steps.filter("last").groupBy("node").agg(F.count("*").alias("checkouts"), F.min(checkout).alias(checkout)).filter(F.col("checkouts") >= at_least)
    shown = journey_paths(events.join(ends.select(checkout), checkout, "left_semi"), checkout, ts, tie, event, chunk_seconds)
    return ends.join(shown, checkout).select("path", "checkouts")


def event_positions(events: DataFrame, checkout: str, ts: str, tie: str, event: str, chunk_seconds: int = 300) -> DataFrame:
    """Checkouts and mean position per event; an event without checkout or time has no position."""
    d = with_ordinal(events.select(checkout, ts, tie, event), [checkout], [ts, tie], "__pos", time_chunk(ts, chunk_seconds))
    return d.groupBy(event).agg(F.countDistinct(checkout).alias("checkouts"), ratio(F.sum("__pos"), F.count("__pos")).alias("mean_position"))


def dwell_time(events: DataFrame, checkout: str, ts: str, tie: str, event: str, start: str, probs: Mapping[str, float],
               chunk_seconds: int = 300) -> DataFrame:
    """Seconds spent on a screen until the next different event of the checkout:
    next minus current, percentiles over all visits."""
    d = with_next(events.select(checkout, ts, tie, event), [checkout], [ts, tie], {"__e": event, "__t": ts}, time_chunk(ts, chunk_seconds))
    d = d.filter((F.col(event) == start) & (F.col("__e") != start)).withColumn("dwell", seconds_between(ts, "__t"))
    return exact_quantiles(d, [], "dwell", probs)


# Page-load bands in milliseconds and order-value bands
LOAD_EDGES = [0, 150, 500, 1000, 5000, 10000, 60000]
AOV_EDGES = [0, 500, 1000, 2000, 3500, 5000, 100000]


def conversion_by_band(fact: DataFrame, by: Sequence[Column], ident: str, reason: str) -> DataFrame:
    """Converted, not loaded, bounced and engaged-then-left shares per band."""
    per = fact.groupBy(*by, ident).agg(
        F.max(flag(F.col(reason) == "Summary Screen CTA clicked")).alias("c"),
        F.max(flag(F.col(reason) == "Summary Screen did not load")).alias("l"),
        F.max(flag(F.col(reason) == "Bounced w/o any interaction")).alias("b"))
    names = [c for c in per.columns if c not in (ident, "c", "l", "b")]
    g = per.groupBy(*names).agg(F.count("*").alias("total"), F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("b").alias("b"))
    return g.select(*names, "total", ratio("c", "total").alias("converted"), ratio("l", "total").alias("pre_load_dropoff"),
                    ratio("b", "total").alias("post_load_bounce"),
                    ratio(F.col("total") - F.col("c") - F.col("l") - F.col("b"), "total").alias("post_engagement_dropoff"))


def aov_profile(fact: DataFrame, entity: str, value: str, edges: Sequence[float], slice_col: str, ident: str, reason: str) -> DataFrame:
    """Conversion per entity band (by the entity's median order value) x slice."""
    median = exact_quantiles(fact, [entity], value, {"__median": 0.5})
    d = fact.join(median, entity).withColumn("entity_band", bands("__median", edges, right_closed=True))
    return conversion_by_band(d, ["entity_band", slice_col], ident, reason)


def partner_orders(orders: DataFrame, meta: DataFrame, pay: DataFrame, order_id: str = "order_id") -> DataFrame:
    """Orders with UTM, line-item count and paid amount, plus payments that have no
    order row in range; each order once.

    orders: order_id, receipt, in_range;  meta: order_id, value (JSON)
    pay: order_id, amount, success
    """
    paid = pay.filter("success").groupBy(order_id).agg(sum_money("amount").alias("order_gmv"))
    tags = ["source", "medium", "campaign"]
    m = meta.select(order_id, *[json_text("value", f"$.utm_parameters.utm_{u}").alias(f"utm_{u}") for u in tags],
                    F.json_array_length(F.get_json_object("value", "$.line_items")).alias("line_items"))
    met = orders.join(m, order_id, "left").join(paid, order_id, "full")
    out = met.filter(F.coalesce("in_range", F.lit(False)) | F.col("order_gmv").isNotNull()).select(
        order_id, "receipt", *[f"utm_{u}" for u in tags], "line_items", "order_gmv")
    return out.withColumns({"placed": flag(F.col("order_gmv").isNotNull()), "order_gmv": F.coalesce("order_gmv", F.lit(0.0))})


def partner_summary(report: DataFrame, by: Sequence[str] = ("utm_source", "utm_medium", "utm_campaign")) -> DataFrame:
    return report.groupBy(*by).agg(
        F.count("*").alias("checkout_initiations"), F.sum("placed").alias("orders_placed"), sum_money("order_gmv").alias("order_gmv"))


def partner_hourly(events: DataFrame, pay: DataFrame, entity: str, ts: str, as_of, hours: int, ident: str,
                   steps: Mapping[str, Column], pay_ts: str, order: str, pay_hours: int | None = None) -> DataFrame:
    """Partner KPIs of the last hours before ``as_of``."""
    recent = lambda c, h: (F.col(c) >= F.lit(as_of) - F.expr(f"INTERVAL {h} HOURS")) & (F.col(c) < F.lit(as_of))
    e = count_ids(events.filter(recent(ts, hours)), [entity], ident, steps)
    p = count_ids(pay.filter(recent(pay_ts, pay_hours or hours)), [entity], order, {
        "payments_initiated": F.lit(True), "orders_placed": F.col("success")})
    return e.join(p, entity, "left").na.fill(0, ["payments_initiated", "orders_placed"])


# Lead bands -> midpoint amount, go-live answer -> days, call status
POTENTIAL = {"<10000": 5000, "10000-50000": 30000, "50000 - 1 lakh": 75000, "1 lakh - 5 lakhs": 300000, "5 lakhs - 10 lakhs": 750000,
             "10 lakhs - 25 lakhs": 1750000, "25 lakhs - 50 lakhs": 3500000, "50 lakhs - 1 Cr": 7500000, "1 Cr - 5 Cr": 25000000, "5 Cr +": 50000000}
GO_LIVE_DAYS = {"Immediate": 0, "7 days": 7, "15 days": 15, "1 month": 30, "1 month - 2 month": 30, "2 month+": 60}
CALL_STATUS = {"Call later": "Call later", "Mtu done on call": "Interested", "Interested": "Interested", "Call dropped": "Call later",
               "Move to competion": "Move to competion", "Not interested": "Not interested", "call dropped": "Not interested",
               "Voice not clear": "Call later", "Others": "Interested", "RNR": "Call later", "Language different": "Language different",
               "Busy": "Call later"}


def lead_enrich(calls: DataFrame, scores: DataFrame, lead: str, day: str, first_txn: DataFrame, threshold: float = 55) -> DataFrame:
    """Latest call per lead (all calls of that date, as rank 1 gives), first call
    date, go-live date, potential, status, and the lead-score flag."""
    d = with_totals(calls, [lead], {"__last": F.max(day), "first_called": F.min(day)}).filter(F.col(day) == F.col("__last")).drop("__last")
    s = scores.groupBy(lead).agg(F.max(F.coalesce("gstin_score", F.lit(0)) + F.coalesce("domain_score", F.lit(0))).alias("score"))
    d = d.join(s, lead, "left").join(first_txn, lead, "left")
    txn, called = F.col("first_txn_date"), F.col("first_called")
    return d.withColumns({
        "go_live_date": F.date_add("first_called", code_name("go_live", GO_LIVE_DAYS)),
        "potential_amount": code_name("potential", POTENTIAL),
        "status_updated": F.coalesce(code_name("status", CALL_STATUS), F.col("status")),
        "activity": first_match([(txn >= called, "after_call"), (txn < called, "before_call"), (txn.isNull(), "none")], "other"),
        "lead_flag": F.when(F.col("score") >= threshold, "HQL").otherwise("Non-HQL")})


def touch_source(referrer: Column, own_sites: Sequence[str]) -> tuple[Column, Column]:
    """Medium and source of an untagged visit out of its referrer."""
    r = F.lower(referrer)
    own = r.isNull() | (r == "")
    for s in own_sites:
        own = own | r.contains(s)
    medium = F.when(own, "website").otherwise("organic")
    source = first_match([(own, "direct"), (r.contains("google"), "google"), (r.contains("bing"), "bing")], "others")
    return medium, source


#: The parts of a page event's documents that name where a visitor came from.
PAGE_CONTEXT = """struct<page: struct<referrer: string, url: string, title: string>, campaign: struct<medium: string, source: string, adgroup: string, name: string,
  content: string, term: string, matchtype: string, location: string, network: string, device: string, devicemodel: string>>"""
PAGE_PROPERTIES = "struct<url: string, title: string>"
# Columns of a touch and the campaign fields that they hold.
CAMPAIGN = {"acquisition_adgroup": "adgroup", "acquisition_campaign": "name", "acquisition_content": "content", "acquisition_keyword": "term", "campaign_matchtype": "matchtype",
            "campaign_location": "location", "campaign_network": "network", "campaign_device": "device", "campaign_devicemodel": "devicemodel"}
TOUCH = ["acquisition_medium", "acquisition_source", *CAMPAIGN, "landing_page"]


def acquisition_visits(pages: DataFrame, person: str, ts: str, ident: str, own_sites: Sequence[str]) -> DataFrame:
    """Page events with ``context`` and ``properties`` (JSON texts) as touches: medium and source of the campaign, or else of the referrer, the
    other campaign fields and the landing page. Visits without a person or a time are no touches."""
    d = pages.filter(F.col(person).isNotNull() & F.col(ts).isNotNull()).select(
        person, ts, ident, F.from_json("context", PAGE_CONTEXT).alias("c"), F.from_json("properties", PAGE_PROPERTIES).alias("p"))
    medium, source = touch_source(F.col("c.page.referrer"), own_sites)
    return d.select(person, ts, ident, F.coalesce("c.campaign.medium", medium).alias("acquisition_medium"), F.coalesce("c.campaign.source", source).alias("acquisition_source"),
                    *[F.col(f"c.campaign.{f}").alias(n) for n, f in CAMPAIGN.items()],
                    F.coalesce("c.page.url", "p.url", "p.title", "c.page.title").alias("landing_page"))


def risk_journey(starts: DataFrame, responses: DataFrame, saves: DataFrame, methods: DataFrame, submits: DataFrame, key: str, ts: str,
                 tie: str, by: Sequence[str]) -> DataFrame:
    """Checkouts by risk response x address saved x chosen x submitted method.
    Responses and saves: latest per checkout; methods: each one counts once."""
    r = latest_per_key(responses, [key], [ts, tie], ["response"]).select(key, "response")
    s = latest_per_key(saves, [key], [ts, tie], ["address_saved"]).select(key, "address_saved")
    d = starts.select(key, *by).distinct().join(r, key).join(s, key)
    d = d.join(methods.select(key, "method").distinct(), key, "left").join(submits.select(key, "method_submit").distinct(), key, "left")
    return d.groupBy(*by, "response", "address_saved", "method", "method_submit").agg(F.countDistinct(key).alias("checkouts"))


def cohort_sample(fact: DataFrame, scores: DataFrame, events: DataFrame, key: str, conditions: Column, event_filter: Column,
                  columns: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """Checkouts that meet several conditions, with score and event values; a sample
    of n rows in a fixed order is the feature."""
    chosen = fact.filter(conditions).select(key).join(scores, key).distinct()
    return events.filter(event_filter).join(chosen, key).select(*columns).distinct().orderBy(*order).limit(n)


def select_tickets(tickets: DataFrame, ident: str, revision: Sequence[str], transaction_ids: Sequence[str], keep: Column,
                   blanks: Sequence[str] = ("", "undefined", "nan", "na")) -> DataFrame:
    """Latest revision of each ticket in scope, with its first known transaction id."""
    d = latest_per_key(tickets, [ident], revision).filter(keep)
    d = d.withColumn("transaction_id", F.coalesce(*transaction_ids))
    return d.filter(F.col("transaction_id").isNotNull() & ~F.col("transaction_id").isin(list(blanks)))


