"""Joins with time: touches before a sign-up, last seen dates, effective dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import epoch_micros
from ..functions.scan import backwards, chunked_scan, chunks_backwards, last_before, time_chunk, with_running_sum

DAY = 86_400


def touch_attribution(signups: DataFrame, visits: DataFrame, key: str, signup_id: str, signup_ts: str, visit_ts: str,
                      visit_id: str, take: Sequence[str], days: int = 60, chunk_seconds: int = 600) -> DataFrame:
    """First and last touch of each sign-up: before it, and at most ``days`` whole days
    before it (a visit 60 days and 23 hours back is 60 whole days back).

    Window starts, sign-ups and visits lie on one time axis per person. Carried
    forward, a sign-up sees its last visit; carried backward, a window start sees its
    first one. A person with many visits and sign-ups costs rows, not pairs. All
    last-touch columns come from the last-touch row. Sign-ups without a person or time have no touch.
    """
    cols = [visit_ts, visit_id, *take]
    # the first instant that is fewer than days + 1 whole days back
    start = F.col(signup_ts) - F.expr(f"INTERVAL {days + 1} DAYS") + F.expr("INTERVAL 1 MICROSECOND")
    point = lambda kind, t: F.struct(F.lit(kind).alias("__kind"), t.alias("__t"))
    s = signups.select(key, signup_id, F.col(signup_ts).alias("__s"), start.alias("__from"),
                       F.inline(F.array(point(0, start), point(1, F.col(signup_ts)))))
    v = visits.select(key, F.lit(2).alias("__kind"), F.col(visit_ts).alias("__t"), F.struct(*cols).alias("__v"), F.col(visit_id).alias("__tie"))
    axis = s.unionByName(v, allowMissingColumns=True)
    is_visit, when = F.col("__kind") == 2, F.struct("__t", "__tie")
    # ascending: a sign-up comes before visits at its own instant; descending: a
    # window start comes after them
    backward = backwards([key], [F.col("__t").desc(), F.when(is_visit, 0).otherwise(1), F.col("__tie").desc()])
    upto = (Window.unboundedPreceding, Window.currentRow)
    earlier = (Window.unboundedPreceding, -1)
    out = chunked_scan(
        axis, [key], [F.col("__t"), F.when(is_visit, 1).otherwise(0), F.col("__tie")], time_chunk("__t", chunk_seconds),
        inner={"__l": lambda w: F.last("__v", ignorenulls=True).over(w.rowsBetween(*upto)),
               "__f": lambda w: F.last("__v", ignorenulls=True).over(backward.rowsBetween(*upto))},
        summary={"__lv": F.max_by("__v", F.when(is_visit, when)), "__fv": F.min_by("__v", F.when(is_visit, when))},
        carry={"__lc": lambda w: F.last("__lv", ignorenulls=True).over(w.rowsBetween(*earlier)),
               "__fc": lambda w: F.last("__fv", ignorenulls=True).over(chunks_backwards([key]).rowsBetween(*earlier))},
        result={"__last": F.coalesce(F.col("__l"), F.col("__lc")), "__first": F.coalesce(F.col("__f"), F.col("__fc"))})
    out = out.filter(~is_visit)
    last = F.when((F.col("__kind") == 1) & (F.col("__last")[visit_ts] >= F.col("__from")), F.col("__last"))
    first = F.when((F.col("__kind") == 0) & (F.col("__first")[visit_ts] < F.col("__s")), F.col("__first"))
    got = out.groupBy(key, signup_id).agg(F.max(first).alias("__f"), F.max(last).alias("__l"))
    return got.select(key, signup_id, *[F.col("__f")[c].alias(f"first_{c}") for c in cols], *[F.col("__l")[c].alias(f"last_{c}") for c in cols])


def touches_in_window(signups: DataFrame, visits: DataFrame, key: str, signup_id: str, signup_ts: str, visit_ts: str,
                      days: int = 60, chunk_seconds: int = 600) -> DataFrame:
    """Number of visits before each sign-up and at most ``days`` whole days before it: the
    running visit count at the sign-up less the one at its window start, no pairs.
    Sign-ups without a person or time have none."""
    start = F.col(signup_ts) - F.expr(f"INTERVAL {days + 1} DAYS") + F.expr("INTERVAL 1 MICROSECOND")
    point = lambda sign, t: F.struct(F.lit(sign).alias("__sign"), t.alias("__t"))
    s = signups.select(key, F.col(signup_id), F.inline(F.array(point(-1, start), point(1, F.col(signup_ts)))), F.lit(0).alias("__visit"))
    v = visits.select(key, F.col(visit_ts).alias("__t"), F.lit(1).alias("__visit"))
    axis = s.unionByName(v, allowMissingColumns=True)
    # points come before visits at the same instant: both bounds count visits strictly before them
    seen = with_running_sum(axis, [key], ["__t", "__visit"], {"__n": F.col("__visit")}, time_chunk("__t", chunk_seconds))
    return seen.filter("__visit = 0").groupBy(key, signup_id).agg(F.coalesce(F.sum(F.col("__n") * F.col("__sign")), F.lit(0)).alias("touches"))


def last_seen_by_channel(anchors: DataFrame, seen: DataFrame, key: str, anchor: str, seen_date: str, channel: str,
                         channels: Sequence[str], chunk_days: int = 1) -> DataFrame:
    """Per anchor row and channel: the last date strictly before the anchor date.

    Sightings are reduced to distinct (key, channel, date) and carried forward
    as one date column per channel on the key's calendar, so nothing is paired.
    """
    days = seen.groupBy(key, seen_date).pivot(channel, list(channels)).agg(F.max(seen_date))
    return last_before(anchors, days, [key], anchor, seen_date, {f"last_{c}": c for c in channels}, chunk_days * DAY, independent=True)


def days_since_last(df: DataFrame, date_cols: Sequence[str], anchor: str) -> DataFrame:
    """Latest of several dates that lies before the anchor, and the days since."""
    before = F.filter(F.array(*[F.col(c) for c in date_cols]), lambda d: d < F.col(anchor))
    latest = F.array_max(before)
    return df.withColumn("last_login", latest).withColumn("days_since", F.datediff(F.col(anchor), latest))


def effective_from(facts: DataFrame, dim: DataFrame, key: str, fact_date: str, start: str, how: str = "inner") -> DataFrame:
    """Facts dated on or after their dimension row's start date. The dimension
    has one row per key; Spark broadcasts it when its measured size allows."""
    d = dim.withColumnRenamed(key, "__k")
    cond = (F.col(key) == F.col("__k")) & (F.col(fact_date) >= F.col(start))
    return facts.join(d, cond, how).drop("__k")


def post_ramp(events: DataFrame, ramp: DataFrame, key: str, day: str, ramp_date: str, fully: Column, blocked: Column) -> DataFrame:
    """Events of an entity after its ramp date; fully ramped and blocked entities are left out."""
    live = ramp.filter(~F.coalesce(fully, F.lit(False)) & ~F.coalesce(blocked, F.lit(False))).select(key, ramp_date)
    return effective_from(events, live, key, day, ramp_date).filter(F.col(day) > F.col(ramp_date))


def null_matching_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which NULL keys match each other."""
    r = right
    cond = F.lit(True)
    for c in on:
        r = r.withColumnRenamed(c, f"__r_{c}")
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in on])


def seconds_between(a: str, b: str) -> Column:
    return (epoch_micros(b) - epoch_micros(a)) / 1_000_000
