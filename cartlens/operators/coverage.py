"""Rollout coverage, overlaps, ineligibility reasons, score variants."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import contains_any, ratio


def coverage_flags(active: DataFrame, eligible: DataFrame, ineligible: DataFrame, ramp: DataFrame, entity: str) -> DataFrame:
    """Active entities with eligible / ineligible marks, ramp status and the flags on them."""
    mark = lambda d, n: d.select(entity).distinct().withColumn(n, F.lit(True))
    d = active.join(mark(eligible, "eligible"), entity, "left").join(mark(ineligible, "not_eligible"), entity, "left")
    d = d.join(ramp.select(entity, "status"), entity, "left")
    el, no, live = F.coalesce("eligible", F.lit(False)), F.coalesce("not_eligible", F.lit(False)), F.coalesce(F.col("status") == "live", F.lit(False))
    return d.withColumns({
        "both_eligible_and_ineligible": el & no, "not_received_call": ~el & ~no, "eligible_and_live": el & live,
        "eligible_and_not_live": el & ~live, "all_ineligible": no & ~el})


def coverage(flags: DataFrame, by: Sequence[str], entity: str) -> DataFrame:
    """Entities per combination (unknown values kept) and percent of all entities."""
    n = flags.select(*by, entity).distinct().groupBy(*by).agg(F.count("*").alias("entities"))
    whole = flags.select(F.countDistinct(entity).alias("n"))
    return n.withColumn("percentage", ratio("entities", whole.scalar()) * 100)


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of both, only left, only right and union of two key sets, in one pass."""
    both = a.select(key).withColumn("l", F.lit(1)).withColumn("r", F.lit(0)).unionByName(
        b.select(key).withColumn("l", F.lit(0)).withColumn("r", F.lit(1)))
    k = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return k.agg(F.sum(F.col("l") * F.col("r")).alias("in_both"), F.sum(F.col("l") * (1 - F.col("r"))).alias("only_left"),
                 F.sum((1 - F.col("l")) * F.col("r")).alias("only_right"), F.count("*").alias("in_any"))


def ineligible_reasons(df: DataFrame, entity: str, reason: str, unblocked: Sequence[str]) -> DataFrame:
    """All reasons of an entity as one ordered text and whether one of them has
    since been lifted. The set of reasons is bounded by the reason codes."""
    d = df.filter(F.col(reason).isNotNull() & (F.col(reason) != ""))
    out = d.groupBy(entity).agg(F.array_join(F.sort_array(F.collect_set(reason)), ", ").alias("reasons"))
    return out.withColumn("eligible_now", contains_any("reasons", unblocked))


def entities_per_reason(df: DataFrame, entity: str, reason: str) -> DataFrame:
    d = df.filter(F.col(reason).isNotNull() & (F.col(reason) != ""))
    return d.groupBy(reason).agg(F.countDistinct(entity).alias("entities"))


def rampup_cumulative(sheet: DataFrame, entity: str, day: str, blocked: Column) -> DataFrame:
    """Entities ramped up per day and so far (one row per calendar day)."""
    g = sheet.filter(~blocked).groupBy(day).agg(F.countDistinct(entity).alias("entities"))
    return g.withColumn("ramped_up", F.sum("entities").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)))


def null_variants(df: DataFrame, cols: Sequence[str], k: int, tag: str = "variant") -> DataFrame:
    """Every row as it is ('base') and once per 1..k columns blanked, tagged with
    the columns. The masks are a literal array exploded per row: no join."""
    masks = [("base", ())] + [("_".join(c) + "_null", c) for n in range(1, k + 1) for c in combinations(cols, n)]
    m = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(x) for x in c]).cast("array<string>").alias("cols")) for name, c in masks]))
    d = df.withColumn("__m", m)
    blank = {c: F.when(F.array_contains(F.col("__m.cols"), c), F.lit("")).otherwise(F.col(c).cast("string")) for c in cols}
    return d.withColumns(blank).withColumn(tag, F.col("__m.name")).drop("__m")


def score_pivot(scores: DataFrame, ident: str, variants: Sequence[str], tag: str = "variant", score: str = "score") -> DataFrame:
    """One row per id, its score under every variant side by side."""
    p = scores.groupBy(ident).pivot(tag, list(variants)).agg(F.max(score))
    return p.select(ident, *[F.col(f"`{v}`").alias(f"score_{v}") for v in variants])
