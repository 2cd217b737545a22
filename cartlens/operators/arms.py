"""A/B comparisons: arm KPIs, slices, split checks, error mix, effect size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag, ratio
from ..functions.grouped import pivot_sum, with_report_totals
from .stats import cohens_h

KPIS = ["split_pct", "modal_cr", "modified_modal_cr", "success_rate", "submit_to_attempt", "overall_cr"]


def attempts_per_checkout(attempts: DataFrame, checkout: str, attempt: str, success: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct attempts and successes per checkout (and attempt slice).

    Rows are first reduced to attempts, which spreads a checkout with very many
    rows, then to checkouts with map-side sums.
    """
    per_attempt = attempts.groupBy(checkout, *by, attempt).agg(F.max(flag(F.col(success))).alias("__ok"))
    return per_attempt.groupBy(checkout, *by).agg(F.count(attempt).alias("__att"), F.sum("__ok").alias("__ok"))


def l0_metrics(checkouts: DataFrame, attempts: DataFrame, arm: str, by: Sequence[str] = (), attempt_by: Sequence[str] = (),
               checkout: str = "checkout_id", merchant: str = "merchant_id", submitted: str = "submitted",
               attempt: str = "attempt_id", success: str = "success") -> DataFrame:
    """Arm KPIs: distinct checkouts, merchants, submits, attempts, successes and the
    rates between them, by checkout slices (``by``) and attempt slices
    (``attempt_by``; checkouts without an attempt show under NULL there).

    ``checkouts`` has one row per checkout. Seven distinct counts would expand every
    joined row seven times; here attempts are reduced per checkout before the join,
    so the counts are plain sums and only the merchant count stays a distinct.
    """
    a = attempts_per_checkout(attempts, checkout, attempt, success, attempt_by)
    d = checkouts.select(checkout, merchant, submitted, arm, *by).join(a, checkout, "left")
    att, ok, sub = F.coalesce("__att", F.lit(0)), F.coalesce("__ok", F.lit(0)), F.col(submitted) == 1
    out = d.groupBy(*by, *attempt_by, arm).agg(
        F.count("*").alias("checkouts"), F.countDistinct(merchant).alias("merchants"),
        F.sum(flag(sub)).alias("submits"), F.sum(att).alias("attempts"), F.sum(ok).alias("successes"),
        F.sum(flag(att > 0)).alias("attempt_checkouts"), F.sum(flag(ok > 0)).alias("paid_checkouts"),
        # a checkout that reached payment has submitted even when the event is missing
        F.sum(flag(sub | (att > 0))).alias("modified_submits"))
    out = with_report_totals(out, [], {"__all": F.sum("checkouts")})
    return out.withColumns({
        "split_pct": ratio("checkouts", "__all"),
        "modal_cr": ratio("submits", "checkouts"),
        "modified_modal_cr": ratio("modified_submits", "checkouts"),
        "success_rate": ratio("successes", "attempts"),
        "submit_to_attempt": ratio("attempts", "submits"),
        "overall_cr": ratio("paid_checkouts", "checkouts")}).drop("__all")


def l0_compare(metrics: DataFrame, by: Sequence[str], arm: str, arms: Sequence[str],
               counts: Sequence[str] = ("checkouts", "attempts", "successes"),
               rates: Sequence[str] = ("modal_cr", "success_rate", "submit_to_attempt", "overall_cr")) -> DataFrame:
    """Arm KPIs side by side per slice, with last arm minus first arm per rate."""
    out = pivot_sum(metrics, by, arm, arms, {c: F.max(c) for c in [*counts, *rates]})
    a, b = arms[0], arms[-1]
    return out.withColumns({f"{r}_diff": F.col(f"{r}_{b}") - F.col(f"{r}_{a}") for r in rates})


def balanced_entities(df: DataFrame, arm: str, entity: str, arms: Sequence[str], ident: str) -> DataFrame:
    """Entities whose traffic is in every arm; an arm with 0 or 100 % is contaminated."""
    per_id = df.filter(F.col(arm).isin(list(arms))).select(entity, arm, ident).distinct()
    split = pivot_sum(per_id, [entity], arm, arms, {"n": F.count(ident)})
    n = [F.coalesce(F.col(f"n_{a}"), F.lit(0)) for a in arms]
    total = n[0]
    for c in n[1:]:
        total = total + c
    split = split.select(entity, total.alias("total"), *[ratio(c * 100, total).alias(f"pct_{a}") for a, c in zip(arms, n)])
    keep = F.lit(True)
    for a in arms:
        keep = keep & (F.col(f"pct_{a}") > 0) & (F.col(f"pct_{a}") < 100)
    return split.filter(keep)


def only_balanced(df: DataFrame, arm: str, entity: str, arms: Sequence[str], ident: str) -> DataFrame:
    return df.join(balanced_entities(df, arm, entity, arms, ident).select(entity), entity, "left_semi")


def split_check(df: DataFrame, arm: str, eligible: str, ident: str) -> DataFrame:
    """Ids by arm x eligibility, unknown arms as 'NA', with the share of all."""
    arm_c = F.coalesce(F.col(arm), F.lit("NA")).alias(arm)
    el = F.coalesce(F.col(eligible).cast("string"), F.lit("NA")).alias(eligible)
    n = df.select(arm_c, el, ident).distinct().groupBy(arm, eligible).agg(F.count(ident).alias("ids"))
    return with_report_totals(n, [], {"all_ids": F.sum("ids")}).withColumn("share", ratio("ids", "all_ids"))


def error_mix(df: DataFrame, by: Sequence[str], arm: str, arms: Sequence[str], ident: str) -> DataFrame:
    """Attempts per gateway x error in each arm, share within the arm, share shift."""
    n = df.select(*by, arm, ident).distinct().groupBy(*by, arm).agg(F.count(ident).alias("n"))
    n = with_report_totals(n, [arm], {"arm_n": F.sum("n")}).withColumn("share", ratio("n", "arm_n"))
    out = pivot_sum(n, by, arm, arms, {"n": F.sum("n"), "share": F.sum("share")})
    a, b = arms[0], arms[-1]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.withColumn("share_diff", zero(f"share_{b}") - zero(f"share_{a}"))


def submit_attempt_ratio(checkouts: DataFrame, attempts: DataFrame, checkout: str, submitted: str, attempt: str, success: str) -> DataFrame:
    """Distribution of payment attempts over submitted checkouts, by attempt count."""
    a = attempts_per_checkout(attempts, checkout, attempt, success)
    d = checkouts.filter(F.col(submitted) == 1).select(checkout).join(a, checkout, "left")
    n = d.groupBy(F.coalesce("__att", F.lit(0)).alias("attempts")).agg(F.count("*").alias("checkouts"))
    return with_report_totals(n, [], {"__all": F.sum("checkouts")}).select(
        "attempts", "checkouts", ratio("checkouts", "__all").alias("share"))


def effect_size(df: DataFrame, arm: str, arms: Sequence[str], by: Sequence[str], base: str, converted: str) -> DataFrame:
    """Cohen's h between two arms per entity, for entities that have both."""
    n = pivot_sum(df, by, arm, arms, {"n": F.sum(base), "x": F.sum(converted)})
    a, b = arms
    n = n.filter(F.col(f"n_{a}").isNotNull() & F.col(f"n_{b}").isNotNull())
    n = n.withColumns({f"p_{v}": ratio(f"x_{v}", f"n_{v}") for v in arms})
    return n.withColumn("h", cohens_h(F.col(f"p_{a}"), F.col(f"p_{b}")))


def arm_cross(df: DataFrame, arm_a: str, arm_b: str, by: Sequence[str], opened: str, paid: str) -> DataFrame:
    """Conversion of every pair of arms of two experiments."""
    return df.groupBy(*by, arm_a, arm_b).agg(F.sum(opened).alias("opens"), F.sum(paid).alias("paid")).withColumn(
        "cr", ratio("paid", "opens"))


def method_share_by_arm(df: DataFrame, entity: str, arm: str, is_method: Column) -> DataFrame:
    """Share of one payment method among the attempts of an entity and arm."""
    return df.groupBy(entity, arm).agg(
        F.count("*").alias("attempts"), F.sum(flag(is_method)).alias("method_attempts")).withColumn(
        "method_share", ratio("method_attempts", "attempts"))


def ineligible_sessions(df: DataFrame, eligible: Column, reason: str, ident: str) -> DataFrame:
    """Reasons of sessions that are not eligible or unknown, with the share."""
    bad = df.filter(~F.coalesce(eligible, F.lit(False))).select(
        F.coalesce(reason, F.lit("NA")).alias("reason"), ident).distinct()
    n = bad.groupBy("reason").agg(F.count("*").alias("sessions"))
    return with_report_totals(n, [], {"__all": F.sum("sessions")}).select("reason", "sessions", ratio("sessions", "__all").alias("share"))


def effective_arm(assigned: Column, flow_seen: Column, changed: Column, test: str) -> Column:
    """What a checkout of the test variant really experienced, by the flow it saw and
    whether the buyer changed the method. Rows of other variants, and rows of which
    the flow is not known, keep the assigned value."""
    in_test = assigned == test
    return (F.when(in_test & flow_seen & changed, "test_change_method_clicked").when(in_test & flow_seen, "test")
            .when(in_test & ~flow_seen & changed, "control_change_method_clicked").when(in_test & ~flow_seen, "control").otherwise(assigned))


def variant_cr(df: DataFrame, variant: str, slices: Mapping[str, Column], opened: str, paid: str,
               pre: DataFrame | None = None, pre_label: str = "pre") -> DataFrame:
    """Conversion by variant and by variant x each slice, stacked as rows
    (slice, value); an optional pre-period is stacked as its own variant."""
    cols = df.columns
    both = df if pre is None else df.unionByName(pre.withColumn(variant, F.lit(pre_label)).select(*cols))
    # reduce to slice columns first, so the stacking multiplies groups, not rows
    base = both.groupBy(variant, *[c.alias(f"__{n}") for n, c in slices.items()]).agg(
        F.sum(opened).alias("opens"), F.sum(paid).alias("paid"))
    sets = F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *[
        F.struct(F.lit(n).alias("slice"), F.col(f"__{n}").cast("string").alias("value")) for n in slices])
    return base.select(variant, "opens", "paid", F.inline(sets)).groupBy(variant, "slice", "value").agg(
        F.sum("opens").alias("opens"), F.sum("paid").alias("paid")).withColumn("cr", ratio("paid", "opens"))
