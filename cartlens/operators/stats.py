"""Statistics: correlation, slope, association, histograms, trend shape, effect size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bands, col, first_match, flag, ratio
from ..functions.grouped import exact_quantiles, value_slot, with_totals
from ..functions.scan import chunked_scan


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation aggregate; NULL for a constant side instead of an error.

    Rows missing either value are left out of both spreads.
    """
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope of y on x; NULL when x does not vary."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xx, yy), F.var_pop(xx))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairs in one aggregate, as rows (a, b, corr)."""
    pairs = [(a, b) for a in cols for b in cols]
    one = df.agg(*[pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def chi_square(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Chi-square (without continuity correction) and Cramér's V per group.

    Uses chi2 = n (sum n_ij^2 / (r_i c_j) - 1) on the contingency table, whose
    margins are aggregated and joined back. V = sqrt(chi2 / (n v)), v the
    smaller of rows and columns less one; NULL for a one-row or one-column table.
    """
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("n"))
    d = with_totals(cells, [*by, x], {"row_n": F.sum("n")})
    d = with_totals(d, [*by, y], {"col_n": F.sum("n")}, source=cells)
    share = F.col("n").cast("double") * F.col("n") / (F.col("row_n").cast("double") * F.col("col_n"))
    out = d.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(share).alias("__s"),
        F.countDistinct(x).alias("__r"), F.countDistinct(y).alias("__c"))
    v = F.least("__r", "__c") - 1
    out = out.withColumn("chi2", F.when(v > 0, F.col("n") * F.greatest(F.col("__s") - 1, F.lit(0.0))))
    return out.withColumn("cramers_v", F.sqrt(ratio("chi2", F.col("n") * v))).drop("__s", "__r", "__c")


def feature_association(df: DataFrame, entity: str, features: Sequence[str], outcome: str) -> DataFrame:
    """Correlation, chi-square and Cramér's V of every feature with a 0/1 outcome,
    per entity. The features are laid out as rows, so one pass serves them all."""
    long = df.unpivot([entity, outcome], list(features), "feature", "x")
    keys = [entity, "feature"]
    corr = long.groupBy(*keys).agg(pearson("x", outcome).alias("corr"))
    assoc = chi_square(long, keys, "x", outcome)
    return corr.join(assoc, keys, "left")


def histogram(df: DataFrame, by: Sequence[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins [lo, hi); values outside are kept in bin 0 and bins + 1."""
    b = F.width_bucket(F.col(value).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    return df.filter(F.col(value).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """count, mean, std, min, max and exact quantiles, one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "measure", "v")
    long = long.filter(F.col("v").isNotNull())
    base = long.groupBy("measure").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    return base.join(exact_quantiles(long, ["measure"], "v", probs), "measure")


def cr_slope(df: DataFrame, value: str, converted: Column) -> DataFrame:
    """Conversion by exact value (one row per value)."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.sum(flag(converted)).alias("converted")).withColumn(
        "cr", ratio("converted", "n"))


def cohens_h(p1: Column, p2: Column) -> Column:
    return F.abs(2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2)))


def rows_to_reach(df: DataFrame, by: Sequence[str], amount: str, share: float, total: str = "__total") -> DataFrame:
    """How many rows, taken from the largest contribution down, stay within
    ``share`` of the group's total.

    Contributions are signed towards the total (a negative total turns them
    round). Equal contributions are one counted row; the running sum is cut into
    value slots, so one group with all rows is still spread over tasks. Amounts
    must be decimal: the sums are exact and the count does not depend on order.
    """
    signed = with_totals(df, by, {total: F.sum(amount), "rows_total": F.count("*")})
    signed = signed.withColumn("__a", F.when(F.col(total) < 0, -F.col(amount)).otherwise(F.col(amount)))
    level = signed.groupBy(*by, "__a").agg(
        F.count("*").alias("__n"), F.first(total).alias(total), F.first("rows_total").alias("rows_total"))
    level = level.withColumns({"__slot": value_slot("__a"), "__sum": F.col("__a") * F.col("__n")})
    scanned = chunked_scan(
        level, by, [F.col("__a").desc()], -F.col("__slot"),
        inner={"__in": lambda w: F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, 0))},
        summary={"__tot": F.sum("__sum")},
        carry={"__off": lambda w: F.sum("__tot").over(w.rowsBetween(Window.unboundedPreceding, -1))},
        result={"__upto": F.col("__in") + F.coalesce(F.col("__off"), F.lit(0))})
    limit = F.abs(F.col(total)) * F.lit(str(share)).cast("decimal(5,4)")
    before = F.col("__upto") - F.col("__sum")
    # Sorted towards the total, the running sum only falls back below the limit if
    # it never passed it, so levels at or below zero hold no counted row.
    fits = F.floor(F.try_divide(limit - before, F.col("__a")))
    some = F.when(F.col("__a") > 0, F.greatest(F.lit(0), F.least(F.col("__n"), fits))).otherwise(F.lit(0))
    return scanned.groupBy(*by).agg(F.sum(some.cast("bigint")).alias("rows_needed"), F.first("rows_total").alias("rows_total"))


def trend_shape(daily: DataFrame, entity: str, day_no: str, value: str, first: int = 7, last: int = 31,
                z_limit: float = 3.0) -> DataFrame:
    """Shape of a daily metric over days 1..last after go-live.

    Correlation uses the days whose |z| is below the limit, slopes use all days
    (value on day number): overall, the first days and the days after them. The
    label compares the signs of the early and the overall slope. An entity must
    have every day 1..last; at most ``last`` rows per entity, all aggregates.
    """
    d = daily.filter(F.col(day_no).between(1, last)).select(entity, day_no, F.col(value).cast("double").alias("v"))
    parts = {"": F.lit(True), "_first": F.col(day_no) <= first, "_after": F.col(day_no) > first}
    base = d.groupBy(entity).agg(
        F.count("v").alias("__days"),
        *[c.alias(n) for p, cond in parts.items() for n, c in {
            f"__m{p}": F.avg(F.when(cond, F.col("v"))), f"__s{p}": F.stddev_pop(F.when(cond, F.col("v")))}.items()])
    d = d.join(base.filter(F.col("__days") == last), entity)
    aggs = []
    for p, cond in parts.items():
        z = F.abs(ratio(F.col("v") - F.col(f"__m{p}"), F.col(f"__s{p}")))
        keep = cond & (z < z_limit)
        aggs.append(pearson(F.when(keep, F.col("v")), F.when(keep, F.col(day_no))).alias(f"corr{p}"))
        aggs.append(slope(F.when(cond, F.col("v")), F.when(cond, F.col(day_no))).alias(f"slope{p}"))
    out = d.groupBy(entity).agg(*aggs)
    early, whole = F.col("slope_first"), F.col("slope")
    return out.withColumn("category", first_match([
        ((early < 0) & (whole > 0), "Slope Increased after the first week"),
        ((early > 0) & (whole < 0), "Slope Decreased after the first week"),
        ((early > 0) & (whole > 0), "Trend stayed positive"),
        ((early < 0) & (whole < 0), "Trend stayed negative")], ""))


def quantile_tag(df: DataFrame, value: str, probs: Sequence[float], labels: Sequence[str], tag: str = "tag") -> DataFrame:
    """Label rows by where the value falls among exact quantiles of the column:
    below the first, between, at or above the last."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    # one scalar with all quantiles: the quantile run is planned once
    out = df.withColumn("__q", exact_quantiles(df, [], value, names).select(F.struct(*names)).scalar())
    rules = [(F.col(value) < F.col("__q")[n], lab) for n, lab in zip(names, labels)]
    return out.withColumn(tag, first_match(rules + [(F.col(value).isNotNull(), labels[-1])])).drop("__q")


def volume_buckets(df: DataFrame, volume: str, edges: Sequence[float], labels: Sequence[str], metric: str,
                   probs: Mapping[str, float]) -> DataFrame:
    """Entities per (a, b] volume bucket with the distribution of a metric."""
    d = df.withColumn("bucket", bands(volume, edges, labels, right_closed=True)).filter(F.col("bucket").isNotNull())
    n = d.groupBy("bucket").agg(F.count("*").alias("entities"), F.avg(metric).alias("mean"))
    return n.join(exact_quantiles(d, ["bucket"], metric, probs), "bucket", "left")
