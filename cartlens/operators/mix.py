"""Why a conversion rate moved: mix, rate and volume decompositions."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_FLOOR, Decimal
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..functions.grouped import pivot_sum, with_report_totals, with_totals
from ..session import scratch_dir
from .stats import rows_to_reach

#: Subsets of dimensions that one job of the search groups the leaf table by.
SETS_PER_JOB = 64


def leaf_table(df: DataFrame, dims: Sequence[str], period: str, pre: str, post: str, opens: str, submits: str) -> DataFrame:
    """One row per combination of the dimensions: opens and submits of both periods."""
    t = pivot_sum(df, dims, period, [pre, post], {"open": F.sum(opens), "submit": F.sum(submits)})
    names = {f"open_{pre}": "open_pre", f"open_{post}": "open_post", f"submit_{pre}": "submit_pre", f"submit_{post}": "submit_post"}
    return t.select(*dims, *[F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in names.items()])


def mix_decompose(leaf: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Conversion change split into one mix impact per dimension, taken in the
    given order, and a pure conversion impact.

    For level i let pre_i, post_i be the opens of the leaf's prefix (d1..di). The
    opens a leaf would have with the first i shares moved to the new period are
    N_pre post_i/N_post pre/pre_i. A leaf without old opens has none until the
    first level whose prefix is also empty, then N_pre post/N_post. The mix
    impact of a level is the change of these opens at the old rate. Summed over
    leaves, all impacts add up to the rate change. Prefix sums are aggregates
    joined back, so a prefix holding most leaves needs no single task.
    """
    d = leaf
    for i in range(1, len(dims)):
        d = with_totals(d, list(dims[:i]), {f"__pre{i}": F.sum("open_pre"), f"__post{i}": F.sum("open_post")}, source=leaf)
    n = len(dims)
    d = with_totals(d, [], {"__npre": F.sum("open_pre"), "__npost": F.sum("open_post")}, source=leaf)
    dbl = lambda c: F.col(c).cast("double")
    npre, npost, pre, post = dbl("__npre"), dbl("__npost"), dbl("open_pre"), dbl("open_post")
    cr_pre = F.coalesce(ratio("submit_pre", "open_pre"), F.lit(0.0))
    cr_post = F.coalesce(ratio("submit_post", "open_post"), F.lit(0.0))
    opens = [pre]
    for i in range(1, n + 1):
        pre_i, post_i = (dbl(f"__pre{i}"), dbl(f"__post{i}")) if i < n else (pre, post)
        opens.append(F.when(pre > 0, F.try_divide(npre * post_i, npost) * F.try_divide(pre, pre_i))
                     .when(pre_i > 0, 0.0).otherwise(F.try_divide(npre * post, npost)))
    cols = [F.try_divide((b - a) * cr_pre, npre).alias(f"{dim}_impact") for dim, a, b in zip(dims, opens, opens[1:])]
    return d.select(
        *leaf.columns, cr_pre.alias("cr_pre"), cr_post.alias("cr_post"),
        F.try_divide(pre, npre).alias("share_pre"), F.try_divide(post, npost).alias("share_post"),
        opens[-1].alias("mix_opens"), *cols,
        F.try_divide((cr_post - cr_pre) * opens[-1], npre).alias("conversion_impact"))


def mix_summary(parts: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row per step: starting rate, impact of each dimension, conversion
    impact, final rate."""
    s = parts.agg(
        ratio(F.sum("submit_pre"), F.sum("open_pre")).alias("pre"), ratio(F.sum("submit_post"), F.sum("open_post")).alias("post"),
        *[F.sum(f"{d}_impact").alias(f"{d}_impact") for d in dims], F.sum("conversion_impact").alias("conversion_impact"))
    rows = [F.struct(F.lit(0).alias("step"), F.lit("Pre_CR").alias("feature"), F.col("pre").alias("impact"))]
    for i, d in enumerate(dims):
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(d).alias("feature"), F.col(f"{d}_impact").alias("impact")))
    rows.append(F.struct(F.lit(len(dims) + 1).alias("step"), F.lit("conversion").alias("feature"), F.col("conversion_impact").alias("impact")))
    rows.append(F.struct(F.lit(len(dims) + 2).alias("step"), F.lit("Post_CR").alias("feature"), F.col("post").alias("impact")))
    return s.select(F.inline(F.array(*rows)))


def feature_impact(parts: DataFrame, feature: str) -> DataFrame:
    """Mix impact of one dimension's values with old and new volumes and rates."""
    return parts.groupBy(feature).agg(
        F.sum(f"{feature}_impact").alias("volume_impact"), F.sum("conversion_impact").alias("conversion_impact"),
        F.sum("share_pre").alias("share_pre"), F.sum("share_post").alias("share_post"),
        ratio(F.sum("submit_pre"), F.sum("open_pre")).alias("cr_pre"),
        ratio(F.sum("submit_post"), F.sum("open_post")).alias("cr_post"))


def explain_impact(parts: DataFrame, dims: Sequence[str], share: float = 0.8, impact: str = "conversion_impact") -> DataFrame:
    """For every subset of dimensions: how many of its rows, largest first in the
    direction of the total, stay within the share of the impact.

    All subsets come from one cube over the leaf table. Kept are subsets that
    need more than one row and not all of them; a small weight (rows needed x
    share of rows) marks a compact explanation. The cube has 2^n subsets of n
    dimensions; ``search_explanations`` finds the short ones among many.
    """
    exact = parts.withColumn("__i", F.round(impact, 12).cast("decimal(24,12)"))
    rows = exact.cube(*dims).agg(F.sum("__i").alias("__i"), F.grouping_id().alias("__set"))
    rows = rows.filter(F.col("__set") != 2 ** len(dims) - 1)
    need = rows_to_reach(rows.select("__set", "__i"), ["__set"], "__i", share)
    names = {}
    for k in range(1, len(dims) + 1):
        for sub in combinations(range(len(dims)), k):
            code = sum(1 << (len(dims) - 1 - i) for i in range(len(dims)) if i not in sub)
            names[code] = "+".join(dims[i] for i in sub)
    label = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("__set").cast("int"))
    out = need.select(label.alias("features"), "rows_needed", "rows_total", ratio("rows_needed", "rows_total").alias("share_needed"))
    out = out.withColumn("weight", F.col("rows_needed") * F.col("share_needed"))
    return out.filter(~F.col("rows_needed").isin(0, 1) & (F.col("share_needed") != 1))


def _rows_of_sets(leaf: DataFrame, dims: Sequence[str], sets: Sequence[tuple[int, ...]], most: int, target: Decimal) -> dict[tuple[int, ...], tuple[int, int, int]]:
    """Of each set of dimensions: its rows, its largest rows that stay within the
    target, and how many rows any finer set needs at least; the last two are
    counted up to ``most`` + 1."""
    code = {sum(1 << (len(dims) - 1 - i) for i in range(len(dims)) if i not in s): s for s in sets}
    rows = leaf.groupingSets([[F.col(dims[i]) for i in s] for s in sets], *dims).agg(
        F.sum("__gain").alias("__gain"), F.sum("__reach").alias("__reach"), F.grouping_id().alias("__set"))
    totals = rows.groupBy("__set").agg(F.count("*").alias("n"))
    both = rows.select("__set", F.inline(F.array(
        F.struct(F.lit(False).alias("reach"), F.col("__gain").alias("v")), F.struct(F.lit(True).alias("reach"), F.col("__reach").alias("v"))))).filter("v > 0")
    # Each task hands on the largest rows of a set only, so the running sums below see few.
    largest = Window.partitionBy("__set", "reach").orderBy(F.desc("v"))
    top = both.withColumn("nth", F.row_number().over(largest)).filter(F.col("nth") <= most + 1)
    within = top.withColumn("upto", F.sum("v").over(largest.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") <= F.lit(target))
    counts = within.groupBy("__set").agg(F.count_if(~F.col("reach")).alias("need"), F.count_if("reach").alias("floor"))
    return {code[r["__set"]]: (r["n"], r["need"] or 0, r["floor"] or 0) for r in totals.join(counts, "__set", "left").collect()}


def search_explanations(parts: DataFrame, dims: Sequence[str], most: int = 10, share: float = 0.8, impact: str = "conversion_impact") -> DataFrame:
    """The subsets of ``explain_impact`` that need at most ``most`` rows, without the cube.

    Subsets are tried level by level. What k rows of any finer subset can reach is
    bounded by the k largest groups of positive leaf impacts, so where these stay
    within the share for more than ``most`` groups no finer subset is tried. A
    subset with a dimension that its others already fix has the rows of the
    others; it is not listed, nor are its finer ones. Nothing else is left out.

    Jobs run while the query is built: the leaf table is written once to the
    scratch folder and read once per ``SETS_PER_JOB`` subsets. Only the counts of
    each subset come to the driver. A NULL impact counts as none, a NULL value of
    a dimension is a value. A total of zero or an empty table gives no rows.
    """
    if not 0 < share < 1 or most < 1:
        raise ValueError("share must lie between 0 and 1, most must be positive")
    spark, dims = parts.sparkSession, list(dims)
    exact = parts.groupBy(*dims).agg(F.coalesce(F.sum(F.round(impact, 12).cast("decimal(24,12)")), F.lit(0)).cast("decimal(34,12)").alias("__i"))
    path = scratch_dir(spark, "leaf")
    exact.write.parquet(path)
    leaf = spark.read.schema(exact.schema).parquet(path)
    total = leaf.agg(F.sum("__i")).first()[0] or Decimal(0)
    gain = F.col("__i") if total > 0 else -F.col("__i")
    leaf = leaf.select(*dims, gain.alias("__gain"), F.greatest(gain, F.lit(0)).alias("__reach"))
    target = (abs(total) * Decimal(str(share))).quantize(Decimal("1e-12"), ROUND_FLOOR)

    found, totals = [], {(): 1}
    level = [(i,) for i in range(len(dims))] if total else []
    while level:
        alive = set()
        for at in range(0, len(level), SETS_PER_JOB):
            for s, (n, need, floor) in _rows_of_sets(leaf, dims, level[at:at + SETS_PER_JOB], most, target).items():
                if any(totals[rest] == n for rest in combinations(s, len(s) - 1)):
                    continue
                totals[s] = n
                if 1 < need <= most and need < n:
                    found.append(("+".join(dims[i] for i in s), need, n))
                if floor <= most:
                    alive.add(s)
        level = [s + (j,) for s in sorted(alive) for j in range(s[-1] + 1, len(dims))
                 if all(rest in alive for rest in combinations(s + (j,), len(s)))]
    out = spark.createDataFrame(found, "features string, rows_needed bigint, rows_total bigint")
    out = out.withColumn("share_needed", ratio("rows_needed", "rows_total"))
    return out.withColumn("weight", F.col("rows_needed") * F.col("share_needed"))


def vol_rate_impact(leaf: DataFrame, by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Two-factor split per group: volume impact = old rate x share change, rate
    impact = new share x rate change. ``within`` takes shares inside coarser groups."""
    g = leaf.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ["open_pre", "open_post", "submit_pre", "submit_post"]])
    g = with_totals(g, within, {"__a": F.sum("open_pre"), "__b": F.sum("open_post")})
    cr0, cr1 = F.coalesce(ratio("submit_pre", "open_pre"), F.lit(0.0)), F.coalesce(ratio("submit_post", "open_post"), F.lit(0.0))
    s0, s1 = F.coalesce(ratio("open_pre", "__a"), F.lit(0.0)), F.coalesce(ratio("open_post", "__b"), F.lit(0.0))
    g = g.withColumns({"cr_pre": cr0, "cr_post": cr1, "share_pre": s0, "share_post": s1})
    vol, rate = F.col("cr_pre") * (F.col("share_post") - F.col("share_pre")), F.col("share_post") * (F.col("cr_post") - F.col("cr_pre"))
    return g.withColumns({"vol_impact": vol, "rate_impact": rate, "total_impact": vol + rate}).drop("__a", "__b")


def vol_rate_rollup(leaf: DataFrame, levels: Sequence[Sequence[str]], entity: str) -> DataFrame:
    """The two-factor split at the finest level, summed up to coarser levels, with
    each row's share of its entity's total impact. One row set per level."""
    every = list(levels[-1])
    fine = vol_rate_impact(leaf, every)
    sums = [F.sum(c).alias(c) for c in ["vol_impact", "rate_impact", "total_impact"]]
    sets = fine.groupingSets([[F.col(c) for c in level] for level in levels], *every).agg(*sums, F.grouping_id().alias("__set"))
    code = {"+".join(level): sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in level) for level in levels}
    name = F.element_at(F.create_map(*[F.lit(x) for n, k in code.items() for x in (k, n)]), F.col("__set").cast("int"))
    # a level without the entity has one total, as its entity is NULL throughout
    totals = with_report_totals(sets, ["__set", entity], {"__e": F.sum("total_impact")})
    return totals.select(name.alias("level"), *[F.col(c).cast("string").alias(c) for c in every], "vol_impact", "rate_impact", "total_impact",
                         ratio("total_impact", "__e").alias("entity_share"))


def model_impact(leaf: DataFrame, group: str) -> DataFrame:
    """Two-factor split of a flag rate or precision by model between two periods, in
    percent points. In the leaf table hits stand as submits and the base as opens."""
    out = vol_rate_impact(leaf, [group])
    return out.withColumns({c: F.col(c) * 100 for c in ["vol_impact", "rate_impact", "total_impact"]})
