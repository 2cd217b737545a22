"""Grouped helpers whose cost does not depend on how rows spread over groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import flag, row_hash

SLOTS_PER_OCTAVE = 512
#: Distinct doubles of a slot that one task orders; beyond that the slot is cut by binary digits.
SLOT_LEVELS = 500_000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None = None,
                   earliest: bool = False) -> DataFrame:
    """One row per key, the one with the greatest order tuple.

    An aggregate, not a window: each map task keeps one row per key, so a key
    with any number of rows sends only one row per task through the shuffle.
    """
    rest = [c for c in (cols or df.columns) if c not in keys]
    pick = F.min_by if earliest else F.max_by
    best = pick(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def count_ids(df: DataFrame, by: Sequence[str], ident: str, conds: Mapping[str, Column]) -> DataFrame:
    """Distinct ids per group for several conditions.

    Two plain aggregates instead of one multi-distinct (which would expand every
    row once per measure): flags per (group, id), then sums per group.
    """
    per_id = df.filter(F.col(ident).isNotNull()).groupBy(*by, ident).agg(
        *[F.max(flag(c)).alias(n) for n, c in conds.items()])
    return per_id.groupBy(*by).agg(*[F.sum(n).cast("bigint").alias(n) for n in conds])


def distinct_counts(df: DataFrame, by: Sequence[str], idents: Mapping[str, str], repeated: bool = False) -> DataFrame:
    """Distinct values of several columns per group: ``idents`` maps new name -> column.

    One two-step count for each column, put side by side: no row is copied once per measure, and each column is read once. If ``df`` is dear
    (joins, scans) or has many ``repeated`` rows of the same columns, it is first reduced to its distinct rows, which all the counts then share.
    NULL is no value and, as a group, a group like others.
    """
    base = df.select(*by, *dict.fromkeys(idents.values()))
    if repeated:
        base = base.distinct()
    parts = None
    for i, c in enumerate(idents.values()):
        n = base.groupBy(*by, c).agg(F.lit(1)).groupBy(*by).agg(F.count(c).alias("__n")).withColumn("__i", F.lit(i))
        parts = n if parts is None else parts.unionByName(n)
    return parts.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == i, F.col("__n"))).alias(n) for i, n in enumerate(idents)])


def set_sketches(df: DataFrame, by: Sequence[str], idents: Mapping[str, str], lg_k: int = 14) -> DataFrame:
    """Distinct counts that add up: one sketch per group and column (HyperLogLog of 2^lg_k registers, some 16 KB at most for the default).

    Stored by slice (day, merchant), they give the distinct counts of any union of slices through ``sketch_totals`` without the rows. The standard error is 1.04 / sqrt(2^lg_k), 0.8 %
    for the default; where the exact number is wanted, ``distinct_counts`` reads the rows.
    """
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(c, lg_k).alias(n) for n, c in idents.items()])


def sketch_totals(sketches: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Estimated distinct counts of groups of slices, out of their stored sketches."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names])


def with_totals(df: DataFrame, within: Sequence[str], totals: Mapping[str, Column], source: DataFrame | None = None) -> DataFrame:
    """Add group totals to every row. They are taken from ``source`` (default: the
    rows themselves); naming the base table there keeps chained totals from
    repeating the joins before them.

    Aggregate and join back rather than a window, so a group of any size stays
    spread out; without group columns the totals are scalar subqueries. For
    reports with few rows per group use ``with_report_totals``.
    """
    source = df if source is None else source
    if not within:
        agg = source.agg(*[t.alias(n) for n, t in totals.items()])
        out = df.withColumn("__totals", agg.select(F.struct(*totals)).scalar())
        return out.withColumns({n: F.col("__totals")[n] for n in totals}).drop("__totals")
    agg = source.groupBy(*within).agg(*[t.alias(n) for n, t in totals.items()])
    cond = None
    for c in within:
        agg = agg.withColumnRenamed(c, f"__w_{c}")
        eq = df[c].eqNullSafe(agg[f"__w_{c}"])
        cond = eq if cond is None else cond & eq
    return df.join(agg, cond, "inner").drop(*[f"__w_{c}" for c in within])


def with_report_totals(df: DataFrame, within: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Add totals to an aggregated report whose groups are bounded by a fixed
    domain (arms, states, reasons, bands, days). A window over the few result
    rows: the input is not read a second time, as a join back would do."""
    w = Window.partitionBy(*within)
    return df.withColumns({n: t.over(w) for n, t in totals.items()})


def value_slot(value: Column | str, per_octave: int = SLOTS_PER_OCTAVE) -> Column:
    """Slot number of a number, monotone in its value: ``per_octave`` slots between
    x and 2x on both sides of zero.

    It cuts the value range of a group into pieces that many tasks can order,
    without looking at the data first. Equal values are always merged before, so a
    slot holds at most the distinct values of a 1/512 relative range (for amounts
    in cents: a few thousand). Both infinities have slots of their own at the ends;
    NULL and NaN have none.
    """
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    size = F.floor(F.log2(F.abs(v)) * per_octave) + 2048 * per_octave
    end, endless = 4096 * per_octave, F.lit(float("inf"))
    return (F.when(F.isnan(v), F.lit(None)).when(v == endless, F.lit(end)).when(v == -endless, F.lit(-end))
            .when(v > 0, size).when(v < 0, -size).when(v == 0, F.lit(0)).cast("bigint"))


def slot_digits(value: Column, slot: Column, per_octave: int, shift: int) -> Column:
    """Whole number, monotone in the doubles of one slot: their 53 binary digits without the last ``shift``.

    All values of a slot are scaled by one power of two (in two steps, as neither may overflow), which is exact.
    """
    octave = F.floor((F.abs(slot) - 2048 * per_octave) / per_octave)
    first = F.floor((52 - octave) / 2)
    whole = (value * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), 52 - octave - first)).cast("bigint")
    # Zero and the infinities have slots of their own.
    alone = (slot == 0) | (F.abs(slot) >= 4096 * per_octave)
    return F.shiftright(F.when(alone, F.lit(0).cast("bigint")).otherwise(whole), shift)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
                    per_octave: int = SLOTS_PER_OCTAVE) -> DataFrame:
    """Exact interpolated quantiles per group; no group has to fit in one task.

    Equal values are counted first and the value range is cut into slots. Slot
    totals give the rank at which each slot starts, so ranks are counted exactly
    inside the slots that hold a wanted rank, and other slots are not ordered.
    Doubles may crowd in a slot: one that holds a wanted rank and more than ``SLOT_LEVELS`` values
    is cut again by counted binary digits. It has 2^43 doubles, so there are at most 2^21 parts of at most 2^22 doubles: what a task orders is bounded by that, however
    the values lie. NULL and NaN values are left out, and groups with a NULL key.
    """
    counts = df.filter(value_slot(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    d = counts.withColumn("__slot", value_slot("__v", per_octave))

    def ranks(total: Column) -> dict[str, tuple[Column, Column, Column]]:
        return {n: (pos := F.lit(float(p)) * (total - 1), F.floor(pos), F.ceil(pos)) for n, p in probs.items()}

    def wanted(sizes: DataFrame, within: Sequence[str], order: str, known: bool) -> DataFrame:
        """Parts that hold a wanted rank, with the number of values before them (``__offset``) and in the whole group (``__total``)."""
        group = Window.partitionBy(*within)                    # one row per used part
        past = F.coalesce(F.sum("__size").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if known:
            sizes = sizes.withColumn("__offset", F.col("__offset") + past)
        else:
            sizes = sizes.withColumns({"__offset": past, "__total": F.sum("__size").over(group)})
        hold = F.lit(False)
        for _, lo, hi in ranks(F.col("__total")).values():
            for r in (lo, hi):
                hold = hold | ((F.col("__offset") <= r) & (r < F.col("__offset") + F.col("__size")))
        return sizes.filter(hold).drop("__size")

    sizes = d.groupBy(*by, "__slot").agg(F.sum("__n").alias("__size"), F.count("*").alias("__levels"))
    slots = wanted(sizes, by, "__slot", False)
    crowded = F.col("__levels") > SLOT_LEVELS
    if dict(df.dtypes)[value] not in ("double", "float"):  # other types hold few values in a slot
        parts = d.join(slots.drop("__levels"), [*by, "__slot"]).withColumn("__part", F.lit(0).cast("bigint"))
    else:
        parts = d.join(slots.filter(~crowded).drop("__levels"), [*by, "__slot"]).withColumn("__part", F.lit(0).cast("bigint"))
        digits = lambda shift: slot_digits(F.col("__v").cast("double"), F.col("__slot"), per_octave, shift)
        # Usually there are none of these, and Spark drops the branch when it sees that.
        many = d.join(slots.filter(crowded).drop("__levels"), [*by, "__slot"]).withColumn("__part", slot_digits(F.col("__v").cast("double"), F.col("__slot"), per_octave, 22))
        sizes = many.groupBy(*by, "__slot", "__part", "__offset", "__total").agg(F.sum("__n").alias("__size"))
        chosen = wanted(sizes, [*by, "__slot"], "__part", True)
        parts = parts.unionByName(many.drop("__offset", "__total").join(chosen, [*by, "__slot", "__part"]).select(*parts.columns))
    inside = Window.partitionBy(*by, "__slot", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("__last", F.col("__offset") + F.sum("__n").over(inside) - 1)   # greatest 0-based rank of the value
    parts = parts.withColumn("__first", F.col("__last") - F.col("__n") + 1)
    aggs, final = [], []
    for n, (_, lo, hi) in ranks(F.col("__total")).items():
        for tag, r in (("lo", lo), ("hi", hi)):
            aggs.append(F.max(F.when((F.col("__first") <= r) & (r <= F.col("__last")), F.col("__v"))).alias(f"__{tag}_{n}"))
    out = parts.groupBy(*by).agg(F.max("__total").alias("__total"), *aggs)
    for n, (pos, lo_rank, _) in ranks(F.col("__total")).items():
        lo, hi = F.col(f"__lo_{n}").cast("double"), F.col(f"__hi_{n}").cast("double")
        final.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (pos - lo_rank)).alias(n))
    return out.select(*by, *final)


def left_join_sparse(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str] | None = None) -> DataFrame:
    """Left join on a key that is often NULL on the left. Rows without a key match
    nothing; a salt out of the ``spread`` columns (or the whole row) keeps them from all
    meeting in the one task that NULL hashes to. The right side's salt is 0, computed out
    of its key: a literal would be put in the place of the left side's salt, and the join
    would deal its rows by the key alone."""
    salt = F.when(F.col(key).isNull(), F.xxhash64(*spread) if spread else row_hash(left)).otherwise(F.lit(0).cast("bigint"))
    r = right.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(1)))
    return left.withColumn("__salt", salt).join(r, [key, "__salt"], "left").drop("__salt")


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Best n rows per group. Spark prunes to n per group in every map task
    (window group limit) before the shuffle, so hot groups stay small."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def pivot_sum(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, measures: Mapping[str, Column],
              sep: str = "_") -> DataFrame:
    """Pivot with fixed values and flat names ``measure_value``."""
    out = df.groupBy(*keys).pivot(column, list(values)).agg(*[m.alias(n) for n, m in measures.items()])
    if len(measures) == 1:
        (only,) = measures
        return out.select(*keys, *[F.col(f"`{v}`").alias(f"{only}{sep}{v}") for v in values])
    return out.select(*keys, *[F.col(f"`{v}_{n}`").alias(f"{n}{sep}{v}") for v in values for n in measures])


def exact_rank(df: DataFrame, by: Sequence[str], value: str, up: str | None = None, down: str | None = None) -> DataFrame:
    """rank() in ascending (``up``) and descending (``down``) order with shared ranks
    for ties, without one task per group: equal values are counted first, counts run
    over value slots, and the ranks are joined back to the rows. Rows without a key
    or a number have no rank."""
    from .scan import SPREAD, chunked_scan

    known = value_slot(value).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    levels = df.filter(known).groupBy(*by, value).agg(F.count("*").alias("__n")).withColumn("__slot", value_slot(value))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    counted = chunked_scan(
        levels, by, [F.col(value)], F.col("__slot"),
        inner={"__in": lambda w: F.sum("__n").over(upto(w))},
        summary={"__tot": F.sum("__n")},
        carry={"__off": lambda w: F.sum("__tot").over(w.rowsBetween(Window.unboundedPreceding, -1)),
               "__all": lambda w: F.sum("__tot").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))},
        result={"__upto": F.col("__in") + F.coalesce(F.col("__off"), F.lit(0)), "__all": F.col("__all")})
    ranks = {}
    if up:
        ranks[up] = F.col("__upto") - F.col("__n") + 1
    if down:
        ranks[down] = F.col("__all") - F.col("__upto") + 1
    # Rows without a rank are spread by a salt that no count has.
    salt = F.when(known, F.lit(-1).cast("bigint")).otherwise(F.pmod(row_hash(df), F.lit(SPREAD)))
    counted = counted.select(*by, value, F.lit(-1).cast("bigint").alias("__salt"), *[c.alias(n) for n, c in ranks.items()])
    return df.withColumn("__salt", salt).join(counted, [*by, value, "__salt"], "left").select(*df.columns, *ranks)


def top_n_with_rest(df: DataFrame, label: str, order: Sequence[Column], n: int, sums: Sequence[str],
                    rest: str = "Others") -> DataFrame:
    """The n best rows and one row with the sums of all others."""
    top = df.orderBy(*order).limit(n).select(F.col(label).cast("string").alias(label), *sums)
    whole = df.agg(*[F.sum(c).alias(c) for c in sums])
    head = top.agg(*[F.sum(c).alias(c) for c in sums])
    remainder = whole.select(F.lit(rest).alias(label), *[
        (F.col(c) - F.coalesce(head.select(c).scalar(), F.lit(0))).alias(c) for c in sums])
    return top.unionByName(remainder)


def with_total_row(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], total: str = "Total") -> DataFrame:
    """Groups of the first key plus a Total row per remaining keys, computed from
    the rows (rollup): distinct measures never get added up."""
    first, *rest = keys
    sets = df.cube(first).agg(*[a.alias(n) for n, a in aggs.items()], F.grouping_id().alias("__g")) if not rest else (
        df.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in rest]], *keys)
        .agg(*[a.alias(n) for n, a in aggs.items()], F.grouping(first).alias("__g")))
    name = F.when(F.col("__g") > 0, F.lit(total)).otherwise(F.col(first).cast("string"))
    return sets.select(name.alias(first), *rest, *aggs)


def complete_keys(df: DataFrame, key: str, cell: str, cells: int) -> DataFrame:
    """Rows of the keys that have all cells present."""
    full = df.groupBy(key).agg(F.countDistinct(cell).alias("__c")).filter(F.col("__c") == cells)
    return df.join(full, key, "left_semi")
