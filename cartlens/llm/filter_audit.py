"""Audit of how filters interact: what every order of them removes at every step, by counting paths through the subset lattice.

A row fails some of the filters; that set, the rows' mask, settles all its fates. Rows are counted by part and mask, and from there on only the lattice is left:
a state is the set of filters applied so far, an edge applies one more. A forward pass counts the orders that reach a state, a backward pass those that leave it;
their product is the number of orders that run through an edge. It weighs the edge's removals for the Shapley sums, and the steps of each order are read from the same edges.

The lattice depends on the number of filters alone (80 edges and 600 steps for five), so its tables are broadcast. Rows meet it only as counts.

Copies: ``repeated`` marks a row whose text is that of a row with a smaller id. Rows are counted by digest and id before they are grouped, so that copies of one text, or rows
with one id, meet as counts. A row without an id is no copy and makes none. Null text is empty text.
A null part is the empty string; labels without an id belong to nothing; of several labels of one id the greatest value counts; rows without a label count as lost neither way.
Repeated rows count each. An empty table has no parts and gives no rows. Extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: More filters would make the report itself too long: it holds a row for each step of each order.
MOST = 7


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, number of orders through that edge) of all edges of the subset lattice."""
    states = sorted(range(1 << n), key=lambda s: s.bit_count())
    reach, leave = {0: 1}, {(1 << n) - 1: 1}
    for s in states[1:]:
        reach[s] = sum(reach[s ^ (1 << f)] for f in range(n) if s >> f & 1)
    for s in reversed(states[:-1]):
        leave[s] = sum(leave[s | (1 << f)] for f in range(n) if not s >> f & 1)
    return [(s, f, reach[s] * leave[s | (1 << f)]) for s in states for f in range(n) if not s >> f & 1]


def edge_counts(counts: DataFrame, names: str) -> DataFrame:
    """(part, state, f, orders, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of every edge and part.

    ``counts`` holds (part, mask, n, good, toxic): rows by the set of filters that they fail."""
    spark, bits = counts.sparkSession, len(names)
    edges = lattice(bits)
    # What an edge does with the rows of a mask: (kept, removed, redundant, fails this filter only).
    rows = []
    for s, f, orders in edges:
        for mask in range(1 << bits):
            fails, gone = mask >> f & 1, mask & s != 0
            rows.append((mask, s, f, orders, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == 1 << f)))
    effect = spark.createDataFrame(rows, "mask int, state int, f int, orders long, k int, r int, d int, u int")
    total = {"kept": F.col("n") * F.col("k"), "removed": F.col("n") * F.col("r"), "redundant": F.col("n") * F.col("d"), "unique_fails": F.col("n") * F.col("u"),
             "good_lost": F.col("good") * F.col("r"), "toxic_lost": F.col("toxic") * F.col("r")}
    # Every part has all edges, with zeros where no row has a mask.
    return counts.join(F.broadcast(effect), "mask").groupBy("part", "state", "f", "orders").agg(*[F.sum(c).cast("long").alias(name) for name, c in total.items()])


def steps(edges: DataFrame, names: str) -> DataFrame:
    """One row for each part, order and step, read from the edges; with the Shapley sum of the step's filter over all orders."""
    spark, rows = edges.sparkSession, []
    for order in permutations(range(len(names))):
        state = 0
        for i, f in enumerate(order):
            rows.append(("".join(names[x] for x in order), i + 1, state, f))
            state |= 1 << f
    path = spark.createDataFrame(rows, "filter_order string, step int, state int, f int")
    shapley = edges.groupBy("part", "f").agg(F.sum(F.col("orders") * F.col("removed")).cast("long").alias("shapley"))
    return edges.join(F.broadcast(path), ["state", "f"]).join(shapley, ["part", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed_masks(docs: DataFrame, failing: Mapping[str, Column], part: Column, id_col: str, text_col: str, repeated: str | None) -> DataFrame:
    """(id, part, mask, n): rows counted by id and by the set of filters that they fail; ``repeated`` names the filter against copies."""
    names = list(failing) + ([repeated] if repeated else [])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bits = [F.when(c, 1 << names.index(name)).otherwise(0) for name, c in failing.items()]
    mask = F.lit(0)
    for b in bits:
        mask = mask + b
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"),
                       *([F.unhex(F.sha2(text, 256)).alias("digest")] if repeated else []))
    if not repeated:
        return rows.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    seen = written(rows.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n")), "seen")
    # The join is by digest and id: the copies of one text are dealt out by their ids.
    first = seen.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = seen.filter("id IS NOT NULL").join(first, ["digest", "id"], "left").withColumn(
        "mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << names.index(repeated)))
    return known.select("id", "part", "mask", "n").unionByName(seen.filter("id IS NULL").select("id", "part", "mask", "n")).groupBy("id", "part", "mask").agg(
        F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, failing: Mapping[str, Column], part: Column, id_col: str = "doc_id", text_col: str = "text",
          repeated: str | None = None, good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """All orders of the filters, step by step.

    ``failing`` gives the condition under which a row fails, by one-letter name; null is not failing. ``repeated`` names a further filter, which fails copies.
    ``labels`` holds 1 in ``good`` and ``toxic`` for rows that should stay or go.
    """
    names = "".join(failing) + (repeated or "")
    if not 1 <= len(names) <= MOST or len(set(names)) < len(names) or any(len(x) != 1 for x in [*failing, *([repeated] if repeated else [])]):
        raise ValueError(f"between 1 and {MOST} filters with different one-letter names are needed")
    masks = failed_masks(docs, failing, part, id_col, text_col, repeated)
    marks = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.max(F.when(F.col(good) == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col(toxic) == 1, 1).otherwise(0)).alias("toxic"))
    # Rows without an id have no label and go past the join, where they would be one key.
    met = masks.filter("id IS NOT NULL").join(marks, "id", "left").unionByName(masks.filter("id IS NULL"), allowMissingColumns=True)
    counts = met.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # A few counts for each part; written, since edges and Shapley sums both read them.
    return steps(edge_counts(written(counts, "mask-counts"), names), names)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def document_filters(text_col: str = "text") -> dict[str, Column]:
    """The failing conditions on a text alone: few words, repeated words, capitals, marks."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    w = words(text)
    return {"A": F.size(w) < 100,
            "B": 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
            "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
            "D": text.rlike(r"[#$%&*|]")}


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return audit(docs, table(spark, sf_dir, "labels"), document_filters(), F.col("lang"), repeated="E")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first_id < w.doc_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS f, left(filter_order, CAST(step AS INTEGER) - 1) AS done
  FROM o, range(1, 6) r(step)),
m AS (SELECT *, contains(fails, f) AS bad, translate(fails, done, '') <> fails AS gone FROM s, c),
e AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (bad AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM e"""
