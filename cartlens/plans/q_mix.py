from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import mix as op
from .registry import query
from .views import sql

DIMS = ["platform", "browser", "os", "aov"]


def leaf(t, dims=DIMS):
    # The decomposition reads the leaf table once per prefix; Spark reuses its
    # exchange, so the event log is scanned once. In the later period checkouts with
    # large carts do not count as won, which gives the analysis a real drop to explain.
    counts = (F.col("period") == "Prev") | (F.col("max_k") < 60)
    c = t.checkouts().withColumn("won", F.when(counts, F.col("open") * F.col("paid")).otherwise(0))
    return op.leaf_table(c, dims, "period", "Prev", "Post", "open", "won")


def leaf_sql(dims):
    d = ", ".join(dims)
    return f"""leaf AS (SELECT {d}, {", ".join(f"CAST(coalesce(sum({e}) FILTER (period='{p}'), 0) AS BIGINT) AS {n}_{s}"
        for n, e in [("open", "open"), ("submit", "CASE WHEN period = 'Prev' OR max_k < 60 THEN open*paid ELSE 0 END")] for p, s in [("Prev", "pre"), ("Post", "post")])} FROM cf GROUP BY ALL)"""


def mix_sql(dims):
    n = len(dims)
    wins = "".join(f", sum(open_pre) OVER (PARTITION BY {', '.join(dims[:i])})::DOUBLE AS p{i}, sum(open_post) OVER (PARTITION BY {', '.join(dims[:i])})::DOUBLE AS q{i}"
                   for i in range(1, n + 1))
    mixes = ", ".join(f"CASE WHEN open_pre > 0 THEN np * q{i} / nq * (open_pre::DOUBLE / p{i}) WHEN p{i} > 0 THEN 0 ELSE np * open_post / nq END AS o{i}"
                      for i in range(1, n + 1))
    imp = ", ".join(f"(o{i} - {'open_pre' if i == 1 else f'o{i-1}'}) * cr_pre / np AS {d}_impact" for i, d in enumerate(dims, 1))
    return f"""{leaf_sql(dims)},
  w AS (SELECT *, coalesce(submit_pre::DOUBLE / nullif(open_pre, 0), 0) AS cr_pre, coalesce(submit_post::DOUBLE / nullif(open_post, 0), 0) AS cr_post,
    sum(open_pre) OVER ()::DOUBLE AS np, sum(open_post) OVER ()::DOUBLE AS nq{wins} FROM leaf),
  o AS (SELECT *, {mixes} FROM w),
  parts AS (SELECT *, open_pre / np AS share_pre, open_post / nq AS share_post, o{n} AS mix_opens, {imp}, (cr_post - cr_pre) * o{n} / np AS conversion_impact FROM o)"""


IMPACTS = [f"{d}_impact" for d in DIMS] + ["conversion_impact"]
LEAF_OUT = ["cr_pre", "cr_post", "share_pre", "share_post", *IMPACTS]


@query("d13_mix_decompose", sql("cf", f"""{mix_sql(DIMS)}
SELECT {", ".join(DIMS)}, open_pre, open_post, submit_pre, submit_post, round(mix_opens, 5) AS mix_opens, {", ".join(f"round({c}, 8) AS {c}" for c in LEAF_OUT)} FROM parts"""))
def _(t):
    parts = op.mix_decompose(leaf(t), DIMS)
    return parts.withColumns({**{c: rounded(c, 8) for c in LEAF_OUT}, "mix_opens": rounded("mix_opens", 5)})


@query("d13_mix_summary", sql("cf", mix_sql(DIMS) + """
SELECT 0::BIGINT AS step, 'Pre_CR' AS feature, round(sum(submit_pre)::DOUBLE / sum(open_pre), 8) AS impact FROM parts
""" + "".join(f"UNION ALL SELECT {i}, '{d}', round(sum({d}_impact), 8) FROM parts " for i, d in enumerate(DIMS, 1)) + f"""
UNION ALL SELECT {len(DIMS) + 1}, 'conversion', round(sum(conversion_impact), 8) FROM parts
UNION ALL SELECT {len(DIMS) + 2}, 'Post_CR', round(sum(submit_post)::DOUBLE / sum(open_post), 8) FROM parts"""))
def _(t):
    return op.mix_summary(op.mix_decompose(leaf(t), DIMS), DIMS).withColumn("impact", rounded("impact", 8))


@query("d14_explain_impact", sql("cf", mix_sql(DIMS) + f""",
c AS (SELECT {", ".join(DIMS)}, sum(CAST(round(conversion_impact, 12) AS DECIMAL(24,12))) AS i,
  {" + ".join(f"grouping({d}) * {2 ** (len(DIMS) - 1 - j)}" for j, d in enumerate(DIMS))} AS gid FROM parts GROUP BY CUBE ({", ".join(DIMS)})),
s AS (SELECT gid, i, sum(i) OVER (PARTITION BY gid) AS total FROM c WHERE gid <> {2 ** len(DIMS) - 1}),
r AS (SELECT *, sum(i * sign(total)) OVER (PARTITION BY gid ORDER BY i * sign(total) DESC ROWS UNBOUNDED PRECEDING) AS run FROM s),
n AS (SELECT gid, count(*) FILTER (run <= abs(total) * 0.8) AS rows_needed, count(*) AS rows_total FROM r GROUP BY 1)
SELECT array_to_string(list_filter([{", ".join(f"CASE WHEN (gid // {2 ** (len(DIMS) - 1 - j)}) % 2 = 0 THEN '{d}' END" for j, d in enumerate(DIMS))}], lambda x: x IS NOT NULL), '+') AS features,
  rows_needed, rows_total, round(rows_needed::DOUBLE / rows_total, 6) AS share_needed, round(rows_needed * (rows_needed::DOUBLE / rows_total), 6) AS weight
FROM n WHERE rows_needed NOT IN (0, 1) AND rows_needed <> rows_total"""))
def _(t):
    parts = op.mix_decompose(leaf(t), DIMS).select(*DIMS, "conversion_impact")
    out = op.explain_impact(parts, DIMS)
    return out.withColumns({"share_needed": rounded("share_needed"), "weight": rounded("weight")})


SEARCH_DIMS = [*DIMS, "arm", "eligible"]


@query("d14_explain_search", sql("cf", mix_sql(SEARCH_DIMS) + f""",
c AS (SELECT {", ".join(SEARCH_DIMS)}, sum(CAST(round(conversion_impact, 12) AS DECIMAL(24,12))) AS i,
  {" + ".join(f"grouping({d}) * {2 ** (len(SEARCH_DIMS) - 1 - j)}" for j, d in enumerate(SEARCH_DIMS))} AS gid FROM parts GROUP BY CUBE ({", ".join(SEARCH_DIMS)})),
s AS (SELECT gid, i, sum(i) OVER (PARTITION BY gid) AS total FROM c),
r AS (SELECT *, sum(i * sign(total)) OVER (PARTITION BY gid ORDER BY i * sign(total) DESC ROWS UNBOUNDED PRECEDING) AS run FROM s),
n AS (SELECT gid, count(*) FILTER (run <= abs(total) * 0.8) AS rows_needed, count(*) AS rows_total FROM r GROUP BY 1),
fixed AS (SELECT DISTINCT a.gid FROM n a JOIN n b ON b.rows_total = a.rows_total AND b.gid > a.gid AND a.gid & b.gid = a.gid AND bit_count(b.gid - a.gid) = 1)
SELECT array_to_string(list_filter([{", ".join(f"CASE WHEN (gid // {2 ** (len(SEARCH_DIMS) - 1 - j)}) % 2 = 0 THEN '{d}' END" for j, d in enumerate(SEARCH_DIMS))}], lambda x: x IS NOT NULL), '+') AS features,
  rows_needed, rows_total, round(rows_needed::DOUBLE / rows_total, 6) AS share_needed, round(rows_needed * (rows_needed::DOUBLE / rows_total), 6) AS weight
FROM n ANTI JOIN fixed USING (gid) WHERE rows_needed BETWEEN 2 AND 20 AND rows_needed <> rows_total"""))
def _(t):
    parts = op.mix_decompose(leaf(t, SEARCH_DIMS), SEARCH_DIMS).select(*SEARCH_DIMS, "conversion_impact")
    out = op.search_explanations(parts, SEARCH_DIMS, 20)
    return out.withColumns({"share_needed": rounded("share_needed"), "weight": rounded("weight")})


@query("d15_feature_impact", sql("cf", mix_sql(DIMS) + """
SELECT aov, round(sum(aov_impact), 8) AS volume_impact, round(sum(conversion_impact), 8) AS conversion_impact, round(sum(share_pre), 8) AS share_pre,
  round(sum(share_post), 8) AS share_post, round(sum(submit_pre)::DOUBLE / nullif(sum(open_pre), 0), 8) AS cr_pre,
  round(sum(submit_post)::DOUBLE / nullif(sum(open_post), 0), 8) AS cr_post FROM parts GROUP BY 1"""))
def _(t):
    out = op.feature_impact(op.mix_decompose(leaf(t), DIMS), "aov")
    return out.withColumns({c: rounded(c, 8) for c in out.columns if c != "aov"})


def vr_sql(by, name):
    k = ", ".join(by)
    return f"""{name}0 AS (SELECT {k}, sum(open_pre)::DOUBLE AS a, sum(open_post)::DOUBLE AS b, sum(submit_pre)::DOUBLE AS c, sum(submit_post)::DOUBLE AS d FROM leaf GROUP BY ALL),
  {name}1 AS (SELECT *, coalesce(c / nullif(a, 0), 0) AS r0, coalesce(d / nullif(b, 0), 0) AS r1, a / sum(a) OVER () AS s0, b / sum(b) OVER () AS s1 FROM {name}0),
  {name} AS (SELECT *, r0 * (s1 - s0) AS vol, s1 * (r1 - r0) AS rate FROM {name}1)"""


@query("d16_vol_rate_impact", sql("cf", f"""{leaf_sql(["aov", "os"])}, {vr_sql(["aov", "os"], "f")}
SELECT aov, os, a::BIGINT AS open_pre, b::BIGINT AS open_post, c::BIGINT AS submit_pre, d::BIGINT AS submit_post, round(r0, 8) AS cr_pre, round(r1, 8) AS cr_post,
  round(s0, 8) AS share_pre, round(s1, 8) AS share_post, round(vol, 8) AS vol_impact, round(rate, 8) AS rate_impact, round(vol + rate, 8) AS total_impact FROM f"""))
def _(t):
    out = op.vol_rate_impact(leaf(t, ["aov", "os"]), ["aov", "os"])
    return out.withColumns({c: rounded(c, 8) for c in out.columns if c.startswith(("cr_", "share", "vol", "rate", "total"))})


LEVELS = [["aov"], ["merchant_id"], ["aov", "merchant_id"]]


@query("d17_vol_rate_rollup", sql("cf", f"""{leaf_sql(["aov", "merchant_id"])}, {vr_sql(["aov", "merchant_id"], "f")},
a1 AS (SELECT 'aov' AS level, aov, NULL AS merchant_id, sum(vol) AS vol, sum(rate) AS rate FROM f GROUP BY 2),
a2 AS (SELECT 'merchant_id' AS level, NULL AS aov, CAST(merchant_id AS VARCHAR) AS merchant_id, sum(vol) AS vol, sum(rate) AS rate FROM f GROUP BY 3),
a3 AS (SELECT 'aov+merchant_id' AS level, aov, CAST(merchant_id AS VARCHAR) AS merchant_id, sum(vol) AS vol, sum(rate) AS rate FROM f GROUP BY 2, 3),
u AS (SELECT *, sum(vol + rate) OVER () AS e FROM a1 UNION ALL SELECT *, vol + rate FROM a2 UNION ALL SELECT *, sum(vol + rate) OVER (PARTITION BY merchant_id) FROM a3)
SELECT level, aov, merchant_id, round(vol, 8) AS vol_impact, round(rate, 8) AS rate_impact, round(vol + rate, 8) AS total_impact, round((vol + rate) / nullif(e, 0), 5) AS entity_share FROM u"""))
def _(t):
    out = op.vol_rate_rollup(leaf(t, ["aov", "merchant_id"]), LEVELS, "merchant_id")
    return out.withColumns({**{c: rounded(c, 8) for c in ["vol_impact", "rate_impact", "total_impact"]}, "entity_share": rounded("entity_share", 5)})
