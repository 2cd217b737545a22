"""Scalar function families, one query each."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions import expr as x
from ..functions import periods
from .registry import query
from .views import sql


@query("f01_string", """
SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, substr(c_name, 10) AS tail, c_name || '/' || c_mktsegment AS both,
  length(c_name) AS len, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded, split_part(c_name, '#', 2) AS part,
  string_split(c_name, '#')[1] AS head, string_split(c_name, '0')[-1] AS last, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits,
  regexp_extract(c_name, '0*([1-9][0-9]*)$', 1) AS number, c_name LIKE 'Cust%1' AS ends_one, contains(c_mktsegment, 'ING') AS has_ing
FROM customer""")
def _(t):
    n = F.col("c_name")
    return t.raw("customer").select(
        "c_custkey", F.lower(n).alias("low"), F.upper("c_mktsegment").alias("up"), F.expr("substring(c_name, 10)").alias("tail"),
        F.concat(n, F.lit("/"), F.col("c_mktsegment")).alias("both"), F.length(n).cast("bigint").alias("len"),
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("padded"), F.split_part(n, F.lit("#"), F.lit(2)).alias("part"),
        F.split(n, "#")[0].alias("head"), x.last_token(n, "0").alias("last"), F.regexp_replace(n, "[^0-9]", "").alias("digits"),
        F.regexp_extract(n, "0*([1-9][0-9]*)$", 1).alias("number"), n.like("Cust%1").alias("ends_one"),
        F.contains(F.col("c_mktsegment"), F.lit("ING")).alias("has_ing"))


@query("f02_datetime", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 5 AS plus5, CAST(o_orderdate AS DATE) - 3 AS minus3,
  date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days, week(o_orderdate) AS week, month(o_orderdate) AS month, year(o_orderdate) AS year,
  day(o_orderdate) AS dom, strftime(o_orderdate, '%Y-%m') AS ym, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
  CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, epoch(o_orderdate)::BIGINT AS epoch, monthname(o_orderdate) AS month_name,
  CAST(epoch_ms(epoch_ms(o_orderdate) + 71400000 + 19800000) AS DATE) AS local_day, TRY_CAST('2024-13-01' AS DATE) IS NULL AS bad_date
FROM orders""", dates="day plus5 minus3 month_start week_start local_day")
def _(t):
    d = F.col("o_orderdate")
    epoch = F.unix_seconds(d.cast("timestamp"))
    return t.raw("orders").select(
        "o_orderkey", F.to_date(d).alias("day"), F.date_add(d, 5).alias("plus5"), F.date_sub(d, 3).alias("minus3"),
        F.datediff(d, F.lit("1995-01-01")).cast("bigint").alias("days"), F.weekofyear(d).cast("bigint").alias("week"), F.month(d).cast("bigint").alias("month"),
        F.year(d).cast("bigint").alias("year"), F.dayofmonth(d).cast("bigint").alias("dom"), periods.month_label(d).alias("ym"),
        periods.period_start(d, "month").alias("month_start"), periods.period_start(d, "week").alias("week_start"), epoch.alias("epoch"),
        F.date_format(d, "MMMM").alias("month_name"), x.local_date(epoch + 71400, "Asia/Kolkata").alias("local_day"),
        F.try_to_timestamp(F.lit("2024-13-01"), F.lit("yyyy-MM-dd")).isNull().alias("bad_date"))


AS_OF = dt.date(1998, 1, 14)


@query("f03_period_calculus", sql("pay", """
SELECT CASE WHEN created_date >= DATE '1997-12-15' AND created_date < DATE '1998-01-12' THEN 'last_4_weeks' END AS weeks,
  CASE WHEN created_date >= DATE '1997-10-01' AND created_date < DATE '1998-01-01' THEN 'last_3_months' END AS months,
  CASE WHEN created_date >= DATE '1998-01-07' AND created_date < DATE '1998-01-14' THEN 'prior_7_days' END AS days,
  strftime(created_date, '%Y-%m') <= '1997-12' AS may_settle, count(*) AS n FROM pay GROUP BY 1, 2, 3, 4"""))
def _(t):
    d = F.col("created_date")

    def inside(span, label):
        return F.when((d >= F.lit(span[0])) & (d < F.lit(span[1])), label)

    return t.payments().groupBy(
        inside(periods.last_whole_periods(AS_OF, "week", 4), "last_4_weeks").alias("weeks"),
        inside(periods.last_whole_periods(AS_OF, "month", 3), "last_3_months").alias("months"),
        inside(periods.prior_days(AS_OF, 7), "prior_7_days").alias("days"),
        (periods.month_label(d) <= periods.cutoff_month(AS_OF)).alias("may_settle")).agg(F.count("*").alias("n"))


@query("f04_math", """
WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd FROM part)
SELECT p_partkey, round(p_retailprice, 1) AS r1, abs(p_size - 25)::BIGINT AS a, CAST(CAST(floor(p_retailprice) AS BIGINT) / 100 AS DECIMAL(10,2))::DOUBLE AS major,
  round(sqrt(p_size), 6) AS root, round(asin(sqrt(p_size / 50.0)), 6) AS arc, floor(p_retailprice / 7)::BIGINT AS f, round((p_retailprice - m) / sd, 6) AS z
FROM part, s""")
def _(t):
    p = t.raw("part")
    s = p.agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("sd"))
    price, size = F.col("p_retailprice"), F.col("p_size")
    return p.select(
        "p_partkey", F.round(price, 1).alias("r1"), F.abs(size - 25).alias("a"),
        (F.floor(price) / 100).cast("decimal(10,2)").alias("major"), x.rounded(F.sqrt(size)).alias("root"),
        x.rounded(F.asin(F.sqrt(size / 50.0))).alias("arc"), F.floor(price / 7).alias("f"),
        x.rounded(x.ratio(price - s.select("m").scalar(), s.select("sd").scalar())).alias("z"))


@query("f05_null_handling", """
SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS q, nullif(l.quality, 0)::BIGINT AS q1, l.toxic IS NULL AS unknown,
  CASE WHEN l.toxic IS NOT NULL THEN 'known' ELSE 'unknown' END AS state, TRY_CAST(lang AS BIGINT) IS NULL AS bad, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END::BIGINT AS long_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    d = t.raw("documents").join(t.raw("labels"), "doc_id", "left")
    return d.select(
        "doc_id", F.coalesce("quality", F.lit(-1)).alias("q"), F.nullif(F.col("quality"), F.lit(0)).alias("q1"),
        F.col("toxic").isNull().alias("unknown"), F.when(F.isnotnull("toxic"), "known").otherwise("unknown").alias("state"),
        F.col("lang").try_cast("bigint").isNull().alias("bad"), F.expr("if(n_chars > 1000, 1, 0)").alias("long_text"))


@query("f06_json", """
SELECT doc_id, len(string_split(text, ' '))::BIGINT AS items, CAST(list_sum(list_transform(string_split(text, ' '), lambda w: length(w))) AS BIGINT) AS letters FROM documents""")
def _(t):
    doc = F.to_json(F.split("text", " "))
    words = F.from_json("doc", "array<string>")
    return t.raw("documents").select("doc_id", doc.alias("doc")).select(
        "doc_id", F.json_array_length("doc").cast("bigint").alias("items"),
        F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("letters"))


@query("f07_array_index", """
SELECT doc_id, string_split(text, ' ')[1] AS first_word, string_split(text, ' ')[2] AS second_word FROM documents""")
def _(t):
    doc = F.to_json(F.struct(F.split("text", " ").alias("words")))
    return t.raw("documents").select("doc_id", F.get_json_object(doc, "$.words[0]").alias("first_word"),
                                     F.get_json_object(doc, "$.words[1]").alias("second_word"))


@query("f08_formatting", """
WITH v AS (SELECT o_orderkey, CAST(floor(o_totalprice * 37) AS BIGINT) AS n, o_totalprice / 1000000 AS share FROM orders)
SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE
  reverse(rtrim(regexp_replace(reverse(CAST(n // 1000 AS VARCHAR)), '(..)', '\\1,', 'g'), ',')) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') END AS grouped,
  printf('%.2f', round(share * 100, 2)) || '%' AS pct FROM v""")
def _(t):
    n = F.floor(F.col("o_totalprice") * 37)
    return t.raw("orders").select("o_orderkey", x.indian_grouping(n).alias("grouped"),
                                  x.percent_text(F.col("o_totalprice") / 1000000).alias("pct"))


@query("f09_colour", """
SELECT p_partkey, round((p_partkey % 256) / 255.0, 6) AS r, round((p_size * 5) / 255.0, 6) AS g, round(16 / 255.0, 6) AS b FROM part""")
def _(t):
    hx = F.format_string("#%02x%02x10", F.col("p_partkey") % 256, F.col("p_size") * 5)
    return t.raw("part").select("p_partkey", *[x.rounded(x.hex_channel(hx, i)).alias(n) for i, n in enumerate("rgb")])
