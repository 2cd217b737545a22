"""Fill-in-middle transformation by counted-quantifier regular expressions.

A text is cut into units (lines, unless another pattern is given). ``regexp_count`` gives their number n, hashes of the row's id choose two cuts a <= b,
and a pattern made for the row, ``unit{a}+``, ``unit{b-a}+`` and the rest, captures prefix, middle and suffix in one match. The possessive counts
walk over the units in a loop, without a step of recursion for each, so that texts of any length and number of lines pass. The match is replaced by the
three parts in the order of the form, with a sentinel before each; the sizes are read from the places of the sentinels.

Forms: ``plain`` is the text as it is: empty or null texts (null counts as empty), texts that hold a sentinel, and rows that the rate leaves out;
``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix, middle. A row without an id is hashed as the seed alone. Every row is transformed on its own: repeated
rows give equal results, and no row meets another. Clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import replace_column, table

#: Units; a pattern must cover a text without gaps.
LINES = r"[^\n]*\n|[^\n]+"
CHARACTERS = r"[\x{0}-\x{10FFFF}]"
SENTINELS = ("<P>", "<S>", "<M>")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def hashes(seed: int, ident: Column, many: int = 4) -> list[Column]:
    """Numbers below 2**32 out of the seed and the decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(many)]


def check_sentinels(sentinels: Sequence[str]) -> None:
    """Sentinels must be found again wherever they stand: none may begin with the end of another one (or of itself)."""
    for x in sentinels:
        for y in sentinels:
            if not x or (x != y and x in y) or any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)))):
                raise ValueError("sentinels must not be empty, hold or overlap each other")
    if len(set(sentinels)) < 3:
        raise ValueError("three different sentinels are needed")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_share: int = 50,
                   unit: str = LINES, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``docs`` with the number of units ``n``, the ``form``, ``prefix_chars`` and ``middle_chars`` (null where plain) and the ``output``.

    ``rate`` is the percentage of rows that are transformed, ``spm_share`` the percentage of these in form spm.
    """
    check_sentinels(sentinels)
    p, s, m = sentinels
    h1, h2, h3, h4 = hashes(seed, F.col(f"`{id_col}`"))
    keep = replace_column(docs, *RESULTS)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    held = text.rlike("|".join(map(re.escape, sentinels)))
    # The row goes along as one column, so that its names cannot clash with those used here.
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"), F.regexp_count(text, F.lit(unit)).cast("long").alias("n"),
                    h1.alias("h1"), h2.alias("h2"),
                    F.when((text == "") | held | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm").alias("form"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    count = [F.least(a, b), F.abs(a - b)]
    pattern = F.concat(F.lit(r"\A"), *[x for k in count for x in (F.lit(f"((?:{unit}){{"), k.cast("string"), F.lit("}+)"))], F.lit(r"([\x{0}-\x{10FFFF}]*+)\z"))
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    cut = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    d = d.select("row", "n", "form", cut.alias("output"))

    def size(left: str, right: str | None) -> Column:
        end = F.length("output") + 1 if right is None else F.locate(right, F.col("output"))
        return (end - F.locate(left, F.col("output")) - len(left)).cast("long")

    prefix = F.when(F.col("form") == "psm", size(p, s)).when(F.col("form") == "spm", size(p, m))
    return d.select("row.*", "n", "form", prefix.alias("prefix_chars"), F.when(F.col("form") != "plain", size(m, None)).alias("middle_chars"), "output")


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The exact text, out of the output and its form."""
    p, s, m = map(re.escape, sentinels)
    any_ = r"([\x{0}-\x{10FFFF}]*?)"
    rest = r"([\x{0}-\x{10FFFF}]*+)\z"
    return (F.when(form == "psm", F.regexp_replace(output, rf"\A{p}{any_}{s}{any_}{m}{rest}", "$1$3$2"))
            .when(form == "spm", F.regexp_replace(output, rf"\A{s}{any_}{p}{any_}{m}{rest}", "$2$3$1")).otherwise(output))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                    F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * CAST(i AS INTEGER) + 1, 8) AS BIGINT) FOR i IN range(4)] AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s"""
