"""Values declared in stored pages and brand colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hex_channel
from ..functions.grouped import top_n

# Fixed value: tags whose style is read
STYLE_TAGS = "style|span|div|p|h1|h2|h3|h4|h5|h6"


def style_values(pages: DataFrame, page: str, html: str, prop: str = "[a-z-]*color[a-z-]*") -> DataFrame:
    """(page, property, value) for every matching declaration in style blocks and
    style attributes of the whole page text. ``prop`` is a pattern for the
    property name; the default reads colours."""
    block = F.regexp_extract_all(F.lower(html), F.lit(r"(?s)<style[^>]*>(.*?)</style>"), F.lit(1))
    attr = F.regexp_extract_all(F.lower(html), F.lit(rf"<(?:{STYLE_TAGS})\b[^>]*?\sstyle=[\"']([^\"']*)[\"']"), F.lit(1))
    css = F.explode(F.concat(block, attr))
    decl = r"(?:^|[;{\s])(" + prop + r")\s*:\s*([^;{}]+)"
    d = pages.select(page, css.alias("css"))
    names = F.regexp_extract_all("css", F.lit(decl), F.lit(1))
    values = F.regexp_extract_all("css", F.lit(decl), F.lit(2))
    d = d.select(page, F.explode(F.arrays_zip(names.alias("n"), values.alias("v"))).alias("x"))
    return d.select(page, F.col("x.n").alias("property"), F.trim(F.col("x.v")).alias("value"))


def page_colors(pages: DataFrame, page: str, html: str, n: int = 5, prop: str = "[a-z-]*color[a-z-]*") -> DataFrame:
    """The n most frequent declared values per page."""
    g = style_values(pages, page, html, prop).groupBy(page, "value").agg(F.count("*").alias("uses"))
    return top_n(g, [page], [F.col("uses").desc(), F.col("value")], n)


def brand_colors(df: DataFrame, color: str) -> DataFrame:
    """Frequency of valid six-digit colours with red, green and blue shares."""
    d = df.filter(F.col(color).rlike("^[0-9a-fA-F]{6}$"))
    g = d.groupBy(F.col(color).alias("color")).agg(F.count("*").alias("n"))
    return g.withColumns({c: hex_channel("color", i) for i, c in enumerate(["red", "green", "blue"])})


def color_frequencies(colors: DataFrame) -> DataFrame:
    """How many colours occur 1, 2, 3 … times."""
    return colors.groupBy("n").agg(F.count("*").alias("colors"))
