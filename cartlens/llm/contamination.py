"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Index: for each term of the benchmark its postings (text, position) in the training texts, stored as a table. Every window (``WINDOW``
consecutive words of an item; a shorter item is one window) is looked up from its two rarest terms, by their frequency in the index: their
posting lists, each moved by the term's place in the item, are intersected. Where an item can begin by that, each of its terms is looked up at the place where it has to stand, and
runs of matched words as long as a window are exact occurrences. ``proximity`` returns places where the two rarest terms of an item stand close together instead.

A table is broadcast only if its measured size is within ``BROADCAST_BYTES``; beyond that the same join shuffles.

Words: A-Z in lower case, runs of letters, digits and characters above 127. Null and empty texts have no words; items without words are never found;
an item without an id marks words, but is not counted among the items. Copies of a text share their result; repeated rows each get a row. Clashing columns are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import replace_column, table, written

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
BROADCAST_BYTES = 8 << 20
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` to broadcast, if its rows of about ``row_bytes`` are few enough; as it is otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def vocabulary(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(items with their words, numbered terms); both are written, so that numbers stay the same."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), words(F.col(f"`{text_col}`")).alias("words"))
    items = written(items.filter(F.size("words") > 0).dropDuplicates().withColumn("item", F.monotonically_increasing_id()), "items")
    terms = items.select(F.explode("words").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id())
    return items, written(terms, "terms")


def build_index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (key, pos, t) of ``terms`` in (key, words)."""
    longest = terms.agg(F.coalesce(F.max(F.octet_length("term")), F.lit(0))).head()[0]
    postings = texts.select("key", F.posexplode("words").alias("pos", "term"))
    return written(postings.join(small(terms, 40 + longest), "term").select("key", "pos", "t"), "index")


def anchors(items: DataFrame, terms: DataFrame, index: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(places of the items' terms, the two rarest terms of each window); windows with a term that no text holds are left out."""
    frequency = index.groupBy("t").agg(F.count("*").alias("n"))
    places = written(items.select("item", "item_id", F.size("words").alias("length"), F.posexplode("words").alias("q", "term"))
                     .join(terms, "term").join(frequency, "t", "left")
                     .select("item", "item_id", F.least("length", F.lit(window)).alias("width"), "length", "q", "t", F.coalesce("n", F.lit(0)).alias("n")), "places")
    whole = places.groupBy("item", "width", "length").agg(F.array_sort(F.collect_list(F.struct("q", "n", "t"))).alias("at"))
    slices = whole.select("item", F.expr("explode(transform(sequence(0, length - width), s -> slice(at, s + 1, width)))").alias("at"))
    rare = slices.select("item", F.expr("array_sort(transform(at, x -> struct(x.n as n, x.q as q, x.t as t)))").alias("by"))
    first, second = F.col("by")[0], F.coalesce(F.get("by", F.lit(1)), F.col("by")[0])
    pairs = rare.filter(first["n"] > 0).select("item", first["q"].alias("q1"), second["q"].alias("q2"), first["t"].alias("t1"), second["t"].alias("t2")).distinct()
    return places, written(pairs, "anchors")


def _lists(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Postings of the rarest terms with the pair that asks for them; ``side`` is 1, 2 or, for windows of one word, 3."""
    sides = F.explode(F.array(
        F.struct(F.col("t1").alias("t"), F.col("q1").alias("q"), F.when(F.col("q1") == F.col("q2"), 3).otherwise(1).alias("side")),
        F.struct(F.col("t2").alias("t"), F.col("q2").alias("q"), F.when(F.col("q1") == F.col("q2"), 3).otherwise(2).alias("side"))))
    asked = pairs.select("item", "q1", "q2", sides.alias("s")).select("item", "q1", "q2", "s.*").distinct()
    return index.join(small(asked, 64), "t")


def occurrences(items: DataFrame, terms: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, item_id, pos): each word of each exact occurrence of a window."""
    places, pairs = anchors(items, terms, index, window)
    begins = (_lists(index, pairs).groupBy("key", "item", "q1", "q2", (F.col("pos") - F.col("q")).alias("start"))
              .agg(F.bit_or("side").alias("sides")).filter("sides = 3").select("key", "item", "start").distinct())
    begins = written(begins, "begins")
    # Each place where an item can begin asks for the item's terms at their places, and no other posting of the text is looked at: a text that
    # repeats an item costs its occurrences times the item's length.
    expected = written(begins.join(small(places, 64), "item").select("key", "item", "item_id", "width", "start", "q", "t", (F.col("start") + F.col("q")).alias("pos")), "expected")
    held = index.join(small(begins.select("key").distinct(), 40), "key", "left_semi")
    matched = (held.join(small(expected, 100), ["key", "pos", "t"])
               .groupBy("key", "item", "item_id", "width", "start").agg(F.array_sort(F.collect_set("q")).alias("at")))
    full = matched.filter("size(at) >= width").withColumn(
        "at", F.expr("flatten(transform(filter(sequence(0, size(at) - width), i -> at[i + width - 1] - at[i] = width - 1), i -> sequence(at[i], at[i] + width - 1)))"))
    return full.select("key", "item_id", F.explode(F.array_distinct("at")).alias("q"), "start").select("key", "item_id", (F.col("start") + F.col("q")).alias("pos"))


def proximity(items: DataFrame, terms: DataFrame, index: DataFrame, slop: int = 5, window: int = WINDOW) -> DataFrame:
    """(key, item_id, pos): places of a window's rarest term with its second rarest within ``slop`` words of where the item has it."""
    _, pairs = anchors(items, terms, index, window)
    starts = _lists(index, pairs).select("key", "item", "q1", "q2", "side", "pos", (F.col("pos") - F.col("q")).alias("start"))
    # Starts at most ``slop`` apart share a cell of that width or lie in neighbouring ones.
    cell = F.floor(F.col("start") / (slop + 1))
    one = starts.filter("side <> 2").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    two = starts.filter("side <> 1").select("key", "item", "q1", "q2", cell.alias("cell"), F.col("start").alias("other"))
    near = one.join(two, ["key", "item", "q1", "q2", "cell"]).filter(F.abs(F.col("start") - F.col("other")) <= slop)
    return near.select("key", "item", "pos").distinct().join(items.select("item", "item_id"), "item").select("key", "item_id", "pos")


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, words) of each text; equal texts have equal keys."""
    text = F.col(f"`{text_col}`")
    return docs.filter(text.isNotNull()).select(F.unhex(F.md5(text)).alias("key"), words(text).alias("words"))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", benchmark_text: str = "text",
                  window: int = WINDOW, share: int = SHARE, keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns ``RESULTS``."""
    items, terms = vocabulary(benchmark, id_col, benchmark_text)
    hits = written(occurrences(items, terms, build_index(keyed(docs, text_col), terms), window).distinct(), "hits")
    n_hit = hits.select("key", "pos").distinct().groupBy("key").agg(F.count("*").alias("__hit"))
    listed = hits.select("key", "item_id").distinct().groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    # One row of fixed width for each text that is hit: texts are moved only if these are too many to send round.
    result = written(n_hit.join(listed, "key", "left").select(
        "key", "__hit", F.size(F.coalesce("ids", F.array().cast("array<string>"))).alias("__n"),
        F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","), 256).alias("__sha")), "result")
    own = [F.col(f"`{c}`") for c in replace_column(docs, *RESULTS) if keep_text or c != text_col]
    text = F.col(f"`{text_col}`")
    rows = docs.select(*own, F.unhex(F.md5(text)).alias("key"), F.size(words(text)).cast("long").alias("n_words"))
    hit = F.coalesce("__hit", F.lit(0)).cast("long")
    return rows.join(small(result, 160), "key", "left").select(
        *own, "n_words", hit.alias("n_hit"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("__sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS width, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT row_no, s, width, array_to_string(w[s:s + width - 1], ' ') AS phrase
          FROM (SELECT row_no, w, width, unnest(range(1, len(w) - width + 2)) AS s FROM doc, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width)),
hit AS (SELECT row_no, item_id, s, width FROM grams JOIN windows USING (width, phrase)),
n AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(s, s + width)) AS p FROM hit) GROUP BY row_no),
ids AS (SELECT row_no, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list
        FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN n USING (row_no) LEFT JOIN ids USING (row_no)
"""
