"""A corpus from raw documents to token ids: five stages, each written as Parquet and reread by the next one.

All stages but the last return the columns of ``documents``. Rejected, repeated and contaminated documents go, secrets are masked, the rest stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import contamination, jaccard, quality, secrets, tokens
from cartlens.llm.common import small_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more); learnt from the labels outside the held-out fold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model).filter("score >= 0.5").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id (rows without an id last); documents without words stay.

    Groups are those of the texts: unlinked texts that carry one id stay apart, and near copies without an id are a group like any other.
    """
    small_batches(spark)
    tagged = docs.withColumn("__row", F.xxhash64(*docs.columns))
    found = written(jaccard.near_duplicates(tagged, tag=F.col("__row")), "groups")
    # Equal rows share the tag: of those that stay, one is kept.
    first = found.filter("n_shingles > 0").groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "tag")).alias("f")).select("f.tag")
    wordless = found.filter("n_shingles = 0").select("tag").distinct()
    copies = found.filter("n_shingles > 0").groupBy("tag").agg(F.count("*").alias("copies"))
    stay = written(wordless.withColumn("copies", F.lit(1)).unionByName(first.distinct().join(copies, "tag")).withColumnRenamed("tag", "__row"), "stay")
    # Whole rows are moved only if the tags are too many to send round.
    once = tagged.join(jaccard.small(stay.filter("copies = 1").select("__row"), 16), "__row", "left_semi")
    more = tagged.join(jaccard.small(stay.filter("copies > 1").select("__row"), 16), "__row", "left_semi").dropDuplicates(["__row"])
    return once.unionByName(more).select(docs.columns)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a window of a benchmark item."""
    return contamination.contamination(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span masked and ``n_chars`` counted anew where the text changed."""
    small_batches(spark)
    clean = secrets.masked(docs.withColumn("__text", F.col("text")), secrets.train(docs))
    n = F.when(F.col("text").eqNullSafe(F.col("__text")), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with their digests, beside the other columns."""
    small_batches(spark)
    return tokens.digests(tokens.encode(docs), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", not_contaminated),
    ("secret_scan", without_secrets),
    ("byte_level_bpe", encoded),
]

#: The stages hold trained models, connected components and byte pairs, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
