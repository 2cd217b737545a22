"""Reading, writing and maintaining tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import col, plain_number, slug


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """Catalog table by name, or a Parquet directory by path."""
    return spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)


def scan_events(df: DataFrame, date_col: str, start: dt.date, end: dt.date, source: str | None = None,
                source_col: str = "source") -> DataFrame:
    """Event-log scan pruned by date and source. Dates are compared on the
    column's own type, without a cast around it, so partitions are skipped."""
    kind = dict(df.dtypes)[date_col]
    lo, hi = (F.lit(d.isoformat() if kind == "string" else d) for d in (start, end))
    out = df.filter((F.col(date_col) >= lo) & (F.col(date_col) <= hi))
    return out if source is None else out.filter(F.col(source_col) == source)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True,
             encoding: str = "UTF-8") -> DataFrame:
    """Delimited text; give the schema as DDL, inference would read all data twice."""
    r = spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
    return (r.schema(schema) if schema else r).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("encoding", encoding).csv(path)


def jdbc_options(url: str, table: str, partition_column: str | None = None, lower: int | None = None,
                 upper: int | None = None, partitions: int = 64, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options; with a partition column the table is read in parallel
    ranges instead of through one connection."""
    out = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs lower and upper bounds")
        out |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                "numPartitions": str(partitions)}
    return out


def import_jdbc(spark: SparkSession, target: str, properties: Mapping[str, str] | None = None, **options) -> None:
    """Database table -> managed table."""
    reader = spark.read.format("jdbc").options(**jdbc_options(**options))
    reader.options(**(properties or {})).load().write.mode("overwrite").saveAsTable(target)


LINE = "__line"


def read_lines(spark: SparkSession, path: str, columns: int, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Header-less sheet as text columns, with the place of each line: file, offset of
    the block and number within it. Files are in the order of their names."""
    names = [f"c{i}" for i in range(columns)]
    lines = spark.read.option("sep", sep).option("encoding", encoding).schema(", ".join(f"{n} string" for n in names)).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
    return lines.select(*names, place.alias(LINE))


def promote_header(df: DataFrame, row: int) -> DataFrame:
    """Use the row-th line of a sheet from ``read_lines`` as column names.

    Lines up to it are preamble and are dropped by their place, so a data line that
    repeats one of them stays. Only those row + 1 lines come to the driver; names
    are made column-safe and unique.
    """
    head = df.orderBy(LINE).limit(row + 1).collect()
    names, seen = [], {}
    for i, v in enumerate(head[row][:-1]):
        s = slug(v) if v else f"col_{i}"
        seen[s] = seen.get(s, 0) + 1
        names.append(s if seen[s] == 1 else f"{s}_{seen[s]}")
    last = head[row][LINE]
    data = df.filter(F.col(LINE) > F.struct(F.lit(last["file"]).alias("file"), F.lit(last["block"]).alias("block"), F.lit(last["line"]).alias("line")))
    return data.drop(LINE).toDF(*names)


def clean_sheet(df: DataFrame, header_row: int, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None,
                numbers: Sequence[str] = ()) -> DataFrame:
    """Exported sheet -> typed table: header promoted, columns dropped and
    renamed, thousands commas removed from number columns."""
    out = promote_header(df, header_row).drop(*drop)
    out = out.withColumnsRenamed(dict(rename or {}))
    return out.withColumns({c: plain_number(c) for c in numbers})


def json_map_rows(df: DataFrame, doc: str, attributes: str, key_name: str = "key", keep: Sequence[str] = ()) -> DataFrame:
    """JSON document {key: {attributes}} -> one row per key."""
    m = F.from_json(doc, f"map<string,struct<{attributes}>>")
    return df.select(*keep, F.explode(m).alias(key_name, "__v")).select(*keep, key_name, "__v.*")


def append_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Append Parquet by date; rows are gathered per partition value and large values
    are split by size, so none turns into one huge file or thousands of small ones."""
    df.hint("rebalance", by).write.mode("append").partitionBy(by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the date partitions present in ``df``; safe to run again."""
    writer = df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).parquet(path)


def create_partitioned_table(spark: SparkSession, name: str, columns: str, by: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({by}){where}")


def write_event_store(df: DataFrame, table: str, path: str, day: str, source: str, key: str, buckets: int) -> None:
    """Events as a catalog table in folders by day and source, dealt into ``buckets`` by the key and sorted by it.

    A filter on day or source skips folders. Aggregates and joins by the key need no shuffle of the events: all rows of a key lie in one bucket of each folder, and tables with the
    same number of buckets meet bucket by bucket. Rows are dealt as Spark deals buckets, so each folder gets one file for each bucket. A key that
    holds much of a day makes one large file: keep such tables for keys without hot values (checkouts, not merchants); rows without a key are one bucket.
    """
    dealt = df.repartition(buckets, F.col(key))
    dealt.write.partitionBy(day, source).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def insert_select(df: DataFrame, table: str) -> None:
    """INSERT INTO table SELECT …, columns matched by name."""
    cols = df.sparkSession.table(table).columns
    df.select(*cols).write.insertInto(table)


def add_int_columns(spark: SparkSession, table: str, names: Sequence[str]) -> None:
    have = set(spark.table(table).columns)
    new = [n for n in names if n not in have]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(n + ' int' for n in new)})")


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Table after deleting the keys (anti join; a NULL key deletes nothing)."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def rebuild_with_today(spark: SparkSession, table: str, today: DataFrame, day_col: str, location: str) -> DataFrame:
    """Rebuild a table as its rows of other days and today's rows; ``<table>_backup`` keeps the rows as they were.

    The new rows are written to a folder of their own under ``location``, however often this runs. Then two names are switched, each by one change of a
    location in the catalog: first the backup, to the folder that the table is in now, then the table, to the new folder. The table has a name and whole rows at
    every moment; a run that is killed leaves it as it was, or done. The rows of the backup before go out of use with the third run; their folder is not removed.
    """
    old = spark.table(table)
    if spark.catalog.listColumns(table) and any(c.isPartition for c in spark.catalog.listColumns(table)):
        raise ValueError(f"{table} is partitioned: its days are replaced by overwrite_partitions or a FactStore")
    folder = f"{location.rstrip('/')}/run-{uuid.uuid4().hex}"
    days = today.select(day_col).distinct()
    kept = old.alias("o").join(days.withColumnRenamed(day_col, "__day"), F.col(f"o.{day_col}").eqNullSafe(F.col("__day")), "left_anti")
    kept.select(*old.columns).unionByName(today.select(*old.columns)).write.parquet(folder)
    before = table_location(spark, table)
    if spark.catalog.tableExists(f"{table}_backup"):
        spark.sql(f"ALTER TABLE {table}_backup SET LOCATION '{before}'")
    else:
        spark.catalog.createTable(f"{table}_backup", path=before, source="parquet", schema=old.schema)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
    return spark.table(table)


def table_location(spark: SparkSession, table: str) -> str:
    """Folder that a catalog table is in."""
    return next(r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect() if r["col_name"] == "Location")


def publish_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def label_run(df: DataFrame, label: str, column: str = "period") -> DataFrame:
    return df.withColumn(column, F.lit(label))


def append_run(history: DataFrame, run: DataFrame, label: str, column: str = "period") -> DataFrame:
    """History with one labelled snapshot; a repeated label replaces its old rows."""
    kept = history.filter(~F.col(column).eqNullSafe(F.lit(label)))
    return kept.unionByName(label_run(run, label, column), allowMissingColumns=True)


def only_new(candidate: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not published yet."""
    return candidate.join(published.select(*keys).distinct(), list(keys), "left_anti")


def days_between(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per calendar day, end included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))


def backfill(df: DataFrame, day: Column | str, start: dt.date, end: dt.date, aggregate, path: str, by: str) -> None:
    """All days of a range in one job: filter once, aggregate per day, overwrite
    the touched partitions. Replaces a loop with one job per day."""
    picked = df.filter((col(day) >= F.lit(start)) & (col(day) <= F.lit(end)))
    overwrite_partitions(aggregate(picked), path, by)
