import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartlens import session
from cartlens.sources import io


def test_jdbc_options_partition_the_read():
    o = io.jdbc_options("jdbc:x", "t", "id", 0, 1000, 8)
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "0", "1000", "8")
    assert "partitionColumn" not in io.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        io.jdbc_options("jdbc:x", "t", "id")


def test_csv_round_trip_with_separator(spark, rows, tmp_path):
    d = spark.createDataFrame([(1, "a;b", 1.5), (2, None, None)], "i long, s string, v double")
    io.write_csv(d, str(tmp_path / "c"), sep="|")
    assert rows(io.read_csv(spark, str(tmp_path / "c"), "i long, s string, v double", "|")) == [(1, "a;b", 1.5), (2, None, None)]


def test_overwrite_partitions_is_idempotent(spark, rows, tmp_path):
    p = str(tmp_path / "t")
    d = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)], "day date, v long")
    io.append_partitioned(d, p, "day")
    new = d.filter("day = '2024-01-02'").withColumn("v", F.lit(9).cast("long"))
    for _ in range(2):
        io.overwrite_partitions(new, p, "day")
    assert rows(spark.read.parquet(p).select("day", "v")) == [(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 9)]


def test_scan_is_pruned_on_partition_column(spark, tmp_path):
    p = str(tmp_path / "e")
    d = spark.range(30).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("day"), F.lit("web").alias("source"), "id")
    io.append_partitioned(d, p, "day")
    q = io.scan_events(spark.read.parquet(p), "day", dt.date(2024, 1, 5), dt.date(2024, 1, 6), "web")
    plan = q._jdf.queryExecution().toString()
    assert q.count() == 2 and "PartitionFilters: [isnotnull(day" in plan
    text_day = d.withColumn("day", F.col("day").cast("string"))
    assert io.scan_events(text_day, "day", dt.date(2024, 1, 5), dt.date(2024, 1, 6)).count() == 2


def test_clean_sheet(spark, rows, tmp_path):
    lines = ["Report;;", "Item Name;Price (INR);Price (INR)", "a;1,200;x", "b;3;y", "Report;;", "Item Name;Price (INR);Price (INR)"]
    (tmp_path / "a.csv").write_text("\n".join(lines[:3]))
    (tmp_path / "b.csv").write_text("\n".join(lines[3:] + ["c;4;z"] * 5000))
    out = io.clean_sheet(io.read_lines(spark, str(tmp_path), 3, ";"), 1, drop=["price_inr_2"], rename={"item_name": "item"}, numbers=["price_inr"])
    assert out.columns == ["item", "price_inr"] and out.count() == 5004
    assert rows(out.filter("item <> 'c' or item is null").select("item")) == [("Item Name",), ("Report",), ("a",), ("b",)]


def test_json_map_rows(spark, rows):
    d = spark.createDataFrame([('{"x": {"n": 1}, "y": {"n": null}}',), ("{broken",), (None,)], "doc string")
    assert rows(io.json_map_rows(d, "doc", "n: bigint")) == [("x", 1), ("y", None)]


def test_append_run_replaces_same_label(spark, rows):
    h = io.label_run(spark.createDataFrame([(1,)], "v long"), "may")
    run = spark.createDataFrame([(2, "new")], "v long, extra string")
    once = io.append_run(h, run, "june")
    assert rows(io.append_run(once, run, "june").select("v", "period")) == [(1, "may"), (2, "june")]


def test_without_keys_ignores_null_keys(spark, rows):
    d = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    assert rows(io.without_keys(d, spark.createDataFrame([(2,), (None,)], "k long"), "k")) == [(1,), (None,)]


def test_only_new(spark, rows):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k long, s string, v long")
    assert rows(io.only_new(a, a.filter("k = 1"), ["k", "s"])) == [(2, "y", 6)]


def test_scratch_dir_uses_the_shared_folder(spark, tmp_path):
    class Conf:
        def get(self, name, default=None):
            return f"{tmp_path}/" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert session.scratch_dir(Session(), "x").startswith(f"{tmp_path}/x-")


def test_scratch_dir_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.scratch_dir(Session(), "x")


def test_rebuild_keeps_a_backup_and_can_run_every_day(spark, rows, tmp_path):
    name = "t_rebuild_" + tmp_path.name.replace("-", "_")
    old = spark.createDataFrame([(1, "mon"), (2, "tue"), (0, None)], "v long, day string")
    old.write.option("path", str(tmp_path / "old")).saveAsTable(name)
    where = str(tmp_path / "new")
    out = io.rebuild_with_today(spark, name, spark.createDataFrame([(3, "tue"), (4, "tue")], "v long, day string"), "day", where)
    first = [(0, None), (1, "mon"), (3, "tue"), (4, "tue")]
    assert rows(out) == first and rows(spark.table(name)) == first
    assert rows(spark.table(f"{name}_backup")) == rows(old)
    io.rebuild_with_today(spark, name, spark.createDataFrame([("wed", 5)], "day string, v long"), "day", where)      # the next day
    assert rows(spark.table(name)) == [*first, (5, "wed")]
    assert rows(spark.table(f"{name}_backup")) == first
    io.rebuild_with_today(spark, name, spark.createDataFrame([(6, "wed")], "v long, day string"), "day", where)      # the same day again
    assert rows(spark.table(name)) == [*first, (6, "wed")]
    assert rows(spark.table(f"{name}_backup")) == [*first, (5, "wed")]
    for t in (name, f"{name}_backup"):
        spark.sql(f"DROP TABLE {t}")


def test_rebuild_that_fails_leaves_table_and_backup(spark, rows, tmp_path):
    name = "t_failed_" + tmp_path.name.replace("-", "_")
    old = spark.createDataFrame([(1, "mon")], "v long, day string")
    old.write.option("path", str(tmp_path / "old")).saveAsTable(name)
    io.rebuild_with_today(spark, name, spark.createDataFrame([(2, "tue")], "v long, day string"), "day", str(tmp_path / "new"))
    broken = spark.createDataFrame([(3, "wed")], "v long, day string").withColumn("v", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        io.rebuild_with_today(spark, name, broken, "day", str(tmp_path / "new"))
    assert rows(spark.table(name)) == [(1, "mon"), (2, "tue")] and rows(spark.table(f"{name}_backup")) == [(1, "mon")]
    for t in (name, f"{name}_backup"):
        spark.sql(f"DROP TABLE {t}")


def test_stored_events_are_pruned_and_not_shuffled(spark, rows, tmp_path):
    name = "t_store_" + tmp_path.name.replace("-", "_")
    src = [(f"c{i % 9}" if i % 10 else None, dt.date(2024, 1, 1 + i % 5), "ab"[i % 2], i) for i in range(200)]
    d = spark.createDataFrame(src, "c string, day date, source string, v long")
    io.write_event_store(d, name, str(tmp_path / "e"), "day", "source", "c", 4)
    t = spark.table(name)
    assert rows(t.select(*d.columns)) == rows(d)
    assert len(list((tmp_path / "e").rglob("part-*.parquet"))) <= 5 * 2 * 4
    scan = io.scan_events(t, "day", dt.date(2024, 1, 2), dt.date(2024, 1, 3), "a")
    assert scan.count() == sum(s == "a" and 2 <= x.day <= 3 for _, x, s, _ in src)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "source" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = t.groupBy("c").agg(F.count("*").alias("n")).join(t.filter("v > 50").groupBy("c").agg(F.max("v").alias("top")), "c", "left")
        assert "Exchange" not in fact._jdf.queryExecution().executedPlan().toString()
        assert fact.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE {name}")


def test_days_between(spark):
    assert io.days_between(spark, dt.date(2024, 2, 27), dt.date(2024, 3, 1)).count() == 4
