import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartlens.functions import expr as x
from cartlens.functions import periods


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("value,left,right", [
    (0.0, "[0, 500)", None), (499.9, "[0, 500)", "(0, 500]"), (500.0, "[500, 1000)", "(0, 500]"), (1000.0, None, "(500, 1000]"),
    (-1.0, None, None), (1000.1, None, None), (None, None, None)])
def test_band_edges(spark, value, left, right):
    assert one(spark, value, "double", x.bands("v", [0, 500, 1000])) == left
    assert one(spark, value, "double", x.bands("v", [0, 500, 1000], right_closed=True)) == right


@pytest.mark.parametrize("doc,expected", [
    ('{"a": {"b": 5}}', 5), ('{"a": {"c": 7}}', 7), ("{broken", None), ('{"a": {"b": "x"}}', None), (None, None), ('{"a": {"b": ""}}', None)])
def test_json_number_falls_back(spark, doc, expected):
    assert one(spark, doc, "string", x.json_number("v", "$.a.b", "$.a.c")) == expected


@pytest.mark.parametrize("text,expected", [("true", True), ("TRUE", True), ("", None), ("zzz", None), ("false", False)])
def test_json_bool(spark, text, expected):
    assert one(spark, '{"f": "%s"}' % text, "string", x.json_bool("v", "$.f")) is expected


def test_json_dotted_key_and_index(spark):
    doc = '{"m": {"count.cards": 3}, "l": ["p", "q"]}'
    assert one(spark, doc, "string", x.json_text("v", "$.m['count.cards']")) == "3"
    assert one(spark, doc, "string", x.json_text("v", "$.l[1]")) == "q"


def test_ratio_zero_and_null(spark):
    d = spark.createDataFrame([(1, 0), (0, 0), (3, 4), (None, 2), (2, None)], "a int, b int")
    assert [r[0] for r in d.select(x.ratio("a", "b")).collect()] == [None, None, 0.75, None, None]


def test_flag_treats_null_as_false(spark):
    assert one(spark, None, "int", x.flag(F.col("v") > 1)) == 0


def test_not_equal_or_null_keeps_null(spark):
    d = spark.createDataFrame([("x",), ("y",), (None,)], "v string")
    assert d.filter(x.not_equal_or_null("v", "x")).count() == 2


def test_contains_any_is_literal(spark):
    assert one(spark, "a.b", "string", x.contains_any("v", ["a.b"])) is True
    assert one(spark, "axb", "string", x.contains_any("v", ["a.b"])) is False


@pytest.mark.parametrize("n,text", [(7, "7"), (999, "999"), (1000, "1,000"), (123456, "1,23,456"), (1234567, "12,34,567"), (123456789, "12,34,56,789")])
def test_indian_grouping(spark, n, text):
    assert one(spark, n, "long", x.indian_grouping("v")) == text


def test_plain_number(spark):
    assert one(spark, "₹ 1,23,456.50", "string", x.plain_number("v")) == 123456.5
    assert one(spark, "n/a", "string", x.plain_number("v")) is None


def test_slug_columns(spark):
    d = spark.createDataFrame([(1, 2, 3)], "`GMV (INR)` int, `gmv inr` int, ` ` int")
    assert x.slug_columns(d).columns == ["gmv_inr", "gmv_inr_2", "col"]


def test_hex_channel(spark):
    assert one(spark, "#ff8000", "string", x.hex_channel("v", 0)) == 1.0
    assert one(spark, "ff8000", "string", x.hex_channel("v", 2)) == 0.0


def test_local_date_crosses_midnight(spark):
    late = int(dt.datetime(2024, 1, 31, 19, 0, tzinfo=dt.timezone.utc).timestamp())
    assert one(spark, late, "long", x.local_date("v", "Asia/Kolkata")) == dt.date(2024, 2, 1)
    assert one(spark, late, "long", x.local_date("v", "UTC")) == dt.date(2024, 1, 31)


def test_weeks_keep_the_year(spark):
    a = one(spark, dt.date(2024, 12, 30), "date", periods.period_start("v", "week"))
    b = one(spark, dt.date(2024, 1, 1), "date", periods.period_start("v", "week"))
    assert a == dt.date(2024, 12, 30) and b == dt.date(2024, 1, 1)


def test_periods_over_january():
    assert periods.last_whole_periods(dt.date(2024, 1, 10), "month", 2) == (dt.date(2023, 11, 1), dt.date(2024, 1, 1))
    assert periods.last_whole_periods(dt.date(2024, 1, 10), "week", 1) == (dt.date(2024, 1, 1), dt.date(2024, 1, 8))
    assert periods.prior_days(dt.date(2024, 1, 3)) == (dt.date(2023, 12, 27), dt.date(2024, 1, 3))


@pytest.mark.parametrize("day,month", [(dt.date(2024, 3, 13), "2024-01"), (dt.date(2024, 3, 14), "2024-02"), (dt.date(2024, 1, 13), "2023-11"),
                                       (dt.date(2024, 1, 14), "2023-12"), (dt.date(2024, 2, 1), "2023-12")])
def test_cutoff_month(day, month):
    assert periods.cutoff_month(day) == month
