import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartlens.operators import coverage, journey
from cartlens.operators.identity import label_repeat, new_vs_repeat

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "i long, c string, ts timestamp_ntz, e string"


def some_events(seed, n, keys=12):
    r = random.Random(seed)
    return [(i, r.choice([None, "hot", *[f"c{k}" for k in range(keys)]]), r.choice([None, *[T0 + dt.timedelta(seconds=r.choice([0, 1, r.randrange(9000)]))] * 6]), r.choice(["a", "b", None]))
            for i in range(n)]


def paths(rows):
    out = {}
    for i, c, t, e in sorted((x for x in rows if x[1] is not None and x[2] is not None), key=lambda x: (x[2], x[0])):
        out.setdefault(c, []).append(e)
    return out


@pytest.mark.parametrize("chunk", [60, 10**6])
def test_tree_equals_strings(spark, chunk):
    rows = some_events(5, 400)
    tree = journey.journey_tree(spark.createDataFrame(rows, SCHEMA), "c", "ts", "i", "e", chunk).collect()
    through, ends = Counter(), Counter()
    for p in paths(rows).values():
        ends[tuple(p)] += 1
        for n in range(1, len(p) + 1):
            through[tuple(p[:n])] += 1
    nodes = {x["node"]: x for x in tree}
    assert len(nodes) == len(tree) == len(through)

    def path_of(x):
        out = []
        while x is not None:
            out.append(x["event"])
            up = x["parent"]
            assert (up in nodes) == (x["depth"] > 1) and (x["depth"] > 1 or set(up) == {0})
            x = nodes.get(up)
        return tuple(reversed(out))

    assert {path_of(x): (x["depth"], x["checkouts"], x["ends"]) for x in tree} == {p: (len(p), n, ends[p]) for p, n in through.items()}


def test_long_journey_of_one_checkout(spark):
    """A path of many events is as many nodes, none of which holds the path."""
    n = 50_000
    d = spark.range(n).select(F.col("id").alias("i"), F.lit("hot").alias("c"), F.timestamp_seconds(F.col("id") * 3).alias("ts"), F.when(F.col("id") % 7 == 0, "a").otherwise("b").alias("e"))
    tree = journey.journey_tree(d, "c", "ts", "i", "e")
    assert tuple(tree.agg(F.count("*"), F.countDistinct("node"), F.max("depth"), F.sum("ends"), F.max(F.octet_length("event"))).first()) == (n, n, n, 1, 1)


def test_frequent_paths(spark, rows):
    src = [(i, f"c{i % 20}", T0 + dt.timedelta(seconds=i), "ab"[i % 20 % 3 == 0]) for i in range(60)] + [(99, "c1", T0 + dt.timedelta(days=1), "z"), (100, None, T0, "a"), (101, "c2", None, "a")]
    want = Counter(",".join(p) for p in paths(src).values())
    got = journey.frequent_paths(spark.createDataFrame(src, SCHEMA), "c", "ts", "i", "e", 2)
    assert rows(got) == sorted((p, n) for p, n in want.items() if n >= 2)


def test_paths_leave_out_events_without_place(spark, rows):
    src = [(1, None, T0, "a"), (2, None, T0, "b"), (3, "c", None, "first?"), (4, "c", T0, "x")]
    assert rows(journey.journey_paths(spark.createDataFrame(src, SCHEMA), "c", "ts", "i", "e")) == [("c", "x", 1)]


def test_nothing_unblocked_makes_nobody_eligible(spark):
    d = spark.createDataFrame([(1, "r1"), (1, "r2"), (2, "r3")], "m long, reason string")
    assert {r["eligible_now"] for r in coverage.ineligible_reasons(d, "m", "reason", []).collect()} == {False}


def test_devices_without_id_are_kept_and_have_no_label(spark, rows):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z"), (None, 2, "z"), ("b", 2, None)], "device string, day int, ident string")
    assert rows(label_repeat(d, "device", "day").select("device", "day", "visitor")) == [("a", 1, "new"), ("a", 2, "repeating"), ("b", 2, "new"), (None, 1, None), (None, 2, None)]
    got = new_vs_repeat(d, "device", "day", "ident").select("visitor", "devices", "checkouts")
    assert rows(got) == [("new", 2, 1), ("repeating", 1, 1), (None, 0, 1)]
