import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cartlens.sources.fact_store import FactStore
from cartlens.sources.versions import OtherWriter, Versions, with_entry

FACT = "k string, a int, b int, day date"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def merged(*deltas):
    out = {}
    for rows in deltas:
        for k, a, b, d in rows:
            o = out.get(k, (a, b, d))
            out[k] = (max(a, o[0]), max(b, o[1]), min((x for x in (d, o[2]) if x), default=None))
    return sorted(((k, *v) for k, v in out.items()), key=str)


def content(store, version=None):
    return sorted((tuple(r) for r in store.read(version).select("k", "a", "b", "day").collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return FactStore(spark, str(tmp_path / "fact"), "k", "day", ["a", "b"], buckets=4)


def test_any_split_of_the_rows_gives_one_fact(spark, store):
    r = random.Random(3)
    rows = [(r.choice([None, *[f"c{i}" for i in range(40)]]), r.randrange(2), r.randrange(3), r.choice([None, day(r.randrange(90))])) for _ in range(400)]
    deltas, at = [], 0
    while at < len(rows):
        deltas.append(rows[at:(at := at + r.choice([1, 7, 60]))])
    for n, d in enumerate(deltas):
        store.upsert(spark.createDataFrame(d, FACT))
        if n % 5 == 0:
            assert content(store) == merged(*deltas[:n + 1])
    assert content(store) == merged(rows)
    assert content(store, 1) == merged(deltas[0])         # old versions stay readable
    assert {r["key"]: r["day"] for r in store.locator().collect()} == {k: d for k, _, _, d in merged(rows)}
    assert len(store.versions.manifest()["keys"]) <= 2 * 7  # fewer than 8 folders for each level


def test_only_days_that_hold_touched_keys_are_read(spark, store):
    store.upsert(spark.createDataFrame([("old", 1, 0, day(-900)), ("x", 0, 0, day(0)), ("y", 0, 0, day(1)), ("z", 0, 0, day(1))], FACT))
    delta = spark.createDataFrame([("old", 0, 1, day(3)), ("y", 1, 0, day(2)), ("new", 1, 1, day(0)), ("new", 0, 2, day(5))], FACT)
    want = [("new", 1, 2, day(0)), ("old", 1, 1, day(-900)), ("x", 0, 0, day(0)), ("y", 1, 0, day(1)), ("z", 0, 0, day(1))]
    assert store.upsert(delta) == [f"day={day(-900)}", f"day={day(1)}"]      # a key of any age; day 0 only gets a row more
    assert content(store) == want
    store.upsert(delta)
    assert content(store) == want
    assert store.upsert(delta.limit(0)) == []
    assert content(store) == want
    plan = store.read().filter(F.col("day") == F.lit(day(1)))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_key_moves_to_an_earlier_day_and_from_no_day(spark, store):
    store.upsert(spark.createDataFrame([("a", 0, 0, day(5)), ("n", 0, 0, None)], FACT))
    store.upsert(spark.createDataFrame([("a", 0, 1, day(2)), ("n", 1, 0, None)], FACT))
    assert content(store) == [("a", 0, 1, day(2)), ("n", 1, 0, None)]
    store.upsert(spark.createDataFrame([("n", 0, 0, day(7)), ("a", 0, 0, None)], FACT))
    assert content(store) == [("a", 0, 1, day(2)), ("n", 1, 0, day(7))]
    assert sorted(store.versions.manifest()["days"]) == [f"day={day(2)}", f"day={day(7)}"]


@pytest.mark.parametrize("step", ["write", "publish", "rename"])
def test_a_killed_writer_leaves_the_last_version(spark, store, monkeypatch, step):
    first, second = [("a", 1, 0, day(0)), ("b", 1, 0, day(1))], [("a", 0, 1, day(1)), ("c", 1, 1, day(0))]
    store.upsert(spark.createDataFrame(first, FACT))

    class Killed(Exception):
        pass

    with monkeypatch.context() as m:
        if step == "rename":  # after the draft of the manifest
            class Broken:
                def __init__(self, fs):
                    self.fs = fs

                def __getattr__(self, name):
                    if name == "rename":
                        raise Killed
                    return getattr(self.fs, name)

            m.setattr(store.versions, "_fs", Broken(store.versions._fs))
        else:
            calls, real = [], getattr(Versions, step)

            def stop(self, *args):
                calls.append(1)
                if step == "publish" or len(calls) == 2:  # the second folder: rows are written, the locator is not
                    raise Killed
                return real(self, *args)

            m.setattr(Versions, step, stop)
        with pytest.raises(Killed):
            store.upsert(spark.createDataFrame(second, FACT))
    assert content(store) == merged(first)
    store.upsert(spark.createDataFrame(second, FACT))
    assert content(store) == merged(first, second)


def test_two_writers_cannot_both_publish(spark, store):
    store.upsert(spark.createDataFrame([("a", 1, 0, day(0))], FACT))
    late = store._state()
    store.upsert(spark.createDataFrame([("b", 1, 0, day(0))], FACT))
    with pytest.raises(OtherWriter):
        store.versions.publish(late, late["version"])
    assert [k for k, *_ in content(store)] == ["a", "b"]


def test_delete_and_return(spark, store):
    store.upsert(spark.createDataFrame([("a", 1, 1, day(0)), ("b", 1, 0, day(0)), ("c", 1, 0, day(9)), (None, 1, 0, day(9))], FACT))
    assert store.delete(spark.createDataFrame([("a",), (None,), ("nobody",), ("a",)], "k string")) == [f"day={day(0)}"]
    assert content(store) == sorted([("b", 1, 0, day(0)), ("c", 1, 0, day(9)), (None, 1, 0, day(9))], key=str)
    store.upsert(spark.createDataFrame([("a", 0, 0, day(4))], FACT))        # comes back as a new key
    assert ("a", 0, 0, day(4)) in content(store)
    store.delete(spark.createDataFrame([("c",), (None,)], "k string"))
    assert sorted(k for k in store.versions.manifest()["days"]) == [f"day={day(n)}" for n in (0, 4, 9)]


def test_expired_versions_take_their_folders_along(spark, store):
    for n in range(4):
        store.upsert(spark.createDataFrame([("a", n, 0, day(0)), (f"k{n}", 0, 0, day(n))], FACT))
    want = content(store)
    assert store.expire(2) and store.versions.numbers() == [3, 4]
    assert content(store) == want and store.expire(2) == []
    assert content(store, 3) and pytest.raises(ValueError, store.read, 1)


def test_log_levels():
    log, merges = [], []

    def merge(folders, whole):
        merges.append((folders, whole))
        return "+".join(folders)

    for i in range(100):
        log = with_entry(log, str(i), merge, fan=3)
        assert "+".join(f for _, f in log) == "+".join(map(str, range(i + 1)))       # oldest first, nothing lost
        assert all(sum(lv == x for lv, _ in log) < 3 for x in range(9))
    assert any(w for _, w in merges) and not all(w for _, w in merges)


def test_session_without_settings_of_this_library(spark, tmp_path):
    """No setting of ``build_session`` is needed."""
    plain = spark.newSession()
    plain.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    assert isinstance(plain, SparkSession)
    store = FactStore(plain, str(tmp_path / uuid.uuid4().hex), "k", "day", ["a", "b"], buckets=4)
    for _ in range(2):
        store.upsert(plain.createDataFrame([("a", 1, 0, day(0)), ("b", 0, 1, day(1))], FACT))
    assert content(store) == [("a", 1, 0, day(0)), ("b", 0, 1, day(1))]
