import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cartlens.operators.facts import build_checkout_fact, sessionize
from cartlens.streaming import live

SCHEMA = "id long, k string, m long, e string, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def write_files(spark, path, files):
    for i, f in enumerate(files):
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/f{i}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_fact_log_equals_batch_fact(spark, rows, tmp_path):
    r = random.Random(3)
    src = [(i, f"c{r.randrange(20)}", 1, r.choice(["open", "paid"]), T0 + dt.timedelta(hours=r.randrange(72))) for i in range(200)]
    write_files(spark, str(tmp_path / "in"), [src[:80], src[80:150], src[150:]])
    out = str(tmp_path / "log")
    write = writer(spark, out)

    def twice(batch, n):   # a batch repeated after a failure must not count twice
        write(batch, n)
        write(batch, n)

    q = stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(live.read_fact_log(spark, out)) == rows(built(spark, src))


def columns():
    """Flags, first dates and sums of the fact."""
    return {"open": F.col("e") == "open", "paid": F.col("e") == "paid"}, {"day": F.min(F.to_date("ts"))}, {"events": F.count("*")}


def built(spark, rows):
    flags, first, sums = columns()
    return build_checkout_fact(spark.createDataFrame(rows, SCHEMA), flags, "k", {**first, **sums})


def writer(spark, path, **options):
    flags, first, sums = columns()
    return live.fact_log_writer(spark, path, flags, "k", first, sums, **options)


def test_fact_log_is_read_from_few_folders(spark, rows, tmp_path):
    r = random.Random(9)
    src = [(i, f"c{r.randrange(9)}", 1, r.choice(["open", "paid"]), T0 + dt.timedelta(hours=r.randrange(72))) for i in range(120)]
    out = str(tmp_path / "log")
    write = writer(spark, out, fan=3)
    for n in range(20):
        write(spark.createDataFrame(src[6 * n:6 * n + 6], SCHEMA), n)
        if n == 11:
            write(spark.createDataFrame(src[:6], SCHEMA), 0)       # an old batch again
    state = live.Versions(spark, out).manifest()
    assert len(state["entries"]) <= 2 * 3 and state["streams"] == {"events": 19}
    assert rows(live.read_fact_log(spark, out)) == rows(built(spark, src))
    assert rows(live.read_fact_log(spark, out, 5)) == rows(built(spark, src[:30]))     # as it was
    more = writer(spark, out, stream="second", fan=3)
    more(spark.createDataFrame(src[:6], SCHEMA), 0)                              # another stream counts by itself
    assert rows(live.read_fact_log(spark, out)) == rows(built(spark, src + src[:6]))


KEYS = ["m", "dt", "device_id"]
EVENTS = "event_id long, m long, dt date, device_id string, ts timestamp"


def session_events(r, n):
    """Days of two merchants with gaps around half an hour, a hot device and events without one."""
    out = []
    for i in range(n):
        t = T0 + dt.timedelta(hours=8, seconds=r.choice([0, 1800, 3600, 9000]) + r.choice([0, 1, 1799, 1800, 1801, r.randrange(1800)]) + r.randrange(4) * 7200, microseconds=r.choice([0, 1, 999_999]))
        out.append((i, r.randrange(2), t.date(), r.choice(["hot", "hot", "a", "b", None]), t))
    return out


def late_order(r, events, lateness):
    """Events in an order in which none is later than the lateness, against the greatest time before it."""
    return sorted(events, key=lambda e: (e[4].timestamp() + r.random() * lateness))


@pytest.mark.parametrize("seed, files", [(1, 1), (2, 3), (3, 9)])
def test_sessions_of_a_stream_equal_the_batch(spark, rows, tmp_path, seed, files):
    r = random.Random(seed)
    src = late_order(r, session_events(r, 150), 3000)
    last = [(10_000 + i, 9, T0.date(), "end", T0 + dt.timedelta(days=2 + i)) for i in range(2)]
    parts = [src[len(src) * i // files:len(src) * (i + 1) // files] for i in range(files)] + [[x] for x in last]
    for i, f in enumerate(parts):
        spark.createDataFrame(f, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    settings = {"spark.sql.streaming.stateStore.providerClass": live.ROCKS, "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    name = f"sessions_{seed}"
    try:
        s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = live.stream_sessions(s, KEYS, "ts", "1 hour").writeStream.format("memory").queryName(name).outputMode("append").option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = spark.table(name).filter("m <> 9")
    batch = sessionize(spark.createDataFrame(src, EVENTS), KEYS, "ts", "event_id")
    want = batch.filter("session_no IS NOT NULL").groupBy(*KEYS, "session_no", "session_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))
    assert rows(got) == rows(want.select(*got.columns)) and got.count() > 20
    events = live.session_of(spark.createDataFrame(src, EVENTS), got, KEYS, "ts")
    assert rows(events.select("event_id", "session_no", "session_id")) == rows(batch.select("event_id", "session_no", "session_id"))


def test_sessions_need_a_store_with_timers(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        live.stream_sessions(spark.createDataFrame([], EVENTS), KEYS, "ts")


def test_hourly_ids_equal_batch_counts(spark, rows, tmp_path):
    r = random.Random(5)
    src = [(i, f"c{r.randrange(9)}", r.randrange(2), r.choice(["open", "paid", "x"]), T0 + dt.timedelta(minutes=i)) for i in range(300)]
    end = [(999, "z", 0, "open", T0 + dt.timedelta(days=2))]     # moves the watermark past all hours
    write_files(spark, str(tmp_path / "in"), [src[:150], src[150:], end, [(1000, "z", 0, "open", T0 + dt.timedelta(days=2))]])
    step = F.when(F.col("e").isin("open", "paid"), F.col("e"))
    q = live.hourly_ids(stream(spark, str(tmp_path / "in")), "ts", "m", step, "k").writeStream.format("memory").queryName("hourly").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    d = spark.createDataFrame(src, SCHEMA).filter("e <> 'x'")
    want = d.groupBy(F.date_trunc("hour", "ts").alias("hour"), "m", F.col("e").alias("step")).agg(F.countDistinct("k").alias("ids"))
    assert rows(spark.table("hourly")) == rows(want)
