"""A fact kept by days, into which deltas are merged by key, whatever the age of a key's row.

The store holds one row for each key, in the folder of its first day, and beside the rows a key locator: a log of (key, day), dealt into buckets by a hash of the key, that
says on which day a key's row lies. A delta asks the locator, reads the days that hold its keys and no others, and appends what is new. The work
is set by the delta and the days it touches, not by the history: the locator is a narrow scan (of the delta's buckets), met with the keys of the delta, which are sent round where they are few.

Every change is a version (``versions``): data folders are immutable, the switch is one rename, and a writer killed at any point leaves the last version.
Merging is by greatest flags and least day, so the same delta again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_dir
from .versions import FAN, Versions, with_entry

BUCKETS = 64


class FactStore:
    """One row for each ``key``: the greatest ``maxes`` and the least ``day`` of all rows merged in.

    Rows without a key are one key, as in a grouping. A key without any day lies in a folder of its own until a day is known.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, day: str, maxes: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.versions = spark, Versions(spark, root)
        self.key, self.day, self.maxes, self.buckets = key, day, list(maxes), buckets

    # -- reading

    def _state(self, version: int | None = None) -> dict:
        return {"days": {}, "keys": [], "schema": None, "buckets": self.buckets, **self.versions.manifest(version)}

    def _rows(self, state: dict, parts: Sequence[str]) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.versions.root}/{folder}/{part}" for part in parts for folder in state["days"].get(part, [])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.versions.root}/data").parquet(*paths)
        return found.select(*schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The fact as of a version; filters on the day skip the folders of other days."""
        state = self._state(version)
        if state["schema"] is None:
            raise ValueError(f"{self.versions.root} has no version yet")
        return self._rows(state, list(state["days"]))

    def _locator_log(self, state: dict, folders: Sequence[str]) -> DataFrame:
        kinds = {f["name"]: f for f in state["schema"]["fields"]}
        schema = StructType.fromJson({"type": "struct", "fields": [{**kinds[self.key], "name": "key"}, {**kinds[self.day], "name": "day"}]})
        schema = schema.add("version", "long").add("gone", "boolean").add("bucket", "integer")
        paths = [f"{self.versions.root}/{f}" for f in folders]
        read = self.spark.read.schema(schema).option("basePath", f"{self.versions.root}/data")
        return read.parquet(*paths).select(*schema.names) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _newest(log: DataFrame, *more: str) -> DataFrame:
        return log.groupBy("key", *more).agg(F.max_by(F.struct("day", "gone", "version"), "version").alias("x")).select("key", *more, "x.*")

    def locator(self, version: int | None = None) -> DataFrame:
        """(key, day): where the row of each key lies."""
        state = self._state(version)
        return self._newest(self._locator_log(state, [f for _, f in state["keys"]])).filter("NOT gone").select("key", "day")

    # -- writing

    def _bucket(self, key: str, state: dict) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(state["buckets"])).cast("int")

    def _written(self, df: DataFrame, purpose: str) -> DataFrame:
        """An intermediate that several steps read; it is no part of the store."""
        path = scratch_dir(self.spark, purpose)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _located(self, new: DataFrame, state: dict) -> DataFrame:
        """``new`` with ``old_day`` and whether the key is ``known``."""
        if not state["keys"]:
            return new.withColumns({"old_day": F.lit(None).cast(new.schema[self.day].dataType), "known": F.lit(False)})
        new = self._written(new, "delta")
        wanted = new.withColumn("bucket", self._bucket(self.key, state))
        log = self._locator_log(state, [f for _, f in state["keys"]])
        held = [r[0] for r in wanted.select("bucket").distinct().collect()]   # no more than there are buckets
        if len(held) < state["buckets"]:
            log = log.filter(F.col("bucket").isin(held))
        keys = wanted.select("bucket", F.col(self.key).alias("k"))
        hits = log.alias("l").join(keys, (log["bucket"] == keys["bucket"]) & log["key"].eqNullSafe(keys["k"])).select("l.*")
        hits = self._newest(hits).filter("NOT gone").select(F.col("key").alias("__key"), F.col("day").alias("old_day"), F.lit(True).alias("known"))
        out = new.join(hits, new[self.key].eqNullSafe(hits["__key"]), "left").drop("__key")
        return out.withColumn("known", F.coalesce("known", F.lit(False)))

    def _part(self, value) -> str:
        names = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return names.getPartitionPathString(self.day, None if value is None else str(value))

    def _commit(self, state: dict, rows: DataFrame, rewritten: set[str], log: DataFrame) -> None:
        """A version in which ``rows`` take the place of the ``rewritten`` days and are added to the others, and ``log`` extends the locator."""
        folder = self.versions.write(rows, [self.day])
        days = {p: list(f) for p, f in state["days"].items() if p not in rewritten}
        for part in self.versions.parts(folder):
            days.setdefault(part, []).append(folder)

        def merge(folders: list[str], whole: bool) -> str:
            newest = self._newest(self._locator_log(state, folders), "bucket")
            return self.versions.write(newest.filter("NOT gone") if whole else newest, ["bucket"])

        keys = with_entry(state["keys"], self.versions.write(log, ["bucket"]), merge)
        self.versions.publish({**state, "days": days, "keys": keys}, state["version"])

    def upsert(self, delta: DataFrame) -> list[str]:
        """Merge a delta (any number of rows for a key); returns the days that were read and rewritten.

        Keys that no day holds yet are appended to their day, in a folder of their own; a day of ``FAN`` such folders is put together when it is next added to.
        """
        new = delta.groupBy(self.key).agg(*[F.max(c).alias(c) for c in self.maxes], F.min(self.day).alias(self.day))
        state = self._state()
        if state["schema"] is None:
            state["schema"] = new.schema.jsonValue()
        found = self._written(self._located(new, state), "located")
        # Only days come to the driver: those of the rows that change, and those that rows go to.
        at = F.when(F.col("known"), F.col("old_day")).otherwise(F.col(self.day)).alias("at")
        places = found.groupBy("known", at).agg(F.lit(1)).collect() if state["days"] else []
        held = {self._part(r["at"]) for r in places if r["known"]}
        full = {p for r in places if len(state["days"].get(p := self._part(r["at"]), ())) >= FAN}
        rewritten = sorted(held | full)
        old = self._rows(state, rewritten)
        change = found.filter("known").select(F.col(self.key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in (*self.maxes, self.day)])
        merged = old.join(change, old[self.key].eqNullSafe(change["__key"]), "left").select(
            self.key, *[F.greatest(c, f"__{c}").alias(c) for c in self.maxes], F.least(self.day, f"__{self.day}").alias(self.day))
        columns = StructType.fromJson(state["schema"]).names
        rows = merged.unionByName(found.filter("NOT known").select(*columns)).select(*columns)
        placed = ~F.col("known") | (F.col(self.day) < F.col("old_day")) | (F.col("old_day").isNull() & F.col(self.day).isNotNull())
        log = found.filter(placed).select(F.col(self.key).alias("key"), F.col(self.day).alias("day"), F.lit(state["version"] + 1).cast("long").alias("version"),
                                          F.lit(False).alias("gone"), self._bucket(self.key, state).alias("bucket"))
        self._commit(state, rows, set(rewritten), log)
        return rewritten

    def delete(self, keys: DataFrame) -> list[str]:
        """Take out the rows of ``keys``; a NULL key takes out nothing. Returns the days that were rewritten."""
        state = self._state()
        if state["schema"] is None:
            return []
        if not state["keys"]:
            return []
        gone = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        found = self._written(self._located(gone, state).filter("known"), "located")
        rewritten = sorted(self._part(r[0]) for r in found.select("old_day").distinct().collect())
        rows = self._rows(state, rewritten).join(found.select(self.key), self.key, "left_anti")
        log = found.select(F.col(self.key).alias("key"), F.col("old_day").alias("day"), F.lit(state["version"] + 1).cast("long").alias("version"),
                           F.lit(True).alias("gone"), self._bucket(self.key, state).alias("bucket"))
        self._commit(state, rows.select(*StructType.fromJson(state["schema"]).names), set(rewritten), log)
        return rewritten

    def expire(self, keep: int) -> list[str]:
        """Give up all but the last ``keep`` versions, see ``Versions.expire``."""
        return self.versions.expire(keep, lambda m: {f for fs in m.get("days", {}).values() for f in fs} | {f for _, f in m.get("keys", [])})
