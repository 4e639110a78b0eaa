"""Kept results: raw ranges by person, which are read only where they are not kept, and interval features that grow at their end.

Both are logs of parts. A run adds one part: its rows, and then its manifest, which says for each person what the part answers for. A
part without a whole manifest, as a lost driver leaves it, does not count. Readers join rows to what the manifests leave of them; nothing
that is kept is written again, until compact puts the parts together.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir, whose files go when the driver's JVM ends. Only a local session without that folder, as in
    tests, gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and (at := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = at.get()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once as a table in the shared folder and read again: lost executors cost no recomputation."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left.join(right), both dealt out and sorted, for stored tables that grow with the input. The optimiser would broadcast one by the size of
    its files, which are compressed: rows that repeat each other take a hundred times that in the driver's memory."""
    return left.hint("merge").join(right.hint("merge"), on, how)


class Store:
    """A folder of Parquet tables: one for each feature, and within it one for each kept range. A table's files lie in parts."""

    #: Column of the parts, which readers do not see, and the part that save writes.
    PART, WHOLE = "part__", -1

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        """Whether there is such a table; one that a lost save had put aside is put back first."""
        if not self._fs.exists(self._at(name)) and self._fs.exists(self._at(f".old/{name}")):
            self._fs.rename(self._at(f".old/{name}"), self._at(name))
        return self._fs.exists(self._at(name))

    def save(self, name: str, frame: DataFrame) -> None:
        """Written beside the old table and then put in its place, so that frame may read the old one, which goes last."""
        there = self.exists(name)
        self._fs.delete(self._at(f".new/{name}"), True)
        frame.write.parquet(f"{self.path}/.new/{name}/{self.PART}={self.WHOLE}")
        if there:
            self._fs.delete(self._at(f".old/{name}"), True)
            self._fs.mkdirs(self._at(f".old/{name}").getParent())
            self._fs.rename(self._at(name), self._at(f".old/{name}"))
        self._fs.mkdirs(self._at(name).getParent())
        self._fs.rename(self._at(f".new/{name}"), self._at(name))
        self._fs.delete(self._at(f".old/{name}"), True)

    def append(self, name: str, frame: DataFrame, part: int) -> None:
        """Adds a part to a table, or replaces that part if it is there; the other parts are not read."""
        self.exists(name)
        frame.write.mode("overwrite").parquet(f"{self.path}/{name}/{self.PART}={part}")

    def load(self, name: str) -> DataFrame:
        self.exists(name)
        return self.spark.read.parquet(f"{self.path}/{name}").drop(self.PART)

    def delete(self, name: str) -> bool:
        self._fs.delete(self._at(f".old/{name}"), True)
        return self._fs.delete(self._at(name), True)

    def export(self, name: str, other: Store) -> None:
        """Copies a table to another store."""
        other.save(name, self.load(name))

    # Logs of parts

    @staticmethod
    def key(name: str, options: dict | None = None) -> str:
        """Where a feature with its options is kept: other options have a log of their own."""
        told = json.dumps(options or {}, sort_keys=True, default=str)
        return f"kept/{name}/{hashlib.sha256(told.encode()).hexdigest()[:16]}"

    def parts(self, key: str) -> list[str]:
        """Names of the parts whose manifest is whole, oldest first."""
        if not self._fs.exists(self._at(f"{key}/manifest")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{key}/manifest"))]
        return sorted(n.partition("=")[2] for n in names if n.startswith(self.PART) and self._fs.exists(self._at(f"{key}/manifest/{n}/_SUCCESS")))

    def _add(self, key: str, rows: DataFrame, manifest: DataFrame) -> str:
        there = self.parts(key)
        part = f"p{1 + int(there[-1][1:9]) if there else 0:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{key}/rows/{self.PART}={part}")
        manifest.write.parquet(f"{self.path}/{key}/manifest/{self.PART}={part}")
        return part

    def _read(self, key: str, what: str, parts: list[str]) -> DataFrame:
        base = f"{self.path}/{key}/{what}"
        return self.spark.read.option("basePath", base).parquet(*(f"{base}/{self.PART}={p}" for p in parts))

    def _owned(self, key: str, parts: list[str]) -> DataFrame:
        """participant_id, low, high and part of ranges that do not overlap: of parts that hold a time twice, as after two runs at once, the
        one that begins first, or else is older, answers for it."""
        order = W.partitionBy("participant_id").orderBy("low", F.desc("high"), self.PART)
        before = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
        rows = self._read(key, "manifest", parts).withColumn("before", before)
        return rows.withColumn("low", F.greatest("low", F.coalesce(F.col("before") + 1, F.col("low")))).where("low <= high").drop("before")

    def _gaps(self, wanted: DataFrame, owned: DataFrame | None) -> DataFrame:
        """participant_id, low and high of what owned leaves of wanted (participant_id, low, high; ranges that do not overlap)."""
        if owned is None:
            return wanted
        own = owned.select("participant_id", F.col("low").alias("from"), F.col("high").alias("to"))
        met = (F.col("from") <= F.col("high")) & (F.col("to") >= F.col("low"))
        inside = wanted.join(own, "participant_id").where(met)
        order = W.partitionBy("participant_id", "low", "high").orderBy("from")
        left = F.coalesce(F.lag("to").over(order) + 1, F.col("low"))
        between = inside.select("participant_id", left.alias("a"), (F.col("from") - 1).alias("b"))
        after = inside.groupBy("participant_id", "low", "high").agg((F.max("to") + 1).alias("a")).select("participant_id", "a", F.col("high").alias("b"))
        free = wanted.join(inside.select("participant_id", "low", "high").distinct(), ["participant_id", "low", "high"], "left_anti").toDF("participant_id", "a", "b")
        return between.unionByName(after).unionByName(free).where("a <= b").toDF("participant_id", "low", "high")

    def ranged(self, name: str, options: dict | None, people: DataFrame, start: int, end: int, read: Callable[[int, int], DataFrame]) -> DataFrame:
        """Rows of people (participant_id) with start <= ts <= end. What is kept under name and options is not read again:
        read(low, high) is called once for the span of all gaps, if there are any, and its rows inside each person's gaps are added.

        Rows of read are taken as they are found first: later changes to a range that is kept are not seen until forget.
        """
        key = self.key(name, options)
        parts = self.parts(key)
        wanted = people.select("participant_id", F.lit(start).cast("long").alias("low"), F.lit(end).cast("long").alias("high")).where("participant_id IS NOT NULL").distinct()
        gaps = stored(self._gaps(wanted, self._owned(key, parts) if parts else None), "gaps")
        low, high = gaps.agg(F.min("low"), F.max("high")).first()
        if low is not None or not parts:
            rows = read(start if low is None else low, end if high is None else high)
            inside = gaps.select("participant_id", F.col("low").alias("low__"), F.col("high").alias("high__"))
            rows = rows.join(inside, "participant_id").where(F.col("ts").between(F.col("low__"), F.col("high__"))).drop("low__", "high__")
            self._add(key, rows, gaps)
        return self._ranges(key, wanted)

    def _ranges(self, key: str, wanted: DataFrame) -> DataFrame:
        """What is kept of wanted (participant_id, low, high; ranges that do not overlap)."""
        parts = self.parts(key)
        rows, owned = self._read(key, "rows", parts), self._owned(key, parts)
        ask = wanted.select("participant_id", F.col("low").alias("ask"), F.col("high").alias("until"))
        good = owned.join(ask, "participant_id").where("ask <= high AND until >= low").select("participant_id", self.PART, F.greatest("low", "ask").alias("low__"), F.least("high", "until").alias("high__"))
        return rows.join(good, ["participant_id", self.PART]).where(F.col("ts").between(F.col("low__"), F.col("high__"))).drop("low__", "high__", self.PART)

    #: Since of a person of whom everything was computed.
    ALL = -(1 << 63)

    def _intervals(self, key: str) -> DataFrame | None:
        """The intervals that are kept, of all people: those of a part up to where a later part of the same person begins."""
        if not (parts := self.parts(key)):
            return None
        later = W.partitionBy("participant_id").orderBy(self.PART).rowsBetween(1, W.unboundedFollowing)
        limits = self._read(key, "manifest", parts).select("participant_id", self.PART, F.min("since").over(later).alias("until__"))
        rows = self._read(key, "rows", parts).join(limits, ["participant_id", self.PART])
        return rows.where("until__ IS NULL OR start <= until__").drop("until__", self.PART)

    def grown(self, name: str, options: dict | None, people: DataFrame, compute: Callable[[DataFrame | None], DataFrame], kind: str | None = None) -> DataFrame:
        """Intervals (participant_id, start, ...) of people, with those that are kept under name and options taken from there.

        compute(since) gives the intervals of people from the readings with ts >= since on, all of them where since (participant_id, since)
        has no row. since is the start of each person's last interval but one (of each value of the column kind, and of these the least).
        Intervals that start later are replaced, as the last one may still have been open; those up to it stay. A person with
        fewer intervals is computed anew, and people who are not asked for keep what they have.

        compute has to give from the start of an interval on what it gives from all readings. Readings that come later with times before
        since are not seen until forget.
        """
        people = people.select("participant_id").where("participant_id IS NOT NULL").distinct()
        key = self.key(name, options)
        kept, since = self._intervals(key), None
        if kept is not None:
            each = ["participant_id"] + [kind] * (kind is not None)
            nth = F.row_number().over(W.partitionBy(*each).orderBy(F.desc("start")))
            starts = kept.join(people, "participant_id", "left_semi").select(*each, "start").distinct().withColumn("nth", nth)
            second = starts.groupBy(*each).agg(F.coalesce(F.max(F.when(F.col("nth") == 2, F.col("start"))), F.lit(self.ALL)).alias("since"))
            since = stored(second.groupBy("participant_id").agg(F.min("since").alias("since")).where(F.col("since") > self.ALL), "since")
        fresh = compute(since)
        if since is None:
            manifest = people.withColumn("since", F.lit(self.ALL))
        else:
            manifest = people.join(since, "participant_id", "left").withColumn("since", F.coalesce("since", F.lit(self.ALL)))
            fresh = fresh.join(since.withColumnRenamed("since", "since__"), "participant_id", "left").where("since__ IS NULL OR start > since__").drop("since__")
        self._add(key, fresh.join(people, "participant_id", "left_semi"), manifest)
        return self._intervals(key).join(people, "participant_id", "left_semi")

    def _whole(self, key: str) -> tuple[DataFrame, DataFrame]:
        """Rows and manifest of a log as if they were of one part."""
        parts = self.parts(key)
        manifest = self._read(key, "manifest", parts)
        if "since" in manifest.columns:
            return self._intervals(key), manifest.select("participant_id", F.lit(self.ALL).alias("since")).distinct()
        owned = self._owned(key, parts).drop(self.PART)
        return self._ranges(key, owned), owned

    def compact(self, name: str, options: dict | None = None) -> None:
        """Puts the parts of a log together in one; the old parts go when it is there."""
        key = self.key(name, options)
        if parts := self.parts(key):
            self._add(key, *self._whole(key))
            self._drop(key, parts)

    def _drop(self, key: str, parts: list[str]) -> None:
        for p in parts:
            for what in ("manifest", "rows"):
                self._fs.delete(self._at(f"{key}/{what}/{self.PART}={p}"), True)

    def forget(self, name: str, options: dict | None = None, people: DataFrame | None = None) -> None:
        """Drops what is kept under name and options, of these people or of all."""
        key = self.key(name, options)
        if parts := self.parts(key):
            if people is not None:
                self._add(key, *(f.join(people.select("participant_id"), "participant_id", "left_anti") for f in self._whole(key)))
            self._drop(key, parts)

    def logs(self) -> list[str]:
        """Keys of all logs that have a part."""
        out = []
        for name in self._fs.listStatus(self._at("kept")) if self._fs.exists(self._at("kept")) else []:
            out += [f"kept/{name.getPath().getName()}/{o.getPath().getName()}" for o in self._fs.listStatus(name.getPath())]
        return sorted(k for k in out if self.parts(k))

    def archive(self, path: str) -> None:
        """Copies all logs to a folder of their own; its table of contents, with row counts and sums of hashes, comes last."""
        other, contents = Store(self.spark, path), []
        for key in self.logs():
            for part in self.parts(key):
                for what in ("rows", "manifest"):
                    rows = self._read(key, what, [part]).drop(self.PART)
                    rows.write.parquet(f"{other.path}/{key}/{what}/{self.PART}={part}")
                    contents.append((key, part, what, *self._digest(rows)))
        self.spark.createDataFrame(contents, "key string, part string, what string, n long, hashes string").coalesce(1).write.parquet(f"{other.path}/contents")

    def _digest(self, rows: DataFrame) -> tuple[int, str]:
        n, hashes = rows.agg(F.count("*"), F.sum(F.xxhash64(*(F.to_json(F.struct(F.col(c))) for c in sorted(rows.columns))).cast("decimal(38,0)"))).first()
        return n, str(hashes)

    def restore(self, path: str) -> None:
        """Takes in the logs of an archive. Nothing changes unless the archive is whole.

        Where both have a time of a person's raw rows, or a person's intervals, those that are here stay.
        """
        other = Store(self.spark, path)
        if not other._fs.exists(other._at("contents/_SUCCESS")):
            raise ValueError(f"no whole archive in {path}")
        contents = self.spark.read.parquet(f"{other.path}/contents").collect()  # a row for each part
        for key, part, what, n, hashes in contents:
            try:
                found = other._digest(other._read(key, what, [part]).drop(self.PART)) if part in other.parts(key) else None
            except AnalysisException:  # no file is left
                found = None
            if found != (n, hashes):
                raise ValueError(f"archive {path}: {what} of {key} are not whole")
        for key in sorted({r["key"] for r in contents}):
            rows, manifest = other._whole(key)
            if mine := self.parts(key):
                if "since" in manifest.columns:
                    manifest = manifest.join(self._read(key, "manifest", mine), "participant_id", "left_anti")
                    rows = rows.join(manifest, "participant_id", "left_semi")
                else:
                    manifest = stored(self._gaps(manifest, self._owned(key, mine)), "gaps")
                    rows = other._ranges(key, manifest)
            self._add(key, rows, manifest)
