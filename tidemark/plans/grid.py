"""Windows of fixed resolution over all participants in one plan."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400_000


@dataclass(frozen=True)
class Grid:
    """Whole windows of resolution ms from start on; what is left before end is no window."""

    start: int
    end: int
    resolution: int

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError("'start' argument must occur before 'end'.")
        if self.resolution <= 0:
            raise ValueError("'resolution' must be positive.")

    @property
    def n(self) -> int:
        return (self.end - self.start) // self.resolution

    def spine(self, people: DataFrame) -> DataFrame:
        """participant_id, window and timestamp (the window's start) of all windows."""
        windows = F.sequence(F.lit(0), F.lit(self.n - 1)) if self.n else F.array().cast("array<int>")
        rows = people.select("participant_id").distinct().withColumn("window", F.explode(windows))
        return rows.withColumn("timestamp", F.lit(self.start) + F.col("window").cast("long") * self.resolution)

    def hits(self, rows: DataFrame, half_open: bool = False) -> DataFrame:
        """rows with their window. An event on a boundary is in both windows, unless they are half open."""
        rows = rows.where((F.col("ts") >= self.start) & (F.col("ts") <= self.start + self.n * self.resolution))
        at = F.floor((F.col("ts") - self.start) / self.resolution).cast("int")
        if half_open:
            return rows.withColumn("window", at).where(F.col("window") < self.n)
        on_edge = (F.col("ts") - self.start) % self.resolution == 0
        both = F.when(on_edge & (at > 0), F.array(at - 1, at)).otherwise(F.array(at))
        return rows.withColumn("window", F.explode(both)).where(F.col("window") < self.n)

    def filled(self, people: DataFrame, found: DataFrame) -> DataFrame:
        """participant_id, timestamp and found's values for all windows, null where found has none."""
        values = [c for c in found.columns if c not in ("participant_id", "window")]
        return self.spine(people).join(found, ["participant_id", "window"], "left").select("participant_id", "timestamp", *values)

    def series(self, rows: DataFrame, people: DataFrame, value: Column, half_open: bool = False) -> DataFrame:
        """participant_id, timestamp, value: an aggregate of each window's rows; null without rows."""
        found = self.hits(rows, half_open).groupBy("participant_id", "window").agg(value.alias("value"))
        return self.filled(people, found)

    def clipped(self, intervals: DataFrame) -> DataFrame:
        """Intervals by window. An interval counts where it lies inside, ends inside after starting before, or starts inside
        and ends after; one that covers a window and more does not. A window's first interval is cut to its start
        and its last to its end. Intervals meet windows by number, an equi-join that needs no range join."""
        first = F.floor((F.col("start") - 1 - self.start) / self.resolution).cast("int")
        last = F.floor((F.col("end") - self.start) / self.resolution).cast("int")
        rows = intervals.where((F.col("end") >= self.start) & (F.col("start") <= self.start + self.n * self.resolution))
        rows = rows.withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), first), F.least(F.lit(self.n - 1), F.greatest(last, first)))))
        low = F.lit(self.start) + F.col("window").cast("long") * self.resolution
        high = low + self.resolution
        start, end = F.col("start"), F.col("end")
        inside = (start >= low) & (end <= high)
        rows = rows.where(inside | ((start < low) & (end > low) & (end <= high)) | ((start > low) & (start < high) & (end > high)))
        up = W.partitionBy("participant_id", "window").orderBy("start", "end")
        down = W.partitionBy("participant_id", "window").orderBy(F.desc("start"), F.desc("end"))
        rows = rows.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down))
        rows = rows.withColumn("start", F.when(F.col("up") == 1, F.greatest(start, low)).otherwise(start))
        rows = rows.withColumn("end", F.when(F.col("down") == 1, F.least(end, high)).otherwise(end))
        return rows.drop("up", "down").withColumn("duration", F.col("end") - F.col("start"))


def nine_am(start: Column, end: Column, zone: str | Column = "UTC") -> tuple[Column, Column]:
    """start moved back and end moved on to 9 in the morning of the zone; both stay if they are. A column of zones gives each row its own.

    Days are counted on the clock of the zone, so the steps are 23 or 25 hours where clocks change. The session's zone does not matter.
    """
    nine = 32_400_000

    def local(ms: Column) -> Column:
        return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone)) - nine

    def instant(day: Column) -> Column:
        return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(day.cast("long") * DAY + nine), zone))

    return instant(F.floor(local(start) / DAY)), instant(F.ceil(local(end) / DAY))


def now(clock: float | None = None) -> int:
    """The whole second that it is, in ms; clock (seconds) stands in for the time in tests and reruns."""
    return int(time.time() if clock is None else clock) * 1000


def expanded(ids: list[str], participants: DataFrame, studies: DataFrame) -> DataFrame:
    """participant_id of all participants that ids name: themselves, those of studies, and those of researchers' studies.

    participants: participant_id, study_id. studies: study_id, researcher_id.
    """
    rows = participants.join(studies, "study_id", "left")
    named = F.col("participant_id").cast("string").isin(ids) | F.col("study_id").cast("string").isin(ids) | F.col("researcher_id").cast("string").isin(ids)
    return rows.where(named).select("participant_id").distinct()
