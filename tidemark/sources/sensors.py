"""Scans: one table of sensor events with JSON payloads, one of activity events with slices, and typed views of them.

sensor_events: participant_id, sensor, ts (epoch ms), seq (arrival order), data (JSON object).
activity_events: participant_id, ts, seq, duration, activity (id), static_data, temporal_slices.
activities: id, name, spec.
write_events lays either table out by day, and sensor_events by sensor too; views of such tables read the files of their sensor and
range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_XYZ = "struct<x:double,y:double,z:double>"
_INTERVAL = "struct<start:double,duration:double>"
_LAMP, _KIT = "lamp.", "com.apple.sensorkit."

#: Raw sensor feature to the origins it reads and the payload's columns.
SENSORS: dict[str, tuple[tuple[str, ...], str]] = {
    "accelerometer": ((_LAMP + "accelerometer",), f"x double, y double, z double, motion {_XYZ}"),
    "ambient_light": ((_KIT + "ambient_light",), "placement int, chromaticity struct<x:double,y:double>, lux struct<value:double,unit:string>"),
    "analytics": ((_LAMP + "analytics",), "user_agent string, device_type string, device_token string, action string, type string"),
    "bluetooth": ((_LAMP + "bluetooth",), "bt_rssi int, bt_name string, bt_address string"),
    "calls": ((_LAMP + "calls",), "call_trace string, call_type int, call_duration long"),
    "device_motion": ((_LAMP + "device_motion",), f"motion {_XYZ}, magnetic {_XYZ}, attitude {_XYZ}, gravity {_XYZ}, rotation {_XYZ}"),
    "device_state": ((_LAMP + "device_state", _LAMP + "screen_state"), "value int, state int, representation string, battery_level double"),
    "device_usage": ((_KIT + "device_usage",), "totalScreenWakes long, totalUnlocks long, totalUnlockDuration double, duration double, applicationUsageByCategory map<string,array<struct<usageTime:double>>>"),
    "gps": ((_LAMP + "gps",), "latitude double, longitude double, altitude double, accuracy double"),
    "gyroscope": ((_LAMP + "gyroscope",), "x double, y double, z double"),
    "messages_usage": ((_KIT + "messages_usage",), "totalIncomingMessages long, totalOutgoingMessages long, totalUniqueContacts long, duration double"),
    "nearby_device": ((_LAMP + "nearby_device",), "type string, address string"),
    "phone_usage": ((_KIT + "phone_usage",), "totalIncomingCalls long, totalOutgoingCalls long, totalPhoneCallDuration double, totalUniqueContacts long, duration double"),
    "screen_state": ((_LAMP + "screen_state",), "value int, state int, valueString string"),
    "sleep": ((_LAMP + "sleep",), "value int, source string, representation string, duration double"),
    "sms": ((_LAMP + "sms",), "type string"),
    "steps": ((_LAMP + "steps",), "value double, type string, source string, device_model string"),
    "telephony": ((_LAMP + "telephony",), "trace string, type string, duration double"),
    "visits": ((_KIT + "visits",), f"distanceFromHome double, locationCategory int, locationCategoryRepresentation string, arrivalDateInterval {_INTERVAL}, departureDateInterval {_INTERVAL}"),
}

#: Raw activity features, all of them read from activity events of that spec.
ACTIVITIES = ("balloon_risk", "cats_and_dogs", "dcog", "digit_span", "fragmented_letters", "funny_memory", "jewels_a", "jewels_b", "pop_the_bubbles", "spatial_span", "survey", "trails_b", "voice_survey")

SLICES = "array<struct<duration:long,item:string,level:string,status:boolean,type:string,value:string>>"
NEWEST = ("participant_id", "seq")


#: Column of the days by which written events are parted, counted from 1970 in UTC.
DAY_PART = "event_day"


def write_events(events: DataFrame, path: str) -> None:
    """Writes sensor_events or activity_events as Parquet, parted by sensor, where there is one, and by day.

    Large days are dealt to several tasks and files, small ones share a task. Files are ordered by participant and time, so
    that their row groups can be left out by person.
    """
    parts = [c for c in ("sensor",) if c in events.columns] + [DAY_PART]
    rows = events.withColumn(DAY_PART, F.floor(F.col("ts") / 86_400_000).cast("int")).hint("rebalance", *parts)
    rows.sortWithinPartitions(*parts, "participant_id", "ts").write.partitionBy(*parts).parquet(path)


def between(events: DataFrame, start: int | Column | None = None, end: int | Column | None = None) -> DataFrame:
    """Rows with start <= ts <= end, both ends included. Of events that are parted by day only the days of the range are read."""
    by_day = DAY_PART in events.columns
    for bound, above in ((start, True), (end, False)):
        if bound is not None:
            events = events.where(F.col("ts") >= bound if above else F.col("ts") <= bound)
            if by_day:
                day = F.floor(bound / 86_400_000).cast("int") if isinstance(bound, Column) else F.lit(bound // 86_400_000)
                events = events.where(F.col(DAY_PART) >= day if above else F.col(DAY_PART) <= day)
    return events.drop(DAY_PART)


def sensor(events: DataFrame, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Typed rows of one raw sensor feature: participant_id, ts, seq and the payload's columns; missing ones are null.

    device_state also reads screen_state, and both take `state` where there is no `value`. An accelerometer payload with
    `motion` is replaced by it. The event's own timestamp wins over one in the payload.
    """
    origins, schema = SENSORS[name]
    rows = between(events.where(F.col("sensor").isin(*origins)), start, end)
    rows = rows.select("participant_id", "ts", "seq", F.from_json("data", schema).alias("data")).select("participant_id", "ts", "seq", "data.*")
    if name == "accelerometer":
        rows = rows.select("participant_id", "ts", "seq", *(F.when(F.col("motion").isNotNull(), F.col(f"motion.{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"))
    if name in ("device_state", "screen_state"):
        rows = rows.withColumn("value", F.coalesce("value", "state")).drop("state")
    return rows


def activity(events: DataFrame, activities: DataFrame, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Activity events whose activity has the spec: a semi-join on the small dimension."""
    if name not in ACTIVITIES:
        raise ValueError(f"unknown activity {name}")
    ids = activities.where(F.col("spec") == f"lamp.{name}").select(F.col("id").alias("activity"))
    return between(events, start, end).join(ids, "activity", "left_semi")


def survey(events: DataFrame, activities: DataFrame, start: int | None = None, end: int | None = None, replace_ids: bool = True) -> DataFrame:
    """One row for each answered question: participant_id, ts, event (seq), survey, item, value, type, level, duration,
    position (of the answer in its event).

    Of a participant's events with the same slices only the longest counts, the first of equals; events of
    activities that are no surveys, or unknown, go. Without replace_ids, survey is the activity's id, not its name. The list of activities
    goes to all tasks: dealt out by activity, the events of one survey would be a single task's, slices and all.
    """
    same = W.partitionBy("participant_id", "temporal_slices").orderBy(F.desc("duration"), "ts", "seq")
    first = F.lag(F.lit(True)).over(same).isNull()  # a limit on row_number would sort all events once more, before they are dealt out
    once = between(events, start, end).withColumn("first", first).where("first")
    names = activities.where("spec = 'lamp.survey'").select(F.col("id").alias("activity"), F.col("name" if replace_ids else "id").alias("survey"))
    rows = once.join(F.broadcast(names), "activity").select("participant_id", "ts", F.col("seq").alias("event"), "survey", F.posexplode("temporal_slices").alias("position", "s"))
    return rows.select("participant_id", "ts", "event", "survey", "s.item", "s.value", "s.type", "s.level", "s.duration", "position")


def activity_names(events: DataFrame, activities: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """events with the activity's name and the second dotted part of its spec; null where the activity is not known.

    gone: activities that were deleted (id, name, spec). With it, they are named too, and column gone tells that the activity is
    not among those that are left.
    """
    columns = [F.col("id").alias("activity"), "name", F.split("spec", r"\.").getItem(1).alias("spec")]
    known = activities.select(*columns)
    if gone is None:
        return events.join(known, "activity", "left")
    known = known.withColumn("gone", F.lit(False)).unionByName(gone.join(activities, "id", "left_anti").select(*columns, F.lit(True).alias("gone")))
    return events.join(known, "activity", "left").withColumn("gone", F.coalesce("gone", F.lit(True)))


def deleted(entities: DataFrame, parent: str | None = None) -> DataFrame:
    """Deleted rows of an entity table with columns _deleted and _parent."""
    rows = entities.where("_deleted")
    return rows if parent is None else rows.where(F.col("_parent") == parent)


def quality(rows: DataFrame, start: int, end: int, bin_ms: int = 600_000) -> DataFrame:
    """participant_id, fs_mean, fs_var: sampling frequency over bins of bin_ms back from end, per second.

    The oldest event is not counted. A range of no whole bin gives n events a bin and no variance; participants
    without rows in the range are not listed.
    """
    rows = between(rows, start, end)
    bins = -(-(end - start) // bin_ms)
    if bins < 1:
        return rows.groupBy("participant_id").agg((F.count("*") / (bin_ms / 1000)).alias("fs_mean"), F.lit(0.0).alias("fs_var"))
    oldest = W.partitionBy("participant_id").orderBy("ts", "seq")
    counted = rows.withColumn("nth", F.row_number().over(oldest)).withColumn("bin", F.floor((F.lit(end) - F.col("ts")) / bin_ms))
    per_bin = counted.groupBy("participant_id", "bin").agg(F.sum(F.when(F.col("nth") > 1, 1).otherwise(0)).alias("n"))
    # Bins without events are zeros: sums over all bins need no spine.
    f = F.when(F.col("bin") < bins, F.col("n") / (bin_ms / 1000)).otherwise(0.0)
    sums = per_bin.groupBy("participant_id").agg(F.sum(f).alias("s"), F.sum(f * f).alias("q"))
    mean = F.col("s") / bins
    return sums.select("participant_id", mean.alias("fs_mean"), F.greatest(F.lit(0.0), F.col("q") / bins - mean * mean).alias("fs_var"))


def time_range(*frames: DataFrame) -> DataFrame:
    """participant_id, first and last ts over all frames."""
    every = frames[0].select("participant_id", "ts")
    for f in frames[1:]:
        every = every.unionByName(f.select("participant_id", "ts"))
    return every.groupBy("participant_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
