"""More queries for the catalogue: one for each raw feature, by way of its JSON payload or its activity, and further operators."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalogue import _ACT, _DAILY, _EV, _LABEL, _PL, _SL, ORACLES, QUERIES, START, _daily, _labelled, _named, _query, _rounded, activities, events, plays
from tidemark.operators import cohort, reports, series
from tidemark.plans.grid import DAY, Grid
from tidemark.sources import sensors

__all__ = ["ORACLES", "QUERIES"]

_X = {"x": "value", "y": "CAST(k AS DOUBLE)", "z": "CAST(k % 7 AS DOUBLE)"}


def _vector(name: str, by: int) -> dict[str, str]:
    return {f"{name}.{c}": f"CAST(k % {by + i} AS DOUBLE)" for i, c in enumerate("xyz")}


#: Payload fields of each sensor as expressions over events that both engines read; a dot leads into a nested object.
PAYLOADS: dict[str, dict[str, str]] = {
    "accelerometer": _X | _vector("motion", 11),
    "ambient_light": {"placement": "k % 3", "chromaticity.x": "value", "chromaticity.y": "CAST(k AS DOUBLE)", "lux.value": "value", "lux.unit": "event_type"},
    "analytics": {"user_agent": "event_type", "device_type": "CASE WHEN k % 2 = 0 THEN 'iOS' ELSE 'Android' END", "device_token": "CAST(k AS STRING)", "action": "'login'", "type": "event_type"},
    "bluetooth": {"bt_rssi": "-k", "bt_name": "event_type", "bt_address": "CAST(k AS STRING)"},
    "calls": {"call_trace": "CAST(k AS STRING)", "call_type": "k % 3", "call_duration": "CAST(k AS BIGINT)"},
    "device_motion": _vector("motion", 3) | _vector("magnetic", 4) | _vector("attitude", 5) | _vector("gravity", 6) | _vector("rotation", 7),
    "device_state": {"value": "CASE WHEN k % 3 = 0 THEN k % 5 END", "state": "k % 4", "representation": "event_type", "battery_level": "value"},
    "device_usage": {"totalScreenWakes": "CAST(k AS BIGINT)", "totalUnlocks": "CAST(k % 9 AS BIGINT)", "totalUnlockDuration": "value", "duration": "CAST(k AS DOUBLE)"},
    "gps": {"latitude": "value", "longitude": "-value", "altitude": "CAST(k AS DOUBLE)", "accuracy": "CASE WHEN k % 5 > 0 THEN CAST(k AS DOUBLE) END"},
    "gyroscope": _X,
    "messages_usage": {"totalIncomingMessages": "CAST(k AS BIGINT)", "totalOutgoingMessages": "CAST(k % 9 AS BIGINT)", "totalUniqueContacts": "CAST(k % 4 AS BIGINT)", "duration": "value"},
    "nearby_device": {"type": "CASE WHEN k % 3 = 0 THEN 'wifi' ELSE 'bluetooth' END", "address": "CAST(k AS STRING)"},
    "phone_usage": {"totalIncomingCalls": "CAST(k AS BIGINT)", "totalOutgoingCalls": "CAST(k % 9 AS BIGINT)", "totalPhoneCallDuration": "value", "totalUniqueContacts": "CAST(k % 4 AS BIGINT)", "duration": "CAST(k AS DOUBLE)"},
    "screen_state": {"value": "CASE WHEN k % 3 = 0 THEN k % 5 END", "state": "k % 4", "valueString": "event_type"},
    "sleep": {"value": "k % 3", "source": "event_type", "representation": "CASE WHEN k % 2 = 0 THEN 'in_bed' ELSE 'in_sleep' END", "duration": "value"},
    "sms": {"type": "event_type"},
    "steps": {"value": "value", "type": "'step_count'", "source": "event_type", "device_model": "CAST(k AS STRING)"},
    "telephony": {"trace": "CAST(k AS STRING)", "type": "CASE WHEN k % 2 = 0 THEN 'incoming' ELSE 'outgoing' END", "duration": "value"},
    "visits": {"distanceFromHome": "value", "locationCategory": "k % 4", "locationCategoryRepresentation": "event_type", "arrivalDateInterval.start": "value", "arrivalDateInterval.duration": "CAST(k AS DOUBLE)", "departureDateInterval.start": "CAST(k AS DOUBLE)", "departureDateInterval.duration": "value"},
}


def sensor_events(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Events as sensor events of one feature's origins in turn and of another sensor, each with a JSON payload."""
    origins = sensors.SENSORS[name][0]
    nested = defaultdict(list)
    for field, value in PAYLOADS[name].items():
        outer, _, inner = field.partition(".")
        nested[outer].append(F.expr(value).alias(inner or outer))
    fields = []
    for outer, inner in nested.items():
        one = F.struct(*inner) if any("." in f and f.startswith(outer) for f in PAYLOADS[name]) else inner[0]
        fields.append((F.when(F.col("k") % 4 < 2, one) if (name, outer) == ("accelerometer", "motion") else one).alias(outer))
    names = F.array(*(F.lit(o) for o in origins), F.lit("lamp.other"))
    return events(spark, sf_dir).select("participant_id", F.element_at(names, (F.col("k") % (len(origins) + 1) + 1).cast("int")).alias("sensor"), "ts", "seq", F.to_json(F.struct(*fields)).alias("data"))


def _raw_sensor(name: str) -> None:
    columns = {f.replace(".", "_"): e for f, e in PAYLOADS[name].items()}
    if name == "accelerometer":  # a payload with motion is replaced by it
        columns = {c: f"CASE WHEN k % 4 < 2 THEN {columns[f'motion_{c}']} ELSE {columns[c]} END" for c in "xyz"}
    if name in ("device_state", "screen_state"):
        columns["value"] = f"coalesce({columns['value']}, {columns.pop('state')})"
    flat = ", ".join(f'{e.replace("STRING", "VARCHAR")} AS "{c}"' for c, e in columns.items())
    origins = len(sensors.SENSORS[name][0])
    sql = f"WITH {_EV} SELECT participant_id, ts, seq, {flat} FROM ev WHERE k % {origins + 1} < {origins} AND ts >= {START + 2 * DAY} AND ts <= {START + 20 * DAY}"

    def run(spark, sf_dir):
        rows = sensors.sensor(sensor_events(spark, sf_dir, name), name, START + 2 * DAY, START + 20 * DAY)
        paths = {f.replace(".", "_"): f for f in PAYLOADS[name]}
        return rows.select("participant_id", "ts", "seq", *(F.col(paths[c]).alias(c) for c in columns))

    _query(f"q_raw_{name}", sql)(run)


for _name in PAYLOADS:
    _raw_sensor(_name)


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: A measure over an activity's slices, in Spark and in SQL; games take turns.
_OVER_SLICES = (
    (lambda s: F.size(F.filter(s, lambda x: x["level"] == "1")), "count(*) FILTER (WHERE level = '1')"),
    (lambda s: F.aggregate(F.filter(s, lambda x: x["status"]), F.lit(0).cast("long"), lambda t, x: t + x["duration"]), "coalesce(sum(sl.duration) FILTER (WHERE status), 0)"),
    (lambda s: F.size(F.array_distinct(F.transform(s, lambda x: x["item"]))), "count(DISTINCT item)"),
    (lambda s: F.size(F.filter(s, lambda x: (x["type"] == "true") & (x["value"] == "go"))), "count(*) FILTER (WHERE type AND value = 'go')"),
)


def _raw_activity(name: str) -> None:
    """Each game with activities, a range and a measure of its own."""
    at = sensors.ACTIVITIES.index(name)
    own = _PRIORITIES[at % 5], _PRIORITIES[(at + 1 + at // 5) % 5]
    low = 788918400000 + at % 4 * 180 * DAY
    high = low + (at % 3 + 2) * 180 * DAY
    measure, sql_measure = _OVER_SLICES[at % 4]
    sql = f"""WITH {_PL}, {_SL} SELECT participant_id, pl.ts, pl.seq, min(pl.duration) AS duration, count(*) AS slices, CAST(sum(sl.duration) AS BIGINT) AS slice_ms, count(*) FILTER (WHERE status) AS right_, CAST({sql_measure} AS BIGINT) AS measure
    FROM pl JOIN sl ON sl.seq = pl.seq WHERE activity IN {own} AND ts >= {low} AND ts <= {high} GROUP BY participant_id, pl.ts, pl.seq"""

    def run(spark, sf_dir):
        known = spark.createDataFrame([(p, p, f"lamp.{name}" if p in own else ("lamp.other", name)[i % 2]) for i, p in enumerate(_PRIORITIES)], "id string, name string, spec string")
        rows = sensors.activity(plays(spark, sf_dir), known, name, low, high)
        right = F.size(F.filter("temporal_slices", lambda s: s["status"]))
        total = F.aggregate("temporal_slices", F.lit(0).cast("long"), lambda t, s: t + s["duration"])
        return rows.select("participant_id", "ts", "seq", "duration", F.size("temporal_slices").cast("long").alias("slices"), total.alias("slice_ms"), right.cast("long").alias("right_"), measure(F.col("temporal_slices")).cast("long").alias("measure"))

    _query(f"q_raw_{name}", sql)(run)


for _name in sensors.ACTIVITIES:
    if _name != "survey":  # q_survey_dedupe has it
        _raw_activity(_name)


@_query("q_local_time", f"WITH {_EV} SELECT participant_id, seq, ts + CASE participant_id % 3 WHEN 0 THEN 19800000 WHEN 1 THEN -28800000 ELSE 0 END AS local FROM ev")
def _local(spark, sf_dir):
    e = events(spark, sf_dir)
    zones = e.select("participant_id").distinct().withColumn("zone", F.when(F.col("participant_id") % 3 == 0, "+05:30").when(F.col("participant_id") % 3 == 1, "-08:00")).where("zone IS NOT NULL")
    return cohort.local_time(e, zones).select("participant_id", "seq", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(local AS TIMESTAMP_NTZ))").alias("local"))


@_query("q_cohort_normalize", f"WITH {_EV}, {_DAILY} SELECT participant_id, day, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS v, round((u - avg(u) OVER ()) / stddev_pop(u) OVER (), 6) AS u FROM dl")
def _cohort_normalize(spark, sf_dir):
    return _rounded(cohort.cohort_normalized(_daily(spark, sf_dir)), "v", "u")


_BIN = "b AS (SELECT participant_id, CAST(floor(day / 3) AS BIGINT) AS bin, avg(v) AS v, avg(u) AS u FROM dl GROUP BY 1, 2)"


@_query("q_binned", f"WITH {_EV}, {_DAILY}, {_BIN} SELECT participant_id, bin, round(v, 6) AS v, round(u, 6) AS u FROM b")
def _binned(spark, sf_dir):
    return _rounded(cohort.binned(_daily(spark, sf_dir)), "v", "u")


@_query(
    "q_impute_bins",
    f"""WITH {_EV}, d3 AS (SELECT participant_id, CAST(floor((ts - {START}) / {3 * DAY}) AS BIGINT) AS bin, CAST(sum(CASE WHEN k % 7 > 0 THEN k END) AS DOUBLE) / sum(CASE WHEN k % 7 > 0 THEN 1 END) AS v FROM ev WHERE k % 5 > 0 GROUP BY 1, 2),
    p AS (SELECT participant_id, min(bin) AS a, max(bin) AS z FROM d3 GROUP BY 1), s AS (SELECT participant_id, unnest(range(a, z + 1)) AS bin FROM p), j AS (SELECT s.participant_id, s.bin, v FROM s LEFT JOIN d3 ON d3.participant_id = s.participant_id AND d3.bin = s.bin)
    SELECT participant_id, bin, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY participant_id ORDER BY bin ROWS UNBOUNDED PRECEDING)) AS v FROM j""",
)
def _impute_bins(spark, sf_dir):
    k = F.when(F.col("k") % 7 > 0, F.col("k"))
    rows = events(spark, sf_dir).where("k % 5 > 0").groupBy("participant_id", F.floor((F.col("ts") - START) / (3 * DAY)).alias("bin")).agg((F.sum(k).cast("double") / F.count(k)).alias("v"))
    return cohort.imputed_bins(rows.withColumn("v", F.nanvl("v", F.lit(None).cast("double"))))


@_query("q_joint_transitions", f"""WITH {_EV}, {_DAILY}, x AS (SELECT participant_id, day, {_LABEL.format("v")} || ',' || {_LABEL.format("u")} AS l FROM dl), y AS (SELECT participant_id, l AS a, lead(l) OVER p AS b, lead(day) OVER p - day AS gap FROM x WINDOW p AS (PARTITION BY participant_id ORDER BY day))
    SELECT participant_id, 'v,u' AS domains, a AS "from", b AS "to", count(*) AS n FROM y WHERE gap <= 3 GROUP BY participant_id, a, b""")
def _joint(spark, sf_dir):
    return cohort.transitions(_labelled(_daily(spark, sf_dir)), ["v", "u"], joint_size=2)


@_query("q_members", "SELECT c_custkey AS participant_id, n_nationkey AS study_id, n_name AS study_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def _members(spark, sf_dir):
    people, studies = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    return reports.members("1", people.select(F.col("c_custkey").alias("participant_id"), F.col("c_nationkey").alias("study_id")), studies.select(F.col("n_nationkey").alias("study_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("researcher_id")))


@_query("q_deleted", "SELECT c_custkey AS id, c_nationkey AS _parent FROM customer WHERE c_acctbal < 0 AND c_nationkey = 7")
def _deleted(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("_parent"), (F.col("c_acctbal") < 0).alias("_deleted"))
    return sensors.deleted(rows, 7).select("id", "_parent")


@_query("q_all_activity_names", f"WITH {_PL}, {_ACT} SELECT pl.seq, coalesce(name, 'Was ' || activity) AS name, split_part(spec, '.', 2) AS spec, activity NOT IN (SELECT id FROM act) AS gone FROM pl LEFT JOIN act ON act.id = activity")
def _all_names(spark, sf_dir):
    gone = spark.createDataFrame([("5-LOW", "Was 5-LOW", None)], "id string, name string, spec string")
    out = sensors.activity_names(plays(spark, sf_dir), activities(spark), gone)
    return out.select("seq", "name", F.coalesce("spec", F.lit(None)).alias("spec"), "gone")


ORACLES["q_all_activity_names"] = ORACLES["q_all_activity_names"].replace("split_part(spec, '.', 2)", "CASE WHEN spec IS NOT NULL THEN split_part(spec, '.', 2) END")


@_query("q_due_modules", "SELECT c_custkey AS participant_id, m.module FROM customer JOIN (VALUES ('BUILDING', 'a', 0, 5000), ('BUILDING', 'b', 2000, 9000), ('MACHINERY', 'c', 4000, 8000)) m(phase, module, low, high) ON c_mktsegment = phase WHERE 9999 - CAST(trunc(c_acctbal) AS BIGINT) > low AND 9999 - CAST(trunc(c_acctbal) AS BIGINT) <= high")
def _due(spark, sf_dir):
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("participant_id"), F.col("c_mktsegment").alias("phase"), F.col("c_acctbal").cast("long").alias("enrolled"))
    modules = spark.createDataFrame([("BUILDING", "a", 0, 5000), ("BUILDING", "b", 2000, 9000), ("MACHINERY", "c", 4000, 8000)], "phase string, module string, start long, end long")
    return reports.due_modules(people, modules, 9999)


@_query("q_survey_table", f"""WITH {_PL}, {_SL} SELECT participant_id, pl.ts AS timestamp, avg(CASE WHEN item = 'A' THEN sl.duration END) AS "A", avg(CASE WHEN item = 'N' THEN sl.duration END) AS "N", avg(CASE WHEN item = 'R' THEN sl.duration END) AS "R" FROM pl JOIN sl ON sl.seq = pl.seq WHERE activity = '1-URGENT' GROUP BY participant_id, pl.ts""")
def _survey_table(spark, sf_dir):
    rows = plays(spark, sf_dir).where("activity = '1-URGENT'").select("participant_id", F.col("ts").alias("start"), F.explode("temporal_slices").alias("s"))
    return reports.survey_table(rows.select("participant_id", "start", F.col("s.item").alias("question"), F.col("s.duration").cast("double").alias("score")), ["A", "N", "R"])


_TAG = "CASE participant_id % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'okay_missing' ELSE 'bad' END"


@_query("q_passive_means", f"WITH {_EV}, t AS (SELECT participant_id, {_TAG} AS tag, avg(k) AS s, avg(CASE WHEN k % 2 = 0 THEN k END) / 3600000.0 AS h FROM ev GROUP BY 1) SELECT participant_id, round(s, 9) AS steps, round(CASE WHEN tag = 'bad' THEN 0 ELSE coalesce(h, 0) END, 9) AS screen_hours, round(CASE WHEN tag = 'bad' THEN 0 ELSE coalesce(h, 0) END, 9) AS home_hours FROM t")
def _passive(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("value", F.col("k").cast("double"))
    tags = e.select("participant_id").distinct().withColumn("gps_quality", F.expr(_TAG)).withColumn("screen_quality", F.col("gps_quality"))
    out = reports.passive_means(e, e.where("k % 2 = 0"), e.where("k % 2 = 0"), tags)
    return out.withColumns({c: F.round(c, 9) for c in ("steps", "screen_hours", "home_hours")})


@_query("q_sample_window", f"WITH {_EV}, m AS (SELECT max(ts) AS now FROM ev), w AS (SELECT (now - {2 * DAY}) // {DAY} * {DAY} AS z FROM m) SELECT participant_id, count(*) AS n FROM ev, w WHERE ts >= z - {5 * DAY} AND ts <= z GROUP BY 1")
def _sample(spark, sf_dir):
    e = events(spark, sf_dir)
    start, end = reports.sample_window(e.agg(F.max("ts")).first()[0], 5, 2, midnight=True)
    return sensors.between(e, start, end).groupBy("participant_id").agg(F.count("*").alias("n"))


_KIT = "kit AS (SELECT participant_id, ts, k AS inc, k % 9 AS outg, value AS dur, k % 4 AS contacts FROM ev)"
_MONTH_ = f"participant_id, {START}::BIGINT AS timestamp"


def _usage(spark, sf_dir):
    return events(spark, sf_dir).select("participant_id", "ts", "seq", F.col("k").cast("long").alias("totalIncomingCalls"), (F.col("k") % 9).cast("long").alias("totalOutgoingCalls"), F.col("value").alias("totalPhoneCallDuration"), (F.col("k") % 4).cast("long").alias("totalUniqueContacts"))


_WHOLE = Grid(START, START + 30 * DAY, 30 * DAY)
_IN = f"ts >= {START} AND ts <= {START + 30 * DAY}"


def _kit(name: str, function, value: str) -> None:
    """The branch of a call feature that reads the phone's own sums where there are no single calls."""

    def run(spark, sf_dir):
        usage = _usage(spark, sf_dir)
        none = spark.createDataFrame([], "participant_id long, ts long, seq long, trace string, type string, duration double")
        out = function(none, usage, usage.select("participant_id").distinct(), _WHOLE, sensor="SensorKit")
        return out.select("participant_id", "timestamp", F.round(F.col("value").cast("double"), 6).alias("value"))

    _query(name, f"WITH {_EV}, {_KIT} SELECT {_MONTH_}, round(CAST({value} AS DOUBLE), 6) AS value FROM kit WHERE {_IN} GROUP BY 1")(run)


_kit("q_call_number_usage", series.call_number, "sum(inc + outg)")
_kit("q_call_duration_usage", series.call_duration, "sum(dur)")
_kit("q_call_degree_usage", series.call_degree, "sum(contacts)")
