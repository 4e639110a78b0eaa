"""Queries of runs with kept results, of layouts by day, clusters and their merging, studies and models; the last module of the catalogue."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.catalogue import _BOUTS, _CLIP, _DAILY, _EV, _PEOPLE, _PL, _PLACES, _SCORES, _SL, _SURVEY, _WIN, FRAMES, GRID, MONTH, ORACLES, QUERIES, START, TWO_DAYS, _daily, _games, _places, _query, _rounded, _scores, activities, events, frame, people, plays
from tidemark.more_queries import sensor_events
from tidemark.operators import density, intervals, reports, series
from tidemark.operators.study import Study
from tidemark.plans.grid import DAY, Grid, nine_am
from tidemark.plans.registry import run
from tidemark.sources import sensors
from tidemark.sources.store import Store, shared_path

__all__ = ["ORACLES", "QUERIES"]


# Kept results


@_query("q_cached", f"WITH {_EV} SELECT participant_id, ts, seq, value, event_type AS source FROM ev WHERE k % 2 = 0 AND ts BETWEEN {START + 6 * DAY} AND {START + 20 * DAY}")
def _cached(spark, sf_dir):
    """Even people's range is kept by a first run, and taken out of what the second one, for all people and a longer range, can read."""
    store, rows = Store(spark, shared_path(spark, "store")), sensor_events(spark, sf_dir, "steps")
    even = F.col("participant_id") % 2 == 0
    run({"sensor_events": rows}, people(spark, sf_dir).where(even), ["steps"], START + 2 * DAY, START + 10 * DAY, store=store)
    gone = even & F.col("ts").between(START + 2 * DAY, START + 10 * DAY)
    out = run({"sensor_events": rows.where(~gone)}, people(spark, sf_dir), ["steps"], START + 6 * DAY, START + 20 * DAY, store=store)["steps"]
    return out.select("participant_id", "ts", "seq", "value", "source")


_WHOLE_CLIP = _CLIP.replace(str(DAY), str(30 * DAY)).replace("row_number() OVER (PARTITION BY participant_id, w", "row_number() OVER (PARTITION BY participant_id")


@_query("q_incremental", f'WITH {_EV}, spine AS (SELECT DISTINCT participant_id, 0 AS w, CAST({START} AS BIGINT) AS low FROM ev), {_BOUTS}, {_WHOLE_CLIP} SELECT participant_id, "start", "end", "end" - "start" AS duration FROM clip')
def _incremental(spark, sf_dir):
    """Screen bouts that three runs add to: of even people, of all, and of all again with the whole table."""
    store, rows = Store(spark, shared_path(spark, "store")), frame(spark, sf_dir, "state")
    none = spark.createDataFrame([], "participant_id long, ts long")
    who = people(spark, sf_dir)
    for some, until in ((who.where("participant_id % 2 = 0"), 8), (who, 15), (who, 31)):
        sources = {"device_state": sensors.between(rows, None, START + until * DAY), "activity_events": none}
        out = run(sources, some, [{"name": "screen_active", "duration_threshold": TWO_DAYS}], START, START + 30 * DAY, store=store)["screen_active"]
    return out.select("participant_id", "start", "end", "duration")


@_query(
    "q_pairs",
    f"""WITH {_EV}, sp AS (SELECT DISTINCT participant_id, range AS w, CAST({START} + range * {DAY} AS BIGINT) AS low FROM ev, range(30)),
    j AS (SELECT sp.participant_id, low, ev.k, ev.value, ev.ts FROM sp LEFT JOIN ev ON ev.participant_id = sp.participant_id AND ev.ts BETWEEN low AND low + {DAY}),
    a AS (SELECT participant_id, low, avg(value / 600) AS battery, CASE WHEN count(ts) > 0 THEN count(*) FILTER (WHERE k % 2 = 0) END AS incoming, CASE WHEN count(ts) > 0 THEN count(*) FILTER (WHERE k % 2 = 1) END AS outgoing FROM j GROUP BY 1, 2)
    SELECT participant_id, low AS timestamp, 'battery_level' AS feature, round(battery, 9) AS value FROM a WHERE participant_id % 3 < 2
    UNION ALL SELECT participant_id, low, 'incoming', CAST(incoming AS DOUBLE) FROM a WHERE participant_id % 3 = 1 UNION ALL SELECT participant_id, low, 'outgoing', CAST(outgoing AS DOUBLE) FROM a WHERE participant_id % 3 = 2""",
)
def _pairs(spark, sf_dir):
    """Each feature for its own people, with options of its own."""
    told = {d: json.dumps({"call_direction": d}) for d in ("incoming", "outgoing")}
    each = F.when(F.col("participant_id") % 3 == 0, F.array(F.struct(F.lit("battery_level").alias("feature"), F.lit(None).cast("string").alias("options"))))
    each = each.when(F.col("participant_id") % 3 == 1, F.array(F.struct(F.lit("battery_level").alias("feature"), F.lit(None).cast("string").alias("options")), F.struct(F.lit("call_number").alias("feature"), F.lit(told["incoming"]).alias("options"))))
    each = each.otherwise(F.array(F.struct(F.lit("call_number").alias("feature"), F.lit(told["outgoing"]).alias("options"))))
    pairs = people(spark, sf_dir).withColumn("p", F.explode(each)).select("participant_id", "p.*")
    calls = frame(spark, sf_dir, "telephony")
    out = run({"device_state": frame(spark, sf_dir, "state"), "telephony": calls, "phone_usage": calls.limit(0)}, None, (), START, START + 30 * DAY, DAY, pairs=pairs)
    name = F.coalesce(F.get_json_object("options", "$.call_direction"), F.lit("battery_level")).alias("feature")
    rows = [out[f].select("participant_id", "timestamp", name, F.round(F.col("value").cast("double"), 9).alias("value")) for f in ("battery_level", "call_number")]
    return rows[0].unionByName(rows[1])


@_query("q_partitioned_scan", f"WITH {_EV} SELECT participant_id, ts, seq, value AS latitude, CAST(k AS DOUBLE) AS altitude FROM ev WHERE k % 2 = 0 AND ts BETWEEN {START + 5 * DAY + 7} AND {START + 9 * DAY}")
def _partitioned(spark, sf_dir):
    path = shared_path(spark, "events")
    sensors.write_events(sensor_events(spark, sf_dir, "gps"), path)
    return sensors.sensor(spark.read.parquet(path), "gps", START + 5 * DAY + 7, START + 9 * DAY).select("participant_id", "ts", "seq", "latitude", "altitude")


_ZONES = ("America/New_York", "Europe/Berlin", "Australia/Sydney")


@_query(
    "q_nine_am_zones",
    f"""WITH {_EV}, z AS (SELECT participant_id, seq, ts + (seq % 24) * {15 * DAY} AS moment, CASE participant_id % 3 WHEN 0 THEN '{_ZONES[0]}' WHEN 1 THEN '{_ZONES[1]}' ELSE '{_ZONES[2]}' END AS zone FROM ev),
    l AS (SELECT *, timezone(zone, make_timestamptz(moment * 1000)) AS local FROM z), b AS (SELECT *, date_trunc('day', local - INTERVAL 9 HOURS) + INTERVAL 9 HOURS AS back FROM l)
    SELECT participant_id, seq, epoch_ms(timezone(zone, back)) AS start, epoch_ms(timezone(zone, CASE WHEN back = local THEN back ELSE back + INTERVAL 1 DAY END)) AS stop FROM b""",
)
def _zones(spark, sf_dir):
    """Over a year, with the changes of clocks of each person's zone."""
    zone = F.element_at(F.array(*map(F.lit, _ZONES)), (F.col("participant_id") % 3 + 1).cast("int"))
    rows = events(spark, sf_dir).withColumn("at", F.col("ts") + (F.col("seq") % 24) * 15 * DAY)
    start, stop = nine_am(F.col("at"), F.col("at"), zone)
    return rows.select("participant_id", "seq", start.alias("start"), stop.alias("stop"))


# Places

FRAMES["shapes"] = "participant_id, ts, seq, CAST((k % 10) * 0.75 AS DOUBLE) AS latitude, CAST(floor(k / 10) * 1.25 AS DOUBLE) AS longitude"


@_query(
    "q_dbscan_shapes",
    f"""WITH RECURSIVE {_EV}, r AS (SELECT * FROM (SELECT {FRAMES["shapes"]}, row_number() OVER (PARTITION BY participant_id, ts ORDER BY seq DESC) AS nth FROM ev) WHERE nth = 1),
    p AS (SELECT a.participant_id, a.seq AS a, b.seq AS b FROM r a JOIN r b ON a.participant_id = b.participant_id AND pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2) <= 1),
    co AS (SELECT participant_id, a AS seq FROM p GROUP BY 1, 2 HAVING count(*) >= 5),
    e AS (SELECT p.participant_id, p.a, p.b FROM p JOIN co x ON x.participant_id = p.participant_id AND x.seq = p.a JOIN co y ON y.participant_id = p.participant_id AND y.seq = p.b),
    w AS (SELECT participant_id, seq AS root, seq FROM co UNION SELECT w.participant_id, w.root, e.b FROM w JOIN e ON e.participant_id = w.participant_id AND e.a = w.seq),
    lb AS (SELECT participant_id, seq, min(root) AS label FROM w GROUP BY 1, 2),
    nw AS (SELECT lb.participant_id, label, max({{'t': ts, 's': r.seq}}) AS newest FROM lb JOIN r ON r.participant_id = lb.participant_id AND r.seq = lb.seq GROUP BY 1, 2),
    cl AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY newest DESC) - 1 AS cluster FROM nw),
    bd AS (SELECT p.participant_id, p.a AS seq, min(cluster) AS cluster FROM p JOIN lb ON lb.participant_id = p.participant_id AND lb.seq = p.b JOIN cl ON cl.participant_id = lb.participant_id AND cl.label = lb.label GROUP BY 1, 2)
    SELECT r.participant_id, r.seq, CAST(coalesce(c0.cluster, bd.cluster, -1) AS INTEGER) AS cluster, lb.seq IS NOT NULL AS core FROM r LEFT JOIN lb ON lb.participant_id = r.participant_id AND lb.seq = r.seq
    LEFT JOIN cl c0 ON c0.participant_id = lb.participant_id AND c0.label = lb.label LEFT JOIN bd ON bd.participant_id = r.participant_id AND bd.seq = r.seq""",
)
def _shapes(spark, sf_dir):
    """Cores, border readings between chains and noise on a lattice whose squares of distances are exact."""
    return density.dbscan(intervals.one_per_time(frame(spark, sf_dir, "shapes")), 1.0).select("participant_id", "seq", "cluster", "core")


FRAMES["towns"] = "participant_id, ts, seq, CAST(CASE k % 4 WHEN 0 THEN 40 WHEN 1 THEN 41 WHEN 2 THEN 44 ELSE 53 END + (k % 3) * 0.0001 AS DOUBLE) AS latitude, CAST(-71 + (k % 5) * 0.0001 AS DOUBLE) AS longitude"


@_query(
    "q_kmeans",
    f"""WITH {_EV}, r AS (SELECT *, floor(latitude + 0.5) AS town, row_number() OVER (PARTITION BY participant_id, ts ORDER BY seq DESC) AS nth FROM (SELECT {FRAMES["towns"]} FROM ev)),
    c AS (SELECT participant_id, town, avg(latitude) FILTER (WHERE nth = 1) AS la, avg(longitude) FILTER (WHERE nth = 1) AS lo FROM r GROUP BY 1, 2),
    m AS (SELECT r.participant_id, r.town, la, lo, count(*) AS here, avg(110.25 * sqrt(pow(latitude - la, 2) + pow((longitude - lo) * cos(latitude), 2))) * 1000 AS radius FROM r JOIN c ON c.participant_id = r.participant_id AND c.town = r.town GROUP BY 1, 2, 3, 4),
    i AS (SELECT participant_id, town, ts, row_number() OVER (PARTITION BY participant_id ORDER BY ts, seq) - row_number() OVER (PARTITION BY participant_id, town ORDER BY ts, seq) AS island FROM r),
    dw AS (SELECT participant_id, town, sum(d) AS duration FROM (SELECT participant_id, town, max(ts) - min(ts) AS d FROM i GROUP BY participant_id, town, island) GROUP BY 1, 2)
    SELECT m.participant_id, CAST(row_number() OVER (PARTITION BY m.participant_id ORDER BY here DESC, la) - 1 AS INTEGER) AS rank, round(la, 10) AS latitude, round(lo, 10) AS longitude, round(radius, 4) AS radius, round(here / sum(here) OVER (PARTITION BY m.participant_id), 6) AS proportion, CAST(duration AS BIGINT) AS duration
    FROM m JOIN dw ON dw.participant_id = m.participant_id AND dw.town = m.town""",
)
def _towns(spark, sf_dir):
    """Four towns of fifteen spots each: one more centre than towns lowers the cost by next to nothing."""
    out = intervals.significant_locations(frame(spark, sf_dir, "towns"), method="k_means")
    return _rounded(out, "proportion").withColumns({"latitude": F.round("latitude", 10), "longitude": F.round("longitude", 10), "radius": F.round("radius", 4)})


_APART = "2 * 6378137 * asin(sqrt(least(1, pow(sin((radians(y.la) - radians(a[i].la)) / 2), 2) + cos(radians(a[i].la)) * cos(radians(y.la)) * pow(sin((radians(y.lo) - radians(a[i].lo)) / 2), 2))))"
_LATER = f"list_filter(a[i + 1:], lambda y: {_APART} < 60000)"
#: Places of a month, those within 60 km taken in one after the other.
_FOLDED = f"""{_PLACES}, fo AS (SELECT pr.participant_id, list({{'la': latitude, 'lo': longitude, 'r': CASE WHEN here < n THEN 0.0::DOUBLE END, 'p': CAST(proportion AS DOUBLE), 'd': duration}} ORDER BY pr.rank) AS a FROM pr JOIN dw ON dw.participant_id = pr.participant_id AND dw.rank = pr.rank JOIN n ON n.participant_id = pr.participant_id GROUP BY 1),
fd AS (SELECT participant_id, a, 1 AS i FROM fo UNION ALL SELECT participant_id, CASE WHEN a[i].p > 0 THEN list_concat(a[:i - 1], [{{'la': a[i].la, 'lo': a[i].lo, 'r': a[i].r, 'p': a[i].p + coalesce(list_sum(list_transform({_LATER}, lambda y: y.p)), 0), 'd': CAST(a[i].d + coalesce(list_sum(list_transform({_LATER}, lambda y: y.d)), 0) AS BIGINT)}}],
list_transform(a[i + 1:], lambda y: {{'la': y.la, 'lo': y.lo, 'r': y.r, 'p': CASE WHEN {_APART} < 60000 THEN 0.0::DOUBLE ELSE y.p END, 'd': y.d}})) ELSE a END, i + 1 FROM fd WHERE i <= len(a)),
mg AS (SELECT participant_id, unnest(list_filter(a, lambda y: y.p > 0)) AS x, generate_subscripts(list_filter(a, lambda y: y.p > 0), 1) - 1 AS rank FROM fd WHERE i = len(a) + 1)"""
ORACLES["q_sigloc_merged"] = f"WITH RECURSIVE {_EV}, {_FOLDED} SELECT participant_id, CAST(rank AS INTEGER) AS rank, x.la AS latitude, x.lo AS longitude, x.r AS radius, x.p AS proportion, x.d AS duration FROM mg"


@_query("q_entropy_merged", f"WITH RECURSIVE {_EV}, {_PEOPLE}, {_FOLDED} SELECT people.participant_id, CAST({START} AS BIGINT) AS timestamp, round(sum(-x.p * ln(x.p)), 6) AS value FROM people LEFT JOIN mg ON mg.participant_id = people.participant_id GROUP BY 1, 2")
def _entropy_merged(spark, sf_dir):
    out = series.entropy(frame(spark, sf_dir, "places"), people(spark, sf_dir), MONTH, max_dist=60_000)
    return out.withColumn("value", F.round("value", 6) + 0.0)


@_query("q_hometime_merged", f"WITH RECURSIVE {_EV}, {_PEOPLE}, {_FOLDED} SELECT people.participant_id, CAST({START} AS BIGINT) AS timestamp, x.d AS value FROM people LEFT JOIN mg ON mg.participant_id = people.participant_id AND mg.rank = 0")
def _home_merged(spark, sf_dir):
    return series.hometime(frame(spark, sf_dir, "places"), people(spark, sf_dir), MONTH, max_dist=60_000)


# Screen bouts in the encoding that the newest activity tells, surveys by question and with empty windows

_TURNED = _BOUTS.replace("IN (0, 3) THEN 1", "IN (0, 3) THEN 9").replace("IN (1, 2) THEN 0", "IN (1, 2) THEN 1").replace("THEN 9", "THEN 0")
for _old in ("st", "s1", "s2", "s3", "s4", "s5", "bouts"):
    _TURNED = _TURNED.replace(f"{_old} AS (", f"t_{_old} AS (").replace(f"FROM {_old} ", f"FROM t_{_old} ").replace(f"FROM {_old})", f"FROM t_{_old})")


#: Bouts in the encoding that each person's newest activity tells.
_ENCODED = f"""{_BOUTS}, {_TURNED}, nw AS (SELECT participant_id, max(ts) AS newest FROM ev WHERE k % 7 = 3 AND participant_id % 4 > 0 GROUP BY 1),
    ht AS (SELECT nw.participant_id, count(b."start") AS n FROM nw LEFT JOIN bouts b ON b.participant_id = nw.participant_id AND newest BETWEEN b."start" AND b."end" GROUP BY 1), wr AS (SELECT participant_id FROM ht WHERE n <> 1),
enc AS (SELECT participant_id, "start", "end", duration FROM bouts WHERE participant_id NOT IN (SELECT participant_id FROM wr) UNION ALL SELECT participant_id, "start", "end", duration FROM t_bouts WHERE participant_id IN (SELECT participant_id FROM wr))"""


def _used(spark, sf_dir):
    return events(spark, sf_dir).where("k % 7 = 3 AND participant_id % 4 > 0")


@_query("q_screen_encoded", f'WITH {_EV}, {_ENCODED} SELECT participant_id, "start", "end", duration FROM enc')
def _encoded(spark, sf_dir):
    return intervals.screen_active(frame(spark, sf_dir, "state"), _used(spark, sf_dir), TWO_DAYS)


@_query(
    "q_screen_duration_plays",
    f"""WITH {_EV}, {_WIN}, {_ENCODED}, {_CLIP.replace("FROM bouts b", "FROM enc b")}, spent AS (SELECT participant_id, w, sum("end" - "start") AS v FROM clip GROUP BY 1, 2),
    seen AS (SELECT DISTINCT s.participant_id, s.w FROM spine s JOIN ev e ON e.participant_id = s.participant_id AND e.ts BETWEEN s.low AND s.low + {DAY})
    SELECT s.participant_id, s.low AS timestamp, CAST(CASE WHEN seen.w IS NOT NULL THEN coalesce(v, 0) END AS BIGINT) AS value FROM spine s LEFT JOIN seen ON seen.participant_id = s.participant_id AND seen.w = s.w LEFT JOIN spent ON spent.participant_id = s.participant_id AND spent.w = s.w""",
)
def _duration_plays(spark, sf_dir):
    """Screen time where activities tell the encoding of each person's states."""
    return series.screen_duration(frame(spark, sf_dir, "state"), _used(spark, sf_dir), people(spark, sf_dir), GRID, TWO_DAYS)


@_query("q_survey_ids", f"WITH {_SURVEY} SELECT participant_id, ts, event, '1-URGENT' AS survey, item, value, level, duration FROM su")
def _survey_ids(spark, sf_dir):
    return sensors.survey(plays(spark, sf_dir), activities(spark), replace_ids=False).drop("type", "position")


@_query(
    "q_question_scores",
    f"""WITH {_SCORES}, od AS (SELECT sv.participant_id, sv.ts, sv.seq AS event, sl.item, sl.value, row_number() OVER (PARTITION BY sv.seq, sl.item ORDER BY sl.duration DESC, sl.level DESC, status DESC, type DESC, sl.value DESC) AS back FROM sv JOIN sl ON sl.seq = sv.seq WHERE nth = 1 AND activity = '1-URGENT')
    SELECT participant_id, ts AS "start", CAST(e AS BIGINT) AS "end", category, category AS question, CAST(score AS DOUBLE) AS score FROM sc JOIN en ON en.event = sc.event
    UNION ALL SELECT participant_id, ts, CAST(e AS BIGINT), CASE item WHEN 'A' THEN 'first' ELSE 'second' END, item, CASE value WHEN 'go' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END FROM od JOIN en ON en.event = od.event WHERE back = 1 AND item IN ('A', 'N', 'R')""",
)
def _question_scores(spark, sf_dir):
    return _scores(spark, sf_dir, return_ind_ques=True)


_YEARS = f"pp AS (SELECT DISTINCT participant_id FROM pl), z AS (SELECT min(epoch_us(o_orderdate) // 1000) // {365 * DAY} * {365 * DAY} AS s FROM orders), sp AS (SELECT participant_id, CAST(s + range * {365 * DAY} AS BIGINT) AS low FROM pp, z, range(10))"



def _years(rows) -> Grid:
    first = rows.agg(F.min("ts")).first()[0] // (365 * DAY) * (365 * DAY)
    return Grid(first, first + 3650 * DAY, 365 * DAY)


@_query(
    "q_survey_windows",
    f"""WITH {_SCORES}, {_YEARS} SELECT sp.participant_id, low AS timestamp, avg(CASE WHEN category = 'first' THEN score END) AS value, count(sc.ts) > 0 AND count(CASE WHEN category = 'first' THEN 1 END) = 0 AS unanswered
    FROM sp LEFT JOIN sc ON sc.participant_id = sp.participant_id AND sc.ts >= low AND sc.ts <= low + {365 * DAY} GROUP BY 1, 2""",
)
def _survey_windows(spark, sf_dir):
    """Every window: null without surveys, and where surveys have no answer of the category."""
    rows = plays(spark, sf_dir)
    out = series.survey_results(_scores(spark, sf_dir), rows.select("participant_id"), _years(rows), "first")
    return out.select("participant_id", "timestamp", F.nanvl("value", F.lit(None).cast("double")).alias("value"), F.coalesce(F.isnan("value"), F.lit(False)).alias("unanswered"))


_MEASURES = {"jewels_a": ("2-HIGH", "avg(CASE WHEN sl.duration > 0 THEN sl.duration END)"), "balloon_risk": ("4-NOT SPECIFIED", "CASE WHEN bool_or(NOT type OR NOT status) THEN 0 ELSE count(*) END"), "pop_the_bubbles": ("3-MEDIUM", "avg(CASE WHEN value = 'no-go' THEN CASE WHEN type THEN 1.0 ELSE 0.0 END END)")}
_LEVELS = " UNION ALL ".join(f"SELECT '{g}' AS game, participant_id, ts, CAST({m} AS DOUBLE) AS v FROM pl JOIN sl ON sl.seq = pl.seq WHERE activity = '{a}' GROUP BY participant_id, ts, pl.seq, sl.level" for g, (a, m) in _MEASURES.items())


@_query(
    "q_game_windows",
    f"""WITH {_PL}, {_SL}, {_YEARS}, lv AS ({_LEVELS}), g AS (SELECT DISTINCT game FROM lv)
    SELECT g.game, sp.participant_id, low AS timestamp, round(avg(v), 6) AS value FROM sp CROSS JOIN g LEFT JOIN lv ON lv.game = g.game AND lv.participant_id = sp.participant_id AND lv.ts >= low AND lv.ts <= low + {365 * DAY} GROUP BY 1, 2, 3""",
)
def _game_windows(spark, sf_dir):
    """Every window of three games by each one's measure; null where the game was not played."""
    rows = plays(spark, sf_dir)
    who, grid = rows.select("participant_id"), _years(rows)
    of = [series.game_results(_games(spark, sf_dir, g), who, grid, name_of_game=g).select(F.lit(g).alias("game"), "participant_id", "timestamp", F.round(F.col("value").cast("double"), 6).alias("value")) for g in _MEASURES]
    return of[0].unionByName(of[1]).unionByName(of[2])


# Studies and models


@_query("q_domain_check", f"WITH {_EV}, {_DAILY}, d AS (SELECT *, CASE WHEN participant_id % 3 = 0 THEN u END AS part FROM dl), p AS (SELECT participant_id, count(v) AS v, count(part) AS part FROM d GROUP BY 1) SELECT 'v' AS domain, 'ok' AS state, CAST(sum(v) AS BIGINT) AS n_values, count(*) AS n_participants, count(*) FILTER (WHERE v = 0) AS n_without FROM p UNION ALL SELECT 'part', 'ok', CAST(sum(part) AS BIGINT), count(*), count(*) FILTER (WHERE part = 0) FROM p UNION ALL SELECT 'none', 'empty', 0, count(*), count(*) FROM p UNION ALL SELECT 'strange', 'unknown', 0, count(*), count(*) FROM p")
def _domain_check(spark, sf_dir):
    daily = _daily(spark, sf_dir).withColumn("part", F.when(F.col("participant_id") % 3 == 0, F.col("u"))).withColumn("none", F.lit(None).cast("double"))
    return Study(daily, ("v", "part", "none", "strange")).check()


_LABEL_ = "value + 2 * k + seq % 97"


@_query(
    "q_elastic_ridge",
    f"""WITH {_EV}, c AS (SELECT corr(value, {_LABEL_}) AS r1, corr(k, {_LABEL_}) AS r2, corr(value, k) AS q FROM ev), l AS (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE, 1.0::DOUBLE, 10.0::DOUBLE]) AS penalty)
    SELECT penalty, 'value' AS feature, round(((1 + penalty) * r1 - q * r2) / (pow(1 + penalty, 2) - q * q), 6) AS coefficient FROM c, l UNION ALL SELECT penalty, 'k', round(((1 + penalty) * r2 - q * r1) / (pow(1 + penalty, 2) - q * q), 6) FROM c, l""",
)
def _ridge(spark, sf_dir):
    """The path at its ridge end, where two features have closed coefficients."""
    rows = events(spark, sf_dir).withColumn("y", F.expr(_LABEL_))
    path = reports.elastic_net_path(rows, ["value", "k"], "y", [0.01, 0.1, 1.0, 10.0], ratio=0.0)
    return _rounded(spark.createDataFrame([(x["penalty"], f, c) for x in path for f, c in x["coefficients"].items()], "penalty double, feature string, coefficient double"), "coefficient")


def _tail(t: str, df: str) -> str:
    """Two-sided p of Student's t by Simpson's rule over 2,000 steps of its density."""
    density_ = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * pow(1 + pow(abs({t}) * s / 2000.0, 2) / {df}, -({df} + 1) / 2.0)"
    return f"greatest(0.0, 1 - 2 * abs({t}) / 6000.0 * (SELECT sum({density_} * CASE WHEN s IN (0, 2000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END) FROM steps))"


@_query(
    "q_corr_p",
    f"""WITH {_EV}, steps AS (SELECT CAST(range AS DOUBLE) AS s FROM range(2001)), d AS (SELECT participant_id, avg(value) AS a, avg(k) AS b, avg(seq % 1000) AS c FROM ev GROUP BY 1),
    r AS (SELECT 'a' AS x, 'b' AS y, corr(a, b) AS r, count(*) - 2 AS df FROM d UNION ALL SELECT 'a', 'c', corr(a, c), count(*) - 2 FROM d UNION ALL SELECT 'b', 'c', corr(b, c), count(*) - 2 FROM d),
    t AS (SELECT *, r * sqrt(df / (1 - r * r)) AS t FROM r), p AS (SELECT x, y, r, {_tail("t", "df")} AS p FROM t), k AS (SELECT *, row_number() OVER (ORDER BY p) AS i FROM p),
    j AS (SELECT *, min(least(1, p * 3 / i)) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM k)
    SELECT x AS a, y AS b, round(r, 6) AS r, round(p, 5) AS p, round(q, 5) AS adjusted_p FROM j""",
)
def _corr_p(spark, sf_dir):
    """Over the means of people, so that p is not all zero."""
    rows = events(spark, sf_dir).groupBy("participant_id").agg(F.avg("value").alias("a"), F.avg("k").alias("b"), F.avg(F.col("seq") % 1000).alias("c"))
    found = reports.correlations(rows, ["a", "b", "c"])
    return spark.createDataFrame([(x["a"], x["b"], round(x["r"], 6), round(x["p"], 5), round(x["adjusted_p"], 5)) for x in found], "a string, b string, r double, p double, adjusted_p double")


@_query(
    "q_ttest_p",
    f"""WITH {_EV}, steps AS (SELECT CAST(range AS DOUBLE) AS s FROM range(2001)), d AS (SELECT participant_id, avg(value) AS m FROM ev GROUP BY 1), g AS (SELECT participant_id % 2 = 0 AS g, count(*) AS n, avg(m) AS m, var_samp(m) AS v FROM d GROUP BY 1),
    t AS (SELECT a.n + b.n - 2 AS df, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t FROM g a, g b WHERE a.g AND NOT b.g)
    SELECT round(t, 6) AS t, round({_tail("t", "df")}, 5) AS p FROM t""",
)
def _ttest_p(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("participant_id").agg(F.avg("value").alias("m")).withColumn("even", F.col("participant_id") % 2 == 0)
    got = reports.group_test(rows, "m", "even")
    return spark.createDataFrame([(round(got["t"], 6), round(got["p"], 5))], "t double, p double")
