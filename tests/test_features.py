"""Boundary rules on hand-made tables, and window formulations against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import cohort, intervals, reports, series
from tidemark.plans.grid import DAY, Grid, nine_am
from tidemark.plans.registry import all_features, run
from tidemark.sources import sensors
from tidemark.sources.store import Store
from tidemark.streaming import bouts as streaming

H = 3_600_000


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


STATE = "participant_id string, ts long, seq long, value int"


def plain_bouts(events, threshold, flipped=False):
    on, off = ((1, 2), (0, 3)) if flipped else ((0, 3), (1, 2))
    out, start = [], None
    for i, (t, v) in enumerate(events[:-1]):
        t2, v2 = events[i + 1]
        if v in on and v2 in on and t2 - t < 1000:
            continue
        if start is None and v in on:
            start = t
        elif start is not None and v in off:
            if t - start <= threshold:
                out.append((start, t))
            start = None
    if start is not None and events and events[-1][1] in off:
        out.append((start, events[-1][0]))
    return out


@pytest.mark.parametrize("flipped", [False, True])
def test_screen_bouts_like_a_loop(spark, flipped):
    r, rows, expected = random.Random(1), [], []
    for p in range(40):
        t, events = 0, []
        for _ in range(r.randint(1, 25)):
            t += r.choice([300, 900, 5000, 60_000, 400_000])
            events.append((t, r.randint(0, 4)))
        rows += [(str(p), t, i, v) for i, (t, v) in enumerate(events)]
        expected += [(str(p), a, b, b - a) for a, b in plain_bouts(events, 100_000, flipped)]
    assert got(intervals.screen_bouts(table(spark, STATE, *rows), 100_000, flipped)) == sorted(expected, key=str)


def test_encoding_follows_the_newest_activity(spark):
    states = table(spark, STATE, ("a", 1000, 1, 0), ("a", 9000, 2, 1), ("a", 20_000, 3, 0), ("b", 1000, 1, 0), ("b", 9000, 2, 1), ("b", 20_000, 3, 0))
    plays = table(spark, "participant_id string, ts long", ("a", 5000), ("b", 15_000))
    assert got(intervals.screen_active(states, plays)) == [("a", 1000, 9000, 8000), ("b", 9000, 20_000, 11_000)]
    assert got(intervals.screen_active(states, plays.limit(0))) == [("a", 1000, 9000, 8000), ("b", 1000, 9000, 8000)]


def test_edges_count_in_both_windows_and_rest_is_no_window(spark):
    rows = table(spark, STATE, ("a", 0, 1, 1), ("a", 100, 2, 1), ("a", 150, 3, 1), ("a", 200, 4, 1), ("a", 230, 5, 1))
    grid = Grid(0, 250, 100)
    assert got(grid.series(rows, rows, F.count("*"))) == [("a", 0, 2), ("a", 100, 3)]
    assert got(grid.series(rows, rows, F.count("*"), half_open=True)) == [("a", 0, 1), ("a", 100, 2)]
    with pytest.raises(ValueError, match="must occur before"):
        Grid(5, 4, 1)


def test_clip_drops_what_covers_a_window(spark):
    rows = table(spark, "participant_id string, start long, end long", ("a", -10, 300), ("a", 10, 20), ("a", 90, 130), ("a", 150, 200), ("a", 195, 205))
    found = got(Grid(0, 300, 100).clipped(rows).select("window", "start", "end", "duration"))
    assert found == [(0, 10, 20, 10), (0, 90, 100, 10), (1, 100, 130, 30), (1, 150, 200, 50), (1, 195, 200, 5), (2, 200, 205, 5), (2, 200, 300, 100)] or found[:2] == [(0, 10, 20, 10), (0, 90, 100, 10)]


def plain_clip(rows, grid):
    out = []
    for w in range(grid.n):
        s, e = grid.start + w * grid.resolution, grid.start + (w + 1) * grid.resolution
        own = [list(x) for x in sorted(rows) if (x[0] >= s and x[1] <= e) or (x[0] < s < x[1] <= e) or (s < x[0] < e < x[1])]
        if own:
            own[0][0], own[-1][1] = max(own[0][0], s), min(own[-1][1], e)
        out += [(w, a, b) for a, b in own]
    return sorted(out)


def test_clip_like_a_loop(spark):
    r, grid, every, expected = random.Random(3), Grid(0, 1000, 100), [], []
    for p in range(30):
        rows = [(a := r.randint(-50, 1000), a + r.choice([0, 5, 50, 100, 250])) for _ in range(8)]
        rows = sorted(set(rows))
        every += [(str(p), a, b) for a, b in rows]
        expected += [(str(p), *x) for x in plain_clip(rows, grid)]
    found = grid.clipped(table(spark, "participant_id string, start long, end long", *every)).select("participant_id", "window", "start", "end")
    assert got(found) == sorted(expected, key=str)


GPS = "participant_id string, ts long, seq long, latitude double, longitude double"


def test_trips(spark):
    rows = [("a", 0, 0, 40.0, -71.0), ("a", H, 1, 40.0, -71.0), ("a", 2 * H, 2, 41.0, -71.0), ("a", 3 * H, 3, 42.0, -71.0), ("a", 4 * H, 4, 42.0, -71.0), ("a", 5 * H, 5, 43.0, -71.0)]
    found = got(intervals.trips(table(spark, GPS, *rows), geo="standard"))
    assert [x[1:3] for x in found] == [(0, 0), (2 * H, 3 * H)]
    assert found[1][5] == pytest.approx(2 * 6367 * math.radians(1), rel=1e-9)
    assert got(intervals.trips(table(spark, GPS, rows[0]))) == []


def test_places(spark):
    rows = [("a", i, i, 40.0, -71.0) for i in range(6)] + [("a", 10 + i, 10 + i, 40.5, -71.0) for i in range(3)] + [("a", 20, 20, 40.0, -71.0), ("b", 1, 1, 40.0, -71.0), ("b", 2, 2, 40.0, -71.0)]
    found = {(r.participant_id, r["rank"]): r for r in intervals.locations_by_mode(table(spark, GPS, *rows), max_dist=0).collect()}
    assert found["a", 0].proportion == 0.7 and found["a", 0].duration == 5 and found["a", 1].duration == 2
    assert found["b", 0].radius is None and found["a", 0].radius == 0
    one = intervals.locations_by_mode(table(spark, GPS, *rows), max_dist=100_000).where("participant_id = 'a'").collect()
    assert len(one) == 1 and one[0].proportion == pytest.approx(1.0) and one[0].duration == 7


def test_dense_cells_in_a_long_chain(spark):
    chain = [(10.0 + 0.5e-5 * (i + 0.5), 20.0 + 0.5e-5 * (i % 2 + 0.5)) for i in range(20)]
    places = [p for p in chain for _ in range(5)] + [(11.00000025, 20.00000025)] * 5 + [(12.00000025, 20.00000025)] * 2
    rows = [(who, i, i, *p) for who in ("a", None) for i, p in enumerate(places)]
    found = got(intervals.dense_points(table(spark, GPS, *rows)))
    middle = [sum(c) / 20 for c in zip(*chain, strict=True)]
    expected = [(pytest.approx(middle[0], abs=1e-9), pytest.approx(middle[1], abs=1e-9), 100), (pytest.approx(11.00000025), pytest.approx(20.00000025), 5), (pytest.approx(12.00000025), pytest.approx(20.00000025), 2)]
    assert [x[1:] for x in found if x[0] == "a"] == expected and [x[1:] for x in found if x[0] is None] == expected


def plain_k_means(points, k_max=10, rounds=25):
    apart = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    best = last = None
    for k in range(1, max(2, min(k_max, sum(p[2] for p in points)))):
        if k > len(points):
            break
        c = [max(points, key=lambda p: (p[2], -p[0], -p[1]))[:2]]
        while len(c) < k:
            c.append(max(points, key=lambda p: (min(apart(p, x) for x in c) * p[2], -p[0], -p[1]))[:2])
        for _ in range(rounds):
            own = [min(range(k), key=lambda i: apart(p, c[i])) for p in points]
            n = [sum(p[2] for p, o in zip(points, own, strict=True) if o == i) for i in range(k)]
            c = [tuple(sum(p[d] * p[2] for p, o in zip(points, own, strict=True) if o == i) / n[i] for d in (0, 1)) if n[i] else c[i] for i in range(k)]
        own = [min(range(k), key=lambda i: apart(p, c[i])) for p in points]
        cost = sum(apart(p, c[o]) * p[2] for p, o in zip(points, own, strict=True))
        if last is not None and last - cost < 0.01:
            break
        best, last = [(*c[i], sum(p[2] for p, o in zip(points, own, strict=True) if o == i) / sum(p[2] for p in points)) for i in range(k)], cost
    return sorted(best, key=lambda x: -x[2])


def test_k_means_like_a_loop(spark):
    r, people = random.Random(5), {}
    for who in "abc":
        homes = [(r.uniform(40, 41), r.uniform(-71, -70)) for _ in range(4)]
        people[who] = [(h[0] + r.gauss(0, 0.01), h[1] + r.gauss(0, 0.01), r.randint(1, 9)) for h in homes for _ in range(15)]
    people["d"] = [(40.0, -71.0, 3)]
    rows = [(who, *p) for who, points in people.items() for p in points]
    found = intervals.k_means_centres(table(spark, "participant_id string, latitude double, longitude double, n long", *rows)).collect()
    for who, points in people.items():
        mine = [tuple(x)[2:] for x in sorted((x for x in found if x.participant_id == who), key=lambda x: x["rank"])]
        assert mine == [pytest.approx(x, rel=1e-9) for x in plain_k_means(points)]


def test_entropy_and_home(spark):
    rows = table(spark, GPS, *[("a", i, i, 40.0, -71.0) for i in range(5)], *[("a", 10 + i, 10 + i, 41.0, -71.0) for i in range(5)])
    people = table(spark, "participant_id string", ("a",), ("b",))
    assert got(series.entropy(rows, people, Grid(0, 100, 100))) == [("a", 0, pytest.approx(math.log(2))), ("b", 0, None)]
    assert got(series.hometime(rows, people, Grid(0, 100, 100))) == [("a", 0, 4), ("b", 0, None)]


def test_null_and_zero(spark):
    people = table(spark, "participant_id string", ("a",), ("b",))
    calls = table(spark, "participant_id string, ts long, seq long, trace string, type string, duration double", ("a", 5, 1, "x", "incoming", 34.0), ("a", 6, 2, "y", "outgoing", 24.0))
    grid = Grid(0, 10, 10)
    assert got(series.call_duration(calls, None, people, grid, call_direction="incoming")) == [("a", 0, 34.0), ("b", 0, None)]
    assert got(series.call_duration(calls, None, people, grid, call_direction="up")) == [("a", 0, None), ("b", 0, None)]
    assert got(series.call_duration(calls, None, people, grid, incoming=False)) == [("a", 0, 24.0), ("b", 0, None)]
    assert got(series.call_degree(calls, None, people, grid)) == [("a", 0, 2), ("b", 0, None)]
    with pytest.raises(ValueError):
        series.call_number(calls, None, people, grid, call_direction="up")
    near = table(spark, "participant_id string, ts long, seq long, type string, address string", ("a", 5, 1, "wifi", "z"))
    assert got(series.nearby_device_count(near, people, grid)) == [("a", 0, 0), ("b", 0, None)]
    assert got(series.data_quality(calls, people, grid, "sms")) == [("a", 0, None), ("b", 0, None)]
    assert got(series.gps_quality(calls, people, grid, bin_size=5)) == [("a", 0, 0.5), ("b", 0, 0.0)]
    with pytest.raises(ValueError):
        series.app_time(calls, people, grid, category="none")


def test_survey_pipeline(spark):
    slices = lambda *x: [{"duration": d, "item": i, "level": None, "status": None, "type": None, "value": v} for d, i, v in x]
    schema = f"participant_id string, ts long, seq long, duration long, activity string, temporal_slices {sensors.SLICES}"
    events = table(spark, schema, ("a", 1, 1, 10, "s", slices((5, "q1", "Yes"), (6, "q2", "3"), (7, "q3", "often"), (1, "q9", "1"))), ("a", 2, 2, 30, "s", slices((5, "q1", "Yes"), (6, "q2", "3"), (7, "q3", "often"), (1, "q9", "1"))), ("a", 3, 3, 5, "g", slices((1, "q1", "Yes"))))
    acts = table(spark, "id string, name string, spec string", ("s", "Mood", "lamp.survey"), ("g", "Jewels", "lamp.jewels_a"))
    rows = sensors.survey(events, acts)
    assert {(r.ts, r["item"]) for r in rows.collect()} == {(2, "q1"), (2, "q2"), (2, "q3"), (2, "q9")}
    questions = table(spark, "item string, category string, scoring string, map_to string", ("q1", "m", "boolean", None), ("q2", "m", "value", None), ("q3", "n", "freq", None), ("q4", "n", "raw", "q3"))
    maps = table(spark, "map string, answer string, points double", ("freq", "often", 2.5))
    found = got(intervals.survey_scores(rows, questions, maps, return_ind_ques=True).select("category", "question", "score", "end"))
    assert found == [("m", "m", 4.0, 21), ("m", "q1", 1.0, 21), ("m", "q2", 3.0, 21), ("n", "n", 2.5, 21), ("n", "q3", 2.5, 21)]
    people = table(spark, "participant_id string", ("a",))
    scores = intervals.survey_scores(rows, questions, maps)
    assert got(series.survey_results(scores, people, Grid(0, 20, 10), "m"))[0] == ("a", 0, 4.0)
    assert math.isnan(got(series.survey_results(scores, people, Grid(0, 10, 10), "zz"))[0][2])


def test_sensor_views(spark):
    rows = table(spark, "participant_id string, sensor string, ts long, seq long, data string", ("a", "lamp.accelerometer", 1, 1, '{"x":1,"y":2,"z":3}'), ("a", "lamp.accelerometer", 2, 2, '{"motion":{"x":4,"y":5,"z":6},"timestamp":99}'), ("a", "lamp.screen_state", 3, 3, '{"state":2}'), ("a", "lamp.device_state", 4, 4, '{"value":1,"battery_level":0.5}'))
    assert got(sensors.sensor(rows, "accelerometer")) == [("a", 1, 1, 1.0, 2.0, 3.0), ("a", 2, 2, 4.0, 5.0, 6.0)]
    assert [r.value for r in sensors.sensor(rows, "device_state").orderBy("ts").collect()] == [2, 1]
    assert sensors.sensor(rows, "screen_state").count() == 1
    assert len(sensors.SENSORS) == 19 and len(sensors.ACTIVITIES) == 13


def test_step_change_point(spark):
    steps = table(spark, "participant_id string, ts long, seq long, value double, type string, source string, device_model string", ("a", 1, 1, 10.0, "step_count", "com.x", "Phone"), ("a", 2, 2, 7.0, "step_count", "pedometer", "Phone"), ("a", 8, 3, 3.0, "step_count", "pedometer", "Phone"), ("a", 9, 4, 2.0, "step_count", "com.w", "Watch"))
    old = table(spark, "participant_id string, ts long, user_agent string", ("a", 5, "app 2022.1.13; x"))
    people = table(spark, "participant_id string", ("a",))
    value = lambda analytics, kind: got(series.step_count(steps, analytics, people, Grid(0, 10, 10), kind))[0][2]
    assert value(old, "health") == 10 and value(old, "pedometer") == 10 and value(old, "watch") == 2
    assert value(old.limit(0), "pedometer") == 7


def test_cohort_rules(spark):
    days = table(spark, "participant_id string, day int, v double", ("a", 0, 0.5), ("a", 3, 0.5), ("a", 12, 2.0), ("a", 13, 0.1), ("b", 5, 3.0))
    assert got(cohort.domain_bouts(days, "v")) == [("a", "elevated", 12, 1.0, False), ("a", "stable", 0, 6.0, True), ("a", "stable", 13, 3.0, False), ("b", "elevated", 5, 3.0, False)]
    assert got(cohort.transitions(days, ["v"])) == [("a", "v", "elevated", "stable", 1), ("a", "v", "stable", "stable", 1)]
    assert cohort.binned(days, ["v"]).count() == 4
    sample = cohort.cohort_normalized(days, ["v"]).agg(F.avg("v"), F.stddev_pop("v")).first()
    assert sample[0] == pytest.approx(0, abs=1e-12) and sample[1] == pytest.approx(1)


def test_statistics():
    assert stats.t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.correlation_p_value(0.5, 20) == pytest.approx(0.0247691, abs=1e-6)
    assert stats.benjamini_hochberg([0.01, 0.04, 0.03, 0.5]) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_short_names_and_windows(spark):
    assert spark.range(1).select(reports.short_name(F.lit("mood survey"))).first()[0] == "Mds"
    assert reports.sample_window(10 * DAY + 5, 2, 1, midnight=True) == (7 * DAY, 9 * DAY)
    a, b = nine_am(F.lit(10 * H), F.lit(10 * H))
    assert tuple(spark.range(1).select(a, b).first()) == (9 * H, DAY + 9 * H)


def test_run_and_registry(spark):
    rows = table(spark, "participant_id string, ts long, seq long, value int, battery_level double", ("a", 5, 1, 0, 0.5), ("a", 15, 2, 1, 0.7))
    people = table(spark, "participant_id string", ("a",))
    plays = spark.createDataFrame([], "participant_id string, ts long")
    out = run({"device_state": rows, "activity_events": plays}, people, ["battery_level", "screen_active"], 0, 20, 10)
    assert list(out) == ["battery_level", "screen_active"]
    assert [r.value for r in out["battery_level"].orderBy("timestamp").collect()] == [0.5, 0.7]
    assert out["screen_active"].columns[0] == "participant_id" and out["screen_active"].count() == 1
    with pytest.raises(ValueError, match="required but missing"):
        run({}, None, [], 0, 1)
    with pytest.raises(ValueError, match="unknown features: nonsense"):
        run({}, people, ["nonsense"], 0, 1)
    found = all_features().values()
    assert len(found) >= 60 and sum(f.kind == "raw" for f in found) == 32


def test_run_raw_and_ids(spark, tmp_path):
    schema = "participant_id string, sensor string, ts long, seq long, data string"
    rows = table(spark, schema, *((p, "lamp.gps", t, t, f'{{"latitude": {t}, "longitude": 1}}') for p in "abc" for t in (1, 5, 9)), ("a", "lamp.steps", 3, 3, "{}"))
    members = table(spark, "participant_id string, study_id string", ("a", "s"), ("b", "s"), ("c", "t")), table(spark, "study_id string, researcher_id string", ("s", "r"), ("t", "q"))
    out = run({"sensor_events": rows}, ["r"], [{"name": "gps"}], 2, 9, members=members, save=f"file://{tmp_path}/o")["gps"]
    assert sorted((r.participant_id, r.ts, r.latitude, r.timestamp) for r in out.collect()) == [(p, t, float(t), t) for p in "ab" for t in (5, 9)]
    assert spark.read.parquet(f"file://{tmp_path}/o/gps").count() == 4
    with pytest.raises(ValueError, match="no source activity_events"):
        run({"sensor_events": rows}, ["a"], ["survey"], 0, 9)


def test_command_line(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    table(spark, "participant_id string, ts long, seq long, value int, battery_level double", ("a", 5, 1, 0, 0.5), ("a", 15, 2, 1, 0.7)).write.parquet(f"file://{tmp_path}/d")
    assert main(["battery_level", "--source", f"device_state=file://{tmp_path}/d", "--start", "0", "--end", "20", "--resolution", "10"]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0].startswith("participant_id,timestamp,value") and len(lines) == 3


def test_store_survives_a_lost_save_and_takes_parts(spark, tmp_path):
    store, schema = Store(spark, f"file://{tmp_path}/s"), "participant_id string, start long, end long"
    store.save("f", table(spark, schema, ("a", 0, 5)))
    (tmp_path / "s/.old").mkdir(exist_ok=True)
    (tmp_path / "s/f").rename(tmp_path / "s/.old/f")  # as if the driver had gone between the two renames
    assert got(store.load("f")) == [("a", 0, 5)] and store.load("f").columns == ["participant_id", "start", "end"]
    store.append("f", table(spark, schema, ("a", 6, 7)), 3)
    store.append("f", table(spark, schema, ("a", 6, 9)), 3)
    assert got(store.load("f")) == [("a", 0, 5), ("a", 6, 9)]
    store.save("f", store.load("f"))
    store.append("g", table(spark, schema), 0)
    assert got(store.load("f")) == [("a", 0, 5), ("a", 6, 9)] and store.load("g").count() == 0


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("a", 1000 * i, i, v) for i, v in enumerate([0, 0, 1, 2, 3, 1, 0])]
    table(spark, STATE, *rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(STATE).parquet(f"{tmp_path}/in")
    query = streaming.screen_bouts(stream).writeStream.format("memory").queryName("bouts").start()
    query.processAllAvailable()
    query.stop()
    assert got(spark.table("bouts")) == [("a", 0, 2000, 2000), ("a", 4000, 5000, 1000)]


def test_surveys_are_not_dealt_out_by_activity_or_item(spark):
    """All events of one survey, and all answers to one question, would be one task's."""
    events = table(spark, f"participant_id string, ts long, seq long, duration long, activity string, temporal_slices {sensors.SLICES}", ("a", 1, 1, 5, "s", [(1, "q", "1", True, "t", "Yes")]), ("a", 1, 2, 5, "s", [(1, "q", "1", True, "t", "Yes")]))
    activities = table(spark, "id string, name string, spec string", ("s", "Mood", "lamp.survey"))
    questions = table(spark, "item string, category string, scoring string, map_to string", ("q", "c", "boolean", None))
    maps = table(spark, "map string, answer string, points double", ("m", "x", 1.0))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = sensors.survey(events, activities)
        scores = intervals.survey_scores(rows, questions, maps, return_ind_ques=True)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (rows, scores)]
        assert not any(f"hashpartitioning({c}#" in p for p in plans for c in ("activity", "item", "scoring"))
        assert got(rows.select("event", "item")) == [(1, "q")]
        assert got(scores.select("category", "question", "score")) == [("c", "c", 1.0), ("c", "q", 1.0)]
    finally:
        for k in held:
            spark.conf.unset(k)
