"""Kept results beside runs without a store: people, ranges, options, lost drivers, archives."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.plans.registry import run
from tidemark.sources import sensors
from tidemark.sources.store import Store
from tests.test_features import H, got, table

STATES = "participant_id string, ts long, seq long, value int"
GPS = "participant_id string, ts long, seq long, latitude double, longitude double"
ACC = "participant_id string, ts long, seq long, x double, y double, z double"
EVENTS = "participant_id string, sensor string, ts long, seq long, data string"


def both(spark, store, sources, people, features, start, end, **options):
    """Rows with the store, which have to be those without it."""
    kept = run(sources, people, features, start, end, store=store, **options)
    plain = run(sources, people, features, start, end, **options)
    for name in plain:
        assert got(kept[name].select(*plain[name].columns)) == got(plain[name]), name
    return kept


def counted(read, calls):
    def one(low, high):
        calls.append((low, high))
        return read(low, high)

    return one


def test_raw_ranges_by_person_and_options(spark, tmp_path):
    rows = table(spark, EVENTS, *((p, "lamp.gps", t, t, f'{{"latitude": {t}, "longitude": 1}}') for p in "abc" for t in range(0, 40, 2)), ("a", "lamp.steps", 3, 3, '{"value": 7}'))
    store = Store(spark, f"file://{tmp_path}/k")
    for people, low, high in ((["a"], 5, 20), (["b"], 5, 20), (["a", "b"], 0, 30), (["c", "a"], 10, 39), (["a"], 12, 13), (["nobody"], 0, 9)):
        both(spark, store, {"sensor_events": rows}, people, ["gps"], low, high)
    assert both(spark, store, {"sensor_events": rows}, ["a"], ["steps"], 0, 9)["steps"].first().value == 7
    silent = run({"sensor_events": rows.where("participant_id = 'c'")}, ["c"], ["gps"], 12, 20, store=store)["gps"]
    assert silent.count() == 5


def test_only_gaps_are_read(spark, tmp_path):
    store, calls = Store(spark, f"file://{tmp_path}/k"), []
    rows = table(spark, "participant_id string, ts long", *((p, t) for p in "ab" for t in range(100)))
    read = counted(lambda low, high: sensors.between(rows, low, high), calls)
    a, ab = table(spark, "participant_id string", ("a",)), table(spark, "participant_id string", ("a",), ("b",), (None,))
    assert store.ranged("r", None, a, 20, 29, read).count() == 10 and store.ranged("r", None, a, 50, 59, read).count() == 10
    assert store.ranged("r", None, a, 22, 27, read).count() == 6 and calls == [(20, 29), (50, 59)]
    assert store.ranged("r", None, a, 25, 70, read).count() == 46 and calls[2:] == [(30, 70)]
    assert store.ranged("r", None, ab, 20, 70, read).count() == 102 and calls[3:] == [(20, 70)]
    assert store.ranged("r", {"x": 1}, a, 20, 29, read).count() == 10 and len(calls) == 5
    key = store.key("r")
    store._add(key, rows.where("participant_id = 'a' AND ts BETWEEN 15 AND 80"), table(spark, "participant_id string, low long, high long", ("a", 15, 80)))  # as a run at the same time
    assert store.ranged("r", None, ab, 10, 90, read).orderBy("participant_id", "ts").collect() == [(p, t) for p in "ab" for t in range(10, 91)]
    store.compact("r")
    assert len(store.parts(key)) == 1 and got(store.ranged("r", None, ab, 10, 90, read)) == got(rows.where("ts BETWEEN 10 AND 90"))
    store.forget("r", people=a)
    n = len(calls)
    assert store.ranged("r", None, ab, 40, 45, read).count() == 12 and calls[n:] == [(40, 45)]
    store.forget("r")
    assert store.parts(key) == []


def test_gaps_like_sets(spark, tmp_path):
    r, store = random.Random(2), Store(spark, f"file://{tmp_path}/k")
    rows = table(spark, "participant_id long, ts long", *((p, t) for p in range(6) for t in range(60)))
    for _ in range(4):
        people = table(spark, "participant_id long", *((p,) for p in r.sample(range(6), 3)))
        low = r.randint(0, 50)
        high = low + r.randint(0, 20)
        found = store.ranged("r", None, people, low, high, lambda a, b: sensors.between(rows, a, b))
        assert got(found) == got(rows.join(people, "participant_id", "left_semi").where(F.col("ts").between(low, high)))


def histories(seed):
    r, states, gps, acc = random.Random(seed), [], [], []
    for p in "abcd":
        t = 0
        for i in range(150):
            t += r.choice([300, 900, 5000, 60_000, H, 9 * H])
            states.append((p, t, i, r.randint(0, 4)))
            gps.append((p, t, i, 40 + r.choice([0, 0, 0.4, 2]) * r.random(), -71.0))
            acc.append((p, t, i, r.random(), r.random(), 1.0))
    return states, gps, acc


def test_growing_intervals_equal_plain_runs(spark, tmp_path):
    store, (states, gps, acc) = Store(spark, f"file://{tmp_path}/k"), histories(4)
    plays = [(p, t, 0) for p, t, i, _ in states if i in (20, 90, 140)]
    last = max(x[1] for x in states)

    def sources(upto):
        cut = lambda rows: [x for x in rows if x[1] <= upto]
        return {"device_state": table(spark, STATES, *cut(states)), "gps": table(spark, GPS, *cut(gps)), "accelerometer": table(spark, ACC, *cut(acc)), "activity_events": table(spark, "participant_id string, ts long, seq long", *cut(plays), ("zz", 0, 0))}

    features = ["trips", {"name": "screen_active", "duration_threshold": 200_000}, {"name": "acc_jerk", "threshold": 6000}]
    for part, people in ((0.1, "ab"), (0.35, "abc"), (0.61, "d"), (1, "abcd")):
        both(spark, store, sources(int(last * part)), list(people), features, 0, last)
    both(spark, store, sources(last), ["a"], [{"name": "acc_jerk", "threshold": 50}, "trips"], last // 5, last // 2)
    both(spark, store, sources(last), ["a", "b"], [{"name": "acc_jerk", "threshold": 6000}], 0, last)
    before = got(store._intervals(store.key("trips", {})))
    store.compact("trips", {})
    assert got(store._intervals(store.key("trips", {}))) == before and len(store.parts(store.key("trips", {}))) == 1
    late = run({**sources(last), "gps": table(spark, GPS, *gps, ("a", 5, 999, 50.0, 1.0))}, ["a"], ["trips"], 0, last)["trips"]
    store.forget("trips", {}, table(spark, "participant_id string", ("a",)))
    assert got(run({**sources(last), "gps": table(spark, GPS, *gps, ("a", 5, 999, 50.0, 1.0))}, ["a"], ["trips"], 0, last, store=store)["trips"].select(*late.columns)) == got(late)
    assert got(store._intervals(store.key("trips", {})).where("participant_id <> 'a'")) == [x for x in before if x[0] != "a"]


def test_only_the_tail_is_computed(spark, tmp_path):
    store, asked = Store(spark, f"file://{tmp_path}/k"), []
    people = table(spark, "participant_id string", ("a",), ("b",))

    def compute(since):
        asked.append(None if since is None else got(since))
        return table(spark, "participant_id string, start long, end long", ("a", 0, 5), ("a", 10, 15), ("a", 20, 26), ("b", 3, 4))

    for _ in range(2):
        assert got(store.grown("f", None, people, compute)) == [("a", 0, 5), ("a", 10, 15), ("a", 20, 26), ("b", 3, 4)]
    assert asked == [None, [("a", 10)]]


def test_survey_events_are_kept_before_repeats_go(spark, tmp_path):
    slices = lambda v: [{"duration": 1, "item": "q", "level": None, "status": None, "type": None, "value": v}]
    schema = f"participant_id string, ts long, seq long, duration long, activity string, temporal_slices {sensors.SLICES}"
    events = table(spark, schema, ("a", 1, 1, 10, "s", slices("x")), ("a", 9, 2, 30, "s", slices("x")), ("b", 5, 3, 1, "s", slices("y")))
    acts = table(spark, "id string, name string, spec string", ("s", "Mood", "lamp.survey"))
    sources, store = {"activity_events": events, "activities": acts}, Store(spark, f"file://{tmp_path}/k")
    both(spark, store, sources, ["a"], ["survey"], 0, 5)
    assert [r.ts for r in both(spark, store, sources, ["a", "b"], ["survey"], 0, 9)["survey"].orderBy("ts").collect()] == [5, 9]
    named = both(spark, store, sources, ["a"], [{"name": "survey", "replace_ids": False}], 0, 5)["survey"].first()
    assert named.survey == "s" and named.ts == 1


def test_a_lost_part_does_not_count(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/k")
    people = table(spark, "participant_id string", ("a",))
    rows = table(spark, "participant_id string, ts long", ("a", 1), ("a", 2))
    read = lambda low, high: sensors.between(rows, low, high)
    store.ranged("r", None, people, 0, 1, read)
    rows.write.parquet(f"{tmp_path}/k/{store.key('r')}/rows/part__=p00000001-lost")  # rows without a manifest
    assert store.ranged("r", None, people, 0, 5, read).count() == 2


def test_archives(spark, tmp_path):
    store, other = (Store(spark, f"file://{tmp_path}/{x}") for x in "kl")
    rows = table(spark, "participant_id string, ts long", *((p, t) for p in "ab" for t in range(50)))
    a, ab = table(spark, "participant_id string", ("a",)), table(spark, "participant_id string", ("a",), ("b",))
    read = lambda low, high: sensors.between(rows, low, high)
    made = lambda since: table(spark, "participant_id string, start long, end long", ("a", 0, 5), ("b", 3, 4))
    store.ranged("r", {"x": 1}, ab, 10, 30, read)
    store.grown("f", None, ab, made)
    store.archive(f"file://{tmp_path}/archive")
    other.ranged("r", {"x": 1}, a, 20, 40, read)
    other.grown("f", None, a, lambda since: table(spark, "participant_id string, start long, end long", ("a", 1, 2)))
    other.restore(f"file://{tmp_path}/archive")
    calls = []
    assert got(other.ranged("r", {"x": 1}, a, 10, 40, counted(read, calls))) == [("a", t) for t in range(10, 41)] and not calls
    assert other.ranged("r", {"x": 1}, ab, 10, 30, counted(read, calls)).count() == 42 and not calls
    assert got(other._intervals(other.key("f"))) == [("a", 1, 2), ("b", 3, 4)]
    other.restore(f"file://{tmp_path}/archive")
    assert other.ranged("r", {"x": 1}, ab, 10, 30, read).count() == 42
    before = {k: other.parts(k) for k in other.logs()}
    next(Path(f"{tmp_path}/archive/{store.key('f')}/rows").rglob("*.parquet")).unlink()
    with pytest.raises(ValueError, match="not whole"):
        other.restore(f"file://{tmp_path}/archive")
    with pytest.raises(ValueError, match="no whole archive"):
        other.restore(f"file://{tmp_path}/nothing")
    assert {k: other.parts(k) for k in other.logs()} == before


def test_pairs_of_people_and_features(spark):
    states = table(spark, "participant_id string, ts long, seq long, value int, battery_level double", *((p, t, t, 0, t / 10) for p in "abc" for t in (1, 6)))
    calls = table(spark, "participant_id string, ts long, seq long, trace string, type string, duration double", *((p, t, t, "x", k, 1.0) for p in "abc" for t, k in ((2, "incoming"), (3, "outgoing"), (4, "incoming"))))
    sources = {"device_state": states, "telephony": calls, "phone_usage": calls.limit(0)}
    pairs = table(spark, "participant_id string, feature string, options string", ("a", "battery_level", None), ("b", "battery_level", None), ("a", "call_number", '{"call_direction": "incoming"}'), ("c", "call_number", '{"call_direction": "outgoing"}'))
    out = run(sources, None, (), 0, 10, 10, pairs=pairs)
    assert got(out["battery_level"].select("participant_id", "value")) == [("a", pytest.approx(0.35)), ("b", pytest.approx(0.35))]
    assert got(out["call_number"].select("participant_id", "value", "options")) == [("a", 2, '{"call_direction": "incoming"}'), ("c", 1, '{"call_direction": "outgoing"}')]
    plain = run(sources, ["x"], ["battery_level"], 0, 10, 10, pairs=pairs.drop("options"), parameters={"call_number": {"call_direction": "all"}})
    assert got(plain["call_number"].select("participant_id", "value")) == [("a", 3), ("c", 3)]
    with pytest.raises(ValueError, match="unknown features: no"):
        run(sources, None, (), 0, 10, 10, pairs=table(spark, "participant_id string, feature string", ("a", "no")))


def test_default_range_is_moved_to_nine(spark):
    states = table(spark, "participant_id string, ts long, seq long, value int, battery_level double", ("a", 10 * H, 1, 0, 0.5), ("a", 34 * H, 2, 1, 0.7))
    out = run({"device_state": states}, ["a"], ["battery_level"])["battery_level"]
    assert [(r.timestamp, r.value) for r in out.orderBy("timestamp").collect()] == [(9 * H, 0.5), (33 * H, 0.7)]
    assert run({"device_state": states}, ["a"], ["battery_level"], zone="America/New_York")["battery_level"].first().timestamp == -10 * H
    assert run({"device_state": states}, ["a"], ["battery_level"], resolution=H)["battery_level"].count() == 24
    assert run({"device_state": states}, ["b"], ["battery_level"]) == {}


def test_the_example_of_the_readme_in_a_fresh_process():
    code = "from tidemark.plans.registry import run, all_features\nassert 'hometime' in all_features()\ntry:\n    run({}, [], ['screen_duration', 'hometime', 'none'], 0, 1)\nexcept ValueError as e:\n    assert str(e) == 'unknown features: none', e"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
