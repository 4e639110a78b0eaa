"""Studies, models, layouts by day and zones on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_features import H, got, table
from tidemark.operators import reports
from tidemark.operators.study import Study, domain_check
from tidemark.plans.grid import DAY, nine_am, now
from tidemark.sources import sensors

DAILY = "participant_id string, day int, v double, w double, t string"


@pytest.fixture(scope="module")
def daily(spark):
    return table(spark, DAILY, ("a", 0, 1.0, None, "x"), ("a", 1, 3.0, float("nan"), "y"), ("b", 0, None, None, "z"), (None, 0, 2.0, None, None))


def test_domain_check(spark, daily):
    assert got(domain_check(daily)) == [("t", "text", 3, 3, 1), ("v", "ok", 3, 3, 1), ("w", "empty", 0, 3, 3)]
    assert got(domain_check(daily, ["v", "zz", "v"])) == [("v", "ok", 3, 3, 1), ("zz", "unknown", 0, 3, 3)]
    assert got(domain_check(daily.limit(0), ["v", "zz"])) == [("v", "empty", 0, 0, 0), ("zz", "unknown", 0, 0, 0)]


def test_versions_of_a_study(spark, daily):
    study = Study(daily, ("v",), table(spark, "participant_id string, age int", ("a", 20), ("b", 30), ("c", 90)))
    changed = study.normalized().imputed(["v"]).binned(days=2)
    assert changed.steps == ("normalize", "impute", "bin") and changed.daily.columns == ["participant_id", "bin", "v"]
    assert str(got(changed.reset().daily)) == str(got(daily)) and changed.reset().steps == () and study.reset() is study
    back = changed.reset(1)
    assert back.steps == ("normalize",) and str(got(back.daily)) == str(got(study.normalized().daily)) and changed.reset(-1).steps == ("normalize", "impute")
    assert len(study) == 3 and list(study) == [None, "a", "b"] and study.participant("a").count() == 2 and study.participant("q").count() == 0
    assert got(study.age_statistics()) == [(25.0, 5.0)]
    more = study.with_participants(table(spark, "participant_id string, day int, v double", ("b", 5, 9.0), ("c", 0, 1.0)))
    assert len(more) == 4 and got(more.participant("b").select("day", "v")) == [(5, 9.0)]
    with pytest.raises(ValueError, match="reset"):
        changed.with_participants(daily)
    with pytest.raises(ValueError, match="unknown domains: zz"):
        study.normalized(["zz"])
    whole = study.normalized(whole=True).daily.agg(F.avg("v"), F.stddev_pop("v")).first()
    assert whole[0] == pytest.approx(0) and whole[1] == pytest.approx(1)


def test_elastic_net_like_plain_descent(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4)) @ np.diag([1, 5, 0.1, 1]) + np.array([100, 0, 3, 0])
    y = 2 * x[:, 0] - x[:, 1] + r.normal(size=300)
    rows = [(str(i // 3), *map(float, x[i]), 7.0, float(y[i])) for i in range(300)] + [("z", None, 1.0, 1.0, 1.0, 7.0, 1.0), ("z", math.nan, 1.0, 1.0, 1.0, 7.0, 1.0)]
    frame = table(spark, "participant_id string, a double, b double, c double, d double, e double, y double", *rows)
    path = reports.elastic_net_path(frame, list("abcde"), "y", [0.001, 0.1, 0.5, 5.0], ratio=0.5)
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    for step in path:
        b = np.zeros(4)
        for _ in range(3000):
            for j in range(4):
                left = z[:, j] @ (t - z @ b + z[:, j] * b[j]) / 300
                b[j] = np.sign(left) * max(0, abs(left) - step["penalty"] * 0.5) / (1 + step["penalty"] * 0.5)
        assert list(step["coefficients"].values()) == pytest.approx([*b, 0.0], abs=1e-7)
    assert [s["penalty"] for s in path] == [0.001, 0.1, 0.5, 5.0] and path[0]["r2"] > 0.9 > path[2]["r2"] and set(path[3]["coefficients"].values()) == {0.0}
    folds = dict(got(frame.select("participant_id", reports.person_fold(3)).distinct()))
    left = [x for x in range(300)]
    missed = total = 0.0
    for f in {0, 1, 2}:
        out = np.array([folds[str(i // 3)] == f for i in left])
        m, my = x[~out].mean(0), y[~out].mean()
        a, u = (x - m) / x.std(0), (y - my) / y.std()
        b = np.linalg.solve(a[~out].T @ a[~out] / (~out).sum() + 0.1 * np.eye(4), a[~out].T @ u[~out] / (~out).sum())
        missed += ((u[out] - a[out] @ b) ** 2).sum()
        total += (u[out] ** 2).sum()
    assert reports.elastic_net_path(frame, list("abcde"), "y", [0.1], ratio=0.0)[0]["r2"] == pytest.approx(1 - missed / total, abs=1e-6)
    assert reports.elastic_net_path(frame.limit(0), ["a"], "y", [1.0]) == [] and reports.elastic_net_path(frame, ["a"], "e", [1.0]) == []


def test_improvement_model_keeps_people_together(spark):
    r = random.Random(3)
    rows = [(str(i // 4), r.gauss(0, 1) + (i % 2), r.gauss(0, 1), i % 2 == 1) for i in range(240)]
    model = reports.improvement_model(table(spark, "participant_id string, a double, b double, better boolean", *rows), ["a", "b"], "better", penalties=(0.01, 1.0), person="participant_id")
    assert max(model.avgMetrics) > 0.6


def test_written_events_are_read_by_sensor_and_day(spark, tmp_path):
    rows = table(spark, "participant_id string, sensor string, ts long, seq long, data string", *(("a", s, d * DAY + H, d, '{"latitude": 1}') for s in ("lamp.gps", "lamp.steps") for d in range(-2, 9)))
    sensors.write_events(rows, f"file://{tmp_path}/e")
    kept = spark.read.parquet(f"file://{tmp_path}/e")
    found = sensors.sensor(kept, "gps", -DAY + H, 3 * DAY)
    assert got(found.select("ts")) == got(sensors.sensor(rows, "gps", -DAY + H, 3 * DAY).select("ts"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = sensors.sensor(kept, "gps", -DAY + H, 3 * DAY)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "sensor" in filters and "event_day" in filters and ">= -1" in filters and "<= 3" in filters
    assert "event_day" not in found.columns
    plays = rows.drop("sensor", "data").withColumn("activity", F.lit("x"))
    sensors.write_events(plays, f"file://{tmp_path}/p")
    acts = table(spark, "id string, name string, spec string", ("x", "J", "lamp.jewels_a"))
    assert got(sensors.activity(spark.read.parquet(f"file://{tmp_path}/p"), acts, "jewels_a", 0, 2 * DAY).select("ts").distinct()) == [(H,), (DAY + H,)]


def test_nine_in_zones_and_now(spark):
    rows = table(spark, "z string, t long", ("America/New_York", 1_710_075_600_000), ("America/New_York", 1_710_075_600_001), ("America/New_York", 1_730_556_000_000), ("UTC", 9 * H))
    a, b = nine_am(F.col("t"), F.col("t"), F.col("z"))
    found = {(r.z, r.t): (r.a, r.b) for r in rows.select("z", "t", a.alias("a"), b.alias("b")).collect()}
    # 10 March 2024, 9 in the morning, is 13:00 UTC; the day before it was 14:00 UTC
    assert found["America/New_York", 1_710_075_600_000] == (1_710_075_600_000, 1_710_075_600_000)
    assert found["America/New_York", 1_710_075_600_001] == (1_710_075_600_000, 1_710_075_600_000 + DAY)
    assert found["America/New_York", 1_730_556_000_000] == (1_730_552_400_000, 1_730_552_400_000 + DAY + H)
    assert found["UTC", 9 * H] == (9 * H, 9 * H)
    assert now(12.9) == 12_000 and now() % 1000 == 0
