"""Density clusters and the merging of places, beside plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_features import GPS, got, table
from tidemark.operators import density, intervals


def plain_dbscan(rows, eps, least=5):
    """rows: (ts, seq, lat, lon), one for each ts; labels by looking through them from the newest on, as the usual algorithm does."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][:2], reverse=True)
    near = {i: [j for j in order if (rows[i][2] - rows[j][2]) ** 2 + (rows[i][3] - rows[j][3]) ** 2 <= eps * eps] for i in order}
    label, n = {}, 0
    for i in order:
        if i in label or len(near[i]) < least:
            continue
        label[i], todo = n, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in label:
                    label[j] = n
                    if len(near[j]) >= least:
                        todo.append(j)
        n += 1
    return [label.get(i, -1) for i in range(len(rows))], [len(near[i]) >= least for i in range(len(rows))]


def shapes(seed):
    """Chains, a ring around a blob, border points between clusters, repeated positions and noise, about an eps of 1."""
    r = random.Random(seed)
    out = [(0.9 * i, 0.0) for i in range(8)] + [(20 + 3 * math.cos(a / 4), 20 + 3 * math.sin(a / 4)) for a in range(25)] + [(20 + r.gauss(0, 0.3), 20 + r.gauss(0, 0.3)) for _ in range(12)]
    out += [(40.0, 40.0)] * 6 + [(40.0, 42.0)] * 6 + [(40.0, 41.0)] + [(40.75, 42.0)] * 2 + [(60.0, 60.0)] * 4 + [(60.5, 60.5)] + [(80.0, 80.0)] * 3
    out += [(100 + r.uniform(0, 5), r.uniform(0, 5)) for _ in range(60)] + [(0.7 * i + 200, 0.7 * i) for i in range(9)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("eps", [1.0, 0.6])
def test_dbscan_like_a_loop(spark, eps):
    rows, expected = [], []
    for who, seed in (("a", 1), ("b", 2), (None, 3)):
        own = [(100 + i, i, *p) for i, p in enumerate(shapes(seed))]
        rows += [(who, *x) for x in own]
        labels, cores = plain_dbscan(own, eps)
        expected += [(who, *x, c, k) for x, c, k in zip(own, labels, cores, strict=True)]
    frame = table(spark, GPS, *rows, ("a", 1, 0, None, 1.0), ("a", 2, 0, float("nan"), 1.0)).selectExpr("*", "1 AS n", "2 AS label", "3 AS core")
    found = got(density.dbscan(frame, eps))
    assert found == sorted(expected, key=str)
    means = {}
    for who, _, _, la, lo, c, _ in expected:
        means.setdefault((who, c) if c >= 0 else (who, la, lo), []).append((la, lo))
    sums = sorted(((k[0] or "", sum(x for x, _ in v) / len(v), sum(y for _, y in v) / len(v), len(v)) for k, v in means.items()))
    mine = sorted((w or "", x, y, n) for w, x, y, n in got(intervals.dense_points(frame, eps)))
    assert [x[0] for x in mine] == [x[0] for x in sums] and [x[3] for x in mine] == [x[3] for x in sums]
    assert [c for x in mine for c in x[1:3]] == pytest.approx([c for x in sums for c in x[1:3]], abs=1e-9)


def test_crowded_cells_make_no_pairs(spark):
    n = 30_000
    here = spark.range(n).select(F.lit("a").alias("participant_id"), F.col("id").alias("ts"), F.col("id").alias("seq"), (F.rand(1) * 0.69).alias("latitude"), (F.rand(2) * 0.69).alias("longitude"))
    found = density.dbscan(here.unionByName(here.withColumn("ts", F.col("ts") + n).withColumn("longitude", F.col("longitude") + 1.4)), 1.0)
    assert found.select("cluster").distinct().count() == 1 and found.count() == 2 * n


@pytest.fixture
def no_broadcast(spark):
    """Any broadcast of a row fails, as large ones do on the driver."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_stored_tables_are_not_broadcast(spark, no_broadcast):
    rows = [(who, 100 + i, i, *p) for who in ("a", "b") for i, p in enumerate(shapes(1))]
    assert density.dbscan(table(spark, GPS, *rows), 1.0).count() == len(rows)


def test_k_means_broadcasts_nothing_that_grows(spark, no_broadcast):
    rows = [(who, i, i, 40.0 + i % 2, -71.0) for who in ("a", "b") for i in range(12)]
    found = got(intervals.locations_by_k_means(table(spark, GPS, *rows), k_max=3).select("participant_id", "rank", "latitude", "proportion"))
    assert found == [(who, rank, 40.0 + rank, 0.5) for who in ("a", "b") for rank in (0, 1)]


def plain_absorbed(rows, most):
    def apart(a, b):
        la, lb = math.radians(a["latitude"]), math.radians(b["latitude"])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b["longitude"] - a["longitude"]) / 2) ** 2
        return 2 * 6378137 * math.asin(math.sqrt(min(1.0, h)))

    rows = [dict(r) for r in rows]
    for i, big in enumerate(rows):
        if big["proportion"] > 0:
            for small in rows[i + 1 :]:
                if apart(big, small) < most:
                    big["proportion"] += small["proportion"]
                    small["proportion"] = 0
                    big["duration"] += small["duration"]
    return [(r["latitude"], r["longitude"], r["proportion"], r["duration"]) for r in rows if r["proportion"] > 0]


def test_absorbed_like_a_loop(spark):
    r, rows, expected = random.Random(6), [], []
    for p in range(25):
        n = r.choice([1, 2, 5, 12])
        own = [{"latitude": 40 + 0.001 * r.randint(0, 8), "longitude": -71 + 0.001 * r.randint(0, 8), "proportion": 1 / (i + 1), "duration": r.randint(0, 99)} for i in range(n)]
        rows += [(str(p), i, x["latitude"], x["longitude"], 0.5, x["proportion"], x["duration"]) for i, x in enumerate(own)]
        expected += [(str(p), i, x[0], x[1], 0.5, x[2], x[3]) for i, x in enumerate(plain_absorbed(own, 300))]
    places = table(spark, "participant_id string, rank int, latitude double, longitude double, radius double, proportion double, duration long", *rows)
    assert got(intervals.absorbed(places, 300)) == sorted(expected, key=str)
    assert "Python" not in intervals.absorbed(places, 300)._jdf.queryExecution().toString()
