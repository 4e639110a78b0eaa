"""Density clusters of positions, exactly: readings are cores where min_samples readings lie within eps, cores within eps of each other are
one cluster, and what is within eps of a core belongs to it.

Positions lie in cells so narrow that all of a cell are within eps of each other. A cell with min_samples readings holds cores only, so
distances are taken for the few positions of the other cells; and the cores of a cell are in one cluster, so clusters are
found among cells. Two cells near each other are joined if some of their outermost cores are within eps; only where this
leaves them in different clusters are their cores near the other cell compared, so no pairs within a place are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.store import merged, stored

#: Cells are so many eps wide: their diagonal is less than eps, and what is within eps is two cells away at most.
WIDTH = 0.7
_STEPS = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """who, node and label of nodes (who, node): the least node of the same who that links (who, a, b) lead to.

    In each round a node takes the least label of its neighbours, then the label of the node that its label names, until no label
    changes; labels are written to the shared folder.
    """
    labels = nodes.select("who", "node", F.col("node").alias("label"))
    links = stored(links.select("who", "a", "b").unionByName(links.select("who", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    if links.isEmpty():
        return labels
    labels = stored(labels, "labels")
    while True:
        met = merged(links, labels.withColumnRenamed("node", "a"), ["who", "a"]).groupBy("who", F.col("b").alias("node")).agg(F.min("label").alias("other"))
        nearer = merged(labels, met, ["who", "node"], "left").select("who", "node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        named = labels.select("who", F.col("node").alias("label"), F.col("label").alias("beyond"))
        after = stored(merged(nearer, named, ["who", "label"]).select("who", "node", "was", F.least("label", "beyond").alias("label")), "labels")
        labels = after.select("who", "node", "label")
        if after.where("label < was").isEmpty():
            return labels


def _square(a: str, b: str) -> str:
    return f"pow({a}.latitude - {b}.latitude, 2) + pow({a}.longitude - {b}.longitude, 2)"


def _around(rows: DataFrame, keep: list[str], steps: list[tuple[int, int]] = _STEPS) -> DataFrame:
    """keep and cell of each cell around that of rows (who, cell)."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    return rows.withColumn("d__", each).select("who", *keep, F.struct((F.col("cell.i") + F.col("d__.a")).alias("i"), (F.col("cell.j") + F.col("d__.b")).alias("j")).alias("cell"))


def _order() -> Column:
    return F.struct("ts", "seq")


def positions(gps: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """who, at (latitude, longitude), n, newest (ts, seq), cell, core and label of each position of gps (one reading for each ts): core is
    true for cores, label the least cell of the cluster, null for noise. Positions without a number are left out.

    who is a struct of participant_id, so that null is a participant like others. What is within eps of cores of several clusters goes to the
    one with the newest core, the one that comes first where readings are looked through from the newest on.
    """
    cell = F.struct(*(F.floor(F.col(c) / (eps * WIDTH)).cast("long").alias(k) for c, k in (("latitude", "i"), ("longitude", "j"))))
    known = gps.where("latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)")
    rows = known.groupBy(F.struct("participant_id").alias("who"), F.struct("latitude", "longitude").alias("at"), cell.alias("cell")).agg(F.count("*").alias("n"), F.max(_order()).alias("newest"))
    rows = stored(rows, "positions")
    full = rows.groupBy("who", "cell").agg((F.sum("n") >= min_samples).alias("full"))
    rows = stored(merged(rows, full, ["who", "cell"]), "positions")
    few, near = rows.where("NOT full"), f"{_square('mine', 'at')} <= {eps * eps!r}"
    met = merged(_around(few.withColumnRenamed("at", "mine"), ["mine"]), rows.select("who", "cell", "at", "n"), ["who", "cell"]).where(near)
    counts = met.groupBy("who", F.col("mine").alias("at")).agg((F.sum("n") >= min_samples).alias("many"))
    rows = stored(merged(rows, counts, ["who", "at"], "left").withColumn("core", F.col("full") | F.coalesce("many", F.lit(False))).drop("full", "many"), "positions")
    cores = rows.where("core")

    outer = [f"{f}(at, {x})" for x in ("at.latitude", "at.longitude", "at.latitude + at.longitude", "at.latitude - at.longitude") for f in ("max_by", "min_by")]
    cells = stored(cores.groupBy("who", "cell").agg(F.array_distinct(F.array(*map(F.expr, outer))).alias("rim")), "cells")
    ahead = [s for s in _STEPS if s > (0, 0)]
    pairs = merged(_around(cells.withColumn("a", F.col("cell")).withColumnRenamed("rim", "mine"), ["a", "mine"], ahead), cells, ["who", "cell"])
    touch = F.expr(f"exists(mine, x -> exists(rim, y -> {_square('x', 'y')} <= {eps * eps!r}))")
    box = lambda c: f"struct(array_min({c}.latitude) AS s, array_max({c}.latitude) AS n, array_min({c}.longitude) AS w, array_max({c}.longitude) AS e)"
    pairs = stored(pairs.select("who", "a", F.col("cell").alias("b"), touch.alias("touch"), F.expr(box("mine")).alias("box_a"), F.expr(box("rim")).alias("box_b")), "pairs")
    nodes = cells.select("who", F.col("cell").alias("node"))
    labels = stored(components(nodes, pairs.where("touch")), "labels")

    def labelled(frame: DataFrame, cell: str) -> DataFrame:
        return merged(frame, labels.select("who", F.col("node").alias(cell), F.col("label").alias(f"label_{cell}")), ["who", cell])

    def beside(cell: str, box: str, name: str) -> DataFrame:
        """Cores of a cell within eps of the other one's box."""
        off = lambda c, low, high: f"pow(greatest({box}.{low} - {c}, {c} - {box}.{high}, 0), 2)"
        rows = merged(apart, cores.select("who", F.col("cell").alias(cell), F.col("at").alias(name)), ["who", cell])
        return rows.where(f"{off(f'{name}.latitude', 's', 'n')} + {off(f'{name}.longitude', 'w', 'e')} <= {eps * eps * (1 + 1e-9)!r}").select("who", "a", "b", "label_a", "label_b", name)

    apart = labelled(labelled(pairs.where("NOT touch"), "a"), "b").where("label_a <> label_b")
    by = ["who", "a", "b", "label_a", "label_b"]
    more = merged(beside("a", "box_b", "x"), beside("b", "box_a", "y"), by).where(f"{_square('x', 'y')} <= {eps * eps!r}")
    more = stored(more.select("who", F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "links")
    if not more.isEmpty():
        joined = components(labels.select("who", F.col("label").alias("node")).distinct(), more)
        labels = merged(labels, joined.select("who", F.col("node").alias("label"), F.col("label").alias("final")), ["who", "label"]).select("who", "node", F.col("final").alias("label"))
        labels = stored(labels, "labels")

    of_cells = labels.withColumnRenamed("node", "cell")
    cores = merged(cores, of_cells, ["who", "cell"])
    newest = cores.groupBy("who", "label").agg(F.max("newest").alias("first"))
    edge = merged(_around(rows.where("NOT core").withColumnRenamed("at", "mine"), ["mine"]), cores.select("who", "cell", "at", "label"), ["who", "cell"]).where(near)
    edge = merged(edge.select("who", F.col("mine").alias("at"), "label").distinct(), newest, ["who", "label"]).groupBy("who", "at").agg(F.max_by("label", "first").alias("label"))
    columns = ["who", "at", "n", "newest", "cell", "core", "label"]
    return stored(cores.select(*columns).unionByName(merged(rows.where("NOT core"), edge, ["who", "at"], "left").select(*columns)), "positions")


def dbscan(gps: DataFrame, eps: float = 1e-5, min_samples: int = 5) -> DataFrame:
    """participant_id, ts, seq, latitude, longitude, cluster and core of each reading of gps: clusters are numbered from 0, those with
    newer cores first, and noise is -1. Readings without a position are left out. eps is in degrees."""
    at = positions(gps, eps, min_samples)
    order = at.where("core").groupBy("who", "label").agg(F.max("newest").alias("first"))
    order = order.withColumn("cluster", F.row_number().over(W.partitionBy("who").orderBy(F.desc("first"))) - 1).drop("first")
    at = merged(at, order, ["who", "label"], "left").select("who", "at", "core", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    rows = gps.select("participant_id", "ts", "seq", "latitude", "longitude").withColumn("who", F.struct("participant_id")).withColumn("at", F.struct("latitude", "longitude"))
    return merged(rows, at, ["who", "at"]).select("participant_id", "ts", "seq", "latitude", "longitude", "cluster", "core")


def reduced(gps: DataFrame, eps: float = 1e-5, min_samples: int = 5) -> DataFrame:
    """participant_id, latitude, longitude, n: the mean position and number of readings of each cluster, and noise as it is."""
    at = positions(gps, eps, min_samples)
    mean = [(F.sum(F.col(f"at.{c}") * F.col("n")) / F.sum("n")).alias(c) for c in ("latitude", "longitude")]
    found = at.where("label IS NOT NULL").groupBy("who", "label").agg(*mean, F.sum("n").alias("n"))
    out = found.select("who.participant_id", "latitude", "longitude", "n")
    return out.unionByName(at.where("label IS NULL").select("who.participant_id", "at.latitude", "at.longitude", "n"))
