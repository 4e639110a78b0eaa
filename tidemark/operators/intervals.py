"""Interval features: sparse events with start and end, by window functions over each participant's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_km, planar_km
from tidemark.operators.density import reduced
from tidemark.plans.registry import PRIMARY, feature
from tidemark.sources.store import merged, stored


def by_time(*keys: str):
    """Each participant's rows in order of time and arrival."""
    return W.partitionBy("participant_id", *keys).orderBy("ts", "seq")


def one_per_time(rows: DataFrame, *keys: str) -> DataFrame:
    """Of a participant's rows with equal ts the one that arrived last."""
    same = W.partitionBy("participant_id", *keys, "ts").orderBy(F.desc("seq"))
    return rows.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")


def runs(flag: Column, over) -> Column:
    """A number that grows by one at each row where flag is true: rows of one number are one run."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(over.rowsBetween(W.unboundedPreceding, 0))


@feature(PRIMARY, "accelerometer")
def acc_jerk(accelerometer: DataFrame, threshold: int = 500) -> DataFrame:
    """Jerk between readings less than threshold ms apart: participant_id, start, end, acc_jerk."""
    rows = one_per_time(accelerometer)
    dt = (F.lead("ts").over(by_time()) - F.col("ts")) / 1000
    jerk = F.sqrt(sum(F.pow((F.lead(c).over(by_time()) - F.col(c)) / dt, 2) for c in "xyz"))
    rows = rows.select("participant_id", F.col("ts").alias("start"), F.lead("ts").over(by_time()).alias("end"), jerk.alias("acc_jerk"), dt.alias("dt"))
    return rows.where(F.col("dt") < threshold / 1000).drop("dt")


def screen_bouts(device_state: DataFrame, duration_threshold: int = 7_200_000, flipped: bool = False) -> DataFrame:
    """Bouts from a first on-event to the next off-event: participant_id, start, end, duration.

    On is 0 or 3 and off 1 or 2, or the other way round if flipped; other values are nothing. An on-event that another
    follows within a second is skipped. Bouts over the threshold go, unless the last event of all ends them.
    """
    on, off = ((1, 2), (0, 3)) if flipped else ((0, 3), (1, 2))
    state = F.when(F.col("value").isin(*on), 1).when(F.col("value").isin(*off), 0)
    rows = device_state.select("participant_id", "ts", "seq", state.alias("on"))
    after, then = F.lead("ts").over(by_time()), F.lead("on").over(by_time())
    rows = rows.select("*", after.isNull().alias("last"), F.coalesce((F.col("on") == 1) & (then == 1) & (after - F.col("ts") < 1000), F.lit(False)).alias("bounced"))
    rows = rows.where(F.col("on").isNotNull() & ~F.col("bounced") & ~(F.col("last") & (F.col("on") == 1)))
    before = F.lag("on").over(by_time())
    turns = rows.withColumn("before", before).where((F.col("before") != F.col("on")) | (F.col("before").isNull() & (F.col("on") == 1)))
    ends = turns.select("participant_id", "on", F.col("ts").alias("start"), F.lead("ts").over(by_time()).alias("end"), F.lead("last").over(by_time()).alias("final"))
    bouts = ends.where((F.col("on") == 1) & F.col("end").isNotNull()).withColumn("duration", F.col("end") - F.col("start"))
    return bouts.where((F.col("duration") <= duration_threshold) | F.col("final")).select("participant_id", "start", "end", "duration")


def bouts_in_both(device_state: DataFrame, duration_threshold: int = 7_200_000) -> DataFrame:
    """Screen-on bouts in the usual encoding and, with flipped true, in the other one."""
    usual, turned = screen_bouts(device_state, duration_threshold), screen_bouts(device_state, duration_threshold, flipped=True)
    return usual.withColumn("flipped", F.lit(False)).unionByName(turned.withColumn("flipped", F.lit(True)))


def in_encoding(both: DataFrame, activity_events: DataFrame) -> DataFrame:
    """Of bouts in both encodings those of the one under which a person's newest activity event falls into exactly one bout."""
    newest = activity_events.groupBy("participant_id").agg(F.max("ts").alias("newest"))
    usual = both.where("NOT flipped").drop("flipped")
    hits = newest.join(usual, "participant_id", "left").groupBy("participant_id").agg(F.sum(F.when(F.col("newest").between(F.col("start"), F.col("end")), 1).otherwise(0)).alias("n"))
    wrong = hits.where("n <> 1").select("participant_id")
    turned = both.where("flipped").drop("flipped")
    return usual.join(wrong, "participant_id", "left_anti").unionByName(turned.join(wrong, "participant_id", "left_semi"))


@feature(PRIMARY, "device_state", "activity_events", base=(bouts_in_both, "flipped", ("device_state",), in_encoding))
def screen_active(device_state: DataFrame, activity_events: DataFrame, duration_threshold: int = 7_200_000) -> DataFrame:
    """Screen-on bouts, in the encoding under which the newest activity event falls into exactly one of them.

    Without activity events the usual encoding holds; it is turned round where the newest event is not in exactly one bout.
    """
    return in_encoding(bouts_in_both(device_state, duration_threshold), activity_events)


@feature(PRIMARY, "gps")
def trips(gps: DataFrame, geo: str = "swapped") -> DataFrame:
    """Runs of moving readings: participant_id, start, end, latitude, longitude, distance (km).

    A reading is stationary when slower than 10 km/h or over 600 hours after the last; a first one moves. A run that is still
    going on at the end is no trip. geo: "swapped" takes latitudes as longitudes, as kept results do; "standard" does not.
    """
    lat, lon = ("longitude", "latitude") if geo == "swapped" else ("latitude", "longitude")
    hours = (F.col("ts") - F.lag("ts").over(by_time())) / 3_600_000
    dx = haversine_km(F.lag(lat).over(by_time()), F.lag(lon).over(by_time()), F.col(lat), F.col(lon), 6367.0)
    rows = gps.select("participant_id", "ts", "seq", "latitude", "longitude", hours.alias("dt"), dx.alias("dx"))
    rows = rows.withColumn("still", F.coalesce((F.col("dx") < 10 * F.col("dt")) | (F.col("dt") > 600), F.lit(False)))
    rows = rows.withColumn("run", runs(F.col("still") != F.coalesce(F.lag("still").over(by_time()), ~F.col("still")), by_time())).withColumn("open", F.lead("ts").over(by_time()).isNull())
    moving = rows.where("NOT still").groupBy("participant_id", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.min_by("latitude", F.struct("ts", "seq")).alias("latitude"), F.min_by("longitude", F.struct("ts", "seq")).alias("longitude"), F.sum(F.coalesce("dx", F.lit(0.0))).alias("distance"), F.max("open").alias("open"))
    return moving.where("NOT open").select("participant_id", "start", "end", "latitude", "longitude", "distance")


def dwell(rows: DataFrame, *keys: str) -> DataFrame:
    """Time in each cluster: over runs of consecutive readings in it, last less first ts. keys part independent histories."""
    own = W.partitionBy("participant_id", *keys).orderBy("ts", "seq")
    numbered = rows.withColumn("at", F.row_number().over(own)).withColumn("in", F.row_number().over(W.partitionBy("participant_id", *keys, "cluster").orderBy("ts", "seq")))
    island = numbered.where("cluster >= 0").groupBy("participant_id", *keys, "cluster", (F.col("at") - F.col("in")).alias("island")).agg((F.max("ts") - F.min("ts")).alias("spent"))
    return island.groupBy("participant_id", *keys, "cluster").agg(F.sum("spent").alias("duration"))


def clustered(gps: DataFrame, *keys: str, max_clusters: int = -1, min_cluster_size: float = 0.01) -> DataFrame:
    """Readings (one per ts) with the rank of their rounded place, -1 if it is no cluster; n is the number of readings.

    Places are ranked by count, then latitude and longitude. With max_clusters the first so many count, else those with more than
    int(min_cluster_size * n) readings, n - 1 of them at most.
    """
    rows = one_per_time(gps, *keys).withColumn("lat", F.round("latitude", 3)).withColumn("lon", F.round("longitude", 3))
    places = rows.groupBy("participant_id", *keys, "lat", "lon").agg(F.count("*").alias("here"))
    person = W.partitionBy("participant_id", *keys)
    places = places.withColumn("n", F.sum("here").over(person)).withColumn("rank", F.row_number().over(person.orderBy(F.desc("here"), "lat", "lon")) - 1)
    good = F.col("rank") < max_clusters if max_clusters != -1 else (F.col("here") > F.floor(F.col("n") * min_cluster_size)) & (F.col("rank") < F.col("n") - 1)
    places = places.withColumn("cluster", F.when(good, F.col("rank")).otherwise(-1)).drop("rank", "here")
    return rows.join(places, ["participant_id", *keys, "lat", "lon"])


def _metres_sql(a: str, b: str) -> str:
    half = f"pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin((radians({b}.longitude) - radians({a}.longitude)) / 2), 2)"
    return f"2 * 6378137.0D * asin(sqrt(least(1.0D, {half})))"


def absorbed(places: DataFrame, max_dist: float, *keys: str) -> DataFrame:
    """Ranked places (participant_id, keys, rank, latitude, longitude, radius, proportion, duration) with the near ones taken in.

    In order of rank, a place that still has a share takes in the later ones within max_dist metres: it gets their shares, which are then
    zero, and their times, which later places in reach get as well. Places without a share go, the others are ranked anew. It is a
    fold over the array of a history's places, of which there are about a hundred at most by their least share.
    """
    inner = [c for c in places.columns if c not in ("participant_id", *keys)]
    one = places.groupBy("participant_id", *keys).agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in inner if c != "rank")))).alias("all"))
    near = f"{_metres_sql('element_at(a, i)', 'y')} < {float(max_dist)!r}D"
    later = f"filter(slice(a, i + 1, size(a)), y -> {near})"
    fields = {
        "proportion": f"CASE WHEN k + 1 = i THEN aggregate({later}, x.proportion, (s, y) -> s + y.proportion) WHEN k + 1 > i AND {near.replace('y.', 'x.')} THEN 0.0D ELSE x.proportion END",
        "duration": f"CASE WHEN k + 1 = i THEN aggregate({later}, x.duration, (s, y) -> s + y.duration) ELSE x.duration END",
    }
    changed = ", ".join(f"{fields.get(c, f'x.{c}')} AS {c}" for c in ["rank", *(c for c in inner if c != "rank")])
    step = f"CASE WHEN element_at(a, i).proportion > 0 THEN transform(a, (x, k) -> struct({changed})) ELSE a END"
    folded = one.withColumn("all", F.expr(f"filter(aggregate(sequence(1, size(all)), all, (a, i) -> {step}), x -> x.proportion > 0)"))
    out = folded.select("participant_id", *keys, F.posexplode("all").alias("at", "x"))
    return out.select("participant_id", *keys, *(F.col("at").cast("int").alias("rank") if c == "rank" else F.col(f"x.{c}").alias(c) for c in inner)).select(*places.columns)


def locations_by_mode(gps: DataFrame, *keys: str, max_clusters: int = -1, min_cluster_size: float = 0.01, max_dist: float = 300) -> DataFrame:
    """participant_id, keys, rank, latitude, longitude, radius (m), proportion and duration (ms) of the places most read.

    radius is null when one place holds all readings; proportion is of the readings in any cluster.
    """
    rows = clustered(gps, *keys, max_clusters=max_clusters, min_cluster_size=min_cluster_size)
    inside = rows.where("cluster >= 0")
    off = planar_km(F.col("lon"), F.col("lat"), F.col("longitude"), F.col("latitude")) * 1000
    sums = inside.groupBy("participant_id", *keys, "cluster").agg(F.first("lat").alias("latitude"), F.first("lon").alias("longitude"), F.avg(off).alias("radius"), F.count("*").alias("here"), F.first("n").alias("n"))
    total = F.sum("here").over(W.partitionBy("participant_id", *keys))
    sums = sums.withColumn("proportion", F.col("here") / total).withColumn("radius", F.when(F.col("here") < F.col("n"), F.col("radius")))
    found = sums.join(dwell(rows, *keys), ["participant_id", *keys, "cluster"])
    columns = ["participant_id", *keys, "rank", "latitude", "longitude", "radius", "proportion", "duration"]
    found = found.withColumn("rank", F.col("cluster").cast("int")).withColumn("duration", F.col("duration").cast("long")).select(*columns)
    if max_dist <= 0:
        return found
    return absorbed(found, max_dist, *keys)


@feature(PRIMARY, "gps")
def significant_locations(gps: DataFrame, method: str = "mode", k_max: int = 10, eps: float = 1e-5, max_clusters: int = -1, min_cluster_size: float = 0.01, max_dist: float = 300) -> DataFrame:
    """Places by mode (rounded places, near ones merged) or k_means (centres of density clusters)."""
    if method == "mode":
        return locations_by_mode(gps, max_clusters=max_clusters, min_cluster_size=min_cluster_size, max_dist=max_dist)
    if method != "k_means":
        raise ValueError("method must be mode or k_means")
    return locations_by_k_means(gps, k_max=k_max, eps=eps)


def dense_points(gps: DataFrame, eps: float = 1e-5, min_samples: int = 5) -> DataFrame:
    """participant_id, latitude, longitude, n: readings (one for each ts) reduced to one point for each density cluster, noise kept."""
    return reduced(one_per_time(gps), eps, min_samples)


#: Square of the distance in degrees from a point to each of centres, and the first nearest of these.
_SQUARES = "transform(centres, c -> pow(latitude - c.latitude, 2) + pow(longitude - c.longitude, 2))"
_NEAREST = f"cast(array_position({_SQUARES}, array_min({_SQUARES})) - 1 AS int)"


def _starts(points: DataFrame, k_max: int) -> DataFrame:
    """participant_id, k and centres of each k up to k_max, the number of points and that of readings less one: the heaviest point, then always the one with the
    largest product of weight and square of the distance to those before (of equals the least latitude, then longitude)."""
    here, order = F.struct("latitude", "longitude"), lambda x: F.struct(x, -F.col("latitude"), -F.col("longitude"))
    seeds = stored(points.groupBy("participant_id").agg(F.count("*").alias("many"), F.sum("n").alias("readings"), F.array(F.max_by(here, order(F.col("n").cast("double")))).alias("centres")), "seeds")
    for k in range(2, k_max + 1):
        open_ = seeds.where((F.col("many") >= k) & (F.col("readings") > k))
        if open_.isEmpty():
            break
        far = F.expr(f"array_min({_SQUARES}) * n")
        found = merged(points, open_, "participant_id").groupBy("participant_id").agg(F.max_by(here, order(far)).alias("next"))
        grown = F.when(F.col("next").isNotNull(), F.concat("centres", F.array("next"))).otherwise(F.col("centres"))
        seeds = stored(merged(seeds, found, "participant_id", "left").select("participant_id", "many", "readings", grown.alias("centres")), "seeds")
    each = seeds.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("centres"))))
    return each.select("participant_id", "k", F.expr("slice(centres, 1, k)").alias("centres"))


def k_means_centres(points: DataFrame, k_max: int = 10, rounds: int = 25) -> DataFrame:
    """participant_id, rank, latitude, longitude, proportion: weighted k-means of each participant's points (latitude, longitude, n),
    with the first k below k_max, and below the number of readings, at which one more centre lowers the cost (sum of squared
    degrees) by less than a hundredth; the last such k where none does, and at least one.

    All k of all participants take a round at once, as sums over points joined to the at most k_max centres of each k, until no
    centre moves or for so many rounds. Centres without points are left out.
    """
    points = stored(points, "points")
    state = stored(_starts(points, k_max - 1).withColumn("moved", F.lit(True)), "centres")
    for _ in range(rounds):
        active = state.where("moved")
        if active.isEmpty():
            break
        own = merged(points, active, "participant_id").select("participant_id", "k", "n", "latitude", "longitude", F.expr(_NEAREST).alias("own"))
        means = own.groupBy("participant_id", "k", "own").agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("latitude", "longitude")))
        maps = means.groupBy("participant_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("own", F.struct("latitude", "longitude")))).alias("means"))
        new = F.expr("CASE WHEN means IS NULL THEN centres ELSE transform(centres, (c, i) -> coalesce(try_element_at(means, i), c)) END")
        both = merged(state, maps, ["participant_id", "k"], "left").select("participant_id", "k", "centres", new.alias("new"))
        moved = F.expr("exists(zip_with(centres, new, (a, b) -> abs(a.latitude - b.latitude) > 1e-12 OR abs(a.longitude - b.longitude) > 1e-12), x -> x)")
        state = stored(both.select("participant_id", "k", F.col("new").alias("centres"), moved.alias("moved")), "centres")
    own = merged(points, state, "participant_id").select("participant_id", "k", "n", F.expr(_NEAREST).alias("own"), F.expr(f"array_min({_SQUARES}) * n").alias("cost"))
    sums = stored(own.groupBy("participant_id", "k", "own").agg(F.sum("n").alias("here"), F.sum("cost").alias("cost")), "sums")
    costs = sums.groupBy("participant_id", "k").agg(F.sum("cost").alias("cost")).withColumn("next", F.lead("cost").over(W.partitionBy("participant_id").orderBy("k")))
    best = costs.groupBy("participant_id").agg(F.coalesce(F.min(F.when(F.col("cost") - F.col("next") < 0.01, F.col("k"))), F.max("k")).alias("k"))
    person = W.partitionBy("participant_id")
    shares = merged(merged(sums, best, ["participant_id", "k"]), state, ["participant_id", "k"]).select("participant_id", "own", F.expr("centres[own]").alias("c"), (F.col("here") / F.sum("here").over(person)).alias("proportion"))
    rank = (F.row_number().over(person.orderBy(F.desc("proportion"), "own")) - 1).cast("int")
    return shares.select("participant_id", rank.alias("rank"), "c.latitude", "c.longitude", "proportion")


def locations_by_k_means(gps: DataFrame, k_max: int = 10, eps: float = 1e-5, rounds: int = 25) -> DataFrame:
    """participant_id, rank, latitude, longitude, radius, proportion, duration: weighted k-means of each participant's reduced points
    (k_means_centres), and of all its readings those nearest to each centre: their mean planar distance to it in metres, their share
    and their dwell. Ranked by share, then latitude and longitude; centres without readings are left out, near ones are not merged.

    The start is fixed (farthest points first), so that results repeat.
    """
    c = stored(k_means_centres(dense_points(gps, eps), k_max, rounds), "means")
    centres = c.groupBy("participant_id").agg(F.array_sort(F.collect_list(F.struct("rank", "latitude", "longitude"))).alias("centres"))  # k_max at most
    known = gps.where("latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)")
    rows = merged(known.select("participant_id", "ts", "seq", "latitude", "longitude"), centres, "participant_id").withColumn("cluster", F.expr(_NEAREST)).withColumn("c", F.expr("centres[cluster]")).drop("centres")
    off = planar_km(F.col("c.latitude"), F.col("c.longitude"), F.col("latitude"), F.col("longitude")) * 1000
    sums = rows.groupBy("participant_id", "cluster").agg(F.first("c").alias("c"), F.avg(off).alias("radius"), F.count("*").alias("here"))
    person = W.partitionBy("participant_id")
    found = sums.withColumn("proportion", F.col("here") / F.sum("here").over(person)).withColumn("rank", (F.row_number().over(person.orderBy(F.desc("here"), "c.latitude", "c.longitude")) - 1).cast("int"))
    found = merged(found, dwell(rows.drop("c")), ["participant_id", "cluster"])
    return found.select("participant_id", "rank", "c.latitude", "c.longitude", "radius", "proportion", F.col("duration").cast("long").alias("duration"))


@feature(PRIMARY, "survey", "questions", "value_maps")
def survey_scores(survey: DataFrame, questions: DataFrame, value_maps: DataFrame, return_ind_ques: bool = False) -> DataFrame:
    """participant_id, start, end, category, question, score of each answered survey and category.

    questions: item, category, scoring (value, raw, boolean, or the name of a map), map_to (an alias, or null).
    value_maps: map, answer, points. Questions that are not listed do not count, and an answer without a score neither. A survey's
    total has its category as question; with return_ind_ques each question has a row too, the last of repeated answers. Questions and maps
    go to all tasks, as answers to one question are too many for one.
    """
    alias = questions.select(F.col("item").alias("map_to"), F.col("scoring").alias("alias_scoring"))
    known = questions.join(alias, "map_to", "left").select("item", "category", F.coalesce("alias_scoring", "scoring").alias("scoring"))
    ends = survey.groupBy("participant_id", "event", "ts", "survey").agg((F.col("ts") + F.sum(F.coalesce("duration", F.lit(0)))).alias("end"))
    rows = survey.where("value IS NOT NULL AND item IS NOT NULL").join(F.broadcast(known), "item")
    maps = value_maps.select(F.col("map").alias("scoring"), F.col("answer").alias("value"), F.col("points").cast("double").alias("points"))
    rows = rows.join(F.broadcast(maps), ["scoring", "value"], "left")
    number = F.expr("try_cast(value AS double)")
    score = F.when(F.col("scoring") == "value", F.expr("CAST(try_cast(value AS int) AS double)")).when(F.col("scoring") == "raw", number).when(F.col("scoring") == "boolean", F.when(F.col("value") == "Yes", 1.0).otherwise(0.0)).otherwise(F.col("points"))
    rows = rows.withColumn("score", score).where("score IS NOT NULL")
    keys = ["participant_id", "event", "ts", "survey"]
    total = rows.groupBy(*keys, "category").agg(F.sum("score").alias("score")).withColumn("question", F.col("category"))
    if return_ind_ques:
        each = rows.groupBy(*keys, "category", F.col("item").alias("question")).agg(F.max_by("score", "position").alias("score"))
        total = total.unionByName(each)
    return total.join(ends, keys).select("participant_id", F.col("ts").alias("start"), "end", "category", "question", "score")


def _levels(games: DataFrame) -> DataFrame:
    return games.select("participant_id", F.col("ts").alias("start"), F.col("seq").alias("event"), F.col("duration").alias("whole"), F.explode("temporal_slices").alias("s")).select("participant_id", "start", "event", "whole", "s.*")


_PLAY = ["participant_id", "start", "event", "level"]


def _truth(column: str) -> Column:
    text = F.lower(F.col(column).cast("string"))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


@feature(PRIMARY, "games")
def game_level_scores(games: DataFrame, name_of_game: str = "jewels_a") -> DataFrame:
    """Scores of each level of each game played, by the game's own rule: games are the events of that game.

    Most games: mean tap time over slices that took time, and the share of right ones (status, or type in games without it);
    jewels also the number collected. pop_the_bubbles: right answers to go and no-go items. balloon_risk: pumps, 0 where it burst.
    The last two leave out slices with any null.
    """
    rows = _levels(games)
    if name_of_game == "pop_the_bubbles":
        rows = rows.dropna()
        right, stop = F.when(_truth("type"), 1.0).otherwise(0.0), F.col("value").contains("no-go")
        out = rows.groupBy(*_PLAY).agg((F.first("start") + F.first("whole")).alias("end"), F.avg(F.when(~stop, right)).alias("avg_go_perc_correct"), F.avg(F.when(stop, right)).alias("avg_NO_go_perc_correct"))
    elif name_of_game == "balloon_risk":
        rows = rows.dropna()
        burst = F.max(F.when(~_truth("type") | ~_truth("status"), 1).otherwise(0)) == 1
        out = rows.groupBy(*_PLAY).agg((F.first("start") + F.sum("duration")).alias("end"), F.when(burst, 0).otherwise(F.count("*")).alias("avg_pumps"))
    else:
        right = F.coalesce(F.col("status"), _truth("type"))
        extra = [F.sum(F.when(right, 1).otherwise(0)).alias("jewels_collected")] if name_of_game in ("jewels_a", "jewels_b") else []
        out = rows.groupBy(*_PLAY).agg((F.first("start") + F.sum("duration")).alias("end"), F.avg(F.when(F.col("duration") > 0, F.col("duration"))).alias("avg_tap_time"), F.avg(right.cast("double")).alias("perc_correct"), *extra)
    return out.drop("event")
