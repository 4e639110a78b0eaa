"""Reports over many participants, as frames; drawing them is left to others."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import benjamini_hochberg, correlation_p_value, t_test
from tidemark.operators.series import data_quality
from tidemark.plans.grid import DAY, Grid

HOUR = 3_600_000
GAMES = ("lamp.jewels_a", "lamp.jewels_b", "lamp.balloon_risk", "lamp.cats_and_dogs", "lamp.pop_the_bubbles", "lamp.spatial_span", "lamp.trails_b", "lamp.digit_span", "lamp.dcog", "lamp.funny_memory")


def members(researcher: str, participants: DataFrame, studies: DataFrame) -> DataFrame:
    """participant_id and study name of a researcher's participants."""
    return participants.join(studies.where(F.col("researcher_id") == researcher), "study_id").select("participant_id", "study_id", F.col("name").alias("study_name"))


def sample_window(now: int, days: int, offset: int = 0, midnight: bool = False) -> tuple[int, int]:
    """Start and end (ms) of days days that end offset days before now, or at the midnight before that."""
    end = now - offset * DAY
    end -= end % DAY if midnight else 0
    return end - days * DAY, end


def quality_tags(device_state: DataFrame, gps: DataFrame, accelerometer: DataFrame, people: DataFrame, end: int, days: int = 7) -> DataFrame:
    """A row for each participant: screen days and last time, gps and accelerometer quality by day, and their labels.

    gps and acc: mean quality (1 h bins) over days that have any; *_missing_days: the days without. Labels: good above 0.8, okay
    above 0.5, else bad, with _missing where days lack; missing where all do. Screen: good with all days, bad with any event ever.
    """
    start = end - days * DAY
    grid = Grid(start, end, DAY)
    every = device_state.groupBy("participant_id").agg(F.max("ts").alias("last_screen"))
    screen = grid.hits(device_state, half_open=True).groupBy("participant_id").agg(F.count_distinct("window").alias("screen_days"))
    out = people.select("participant_id").distinct().join(screen, "participant_id", "left").join(every, "participant_id", "left").withColumn("screen_days", F.coalesce("screen_days", F.lit(0)))
    out = out.withColumn("screen_quality", F.when(F.col("screen_days") == days, "good").when(F.col("last_screen").isNotNull(), "bad").otherwise("missing"))
    for name, rows, kind in (("gps", gps, "gps"), ("acc", accelerometer, "accelerometer")):
        daily = data_quality(rows, people, grid, kind, HOUR)
        some = F.avg(F.when(F.col("value") != 0, F.col("value")))
        lacks = F.array_sort(F.collect_list(F.when(F.col("value") == 0, F.col("timestamp"))))
        sums = daily.groupBy("participant_id").agg(some.alias(name), lacks.alias(f"{name}_missing_days"))
        out = out.join(sums, "participant_id", "left")
        label = F.when(F.col(name) > 0.8, "good").when(F.col(name) > 0.5, "okay").otherwise("bad")
        tag = F.when(F.size(f"{name}_missing_days") == 0, label).when(F.col(name) > 0, F.concat(label, F.lit("_missing"))).otherwise("missing")
        out = out.withColumn(f"{name}_quality", tag)
    return out


def long_tags(tags: DataFrame) -> DataFrame:
    """participant_id, type, quality: quality_tags turned into rows."""
    return tags.unpivot("participant_id", ["screen_quality", "acc_quality", "gps_quality"], "type", "quality")


def activity_buckets(named: DataFrame, people: DataFrame) -> DataFrame:
    """participant_id and counts of events by kind of activity, from events with their activity's spec (second part of its name)."""
    games = [g.partition(".")[2] for g in GAMES]
    kind = F.when(F.col("spec").isin("survey", "tips", "breathe", "group"), F.col("spec")).when(F.col("spec").isin(games), "games").otherwise("other")
    counts = named.groupBy("participant_id").agg(*(F.sum(F.when(kind == k, 1).otherwise(0)).alias(k) for k in ("survey", "tips", "breathe", "group", "games", "other")))
    return people.select("participant_id").distinct().join(counts, "participant_id", "left").na.fill(0)


def passive_means(steps: DataFrame, screen: DataFrame, home: DataFrame, tags: DataFrame) -> DataFrame:
    """Means of daily steps, screen hours and home hours; 0 without data or where the quality tag is not good or okay."""
    out = tags.select("participant_id", "screen_quality", "gps_quality")
    for name, frame, gate, scale in (("steps", steps, None, 1), ("screen_hours", screen, "screen_quality", HOUR), ("home_hours", home, "gps_quality", HOUR)):
        out = out.join(frame.groupBy("participant_id").agg((F.avg("value") / scale).alias(name)), "participant_id", "left")
        value = F.coalesce(F.col(name), F.lit(0.0))
        out = out.withColumn(name, value if gate is None else F.when(F.col(gate).startswith("good") | F.col(gate).startswith("okay"), value).otherwise(0.0))
    return out.drop("screen_quality", "gps_quality")


def survey_count(named: DataFrame, name: str) -> DataFrame:
    return named.where(F.col("name") == name).groupBy("participant_id").agg(F.count("*").alias("n"))


def completion(named: DataFrame, targets: DataFrame, now: int) -> DataFrame:
    """participant_id, done, target and completion. targets: participant_id, activity_name, count, time_interval (ms back from now).

    An activity done more often than asked for counts as often as asked for.
    """
    own = targets.join(named.select("participant_id", F.col("name").alias("activity_name"), "ts"), ["participant_id", "activity_name"], "left")
    hit = (F.col("ts") >= now - F.col("time_interval")) & (F.col("ts") <= now)
    each = own.groupBy("participant_id", "activity_name", "count", "time_interval").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("n"))
    sums = each.groupBy("participant_id").agg(F.sum(F.least("n", "count")).alias("done"), F.sum("count").alias("target"))
    return sums.withColumn("completion", F.try_divide("done", "target"))


def hourly_counts(events: DataFrame, start: int, end: int, target_hz: float = 1.0, stored: DataFrame | None = None) -> DataFrame:
    """participant_id, timestamp (hour), count and share of the target of hours with events; hours that stored already has, other than
    with 0, are kept and not counted again."""
    hour = F.col("ts") - F.pmod(F.col("ts"), F.lit(HOUR))
    rows = events.where((F.col("ts") >= start) & (F.col("ts") < end)).withColumn("timestamp", hour)
    if stored is not None:
        rows = rows.join(stored.where("count > 0").select("participant_id", "timestamp"), ["participant_id", "timestamp"], "left_anti")
    counts = rows.groupBy("participant_id", "timestamp").agg(F.count("*").alias("count"))
    if stored is not None:
        counts = counts.unionByName(stored.where("count > 0").select("participant_id", "timestamp", "count"))
    return counts.withColumn("share", F.col("count") / (target_hz * 3600))


def active_counts(named: DataFrame, names: Sequence[str] | None = None, exclude: Sequence[str] = (), groups: bool = False) -> DataFrame:
    """participant_id, day (ms), activity, name, count: one row for each day and activity, for chosen names, specs or ids.

    Activities of the spec group go, unless asked for; busy says that a participant has a day of nine events or more.
    """
    rows = named if names is None else named.where(F.col("name").isin(list(names)) | F.col("spec").isin(list(names)) | F.col("activity").isin(list(names)))
    rows = rows if groups else rows.where(F.coalesce(F.col("spec") != "group", F.lit(True)))
    rows = rows.withColumn("day", F.col("ts") - F.pmod(F.col("ts"), F.lit(DAY)))
    counts = rows.groupBy("participant_id", "day", "activity", "name").agg(F.count("*").alias("count"))
    counts = counts.where(~F.coalesce(F.col("name").isin(list(exclude)), F.lit(False))) if exclude else counts
    daily = counts.withColumn("of_day", F.sum("count").over(W.partitionBy("participant_id", "day")))
    return daily.withColumn("busy", F.max("of_day").over(W.partitionBy("participant_id")) >= 9).drop("of_day")


def short_name(name: Column) -> Column:
    """First letter in upper case and the next letters without vowels and spaces: three in all."""
    return F.substring(F.concat(F.upper(F.substring(name, 1, 1)), F.regexp_replace(F.substring(name, 2, 1_000_000), "[aeiou ]+", "")), 1, 3)


def tertiles(series: DataFrame) -> DataFrame:
    """Each participant's values as Zero, Low, Medium or High, by thirds of the range between least and largest."""
    own = W.partitionBy("participant_id")
    low, high = F.min("value").over(own), F.max("value").over(own)
    rows = series.withColumn("low", (low + high) / 2 - (high - low) / 6).withColumn("high", (low + high) / 2 + (high - low) / 6)
    v = F.col("value")
    name = F.when(v.isNull(), None).when(v == 0, "Zero").when(v > F.col("high"), "High").when(v < F.col("low"), "Low").otherwise("Medium")
    code = F.when(v.isNull(), None).when(v == 0, 0).when(v > F.col("high"), 3).when(v < F.col("low"), 1).otherwise(2)
    return rows.withColumn("tertile", name).withColumn("code", code).drop("low", "high")


def survey_table(scores: DataFrame, questions: Sequence[str] | None = None) -> DataFrame:
    """A row for each participant and time, a column for each question, the mean of repeated answers. Name the questions where they
    are known: else they are read first."""
    return scores.groupBy("participant_id", F.col("start").alias("timestamp")).pivot("question", list(questions) if questions else None).agg(F.avg("score"))


def mean_and_variance(series: dict[str, DataFrame], first: DataFrame, since: int, until: int, passive: Sequence[str] = ()) -> DataFrame:
    """participant_id, and mean and sample variance of each feature, from since to until ms after the participant's first event.

    first: participant_id, first. Passive features count where above 0.
    """
    out = first.select("participant_id")
    for name, frame in series.items():
        rows = frame.join(first, "participant_id").where((F.col("timestamp") >= F.col("first") + since) & (F.col("timestamp") < F.col("first") + until))
        rows = rows.where("value > 0") if name in passive else rows
        out = out.join(rows.groupBy("participant_id").agg(F.avg("value").alias(f"{name}_mean"), F.var_samp("value").alias(f"{name}_var")), "participant_id", "left")
    return out


def correlations(table: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> list[dict]:
    """r, p, adjusted p (Benjamini-Hochberg over all pairs) and significance of each pair of columns, over rows that have all of them.

    Fewer than three rows, or a column that does not vary: r 0 and p 1. One row of sums comes to the driver.
    """
    rows = table.select(*columns).dropna()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = rows.agg(F.count("*").alias("n"), *(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs))).first()
    found = []
    for i, (a, b) in enumerate(pairs):
        r = got[f"r{i}"]
        usable = r is not None and not math.isnan(r) and got["n"] >= 3
        found.append({"a": a, "b": b, "r": r if usable else 0.0, "p": correlation_p_value(r, got["n"]) if usable else 1.0})
    for x, p in zip(found, benjamini_hochberg([x["p"] for x in found]), strict=True):
        x |= {"adjusted_p": p, "significant": p < alpha}
    return found


def improvement(table: DataFrame, value: str, amount: float, min_records: int = 2, min_start: float = 0, min_time: int = 0) -> DataFrame:
    """participant_id, change (last row's value less the first's, by timestamp) and whether it is an improvement by more than amount.

    With amount between 0 and 1 the share of the last value has to be larger too. Null for participants with too few records, too low
    a last value, or first and last times (first less last) too near each other.
    """
    order = F.struct("timestamp")
    sums = table.groupBy("participant_id").agg(F.count("*").alias("n"), F.min_by(value, order).alias("a"), F.max_by(value, order).alias("z"), (F.min("timestamp") - F.max("timestamp")).alias("gap"))
    fit = (F.col("n") >= min_records) & (F.col("z") >= min_start) & (F.col("gap") >= min_time)
    change = F.col("z") - F.col("a")
    better = change > amount
    if 0 < amount < 1:
        better = better & F.coalesce(F.try_divide(change, F.col("z")) > amount, F.lit(False))
    return sums.select("participant_id", F.when(fit, better).alias("improved"), F.when(fit, change).alias("change"))


def merged_by_time(frames: dict[str, DataFrame]) -> DataFrame:
    """participant_id, timestamp and one value column for each frame; every time that any of them has."""
    named = [f.select("participant_id", "timestamp", F.col("value").alias(k)) for k, f in frames.items()]
    return reduce(lambda a, b: a.join(b, ["participant_id", "timestamp"], "full"), named)


def group_test(table: DataFrame, value: str, group: str) -> dict:
    """Independent t test of value between the two groups of a boolean column."""
    got = {r["g"]: r for r in table.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).collect()}
    if len(got) < 2 or min(r["n"] for r in got.values()) < 2:
        return {"t": None, "p": None}
    a, b = got[True], got[False]
    t, p = t_test(a["n"], a["m"], a["v"], b["n"], b["m"], b["v"])
    return {"t": t, "p": p}


def person_fold(folds: int, person: str = "participant_id", seed: int = 7) -> Column:
    """A fold from 0 for each person, by a hash of the id: all rows of a person are in one fold."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(person).cast("string")), F.lit(folds)).cast("int")


def improvement_model(table: DataFrame, features: Sequence[str], label: str, folds: int = 3, seed: int = 7, penalties: Sequence[float] = (0.01, 0.1, 1.0), ratio: float = 0.5, person: str | None = None):
    """Elastic-net logistic regression on standardised features, its strength chosen by cross-validated area under the curve;
    both classes weigh the same. person: a column whose rows stay in one fold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = table.select(*features, F.col(label).cast("double").alias("label"), *([person_fold(folds, person, seed).alias("fold")] if person else [])).dropna()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, total / (2 * counts.get(1.0, 1))).otherwise(total / (2 * counts.get(0.0, 1))))
    model = LogisticRegression(elasticNetParam=ratio, weightCol="weight", featuresCol="scaled")
    steps = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), model])
    grid = ParamGridBuilder().addGrid(model.regParam, list(penalties)).build()
    own = {"foldCol": "fold"} if person else {}
    return CrossValidator(estimator=steps, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"), numFolds=folds, seed=seed, **own).fit(rows)


def _descent(gram: np.ndarray, moment: np.ndarray, penalty: float, ratio: float, begin: np.ndarray) -> np.ndarray:
    """Elastic-net coefficients for correlations gram of the features and moment with the label, by coordinate descent."""
    b = begin.copy()
    for _ in range(10_000):
        before = b.copy()
        for i in range(len(b)):
            left = moment[i] - gram[i] @ b + gram[i, i] * b[i]
            b[i] = np.sign(left) * max(0.0, abs(left) - penalty * ratio) / (gram[i, i] + penalty * (1 - ratio))
        if np.abs(b - before).max() < 1e-13:
            break
    return b


def elastic_net_path(table: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float], ratio: float = 0.5, folds: int = 3, person: str = "participant_id", seed: int = 7) -> list[dict]:
    """penalty, r2 (of rows left out, all folds together) and coefficients by feature for each penalty, of a linear model of a numeric or
    boolean label; features and label are standardised over all rows, so coefficients compare. Persons' rows stay in one fold.

    One pass over the rows adds up products by fold, a square of the number of features for each; every model is fitted to sums.
    Rows with a null or NaN are left out. A constant feature has coefficient 0; with a constant label, or less than two rows, there is no path.
    """
    names = [*features, "y__"]
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features] + [F.nanvl(F.col(label).cast("double"), F.lit(None).cast("double"))]
    rows = table.select(person_fold(folds, person, seed).alias("fold__"), *(c.alias(n) for c, n in zip(clean, names, strict=True))).dropna(subset=names)
    middle = rows.agg(*(F.avg(c).alias(c) for c in names)).first()  # sums of differences from the means keep their digits
    if middle[0] is None:
        return []
    off = [F.col(c) - middle[c] for c in names]
    k = len(names)
    sums = [F.sum(off[i] * off[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    each = rows.groupBy("fold__").agg(F.count("*").alias("n"), *(F.sum(off[i]).alias(f"m{i}") for i in range(k)), *sums).collect()  # a row for each fold

    def whole(parts: list) -> tuple[float, np.ndarray, np.ndarray]:
        n = sum(r["n"] for r in parts)
        m = np.array([sum(r[f"m{i}"] for r in parts) for i in range(k)])
        s = np.array([[sum(r[f"s{min(i, j)}_{max(i, j)}"] for r in parts) for j in range(k)] for i in range(k)])
        return n, m, s

    n, m, s = whole(each)
    scale = np.sqrt(np.maximum(np.diag(s) / n - (m / n) ** 2, 0))
    if n < 2 or scale[-1] == 0:
        return []
    scale[scale == 0] = 1.0

    def standard(n: float, m: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (s / n - np.outer(m, m) / n**2) / np.outer(scale, scale)

    out, begin = [], np.zeros(k - 1)
    for penalty in sorted(penalties, reverse=True):
        c = standard(n, m, s)
        begin = _descent(c[:-1, :-1], c[:-1, -1], penalty, ratio, begin)
        missed = total = 0.0
        for left in each if len(each) > 1 else []:
            n1, m1, s1 = whole([r for r in each if r["fold__"] != left["fold__"]])
            c1 = standard(n1, m1, s1)
            b = np.append(_descent(c1[:-1, :-1], c1[:-1, -1], penalty, ratio, begin), -1.0)
            n2, m2, s2 = whole([left])
            centre = m1 / n1
            around = (s2 - np.outer(m2, centre) - np.outer(centre, m2) + n2 * np.outer(centre, centre)) / np.outer(scale, scale)
            missed += float(b @ around @ b)
            total += float(around[-1, -1])
        out.append({"penalty": penalty, "r2": 1 - missed / total if total else None, "coefficients": dict(zip(features, begin.tolist(), strict=True))})
    return out[::-1]


def os_version(analytics: DataFrame) -> DataFrame:
    """participant_id and the commonest pair of device type and user agent of its logins, the one seen first of equals; agent parts by
    semicolons."""
    rows = analytics.where("action = 'login' OR type = 'login'").withColumn("device", F.concat_ws("; ", "device_type", "user_agent"))
    counts = rows.groupBy("participant_id", "device").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    best = counts.groupBy("participant_id").agg(F.max_by("device", F.struct("n", (-F.col("first")).alias("f"))).alias("device"))
    parts = F.split("device", "; ")
    return best.withColumn("parts", F.when(F.size(parts) >= 4, parts))


def due_modules(participants: DataFrame, modules: DataFrame, now: int) -> DataFrame:
    """participant_id and module of modules (phase, module, start, end in ms) whose phase is the participant's (participant_id, phase,
    enrolled) and whose time has come: start < elapsed <= end."""
    elapsed = F.lit(now) - F.col("enrolled")
    return participants.join(modules, "phase").where((elapsed > F.col("start")) & (elapsed <= F.col("end"))).select("participant_id", "module")
