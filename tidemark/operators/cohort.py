"""Cohort operators on daily frames: participant_id, day (whole number) and a column for each domain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.intervals import runs


def _days():
    return W.partitionBy("participant_id").orderBy("day")


#: Weights of the three days before, the day itself and the three after.
WEIGHTS = (0.05, 0.2, 0.4, 1.5, 0.4, 0.2, 0.05)


def daily_means(rows: DataFrame, domains: Sequence[str]) -> DataFrame:
    """participant_id, day and the mean of each domain over rows (participant_id, day, seq, domains).

    Values are added one by one in order of arrival, seq: sums of doubles differ in their last place by order, and a mean that meets a bound, as
    1 of the labels, would fall on either side of it by the partitions that its rows came from. Rows without seq come first; seq may repeat.
    """
    key = ["participant_id", "day"]
    order = W.partitionBy(*key).orderBy("seq")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    sums = rows.select(*key, F.row_number().over(order).alias("__at"), *(F.sum(F.col(c).cast("double")).over(so_far).alias(c) for c in domains), *(F.count(c).over(so_far).alias(f"{c}__n") for c in domains))
    last = sums.groupBy(*key).agg(F.max_by(F.struct(*domains, *(f"{c}__n" for c in domains)), "__at").alias("s"))
    return last.select(*key, *(F.try_divide(f"s.{c}", f"s.{c}__n").alias(c) for c in domains))


def _each(frame: DataFrame, domains: Sequence[str] | None) -> list[str]:
    return [c for c in frame.columns if c not in ("participant_id", "day", "Date", "id")] if domains is None else list(domains)


def imputed(daily: DataFrame, domains: Sequence[str] | None = None, last_row: int | None = 90) -> DataFrame:
    """Every value replaced by the weighted mean of the seven rows around it that have one. Rows from last_row on (counted from 0)
    are not looked at, as kept results have it; None looks at all."""
    rows = daily.withColumn("__at", F.row_number().over(_days()) - 1)
    out = {}
    for c in _each(daily, domains):
        total, weight = F.lit(0.0), F.lit(0.0)
        for k, w in zip(range(-3, 4), WEIGHTS, strict=True):
            v = F.lead(c, k).over(_days()) if k > 0 else F.lag(c, -k).over(_days())
            if last_row is not None:
                v = F.when(F.col("__at") + k < last_row, v)
            total = total + F.coalesce(v * w, F.lit(0.0))
            weight = weight + F.when(v.isNotNull(), w).otherwise(0.0)
        out[c] = F.try_divide(total, weight)
    return rows.withColumns(out).drop("__at")


def normalized(daily: DataFrame, domains: Sequence[str] | None = None, means: dict[str, float] | None = None, deviations: dict[str, float] | None = None) -> DataFrame:
    """z-scores by each participant's own mean and sample deviation, or by those given."""
    own = W.partitionBy("participant_id")

    def z(c: str) -> Column:
        mean = F.lit(means[c]) if means and c in means else F.avg(c).over(own)
        dev = F.lit(deviations[c]) if deviations and c in deviations else F.stddev_samp(c).over(own)
        return F.try_divide(F.col(c) - mean, dev)

    return daily.withColumns({c: z(c) for c in _each(daily, domains)})


def cohort_statistics(daily: DataFrame, domains: Sequence[str] | None = None) -> DataFrame:
    """domain, mean and population deviation over the cohort; nulls and NaN do not count."""
    names = _each(daily, domains)
    long = daily.select(F.explode(F.array(*(F.struct(F.lit(c).alias("domain"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v")) for c in names))).alias("x")).select("x.*")
    return long.groupBy("domain").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("stdev"))


def cohort_normalized(daily: DataFrame, domains: Sequence[str] | None = None) -> DataFrame:
    """z-scores by the cohort's mean and population deviation, which the driver reads: a row for each domain."""
    found = {r["domain"]: r for r in cohort_statistics(daily, domains).collect()}
    return normalized(daily, domains, {c: r["mean"] for c, r in found.items()}, {c: r["stdev"] for c, r in found.items()})


def _label(c: str) -> Column:
    return F.when(F.col(c) < 1.0, "stable").otherwise("elevated")


def transitions(daily: DataFrame, domains: Sequence[str] | None = None, joint_size: int = 1) -> DataFrame:
    """participant_id, domains, from, to, n: steps between labels of rows with values, at most 3 days apart.

    Labels of joint_size domains together are joined by commas; pairs of labels that do not occur have no row.
    """
    every = []
    for names in combinations(_each(daily, domains), joint_size):
        rows = daily.dropna(subset=list(names)).select("participant_id", "day", F.concat_ws(",", *(_label(c) for c in names)).alias("from"))
        rows = rows.withColumn("to", F.lead("from").over(_days())).withColumn("gap", F.lead("day").over(_days()) - F.col("day")).where("gap <= 3")
        every.append(rows.groupBy("participant_id", "from", "to").agg(F.count("*").alias("n")).withColumn("domains", F.lit(",".join(names))))
    return reduce(DataFrame.unionByName, every).select("participant_id", "domains", "from", "to", "n")


def transition_probabilities(daily: DataFrame, domains: Sequence[str] | None = None, joint_size: int = 1) -> DataFrame:
    """domains, from, to, n and the share of n among the steps from the same label, over the cohort, for all pairs of labels; null
    where a label has no step."""
    counts = transitions(daily, domains, joint_size).groupBy("domains", "from", "to").agg(F.sum("n").alias("n"))
    one = ["stable", "elevated"]
    labels = reduce(lambda a, _: [f"{x},{y}" for x in a for y in one], range(joint_size - 1), one)
    pairs = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a in labels for b in labels))
    spine = counts.select("domains").distinct().withColumn("p", F.explode(pairs)).select("domains", "p.*")
    full = spine.join(counts, ["domains", "from", "to"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("probability", F.try_divide("n", F.sum("n").over(W.partitionBy("domains", "from"))))


def domain_bouts(daily: DataFrame, domain: str) -> DataFrame:
    """participant_id, state, start, length, ended of the runs of one state of a domain.

    Rows at most 6 days apart in one state are one run. A run ends with the next row, or 3 days after its last row when the next is
    more than 8 days on, which counts as an end; a run of one row that nothing follows lasts 3 days.
    """
    rows = daily.where(F.col(domain).isNotNull()).select("participant_id", "day", _label(domain).alias("state"))
    new = (F.lag("state").over(_days()) != F.col("state")) | (F.col("day") - F.lag("day").over(_days()) > 6)
    rows = rows.withColumn("run", runs(F.coalesce(new, F.lit(True)), _days())).withColumn("next", F.lead("day").over(_days()))
    bouts = rows.groupBy("participant_id", "run").agg(F.first("state").alias("state"), F.min("day").alias("start"), F.max("day").alias("last"), F.count("*").alias("n"), F.max_by(F.struct("next"), "day").alias("after"))
    after = F.col("after.next")
    stop = F.when(after.isNull(), F.when(F.col("n") == 1, F.col("last") + 3).otherwise(F.col("last"))).when(after - F.col("last") > 8, F.col("last") + 3).otherwise(after)
    ended = F.coalesce(after - F.col("last") > 8, F.lit(False))
    return bouts.select("participant_id", "state", "start", (stop - F.col("start")).cast("double").alias("length"), ended.alias("ended"))


def binned(daily: DataFrame, domains: Sequence[str] | None = None, days: int = 3) -> DataFrame:
    """Means of each run of so many days: our own definition, as there is none to follow."""
    key = F.floor(F.col("day") / days).alias("bin")
    return daily.groupBy("participant_id", key).agg(*(F.avg(c).alias(c) for c in _each(daily, domains)))


def imputed_bins(bins: DataFrame, domains: Sequence[str] | None = None) -> DataFrame:
    """Every bin from a participant's first to the last one, with each missing value replaced by the nearest one before it: our own
    definition, as there is none to follow. Values before the first known one stay null."""
    names = [c for c in _each(bins, domains) if c != "bin"]
    spine = bins.groupBy("participant_id").agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    before = W.partitionBy("participant_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return spine.join(bins, ["participant_id", "bin"], "left").withColumns({c: F.last(c, ignorenulls=True).over(before) for c in names})


def age_statistics(participants: DataFrame) -> DataFrame:
    """mean_age and std_age (of the population), without those whose age is not known."""
    return participants.agg(F.avg("age").alias("mean_age"), F.stddev_pop("age").alias("std_age"))


def local_time(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """rows with local, the wall time in each participant's zone (participant_id, zone); UTC where none is known."""
    return rows.join(zones, "participant_id", "left").withColumn("local", F.from_utc_timestamp(F.timestamp_millis("ts"), F.coalesce("zone", F.lit("UTC")))).drop("zone")
