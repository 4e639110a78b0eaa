"""Secondary features: one value for each participant and window. Null means that a window had nothing to judge from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.intervals import locations_by_mode, one_per_time, runs
from tidemark.operators.intervals import screen_active as _screen_active
from tidemark.operators.intervals import trips as _trips
from tidemark.plans.grid import Grid
from tidemark.plans.registry import SECONDARY, feature

#: Categories of app use by name.
APP_CATEGORIES = {
    "books": "SRDeviceUsageCategoryBooks",
    "business": "SRDeviceUsageCategoryBusiness",
    "catalogs": "SRDeviceUsageCategoryCatalogs",
    "developer": "SRDeviceUsageCategoryDeveloperTools",
    "education": "SRDeviceUsageCategoryEducation",
    "entertainment": "SRDeviceUsageCategoryEntertainment",
    "finance": "SRDeviceUsageCategoryFinance",
    "dining": "SRDeviceUsageCategoryFoodAndDrink",
    "games": "SRDeviceUsageCategoryGames",
    "design": "SRDeviceUsageCategoryGraphicsAndDesign",
    "health": "SRDeviceUsageCategoryHealthAndFitness",
    "kids": "SRDeviceUsageCategoryKids",
    "lifestyle": "SRDeviceUsageCategoryLifestyle",
    "medical": "SRDeviceUsageCategoryMedical",
    "misc": "SRDeviceUsageCategoryMiscellaneous",
    "music": "SRDeviceUsageCategoryMusic",
    "navigation": "SRDeviceUsageCategoryNavigation",
    "news": "SRDeviceUsageCategoryNews",
    "applenews": "SRDeviceUsageCategoryNewsstand",
    "photo_video": "SRDeviceUsageCategoryPhotoAndVideo",
    "productivity": "SRDeviceUsageCategoryProductivity",
    "reference": "SRDeviceUsageCategoryReference",
    "shopping": "SRDeviceUsageCategoryShopping",
    "social": "SRDeviceUsageCategorySocialNetworking",
    "sports": "SRDeviceUsageCategorySports",
    "stickers": "SRDeviceUsageCategoryStickers",
    "travel": "SRDeviceUsageCategoryTravel",
    "utilities": "SRDeviceUsageCategoryUtilities",
    "weather": "SRDeviceUsageCategoryWeather",
}
#: Fixed value: windows that end by then hold app use in seconds.
APP_MS_SINCE = 1677088485000

#: App versions from before steps were counted anew.
OLD_STEP_VERSIONS = (
    "1.0", "1.1", "1.1.1", "1.1.2", "1.1.3", "2021.1.20", "2021.1.21", "2021.6.28", "2021.6.29", "2021.7.6", "2021.8.30", "2021.10.10",
    "2021.10.20", "2022.1.13", "2022.2.28", "2022.3.30", "2022.4.13", "2022.4.23", "2.22.5.9", "2022.6.1", "2022.6.9", "2022.6.16",
    "2022.6.20", "2022.6.29", "2022.7.13", "2022.8.4", "2022.8.9", "2022.8.24", "2022.10.6", "2022.10.26", "2022.10.27", "2023.1.20",
    "2023.2.1", "2023.2.23", "2023.4.4", "2023.4.11", "2023.4.19",
)


def _sum(value: Column | str, where: Column | None = None) -> Column:
    """Sum over a window's rows, 0 where none has the value."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(value if where is None else F.when(where, value)).cast("double"), F.lit(0.0))


def _count(where: Column) -> Column:
    return F.sum(F.when(where, 1).otherwise(0))


@feature(SECONDARY, "device_usage")
def app_time(device_usage: DataFrame, people: DataFrame, grid: Grid, category: str = "all") -> DataFrame:
    """Time in apps of a category, in ms."""
    if category != "all" and category not in APP_CATEGORIES:
        raise ValueError(f"category must be all or one of {list(APP_CATEGORIES)}")
    names = list(APP_CATEGORIES.values()) if category == "all" else [APP_CATEGORIES[category]]
    uses = F.aggregate(F.flatten(F.map_values(F.map_filter("applicationUsageByCategory", lambda k, _: k.isin(names)))), F.lit(0.0), lambda t, u: t + F.coalesce(u["usageTime"], F.lit(0.0)))
    out = grid.series(device_usage.withColumn("used", F.coalesce(uses, F.lit(0.0))), people, _sum("used"))
    return out.withColumn("value", F.when(F.col("timestamp") + grid.resolution <= APP_MS_SINCE, F.col("value") * 1000).otherwise(F.col("value")))


@feature(SECONDARY, "device_state")
def battery_level(device_state: DataFrame, people: DataFrame, grid: Grid) -> DataFrame:
    return grid.series(device_state, people, F.avg("battery_level"))


def _direction(direction: str) -> Column | None:
    """Which calls count; None for a direction that does not exist."""
    return F.lit(True) if direction == "all" else F.col("type") == direction if direction in ("incoming", "outgoing") else None


@feature(SECONDARY, "telephony", "phone_usage")
def call_degree(telephony: DataFrame, phone_usage: DataFrame, people: DataFrame, grid: Grid, sensor: str = "Telephony", call_direction: str = "all") -> DataFrame:
    """Number of different people called or calling."""
    if sensor == "SensorKit":
        return grid.series(phone_usage, people, F.sum("totalUniqueContacts"))
    if (which := _direction(call_direction)) is None:
        raise ValueError("call_direction must be all, incoming or outgoing")
    return grid.series(telephony, people, F.count_distinct(F.when(which, F.col("trace"))))


@feature(SECONDARY, "telephony", "phone_usage")
def call_duration(telephony: DataFrame, phone_usage: DataFrame, people: DataFrame, grid: Grid, sensor: str = "Telephony", call_direction: str = "all", incoming: bool | None = None) -> DataFrame:
    """Seconds of calls. A direction that does not exist gives null; incoming, if given, decides the direction."""
    if sensor == "SensorKit":
        return grid.series(phone_usage, people, _sum("totalPhoneCallDuration"))
    which = _direction(call_direction if incoming is None else "incoming" if incoming else "outgoing")
    return grid.series(telephony, people, F.lit(None).cast("double") if which is None else _sum("duration", which))


@feature(SECONDARY, "telephony", "phone_usage")
def call_number(telephony: DataFrame, phone_usage: DataFrame, people: DataFrame, grid: Grid, sensor: str = "Telephony", call_direction: str = "all", incoming: bool | None = None) -> DataFrame:
    """Number of calls."""
    direction = call_direction if incoming is None else "incoming" if incoming else "outgoing"
    if (which := _direction(direction)) is None:
        raise ValueError("call_direction must be all, incoming or outgoing")
    if sensor == "SensorKit":
        columns = {"incoming": ["totalIncomingCalls"], "outgoing": ["totalOutgoingCalls"], "all": ["totalIncomingCalls", "totalOutgoingCalls"]}[direction]
        return grid.series(phone_usage, people, F.sum(sum(F.coalesce(F.col(c), F.lit(0)) for c in columns)))
    return grid.series(telephony, people, _count(which))


def data_quality(rows: DataFrame, people: DataFrame, grid: Grid, feature: str = "accelerometer", bin_size: int = -1) -> DataFrame:
    """Share of a window's bins that hold an event; 0 without any. Bins are 1 s for accelerometer and 10 min for gps."""
    size = {"accelerometer": 1000, "gps": 600_000}.get(feature) if bin_size == -1 else bin_size
    if feature not in ("accelerometer", "gps"):
        return grid.spine(people).select("participant_id", "timestamp", F.lit(None).cast("double").alias("value"))
    bins = F.count_distinct(F.floor(((F.col("ts") - grid.start) % grid.resolution) / size))
    out = grid.series(rows, people, bins / (grid.resolution / size), half_open=True)
    return out.withColumn("value", F.coalesce("value", F.lit(0.0)))


@feature(SECONDARY, "accelerometer")
def accelerometer_quality(accelerometer: DataFrame, people: DataFrame, grid: Grid, bin_size: int = -1) -> DataFrame:
    return data_quality(accelerometer, people, grid, "accelerometer", bin_size)


@feature(SECONDARY, "gps")
def gps_quality(gps: DataFrame, people: DataFrame, grid: Grid, bin_size: int = -1) -> DataFrame:
    return data_quality(gps, people, grid, "gps", bin_size)


@feature(SECONDARY, "gps")
def entropy(gps: DataFrame, people: DataFrame, grid: Grid, **options) -> DataFrame:
    """Entropy of the shares of a window's significant places."""
    p = F.col("proportion")
    found = locations_by_mode(grid.hits(gps), "window", **options).where((p > 0) & (p <= 1))
    return grid.filled(people, found.groupBy("participant_id", "window").agg((-F.sum(p * F.ln(p))).alias("value")))


@feature(SECONDARY, "gps")
def hometime(gps: DataFrame, people: DataFrame, grid: Grid, **options) -> DataFrame:
    """Time at the window's first place, in ms."""
    found = locations_by_mode(grid.hits(gps), "window", **options).where("rank = 0")
    return grid.filled(people, found.select("participant_id", "window", F.col("duration").alias("value")))


def scored(scores: DataFrame, people: DataFrame, grid: Grid, value: Column) -> DataFrame:
    """Aggregate of interval scores by the window of their start."""
    return grid.series(scores.withColumn("ts", F.col("start")), people, value)


#: Games with a measure of their own; the others have avg_tap_time.
GAME_MEASURES = {"pop_the_bubbles": "avg_NO_go_perc_correct", "balloon_risk": "avg_pumps"}


@feature(SECONDARY, "game_scores")
def game_results(game_scores: DataFrame, people: DataFrame, grid: Grid, name_of_game: str = "jewels_a") -> DataFrame:
    """Mean of the game's measure over all its levels."""
    return scored(game_scores, people, grid, F.avg(GAME_MEASURES.get(name_of_game, "avg_tap_time")))


@feature(SECONDARY, "scores")
def survey_results(scores: DataFrame, people: DataFrame, grid: Grid, question_or_category: str) -> DataFrame:
    """Mean score of a question or category; NaN where there are scores but none of it."""
    own = F.avg(F.when(F.col("question") == question_or_category, F.col("score")))
    return scored(scores, people, grid, F.coalesce(own, F.lit(float("nan"))))


@feature(SECONDARY, "sleep")
def healthkit_sleep_duration(sleep: DataFrame, people: DataFrame, grid: Grid, duration_type: str = "in_bed") -> DataFrame:
    """Sum of durations of a kind of sleep, of readings at different times; null for another kind."""
    if duration_type not in ("in_bed", "in_sleep"):
        return grid.spine(people).select("participant_id", "timestamp", F.lit(None).cast("double").alias("value"))
    return grid.series(one_per_time(sleep), people, _sum("duration", F.col("representation") == duration_type))


@feature(SECONDARY, "screen_state", "accelerometer")
def inactive_duration(screen_state: DataFrame, accelerometer: DataFrame, people: DataFrame, grid: Grid, threshold: float = 0.5, gap: int = 10_000) -> DataFrame:
    """Overlap of the longest screen gap and the longest calm of the accelerometer in a window, in ms, or null.

    A screen gap ends in value 0, and takes in the gaps before and after it that lie at most gap ms apart. A calm lies between
    two readings whose jerk falls to threshold or below; the first calm reading does not count. Of equal lengths the first wins.
    """
    own = W.partitionBy("participant_id", "window").orderBy("ts", "seq")
    keys = ["participant_id", "window"]
    gaps = grid.hits(screen_state).withColumn("start", F.lag("ts").over(own)).where("value = 0 AND start IS NOT NULL").withColumn("end", F.col("ts"))
    apart = F.col("start") - F.lag("end").over(own) > gap
    gaps = gaps.withColumn("bout", runs(F.coalesce(apart, F.lit(True)), own))
    longest = F.max_by(F.struct("bout"), F.struct((F.col("end") - F.col("start")).alias("d"), (-F.col("end")).alias("first"))).alias("best")
    best = gaps.groupBy(*keys).agg(longest).select(*keys, F.col("best.bout").alias("bout"))
    screen = gaps.join(best, [*keys, "bout"]).groupBy(*keys).agg(F.min("start").alias("screen_start"), F.max("end").alias("screen_end"))
    rows = one_per_time(grid.hits(accelerometer), "window")
    dt = (F.lag("ts").over(own) - F.col("ts")) / 1000
    jerk = F.sqrt(sum(F.pow((F.lag(c).over(own) - F.col(c)) / dt, 2) for c in "xyz"))
    rows = rows.select(*keys, "ts", "seq", jerk.alias("jerk")).where("jerk IS NOT NULL").withColumn("above", F.col("jerk") > threshold)
    rows = rows.withColumn("before", F.lag("above").over(own)).where("NOT above").withColumn("nth", F.row_number().over(own))
    falls = rows.where("before AND nth > 1")
    calms = falls.withColumn("start", F.lag("ts").over(own)).where("start IS NOT NULL")
    top = F.max_by(F.struct("start", F.col("ts").alias("end")), F.struct((F.col("ts") - F.col("start")).alias("d"), (-F.col("ts")).alias("first"))).alias("best")
    calm = calms.groupBy(*keys).agg(top).select(*keys, F.col("best.start").alias("calm_start"), F.col("best.end").alias("calm_end"))
    overlap = F.least("screen_end", "calm_end") - F.greatest("screen_start", "calm_start")
    found = screen.join(calm, keys).select(*keys, F.when(overlap >= 0, overlap).alias("value"))
    return grid.filled(people, found)


@feature(SECONDARY, "nearby_device")
def nearby_device_count(nearby_device: DataFrame, people: DataFrame, grid: Grid) -> DataFrame:
    """Number of different bluetooth addresses."""
    return grid.series(nearby_device, people, F.count_distinct(F.when(F.col("type") == "bluetooth", F.col("address"))))


@feature(SECONDARY, "device_state", "activity_events")
def screen_duration(device_state: DataFrame, activity_events: DataFrame | None, people: DataFrame, grid: Grid, duration_threshold: int = 7_200_000) -> DataFrame:
    """Screen-on time in ms; null in windows without any device state."""
    from tidemark.operators.intervals import screen_bouts

    bouts = screen_bouts(device_state, duration_threshold) if activity_events is None else _screen_active(device_state, activity_events, duration_threshold)
    spent = grid.clipped(bouts).groupBy("participant_id", "window").agg(F.sum("duration").alias("spent"))
    seen = grid.hits(device_state).select("participant_id", "window").distinct()
    found = seen.join(spent, ["participant_id", "window"], "left").select("participant_id", "window", F.coalesce("spent", F.lit(0)).alias("value"))
    return grid.filled(people, found)


def _usage(column: str, doc: str):
    def total(device_usage: DataFrame, people: DataFrame, grid: Grid) -> DataFrame:
        return grid.series(device_usage, people, F.sum(column))

    total.__doc__ = doc
    return total


screen_unlock_duration = _usage("totalUnlockDuration", "Seconds unlocked.")
screen_unlocks = _usage("totalUnlocks", "Number of unlocks.")
screen_wakes = _usage("totalScreenWakes", "Number of screen wakes.")
for _name in ("screen_unlock_duration", "screen_unlocks", "screen_wakes"):
    globals()[_name].__name__ = _name
    feature(SECONDARY, "device_usage")(globals()[_name])


def steps_changed(analytics: DataFrame) -> DataFrame:
    """participant_id and the ts of its newest analytics event that an old app version sent."""
    version = F.split(F.split("user_agent", ";").getItem(0), " ")
    rows = analytics.where(F.size(version) > 1).where(F.element_at(version, 2).isin(*OLD_STEP_VERSIONS))
    return rows.groupBy("participant_id").agg(F.max("ts").alias("changed"))


@feature(SECONDARY, "steps", "analytics")
def step_count(steps: DataFrame, analytics: DataFrame, people: DataFrame, grid: Grid, data_type: str = "health") -> DataFrame:
    """Steps: the sum of health sources without watches, the most that a pedometer says, or the sum of watches.

    Pedometers count since the change of app version, before it every source that is not null does; watches since the change.
    Null without rows, or without rows that the type looks at. Where no row of a window has a type, null.
    """
    if data_type not in ("health", "pedometer", "watch"):
        raise ValueError("data_type must be health, watch or pedometer")
    rows = grid.hits(steps).join(steps_changed(analytics), "participant_id", "left")
    new = F.col("changed").isNull() | (F.col("ts") > F.col("changed"))
    counted = F.col("type") == "step_count"
    if data_type == "health":
        looked = F.col("source").rlike("com.")
        value = F.sum(F.when(looked & counted & (F.coalesce("device_model", F.lit("")) != "Watch"), F.col("value")))
        value = F.when(_count(looked) > 0, F.coalesce(value, F.lit(0.0)))
    elif data_type == "pedometer":
        value = F.max(F.when(counted & F.when(new, F.col("source").contains("pedometer")).otherwise(F.coalesce("source", F.lit("")) != "null"), F.col("value")))
    else:
        value = F.sum(F.when(new & counted & (F.col("device_model") == "Watch"), F.col("value")))
        value = F.when(_count(new) > 0, F.coalesce(value, F.lit(0.0)))
    value = F.when(F.count("type") > 0, value)
    return grid.filled(people, rows.groupBy("participant_id", "window").agg(value.alias("value")))


@feature(SECONDARY, "messages_usage")
def text_degree(messages_usage: DataFrame, people: DataFrame, grid: Grid) -> DataFrame:
    """Number of people texted with."""
    return grid.series(messages_usage, people, F.sum("totalUniqueContacts"))


@feature(SECONDARY, "messages_usage")
def text_number(messages_usage: DataFrame, people: DataFrame, grid: Grid, text_direction: str = "all") -> DataFrame:
    """Number of texts."""
    columns = {"incoming": ["totalIncomingMessages"], "outgoing": ["totalOutgoingMessages"], "all": ["totalIncomingMessages", "totalOutgoingMessages"]}
    if text_direction not in columns:
        raise ValueError("text_direction must be all, incoming or outgoing")
    return grid.series(messages_usage, people, F.sum(sum(F.coalesce(F.col(c), F.lit(0)) for c in columns[text_direction])))


@feature(SECONDARY, "gps")
def trip_distance(gps: DataFrame, people: DataFrame, grid: Grid, geo: str = "swapped") -> DataFrame:
    """Kilometres of the trips within a window; null without readings."""
    return _by_window(gps, people, grid, geo, F.sum("distance"), True)


@feature(SECONDARY, "gps")
def trip_duration(gps: DataFrame, people: DataFrame, grid: Grid, geo: str = "swapped") -> DataFrame:
    """Time of the trips within a window, in ms; 0 without readings."""
    return _by_window(gps, people, grid, geo, F.sum(F.col("end") - F.col("start")), False)


def _by_window(gps: DataFrame, people: DataFrame, grid: Grid, geo: str, value: Column, null: bool) -> DataFrame:
    """Each window's readings make trips of their own: a participant's windows are taken as histories apart."""
    rows = grid.hits(gps)
    own = _trips(rows.withColumn("participant_id", F.struct("participant_id", "window")), geo)
    found = own.groupBy("participant_id").agg(value.alias("spent")).select("participant_id.*", "spent")
    seen = rows.select("participant_id", "window").distinct().join(found, ["participant_id", "window"], "left")
    out = grid.filled(people, seen.select("participant_id", "window", F.coalesce("spent", F.lit(0)).alias("value")))
    return out if null else out.withColumn("value", F.coalesce("value", F.lit(0)))


@feature(SECONDARY, "visits")
def visit_time(visits: DataFrame, people: DataFrame, grid: Grid, category: str = "home") -> DataFrame:
    """Seconds between arrival and departure at places of a category; other stands for unknown."""
    if category is None:
        raise ValueError("category is required")
    own = F.col("locationCategoryRepresentation") == ("unknown" if category == "other" else category)
    return grid.series(visits, people, _sum(F.col("departureDateInterval.start") - F.col("arrivalDateInterval.start"), own))
