"""Named features of three kinds, and one call that runs several of them for all participants at once."""

from __future__ import annotations

import importlib
import inspect
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.grid import DAY, Grid, expanded, nine_am
from tidemark.sources import sensors
from tidemark.sources.store import Store

RAW, PRIMARY, SECONDARY = "raw", "primary", "secondary"


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    function: Callable[..., DataFrame]
    inputs: tuple[str, ...] = field(default=())
    #: For intervals that are decided over a whole history: what can be kept of them, with a kind that its rows have (grown), the
    #: inputs of that, and the function that makes the intervals of it and the other inputs.
    base: tuple[Callable[..., DataFrame], str, tuple[str, ...], Callable[..., DataFrame]] | None = None

    @property
    def sources(self) -> tuple[str, ...]:
        """Names of the frames that run needs for it."""
        return tuple(("sensor_events" if self.name in sensors.SENSORS else "activity_events") if i == "events" else i for i in self.inputs)

    @property
    def keeps(self) -> bool:
        """Whether it makes intervals, which a store can keep."""
        return self.kind == PRIMARY and self.name != "significant_locations"

    @property
    def parameters(self) -> dict[str, inspect.Parameter]:
        """Options of the feature: what its function takes besides its inputs, people and grid."""
        fixed = {*self.inputs, "people", "grid", "events", "activities", "name", "start", "end"}
        return {k: v for k, v in inspect.signature(self.function).parameters.items() if k not in fixed}


FEATURES: dict[str, Feature] = {}


def feature(kind: str, *inputs: str, base: tuple | None = None):
    """Registers a function of its input frames, and of people and grid for a secondary feature, under its own name."""

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        FEATURES[function.__name__] = Feature(function.__name__, kind, function, inputs, base)
        return function

    return register


def _register_raw() -> None:
    for name in sensors.SENSORS:
        FEATURES[name] = Feature(name, RAW, partial(sensors.sensor, name=name), ("events",))
    for name in sensors.ACTIVITIES:
        FEATURES[name] = Feature(name, RAW, sensors.survey if name == "survey" else partial(sensors.activity, name=name), ("events", "activities"))


_register_raw()


def all_features() -> dict[str, Feature]:
    """All features by name; the modules that register them are loaded when they are first asked for."""
    for module in ("intervals", "series"):
        importlib.import_module(f"tidemark.operators.{module}")
    return FEATURES


def _default_range(sources: dict[str, DataFrame], people: DataFrame, start: int | None, end: int | None, resolution: int, zone: str) -> tuple[int | None, int | None]:
    """start and end, where they are None from the first and last event of people in any source; for windows of whole days moved to the 9
    in the morning before and after, in the zone."""
    rows = None
    for s in sources.values():
        if {"participant_id", "ts"} <= set(s.columns):
            own = s.select("participant_id", "ts")
            rows = own if rows is None else rows.unionByName(own)
    first, last = F.col("first").cast("long"), F.col("last").cast("long")
    shifted = nine_am(first, last, zone) if resolution % DAY == 0 else (first, last)
    got = rows.join(people, "participant_id", "left_semi").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).select(*shifted).first()
    return (got[0] if start is None else start), (got[1] if end is None else end)


def run(sources: dict[str, DataFrame], people: DataFrame | Iterable | None, features: Iterable[str | dict] = (), start: int | None = None, end: int | None = None, resolution: int = DAY, parameters: dict[str, dict] | None = None, members: tuple[DataFrame, DataFrame] | None = None, save: str | None = None, store: Store | None = None, pairs: DataFrame | None = None, zone: str = "UTC") -> dict[str, DataFrame]:
    """Feature name to a lazy frame over all people, with participant_id first and datetime added.

    sources: frames by the names that features ask for; raw sensors ask for sensor_events, raw activities for activity_events and
    activities. people: a frame with participant_id, or ids of participants, studies and researchers, which members (participants with
    study_id, studies with researcher_id) tells apart. features: names, or dicts with name and the feature's options; an unknown
    name raises. pairs: instead of people and features, a frame of participant_id and feature, and options as a JSON object if
    they differ; each feature is computed for its own people, with its options over those of parameters, and a column options tells
    results apart. start and end default to the first and last event of all sources, for windows of whole days moved to 9 in the
    morning of zone. Intervals get timestamp = start of the run. save: a folder that gets a Parquet table for each feature.

    store: keeps raw ranges and interval features by person and options (Store.ranged and Store.grown), so that a run reads what
    is new. Results are those of a run without a store as long as events come in order of time; what comes late is
    seen after Store.forget. Features without start and end are computed anew, and so are secondary ones.
    """
    known = all_features()
    if pairs is not None:
        people = pairs.select("participant_id").distinct()
        named = pairs.select("feature", *(["options"] if "options" in pairs.columns else [F.lit(None).cast("string").alias("options")])).distinct().orderBy("feature", "options")
        wanted = [(r["feature"], {**(parameters or {}).get(r["feature"], {}), **json.loads(r["options"] or "{}")}, r["options"]) for r in named.collect()]  # a row for each feature and set of options
    else:
        wanted = [(f, (parameters or {}).get(f, {}), None) if isinstance(f, str) else (f["name"], {k: v for k, v in f.items() if k != "name"}, None) for f in features]
    if people is None:
        raise ValueError("parameter `id` is required but missing.")
    if unknown := [f for f, _, _ in wanted if f not in known]:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    if not isinstance(people, DataFrame):
        ids = [str(x) for x in people]
        some = next(s for s in sources.values() if "participant_id" in s.columns)
        people = expanded(ids, *members) if members else some.where(F.col("participant_id").cast("string").isin(ids)).select("participant_id").distinct()
    people = people.select("participant_id").distinct()
    if start is None or end is None:
        start, end = _default_range(sources, people, start, end, resolution, zone)
        if start is None or end is None:
            return {}
    grid, out = Grid(start, end, resolution), {}

    for name, options, told in wanted:
        own = people if pairs is None else pairs.where((F.col("feature") == name) & (F.col("options").eqNullSafe(F.lit(told)) if "options" in pairs.columns else F.lit(True))).select("participant_id").distinct()
        got = _one(known[name], options, sources, own, grid, store)
        got = got.select("participant_id", *(c for c in got.columns if c != "participant_id")).withColumn("datetime", F.timestamp_millis("timestamp"))
        if pairs is not None and "options" in pairs.columns:
            got = got.withColumn("options", F.lit(told).cast("string"))
        out[name] = out[name].unionByName(got, allowMissingColumns=True) if name in out and pairs is not None else got
    if save:
        for name, got in out.items():
            got.write.mode("overwrite").parquet(f"{save.rstrip('/')}/{name}")
    return out


def _one(entry: Feature, options: dict, sources: dict[str, DataFrame], people: DataFrame, grid: Grid, store: Store | None) -> DataFrame:
    """A feature of people, by its kind, with the column timestamp."""

    def source(name: str, since: DataFrame | None = None) -> DataFrame:
        if name not in sources:
            raise ValueError(f"no source {name}")
        own = sources[name]
        if "participant_id" not in own.columns:
            return own
        own = own.join(people, "participant_id", "left_semi")
        if since is not None and "ts" in own.columns:
            own = own.join(since, "participant_id", "left").where(F.col("since").isNull() | (F.col("ts") >= F.col("since"))).drop("since")
        return own

    if entry.kind == SECONDARY:
        return entry.function(*map(source, entry.inputs), people, grid, **options)
    if entry.kind == PRIMARY:
        if store is None or not entry.keeps:
            got = entry.function(*map(source, entry.inputs), **options)
        elif entry.base:
            base, kind, inputs, made = entry.base
            rows = store.grown(entry.name, options, people, lambda since: base(*(source(i, since) for i in inputs), **options), kind)
            got = made(rows, *(source(i) for i in entry.inputs if i not in inputs))
        else:
            got = store.grown(entry.name, options, people, lambda since: entry.function(*(source(i, since) for i in entry.inputs), **options))
        if entry.keeps and grid.end > grid.start:
            got = Grid(grid.start, grid.end, grid.end - grid.start).clipped(got).drop("window")
        return got.withColumn("timestamp", F.lit(grid.start))
    inputs = [source(i) for i in entry.sources]
    if store is None:
        got = entry.function(*inputs, start=grid.start, end=grid.end, **options)
    elif entry.name in sensors.SENSORS:
        got = store.ranged(entry.name, options, people, grid.start, grid.end, lambda low, high: entry.function(*inputs, start=low, end=high, **options))
    else:  # events are kept as they are, as a survey's rows depend on all events of the range, and activities may be renamed
        events = store.ranged("activity_events", None, people, grid.start, grid.end, lambda low, high: sensors.between(inputs[0], low, high))
        got = entry.function(events, *inputs[1:], start=grid.start, end=grid.end, **options)
    return got.withColumn("timestamp", F.col("ts"))
