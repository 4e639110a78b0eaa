"""The same features over streams: windows with watermarks, screen bouts with state, and kept results by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.store import Store


def windowed(events: DataFrame, value: Column, resolution: str = "1 day", late: str = "1 hour") -> DataFrame:
    """participant_id, timestamp and an aggregate of each tumbling window that has events; windows close `late` after their end.
    events has ts in ms."""
    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    out = timed.groupBy("participant_id", F.window("at", resolution)).agg(value.alias("value"))
    return out.select("participant_id", F.unix_millis("window.start").alias("timestamp"), "value")


def screen_bouts(states: DataFrame, duration_threshold: int = 7_200_000) -> DataFrame:
    """Screen-on bouts as their off-events come: participant_id, start, end, duration. The state of a participant is the start of an
    open bout. Events of one participant have to come in order over micro-batches; within one they are sorted here. On-events
    that bounce within a second start the bout with the last of them while the first is in the same batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        values, times, out = rows["value"].tolist(), rows["ts"].tolist(), []
        for i, (v, t) in enumerate(zip(values, times, strict=True)):
            if v in (0, 3):
                bounced = i + 1 < len(values) and values[i + 1] in (0, 3) and times[i + 1] - t < 1000
                if start is None and not bounced:
                    start = t
            elif v in (1, 2) and start is not None:
                if t - start <= duration_threshold:
                    out.append((key[0], start, t, t - start))
                start = None
        if start is None:
            state.remove()
        else:
            state.update((start,))
        yield pd.DataFrame(out, columns=["participant_id", "start", "end", "duration"])

    kind = states.schema["participant_id"].dataType.simpleString()
    grouped = states.select("participant_id", "ts", "seq", "value").groupBy("participant_id")
    return grouped.applyInPandasWithState(step, f"participant_id {kind}, start long, end long, duration long", "start long", "append", GroupStateTimeout.NoTimeout)


def keep(intervals: DataFrame, store: Store, name: str, checkpoint: str):
    """Writes a stream of intervals into a store: each micro-batch is a part named by its number, so one that is repeated after a
    failure replaces itself and no earlier batch is read. store.save(name, store.load(name)) makes one part of them."""

    def add(batch: DataFrame, number: int) -> None:
        store.append(name, batch, number)

    return intervals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
