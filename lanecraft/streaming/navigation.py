"""State along a stream of positions: the step machine of a trip, debouncing, and results that are out of date."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

STEPS = "trip long, event_id long, step int, far boolean, near boolean"
#: Metres from the next manoeuvre at which it is announced, announced again, and taken as reached. Fixed values.
FAR, NEAR, THERE = 200, 50, 30
EARTH_M = 6_371_000.0
State = tuple[int, bool, bool]


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return EARTH_M * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def advance(state: State, at: tuple[float, float] | None, manoeuvres: list[tuple[float, float]]) -> tuple[State, bool, bool]:
    """The state (step, whether the next manoeuvre was announced from far and from near) after a position, and what is announced now.

    Both announcements may be due at once. The last manoeuvre is never left, and without a next one nothing happens.
    """
    step, far, near = state
    if at is None or step + 1 >= len(manoeuvres):
        return state, False, False
    away = metres(at, manoeuvres[step + 1])
    say_far, say_near = away <= FAR and not far, away <= NEAR and not near
    if away <= THERE:
        return (step + 1, False, False), say_far, say_near
    return (step, far or say_far, near or say_near), say_far, say_near


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` and sorted within it, for a pass that carries a small state from batch to batch.

    A key's rows go through one task, since each needs the state before it, but never lie in its memory at once.
    """
    return rows.repartition(key).sortWithinPartitions(key, "ts", "event_id")


def steps_batch(positions: DataFrame, manoeuvres: DataFrame) -> DataFrame:
    """The step machine over the ``positions(trip, event_id, ts, lat, lng)`` of each trip in order.

    ``manoeuvres(trip, idx, lat, lng)`` come before a trip's positions in the same pass, which holds those of one trip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip, state, ahead = None, (0, False, False), []
        for batch in batches:
            out = []
            for key, kind, event, lat, lng in zip(*(batch.column(c).to_pylist() for c in ("trip", "kind", "event_id", "lat", "lng")), strict=True):
                if trip is None or key != trip[0]:
                    trip, state, ahead = (key,), (0, False, False), []
                at = None if lat is None or lng is None else (lat, lng)
                if kind == 0:
                    ahead.append(at or (math.nan, math.nan))
                    continue
                state, far, near = advance(state, at, ahead)
                out.append((key, event, state[0], far, near))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["trip", "event_id", "step", "far", "near"])

    first = manoeuvres.select("trip", F.lit(0).alias("kind"), F.col("idx").cast("long").alias("ts"), F.lit(None).cast("long").alias("event_id"), "lat", "lng")
    every = first.unionByName(positions.select("trip", F.lit(1).alias("kind"), "ts", "event_id", "lat", "lng"))
    return every.repartition("trip").sortWithinPartitions("trip", "kind", "ts", "event_id").mapInArrow(run, STEPS)


def steps_stream(positions: DataFrame, manoeuvres: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same over a stream of positions; those later than ``late`` are left out. Manoeuvres are a table that is joined.

    The state of a trip goes once the stream is an hour past its last position. That hour is one of ``ts``, not of the
    clock: a replay gives the same rows, and a stream that has read all there is comes to its end.
    """

    def run(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at: State = tuple(state.get) if state.exists else (0, False, False)
        new, rows = pd.concat(list(parts)), []
        for event, lat, lng, ahead in new.sort_values(["ts", "event_id"])[["event_id", "lat", "lng", "ahead"]].itertuples(index=False):
            there = [(m["lat"], m["lng"]) for m in ahead] if ahead is not None else []
            at, far, near = advance(at, None if pd.isna(lat) or pd.isna(lng) else (lat, lng), there)
            rows.append((key[0], event, at[0], far, near))
        state.update(at)
        state.setTimeoutTimestamp(max(int(new["ts"].max()), state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(rows, columns=["trip", "event_id", "step", "far", "near"])

    # Watermarks begin at 0 and leave out what isn't after them, so that a position at 0 needs one more.
    marked = positions.withColumn("_at", F.timestamp_millis(F.col("ts") + 1)).withWatermark("_at", late)
    ahead = manoeuvres.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lng"))).alias("ahead"))
    return marked.join(ahead, "trip", "left").groupBy("trip").applyInPandasWithState(run, STEPS, "step int, far boolean, near boolean", "append", GroupStateTimeout.EventTimeTimeout)


class StepMachine(StatefulProcessor):
    """The step machine of each trip: where the trip stands, and a timer that ends it an hour after its last position by the stream's time."""

    HOUR_MS = 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", "step int, far boolean, near boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        at: State = tuple(self.standing.get()) if self.standing.exists() else (0, False, False)
        new, out = pd.concat(list(rows)), []
        for event, lat, lng, ahead in new.sort_values(["ts", "event_id"])[["event_id", "lat", "lng", "ahead"]].itertuples(index=False):
            there = [(m["lat"], m["lng"]) for m in ahead] if ahead is not None else []
            at, far, near = advance(at, None if pd.isna(lat) or pd.isna(lng) else (lat, lng), there)
            out.append((key[0], event, at[0], far, near))
        self.standing.update(at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(new["ts"].max()), timers.getCurrentWatermarkInMs()) + self.HOUR_MS)
        yield pd.DataFrame(out, columns=["trip", "event_id", "step", "far", "near"])

    def handleExpiredTimer(self, key: Any, timers: TimerValues, expired: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.standing.clear()
        return iter([])

    def close(self) -> None:
        pass


def step_machine(positions: DataFrame, manoeuvres: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``steps_stream`` by a stateful processor; needs the state store of RocksDB (``spark.sql.streaming.stateStore.providerClass``).

    Positions later than ``late`` are left out. A query that is started again from its checkpoint goes on with the
    trips where they stood.
    """
    ahead = manoeuvres.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lng"))).alias("ahead"))
    marked = positions.withColumn("_at", F.timestamp_millis(F.col("ts") + 1)).withWatermark("_at", late)
    return marked.join(ahead, "trip", "left").groupBy("trip").transformWithStateInPandas(StepMachine(), STEPS, "append", "eventTime")


def debounced_stream(events: DataFrame, key: str, ts: str, gap: str, late: str = "10 seconds") -> DataFrame:
    """The last event of each burst of a key, once the gap has passed: a session window with a watermark."""
    marked = events.withWatermark(ts, late)
    return marked.groupBy(F.session_window(ts, gap), key).agg(F.max_by(F.struct("event_id", ts), ts).alias("last")).select(key, "last.*")


def counts_stream(events: DataFrame, ts: str, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling or sliding windows; an extension beside what live positions need."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(window, "event_type").agg(F.count("*").alias("n"))


def cooled(requests: DataFrame, pause_ms: int = 60_000) -> DataFrame:
    """Which of ``requests(client, event_id, ts, refused)`` are sent: after one that is refused none for ``pause_ms``.

    A refusal counts only if its request was sent, so a client's requests are gone through in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, until = None, -1
        for batch in batches:
            sent = []
            for key, ts, refused in zip(*(batch.column(c).to_pylist() for c in ("client", "ts", "refused")), strict=True):
                if client is None or key != client[0]:
                    client, until = (key,), -1
                sent.append(ts is not None and ts >= until)
                if sent[-1] and refused:
                    until = ts + pause_ms
            yield pa.RecordBatch.from_arrays([batch.column("client"), batch.column("event_id"), pa.array(sent, pa.bool_())], names=["client", "event_id", "sent"])

    return in_order(requests.select("client", "event_id", "ts", "refused"), "client").mapInArrow(run, "client long, event_id long, sent boolean")


def on_route(positions: DataFrame, route: DataFrame, most_m: float = 100.0, cell: float = 0.002) -> DataFrame:
    """``positions(trip, event_id, lat, lng)`` with ``point``, the nearest of their route's points ``(trip, idx, lat, lng)``, null beyond ``most_m``.

    They meet by cells of a route, so that a long one isn't compared whole; cells are wider than ``most_m`` below 60
    degrees of latitude. Without a stream it is a join like any other; in a stream, one for ``foreachBatch``.
    """
    from lanecraft.functions import geo
    from lanecraft.operators.spatial import around

    there = route.select("trip", F.col("idx").alias("point"), F.col("lat").alias("rlat"), F.col("lng").alias("rlng"))
    there = there.withColumns({"row": geo.tile(F.col("rlat"), cell), "col": geo.tile(F.col("rlng"), cell)})
    asked = positions.select("trip", "event_id", "lat", "lng").withColumn("c", F.explode(around(cell))).select("trip", "event_id", "lat", "lng", "c.*")
    away = geo.haversine(F.col("lat"), F.col("lng"), F.col("rlat"), F.col("rlng"))
    best = asked.join(there, ["trip", "row", "col"]).where(away <= most_m).groupBy("trip", "event_id").agg(F.min(F.struct(F.round(away, 6).alias("metres"), "point")).alias("b"))
    return positions.join(best, ["trip", "event_id"], "left").select("trip", "event_id", F.col("b.point").alias("point"))
