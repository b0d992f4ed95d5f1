"""The store's time rules as Structured Streaming: gates, dedup, bins and windows, late rows, pending labels, stateful folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A file-source stream of event rows; files: at most so many a batch."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def gated(events: DataFrame, least: int = 60) -> DataFrame:
    """Events whose source was out `least` minutes before the event's time at the latest: what a cutoff may use. props holds k, the minutes from source to event."""
    lead = F.get_json_object("props", "$.k").cast("long")
    return events.where(lead >= least)


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each event id, with state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per bin and stat; rows later than the watermark are dropped by the engine."""
    return sliding(events, size, None, late)


def sliding(events: DataFrame, size: str = "1 hour", slide: str | None = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and stat; a row is in every window that covers it."""
    w = F.window("ts", size, slide)
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def marked_late(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, ts, value, late): every row, with whether it came after the watermark had passed it.

    The engine drops late rows before aggregates; here they come through, for a side output. Only the
    watermark is read, so no user leaves state behind.
    """

    def mark(key, frames, state):
        limit = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for f in frames:
            yield f[["event_id", "user_id", "ts", "value"]].assign(late=f.ts < limit)

    rows = events.withWatermark("ts", late).groupBy("user_id")
    return rows.applyInPandasWithState(mark, "event_id long, user_id long, ts timestamp, value double, late boolean", "seen long", "append", "NoTimeout")


def split_output(marked: DataFrame, on_time: str, late: str, checkpoint: str) -> StreamingQuery:
    """Writes rows in time and late rows to two tables, a folder for each batch, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        batch.where("NOT late").write.mode("overwrite").parquet(f"{on_time}/batch={n}")
        batch.where("late").write.mode("overwrite").parquet(f"{late}/batch={n}")
        batch.unpersist()

    return marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def matured_labels(events: DataFrame, hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, realized, status): a label for each purchase, `hours` after it: SETTLED by the participant's first later event, or EXPIRED when the watermark passes without one.

    Purchases wait in state; an event-time timer fires for those that nothing settles.
    """
    span = pd.Timedelta(hours=hours)

    def settle(key, frames, state):
        waiting = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        if state.hasTimedOut:
            mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            out = [(i, pd.Timestamp(t, unit="us") + span, "EXPIRED") for i, t in waiting if pd.Timestamp(t, unit="us") + span <= mark]
            waiting = [(i, t) for i, t in waiting if pd.Timestamp(t, unit="us") + span > mark]
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            for i, ts, kind in zip(rows.event_id, rows.ts, rows.event_type, strict=True):
                now = ts.value // 1000
                due = [(j, t) for j, t in waiting if t < now]
                out += [(j, min(ts, pd.Timestamp(t, unit="us") + span), "SETTLED" if ts <= pd.Timestamp(t, unit="us") + span else "EXPIRED") for j, t in due]
                waiting = [x for x in waiting if x not in due]
                if kind == "purchase":
                    waiting.append((int(i), int(now)))
        if waiting:
            state.update(tuple(map(list, zip(*waiting, strict=True))))
            first = min(t for _, t in waiting)
            state.setTimeoutTimestamp(max(first // 1000 + hours * 3_600_000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["user_id", "event_id", "realized", "status"])

    rows = events.withWatermark("ts", late).groupBy("user_id")
    return rows.applyInPandasWithState(settle, "user_id long, event_id long, realized timestamp, status string", "ids array<long>, times array<long>", "append", "EventTimeTimeout")


def running_rating(events: DataFrame, rate: float = 0.1) -> DataFrame:
    """An exponentially weighted level of each participant's values, kept as state over micro-batches."""

    def fold(key, frames, state):
        n, level = state.get if state.exists else (0, 0.0)
        for v in pd.concat(list(frames)).sort_values(["ts", "event_id"]).value:
            level = v if n == 0 else level + rate * (v - level)
            n += 1
        state.update((n, level))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "level": [level]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, n long, level double", "n long, level double", "update", "NoTimeout")


def meetings(events: DataFrame, most: int = 20) -> DataFrame:
    """(user_id, event_type, n, share): of the last `most` values of a participant and stat, how many and which share is above 50: a bounded history as state."""

    def fold(key, frames, state):
        past = list(state.get[0]) if state.exists else []
        past = (past + [int(v > 50) for v in pd.concat(list(frames)).sort_values(["ts", "event_id"]).value])[-most:]
        state.update((past,))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "n": [len(past)], "share": [sum(past) / len(past)]})

    return events.groupBy("user_id", "event_type").applyInPandasWithState(fold, "user_id long, event_type string, n long, share double", "past array<int>", "update", "NoTimeout")


def restartable(df: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Starts, or starts again from its checkpoint, a stream whose batches go to sink(batch, number); a number that comes again is the same batch."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).start()


MATCH = "match_id long, sport string, a long, b long, outcome string, ts timestamp, avail timestamp"
RATED = "sport string, match_id long, elo_a double, elo_b double"
_HOUR, _DAY = 3_600_000_000, 86_400_000_000


def match_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A file-source stream of matches; files: at most so many a batch."""
    reader = spark.readStream.schema(MATCH)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


class Ratings(StatefulProcessor):
    """Ratings by sport over a stream of matches, with head-of-line admission.

    State: a rating for each participant (a map); matches that the watermark hasn't passed (a list); what
    is to be done, in order of time: results that wait to be admitted, and matches that wait for the
    results before their cutoff (a list); and the latest realization among the matches so far. A timer
    goes off when the watermark passes the first that waits.
    """

    def __init__(self, k: float = 24.0, start: float = 1500.0, scale: float = 400.0):
        self.k, self.first, self.scale = k, start, scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rating = handle.getMapState("rating", "pid long", "rating double")
        self.fresh = handle.getListState("fresh", "t long, match_id long, a long, b long, won int, avail long")
        self.due = handle.getListState("due", "at long, kind int, t long, match_id long, a long, b long, won int")
        self.latest = handle.getValueState("latest", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, first = [], None
        for f in rows:
            for i, a, b, won, t, avail in zip(f.match_id, f.a, f.b, f.outcome.map({"A": 1, "B": 0}).fillna(-1), f.ts, f.avail, strict=True):
                t, avail = t.value // 1000, avail.value // 1000
                new.append((t, int(i), int(a), int(b), int(won), avail))
                first = t if first is None else min(first, t)
        self.fresh.appendList(new)
        self._wake(first, timerValues)
        yield pd.DataFrame([], columns=[c.split()[0] for c in RATED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = sorted(tuple(r) for r in self.fresh.get()) if self.fresh.exists() else []
        todo = [tuple(r) for r in self.due.get()] if self.due.exists() else []
        latest = self.latest.get()[0] if self.latest.exists() else None
        for t, i, a, b, won, avail in (r for r in fresh if r[0] < passed):  # none before these can come any more
            todo.append((t - _HOUR, 1, t, i, a, b, -1))
            if won >= 0 and a != b:
                latest = max(t + _DAY, avail, latest if latest is not None else t)
                todo.append((max(latest, t + 1 - _HOUR), 0, t, i, a, b, won))
        fresh = [r for r in fresh if r[0] >= passed]
        todo.sort()
        ready = next((n for n, r in enumerate(todo) if r[0] >= passed - _HOUR), len(todo))
        out, held = [], {}

        def rating(pid):
            if pid not in held:
                held[pid] = self.rating.getValue((pid,))[0] if self.rating.containsKey((pid,)) else self.first
            return held[pid]

        for _, kind, _, i, a, b, won in todo[:ready]:
            ra, rb = rating(a), rating(b)
            if kind == 1:
                out.append((key[0], i, ra, rb))
            else:
                change = self.k * (won - 1 / (1 + 10 ** ((rb - ra) / self.scale)))
                held[a], held[b] = ra + change, rb - change
        for pid, r in held.items():
            self.rating.updateValue((pid,), (r,))
        for state, left in ((self.fresh, fresh), (self.due, todo[ready:])):
            if left:
                state.put(left)
            else:
                state.clear()
        if latest is not None:
            self.latest.update((latest,))
        waits = [r[0] for r in fresh[:1]] + [r[0] + _HOUR for r in todo[ready : ready + 1]]
        self._wake(min(waits) if waits else None, timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RATED.split(", ")])

    def _wake(self, at: int | None, timers) -> None:
        """A timer for when the watermark has passed `at`, in microseconds."""
        if at is not None:
            self.handle.registerTimer(max(at // 1000 + 1, timers.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def streamed_ratings(matches: DataFrame, late: str = "10 minutes", k: float = 24.0) -> DataFrame:
    """(sport, match_id, elo_a, elo_b) of each match of the stream once the watermark has passed what may still change it: both sides' ratings at its cutoff, by the results admitted then. Needs the RocksDB state store."""
    rows = matches.withWatermark("ts", late).groupBy("sport")
    return rows.transformWithStateInPandas(Ratings(k), RATED, "Append", "EventTime")


def gated_pairs(observations: DataFrame, cutoffs: DataFrame, reach: str = "30 days", late: str = "10 minutes", late_cutoffs: str = "1 hour") -> DataFrame:
    """(target_id, version, event_id, t, known, cutoff, allowed): each observation(event_id, pid, ts, known) of a stream with each version of a cutoff(target_id, pid, version, start, cutoff) of another, of the same participant and up to `reach` before the target's start; allowed says that it was known at that cutoff.

    Both streams have a watermark of their own, on the observation's and on the target's time, so the
    state of either is dropped once the other has passed it by the reach.
    """
    o = observations.withWatermark("ts", late).select(F.col("pid"), "event_id", F.col("ts").alias("t"), "known")
    c = cutoffs.withWatermark("start", late_cutoffs).select(F.col("pid").alias("target_pid"), "target_id", "version", "start", "cutoff")
    pairs = o.join(c, F.expr(f"pid = target_pid AND t < start AND t >= start - INTERVAL {reach}"))
    return pairs.select("target_id", "version", "event_id", "t", "known", "cutoff", (F.greatest("t", "known") <= F.col("cutoff")).alias("allowed"))


def in_force(pairs: DataFrame) -> DataFrame:
    """Of a table of gated pairs those of each target's newest version that are allowed."""
    newest = pairs.groupBy("target_id").agg(F.max("version").alias("version"))
    return pairs.join(newest, ["target_id", "version"], "left_semi").where("allowed")
