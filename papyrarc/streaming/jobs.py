"""Streams of submissions, job events and captures, with batch twins that give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyrarc.operators.scan import stored

_FINAL = ("succeeded", "failed", "cancelled")


def suppress_fresh(submissions: DataFrame, seconds: int, late: str | None = None) -> DataFrame:
    """Stream of (key, event_id, ts): those accepted, at least `seconds` after the key's last accepted one.

    Those suppressed don't extend the window. State is one time for each key; a batch's rows of a key are taken in order of
    time and id. With `late`, rows behind that watermark are dropped, and a key's state is given up once the watermark
    is `seconds` past its last accepted row: whatever still comes is accepted anyway. Without it keys are remembered for ever.
    The same function serves batch tables.
    """

    def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            at = r.ts.timestamp()
            if last is None or at - last >= seconds:
                last = at
                kept.append((key[0], r.event_id, r.ts))
        if last is not None:
            state.update((last,))
            if late:
                state.setTimeoutTimestamp(max(math.ceil((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=["key", "event_id", "ts"])

    rows = submissions.select("key", "event_id", "ts")
    rows = rows.withWatermark("ts", late) if late else rows
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(accept, "key long, event_id long, ts timestamp", "last double", "append", timeout)


#: Events of one key that a task holds at a time, and stretches of them that are composed together.
STRETCH, COMPOSED = 1 << 18, 64


def _jumps(at: np.ndarray, width: int) -> np.ndarray:
    """For each event of a stretch, the last one that is accepted if this one is: jumps to the next accepted event, doubled until none moves."""
    after = np.searchsorted(at, at + width)
    jump = np.where(after < len(at), after, np.arange(len(at)))
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return at[jump]


def _cut(width: int, stretch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted (key, at, event_id): the accepted events of keys that lie within the task, and the stretches of all other keys.

    Those have the time they begin at. An event that can be the first accepted of its stretch has the time of the last one then, where the next event's differs.
    """

    def accepted(key: pa.Array, at: np.ndarray, ids: np.ndarray, starts: set[int]) -> pa.RecordBatch:
        kept, last = [], 0
        for i, t in enumerate(at.tolist()):
            if i in starts or t - last >= width:
                last = t
                kept.append(i)
        return _cut_rows(key.take(pa.array(kept, pa.int64())), at[kept], ids[kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, at, ids = None, False, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def open_stretch(n: int) -> pa.RecordBatch:
            times = at[:n]
            last = _jumps(times, width)
            enter = np.searchsorted(times, times[0] + width) + 1  # so many can be the first
            told = np.zeros(n, bool)
            told[:enter] = np.append(last[:enter][1:] != last[:enter][:-1], True)
            ends = pa.array(last, mask=~told)
            return _cut_rows(pa.array([now[0]] * n, pa.int64()), times, ids[:n], pa.array(np.full(n, times[0])), ends)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, times, names = batch.column("key"), batch.column("at").to_numpy(), batch.column("event_id")
            null, value = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy()
            edges = (np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1).tolist()
            names = names.to_numpy()
            if now is not None and key[0].as_py() != now[0]:
                yield accepted(pa.array([now[0]] * len(at), pa.int64()), at, ids, {0}) if whole else open_stretch(len(at))
                now, whole, at, ids = (key[0].as_py(),), True, at[:0], ids[:0]
            elif now is None:
                now = (key[0].as_py(),)
            first, last = (edges[0], edges[-1]) if edges else (len(times), len(times))
            at, ids = np.concatenate([at, times[:first]]), np.concatenate([ids, names[:first]])
            if edges:
                yield accepted(pa.array([now[0]] * len(at), pa.int64()), at, ids, {0}) if whole else open_stretch(len(at))
                if last > first:
                    yield accepted(key.slice(first, last - first), times[first:last], names[first:last], {e - first for e in edges[:-1]})
                now, whole, at, ids = (key[last].as_py(),), True, times[last:], names[last:]
            while len(at) > stretch:
                yield open_stretch(stretch)
                whole, at, ids = False, at[stretch:], ids[stretch:]
        if now is not None:
            yield open_stretch(len(at))

    return run


def _cut_rows(key: pa.Array, at: np.ndarray, ids: np.ndarray, stretch: pa.Array | None = None, end: pa.Array | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(at), pa.int64())
    return pa.RecordBatch.from_arrays([key, pa.array(ids, pa.int64()), pa.array(at, pa.int64()), none if stretch is None else stretch, none if end is None else end], names=["key", "event_id", "at", "stretch", "end"])


def _compose(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What neighbouring stretches make together of each time before them: a row for each end, with the last time it is reached by.

    A stretch's row says: whoever is free at a time up to `upto`, and after that of the row before, has `end` as the last accepted event.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start = None, 0
        upto = end = np.zeros(0, np.int64)

        def extend(more_upto: np.ndarray, more_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(more_upto, end + width)
            there = at < len(more_upto)
            ends = np.where(there, more_end[np.minimum(at, len(more_upto) - 1)], end)
            # who is free only after all events so far comes in here, if anyone can be
            late = np.searchsorted(more_upto, upto[-1], side="right") if len(upto) else 0
            reach = np.searchsorted(more_upto, start + width) + 1 if not len(upto) or upto[-1] < start + width else late
            return np.concatenate([upto, more_upto[late:reach]]), np.concatenate([ends, more_end[late:reach]])

        def out() -> pa.RecordBatch:
            # neighbours with one end are one row, with the later time
            last = np.flatnonzero(np.append(end[1:] != end[:-1], True))
            n = len(last)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.int64()), pa.array([now[1]] * n, pa.int64()), pa.array(upto[last]), pa.array(end[last])], names=["key", "part", "upto", "end"])

        for of, _, u, e in _grouped(batches, ("key", "part", "stretch")):
            if now != of[:2]:
                if now is not None:
                    yield out()
                now, start, upto, end = of[:2], of[2], u[:0], e[:0]
            upto, end = extend(u, e)
        if now is not None:
            yield out()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, int | None, np.ndarray, np.ndarray]]:
    """Stretch by stretch: its columns `by`, the time `after`, and all its rows' upto and end. Batches are sorted by `by` and upto."""
    now, after, held = None, None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in by]
        afters = batch.column("after").to_pylist() if "after" in batch.schema.names else [None] * batch.num_rows
        upto, end = batch.column("upto").to_numpy(), batch.column("end").to_numpy()
        lo = 0
        for i, of in enumerate(zip(*cols, strict=True)):
            if of != now:
                held.append((upto[lo:i], end[lo:i]))
                if now is not None:
                    yield now, after, np.concatenate([u for u, _ in held]), np.concatenate([e for _, e in held])
                now, after, held, lo = of, afters[i], [], i
        held.append((upto[lo:], end[lo:]))
    if now is not None:
        yield now, after, np.concatenate([u for u, _ in held]), np.concatenate([e for _, e in held])


def _walk(width: int, within: int, by: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each unit of rows (upto, end), named by the columns `by`: the last accepted time before it. Walks start anew where the first `within` of them change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, last = None, None
        for of, after, upto, end in _grouped(batches, by):
            if of[:within] != walk:
                walk, last = of[:within], after
            yield pa.RecordBatch.from_arrays([pa.array([of[0]], pa.int64()), pa.array([of[-1]], pa.int64()), pa.array([last], pa.int64())], names=["key", "unit", "after"])
            i = 0 if last is None else np.searchsorted(upto, last + width)
            if i < len(upto):
                last = int(end[i])

    return run


def _accept(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The accepted events of stretches (key, stretch, after, at, event_id), each read in order on from the last time accepted before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            kept = []
            columns = (batch.column(c).to_pylist() for c in ("key", "stretch", "after", "at"))
            for i, (key, stretch, after, at) in enumerate(zip(*columns, strict=True)):
                if (key, stretch) != now:
                    now, last = (key, stretch), after
                if last is None or at - last >= width:
                    last = at
                    kept.append(i)
            yield batch.select(["key", "event_id", "at"]).take(pa.array(kept, pa.int64()))

    return run


def suppress_fresh_batch(submissions: DataFrame, seconds: int, stretch: int = STRETCH, composed: int = COMPOSED) -> DataFrame:
    """The batch twin of `suppress_fresh`; rows without a time are left out.

    Of a key's events at one time only the first can be accepted, so those are taken in a grouped minimum. Events are sorted over
    all tasks by key and time. A key that lies within one task is read there. Any other is cut into stretches of at most
    `stretch` events, and each event's jump to the next one accepted is doubled until it leaves its stretch: so a stretch is
    what it makes of the last time accepted before it, a row for each end it can have. `composed` neighbours are put together into one such table; a
    key's tables are walked through once, then each one's stretches, and last the events of every stretch by
    themselves, so that no task orders a key. Events are stored once, in the folder that executors share.
    """
    if seconds <= 0:
        return submissions.select("key", "event_id", "ts")
    width = seconds * 1_000_000
    parts = int(submissions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = submissions.where("ts is not null").select(F.col("key").cast("long").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"))
    first = times.groupBy("key", "at").agg(F.min("event_id").alias("event_id")).where("event_id is not null")
    dealt = stored(first.repartitionByRange(parts, "key", "at").sortWithinPartitions("key", "at").mapInArrow(_cut(width, stretch), "key long, event_id long, at long, stretch long, end long"))

    several = dealt.where("stretch is not null")
    ends = several.where("end is not null").select("key", "stretch", F.col("at").alias("upto"), "end")
    place = F.row_number().over(Window.partitionBy("key").orderBy("stretch"))
    groups = ends.select("key", "stretch").distinct().withColumn("part", F.floor((place - 1) / composed)).select(F.col("key").alias("of"), F.col("stretch").alias("begin"), "part")
    ends = ends.join(groups, F.col("key").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("begin"))).select("key", "part", "stretch", "upto", "end")

    sort = lambda df, by, order: df.repartition(parts, *by).sortWithinPartitions(*by, *order)
    tables = sort(ends, ["key", "part"], ["stretch", "upto"]).mapInArrow(_compose(width), "key long, part long, upto long, end long")
    walk = "key long, unit long, after long"
    before = sort(tables, ["key"], ["part", "upto"]).mapInArrow(_walk(width, 1, ("key", "part")), walk)
    before = before.select(F.col("key").alias("of"), F.col("unit").alias("begin"), "after")
    inner = ends.join(before, F.col("key").eqNullSafe(F.col("of")) & (F.col("part") == F.col("begin"))).select("key", "part", "stretch", "after", "upto", "end")
    entered = sort(inner, ["key", "part"], ["stretch", "upto"]).mapInArrow(_walk(width, 2, ("key", "part", "stretch")), walk)
    entered = entered.select(F.col("key").alias("of"), F.col("unit").alias("begin"), "after")
    rest = several.join(entered, F.col("key").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("begin"))).select("key", "stretch", "after", "at", "event_id")
    accepted = sort(rest, ["key", "stretch"], ["at"]).mapInArrow(_accept(width), "key long, event_id long, at long")
    out = dealt.where("stretch is null").select("key", "event_id", "at").union(accepted)
    return out.select("key", "event_id", F.timestamp_micros("at").alias("ts"))


def next_state(state: str | None, event: str) -> str | None:
    """A job's state after an event; events that don't fit leave it as it is."""
    if event == "queued" and state is None:
        return "queued"
    if event == "running" and state == "queued":
        return "running"
    if event in ("succeeded", "failed") and state == "running":
        return event
    if event == "retry" and state in ("running", "failed"):
        return "queued"
    if event == "cancelled" and state == "queued":
        return "cancelled"
    return state


def job_states(events: DataFrame, timeout_seconds: int = 60) -> DataFrame:
    """Stream of (job_id, state, attempts, overdue) whenever a job changes, from events (job_id, event, ts).

    Only queued jobs can be cancelled; an attempt counts when a job starts to run. A batch's events of a job are taken in order of
    time, and of event_id where there is one. A watchdog, on event time, marks jobs that run for
    longer than five minutes or four times the timeout. `events` needs a watermark on ts.
    """
    allowed = max(300, 4 * timeout_seconds)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts, started = state.get if state.exists else (None, 0, 0.0)
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], now, attempts, now == "running")], columns=["job_id", "state", "attempts", "overdue"])
            return
        rows = pd.concat(list(frames))
        for r in rows.sort_values([c for c in ("ts", "event_id") if c in rows]).itertuples():
            after = next_state(now, r.event)
            if after == "running" and now != "running":
                attempts, started = attempts + 1, r.ts.timestamp()
            now = after
        if now is None:
            return
        state.update((now, attempts, started))
        if now == "running":
            state.setTimeoutTimestamp(max(int((started + allowed) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], now, attempts, False)], columns=["job_id", "state", "attempts", "overdue"])

    return events.groupBy("job_id").applyInPandasWithState(fold, "job_id long, state string, attempts int, overdue boolean", "state string, attempts int, started double", "update", GroupStateTimeout.EventTimeTimeout)


_STATES = (None, "queued", "running", *_FINAL)
#: For each kind of event: the state that follows on each state, and whether an attempt begins there.
_MOVES = {e: tuple((_STATES.index(next_state(s, e)), int(next_state(s, e) == "running" and s != "running")) for s in _STATES) for e in ("queued", "running", "succeeded", "failed", "retry", "cancelled")}
_STAY = tuple((i, 0) for i in range(len(_STATES)))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each stretch of a job's events, in order, makes of every state that it may find."""
    job, first, moves = None, None, list(_STAY)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([job], pa.int64()), pa.array([first[0]], pa.timestamp("us", tz="UTC")), pa.array([first[1]], pa.int64()), pa.array([[m for m, _ in moves]], pa.list_(pa.int32())), pa.array([[n for _, n in moves]], pa.list_(pa.int32()))], names=["job_id", "ts", "event_id", "ends", "attempts"])

    for batch in batches:
        for of, ts, event_id, event in zip(*(batch.column(c).to_pylist() for c in ("job_id", "ts", "event_id", "event")), strict=True):
            if first is None or of != job:
                if first is not None:
                    yield out()
                job, first, moves = of, (ts, event_id), list(_STAY)
            step = _MOVES.get(event, _STAY)
            moves = [(step[s][0], n + step[s][1]) for s, n in moves]
    if first is not None:
        yield out()


def job_states_batch(events: DataFrame) -> DataFrame:
    """(job_id, state, attempts) after all events of each job.

    Events are sorted over all tasks by job, time and id, so that a job of any number of events is spread over several. Each task
    sums up its stretch of a job as what it makes of every state, one row, and a job's stretches, at most one
    for each task, are composed in order.
    """
    rows = events.select(F.col("job_id").cast("long"), F.col("ts").cast("timestamp"), F.col("event_id").cast("long"), "event")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "job_id", "ts", "event_id").sortWithinPartitions("job_id", "ts", "event_id")
    stretches = ordered.mapInArrow(_stretches, "job_id long, ts timestamp, event_id long, ends array<int>, attempts array<int>")
    whole = stretches.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "ends", "attempts"))).alias("all"))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"))
    end = F.aggregate("all", start, lambda acc, x: F.struct(F.get(x["ends"], acc["s"]).alias("s"), (acc["n"] + F.get(x["attempts"], acc["s"])).alias("n")))
    return whole.select("job_id", end.alias("e")).select("job_id", F.get(F.array(*(F.lit(s).cast("string") for s in _STATES)), F.col("e.s")).alias("state"), F.col("e.n").alias("attempts")).where("state is not null")


def overdue_jobs(jobs: DataFrame, now: datetime | Column, timeout_seconds: int = 60) -> DataFrame:
    """Running jobs that started longer ago than five minutes or four times the timeout."""
    at = now if isinstance(now, Column) else F.lit(now)
    return jobs.where((F.col("status") == "running") & (F.col("started_at") < at - F.make_dt_interval(secs=F.lit(max(300, 4 * timeout_seconds)))))


def latest_pointer(captures: DataFrame, key: str) -> DataFrame:
    """(key, capture_id, captured_at) of the newest capture; late arrivals win only if they aren't older. For streams in update or complete mode."""
    return captures.groupBy(key).agg(F.max(F.struct("captured_at", "capture_id")).alias("b")).select(key, "b.capture_id", "b.captured_at")


def status_windows(events: DataFrame, ts: str, status: str, length: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, status, n) of tumbling or sliding windows; with `late`, rows behind that watermark are dropped from a stream."""
    rows = events.withWatermark(ts, late) if late else events
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.groupBy(window.alias("w"), F.col(status).alias("status")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")
