"""Sessions by inactivity: a timer per key that every event sets anew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class SessionTimers:
    """Keyed timers over events that come ordered by key, slice and time, a batch at a time.

    The first event of a key opens a session and sets its timer to its time + gap; every later event
    updates the session and resets the timer. The timer has expired when the key's next event is later
    than it, or when the key or slice ends; the session is then emitted with start, end and counts.
    All timers of a batch are evaluated at once; the session still open at its end is carried over.
    """

    def __init__(self, gap: int, n_kinds: int):
        self.gap, self.n_kinds = gap, n_kinds
        self.open: list | None = None  # key, slice, start, last time, last id, counts
        self.empty_counts = np.zeros(n_kinds, np.int64)

    def updates(self, batch: pa.RecordBatch) -> dict | None:
        """Sessions whose timers expired within the batch."""
        if not batch.num_rows:
            return None
        keys, cuts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        times, kinds = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        ids = batch.column(4).fill_null(-1).to_numpy(zero_copy_only=False)
        known = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        n = len(times)
        other = np.ones(n, bool)  # another key or slice than the event before
        if n > 1:
            other[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (cuts[1:] != cuts[:-1])
        before = np.empty(n, np.int64)
        before[1:] = times[:-1]
        again = np.zeros(n, bool)  # the record before, delivered once more
        again[1:] = ~other[1:] & known[1:] & (times[1:] == times[:-1]) & (ids[1:] == ids[:-1])
        before[0] = times[0]
        if self.open is not None:
            key, cut, _, last, last_id, _ = self.open
            other[0] = keys[0].as_py() != key or cuts[0] != cut
            before[0] = last
            again[0] = not other[0] and known[0] and times[0] == last and ids[0] == last_id
        expired = other | (times > before + self.gap)
        starts = np.flatnonzero(expired)
        goes_on = not expired[0]
        if goes_on:
            starts = np.concatenate([[0], starts])
        ends = np.concatenate([starts[1:], [n]]) - 1
        counts = np.empty((len(starts), self.n_kinds), np.int64)
        for k in range(self.n_kinds):
            counts[:, k] = np.add.reduceat(((kinds == k) & ~again).astype(np.int64), starts)
        first = times[starts].copy()
        due = []
        if goes_on:
            first[0] = self.open[2]
            counts[0] += self.open[5]
        elif self.open is not None:
            due.append(self.expired())
        e = ends[-1]
        self.open = [keys[int(starts[-1])].as_py(), int(cuts[e]), int(first[-1]), int(times[e]), int(ids[e]), counts[-1].copy()]
        at = starts[:-1]
        if len(at):
            due.append(self.table(keys.take(pa.array(at)), cuts[at], first[:-1], times[ends[:-1]], counts[:-1]))
        return pa.concat_tables(due) if due else None

    def expired(self) -> pa.Table:
        """What is still open, when no more events come."""
        key, cut, start, last, _, counts = self.open
        return self.table(pa.array([key], pa.string()), [cut], [start], [last], counts[None, :])

    @staticmethod
    def table(keys, cuts, starts, ends, counts) -> pa.Table:
        cols = [keys, pa.array(cuts, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
        return pa.Table.from_arrays([*cols, *(pa.array(counts[:, k], pa.int64()) for k in range(counts.shape[1]))], names=["key", "slice", "start", "end", *(f"n{k}" for k in range(counts.shape[1]))])


def sessions(
    df: DataFrame, key: Column, seconds: Column, kind: Column, record_id: Column, kinds: tuple[str, ...], gap: int = 1800, slice_seconds: int = 86_400
) -> DataFrame:
    """Sessions of each key: columns key, session_start, session_end, duration, n_events, n_<kind>..., n_other.

    A session goes on while the next event is at most `gap` seconds later. The end is the time of the
    last event.

    The events of a key are split by time slice, so that a key with a large part of all events is
    worked on by many tasks. Within a slice SessionTimers runs over the ordered events. Only sessions
    less than `gap` from a slice's border can go on in the next slice: these, at most two per key and
    slice, meet by key and are joined up, all others are spread over the tasks.

    Defined cases: a NULL key or time, or a time beyond +-2^60, takes no part. Copies of a record (same key, time and record_id)
    count once; rows without record_id count each. A kind that is NULL or not in `kinds` counts as
    other. Events at the same second are one moment. An empty table gives no sessions. Other columns
    of df are ignored whatever their names.
    """
    n_kinds = len(kinds) + 1
    number = F.lit(n_kinds - 1)
    for i, k in reversed(list(enumerate(kinds))):
        number = F.when(kind == k, F.lit(i)).otherwise(number)
    t = seconds.cast("bigint")
    rows = df.select(
        key.cast("string").alias("key"), F.floor(t / F.lit(slice_seconds)).cast("bigint").alias("slice"), t.alias("t"), number.cast("int").alias("kind"), record_id.cast("bigint").alias("id")
    ).where(F.col("key").isNotNull() & F.col("t").between(-(1 << 60), 1 << 60))

    def timers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = SessionTimers(gap, n_kinds)
        for batch in batches:
            if (due := running.updates(batch)) is not None:
                yield from due.to_batches()
        if running.open is not None:
            yield from running.expired().to_batches()

    counts = [f"n{k}" for k in range(n_kinds)]
    schema = "key string, slice bigint, start bigint, end bigint, " + ", ".join(f"{c} bigint" for c in counts)
    partial = rows.repartition("key", "slice").sortWithinPartitions("key", "slice", "t", "id").mapInArrow(timers, schema)
    border = F.col("slice") * slice_seconds
    reaches = (F.col("start") - border < gap) | (border + slice_seconds - F.col("end") <= gap)
    spread = partial.withColumn("apart", F.when(~reaches, F.col("start")))
    by_start = Window.partitionBy("key", "apart").orderBy("start")
    numbered = spread.withColumn("opens", (F.col("start") > F.lag("end").over(by_start) + gap).cast("int")).withColumn("nth", F.sum(F.coalesce("opens", F.lit(1))).over(by_start))
    whole = numbered.groupBy("key", "apart", "nth").agg(F.min("start").alias("session_start"), F.max("end").alias("session_end"), *[F.sum(c).alias(c) for c in counts])
    return whole.select(
        "key",
        "session_start",
        "session_end",
        (F.col("session_end") - F.col("session_start")).alias("duration"),
        sum(F.col(c) for c in counts).alias("n_events"),
        *[F.col(f"n{i}").alias(f"n_{k}") for i, k in enumerate(kinds)],
        F.col(f"n{n_kinds - 1}").alias("n_other"),
    )
