"""Keyed state machines for transformWithState."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillstone.operators.late import ALLOWED_LATENESS, MAX_OUT_OF_ORDERNESS


def _row(output: str) -> Callable[..., Row]:
    """A maker of rows with the names of an output schema."""
    return Row(*[c.split()[0] for c in output.split(",")])


class SessionProcessor(StatefulProcessor):
    """Sessions by timers that every event sets anew, for transformWithStateInPandas.

    Rows: key, ms, and a timestamp with a watermark. Events may come in any order within the watermark's
    delay, so several sessions of a key can be open at once: events that fall into one prolong it, and
    sessions that grow to within the gap of each other become one. A session is given out only when its
    timer goes off, that is, when the watermark has passed its end by the gap and no event can change it.

    The rows may be grouped by key or by anything that the key determines, such as a hash of it: the open sessions
    of all keys of a group are one value, and the group has one timer, for the session that ends first. A call has
    a cost of its own that is far above that of its rows, so many keys should be grouped to some hundred hashes.
    """

    OUTPUT = "key string, session_start bigint, session_end bigint, n_events bigint"
    SESSIONS = pa.schema([("key", pa.string()), ("start", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")

    def _kept(self) -> list[np.ndarray]:
        """The group's open sessions: key, start, last, n."""
        held = self.open.get()
        t = pa.ipc.open_stream(held[0]).read_all() if held else pa.table([[]] * 4, self.SESSIONS)
        return [c.to_numpy() for c in t.columns]

    def _keep(self, sessions: list[np.ndarray]) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.SESSIONS) as w:
            w.write_batch(pa.record_batch([pa.array(c, f.type, from_pandas=True) for c, f in zip(sessions, self.SESSIONS, strict=True)], self.SESSIONS))
        self.open.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had, new = self._kept(), [(b["key"].to_numpy(), b["ms"].to_numpy()) for b in rows]
        codes, keys = pd.factorize(np.concatenate([had[0], *(k for k, _ in new)]), use_na_sentinel=False)
        start = np.concatenate([had[1], *(ms for _, ms in new)])
        order = np.lexsort((start, codes))
        last = np.concatenate([had[2], start[len(had[2]) :]])[order]
        n = np.concatenate([had[3], np.ones(len(start) - len(had[3]), np.int64)])[order]
        codes, start = codes[order], start[order]
        last = pd.Series(last).groupby(codes).cummax().to_numpy()
        opens = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (start[1:] - last[:-1] > self.gap)]))
        ends = np.concatenate([opens[1:], [len(start)]]) - 1
        now = [keys[codes[opens]], start[opens], last[ends], np.add.reduceat(n, opens)]
        self._keep(now)
        before, after = int(had[2].min()) if len(had[2]) else None, int(now[2].min())
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before + self.gap)
            self.handle.registerTimer(after + self.gap)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = self._kept()
        due = had[2] + self.gap <= timerValues.getCurrentWatermarkInMs()
        if due.all():
            self.open.clear()
        else:
            left = [c[~due] for c in had]
            self._keep(left)
            self.handle.registerTimer(int(left[2].min()) + self.gap)
        yield pd.DataFrame(dict(zip(["key", "session_start", "session_end", "n_events"], (c[due] for c in had), strict=True)))

    def close(self) -> None:
        pass


class LateWindows(StatefulProcessor):
    """Tumbling windows by event time per key that late records correct.

    Rows: key, event_id, seq, ms, value, window_ms, lateness, disorder (NULL: the defaults). The watermark
    of a key is the largest ms so far less the disorder, judged record by record in order of seq. A
    window is emitted when the watermark reaches its end (outcome window, revision 0). A late record up
    to end + lateness changes its pane, which is emitted again with the next revision; a later one is
    given out by itself: outcome dropped. What the policy is - drop, side output or update - is a filter
    on the outcome. State beyond the cut-off is removed.
    """

    OUTPUT = "key string, outcome string, event_id bigint, window_start bigint, window_end bigint, revision bigint, n bigint, total bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "ms bigint")
        self.panes = handle.getMapState("panes", "start bigint", "n bigint, nv bigint, total bigint, revision bigint, until bigint")
        self.seen = handle.getMapState("seen", "event_id bigint", "until bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        give = _row(self.OUTPUT)
        top = self.top.get()[0] if self.top.exists() else None
        panes = {k[0]: list(v) for k, v in self.panes.iterator()}
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        known, had = set(panes), set(seen)
        wide = 0
        for r in sorted(rows, key=lambda r: r.seq):
            if r.ms is None or r.window_ms is None or r.window_ms <= 0 or r.event_id in seen:
                continue
            wide = r.window_ms
            lateness = ALLOWED_LATENESS if r.lateness is None else r.lateness
            disorder = MAX_OUT_OF_ORDERNESS if r.disorder is None else r.disorder
            start = r.ms - r.ms % wide
            end = start + wide
            mark = None if top is None else top - disorder
            if r.event_id is not None:
                seen[r.event_id] = end + lateness
            if mark is not None and mark > end + lateness:
                yield give(key[0], "dropped", r.event_id, start, end, None, None, None)
                seen.pop(r.event_id, None)
                continue
            p = panes.setdefault(start, [0, 0, 0, -1, end + lateness])
            p[0] += 1
            if r.value is not None:
                p[1] += 1
                p[2] += r.value
            if mark is not None and mark >= end:
                p[3] = max(p[3], 0) + 1
                yield give(key[0], "corrected", r.event_id, start, end, p[3], p[0], p[2] if p[1] else None)
            if top is None or r.ms > top:
                top = r.ms
                for s in sorted(panes):
                    q = panes[s]
                    if s + wide > top - disorder:
                        break
                    if q[3] < 0:
                        q[3] = 0
                        yield give(key[0], "window", None, s, s + wide, 0, q[0], q[2] if q[1] else None)
                    if q[4] < top - disorder:
                        del panes[s]
        if top is None:
            return
        self.top.update((top,))
        for s in known - set(panes):
            self.panes.removeKey((s,))
        for s, p in panes.items():
            self.panes.updateValue((s,), tuple(p))
        mark = top - disorder if wide else None
        for i, until in seen.items():
            if mark is not None and until < mark:
                if i in had:
                    self.seen.removeKey((i,))
            elif i not in had:
                self.seen.updateValue((i,), (until,))

    def close(self) -> None:
        pass


class RunningCount(StatefulProcessor):
    """Passes every event through with its number among the events of its key, for transformWithStateInPandas. Rows: key, id; numbered in order of id within a batch."""

    OUTPUT = "key string, id bigint, n bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids = np.sort(np.concatenate([b["id"].to_numpy() for b in rows]))
        n = self.n.get()[0] if self.n.exists() else 0
        self.n.update((n + len(ids),))
        yield pd.DataFrame({"key": [key[0]] * len(ids), "id": ids, "n": np.arange(n + 1, n + len(ids) + 1)})

    def close(self) -> None:
        pass


class KeyedStore(StatefulProcessor):
    """Entries per key with expiry and bounds on their number and size, updated once per transaction.

    Rows: key, op, name, value, tx, seq. put writes an entry, but does nothing if its tx was already applied
    to the key; delete removes one, clear all. get gives the value or NULL, exists `true` or `false`, list the
    names with the prefix `name`, snapshot all entries with their values, which puts can restore. An entry
    not written for ttl_ms is gone. Beyond max_entries, or max_bytes of names and values, the entries used
    longest ago are removed (policy lru), or those written first (policy oldest).
    """

    OUTPUT = "key string, seq bigint, op string, name string, value string"

    def __init__(self, ttl_ms: int | None = None, max_entries: int | None = None, policy: str = "lru", max_bytes: int | None = None):
        if policy not in ("lru", "oldest"):
            raise ValueError(f"unknown policy {policy!r}")
        self.ttl, self.max_entries, self.policy, self.max_bytes = ttl_ms, max_entries, policy, max_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = {"ttlDurationMs": self.ttl} if self.ttl else {}
        self.entries = handle.getMapState("entries", "name string", "value string, written bigint, used bigint", **kept)
        self.applied = handle.getMapState("applied", "tx string", "seq bigint", **kept)

    def _evict(self) -> None:
        by = 2 if self.policy == "lru" else 1
        held = sorted((tuple(v)[by], k[0], len(k[0].encode()) + len((v[0] or "").encode())) for k, v in self.entries.iterator())
        n, size = len(held), sum(h[2] for h in held)
        for _, name, own in held:
            if n <= (self.max_entries or n) and size <= (self.max_bytes or size):
                break
            self.entries.removeKey((name,))
            n, size = n - 1, size - own

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        give = _row(self.OUTPUT)
        for r in sorted(rows, key=lambda r: r.seq):
            name = (r.name,)
            if r.op == "put":
                if r.tx is not None:
                    if self.applied.containsKey((r.tx,)):
                        continue
                    self.applied.updateValue((r.tx,), (r.seq,))
                self.entries.updateValue(name, (r.value, r.seq, r.seq))
                if self.max_entries or self.max_bytes:
                    self._evict()
            elif r.op == "delete":
                self.entries.removeKey(name)
            elif r.op == "clear":
                for k in [k[0] for k in self.entries.keys()]:
                    self.entries.removeKey((k,))
            elif r.op == "get":
                found = self.entries.getValue(name) if self.entries.containsKey(name) else None
                if found is not None:
                    self.entries.updateValue(name, (found[0], found[1], r.seq))
                yield give(key[0], r.seq, r.op, r.name, found[0] if found is not None else None)
            elif r.op == "exists":
                yield give(key[0], r.seq, r.op, r.name, "true" if self.entries.containsKey(name) else "false")
            elif r.op in ("list", "snapshot"):
                for k, v in sorted((k[0], v[0]) for k, v in self.entries.iterator() if k[0].startswith(r.name or "")):
                    yield give(key[0], r.seq, r.op, k, v if r.op == "snapshot" else None)

    def close(self) -> None:
        pass
