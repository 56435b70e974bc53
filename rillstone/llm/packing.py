"""Items of varying size into as few containers of fixed capacity as can be."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.store import written

#: Parts of the items of one size that are numbered apart.
PARTS = 64

#: So many containers that hold the same sizes: {size: how often}.
Pattern = tuple[int, dict[int, int]]


class _Stock:
    """Sizes still to be put away and how often each is there."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def less(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def left(self, size: int, used: tuple[int, ...]) -> int:
        return self.n.get(size, 0) - used.count(size)

    def largest(self, limit: int, used: tuple[int, ...]) -> int | None:
        """The largest size up to the limit besides those used."""
        i = bisect_right(self.sizes, limit) - 1
        while i >= 0 and self.left(self.sizes[i], used) <= 0:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, k: int, used: tuple[int, ...]) -> list[int]:
        """The k smallest items besides those used."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), max(0, self.left(s, used)))
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int, used: tuple[int, ...]) -> int:
        """The largest sum up to room of two items besides those used; 0 if no two fit."""
        sizes = [s for s in self.sizes[: bisect_right(self.sizes, room)] if self.left(s, used) > 0]
        best, i, j = 0, 0, len(sizes) - 1
        while i <= j:
            both = sizes[i] + sizes[j]
            if both > room:
                j -= 1
            else:
                if i < j or self.left(sizes[i], used) > 1:
                    best = max(best, both)
                i += 1
        return best

    def largest_minor(self, room: int, used: tuple[int, ...]) -> int:
        """The largest possible smaller item of two that fit together; 0 if no two fit."""
        i = bisect_right(self.sizes, room // 2) - 1
        while i >= 0:
            y = self.sizes[i]
            if self.left(y, used) >= 2:
                return y
            if self.left(y, used) == 1:
                j = i + 1
                while j < len(self.sizes) and self.left(self.sizes[j], used) <= 0:
                    j += 1
                if j < len(self.sizes) and self.sizes[j] + y <= room:
                    return y
            i -= 1
        return 0


def reduced(stock: _Stock, capacity: int) -> list[Pattern]:
    """Fix the sets that dominate every other set with the same item (Martello and Toth), and take them from stock.

    A set dominates another if the other's items can be shared out among the set's items without any
    getting more than its own size; some best packing then holds the set. From the largest item on:
    alone, if nothing fits beside it; with the item that fills the container; with the largest that
    fits, if no two fit or no two that fit are larger together; with the largest that fits and the
    largest that fits then, if no three fit and no pair has a larger minor item. What makes a set
    dominate stays true as items go, so a set is fixed as often as its items are there.
    """
    out: list[Pattern] = []
    for s in reversed(list(stock.sizes)):
        while s in stock.n:
            room, mine = capacity - s, (s,)
            few = stock.smallest(3, mine)
            if not few or few[0] > room:
                chosen = mine
            else:
                k = stock.largest(room, mine)
                if k == room or len(few) < 2 or few[0] + few[1] > room:
                    chosen = (s, k)
                elif len(few) < 3 or sum(few) > room:
                    if k >= stock.best_pair(room, mine):
                        chosen = (s, k)
                    else:
                        c = stock.largest(room - k, (s, k))
                        if c is None or stock.largest_minor(room, mine) > c:
                            break
                        chosen = (s, k, c)
                else:
                    break
            need = {x: chosen.count(x) for x in chosen}
            times = min(stock.n[x] // q for x, q in need.items())
            for x, q in need.items():
                stock.less(x, q * times)
            out.append((times, need))
    return out


def best_fit(stock: _Stock, capacity: int) -> list[Pattern]:
    """Put what is left, largest first, where the least room remains; like containers are filled together."""
    rooms: list[int] = []
    at: dict[int, list[list]] = {}
    done: list[Pattern] = []

    def keep(n: int, room: int, held: dict[int, int]) -> None:
        if not room:
            done.append((n, held))
            return
        if room not in at:
            at[room] = []
            insort(rooms, room)
        at[room].append([n, held])

    for s in reversed(list(stock.sizes)):
        left = stock.n[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                room, n, held = capacity, left, {}  # as many new ones as need be
            else:
                room = rooms[i]
                n, held = at[room].pop()
                if not at[room]:
                    del at[room]
                    del rooms[i]
            each = room // s
            full = min(n, left // each)
            if full:
                keep(full, room - each * s, {**held, s: each})
                left -= full * each
                n -= full
            if n and left:  # one more takes what is left
                keep(1, room - left * s, {**held, s: left})
                n, left = n - 1, 0
            if n and held:
                keep(n, room, held)
    for room in rooms:
        done += [(n, held) for n, held in at[room]]
    return done


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that put away all items. Sizes are from 1 to capacity."""
    stock = _Stock(counts)
    return reduced(stock, capacity) + best_fit(stock, capacity)


def _spans(patterns: list[Pattern]) -> np.ndarray:
    """For each size and pattern: size, first rank, first container, items of the size in a container; ordered."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for n, held in patterns:
        for s, each in held.items():
            rows.append((s, used.get(s, 0), container, each))
            used[s] = used.get(s, 0) + n * each
        container += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(items: DataFrame, item_id: Column, size: Column, kinds: DataFrame) -> DataFrame:
    """Containers for all items, for each kind of container by itself: container_kind, container, doc_id, piece, n_tokens.

    kinds: container_kind (unique), capacity_tokens. Containers of a kind are numbered from 0. An item
    over the capacity is split into pieces of the capacity and one with what remains; no other is.

    The sizes are counted where they lie; only the counts come to the driver, one row per size up to the
    capacity of each kind, however many items there are. Which sizes share a container is found there,
    on whole groups of like items. The items of a size are then numbered, in parts so that a size with a
    large part of all items is spread over many tasks, and each takes its place by its number.

    Defined cases: an item without size or with a size below 1 is left out, as is a kind without name
    or with a capacity below 1. Rows that repeat an id are items of their own. Items of one size are
    placed in order of their id. Empty tables give no rows. Other columns are ignored.
    """
    spark = items.sparkSession
    c = kinds.groupBy("container_kind").agg(F.min("capacity_tokens").cast("bigint").alias("capacity")).where("container_kind IS NOT NULL AND capacity >= 1")
    base = written(items.select(item_id.cast("bigint").alias("doc_id"), size.cast("bigint").alias("size")).where("size >= 1"))
    capacities = {r["container_kind"]: r["capacity"] for r in c.collect()}
    if not capacities:
        return spark.createDataFrame([], "container_kind string, container bigint, doc_id bigint, piece int, n_tokens int")
    names = sorted(capacities)
    each_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(capacities[n]).alias("capacity")) for k, n in enumerate(names)]))
    rows = base.select("doc_id", "size", each_kind.alias("c")).select("doc_id", "size", "c.*")
    cut = rows.withColumn("piece", F.explode(F.expr("sequence(0, CAST((size - 1) DIV capacity AS INT))")))
    each = cut.select("kind", "doc_id", "piece", F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity")).cast("int").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int").alias("part"))
    of_parts = written(each.groupBy("kind", "n_tokens", "part").agg(F.count(F.lit(1)).alias("n")))
    counts: dict[int, dict[int, int]] = {k: {} for k in range(len(names))}
    for r in of_parts.groupBy("kind", "n_tokens").agg(F.sum("n").alias("n")).collect():  # at most as many rows as the capacities' sum
        counts[r["kind"]][r["n_tokens"]] = r["n"]
    spans = {k: _spans(plan(counts[k], capacities[names[k]])) for k in counts}
    upto = Window.partitionBy("kind", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_parts.select("kind", "n_tokens", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    by_id = Window.partitionBy("kind", "n_tokens", "part").orderBy("doc_id", "piece")
    ranked = each.withColumn("nth", F.row_number().over(by_id)).join(starts, ["kind", "n_tokens", "part"])
    ranked = ranked.select("kind", "doc_id", "piece", "n_tokens", (F.col("start") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, n_tokens, rank = (b.column(k).to_numpy() for k in (0, 3, 4))
            container = np.zeros(len(kind), np.int64)
            for k in np.unique(kind):
                m = np.flatnonzero(kind == k)
                s = spans[int(k)]
                lo, hi = np.searchsorted(s[:, 0], n_tokens[m]), np.searchsorted(s[:, 0], n_tokens[m], "right")
                while len(wide := np.flatnonzero(hi - lo > 1)):  # the last span of the size that starts at or before the rank
                    mid = (lo[wide] + hi[wide]) >> 1
                    left = s[mid, 1] <= rank[m][wide]
                    lo[wide[left]], hi[wide[~left]] = mid[left], mid[~left]
                container[m] = s[lo, 2] + (rank[m] - s[lo, 1]) // s[lo, 3]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, object)[kind], pa.string()), pa.array(container), b.column(1), b.column(2), b.column(3)], names=["container_kind", "container", "doc_id", "piece", "n_tokens"])

    return ranked.mapInArrow(place, "container_kind string, container bigint, doc_id bigint, piece int, n_tokens int")
