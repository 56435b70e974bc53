"""Pairing records of two tables by nearest time with x-fast tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.cleaning import one_per_id

#: Rows of whole groups that are worked on at once.
BLOCK = 1 << 16


class PrefixTable:
    """A hash table over distinct non-negative 64-bit keys (open addressing, many keys at a time)."""

    def __init__(self, keys: np.ndarray):
        self.mask = (1 << max(4, int(2 * len(keys)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int64)
        self.refs = np.full(self.mask + 1, -1, np.int64)
        rest, at = np.arange(len(keys)), self.home(keys)
        while len(rest):
            free = self.slots[at] == -1
            self.slots[at[free]] = keys[rest[free]]
            won = self.slots[at] == keys[rest]
            self.refs[at[won]] = rest[won]
            rest, at = rest[~won], (at[~won] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys in the table's input, -1 for those it lacks."""
        out, rest, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self.home(keys)
        while len(rest):
            there = self.slots[at]
            hit = there == keys[rest]
            out[rest[hit]] = self.refs[at[hit]]
            on = ~hit & (there != -1)
            rest, at = rest[on], (at[on] + 1) & self.mask
        return out


class XFastTrie:
    """Predecessor and successor among leaves (group, offset), offsets of `bits` bits.

    Every bit-prefix of every leaf is a key of a hash table, with the first and last leaf below it. A
    query finds the longest prefix that it shares with a leaf by binary search on the prefix length;
    all leaves below that node are on one side of it, so the nearest of them is its predecessor or
    successor, and the linked list of leaves has the other.
    """

    def __init__(self, leaves: np.ndarray, bits: int):
        self.leaves, self.bits = leaves, bits  # ascending and distinct
        keys, first, last = [], [], []
        for length in range(bits + 1):
            prefix = leaves >> (bits - length)
            starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else np.zeros(0, np.int64)
            keys.append(prefix[starts] << 6 | length)
            first.append(starts)
            last.append(np.concatenate([starts[1:], [len(prefix)]]) - 1 if len(prefix) else starts)
        self.first, self.last = np.concatenate(first), np.concatenate(last)
        self.table = PrefixTable(np.concatenate(keys))

    def neighbours(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the last leaf <= q and the first leaf > q in the group of q; -1 where there is none."""
        bits, n = self.bits, len(q)
        low, high = np.full(n, -1, np.int64), np.full(n, bits, np.int64)
        node = np.full(n, -1, np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            length = (low[open_] + high[open_] + 1) >> 1
            found = self.table.find((q[open_] >> (bits - length)) << 6 | length)
            there = found >= 0
            low[open_[there]], node[open_[there]] = length[there], found[there]
            high[open_[~there]] = length[~there] - 1
        pred, succ = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        some, m = low >= 0, len(self.leaves)
        whole = some & (low == bits)
        right = np.zeros(n, bool)
        part = np.flatnonzero(some & ~whole)
        right[part] = (q[part] >> (bits - low[part] - 1)) & 1 == 1
        at_end, at_start = np.flatnonzero(whole | right), np.flatnonzero(some & ~whole & ~right)
        pred[at_end] = self.last[node[at_end]]
        succ[at_end] = pred[at_end] + 1
        succ[at_start] = self.first[node[at_start]]
        pred[at_start] = succ[at_start] - 1
        for side in (pred, succ):
            side[side >= m] = -1
            ok = np.flatnonzero(side >= 0)
            apart = self.leaves[side[ok]] >> bits != q[ok] >> bits
            side[ok[apart]] = -1
        return pred, succ


class Side:
    """The right records of some groups in a trie, against which left records are matched."""

    def __init__(self, spots: np.ndarray, ids: np.ndarray, bits: int, tolerance: int):
        self.ids, self.tolerance = ids, tolerance
        self.trie = XFastTrie(spots, bits) if len(spots) else None

    def matches(self, q: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        far = np.int64(1) << 62
        if self.trie is None:
            ok, gap, best, back = np.zeros(len(q), bool), q, q, q
        else:
            leaves = self.trie.leaves
            pred, succ = self.trie.neighbours(q)
            back = np.where(pred >= 0, q - leaves[pred], far)
            ahead = np.where(succ >= 0, leaves[succ] - q, far)
            gap, best = np.where(back <= ahead, -back, ahead), np.where(back <= ahead, pred, succ)
            ok = np.minimum(back, ahead) <= self.tolerance
        right = self.ids[best[ok]] if ok.any() else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(right), pa.array(gap[ok])], names=["left_id", "right_id", "gap_ms"])


def _groups(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Numbers, from 0, of the groups (entity, bucket) of ordered rows."""
    n = rows.num_rows
    entity, bucket = rows.column(0), rows.column(1).to_numpy()
    other = np.zeros(n, bool)
    if n > 1:
        other[1:] = pc.not_equal(entity.slice(1), entity.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (bucket[1:] != bucket[:-1])
    return np.cumsum(other)


class Matcher:
    """Matches in rows (entity, bucket, side, ms, id) that come in this order, a batch at a time.

    Whole groups are matched together, some rows at a time. A group of more rows than that is matched by
    itself: its trie is built once, when its right records are all there, and its left records pass by.
    """

    def __init__(self, bits: int, bucket_bits: int, tolerance: int):
        self.bits, self.bucket_bits, self.tolerance = bits, bucket_bits, tolerance
        self.whole: list[pa.RecordBatch] = []  # batches of groups that are all there
        self.part: list[pa.RecordBatch] = []  # the last group so far
        self.open: tuple[object, int, Side] | None = None  # or its trie

    def _spots(self, rows: pa.Table | pa.RecordBatch, groups: np.ndarray | int) -> np.ndarray:
        return (groups << self.bits) | (rows.column(3).to_numpy() - (rows.column(1).to_numpy() << self.bucket_bits) + self.tolerance)

    def _side(self, rows: pa.Table) -> tuple[Side, np.ndarray, np.ndarray]:
        """The right records of rows, and spots and ids of the left ones."""
        spots, of, ids = self._spots(rows, _groups(rows)), rows.column(2).to_numpy() == 0, rows.column(4).to_numpy()
        return Side(spots[of], ids[of], self.bits, self.tolerance), spots[~of], ids[~of]

    def _all(self, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if batches:
            side, q, ids = self._side(pa.Table.from_batches(batches).combine_chunks())
            yield side.matches(q, ids)

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        groups = _groups(batch)
        entity, bucket = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        if self.open is not None:
            if self.open[:2] == (entity, bucket):  # left records of the open group
                n = int(np.searchsorted(groups, 1))
                now = batch.slice(0, n)
                yield self.open[2].matches(self._spots(now, 0), now.column(4).to_numpy())
                batch, groups = batch.slice(n), groups[n:]
            if not batch.num_rows:
                return
            self.open = None
        elif self.part and (self.part[0].column(0)[0].as_py(), self.part[0].column(1)[0].as_py()) == (entity, bucket):
            n = int(np.searchsorted(groups, groups[0] + 1))
            self.part.append(batch.slice(0, n))
            batch, groups = batch.slice(n), groups[n:]
        if batch.num_rows:
            last = int(np.searchsorted(groups, groups[-1]))
            self.whole += [*self.part, *([batch.slice(0, last)] if last else [])]
            self.part = [batch.slice(last)]
        if sum(b.num_rows for b in self.whole) >= BLOCK:
            yield from self._all(self.whole)
            self.whole = []
        if sum(b.num_rows for b in self.part) >= BLOCK and self.part[-1].column(2)[-1].as_py() == 1:
            rows = pa.Table.from_batches(self.part).combine_chunks()
            side, q, ids = self._side(rows)
            yield side.matches(q, ids)
            self.open, self.part = (rows.column(0)[0].as_py(), rows.column(1)[0].as_py(), side), []

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._all(self.whole + self.part)


def nearest(
    left: DataFrame, left_id: Column, left_entity: Column, left_ms: Column,
    right: DataFrame, right_id: Column, right_entity: Column, right_ms: Column,
    tolerance_ms: int = 30_000, bucket_bits: int = 20,
) -> DataFrame:
    """For each left record the right record of the same entity that is nearest in time: left_id, right_id, gap_ms.

    gap_ms is the right time less the left time, at most tolerance_ms either way. At equal distance the
    earlier right record wins, at equal time the one with the smaller id. Left records without a match
    are left out.

    The time line of an entity is cut into buckets of 2^bucket_bits ms, right records near a border go
    to both buckets, and the tries are built per entity and bucket: however many records an entity
    has, no bucket holds more than 2^bucket_bits + 2 * tolerance_ms leaves, as right records of one
    time are reduced to their smallest id before. A bucket's trie is built once; left records pass by in blocks.

    Defined cases: a record with NULL id, entity or time takes no part. Rows with the same left_id are
    one record (the earliest). Empty tables give no rows. Other columns are ignored whatever their names.
    """
    assert 0 <= tolerance_ms < 1 << 36 and 0 < bucket_bits < 37
    bits = ((1 << bucket_bits) + 2 * tolerance_ms).bit_length()
    point = left.select(left_id.cast("bigint").alias("id"), left_entity.cast("string").alias("entity"), left_ms.cast("bigint").alias("ms"))
    point = one_per_id(point.where("id IS NOT NULL AND entity IS NOT NULL AND ms IS NOT NULL"), "id", ["ms"])
    leaf = right.select(right_id.cast("bigint").alias("id"), right_entity.cast("string").alias("entity"), right_ms.cast("bigint").alias("ms"))
    leaf = leaf.where("id IS NOT NULL AND entity IS NOT NULL AND ms IS NOT NULL").groupBy("entity", "ms").agg(F.min("id").alias("id"))
    low, high = F.shiftright(F.col("ms") - tolerance_ms, bucket_bits), F.shiftright(F.col("ms") + tolerance_ms, bucket_bits)
    both = leaf.select("entity", F.explode(F.sequence(low, high)).alias("bucket"), F.lit(0).alias("side"), "ms", "id").unionByName(
        point.select("entity", F.shiftright("ms", bucket_bits).alias("bucket"), F.lit(1).alias("side"), "ms", "id")
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(bits, bucket_bits, tolerance_ms)
        for batch in batches:
            yield from matcher.add(batch)
        yield from matcher.end()

    ordered = both.repartition("entity", "bucket").sortWithinPartitions("entity", "bucket", "side", "ms", "id")
    return ordered.mapInArrow(match, "left_id bigint, right_id bigint, gap_ms bigint")
