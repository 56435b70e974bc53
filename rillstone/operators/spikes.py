"""Faults in measurements: spikes by phase-space thresholding, stuck values, impossible readings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.cleaning import one_per_id

#: Rows of a series group for one task's block, and rows of the neighbouring blocks that it also sees.
BLOCK_ROWS, MARGIN_ROWS = 24_000, 3_000
#: Neighbours on each side that make up the local level, of the source itself and of its peers.
OWN, PEERS = 5, 4
#: A point outside the ellipsoid is no spike if it is nearer to a level of its neighbours or peers than this
#: share of its own deviation, or of the ellipsoid's reach.
OWN_SHARE, REACH_SHARE = 1 / 2, 2 / 3
#: A run counts as stuck if fewer than this many runs so long are to be expected among the source's runs.
RUN_CHANCE, SHORTEST_RUN = 1e-4, 6
#: The 90 % quantile of the length of three independent normal values with scatter 1 (chi, 3 degrees of freedom).
CHI_90 = 2.5003


def _scale(d: np.ndarray) -> float:
    """Robust standard deviation around 0; of the values that aren't 0, if most of them are."""
    d = np.abs(d[np.isfinite(d)])
    half = float(np.median(d)) if len(d) else 0.0
    return 1.4826 * (half or (float(np.median(d[d > 0])) if (d > 0).any() else 0.0))


def _levels(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Levels about each value, without it: medians of the neighbours before, after and on both sides, and on the line from before to after: shape (n, 4)."""
    n = len(x)
    pad = np.full(OWN, np.nan)
    w = sliding_window_view(np.concatenate([pad, x, pad]), 2 * OWN + 1)
    when = sliding_window_view(np.concatenate([pad, np.where(np.isnan(x), np.nan, t), pad]), 2 * OWN + 1)
    sides = slice(0, OWN), slice(OWN + 1, 2 * OWN + 1)
    out, at = np.full((n, 4), np.nan), np.full((n, 2), np.nan)
    for k, part in enumerate((w[:, sides[0]], w[:, sides[1]], np.concatenate([w[:, sides[0]], w[:, sides[1]]], axis=1))):
        some = ~np.isnan(part).all(axis=1)
        out[some, k] = np.nanmedian(part[some], axis=1)
        if k < 2:
            at[some, k] = np.nanmedian(when[some][:, sides[k]], axis=1)
    span = at[:, 1] - at[:, 0]
    share = np.divide(t - at[:, 0], span, out=np.full(n, np.nan), where=span > 0)
    out[:, 3] = out[:, 0] + (out[:, 1] - out[:, 0]) * share
    return out


def _weighted_median(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    order = np.argsort(v, axis=1)
    v, w = np.take_along_axis(v, order, 1), np.take_along_axis(w, order, 1)
    upto = np.cumsum(w, axis=1)
    return v[np.arange(len(v)), np.argmax(upto >= upto[:, -1:] / 2, axis=1)]


def _peer_distance(z: np.ndarray, t: np.ndarray, own: np.ndarray, peers: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Least distance of the records `own` from the level of the records `peers` before, after and around their time."""
    if not len(peers):
        return np.full(len(own), np.inf)
    at = np.searchsorted(t[peers], t[own])[:, None] + np.arange(-PEERS, PEERS)[None, :]
    near = peers[np.clip(at, 0, len(peers) - 1)]
    v, w = z[near], 1 / scale[near]
    each = [_weighted_median(v[:, a:b], w[:, a:b]) for a, b in ((0, 2 * PEERS), (0, PEERS), (PEERS, 2 * PEERS))]
    return np.min(np.abs(z[own][:, None] - np.stack(each, axis=1)), axis=1)


def outside_ellipsoid(u: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Phase-space thresholding: which points (u, first, second difference) lie outside the robust ellipsoid; how far out all lie; the reach.

    The ellipsoid is turned in the plane of u and its second difference, which go against each other, by
    the angle of their robust correlation. Its half axes are the robust standard deviations along the
    turned axes times the universal threshold sqrt(2 ln n), the largest deviation to be expected of n
    normal values; where the source's own points lie farther out than normal ones, by their 90 %
    quantile, the reach grows with them. Shape and reach come from the points `kept`.
    """
    n = int(kept.sum())
    if n < 3:
        return np.zeros(len(u), bool), np.zeros(len(u)), np.inf
    d1 = np.gradient(u)
    d2 = np.gradient(d1)
    a, b = u[kept], d2[kept]
    calm = (np.abs(a) <= 3 * _scale(a)) & (np.abs(b) <= 3 * _scale(b))
    angle = np.arctan2((a[calm] * b[calm]).sum(), (a[calm] ** 2).sum())
    r = np.zeros(len(u))
    for part in (np.cos(angle) * u + np.sin(angle) * d2, d1, np.cos(angle) * d2 - np.sin(angle) * u):
        s = _scale(part[kept])
        r += (part / s) ** 2 if s > 0 else 0.0  # without scatter all points lie on the plane
    r = np.sqrt(r)
    reach = np.sqrt(2 * np.log(n)) * max(1.0, float(np.quantile(r[kept], 0.9)) / CHI_90)
    return r > reach, r, reach


def _outermost(r: np.ndarray) -> np.ndarray:
    """Points that lie as far out as any of the two before and after, whose differences they have a part in."""
    pad = np.concatenate([[0, 0], r, [0, 0]])
    return r >= np.max([pad[k : k + len(r)] for k in range(5)], axis=0)


def stuck_runs(p: np.ndarray) -> np.ndarray:
    """Which prices repeat the one before within a run much longer than the source otherwise shows.

    The chance that a run goes on is taken from the runs themselves, each counting once at each length,
    so that a few long ones don't make long runs look normal.
    """
    n = len(p)
    if n < 2:
        return np.zeros(n, bool)
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    lengths = np.diff(np.concatenate([starts, [n]]))
    reach = [int((lengths >= k).sum()) for k in range(1, 6)]
    chance = max((b + 1) / (a + 2) for a, b in zip(reach, reach[1:], strict=False) if a >= 30 or a == reach[0])
    need = SHORTEST_RUN if chance <= 0 else max(SHORTEST_RUN, 1 + np.log(len(lengths) / RUN_CHANCE) / -np.log(min(chance, 0.99)))
    out = np.repeat(lengths >= need, lengths)
    out[starts] = False
    return out


def faults(t: np.ndarray, price: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fault of each record of a group of sources that measure the same thing: 0 none, 1 spike, 2 stuck, 3 impossible; and its deviation in scatters.

    Records come ordered by time; source holds small numbers. A missing price must not be among them.

    A record's deviation is that from the median of its neighbours. In each round the points outside the
    ellipsoid of their source that lie farthest out are taken for spikes, if nothing speaks for them, and
    are replaced; rounds go on until a source has no new ones. What speaks for a point is that it lies on
    the level of its neighbours before or after it, or on the line between these - then it is a move to
    another level -, or on that of the other sources, who share the move.
    """
    n = len(price)
    kind, score = np.zeros(n, np.int8), np.zeros(n)
    if not n:
        return kind, score
    possible = np.isfinite(price) & (price > 0)
    kind[~possible] = 3
    of = [np.flatnonzero((source == k) & possible) for k in range(int(source.max()) + 1)]
    x = np.full(n, np.nan)
    x[possible] = np.log(price[possible])
    bias, scatter = np.zeros(len(of)), np.full(len(of), 1e-9)
    for i in of:
        kind[i[stuck_runs(price[i])]] = 2
    for k, i in enumerate(of):
        scatter[k] = max(_scale(np.diff(x[i])) / np.sqrt(2), 1e-9)
        peers = np.flatnonzero(possible & (kind != 2) & (source != k))
        i = i[kind[i] != 2]
        if len(i) and len(peers):
            bias[k] = np.median(x[i] - x[peers[np.clip(np.searchsorted(t[peers], t[i]), 0, len(peers) - 1)]]) / 2
    z, scale = x - bias[source], scatter[source]
    spike = np.zeros(n, bool)
    open_ = [k for k, i in enumerate(of) if len(i) >= 3]
    while open_:
        found, again = spike.copy(), []
        for k in open_:
            i = of[k]
            level = _levels(np.where(spike[i], np.nan, x[i]), t[i].astype(float))
            off = x[i, None] - level
            some = ~np.isnan(off).all(axis=1)
            near = np.zeros(len(i))
            near[some] = np.nanmin(np.abs(off[some]), axis=1)
            # replaced points have no deviation of their own in the next round
            u = np.where(spike[i] | np.isnan(off[:, 2]), 0.0, off[:, 2])
            live = ~spike[i] & (kind[i] != 2)
            outside, r, reach = outside_ellipsoid(u, live)
            c = np.flatnonzero(outside & live & _outermost(np.where(live, r, 0.0)))
            own_scale = max(_scale(u[live]), 1e-9)
            bar = np.maximum(OWN_SHARE * np.abs(u[c]), REACH_SHARE * reach * own_scale)
            c, bar = c[near[c] >= bar], bar[near[c] >= bar]
            peers = np.flatnonzero(possible & ~spike & (kind != 2) & (source != k))
            new = c[_peer_distance(z, t, i[c], peers, scale) >= bar]
            if len(new):
                found[i[new]] = True
                score[i[new]] = near[new] / own_scale
                again.append(k)
        spike, open_ = found, again
    kind[spike] = 1
    return kind, score


KINDS = ("spike", "stuck", "impossible")


def flagged(
    df: DataFrame, record_id: Column, series: Column, source: Column, seconds: Column, value: Column, block_rows: int = BLOCK_ROWS, margin_rows: int = MARGIN_ROWS, cell_seconds: int = 300
) -> DataFrame:
    """Faulty records: record_id, series, source, kind (spike, stuck, impossible), score.

    series is what is measured (a symbol), source who measures it (an exchange). A spike leaves, for a
    few records, the range in which its source scatters about its current level, by phase-space
    thresholding over value, first and second differences, round by round; moves that the series'
    other sources share are real. A stuck record
    repeats the value before it in a run much longer than its source otherwise shows. A value that is
    NaN, infinite or not positive is impossible. score is a spike's deviation in scatters of the source.

    The records of a series are cut along time into blocks of about block_rows, found from counts per
    cell of cell_seconds, and each block also sees margin_rows on either side: a series with a large
    part of all records is spread over many tasks, and none holds more than a block (or, beyond that,
    the records of one cell).

    Defined cases: a record with NULL series, source, time or value takes no part. Rows with the same
    record_id are one record. Records at one time are ordered by id. A source without other sources is
    judged by itself. An empty table gives no rows. Other columns of df are ignored.
    """
    rows = df.select(record_id.cast("bigint").alias("record_id"), series.cast("string").alias("series"), source.cast("string").alias("source"), seconds.cast("bigint").alias("t"), value.cast("double").alias("value"))
    rows = one_per_id(rows.where("series IS NOT NULL AND source IS NOT NULL AND t IS NOT NULL AND value IS NOT NULL"), "record_id")
    rows = rows.withColumn("cell", F.floor(F.col("t") / F.lit(cell_seconds)))
    by_cell = Window.partitionBy("series").orderBy("cell")
    before = F.coalesce(F.sum("n").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy("series", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)

    def block(c: Column) -> Column:
        return F.floor(c / F.lit(block_rows))

    cells = cells.select(
        "series", "cell", block(F.col("before")).alias("core"),
        block(F.greatest(F.col("before") - margin_rows, F.lit(0))).alias("low"),
        F.least(block(F.col("before") + margin_rows), block(F.max("before").over(Window.partitionBy("series")))).alias("high"),
    )
    spread = rows.join(cells, ["series", "cell"]).withColumn("block", F.explode(F.sequence("low", "high")))

    def judge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", "record_id"])
        kind, score = faults(g["t"].to_numpy(), g["value"].to_numpy(), pd.factorize(g["source"], sort=True)[0])
        out = g[["record_id", "series", "source"]].assign(kind=np.array(["", *KINDS], object)[kind], score=np.round(score, 3))
        return out[(kind > 0) & (g["core"] == g["block"]).to_numpy()]

    return spread.groupBy("series", "block").applyInPandas(judge, "record_id bigint, series string, source string, kind string, score double")
