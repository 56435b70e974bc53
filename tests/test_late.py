import random

from conftest import rows

from rillstone.operators import late


def frames(spark, events, configs, slide=False):
    e = spark.createDataFrame([(*r, "clash") for r in events], "event_id bigint, key string, value bigint, ms bigint, arrival_seq bigint, pane string")
    c = spark.createDataFrame(configs, "key string, window_ms bigint, allowed_lateness bigint, max_out_of_orderness bigint" + (", slide_ms bigint" if slide else ""))
    return e, c


def brute(events, configs):
    """Outcome of each record by window, and the emissions, one record at a time."""
    seen, top, panes, outcomes, emitted = set(), {}, {}, [], []
    conf = {c[0]: c for c in configs}
    for i, k, v, ms, _ in sorted((e for e in events if e[1] is not None and e[3] is not None), key=lambda e: e[4]):
        if i in seen:
            continue
        seen.add(i)
        if k not in conf or not conf[k][1]:
            continue
        _, wide, lateness, disorder, *rest = conf[k]
        slide = rest[0] if rest and rest[0] else wide
        lateness, disorder = 0 if lateness is None else lateness, 1000 if disorder is None else disorder
        mark = top[k] - disorder if k in top else None
        s = ms // slide * slide
        while s + wide > ms:
            end = s + wide
            if mark is not None and mark > end + lateness:
                outcomes.append((i, "dropped"))
            else:
                p = panes.setdefault((k, s, end), [0, 0, 0])
                p[0] += 1
                p[1] += v is not None
                p[2] += v or 0
                if mark is not None and mark >= end:
                    outcomes.append((i, "corrected"))
                    emitted.append((k, s, p[0], p[2] if p[1] else None))
            s -= slide
        top[k] = max(top.get(k, ms), ms)
    return sorted(outcomes, key=repr), panes, emitted


def data(rng, n=600):
    out, now = [], 0
    for seq in range(n):
        now += rng.randint(0, 400)
        ms = rng.choice([now, now, now - rng.randint(0, 3000), now - rng.randint(0, 90_000), now + 500, None])
        out.append((rng.randint(1, n), rng.choice(["a", "b", "c", None]), rng.choice([None, 1, 5, -2]), ms, seq))
    first = {}
    return [(*first.setdefault(r[0], r)[:4], r[4]) for r in out]  # copies have the same content


CONFIGS = [("a", 5000, 20_000, 1000), ("b", 2000, None, None), ("c", 7000, 0, 4000), ("d", None, 0, 0)]


def test_outcomes_and_windows(spark):
    events = data(random.Random(1))
    r = late.classified(*frames(spark, events, CONFIGS), seq_block_bits=5)
    outcomes, panes, emitted = brute(events, CONFIGS)
    assert rows(late.late_records(r).select("event_id", "outcome")) == outcomes
    got = {(x["key"], x["window_start"], x["window_end"]): [x["n"], x["n_values"], x["total"] or 0] for x in late.windows(r).collect()}
    assert got == panes
    revisions = [(x["key"], x["window_start"], x["n"], x["total"]) for x in late.window_emissions(r).where("revision > 0").collect()]
    assert sorted(revisions, key=repr) == sorted(emitted, key=repr)


def test_sliding_windows(spark):
    events = data(random.Random(2))
    configs = [("a", 6000, 10_000, 1000, 2000), ("b", 5000, 5000, 500, 3000), ("c", 4000, 0, 100, None)]
    r = late.classified(*frames(spark, events, configs, slide=True), seq_block_bits=4)
    outcomes, panes, _ = brute(events, configs)
    assert rows(late.late_records(r).where("outcome <> 'ontime'").select("event_id", "outcome")) == outcomes
    got = {(x["key"], x["window_start"], x["window_end"]): [x["n"], x["n_values"], x["total"] or 0] for x in late.windows(r).collect()}
    assert got == panes


def test_limits_and_empty(spark):
    # watermark = end is late, = end + lateness is the last to be corrected
    events = [(1, "a", 1, 100, 1), (2, "a", 1, 2000, 2), (3, "a", 1, 50, 3), (4, "a", 1, 2001, 4), (5, "a", 1, 60, 5)]
    r = late.classified(*frames(spark, events, [("a", 1000, 1000, 0)]))
    assert rows(late.late_records(r).select("event_id", "outcome")) == [(3, "corrected"), (5, "dropped")]
    r = late.classified(*frames(spark, [], CONFIGS))
    assert late.windows(r).count() == 0 and late.late_records(r).count() == 0
