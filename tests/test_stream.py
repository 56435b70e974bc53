import random
from datetime import UTC, datetime, timedelta
from queue import Queue

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillstone.catalog import reference
from rillstone.functions import scalar, trace
from rillstone.operators.aggregates import accumulated, aggregate, custom, percentile_at_index
from rillstone.operators.ranks import running
from rillstone.operators.windows import count_window, session, sliding, tumbling
from rillstone.store import shared_dir
from rillstone.stream import EventStream

T0 = datetime(2025, 1, 1, tzinfo=UTC)
MS0 = int(T0.timestamp() * 1000)


def stream(spark, *events):
    """Events (key, value, seconds)."""
    return EventStream.from_iter(spark, [(i, k, None if v is None else float(v), None if s is None else T0 + timedelta(seconds=s), []) for i, (k, v, s) in enumerate(events)])


def values(s):
    return [r["value"] for r in s.collect()]


def test_row_operators(spark):
    s = stream(spark, ("a", 1, 0), ("b", 2, 1), ("a", 3, 2), (None, None, 3))
    assert values(s.filter("value > 1")) == [2, 3]
    assert values(s.map("value * 10")) == [10, 20, 30, None]
    assert sorted(values(s.flat_map("CASE WHEN value > 1 THEN array(value, -value) END"))) == [-3, -2, 2, 3]
    assert rows(s.key_by("value > 1").group_by("key").agg(n=aggregate("count"))) == [(False, 1), (None, 1), (True, 2)]
    assert values(s.take(2)) == [1, 2] and values(s.skip(3)) == [None] and values(s.skip(9)) == []
    assert values(s.first()) == [1] and values(s.last()) == [None]
    assert s.count() == 4
    assert values(s.map_python(lambda x: x + 1, "double").filter("value > 3")) == [4]
    assert values(s.filter_python(lambda x: x == 2)) == [2]
    assert s.partitioned(3).count() == s.partitioned(3, "").count() == 4


def test_any_all_fold(spark):
    s, none = stream(spark, ("a", 1, 0), ("a", 2, 1)), EventStream.empty(spark)
    one = lambda df: df.collect()[0][0]
    assert one(s.any("value > 1")) and not one(s.any("value > 2")) and not one(none.any("true"))
    assert one(s.all("value > 0")) and not one(s.all("value > 1")) and one(none.all("false"))
    assert one(s.fold(F.lit(0.0), lambda acc, v: acc * 10 + v)) == 12
    assert none.count() == 0 and values(EventStream.from_values(spark, [5.0, 4.0])) == [5, 4]


def test_aggregates(spark):
    s = stream(spark, ("a", 4, 0), ("a", 1, 1), ("b", None, 2), ("a", 2, 3), ("a", 9, 4))
    v = F.col("value")
    got = s.group_by("key").agg(**{n: aggregate(n, v) for n in ("count", "sum", "avg", "min", "max", "median")})
    assert rows(got) == [("a", 4, 16.0, 4.0, 1.0, 9.0, 3.0), ("b", 0, None, None, None, None, None)]
    assert rows(s.filter("false").agg(n=aggregate("count"), s=aggregate("sum", v), z=aggregate("sum", v, empty_as_zero=True))) == [(0, None, 0.0)]
    assert rows(s.group_by("key").agg(having="n > 2", n=aggregate("count"))) == [("a", 4)]
    with pytest.raises(ValueError):
        aggregate("stddev", v)
    rng = random.Random(1)
    many = stream(spark, *[(rng.choice("ab"), rng.randint(0, 20), i) for i in range(101)])
    for key, p50, p99 in rows(percentile_at_index(many.df, ["key"], "value", {"p50": 0.5, "p99": 0.99})):
        own = sorted(r["value"] for r in many.collect() if r["key"] == key)
        assert p50 == own[int((len(own) - 1) * 0.5)] and p99 == own[int((len(own) - 1) * 0.99)]


def bounds(df, *cols):
    return sorted(((r["window_start"] - MS0) // 1000, (r["window_end"] - MS0) // 1000, *[r[c] for c in cols]) for r in df.collect())


def test_windows(spark):
    s = stream(spark, ("k", 1, 45), ("k", 2, 61), ("k", 3, 20))
    assert bounds(s.window(tumbling(60_000)).sum(), "sum") == [(0, 60, 4), (60, 120, 2)]
    assert bounds(s.window(tumbling(60_000, 15_000)).count(), "count") == [(15, 75, 3)]
    assert bounds(s.filter("value = 1").window(sliding(60_000, 30_000)).count(), "count") == [(0, 60, 1), (30, 90, 1)]
    assert bounds(s.filter("value = 1").window(sliding(60_000)).count(), "count") == [(0, 60, 1), (30, 90, 1)]
    assert bounds(s.window(sliding(30_000, 60_000)).count(), "count") == [(0, 30, 1), (60, 90, 1)]
    assert bounds(s.window(sliding(30_000, 60_000, 20_000)).count(), "count") == [(20, 50, 2)]
    assert bounds(s.window(session(25_000)).count(), "count") == [(20, 86, 3)]
    assert bounds(s.window(session(16_000)).count(), "count") == [(20, 36, 1), (45, 77, 2)]
    assert len(bounds(s.window(session(25_000, merge=False)).count())) == 3
    assert bounds(s.window(count_window(2)).sum(), "sum") == [(20, 45, 4), (61, 61, 2)]
    assert [values(s.window(tumbling(60_000)).to_events(n))[0] for n in ("avg", "min", "max", "median")] == [2, 1, 3, 2]
    before = stream(spark, ("k", 1, -MS0 // 1000 - 1))
    assert before.window(tumbling(60_000)).count().select("window_start").collect()[0][0] == -60_000
    assert EventStream.empty(spark).window(tumbling(1000)).count().count() == 0
    for bad in (lambda: tumbling(0), lambda: sliding(5, 0), lambda: session(-1), lambda: count_window(0)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_match_brute_force(spark, how):
    rng = random.Random(hash(how) % 100)
    make = lambda n: [(rng.choice(["a", "b", "c", "d", None]), i, rng.randint(0, 300)) for i in range(n)]
    left, right = [("l", 100, 5), *make(25)], [("r", 200, 5), *make(20)]
    for within in (None, 40, 0):
        for unmatched in ("row", "key"):
            if within is None and unmatched == "key":
                continue
            got = stream(spark, *left).join(stream(spark, *right), how, None if within is None else within * 1000, unmatched)
            pairs = [(a, b) for a in left for b in right if a[0] is not None and a[0] == b[0] and (within is None or abs(a[2] - b[2]) <= within)]
            want = [(a[0], a[1], b[1]) for a, b in pairs]
            keys = {x[0] for x in right}, {x[0] for x in left}
            lone = lambda x, side, other: x not in side and (unmatched == "row" or x[0] is None or x[0] not in other)
            if how in ("left", "outer"):
                want += [(a[0], a[1], None) for a in left if lone(a, [p[0] for p in pairs], keys[0])]
            if how in ("right", "outer"):
                want += [(b[0], None, b[1]) for b in right if lone(b, [p[1] for p in pairs], keys[1])]
            assert rows(got.df.select("key", "left_value", "right_value")) == sorted(((k, None if a is None else float(a), None if b is None else float(b)) for k, a, b in want), key=repr), (within, unmatched)


def test_join_results(spark):
    j = stream(spark, ("a", 1, 0), ("b", 2, 5)).join(stream(spark, ("a", 3, 9), ("c", 4, 1)), "outer")
    assert rows(j.as_tuples().select("value")) == [("(1.0, 3.0)",), ("(2.0, null)",), ("(null, 4.0)",)]
    assert rows(j.sum_values().select("value")) == [(2.0,), (4.0,), (4.0,)]
    assert rows(j.coalesce_left().select("value")) == [(1.0,), (2.0,), (4.0,)]
    assert rows(j.coalesce_right().select("value")) == [(2.0,), (3.0,), (4.0,)]
    assert rows(j.combine(lambda a, b: a - b).where("value IS NOT NULL").select("value", "ts")) == [(-2.0, (T0 + timedelta(seconds=9)).replace(tzinfo=None))]
    none = stream(spark, (None, 1, 0))
    assert none.join(none).count() == 0 and none.join(none, null_safe=True).count() == 1
    with pytest.raises(ValueError):
        none.join(none, "sideways")


def test_joins_of_whole_tables(spark, tmp_path):
    """Keys without partner on both sides, and rows of all remainders of their ids."""
    spark.createDataFrame([(1, 1, 10.0), (2, 3, 20.0), (5, 3, 50.0), (7, 8, 70.0), (10, 9, 100.0)], "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (6, 6.0), (8, 8.0)], "c_custkey bigint, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = lambda name: rows(reference.QUERIES[f"join_{name}"](spark, str(tmp_path)))
    both = [(1, 10.0, 1.0), (3, 20.0, 3.0), (3, 50.0, 3.0), (8, 70.0, 8.0)]
    left, right = [(9, 100.0, None)], [(2, None, 2.0), (6, None, 6.0)]
    for how, want in (("inner", both), ("left", both + left), ("right", both + right), ("outer", both + left + right)):
        assert got(how) == sorted(want, key=repr), how
    every = both + left + right
    assert got("sum_values") == sorted(((k, (a or 0) + (b or 0)) for k, a, b in every), key=repr)
    assert got("coalesce_left") == sorted(((k, a or b) for k, a, b in every), key=repr)
    assert got("coalesce_right") == sorted(((k, b or a) for k, a, b in every), key=repr)
    assert got("combine") == sorted(((k, a - b) for k, a, b in both), key=repr)


def test_null_safe_join_of_whole_table(spark, tmp_path):
    """Events of all remainders of their ids take part, those without a key as one group."""
    e = [(1, 7, "click"), (2, 57, "error"), (3, 7, "view"), (4, 50, "click"), (5, 9, "view"), (6, 9, "signup")]
    spark.createDataFrame([(*x, 1.0, T0) for x in e], "event_id bigint, user_id bigint, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(reference.QUERIES["join_null_safe"](spark, str(tmp_path))) == [(1, 2), (2, 2), (3, 3), (4, 3), (5, 3), (6, 1)]


def test_tuples_of_whole_table(spark, tmp_path):
    """Users of all remainders of their ids, with signups only, errors only and both."""
    e = [(1, 1, "signup"), (2, 1, "error"), (3, 5, "signup"), (4, 7, "error"), (5, 12, "signup"), (6, 12, "error"), (7, 12, "error"), (8, 12, "view")]
    spark.createDataFrame([(*x, 1.0, T0) for x in e], "event_id bigint, user_id bigint, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(reference.QUERIES["join_as_tuples"](spark, str(tmp_path))) == sorted([(1, "(1, 2)"), (5, "(3, null)"), (7, "(null, 4)"), (12, "(5, 6)"), (12, "(5, 7)")], key=repr)


def test_distinct_by(spark):
    s = stream(spark, ("t1", 2, 5), ("t1", 1, 3), (None, 7, 1), (None, 7, 1))
    assert sorted(values(s.distinct_by("key"))) == [1, 7, 7]


def test_scalar(spark):
    df = spark.createDataFrame([("héllo", -2.5, 7, 0), (None, None, None, None), (" \tx \n", 2.5, -7, 2)], "s string, x double, a bigint, b bigint")
    s, x, a, b = (F.col(c) for c in "sxab")
    got = df.select(
        scalar.substring(s, -3, 2), scalar.substring(s, 2), scalar.substring(s, 2, 0), scalar.length(s), scalar.byte_length(s), scalar.trim(s), scalar.round_half_away(x), scalar.floor(x),
        scalar.ceiling(x), scalar.divide(x, b), scalar.divide_whole(a, b), scalar.display(x), scalar.as_int(x), scalar.as_float(a),
    ).collect()
    assert tuple(got[0]) == ("hé", "éllo", "éllo", 5, 6, "héllo", -3, -3, -2, None, None, "-2.5", -2, 7.0)
    assert tuple(got[1])[:11] == (None,) * 11 and got[1][11] == "null"
    assert tuple(got[2])[5:] == ("x", 3, 2, 3, 1.25, -3, "2.5", 2, -7.0)
    h = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],), ([],), (None,)], "h array<struct<k: string, v: string>>")
    assert [r[0] for r in h.select(scalar.first_header(F.col("h"), "a")).collect()] == ["1", None, None]


class Mean:
    def create(self):
        return 0.0, 0

    def add(self, state, values):
        return state[0] + values.sum(), state[1] + values.count()

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def result(self, state):
        return state[0] / state[1] if state[1] else None


def test_custom_aggregates(spark):
    s = stream(spark, *[(k, v, 0) for k, v in [("a", 1), ("a", 2), ("a", 6), ("b", None), (None, 4)]])
    assert rows(accumulated(s.df.repartition(3), ["key"], "value", Mean(), "double")) == [("a", 3.0), ("b", None), (None, 4.0)]
    assert accumulated(s.df.where("false"), ["key"], "value", Mean(), "double").count() == 0
    spread = custom(lambda v: v.max() - v.min(), "double")
    assert rows(s.filter("key = 'a'").group_by("key").agg(x=spread(F.col("value")))) == [("a", 5.0)]


def test_fold_in_shares(spark):
    e = EventStream.from_iter(spark, [(i, "a" if i % 3 else "b", float(i), T0 + timedelta(seconds=i), None) for i in range(500)])
    step = lambda acc, v: acc + v
    whole = rows(e.fold(F.lit(0.0), step, ["key"]))
    assert rows(e.fold(F.lit(0.0), step, ["key"], merge=step, parts=4)) == whole == [("a", 83167.0), ("b", 41583.0)]
    assert rows(e.fold(F.lit(0.0), step, merge=step)) == [(124750.0,)]


def test_python_flat_map_sink_and_source(spark, tmp_path):
    e = EventStream.from_iter(spark, [(i, "a", float(i), T0, None) for i in range(4)])
    assert sorted(r["value"] for r in e.flat_map_python(lambda v: [v] * int(v), "double").df.collect()) == [1.0, 2.0, 2.0, 3.0, 3.0, 3.0]
    e.sink(f"{tmp_path}/out", "parquet")
    again = EventStream.from_source(spark.read.parquet(f"{tmp_path}/out"))
    assert again.count() == 4
    with pytest.raises(ValueError):
        EventStream.from_source(spark.readStream.schema(again.df.schema).parquet(f"{tmp_path}/out")).sink(f"{tmp_path}/more")
    q = EventStream.from_source(spark.readStream.schema(again.df.schema).parquet(f"{tmp_path}/out")).sink(f"{tmp_path}/more", "parquet", checkpoint=f"{tmp_path}/log")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/more").count() == 4


def test_shared_folder_on_a_cluster():
    class Conf(dict):
        set = dict.__setitem__

    def session(master, conf):
        return type("S", (), {"conf": conf, "sparkContext": type("C", (), {"master": master})})

    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077", Conf()))
    with pytest.raises(RuntimeError):
        shared_dir(session("local-cluster[2,1,1024]", Conf()))
    assert shared_dir(session("yarn", Conf({"spark.checkpoint.dir": "/shared"}))) == "/shared"
    conf = Conf()
    assert shared_dir(session("local[4]", conf)) == shared_dir(session("local[4]", conf))


def test_running_sums_of_large_keys(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randint(1, 5)) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, t int, w bigint").repartition(5)
    want, upto = {}, {}
    for k, t, w in data:
        upto[k] = upto.get(k, 0) + w
        want[t] = upto[k]
    assert {r["t"]: r["__upto"] for r in running(df, ["k"], ["t"], F.col("w")).collect()} == want
    assert {r["t"]: r["__upto"] for r in running(df, [], ["t"]).collect()} == {i: i + 1 for i in range(3000)}
    assert running(df.where("false"), ["k"], ["t"]).count() == 0


def test_channels_watermarks_and_sinks_of_ones_own(spark, tmp_path):
    q = Queue()
    for x in [(1, "a", 1.0, T0, None), (2, "b", 2.0, T0, None), None]:
        q.put(x)
    e = EventStream.from_channel(spark, q)
    assert values(e) == [1.0, 2.0]
    seen = []
    e.sink_with(lambda df, n: seen.append((n, df.count())))
    e.df.write.parquet(f"{tmp_path}/in")
    s = EventStream.from_source(spark.readStream.schema(e.df.schema).parquet(f"{tmp_path}/in")).with_watermark("1 second", "least(ts, TIMESTAMP '2024-01-01')")
    s.sink_with(lambda df, n: seen.append((n, df.count(), df.select(F.year("ts")).first()[0])), f"{tmp_path}/log").awaitTermination()
    assert seen == [(0, 2), (0, 2, 2024)]


def test_trace_context(spark):
    context = f"00-{'ab' * 16}-{'cd' * 8}-01"
    data = [(1, [("x", "1"), ("traceparent", context)]), (2, None), (3, [("traceparent", "nonsense")]), (4, [("traceparent", f"00-{'0' * 32}-{'cd' * 8}-01")])]
    df = spark.createDataFrame(data, "id int, headers array<struct<k: string, v: string>>")
    h = F.col("headers")
    read = {r[0]: tuple(r)[1:] for r in df.select("id", trace.trace_id(h), trace.span_id(h), trace.sampled(h)).collect()}
    assert read == {1: ("ab" * 16, "cd" * 8, True), 2: (None,) * 3, 3: (None,) * 3, 4: (None,) * 3}
    again = df.select("id", trace.traced(h, F.col("id"), "filter").alias("headers"))
    one, two = ({r[0]: tuple(r)[1:] for r in again.select("id", trace.trace_id(h), trace.span_id(h), F.size(h)).collect()} for _ in range(2))
    assert one == two and one[1][0] == "ab" * 16 and one[1][1] != "cd" * 8 and one[1][2] == 2 and one[2][2] == 1
    assert len({v[0] for v in one.values()}) == 4
