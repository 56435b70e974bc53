"""Queries for the operators of event streams, over the tables events, orders, customer, lineitem, nation and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.cleaning import one_per_id
from rillstone.functions import scalar
from rillstone.operators.aggregates import accumulated, aggregate, percentile_at_index
from rillstone.operators.windows import count_window, session, sliding, tumbling
from rillstone.plans import dialect
from rillstone.store import table
from rillstone.stream import EventStream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000
#: Epoch ms of an event in DuckDB, floored as in Spark.
MS = "(epoch_us(ts) // 1000)"


def query(sql: str | None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def events(spark: SparkSession, sf_dir: str, key: str = "event_type") -> EventStream:
    """The table events with a time that windows and watermarks take (the session's time zone is meant to be UTC)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.expr("timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)))"))
    return EventStream(e, key, "value", "ts", "event_id")


def sql_on_events(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: dialect.run(spark, text, events=events(spark, sf_dir).df)


def r4(c: str) -> F.Column:
    return F.round(c, 4).alias(c)


# filters and projections
@query("SELECT event_id, value FROM events WHERE value > 100")
def filter_gt(spark, d):
    return events(spark, d).filter("value > 100").df.select("event_id", "value")


@query("SELECT event_id FROM events WHERE (value > 50 AND event_type = 'click') OR user_id < 10")
def filter_and_or(spark, d):
    return events(spark, d).filter(((F.col("value") > 50) & (F.col("event_type") == "click")) | (F.col("user_id") < 10)).df.select("event_id")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase'")
def filter_eq_str(spark, d):
    return events(spark, d).filter(F.col("event_type") == "purchase").df.select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'view'")
def filter_ne(spark, d):
    return events(spark, d).filter(F.col("event_type") != "view").df.select("event_id", "event_type")


@query("SELECT event_id, value FROM events WHERE value >= 10 AND value <= 20")
def filter_ge_le(spark, d):
    return events(spark, d).filter("value >= 10 AND value <= 20").df.select("event_id", "value")


@query("SELECT event_id AS id, event_type AS kind FROM events")
def project_alias(spark, d):
    return events(spark, d).df.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))


@query("SELECT * FROM nation")
def select_star(spark, d):
    return table(spark, d, "nation").select("*")


@query("SELECT event_id, value * 2 AS value FROM events")
def map_value_times_two(spark, d):
    return events(spark, d).map("value * 2").df.select("event_id", "value")


@query("SELECT event_id, value * 2 AS value FROM events WHERE event_id % 2 = 0")
def filter_map(spark, d):
    return events(spark, d).filter("event_id % 2 = 0").map("value * 2").df.select("event_id", "value")


@query(
    """SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[ \\t\\n\\r]+')) AS word FROM documents)
    WHERE length(word) >= 3 GROUP BY word"""
)
def flat_map_words(spark, d):
    docs = EventStream(table(spark, d, "documents").select("doc_id", F.lower("text").alias("value")), "doc_id", "value", "ts", "doc_id")
    words = docs.flat_map(F.split("value", "[ \\t\\n\\r]+")).filter("length(value) >= 3").df
    return words.groupBy(F.col("value").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id")
def key_by_count(spark, d):
    return events(spark, d).key_by("user_id").group_by("key").agg(n=aggregate("count"))


@query("SELECT event_id, floor(value)::BIGINT % 7 AS key FROM events")
def key_by_expression(spark, d):
    return events(spark, d).key_by("CAST(floor(value) AS BIGINT) % 7").df.select("event_id", "key")


# order and limits
@query("SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 25")
def take_n(spark, d):
    return events(spark, d).take(25).df.select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY ts, event_id OFFSET 9900")
def skip_n(spark, d):
    return events(spark, d).skip(9900).df.select("event_id", "value")


@query("SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 1")
def first_event(spark, d):
    return events(spark, d).first().df.select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def last_event(spark, d):
    return events(spark, d).last().df.select("event_id", "user_id")


@query("SELECT coalesce(bool_or(value > 500), false) AS any FROM events")
def any_match(spark, d):
    return events(spark, d).any("value > 500")


@query("SELECT coalesce(bool_and(value >= 0), true) AS all FROM events")
def all_match(spark, d):
    return events(spark, d).all("value >= 0")


@query("SELECT count(*) AS n FROM events")
def count_events(spark, d):
    return events(spark, d).agg(n=aggregate("count"))


@query("SELECT event_type, round(sum(value), 4) AS fold FROM events GROUP BY event_type")
def fold_sum(spark, d):
    return events(spark, d).fold(F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)), ["event_type"]).select("event_type", r4("fold"))


@query("SELECT event_type, event_id, value FROM events ORDER BY event_type DESC, value, event_id LIMIT 50")
def order_by_multi(spark, d):
    return events(spark, d).df.select("event_type", "event_id", "value").orderBy(F.desc("event_type"), "value", "event_id").limit(50)


@query("SELECT event_id FROM events ORDER BY value, event_id LIMIT 20 OFFSET 40")
def limit_offset(spark, d):
    return events(spark, d).df.orderBy("value", "event_id").offset(40).limit(20).select("event_id")


@query("SELECT event_id FROM events ORDER BY event_id OFFSET 100000000")
def offset_beyond_end(spark, d):
    return events(spark, d).df.orderBy("event_id").offset(100_000_000).select("event_id")


@query("SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 10")
def top_k(spark, d):
    return events(spark, d).group_by("user_id").agg(total=F.sum("value")).orderBy(F.desc("total"), "user_id").limit(10).select("user_id", r4("total"))


# aggregates
SIX = {"n": ("count", None), "total": ("sum", "{}"), "average": ("avg", "{}"), "least": ("min", "{}"), "most": ("max", "{}"), "middle": ("median", "{}")}


def six(column: str) -> dict[str, F.Column]:
    out = {n: aggregate(f, F.col(column) if c else None) for n, (f, c) in SIX.items()}
    return {n: F.round(c, 4) if n != "n" else c for n, c in out.items()}


def six_sql(column: str) -> str:
    return ", ".join("count(*) AS n" if n == "n" else f"round({f}({column}), 4) AS {n}" for n, (f, _) in SIX.items())


@query(f"SELECT {six_sql('value')} FROM events")
def agg_global_six(spark, d):
    return events(spark, d).agg(**six("value"))


@query(f"SELECT l_returnflag, l_linestatus, {six_sql('l_quantity')} FROM lineitem GROUP BY ALL")
def agg_group_six(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*[c.alias(n) for n, c in six("l_quantity").items()])


@query("SELECT count(*) AS n, sum(value) AS total, avg(value) AS average, min(value) AS least, median(value) AS middle, coalesce(sum(value), 0.0) AS total_or_zero FROM events WHERE value < -1e9")
def agg_empty_input(spark, d):
    e = events(spark, d).filter("value < -1e9")
    v = F.col("value")
    return e.agg(n=aggregate("count"), total=aggregate("sum", v), average=aggregate("avg", v), least=aggregate("min", v), middle=aggregate("median", v), total_or_zero=aggregate("sum", v, empty_as_zero=True))


@query("SELECT count(*) AS all_rows, count(CASE WHEN value > 50 THEN value END) AS with_value FROM events")
def count_field_vs_star(spark, d):
    return events(spark, d).agg(all_rows=aggregate("count"), with_value=aggregate("count", F.when(F.col("value") > 50, F.col("value"))))


@query("SELECT user_id, count(*) AS event_count FROM events GROUP BY user_id HAVING count(*) > 12")
def having_alias(spark, d):
    return events(spark, d).group_by("user_id").agg(having="event_count > 12", event_count=aggregate("count"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING avg(value) > 50")
def having_agg_expr(spark, d):
    return sql_on_events("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type HAVING AVG(value) > 50")(spark, d)


@query("SELECT DISTINCT event_type FROM events")
def group_without_aggregate(spark, d):
    return sql_on_events("SELECT event_type FROM events GROUP BY event_type")(spark, d)


@query(
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
    SELECT event_type, v[floor((len(v) - 1) * 0.5)::INT + 1] AS p50, v[floor((len(v) - 1) * 0.95)::INT + 1] AS p95, v[floor((len(v) - 1) * 0.99)::INT + 1] AS p99 FROM s"""
)
def percentile_index(spark, d):
    return percentile_at_index(events(spark, d).df, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(
    """WITH h AS (SELECT node_id, unnest(samples) AS v FROM (SELECT histogram_id, any_value(node_id) AS node_id, any_value(samples) AS samples FROM latency_histograms GROUP BY histogram_id)),
    s AS (SELECT node_id, list_sort(list(v)) AS l, count(v) AS n, sum(v)::BIGINT AS total, min(v) AS least, max(v) AS most FROM h WHERE v IS NOT NULL GROUP BY node_id)
    SELECT node_id, n, total, least, most, l[floor((n - 1) * 0.5)::INT + 1] AS p50, l[floor((n - 1) * 0.95)::INT + 1] AS p95, l[floor((n - 1) * 0.99)::INT + 1] AS p99 FROM s"""
)
def latency_by_node(spark, d):
    """Latencies of all operators of a node, from the samples each of them keeps."""
    h = one_per_id(table(spark, d, "latency_histograms").select("histogram_id", "node_id", "samples"), "histogram_id").select("node_id", F.explode("samples").alias("v")).where("v IS NOT NULL")
    sums = h.groupBy("node_id").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
    p = percentile_at_index(h, ["node_id"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed("node_id", "n_id")
    return sums.join(p, F.col("node_id").eqNullSafe(F.col("n_id"))).drop("n_id")


class Spread:
    """The range of a group's values, in parts."""

    def create(self):
        return None

    def add(self, state, values):
        v = values.dropna()
        return state if v.empty else self.merge(state, (float(v.min()), float(v.max())))

    def merge(self, a, b):
        return a if b is None else b if a is None else (min(a[0], b[0]), max(a[1], b[1]))

    def result(self, state):
        return None if state is None else state[1] - state[0]


@query("SELECT event_type, round(max(value) - min(value), 4) AS result FROM events GROUP BY event_type")
def agg_custom(spark, d):
    return accumulated(events(spark, d).df, ["event_type"], "value", Spread(), "double").select("event_type", r4("result"))


@query(f"SELECT event_type, count(*) AS n, start FROM (SELECT event_type, {MS} // {HOUR} * {HOUR} + unnest([0, {HOUR}]) AS start FROM events) GROUP BY ALL")
def window_custom(spark, d):
    """Windows of one's own: each event in its hour and in the next."""
    ms = F.unix_millis("ts")
    hour = ms - F.pmod(ms, F.lit(HOUR))
    windows = F.array(*[F.struct((hour + k * HOUR).alias("start"), (hour + (k + 1) * HOUR).alias("end")) for k in (0, 1)])
    return events(spark, d).window_by(windows).agg(n=aggregate("count")).select("event_type", "n", F.col("window.start").alias("start"))


# joins
def _orders(spark, d):
    o = table(spark, d, "orders")
    return EventStream(o.select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.lit(None).cast("timestamp").alias("ts")), tie="o_orderkey")


def _customers(spark, d):
    c = table(spark, d, "customer")
    return EventStream(c.select("c_custkey", F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit(None).cast("timestamp").alias("ts")), tie="c_custkey")


_O, _C = "(SELECT o_custkey AS key, o_totalprice AS value FROM orders)", "(SELECT c_custkey AS key, c_acctbal AS value FROM customer)"


def _join(how: str, kind: str) -> None:
    def f(spark, d):
        return _orders(spark, d).join(_customers(spark, d), how).df.select("key", "left_value", "right_value")

    f.__name__ = f"join_{how}"
    query(f"SELECT coalesce(o.key, c.key) AS key, o.value AS left_value, c.value AS right_value FROM {_O} o {kind} JOIN {_C} c ON o.key = c.key")(f)


for _how, _kind in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _join(_how, _kind)

_PAIRS = f"{_O} o FULL JOIN {_C} c ON o.key = c.key"


@query(f"SELECT coalesce(o.key, c.key) AS key, round(coalesce(o.value::DOUBLE, 0) + coalesce(c.value::DOUBLE, 0), 4) AS value FROM {_PAIRS}")
def join_sum_values(spark, d):
    return _orders(spark, d).join(_customers(spark, d), "outer").sum_values().select("key", r4("value"))


@query(f"SELECT coalesce(o.key, c.key) AS key, coalesce(o.value, c.value) AS value FROM {_PAIRS}")
def join_coalesce_left(spark, d):
    return _orders(spark, d).join(_customers(spark, d), "outer").coalesce_left().select("key", "value")


@query(f"SELECT coalesce(o.key, c.key) AS key, coalesce(c.value, o.value) AS value FROM {_PAIRS}")
def join_coalesce_right(spark, d):
    return _orders(spark, d).join(_customers(spark, d), "outer").coalesce_right().select("key", "value")


@query(f"SELECT o.key AS key, o.value - c.value AS value FROM {_O} o JOIN {_C} c ON o.key = c.key")
def join_combine(spark, d):
    return _orders(spark, d).join(_customers(spark, d)).combine(lambda a, b: a - b).select("key", "value")


def _users(spark, d, kind: str) -> EventStream:
    e = events(spark, d, "user_id").filter(F.col("event_type") == kind)
    return EventStream(e.df.select("user_id", F.col("event_id").alias("value"), "ts", "event_id"), "user_id", "value", "ts", "event_id")


@query(
    """SELECT coalesce(a.user_id, b.user_id) AS key, '(' || coalesce(a.event_id::VARCHAR, 'null') || ', ' || coalesce(b.event_id::VARCHAR, 'null') || ')' AS value
    FROM (SELECT * FROM events WHERE event_type = 'signup') a FULL JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id"""
)
def join_as_tuples(spark, d):
    return _users(spark, d, "signup").join(_users(spark, d, "error"), "outer").as_tuples().select("key", "value")


_K = "CASE WHEN event_type <> 'view' THEN nullif(user_id % 50, 0) END"


@query(f"SELECT a.event_id AS left_value, b.n AS right_value FROM (SELECT event_id, {_K} AS k FROM events) a JOIN (SELECT {_K} AS k, count(*) AS n FROM events GROUP BY ALL) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark, d):
    """Each event with the number of events of its key; a fifth and more of all have none. Their pairs would be of quadratic size."""
    e = events(spark, d).key_by(_K).map("event_id")
    n = e.group_by("key").agg(value=aggregate("count")).withColumn("ts", F.lit(None).cast("timestamp"))
    return e.join(EventStream(n, tie="key"), null_safe=True).df.select("left_value", "right_value")


BOUND = 10 * HOUR


def _near(kind: str) -> str:
    return f"""FROM (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type = 'click') a {kind} JOIN (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase') b
    ON a.user_id = b.user_id AND abs(a.us - b.us) <= {BOUND * 1000}"""


_BOTH = "coalesce(a.user_id, b.user_id) AS key, a.event_id AS left_value, b.event_id AS right_value, greatest(coalesce(a.us, b.us), coalesce(b.us, a.us)) AS us"


def _interval(spark, d, how: str, unmatched: str = "row") -> DataFrame:
    out = _users(spark, d, "click").join(_users(spark, d, "purchase"), how, BOUND, unmatched)
    return out.df.select("key", "left_value", "right_value", F.unix_micros("ts").alias("us"))


@query(f"SELECT {_BOTH} {_near('')}")
def join_interval_inner(spark, d):
    return _interval(spark, d, "inner")


@query(f"SELECT {_BOTH} {_near('LEFT')}")
def join_interval_left(spark, d):
    return _interval(spark, d, "left")


@query(f"SELECT {_BOTH} {_near('RIGHT')}")
def join_interval_right(spark, d):
    return _interval(spark, d, "right")


@query(f"SELECT {_BOTH} {_near('FULL')}")
def join_interval_outer(spark, d):
    return _interval(spark, d, "outer")


@query(f"SELECT {_BOTH} {_near('LEFT')} WHERE b.event_id IS NOT NULL OR a.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def join_interval_left_keylevel(spark, d):
    return _interval(spark, d, "left", "key")


@query("SELECT a.n_name AS n_name, count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey GROUP BY a.n_name")
def join_theta_lt(spark, d):
    n = table(spark, d, "nation")
    text = "SELECT a.n_name AS n_name, COUNT(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey GROUP BY a.n_name"
    return dialect.run(spark, text, nation=n)


_THREE = "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"


def _tables(spark, d, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in names}


@query(f"SELECT o.o_orderkey AS o_o_orderkey, n.n_name AS nation {_THREE} WHERE o.o_totalprice > 100000")
def join_three_way(spark, d):
    return dialect.run(spark, f"SELECT o.o_orderkey, n.n_name AS nation {_THREE} WHERE o.o_totalprice > 100000", **_tables(spark, d, "orders", "customer", "nation"))


@query(f"SELECT n.n_name AS nation, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total {_THREE} GROUP BY n.n_name HAVING count(*) > 10")
def join_group_agg(spark, d):
    text = f"SELECT n.n_name AS nation, COUNT(*) AS orders, round(SUM(o.o_totalprice), 2) AS total {_THREE} GROUP BY n.n_name HAVING orders > 10"
    return dialect.run(spark, text, **_tables(spark, d, "orders", "customer", "nation"))


# windows
def start(size: int, offset: int = 0) -> str:
    return f"(({MS} - {offset}) // {size} * {size} + {offset})"


@query(f"SELECT event_type, {start(HOUR)} AS window_start, {start(HOUR)} + {HOUR} AS window_end, {six_sql('value')} FROM events GROUP BY ALL")
def tumbling_six(spark, d):
    return events(spark, d).window(tumbling(HOUR)).agg(**six("value"))


@query(f"SELECT user_id % 3 AS key, {start(HOUR, 900_000)} AS window_start, {start(HOUR, 900_000)} + {HOUR} AS window_end, count(*) AS count FROM events GROUP BY ALL")
def tumbling_offset(spark, d):
    return events(spark, d).key_by("user_id % 3").window(tumbling(HOUR, 900_000)).count()


@query(f"SELECT event_type, {start(HOUR)} AS window_start, {start(HOUR)} + {HOUR} AS window_end, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 4")
def tumbling_group_having(spark, d):
    return events(spark, d).window(tumbling(HOUR)).agg(having="n > 4", n=aggregate("count"))


def slides(size: int, slide: int, offset: int = 0) -> str:
    low = f"(({MS} - {offset} - {size}) // {slide} * {slide} + {slide} + {offset})"
    return f"(SELECT *, unnest(generate_series({low}, {MS}, {slide})) AS window_start FROM events)"


@query(f"SELECT event_type, window_start, window_start + {HOUR} AS window_end, round(sum(value), 4) AS sum FROM {slides(HOUR, HOUR // 2)} GROUP BY ALL")
def sliding_half(spark, d):
    return events(spark, d).window(sliding(HOUR)).sum().withColumn("sum", F.round("sum", 4))


@query(f"SELECT event_type, window_start, window_start + {HOUR} AS window_end, count(*) AS count FROM {slides(HOUR, HOUR // 3, 60_000)} GROUP BY ALL")
def sliding_slide_offset(spark, d):
    return events(spark, d).window(sliding(HOUR, HOUR // 3, 60_000)).count()


@query(f"SELECT event_type, window_start, window_start + {HOUR} AS window_end, count(*) AS count FROM {slides(HOUR, 3 * HOUR)} GROUP BY ALL")
def sliding_with_gaps(spark, d):
    return events(spark, d).window(sliding(HOUR, 3 * HOUR)).count()


@query(
    """WITH m AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM m)
    SELECT user_id, count(*) AS count, min(us) // 1000 AS window_start, (max(us) + 1800000000) // 1000 AS window_end FROM s GROUP BY user_id, nth"""
)
def session_by_user(spark, d):
    return events(spark, d, "user_id").window(session(HOUR // 2)).count()


@query(f"SELECT user_id, count(*) AS count, {MS} AS window_start, (epoch_us(ts) + 1800000000) // 1000 AS window_end FROM events GROUP BY user_id, ts")
def session_unmerged(spark, d):
    return events(spark, d, "user_id").window(session(HOUR // 2, merge=False)).count()


@query(f"SELECT event_type, {start(HOUR * 6)} AS window_start, {start(HOUR * 6)} + {HOUR * 6} AS window_end, round(median(value), 4) AS median FROM events GROUP BY ALL")
def window_median(spark, d):
    return events(spark, d).window(tumbling(HOUR * 6)).median().withColumn("median", F.round("median", 4))


@query(f"SELECT event_type, {start(HOUR)} AS window_start, {start(HOUR)} + {HOUR} AS window_end, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def window_min_max(spark, d):
    return events(spark, d).window(tumbling(HOUR)).agg(least=F.min("value"), most=F.max("value"))


@query(f"SELECT event_type AS key, round(avg(value), 4) AS value, {start(HOUR)} + {HOUR} AS ms FROM events GROUP BY event_type, {start(HOUR)}")
def window_to_events(spark, d):
    return events(spark, d).window(tumbling(HOUR)).to_events("avg").df.select(F.col("event_type").alias("key"), F.round("value", 4).alias("value"), F.unix_millis("ts").alias("ms"))


@query(
    f"""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS nth FROM events)
    SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, min({MS}) AS window_start, max({MS}) AS window_end FROM n GROUP BY user_id, nth"""
)
def count_windows(spark, d):
    return events(spark, d, "user_id").window(count_window(10)).agg(n=aggregate("count"), total=F.round(F.sum("value"), 4))


# scalar functions
@query(
    """SELECT n_nationkey, upper(n_name) AS up, lower(n_name) AS low, substring(n_name, 2, 3) AS middle, length(n_name) AS len, octet_length(n_name::BLOB) AS bytes,
    trim(chr(9) || ' ' || n_name || chr(160) || chr(10), ' ' || chr(9) || chr(10) || chr(160)) AS trimmed FROM nation"""
)
def scalar_string(spark, d):
    n = F.col("n_name")
    padded = F.concat(F.lit("\t "), n, F.lit("\xa0\n"))
    return table(spark, d, "nation").select(
        "n_nationkey", F.upper(n).alias("up"), F.lower(n).alias("low"), scalar.substring(n, 2, 3).alias("middle"),
        scalar.length(n).cast("bigint").alias("len"), scalar.byte_length(n).cast("bigint").alias("bytes"), scalar.trim(padded).alias("trimmed"),
    )


@query("SELECT event_id, abs(value - 50) AS a, round(value)::BIGINT AS r, floor(value)::BIGINT AS f, ceil(value)::BIGINT AS c FROM events")
def scalar_math(spark, d):
    v = F.col("value")
    return events(spark, d).df.select("event_id", F.abs(v - 50).alias("a"), scalar.round_half_away(v).alias("r"), scalar.floor(v).alias("f"), scalar.ceiling(v).alias("c"))


@query("SELECT n_nationkey, substring(n_name, 1, 2) AS below, substring(n_name, 3) AS rest, substring(n_name, 2) AS none, substring(n_name, 90, 2) AS beyond FROM nation")
def scalar_substring_edges(spark, d):
    n, s = F.col("n_name"), scalar.substring
    return table(spark, d, "nation").select("n_nationkey", s(n, -4, 2).alias("below"), s(n, 3).alias("rest"), s(n, 2, 0).alias("none"), s(n, 90, 2).alias("beyond"))


@query("SELECT event_id, value / nullif(user_id % 3, 0) AS q, (event_id // nullif(user_id % 3, 0))::BIGINT AS w, event_id + user_id AS s, event_id * 2 - user_id AS m FROM events")
def arith_null_div0(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, d).df.select("event_id", scalar.divide(F.col("value"), u % 3).alias("q"), scalar.divide_whole(e, u % 3).alias("w"), (e + u).alias("s"), (e * 2 - u).alias("m"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_path_extract(spark, d):
    return events(spark, d).df.select("event_id", scalar.as_int(F.get_json_object("props", "$.k")).alias("k"))


# exactly once
@query("SELECT transaction_id, min(event_id) AS event_id FROM stream_events WHERE transaction_id IS NOT NULL GROUP BY transaction_id UNION ALL SELECT NULL, event_id FROM stream_events WHERE transaction_id IS NULL")
def dedup_txn(spark, d):
    s = table(spark, d, "stream_events").withColumn("ts", F.timestamp_millis("arrival_seq"))
    return EventStream(s, "key", "value", "ts", "arrival_seq").distinct_by("transaction_id").df.select("transaction_id", "event_id")


@query("SELECT count(*) AS n, true AS at_most_eight, true AS keys_together, true AS spread FROM events")
def hash_partition_counts(spark, d):
    """Every key's events in one of eight partitions, and keys in more than one."""
    e = events(spark, d, "user_id").partitioned(8).df.withColumn("at", F.spark_partition_id())
    keys = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("at").alias("places"), F.max("at").alias("at"))
    return keys.agg(F.sum("n").alias("n"), (F.count_distinct("at") <= 8).alias("at_most_eight"), (F.max("places") == 1).alias("keys_together"), (F.count_distinct("at") > 1).alias("spread"))


@query("SELECT count(*) AS n, 8::BIGINT AS partitions, true AS even FROM events")
def round_robin_partitions(spark, d):
    """In turn: eight partitions, none of which has a tenth more than another, but for some rows for each part that is read."""
    each = events(spark, d).partitioned(8, "").df.groupBy(F.spark_partition_id().alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("partitions"), (F.max("n") <= F.min("n") * 1.1 + 64).alias("even"))


# the dialect
DIALECT = {
    "sql_select_where": ("SELECT event_id, value FROM events WHERE value >= 100.0 AND event_type != 'view'", "SELECT event_id, value FROM events WHERE value >= 100.0 AND event_type <> 'view'"),
    "sql_group_by": ("SELECT event_type, COUNT(*), MAX(value) AS most FROM events GROUP BY event_type", "SELECT event_type, count(*) AS count, max(value) AS most FROM events GROUP BY event_type"),
    "sql_having": ("SELECT user_id, COUNT(*) AS event_count FROM events GROUP BY user_id HAVING event_count > 12 AND AVG(value) > 10", "SELECT user_id, count(*) AS event_count FROM events GROUP BY user_id HAVING count(*) > 12 AND avg(value) > 10"),
    "sql_order_limit": ("SELECT event_id, value FROM events ORDER BY value DESC, event_id ASC LIMIT 10 OFFSET 5", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10 OFFSET 5"),
    "sql_functions": ("SELECT event_id, UPPER(event_type) AS kind, ABS(value - 50) AS off FROM events WHERE -value < -100", "SELECT event_id, upper(event_type) AS kind, abs(value - 50) AS off FROM events WHERE -value < -100"),
    "sql_tumbling": ("SELECT event_type, COUNT(*), round(SUM(value), 4) AS total FROM events GROUP BY event_type WINDOW TUMBLING 1 HOUR", f"SELECT event_type, count(*) AS count, round(sum(value), 4) AS total, {start(HOUR)} AS window_start, {start(HOUR)} + {HOUR} AS window_end FROM events GROUP BY ALL"),
    "sql_sliding": ("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type WINDOW SLIDING 10 MINUTES HAVING n > 1", f"SELECT event_type, count(*) AS n, window_start, window_start + 600000 AS window_end FROM {slides(600_000, 300_000)} GROUP BY ALL HAVING count(*) > 1"),
    "sql_sliding_slide": ("SELECT COUNT(*) AS n FROM events WINDOW SLIDING 6 HOURS SLIDE 2 HOURS", f"SELECT count(*) AS n, window_start, window_start + {6 * HOUR} AS window_end FROM {slides(6 * HOUR, 2 * HOUR)} GROUP BY ALL"),
    "sql_session": ("SELECT user_id, COUNT(*) FROM events WHERE value > 1 GROUP BY user_id WINDOW SESSION 30 MINUTES", SQL["session_by_user"].replace("FROM events WINDOW", "FROM events WHERE value > 1 WINDOW")),
    "sql_count_window": ("SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id WINDOW TUMBLING 5", f"""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) // 5 AS nth FROM events)
        SELECT user_id, count(*) AS n, min({MS}) AS window_start, max({MS}) AS window_end FROM n GROUP BY user_id, nth"""),
    "sql_global": ("SELECT COUNT(*), round(AVG(value), 4) AS avg, MEDIAN(value) AS middle FROM events", "SELECT count(*) AS count, round(avg(value), 4) AS avg, median(value) AS middle FROM events"),
    "sql_scalar_div0": ("SELECT event_id, value / (user_id % 3) AS q, event_id % (user_id % 3) AS m, 9223372036854775807 + event_id + 1 AS s FROM events WHERE value / (user_id % 3) > 10 OR user_id % 3 = 0",
        "SELECT event_id, value / nullif(user_id % 3, 0) AS q, event_id % nullif(user_id % 3, 0) AS m, NULL::BIGINT AS s FROM events WHERE value / nullif(user_id % 3, 0) > 10 OR user_id % 3 = 0"),
    "sql_scalar_substring": ("SELECT event_id, SUBSTRING(event_type, -5, 2) AS below, SUBSTR(event_type, 3) AS rest, SUBSTRING(event_type, 2, 0) AS none, SUBSTRING(event_type, 90, 2) AS beyond FROM events",
        "SELECT event_id, substring(event_type, 1, 2) AS below, substring(event_type, 3) AS rest, substring(event_type, 2) AS none, substring(event_type, 90, 2) AS beyond FROM events"),
    "sql_scalar_trim": ("SELECT event_id, TRIM('\t ' || event_type || '\u00a0\n') AS trimmed, LENGTH(event_type) AS len FROM events", "SELECT event_id, event_type AS trimmed, length(event_type)::INTEGER AS len FROM events"),
    "sql_scalar_round": ("SELECT event_id, ROUND(value - 50) AS r, FLOOR(value) AS f, CEIL(value) AS c FROM events", "SELECT event_id, round(value - 50)::BIGINT AS r, floor(value)::BIGINT AS f, ceil(value)::BIGINT AS c FROM events"),
    "sql_distinct": ("SELECT DISTINCT user_id, event_type FROM events", "SELECT DISTINCT user_id, event_type FROM events"),
    "sql_union": ("SELECT user_id, event_type FROM events WHERE value > 50 UNION SELECT user_id, upper(event_type) AS event_type FROM events WHERE value < 20", "SELECT user_id, event_type FROM events WHERE value > 50 UNION SELECT user_id, upper(event_type) FROM events WHERE value < 20"),
    "sql_union_all": ("SELECT event_id FROM events WHERE value > 50 UNION ALL SELECT event_id FROM events WHERE value > 90 ORDER BY event_id DESC LIMIT 50", "SELECT event_id FROM events WHERE value > 50 UNION ALL SELECT event_id FROM events WHERE value > 90 ORDER BY event_id DESC LIMIT 50"),
    "sql_intersect": ("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'"),
    "sql_except": ("SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE value > 200", "SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE value > 200"),
    "sql_nulls_last": ("SELECT event_id, CASE WHEN value > 5 THEN value END AS v FROM events ORDER BY v DESC NULLS FIRST, 1 LIMIT 40", "SELECT event_id, CASE WHEN value > 5 THEN value END AS v FROM events ORDER BY v DESC NULLS FIRST, 1 LIMIT 40"),
    "sql_count_distinct": ("SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"),
    "sql_rollup": ("SELECT event_type, user_id % 3 AS part, COUNT(*) AS n FROM events GROUP BY ROLLUP(event_type, user_id % 3)", "SELECT event_type, user_id % 3 AS part, count(*) AS n FROM events GROUP BY ROLLUP(event_type, user_id % 3)"),
}
for _name, (_text, _sql) in DIALECT.items():
    QUERIES[_name] = sql_on_events(_text)
    SQL[_name] = _sql
