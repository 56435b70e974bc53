"""Streaming queries, run over what their files hold; windows that are still open at the end have no row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.catalog.events import _P5
from rillstone.catalog.reference import DIALECT, HOUR, SQL as BATCH_SQL, start
from rillstone.operators.aggregates import aggregate
from rillstone.operators.windows import session, tumbling
from rillstone.plans import dialect
from rillstone.store import shared_dir, table, written
from rillstone.stream import EventStream
from rillstone.streaming.late import late_windows
from rillstone.streaming.processors import KeyedStore, RunningCount, SessionProcessor
from rillstone.streaming.run import drained, use_rocksdb


def unbounded(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. As a pattern the path may be one file or a folder; a plain one must be a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def events(spark: SparkSession, sf_dir: str, key: str = "event_type") -> EventStream:
    e = unbounded(spark, sf_dir, "events").withColumn("ts", F.expr("timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)))"))
    return EventStream(e, key, "value", "ts", "event_id")


def stream_filter_map(spark: SparkSession, d: str) -> DataFrame:
    return drained(events(spark, d).filter("event_id % 2 = 0").map("value * 2").df.select("event_id", "value"))


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return drained(events(spark, d).with_watermark("1 second").window(tumbling(HOUR)).agg(n=aggregate("count"), most=F.max("value")))


def stream_median(spark: SparkSession, d: str) -> DataFrame:
    return drained(events(spark, d).with_watermark("1 second").window(tumbling(6 * HOUR)).agg(median=F.median("value")))


def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return drained(events(spark, d, "user_id").with_watermark("1 second").window(session(HOUR // 2)).count())


def _timed(e: DataFrame, delay: str) -> DataFrame:
    key = F.col("user_id").cast("string")
    rows = e.select(F.pmod(F.xxhash64(key), F.lit(512)).alias("part"), key.alias("key"), "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", delay)
    return rows.groupBy("part").transformWithStateInPandas(SessionProcessor(HOUR // 2), SessionProcessor.OUTPUT, "Append", "EventTime")


def stream_session_timers(spark: SparkSession, d: str) -> DataFrame:
    use_rocksdb(spark)
    return drained(_timed(events(spark, d).df, "1 second"))


DAY = 24 * HOUR


def stream_session_disorder(spark: SparkSession, d: str) -> DataFrame:
    """The same from batches of five days, where an event comes up to two days late and thus in a batch after later ones."""
    use_rocksdb(spark)
    e = table(spark, d, "events").withColumn("us", F.expr("unix_micros(CAST(ts AS TIMESTAMP))"))
    late = F.pmod(F.xxhash64("event_id"), F.lit(2 * DAY))
    batch = F.floor((F.floor(F.col("us") / 1000) + late) / F.lit(5 * DAY))
    at = f"{shared_dir(spark)}/rillstone/{uuid.uuid4().hex}"
    batches = written(e.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), batch.alias("batch")), ["batch"])
    numbers = sorted(r[0] for r in batches.select("batch").distinct().collect())  # one for each five days
    for n in numbers:  # files are read in order of their times
        batches.where(F.col("batch") == n).drop("batch").coalesce(1).write.mode("append").parquet(at)
    s = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(at)
    return drained(_timed(s, "2 days"))


def stream_sql_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return drained(dialect.run(spark, DIALECT["sql_tumbling"][0], events=events(spark, d).with_watermark("1 second").df))


def stream_sql_session(spark: SparkSession, d: str) -> DataFrame:
    return drained(dialect.run(spark, DIALECT["sql_session"][0], events=events(spark, d).with_watermark("1 second").df))


def stream_interval_join(spark: SparkSession, d: str) -> DataFrame:
    def side(kind: str) -> EventStream:
        e = events(spark, d).df.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("value"), "ts", "event_id")
        return EventStream(e.withWatermark("ts", "1 second"), "user_id", "value", "ts", "event_id")

    return drained(side("click").join(side("purchase"), "inner", 10 * HOUR).df.select("key", "left_value", "right_value", F.unix_micros("ts").alias("us")))


def stream_interval_left(spark: SparkSession, d: str) -> DataFrame:
    """Clicks without a purchase are given out once no purchase can come any more."""

    def side(kind: str) -> EventStream:
        e = events(spark, d).df.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("value"), "ts", "event_id")
        return EventStream(e.withWatermark("ts", "1 second"), "user_id", "value", "ts", "event_id")

    return drained(side("click").join(side("purchase"), "left", 10 * HOUR).df.select("key", "left_value", "right_value", F.unix_micros("ts").alias("us")))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """With the records that have no transaction id, which all pass."""
    s = unbounded(spark, d, "stream_events").withColumn("ts", F.col("arrived_at").cast("timestamp"))
    e = EventStream(s, "key", "value", "ts", "arrival_seq").with_watermark("30 days")
    return drained(e.distinct_by("transaction_id").df.select("transaction_id", "event_id"))


def _late(spark: SparkSession, d: str, policy: str) -> DataFrame:
    use_rocksdb(spark)
    c = table(spark, d, "stream_configs").select("key", "window_ms", F.col("allowed_lateness").alias("lateness"), F.col("max_out_of_orderness").alias("disorder"))
    s = unbounded(spark, d, "stream_events").select("key", "event_id", F.col("arrival_seq").alias("seq"), "ms", "value")
    return drained(late_windows(s, c, policy))


def stream_late_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows, their corrections, and beside them the records beyond the cut-off."""
    return _late(spark, d, "side_output")


def stream_late_drop(spark: SparkSession, d: str) -> DataFrame:
    return _late(spark, d, "drop")


def stream_late_update(spark: SparkSession, d: str) -> DataFrame:
    return _late(spark, d, "update")


def stream_keyed_store(spark: SparkSession, d: str) -> DataFrame:
    """A store per user: events write, read and look for the entry of their type in turn."""
    use_rocksdb(spark)
    op = F.element_at(F.array(F.lit("put"), F.lit("get"), F.lit("exists")), (F.col("event_id") % 3 + 1).cast("int"))
    e = events(spark, d).df.select(
        F.col("user_id").cast("string").alias("key"), op.alias("op"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("value"), F.lit(None).cast("string").alias("tx"), F.col("event_id").alias("seq")
    )
    return drained(e.groupBy("key").transformWithState(KeyedStore(), KeyedStore.OUTPUT, "Append", "None"))


def stream_running_count(spark: SparkSession, d: str) -> DataFrame:
    use_rocksdb(spark)
    e = events(spark, d).df.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"))
    return drained(e.groupBy("key").transformWithStateInPandas(RunningCount(), RunningCount.OUTPUT, "Append", "None"))


def _closed(sql: str, end: str = "window_end", delay_ms: int = 1000) -> str:
    """The rows of a batch query whose window has closed when the stream ends."""
    return f"SELECT * FROM ({sql}) WHERE {end} <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - {delay_ms}"


_SESSIONS = BATCH_SQL["session_by_user"]
_STREAMED = (
    stream_filter_map, stream_tumbling, stream_median, stream_session, stream_session_timers, stream_session_disorder, stream_sql_tumbling, stream_sql_session, stream_interval_join, stream_interval_left,
    stream_dedup, stream_late_windows, stream_late_drop, stream_late_update, stream_running_count, stream_keyed_store,
)
QUERIES = {f.__name__: f for f in _STREAMED}
_LATE = (
    _P5
    + """,
ends AS (SELECT s.key, max(ms) - coalesce(any_value(c.max_out_of_orderness), 1000) AS last FROM seen s JOIN stream_configs c USING (key) GROUP BY s.key),
steps AS (SELECT key, window_start, window_end, CASE WHEN outcome = 'corrected' THEN seq END AS seq, any_value(CASE WHEN outcome = 'corrected' THEN event_id END) AS event_id,
  count(*) AS n, sum(value) AS s FROM told WHERE outcome <> 'dropped' GROUP BY ALL),
emitted AS (SELECT key, CASE WHEN seq IS NULL THEN 'window' ELSE 'corrected' END AS outcome, event_id, window_start, window_end, count(seq) OVER w AS revision,
  CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(s) OVER w AS BIGINT) AS total
  FROM steps JOIN ends USING (key) WHERE last >= window_end
  WINDOW w AS (PARTITION BY key, window_start ORDER BY seq NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT * FROM emitted"""
)
_SESSIONS_AT = f"SELECT user_id::VARCHAR AS key, window_start AS session_start, window_end - {HOUR // 2} AS session_end, count AS n_events FROM"
_LAST_MS = "(SELECT least(max(us) FILTER (WHERE event_type = 'click'), max(us) FILTER (WHERE event_type = 'purchase')) FROM (SELECT event_type, epoch_us(ts) AS us FROM events)) // 1000 - 1000"
SQL = {
    "stream_filter_map": BATCH_SQL["filter_map"],
    "stream_tumbling": _closed(f"SELECT event_type, {start(HOUR)} AS window_start, {start(HOUR)} + {HOUR} AS window_end, count(*) AS n, max(value) AS most FROM events GROUP BY ALL"),
    "stream_median": _closed(f"SELECT event_type, {start(6 * HOUR)} AS window_start, {start(6 * HOUR)} + {6 * HOUR} AS window_end, median(value) AS median FROM events GROUP BY ALL"),
    "stream_session": _closed(_SESSIONS),
    "stream_session_timers": f"{_SESSIONS_AT} ({_closed(_SESSIONS)})",
    "stream_session_disorder": f"{_SESSIONS_AT} ({_closed(_SESSIONS, delay_ms=2 * DAY)})",
    "stream_sql_tumbling": _closed(DIALECT["sql_tumbling"][1]),
    "stream_sql_session": f"SELECT * FROM ({DIALECT['sql_session'][1]}) WHERE window_end <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 1000",
    "stream_interval_left": f"SELECT * FROM ({BATCH_SQL['join_interval_left']}) WHERE right_value IS NOT NULL OR us + {10 * HOUR * 1000} < ({_LAST_MS}) * 1000",
    "stream_interval_join": BATCH_SQL["join_interval_inner"],
    "stream_dedup": BATCH_SQL["dedup_txn"],
    "stream_late_windows": _LATE + " UNION ALL SELECT key, outcome, event_id, window_start, window_end, NULL, NULL, NULL FROM told WHERE outcome = 'dropped'",
    "stream_late_drop": _LATE + " WHERE outcome = 'window'",
    "stream_late_update": _LATE,
    "stream_keyed_store": """SELECT key, seq, op, name, CASE op WHEN 'get' THEN put ELSE CASE WHEN put IS NULL THEN 'false' ELSE 'true' END END AS value FROM
    (SELECT user_id::VARCHAR AS key, event_id AS seq, event_type AS name, CASE event_id % 3 WHEN 0 THEN 'put' WHEN 1 THEN 'get' ELSE 'exists' END AS op,
      last_value(CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS put FROM events) WHERE op <> 'put'""",
    "stream_running_count": "SELECT event_type AS key, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events",
}
