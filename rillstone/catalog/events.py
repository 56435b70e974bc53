"""Queries of the problems on event tables: p1, p3, p5, p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.cleaning import WHITE_SPACE, folded, folded_symbol, seconds
from rillstone.operators import late, rolling, spikes
from rillstone.operators.sessions import sessions
from rillstone.store import table

EVENT_TYPES = ("impression", "click", "conversion")

_WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_T = "CASE WHEN timestamp > 100000000000 THEN timestamp // 1000 ELSE timestamp END"


def _fold(c: str) -> str:
    return f"nullif(lower(trim({c}, {_WS})), '')"


def rolling_by_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "ad_events")
    day = F.to_date(F.timestamp_seconds(seconds(F.col("timestamp"))))
    return rolling.rolling_totals(e, folded(F.col("campaign_id")), day, F.col("cost"), F.col("event_id")).withColumnRenamed("entity", "campaign_id")


def p1_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rolling_by_campaign(spark, sf_dir)
    money = [F.round(c, 6).alias(c) for p in (7, 30) for c in (f"total_{p}d", f"average_{p}d")]
    return r.select("campaign_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_events", "events_7d", "events_30d", *money)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rolling_by_campaign(spark, sf_dir).where("n_events = 0 AND events_7d > 0")
    return r.select("campaign_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


_P1_DAILY = f"""
WITH clean AS (
  SELECT event_id, {_fold('campaign_id')} AS campaign_id, CAST(to_timestamp({_T}) AT TIME ZONE 'UTC' AS DATE) AS day,
    CAST(CASE WHEN isfinite(cost) THEN cost END AS DECIMAL(28,10)) AS cost
  FROM ad_events WHERE timestamp IS NOT NULL),
one AS (SELECT DISTINCT event_id, campaign_id, day, cost FROM clean WHERE campaign_id IS NOT NULL),
daily AS (SELECT campaign_id, day, count(*) AS n, sum(cost) AS total, count(cost) AS valued FROM one GROUP BY ALL),
span AS (SELECT campaign_id, min(day) AS a, max(day) AS b FROM daily GROUP BY ALL),
days AS (SELECT campaign_id, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM span)"""

P1_ROLLING_SQL = (
    _P1_DAILY
    + """
SELECT x.campaign_id, strftime(x.day, '%Y-%m-%d') AS day,
  coalesce(sum(d.n) FILTER (WHERE d.day = x.day), 0)::BIGINT AS n_events,
  coalesce(sum(d.n) FILTER (WHERE d.day > x.day - 7), 0)::BIGINT AS events_7d,
  coalesce(sum(d.n), 0)::BIGINT AS events_30d,
  round(coalesce(sum(d.total) FILTER (WHERE d.day > x.day - 7), 0)::DOUBLE, 6) AS total_7d,
  round(coalesce(sum(d.total), 0)::DOUBLE, 6) AS total_30d,
  round(coalesce(sum(d.total) FILTER (WHERE d.day > x.day - 7), 0)::DOUBLE / nullif(sum(d.valued) FILTER (WHERE d.day > x.day - 7), 0)::DOUBLE, 6) AS average_7d,
  round(coalesce(sum(d.total), 0)::DOUBLE / nullif(sum(d.valued), 0)::DOUBLE, 6) AS average_30d
FROM days x LEFT JOIN daily d ON d.campaign_id = x.campaign_id AND d.day <= x.day AND d.day > x.day - 30
GROUP BY x.campaign_id, x.day"""
)

P1_FOUND_SQL = (
    _P1_DAILY
    + """
SELECT x.campaign_id, strftime(x.day, '%Y-%m-%d') AS day FROM days x
WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.campaign_id = x.campaign_id AND d.day = x.day)
  AND EXISTS (SELECT 1 FROM daily d WHERE d.campaign_id = x.campaign_id AND d.day < x.day AND d.day > x.day - 7)"""
)


def sessions_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "ad_events")
    s = sessions(e, folded(F.col("user_id")), seconds(F.col("timestamp")), folded(F.col("event_type")), F.col("event_id"), EVENT_TYPES)
    return s.withColumnRenamed("key", "user_id")


def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_by_user(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_by_user(spark, sf_dir).select("user_id", "session_start", "session_end")


_P3_SESSIONS = f"""
WITH one AS (SELECT DISTINCT event_id, {_fold('user_id')} AS user_id, {_T} AS t, {_fold('event_type')} AS kind FROM ad_events WHERE timestamp IS NOT NULL),
marked AS (SELECT *, t - lag(t) OVER w > 1800 AS opens FROM one WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
numbered AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nth FROM marked)"""

P3_SESSIONS_SQL = (
    _P3_SESSIONS
    + """
SELECT user_id, min(t) AS session_start, max(t) AS session_end, max(t) - min(t) AS duration, count(*) AS n_events,
  count(*) FILTER (WHERE kind = 'impression') AS n_impression, count(*) FILTER (WHERE kind = 'click') AS n_click,
  count(*) FILTER (WHERE kind = 'conversion') AS n_conversion,
  count(*) FILTER (WHERE kind IS NULL OR kind NOT IN ('impression', 'click', 'conversion')) AS n_other
FROM numbered GROUP BY user_id, nth"""
)
P3_FOUND_SQL = _P3_SESSIONS + " SELECT user_id, min(t) AS session_start, max(t) AS session_end FROM numbered GROUP BY user_id, nth"


def late_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.classified(table(spark, sf_dir, "stream_events"), table(spark, sf_dir, "stream_configs"))


def p5_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.windows(late_by_key(spark, sf_dir))


def p5_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.window_emissions(late_by_key(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.late_records(late_by_key(spark, sf_dir)).where("outcome <> 'ontime'").select("event_id", "outcome")


_P5 = """
WITH one AS (SELECT event_id, arg_min(key, arrival_seq) AS key, arg_min(value, arrival_seq) AS value, min(ms) AS ms, min(arrival_seq) AS seq
  FROM stream_events WHERE key IS NOT NULL AND ms IS NOT NULL GROUP BY event_id),
seen AS (SELECT *, max(ms) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM one),
judged AS (SELECT s.*, c.window_ms, coalesce(c.allowed_lateness, 0) AS lateness, top - coalesce(c.max_out_of_orderness, 1000) AS wm,
  CAST(floor(ms / c.window_ms) AS BIGINT) * c.window_ms AS window_start FROM seen s JOIN stream_configs c USING (key)),
told AS (SELECT *, window_start + window_ms AS window_end,
  CASE WHEN wm > window_start + window_ms + lateness THEN 'dropped' WHEN wm >= window_start + window_ms THEN 'corrected' ELSE 'ontime' END AS outcome FROM judged)"""

P5_FOUND_SQL = _P5 + " SELECT event_id, outcome FROM told WHERE outcome <> 'ontime'"
P5_WINDOWS_SQL = (
    _P5
    + """
SELECT key, window_start, window_end, count(*) FILTER (WHERE outcome = 'corrected') AS corrections,
  count(*) FILTER (WHERE outcome <> 'dropped') AS n, count(value) FILTER (WHERE outcome <> 'dropped') AS n_values,
  CAST(sum(value) FILTER (WHERE outcome <> 'dropped') AS BIGINT) AS total, count(*) FILTER (WHERE outcome = 'dropped') AS dropped,
  CAST(sum(value) FILTER (WHERE outcome <> 'dropped') AS BIGINT)::DOUBLE / nullif(count(value) FILTER (WHERE outcome <> 'dropped'), 0) AS average
FROM told GROUP BY key, window_start, window_end HAVING count(*) FILTER (WHERE outcome <> 'dropped') > 0"""
)
P5_EMISSIONS_SQL = (
    _P5
    + """,
lost AS (SELECT key, window_start, count(*) FILTER (WHERE outcome = 'dropped') AS dropped FROM told GROUP BY ALL),
steps AS (SELECT key, window_start, window_end, CASE WHEN outcome = 'corrected' THEN seq END AS seq, count(*) AS n, count(value) AS nv, sum(value) AS s
  FROM told WHERE outcome <> 'dropped' GROUP BY ALL)
SELECT key, window_start, window_end, count(seq) OVER w AS revision, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(nv) OVER w AS BIGINT) AS n_values,
  CAST(sum(s) OVER w AS BIGINT) AS total, dropped, CAST(sum(s) OVER w AS BIGINT)::DOUBLE / nullif(sum(nv) OVER w, 0) AS average
FROM steps JOIN lost USING (key, window_start)
WINDOW w AS (PARTITION BY key, window_start ORDER BY seq NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)

def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "price_events")
    found = spikes.flagged(e, F.col("event_id"), folded_symbol(F.col("symbol")), folded(F.col("exchange")), F.col("timestamp"), F.col("price"))
    return found.withColumnsRenamed({"record_id": "event_id", "series": "symbol", "source": "exchange"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_faults(spark, sf_dir).select("event_id")


def p6_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impossible readings among the faults."""
    return p6_faults(spark, sf_dir).where("kind = 'impossible'").select("event_id")


def p6_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source that has possible prices: whether every record held to be stuck repeats the price before it, within a run of six or more."""
    e = table(spark, sf_dir, "price_events").select(
        "event_id", folded_symbol(F.col("symbol")).alias("symbol"), folded(F.col("exchange")).alias("exchange"), "timestamp", F.when((F.col("price") > 0) & (F.col("price") < float("inf")), F.col("price")).alias("price")
    )
    e = e.where("symbol IS NOT NULL AND exchange IS NOT NULL AND timestamp IS NOT NULL AND price IS NOT NULL").dropDuplicates(["event_id"])
    by = Window.partitionBy("symbol", "exchange").orderBy("timestamp", "event_id")
    runs = e.withColumn("again", F.coalesce((F.col("price") == F.lag("price").over(by)).cast("int"), F.lit(0)))
    runs = runs.withColumn("run", F.sum(1 - F.col("again")).over(by))
    sizes = runs.groupBy("symbol", "exchange", "run").agg(F.count(F.lit(1)).alias("size"))
    stuck = p6_faults(spark, sf_dir).where("kind = 'stuck'").select("event_id", F.lit(True).alias("stuck"))
    told = runs.join(sizes, ["symbol", "exchange", "run"]).join(stuck, "event_id", "left")
    return told.groupBy("symbol", "exchange").agg(F.bool_and(F.col("stuck").isNull() | (F.col("again") == 1) & (F.col("size") >= 6)).alias("repeats"))


_P6_CLEAN = f"""SELECT DISTINCT event_id, timestamp, {_fold('exchange')} AS exchange, price,
  nullif(regexp_replace(lower(trim(symbol, {_WS})), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') AS symbol FROM price_events"""
P6_IMPOSSIBLE_SQL = f"""SELECT event_id FROM ({_P6_CLEAN}) WHERE symbol IS NOT NULL AND exchange IS NOT NULL AND timestamp IS NOT NULL AND price IS NOT NULL AND (NOT isfinite(price) OR price <= 0)"""
P6_STUCK_SQL = f"""SELECT DISTINCT symbol, exchange, true AS repeats FROM ({_P6_CLEAN}) WHERE symbol IS NOT NULL AND exchange IS NOT NULL AND timestamp IS NOT NULL AND isfinite(price) AND price > 0"""

QUERIES = {
    "p1_rolling_totals": p1_rolling_totals,
    "p1_found": p1_found,
    "p3_sessions": p3_sessions,
    "p3_found": p3_found,
    "p5_windows": p5_windows,
    "p5_emissions": p5_emissions,
    "p5_found": p5_found,
    "p6_faults": p6_faults,
    "p6_found": p6_found,
    "p6_impossible": p6_impossible,
    "p6_stuck": p6_stuck,
}
SQL = {
    "p1_rolling_totals": P1_ROLLING_SQL,
    "p1_found": P1_FOUND_SQL,
    "p3_sessions": P3_SESSIONS_SQL,
    "p3_found": P3_FOUND_SQL,
    "p5_windows": P5_WINDOWS_SQL,
    "p5_emissions": P5_EMISSIONS_SQL,
    "p6_impossible": P6_IMPOSSIBLE_SQL,
    "p6_stuck": P6_STUCK_SQL,
    "p5_found": P5_FOUND_SQL,
}
