"""Queries p2 (nearest times), p4 (distinct counts), p7 (percentiles) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.cleaning import WHITE_SPACE, folded, folded_symbol, one_per_id, seconds
from rillstone.llm import distinct, percentiles
from rillstone.llm.nearest_time import nearest
from rillstone.store import table, written

_WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def _fold(c: str) -> str:
    return f"nullif(lower(trim({c}, {_WS})), '')"


def _symbol(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim({c}, {_WS})), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"


def _source() -> Column:
    return F.concat(folded_symbol(F.col("symbol")), F.lit("\t"), folded(F.col("exchange")))  # NULL if either is


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills, prices = table(spark, sf_dir, "fills"), table(spark, sf_dir, "price_events")
    pairs = nearest(fills, F.col("fill_id"), _source(), F.col("ms"), prices, F.col("event_id"), _source(), F.col("timestamp") * 1000, 30_000)
    return pairs.withColumnsRenamed({"left_id": "fill_id", "right_id": "event_id"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("fill_id", "event_id")


_P2 = f"""
WITH f AS (SELECT fill_id, min(ms) AS ms, min({_symbol('symbol')}) AS symbol, min({_fold('exchange')}) AS exchange FROM fills
  WHERE ms IS NOT NULL AND {_symbol('symbol')} IS NOT NULL AND {_fold('exchange')} IS NOT NULL GROUP BY fill_id),
p AS (SELECT DISTINCT event_id, timestamp * 1000 AS ms, {_symbol('symbol')} AS symbol, {_fold('exchange')} AS exchange FROM price_events WHERE timestamp IS NOT NULL),
near AS (SELECT f.fill_id, p.event_id, p.ms - f.ms AS gap_ms, row_number() OVER (PARTITION BY f.fill_id ORDER BY abs(p.ms - f.ms), p.ms, p.event_id) AS nth
  FROM f JOIN p ON f.symbol = p.symbol AND f.exchange = p.exchange AND p.ms BETWEEN f.ms - 30000 AND f.ms + 30000)"""


def _day() -> Column:
    return F.to_date(F.timestamp_seconds(seconds(F.col("timestamp"))))


#: The sets of groups for which users are counted; of sets with as many columns the smaller ones stand last.
USER_SETS = [("day", "campaign_id", "country"), ("day", "campaign_id"), ("campaign_id", "country"), ("day", "country"), ("campaign_id",), ("day",), ("country",), ()]


def _user_groups() -> dict[str, Column]:
    return {"day": _day(), "campaign_id": folded(F.col("campaign_id")), "country": F.upper(folded(F.col("country")))}


def _user_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = written(distinct.registers(table(spark, sf_dir, "ad_events"), folded(F.col("user_id")), _user_groups()))
    return distinct.estimates(distinct.rolled_up(part, USER_SETS))


def p4_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per day, campaign, country and each combination of these, and in all."""
    return _user_estimates(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


#: The least exact counts of the classes of groups by size.
SIZES = (20_001, 8_000, 1_000, 100, 1)


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the bounds hold: groups by their exact number of users, from `at_least` on.

    at_least, n_groups, users (the sum of the exact numbers), covered: at least 93 % of the groups, or in a
    class of less than 30 all but two, have the exact number within lower and upper.
    """
    e = table(spark, sf_dir, "ad_events").select(*[c.alias(n) for n, c in _user_groups().items()], folded(F.col("user_id")).alias("user_id")).where("user_id IS NOT NULL").distinct()
    of = lambda s: F.when(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in s) or "true"), F.struct(F.lit("+".join(s) or "all").alias("grouping"), *[(F.col(c) if c in s else F.lit(None).cast(k)).alias(c) for c, k in e.dtypes[:-1]]))
    each = e.select(F.explode(F.array(*[of(s) for s in USER_SETS])).alias("g"), "user_id").where("g IS NOT NULL").select("g.*", "user_id").distinct()
    names = ["grouping", *_user_groups()]
    exact = each.groupBy(*names).agg(F.count(F.lit(1)).alias("exact")).alias("x")
    told = _user_estimates(spark, sf_dir).alias("y")
    both = exact.join(told, [F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) for n in names], "left")
    least = F.lit(SIZES[-1])
    for n in reversed(SIZES):
        least = F.when(F.col("exact") >= n, F.lit(n)).otherwise(least)
    inside = F.coalesce(F.col("exact").between(F.col("lower"), F.col("upper")), F.lit(False)).cast("bigint")
    out = both.groupBy(least.alias("at_least")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("exact").alias("users"), F.sum(inside).alias("inside"))
    return out.select("at_least", "n_groups", "users", ((F.col("inside") >= 0.93 * F.col("n_groups")) | (F.col("n_groups") < 30) & (F.col("n_groups") - F.col("inside") <= 2)).alias("covered"))


_P4_SETS = ", ".join("(" + ", ".join(s) + ")" for s in USER_SETS)
P4_COVERAGE_SQL = f"""
WITH e AS (SELECT DISTINCT CAST(to_timestamp(CASE WHEN timestamp > 100000000000 THEN timestamp // 1000 ELSE timestamp END) AT TIME ZONE 'UTC' AS DATE) AS day,
  {_fold('campaign_id')} AS campaign_id, upper({_fold('country')}) AS country, {_fold('user_id')} AS user_id FROM ad_events WHERE {_fold('user_id')} IS NOT NULL),
counted AS (SELECT count(DISTINCT user_id) AS exact FROM e GROUP BY GROUPING SETS ({_P4_SETS})
  HAVING (grouping(day) = 1 OR day IS NOT NULL) AND (grouping(campaign_id) = 1 OR campaign_id IS NOT NULL) AND (grouping(country) = 1 OR country IS NOT NULL) AND count(*) > 0)
SELECT CASE {' '.join(f'WHEN exact >= {n} THEN {n}' for n in SIZES)} END::INTEGER AS at_least, count(*) AS n_groups, sum(exact)::BIGINT AS users, true AS covered FROM counted GROUP BY ALL"""


AT = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)


def p7_price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the finite prices per symbol and per symbol and day."""
    e = table(spark, sf_dir, "price_events").select("event_id", folded_symbol(F.col("symbol")).alias("symbol"), _day().alias("day"), "price")
    e = one_per_id(e.where("symbol IS NOT NULL AND price IS NOT NULL"), "event_id")
    part = percentiles.counts(e, F.col("price"), {"symbol": F.col("symbol"), "day": F.col("day")})
    out = percentiles.percentiles(percentiles.rolled_up(part, [("symbol",), ("symbol", "day")]), AT)
    return out.drop("grouping").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p7_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the latency samples per operator and per operator and node."""
    h = table(spark, sf_dir, "latency_histograms").select("histogram_id", "operator_id", "node_id", "samples").where("operator_id IS NOT NULL")
    h = one_per_id(h, "histogram_id").select("operator_id", "node_id", F.explode("samples").alias("sample"))
    part = percentiles.counts(h, F.col("sample"), {"operator_id": F.col("operator_id"), "node_id": F.col("node_id")})
    return percentiles.percentiles(percentiles.rolled_up(part, [("operator_id",), ("operator_id", "node_id")]), AT).drop("grouping")


def _ranked(rows: str, a: str, b: str) -> str:
    """SQL for the values at rank ceil(p * n) of `rows` per a and per a and b."""
    at = ", ".join(f"({round(p * 1_000_000)}, {p})" for p in AT)
    return f"""WITH rows_ AS ({rows}),
sets AS (SELECT {a} AS a, NULL AS b, v, row_number() OVER (PARTITION BY {a} ORDER BY v) AS nth, count(*) OVER (PARTITION BY {a}) AS n FROM rows_
  UNION ALL SELECT {a}, {b}, v, row_number() OVER (PARTITION BY {a}, {b} ORDER BY v), count(*) OVER (PARTITION BY {a}, {b}) FROM rows_ WHERE {b} IS NOT NULL),
wanted(micro, percentile) AS (VALUES {at})
SELECT a AS {a}, b AS {b}, CAST(percentile AS DOUBLE) AS percentile, n, CAST(v AS DOUBLE) AS value
FROM sets JOIN wanted ON nth = greatest(1, (micro * n + 999999) // 1000000)"""


P7_PRICE_SQL = _ranked(
    f"""SELECT symbol, day, v FROM (SELECT DISTINCT event_id, {_symbol('symbol')} AS symbol,
    strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, price AS v FROM price_events WHERE isfinite(price)) WHERE symbol IS NOT NULL""",
    "symbol",
    "day",
)
P7_LATENCY_SQL = _ranked(
    """SELECT operator_id, node_id, v FROM (SELECT operator_id, node_id, unnest(samples) AS v FROM
    (SELECT histogram_id, any_value(operator_id) AS operator_id, any_value(node_id) AS node_id, any_value(samples) AS samples FROM latency_histograms
     WHERE operator_id IS NOT NULL GROUP BY histogram_id)) WHERE v IS NOT NULL""",
    "operator_id",
    "node_id",
)

QUERIES = {
    "p2_matches": p2_matches,
    "p2_found": p2_found,
    "p4_distinct_users": p4_distinct_users,
    "p4_coverage": p4_coverage,
    "p7_price_percentiles": p7_price_percentiles,
    "p7_latency_percentiles": p7_latency_percentiles,
}
SQL = {
    "p2_matches": _P2 + " SELECT fill_id, event_id, gap_ms FROM near WHERE nth = 1",
    "p2_found": _P2 + " SELECT fill_id, event_id FROM near WHERE nth = 1",
    "p4_coverage": P4_COVERAGE_SQL,
    "p7_price_percentiles": P7_PRICE_SQL,
    "p7_latency_percentiles": P7_LATENCY_SQL,
}
