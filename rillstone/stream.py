"""A fluent interface to keyed, timestamped events; every method returns a new lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from queue import Queue

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillstone.operators import joins
from rillstone.operators.aggregates import aggregate
from rillstone.operators.windows import Spec, aggregated
from rillstone.sinks import files

#: An event with a key, a numeric value, its time and headers, of which names may occur again.
EVENT_SCHEMA = "id bigint, key string, value double, ts timestamp, headers array<struct<k: string, v: string>>"


class EventStream:
    """Events as a DataFrame with columns for key, value and time, and one that orders events of one time."""

    def __init__(self, df: DataFrame, key: str = "key", value: str = "value", ts: str = "ts", tie: str = "id"):
        self.df, self.key, self.value, self.ts, self.tie = df, key, value, ts, tie

    @classmethod
    def from_iter(cls, spark: SparkSession, rows: Iterable, schema: str = EVENT_SCHEMA, **names: str) -> EventStream:
        return cls(spark.createDataFrame(list(rows), schema), **names)

    @classmethod
    def from_values(cls, spark: SparkSession, values: Iterable) -> EventStream:
        """Values without keys; all have the current time and keep their order."""
        df = spark.createDataFrame([(i, None, v) for i, v in enumerate(values)], "id bigint, key string, value double")
        return cls(df.withColumn("ts", F.current_timestamp()))

    @classmethod
    def from_channel(cls, spark: SparkSession, channel: Queue, schema: str = EVENT_SCHEMA, **names: str) -> EventStream:
        """The rows that are put into a queue, until a None."""
        return cls.from_iter(spark, iter(channel.get, None), schema, **names)

    @classmethod
    def empty(cls, spark: SparkSession) -> EventStream:
        return cls.from_iter(spark, [])

    def _with(self, df: DataFrame) -> EventStream:
        return EventStream(df, self.key, self.value, self.ts, self.tie)

    # row by row
    def filter(self, condition: Column | str) -> EventStream:
        return self._with(self.df.where(condition))

    def map(self, value: Column | str) -> EventStream:
        return self._with(self.df.withColumn(self.value, F.expr(value) if isinstance(value, str) else value))

    def flat_map(self, values: Column | str) -> EventStream:
        """One event for each item of an array; none for an empty or NULL one."""
        return self._with(self.df.withColumn(self.value, F.explode(F.expr(values) if isinstance(values, str) else values)))

    def flat_map_python(self, f: Callable[[object], Iterable], result: str) -> EventStream:
        """One event for each item that a Python function gives for a value, for what columns can't say."""
        many = F.pandas_udf(lambda s: s.map(lambda v: list(f(v))), f"array<{result}>")
        return self.flat_map(many(F.col(self.value)))

    def key_by(self, key: Column | str) -> EventStream:
        return EventStream(self.df.withColumn("key", F.expr(key) if isinstance(key, str) else key), "key", self.value, self.ts, self.tie)

    def map_python(self, f: Callable, result: str) -> EventStream:
        """The value through a Python function over pandas Series, for what columns can't say."""
        return self._with(self.df.withColumn(self.value, F.pandas_udf(f, result)(F.col(self.value))))

    def filter_python(self, f: Callable) -> EventStream:
        return self._with(self.df.where(F.pandas_udf(f, "boolean")(F.col(self.value))))

    @classmethod
    def from_source(cls, df: DataFrame, **names: str) -> EventStream:
        """The rows of a source (sources.files, sources.http, or any reader of Spark's), bounded or not."""
        return cls(df, **names)

    def sink(self, path: str, fmt: str = "json", append: bool = True, checkpoint: str | None = None, every: str | None = None) -> StreamingQuery | None:
        """Write the events to files; unbounded ones need a checkpoint, and give the query that writes them."""
        if not self.df.isStreaming:
            return files.write(self.df, path, fmt, append)
        if checkpoint is None:
            raise ValueError("a stream needs a checkpoint to be written")
        return files.start(self.df, path, checkpoint, fmt, every)

    def sink_with(self, write: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append", every: str | None = None) -> StreamingQuery | None:
        """A sink of one's own: it is given the rows and the number of their batch; a batch may come again after a failure."""
        if not self.df.isStreaming:
            return write(self.df, 0)
        w = self.df.writeStream.foreachBatch(write).outputMode(mode)
        w = w.option("checkpointLocation", checkpoint) if checkpoint else w
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()

    def for_each(self, f: Callable[[Row], None]) -> None:
        self.df.foreach(f)

    # in order
    def _ordered(self, descending: bool = False) -> DataFrame:
        cols = [F.col(self.ts), F.col(self.tie)]
        return self.df.orderBy(*[c.desc() if descending else c.asc() for c in cols])

    def take(self, n: int) -> EventStream:
        return self._with(self._ordered().limit(n))

    def skip(self, n: int) -> EventStream:
        return self._with(self._ordered().offset(n))

    def first(self) -> EventStream:
        return self.take(1)

    def last(self) -> EventStream:
        return self._with(self._ordered(descending=True).limit(1))

    # as a whole
    def collect(self) -> list[Row]:
        return self._ordered().collect()

    def count(self) -> int:
        return self.df.count()

    def any(self, condition: Column | str) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_or(F.expr(condition) if isinstance(condition, str) else condition), F.lit(False)).alias("any"))

    def all(self, condition: Column | str) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_and(F.expr(condition) if isinstance(condition, str) else condition), F.lit(True)).alias("all"))

    def fold(self, start: Column, step: Callable[[Column, Column], Column], by: list[str] | None = None, merge: Callable[[Column, Column], Column] | None = None, parts: int = 64) -> DataFrame:
        """A step over each event's value in order.

        Without `merge` a group's values are held in one row. With it, the step may go over shares of the
        group, each from `start`, and merge puts the results of two shares together, in any order; a group
        is then split into up to parts^2 shares, so that it may be large.
        """
        if merge is not None:
            by = by or []
            share = F.pmod(F.xxhash64(self.tie), F.lit(parts * parts)).alias("__share")
            folded = self._with(self.df.withColumn("__share", share)).fold(start, step, [*by, "__share"])
            for upper in (F.floor(F.col("__share") / parts), F.lit(0)):
                some = folded.withColumn("__share", upper).groupBy(*by, "__share").agg(F.collect_list("fold").alias("__f"))
                folded = some.select(*by, "__share", F.reduce(F.slice("__f", 2, parts), F.col("__f")[0], merge).alias("fold"))
            return folded.drop("__share")
        values = F.array_sort(F.collect_list(F.struct(F.col(self.ts), F.col(self.tie), F.col(self.value).alias("v"))))
        return self.df.groupBy(*(by or [])).agg(F.aggregate(values, start, lambda acc, x: step(acc, x["v"])).alias("fold"))

    def group_by(self, *columns: str) -> Grouped:
        return Grouped(self, list(columns))

    def agg(self, **named: Column) -> DataFrame:
        return self.df.agg(*[c.alias(n) for n, c in named.items()])

    def distinct_by(self, *columns: str) -> EventStream:
        """The first event of each combination; rows without a value in any of the columns all stay."""
        known = F.lit(True)
        for c in columns:
            known = known & F.col(c).isNotNull()
        own = F.when(~known, F.monotonically_increasing_id())
        marked = self.df.withColumn("__own", own)
        if self.df.isStreaming:
            return self._with(self.df.where(known).dropDuplicatesWithinWatermark(list(columns)).unionByName(self.df.where(~known)))
        rest = [c for c in self.df.columns if c not in columns]
        best = marked.groupBy(*columns, "__own").agg(F.min(F.struct(self.ts, self.tie, *[c for c in rest if c not in (self.ts, self.tie)])).alias("__r"))
        return self._with(best.select(*[F.col(c) if c in columns else F.col("__r")[c].alias(c) for c in self.df.columns]))

    # windows and joins
    def window(self, spec: Spec, *by: str) -> WindowedStream:
        """By window and key, or the given columns."""
        return WindowedStream(self, spec, list(by) or [self.key])

    def window_by(self, windows: Column | str, *by: str) -> Grouped:
        """By windows of one's own: an array of structs (start, end) for each event; groups have a column `window`."""
        each = self.df.withColumn("window", F.explode(F.expr(windows) if isinstance(windows, str) else windows))
        return Grouped(self._with(each), ["window", *(by or [self.key])])

    def with_watermark(self, delay: str, at: Column | str | None = None) -> EventStream:
        """By the events' time, or a time of one's own (such as one bounded by the time of arrival), which becomes theirs."""
        df = self.df if at is None else self.df.withColumn(self.ts, F.expr(at) if isinstance(at, str) else at)
        return self._with(df.withWatermark(self.ts, delay))

    def join(self, other: EventStream, how: str = "inner", within_ms: int | None = None, unmatched: str = "row", null_safe: bool = False) -> JoinedStream:
        sides = [s.df.select(F.col(s.key).alias("key"), F.col(s.value).alias("value"), F.col(s.ts).alias("ts")) for s in (self, other)]
        return JoinedStream(joins.joined(*sides, how, within_ms, unmatched, null_safe))

    def partitioned(self, n: int, by: Column | str | None = None) -> EventStream:
        """In n partitions by hash of the key, or of another column or expression; with by="" in turn."""
        if isinstance(by, str) and by == "":
            return self._with(self.df.repartition(n))
        return self._with(self.df.repartition(n, self.key if by is None else by))


class Grouped:
    def __init__(self, events: EventStream, columns: list[str]):
        self.events, self.columns = events, columns

    def agg(self, having: Column | str | None = None, **named: Column) -> DataFrame:
        out = self.events.df.groupBy(*self.columns).agg(*[c.alias(n) for n, c in named.items()])
        return out if having is None else out.where(having)


class WindowedStream:
    """Events by window and group; each aggregate gives the groups' columns, the result and window_start, window_end in ms."""

    def __init__(self, events: EventStream, spec: Spec, by: list[str]):
        self.events, self.spec, self.by = events, spec, by

    def agg(self, having: Column | str | None = None, **named: Column) -> DataFrame:
        out = aggregated(self.events.df, self.events.ts, self.spec, self.by, named, self.events.tie)
        return out if having is None else out.where(having)

    def _one(self, name: str) -> DataFrame:
        return self.agg(**{name: aggregate(name, None if name == "count" else F.col(self.events.value))})

    def count(self) -> DataFrame:
        return self._one("count")

    def sum(self) -> DataFrame:
        return self._one("sum")

    def avg(self) -> DataFrame:
        return self._one("avg")

    def min(self) -> DataFrame:
        return self._one("min")

    def max(self) -> DataFrame:
        return self._one("max")

    def median(self) -> DataFrame:
        return self._one("median")

    def to_events(self, name: str) -> EventStream:
        """The results as events at their window's end."""
        out = self._one(name).withColumnRenamed(name, "value").withColumn("ts", F.timestamp_millis("window_end"))
        return EventStream(out, self.by[0], "value", "ts", "window_start")


class JoinedStream:
    """Pairs of events; see joins.joined."""

    def __init__(self, df: DataFrame):
        self.df = df

    def collect(self) -> list[Row]:
        return self.df.collect()

    def count(self) -> int:
        return self.df.count()

    def combine(self, f: Callable[[Column, Column], Column]) -> DataFrame:
        return joins.combine(self.df, f)

    def as_tuples(self) -> DataFrame:
        return joins.as_tuples(self.df)

    def sum_values(self) -> DataFrame:
        return joins.sum_values(self.df)

    def coalesce_left(self) -> DataFrame:
        return joins.coalesce_left(self.df)

    def coalesce_right(self) -> DataFrame:
        return joins.coalesce_right(self.df)
