"""Windows over late data on streams, by policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.streaming.processors import LateWindows

#: Which outcomes each policy gives out: late records are dropped, given out beside, or correct their window.
POLICIES = {"drop": ("window",), "side_output": ("window", "corrected", "dropped"), "update": ("window", "corrected")}


def late_windows(events: DataFrame, configs: DataFrame, policy: str = "update") -> DataFrame:
    """Emissions of tumbling windows per key; see LateWindows for the columns.

    events: a stream of key, event_id, seq, ms, value. configs: key, window_ms, lateness, disorder.
    drop: windows once, without what comes late. update: again for each late record up to the cut-off.
    side_output: also the records beyond the cut-off, as rows of their own with outcome dropped.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; there are {', '.join(POLICIES)}")
    rows = events.where("key IS NOT NULL AND ms IS NOT NULL").join(configs, "key")
    if policy == "drop":
        rows = rows.withColumn("lateness", F.lit(0).cast("bigint"))
    out = rows.groupBy("key").transformWithState(LateWindows(), LateWindows.OUTPUT, "Append", "None")
    return out.where(F.col("outcome").isin(*POLICIES[policy]))
