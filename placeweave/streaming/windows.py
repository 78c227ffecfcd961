"""Debounce, supersession and pacing over event tables."""

from pyspark.sql import DataFrame, functions as F

from placeweave import fixed
from placeweave.functions.numbers import micros
from placeweave.operators.skew import following, running_max
from placeweave.session import cut_lineage


def ranged(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Events with ``range_bucket``: stretches of about equal rows in the order of keys and time.

    A busy key or day falls into as many stretches as it has rows for. The ranges come from a sample, so the
    table is stored: a task that runs again must see the same stretches.
    """
    dealt = events.repartitionByRange(*keys, *order)
    return cut_lineage(dealt.withColumn("range_bucket", F.spark_partition_id()))


def debounce(
    events: DataFrame, keys: list[str], delay_ms: int, ts: str = "ts", tie: str = "event_id"
) -> DataFrame:
    """Events that no later event of their key follows within the delay."""
    later = following(
        ranged(events, keys, [ts, tie]), keys, [ts, tie], F.col("range_bucket"), ts, "later_ts"
    ).drop("range_bucket")
    gap_ms = (micros(F.col("later_ts")) - micros(F.col(ts))) / 1000
    return later.filter(F.col("later_ts").isNull() | (gap_ms > delay_ms)).drop("later_ts")


def supersede(
    lookups: DataFrame, keys: list[str], start: str = "start_ts", end: str = "end_ts",
    tie: str = "event_id",
) -> DataFrame:
    """Mark lookups that a new lookup of the same session and kind cancels while they run."""
    later = following(
        ranged(lookups, keys, [start, tie]), keys, [start, tie], F.col("range_bucket"), start, "later_ts"
    ).drop("range_bucket")
    cancelled = F.coalesce(F.col("later_ts") < F.col(end), F.lit(False))
    return later.withColumn("cancelled", cancelled).drop("later_ts")


def pace(
    requests: DataFrame, host: str, ts: str = "ts", tie: str = "event_id",
    gap_s: float = fixed.HOST_GAP_SECONDS,
) -> DataFrame:
    """``start_us``: not before arrival, and a gap after the host's last start, in microseconds."""
    return running_max(
        ranged(requests, [host], [ts, tie]), [host], [ts, tie], F.col("range_bucket"), micros(F.col(ts)),
        int(gap_s * 1_000_000), "start_us",
    ).drop("range_bucket")
