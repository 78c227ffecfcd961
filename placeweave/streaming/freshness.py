"""Time-to-live freshness, in batch and as a stateful stream."""

from pyspark.sql import DataFrame, Window, functions as F

from placeweave.functions.numbers import micros
from placeweave.operators.asof import as_of, chains
from placeweave.session import cut_lineage
from placeweave.streaming.ordered import Fresh, Quiet, processed


def mark_fresh(
    events: DataFrame, key: str, ttl_seconds: float, ts: str = "ts", tie: str = "event_id"
) -> DataFrame:
    """Add ``hit``: whether the event falls within the lifetime of its key's last miss.

    After a miss the next one is the first event later than its time plus the lifetime, so misses form chains. A
    chain starts at the first event of a key and after every silence longer than the lifetime; the rest follows
    by an as-of lookup and pointer doubling, without a task that sees a whole key. Of events of one key and time
    only the first by ``tie`` can be a miss. An event without key or time is no hit.
    """
    ttl = int(ttl_seconds * 1_000_000)
    usable = F.col(key).isNotNull() & F.col(ts).isNotNull()
    timed = events.filter(usable).withColumn("at", micros(F.col(ts)))
    nodes = cut_lineage(timed.select(key, "at").distinct())
    # One lookup serves both: the next node after the lifetime, and, for a lifetime of nothing, the next node.
    probes = nodes.select(key, "at", F.explode(F.array(F.lit(ttl), F.lit(0))).alias("wait"))
    probes = probes.withColumn("until", F.col("at") + F.col("wait"))
    later = nodes.withColumnRenamed("at", "later")
    looked = cut_lineage(as_of(probes, later, [key], "until", "later", ["later"], forward=True).select(
        key, "at", "wait", F.col("found.later").alias("next")
    ).filter("next is not null"))
    after_silence = looked.filter((F.col("wait") == 0) & (F.col("next") - F.col("at") > ttl)).select(key, F.col("next").alias("at"))
    first = nodes.groupBy(key).agg(F.min("at").alias("at"))
    starts = cut_lineage(after_silence.unionByName(first))
    pointers = looked.filter(F.col("wait") == ttl).select(key, "at", "next") if ttl else looked.select(key, "at", "next").distinct()
    known = starts.withColumnRenamed("at", "next")
    misses = chains(starts, pointers.join(known, [key, "next"], "left_anti"), [key]).withColumn("missed", F.lit(True))
    nth = F.row_number().over(Window.partitionBy(key, "at").orderBy(tie))
    marked = timed.withColumn("nth", nth).join(misses, [key, "at"], "left")
    hit = ~(F.coalesce("missed", F.lit(False)) & (F.col("nth") == 1))
    marked = marked.select(*events.columns, hit.alias("hit"))
    return marked.unionByName(events.filter(~usable).withColumn("hit", F.lit(False)))


def fresh_stream(
    events: DataFrame, key: str, ttl_seconds: float, lateness: str = "10 minutes"
) -> DataFrame:
    """Streaming form over (key, event_id, ts): an event leaves, marked, once the watermark has passed its minute.

    State per key is the last miss and the minutes that the watermark has not passed; timers remove both. Events later
    than the watermark are dropped, as in every stream.
    """
    return processed(events, key, Fresh(key, int(ttl_seconds * 1_000_000)), ", hit boolean", lateness)


def debounce_stream(
    events: DataFrame, key: str, delay_ms: int, lateness: str = "1 minute"
) -> DataFrame:
    """Streaming debounce over (key, event_id, ts): an event leaves once its quiet time has passed."""
    return processed(events, key, Quiet(key, delay_ms * 1000), "", lateness)


def stale_first(
    requests: DataFrame, store: DataFrame, key: str, now, ttl_seconds: float
) -> tuple[DataFrame, DataFrame]:
    """(answers from the newest stored result within its lifetime, requests left to do)."""
    age = micros(now) - micros(F.col("created_at"))
    live = store.filter(age <= int(ttl_seconds * 1_000_000))
    newest = live.groupBy(key).agg(
        F.max_by("value", "created_at").alias("value"), F.max("created_at").alias("created_at")
    )
    answered = requests.join(newest, key)
    return answered, requests.join(newest.select(key), key, "left_anti")


def stale_first_at(
    requests: DataFrame, store: DataFrame, key: str, ttl_seconds: float, asked: str = "asked_at", saved: str = "created_at",
    value: str = "value",
) -> DataFrame:
    """Requests with ``value`` and ``saved`` of the newest result stored by then, null if it is older than the lifetime.

    Each request has a time of its own. Of results saved at one time the one with the largest value counts. Requests
    without an answer are left to do; those without a key or time have none.
    """
    found = as_of(requests, store, [key], asked, saved, [saved, value], out="stored")
    age = micros(F.col(asked)) - micros(F.col(f"stored.{saved}"))
    fresh = age <= int(ttl_seconds * 1_000_000)
    return found.select(*requests.columns, *[F.when(fresh, F.col(f"stored.{c}")).alias(c) for c in (value, saved)])
