"""Freshness, debounce, supersession, pacing and stream linkage over events."""

from pyspark.sql import functions as F

from placeweave.functions.numbers import micros
from placeweave.streaming import freshness, windows
from placeweave.streaming.linkage import link_requests
from placeweave.operators.awards import award_keys
from placeweave.session import cut_lineage
from workloads.linking import strict_sql
from workloads.registry import query

c = F.col


@query("t01_ttl_freshness", """
    with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    f as (select user_id, rn, event_id, ts as created, false as hit from e where rn = 1
          union all
          select e.user_id, e.rn, e.event_id, case when e.ts - f.created <= interval 6 hour then f.created else e.ts end,
                 e.ts - f.created <= interval 6 hour
          from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
    select event_id, user_id, hit from f""")
def ttl_freshness(table):
    rows = table("events").select("event_id", "user_id", "ts")
    return freshness.mark_fresh(rows, "user_id", 21600).select("event_id", "user_id", "hit")


def debounce_sql(ms):
    return f"""
    with l as (select event_id, user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as next_ts from events)
    select event_id, user_id from l where next_ts is null or epoch_us(next_ts) - epoch_us(ts) > {ms}::bigint * 1000"""


# The proxy events lie minutes apart, so the delays are scaled to hours.
@query("t02_debounced_list", debounce_sql(3_500_000))
def debounced_list(table):
    return windows.debounce(table("events").select("event_id", "user_id", "ts"), ["user_id"], 3_500_000).select("event_id", "user_id")


@query("t02_debounced_recommendations", debounce_sql(9_000_000))
def debounced_recommendations(table):
    return windows.debounce(table("events").select("event_id", "user_id", "ts"), ["user_id"], 9_000_000).select("event_id", "user_id")


@query("t03_superseded", """
    with l as (select event_id, user_id, event_type, ts, ts + interval 1 hour * value as ends,
                      lead(ts) over (partition by user_id, event_type order by ts, event_id) as next_ts from events)
    select event_id, coalesce(next_ts < ends, false) as cancelled from l""")
def superseded(table):
    ends = micros(c("ts")) + F.round(c("value") * 3600 * 1_000_000).cast("bigint")
    rows = table("events").select("event_id", "user_id", "event_type", c("ts").cast("timestamp").alias("start_ts"), F.timestamp_micros(ends).alias("end_ts"))
    return windows.supersede(rows, ["user_id", "event_type"]).select("event_id", "cancelled")


@query("t04_paced_starts", """
    with r as (select event_id, event_type, epoch_us(ts) as t, row_number() over (partition by event_type order by ts, event_id) as rn from events)
    select event_id, event_type, max(t - rn * 600000000) over (partition by event_type order by rn rows between unbounded preceding and current row) + rn * 600000000 as start_us from r""")
def paced(table):
    return windows.pace(table("events").select("event_id", "event_type", "ts"), "event_type", gap_s=600.0).drop("ts")


STORE = """
    with now as (select max(ts) as t from events),
    live as (select user_id, event_type, max_by(value, ts) as value from events, now where epoch_us(t) - epoch_us(ts) <= 86400000000 * 5 and event_type <> 'view' group by all)"""


def store(table):
    saved = table("events").filter(c("event_type") != "view").select(
        F.concat_ws("|", "user_id", "event_type").alias("key"), c("ts").alias("created_at"), "value")
    asked = table("events").select("event_id", F.concat_ws("|", "user_id", "event_type").alias("key"))
    now = table("events").agg(F.max("ts").alias("now"))
    return asked, saved.crossJoin(F.broadcast(now))


@query("t06_stored_answers", STORE + """
    select e.event_id, l.value from events e join live l on e.user_id = l.user_id and e.event_type = l.event_type""")
def stored_answers(table):
    asked, saved = store(table)
    answered, _ = freshness.stale_first(asked, saved, "key", c("now"), 86400 * 5)
    return answered.select("event_id", "value")


@query("t06_left_to_do", STORE + """
    select e.event_id from events e left join live l on e.user_id = l.user_id and e.event_type = l.event_type where l.user_id is null""")
def left_to_do(table):
    asked, saved = store(table)
    _, todo = freshness.stale_first(asked, saved, "key", c("now"), 86400 * 5)
    return todo.select("event_id")


@query("t06_answers_as_of", """
    with saved as (select concat_ws('|', user_id, event_type) as key, ts as saved_at, max(value) as value from events where event_id % 3 = 0 group by all),
    asked as (select event_id, concat_ws('|', user_id, event_type) as key, ts from events)
    select event_id, case when epoch_us(ts) - epoch_us(saved_at) <= 5 * 86400000000 then value end as value
    from asked asof left join saved on asked.key = saved.key and asked.ts >= saved.saved_at""")
def answers_as_of(table):
    """Every event asks at its own time; every third one has stored a result."""
    named = table("events").withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    saved = named.filter(c("event_id") % 3 == 0).select("key", c("ts").alias("created_at"), "value")
    asked = named.select("event_id", "key", c("ts").alias("asked_at"))
    return freshness.stale_first_at(asked, saved, "key", 86400 * 5).select("event_id", "value")


@query("t05_linked_requests", f"""
    , strict as ({strict_sql('places', 'awards')})
    select place_id, award_id, round(score, 3) as score, round(m, 3) as distance_m from strict""", views=["places", "awards"])
def linked_requests(table):
    """One micro-batch of the stream: every place as a request body."""
    bodies = table("places").select(
        "place_id",
        F.to_json(F.struct("name", "phone", "website", "address", c("latitude").cast("string").alias("latitude"),
                           c("longitude").cast("string").alias("longitude"), "coordinates_source")).alias("body"))
    linked = link_requests(bodies, cut_lineage(award_keys(table("awards"))))
    return linked.select("place_id", "award_id", F.round("score", 3).alias("score"), F.round("distance_m", 3).alias("distance_m"))
