"""Checks, routing and reshaping of place rows."""

from pyspark.sql import functions as F

from placeweave.functions.geo import country_of
from placeweave.functions.labels import award_badge
from placeweave.functions.urls import listing_compare_key
from placeweave.operators import records, validate
from placeweave.operators.awards import link_awards_strict
from placeweave.sources.requests import read_requests
from workloads.linking import strict_sql
from placeweave.sources import sinks
from workloads.registry import listing_link, query

c = F.col


@query("p01_checked_places", f"""
    select place_id, left(trim(name), 200) as name, left(trim(alternate_name), 200) as alternate_name,
           left(trim(address), 500) as address, left(trim(phone), 50) as phone, left(trim(website), 500) as website,
           coalesce({listing_link('left(trim(listing_url), 300)')}, '') as listing_url,
           try_cast(latitude as double) as latitude, try_cast(longitude as double) as longitude,
           case when coordinates_source = 'place' then 'place' else '' end as coordinates_source,
           case when trim(name) = '' then 'name' when latitude <> '' and try_cast(latitude as double) is null then 'latitude' end as reject_reason
    from raw_places""", views=["raw_places"])
def checked_places(table):
    return validate.check_places(table("raw_places"))


@query("p02_checked_hints", """
    select place_id, case when place_id % 3 = 0 then 'Listing ' || place_id when place_id % 3 = 1 then 'Chosen' end as name,
           case when place_id % 3 = 0 then case when place_id % 23 = 0 then null else 35.5e0 end end as latitude,
           place_id % 3 = 0 and place_id % 23 = 0 as is_rejected
    from (select c_custkey as place_id from customer) t""")
def checked_hints(table):
    kind = "struct<name:string,phone:string,website:string,latitude:string,longitude:string>"
    lat = F.when(c("place_id") % 23 == 0, "abc").otherwise("35.5")
    linked = F.struct(F.concat(F.lit(" Listing "), "place_id").alias("name"), F.lit("").alias("phone"),
                      F.lit("").alias("website"), lat.alias("latitude"), F.lit("").alias("longitude"))
    chosen = F.struct(F.lit("Chosen").alias("name"), F.lit("").alias("phone"), F.lit("").alias("website"),
                      F.lit("").alias("latitude"), F.lit(None).cast("string").alias("longitude"))
    raw = table("raw_places").select(
        "place_id", F.when(c("place_id") % 3 == 0, linked).cast(kind).alias("linked"),
        F.when(c("place_id") % 3 == 1, chosen).cast(kind).alias("selected"))
    checked = validate.check_hints(raw)
    return checked.select("place_id", c("hint.name").alias("name"), c("hint.latitude").alias("latitude"),
                          c("reject_reason").isNotNull().alias("is_rejected"))


GENRE_LIST = "list_filter(list_transform(split(genre_text, ','), lambda g: left(trim(g), 80)), lambda g: g <> '')"


@query("p03_checked_seeds", f"""
    select listing_id, name, coalesce({listing_link('url')}, '') as url, array_to_string({GENRE_LIST}[1:4], ',') as genres,
           station, case when listing_id % 13 = 0 then 'genres' end as reject_reason
    from (select listing_id, name, url, station, case when listing_id % 13 = 0 then ' , ' else genre_text end as genre_text from listings) t""",
    views=["listings"])
def checked_seeds(table):
    raw = table("listings").withColumn(
        "genres", F.split(F.when(c("listing_id") % 13 == 0, " , ").otherwise(c("genre_text")), ","))
    return validate.check_seeds(raw).select(
        "listing_id", "name", "url", F.array_join("genres", ",").alias("genres"), "station", "reject_reason")


@query("p04_popularity_seeds", f"""
    select place_id, left(trim(name), 200) as name, coalesce({listing_link('listing_url')}, '') as url,
           case when trim(name) = '' then 'name' when {listing_link('listing_url')} is null then 'url' end as reject_reason
    from raw_places""", views=["raw_places"])
def popularity_seeds(table):
    checked = validate.check_popularity_seeds(
        table("raw_places").withColumn("url", c("listing_url")))
    return checked.select("place_id", "name", F.coalesce("url", F.lit("")).alias("url"), "reject_reason")


@query("p05_review_requests", f"""
    select place_id, case when host in ('tabelog.com', 'www.tabelog.com') then coalesce({listing_link('listing_url')}, '') else '' end as url,
           left(trim(regexp_replace(name, '\\s+', ' ', 'g')), 120) as name,
           case when host not in ('tabelog.com', 'www.tabelog.com') or {listing_link('listing_url')} is null then 'url'
                when trim(name) = '' then 'name' end as reject_reason
    from (select *, lower(regexp_extract(listing_url, '^https?://([^/?#]*)', 1)) as host from raw_places) t""",
    views=["raw_places"])
def review_requests(table):
    raw = table("raw_places").select("place_id", "name", c("listing_url").alias("url"), c("address").alias("comment"))
    return validate.check_review_requests(raw).withColumn("url", F.coalesce("url", F.lit("")))


@query("p06_shaped_records", """
    select c_custkey, c_name as name, try_cast(cast(c_acctbal as varchar) as double) as rating,
           case when c_custkey % 2 = 0 then c_mktsegment else 'none' end as genres,
           35.0e0 + c_nationkey as latitude, case when c_custkey % 3 = 0 then 'https://x.example.com/b' else '' end as reservation_url
    from customer""")
def shaped_records(table):
    raw = table("customer").select(
        "c_custkey", F.lit("").alias("name"), c("c_name").alias("display_name"), c("c_acctbal").alias("score"),
        F.when(c("c_custkey") % 2 == 0, c("c_mktsegment")).otherwise("").alias("genre"),
        F.array(F.lit("none")).alias("categories"),
        F.struct((F.lit(35.0) + c("c_nationkey")).alias("lat"), F.lit(139.0).alias("lng")).alias("location"),
        F.when(c("c_custkey") % 3 == 0, "https://x.example.com/b").otherwise("mailto:a").alias("booking_url"))
    shaped = records.shape_listings(raw, ["c_custkey"])
    return shaped.select("c_custkey", "name", "rating", F.array_join("genres", ",").alias("genres"), "latitude", "reservation_url")


DETAIL = """(select listing_id, case when listing_id % 2 = 0 then '' else 'D' || phone end as phone,
             case when listing_id % 3 = 0 then null else review_count + 1 end as review_count, 'open' as hours
             from listings where listing_id % 4 < 2)"""


@query("p07_details_first", f"""
    select l.listing_id, l.name, coalesce(nullif(d.phone, ''), l.phone) as phone,
           coalesce(d.review_count, l.review_count) as review_count, coalesce(d.hours, '') as hours
    from listings l left join {DETAIL} d on l.listing_id = d.listing_id""", views=["listings"])
def details_first(table):
    base = table("listings").select("listing_id", "name", "phone", "review_count")
    detail = base.filter(c("listing_id") % 4 < 2).select(
        "listing_id", F.when(c("listing_id") % 2 == 0, "").otherwise(F.concat(F.lit("D"), "phone")).alias("phone"),
        F.when(c("listing_id") % 3 != 0, c("review_count") + 1).alias("review_count"), F.lit("open").alias("hours"))
    merged = records.prefer_details(base, detail, "listing_id")
    return merged.withColumn("hours", F.coalesce("hours", F.lit("")))


COUNTRY = """case when regexp_matches(listing_url, '^https://tabelog\\.com/[a-zA-Z0-9-]+/A\\d+/A\\d+/\\d+/')
       or regexp_matches(phone, '(?:^|[^\\d])\\+81(?:[\\s()\\-]|\\d)')
       or regexp_matches(address, '〒\\s*\\d{3}\\s*[-‐‑–—]?\\s*\\d{4}')
       or regexp_matches(address, '\\bJapan\\b|日本|北海道|東京都|京都府|大阪府') then 'japan'
     when coordinates_source = 'place' and try_cast(latitude as double) is not null and try_cast(longitude as double) is not null
       and not (try_cast(latitude as double) between 20 and 46.5 and try_cast(longitude as double) between 122 and 154.5) then 'not_japan'
     else 'unknown' end"""


@query("p08_country", f"select place_id, {COUNTRY} as country from raw_places", views=["raw_places"])
def country(table):
    columns = ["listing_url", "phone", "address", "latitude", "longitude", "coordinates_source"]
    return table("raw_places").select("place_id", country_of(*[c(x) for x in columns]).alias("country"))


@query("p09_not_overseas", f"""
    select place_id from raw_places where {COUNTRY} <> 'not_japan'""", views=["raw_places"])
def not_overseas(table):
    return validate.drop_overseas(table("raw_places")).select("place_id")


@query("p13_routed_cards", f"""
    , checked as (select card_id, batch_id, trim(key) as key, trim(name) as name, try_cast(latitude as double) as lat,
                  try_cast(longitude as double) as lng, coordinates_source,
                  trim(key) = '' or trim(name) = '' or (latitude <> '' and try_cast(latitude as double) is null) as invalid from cards),
    place as (select card_id as place_id, name, lat as latitude, lng as longitude from checked),
    matched as ({strict_sql('place', 'awards')})
    select k.card_id, left(k.key, 300) as key,
           case when k.invalid then 'invalid'
                when k.coordinates_source = 'place' and k.lat is not null and k.lng is not null
                     and not (k.lat between 20 and 46.5 and k.lng between 122 and 154.5) then 'no_match'
                when m.award_id is null then 'no_match' else 'matched' end as status,
           case when k.invalid or m.award_id is null or (k.coordinates_source = 'place' and k.lat is not null and k.lng is not null
                     and not (k.lat between 20 and 46.5 and k.lng between 122 and 154.5)) then ''
                else a.distinction || case when a.green_star then ' · 綠星' else '' end end as badge
    from checked k left join matched m on k.card_id = m.place_id left join awards a on m.award_id = a.award_id""",
    views=["cards", "awards"])
def routed_cards(table):
    cards = validate.check_batches(table("cards").drop("batch_hint"))
    places = validate.accepted(cards).select(c("card_id").alias("place_id"), "name", "latitude", "longitude")
    linked = link_awards_strict(places, table("awards"))
    badges = table("awards").select("award_id", award_badge(c("distinction"), c("green_star")).alias("badge"))
    routed = validate.route_cards(cards.withColumnRenamed("card_id", "place_id"), linked, badges)
    shown = F.when(c("status") == "matched", c("badge")).otherwise("")
    return routed.select(c("place_id").alias("card_id"), "key", "status", shown.alias("badge"))


@query("s06_typed_badges", f"""
    , checked as (select card_id, trim(key) as key, trim(name) as name, try_cast(latitude as double) as lat,
                  try_cast(longitude as double) as lng, coordinates_source,
                  trim(key) = '' or trim(name) = '' or (latitude <> '' and try_cast(latitude as double) is null) as invalid from cards),
    place as (select card_id as place_id, name, lat as latitude, lng as longitude from checked),
    matched as ({strict_sql('place', 'awards')}),
    told as (select k.*, not (k.coordinates_source = 'place' and k.lat is not null and k.lng is not null
                     and not (k.lat between 20 and 46.5 and k.lng between 122 and 154.5)) as inland, m.award_id
             from checked k left join matched m on k.card_id = m.place_id where not coalesce(k.invalid, false))
    select left(t.key, 300) as key, case when coalesce(inland, true) and t.award_id is not null then 'matched' else 'no_match' end as status,
           a.award_id, a.distinction, a.green_star, '2024-05-01' as run_date
    from told t left join awards a on t.award_id = a.award_id and coalesce(inland, true)""", views=["cards", "awards"])
def typed_badges(table):
    """Outcomes of all cards that are worth storing, written and read back."""
    from workloads.linking import written

    cards = validate.check_batches(table("cards").drop("batch_hint"))
    places = validate.accepted(cards).select(c("card_id").alias("place_id"), "name", "latitude", "longitude")
    linked = link_awards_strict(places, table("awards"))
    badges = table("awards").select("award_id", "distinction", "green_star", award_badge(c("distinction"), c("green_star")).alias("label"))
    routed = validate.remembered(validate.route_cards(cards.withColumnRenamed("card_id", "place_id"), linked, badges))
    matched = c("status") == "matched"
    shown = routed.select("key", "status", *[F.when(matched, c(x)).alias(x) for x in ("award_id", "distinction", "label", "green_star")])
    return written(shown, sinks.BADGES).drop("label")


@query("j15_cards_to_look_up", """
    , stored as (select distinct key from cards where card_id % 3 = 0)
    select card_id, key from cards where key <> '' and key not in (select key from stored)""", views=["cards"])
def cards_to_look_up(table):
    store = table("cards").filter(c("card_id") % 3 == 0).select("key").distinct()
    return validate.still_needed(table("cards"), store).select("card_id", "key")


@query("j15_covered_batches", """
    , flying as (select distinct key from cards where card_id % 9 < 7 or batch_id % 2 = 0)
    select batch_id, bool_and(f.key is not null) as covered
    from cards k left join flying f on k.key = f.key group by batch_id""", views=["cards"])
def covered(table):
    flying = table("cards").filter((c("card_id") % 9 < 7) | (c("batch_id") % 2 == 0)).select("key")
    return validate.covered_batches(table("cards").select("batch_id", "key"), flying)


@query("s05_request_bodies", """
    with b as (select event_id, case when event_id % 11 = 0 then '' when event_id % 11 = 1 then '[1]'
                     when event_id % 11 = 2 then '{bad' when event_id % 11 = 3 then repeat('x', 20000) || props
                     else '{"name":"Shop ' || event_id || '","latitude":' || value || '}' end as body from events)
    select event_id, case when length(body) = 0 or length(body) > 16384 then 'size'
                          when event_id % 11 = 2 then 'json' when event_id % 11 = 1 then 'object' end as reject_reason,
           case when event_id % 11 > 3 then 'Shop ' || event_id else '' end as name
    from b""")
def request_bodies(table):
    body = (F.when(c("event_id") % 11 == 0, "").when(c("event_id") % 11 == 1, "[1]").when(c("event_id") % 11 == 2, "{bad")
            .when(c("event_id") % 11 == 3, F.concat(F.repeat(F.lit("x"), 20000), "props"))
            .otherwise(F.concat(F.lit('{"name":"Shop '), "event_id", F.lit('","latitude":'), "value", F.lit("}"))))
    read = read_requests(table("events").select("event_id", body.alias("body")))
    return read.select("event_id", "reject_reason", F.coalesce("request.name", F.lit("")).alias("name"))


@query("u01_union_new_keys", """
    select listing_id, name, coalesce(phone, '') as phone from listings_dup where listing_id < 1000000
    union all
    select listing_id, name, coalesce(phone, '') from listings_dup d where listing_id >= 1000000
      and coalesce(phone, '') not in (select phone from listings_dup where listing_id < 1000000 and phone is not null)""",
    views=["listings_dup"])
def union_new(table):
    rows = table("listings_dup").select("listing_id", "name", F.coalesce("phone", F.lit("")).alias("phone"))
    known = rows.filter(c("listing_id") < 1000000)
    return records.append_new(known, rows.filter(c("listing_id") >= 1000000), ["phone"])


@query("l03_best_four_enriched", """
    , ranked as (select listing_id, area_path, row_number() over (partition by area_path order by review_count desc, listing_id) as rn from listings)
    select l.listing_id, case when r.rn <= 4 then 'D' || l.phone else l.phone end as phone
    from listings l join ranked r on l.listing_id = r.listing_id""", views=["listings"])
def best_four(table):
    rows = table("listings").select("listing_id", "area_path", "review_count", "phone")
    detail = rows.select("listing_id", F.concat(F.lit("D"), "phone").alias("phone"))
    order = [c("review_count").desc(), c("listing_id").asc()]
    return records.enrich_best(rows, detail, "listing_id", "area_path", order).select("listing_id", "phone")


@query("l06_newest_kept", """
    , aged as (select event_id, session_id, ts, row_number() over (partition by session_id order by ts desc, event_id) as rn
               from requests where ts >= timestamp '2024-01-20 00:00:00')
    select event_id, session_id from aged where rn <= 20""", views=["requests"])
def newest_kept(table):
    rows = table("requests").select("event_id", "session_id", "ts")
    kept = records.keep_newest(rows, ["session_id"], "ts", 20, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return kept.select("event_id", "session_id")


@query("a09_first_per_key", """
    with keyed as (select *, row_number() over (partition by user_id, event_type, cast(floor(value) as integer) order by event_id) as rn from events)
    select user_id, event_type, cast(floor(value) as integer) as amount, event_id from keyed where rn = 1""")
def first_per_key(table):
    rows = table("events").select("user_id", "event_type", F.floor("value").cast("int").alias("amount"), "event_id")
    return records.keep_first(rows, ["user_id", "event_type", "amount"], "event_id")


@query("p12_alternatives", """
    , chosen as (select area_path, max_by(url, review_count * 1000000 - listing_id) as url from listings group by area_path)
    select b.listing_id from chosen a join listings b on a.area_path = b.area_path
    where b.review_count >= 300 and regexp_replace(lower(rtrim(a.url, '/')), 'tabelog\\.com/en/', 'tabelog.com/')
          <> regexp_replace(lower(rtrim(b.url, '/')), 'tabelog\\.com/en/', 'tabelog.com/')""",
    views=["listings"])
def alternatives(table):
    from placeweave.operators.linkage import alternatives as rule

    best = F.max_by("url", c("review_count") * 1000000 - c("listing_id"))
    selected = table("listings").groupBy("area_path").agg(best.alias("chosen"))
    others = table("listings").select(
        "listing_id", "area_path", "url",
        F.when(c("review_count") >= 300, "medium").otherwise("low").alias("confidence"))
    pairs = selected.join(others, "area_path")
    return rule(pairs, listing_compare_key(c("chosen")), listing_compare_key(c("url"))).select("listing_id")
