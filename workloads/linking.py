"""Candidate blocks, pair scores, ranking, ambiguity rules and award linkage."""

import uuid

from pyspark.sql import functions as F

from placeweave.functions.urls import listing_compare_key
from placeweave.operators import awards, linkage, recommend
from placeweave.operators.dedupe import dedupe_catalogue, duplicate_rule
from placeweave.operators.skew import spread, union_all
from placeweave.operators.spatial import within_distance
from placeweave.plans.match import candidate_lists, match_places, match_with_awards
from placeweave.session import cut_lineage
from placeweave.sources import sinks
from workloads.registry import (
    address_area, address_key, asked_words, contained_likeness, folded, held_words, likenesses, listing_link, may_be_alike,
    metres, phone_key, query, website,
)

c = F.col

def places_sql(view="places"):
    return f"""
    p as (select place_id, {folded('name')} as n, {folded('alternate_name')} as alt, {phone_key('phone')} as ph,
                 {address_key('address')} as ad, {website('website')} as web, {listing_link('listing_url')} as link,
                 latitude as lat, longitude as lng, coordinates_source as src, {address_area('address')} as area,
                 {asked_words("coalesce(nullif(trim(alternate_name), ''), name)")} as words from {view})"""


PLACE_KEYS = places_sql()


def listing_sql(view):
    return f"""
    l as (select listing_id, {folded('name')} as n, {phone_key('phone')} as ph, {address_key('address')} as ad,
                 coalesce({listing_link('url')}, url) as link, url, latitude as lat, longitude as lng, rating,
                 review_count, is_relocated, {address_area('address')} as area, {held_words('name')} as words from {view})"""


M = metres("p.lat", "p.lng", "l.lat", "l.lng")
BOX = "abs(p.lat - l.lat) < 0.005 and abs(p.lng - l.lng) < 0.01"
FOUND = f"""
    {may_be_alike('close_names', 'select n as t from p union all select alt from p', 'select n as t from l', 0.88)},
    {likenesses('suggestions', 'select a, b from close_names')},
    suggested as (select distinct place_id, listing_id from suggestions s join p on s.a = p.n or s.a = p.alt join l on l.n = s.b
                  where likeness >= 0.88),
    found as (select place_id, listing_id, min(stage) as stage from (
        select place_id, listing_id, 0 as stage from p join l on p.link = l.link
        union all select place_id, listing_id, 1 from suggested
        union all select place_id, listing_id, 2 from p join l on p.ph = l.ph and p.ph <> ''
        union all select place_id, listing_id, 3 from p join l on {BOX} and {M} <= 500
        union all select place_id, listing_id, 4 from p join l on p.area = l.area and len(p.words) > 0 and list_has_all(l.words, p.words)
                  where place_id not in (select place_id from suggested)) t
      group by place_id, listing_id)"""
PAIRS = f"""
    {likenesses('alike', """select p.n as a, l.n as b from found join p using (place_id) join l using (listing_id)
        union all select p.alt, l.n from found join p using (place_id) join l using (listing_id)
        union all select p.ad, l.ad from found join p using (place_id) join l using (listing_id)""")},
    pairs as (select p.place_id, l.listing_id, f.stage, p.ph as pph, l.ph as lph, {M} as m,
                     greatest(coalesce(x.likeness, 0e0), coalesce(y.likeness, 0e0)) as name, coalesce(z.likeness, 0e0) as address,
                     l.rating, l.review_count, l.is_relocated, l.url, p.src, p.n as pn, p.alt as palt, l.n as ln
              from found f join p on f.place_id = p.place_id join l on f.listing_id = l.listing_id
              left join alike x on x.a = p.n and x.b = l.n left join alike y on y.a = p.alt and y.b = l.n
              left join alike z on z.a = p.ad and z.b = l.ad)"""
STOPPED = """
    evidence as (select place_id, bool_or(stage = 0) as direct,
        (coalesce(bool_or(stage = 1 and pph <> '' and pph = lph), false)
         or (coalesce(bool_or(stage = 1 and m <= 500), false)
             and coalesce(bool_or(stage = 1 and (rating is not null or review_count > 0)), false))) as settled
      from pairs group by place_id),
    kept as (select pairs.* from pairs join evidence e on pairs.place_id = e.place_id
             where stage <= case when direct then 0 when settled then 1 else 9 end)"""
TOTAL = """(case when pph <> '' and pph = lph then 52.0e0 else 0.0e0 end + name * 25.0e0
       + case when address >= 0.45 then address * 35.0e0 else 0.0e0 end
       + case when m <= 100 then 52.0e0 when m <= 1000 then 52.0e0 * (1000 - m) / 900 else 0.0e0 end)"""
SCORED = f"""
    scored as (select *, case when stage = 0 then 98.0e0 else least(round({TOTAL}, 1), 100.0e0) end as score from kept),
    banded as (select *, case when score >= 75 then 'high' when score >= 52 then 'medium' else 'low' end as confidence,
        case when stage = 0 then 'Google Maps 直接提供 Tabelog 店家連結' else
          concat_ws('|', case when pph <> '' and pph = lph then '電話完全相同' end, case when name >= 0.88 then '店名高度相似' end,
            case when address >= 0.82 then '地址高度相似' end, case when m <= 100 then '座標相距 ' || cast(round(m) as bigint) || ' 公尺' end) end as reasons
      from scored)"""


def sql_of(places, listings, *parts):
    return ", " + ",".join([places_sql(places), listing_sql(listings), *parts])


def key_tables(table, places="places", listings="listings"):
    keys = linkage.place_keys(spread(table(places), "place_id")), linkage.listing_keys(spread(table(listings), "listing_id"))
    return tuple(cut_lineage(df) for df in keys)


TOWN = ("places_town", "listings_town")


def award_tables(table, probe):
    return cut_lineage(probe), cut_lineage(awards.award_keys(table("awards_dup")))


@query("j01_scored_pairs", sql_of(*TOWN, FOUND, PAIRS, f"""
    totals as (select *, round({TOTAL}, 1) as total from pairs)""") + """
    select place_id, listing_id, round(name, 6) as name_score, round(address, 6) as address_score, least(total, 100e0) as score,
           concat_ws('|', case when pph <> '' and pph = lph then '電話完全相同' end,
            case when name >= 0.88 then '店名高度相似' end, case when address >= 0.82 then '地址高度相似' end,
            case when m <= 100 then '座標相距 ' || cast(round(m) as bigint) || ' 公尺' end) as reasons from totals""",
    views=TOWN)
def scored_pairs(table):
    place, listing = key_tables(table, *TOWN)
    scored = linkage.score_rows(linkage.candidate_rows(place, listing, linkage.suggestions(place, listing)))
    return scored.select("place_id", "listing_id", F.round("name_score", 6).alias("name_score"),
                         F.round("address_score", 6).alias("address_score"), "score", F.array_join("reasons", "|").alias("reasons"))


@query("j02_candidate_stages", sql_of(*TOWN, FOUND) + """
    select place_id, listing_id, stage from found""", views=TOWN)
def candidate_stages(table):
    return linkage.candidate_pairs(*key_tables(table, *TOWN))


@query("j02_early_stop", sql_of(*TOWN, FOUND, PAIRS, STOPPED) + """
    select place_id, listing_id, stage from kept""", views=TOWN)
def early_stop(table):
    rows = linkage.needed_rows(*key_tables(table, *TOWN))
    return union_all([part.select("place_id", "listing_id", "stage") for part in rows])


@query("j02_fuzzy_names", sql_of("places", "listings", FOUND) + """
    select place_id, listing_id, stage from found""", views=["places", "listings"])
def fuzzy_names(table):
    """Candidate stages of places that keywords cannot help, for want of an area."""
    return linkage.candidate_pairs(*key_tables(table), name_threshold=0.88)


@query("j03_award_pairs", f"""
    , p as (select place_id, latitude as lat, longitude as lng from places),
      l as (select award_id, latitude as lat, longitude as lng from awards_dup)
    select place_id, award_id, round({M}, 4) as distance_m, round(greatest(1 - {M} / 500, 0), 6) as closeness
    from p join l on {BOX} and {M} <= 500""", views=["places", "awards_dup"])
def award_pairs(table):
    place = linkage.place_keys(table("places"))
    award = awards.award_keys(table("awards_dup"))
    pairs = within_distance(
        place.select("place_id", "place_lat", "place_lng"), award.select("award_id", "award_lat", "award_lng"),
        ("place_lat", "place_lng"), ("award_lat", "award_lng"), 500.0)
    return pairs.select("place_id", "award_id", F.round("distance_m", 4).alias("distance_m"),
                        F.round(F.greatest(1 - c("distance_m") / 500, F.lit(0.0)), 6).alias("closeness"))


AWARD_KEYS = f"""
    a as (select award_id, {folded('name')} as n, {phone_key('phone')} as ph, {website('website')} as web,
                 latitude as lat, longitude as lng from awards_dup)"""
AM = metres("p.lat", "p.lng", "a.lat", "a.lng")
AWARD_NAME = f"greatest({contained_likeness('p.n', 'a.n')}, {contained_likeness('p.alt', 'a.n')})"
AWARD_RANKED = f"""
    near as (select place_id, award_id, {AM} as m, {AWARD_NAME} as name, p.ph <> '' and p.ph = a.ph as same_ph, p.web <> '' and p.web = a.web as same_web
             from p join a on abs(p.lat - a.lat) < 0.005 and abs(p.lng - a.lng) < 0.01 and {AM} <= 500),
    signal as (select *, same_ph or same_web as ident, greatest(1 - m / 500, 0) as ds from near),
    pointed as (select *, case when m is null then name * 100 + case when ident then 85 else 0 end
                      when ident then case when same_ph and same_web then 70 else 65 end + ds * 30 + name * 5
                      else name * 65 + ds * 35 end as score
               from signal where ident or case when m is null then name >= 0.94 else name >= 0.45 or m <= 25 end),
    ranked as (select *, row_number() over (partition by place_id order by score desc, name desc, award_id) as rn from pointed),
    winner as (select * from ranked where rn = 1),
    same as (select r.place_id, r.m, row_number() over (partition by r.place_id order by r.score desc, r.name desc, r.award_id) as srn
             from ranked r join winner w on r.place_id = w.place_id where case when w.same_web then r.same_web else r.same_ph end),
    counts as (select w.place_id, (select count(*) from same s where s.place_id = w.place_id) as n_same,
                      (select max(m) from same s where s.place_id = w.place_id and srn = 2) as m2,
                      (select count(*) from ranked r where r.place_id = w.place_id and r.m <= 35) as n_close from winner w),
    accepted as (select w.*, n_same, m2, n_close from winner w join counts k on w.place_id = k.place_id
        where case when ident then n_same = 1 or (m is not null and coalesce(m2 - m >= 25, false))
                   else score >= 70 or (n_close = 1 and m <= 35 and name >= 0.25) end)"""


def whole_awards_sql(awards_view, hints=None, places="places"):
    """CTEs up to ``best``: the award of every place, with and without coordinates, in one or two attempts."""
    second = f"""
      union all
      select p.place_id, 2, p.n, p.alt, {folded('h.name')}, p.ph, p.web,
             case when p.lat is null or p.lng is null then h.latitude else p.lat end,
             case when p.lat is null or p.lng is null then h.longitude else p.lng end
      from p join {hints} h using (place_id)""" if hints else ""
    away = metres("t.lat", "t.lng", "a.lat", "a.lng")
    keys = AWARD_KEYS.replace("from awards_dup", f"from {awards_view}")
    named_places = [places_sql(places)] if places else []
    return ", " + ",".join([*named_places, keys, f"""
    tries as (select place_id, 1 as attempt, n, alt, '' as hint, ph, web, lat, lng from p {second})""",
    may_be_alike("close_names", "select unnest([n, alt, hint]) as t from tries", "select n as t from a", 0.94), f"""
    near as (select place_id, attempt, award_id, {away} as m from tries t join a
             on abs(t.lat - a.lat) < 0.005 and abs(t.lng - a.lng) < 0.01 and {away} <= 500)""",
    likenesses("alike", """select a, b from close_names
      union all select unnest([t.n, t.alt, t.hint]), a.n from near join tries t using (place_id, attempt) join a using (award_id)"""), """
    far as (select t.place_id, t.attempt, a.award_id from tries t join a
              on (t.lat is null or t.lng is null or a.lat is null or a.lng is null) and ((t.ph <> '' and t.ph = a.ph) or (t.web <> '' and t.web = a.web))
            union
            select t.place_id, t.attempt, a.award_id from tries t join alike s on likeness >= 0.94 and s.a in (t.n, t.alt, t.hint) join a on a.n = s.b
            where t.lat is null or t.lng is null or a.lat is null or a.lng is null),
    met as (select * from near union all select *, null from far),
    named as (select x.*, t.ph <> '' and t.ph = a.ph as same_ph, t.web <> '' and t.web = a.web as same_web,
                     greatest(coalesce(i.likeness, 0e0), coalesce(j.likeness, 0e0), coalesce(k.likeness, 0e0)) as name
              from met x join tries t using (place_id, attempt) join a using (award_id)
              left join alike i on i.a = t.n and i.b = a.n left join alike j on j.a = t.alt and j.b = a.n
              left join alike k on k.a = t.hint and k.b = a.n),
    signal as (select *, same_ph or same_web as ident, greatest(1 - m / 500, 0) as ds from named),
    pointed as (select *, case when m is null then name * 100 + case when ident then 85 else 0 end
                      when ident then case when same_ph and same_web then 70 else 65 end + ds * 30 + name * 5
                      else name * 65 + ds * 35 end as score
               from signal where ident or case when m is null then name >= 0.94 else name >= 0.45 or m <= 25 end),
    ranked as (select *, row_number() over (partition by place_id, attempt order by score desc, name desc, award_id) as rn,
                      row_number() over (partition by place_id, attempt, same_web order by score desc, name desc, award_id) as web_rn,
                      row_number() over (partition by place_id, attempt, same_ph order by score desc, name desc, award_id) as ph_rn from pointed),
    counts as (select place_id, attempt, count_if(same_web) as n_web, count_if(same_ph) as n_ph, count_if(coalesce(m <= 35, false)) as n_close,
                      max(m) filter (same_web and web_rn = 2) as m_web, max(m) filter (same_ph and ph_rn = 2) as m_ph from ranked group by all),
    accepted as (select w.* from ranked w join counts k using (place_id, attempt) where w.rn = 1 and
        case when ident then case when same_web then n_web else n_ph end = 1
                             or (m is not null and coalesce(case when same_web then m_web else m_ph end - m >= 25, false))
             else score >= 70 or (n_close = 1 and coalesce(m <= 35, false) and name >= 0.25) end),
    best as (select place_id, attempt, award_id, round(case when ident then least(score, 100) else score end, 1) as match_score,
                    round(name, 3) as name_score, round(m, 3) as distance_m,
                    concat_ws('|', case when same_ph then '電話完全相同' end, case when same_web then '官方網站完全相同' end,
                      case when m is not null then '座標相距 ' || cast(round(m) as bigint) || ' 公尺' end) as reasons
             from accepted qualify row_number() over (partition by place_id order by attempt desc) = 1)"""])


def award_sql(*parts):
    return ", " + ",".join([PLACE_KEYS, AWARD_KEYS, *parts])


@query("w03_award_winners", whole_awards_sql("awards_dup") + """
    select place_id, award_id, match_score, distance_m, reasons from best""", views=["places", "awards_dup"])
def award_winners(table):
    linked = awards.link_awards(table("places"), table("awards_dup"))
    return linked.select("place_id", "award_id", "match_score", F.round("distance_m", 3).alias("distance_m"),
                         F.array_join("reasons", "|").alias("reasons"))


@query("a10_ambiguity_counts", award_sql(AWARD_RANKED) + """
    select place_id, count_if(same_web) as website_matches, count_if(same_ph) as phone_matches, count_if(coalesce(m <= 35, false)) as close_rows
    from ranked group by place_id""", views=["places", "awards_dup"])
def ambiguity_counts(table):
    rows = awards.linkage_rows(*award_tables(table, awards.probes(table("places"))))
    return rows.filter(c("distance_m").isNotNull()).groupBy("place_id").agg(
        F.count_if("same_website").alias("website_matches"), F.count_if("same_phone").alias("phone_matches"),
        F.sum("close").alias("close_rows"))


@query("w04_unique_close_rescue", f"""
    , p as (select place_id, latitude as lat, longitude as lng from places),
      l as (select award_id, latitude as lat, longitude as lng from awards_dup),
      close as (select place_id, min(award_id) as award_id, count(*) as n from p join l on {BOX} and {M} <= 35 group by place_id)
    select place_id, award_id from close where n = 1""", views=["places", "awards_dup"])
def unique_close(table):
    """Probes that share no word with any award: only the one row within 35 m can survive."""
    probe = awards.probes(table("places")).withColumn("place_phone", F.lit("")).withColumn("place_website", F.lit(""))
    award = awards.award_keys(table("awards_dup"))
    near = within_distance(probe, award, ("place_lat", "place_lng"), ("award_lat", "award_lng"), 500.0)
    pairs = near.withColumn("name_score", F.lit(0.3)).withColumn("same_phone", F.lit(False)) \
        .withColumn("same_website", F.lit(False)).filter(c("distance_m") <= 35) \
        .withColumn("score", 19.5 + 35 * (1 - c("distance_m") / 500))
    return awards.choose_award(pairs).select("place_id", "award_id")


STRICT = f"""
    with pk as (select place_id, {folded('name')} as n, latitude as lat, longitude as lng from PLACES),
         ak as (select award_id, {folded('name')} as n, latitude as lat, longitude as lng from AWARDS),
         near as (select place_id, award_id, {contained_likeness('pk.n', 'ak.n')} as name, {metres('pk.lat', 'pk.lng', 'ak.lat', 'ak.lng')} as m
                  from pk join ak on abs(pk.lat - ak.lat) < 0.001 and abs(pk.lng - ak.lng) < 0.002),
         hits as (select place_id, award_id, name * 70 + greatest(1 - m / 100, 0) * 30 as score, name, m from near where m <= 100 and name >= 0.88
                  union all select place_id, award_id, 100.0e0, 1.0e0, null from pk join ak on pk.n = ak.n and pk.n <> '' and pk.lat is null),
         top2 as (select *, row_number() over (partition by place_id order by score desc, name desc, award_id) as rn,
                         lead(score) over (partition by place_id order by score desc, name desc, award_id) as next_score from hits)
    select place_id, award_id, score, m from top2 where rn = 1 and score >= 85 and (next_score is null or next_score < score - 3)"""


def strict_sql(places, awards_view):
    return STRICT.replace("PLACES", places).replace("AWARDS", awards_view)


@query("j04_strict_links", f"""
    , strict as ({strict_sql('places', 'awards_dup')})
    select place_id, award_id, round(score, 3) as score, round(m, 3) as distance_m from strict""", views=["places", "awards_dup"])
def strict_links(table):
    linked = awards.link_awards_strict(table("places"), table("awards_dup"))
    return linked.select("place_id", "award_id", F.round("score", 3).alias("score"), F.round("distance_m", 3).alias("distance_m"))


@query("w02_runner_up_margin", """
    with hits as (select l_orderkey, l_suppkey, max(l_extendedprice / 1000) as score from lineitem group by all),
         top2 as (select *, row_number() over (partition by l_orderkey order by score desc, l_suppkey) as rn,
                         lead(score) over (partition by l_orderkey order by score desc, l_suppkey) as next_score from hits)
    select l_orderkey as place_id, l_suppkey as award_id, round(score, 6) as score from top2
    where rn = 1 and score >= 85 and (next_score is null or next_score < score - 3)""")
def runner_up(table):
    hits = table("lineitem").groupBy(c("l_orderkey").alias("place_id"), c("l_suppkey").alias("award_id")).agg(
        F.max(c("l_extendedprice") / 1000).alias("score"))
    hits = hits.withColumn("name_score", F.lit(1.0)).withColumn("distance_m", F.lit(0.0))
    return awards.first_with_margin(hits, 85.0, 3.0).select("place_id", "award_id", F.round("score", 6).alias("score"))


@query("j05_links_without_coordinates", award_sql("""
    hits as (select place_id, award_id, p.ph <> '' and p.ph = a.ph as same_ph, p.web <> '' and p.web = a.web as same_web
             from p join a on (p.ph <> '' and p.ph = a.ph) or (p.web <> '' and p.web = a.web))""") + """
    select place_id, award_id, same_ph, same_web from hits""", views=["places", "awards_dup"])
def without_coordinates(table):
    """Identity pairs of all places once their coordinates are taken away."""
    probe = awards.probes(table("places")).withColumn("place_lat", F.lit(None).cast("double"))
    pairs = awards.identity_pairs(*award_tables(table, probe))
    return pairs.select(
        "place_id", "award_id", c("same_phone").alias("same_ph"), c("same_website").alias("same_web"))


@query("j05_award_winners_without_coordinates", ", off_map as (select * from places where latitude is null)"
       + whole_awards_sql("awards_dup", places="off_map") + """
    select place_id, attempt, award_id, match_score, name_score, cast(null as double) as distance_m from best""", views=["places", "awards_dup"])
def winners_without_coordinates(table):
    """Winners among names at least 0.94 alike, phones and websites, for places off the map."""
    off_map = table("places").filter(c("latitude").isNull())
    return awards.link_awards(off_map, table("awards_dup")).drop("reasons")


@query("j06_detail_enrichment")
def detail_enrichment(table):
    """Places whose name the award row does not share, linked through detail-page phones."""
    foreign = table("places").withColumn("name", F.concat(F.lit("翻訳"), "place_id")) \
        .withColumn("alternate_name", F.lit(""))
    details = table("listings").select(
        c("listing_id").alias("award_id"), "phone", F.lit("").alias("website"))
    bare = table("awards").withColumn("phone", F.lit("")).withColumn("website", F.lit(""))
    return awards.link_awards(foreign, bare, details=details)


@query("j07_direct_links", f"""
    select p.place_id, l.listing_id from places p join listings l on {listing_link('p.listing_url')} = {listing_link('l.url')}""",
    views=["places", "listings"])
def direct_links(table):
    return linkage.direct_pairs(*key_tables(table))


@query("j08_popularity_ranks", f"""
    select l.listing_id, r.ranking_key, cast(r.pos as integer) as rank,
           case when r.pos <= 5 then 'top5' when r.pos <= 10 then 'top10' else 'top20' end as tier
    from listings l join rankings r on {listing_link('l.url')} = {listing_link('r.url')} and l.area_path = r.area_path
    where r.pos <= 20""", views=["listings", "rankings"])
def popularity_ranks(table):
    ordered = F.array_sort(F.collect_list(F.struct("pos", "url")))
    lists = table("rankings").groupBy("area_path", "ranking_key").agg(ordered.alias("rows"))
    lists = lists.select("area_path", "ranking_key", F.transform("rows", lambda r: r["url"]).alias("urls"))
    return recommend.popularity_tags(table("listings"), lists)


@query("s06_typed_popularity", f"""
    select l.listing_id, r.ranking_key, cast(r.pos as integer) as rank,
           case when r.pos <= 5 then 'top5' when r.pos <= 10 then 'top10' else 'top20' end as tier, '2024-05-01' as run_date
    from listings l join rankings r on {listing_link('l.url')} = {listing_link('r.url')} and l.area_path = r.area_path
    where r.pos <= 20""", views=["listings", "rankings"])
def typed_popularity(table):
    return written(popularity_ranks(table), sinks.POPULARITY)


@query("j13_relocation_successors", f"""
    , k as (select *, regexp_replace(lower(rtrim(url, '/')), 'tabelog\\.com/(?:en|tw)/', 'tabelog.com/') as uk,
                   regexp_replace(lower(rtrim(moved_to, '/')), 'tabelog\\.com/(?:en|tw)/', 'tabelog.com/') as mk from listings)
    select s.listing_id, min_by(m.name, m.listing_id) as old_name from k s join k m on m.is_relocated and m.mk = s.uk group by s.listing_id""",
    views=["listings"])
def successors(table):
    selected = table("listings").select("listing_id", listing_compare_key(c("url")).alias("url_key"))
    moved = table("listings").select("name", "url", "is_relocated", c("listing_id").alias("pos"),
                                     listing_compare_key(c("moved_to")).alias("moved_to_key"))
    return recommend.relocation_notices(selected, moved).select("listing_id", "old_name")


@query("j14_hinted_links", award_sql(f"""
    tries as (select place_id, 1 as attempt, lat, lng from p union all
              select p.place_id, 2, coalesce(p.lat, h.latitude), coalesce(p.lng, h.longitude)
              from p join listings h on p.place_id = h.listing_id),
    hits as (select t.place_id, attempt, a.award_id, {metres('t.lat', 't.lng', 'a.lat', 'a.lng')} as m from tries t join a
             on abs(t.lat - a.lat) < 0.005 and abs(t.lng - a.lng) < 0.01)""") + """
    select place_id, attempt, award_id, round(m, 3) as distance_m from hits where m <= 500""",
    views=["places", "awards_dup", "listings"])
def hinted_links(table):
    hints = table("listings").select(c("listing_id").alias("place_id"), "name", "latitude", "longitude")
    probe = awards.probes(table("places"), hints)
    award = awards.award_keys(table("awards_dup"))
    pairs = within_distance(probe, award, ("place_lat", "place_lng"), ("award_lat", "award_lng"), 500.0)
    return pairs.select("place_id", "attempt", "award_id", F.round("distance_m", 3).alias("distance_m"))


HINTS = ", hints as (select listing_id as place_id, name, latitude, longitude from listings)"


@query("j14_two_pass_awards", HINTS + whole_awards_sql("awards", "hints") + """
    select place_id, attempt, award_id, match_score, name_score, distance_m, reasons from best""", views=["places", "awards", "listings"])
def two_pass(table):
    hints = table("listings").select(c("listing_id").alias("place_id"), "name", "latitude", "longitude")
    linked = awards.link_awards(table("places"), table("awards"), hints)
    return linked.withColumn("distance_m", F.round("distance_m", 3)).withColumn("reasons", F.array_join("reasons", "|"))


RANK = "order by is_relocated, score desc, case when rating is not null then 0 else 1 end, coalesce(review_count, 0) desc, listing_id"


AWARDS_OF_MATCHED = whole_awards_sql("awards", "hints", places=None).replace("alike", "award_alike").replace("close_names", "award_names")


@query("j16_listing_and_award", sql_of("places", "listings", FOUND, PAIRS, STOPPED, SCORED) + f"""
    , first as (select *, row_number() over (partition by place_id {RANK}) as rn from banded),
    chosen as (select * from first where rn = 1 and confidence <> 'low'),
    hints as (select c.place_id, l.name, l.latitude, l.longitude from chosen c join listings l using (listing_id))
    {AWARDS_OF_MATCHED}
    select p.place_id, c.listing_id, c.score, c.confidence, round(case when c.stage > 0 then c.m end, 3) as distance_m,
           c.listing_id is not null as matched, coalesce(c.confidence <> 'high', false) as needs_confirmation, b.award_id, b.match_score,
           case when c.listing_id is null and b.award_id is not null then 'no listing' else '' end as error
    from p left join chosen c on p.place_id = c.place_id left join best b on p.place_id = b.place_id""",
    views=["places", "listings", "awards"])
def listing_and_award(table):
    found = match_with_awards(table("places"), table("listings"), table("awards"))
    return found.drop("reasons").withColumn("distance_m", F.round("distance_m", 3))


@query("w01_ranked_candidates", sql_of(*TOWN, FOUND, PAIRS, STOPPED, SCORED) + f"""
    select place_id, listing_id, score, confidence, reasons || case when is_relocated then '|Tabelog 標示為移轉前資料' else '' end as reasons,
           cast(row_number() over (partition by place_id {RANK}) as integer) as rank from banded""",
    views=TOWN)
def ranked_candidates(table):
    rows = linkage.needed_rows(*key_tables(table, *TOWN))
    ranked = linkage.rank_candidates(linkage.score_rows(rows))
    return ranked.select("place_id", "listing_id", "score", "confidence", F.array_join("reasons", "|").alias("reasons"), "rank")


@query("p15_match_places", sql_of(*TOWN, FOUND, PAIRS, STOPPED, SCORED) + f"""
    , best as (select *, row_number() over (partition by place_id {RANK}) as rn from banded)
    select p.place_id, b.listing_id, b.score, b.confidence, b.listing_id is not null as matched,
           coalesce(b.confidence <> 'high', false) as needs_confirmation
    from p left join best b on p.place_id = b.place_id and b.rn = 1 and b.confidence <> 'low'""",
    views=TOWN)
def matched_places(table):
    matched = match_places(table("places_town"), table("listings_town"))
    return matched.select("place_id", "listing_id", "score", "confidence", "matched", "needs_confirmation")


@query("s06_typed_matches", sql_of(*TOWN, FOUND, PAIRS, STOPPED, SCORED) + f"""
    , best as (select *, row_number() over (partition by place_id {RANK}) as rn from banded)
    select p.place_id, b.listing_id, b.score, b.confidence, b.listing_id is not null as matched,
           coalesce(b.confidence <> 'high', false) as needs_confirmation, '2024-05-01' as run_date
    from p left join best b on p.place_id = b.place_id and b.rn = 1 and b.confidence <> 'low'""",
    views=TOWN)
def typed_matches(table):
    """Matches written as a result table, twice, and read back."""
    matched = cut_lineage(match_places(table("places_town"), table("listings_town")))
    return written(matched, sinks.MATCHES).select(
        "place_id", "listing_id", "score", "confidence", "matched", "needs_confirmation", "run_date")


def written(df, schema, times=2):
    """``df`` as a result table of one day, written several times and read back through its pointer."""
    spark = df.sparkSession
    df = cut_lineage(df)
    path = f"{spark.sparkContext.getCheckpointDir()}/results-{uuid.uuid4().hex}"
    for _ in range(times):
        sinks.write_result(df, schema, path, "2024-05-01")
    return sinks.read_results(spark, path, "2024-05-01")


@query("a05_best_of_names", f"""
    select p.place_id, round(greatest({contained_likeness('p.n', 'l.n')}, {contained_likeness('p.alt', 'l.n')}), 6) as best
    from (select place_id, {folded('name')} as n, {folded('alternate_name')} as alt from places) p
    join (select listing_id, {folded('name')} as n from listings) l on p.place_id = l.listing_id""", views=["places", "listings"])
def best_of_names(table):
    place, listing = key_tables(table)
    pairs = place.join(listing, c("place_id") == c("listing_id"))
    best = linkage.name_likeness(c("listing_name"), c("place_name"), c("place_alternate"))
    return pairs.select("place_id", F.round(best, 6).alias("best"))


@query("a06_match_flags", sql_of(*TOWN, FOUND, PAIRS) + """
    select place_id, coalesce(bool_or(pph <> '' and pph = lph), false) as has_phone,
           coalesce(bool_or((pph <> '' and pph = lph) or coalesce(m <= 500, false)), false) as has_strong,
           bool_or(rating is not null or coalesce(review_count, 0) > 0) as has_reviews
    from pairs group by place_id""", views=TOWN)
def match_flags(table):
    place, listing = key_tables(table, *TOWN)
    evidence = linkage.place_evidence(place, listing, linkage.alike_names(place, listing))
    return evidence.select("place_id", "has_phone", "has_strong", "has_reviews")


@query("a07_decisive_pairs", sql_of(*TOWN, FOUND, PAIRS) + """
    select place_id, listing_id from pairs where not is_relocated and
      ((name >= 0.88 and pph <> '' and pph = lph)
       or (src = 'place' and name >= 0.96 and m <= 150 and (rating is not null or review_count > 0)))""",
    views=TOWN)
def decisive_pairs(table):
    return linkage.decisive_pairs(*key_tables(table, *TOWN))


@query("u02_duplicate_pairs", f"""
    , k as (select listing_id, {folded('name')} as n, {phone_key('phone')} as ph, {address_key('address')} as ad, latitude as lat, longitude as lng from listings_dup)
    select a.listing_id, b.listing_id as other_id from k a join k b on a.listing_id < b.listing_id
      and abs(a.lat - b.lat) < 0.0006 and abs(a.lng - b.lng) < 0.0008
    where {contained_likeness('a.n', 'b.n')} >= 0.95 and ((a.ph <> '' and a.ph = b.ph)
       or {metres('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 50 or {contained_likeness('a.ad', 'b.ad')} >= 0.92)""",
    views=["listings_dup"])
def duplicate_pairs(table):
    from placeweave.functions.text import likeness

    keys = linkage.listing_keys(table("listings_dup")).select(
        "listing_id", "listing_name", "listing_phone", "listing_address", "listing_lat", "listing_lng")
    other = keys.select(*[c(x).alias(f"other_{x}") for x in keys.columns])
    near = within_distance(keys, other, ("listing_lat", "listing_lng"), ("other_listing_lat", "other_listing_lng"), 60.0)
    rule = duplicate_rule(
        F.lit(False), likeness(c("listing_name"), c("other_listing_name"), at_least=0.95),
        (c("listing_phone") != "") & (c("listing_phone") == c("other_listing_phone")), c("distance_m"),
        likeness(c("listing_address"), c("other_listing_address"), at_least=0.92))
    return near.filter((c("listing_id") < c("other_listing_id")) & rule).select(
        "listing_id", c("other_listing_id").alias("other_id"))


@query("u03_deduped_candidates")
def deduped_candidates(table):
    winners, _ = candidate_lists(table("places"), table("listings_dup"), name_threshold=None)
    return winners.select("place_id", "listing_id", "score", "duplicate_count", F.array_join("reasons", "|").alias("reasons"))


@query("u04_catalogue_winners")
def catalogue_winners(table):
    keys = linkage.listing_keys(table("listings_dup"))
    return dedupe_catalogue(keys, listing_compare_key(c("url")))


@query("j01_scored_with_addresses", sql_of("places", "listings_dup", FOUND, PAIRS, f"""
    totals as (select *, least(round({TOTAL}, 1), 100e0) as score from pairs)""") + """
    select place_id, listing_id, score, case when score >= 75 then 'high' when score >= 52 then 'medium' else 'low' end as confidence
    from totals""", views=["places", "listings_dup"])
def scored_with_addresses(table):
    """All candidate pairs with the likeness of their addresses."""
    place, listing = key_tables(table, "places", "listings_dup")
    rows = linkage.candidate_rows(place, listing, linkage.suggestions(place, listing))
    return linkage.score_rows(rows).select("place_id", "listing_id", "score", "confidence")


@query("p15_selection_rule", """
    with b as (select o_orderkey as place_id, o_totalprice / 5000 as score from orders)
    select place_id, score >= 52 as matched, score >= 52 and score < 75 as needs_confirmation from b""")
def selection_rule(table):
    from placeweave.functions.labels import confidence_of

    best = table("orders").select(
        c("o_orderkey").alias("place_id"), c("o_custkey").alias("listing_id"), (c("o_totalprice") / 5000).alias("score"),
        confidence_of(c("o_totalprice") / 5000).alias("confidence"), F.array().cast("array<string>").alias("reasons"),
        F.lit(None).cast("double").alias("distance_m"))
    return linkage.select_match(best, best).select("place_id", "matched", "needs_confirmation")
