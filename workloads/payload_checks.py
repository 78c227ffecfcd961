"""Payloads for a language model and checks of its answers."""

from pyspark.sql import functions as F

from placeweave.functions.keys import facts_key
from placeweave.operators import payloads, recommend
from workloads.recommending import SIDES, scored
from workloads.registry import query

c = F.col


@query("p14_facts", """
    , y as (select o_custkey as listing_id, string_agg(distinct cast(extract(year from o_orderdate) as varchar), ',' order by cast(extract(year from o_orderdate) as varchar) desc) as years
            from orders group by o_custkey)
    select l.listing_id, l.name as restaurant_name, l.address as area, l.rating as tabelog_rating, l.review_count as tabelog_review_count,
           case when l.lunch_price <> '' then l.lunch_price end as lunch_price, y.years, l.listing_id % 3 = 0 as online
    from listings l left join y on l.listing_id = y.listing_id""", views=["listings"])
def facts(table):
    years = table("orders").groupBy(c("o_custkey").alias("listing_id")).agg(
        F.collect_set(F.year("o_orderdate")).alias("years"))
    rows = table("listings").join(years, "listing_id", "left").withColumn("genres", F.split("genre_text", ","))
    candidate = {n: c(n) for n in ("name", "address", "genres", "rating", "review_count", "lunch_price", "dinner_price", "years")}
    candidate["reservation_url"] = F.when(c("listing_id") % 3 == 0, "https://book").otherwise("")
    columns = payloads.facts_of(candidate, {}, {})
    named = rows.select("listing_id", *[v.alias(k) for k, v in columns.items()])
    read = named.select("listing_id", payloads.facts(named).alias("f"))
    return read.select(
        "listing_id", "f.restaurant_name", "f.area", "f.tabelog_rating", "f.tabelog_review_count", "f.lunch_price",
        F.array_join(c("f.hyakumeiten_years").cast("array<string>"), ",").alias("years"),
        c("f.has_online_reservation").alias("online"))


@query("h24_facts_key", """
    select listing_id, sha256('{"facts":{"restaurant_name":"' || name || '","tabelog_review_count":' || review_count || '},"version":"zh-Hant-v3"}') as key
    from listings""", views=["listings"])
def facts_keys(table):
    named = table("listings").select("listing_id", c("name").alias("restaurant_name"), c("review_count").alias("tabelog_review_count"))
    return named.select("listing_id", facts_key(payloads.facts(named)).alias("key"))


W7 = """
    with t as (select source, doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 480) as k from documents),
    n as (select *, row_number() over (partition by source order by doc_id) as turn from t where k <> ''),
    s as (select *, coalesce(sum(length(k)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from n where turn <= 20),
    kept as (select source, doc_id, turn, left(k, cast(9000 - before as integer)) as k from s where 9000 - before > 0 and (before + length(k) <= 9000 or 9000 - before >= 40))"""


@query("w07_text_budget", W7 + """
    select source, doc_id, cast(turn as integer) as turn, length(k) as kept_length, k as kept_text from kept""")
def text_budget(table):
    kept = payloads.budget_texts(table("documents").select("source", "doc_id", "text"), "source", "doc_id", "text")
    return kept.select("source", "doc_id", "turn", F.length("kept_text").cast("bigint").alias("kept_length"), "kept_text")


@query("v05_review_payloads", W7 + """
    select source, cast(count(*) as integer) as sample_size from kept group by source""")
def review_payloads(table):
    kept = payloads.budget_texts(
        table("documents").select("source", "doc_id", "text", c("source").alias("place")), "source", "doc_id", "text")
    payload = payloads.review_payload(kept, "source", "place")
    size = F.from_json("payload", "struct<sample_size:int,anonymized_reviews:array<struct<index:int,text:string>>>")
    return payload.select("source", size["sample_size"].alias("sample_size"))


def ranked_pool(table):
    return recommend.recommend(scored(table), minimum=0.0, top=30)


POOL = SIDES + """
    , pool as (select *, row_number() over (partition by seed_id order by score desc, coalesce(rating, 0) desc, coalesce(review_count, 0) desc, name, tu) as rn
               from graded where not same),
    rules as (select *, row_number() over (partition by seed_id order by score desc, coalesce(rating, 0) desc, coalesce(review_count, 0) desc, name, tu) as rn
              from graded where not same and raw >= 35)"""


@query("v01_rerank_payloads", POOL + """
    select seed_id, cast(count(*) as integer) as candidate_count, 'c0' as first_id, min_by(left(name, 160), rn) as first_name,
           max_by(left(name, 160), rn) as last_name from pool where rn <= 30 group by seed_id""", views=["listings"])
def rerank_payloads(table):
    pool = ranked_pool(table).select("seed_id", "rank", "name", c("cand_genres").alias("genres"), "rating", "review_count")
    seeds = table("listings").withColumn("seed_id", c("listing_id")).withColumn("genres", F.split("genre_text", ","))
    payload = payloads.rerank_payload(seeds, pool)
    read = F.from_json("payload", "struct<candidates:array<struct<id:string,name:string>>>")["candidates"]
    return payload.select("seed_id", "candidate_count", F.get(read, 0)["id"].alias("first_id"),
                          F.get(read, 0)["name"].alias("first_name"), F.try_element_at(read, F.lit(-1))["name"].alias("last_name"))


def answers(table):
    """A stand-in answer per seed: sound, out of range, unknown id, repeated id, or no JSON."""
    seed = c("listing_id")
    good = F.concat(F.lit('{"ranking":[{"id":"c1","score":'), seed % 100, F.lit(',"reason":"close"},{"id":"c0","score":"50","reason":" near  by "}]}'))
    return table("listings").select(
        seed.alias("seed_id"),
        F.when(seed % 6 == 0, '{"ranking":[{"id":"c1","score":101,"reason":"x"}]}')
        .when(seed % 6 == 1, '{"ranking":[{"id":"c99","score":10,"reason":"x"}]}')
        .when(seed % 6 == 2, '{"ranking":[{"id":"c1","score":10,"reason":"x"},{"id":"c1","score":9,"reason":"y"}]}')
        .when(seed % 6 == 3, "no json").otherwise(good).alias("answer"))


@query("v02_checked_rankings", """
    select p_partkey as seed_id, p_partkey % 6 in (4, 5) as valid,
           case when p_partkey % 6 in (4, 5) then 'c1:' || (p_partkey % 100) || ':close,c0:50:near by' else '' end as ranking
    from part""")
def checked_rankings(table):
    ranking = payloads.check_ranking(c("answer"), F.lit(30))
    shown = F.transform("ranking", lambda r: F.concat_ws(":", r["id"], r["score"].cast("string"), r["reason"]))
    return answers(table).select("seed_id", ranking.alias("ranking")).select(
        "seed_id", c("ranking").isNotNull().alias("valid"), F.coalesce(F.array_join(shown, ","), F.lit("")).alias("ranking"))


def checked(table):
    return answers(table).select(
        "seed_id", payloads.check_ranking(c("answer"), F.lit(2)).alias("ranking"), F.lit(True).alias("answered"))


@query("j17_reattached", POOL + """
    , n as (select unnest([1, 2]) as answer_rank)
    select p.seed_id, p.cand_id, cast(answer_rank as integer) as answer_rank, case when answer_rank = 1 then cast(p.seed_id % 100 as integer) else 50 end as answer_score
    from pool p join n on p.rn = case when answer_rank = 1 then 2 else 1 end where p.seed_id % 6 in (4, 5)""", views=["listings"])
def reattached(table):
    pool = ranked_pool(table).select("seed_id", "rank", "cand_id")
    return payloads.reattach(checked(table).filter(c("ranking").isNotNull()), pool).select(
        "seed_id", "cand_id", "answer_rank", "answer_score")


@query("v03_fallback", POOL + """
    , n as (select unnest([1, 2]) as answer_rank)
    select p.seed_id, p.tu as cand_url, cast(answer_rank as integer) as rank, 'ai' as ranking_source
    from pool p join n on p.rn = case when answer_rank = 1 then 2 else 1 end where p.seed_id % 6 in (4, 5)
    union all select seed_id, tu, cast(rn as integer), 'rules' from rules where rn <= 6 and seed_id % 6 < 4""", views=["listings"])
def fallback(table):
    graded = scored(table)
    pool = recommend.recommend(graded, 0.0, 30).select("seed_id", "rank", "cand_url")
    mixed = payloads.with_fallback(checked(table), pool, recommend.recommend(graded))
    return mixed.select("seed_id", "cand_url", "rank", "ranking_source")


@query("v03_fallback_diagnostics", SIDES + """
    , r as (select seed_id, count(*) as returned, count_if(not same and raw < 35) as below, least(count_if(not same and raw >= 35), 6) as shown,
                   least(count_if(not same), 30) as pool from graded group by seed_id)
    select seed_id, returned as returned_count, cast(case when seed_id % 6 in (4, 5) then greatest(pool - 2, 0) else below end as bigint) as below_quality_count,
           cast(case when seed_id % 6 in (4, 5) then 2 else shown end as bigint) as recommendation_count,
           case when seed_id % 6 in (4, 5) then 'ai' else 'rules' end as ranking_source,
           cast(case when seed_id % 6 in (4, 5) then pool else 0 end as bigint) as ai_candidate_count, seed_id % 6 < 4 as ai_fallback from r""",
    views=["listings"])
def fallback_diagnostics(table):
    graded = scored(table)
    rules, pool = recommend.similar_diagnostics(graded), recommend.similar_diagnostics(graded, 0.0, 30)
    return payloads.fallback_diagnostics(checked(table), rules, pool).select(
        "seed_id", "returned_count", "below_quality_count", "recommendation_count", "ranking_source",
        c("ai_candidate_count").cast("bigint").alias("ai_candidate_count"), "ai_fallback")


@query("v04_checked_advice", """
    select doc_id, left(trim(regexp_replace(lang || ' 評分 3.5，約 120 元', '\\s+', ' ', 'g')), 220) as summary, '用餐建議' as headline,
           'a' || doc_id || '|b2' as best_for
    from documents where doc_id % 4 <> 0""")
def checked_advice(table):
    answer = F.to_json(F.struct(
        F.when(c("doc_id") % 4 != 0, F.concat("lang", F.lit("  評分 三點五，約 一百二十 元"))).otherwise("").alias("summary"),
        F.array(F.concat(F.lit("a"), "doc_id"), F.lit(" b二 "), F.lit("")).alias("best_for")))
    read = table("documents").select("doc_id", payloads.check_advice(answer).alias("a")).filter(c("a").isNotNull())
    return read.select("doc_id", "a.summary", "a.headline", F.array_join("a.best_for", "|").alias("best_for"))


@query("v05_checked_summaries", """
    select doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 280) as summary,
           cast(case when doc_id % 3 = 0 then 7 when doc_id % 3 = 1 then 12 else 12 end as integer) as sample_size
    from documents where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def checked_summaries(table):
    size = F.when(c("doc_id") % 3 == 0, "7").when(c("doc_id") % 3 == 1, "99").otherwise("many")
    answer = F.to_json(F.struct(c("text").alias("summary"), size.alias("sample_size")))
    read = table("documents").select("doc_id", payloads.check_review_summary(answer, F.lit(12)).alias("a"))
    return read.filter(c("a").isNotNull()).select("doc_id", "a.summary", c("a.sample_size").cast("int").alias("sample_size"))


@query("v06_storable_summaries", """
    select source as listing_key, min(doc_id) as sample_size from documents group by source""")
def storable(table):
    rows = table("documents").groupBy(c("source").alias("listing_key")).agg(
        F.min("doc_id").alias("sample_size"), F.min("text").alias("review_body"), F.min("lang").alias("author"))
    return payloads.storable_summary(rows)


@query("a11_failure_counts", """
    with m as (select user_id, case event_type when 'error' then 'HTTP 403 Forbidden' when 'view' then 'status 404' when 'click' then 'read timed out'
                     when 'signup' then 'got 503 from host' else 'odd' end as message from events)
    select user_id, case when contains(message, '403') then 'forbidden' when contains(message, '404') then 'not_found' when contains(message, 'timed out') then 'timeout'
           when contains(message, '503') then 'http_error' else 'fetch_error' end as failure, count(*) as failures from m group by all""")
def failure_counts(table):
    kind = c("event_type")
    message = (F.when(kind == "error", "HTTP 403 Forbidden").when(kind == "view", "status 404").when(kind == "click", "read timed out")
               .when(kind == "signup", "got 503 from host").otherwise("odd"))
    return payloads.failure_counts(table("events").select("user_id", message.alias("message")), "message", ["user_id"])
