"""Category lists, similarity scores, top lists and diagnostics."""

from pyspark.sql import functions as F

from placeweave import fixed
from placeweave.functions import nearby
from placeweave.operators import history, recommend, records
from placeweave.session import cut_lineage
from workloads.registry import folded, query

c = F.col



def with_genres(listings):
    return listings.withColumn("genres", F.split("genre_text", ","))


def pooled(table, of):
    """Seeds beside the candidates that their category lists give, at most 30 each."""
    seeds = with_genres(table("listings")).withColumn("seed_id", c("listing_id"))
    pairs = of(seeds, category_lists(table))
    # The links of the proxy listings end in their number.
    number = F.regexp_extract("cand_url", "([0-9]+)/?$", 1).cast("bigint") - 13000000
    return pairs.withColumn("cand_id", number)


def pool(table):
    return pooled(table, recommend.seed_pool)


def scored(table):
    return pooled(table, recommend.scored_pool)


def dictionary_sql():
    words = sorted(fixed.GENRE_SLUGS, key=len, reverse=True)
    rows = ", ".join(f"({i}, '{w}', '{fixed.GENRE_SLUGS[w]}')" for i, w in enumerate(words))
    return f"dict(pos, word, slug) as (values {rows})"


SLUG_SQL = f"""
    , {dictionary_sql()},
    g as (select listing_id, area_path, unnest(split(genre_text, ',')) as genre, generate_subscripts(split(genre_text, ','), 1) as gpos from listings),
    hit as (select listing_id, area_path, gpos, min_by(slug, pos) as slug from g join dict on contains(genre, word) group by all),
    one as (select listing_id, area_path, slug, min(gpos) as gpos from hit group by all),
    slugs as (select listing_id, area_path, slug, row_number() over (partition by listing_id order by gpos) - 1 as list_pos from one)"""


LISTS_SQL = SLUG_SQL + """
    , lists as (select s.area_path, s.slug, l.listing_id, l.url, l.name, l.rating, l.genre_text,
                row_number() over (partition by s.area_path, s.slug order by l.listing_id desc) as row_pos
                from slugs s join listings l on s.listing_id = l.listing_id where s.list_pos < 3),
    wanted as (select s.listing_id as seed_id, s.list_pos, t.row_pos, t.url, t.name, t.rating, t.genre_text
               from slugs s join lists t on s.area_path = t.area_path and s.slug = t.slug where s.list_pos < 3 and t.row_pos <= 20),
    firsts as (select seed_id, url, min(list_pos * 1000 + row_pos) as p from wanted group by all),
    turns as (select *, row_number() over (partition by seed_id order by p) as turn from firsts),
    ends as (select seed_id, count(*) as n, max(p) as e from turns where turn <= 30 group by seed_id),
    read as (select w.* from wanted w join ends e on w.seed_id = e.seed_id where e.n < 30 or w.list_pos * 1000 + w.row_pos <= e.e)"""


MID = ("(case when len(regexp_extract_all({0}, '[0-9][0-9,]*')) = 0 then null else "
       "list_avg(list_transform(regexp_extract_all({0}, '[0-9][0-9,]*')[1:2], lambda x: cast(replace(x, ',', '') as double))) end)")
BROAD = "['カフェ', '喫茶店', 'バー', 'バル', 'バー・お酒', 'ダイニングバー', '居酒屋', '食堂', 'レストラン']"
GENRE_KEY = folded("g")
SIDES = LISTS_SQL + f"""
    , side as (select listing_id, area_path, rtrim(url, '/') as url, name, rating, review_count, station,
                      {folded("station")} as sk, {MID.format('dinner_price')} as d, {MID.format('lunch_price')} as l,
                      split(genre_text, ',') as gs, list_transform(split(genre_text, ','), lambda g: {GENRE_KEY}) as gk from listings),
    pair as (select s.listing_id as seed_id, t.listing_id as cand_id, s.area_path, s.url as su, t.url as tu, t.name, t.rating, t.review_count,
                    s.sk as ssk, t.sk as tsk, s.station, s.d as sd, t.d as td, s.l as sl, t.l as tl, s.gk as sgk, s.gs as sgs, t.gk as tgk,
                    list_filter(s.gk, lambda a: len(list_filter(t.gk, lambda b: a <> '' and b <> '' and (a = b or (length(a) >= 2 and (contains(a, b) or contains(b, a)))))) > 0) as hits
             from (select distinct seed_id, rtrim(url, '/') as link from read) p
             join side s on s.listing_id = p.seed_id join side t on t.url = p.link),
    points as (select *,
        case when len(hits) = 0 then 0.0e0
             when len(list_filter(hits, lambda h: not list_contains({BROAD}, h))) > 0 then 45.0e0
             when len(list_filter(sgk, lambda h: not list_contains({BROAD}, h))) > 0 then 5.0e0 else 45.0e0 end as gp,
        case when ssk <> '' and ssk = tsk then 25.0e0 else 20.0e0 end as lp,
        case when abs(sd - td) <= 2500 then 15.0e0 when abs(sd - td) <= 6000 then 8.0e0
             when abs(sl - tl) <= 2500 then 15.0e0 when abs(sl - tl) <= 6000 then 8.0e0 else 0.0e0 end as pp,
        least(8.0e0, coalesce(rating, 0) / 5 * 8) + least(7.0e0, log10(review_count + 1) / 3 * 7) as rp from pair),
    graded as (select *, gp + lp + pp + rp as raw, round(least(gp + lp + pp + rp, 100.0e0)) as score, su = tu as same from points)"""


@query("h16_location_points", SIDES + """
    select seed_id, cand_id, lp as points,
           case when lp = 25 then '同為' || station || '站' else '同一 Tabelog 區域' end as reason from graded""", views=["listings"])
def location_points(table):
    hit = nearby.location_evidence(c("seed_area_path"), c("seed_station"), c("cand_area"))
    return pool(table).select("seed_id", "cand_id", hit.alias("h")).select("seed_id", "cand_id", "h.*")


@query("h19_genre_points", SIDES + """
    select seed_id, cand_id, gp as points from graded""", views=["listings"])
def genre_points(table):
    hit = nearby.genre_evidence(c("seed_genres"), c("seed_genre_keys"), c("cand_genre_keys"))
    return pool(table).select("seed_id", "cand_id", hit["points"].alias("points"))


@query("j10_similar_pairs", SIDES + """
    select seed_id, cand_id, round(raw, 6) as raw_score, case when same then 'same' else 'scored' end as outcome from graded""",
    views=["listings"])
def similar_pairs(table):
    return scored(table).select("seed_id", "cand_id", F.round("raw_score", 6).alias("raw_score"), "outcome")


@query("p16_not_same_entity", SIDES + """
    select seed_id, cand_id from graded where not same""", views=["listings"])
def not_same(table):
    return scored(table).filter(c("outcome") != "same").select("seed_id", "cand_id")


@query("w05_top_recommendations", SIDES + """
    , ranked as (select seed_id, cand_id, score, row_number() over (partition by seed_id
        order by score desc, coalesce(rating, 0) desc, coalesce(review_count, 0) desc, name, tu) as rn
      from graded where not same and raw >= 35)
    select seed_id, cand_id, cast(score as integer) as similarity_score, cast(rn as integer) as rank from ranked where rn <= 6""",
    views=["listings"])
def top_recommendations(table):
    return recommend.recommend(scored(table)).select("seed_id", "cand_id", "similarity_score", "rank")


@query("s06_typed_recommendations", SIDES + """
    , ranked as (select seed_id, tu, name, score, row_number() over (partition by seed_id
        order by score desc, coalesce(rating, 0) desc, coalesce(review_count, 0) desc, name, tu) as rn
      from graded where not same and raw >= 35)
    select seed_id, cast(rn as integer) as rank, name, tu as cand_url, cast(score as integer) as similarity_score, '2024-05-01' as run_date
    from ranked where rn <= 6""", views=["listings"])
def typed_recommendations(table):
    from placeweave.sources import sinks
    from workloads.linking import written

    best = recommend.recommend(scored(table)).withColumnRenamed("cand_name", "name")
    return written(best, sinks.RECOMMENDATIONS).select(
        "seed_id", "rank", "name", F.regexp_replace("cand_url", "/+$", "").alias("cand_url"), "similarity_score", "run_date")


@query("a01_similar_diagnostics", SIDES + """
    select seed_id, count(*) as returned_count, count_if(same) as same_restaurant_count, cast(0 as bigint) as unverified_location_count,
           count_if(not same and raw < 35) as below_quality_count, least(count_if(not same and raw >= 35), 6) as recommendation_count
    from graded group by seed_id""", views=["listings"])
def diagnostics(table):
    return recommend.similar_diagnostics(scored(table))


def sort_sql(order):
    return SIDES + f"""
    , shown as (select seed_id, cand_id, cast(row_number() over (partition by seed_id order by {order}, name, tu) as integer) as display_rank from graded)"""


def sorted_by(table, mode, expanded=True):
    return recommend.visible(scored(table), mode, expanded).select("seed_id", "cand_id", "display_rank")


ORDERS = {
    "recommended": "score desc, coalesce(rating, -1) desc, review_count desc",
    "rating": "coalesce(rating, -1) desc, review_count desc, score desc",
    "reviews": "review_count desc, coalesce(rating, -1) desc, score desc",
}


@query("l01_sorted_recommended", sort_sql(ORDERS["recommended"]) + " select * from shown", views=["listings"])
def sorted_recommended(table):
    return sorted_by(table, "recommended")


@query("l01_sorted_rating", sort_sql(ORDERS["rating"]) + " select * from shown", views=["listings"])
def sorted_rating(table):
    return sorted_by(table, "rating")


@query("l01_sorted_reviews", sort_sql(ORDERS["reviews"]) + " select * from shown", views=["listings"])
def sorted_reviews(table):
    return sorted_by(table, "reviews")


@query("l02_visible_three", sort_sql(ORDERS["recommended"]) + " select * from shown where display_rank <= 3", views=["listings"])
def visible_three(table):
    return sorted_by(table, "recommended", expanded=False)


@query("j11_category_slugs", SLUG_SQL + """
    select listing_id, string_agg(slug, ',' order by list_pos) as slugs from slugs where list_pos < 3 group by listing_id""",
    views=["listings"])
def category_slugs(table):
    rows = with_genres(table("listings"))
    return rows.select("listing_id", F.array_join(recommend.genre_slugs(c("genres")), ",").alias("slugs"))


def category_lists(table):
    slugs = recommend.genre_slugs(c("genres"))
    rows = cut_lineage(with_genres(table("listings")).withColumn("slugs", slugs))
    return rows.withColumn("slug", F.explode("slugs")).select("area_path", "slug", (-c("listing_id")).alias("row_pos"), "url", "name", "rating", "genres",
        "review_count", "address", "station", "area", "lunch_price", "dinner_price")


def category_pool(table):
    seeds = with_genres(table("listings")).select(
        c("listing_id").alias("seed_id"), "area_path", recommend.genre_slugs(c("genres")).alias("slugs"))
    return recommend.category_candidates(seeds, category_lists(table))


@query("j09_category_candidates", LISTS_SQL + """
    select distinct seed_id, url from read""", views=["listings"])
def category_candidates(table):
    return category_pool(table).select("seed_id", "url")


@query("a04_merged_lists", LISTS_SQL + """
    , g2 as (select seed_id, url, list_pos, row_pos, unnest(split(genre_text, ',')) as genre, generate_subscripts(split(genre_text, ','), 1) as gp from read),
    g3 as (select seed_id, url, genre, min(list_pos * 100000 + row_pos * 10 + gp) as p from g2 group by all)
    select r.seed_id, r.url, min(r.name) as name, min(r.rating) as rating, g.genres
    from read r join (select seed_id, url, string_agg(genre, ',' order by p) as genres from g3 group by all) g
      on r.seed_id = g.seed_id and r.url = g.url group by r.seed_id, r.url, g.genres""", views=["listings"])
def merged_lists(table):
    return category_pool(table).select("seed_id", "url", "name", "rating", F.array_join("genres", ",").alias("genres"))


@query("j12_slug_from_labels", f"""
    , labels as (select area_path, min(listing_id) as pos, {folded("area")} as lk, 'slug' || min(listing_id) as slug from listings group by area_path, area),
    seeds as (select listing_id, area_path, list_transform(split(name, ' '), lambda g: {folded("g")}) as gk from listings),
    cross_ as (select s.listing_id, unnest(s.gk) as g, generate_subscripts(s.gk, 1) as gp, l.lk, l.pos, l.slug
               from seeds s join labels l on s.area_path = l.area_path),
    scored as (select *, case when g = lk then 10000 + length(g) when contains(g, lk) or contains(lk, g) then least(length(g), length(lk)) end as score
               from cross_ where g <> '' and lk <> '')
    select listing_id, slug from (select *, row_number() over (partition by listing_id order by score desc, gp, pos) as rn
      from scored where score is not null) t where rn = 1""", views=["listings"])
def dynamic_slug(table):
    # A page offers one label per neighbourhood, 25 in all, whatever the number of listings.
    rows = table("listings").groupBy("area_path", c("area").alias("label")).agg(F.min("listing_id").alias("listing_id"))
    labelled = recommend.folded_labels(rows).select(
        "area_path", F.struct("listing_id", "label_key", F.concat(F.lit("slug"), "listing_id").alias("slug")).alias("link"))
    pages = labelled.groupBy("area_path").agg(F.array_sort(F.collect_list("link")).alias("links"))
    seeds = table("listings").select("listing_id", "area_path", nearby.fold_texts(F.split("name", " ")).alias("gk"))
    return seeds.join(pages, "area_path").select(
        "listing_id", recommend.slug_from_labels(c("gk"), c("links")).alias("slug"))


@query("w06_first_distinct", """
    with firsts as (select user_id, event_type, min(event_id) as p from events group by all)
    select user_id, event_type, cast(rn as integer) as rank from
      (select *, row_number() over (partition by user_id order by p) as rn from firsts) t where rn <= 3""")
def first_distinct(table):
    return records.first_distinct(table("events"), "user_id", "event_type", "event_id", 3)


@query("a08_award_years", """
    with y as (select distinct o_custkey, cast(extract(year from o_orderdate) as integer) + 20 * cast(o_orderkey % 6 as integer) as yr from orders),
    r as (select *, row_number() over (partition by o_custkey order by yr desc) as rn from y where yr between 1990 and 2100)
    select o_custkey, string_agg(cast(yr as varchar), ',' order by yr desc) as years from r where rn <= 8 group by o_custkey""")
def award_years(table):
    year = F.year("o_orderdate") + (20 * (c("o_orderkey") % 6)).cast("int")
    rows = table("orders").groupBy("o_custkey").agg(F.collect_set(year).alias("years"))
    kept = rows.select("o_custkey", history.award_years(c("years")).alias("years"))
    return kept.filter(F.size("years") > 0).select(
        "o_custkey", F.array_join(c("years").cast("array<string>"), ",").alias("years"))


@query("l04_award_order", """
    select o_orderkey, cast(row_number() over (partition by o_custkey order by extract(year from o_orderdate) desc, o_orderpriority desc, o_orderstatus desc, o_orderkey) as integer) as rank
    from orders""")
def award_order(table):
    from pyspark.sql import Window

    rows = table("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"),
                                  c("o_orderpriority").alias("category"), c("o_orderstatus").alias("area"))
    order = Window.partitionBy("o_custkey").orderBy(*history.history_order(), "o_orderkey")
    return rows.select("o_orderkey", F.row_number().over(order).alias("rank"))


@query("l05_timeline", """
    , past as (select o_custkey as listing_id, o_orderkey as pos, cast(extract(year from o_orderdate) as integer) as year, '百名店 · ' || o_orderpriority as label, o_orderstatus as url from orders),
    kept as (select listing_id, year, label, url, min(pos) as pos from past group by all),
    entries as (select listing_id, -1 as pos, 'current' as kind, cast(null as integer) as year, 'Michelin ' || distinction || case when green_star then ' · 綠星' else '' end as label
                from (select award_id as listing_id, distinction, green_star from awards) a where listing_id in (select listing_id from kept)
                union all select listing_id, pos, 'history', year, label from kept)
    select listing_id, kind, year, label, cast(row_number() over (partition by listing_id order by kind = 'history', year desc, pos) as integer) as turn from entries""",
    views=["awards"])
def timeline(table):
    from pyspark.sql import Window

    past = table("orders").select(
        c("o_custkey").alias("listing_id"), c("o_orderkey").alias("pos"), c("o_orderpriority").alias("category"),
        F.lit("").alias("area"), F.year("o_orderdate").alias("year"), c("o_orderstatus").alias("url"))
    now = table("awards").select(
        c("award_id").alias("listing_id"), c("distinction").alias("distinction_label"), "green_star", c("website").alias("url"))
    order = Window.partitionBy("listing_id").orderBy(*history.timeline_order())
    return history.timeline(now, past).select(
        "listing_id", "kind", "year", "label", F.row_number().over(order).alias("turn"))


@query("s04_dictionary_coverage", f"""
    , {dictionary_sql()}, g as (select unnest(split(genre_text, ',')) as genre from listings)
    select genre, count(*) as listings, min_by(slug, pos) as slug from
      (select genre, row_number() over () as id from g) g2 join dict on contains(genre, word) group by genre""", views=["listings"])
def dictionary_coverage(table):
    genres = with_genres(table("listings")).select(F.explode("genres").alias("genre"))
    hits = F.size(F.filter(F.array(*[F.lit(w) for w in fixed.GENRE_SLUGS]), lambda w: c("genre").contains(w)))
    slug = F.get(recommend.genre_slugs(F.array("genre")), 0)
    counted = genres.select("genre", slug.alias("slug"), hits.alias("hits")).filter(c("slug").isNotNull())
    return counted.groupBy("genre", "slug").agg(F.sum("hits").cast("bigint").alias("listings"))
