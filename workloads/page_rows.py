"""Rows read from stored pages and the snapshot jobs on top of them."""

from pyspark.sql import functions as F

from placeweave.operators.awards import award_keys
from placeweave.operators.records import prefer_details
from placeweave.operators.skew import spread
from placeweave.sources import pages, snapshot
from placeweave.functions.labels import payment_of, reservation_state
from workloads.registry import folded, phone_key, query, website

c = F.col

ANCHORS = """
    with a as (select page_id, unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>|<!--.*?-->', '', 'gs'), '<a\\s[^>]*?href="([^"]*)"', 1)) as href,
                      generate_subscripts(regexp_extract_all(regexp_replace(html, '<script>.*?</script>|<!--.*?-->', '', 'gs'), '<a\\s[^>]*?href="([^"]*)"', 1), 1) as pos from pages)"""


def as_is(href):
    return href


@query("x01_first_links", ANCHORS + """
    , f as (select page_id, href, min(pos) as p from a group by all)
    select page_id, url, rank from (select page_id, href as url, cast(row_number() over (partition by page_id order by p) as integer) as rank from f) t where rank <= 6""")
def first_links(table):
    return pages.first_links(pages.page_nodes(table("pages"), ["page_id"]), "page_id", 6, as_is)


@query("x01_all_links", ANCHORS + """
    select page_id, count(*) as links, count(distinct href) as targets from a group by page_id""")
def all_links(table):
    found = pages.links(pages.page_nodes(table("pages"), ["page_id"]), "page_id")
    return found.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("href").alias("targets"))


@query("s07_page_corpus", """
    select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) = '' as untitled, lower(regexp_extract(html, '<html lang="([a-z]+)"', 1)) as lang from pages""")
def page_corpus(table):
    nodes = pages.page_nodes(table("pages"), ["page_id"])
    title = pages.first(F.filter(pages.all_nodes(), lambda n: n["tag"] == "title"))
    root = pages.first(F.filter(pages.all_nodes(), lambda n: n["tag"] == "html"))
    return nodes.select("page_id", (F.coalesce(pages.node_text(title), F.lit("")) == "").alias("untitled"),
                        pages.attr(root, "lang").alias("lang"))


def wrapped(table, markup):
    """Pages made from listing rows: ``markup`` is a Column of HTML. Rows are spread before they become pages."""
    rows = spread(table("listings"), "listing_id")
    return pages.page_nodes(rows.select("listing_id", markup.alias("html")), ["listing_id"])


def text_of(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("=") else c(p[1:]) for p in parts])


def card_markup():
    return text_of(
        '<body><div class="js-restaurant__list_item" data-id="outside"></div><h1 class="search-results__stats">共 1,2', "=listing_id",
        ' 個餐廳</h1><div class="x js-restaurant__list_items"><div class="js-restaurant__list_item" data-id="r', "=listing_id", '" data-lat="', "=latitude",
        '" data-lng="', "=longitude", '"><h3 class="card__menu-content--title"><a href="/tw/r', "=listing_id", '"> <b>', "=name",
        '</b></a></h3><i class="js-bookmark-restaurant" data-distinction="ONE_STAR" data-green-star="True"></i>'
        '<div class="card__menu-footer--score">Tokyo,\n Japan</div><div class="card__menu-footer--score">¥¥ · ', "=genre_text",
        '</div></div><div class="js-restaurant__list_item" data-id=""><h3 class="card__menu-content--title"><a href="/x">No id</a></h3></div></div>'
        '<a href="/tw/restaurants/page/2">2</a><a href="/tw/restaurants/page/', "=review_count", '">n</a></body>')


@query("x02_award_cards", """
    select listing_id, 'r' || listing_id as id, name, 'https://guide.michelin.com/tw/r' || listing_id as url, round(latitude, 6) as latitude,
           'Tokyo, Japan' as location, '¥¥' as price, genre_text as cuisine, 'ONE_STAR' as distinction, true as green_star, '米其林一星' as distinction_label
    from listings""", views=["listings"])
def award_cards(table):
    cards = pages.award_cards(wrapped(table, card_markup()), "listing_id")
    return cards.select("listing_id", "id", "name", "url", F.round("latitude", 6).alias("latitude"), "location", "price", "cuisine",
                        "distinction", "green_star", "distinction_label")


@query("x03_declared_totals", """
    select listing_id, cast('12' || listing_id as bigint) as declared, cast(greatest(2, review_count) as integer) as last_page from listings""", views=["listings"])
def declared_totals(table):
    return pages.award_totals(wrapped(table, card_markup()), "listing_id")


@query("a02_reconciled_counts", """
    select max(declared) as declared, max(parsed) as parsed, max(declared) = max(parsed) as agrees from
      (select count(*) as declared from part) a, (select count(distinct p_partkey) as parsed from part) b""")
def reconciled(table):
    rows = table("part").select(c("p_partkey").cast("string").alias("id"))
    totals = rows.agg(F.count(F.lit(1)).alias("declared")).select(F.lit(1).alias("page"), "declared", F.lit(1).alias("last_page"))
    return snapshot.reconcile(totals, rows).select("declared", "parsed", "agrees")


def entity_markup():
    return text_of(
        '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":["Thing","Restaurant"],"geo":{"latitude":"',
        "=latitude", '","longitude":', "=longitude", '}}]}</script><script type="application/ld+json">[{"@type":"Restaurant","telephone":" ', "=phone",
        ' "}]</script><a data-event="CTA_website" href="https://place', "=listing_id", '.example.com/">web</a>')


@query("x04_linked_entities", """
    select listing_id, phone, round(latitude, 6) as latitude, round(longitude, 6) as longitude, 'https://place' || listing_id || '.example.com/' as website
    from listings""", views=["listings"])
def linked_entities(table):
    nodes = wrapped(table, entity_markup())
    points = nodes.select("listing_id", pages.page_point().alias("p"))
    return pages.award_details(nodes, "listing_id").join(points, "listing_id").select(
        "listing_id", "phone", F.round("p.latitude", 6).alias("latitude"), F.round("p.longitude", 6).alias("longitude"), "website")


def info_markup():
    return text_of(
        '<div id="js-basics" data-lat="', "=latitude", '" data-lng="', "=longitude", '"></div><table><tr><th> 予約 可否 </th><td>予約 可 ', "=phone",
        '</td></tr><tr><th>支払い方法</th><td>カード可<br>（VISA ', "=listing_id", '）電子マネー不可</td></tr><tr><th>予約可否</th><td>second</td></tr></table>'
        '<div class="rst-status-alert">移転前の店舗情報です <a href="https://tabelog.com/en/tokyo/A1301/A130101/', "=listing_id", '/">New ', "=name", '</a></div>')


@query("x05_info_maps", """
    select listing_id, '予約 可 ' || phone as booking, 'available' as state, true as cards, 'VISA ' || listing_id as card_details from listings""",
    views=["listings"])
def info_maps(table):
    read = wrapped(table, info_markup()).select("listing_id", pages.info_map().alias("i"))
    pay = payment_of(c("i")["支払い方法"])
    return read.select("listing_id", c("i")["予約可否"].alias("booking"), reservation_state(c("i")["予約可否"], F.lit("")).alias("state"),
                       pay["cards"]["accepted"].alias("cards"), pay["cards"]["details"].alias("card_details"))


@query("x06_award_history", """
    select listing_id, '寿司百名店' as kind, cast(2020 + listing_id % 5 as integer) as year, case when listing_id % 5 > 2 then 'TOKYO' else '' end as area from listings
    union all select listing_id, '漢堡', 2019, '' from listings""", views=["listings"])
def award_history(table):
    year = (2020 + c("listing_id") % 5).cast("string")
    badge = F.concat(F.lit("食べログ 寿司"), F.when(c("listing_id") % 5 > 2, " TOKYO").otherwise(""), F.lit(" 百名店 "), year, F.lit(" 選出店"))
    link = F.concat(F.lit('<a href="https://award.tabelog.com/hyakumeiten/sushi/'), year, F.lit('/">'))
    markup = F.concat(
        F.lit('<div class="rdheader-badge-award">'), link, F.lit('icon</a><div class="c-tooltip"><p>'), badge, F.lit("</p></div></div>"),
        link, F.lit("again</a>"),
        F.lit('<a href="https://award.tabelog.com/hyakumeiten/burger/2019/">ハンバーガー 百名店 2019 選出店</a>'))
    rows = pages.award_history(wrapped(table, markup), "listing_id")
    kind = F.when(c("category") == "壽司", "寿司百名店").otherwise(c("category"))
    return rows.select("listing_id", kind.alias("kind"), "year", "area")


@query("x07_relocations", """
    select listing_id, true as is_relocated, 'New ' || name as to_name, 'https://tabelog.com/tokyo/A1301/A130101/' || listing_id || '/' as to_url from listings""",
    views=["listings"])
def relocations(table):
    return wrapped(table, info_markup()).select("listing_id", pages.relocation().alias("r")).select("listing_id", "r.*")


@query("x08_review_texts", """
    select doc_id, '題名。' || trim(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '\\s+', ' ', 'g')) as text from documents
    where length(trim(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '\\s+', ' ', 'g'))) >= 20""")
def review_texts(table):
    body = F.regexp_replace("text", "[<>&]", " ")
    markup = F.concat(
        F.lit('<div class="rvw-item"><a class="rvw-item__rvwr-name" href="/u">someone</a><p class="rvw-item__rvw-title">題名</p>'
              '<div class="rvw-item__rvw-comment"><img src="x.jpg"><p>'), body, F.lit(' <a href="/p">photo of someone</a></p></div></div>'))
    nodes = pages.page_nodes(table("documents").select("doc_id", markup.alias("html")), ["doc_id"])
    return pages.review_texts(nodes, "doc_id").filter(F.length("text") >= 23).select("doc_id", "text")


@query("x09_map_targets", """
    select listing_id, address, round(latitude, 6) as latitude, round(longitude, 6) as longitude from listings""", views=["listings"])
def map_targets(table):
    markup = text_of('<div><strong>住所</strong> <span>', "=address", '</span><br>other<script>new google.maps.LatLng(', "=latitude", " , ", "=longitude", ')</script></div>')
    return pages.map_targets(wrapped(table, markup), "listing_id").select(
        "listing_id", "address", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("x10_enriched_listings", """
    select listing_id, name, round(latitude, 6) as latitude, 'available' as reservation_status, true as is_relocated from listings""", views=["listings"])
def enriched(table):
    base = table("listings").select("listing_id", "name", F.lit(None).cast("double").alias("latitude"), "is_relocated")
    read = pages.listing_pages(wrapped(table, info_markup()), "listing_id").select(
        "listing_id", c("point.latitude").alias("latitude"), c("moved.is_relocated").alias("is_relocated"),
        reservation_state(c("info")["予約可否"], F.lit("")).alias("reservation_status"))
    merged = prefer_details(base, read, "listing_id")
    return merged.select("listing_id", "name", F.round("latitude", 6).alias("latitude"), "reservation_status", "is_relocated")


@query("s02_prepared_snapshot", f"""
    select award_id, {folded('name')} as award_name, {phone_key('phone')} as award_phone, {website('website')} as award_website from awards""",
    views=["awards"])
def prepared(table):
    return award_keys(table("awards")).select("award_id", "award_name", "award_phone", "award_website")


PARSED = """
    , parsed as (select listing_id as id, cast(listing_id % 7 as integer) as page, listing_id as pos, name from listings
                 union all select listing_id, 9, listing_id, name || ' (moved)' from listings where review_count > 700),
    last as (select id, max_by(name, page * 1000000 + pos) as name from parsed group by id)"""


def parsed_rows(table):
    rows = table("listings").select(c("listing_id").alias("id"), (c("listing_id") % 7).cast("int").alias("page"), c("listing_id").alias("pos"), "name", "review_count")
    again = rows.filter(c("review_count") > 700).withColumn("page", F.lit(9)).withColumn("name", F.concat("name", F.lit(" (moved)")))
    return rows.unionByName(again).drop("review_count")


def carried(table):
    current = snapshot.latest_rows(parsed_rows(table)).drop("first_seen")
    listings = table("listings")
    previous = listings.select(c("listing_id").alias("id"), c("phone"), F.lit("old").alias("website"),
                               F.when(c("listing_id") % 3 == 0, "2024-01-01").otherwise("").alias("details_fetched_at"))
    details = listings.filter(c("listing_id") % 3 != 1).select(
        c("listing_id").alias("id"), F.concat(F.lit("N"), "phone").alias("phone"), F.lit("new").alias("website"),
        F.when(c("listing_id") % 4 == 0, "HTTP 404").alias("error"))
    return snapshot.carry_details(current, previous, details, F.lit("2024-02-02"))


CARRIED = PARSED + """
    , d as (select id, name, case when id % 3 = 0 then 'old' when id % 3 = 2 and id % 4 <> 0 then 'new' end as website,
                   case when id % 3 = 0 then '2024-01-01' when id % 3 = 2 and id % 4 <> 0 then '2024-02-02' end as details_fetched_at,
                   case when id % 3 = 2 and id % 4 = 0 then 'HTTP 404' end as details_error from last)"""


@query("s03_carried_snapshot", CARRIED + " select * from d", views=["listings"])
def carried_snapshot(table):
    return carried(table).select("id", "name", "website", "details_fetched_at", "details_error")


@query("a03_header_counts", CARRIED + """
    select count(*) as count, count_if(details_error <> '') as details_error_count, 'Japan' as scope from d""", views=["listings"])
def header_counts(table):
    return snapshot.header(carried(table), F.lit("2024-02-02"), F.lit("2024-02-02")).select("count", "details_error_count", "scope")
