"""Scalar rules as projections over whole tables."""

from pyspark.sql import functions as F

from placeweave.functions import geo, keys, labels, nearby, numbers, text, urls
from workloads.registry import (
    address_key, area_of, contained_likeness, folded, likenesses, listing_link, metres, name_key, phone_key,
    query, website,
)

c = F.col


@query("h01_fold_text", f"""
    select 'p' || place_id as id, {folded('name')} as folded from places
    union all select 'c' || place_id, {folded('alternate_name')} from raw_places""",
    views=["places", "raw_places"])
def fold_text(table):
    plain = table("places").select(F.concat(F.lit("p"), "place_id").alias("id"), "name")
    raw = table("raw_places").select(F.concat(F.lit("c"), "place_id").alias("id"), "alternate_name")
    return plain.union(raw).select("id", text.fold_text(c("name")).alias("folded"))


@query("h02_fold_name", f"""
    select listing_id, {name_key("replace(genre_text, ',', ' ') || '本店' || name || '割烹'")} as folded
    from listings""", views=["listings"])
def fold_name(table):
    name = F.concat(F.replace("genre_text", F.lit(","), F.lit(" ")), F.lit("本店"), "name", F.lit("割烹"))
    return table("listings").select("listing_id", text.fold_name(name).alias("folded"))


@query("h03_phone_key", f"""
    select 'p' || place_id as id, {phone_key('phone')} as phone_key from places
    union all select 'c' || place_id, {phone_key('phone')} from raw_places""",
    views=["places", "raw_places"])
def fold_phone(table):
    both = table("places").select(F.concat(F.lit("p"), "place_id").alias("id"), "phone").union(
        table("raw_places").select(F.concat(F.lit("c"), "place_id").alias("id"), "phone"))
    return both.select("id", text.fold_phone(c("phone")).alias("phone_key"))


@query("h04_address_key", f"""
    select place_id, {address_key("address || '3番地 12号'")} as address_key from raw_places""",
    views=["raw_places"])
def fold_address(table):
    return table("raw_places").select(
        "place_id", text.fold_address(F.concat("address", F.lit("3番地 12号"))).alias("address_key"))


@query("h05_likeness_contained", f"""
    select p.place_id, round({contained_likeness('p.k', 'l.k')}, 6) as likeness
    from (select place_id, {name_key('name')} as k from places) p
    join (select listing_id, {name_key('name')} as k from listings) l on p.place_id = l.listing_id
    where contains(p.k, l.k) or contains(l.k, p.k)""", views=["places", "listings"])
def likeness(table):
    place = table("places").select("place_id", text.fold_name(c("name")).alias("a"))
    listing = table("listings").select(c("listing_id").alias("place_id"), text.fold_name(c("name")).alias("b"))
    pairs = place.join(listing, "place_id").filter(c("a").contains(c("b")) | c("b").contains(c("a")))
    return pairs.select("place_id", F.round(text.likeness(c("a"), c("b")), 6).alias("likeness"))


@query("h05_likeness_ratio", f""", k as (select listing_id, {name_key('name')} as k from listings),
    {likenesses('alike', 'select x.k as a, y.k as b from k x join k y on y.listing_id = x.listing_id + 1')}""" + """
    select x.listing_id, round(coalesce(likeness, 0), 6) as likeness
    from k x join k y on y.listing_id = x.listing_id + 1 left join alike on a = x.k and b = y.k""", views=["listings"])
def ratio(table):
    """Ratio of each listing name with the next listing's; the standard library defines it."""
    left = table("listings").select("listing_id", text.fold_name(c("name")).alias("a"))
    right = table("listings").select((c("listing_id") - 1).alias("listing_id"), text.fold_name(c("name")).alias("b"))
    return left.join(right, "listing_id").select(
        "listing_id", F.round(text.likeness(c("a"), c("b")), 6).alias("likeness"))


@query("h06_distance", f"""
    select p.place_id, round({metres('p.latitude', 'p.longitude', 'l.latitude', 'l.longitude')}, 4) as distance_m
    from places p join listings l on p.place_id = l.listing_id""", views=["places", "listings"])
def distance(table):
    listing = table("listings").select(
        c("listing_id").alias("place_id"), c("latitude").alias("lat"), c("longitude").alias("lng"))
    return table("places").join(listing, "place_id").select(
        "place_id",
        F.round(geo.distance_m(c("latitude"), c("longitude"), c("lat"), c("lng")), 4).alias("distance_m"))


@query("h07_tolerant_numbers", """
    select place_id, try_cast(trim(latitude) as double) as as_double,
           case when regexp_matches(trim(phone), '^[+-]?[0-9]+$') then try_cast(trim(phone) as bigint) end as as_integer,
           case when try_cast(trim(latitude) as double) = floor(try_cast(trim(latitude) as double))
                then cast(cast(try_cast(trim(latitude) as double) as bigint) as varchar)
                else cast(try_cast(trim(latitude) as double) as varchar) end as as_text
    from raw_places""", views=["raw_places"])
def tolerant(table):
    return table("raw_places").select(
        "place_id", numbers.to_double(c("latitude")).alias("as_double"),
        numbers.to_integer(c("phone")).alias("as_integer"),
        numbers.number_text(c("latitude")).alias("as_text"))


@query("h08_website_key", f"""
    select 'c' || place_id as id, {website('website')} as website_key from raw_places
    union all select 'p' || place_id, {website('website')} from places""",
    views=["raw_places", "places"])
def website_key(table):
    both = table("raw_places").select(F.concat(F.lit("c"), "place_id").alias("id"), "website").union(
        table("places").select(F.concat(F.lit("p"), "place_id").alias("id"), "website"))
    return both.select("id", urls.website_key(c("website")).alias("website_key"))


@query("h09_listing_url", f"""
    select 'c' || place_id as id, coalesce({listing_link('listing_url')}, '') as url from raw_places
    union all select 'p' || place_id, coalesce({listing_link('listing_url')}, '') from places
    union all select 'l' || listing_id, coalesce({listing_link('url')}, '') from listings""",
    views=["raw_places", "places", "listings"])
def listing_url(table):
    parts = [("c", "raw_places", "place_id", "listing_url"), ("p", "places", "place_id", "listing_url"),
             ("l", "listings", "listing_id", "url")]
    frames = [table(v).select(F.concat(F.lit(p), k).alias("id"), c(u).alias("u")) for p, v, k, u in parts]
    both = frames[0].union(frames[1]).union(frames[2])
    return both.select("id", F.coalesce(urls.listing_url(c("u")), F.lit("")).alias("url"))


@query("h10_compare_key", """
    select listing_id, regexp_replace(lower(rtrim(trim(url), '/')), 'tabelog\\.com/(?:en|tw|cn|kr)/', 'tabelog.com/', 'g') as compare_key
    from listings""", views=["listings"])
def compare_key(table):
    return table("listings").select(
        "listing_id", urls.listing_compare_key(c("url")).alias("compare_key"))


@query("h11_area_path", f"select listing_id, {area_of('url')} as area from listings", views=["listings"])
def area_path(table):
    return table("listings").select("listing_id", urls.area_path(c("url")).alias("area"))


@query("h12_built_urls", f"""
    select listing_id, {listing_link('url')} || 'peripheral_map/' as nearby_page,
           {listing_link('url')} || 'peripheral_map/sushi/' as sushi_page,
           'https://tabelog.com/tw/' || {area_of('url')} || '/rstLst/?SrtT=inbound_access' as popular_page,
           {listing_link('url')} || 'dtlrvwlst/' as review_page,
           'https://www.google.com/maps/search/?api=1&query=' || replace(url_encode(name || ' ' || address), '%20', '+') as map_search
    from listings""", views=["listings"])
def built_urls(table):
    return table("listings").select(
        "listing_id",
        urls.nearby_page_url(c("url")).alias("nearby_page"),
        urls.nearby_page_url(c("url"), F.lit("sushi")).alias("sushi_page"),
        urls.popularity_page_url(c("url"), F.lit("inbound_access")).alias("popular_page"),
        urls.review_page_url(c("url")).alias("review_page"),
        urls.map_search_url(c("name"), c("address")).alias("map_search"))


@query("h13_area_in_address", """
    select place_id, regexp_extract(regexp_replace(address, '日本[、,]', '', 'g'),
           '(?:〒\\s*\\d{3}-?\\d{4}\\s*)?([^\\s,，]{2,12}?[都道府県])', 1) as area
    from raw_places""", views=["raw_places"])
def area_in_address(table):
    return table("raw_places").select(
        "place_id", F.coalesce(nearby.area_in_address(c("address")), F.lit("")).alias("area"))


@query("h14_station_name", """
    select listing_id, case when listing_id % 2 = 0 then station else 'Line' || station end as station
    from listings""", views=["listings"])
def station_name(table):
    raw = F.when(c("listing_id") % 2 == 0, F.concat(F.lit("JR山手線「"), "station", F.lit("」"))) \
        .otherwise(F.concat(F.lit("東急東横線Line"), "station"))
    raw = F.when(c("station") == "", F.when(c("listing_id") % 2 == 0, "").otherwise("東急東横線Line")) \
        .otherwise(raw)
    return table("listings").select("listing_id", nearby.station_name(raw).alias("station"))


@query("h15_locality", """
    select place_id, case when address like '〒%' then '中央区' when address like '日本%' then '京都市'
                          when address like '北海道%' then '札幌市' else '' end as locality
    from raw_places""", views=["raw_places"])
def locality(table):
    return table("raw_places").select("place_id", nearby.locality(F.replace(c("address"), F.lit("日本、"), F.lit(""))).alias("locality"))


MID = ("(case when len(regexp_extract_all({0}, '[0-9][0-9,]*')) = 0 then null else "
       "list_avg(list_transform(regexp_extract_all({0}, '[0-9][0-9,]*')[1:2], lambda x: cast(replace(x, ',', '') as double))) end)")


@query("h17_price_midpoint", f"""
    select listing_id, {MID.format('dinner_price')} as dinner, {MID.format('lunch_price')} as lunch
    from listings""", views=["listings"])
def midpoint(table):
    return table("listings").select(
        "listing_id", nearby.price_midpoint(c("dinner_price")).alias("dinner"),
        nearby.price_midpoint(c("lunch_price")).alias("lunch"))


@query("h18_price_evidence", f"""
    with p as (select listing_id, area_path, {MID.format('dinner_price')} as d, {MID.format('lunch_price')} as l from listings)
    select a.listing_id as seed_id, b.listing_id as cand_id,
           case when abs(a.d - b.d) <= 2500 then 15.0e0 when abs(a.d - b.d) <= 6000 then 8.0e0
                when abs(a.l - b.l) <= 2500 then 15.0e0 when abs(a.l - b.l) <= 6000 then 8.0e0 else 0.0e0 end as points
    from p a join p b on a.area_path = b.area_path and b.listing_id = a.listing_id + 20""", views=["listings"])
def price_evidence(table):
    p = table("listings").select("listing_id", nearby.price_midpoint(c("dinner_price")).alias("d"),
                                 nearby.price_midpoint(c("lunch_price")).alias("l"))
    a = p.select(c("listing_id").alias("seed_id"), (c("listing_id") + 20).alias("cand_id"), c("d").alias("sd"), c("l").alias("sl"))
    b = p.withColumnRenamed("listing_id", "cand_id")
    return a.join(b, "cand_id").select(
        "seed_id", "cand_id", nearby.price_evidence(c("sd"), c("sl"), c("d"), c("l"))["points"].alias("points"))


@query("h20_rating_points", """
    select listing_id, round(least(8.0e0, coalesce(rating, 0) / 5 * 8) + least(7.0e0, log10(review_count + 1) / 3 * 7), 6) as points
    from listings""", views=["listings"])
def rating_points(table):
    return table("listings").select(
        "listing_id", F.round(nearby.rating_points(c("rating"), c("review_count")), 6).alias("points"))


@query("h21_translated_labels", """
    select listing_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(genre_text,
           'イタリアン', '義大利料理'), '中華料理', '中式料理'), 'ビストロ', '小酒館'), 'ラーメン', '拉麵'), '焼き鳥', '烤雞肉串'),
           'カフェ', '咖啡廳'), '寿司', '壽司'), '洋食', '西式料理'), 'バー', '酒吧') as label,
           replace(trim(station), '駅', '站') as station
    from listings""", views=["listings"])
def translated(table):
    return table("listings").select(
        "listing_id", labels.translate_label(c("genre_text")).alias("label"),
        labels.translate_station(c("station")).alias("station"))


@query("h22_ascii_numerals", """
    select listing_id, '共 ' || (listing_id % 10) || ' 家，百名店' || (listing_id % 10) || (listing_id % 7) || '年 '
           || (100 * (1 + listing_id % 9) + 10 * (1 + listing_id % 8)) || ' 元' as shown
    from listings""", views=["listings"])
def numerals(table):
    spelled = F.array(*[F.lit(x) for x in "〇一二三四五六七八九"])

    def digit(number):
        return F.get(spelled, number.cast("int"))

    n = c("listing_id")
    sentence = F.concat(
        F.lit("共 "), digit(n % 10), F.lit(" 家，百名店"), digit(n % 10), digit(n % 7), F.lit("年 "),
        digit(1 + n % 9), F.lit("百"), digit(1 + n % 8), F.lit("十 元"))
    return table("listings").select("listing_id", labels.ascii_numerals(sentence).alias("shown"))


@query("h23_squeezed", """
    select doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 480) as squeezed from documents""")
def squeezed(table):
    return table("documents").select("doc_id", text.squeeze(c("text"), 480).alias("squeezed"))


@query("h24_lookup_keys", """
    select place_id,
           'match:' || concat_ws('|', trim(name), trim(alternate_name), trim(address), trim(coalesce(phone, '')),
             trim(website), trim(listing_url),
             coalesce(printf('%.5f', latitude), ''), coalesce(printf('%.5f', longitude), '')) as lookup_key,
           sha256('{"model":"m1","prompt_version":"review-insights-v1","tabelog_url":"' || name || '"}') as review_key
    from places""", views=["places"])
def lookup_keys(table):
    place = {f: c(f) for f in keys.PLACE_KEY_FIELDS + ["latitude", "longitude"]}
    return table("places").select(
        "place_id", keys.lookup_key(F.lit("match"), keys.place_key(place)).alias("lookup_key"),
        keys.review_key(c("name"), F.lit("m1")).alias("review_key"))


@query("h25_list_names", """
    with n as (select link_id, href, trim(regexp_replace(title, '\\s+', ' ', 'g')) as t from map_links)
    select link_id,
           case when contains(t, '·') and trim(regexp_extract(t, '^(.*)·[^·]*$', 1)) <> '' and trim(regexp_extract(t, '·([^·]*)$', 1)) <> ''
                then trim(regexp_extract(t, '^(.*)·[^·]*$', 1)) else t end as list_name,
           trim(url_decode(replace(regexp_extract(href, '/maps/place/([^/?#]+)', 1), '+', '%20'))) as href_name,
           case when href like 'https://%/maps/place/%' then regexp_extract(href, '^(https://[^/]+/maps/place/[^/]+)', 1)
                when href like 'https://%' then rtrim(href, '/') else href end as stable_href
    from n""", views=["map_links"])
def list_names(table):
    return table("map_links").select(
        "link_id", keys.list_name(c("title")).alias("list_name"),
        urls.name_in_href(c("href")).alias("href_name"), urls.site_href(c("href")).alias("stable_href"))


@query("h26_map_points", """
    with m as (select link_id, href, regexp_extract_all(href, '!3d(-?\\d+(?:\\.\\d+)?)!4d(-?\\d+(?:\\.\\d+)?)', 1) as a,
                      regexp_extract_all(href, '!3d(-?\\d+(?:\\.\\d+)?)!4d(-?\\d+(?:\\.\\d+)?)', 2) as b,
                      regexp_extract(href, '/@(-?\\d+(?:\\.\\d+)?),(-?\\d+(?:\\.\\d+)?)', 1) as va,
                      regexp_extract(href, '/@(-?\\d+(?:\\.\\d+)?),(-?\\d+(?:\\.\\d+)?)', 2) as vb from map_links)
    select link_id,
           cast(case when len(a) > 0 then a[len(a)] when va <> '' then va end as double) as latitude,
           cast(case when len(b) > 0 then b[len(b)] when vb <> '' then vb end as double) as longitude,
           case when len(a) > 0 then 'place' when va <> '' then 'viewport' else '' end as source
    from m""", views=["map_links"])
def map_points(table):
    return table("map_links").select("link_id", geo.map_link_point(c("href")).alias("p")).select("link_id", "p.*")


@query("h27_popularity_badges", """
    select area_path, ranking_key, listing_id,
           case when pos <= 5 then 'top5' when pos <= 10 then 'top10' else 'top20' end as tier,
           ranking_key || ' TOP ' || case when pos <= 5 then '5' when pos <= 10 then '10' else '20' end as badge
    from rankings""", views=["rankings"])
def popularity_badges(table):
    tier = labels.popularity_tier(c("pos"))
    return table("rankings").select(
        "area_path", "ranking_key", "listing_id", tier.alias("tier"),
        labels.popularity_badge(c("ranking_key"), tier).alias("badge"))


@query("h28_confidence", """
    select o_orderkey, case when o_totalprice / 5000 >= 75 then 'high' when o_totalprice / 5000 >= 52 then 'medium' else 'low' end as confidence,
           case when o_totalprice / 5000 >= 75 then '高信心' when o_totalprice / 5000 >= 52 then '待確認' else '低信心' end as label
    from orders""")
def confidence(table):
    band = labels.confidence_of(c("o_totalprice") / 5000)
    return table("orders").select("o_orderkey", band.alias("confidence"), labels.confidence_label(band).alias("label"))


PAY = ("'カード' || case when l_linenumber % 2 = 0 then '可' else '不可' end || '（VISA' || l_partkey || '、Master） ' "
       "|| case when l_suppkey % 3 = 0 then '電子マネー不可 ' else '' end || 'QRコード決済可（PayPay' || l_suppkey || '）'")


@query("h29_payment", """
    select l_orderkey, l_linenumber, l_linenumber % 2 = 0 as cards, 'VISA' || l_partkey || '、Master' as card_details,
           case when l_suppkey % 3 = 0 then 'no' else 'unsaid' end as electronic_money,
           true as qr_code, 'PayPay' || l_suppkey as qr_details
    from lineitem""")
def payment(table):
    value = F.concat(
        F.lit("カード"), F.when(c("l_linenumber") % 2 == 0, "可").otherwise("不可"), F.lit("（VISA"), "l_partkey",
        F.lit("、Master） "), F.when(c("l_suppkey") % 3 == 0, "電子マネー不可 ").otherwise(""),
        F.lit("QRコード決済可（PayPay"), "l_suppkey", F.lit("）"))
    read = table("lineitem").select("l_orderkey", "l_linenumber", labels.payment_of(value).alias("p"))
    return read.select(
        "l_orderkey", "l_linenumber", c("p.cards.accepted").alias("cards"),
        c("p.cards.details").alias("card_details"),
        F.when(c("p.electronic_money").isNull(), "unsaid").when(c("p.electronic_money.accepted"), "yes")
        .otherwise("no").alias("electronic_money"),
        c("p.qr_code.accepted").alias("qr_code"), c("p.qr_code.details").alias("qr_details"))


@query("h30_reservation", """
    select o_orderkey, case when o_orderkey % 5 = 0 then 'online' when o_orderstatus = 'F' then 'unavailable'
                            when o_orderstatus = 'O' then 'available' else 'unknown' end as state
    from orders""")
def reservation(table):
    said = F.when(c("o_orderstatus") == "F", "予約 不可").when(c("o_orderstatus") == "O", "予約可（電話）").otherwise("要確認")
    online = F.when(c("o_orderkey") % 5 == 0, "https://example.com/book").otherwise("")
    return table("orders").select("o_orderkey", labels.reservation_state(said, online).alias("state"))


@query("h31_award_entry", """
    select o_orderkey, case when o_orderkey % 3 = 0 then 'TOKYO' when o_orderkey % 3 = 1 then 'EAST' else '' end as area,
           case when o_orderkey % 2 = 0 then '拉麵' else '漢堡' end as category,
           cast(case when o_orderkey % 7 = 0 then 2019 else 2017 + o_orderkey % 8 end as integer) as year
    from orders""")
def award_entry(table):
    kind = F.when(c("o_orderkey") % 2 == 0, "ラーメン").otherwise("ハンバーガー")
    area = F.when(c("o_orderkey") % 3 == 0, " TOKYO").when(c("o_orderkey") % 3 == 1, " EAST").otherwise("")
    dated = F.concat(F.lit("食べログ "), kind, area, F.lit(" 百名店 "), 2017 + c("o_orderkey") % 8, F.lit(" 選出店"))
    read = table("orders").select(
        "o_orderkey", labels.award_entry(dated, F.lit("")).alias("e"),
        labels.award_entry(F.lit(""), F.lit("https://award.tabelog.com/hyakumeiten/ramen/2019/")).alias("u"))
    year = F.when(c("o_orderkey") % 7 == 0, c("u.year")).otherwise(c("e.year"))
    return read.select("o_orderkey", c("e.area").alias("area"), c("e.category").alias("category"), year.alias("year"))


@query("h32_identity_queries", """
    with q as (select place_id, trim(name) as n, trim(alternate_name) as a,
               regexp_replace(regexp_replace(trim(phone), '^\\+?81[\\s().-]*', '0'), '[^0-9-]', '', 'g') as p from raw_places)
    select place_id, concat_ws('|', case when p <> '' then 'site:tabelog.com "' || p || '"' end,
           case when a <> '' then 'site:tabelog.com "' || a || '"' end,
           case when n <> '' and n <> a then 'site:tabelog.com "' || n || '"' end) as queries
    from q""", views=["raw_places"])
def identity_queries(table):
    return table("raw_places").select(
        "place_id",
        F.array_join(keys.identity_queries(c("phone"), c("alternate_name"), c("name")), "|").alias("queries"))


@query("h33_display_texts", """
    select award_id, distinction || case when green_star then ' · 綠星' else '' end as badge,
           'Michelin ' || distinction || case when green_star then ' · 綠星' else '' end as current_label,
           '百名店 · ' || distinction || case when green_star then ' TOKYO' else '' end as history_label,
           '搜尋範圍：' || name || '；Tabelog 回傳 ' || (1 + award_id) || ' 家'
             || case when award_id % 4 > 0 then '；' || (award_id % 4) || ' 家未達相似度門檻' else '' end
             || case when green_star then '；AI 已分析 12 家' else '' end || '。' as summary,
           case when green_star then 'Tabelog 候選 · AI 排序 · 地圖開啟' else 'Tabelog 推薦 · 地圖開啟' end as source
    from awards""", views=["awards"])
def display_texts(table):
    ranked_by = F.when(c("green_star"), "ai").otherwise("rules")
    return table("awards").select(
        "award_id", labels.award_badge(c("distinction"), c("green_star")).alias("badge"),
        labels.current_award_label(c("distinction"), c("green_star")).alias("current_label"),
        labels.history_label(c("distinction"), F.when(c("green_star"), "TOKYO").otherwise("")).alias("history_label"),
        labels.diagnostics_summary(c("name"), 1 + c("award_id"), c("award_id") % 4, F.lit(12), ranked_by).alias("summary"),
        labels.source_label(ranked_by).alias("source"))


@query("h34_dining_signals", """
    select event_id, event_type = 'view' as has_menu, event_type = 'click' as has_per_person_price,
           event_type in ('signup', 'error') as offers_dine_in
    from events""")
def dining_signals(table):
    said = (F.when(c("event_type") == "view", "Menu·lunch").when(c("event_type") == "click", "約 1 人あたり ¥1,000")
            .when(c("event_type") == "signup", "Offers dine-in").when(c("event_type") == "error", "店内飲食可").otherwise("menus"))
    return table("events").select(
        "event_id", labels.dining_signals(F.array(said, c("props"))).alias("s")).select("event_id", "s.*")


@query("p10_dining_category", """
    select listing_id, listing_id % 7 in (1, 2, 3, 4, 5) or listing_id % 3 = 0 as dining
    from (select p_partkey as listing_id from part) t""")
def dining_category(table):
    signals = F.struct((c("listing_id") % 3 == 0).alias("has_menu"), F.lit(False).alias("has_per_person_price"),
                       F.lit(False).alias("offers_dine_in"))
    category = (F.when(c("listing_id") % 7 == 0, "Bookshop").when(c("listing_id") % 7 == 1, "居酒屋,焼き鳥")
                .when(c("listing_id") % 7 == 2, "ラーメン店").when(c("listing_id") % 7 == 3, "Coffee Shop")
                .when(c("listing_id") % 7 == 4, "카페").when(c("listing_id") % 7 == 5, "Sushi Bar").otherwise("Barber"))
    return table("listings").select("listing_id", labels.is_dining_place(category, signals).alias("dining"))


@query("p11_booking_urls", """
    select o_orderkey, case when o_orderkey % 4 = 0 then 'https://book.example.com/r/' || o_custkey || '/?a=1'
                            when o_orderkey % 4 = 1 then 'http://example.com/yoyaku/' || o_custkey else '' end as url
    from orders""")
def booking(table):
    given = (F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit(" https://book.example.com/r/"), "o_custkey", F.lit("/?a=1 ")))
             .when(c("o_orderkey") % 4 == 1, F.concat(F.lit("http://example.com/yoyaku/"), "o_custkey"))
             .when(c("o_orderkey") % 4 == 2, "https://example.com/AI_request_booking/guide/index/?x=2")
             .otherwise(F.concat(F.lit("tel:"), "o_custkey")))
    return table("orders").select("o_orderkey", urls.booking_url(given).alias("url"))
