"""Stand-ins for places, listings, awards and requests, derived from the driver tables.

Each view is one SELECT that Spark and DuckDB both run; ``{name}`` marks a table or another view.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

LAT = "35.0e0 + ((p_partkey * 7919) % 100000) / 1.0e5"
LNG = "139.0e0 + ((p_partkey * 104729) % 100000) / 1.0e5"
DIGITS = "lpad(cast((p_partkey * 15485863) % 100000000 as string), 8, '0')"
PREFECTURE = "case p_partkey % 4 when 0 then 'tokyo' when 1 then 'osaka' when 2 then 'kyoto' else 'hokkaido' end"
AREA = f"concat({PREFECTURE}, '/A', 1300 + p_partkey % 20, '/A', 130100 + p_partkey % 20)"
GENRES = (
    "case p_partkey % 7 when 0 then '寿司' when 1 then '居酒屋,焼き鳥' when 2 then 'ラーメン,中華料理' "
    "when 3 then 'カフェ' when 4 then 'バー・お酒,ビストロ,洋食' when 5 then 'Sushi Bar,寿司' else 'イタリアン' end"
)
PRICE = (
    "concat('￥', cast(1000 + (p_partkey % 9) * 1000 as string), '～￥', cast(1 + p_partkey % 9 as string), ',999')"
)

TOWN = (
    "case KEY % 4 when 0 then '〒104-0061 東京都中央区銀座' when 1 then '大阪府大阪市北区' when 2 then '京都府京都市左京区' "
    "else '北海道札幌市' end"
)

VIEWS = {
    "listings": f"""
        select p_partkey as listing_id,
               concat(p_name, ' ', p_brand) as name,
               {LAT} as latitude,
               {LNG} as longitude,
               concat('03', {DIGITS}) as phone,
               concat('Block ', p_partkey % 97, '-', p_size, ' ', p_brand, ' Tower') as address,
               concat('https://tabelog.com/', case when p_partkey % 5 = 0 then 'en/' else '' end, {AREA}, '/', 13000000 + p_partkey, '/') as url,
               {AREA} as area_path,
               case when p_partkey % 11 = 0 then null else 2.0e0 + (p_partkey % 300) / 1.0e2 end as rating,
               p_partkey % 997 as review_count,
               {GENRES} as genre_text,
               case when p_partkey % 3 = 0 then concat('Station ', p_partkey % 12) else '' end as station,
               p_brand as area,
               {PRICE} as dinner_price,
               case when p_partkey % 2 = 0 then {PRICE} else '' end as lunch_price,
               p_retailprice as price,
               p_partkey % 29 = 0 as is_relocated,
               case when p_partkey % 29 = 0 then concat('https://tabelog.com/tw/', {AREA}, '/', 13000020 + p_partkey, '/') else '' end as moved_to
        from {{part}}""",
    "listings_dup": """
        select listing_id, name, latitude, longitude, phone, address, url, rating, review_count, is_relocated
        from {listings}
        union all
        select listing_id + 1000000, name, latitude + 2.0e-4, longitude,
               case when listing_id % 20 = 0 then phone else null end,
               case when listing_id % 30 = 0 then address else '' end,
               concat(url, 'copy'), null, listing_id % 13, false
        from {listings} where listing_id % 10 = 0""",
    "places": f"""
        select p_partkey as place_id,
               case when p_partkey % 3 = 0 then concat('The ', upper(p_name), ' ', p_brand) else concat(p_name, ' ', p_brand) end as name,
               case when p_partkey % 9 = 0 then concat(p_name, ' ', p_brand) else '' end as alternate_name,
               case when p_partkey % 17 = 0 then null else {LAT} + (p_partkey % 13) * 1.0e-4 end as latitude,
               case when p_partkey % 17 = 0 then null else {LNG} end as longitude,
               case when p_partkey % 4 = 0 then null
                    when p_partkey % 4 = 1 then concat('+81 3-', {DIGITS})
                    else concat('03-', {DIGITS}) end as phone,
               case when p_partkey % 5 = 0 then concat('Block ', p_partkey % 97, '-', p_size, ' ', p_brand, ' Tower') else '' end as address,
               case when p_partkey % 6 = 0 then concat('HTTP://www.Place', p_partkey, '.example.com:80//menu/?a=1#b') else '' end as website,
               case when p_partkey % 23 = 0 then concat('https://tabelog.com/tw/', {AREA}, '/', 13000000 + p_partkey, '/dtlrvwlst/?x=1') else '' end as listing_url,
               case when p_partkey % 2 = 0 then 'place' else 'viewport' end as coordinates_source
        from {{part}}""",
    # Addresses name a prefecture; some names are misspelt, turned round or cut short and have nothing else to go by.
    "listings_town": f"""
        select listing_id, name, latitude, longitude, phone,
               case when address = '' then '' else concat({TOWN.replace('KEY', 'listing_id')}, ' ', address) end as address,
               url, rating, review_count, is_relocated
        from {{listings_dup}}""",
    "places_town": f"""
        select place_id,
               case place_id % 24 when 1 then concat(substr(name, 1, 2), substr(name, 4))
                    when 7 then concat(split_part(name, ' ', 3), ' ', split_part(name, ' ', 2), ' ', split_part(name, ' ', 1))
                    when 13 then concat(split_part(name, ' ', 3), ', ', split_part(name, ' ', 1)) else name end as name,
               alternate_name,
               case when place_id % 24 in (1, 7, 13) then null else latitude end as latitude,
               case when place_id % 24 in (1, 7, 13) then null else longitude end as longitude,
               case when place_id % 24 in (1, 7, 13) then null else phone end as phone,
               case when address = '' and place_id % 24 not in (1, 7, 13) then ''
                    else concat({TOWN.replace('KEY', 'place_id')}, ' ', address) end as address,
               website, listing_url, coordinates_source
        from {{places}}""",
    "awards": f"""
        select p_partkey as award_id,
               concat(p_name, ' ', p_brand) as name,
               {LAT} as latitude,
               {LNG} as longitude,
               case when p_partkey % 15 = 0 then concat('03-', {DIGITS}) else '' end as phone,
               case when p_partkey % 10 = 0 then concat('https://place', p_partkey, '.example.com/menu') else '' end as website,
               case p_partkey % 7 when 0 then 'THREE_STARS' when 1 then 'TWO_STARS' when 2 then 'ONE_STAR' when 3 then 'BIB_GOURMAND' else 'SELECTED' end as distinction,
               p_partkey % 8 = 0 as green_star
        from {{part}} where p_partkey % 5 = 0""",
    "awards_dup": """
        select award_id, name, latitude, longitude, phone, website, distinction, green_star from {awards}
        union all
        select award_id + 1000000, name, latitude + 1.0e-4, longitude, phone, website, distinction, green_star
        from {awards} where award_id % 20 = 0""",
    "cards": """
        select place_id as card_id,
               cast(floor(place_id / 12) as bigint) * 10 + (case when place_id % 12 >= 9 and floor(place_id / 12) % 10 > 0 then 9 else place_id % 12 end) as batch_hint,
               cast(floor(place_id / 9) as bigint) as batch_id,
               case when place_id % 31 = 0 then '' else concat('https://www.google.com/maps/place/slug', place_id, '|', lower(name)) end as key,
               case when place_id % 37 = 0 then '  ' else name end as name,
               case when place_id % 41 = 0 then 'north' when latitude is null then null
                    when place_id % 43 = 0 then '51.5' else cast(latitude as string) end as latitude,
               cast(longitude as string) as longitude,
               coordinates_source
        from {places}""",
    "rankings": """
        select area_path, ranking_key, pos, listing_id, url from (
          select area_path, 'most_reserved' as ranking_key, listing_id, url,
                 row_number() over (partition by area_path order by review_count desc, listing_id) as pos from {listings}
          union all
          select area_path, 'most_viewed', listing_id, url,
                 row_number() over (partition by area_path order by price desc, listing_id) from {listings}) t
        where pos <= 25""",
    "requests": """
        select event_id, user_id as session_id, event_type as kind, ts,
               concat(cast(user_id as string), '|', event_type) as lookup_key
        from {events}""",
    "raw_places": """
        select c_custkey as place_id,
               case when c_custkey % 19 = 0 then '   ' else concat('  ', c_name, ' ', c_mktsegment, ' ') end as name,
               concat(repeat(lower(c_mktsegment), 30), ' ') as alternate_name,
               case c_custkey % 6 when 0 then concat('〒104-', lpad(cast(c_custkey % 10000 as string), 4, '0'), ' 東京都中央区銀座', c_custkey)
                    when 1 then concat('北海道札幌市', c_custkey) when 2 then 'Main Street 5, Japan'
                    when 3 then concat('Rue ', c_custkey, ', Paris') when 4 then '日本、京都府京都市左京区12' else '' end as address,
               case c_custkey % 5 when 0 then concat('+81 3-', 10000000 + c_custkey) when 1 then concat('03-', 1000 + c_custkey, '-5678')
                    when 2 then concat('+33 1 ', c_custkey) else '' end as phone,
               case c_custkey % 4 when 0 then concat('HTTP://WWW.Shop', c_custkey, '.example.com:80//a//b/?q=1#z')
                    when 1 then concat('https://shop', c_custkey, '.example.com:8443/') when 2 then 'ftp://files.example.com/x'
                    else concat('https://user@shop', c_custkey, '.example.com') end as website,
               case c_custkey % 7 when 0 then concat('https://tabelog.com/en/tokyo/A1301/A130101/', 13000000 + c_custkey, '/dtlrvwlst/')
                    when 1 then concat('https://tabelog.com/osaka/A2701/A270101/', 27000000 + c_custkey)
                    when 2 then concat('https://duckduckgo.com/l/?uddg=https%3A%2F%2Ftabelog.com%2Fkyoto%2FA2601%2FA260101%2F', 26000000 + c_custkey, '%2F&rut=1')
                    when 3 then 'https://example.com/tokyo/A1301/A130101/1/' else '' end as listing_url,
               case when c_custkey % 23 = 0 then 'abc' when c_custkey % 13 = 0 then '' when c_custkey % 3 = 0 then cast(c_acctbal / 100 as string) else '35.5' end as latitude,
               case when c_custkey % 13 = 0 then '' else '139.25' end as longitude,
               case when c_custkey % 2 = 0 then 'place' else 'viewport' end as coordinates_source
        from {customer}""",
    "map_links": """
        select o_orderkey as link_id,
               case o_orderkey % 4
                 when 0 then concat('https://www.google.com/maps/place/Blue+Bolt+', o_custkey, '/@35.1,139.2,17z/data=!3d35.', 1000 + o_custkey, '!4d139.5!3d36.', 1000 + o_custkey, '!4d-138.25?hl=ja')
                 when 1 then concat('https://www.google.com/maps/place/Caf%C3%A9%20', o_custkey, '/@35.', 10 + o_custkey % 90, ',-139.2,17z?x#y')
                 when 2 then concat('https://maps.example.com/search/', o_orderpriority, '/')
                 else 'not a link' end as href,
               case o_orderkey % 3 when 0 then concat('  Shop ', o_custkey, '·Opened link') when 1 then concat('La   Biographie', o_orderkey, '···')
                 else concat('Noeud.', o_orderpriority, ' · 開啟過的連結') end as title
        from {orders}""",
    "texts": """
        select doc_id, source, lang, text, n_chars from {documents}""",
}


def needed(names: list[str]) -> list[str]:
    """The views and their own views, in dependency order."""
    order = []

    def visit(name):
        if name in TABLES or name in order:
            return
        for inner in re.findall(r"\{(\w+)\}", VIEWS[name]):
            visit(inner)
        order.append(name)

    for name in names:
        visit(name)
    return order


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of the views."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inner = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: frame(spark, sf_dir, t) for t in inner})


def with_views(names: list[str], sql: str) -> str:
    """DuckDB text of a query over views: they become common table expressions."""
    parts = [
        f"{name} as ({VIEWS[name].format(**{t: t for t in TABLES + list(VIEWS)})})"
        for name in needed(names)
    ]
    body = sql.strip()
    if not parts:
        return body
    start = "with recursive " if "_pieces as (" in body else "with "
    if body.lower().startswith("with "):
        return start + ",\n".join(parts) + ",\n" + body[5:]
    return start + ",\n".join(parts) + "\n" + body
