"""Registered queries: a Spark function and, where SQL can say it, the DuckDB text to compare with."""

from placeweave import fixed
from workloads.views import frame, with_views

QUERIES = {}
ORACLES = {}


def query(name, sql=None, views=()):
    """Register ``run(table)``, where ``table(name)`` gives a driver table or a view."""

    def register(run):
        QUERIES[name] = lambda spark, sf_dir: run(lambda view: frame(spark, sf_dir, view))
        if sql is not None:
            ORACLES[name] = with_views(list(views), sql)
        return run

    return register


def metres(lat_a, lng_a, lat_b, lng_b):
    """SQL text of the great-circle distance."""
    chord = (
        f"(pow(sin(radians({lat_b} - {lat_a}) / 2), 2) + "
        f"cos(radians({lat_a})) * cos(radians({lat_b})) * pow(sin(radians({lng_b} - {lng_a}) / 2), 2))"
    )
    return f"(2 * 6371000.0e0 * asin(sqrt({chord})))"


def folded(text):
    """SQL text of folding for text without compatibility forms."""
    return (
        f"regexp_replace(lower(coalesce({text}, '')), "
        "'[^0-9a-z\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]', '', 'g')"
    )


def phone_key(text):
    digits = f"regexp_replace(coalesce({text}, ''), '[^0-9]', '', 'g')"
    return (
        f"(case when {digits} like '81%' and length({digits}) in (11, 12) "
        f"then '0' || substr({digits}, 3) else {digits} end)"
    )


def address_key(text):
    bare = f"regexp_replace(lower(coalesce({text}, '')), '〒?[0-9]{{3}}-?[0-9]{{4}}', '', 'g')"
    bare = f"regexp_replace({bare}, '番地|番|号', '', 'g')"
    return f"regexp_replace({bare}, '[^0-9a-z\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]', '', 'g')"


def name_key(text):
    words = ["うなぎ", "鰻", "割烹", "食堂", "レストラン", "料理店", "居酒屋", "喫茶店", "カフェ",
             "本店", "支店", "駅前店", "別館", "新館"]
    sql = folded(text)
    for word in words:
        sql = f"replace({sql}, '{word}', '')"
    return sql


def contained_likeness(a, b):
    """SQL text of the likeness of texts of which one holds the other; else 0."""
    return (
        f"(case when {a} <> '' and {b} <> '' and (contains({a}, {b}) or contains({b}, {a})) "
        f"then 0.88e0 + 0.12e0 * least(length({a}), length({b})) / greatest(length({a}), length({b})) "
        f"else 0.0e0 end)"
    )


def likenesses(name, pairs):
    """CTEs: ``name`` has a, b and likeness of every distinct pair of non-empty texts of the query ``pairs``.

    The matching ratio takes the longest common part (the first in a, then in b) and goes on left and right of it.
    """
    return f"""
    {name}_asked as (select distinct a, b from ({pairs}) where a <> '' and b <> ''),
    {name}_pieces as (
      select a as left_text, b as right_text, a, b, 0 as n from {name}_asked where not contains(a, b) and not contains(b, a)
      union all
      select left_text, right_text, part.a, part.b, part.n from (
        select left_text, right_text, unnest([{{'a': a[:i - 1], 'b': b[:j - 1], 'n': k}}, {{'a': a[i + k:], 'b': b[j + k:], 'n': 0}}]) as part
        from (select *, instr(b, a[i:i + k - 1]) as j from (
          select left_text, right_text, a, b, best.k as k, -best.i as i from (
            select *, list_max(list_transform(range(1, length(a) + 1), lambda i: {{'k': len(list_filter(range(1, length(a) - i + 2),
                     lambda k: contains(b, a[i:i + k - 1]))), 'i': -i}})) as best
            from {name}_pieces where a <> '' and b <> '')) where k > 0))),
    {name} as (
      select a, b, {contained_likeness('a', 'b')} as likeness from {name}_asked where contains(a, b) or contains(b, a)
      union all
      select left_text, right_text, 2e0 * sum(n) / (length(left_text) + length(right_text)) from {name}_pieces group by left_text, right_text)"""


def may_be_alike(name, left, right, threshold):
    """CTEs: ``name`` has all pairs (a, b) of texts of the two queries (column t) that may have that likeness.

    A ratio cannot pass what the shorter text allows, nor what the common characters allow, counted one by one.
    """
    characters = "string_split('0123456789abcdefghijklmnopqrstuvwxyz', '')"
    counts = f"list_transform({characters}, lambda x: length(t) - length(replace(t, x, '')))"
    counted = f"select t, length(t) as s, {counts} as n, length(regexp_replace(t, '[0-9a-z]', '', 'g')) as rest from"
    return f"""
    {name}_left as ({counted} (select distinct t from ({left}) where t <> '')),
    {name}_right as ({counted} (select distinct t from ({right}) where t <> '')),
    {name} as (
      select l.t as a, r.t as b from {name}_left l join {name}_right r on contains(l.t, r.t) or contains(r.t, l.t)
        or (2 * least(l.s, r.s) >= {threshold} * (l.s + r.s)
            and 2 * (least(l.rest, r.rest) + list_sum(list_transform(range(1, 37), lambda i: least(l.n[i], r.n[i])))) >= {threshold} * (l.s + r.s)))"""


def asked_words(text):
    return _words(text, "case when length(r) = 1 then [r] else PAIRS end")


def held_words(text):
    return _words(text, "case when length(r) = 1 then [r] else list_concat(PAIRS, string_split(r, '')) end")


def _words(text, other):
    """SQL text of the sorted distinct words of a name; ``other`` is for runs beyond ASCII."""
    kept = "\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}"
    runs = f"regexp_extract_all(lower(coalesce({text}, '')), '[0-9a-z]+|[{kept}]+')"
    pairs = "list_transform(range(1, length(r)), lambda i: r[i:i + 1])"
    each = f"case when regexp_matches(r, '^[0-9a-z]+$') then [r] else {other.replace('PAIRS', pairs)} end"
    return f"list_sort(list_distinct(flatten(list_transform({runs}, lambda r: {each}))))"


def address_area(text):
    bare = f"replace(replace(coalesce({text}, ''), '日本、', ''), '日本,', '')"
    return f"nullif(regexp_extract({bare}, '{fixed.ADDRESS_AREA_PATTERN}', 1), '')"


LINK = "(?i)https?://tabelog\\.com/(?:en/|tw/|cn/|kr/)?([a-z0-9-]+/A\\d+/A\\d+/\\d+)/?"


def listing_link(text):
    """SQL text of the canonical listing link, through one search redirect, or null."""
    decoded = f"url_decode(replace(coalesce({text}, ''), '+', '%2B'))"
    target = f"regexp_extract({decoded}, '[?&]uddg=([^&#]+)', 1)"
    source = (
        f"(case when contains({decoded}, 'duckduckgo.com/l/') and {target} <> '' "
        f"then {target} else {decoded} end)"
    )
    path = f"regexp_extract({source}, '{LINK}', 1)"
    return f"(case when {path} <> '' then 'https://tabelog.com/' || {path} || '/' end)"


def area_of(text):
    path = f"regexp_extract(coalesce({text}, ''), '{LINK}', 1)"
    return f"regexp_extract({path}, '^([^/]+/[^/]+/[^/]+)/', 1)"


def website(text):
    """SQL text of the comparable form of an official site."""
    shape = "(?i)^(https?)://([^/?#]*)([^?#]*)"
    scheme = f"lower(regexp_extract(trim({text}), '{shape}', 1))"
    server = f"regexp_replace(regexp_extract(trim({text}), '{shape}', 2), '^.*@', '')"
    host = f"regexp_replace(lower(regexp_extract({server}, '^([^:]*)', 1)), '^www\\.', '')"
    port = f"regexp_extract({server}, ':([0-9]+)$', 1)"
    path = f"regexp_replace(regexp_extract(trim({text}), '{shape}', 3), '/+', '/', 'g')"
    return (
        f"(case when {scheme} = '' or {host} = '' then '' else 'https://' || {host} || "
        f"(case when {port} = '' or ({scheme} = 'http' and {port} = '80') or "
        f"({scheme} = 'https' and {port} = '443') then '' else ':' || {port} end) || "
        f"(case when {path} in ('', '/') then '/' else rtrim({path}, '/') end) end)"
    )
