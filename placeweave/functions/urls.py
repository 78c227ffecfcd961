"""URL canonical forms, keys and builders."""

from pyspark.sql import Column, functions as F

from placeweave import fixed
from placeweave.functions.text import none_if_empty, once, strip, text_or_empty


def percent_decode(value: Column) -> Column:
    """Decode percent escapes, leaving plus signs and broken escapes as they are."""
    guarded = F.regexp_replace(text_or_empty(value), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B")))


def website_key(value: Column) -> Column:
    """Comparable form of an official site, or empty text for anything but a web address."""
    url = F.regexp_replace(strip(text_or_empty(value)), "[\\t\\r\\n]", "")
    shape = "^(?i)(https?)://([^/?#]*)([^?#]*)"
    scheme = F.lower(F.regexp_extract(url, shape, 1))
    server = F.regexp_replace(F.regexp_extract(url, shape, 2), "^.*@", "")
    host_port = "^(\\[[^\\]]*\\]|[^:]*)(?::(.*))?$"
    host = F.regexp_replace(F.lower(F.regexp_extract(server, host_port, 1)), "^\\[|\\]$", "")
    port_text = F.regexp_extract(server, host_port, 2)
    port = port_text.try_cast("int")
    port_broken = (port_text != "") & (
        ~port_text.rlike("^[0-9]+$") | port.isNull() | (port > 65535)
    )
    default_port = F.when(scheme == "http", 80).otherwise(443)
    shown_port = F.when((port > 0) & (port != default_port), F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(url, shape, 3), "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when((host == "") | port_broken, "").otherwise(
        F.concat(
            F.lit("https://"),
            F.regexp_replace(host, "^www\\.", ""),
            F.coalesce(shown_port, F.lit("")),
            path,
        )
    )


def listing_url(value: Column) -> Column:
    """Canonical listing page of any link to it, through one search redirect; else null."""

    def unwrapped(decoded):
        target = F.regexp_extract(decoded, "\\?(?:[^#]*?&)?uddg=([^&#]+)", 1)
        inner = percent_decode(percent_decode(F.replace(none_if_empty(target), F.lit("+"), F.lit(" "))))
        redirect = decoded.contains("duckduckgo.com/l/") & (target != "")
        return F.when(redirect, F.coalesce(none_if_empty(inner), decoded)).otherwise(decoded)

    def canonical(decoded):
        path = none_if_empty(F.regexp_extract(decoded, fixed.LISTING_URL_PATTERN, 1))
        return F.concat(F.lit("https://tabelog.com/"), path, F.lit("/"))

    return once(once(percent_decode(value), unwrapped), canonical)


def listing_compare_key(value: Column) -> Column:
    trimmed = F.lower(F.regexp_replace(strip(text_or_empty(value)), "/+$", ""))
    return F.regexp_replace(trimmed, "tabelog\\.com/(?:en|tw|cn|kr)/", "tabelog.com/")


def area_path(value: Column) -> Column:
    path = F.regexp_extract(text_or_empty(value), fixed.LISTING_URL_PATTERN, 1)
    return F.regexp_extract(path, "^([^/]+/[^/]+/[^/]+)/", 1)


def nearby_page_url(value: Column, slug: Column | None = None) -> Column:
    tail = F.lit("")
    if slug is not None:
        bare = F.regexp_replace(text_or_empty(slug), "^/+|/+$", "")
        tail = F.when(text_or_empty(slug) == "", "").otherwise(F.concat(bare, F.lit("/")))
    return F.coalesce(F.concat(listing_url(value), F.lit("peripheral_map/"), tail), F.lit(""))


def popularity_page_url(value: Column, sort_code: Column) -> Column:
    area = area_path(value)
    return F.when(area == "", "").otherwise(
        F.concat(F.lit("https://tabelog.com/tw/"), area, F.lit("/rstLst/?SrtT="), sort_code)
    )


def review_page_url(value: Column) -> Column:
    return F.concat(listing_url(value), F.lit("dtlrvwlst/"))


def map_search_url(name: Column, address: Column) -> Column:
    words = F.array(none_if_empty(strip(text_or_empty(name))),
                    none_if_empty(strip(text_or_empty(address))))
    query = F.array_join(F.array_compact(words), " ")
    return F.concat(
        F.lit("https://www.google.com/maps/search/?api=1&query="), F.url_encode(query)
    )


def booking_url(value: Column) -> Column:
    """The address when it can be acted on; empty for other schemes and generic help pages."""
    url = strip(text_or_empty(value))
    path = F.lower(F.regexp_replace(
        F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#;]*)", 1), "/+$", ""))
    usable = url.rlike("^(?i:https?):") & ~path.isin(fixed.GENERIC_BOOKING_PATHS)
    return F.when(usable, url).otherwise("")


def review_listing_url(value: Column) -> Column:
    """Canonical listing page for a review request on one of the allowed hosts, else null."""
    url = strip(text_or_empty(value))
    server = F.regexp_replace(F.regexp_extract(url, "^(?i:https?)://([^/?#]*)", 1), "^.*@", "")
    host = F.lower(F.regexp_replace(server, ":[0-9]*$", ""))
    return F.when(host.isin(fixed.LISTING_PAGE_HOSTS), listing_url(url))


def site_href(value: Column) -> Column:
    """Stable part of a map link: origin and place slug, or origin and path."""
    url = text_or_empty(value)
    origin = F.regexp_extract(url, "^((?i:https?)://[^/?#]+)", 1)
    path = F.regexp_extract(url, "^(?i:https?)://[^/?#]+([^?#]*)", 1)
    slug = F.regexp_extract(path, "^(/maps/place/[^/]+)", 1)
    kept = F.regexp_replace(F.when(slug != "", slug).otherwise(path), "/$", "")
    loose = strip(F.regexp_extract(url, "^([^?#]*)", 1))
    return F.when(origin != "", F.concat(F.lower(origin), kept)).otherwise(loose)


def name_in_href(value: Column) -> Column:
    slug = F.regexp_extract(text_or_empty(value), "/maps/place/([^/?#]+)", 1)
    return strip(percent_decode(F.replace(slug, F.lit("+"), F.lit(" "))))
