"""Shaping and checking of requests; each function keeps every row and says why one is rejected."""

from pyspark.sql import Column, DataFrame, functions as F

from placeweave import fixed
from placeweave.functions.geo import country_of
from placeweave.functions.nearby import texts
from placeweave.functions.numbers import to_double
from placeweave.functions.text import none_if_empty, squeeze, strip, text_or_empty
from placeweave.functions.urls import area_path, listing_url, review_listing_url
from placeweave.operators.linkage import column_or

PLACE_LIMITS = {"name": 200, "alternate_name": 200, "address": 500, "phone": 50, "website": 500}


def clipped(value: Column, limit: int) -> Column:
    return F.left(strip(text_or_empty(value)), F.lit(limit))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull())


def _coordinate(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(number, whether the given text is not one)."""
    raw = column_or(df, name).cast("string")
    return to_double(raw), (text_or_empty(raw) != "") & to_double(raw).isNull()


def check_places(raw: DataFrame) -> DataFrame:
    """Trim, cut and type place requests; name is mandatory and bad coordinates reject the row."""
    lat, bad_lat = _coordinate(raw, "latitude")
    lng, bad_lng = _coordinate(raw, "longitude")
    shaped = {name: clipped(column_or(raw, name), limit) for name, limit in PLACE_LIMITS.items()}
    shaped["listing_url"] = F.coalesce(
        listing_url(clipped(column_or(raw, "listing_url"), 300)), F.lit("")
    )
    exact = F.coalesce(column_or(raw, "coordinates_source") == "place", F.lit(False))
    reason = (
        F.when(shaped["name"] == "", "name")
        .when(bad_lat, "latitude")
        .when(bad_lng, "longitude")
    )
    return raw.withColumns(
        shaped
        | {
            "latitude": lat,
            "longitude": lng,
            "coordinates_source": F.when(exact, "place").otherwise(""),
            "reject_reason": reason,
        }
    )


def check_hints(raw: DataFrame) -> DataFrame:
    """Linked-listing hints from the struct ``linked``, else ``selected``; null without a name.

    A bad coordinate rejects the row.
    """
    given = F.coalesce(F.col("linked"), F.col("selected"))
    name = clipped(given["name"], 200)

    def coordinate(field):
        text = text_or_empty(given[field].cast("string"))
        number = to_double(text)
        return number, (name != "") & (text != "") & number.isNull()

    (lat, bad_lat), (lng, bad_lng) = coordinate("latitude"), coordinate("longitude")
    hint = F.struct(
        name.alias("name"),
        clipped(given["phone"], 50).alias("phone"),
        clipped(given["website"], 500).alias("website"),
        lat.alias("latitude"),
        lng.alias("longitude"),
    )
    return raw.withColumn("hint", F.when(name != "", hint)).withColumn(
        "reject_reason", F.when(bad_lat, "latitude").when(bad_lng, "longitude")
    )


def mark_country(places: DataFrame) -> DataFrame:
    columns = ["listing_url", "phone", "address", "latitude", "longitude", "coordinates_source"]
    return places.withColumn("country", country_of(*[column_or(places, c) for c in columns]))


def drop_overseas(places: DataFrame) -> DataFrame:
    """Remove only places proven to lie abroad."""
    return mark_country(places).filter(F.col("country") != "not_japan")


def check_seeds(raw: DataFrame) -> DataFrame:
    """Recommendation seeds: name, canonical link and at least one of up to four genres."""
    genres = F.transform(texts(F.col("genres")), lambda g: F.left(g, F.lit(80)))
    shaped = {
        "name": clipped(F.col("name"), 200),
        "url": listing_url(clipped(F.col("url"), 300)),
        "genres": F.slice(genres, 1, 4),
    }
    for name, limit in {"station": 100, "address": 500, "lunch_price": 100,
                        "dinner_price": 100}.items():
        shaped[name] = clipped(column_or(raw, name), limit)
    reason = (
        F.when(shaped["name"] == "", "name")
        .when(shaped["url"].isNull(), "url")
        .when(F.size(shaped["genres"]) == 0, "genres")
    )
    return raw.withColumns(shaped | {"reject_reason": reason})


def check_popularity_seeds(raw: DataFrame) -> DataFrame:
    name, url = clipped(F.col("name"), 200), listing_url(clipped(F.col("url"), 300))
    area = area_path(F.coalesce(url, F.lit("")))
    reason = F.when(name == "", "name").when(url.isNull() | (area == ""), "url")
    return raw.withColumns({"name": name, "url": url, "area_path": area, "reject_reason": reason})


def check_review_requests(raw: DataFrame) -> DataFrame:
    """Only listing pages of the allowed hosts; other fields are dropped."""
    url, name = review_listing_url(F.col("url")), squeeze(F.col("name"), 120)
    reason = F.when(url.isNull(), "url").when(name == "", "name")
    key = [c for c in raw.columns if c.endswith("_id")]
    return raw.select(*key, url.alias("url"), name.alias("name"), reason.alias("reject_reason"))


def check_batches(cards: DataFrame) -> DataFrame:
    """List cards of (batch_id, pos, key, name, latitude, longitude, coordinates_source).

    A batch of more than ten cards is refused as a whole; other faults reject one card.
    """
    sizes = cards.groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_size"))
    shaped = check_places(cards.withColumn("key", clipped(F.col("key"), 300)))
    reason = F.when(F.col("batch_size") > fixed.BATCH_CARDS_MAX, "batch").when(
        F.col("key") == "", "key"
    )
    return shaped.join(sizes, "batch_id").withColumn(
        "reject_reason", F.coalesce(reason, F.col("reject_reason"))
    ).drop("batch_size")


def route_cards(cards: DataFrame, matches: DataFrame, badges: DataFrame) -> DataFrame:
    """Status per checked card: invalid, no_match, or matched with its badge columns."""
    matched = matches.select("place_id", "award_id").join(badges, "award_id")
    routed = mark_country(cards).join(matched, "place_id", "left")
    status = (
        F.when(F.col("reject_reason").isNotNull(), "invalid")
        .when(F.col("country") == "not_japan", "no_match")
        .when(F.col("award_id").isNull(), "no_match")
        .otherwise("matched")
    )
    return routed.withColumn("status", status)


def remembered(routed: DataFrame) -> DataFrame:
    """Outcomes worth storing by card key: badges, and the absence of one."""
    return routed.filter(F.col("status").isin("matched", "no_match") & (F.col("key") != ""))


def still_needed(cards: DataFrame, store: DataFrame) -> DataFrame:
    """Cards with a key that the result store does not hold yet."""
    return cards.filter(none_if_empty(F.col("key")).isNotNull()).join(
        store.select("key"), "key", "left_anti"
    )


def covered_batches(needed: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Per batch, whether every needed card is already being looked up."""
    flying = in_flight.select("key", F.lit(True).alias("flying")).distinct()
    return needed.join(flying, "key", "left").groupBy("batch_id").agg(
        F.bool_and(F.col("flying").isNotNull()).alias("covered")
    )
