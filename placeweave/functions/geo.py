"""Distances, coordinates in map links and the country rule."""

from pyspark.sql import Column, DataFrame, functions as F

from placeweave import fixed
from placeweave.functions.numbers import to_double
from placeweave.functions.text import text_or_empty


def hops(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> dict[str, Column]:
    """The parts of a great-circle distance that need trigonometry, by name; ``metres_of`` makes metres of them."""
    return {
        "hop_lat": F.sin(F.radians(lat_b - lat_a) / 2),
        "hop_lng": F.sin(F.radians(lng_b - lng_a) / 2),
        "hop_cos": F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)),
    }


def metres_of(half_lat: Column, half_lng: Column, cosines: Column) -> Column:
    chord = half_lat * half_lat + (cosines * half_lng * half_lng)
    return 2 * fixed.EARTH_RADIUS_M * F.asin(F.sqrt(F.when(chord > 1, 1.0).otherwise(chord)))


def distance_m(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Great-circle metres; null when any coordinate is."""
    return metres_of(*hops(lat_a, lng_a, lat_b, lng_b).values())


def with_distance(pairs: DataFrame, points: tuple[str, str, str, str], out: str) -> DataFrame:
    """Add great-circle metres between two points, computed once per row.

    Each part leaves a generator of one row: Spark would write a plain column into every condition that reads it.
    """
    parts = hops(*[F.col(c) for c in points])
    pairs = pairs.select("*", F.inline(F.array(F.struct(*[part.alias(name) for name, part in parts.items()]))))
    return pairs.select("*", F.explode(F.array(metres_of(*[F.col(name) for name in parts]))).alias(out)).drop(*parts)


PIN = "!3d(-?\\d+(?:\\.\\d+)?)!4d(-?\\d+(?:\\.\\d+)?)"
VIEW = "/@(-?\\d+(?:\\.\\d+)?),(-?\\d+(?:\\.\\d+)?)"


def map_link_point(url: Column, viewport: bool = True) -> Column:
    """struct(latitude, longitude, source): the last pin, else the viewport, else nulls."""
    url = text_or_empty(url)
    pins = F.size(F.regexp_extract_all(url, F.lit(PIN), F.lit(0))) > 0
    view = url.rlike(VIEW) if viewport else F.lit(False)

    def part(group):
        pin = F.element_at(F.regexp_extract_all(url, F.lit(PIN), F.lit(group)), -1)
        seen = F.when(view, F.regexp_extract(url, VIEW, group))
        return F.when(pins, pin).otherwise(seen).cast("double")

    source = F.when(pins, "place").when(view, "viewport").otherwise("")
    return F.struct(
        part(1).alias("latitude"), part(2).alias("longitude"), source.alias("source")
    )


def country_of(
    listing_url: Column,
    phone: Column,
    address: Column,
    latitude: Column,
    longitude: Column,
    coordinates_source: Column,
) -> Column:
    """"japan" on positive evidence, "not_japan" only from exact outside pins, else "unknown"."""
    address = text_or_empty(address)
    positive = (
        text_or_empty(listing_url).rlike(fixed.COUNTRY_URL_PATTERN)
        | text_or_empty(phone).rlike(fixed.COUNTRY_PHONE_PATTERN)
        | address.rlike(fixed.COUNTRY_POSTCODE_PATTERN)
        | address.rlike(fixed.COUNTRY_ADDRESS_PATTERN)
    )
    box = fixed.COUNTRY_BOX
    lat, lng = to_double(latitude), to_double(longitude)
    exact = (coordinates_source == "place") & lat.isNotNull() & lng.isNotNull()
    inside = lat.between(box["south"], box["north"]) & lng.between(box["west"], box["east"])
    return (
        F.when(positive, "japan")
        .when(F.coalesce(exact & ~inside, F.lit(False)), "not_japan")
        .otherwise("unknown")
    )
