"""Station, locality, price, genre and rating evidence for recommendations."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from placeweave import fixed
from placeweave.functions.labels import translate_station
from placeweave.functions.numbers import to_double
from placeweave.functions.text import fold_text, is_ascii, strip, text_or_empty

TEXTS = T.ArrayType(T.StringType())


def texts(value: Column) -> Column:
    """Trimmed non-empty entries of an array of text."""
    trimmed = F.transform(F.coalesce(value, F.array().cast(TEXTS)), lambda x: strip(text_or_empty(x)))
    return F.filter(trimmed, lambda x: x != "")


@F.pandas_udf(TEXTS)
def _compatibility_fold_all(values: pd.Series) -> pd.Series:
    return values.map(
        lambda vs: None
        if vs is None
        else [unicodedata.normalize("NFKC", v).casefold() for v in vs]
    )


def fold_texts(value: Column) -> Column:
    """Folded form of every entry; arrays of plain ASCII never leave the JVM."""
    plain = is_ascii(F.array_join(value, ""))
    cased = F.coalesce(
        _compatibility_fold_all(F.when(~plain, value)), F.transform(value, F.lower)
    )
    return F.transform(
        cased, lambda x: F.regexp_replace(x, f"[^{fixed.KEPT_CHARACTERS}]", "")
    )


def station_name(value: Column) -> Column:
    station = strip(text_or_empty(value))
    quoted = strip(F.regexp_extract(station, fixed.QUOTED_STATION_PATTERN, 1))
    on_line = strip(F.regexp_extract(station, fixed.LINE_STATION_PATTERN, 1))
    return (
        F.when(station.rlike(fixed.QUOTED_STATION_PATTERN), quoted)
        .when(on_line != "", on_line)
        .otherwise(station)
    )


def station_key(value: Column) -> Column:
    return fold_text(F.regexp_replace(station_name(value), "駅$", ""))


def station_label(value: Column) -> Column:
    label = translate_station(station_name(value))
    return F.when(label.endswith("站"), label).otherwise(F.concat(label, F.lit("站")))


def prefecture(value: Column) -> Column:
    return F.regexp_extract(strip(text_or_empty(value)), fixed.PREFECTURE_PATTERN, 0)


def locality(value: Column) -> Column:
    """The city or ward after the prefecture, unfolded."""
    address = strip(text_or_empty(value))
    rest = F.regexp_replace(address, f"^.*?{fixed.PREFECTURE_PATTERN}", "")
    return F.regexp_extract(rest, fixed.LOCALITY_PATTERN, 1)


def area_in_address(value: Column) -> Column:
    """Prefecture-like first token of an address, after an optional postcode; null if none."""
    text = F.regexp_replace(text_or_empty(value), "日本[、,]", "")
    token = F.regexp_extract(text, fixed.ADDRESS_AREA_PATTERN, 1)
    return F.when(token != "", token)


def location_columns(prefix: str, station: Column, area: Column, address: Column) -> dict:
    """Folded keys to compute once per row, before the pairs exist."""
    return {
        f"{prefix}_station_key": station_key(station),
        f"{prefix}_area_key": fold_text(area),
        f"{prefix}_address_key": fold_text(address),
        f"{prefix}_prefecture_key": fold_text(prefecture(address)),
        f"{prefix}_locality_key": fold_text(locality(address)),
    }


def location_evidence(area_path: Column, seed_station: Column, candidate_area: Column) -> Column:
    """struct(points, reason) over the columns of ``location_columns("seed"/"cand", ...)``."""
    same_station = (F.col("seed_station_key") != "") & (
        F.col("seed_station_key") == F.col("cand_station_key")
    )
    named_area = (F.length("cand_area_key") >= 2) & F.col("seed_address_key").contains(
        F.col("cand_area_key")
    )
    same_locality = (
        (F.col("seed_prefecture_key") != "")
        & (F.col("seed_prefecture_key") == F.col("cand_prefecture_key"))
        & (F.col("seed_locality_key") != "")
        & (F.col("seed_locality_key") == F.col("cand_locality_key"))
    )

    def evidence(points, reason):
        return F.struct(F.lit(points).alias("points"), reason.alias("reason"))

    return (
        F.when(same_station, evidence(25.0, F.concat(F.lit("同為"), station_label(seed_station))))
        .when(text_or_empty(area_path) != "", evidence(20.0, F.lit("同一 Tabelog 區域")))
        .when(named_area, evidence(14.0, F.concat(F.lit("同在"), text_or_empty(candidate_area))))
        .when(same_locality, evidence(18.0, F.lit("同一行政區")))
        .otherwise(evidence(0.0, F.lit("")))
    )


def price_midpoint(value: Column) -> Column:
    """Mean of the first two whole numbers in the text, or the only one, or null."""
    text = F.translate(text_or_empty(value), "０１２３４５６７８９", "0123456789")
    amounts = F.transform(
        F.slice(F.regexp_extract_all(text, F.lit("[0-9][0-9,]*"), F.lit(0)), 1, 2),
        lambda a: F.replace(a, F.lit(","), F.lit("")).cast("double"),
    )
    total = F.aggregate(amounts, F.lit(0.0), lambda acc, a: acc + a)
    return F.when(F.size(amounts) > 0, total / F.size(amounts))


def price_evidence(
    seed_dinner: Column, seed_lunch: Column, cand_dinner: Column, cand_lunch: Column
) -> Column:
    """struct(points, reason) over price midpoints: dinner first, then lunch."""

    def evidence(gap, label):
        return F.when(
            gap <= 2500, F.struct(F.lit(15.0).alias("points"), F.lit(f"{label}接近").alias("reason"))
        ).when(
            gap <= 6000, F.struct(F.lit(8.0).alias("points"), F.lit(f"{label}相近").alias("reason"))
        )

    return F.coalesce(
        evidence(F.abs(seed_dinner - cand_dinner), "晚餐價位"),
        evidence(F.abs(seed_lunch - cand_lunch), "午餐價位"),
        F.struct(F.lit(0.0).alias("points"), F.lit("").alias("reason")),
    )


BROAD_KEYS = [unicodedata.normalize("NFKC", genre).casefold() for genre in fixed.BROAD_GENRES]


def genres_agree(left: Column, right: Column) -> Column:
    """Folded genres are equal, or one holds the other and the left has two characters."""
    inside = left.contains(right) | right.contains(left)
    return (left != "") & (right != "") & ((left == right) | ((F.length(left) >= 2) & inside))


def is_broad(folded: Column) -> Column:
    return folded.isin(BROAD_KEYS)


def genre_evidence(seed_genres: Column, seed_keys: Column, cand_keys: Column) -> Column:
    """struct(points, genre): 45 for a specific match, 5 for a broad one beside a specific seed."""
    pairs = F.arrays_zip(seed_genres.alias("genre"), seed_keys.alias("key"))
    matches = F.filter(
        pairs, lambda p: F.exists(cand_keys, lambda c: genres_agree(p["key"], c))
    )
    specific = F.filter(matches, lambda p: ~is_broad(p["key"]))
    seed_specific = F.exists(seed_keys, lambda k: ~is_broad(k))

    def evidence(points, genre):
        return F.struct(F.lit(points).alias("points"), genre.alias("genre"))

    return (
        F.when(F.size(specific) > 0, evidence(45.0, F.get(specific, 0)["genre"]))
        .when(F.size(matches) == 0, evidence(0.0, F.lit("")))
        .when(seed_specific, evidence(5.0, F.get(matches, 0)["genre"]))
        .otherwise(evidence(45.0, F.get(matches, 0)["genre"]))
    )


def rating_points(rating: Column, review_count: Column) -> Column:
    stars = F.coalesce(to_double(rating), F.lit(0.0))
    reviews = F.greatest(F.coalesce(to_double(review_count), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(8.0), stars / 5 * 8) + F.least(
        F.lit(7.0), F.log10(F.floor(reviews) + 1) / 3 * 7
    )
