"""Alias-tolerant record shaping, merging of details, unions by key and first-wins rules."""

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from placeweave.functions.numbers import to_double, to_integer
from placeweave.functions.text import text_or_empty
from placeweave.functions.urls import booking_url

LISTING_ALIASES = {
    "name": ["name", "restaurant_name", "display_name"],
    "rating": ["rating", "score"],
    "review_count": ["review_count", "reviews_count", "reviewCount"],
    "address": ["address", "full_address"],
    "phone": ["phone", "telephone", "tel"],
    "url": ["url", "restaurant_url"],
    "area": ["area", "location_area"],
    "station": ["station", "nearest_station"],
    "lunch_price": ["lunch_price", "lunch_budget"],
    "dinner_price": ["dinner_price", "dinner_budget"],
    "business_hours": ["business_hours", "hours"],
    "closed_days": ["closed_days", "regular_holiday"],
    "reservation_url": ["reservation_url", "booking_url"],
    "latitude": ["latitude", "lat", "coordinates.latitude", "coordinates.lat",
                 "location.latitude", "location.lat"],
    "longitude": ["longitude", "lng", "lon", "coordinates.longitude", "coordinates.lng",
                  "coordinates.lon", "location.longitude", "location.lng", "location.lon"],
    "genres": ["genres", "genre", "categories"],
}
NUMBERS = {"rating": to_double, "review_count": to_integer, "latitude": to_double,
           "longitude": to_double}


def _field_type(schema: T.StructType, path: str):
    head, _, rest = path.partition(".")
    if head not in schema.names:
        return None
    kind = schema[head].dataType
    if not rest:
        return kind
    return _field_type(kind, rest) if isinstance(kind, T.StructType) else None


def filled(value: Column, kind) -> Column:
    """The value unless it is null, empty text or an empty collection."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(value) > 0, value)
    if isinstance(kind, T.StringType):
        return F.when(value != "", value)
    return value


def shape_listings(raw: DataFrame, keep: list[str]) -> DataFrame:
    """Target columns from whatever aliases the source has; text genres become one-entry arrays."""
    columns = []
    for target, paths in LISTING_ALIASES.items():
        found = []
        for path in paths:
            kind = _field_type(raw.schema, path)
            if kind is None or isinstance(kind, T.StructType):
                continue
            value = filled(F.col(path), kind)
            if target == "genres":
                if isinstance(kind, T.StringType):
                    value = F.when(value.isNotNull(), F.array(value))
            else:
                value = value.cast("string")
            found.append(value)
        if target == "genres":
            empty = F.array().cast("array<string>")
            columns.append(F.coalesce(*found, empty).alias(target))
            continue
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        if target in NUMBERS:
            value = NUMBERS[target](value)
        else:
            value = text_or_empty(value)
        if target == "reservation_url":
            value = booking_url(value)
        columns.append(value.alias(target))
    reserved = F.col("has_reservation") if "has_reservation" in raw.columns else F.lit(False)
    columns.append(F.coalesce(reserved.cast("boolean"), F.lit(False)).alias("has_reservation"))
    return raw.select(*keep, *columns)


def prefer_details(summary: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """A filled detail field replaces the summary field of the same name."""
    fields = [c for c in detail.columns if c != key]
    renamed = detail.select(key, *[F.col(c).alias(f"detail_{c}") for c in fields])
    joined = summary.join(renamed, key, "left")
    merged = []
    for name in summary.columns + [c for c in fields if c not in summary.columns]:
        if name not in fields:
            merged.append(F.col(name))
            continue
        value = filled(F.col(f"detail_{name}"), detail.schema[name].dataType)
        if name in summary.columns:
            value = F.coalesce(value, F.col(name))
        merged.append(value.alias(name))
    return joined.select(*merged)


def enrich_best(
    candidates: DataFrame, detail: DataFrame, key: str, group: str, order: list[Column], top: int = 4
) -> DataFrame:
    """Merge details only into the first ``top`` candidates per group; the rest pass unchanged."""
    best = candidates.select(
        group, key, F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("turn")
    ).filter(F.col("turn") <= top)
    chosen = detail.join(best, key).drop("turn")
    marked = candidates.withColumn("merge_key", F.struct(group, key))
    chosen = chosen.withColumn("merge_key", F.struct(group, key)).drop(group, key)
    return prefer_details(marked, chosen, "merge_key").drop("merge_key")


def append_new(known: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which a key of ``known`` keeps its row and hides the extra one."""
    return known.unionByName(extra.join(known.select(*keys).distinct(), keys, "left_anti"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key in ``order``, folded in the map tasks."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("row")).select(*keys, "row.*")


def first_distinct(df: DataFrame, group: str, key: str, position: str, top: int) -> DataFrame:
    """The first ``top`` distinct keys per group in document order, as (group, key, rank)."""
    firsts = df.groupBy(group, key).agg(F.min(position).alias("first_position"))
    ranked = firsts.withColumn(
        "rank", F.row_number().over(Window.partitionBy(group).orderBy("first_position"))
    )
    return ranked.filter(F.col("rank") <= top).select(group, key, "rank")


def keep_newest(
    df: DataFrame, store: list[str], saved_at: str, top: int, oldest: Column | None = None
) -> DataFrame:
    """Newest ``top`` entries per store; entries saved before ``oldest`` go first."""
    if oldest is not None:
        df = df.filter(F.col(saved_at) >= oldest)
    ties = [F.col(c).asc() for c in df.columns if c.endswith("_id")]
    order = Window.partitionBy(*store).orderBy(F.col(saved_at).desc(), *ties)
    return df.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= top).drop("turn")
