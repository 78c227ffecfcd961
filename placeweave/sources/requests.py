"""Request bodies as a table."""

from pyspark.sql import DataFrame, functions as F

from placeweave import fixed

PLACE_BODY = (
    "struct<name:string,alternate_name:string,address:string,phone:string,website:string,"
    "listing_url:string,latitude:string,longitude:string,coordinates_source:string>"
)


def read_requests(bodies: DataFrame, body: str = "body", schema: str = PLACE_BODY) -> DataFrame:
    """Parse JSON bodies of 1 to 16384 bytes that hold an object; others get a reject reason.

    Numbers inside text fields are kept as their text.
    """
    size = F.octet_length(F.coalesce(F.col(body), F.lit("")))
    value = F.try_parse_json(body)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    reason = (
        F.when((size <= 0) | (size > fixed.REQUEST_BYTES_MAX), "size")
        .when(value.isNull(), "json")
        .when(~is_object, "object")
    )
    parsed = F.when(reason.isNull(), F.from_json(body, schema))
    return bodies.withColumn("request", parsed).withColumn("reject_reason", reason)


def unpack(requests: DataFrame, key: str) -> DataFrame:
    return requests.filter(F.col("reject_reason").isNull()).select(key, "request.*")
