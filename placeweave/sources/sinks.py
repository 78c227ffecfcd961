"""Typed result tables. A repeated run makes a new version of its day, so it is harmless."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from placeweave.sources.versions import read_current, write_version

MATCHES = {
    "place_id": "bigint", "listing_id": "bigint", "score": "double", "confidence": "string",
    "reasons": "array<string>", "distance_m": "double", "matched": "boolean",
    "needs_confirmation": "boolean",
}
BADGES = {
    "key": "string", "status": "string", "award_id": "bigint", "distinction": "string",
    "label": "string", "green_star": "boolean",
}
RECOMMENDATIONS = {
    "seed_id": "bigint", "rank": "int", "name": "string", "cand_url": "string",
    "similarity_score": "int", "reasons": "array<string>",
}
POPULARITY = {"listing_id": "bigint", "ranking_key": "string", "rank": "int", "tier": "string"}


def typed(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the columns of a result table, in its types."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in schema.items()])


def write_result(df: DataFrame, schema: dict[str, str], path: str, run_date: str) -> None:
    """The results of one day, as a version of their own; those of other days stay as they are."""
    write_version(typed(df, schema).withColumn("run_date", F.lit(run_date)), path, run_date)


def read_results(spark: SparkSession, path: str, *run_dates: str) -> DataFrame:
    """The current results of the given days, or of all."""
    return read_current(spark, path, *run_dates)
