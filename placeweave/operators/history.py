"""Award history: ordering, de-duplication and the timeline."""

from pyspark.sql import Column, DataFrame, functions as F

from placeweave.functions.labels import current_award_label, history_label
from placeweave.functions.text import text_or_empty
from placeweave.operators.records import keep_first


def history_order() -> list[Column]:
    return [
        F.coalesce("year", F.lit(0)).desc(),
        F.coalesce("category", F.lit("")).desc(),
        F.coalesce("area", F.lit("")).desc(),
    ]


def award_years(years: Column, top: int = 8) -> Column:
    """Distinct plausible years, newest first."""
    plausible = F.filter(years, lambda y: y.between(1990, 2100))
    return F.slice(F.sort_array(F.array_distinct(plausible), False), 1, top)


def timeline(current: DataFrame, history: DataFrame) -> DataFrame:
    """Current award first, then past selections by year; only for places with a past selection.

    ``current`` has (listing_id, distinction_label, green_star, url); ``history`` has
    (listing_id, pos, category, area, year, url).
    """
    past = history.select(
        "listing_id", "pos", F.lit("history").alias("kind"),
        F.coalesce("year", F.lit(0)).alias("year"),
        history_label(F.col("category"), F.col("area")).alias("label"),
        text_or_empty(F.col("url")).alias("url"),
    )
    past = keep_first(past, ["listing_id", "year", "label", "url"], "pos")
    shown = past.select("listing_id").distinct()
    now = current.join(shown, "listing_id", "left_semi").select(
        "listing_id", F.lit(-1).cast("bigint").alias("pos"), F.lit("current").alias("kind"),
        F.lit(None).cast("int").alias("year"),
        current_award_label(F.col("distinction_label"), F.col("green_star")).alias("label"),
        text_or_empty(F.col("url")).alias("url"),
    )
    return now.unionByName(past)


def timeline_order() -> list[Column]:
    return [F.col("kind") == "history", F.col("year").desc(), F.col("pos").asc()]
