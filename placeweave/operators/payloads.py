"""Bounded payloads for an optional language model and checks of what it answers."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from placeweave import fixed
from placeweave.functions.labels import ascii_numerals, translate_label
from placeweave.functions.nearby import texts
from placeweave.functions.numbers import finite_double, not_nan, to_double, to_integer
from placeweave.functions.text import has_text, none_if_empty, squeeze, text_or_empty
from placeweave.operators.history import award_years
from placeweave.operators.linkage import column_or


def _bounded(values: Column, width: int, top: int) -> Column:
    cut = F.transform(F.coalesce(values, F.array().cast("array<string>")),
                      lambda v: squeeze(v, width))
    return F.slice(F.filter(cut, lambda v: v != ""), 1, top)


def facts(df: DataFrame) -> Column:
    """The thirteen permitted facts; empty ones are null, so their JSON leaves them out.

    Expects restaurant_name, area, cuisine, tabelog_rating, tabelog_review_count, lunch_price,
    dinner_price, reservation_status, has_online_reservation, payment_available,
    hyakumeiten_years, michelin_distinction and michelin_green_star where the table has them.
    Fields are in name order, as content keys need it.
    """

    def text(name, limit=240):
        return none_if_empty(squeeze(column_or(df, name), limit))

    def filled(values):
        return F.when(F.size(values) > 0, values)

    cuisine = F.transform(_bounded(column_or(df, "cuisine", "array<string>"), 80, 4), translate_label)
    years = award_years(
        F.coalesce(column_or(df, "hyakumeiten_years", "array<int>"), F.array().cast("array<int>"))
    )
    values = {
        "restaurant_name": text("restaurant_name", 120),
        "area": text("area"),
        "cuisine": filled(cuisine),
        "tabelog_rating": not_nan(column_or(df, "tabelog_rating")),
        "tabelog_review_count": to_integer(column_or(df, "tabelog_review_count")),
        "lunch_price": text("lunch_price"),
        "dinner_price": text("dinner_price"),
        "reservation_status": text("reservation_status", 40),
        "has_online_reservation": column_or(df, "has_online_reservation", "boolean"),
        "payment_available": column_or(df, "payment_available", "boolean"),
        "hyakumeiten_years": filled(years),
        "michelin_distinction": text("michelin_distinction", 80),
        "michelin_green_star": column_or(df, "michelin_green_star", "boolean"),
    }
    return F.struct(*[values[name].alias(name) for name in sorted(values)])


def facts_of(candidate: dict[str, Column], place: dict[str, Column], award: dict[str, Column]) -> dict:
    """Fact columns of a linked place: listing fields first, then the place's, then the award's."""

    def first(name):
        listed = none_if_empty(text_or_empty(candidate.get(name, F.lit(None))))
        return F.coalesce(listed, text_or_empty(place.get(name, F.lit(None))))

    payment = candidate.get("payment", F.lit(None).cast("string"))
    return {
        "restaurant_name": first("name"),
        "area": first("address"),
        "cuisine": candidate["genres"],
        "tabelog_rating": candidate["rating"],
        "tabelog_review_count": candidate["review_count"],
        "lunch_price": candidate.get("lunch_price", F.lit(None)),
        "dinner_price": candidate.get("dinner_price", F.lit(None)),
        "reservation_status": candidate.get("reservation_status", F.lit(None)),
        "has_online_reservation": text_or_empty(candidate.get("reservation_url", F.lit(None))) != "",
        "payment_available": F.when(payment.isNotNull(), F.lit(True)),
        "hyakumeiten_years": candidate.get("years", F.lit(None).cast("array<int>")),
        "michelin_distinction": award.get("distinction_label", F.lit(None)),
        "michelin_green_star": F.coalesce(award.get("green_star", F.lit(False)), F.lit(False)),
    }


def budget_texts(
    reviews: DataFrame,
    group: str,
    order: str,
    text: str,
    most: int = fixed.REVIEW_COUNT_MAX,
    width: int = fixed.REVIEW_TEXT_MAX,
    total: int = fixed.REVIEW_TOTAL_MAX,
    tail: int = fixed.REVIEW_TAIL_MIN,
) -> DataFrame:
    """Texts that fit a count and a character budget per group, in order.

    Each text is cut to ``width``; the first that overflows ``total`` is cut to the rest, or ends
    the list when fewer than ``tail`` characters remain. Kept texts are a prefix of the non-empty
    ones, so only the first ``most`` of a group leave each map task.
    """
    in_order = Window.partitionBy(group).orderBy(order)
    cut = reviews.filter(has_text(F.col(text))).withColumn("turn", F.row_number().over(in_order))
    # Only texts that can be kept are cleaned.
    cut = cut.filter(F.col("turn") <= most).withColumn("kept_text", squeeze(F.col(text), width))
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("kept_text")).over(earlier), F.lit(0))
    left_over = F.lit(total) - F.col("before")
    fits = (F.length("kept_text") <= left_over) | (left_over >= tail)
    return cut.withColumn("before", before).filter(fits & (left_over > 0)).withColumn(
        "kept_text", F.left(F.col("kept_text"), left_over.cast("int"))
    ).drop("before")


def review_payload(kept: DataFrame, group: str, name: str) -> DataFrame:
    """One JSON payload per group: anonymous texts under running numbers."""
    entries = F.array_sort(F.collect_list(F.struct("turn", "kept_text")))
    numbered = F.transform(
        "entries",
        lambda e, i: F.struct((i + 1).alias("index"), e["kept_text"].alias("text")),
    )
    grouped = kept.groupBy(group).agg(F.min(name).alias("restaurant_name"), entries.alias("entries"))
    body = F.struct(
        F.col("restaurant_name"),
        F.size("entries").alias("sample_size"),
        numbered.alias("anonymized_reviews"),
    )
    return grouped.select(group, F.size("entries").alias("sample_size"), F.to_json(body).alias("payload"))


def rerank_payload(seeds: DataFrame, pool: DataFrame) -> DataFrame:
    """One JSON payload per seed; candidates of ``pool`` (rank from 1) get opaque ids c0, c1, ….

    Numbers stay numbers in the JSON; missing ones are left out.
    """

    def text(name, width):
        return squeeze(column_or(pool, name), width).alias(name)

    entry = F.struct(
        "rank",
        F.struct(
            F.concat(F.lit("c"), (F.col("rank") - 1).cast("string")).alias("id"),
            text("name", 160),
            _bounded(column_or(pool, "genres", "array<string>"), 80, 4).alias("genres"),
            finite_double(column_or(pool, "rating")).alias("rating"),
            finite_double(column_or(pool, "review_count")).cast("bigint").alias("review_count"),
            text("station", 100), text("area", 180), text("lunch_price", 80), text("dinner_price", 80),
        ).alias("entry"),
    )
    grouped = pool.filter(F.col("rank") <= fixed.SIMILAR_POOL).groupBy("seed_id").agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    seed = F.struct(
        squeeze(F.col("name"), 160).alias("name"),
        _bounded(F.col("genres"), 80, 4).alias("genres"),
        squeeze(column_or(seeds, "station"), 100).alias("station"),
        squeeze(column_or(seeds, "address"), 180).alias("area"),
        squeeze(column_or(seeds, "lunch_price"), 80).alias("lunch_price"),
        squeeze(column_or(seeds, "dinner_price"), 80).alias("dinner_price"),
    )
    body = F.struct(
        F.col("seed"), F.transform("entries", lambda e: e["entry"]).alias("candidates")
    )
    return seeds.select("seed_id", seed.alias("seed")).join(grouped, "seed_id").select(
        "seed_id", F.size("entries").alias("candidate_count"), F.to_json(body).alias("payload")
    )


RANKING_ANSWER = "struct<ranking:array<struct<id:string,score:string,reason:string>>>"


def check_ranking(answer: Column, candidate_count: Column) -> Column:
    """Validated array of struct(id, score, reason), or null when any part of the answer is wrong."""
    ranking = F.from_json(answer, RANKING_ANSWER)["ranking"]
    cleaned = F.transform(
        ranking,
        lambda item: F.struct(
            squeeze(item["id"], 8).alias("id"),
            to_double(item["score"]).alias("score"),
            squeeze(item["reason"], 80).alias("reason"),
        ),
    )
    bound = F.least(candidate_count, F.lit(fixed.SIMILAR_POOL))

    def sound(item):
        number = F.regexp_extract(item["id"], "^c(0|[1-9][0-9]*)$", 1).try_cast("int")
        known = number.isNotNull() & (number < bound)
        return known & item["score"].between(0, 100) & (item["reason"] != "")

    ids = F.transform(cleaned, lambda item: item["id"])
    valid = (
        cleaned.isNotNull()
        & (F.size(cleaned) <= fixed.SIMILAR_SHOWN)
        & F.forall(cleaned, lambda item: F.coalesce(sound(item), F.lit(False)))
        & (F.size(F.array_distinct(ids)) == F.size(ids))
    )
    rounded = F.transform(
        cleaned,
        lambda item: F.struct(
            item["id"], F.round(item["score"]).cast("int").alias("score"), item["reason"]
        ),
    )
    return F.when(F.coalesce(valid, F.lit(False)), rounded)


def reattach(checked: DataFrame, pool: DataFrame) -> DataFrame:
    """Answer rows joined back to the pool by their opaque number."""
    answered = checked.select("seed_id", F.posexplode("ranking").alias("pos", "item")).select(
        "seed_id",
        (F.col("pos") + 1).alias("answer_rank"),
        (F.substring("item.id", 2, 8).cast("int") + 1).alias("rank"),
        F.col("item.score").alias("answer_score"),
        F.col("item.reason").alias("answer_reason"),
    )
    return answered.join(pool, ["seed_id", "rank"])


def with_fallback(checked: DataFrame, pool: DataFrame, rules: DataFrame) -> DataFrame:
    """Model order where the whole answer is valid and the pool is not empty, else the rule order.

    ``checked`` has (seed_id, ranking, answered); the result tells its source per row.
    """
    valid = checked.filter(F.col("ranking").isNotNull())
    model = reattach(valid, pool).select(
        "seed_id", "cand_url", F.col("answer_rank").alias("rank"),
        F.col("answer_score").alias("similarity_score"),
        F.array("answer_reason").alias("reasons"), F.lit("ai").alias("ranking_source"),
    )
    plain = rules.join(valid.select("seed_id"), "seed_id", "left_anti").select(
        "seed_id", "cand_url", "rank", "similarity_score", "reasons",
        F.lit("rules").alias("ranking_source"),
    )
    return model.unionByName(plain)


def fallback_diagnostics(checked: DataFrame, rule_counts: DataFrame, pool_counts: DataFrame) -> DataFrame:
    """Diagnostics per seed: pool counts plus rejected ones for the model, else the rule counts."""
    state = checked.select(
        "seed_id", F.col("ranking").isNotNull().alias("by_model"), "answered",
        F.coalesce(F.size("ranking"), F.lit(0)).alias("chosen"),
    )
    pool = pool_counts.select(
        "seed_id", F.col("below_quality_count").alias("pool_below"),
        F.col("recommendation_count").alias("pool_size"),
    )
    joined = rule_counts.join(pool, "seed_id").join(state, "seed_id", "left")
    model = F.coalesce("by_model", F.lit(False))
    left_out = F.greatest(F.col("pool_size") - F.col("chosen"), F.lit(0))
    return joined.select(
        "seed_id", "returned_count", "same_restaurant_count", "unverified_location_count",
        F.when(model, F.col("pool_below") + left_out).otherwise(F.col("below_quality_count"))
        .alias("below_quality_count"),
        F.when(model, F.col("chosen")).otherwise(F.col("recommendation_count"))
        .cast("bigint").alias("recommendation_count"),
        F.when(model, "ai").otherwise("rules").alias("ranking_source"),
        F.when(model, F.col("pool_size")).otherwise(F.lit(0)).alias("ai_candidate_count"),
        (F.coalesce("answered", F.lit(False)) & ~model).alias("ai_fallback"),
    )


ADVICE_ANSWER = (
    "struct<headline:string,summary:string,best_for:array<string>,cautions:array<string>,"
    "evidence:array<string>>"
)


def check_advice(answer: Column) -> Column:
    """Bounded advice as a struct, its lists joined by newlines so numerals are read in one pass.

    Null when the answer has no summary.
    """
    parsed = F.from_json(answer, ADVICE_ANSWER)
    summary = ascii_numerals(squeeze(parsed["summary"], 220))
    headline = ascii_numerals(squeeze(parsed["headline"], 60))

    def lines(name, top, width):
        joined = ascii_numerals(F.array_join(_bounded(parsed[name], width, top), "\n"))
        return F.filter(F.split(joined, "\n"), lambda x: x != "").alias(name)

    body = F.struct(
        F.coalesce(none_if_empty(headline), F.lit(fixed.ADVICE_HEADLINE)).alias("headline"),
        summary.alias("summary"),
        lines("best_for", 3, 48),
        lines("cautions", 2, 60),
        lines("evidence", 4, 72),
    )
    return F.when(summary != "", body)


REVIEW_ANSWER = (
    "struct<summary:string,positive_themes:array<string>,cautions:array<string>,sample_size:string>"
)


def check_review_summary(answer: Column, sample_size: Column) -> Column:
    """Bounded review themes; the reported sample never exceeds the given one. Null if no summary."""
    parsed = F.from_json(answer, REVIEW_ANSWER)
    summary = squeeze(parsed["summary"], 280)
    reported = F.coalesce(to_integer(parsed["sample_size"]), sample_size)
    ceiling = F.when(sample_size > 0, sample_size).otherwise(fixed.REVIEW_COUNT_MAX)
    size = F.greatest(
        F.lit(0), F.least(reported, F.lit(fixed.REVIEW_COUNT_MAX), ceiling)
    )
    body = F.struct(
        summary.alias("summary"),
        _bounded(parsed["positive_themes"], 48, 5).alias("positive_themes"),
        _bounded(parsed["cautions"], 60, 4).alias("cautions"),
        F.when(size > 0, size).otherwise(sample_size).alias("sample_size"),
        F.lit(fixed.REVIEW_NOTE).alias("source_note"),
    )
    return F.when(summary != "", body)


STORED_SUMMARY = ["listing_key", "summary", "positive_themes", "cautions", "sample_size",
                  "source_note", "model", "fetched_at"]


def storable_summary(df: DataFrame) -> DataFrame:
    """Only the columns that may be stored; review bodies, authors and pictures never pass."""
    return df.select(*[c for c in STORED_SUMMARY if c in df.columns])


def failure_class(message: Column) -> Column:
    text = text_or_empty(message)
    lowered = F.lower(text)
    return (
        F.when(text.contains("403") | lowered.contains("forbidden"), "forbidden")
        .when(text.contains("404"), "not_found")
        .when(lowered.contains("timeout") | lowered.contains("timed out"), "timeout")
        .when(text.rlike("\\b(403|404|429|5\\d\\d)\\b"), "http_error")
        .otherwise("fetch_error")
    )


def failure_counts(log: DataFrame, message: str, by: list[str]) -> DataFrame:
    return log.withColumn("failure", failure_class(F.col(message))).groupBy(*by, "failure").agg(
        F.count(F.lit(1)).alias("failures")
    )
