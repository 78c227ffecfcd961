"""Keyword search by area: an inverted index of name words, joined on the rarest word of each question.

A listing is found when it lies in the place's area and its name holds every word that is asked for. So it also
holds the rarest of them, and joining on that one word alone loses nothing. Words are runs of ASCII letters and
digits; a run of kana or kanji, which is written without spaces, gives its pairs of neighbouring characters.
"""

from pyspark.sql import Column, DataFrame, functions as F

from placeweave import fixed
from placeweave.functions.text import casefold

ASCII_RUN = "[0-9a-z]+"
OTHER_RUN = f"[{fixed.KEPT_CHARACTERS.replace('0-9a-z', '')}]+"


def _runs(name: Column) -> Column:
    return F.regexp_extract_all(casefold(name), F.lit(f"{ASCII_RUN}|{OTHER_RUN}"), F.lit(0))


def _pairs(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, 2))


def _words(name: Column, of_run) -> Column:
    parts = F.transform(
        _runs(name), lambda run: F.when(run.rlike(f"^{ASCII_RUN}$"), F.array(run)).otherwise(of_run(run))
    )
    return F.array_sort(F.array_distinct(F.flatten(parts)))


def asked_words(name: Column) -> Column:
    """Sorted distinct words that a listing must hold; a run of one character asks for that character."""
    return _words(name, lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(_pairs(run)))


def held_words(name: Column) -> Column:
    """Sorted distinct words that a name can be found by: runs, pairs and single characters."""
    def parts(run):
        return F.when(F.length(run) == 1, F.array(run)).otherwise(F.concat(_pairs(run), F.split(run, "")))

    return _words(name, parts)


def word_counts(listings: DataFrame) -> DataFrame:
    """In how many listings of an area each word stands; ``listings`` has listing_area and listing_words."""
    words = listings.select("listing_area", F.explode("listing_words").alias("word"))
    return words.groupBy("listing_area", "word").agg(F.count(F.lit(1)).alias("spread"))


def questions(places: DataFrame, listings: DataFrame) -> DataFrame:
    """(place_area, place_words, word): the rarest word of every question that some listing may answer.

    Each question is asked once, however many places share it. One with a word that no listing of its area holds
    has no answer and leaves here.
    """
    asked = places.select("place_area", "place_words").filter(
        F.col("place_area").isNotNull() & (F.size("place_words") > 0)
    ).distinct()
    each = asked.withColumn("word", F.explode("place_words"))
    counts = word_counts(listings).withColumnRenamed("listing_area", "place_area")
    rarest = F.min(F.struct("spread", "word")).alias("rarest")
    known = each.join(counts, ["place_area", "word"]).groupBy("place_area", "place_words").agg(
        rarest, F.count(F.lit(1)).alias("known")
    )
    return known.filter(F.col("known") == F.size("place_words")).select(
        "place_area", "place_words", F.col("rarest.word").alias("word")
    )
