"""Linkage of places to a versioned award snapshot."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from placeweave import fixed
from placeweave.functions.geo import distance_m
from placeweave.functions.numbers import not_nan
from placeweave.functions.text import contained, fold_name, fold_phone, likeness, none_if_empty
from placeweave.functions.urls import website_key
from placeweave.operators.fuzzy import similar_texts
from placeweave.operators.linkage import column_or, place_keys
from placeweave.operators.skew import grown_join, split_join, spread
from placeweave.operators.spatial import within_distance
from placeweave.session import cut_lineage


def award_keys(snapshot: DataFrame) -> DataFrame:
    """Comparable form of each snapshot row; write it next to the snapshot to compute it once."""
    return snapshot.select(
        "award_id",
        fold_name(column_or(snapshot, "name")).alias("award_name"),
        fold_phone(column_or(snapshot, "phone")).alias("award_phone"),
        website_key(column_or(snapshot, "website")).alias("award_website"),
        not_nan(column_or(snapshot, "latitude")).alias("award_lat"),
        not_nan(column_or(snapshot, "longitude")).alias("award_lng"),
    )


def probes(places: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(place_id, attempt, keys…): attempt 1 is the place alone, attempt 2 adds its linked listing.

    The hint gives one more name, and its coordinates as a pair when the place lacks either one.
    """
    plain = place_keys(places).select(
        "place_id", F.lit(1).alias("attempt"), "place_name", "place_alternate",
        F.lit("").alias("hint_name"), "place_phone", "place_website", "place_lat", "place_lng",
    )
    if hints is None:
        return plain
    hint = hints.select(
        "place_id",
        fold_name(F.col("name")).alias("new_name"),
        not_nan(column_or(hints, "latitude")).alias("hint_lat"),
        not_nan(column_or(hints, "longitude")).alias("hint_lng"),
    )
    lacking = F.col("place_lat").isNull() | F.col("place_lng").isNull()
    second = grown_join(plain, hint, "place_id").select(
        "place_id", F.lit(2).alias("attempt"), "place_name", "place_alternate",
        F.col("new_name").alias("hint_name"), "place_phone", "place_website",
        F.when(lacking, F.col("hint_lat")).otherwise(F.col("place_lat")).alias("place_lat"),
        F.when(lacking, F.col("hint_lng")).otherwise(F.col("place_lng")).alias("place_lng"),
    )
    return plain.unionByName(second)


PROBE = ["place_id", "attempt"]


def _name_score() -> Column:
    return F.greatest(
        *[likeness(F.col(c), F.col("award_name"))
          for c in ("place_name", "place_alternate", "hint_name")]
    )


def _same(kind: str) -> Column:
    return (F.col(f"place_{kind}") != "") & (F.col(f"place_{kind}") == F.col(f"award_{kind}"))


def _score() -> Column:
    identity = F.col("same_phone") | F.col("same_website")
    both = F.col("same_phone") & F.col("same_website")
    closeness = F.greatest(1 - F.col("distance_m") / fixed.AWARD_RADIUS_M, F.lit(0.0))
    name = F.col("name_score")
    return (
        F.when(F.col("distance_m").isNull(), name * 100 + F.when(identity, 85).otherwise(0))
        .when(identity, F.when(both, 70).otherwise(65) + closeness * 30 + name * 5)
        .otherwise(name * 65 + closeness * 35)
    )


def _near_enough() -> Column:
    """Whether a row within the radius takes part without an equal phone or website."""
    return (F.col("name_score") >= 0.45) | (F.col("distance_m") <= 25)


def identity_pairs(
    probe: DataFrame, award: DataFrame, used: DataFrame | None = None, details: DataFrame | None = None
) -> DataFrame:
    """All pairs with an equal phone or website that lie within the radius or where a side lacks coordinates.

    One equi-join on (kind, key). The detail pages of ``used`` replace phone and website of their pairs. ``details``
    (of ``_detail_keys``) does so for every pair that asks for its page: keys of award rows and of pages are
    joined at once, and each pair tells which of them holds.
    """
    own, kinds = award.columns, {"phone": "award_phone", "website": "award_website"}
    if details is not None:
        read = F.coalesce("page_read", F.lit(False)) & F.col("award_lat").isNotNull() & F.col("award_lng").isNotNull()
        award = grown_join(award, details, "award_id", "left").withColumn("page_read", read)
        for kind in ("phone", "website"):
            page = F.when(F.col("page_read"), F.coalesce(f"detail_{kind}", f"award_{kind}"))
            award = award.withColumn(f"page_{kind}", page).drop(f"detail_{kind}")

    def keyed(df, side, kinds):
        entries = [
            F.struct(F.lit(kind).alias("kind"), none_if_empty(F.col(column)).alias("key")) for kind, column in kinds
        ]
        return df.select("*", F.explode(F.array_distinct(F.array(*entries))).alias("e")).select(*df.columns, "e.*")

    held = list(kinds.items())
    if details is not None:
        held += [("phone", "page_phone"), ("website", "page_website")]
    met = split_join(keyed(probe, "place", [(kind, f"place_{kind}") for kind in kinds]), keyed(award, "award", held), ["kind", "key"])
    metres = distance_m(*[F.col(c) for c in ("place_lat", "place_lng", "award_lat", "award_lng")])
    met = met.withColumn("distance_m", metres)
    met = met.filter(F.col("distance_m").isNull() | (F.col("distance_m") <= fixed.AWARD_RADIUS_M))
    if details is not None:
        asked = F.col("page_read") & (F.col("distance_m") <= fixed.DETAIL_RADIUS_M)
        names = F.when(asked, _name_score())
        met = met.withColumn("asked", F.coalesce(asked & (names < 0.45), F.lit(False)))
        # Only the key that holds for the pair counts.
        right = {kind: F.when(F.col("asked"), F.col(f"page_{kind}")).otherwise(F.col(column)) for kind, column in kinds.items()}
        met = met.filter(F.col("key") == F.when(F.col("kind") == "phone", right["phone"]).otherwise(right["website"]))
        met = met.withColumns({column: right[kind] for kind, column in kinds.items()}).drop("asked", "page_read", "page_phone", "page_website")
    # A pair that shares both counts once, as the phone's.
    met = met.filter((F.col("kind") == "phone") | ~_same("phone")).drop("kind", "key")
    if used is not None:
        keys = PROBE + ["award_id"]
        met = grown_join(met, used.select(*keys), keys, "left_anti").unionByName(used)
    met = met.withColumn("same_phone", _same("phone")).withColumn("same_website", _same("website"))
    return met.filter(F.col("same_phone") | F.col("same_website"))


PROFILE = ["award_name", "award_lat", "award_lng"]


def _near_profiles(
    probe: DataFrame, award: DataFrame, keep: tuple[str, ...] = (), radius_m: float = fixed.AWARD_RADIUS_M
) -> DataFrame:
    """Probes beside every name and point of awards within the radius, with its first row and its number of rows.

    Rows of one name and point are alike to a probe unless they share its phone or website.
    """
    profiles = award.groupBy(*PROFILE).agg(
        F.min("award_id").alias("award_id"), F.count(F.lit(1)).alias("copies")
    )
    near = within_distance(probe, profiles, ("place_lat", "place_lng"), ("award_lat", "award_lng"), radius_m)
    names = ["place_name", "place_alternate", "hint_name", "award_name"]
    return near.select(*PROBE, "award_id", "copies", "distance_m", *names, *[k for k in keep if k not in names])


def _scored_by_name(near: DataFrame) -> DataFrame:
    # Two names meet in few tasks, which remember their ratio; the share keeps a frequent pair of names apart.
    share = F.pmod(F.xxhash64(*PROBE), F.lit(4))
    near = spread(near.withColumn("share", share), "place_name", "award_name", "share").drop("share")
    return near.withColumn("name_score", _name_score())


def _may_reach(least: Column) -> Column:
    """Whether a near pair without an equal phone or website may have so many points, told without Python.

    Its names must be alike by so much, and a ratio of t leaves at most (1 - t) of all characters unmatched.
    """
    closeness = F.greatest(1 - F.col("distance_m") / fixed.AWARD_RADIUS_M, F.lit(0.0))
    ratio = F.greatest((least - 0.01 - 35 * closeness) / 65, F.lit(0.45))

    def alike(name):
        left, right = F.col(name), F.col("award_name")
        total = F.length(left) + F.length(right)
        edits = F.floor((1 - ratio) * total + 1e-9).cast("int")
        lengths = 2.0 * F.least(F.length(left), F.length(right)) >= ratio * total - 1e-9
        return (left != "") & (right != "") & (contained(left, right) | lengths & (F.call_function("levenshtein", left, right, edits) >= 0))

    return alike("place_name") | alike("place_alternate") | alike("hint_name")


def _deciding_near(probe: DataFrame, award: DataFrame) -> DataFrame:
    """``_best_of_near`` without the pairs beyond 35 m that can neither win nor stand before a pair that wins.

    Such a pair is accepted with 70 points, and below 65 every identity pair comes before it. But it also stands before a
    lone pair within 35 m that has fewer points; those are looked for first.
    """
    close = cut_lineage(_best_of_near(_near_profiles(probe, award, radius_m=fixed.CLOSE_RADIUS_M).withColumn("name_score", _name_score())))
    lone = F.when((F.col("close") == 1) & (F.col("name_score") >= 0.25), F.col("score"))
    least = F.when(F.col("place_id").isNull(), 0.0).otherwise(F.least(F.lit(65.0), F.coalesce("lone", F.lit(65.0))))
    asked = grown_join(probe, close.select(*PROBE, lone.alias("lone")), PROBE, "left").withColumn("least", least)
    far = _near_profiles(asked, award, ("least",)).filter(F.col("distance_m") > fixed.CLOSE_RADIUS_M).filter(_may_reach(F.col("least")))
    return close.unionByName(_best_of_near(far.withColumn("name_score", _name_score())))


def _best_of_near(near: DataFrame) -> DataFrame:
    """The best near row of each probe, with the number of all its pairs within 35 m.

    Rows are folded where they meet, so pairs are neither stored nor shuffled.
    """
    no = F.lit(False)
    near = near.withColumn("same_phone", no).withColumn("same_website", no).withColumn("score", _score())
    part, close = _near_enough(), F.col("distance_m") <= fixed.CLOSE_RADIUS_M
    order = F.struct("score", "name_score", -F.col("award_id"))
    best = near.groupBy(*PROBE).agg(
        F.max_by(F.struct(*RANKED), F.when(part, order)).alias("best"),
        F.sum(F.when(part & close, F.col("copies")).otherwise(0)).alias("close"),
    )
    return best.filter(F.col("best").isNotNull()).select(*PROBE, "best.*", "close")


def _named_without_distance(probe: DataFrame, award: DataFrame) -> list[DataFrame]:
    """(place_id, attempt, award_id, name_score) where a side lacks coordinates and names are at least 0.94 alike.

    Of the awards of one name the first stands for all, as they score alike.
    """
    lost = F.col("place_lat").isNull() | F.col("place_lng").isNull()
    unplaced = F.col("award_lat").isNull() | F.col("award_lng").isNull()
    names = F.array_distinct(F.array("place_name", "place_alternate", "hint_name"))
    found = []
    # Names matter only where coordinates are missing, on either side.
    for probes_in, awards_in in (
        (probe.filter(lost), award), (probe.filter(~lost), award.filter(unplaced))
    ):
        if awards_in.isEmpty() or probes_in.isEmpty():
            continue
        given = probes_in.select(*PROBE, F.explode(names).alias("name")).filter(F.col("name") != "")
        held = awards_in.filter(F.col("award_name") != "").groupBy("award_name").agg(F.min("award_id").alias("award_id"))
        alike = similar_texts(
            given.select(F.col("name").alias("text")), held.select(F.col("award_name").alias("text")), 0.94
        ).select(
            F.col("left_text").alias("name"), F.col("right_text").alias("award_name"), F.col("likeness").alias("name_score")
        )
        firsts = grown_join(alike, held, "award_name").select("name", "award_id", "name_score")
        found.append(split_join(given, firsts, ["name"]).drop("name"))
    return found


RANKED = ["award_id", "score", "name_score", "distance_m", "same_phone", "same_website"]


def linkage_rows(
    probe: DataFrame, award: DataFrame, details: DataFrame | None = None, lookups: int | None = 4, weak: bool = True
) -> DataFrame:
    """What decides about the award of a probe: its identity pairs, and the best of its other pairs.

    ``close`` tells how many pairs within 35 m a row stands for. Identity pairs have ``website_rank`` and
    ``phone_rank``. A name and point may have identity pairs, too: these never score less than its first
    row, so it can only tie with them, and then an identity pair of the same award comes first.
    ``details`` holds (award_id, phone, website) read from detail pages. A probe with a phone or a
    website uses them for its near rows with an unlike name: the first ``lookups`` in snapshot order, as a live
    search would ask for no more pages, or all of them without that number. Without ``weak`` pairs that can neither
    be accepted nor come before an identity pair are left out.
    """
    no, none = F.lit(False), F.lit(None).cast("int")
    own = [name for name in probe.columns if name not in PROBE] + PROFILE
    if details is not None and lookups is not None:
        # Stored, as the near rows with their scores are read twice.
        near = cut_lineage(_scored_by_name(_near_profiles(probe, award, tuple(own))))
        used, pages = cut_lineage(_with_details(near, award, details, lookups)), None
        plain = _best_of_near(near)
    else:
        plain = _best_of_near(_scored_by_name(_near_profiles(probe, award))) if weak else _deciding_near(probe, award)
        used, pages = None, None if details is None else _detail_keys(details).withColumn("page_read", F.lit(True))
    columns = [*PROBE, *RANKED, "close"]
    for far in _named_without_distance(probe, award):
        far = far.withColumn("distance_m", F.lit(None).cast("double")).withColumn("close", F.lit(0).cast("bigint"))
        far = far.withColumn("same_phone", no).withColumn("same_website", no).withColumn("score", _score())
        plain = plain.select(*columns).unionByName(far.select(*columns))
    plain = plain.withColumn("website_rank", none).withColumn("phone_rank", none)
    same = identity_pairs(probe, award, used, pages).withColumn("name_score", _name_score()).withColumn("score", _score())
    # Where its name and point take part, a pair is counted with them.
    close = F.coalesce(F.col("distance_m") <= 35, no)
    same = _with_ranks(same).withColumn("close", F.when(close & ~_near_enough(), 1).otherwise(0).cast("bigint"))
    columns += ["website_rank", "phone_rank"]
    return plain.select(*columns).unionByName(same.select(*columns))


def _detail_keys(details: DataFrame) -> DataFrame:
    return details.select(
        "award_id",
        fold_phone(F.col("phone")).alias("detail_phone"),
        website_key(F.col("website")).alias("detail_website"),
    )


def _with_details(near: DataFrame, award: DataFrame, details: DataFrame, lookups: int) -> DataFrame:
    """The pairs that one of the first detail pages of a probe decides about, with its phone and website."""
    detail = _detail_keys(details)
    asked = (
        ((F.col("place_phone") != "") | (F.col("place_website") != ""))
        & (F.col("distance_m") <= fixed.DETAIL_RADIUS_M)
        & (F.col("name_score") < 0.45)
    )
    read = (
        award.dropna(subset=PROFILE[1:]).join(detail, "award_id")
        .withColumn("award_phone", F.coalesce("detail_phone", "award_phone"))
        .withColumn("award_website", F.coalesce("detail_website", "award_website"))
        .drop("detail_phone", "detail_website")
    )

    def first(rows, *keys):
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy("award_id"))
        return rows.withColumn("turn", turn).filter(F.col("turn") <= lookups).drop("turn")

    # The first of a probe are among the first of each name and point.
    met = split_join(near.filter(asked).drop("award_id", "copies", "name_score"), first(read, *PROFILE), PROFILE)
    return first(met, *PROBE)


def _with_ranks(pairs: DataFrame) -> DataFrame:
    """Turn of each pair among those of its probe with, and those without, the same website or phone."""
    order = [F.col("score").desc(), F.col("name_score").desc(), F.col("award_id").asc()]
    for kind in ("website", "phone"):
        by_signal = Window.partitionBy(*PROBE, f"same_{kind}").orderBy(*order)
        pairs = pairs.withColumn(f"{kind}_rank", F.row_number().over(by_signal))
    return pairs


def choose_award(pairs: DataFrame) -> DataFrame:
    """The winner of each probe, unless another row makes it ambiguous or it is too weak."""
    close = F.coalesce(F.col("distance_m") <= 35, F.lit(False))
    return choose_of_rows(_with_ranks(pairs.select(*PROBE, *RANKED)).withColumn("close", close.cast("bigint")))


def choose_of_rows(rows: DataFrame) -> DataFrame:
    """``choose_award`` over the rows of ``linkage_rows``."""
    row = F.struct(*RANKED)
    identity = F.col("same_phone") | F.col("same_website")
    order = F.struct("score", "name_score", -F.col("award_id"), identity)

    def second(kind):
        chosen = F.col(f"same_{kind}") & (F.col(f"{kind}_rank") == 2)
        return F.max(F.when(chosen, F.struct("distance_m"))).alias(f"second_{kind}")

    groups = rows.groupBy(*PROBE).agg(
        F.max_by(row, order).alias("winner"),
        F.count_if(F.col("same_website")).alias("website_matches"),
        F.count_if(F.col("same_phone")).alias("phone_matches"),
        second("website"),
        second("phone"),
        F.sum("close").alias("close_rows"),
    )
    groups = groups.select("*", "winner.*").drop("winner")
    by_website = F.col("same_website")
    matches = F.when(by_website, F.col("website_matches")).otherwise(F.col("phone_matches"))
    runner_up = F.when(by_website, F.col("second_website.distance_m")).otherwise(
        F.col("second_phone.distance_m")
    )
    metres = F.col("distance_m")
    apart = F.coalesce(runner_up - metres >= 25, F.lit(False))
    lone = (F.col("close_rows") == 1) & F.coalesce(metres <= 35, F.lit(False))
    accepted = F.when(identity, (matches == 1) | (metres.isNotNull() & apart)).otherwise(
        (F.col("score") >= 70) | (lone & (F.col("name_score") >= 0.25))
    )
    before, after = fixed.REASON_DISTANCE
    reasons = F.array_compact(
        F.array(
            F.when(F.col("same_phone"), fixed.REASON_PHONE),
            F.when(F.col("same_website"), fixed.REASON_WEBSITE),
            F.concat(F.lit(before), F.round(metres).cast("bigint").cast("string"), F.lit(after)),
        )
    )
    capped = F.when(identity, F.least("score", F.lit(100.0))).otherwise(F.col("score"))
    return groups.filter(accepted).select(
        *PROBE,
        "award_id",
        F.round(capped, 1).alias("match_score"),
        F.round("name_score", 3).alias("name_score"),
        metres.alias("distance_m"),
        reasons.alias("reasons"),
    )


def link_awards(
    places: DataFrame,
    snapshot: DataFrame,
    hints: DataFrame | None = None,
    details: DataFrame | None = None,
    lookups: int | None = None,
) -> DataFrame:
    """Accepted award per place; the attempt with a linked listing wins over the one without.

    Of ``details`` a place uses every page that it asks for, or only the first ``lookups``.
    """
    probe, award = cut_lineage(probes(spread(places, "place_id"), hints)), cut_lineage(award_keys(spread(snapshot, "award_id")))
    chosen = choose_of_rows(linkage_rows(probe, award, details, lookups, weak=False))
    row = F.struct("attempt", "award_id", "match_score", "name_score", "distance_m", "reasons")
    best = chosen.groupBy("place_id").agg(F.max_by(row, F.col("attempt")).alias("best"))
    return best.select("place_id", "best.*")


def strict_pairs(probe: DataFrame, award: DataFrame) -> DataFrame:
    """Pairs within 100 m and at least 0.88 alike, or equal names where coordinates are missing."""
    plain = probe.filter(F.col("place_name") != "").select(
        "place_id", "place_name", "place_lat", "place_lng"
    )
    near = within_distance(
        plain, award, ("place_lat", "place_lng"), ("award_lat", "award_lng"), 100.0
    ).withColumn("name_score", likeness(F.col("place_name"), F.col("award_name"), at_least=0.88))
    near = near.filter(F.col("name_score") >= 0.88).withColumn(
        "score",
        F.col("name_score") * 70 + F.greatest(1 - F.col("distance_m") / 100, F.lit(0.0)) * 30,
    )
    metres = distance_m(*[F.col(c) for c in ("place_lat", "place_lng", "award_lat", "award_lng")])
    named = (
        split_join(
            plain.withColumn("key", F.col("place_name")),
            award.withColumn("key", none_if_empty(F.col("award_name"))), ["key"],
        )
        .filter(metres.isNull())
        .withColumn("name_score", F.lit(1.0))
        .withColumn("score", F.lit(100.0))
        .withColumn("distance_m", F.lit(None).cast("double"))
    )
    columns = ["place_id", "award_id", "score", "name_score", "distance_m"]
    return near.select(*columns).unionByName(named.select(*columns))


def first_with_margin(pairs: DataFrame, minimum: float, margin: float) -> DataFrame:
    """Winners of at least ``minimum`` whose runner-up trails by more than ``margin``.

    Only the two best rows of a place leave each map task.
    """
    order = Window.partitionBy("place_id").orderBy(
        F.col("score").desc(), F.col("name_score").desc(), F.col("award_id").asc()
    )
    two = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2)
    row = F.struct("award_id", "score", "name_score", "distance_m")
    best = two.groupBy("place_id").agg(
        F.max(F.when(F.col("rank") == 1, row)).alias("winner"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("runner_up"),
    )
    best = best.select("place_id", "winner.*", "runner_up")
    clear = F.col("runner_up").isNull() | (F.col("runner_up") < F.col("score") - margin)
    return best.filter((F.col("score") >= minimum) & clear).drop("runner_up")


def link_awards_strict(cards: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Unambiguous name and coordinate matches for list cards; no detail signals are used."""
    keys = [cut_lineage(df) for df in (place_keys(cards), award_keys(snapshot))]
    return first_with_margin(strict_pairs(*keys), 85.0, 3.0)
