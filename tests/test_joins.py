import math
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from placeweave.operators.fuzzy import similar_texts
from placeweave.operators.skew import following, split_join
from placeweave.operators.spatial import within_distance


def metres(a, b):
    half_lat = math.sin(math.radians(b[0] - a[0]) / 2)
    half_lng = math.sin(math.radians(b[1] - a[1]) / 2)
    chord = half_lat**2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half_lng**2
    return 2 * 6371000 * math.asin(math.sqrt(min(chord, 1)))


def test_grid_join_finds_every_pair(spark):
    draw = random.Random(5)
    points = []
    for lat, lng in [(35.0, 139.0), (0.0, 180.0), (89.999, 10.0), (-60.0, -179.999), (71.2, 0.0)]:
        for _ in range(60):
            points.append((lat + draw.uniform(-0.01, 0.01), (lng + draw.uniform(-0.05, 0.05) + 180) % 360 - 180))
    points = [(max(-90.0, min(90.0, a)), b) for a, b in points]
    rows = [(i, *p) for i, p in enumerate(points)]
    left = spark.createDataFrame(rows, "a bigint, lat_a double, lng_a double")
    right = spark.createDataFrame(rows, "b bigint, lat_b double, lng_b double")
    expected = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if metres(p, q) <= 500}
    for pairs in (25_000_000, 9):
        pairs = within_distance(left, right, ("lat_a", "lng_a"), ("lat_b", "lng_b"), 500.0, pairs_per_block=pairs)
        found = [(r["a"], r["b"]) for r in pairs.select("a", "b").collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_grid_join_is_an_equi_join(spark):
    lat, lng = F.col("id") * 0.001 + 35.0, F.col("id") * 0.002 + 139.0
    left = spark.range(10).select(F.col("id").alias("a"), lat.alias("y1"), lng.alias("x1"))
    right = spark.range(10).select(F.col("id").alias("b"), lat.alias("y2"), lng.alias("x2"))
    plan = within_distance(left, right, ("y1", "x1"), ("y2", "x2"), 500.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_split_join_keeps_all_pairs_of_a_hot_key(spark):
    rows = [(i, 0 if i % 3 else i) for i in range(90)]
    left = spark.createDataFrame(rows, "a bigint, k bigint")
    right = spark.createDataFrame(rows, "b bigint, k bigint")
    expected = sorted((x, y) for x, k in rows for y, q in rows if k == q)
    for pairs in (1, 7, 50, 10**9):
        found = sorted((r["a"], r["b"]) for r in split_join(left, right, ["k"], pairs_per_block=pairs).collect())
        assert found == expected


def test_blocks_of_a_split_join_stay_below_the_pair_bound(spark):
    from pyspark.sql import functions as F

    from placeweave.operators.skew import block_counts

    for m, n in ((1, 10**6), (10**6, 3), (5000, 5000), (400, 10**5), (10, 10)):
        a, b = spark.range(1).select(*block_counts(F.lit(float(m)), F.lit(float(n)), 10_000)).first()
        assert -(-m // a) * -(-n // b) <= 10_200
        assert (a, b) == (1, 1) or m * n > 10_000


def alike(a, b):
    if a in b or b in a:
        short, long = sorted((len(a), len(b)))
        return 0.88 + 0.12 * short / long
    return SequenceMatcher(None, a, b).ratio()


def test_similar_texts_misses_nothing(spark):
    draw = random.Random(3)
    names = {"".join(draw.choice("abcdef") for _ in range(draw.randint(1, 12))) for _ in range(90)}
    names |= {n[:-1] + "z" for n in list(names)[:50]} | {n + "y" for n in list(names)[:30]} | {"x", "xy", "xyz", "abababab", "babababa"}
    texts = spark.createDataFrame([(n,) for n in names], "text string")
    for threshold in (0.88, 0.95):
        found = {(r[0], r[1]) for r in similar_texts(texts, texts, threshold).select("left_text", "right_text").collect()}
        assert found == {(a, b) for a in names for b in names if alike(a, b) >= threshold}


def test_following_crosses_buckets(spark):
    draw = random.Random(9)
    rows = [(i, i % 3, draw.randint(0, 1000)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, t bigint")
    got = {r["id"]: r["later"] for r in following(df, ["k"], ["t", "id"], F.floor(F.col("t") / 50), "t", "later").collect()}
    for k in range(3):
        ordered = sorted((t, i) for i, key, t in rows if key == k)
        for (_, i), after in zip(ordered, ordered[1:] + [(None, None)]):
            assert got[i] == after[0]


def test_growing_tables_are_not_broadcast(spark):
    """However small the sides look to Spark, none of them is collected in the driver."""
    from placeweave.operators.linkage import listing_keys, named_rows, place_keys
    from placeweave.operators.skew import grown_join

    rows = spark.range(20).selectExpr("id as place_id", "id as listing_id", "'old ring' as name", "cast(id as string) as url")
    suggested = rows.select("place_id", F.lit("oldring").alias("listing_name"), F.lit(1.0).alias("name_score"))
    met = named_rows(place_keys(rows), listing_keys(rows), suggested)
    assert met.count() == 400 and grown_join(rows, rows.select("place_id"), "place_id").count() == 20
    plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("SortMergeJoin") >= 2
