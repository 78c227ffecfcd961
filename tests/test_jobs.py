import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from placeweave.operators.awards import award_keys
from placeweave.operators.payloads import check_ranking
from placeweave.operators import recommend
from placeweave.plans.match import recommend_nearby
from placeweave.sources import pages, snapshot
from placeweave.streaming.freshness import debounce_stream, fresh_stream, mark_fresh
from placeweave.streaming.windows import debounce

SEED = ("seed_id bigint, url string, genres array<string>, station string, address string, dinner_price string, area_path string")
CARD = ("area_path string, slug string, row_pos int, name string, url string, genres array<string>, station string, address string, rating double, "
        "review_count bigint, dinner_price string")


def test_recommendation_reasons(spark):
    base = "https://tabelog.com/tokyo/A1301/A130101/"
    seed = spark.createDataFrame([(1, base + "1300001/", ["寿司"], "銀座駅", "東京都中央区銀座", "￥20,000～￥29,999", "a")], SEED)
    cards = spark.createDataFrame([
        ("a", "sushi", 1, "朝の鮨", base + "1300001/", ["寿司"], "", "", None, None, ""),
        ("a", "sushi", 2, "夜の鮨", base + "1300002/", ["寿司"], "銀座駅", "東京都中央区銀座1-1-1", 3.81, 210, "￥20,000～￥29,999"),
    ], CARD)
    best, counts = recommend_nearby(seed, cards)
    row = best.first()
    assert row["name"] == "夜の鮨" and row["reasons"] == ["同為壽司", "同為銀座站", "晚餐價位接近"]
    assert counts.first()["same_restaurant_count"] == 1


def test_a_seed_without_a_category_reads_the_generic_list(spark):
    base = "https://tabelog.com/tokyo/A1301/A130101/"
    seeds = spark.createDataFrame([(i, base + f"{1300000 + i}/", g, "", "", "", "a") for i, g in ((1, ["謎"]), (2, None), (3, ["寿司"]))], SEED)
    cards = spark.createDataFrame(
        [("a", slug, i, f"店{slug}{i}", base + f"{n + i}/", ["寿司"], "", "", 3.5, 10, "")
         for slug, n in (("", 1400000), ("sushi", 1500000)) for i in range(40)], CARD)
    _, counts = recommend_nearby(seeds, cards)
    assert {r["seed_id"]: r["returned_count"] for r in counts.collect()} == {1: 20, 2: 20, 3: 20}


def test_bad_ranking_is_refused_whole(one):
    def checked(text):
        return one(check_ranking(F.lit(text), F.lit(3)))

    assert len(checked('{"ranking":[{"id":"c0","score":90,"reason":"x"},{"id":"c2","score":"7","reason":"y"}]}')) == 2
    for bad in ('{"ranking":[{"id":"c0","score":90,"reason":"x"},{"id":"c0","score":1,"reason":"y"}]}',
                '{"ranking":[{"id":"c3","score":90,"reason":"x"}]}', '{"ranking":[{"id":"c0","score":"NaN","reason":"x"}]}',
                '{"ranking":[{"id":"c0","score":9,"reason":" "}]}', "nothing"):
        assert checked(bad) is None


def test_review_texts_hold_no_author(spark):
    html = ('<ul><li class="rvw-item"><p class="rvw-item__rvwr-name">山田太郎</p><div class="body"><p class="date">2024-05</p>'
            '<p>とても美味しいお店でまた必ず行きたいと思います。</p></div></li></ul>')
    nodes = pages.page_nodes(spark.createDataFrame([(1, html)], "page_id bigint, html string"), ["page_id"])
    texts = [r["text"] for r in pages.review_texts(nodes, "page_id").collect()]
    assert len(texts) == 1 and "山田" not in texts[0] and "美味しい" in texts[0]


def test_published_rows_are_numbered_in_order_over_all_ranges(spark):
    rows = spark.range(1000).selectExpr("cast(id as string) id", "struct(cast(999 - id as int) page, 0 pos) first_seen")
    got = {r["id"]: r["award_id"] for r in snapshot.numbered(rows).collect()}
    assert got == {str(i): 999 - i for i in range(1000)}


def test_publish_checks_counts_and_repeats(spark):
    cards = spark.createDataFrame([("r1", 1, 0, "甲"), ("r2", 1, 1, "乙"), ("r1", 2, 0, "甲改")], "id string, page int, pos int, name string")
    totals = spark.createDataFrame([(1, 2, 2)], "page int, declared bigint, last_page int")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/snapshot"
    for _ in range(2):
        assert snapshot.publish(spark, cards, totals, path, "2024-02-02") == 2
    rows = {r["id"]: r["name"] for r in snapshot.published(spark, path, "2024-02-02").collect()}
    assert rows == {"r1": "甲改", "r2": "乙"}
    published = snapshot.published(spark, path, "2024-02-02")
    assert {r["id"]: r["award_id"] for r in published.collect()} == {"r1": 0, "r2": 1}
    keys = {r["award_id"]: r["award_name"] for r in award_keys(published).collect()}
    assert keys == {r["award_id"]: r["award_name"] for r in published.collect()} and keys[0] != keys[1]
    with pytest.raises(ValueError):
        snapshot.publish(spark, cards, totals.withColumn("declared", F.lit(3)), path, "2024-02-03")


def test_broken_or_missing_snapshot_is_empty(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(folder + "/bad.json", "w") as out:
        out.write("{broken")
    assert snapshot.load_snapshot(spark, folder + "/none.json").count() == 0
    assert snapshot.load_snapshot(spark, folder + "/bad.json").count() == 0
    with open(folder + "/good.json", "w") as out:
        out.write('{"fetched_at":"2024","restaurants":[{"id":"r1","name":"甲"},{"id":"r2","name":"乙"}]}')
    rows = snapshot.load_snapshot(spark, folder + "/good.json").collect()
    assert [(r["award_id"], r["id"], r["fetched_at"]) for r in rows] == [(0, "r1", "2024"), (1, "r2", "2024")]


def events(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return table.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


def replay(spark, table, rule):
    """Write the events as three files in time order plus one that moves the watermark past all."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = table.orderBy("ts").toPandas()
    size = len(rows) // 3 + 1
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    end = rows.iloc[-1:].assign(event_id=-1, user_id=-1, ts=rows["ts"].max() + pd.Timedelta(days=90))
    after = end.assign(event_id=-2, ts=end["ts"] + pd.Timedelta(days=1))
    got = []
    for i, part in enumerate(parts + [end, after]):
        spark.createDataFrame(part, table.schema).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    query = (rule(stream).writeStream.outputMode("append")
             .foreachBatch(lambda df, _: got.extend(df.collect()))
             .option("checkpointLocation", f"{folder}/state").start())
    query.processAllAvailable()
    query.stop()
    return [r for r in got if r["event_id"] >= 0]


def test_fresh_stream_equals_the_batch_fold(spark):
    table = events(spark)
    expected = {r["event_id"]: r["hit"] for r in mark_fresh(table, "user_id", 86400).collect()}
    got = {r["event_id"]: r["hit"] for r in replay(spark, table, lambda s: fresh_stream(s, "user_id", 86400))}
    assert got == expected and len(set(expected.values())) == 2


def test_debounce_stream_equals_the_batch_rule(spark):
    table = events(spark)
    delay = 6 * 3600 * 1000
    expected = {r["event_id"] for r in debounce(table, ["user_id"], delay).collect()}
    got = {r["event_id"] for r in replay(spark, table, lambda s: debounce_stream(s, "user_id", delay))}
    assert got == expected and 0 < len(got) < table.count()


def test_seeds_of_one_area_share_their_merged_lists(spark):
    """Lists are merged once per area and categories, whatever the number of seeds, and every seed gets its own pool."""
    from placeweave.operators.recommend import category_candidates, category_pools

    seeds = spark.createDataFrame(
        [(i, ("tokyo/A1301/A130101", "osaka/A2701/A270101", None)[i % 3], (["sushi", "cafe"], ["cafe"], [], None)[i % 4]) for i in range(240)],
        "seed_id bigint, area_path string, slugs array<string>")
    lists = spark.createDataFrame(
        [(area, slug, n, f"u{(n * 7 + len(slug)) % 23}/", f"n{n}", [slug]) for area in ("tokyo/A1301/A130101", "osaka/A2701/A270101")
         for slug in ("sushi", "cafe") for n in range(25)],
        "area_path string, slug string, row_pos bigint, url string, name string, genres array<string>")
    assert category_pools(seeds, lists).select("pool").distinct().count() == 4
    got = {}
    for r in category_candidates(seeds, lists).collect():
        got.setdefault(r["seed_id"], set()).add(r["url"])

    def links(slugs):
        read = []
        for slug in slugs or []:
            read += [f"u{(n * 7 + len(slug)) % 23}/" for n in range(20)]
        return set(list(dict.fromkeys(read))[:30])

    assert got == {i: links(s) for i, a, s in seeds.collect() if a and s}


def test_short_pages_are_handed_on_together(spark):
    """Pages of one batch keep their order and nodes, long ones between short ones included; small inputs are spread over tasks."""
    from placeweave.operators.skew import spread
    from placeweave.sources import pages

    texts = ["<p>a</p>", "", None, "<b>" + "x" * 200_000 + "</b>", "<i>c</i>", "<p>d</p><p>e</p>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string").coalesce(1)
    nodes = pages.page_nodes(rows, ["page_id"]).selectExpr("page_id", "transform(nodes, n -> n.tag) as tags", "html").collect()
    assert [(r["page_id"], r["tags"], r["html"]) for r in nodes] == [
        (0, ["p", "#text"], texts[0]), (1, [], ""), (2, [], None), (3, ["b", "#text"], texts[3]),
        (4, ["i", "#text"], texts[4]), (5, ["p", "#text", "p", "#text"], texts[5])]
    assert spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() >= 4


def test_seeds_of_one_shape_share_their_scores(spark):
    kinds = "seed_id bigint, area_path string, genres array<string>, url string, station string, address string, area string, lunch_price string, dinner_price string"
    path = "tokyo/A1301/A130101"
    seeds = spark.createDataFrame(
        [(i, path if i % 4 else None, ["寿司"], f"https://tabelog.com/{path}/{13000000 + i}/", "", f"東京都中央区{i}", "", "", "￥1,000") for i in range(40)], kinds)
    cards = spark.createDataFrame(
        [(path, "sushi", i, f"店{i}", f"https://tabelog.com/{path}/{13000000 + i}/", 3.0 + i / 10, 5 + i, ["寿司"], "", "", "中央区", "", "￥1,000") for i in range(6)],
        "area_path string, slug string, row_pos int, name string, url string, rating double, review_count bigint, genres array<string>, "
        "address string, station string, area string, lunch_price string, dinner_price string")
    columns = ["seed_id", "cand_url", "raw_score", "similarity_score", "genre", "place_reason", "price_reason", "outcome"]
    plain = recommend.score_similar(recommend.seed_pool(seeds, cards)).select(*columns)
    shared = recommend.scored_pool(seeds, cards).select(*columns)
    rows = sorted(shared.collect())
    assert rows == sorted(plain.collect()) and {r["outcome"] for r in rows} >= {"same", "scored"}
