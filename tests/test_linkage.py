import random

from pyspark.sql import functions as F

from placeweave.operators.awards import link_awards, link_awards_strict
from placeweave.operators.dedupe import resolve_duplicates
from placeweave.operators.linkage import listing_keys, place_keys, rank_candidates, score_pairs
from placeweave.plans.match import candidate_lists, match_places
from tests.test_joins import alike, metres

PLACE = ("place_id bigint, name string, alternate_name string, address string, phone string, website string, "
         "latitude double, longitude double, coordinates_source string")
LISTING = ("listing_id bigint, name string, address string, phone string, url string, latitude double, "
           "longitude double, rating double, review_count bigint, is_relocated boolean")


def test_scores_and_reasons(spark):
    place = spark.createDataFrame([(1, "朝霧庵", "", "長野県松本市1", "+81 312-34-5678", "", 35.9, 140.6, "place")], PLACE)
    listing = spark.createDataFrame(
        [(7, "割烹 朝霧庵 本店", "長野県松本市1", "0312-34-5678", "https://tabelog.com/a", 35.9, 140.6, 3.5, 20, True),
         (8, "別の店", "", "", "https://tabelog.com/b", 36.9, 140.6, None, 0, False)], LISTING)
    pairs = place_keys(place).crossJoin(listing_keys(listing))
    rows = {r["listing_id"]: r for r in rank_candidates(score_pairs(pairs)).collect()}
    assert rows[7]["score"] == 100.0 and rows[7]["confidence"] == "high"
    assert rows[7]["reasons"] == ["電話完全相同", "店名高度相似", "地址高度相似", "座標相距 0 公尺", "Tabelog 標示為移轉前資料"]
    assert rows[8]["confidence"] == "low" and rows[8]["rank"] == 1


def test_direct_link_short_circuits(spark):
    place = spark.createDataFrame(
        [(1, "甲", "https://tabelog.com/en/tokyo/A1301/A130101/13000001/")], "place_id bigint, name string, listing_url string")
    listing = spark.createDataFrame(
        [(5, "乙", "https://tabelog.com/tokyo/A1301/A130101/13000001/")], "listing_id bigint, name string, url string")
    row = match_places(place, listing).first()
    assert (row["listing_id"], row["score"], row["confidence"]) == (5, 98.0, "high")


def test_reviewed_duplicate_wins(spark):
    place = spark.createDataFrame([(1, "朝霧庵", "", "", "0312345678", "", 35.9, 140.6, "place")], PLACE)
    listing = spark.createDataFrame(
        [(1, "朝霧庵", "", "", "https://tabelog.com/x/1", 35.9, 140.6, None, 0, False),
         (2, "朝霧庵", "", "0312345678", "https://tabelog.com/x/2", 35.9, 140.6, 3.2, 40, False)], LISTING)
    winners, duplicates = candidate_lists(place, listing)
    rows = winners.collect()
    assert [r["listing_id"] for r in rows] == [2] and rows[0]["duplicate_count"] == 1
    assert "同址重複頁面中評論資料較完整" in rows[0]["reasons"]
    assert [r["url"] for r in duplicates.collect()] == ["https://tabelog.com/x/1"]


def test_a_folded_copy_with_reviews_still_stops_the_search(spark):
    place = spark.createDataFrame([(1, "朝霧庵", "", "", "0312345678", "", 35.9, 140.6, "place")], PLACE)
    copy = ("朝霧庵", "", "", "https://tabelog.com/x/1", 35.9, 140.6)
    listing = spark.createDataFrame(
        [(1, *copy, None, 0, False), (2, *copy, 3.1, 50, True),
         (3, "みどり亭", "", "0312345678", "https://tabelog.com/x/3", 35.9, 140.6, None, 0, False)], LISTING)
    ranked, _ = candidate_lists(place, listing)
    first = ranked.filter("rank = 1").first()
    found = match_places(place, listing).first()
    assert (found["listing_id"], found["score"]) == (first["listing_id"], first["score"]) and found["listing_id"] == 1


def test_greedy_duplicates_match_a_plain_loop(spark):
    draw = random.Random(11)
    rows = []
    for rank in range(1, 61):
        name = draw.choice(["朝霧庵食事処", "朝霧庵食事", "あおぞら亭銀座", "abcdefghijkl", "abcdefghijkm", ""])
        rows.append((
            draw.randint(1, 2), rank, draw.choice([None, None, "u1", "u2"]), name, draw.choice(["", "", "0311", "0322"]),
            draw.choice(["", "", "東京都中央区銀座一", "東京都中央区銀座二"]),
            *draw.choice([(None, None), (35.0, 139.0), (35.0003, 139.0), (35.0006, 139.0), (35.01, 139.0)])))
    df = spark.createDataFrame(rows, "g bigint, rank bigint, url_key string, name string, phone string, address string, lat double, lng double")
    got = {(r["g"], r["rank"]): r["winner_rank"] for r in resolve_duplicates(df, ["g"]).collect()}

    def same(a, b):
        if a[2] and a[2] == b[2]:
            return True
        if not a[3] or not b[3] or alike(a[3], b[3]) < 0.95:
            return False
        if a[4] and a[4] == b[4]:
            return True
        if a[6] is not None and b[6] is not None and metres(a[6:], b[6:]) <= 50:
            return True
        return bool(a[5] and b[5] and alike(a[5], b[5]) >= 0.92)

    for group in (1, 2):
        winners = []
        for row in (r for r in rows if r[0] == group):
            first = next((w for w in winners if same(w, row)), None)
            if first is None:
                winners.append(row)
            assert got[(group, row[1])] == (first or row)[1]


AWARD = "award_id bigint, name string, phone string, website string, latitude double, longitude double"


def test_award_identity_across_languages(spark):
    place = spark.createDataFrame([(1, "Sushi Foo", "", "", "+81 3-1111-2222", "https://www.foo.jp/", 35.0, 139.0, "place")], PLACE)
    both = spark.createDataFrame([(0, "鮨ふう", "03-1111-2222", "http://foo.jp", 35.00005, 139.0)], AWARD)
    row = link_awards(place, both).first()
    assert row["match_score"] > 95 and row["reasons"][:2] == ["電話完全相同", "官方網站完全相同"]
    twins = spark.createDataFrame(
        [(0, "鮨ふう", "03-1111-2222", "", 35.0, 139.0), (1, "鮨ふう二", "03-1111-2222", "", 35.00005, 139.0)], AWARD)
    assert link_awards(place, twins).count() == 0
    details = spark.createDataFrame([(0, "03-1111-2222", "")], "award_id bigint, phone string, website string")
    bare = spark.createDataFrame([(0, "鮨ふう", "", "", 35.0004, 139.0)], AWARD)
    assert link_awards(place, bare).count() == 0
    assert link_awards(place, bare, details=details).first()["award_id"] == 0


def test_strict_links(spark):
    award = spark.createDataFrame([(0, "鮨ふう", "", "", 35.0, 139.0)], AWARD)
    cards = spark.createDataFrame(
        [(1, "鮨ふう", 35.00005, 139.0), (2, "鮨ふう", 35.00075, 139.0), (3, "鮨ふ", None, None), (4, "鮨ふう", None, None)],
        "place_id bigint, name string, latitude double, longitude double")
    linked = {r["place_id"] for r in link_awards_strict(cards, award).collect()}
    assert linked == {1, 4}


def test_hint_supplies_name_and_coordinates(spark):
    place = spark.createDataFrame([(1, "Foo", "", "", "", "", None, None, "")], PLACE)
    award = spark.createDataFrame([(0, "鮨ふう", "", "", 35.0, 139.0)], AWARD)
    hint = spark.createDataFrame([(1, "鮨ふう", 35.0, 139.0)], "place_id bigint, name string, latitude double, longitude double")
    assert link_awards(place, award).count() == 0
    assert link_awards(place, award, hint).first()["attempt"] == 2


def test_candidates_match_all_pairs(spark):
    """Suggested names and keywords of an area, against every pair of a small table in two scripts."""
    import re

    from placeweave.operators.linkage import candidate_pairs

    draw = random.Random(12)
    stems = ["清水屋", "水屋清", "鮨", "あおぞら亭", "blue bolt", "old ring"]
    ends = ["", " 本店", " 銀座", " annex", " no 2"]
    areas = ["東京都中央区1", "大阪府大阪市2", "", "〒104-0061 東京都港区3"]
    names = [draw.choice(stems) + draw.choice(ends) + draw.choice(["", " " + draw.choice(stems)]) for _ in range(90)]
    place = [(i, draw.choice([*names[:30], "bolt blue", "銀座 清水", None]), draw.choice(["", "", " ", draw.choice(names)]), draw.choice(areas)) for i in range(40)]
    place += [(40 + i, ("銀座 清水", "bolt blue")[i % 2], None, areas[i // 2]) for i in range(8)]
    listing = [(i, names[30 + i], draw.choice(areas)) for i in range(60)]
    table = spark.createDataFrame([(i, n, a, d) for i, n, a, d in place], "place_id bigint, name string, alternate_name string, address string")
    rows = spark.createDataFrame([(i, n, d, f"u{i}") for i, n, d in listing], "listing_id bigint, name string, address string, url string")
    got = {(r["place_id"], r["listing_id"]): r["stage"] for r in candidate_pairs(place_keys(table), listing_keys(rows)).collect()}

    def fold(name):
        folded = re.sub("[^0-9a-z぀-ヿ㐀-鿿]", "", (name or "").lower())
        for word in ["うなぎ", "鰻", "割烹", "食堂", "レストラン", "料理店", "居酒屋", "喫茶店", "カフェ", "本店", "支店", "駅前店", "別館", "新館"]:
            folded = folded.replace(word, "")
        return folded

    def words(name, held):
        out = set()
        for run in re.findall("[0-9a-z]+|[぀-ヿ㐀-鿿]+", (name or "").lower()):
            if re.match("[0-9a-z]", run) or len(run) == 1:
                out.add(run)
            else:
                out |= {run[i : i + 2] for i in range(len(run) - 1)} | (set(run) if held else set())
        return out

    def area(address):
        found = re.search(r"(?:〒\s*\d{3}-?\d{4}\s*)?([^\s,，]{2,12}?[都道府県])", address)
        return found and found[1]

    expected = {}
    for p, name, other, address in place:
        own = [f for f in (fold(name), fold(other)) if f]
        suggested = {i for i, n, _ in listing if any(fold(n) and alike(o, fold(n)) >= 0.88 for o in own)}
        asked = words(other if (other or "").strip() else name, False)
        for i, n, d in listing:
            if i in suggested:
                expected[p, i] = 1
            elif not suggested and asked and area(address) and area(d) == area(address) and asked <= words(n, True):
                expected[p, i] = 4
    assert got == expected and set(expected.values()) == {1, 4}


def test_best_listings_match_all_scored_pairs(spark):
    """The winner without all pairs by name is the winner of all pairs, far ones, relocated ones and ties included."""
    from placeweave.operators.linkage import (
        best_candidate, best_listings, candidate_pairs, decisive_pairs, direct_pairs, is_decisive, needed_rows, place_evidence, score_rows, suggestions,
    )

    draw = random.Random(31)
    names = ["blue bolt diner", "blue bolt dinner", "the blue bolt diner", "old ring", "あおぞら亭銀座", "銀座 あおぞら亭", ""]
    towns = ["", "", "東京都中央区銀座", "東京都中央区銀座 block 1-2 tower", "東京都中央区銀座 block 3-2 tower", "京都府左京区 block 1-2 tower"]
    spots = [(None, None), (35.0, 139.0), (35.003, 139.0), (35.0075, 139.0), (35.3, 139.0)]
    phones = ["", "", "", "0311112222", "0333334444"]
    links = ["", "", "", *[f"https://tabelog.com/tokyo/A1301/A130101/{i}/" for i in range(1, 4)]]
    place = [(i, draw.choice(names), draw.choice(["", "", *names]), draw.choice(towns), draw.choice(phones), "", *draw.choice(spots),
              draw.choice(["place", ""]), draw.choice(links)) for i in range(120)]
    listing = [(i, draw.choice(names), draw.choice(towns), draw.choice(phones), draw.choice([*links, f"u{i}"]), *draw.choice(spots),
                draw.choice([None, 3.0]), draw.choice([0, 0, 5]), draw.random() < 0.4) for i in range(90)]
    places = place_keys(spark.createDataFrame(place, PLACE + ", listing_url string")).localCheckpoint()
    listings = listing_keys(spark.createDataFrame(listing, LISTING)).localCheckpoint()
    rows = needed_rows(places, listings)
    every = score_rows(rows)
    best = {r["place_id"]: (r["listing_id"], r["score"]) for r in best_candidate(every).collect()}
    found = {r["place_id"]: (r["listing_id"], r["score"]) for r in best_listings(places, listings).collect()}
    assert found == best and len(best) > 60

    # Evidence and stages against all pairs, grouped in plain Python.
    pairs = candidate_pairs(places, listings)
    assert pairs.count() == pairs.select("place_id", "listing_id").distinct().count()
    keyed = pairs.join(places, "place_id").join(listings, "listing_id")
    flags = {}
    for r in keyed.collect():
        same = r["place_phone"] != "" and r["place_phone"] == r["listing_phone"]
        known = None not in (r["place_lat"], r["listing_lat"])
        near = known and metres((r["place_lat"], r["place_lng"]), (r["listing_lat"], r["listing_lng"])) <= 500
        old = flags.get(r["place_id"], (False,) * 3)
        now = (same, same or near, r["rating"] is not None or r["review_count"] > 0)
        flags[r["place_id"]] = tuple(a or b for a, b in zip(old, now))
    evidence = place_evidence(places, listings, suggestions(places, listings)).collect()
    assert {r["place_id"]: (r["has_phone"], r["has_strong"], r["has_reviews"]) for r in evidence} == flags
    scored = score_pairs(keyed)
    decisive = {(r["place_id"], r["listing_id"]) for r in scored.filter(is_decisive(scored)).collect()}
    got = [(r["place_id"], r["listing_id"]) for r in decisive_pairs(places, listings).collect()]
    assert set(got) == decisive and len(got) == len(decisive) > 0
    linked = [(r["place_id"], r["listing_id"]) for r in direct_pairs(places, listings).collect()]
    assert sorted(linked) == sorted((r["place_id"], r["listing_id"]) for r in pairs.filter("stage = 0").collect())


def test_awards_by_name_and_point_match_all_pairs(spark):
    """Winners and close counts without copies of awards among the pairs equal those of all pairs; copies add no rows."""
    from pyspark.sql import Window, functions as F

    from placeweave.functions.geo import distance_m
    from placeweave.functions.text import fold_phone
    from placeweave.functions.urls import website_key
    from placeweave.operators.awards import _name_score, award_keys, choose_award, choose_of_rows, linkage_rows, probes

    draw = random.Random(7)
    names = ["blue bolt diner", "blue bolt dinner", "old ring", "あおぞら亭銀座", "zz", ""]
    spots = [(None, None), (35.0, 139.0), (35.0, 139.0), (35.0002, 139.0), (35.0006, 139.0), (35.003, 139.0), (35.2, None)]
    phones, sites = ["", "", "", "0311112222", "0333334444"], ["", "", "", "https://a.example.com/", "https://b.example.com/"]
    place = [(i, draw.choice(names), draw.choice(["", *names]), "", draw.choice(phones), draw.choice(sites), *draw.choice(spots), "") for i in range(300)]
    award = [(i, draw.choice(names), draw.choice(phones), draw.choice(sites), *draw.choice(spots)) for i in range(40)]
    detail = [(i, draw.choice(phones), draw.choice(sites)) for i in range(0, 40, 2)]
    probe = probes(spark.createDataFrame(place, PLACE)).localCheckpoint()
    details = spark.createDataFrame(detail, "award_id bigint, phone string, website string")

    def brute(keys, details):
        c = F.col
        pairs = probe.crossJoin(keys).withColumn("distance_m", distance_m(*map(c, ("place_lat", "place_lng", "award_lat", "award_lng"))))
        pairs = pairs.filter("distance_m is null or distance_m <= 500").withColumn("name_score", _name_score())
        if details is not None:
            asked = ((c("place_phone") != "") | (c("place_website") != "")) & (c("distance_m") <= 100) & (c("name_score") < 0.45) & c("dp").isNotNull()
            pairs = pairs.join(details.select("award_id", fold_phone(c("phone")).alias("dp"), website_key(c("website")).alias("dw")), "award_id", "left")
            turn = F.row_number().over(Window.partitionBy("place_id", asked).orderBy("award_id"))
            pairs = pairs.withColumn("used", F.coalesce(asked, F.lit(False)) & (turn <= 4))
            pairs = pairs.withColumn("award_phone", F.when(c("used"), c("dp")).otherwise(c("award_phone")))
            pairs = pairs.withColumn("award_website", F.when(c("used"), c("dw")).otherwise(c("award_website")))
        pairs = pairs.withColumn("same_phone", (c("place_phone") != "") & (c("place_phone") == c("award_phone")))
        pairs = pairs.withColumn("same_website", (c("place_website") != "") & (c("place_website") == c("award_website")))
        return pairs.withColumn("score", F.expr("""case when distance_m is null then name_score * 100 + if(same_phone or same_website, 85, 0)
            when same_phone or same_website then if(same_phone and same_website, 70, 65) + greatest(1 - distance_m / 500, 0D) * 30 + name_score * 5
            else name_score * 65 + greatest(1 - distance_m / 500, 0D) * 35 end""")).filter("""same_phone or same_website
            or case when distance_m is null then name_score >= 0.94 else name_score >= 0.45 or distance_m <= 25 end""").localCheckpoint()

    def close_of(rows, close):
        return {tuple(r) for r in rows.filter("distance_m is not null").groupBy("place_id").agg(
            F.count_if("same_website"), F.count_if("same_phone"), F.sum(close)).collect()}

    winners = set()
    for rows, given in ((award[::3], None), (award, details)):
        keys = award_keys(spark.createDataFrame(rows, AWARD)).localCheckpoint()
        every, found = brute(keys, given), linkage_rows(probe, keys, given).localCheckpoint()
        assert close_of(found, F.col("close")) == close_of(every, F.expr("if(distance_m <= 35, 1L, 0L)"))
        got = {str(r) for r in choose_of_rows(found).collect()}
        assert got == {str(r) for r in choose_award(every).collect()}
        winners |= got
    assert len(winners) > 20
    copies = award_keys(spark.createDataFrame([(i, "old ring", "", "", 35.0, 139.0) for i in range(50)], AWARD))
    one = probes(spark.createDataFrame([(1, "old ring", "", "", "", "", 35.0, 139.0, "")], PLACE))
    assert [(r["award_id"], r["close"]) for r in linkage_rows(one, copies).collect()] == [(0, 50)]


def test_identity_pairs_need_no_names(spark):
    """Pairs by phone or website, once each; equal names alone make none."""
    from placeweave.operators.awards import award_keys, identity_pairs, probes

    award = award_keys(spark.createDataFrame([(0, "old ring", "0311112222", "https://a.example.com/", None, None), (1, "old ring", "", "", None, None)], AWARD))
    place = probes(spark.createDataFrame([(1, "old ring", "", "", "0311112222", "https://a.example.com/", 35.0, 139.0, "")], PLACE))
    assert [(r["award_id"], r["same_phone"], r["same_website"]) for r in identity_pairs(place, award).collect()] == [(0, True, True)]


def test_last_stages_and_close_names_match_all_pairs(spark):
    """Pairs by cell and name are all alike pairs within the distance; stages follow from all candidates."""
    from placeweave.operators.linkage import alike_names, candidate_pairs, named_close, with_last_stage

    draw = random.Random(8)
    names = ["blue bolt diner", "blue bolt dinner", "the blue bolt diner", "old ring", ""]
    links = ["", "", "", "https://tabelog.com/tokyo/A1301/A130101/1/", "https://tabelog.com/tokyo/A1301/A130101/2/"]

    def point():
        return draw.choice([(None, None), (35 + draw.random() / 50, 139 + draw.random() / 50)])

    place = [(i, draw.choice(names), draw.choice(["", *names]), "", draw.choice(["", "", "0311112222"]), "", *point(), "", draw.choice(links)) for i in range(80)]
    listing = [(i, draw.choice(names), "", draw.choice(["", "0311112222"]), draw.choice([*links, f"u{i}"]), *point(),
                None, draw.choice([0, 0, 0, 5]), False) for i in range(30)]
    places = place_keys(spark.createDataFrame(place, PLACE + ", listing_url string")).localCheckpoint()
    listings = listing_keys(spark.createDataFrame(listing, LISTING)).localCheckpoint()
    known_places, known = {r["place_id"]: r for r in places.collect()}, {r["listing_id"]: r for r in listings.collect()}

    def apart(p, q):
        if p["place_lat"] is None or q["listing_lat"] is None:
            return 1e9
        return metres((p["place_lat"], p["place_lng"]), (q["listing_lat"], q["listing_lng"]))

    def named(p, q):
        return any(a and q["listing_name"] and alike(a, q["listing_name"]) >= 0.88 for a in (p["place_name"], p["place_alternate"]))

    names_of = alike_names(places, listings)
    close = [(r["place_id"], r["listing_id"]) for r in named_close(places, names_of, listings, 700.0).collect()]
    expected = {(i, j) for i, p in known_places.items() for j, q in known.items() if apart(p, q) <= 700 and named(p, q)}
    assert set(close) == expected and len(close) == len(expected) > 20

    stages = {}
    for r in candidate_pairs(places, listings).collect():
        stages.setdefault(r["place_id"], []).append((r["stage"], known[r["listing_id"]]))
    wanted = {}
    for i, p in known_places.items():
        by_name = [q for stage, q in stages.get(i, []) if stage == 1]
        same = any(p["place_phone"] and p["place_phone"] == q["listing_phone"] for q in by_name)
        near = any(apart(p, q) <= 500 for q in by_name) and any(q["review_count"] > 0 for q in by_name)
        wanted[i] = 0 if any(stage == 0 for stage, _ in stages.get(i, [])) else 1 if same or near else 9
    found = {r["place_id"]: r["last_stage"] for r in with_last_stage(places, listings, names_of).collect()}
    assert found == wanted and set(found.values()) == {0, 1, 9}


def test_every_detail_page_that_a_place_asks_for_is_used(spark):
    """The fifth and later pages count too, a page's phone replaces the row's, and a bound on lookups is an option."""
    place = spark.createDataFrame([(1, "Sushi Foo", "", "", "0311112222", "", 35.0, 139.0, ""), (2, "Sushi Bar", "", "", "0355556666", "", 35.2, 139.0, "")], PLACE)
    rows = [(i, "鮨ふう", "", "", 35.0 + i * 1e-5, 139.0) for i in range(1, 10)] + [(20, "蕎麦", "0355556666", "", 35.2, 139.0)]
    award = spark.createDataFrame(rows, AWARD)
    pages = [(i, "0311112222" if i == 9 else f"030000000{i}", "") for i in range(1, 10)]
    details = spark.createDataFrame(pages, "award_id bigint, phone string, website string")
    assert {r["place_id"]: r["award_id"] for r in link_awards(place, award, details=details).collect()} == {1: 9, 2: 20}
    assert [r["place_id"] for r in link_awards(place, award, details=details, lookups=4).collect()] == [2]
    other = details.unionByName(spark.createDataFrame([(20, "0399990000", "")], details.schema))
    assert [r["place_id"] for r in link_awards(place, award, details=other).collect()] == [1]


def test_award_winners_without_weak_pairs(spark):
    """Leaving out near pairs that cannot decide changes no winner: lone close rows, rows before them, equal phones."""
    from placeweave.operators.awards import award_keys, choose_of_rows, linkage_rows, probes

    draw = random.Random(17)
    names = ["blue bolt diner", "blue bolt dinner", "bolt blue", "old ring", "old ring brand 7", "zz", ""]

    def point():
        return draw.choice([35.0, 35.1, 35.2, 35.3]) + draw.random() / 400, 139.0 + draw.random() / 400

    place = [(i, draw.choice(names), draw.choice(["", *names]), "", draw.choice(["", "", "0311112222"]), "", *point(), "") for i in range(250)]
    award = [(i, draw.choice(names), draw.choice(["", "0311112222"]), "", *point()) for i in range(24)]
    probe = probes(spark.createDataFrame(place, PLACE)).localCheckpoint()
    keys = award_keys(spark.createDataFrame(award, AWARD)).localCheckpoint()
    rows = [{str(r) for r in choose_of_rows(linkage_rows(probe, keys, weak=weak)).collect()} for weak in (True, False)]
    assert rows[0] == rows[1] and len(rows[0]) > 50
