"""As-of lookups, chains of misses and per-request answers against plain loops."""

import datetime as dt
import random

import pytest

from placeweave.operators.asof import as_of, chains
from placeweave.streaming.freshness import mark_fresh, stale_first_at

START = dt.datetime(2024, 5, 1)


def rows_with_a_busy_key(draw, n):
    """A third of the rows have one key, which is never silent for long."""
    return [("busy" if i % 3 == 0 else draw.choice(["a", "b", "c", None]), draw.choice([None, *range(2 * n)]) if i % 17 == 0 else draw.randrange(2 * n))
            for i in range(n)]


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_meets_what_a_loop_finds(spark, forward):
    draw = random.Random(4)
    left = [(i, k, t) for i, (k, t) in enumerate(rows_with_a_busy_key(draw, 200))]
    right = [(k, t, draw.randrange(5)) for k, t in rows_with_a_busy_key(draw, 150)]
    found = as_of(
        spark.createDataFrame(left, "id int, k string, t bigint"), spark.createDataFrame(right, "k string, s bigint, v int"),
        ["k"], "t", "s", ["s", "v"], forward=forward)
    got = {r["id"]: r["found"] and tuple(r["found"]) for r in found.collect()}
    for i, k, t in left:
        own = [(s, v) for key, s, v in right if None not in (k, t, s) and key == k and (s > t if forward else s <= t)]
        assert got[i] == ((min(own) if forward else max(own)) if own else None)


def test_as_of_without_rows(spark):
    none = spark.createDataFrame([], "k string, s bigint, v int")
    one = spark.createDataFrame([("a", 1)], "k string, t bigint")
    assert as_of(one, none, ["k"], "t", "s", ["v"]).collect()[0]["found"] is None
    assert as_of(one.limit(0), none, ["k"], "t", "s", ["v"]).count() == 0


def test_chains_take_logarithmic_rounds(spark, monkeypatch):
    from placeweave.operators import asof

    stored, plain = [], asof.cut_lineage
    monkeypatch.setattr(asof, "cut_lineage", lambda df: stored.append(1) or plain(df))
    n = 300
    pointers = spark.range(n).selectExpr("'k' as k", "id as at", "id + 1 as next").filter(f"next < {n} and at % 100 <> 99")
    starts = spark.createDataFrame([("k", 0), ("k", 200)], "k string, at bigint")
    found = sorted(r["at"] for r in chains(starts, pointers, ["k"]).collect())
    assert found == [*range(100), *range(200, 300)]
    assert len(stored) <= 2 + 2 * 8


def plain_hits(rows, ttl):
    created, out = {}, {}
    for key, at, i in sorted((k, t, i) for i, k, t in rows if k is not None and t is not None):
        out[i] = key in created and at - created[key] <= ttl
        if not out[i]:
            created[key] = at
    return out


def test_fresh_marks_of_a_key_that_is_never_silent(spark):
    draw = random.Random(5)
    times = [draw.choice([draw.randrange(4000), draw.randrange(40) * 60]) for _ in range(300)]
    rows = [(i, "busy" if i % 3 else draw.choice(["a", "b", None]), None if i % 50 == 7 else t) for i, t in enumerate(times)]
    stamped = [(i, k, None if t is None else START + dt.timedelta(seconds=t)) for i, k, t in rows]
    events = spark.createDataFrame(stamped, "event_id int, k string, ts timestamp")
    for ttl in (60, 0):
        got = {r["event_id"]: r["hit"] for r in mark_fresh(events, "k", ttl).collect()}
        expected = {i: False for i, _, _ in rows} | plain_hits(rows, ttl)
        assert got == expected


def test_answers_as_of_each_request(spark):
    at = [START + dt.timedelta(seconds=s) for s in range(100)]
    store = spark.createDataFrame([("a", at[10], "x"), ("a", at[10], "y"), ("a", at[50], "z"), (None, at[0], "n")], "k string, created_at timestamp, value string")
    asked = spark.createDataFrame([(1, "a", at[9]), (2, "a", at[10]), (3, "a", at[40]), (4, "a", at[41]), (5, "a", at[99]), (6, "b", at[20]), (7, None, at[1])], "id int, k string, asked_at timestamp")
    got = {r["id"]: r["value"] for r in stale_first_at(asked, store, "k", 30).collect()}
    assert got == {1: None, 2: "y", 3: "y", 4: None, 5: None, 6: None, 7: None}
