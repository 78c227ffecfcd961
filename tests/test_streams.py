"""Streams that start, stop, fail and start again, against the batch rules."""

import datetime as dt
import random
import tempfile

import pytest

from placeweave.operators.awards import link_awards_strict
from placeweave.streaming import linkage
from placeweave.streaming.freshness import debounce_stream, fresh_stream, mark_fresh
from placeweave.streaming.windows import debounce

START = dt.datetime(2024, 5, 1)
SCHEMA = "event_id bigint, user_id bigint, ts timestamp"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def run(spark, rule, files):
    """(rows, state rows left) of a stream over files that come one by one, stopped and started again in between."""
    place, got, left = folder(), [], None
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{place}/in/part={i}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{place}/in")
        if i % 2 or i == len(files) - 1:
            query = (rule(stream).writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(df.collect()))
                     .option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start())
            assert query.awaitTermination(120)
            left = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else left
    return got, left


@pytest.mark.parametrize("rule", ["fresh", "debounce"])
def test_unordered_and_late_events(spark, rule):
    """Events come up to nine minutes out of order; one comes hours late and is dropped."""
    draw = random.Random(8)
    at = sorted(draw.randrange(4 * 3600) for _ in range(120))
    rows = [(i, i % 3, START + dt.timedelta(seconds=t)) for i, t in enumerate(at)]
    by_arrival = sorted(rows, key=lambda r: r[2].timestamp() + draw.randrange(540))
    late = (900, 1, START + dt.timedelta(seconds=1))
    files = [by_arrival[:60], by_arrival[60:], [late]]
    files.append([(-1, 50, START + dt.timedelta(days=20))])
    files.append([(-2, 51, START + dt.timedelta(days=40))])
    table = spark.createDataFrame(rows, SCHEMA)
    if rule == "fresh":
        expected = {(r["event_id"], r["hit"]) for r in mark_fresh(table, "user_id", 900).collect()}
        got, left = run(spark, lambda s: fresh_stream(s, "user_id", 900), files)
        got = [(r["event_id"], r["hit"]) for r in got if r["event_id"] >= 0]
    else:
        expected = {r["event_id"] for r in debounce(table, ["user_id"], 60_000).collect()}
        got, left = run(spark, lambda s: debounce_stream(s, "user_id", 60_000, "10 minutes"), files)
        got = [r["event_id"] for r in got if r["event_id"] >= 0]
    assert len(got) == len(set(got)) and set(got) == expected
    assert left is None or left <= 6  # timers have removed the state of all keys but the last


def test_link_stream_survives_a_batch_written_twice(spark, monkeypatch):
    award = spark.createDataFrame(
        [(i, f"店{chr(0x4e00 + 37 * i)}亭", "", "", 35.0 + i / 100, 139.0) for i in range(12)],
        "award_id bigint, name string, phone string, website string, latitude double, longitude double")
    place = award.selectExpr("award_id as place_id", "name", "latitude", "longitude").filter("place_id <> 4")
    bodies = place.selectExpr("place_id", "to_json(struct(name, string(latitude) as latitude, string(longitude) as longitude)) as body")
    here, written, plain = folder(), [], linkage.write_batch

    def failing(linked, path, number):
        plain(linked, path, number)
        written.append(number)
        if number == 1 and written.count(1) == 1:
            raise RuntimeError("lost after the batch was written, before it was committed")

    monkeypatch.setattr(linkage, "write_batch", failing)

    def started():
        stream = spark.readStream.schema(bodies.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{here}/in")
        return linkage.link_stream(stream, award, f"{here}/out", f"{here}/state").trigger(availableNow=True).start()

    for i in range(2):
        bodies.filter(f"place_id % 3 = {i}").coalesce(1).write.parquet(f"{here}/in/part={i}")
    with pytest.raises(Exception):
        started().awaitTermination(300)
    bodies.filter("place_id % 3 = 2").coalesce(1).write.parquet(f"{here}/in/part=2")
    assert started().awaitTermination(300)
    assert written == [0, 1, 1, 2]
    got = sorted((r["place_id"], r["award_id"]) for r in linkage.linked(spark, f"{here}/out").collect())
    expected = sorted((r["place_id"], r["award_id"]) for r in link_awards_strict(place, award).collect())
    assert got == expected and len(got) == 11
