"""Award linkage of a request stream against the static snapshot."""

from pyspark.sql import DataFrame, SparkSession

from placeweave.operators.awards import award_keys, first_with_margin, strict_pairs
from placeweave.operators.linkage import place_keys
from placeweave.operators.validate import accepted, check_places, drop_overseas
from placeweave.session import cut_lineage
from placeweave.sources.requests import read_requests, unpack

LINKS = "place_id bigint, award_id bigint, score double, name_score double, distance_m double, batch bigint"


def link_requests(bodies: DataFrame, prepared_snapshot: DataFrame) -> DataFrame:
    """One micro-batch: request bodies of (place_id, body) to unambiguous awards, by the strict rule of list cards."""
    places = accepted(check_places(unpack(read_requests(bodies), "place_id")))
    keys = cut_lineage(place_keys(drop_overseas(places)))
    return first_with_margin(strict_pairs(keys, prepared_snapshot), 85.0, 3.0)


def write_batch(linked: DataFrame, path: str, batch_number: int) -> None:
    """Replace the folder of this batch, so that a batch that runs twice leaves its rows once."""
    linked.select("place_id", "award_id", "score", "name_score", "distance_m").write.mode("overwrite").parquet(f"{path}/batch={batch_number}")


def link_stream(bodies: DataFrame, snapshot: DataFrame, path: str, checkpoint: str):
    """Writer of the stream of links: start it with the trigger you want.

    The checkpoint remembers which files were read; after a restart the batch that was not committed runs again under its
    old number and replaces its own output.
    """
    keys = cut_lineage(award_keys(snapshot))

    def write(batch, batch_number):
        write_batch(link_requests(batch, keys), path, batch_number)

    return bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def linked(spark: SparkSession, path: str) -> DataFrame:
    """What the stream has written so far, with the number of the batch."""
    return spark.read.schema(LINKS).parquet(path)
