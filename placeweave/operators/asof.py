"""As-of lookups that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame, Window, functions as F

from placeweave.operators.skew import union_all
from placeweave.session import cut_lineage


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str],
    forward: bool = False, out: str = "found",
) -> DataFrame:
    """``left`` with a struct of ``columns`` of one row of ``right`` with equal keys, null if there is none.

    Backward: the newest row not later than ``left_time``; of equally new ones the one with the largest columns.
    Forward: the first row later than ``left_time``; of equally early ones the one with the least columns.

    Both sides go through one range partition by keys and time, so a busy key falls into as many ranges as it has
    rows for. Inside a range one running window looks back; of each range only its last row on the right
    side (its first, forward) is passed on to the next ranges of its key. The ranges come from a sample and are
    stored, so a task that runs again sees the same ones. Rows of ``left`` with a null key or time find nothing.
    """
    kept = F.struct(*columns)
    own = F.struct(*left.columns)
    sides = [
        right.select(*keys, F.col(right_time).alias("at"), F.lit(0).alias("side"), kept.alias("found_row")).dropna(subset=[*keys, "at"]),
        left.select(*keys, F.col(left_time).alias("at"), F.lit(1).alias("side"), own.alias("own_row")),
    ]
    sides = [
        sides[0].withColumn("own_row", F.lit(None).cast(sides[1].schema["own_row"].dataType)),
        sides[1].withColumn("found_row", F.lit(None).cast(sides[0].schema["found_row"].dataType)),
    ]
    both = union_all(sides)
    ranged = cut_lineage(both.repartitionByRange(*keys, "at").withColumn("range_bucket", F.spark_partition_id()))
    # At equal times a row of the right side counts for backward lookups only, so it is passed first or last.
    if forward:
        order = [F.col("at").desc(), F.col("side").desc(), F.col("found_row").desc()]
        edge, buckets = F.min(F.struct("at", "found_row")), F.col("range_bucket").desc()
    else:
        order = [F.col("at").asc(), F.col("side").asc(), F.col("found_row").asc()]
        edge, buckets = F.max(F.struct("at", "found_row")), F.col("range_bucket").asc()
    so_far = Window.partitionBy(*keys, "range_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    edges = ranged.filter("side = 0").groupBy(*keys, "range_bucket").agg(edge["found_row"].alias("edge"))
    edges = ranged.select(*keys, "range_bucket").dropna(subset=keys).distinct().join(edges, [*keys, "range_bucket"], "left")
    before = Window.partitionBy(*keys).orderBy(buckets).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("carried", F.last("edge", ignorenulls=True).over(before)).drop("edge")
    seen = ranged.withColumn("seen", F.last("found_row", ignorenulls=True).over(so_far)).filter("side = 1")
    timed = F.col("at").isNotNull()
    return seen.join(edges, [*keys, "range_bucket"], "left").select(
        "own_row.*", F.when(timed, F.coalesce("seen", "carried")).alias(out)
    )


def chains(starts: DataFrame, pointers: DataFrame, keys: list[str]) -> DataFrame:
    """All nodes (keys, at) that the pointers (keys, at, next) reach from the starts (keys, at), the starts included.

    Pointer doubling: each round joins the nodes found so far with pointers that jump twice as far, so the rounds
    grow with the logarithm of the longest chain. Joins are on key and time, so the nodes of one key are spread.
    No two starts may reach the same node.
    """
    found, jumps = cut_lineage(starts), cut_lineage(pointers)
    while not jumps.isEmpty():
        reached = found.join(jumps, [*keys, "at"]).select(*keys, F.col("next").alias("at"))
        second = jumps.select(*keys, F.col("at").alias("next"), F.col("next").alias("second"))
        longer = jumps.join(second, [*keys, "next"]).select(*keys, "at", F.col("second").alias("next"))
        found, jumps = cut_lineage(found.unionByName(reached)), cut_lineage(longer)
    return found
