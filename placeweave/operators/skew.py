"""Joins and windows that stay balanced when one key holds a large share of the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A task of a split join meets at most about so many pairs of one key.
PAIRS_PER_BLOCK = 25_000_000


def block_counts(left_rows: Column, right_rows: Column, pairs: int) -> tuple[Column, Column]:
    """(left splits, right splits) so that a block of one key holds at most ``pairs`` pairs.

    A side smaller than the square root of ``pairs`` stays whole, which copies the fewest rows.
    """
    side = max(1, int(pairs**0.5))

    def splits(own, other):
        share = F.floor(F.lit(pairs) / F.least(other, F.lit(side)))
        return F.when(own <= side, 1).otherwise(F.ceil(own / share)).cast("int")

    small = left_rows * right_rows <= pairs
    return (
        F.when(small, 1).otherwise(splits(left_rows, right_rows)),
        F.when(small, 1).otherwise(splits(right_rows, left_rows)),
    )


def hot_keys(left: DataFrame, right: DataFrame, keys: list[str], pairs: int) -> DataFrame:
    """Every key with more than ``pairs`` pairs, and into how many splits each side goes.

    One count over both sides; counts are folded before they are shuffled.
    """
    sides = [df.select(*keys, F.lit(a).alias("l"), F.lit(1 - a).alias("r")) for df, a in ((left, 1), (right, 0))]
    counted = (
        sides[0].unionByName(sides[1]).groupBy(*keys)
        .agg(F.sum("l").cast("double").alias("l"), F.sum("r").cast("double").alias("r"))
        .filter(F.col("l") * F.col("r") > pairs)
    )
    left_splits, right_splits = block_counts(F.col("l"), F.col("r"), pairs)
    return counted.select(*keys, left_splits.alias("left_splits"), right_splits.alias("right_splits"))


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    pairs_per_block: int = PAIRS_PER_BLOCK,
    known_rows: str | None = None,
    even: bool = False,
) -> DataFrame:
    """Inner equi-join; a hot key becomes a grid of (left split, right split) blocks of bounded pairs.

    Every left row meets every right row of its key exactly once: it takes one left split
    and is copied to all right splits of that key, and the other way round. ``known_rows`` names a
    column on both sides that already bounds the rows of the key on either side; otherwise they are counted.
    The hot keys join like any table: Spark broadcasts them only if it finds them small; the sides are never
    broadcast. ``even`` keeps the
    number of tasks of ``spread``, for pairs that make much work out of few bytes.
    """
    left_columns = left.columns
    right_columns = [c for c in right.columns if c != known_rows]
    left = left.dropna(subset=keys)
    right = right.dropna(subset=keys)
    if known_rows is None:
        hot = hot_keys(left, right, keys, pairs_per_block)
        left = left.join(hot, keys, "left")
        right = right.join(hot, keys, "left")
    else:
        rows = F.col(known_rows).cast("double")
        for name, splits in zip(("left_splits", "right_splits"), block_counts(rows, rows, pairs_per_block)):
            left = left.withColumn(name, splits)
            right = right.withColumn(name, splits)
        right = right.drop(known_rows)

    def own(name, columns):
        # Hashing the row, not drawing a number, gives a recomputed task the same split again.
        count = F.coalesce(F.col(name), F.lit(1))
        return F.when(count == 1, 0).otherwise(F.pmod(F.xxhash64(*columns), count).cast("int"))

    def every(name):
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(name), F.lit(1)) - 1))

    left = left.withColumn("left_split", own("left_splits", left_columns)).withColumn(
        "right_split", every("right_splits")
    )
    right = right.withColumn("right_split", own("right_splits", right_columns)).withColumn(
        "left_split", every("left_splits")
    )
    blocks = keys + ["left_split", "right_split"]
    dropped = ["left_splits", "right_splits"]
    left, right = left.drop(*dropped), right.drop(*dropped)
    if even:
        left, right = spread(left, *blocks), spread(right, *blocks)
    return grown_join(left, right, blocks).drop("left_split", "right_split")


def grown_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that both grow with the data; neither is collected in the driver.

    Spark guesses sizes from compressed files, so a table of a million rows may look small enough to broadcast.
    """
    return left.join(right.hint("merge"), on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all tasks: a small file is one partition, however much work each of its rows makes."""
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def following(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """The next row's ``value`` per key in ``order``, computed bucket by bucket.

    A bucket is a stretch of the order, so one busy key is spread over its buckets; only one
    summary row per bucket is ordered per key.
    """
    df = df.withColumn("bucket", bucket)
    by_bucket = Window.partitionBy(*keys, "bucket").orderBy(*order)
    first = F.min(F.struct(*order, F.col(value).alias("first_value")))["first_value"]
    heads = df.groupBy(*keys, "bucket").agg(first.alias("head"))
    heads = heads.withColumn(
        "next_head", F.lead("head").over(Window.partitionBy(*keys).orderBy("bucket"))
    ).drop("head")
    inside = df.withColumn("inside", F.lead(value).over(by_bucket))
    return (
        inside.join(heads, keys + ["bucket"])
        .withColumn(out, F.coalesce("inside", "next_head"))
        .drop("bucket", "inside", "next_head")
    )


def running_max(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, step: int,
    out: str,
) -> DataFrame:
    """Over rows numbered i = 1, 2, … per key: the maximum of ``value_j - j * step`` plus i * step.

    Buckets are numbered and folded on their own; only one summary row per bucket is ordered per
    key, so a busy key is spread over its buckets.
    """
    df = df.withColumn("bucket", bucket).withColumn("amount", value)
    step = F.lit(step).cast("bigint")
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("turn", F.row_number().over(inside)).withColumn(
        "inside", F.max(F.col("amount") - F.col("turn") * step).over(so_far)
    )
    sums = local.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.max("inside").alias("most")
    )
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("skipped", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    sums = sums.withColumn("earlier", F.max(F.col("most") - F.col("skipped") * step).over(before))
    best = F.greatest(F.col("earlier"), F.col("inside") - F.col("skipped") * step)
    number = F.col("skipped") + F.col("turn")
    return (
        local.join(sums.select(*keys, "bucket", "skipped", "earlier"), keys + ["bucket"])
        .withColumn(out, best + number * step)
        .drop("bucket", "amount", "turn", "inside", "skipped", "earlier")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
