"""Tables in whole versions: each is written to a folder of its own, then one small pointer makes it current.

A reader looks the pointer up once and reads that folder, so it sees the version before or the one after, never
a mixture. A write that fails leaves its folder without a pointer, and the old version stays. Nothing is overwritten.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from placeweave.operators.records import keep_newest

POINTER = "name string, number bigint, folder string"


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """name, number and folder of every version; empty if nothing has been written."""
    try:
        return spark.read.schema(POINTER).json(f"{path}/pointers").filter("folder is not null")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], POINTER)


def current_pointers(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each name; of two that were written at once, the one with the larger folder name."""
    newest = F.max_by("folder", F.struct("number", "folder")).alias("folder")
    return pointers(spark, path).groupBy("name").agg(newest, F.max("number").alias("number"))


def write_version(df: DataFrame, path: str, name: str) -> str:
    """Write ``df`` as the current version of ``name`` and return its folder.

    The pointer is one row in one file, which Spark commits whole once the data lie complete in their folder.
    """
    spark = df.sparkSession
    folder = f"{path}/data/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    last = pointers(spark, path).filter(F.col("name") == name).agg(F.max("number")).first()[0]
    row = spark.createDataFrame([(name, (last or 0) + 1, folder)], POINTER)
    row.coalesce(1).write.mode("append").json(f"{path}/pointers")
    return folder


def read_current(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The current versions, of the given names or of all, as one table."""
    found = current_pointers(spark, path)
    if names:
        found = found.filter(F.col("name").isin(*names))
    folders = [r["folder"] for r in found.orderBy("name").collect()]  # one for each name, such as a day
    if not folders:
        raise ValueError(f"no version of {', '.join(names) or 'anything'} in {path}")
    return spark.read.option("mergeSchema", "true").parquet(*folders)


def compact(spark: SparkSession, path: str, name: str, store: list[str], saved_at: str, top: int, oldest=None) -> str:
    """A new version with the newest ``top`` entries of each store; readers of the old one are not disturbed."""
    return write_version(keep_newest(read_current(spark, path, name), store, saved_at, top, oldest), path, name)
