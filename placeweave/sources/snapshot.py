"""The versioned award snapshot: loading, preparing, reconciling and publishing."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placeweave import fixed
from placeweave.functions.text import text_or_empty
from placeweave.operators.awards import award_keys
from placeweave.session import cut_lineage
from placeweave.sources.versions import read_current, write_version

ROW = (
    "id:string,name:string,url:string,latitude:double,longitude:double,location:string,"
    "price:string,cuisine:string,distinction:string,distinction_label:string,"
    "green_star:boolean,phone:string,website:string,details_fetched_at:string,"
    "details_error:string"
)
DOCUMENT = (
    "source_url string, language string, scope string, fetched_at string, "
    "details_updated_at string, count bigint, details_error_count bigint, "
    f"restaurants array<struct<{ROW}>>"
)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON snapshot with its header columns; missing or broken files give no rows.

    One JSON document is read by one task; publish to Parquet once and read that afterwards.
    """
    reader = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "DROPMALFORMED")
    try:
        document = reader.json(path)
    except AnalysisException:
        document = spark.createDataFrame([], DOCUMENT)
    rows = document.select(
        F.coalesce("source_url", F.lit(fixed.GUIDE_LIST_URL)).alias("source_url"),
        "fetched_at", F.posexplode("restaurants").alias("award_id", "row"),
    )
    return rows.select(
        F.col("award_id").cast("bigint").alias("award_id"), "row.*", "source_url", "fetched_at"
    )


def prepare(snapshot: DataFrame) -> DataFrame:
    """The snapshot beside its comparable columns, to be written once."""
    return snapshot.join(award_keys(snapshot), "award_id")


def latest_rows(parsed: DataFrame) -> DataFrame:
    """Last parsed row per id, by page and position, folded in the map tasks."""
    row = F.struct(*[c for c in parsed.columns if c != "id"])
    return parsed.groupBy("id").agg(
        F.max_by(row, F.struct("page", "pos")).alias("row"),
        F.min(F.struct("page", "pos")).alias("first_seen"),
    ).select("id", "row.*", "first_seen")


def carry_details(
    current: DataFrame, previous: DataFrame, details: DataFrame, stamp: Column, refresh: bool = False
) -> DataFrame:
    """Details of each row: the earlier snapshot's unless refreshed, else newly read ones.

    ``details`` has (id, phone, website, error); rows that need details but have none there count
    as errors only when an error text is given.
    """
    old = previous.select(
        "id", F.col("phone").alias("old_phone"), F.col("website").alias("old_website"),
        F.col("details_fetched_at").alias("old_fetched"),
    )
    new = details.select(
        "id", F.col("phone").alias("new_phone"), F.col("website").alias("new_website"),
        F.col("error").alias("new_error"), F.lit(True).alias("read"),
    )
    joined = current.join(old, "id", "left").join(new, "id", "left")
    kept = F.lit(not refresh) & (text_or_empty(F.col("old_fetched")) != "")
    fresh = ~kept & F.coalesce(F.col("read"), F.lit(False)) & F.col("new_error").isNull()

    def pick(name):
        return F.when(kept, text_or_empty(F.col(f"old_{name}"))).when(fresh, F.col(f"new_{name}"))

    return joined.select(
        *current.columns,
        pick("phone").alias("phone"),
        pick("website").alias("website"),
        F.when(kept, F.col("old_fetched")).when(fresh, stamp).alias("details_fetched_at"),
        F.when(~kept, F.col("new_error")).alias("details_error"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Add award_id: the place of each row in order of first_seen, counted range by range."""
    dealt = cut_lineage(
        rows.repartitionByRange("first_seen").withColumn("range", F.spark_partition_id())
    )
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    # One row per range partition: few, whatever the snapshot holds.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("first_seen", "id"))
    return (
        dealt.join(offsets, "range").withColumn("award_id", (F.col("offset") + inside - 1).cast("bigint"))
        .drop("range", "offset")
    )


def reconcile(totals: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: the declared count beside the distinct ids, and whether they agree."""
    declared = totals.agg(
        F.coalesce(F.max_by("declared", -F.col("page")), F.lit(0)).alias("declared"),
        F.max("last_page").alias("last_page"),
    )
    counted = parsed.agg(F.count_distinct("id").alias("parsed"))
    return declared.crossJoin(counted).withColumn(
        "agrees", (F.col("declared") > 0) & (F.col("declared") == F.col("parsed"))
    )


def header(rows: DataFrame, fetched_at: Column, details_updated_at: Column) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(text_or_empty(F.col("details_error")) != "").alias("details_error_count"),
    ).select(
        F.lit(fixed.GUIDE_LIST_URL).alias("source_url"), F.lit(fixed.GUIDE_LANGUAGE).alias("language"),
        F.lit(fixed.GUIDE_SCOPE).alias("scope"), fetched_at.alias("fetched_at"),
        details_updated_at.alias("details_updated_at"), "count", "details_error_count",
    )


def publish(
    spark: SparkSession,
    cards: DataFrame,
    totals: DataFrame,
    path: str,
    snapshot_date: str,
    details: DataFrame | None = None,
    previous: DataFrame | None = None,
    refresh: bool = False,
) -> int:
    """Write one snapshot as a new version; refuse it when the declared count is not what was parsed.

    A repeated run makes the same rows with the same award_id current, so it can be retried. The rows
    carry their comparable columns and can be linked as they are.
    """
    cards = cut_lineage(cards)  # pages are parsed once for the count and the rows
    check = reconcile(totals, cards).first()
    if not check["agrees"]:
        raise ValueError(f"declared {check['declared']} rows, parsed {check['parsed']}")
    rows = latest_rows(cards)
    stamp = F.lit(snapshot_date)
    if details is not None:
        empty = "id string, phone string, website string, details_fetched_at string"
        rows = carry_details(
            rows, previous if previous is not None else spark.createDataFrame([], empty),
            details, stamp, refresh,
        )
    rows = rows.withColumn("source_url", F.lit(fixed.GUIDE_LIST_URL)).withColumn(
        "fetched_at", stamp
    )
    rows = prepare(numbered(rows)).drop("page", "pos").withColumn("snapshot_date", F.lit(snapshot_date))
    write_version(rows, path, snapshot_date)
    return check["parsed"]


def published(spark: SparkSession, path: str, snapshot_date: str | None = None) -> DataFrame:
    """The current version of a snapshot, or of all; a reader during a publish sees the one before."""
    return read_current(spark, path, *([snapshot_date] if snapshot_date else []))
