"""Column helpers shared by the operators that stay inside Spark expressions."""

from pyspark.sql import Column, DataFrame, functions as F

SPACES = "[\\x20\\x09-\\x0D]+"


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *wanted: str) -> str:
    """Tell early that a column is missing, so that no plan fails halfway."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def words_of(text: Column) -> Column:
    """Runs of anything but the six ASCII white-space characters, in order."""
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def running_sums(values: Column) -> Column:
    """Running sums of an int array: sums per block first, then inside each block.

    Blocks of about the square root of the length keep the copying of an appended array at the power 1.5.
    """
    none = F.array().cast("array<int>")

    def sums(v, start):
        return F.aggregate(
            v,
            F.struct(start.alias("total"), none.alias("out")),
            lambda a, x: F.struct(
                (a["total"] + x).alias("total"),
                F.concat(a["out"], F.array(a["total"] + x)).alias("out"),
            ),
        )["out"]

    def blocks(v, size):
        starts = F.transform(
            F.sequence(F.lit(0), ((F.size(v) - 1) / size).cast("int")), lambda b: b * size + 1
        )
        totals = F.transform(
            starts,
            lambda s: F.aggregate(F.slice(v, s, size), F.lit(0), lambda a, x: a + x),
        )
        before = F.concat(F.array(F.lit(0)), sums(totals, F.lit(0)))
        return F.flatten(
            F.zip_with(
                starts, F.slice(before, 1, F.size(starts)),
                lambda s, b: sums(F.slice(v, s, size), b),
            )
        )

    def split(v):
        return let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda size: blocks(v, size))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(split(v)))


def spans(text: Column, pattern: str, guard: Column | None = None, group: int | None = None) -> Column:
    """All leftmost non-overlapping matches: array of (start, stop, hit, part), in code points.

    The text between matches and the matches themselves alternate, so positions are running sums of
    their lengths. ``part`` is the given group. ``guard`` is a cheap test that holds wherever the
    pattern matches.
    """
    kind = "array<struct<start:int,stop:int,hit:string,part:string>>"
    found = F.struct(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0)).alias("parts"),
    )

    def placed(x):
        steps = F.zip_with(
            F.slice(x["between"], 1, F.size(x["hits"])), x["hits"],
            lambda b, h: (F.length(b) + F.length(h)).cast("int"),
        )
        return F.zip_with(
            running_sums(steps),
            F.arrays_zip(x["hits"].alias("hit"), x["parts"].alias("part")),
            lambda stop, h: F.struct(
                (stop - F.length(h["hit"])).alias("start"), stop.alias("stop"),
                h["hit"].alias("hit"), h["part"].alias("part"),
            ),
        )

    some = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(some, let(found, placed)).otherwise(F.array().cast(kind)).cast(kind)


def joined(array: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.concat_ws(
        ",",
        F.transform(
            array,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")),
        ),
    )
