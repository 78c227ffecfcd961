"""Quality rules from the frequency of lines across the documents of a host."""

from pyspark.sql import Column, DataFrame, functions as F

from placeweave.llm.native import SPACES, fresh, let, read, words_of

WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Words in windows of five words that are found twice or more in the text, the first included.

    Windows are compared by a 64-bit hash. Sorting (hash, place) brings equal windows together; the
    union of the marked windows is the sum of the gaps between their places, five at most each.
    """

    def windows(w):
        last = F.size(w) - WINDOW
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)])
        )

    def covered(h):
        pairs = F.sort_array(
            F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))
        )

        def marked(p):
            def same(x, i):
                return F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))

            twice = F.transform(
                p, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["at"])
            )
            return F.sort_array(F.filter(twice, lambda at: at.isNotNull()))

        def union(at):
            return F.aggregate(
                F.transform(
                    at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))
                ),
                F.lit(0).cast("bigint"),
                lambda a, x: a + x,
            )

        return let(let(pairs, marked), union)

    def count(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h))

    return let(
        words,
        lambda w: F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(let(windows(w), count)),
    )


def base_counts(text: Column) -> Column:
    """Word, symbol and repetition counts of one text, and whether they fail the base rule."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def counts(words):
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.regexp_replace(text, SPACES, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias(
                "n_dup_lines"
            ),
            repeated_words(words).alias("n_repeat_words"),
        )

    return let(words_of(text), counts)


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, one space between words: what counts as the same line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACES, " "))


def lines_of(text: Column) -> Column:
    """(hash, number of words) of every line that has a word."""
    return F.filter(
        F.transform(
            F.split(text, "\n", -1),
            lambda x: let(
                normal_line(x),
                lambda n: F.struct(
                    F.xxhash64(n).alias("line"),
                    (F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1).alias("words"),
                    (n != "").alias("some"),
                ),
            ),
        ),
        lambda x: x["some"],
    )


def line_documents(docs: DataFrame, key="doc_id", text="text", host="source") -> DataFrame:
    """Per host and line hash: in how many distinct documents the line stands (host, line, documents).

    A null host is a host of its own; a null key counts as one document.
    """
    fresh(docs, key, text, host)
    rows = docs.select(
        F.col(host).alias("host"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"),
        F.explode(F.array_distinct(F.transform(lines_of(F.col(text)), lambda x: x["line"]))).alias("line"),
    )
    return rows.groupBy("host", "line").agg(F.count_distinct("doc").alias("documents"))


def quality(
    docs: DataFrame, key="doc_id", text="text", host="source",
    most_documents: int = 25, least_left: float = 0.5, least_words: int = 10,
) -> DataFrame:
    """Judge every document by its base counts and by what is left without lines common on its host.

    A line that stands in more than ``most_documents`` distinct documents of one host is removed from
    the documents of that host. A document is rejected if less than ``least_left`` of its words or
    fewer than ``least_words`` words remain. Adds n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_common_words, n_left_words and kept to the key column.

    Null and empty texts have no words and fail. Every input row gives one output row; rows repeated
    under one key count as one document. A null host is a host of its own. Other columns are ignored.
    """
    fresh(docs, key, text, host)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        F.col(host).alias("host"), base_counts(whole).alias("base"), lines_of(whole).alias("lines"),
    )
    per_line = rows.select(
        "row", "key", "host", "base", F.explode_outer("lines").alias("line")
    ).select("row", "key", "host", "base", F.col("line.line").alias("line"), F.col("line.words").alias("words"))
    common = line_documents(docs, key, text, host).filter(F.col("documents") > most_documents)
    # A document without a line gets a key of its own, else all of them would meet in one task.
    common = common.select(
        F.col("host").alias("common_host"), F.col("line").alias("common_line"), F.lit(True).alias("common")
    )
    met = per_line.withColumn("line_key", F.coalesce("line", F.xxhash64("row"))).join(
        common,
        (F.col("line_key") == F.col("common_line")) & F.col("host").eqNullSafe(F.col("common_host")),
        "left",
    )
    lost = F.when(F.col("common") & F.col("line").isNotNull(), F.col("words")).otherwise(0)
    judged = met.groupBy("row").agg(
        F.first("key").alias(key), F.first("base").alias("base"),
        F.sum(lost).cast("bigint").alias("n_common_words"),
    )
    n = F.col("base.n_words")
    failed = (n < 10) | (100 * F.col("base.n_repeat_words") > 20 * n)
    left = n - F.col("n_common_words")
    return judged.select(
        key, "base.*", failed.alias("base_failed"), "n_common_words", left.alias("n_left_words"),
        (~failed & (left >= least_words) & (left >= least_left * n)).alias("kept"),
    )


def without_common_lines(
    docs: DataFrame, key="doc_id", text="text", host="source", most_documents: int = 25
) -> DataFrame:
    """The documents with lines above the limit cut out of ``text``; other columns as they were."""
    fresh(docs, key, text, host)
    common = line_documents(docs, key, text, host).filter(F.col("documents") > most_documents)
    common = common.select(F.col("host").alias("h"), F.col("line").alias("l"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(host).alias("host"), F.struct("*").alias("all"),
        F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("lines"),
    )
    # One row per line; what else the document has travels with its first line.
    lines = rows.select("row", "host", "all", F.posexplode("lines").alias("at", "line")).select(
        "row", "host", "at", "line", F.when(F.col("at") == 0, F.col("all")).alias("all"),
        F.xxhash64(normal_line(F.col("line"))).alias("hash"),
    )
    met = lines.join(common.withColumn("common", F.lit(True)), (F.col("hash") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")), "left")
    line = F.when(F.col("common").isNull() | (F.trim("line") == ""), F.struct("at", "line"))
    back = met.groupBy("row").agg(
        F.first("all", ignorenulls=True).alias("all"), F.sort_array(F.collect_list(line)).alias("kept")
    )
    left = F.array_join(F.transform("kept", lambda x: x["line"]), "\n")
    new = F.when(F.col("all")[text].isNotNull(), left)
    return back.select(*[new.alias(c) if c == text else F.col("all")[c].alias(c) for c in docs.columns])


def run(spark, sf_dir):
    return quality(read(spark, sf_dir, "documents"))
