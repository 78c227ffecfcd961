"""Quality of documents from their own evidence and from that of their host and path, shrunk to global priors."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from placeweave.llm.native import fresh, let, read, words_of
from placeweave.llm.quality import base_counts
from placeweave.llm.store import stored

FEATURES = ["length", "symbols", "repeats", "lines", "word_length", "shouts", "capitals", "distinct"]
MOST_EVIDENCE = 8.0


def described(text: Column) -> Column:
    """Small bins of what a text looks like, one per feature; all 0 for a text without words."""

    def share(part, whole, steps=10):
        return F.least(F.floor(steps * part / F.greatest(whole, F.lit(1))), F.lit(2 * steps)).cast("int")

    def only(chars):
        return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))

    def bins(b, distinct):
        n = b["n_words"]
        return F.struct(
            F.floor(F.log2(n + 1)).cast("int").alias("length"), share(b["n_symbols"], n, 4).alias("symbols"),
            share(b["n_repeat_words"], n).alias("repeats"), F.least(b["n_dup_lines"], F.lit(5)).cast("int").alias("lines"),
            F.least(F.floor(b["word_chars"] / F.greatest(n, F.lit(1))), F.lit(20)).cast("int").alias("word_length"),
            share(only("!"), n).alias("shouts"), share(only("A-Z"), b["word_chars"]).alias("capitals"),
            share(distinct, n).alias("distinct"),
        )

    distinct = F.size(F.array_distinct(words_of(text)))
    return let(base_counts(text), lambda b: bins(b, distinct))


def log_odds(p):
    return F.log(p / (1 - p))


def held_out(key):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def shrunk(rows: DataFrame, keys: list[str], value: str, prior: Column, name: str) -> DataFrame:
    """Per group: n, total and the strength of its prior, for a beta prior of mean ``prior`` fitted to all groups.

    The strength comes from the moments of the group means: if they differ no more than single rows would,
    it is large and groups fall back on their prior. One strength serves all groups.
    """
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{name}_n"), F.sum(value).alias(f"{name}_total"), F.first(prior).alias(f"{name}_prior")
    )
    n, p = F.col(f"{name}_n"), F.col(f"{name}_prior")
    spread = F.pow(F.col(f"{name}_total") / n - p, 2)
    # E[spread] = p (1 - p) (1 / n + (1 - 1 / n) / (1 + strength)), summed over groups of two rows or more.
    found = groups.filter(n > 1).agg(
        F.sum(n * spread).alias("seen"), F.sum(p * (1 - p)).alias("alone"), F.sum((n - 1) * p * (1 - p)).alias("rest")
    ).first()
    share = ((found["seen"] or 0.0) - (found["alone"] or 0.0)) / (found["rest"] or 1.0)
    strength = min(max(1 / max(share, 1e-4) - 1, 1.0), 1e4)
    return groups.withColumn(f"{name}_strength", F.lit(strength))


def site_quality(
    docs: DataFrame, labels: DataFrame, key="doc_id", text="text", host="source", path="lang", label="quality",
    least: float = 0.5,
) -> DataFrame:
    """key, held_out, evidence, host_mean, path_mean, score and kept of every document.

    ``evidence`` is the naive Bayes log likelihood ratio of the document's bins, counted over the labelled
    documents (those whose crc32 of the key mod 5 is not 0). Every document then has a value: its label if it
    is one of these, else the probability that its evidence gives. Host posteriors are beta means of these values,
    shrunk to the global mean; path posteriors (path within host) are shrunk to their host; the strengths are
    fitted to the groups, and a document's own value is left out of both. ``score`` joins the path posterior
    and the evidence; ``kept`` is score >= ``least``.

    Null and empty texts have bins of their own like others. Null hosts and paths are groups. A host or path of one
    document has the posterior of its parent. Repeated rows count as often as they occur; labels repeated for a
    key count once, the larger label. Without labels all evidence is 0. Other columns are ignored.
    """
    fresh(docs, key, text, host, path)
    fresh(labels, key, label)
    rows = stored(
        docs.select(
            F.col(key).alias("key"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"),
            described(F.coalesce(F.col(text), F.lit(""))).alias("bins"),
        ), "described",
    )
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id"))
        .agg(F.max(label).cast("double").alias("label")).filter(~held_out("id"))
    )
    rows = stored(rows.join(known, F.col("key") == F.col("id"), "left").drop("id"), "labelled")
    each = rows.filter("label is not null").select(
        "label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"bins.{f}").alias("bin")) for f in FEATURES])).alias("b")
    )
    counts = each.groupBy("b.feature", "b.bin").agg(
        F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")
    ).collect()  # a few hundred bins
    good = sum(r["good"] for r in counts if r["feature"] == FEATURES[0]) + 1
    bad = sum(r["bad"] for r in counts if r["feature"] == FEATURES[0]) + 1
    mean = good / (good + bad)

    def ratio(feature):
        out = F.lit(0.0)
        for r in counts:
            if r["feature"] == feature:
                gain = F.log((r["good"] + F.lit(mean)) / good) - F.log((r["bad"] + F.lit(1 - mean)) / bad)
                out = F.when(F.col(f"bins.{feature}") == r["bin"], gain).otherwise(out)
        return out

    evidence = reduce(lambda a, b: a + b, map(ratio, FEATURES))
    evidence = F.greatest(F.lit(-MOST_EVIDENCE), F.least(F.lit(MOST_EVIDENCE), evidence))
    rows = rows.select("key", "host", "path", "label", evidence.alias("evidence"))
    own = 1 / (1 + F.exp(-(F.col("evidence") + log_odds(F.lit(mean)))))
    rows = stored(rows.withColumn("value", F.coalesce("label", own)), "valued")
    hosts = shrunk(rows, ["host"], "value", F.lit(mean), "host")
    host_mean = (F.col("host_total") + F.col("host_strength") * mean) / (F.col("host_n") + F.col("host_strength"))
    with_host = rows.join(
        hosts.select(F.col("host").alias("h"), "host_n", "host_total", "host_strength"), F.col("host").eqNullSafe(F.col("h")), "left"
    ).drop("h")
    paths = shrunk(with_host, ["host", "path"], "value", host_mean, "path")
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "path_n", "path_total", "path_strength")
    both = with_host.join(
        paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left"
    )

    def without_own(level, prior):
        strength = F.col(f"{level}_strength")
        return (F.col(f"{level}_total") - F.col("value") + strength * prior) / (F.col(f"{level}_n") - 1 + strength)

    both = both.withColumn("host_mean", without_own("host", F.lit(mean)))
    both = both.withColumn("path_mean", without_own("path", F.col("host_mean")))
    sure = F.least(F.greatest(F.col("path_mean"), F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(F.col("evidence") + log_odds(sure))))
    return both.select(
        F.col("key").alias(key), held_out("key").alias("held_out"), "evidence", "host_mean", "path_mean",
        score.alias("score"), (score >= least).alias("kept"),
    )


def run(spark, sf_dir):
    return site_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
