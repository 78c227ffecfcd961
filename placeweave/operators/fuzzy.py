"""Join of similar texts without comparing all pairs.

With ratio at least t and total length s, the texts share at least (1.5 t - 1) s - 1 bigrams: the
matched characters lie in blocks, and there are no more blocks than unmatched characters plus one.
When one text holds the other, all bigrams of the shorter occur in the longer. So, with bigrams put
in one global order from rare to frequent, two similar texts already meet in a short rare prefix.
Frequent bigrams are hardly ever joined on.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from placeweave import fixed
from placeweave.functions.text import contained, likeness
from placeweave.operators.skew import split_join, union_all
from placeweave.session import cut_lineage


def _tokens(texts: DataFrame, group: list[str], longest: float) -> DataFrame:
    """One row per token of a text, numbered when it repeats.

    Tokens are the bigrams; texts of at most ``longest`` characters also give single characters,
    because a text of one character can only lie inside them.
    """
    size = F.length("text")
    none = F.array().cast("array<string>")
    pairs = F.when(
        size >= 2,
        F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(F.col("text"), i, 2)),
    ).otherwise(none)
    letters = F.when(
        size <= (longest if longest != math.inf else (1 << 30)),
        F.array_distinct(F.split("text", "")),
    ).otherwise(none)

    def numbered(tokens):
        def entry(token, i):
            before = F.slice(tokens, 1, i)
            copies = F.size(F.filter(before, lambda other: other == token))
            return F.struct(token.alias("token"), copies.alias("copy"))

        return F.transform(tokens, entry)

    tokens = F.concat(
        numbered(pairs),
        F.transform(letters, lambda ch: F.struct(ch.alias("token"), F.lit(0).alias("copy"))),
    )
    return texts.select(*group, "text", F.explode(tokens).alias("t")).select(*group, "text", "t.*")


def at_least_alike(left: Column, right: Column, threshold: float) -> tuple[Column, Column]:
    """(whether two texts may be that much alike, whether they are); Python sees only those that may be.

    A ratio of t leaves at most (1 - t) s characters unmatched, and so many edits turn one text into the other.
    """
    most = F.floor((1 - threshold) * (F.length(left) + F.length(right)) + 1e-9).cast("int")
    may_be = (left != "") & (right != "") & (contained(left, right) | (F.call_function("levenshtein", left, right, most) >= 0))
    may_be = F.coalesce(may_be, F.lit(False))
    return may_be, likeness(F.when(may_be, left), right, at_least=threshold) >= threshold


def letters(name: str) -> Column:
    """The characters of a text, each with the number of equal ones before it."""
    parts = F.split(F.col(name), "")
    return F.transform(parts, lambda ch, i: F.concat(ch, F.size(F.filter(F.slice(parts, 1, i), lambda x: x == ch)).cast("string")))


def may_be_alike(left: str, right: str, left_letters: str, right_letters: str, threshold: float) -> Column:
    """Whether the likeness of two texts may reach ``threshold``, from their edits and ``letters``, without Python.

    A ratio of t leaves at most (1 - t) s characters unmatched, so many edits suffice, and the others occur in both.
    """
    total = F.length(left) + F.length(right)
    edits = f"levenshtein({left}, {right}, cast(floor({1 - threshold} * (length({left}) + length({right})) + 1e-9) as int)) >= 0"
    shared = 2.0 * F.size(F.array_intersect(left_letters, right_letters)) >= threshold * total - 1e-9
    return contained(F.col(left), F.col(right)) | (F.expr(edits) & shared)


def similar_texts(
    left: DataFrame, right: DataFrame, threshold: float, group: list[str] | None = None
) -> DataFrame:
    """(group…, left_text, right_text, likeness) for all pairs with likeness >= threshold.

    ``left`` and ``right`` hold a column ``text`` and the group columns; copies are collapsed first.
    Thresholds from 0.88 up are supported; the argument order of the likeness is kept.
    """
    if threshold < fixed.CONTAINMENT_FLOOR:
        raise ValueError("similar_texts needs a threshold of at least 0.88")
    group = group or []
    share = (threshold - fixed.CONTAINMENT_FLOOR) / fixed.CONTAINMENT_SPAN
    longest = math.inf if share <= 0 else math.floor(1 / share + 1e-9)

    def texts(df):
        return df.select(*group, "text").filter(F.col("text") != "").distinct()

    sides = [_tokens(texts(df), group, longest) for df in (left, right)]
    rarity = union_all([side.select("token") for side in sides]).groupBy("token").agg(
        F.count(F.lit(1)).alias("spread")
    )
    size = F.length("text")
    per_character = 2 * (1.5 * threshold - 1) / (2 - threshold)
    needed = F.greatest(F.ceil(size * per_character - 1 - 1e-9), F.lit(1))
    is_pair = F.length("token") == 2
    in_order = Window.partitionBy(*group, "text").orderBy(is_pair.desc(), "spread", "token", "copy")
    on = group + ["token", "copy", "role"]

    def with_roles(tokens, name, own_role, other_role):
        """The rarest token of an inner text meets every token of the outer one."""
        inner = F.when(is_pair, F.col("turn") == 1).otherwise(size == 1)
        roles = F.array_compact(
            F.array(
                F.when(is_pair & (F.col("turn") <= size - needed), "alike"),
                F.when(inner, own_role),
                F.lit(other_role),
            )
        )
        ranked = tokens.join(rarity, "token").withColumn("turn", F.row_number().over(in_order))
        return ranked.withColumn("role", F.explode(roles)).select(
            *on, F.col("text").alias(name), "spread"
        )

    met = split_join(
        with_roles(sides[0], "left_text", "left_inside", "right_inside"),
        with_roles(sides[1], "right_text", "right_inside", "left_inside"),
        on, known_rows="spread",
    )
    held = (
        F.col("left_text").contains(F.col("right_text"))
        | F.col("right_text").contains(F.col("left_text"))
    )
    pairs = met.filter((F.col("role") == "alike") | held).select(*group, "left_text", "right_text").distinct()
    # Few bytes, much work for each: without a number of its own this stage would be folded into one or two tasks.
    context = met.sparkSession.sparkContext
    pairs = pairs.repartition(max(4 * context.defaultParallelism, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "left_text", "right_text")
    # A ratio of t leaves at most (1 - t) s characters unmatched, and so many edits turn one text into the other.
    edits = f"levenshtein(left_text, right_text, cast(floor({1 - threshold} * (length(left_text) + length(right_text)) + 1e-9) as int)) >= 0"
    score = likeness(F.col("left_text"), F.col("right_text"), at_least=threshold)
    pairs = pairs.filter(held | F.expr(edits)).withColumn("likeness", score)
    # Callers join the result and count its keys first; it must not be computed for each of these.
    return cut_lineage(pairs.filter(F.col("likeness") >= threshold))
