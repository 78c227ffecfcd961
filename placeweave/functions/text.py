"""Text folding and likeness as Column expressions."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from placeweave import fixed
from placeweave.functions.ratio import matching_ratios

# Every character that Python counts as white space, spelled for java.util.regex.
WHITE = (
    "\\t-\\r\\x1c-\\x20\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)


#: Ratios that a task remembers from batch to batch; the same two names meet in many pairs.
RATIOS_KEPT = 2**18
_RATIOS = {}


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{WHITE}]+|[{WHITE}]+$", "")


def squeeze(value: Column, limit: int | None = None) -> Column:
    """Collapse white space, strip, and cut to ``limit`` characters."""
    text = F.trim(F.regexp_replace(text_or_empty(value), f"[{WHITE}]+", " "))
    return text if limit is None else F.left(text, F.lit(limit))


def has_text(value: Column) -> Column:
    """Whether anything but white space is there; stops at the first such character."""
    return text_or_empty(value).rlike(f"[^{WHITE}]")


def none_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def is_ascii(value: Column) -> Column:
    return ~value.rlike("[^\\x00-\\x7f]")


@F.pandas_udf(T.StringType())
def _compatibility_fold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold()
    )


@F.pandas_udf(T.StringType())
def _compatibility_form(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def casefold(value: Column) -> Column:
    """NFKC plus casefold; only text outside ASCII travels to the Arrow helper."""
    text = text_or_empty(value)
    return F.coalesce(_compatibility_fold(F.when(~is_ascii(text), text)), F.lower(text))


def compatibility_form(value: Column) -> Column:
    text = text_or_empty(value)
    return F.coalesce(_compatibility_form(F.when(~is_ascii(text), text)), text)


def _keep_known(value: Column) -> Column:
    return F.regexp_replace(value, f"[^{fixed.KEPT_CHARACTERS}]", "")


def fold_text(value: Column) -> Column:
    return _keep_known(casefold(value))


def drop_name_words(folded: Column) -> Column:
    """Delete the type and branch words one after another, in their given order."""
    for word in fixed.TYPE_WORDS + fixed.BRANCH_WORDS:
        folded = F.replace(folded, F.lit(word), F.lit(""))
    return folded


def fold_name(value: Column) -> Column:
    return drop_name_words(fold_text(value))


def fold_phone(value: Column) -> Column:
    digits = F.regexp_replace(compatibility_form(value), "\\P{Nd}", "")
    abroad = digits.startswith("81") & F.length(digits).isin(11, 12)
    return F.when(abroad, F.concat(F.lit("0"), F.substring(digits, 3, 20))).otherwise(digits)


def fold_address(value: Column) -> Column:
    text = F.regexp_replace(casefold(value), "〒?\\p{Nd}{3}-?\\p{Nd}{4}", "")
    return _keep_known(F.regexp_replace(text, "番地|番|号", ""))


@F.pandas_udf(T.DoubleType())
def _matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    pairs = [None if a is None or b is None else (a, b) for a, b in zip(left, right)]
    unknown = [pair for pair in dict.fromkeys(pairs) if pair is not None and pair not in _RATIOS]
    if len(_RATIOS) + len(unknown) > RATIOS_KEPT:
        # Those of this batch that were known are found again.
        _RATIOS.clear()
        unknown = [pair for pair in dict.fromkeys(pairs) if pair is not None]
    if unknown:
        _RATIOS.update(zip(unknown, matching_ratios(*map(list, zip(*unknown))).tolist()))
    return pd.Series([None if pair is None else _RATIOS[pair] for pair in pairs], dtype="float64")


def contained(left: Column, right: Column) -> Column:
    """Both texts are non-empty and one lies within the other."""
    return (left != "") & (right != "") & (left.contains(right) | right.contains(left))


def containment_likeness(left: Column, right: Column) -> Column:
    short = F.least(F.length(left), F.length(right))
    long = F.greatest(F.length(left), F.length(right))
    return F.lit(fixed.CONTAINMENT_FLOOR) + F.lit(fixed.CONTAINMENT_SPAN) * (short / long)


def most_likeness(left: Column, right: Column) -> Column:
    """What the matching ratio of two texts is at most, from their lengths alone."""
    total = F.length(left) + F.length(right)
    return F.when((left == "") | (right == ""), 0.0).otherwise(2.0 * F.least(F.length(left), F.length(right)) / total)


def likeness(left: Column, right: Column, at_least: float | None = None) -> Column:
    """0 for empty text, the containment score, else the order-sensitive matching ratio.

    With ``at_least`` a pair whose lengths alone rule that ratio out scores 0 and skips the helper.
    """
    left, right = text_or_empty(left), text_or_empty(right)
    within = contained(left, right)
    compare = (left != "") & (right != "") & ~within
    if at_least is not None:
        total = F.length(left) + F.length(right)
        compare &= 2.0 * F.least(F.length(left), F.length(right)) >= at_least * total
    ratio = _matching_ratio(F.when(compare, left), F.when(compare, right))
    return F.when(within, containment_likeness(left, right)).otherwise(
        F.coalesce(ratio, F.lit(0.0))
    )
