"""Tolerant number reading."""

from pyspark.sql import Column, functions as F

from placeweave.functions.text import strip, text_or_empty


def to_double(value: Column) -> Column:
    """A double where the text reads as one, else null."""
    return strip(value.cast("string")).try_cast("double")


def finite_double(value: Column) -> Column:
    number = to_double(value)
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def not_nan(value: Column) -> Column:
    number = to_double(value)
    return F.when(~F.isnan(number), number)


def to_integer(value: Column) -> Column:
    """An integer where the text is one; numbers lose their fraction."""
    text = strip(text_or_empty(value))
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def number_text(value: Column) -> Column:
    """JSON form of a finite number: whole values without a fraction, an exponent only below 0.0001."""
    number = finite_double(value)
    whole = number == F.floor(number)
    # Doubles turn to text with an exponent from 0.001 down and from ten million up.
    text = number.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    tiny = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(".0E"), F.lit("E")), "E-(\\d)$", "E-0$1"), "E", "e")
    other = F.when(~text.contains("E"), text).when(F.abs(number) < 1e-4, tiny).otherwise(plain)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(other)


def micros(value: Column) -> Column:
    """Microseconds since the epoch; a time without a zone counts in the session's zone."""
    return F.unix_micros(value.cast("timestamp"))
