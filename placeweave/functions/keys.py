"""Lookup keys and list-card identity."""

from pyspark.sql import Column, functions as F

from placeweave import fixed
from placeweave.functions.numbers import finite_double
from placeweave.functions.text import compatibility_form, none_if_empty, squeeze, strip, text_or_empty
from placeweave.functions.urls import site_href

PLACE_KEY_FIELDS = ["name", "alternate_name", "address", "phone", "website", "listing_url"]


def coordinate_text(value: Column) -> Column:
    number = finite_double(value)
    return F.when(number.isNull(), "").otherwise(F.format_string("%.5f", number))


def place_key(columns: dict[str, Column]) -> Column:
    """Pipe-joined identity of a place; coordinates at five decimals."""
    parts = [strip(text_or_empty(columns.get(f, F.lit(None)))) for f in PLACE_KEY_FIELDS]
    parts += [coordinate_text(columns.get(f, F.lit(None))) for f in ("latitude", "longitude")]
    return F.concat_ws("|", *parts)


def hint_key(columns: dict[str, Column]) -> Column:
    """Suffix for a lookup that carries a linked listing; empty without a name."""
    name = strip(text_or_empty(columns["name"]))
    rest = [strip(text_or_empty(columns.get(f, F.lit(None)))) for f in ("phone", "website")]
    points = [coordinate_text(columns.get(f, F.lit(None))) for f in ("latitude", "longitude")]
    return F.when(name == "", "").otherwise(F.concat_ws(":", F.lit("tg"), name, *rest, *points))


def lookup_key(kind: Column, place: Column, hint: Column | None = None) -> Column:
    key = F.concat(kind, F.lit(":"), place)
    if hint is None:
        return key
    return F.when(hint == "", key).otherwise(F.concat(key, F.lit("|"), hint))


def content_key(**parts: Column) -> Column:
    """SHA-256 of compact JSON whose keys are sorted."""
    body = F.struct(*[parts[name].alias(name) for name in sorted(parts)])
    return F.sha2(F.to_json(body), 256)


def facts_key(facts: Column) -> Column:
    return content_key(facts=facts, version=F.lit(fixed.ADVICE_KEY_VERSION))


def review_key(listing_url: Column, model: Column) -> Column:
    return content_key(
        model=model, prompt_version=F.lit(fixed.REVIEW_KEY_VERSION), tabelog_url=listing_url
    )


def list_text(value: Column) -> Column:
    return squeeze(F.lower(compatibility_form(value)))


def list_name(value: Column) -> Column:
    """Drop what follows the last middle dot when both sides hold text."""
    name = squeeze(value)
    tail = F.substring_index(name, "·", -1)
    head = F.left(name, F.length(name) - F.length(tail) - 1)
    cut = name.contains("·") & (strip(head) != "") & (strip(tail) != "")
    return F.when(cut, strip(head)).otherwise(name)


def list_card_key(href: Column, name: Column) -> Column:
    shown = F.coalesce(none_if_empty(list_name(name)), strip(text_or_empty(name)))
    return F.concat(site_href(href), F.lit("|"), list_text(shown))


def identity_queries(phone: Column, alternate_name: Column, name: Column) -> Column:
    """Quoted search phrases: the local phone, then the distinct names."""
    local = F.regexp_replace(strip(text_or_empty(phone)), "^\\+?81[\\s().-]*", "0")
    local = none_if_empty(F.regexp_replace(local, "[^\\p{Nd}-]", ""))

    def bare(value):
        return none_if_empty(strip(F.replace(text_or_empty(value), F.lit('"'), F.lit(""))))

    def quoted(value):
        return F.concat(F.lit('site:tabelog.com "'), value, F.lit('"'))

    names = F.array_distinct(F.array_compact(F.array(bare(alternate_name), bare(name))))
    return F.concat(
        F.array_compact(F.array(quoted(local))), F.transform(names, quoted)
    )
