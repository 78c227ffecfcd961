"""Stored web pages as node arrays, and the typed rows read from them.

One pass turns each page into an array of nodes in document order. A node's subtree is the
``size`` entries after it, so every extraction below is a native expression on that array and needs
no shuffle. Pages with many rows (links, cards, reviews) are exploded only after the rows are built.
"""

import json
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from placeweave import fixed
from placeweave.functions.labels import award_entry
from placeweave.functions.numbers import to_double
from placeweave.functions.text import WHITE, none_if_empty, squeeze, strip, text_or_empty
from placeweave.functions.urls import listing_url, website_key
from placeweave.operators.records import first_distinct

NODE_TYPE = (
    "array<struct<pos:int,size:int,parent:int,tag:string,attrs:map<string,string>,text:string>>"
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ENCLOSING = {"ul", "ol", "table", "dl", "select", "body"}


#: Pages of so many characters together are handed on at once.
HELD_CHARACTERS = 1 << 16


class _NodeReader(HTMLParser):
    """Flat node list of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open = [], []

    def add(self, tag, attrs, text):
        parent = self.open[-1] if self.open else -1
        self.nodes.append(
            {"pos": len(self.nodes), "size": 0, "parent": parent, "tag": tag, "attrs": attrs,
             "text": text}
        )

    def close_from(self, depth):
        for pos in self.open[depth:]:
            self.nodes[pos]["size"] = len(self.nodes) - pos - 1
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        for depth in range(len(self.open) - 1, -1, -1):
            held = self.nodes[self.open[depth]]["tag"]
            if held in ENCLOSING:
                break
            if held in CLOSED_BY.get(tag, ()):
                self.close_from(depth)
                break
        self.add(tag, [(k, v or "") for k, v in dict(attrs).items()], "")
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]]["tag"] == tag:
                self.close_from(depth)
                break

    def handle_data(self, data):
        raw = self.open and self.nodes[self.open[-1]]["tag"] in ("script", "style")
        self.add("#code" if raw else "#text", [], data)


def _read_nodes(html):
    reader = _NodeReader()
    reader.feed(html or "")
    reader.close()
    reader.close_from(0)
    return reader.nodes


def page_nodes(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, html and ``nodes`` of each page; short pages are held together, long ones one at a time."""
    chosen = pages.select(*keep, "html")
    schema = T.StructType(chosen.schema.fields)
    node = pa.list_(
        pa.struct(
            [("pos", pa.int32()), ("size", pa.int32()), ("parent", pa.int32()),
             ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
             ("text", pa.string())]
        )
    )

    def read(batches):
        for batch in batches:
            htmls = batch.column(batch.schema.get_field_index("html"))
            start, held, nodes = 0, 0, []
            for row in range(batch.num_rows):
                html = htmls[row].as_py() or ""
                nodes.append(_read_nodes(html))
                held += len(html)
                if held >= HELD_CHARACTERS or row == batch.num_rows - 1:
                    read_pages = batch.slice(start, len(nodes))
                    yield pa.RecordBatch.from_arrays(
                        read_pages.columns + [pa.array(nodes, type=node)],
                        names=batch.schema.names + ["nodes"],
                    )
                    start, held, nodes = row + 1, 0, []

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return chosen.mapInArrow(read, f"{ddl}, nodes {NODE_TYPE}")


# --- expressions on node arrays ------------------------------------------------------------


def all_nodes() -> Column:
    return F.col("nodes")


def attr(node: Column, name: str) -> Column:
    return text_or_empty(node["attrs"][name])


def has_class(node: Column, name: str) -> Column:
    return F.array_contains(F.split(attr(node, "class"), f"[{WHITE}]+"), name)


def inside(node: Column) -> Column:
    """All nodes of the subtree, in document order."""
    return F.slice(all_nodes(), node["pos"] + 2, node["size"])


def node_text(node: Column, drop=None) -> Column:
    """Stripped texts of the subtree joined by spaces; subtrees matching ``drop`` are left out."""
    below = inside(node)
    kept = F.filter(below, lambda n: n["tag"] == "#text")
    if drop is not None:
        dropped = F.filter(below, drop)
        kept = F.filter(
            kept,
            lambda n: ~F.exists(
                dropped,
                lambda d: (d["pos"] < n["pos"]) & (n["pos"] <= d["pos"] + d["size"]),
            ),
        )
    parts = F.transform(kept, lambda n: strip(n["text"]))
    return F.array_join(F.filter(parts, lambda t: t != ""), " ")


def first(nodes: Column) -> Column:
    return F.get(nodes, 0)


def is_link(node: Column) -> Column:
    return (node["tag"] == "a") & F.map_contains_key(node["attrs"], "href")


def first_by(entries: Column, field: str) -> Column:
    """Entries whose ``field`` did not occur earlier in the array."""
    seen = F.transform(entries, lambda e: e[field])
    return F.filter(entries, lambda e, i: F.array_position(seen, e[field]) == i + 1)


def resolve(href: Column, base: str) -> Column:
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(F.lit(base), href))
        .when(href == "", F.lit(base))
        .otherwise(F.concat(F.lit(base + "/"), href))
    )


# --- links ---------------------------------------------------------------------------------


def links(nodes: DataFrame, key: str, where=is_link) -> DataFrame:
    """(key, pos, href, label) of every anchor in document order."""
    found = F.transform(
        F.filter(all_nodes(), where),
        lambda a: F.struct(a["pos"].alias("pos"), strip(attr(a, "href")).alias("href"),
                           node_text(a).alias("label")),
    )
    return nodes.select(key, F.explode(found).alias("link")).select(key, "link.*")


def first_links(nodes: DataFrame, key: str, top: int = 6, canonical=listing_url) -> DataFrame:
    """(key, url, rank): the first distinct canonical targets of a page."""
    found = links(nodes, key).withColumn("url", canonical(F.col("href")))
    return first_distinct(found.filter(F.col("url").isNotNull()), key, "url", "pos", top)


def popularity_lists(nodes: DataFrame, key: str, top: int = 20) -> DataFrame:
    """(key, scope, urls) of regional ranking pages."""
    title = node_text(first(F.filter(all_nodes(), lambda n: n["tag"] == "title")))
    scope = strip(F.regexp_extract(F.coalesce(title, F.lit("")), "推薦適合在(.+?)美食餐廳", 1))
    anchors = F.filter(all_nodes(), lambda n: is_link(n) & has_class(n, "list-rst__rst-name-target"))
    urls = F.transform(
        anchors, lambda a: listing_url(resolve(attr(a, "href"), "https://tabelog.com"))
    )
    return nodes.select(
        key, scope.alias("scope"),
        F.slice(F.array_distinct(F.array_compact(urls)), 1, top).alias("urls"),
    )


def category_links(nodes: DataFrame, key: str) -> DataFrame:
    """(key, pos, label, slug) of the cuisine filters of a nearby page, first per slug."""
    found = links(nodes, key).withColumn("href", resolve(F.col("href"), "https://tabelog.com"))
    slug = F.lower(F.regexp_extract("href", fixed.CATEGORY_LINK_PATTERN, 1))
    found = found.withColumn("slug", slug).filter((F.col("slug") != "") & (F.col("label") != ""))
    return found.groupBy(key, "slug").agg(
        F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label")
    )


def nearby_cards(nodes: DataFrame, key: str, top: int = 20) -> DataFrame:
    """Compact place cards of a nearby page: the first ``top`` distinct links with a name."""

    def heading(n):
        return (n["tag"] == "h4") | (n["tag"] == "h5")

    heads = F.filter(all_nodes(), heading)

    def chosen(n):
        headed = F.exists(
            heads, lambda h: (h["pos"] < n["pos"]) & (n["pos"] <= h["pos"] + h["size"])
        )
        return is_link(n) & (headed | has_class(n, "list-rst__rst-name-target"))

    def card_text(n):
        around = F.filter(
            all_nodes(),
            lambda c: c["tag"].isin("li", "div") & (c["pos"] < n["pos"])
            & (n["pos"] <= c["pos"] + c["size"]),
        )
        return F.coalesce(node_text(F.get(around, F.size(around) - 1)), F.lit(""))

    rows = F.transform(
        F.filter(all_nodes(), chosen),
        lambda n: F.struct(
            n["pos"].alias("pos"), listing_url(attr(n, "href")).alias("url"),
            node_text(n).alias("name"), card_text(n).alias("text"),
        ),
    )
    rows = F.filter(rows, lambda r: r["url"].isNotNull() & (r["name"] != ""))
    cards = nodes.select(
        key, F.posexplode(F.slice(first_by(rows, "url"), 1, top)).alias("row_pos", "card")
    ).select(key, "row_pos", "card.*")
    parts = F.filter(F.transform(F.split("text", "/"), strip), lambda p: p != "")
    genre_text = F.regexp_replace(F.get(parts, 1), "\\s+[2-4]\\.\\d{2}\\s+[\\d,]+人.*$", "")
    genres = F.filter(F.transform(F.split(genre_text, "、"), strip), lambda g: g != "")
    reviews = F.regexp_extract("text", "([\\d,]+)人", 1)
    return cards.select(
        key, "row_pos", "name", "url",
        none_if_empty(F.regexp_extract("text", "\\b([2-4]\\.\\d{2})\\b", 1)).cast("double")
        .alias("rating"),
        F.replace(reviews, F.lit(","), F.lit("")).try_cast("bigint").alias("review_count"),
        F.coalesce(genres, F.array().cast("array<string>")).alias("genres"),
        F.coalesce(F.get(parts, 0), F.lit("")).alias("area"),
    )


# --- award guide pages ---------------------------------------------------------------------


def award_cards(nodes: DataFrame, key: str) -> DataFrame:
    """Award rows of a list page: cards inside the result container that have id, name and url."""
    container = first(F.filter(all_nodes(), lambda n: has_class(n, "js-restaurant__list_items")))
    cards = F.filter(inside(container), lambda n: has_class(n, "js-restaurant__list_item"))

    def classed(card, name):
        return F.filter(inside(card), lambda n: has_class(n, name))

    def row(card):
        titles = F.flatten(
            F.transform(classed(card, "card__menu-content--title"),
                        lambda t: F.filter(inside(t), is_link))
        )
        bookmark = first(classed(card, "js-bookmark-restaurant"))
        scores = F.transform(
            classed(card, "card__menu-footer--score"), lambda n: squeeze(node_text(n))
        )
        distinction = strip(attr(bookmark, "data-distinction"))
        known = distinction.isin(list(fixed.DISTINCTION_LABELS))
        price = F.coalesce(F.get(scores, 1), F.lit(""))
        return F.struct(
            card["pos"].alias("pos"),
            attr(card, "data-id").alias("id"),
            node_text(first(titles)).alias("name"),
            resolve(attr(first(titles), "href"), fixed.GUIDE_BASE_URL).alias("url"),
            to_double(attr(card, "data-lat")).alias("latitude"),
            to_double(attr(card, "data-lng")).alias("longitude"),
            F.coalesce(F.get(scores, 0), F.lit("")).alias("location"),
            strip(F.substring_index(price, "·", 1)).alias("price"),
            F.when(
                price.contains("·"), strip(F.regexp_replace(price, "^[^·]*·", ""))
            ).otherwise("").alias("cuisine"),
            F.when(known, distinction).otherwise("SELECTED").alias("distinction"),
            (F.lower(strip(attr(bookmark, "data-green-star"))) == "true").alias("green_star"),
            (F.size(titles) > 0).alias("titled"),
        )

    rows = nodes.select(key, F.explode(F.transform(cards, row)).alias("card")).select(key, "card.*")
    labels = F.create_map(*[F.lit(x) for pair in fixed.DISTINCTION_LABELS.items() for x in pair])
    return (
        rows.filter(F.col("titled") & (F.col("id") != "") & (F.col("name") != ""))
        .drop("titled")
        .withColumn("distinction_label", labels[F.col("distinction")])
    )


def award_totals(nodes: DataFrame, key: str) -> DataFrame:
    """(key, declared, last_page) of a list page."""
    heading = node_text(first(F.filter(all_nodes(), lambda n: has_class(n, "search-results__stats"))))
    declared = F.regexp_extract(F.coalesce(heading, F.lit("")), "共\\s*([0-9,]+)\\s*個餐廳", 1)
    numbers = F.transform(
        F.filter(all_nodes(), is_link),
        lambda a: F.regexp_extract(attr(a, "href"), "/restaurants/page/(\\d+)", 1).try_cast("int"),
    )
    return nodes.select(
        key,
        F.coalesce(F.replace(declared, F.lit(","), F.lit("")).try_cast("bigint"), F.lit(0))
        .alias("declared"),
        F.coalesce(F.greatest(F.array_max(numbers), F.lit(1)), F.lit(1)).alias("last_page"),
    )


ENTITY_TYPE = (
    T.StructType().add("found", "boolean").add("telephone", "string")
    .add("latitude", "double").add("longitude", "double")
)


def _entities(value, deep):
    """Typed entities of a JSON-LD value: the first one found anywhere, or those at the top."""
    pending = [value]
    while pending:
        node = pending.pop(0)
        if isinstance(node, dict):
            kind = node.get("@type")
            if kind == "Restaurant" or (deep and isinstance(kind, list) and "Restaurant" in kind):
                yield node
                if deep:
                    return
            if deep:
                pending[:0] = node.values()
        elif isinstance(node, list) and (deep or node is value):
            pending[:0] = node


def _number(value):
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


@F.pandas_udf(ENTITY_TYPE)
def _linked_entity(scripts: pd.Series) -> pd.DataFrame:
    rows = []
    for texts in scripts:
        row = {"found": False, "telephone": "", "latitude": None, "longitude": None}
        for text in texts if texts is not None else []:
            try:
                value = json.loads(text)
            except ValueError:
                continue
            for entity in _entities(value, deep=False):
                row["found"] = True
                row["telephone"] = row["telephone"] or str(entity.get("telephone") or "").strip()
            for entity in _entities(value, deep=True):
                geo = entity.get("geo")
                point = (
                    [_number(geo.get(k)) for k in ("latitude", "longitude")]
                    if isinstance(geo, dict) else [None]
                )
                if row["latitude"] is None and None not in point:
                    row["latitude"], row["longitude"] = point
        rows.append(row)
    return pd.DataFrame(rows, columns=["found", "telephone", "latitude", "longitude"])


def linked_entity() -> Column:
    """struct(found, telephone, latitude, longitude) from the page's JSON-LD; bad JSON is skipped."""
    scripts = F.filter(
        all_nodes(), lambda n: (n["tag"] == "script") & (attr(n, "type") == "application/ld+json")
    )
    return _linked_entity(
        F.transform(
            scripts,
            lambda s: F.array_join(F.transform(inside(s), lambda n: n["text"]), ""),
        )
    )


def award_details(nodes: DataFrame, key: str) -> DataFrame:
    """(key, phone, website) of detail pages that describe a restaurant."""
    button = first(
        F.filter(all_nodes(), lambda n: is_link(n) & (attr(n, "data-event") == "CTA_website"))
    )
    website = strip(attr(button, "href"))
    read = nodes.select(key, linked_entity().alias("entity"), website.alias("website"))
    return read.filter(F.col("entity.found")).select(
        key, F.col("entity.telephone").alias("phone"),
        F.when(website_key(F.col("website")) != "", F.col("website")).otherwise("").alias("website"),
    )


# --- listing pages -------------------------------------------------------------------------


def page_point() -> Column:
    """struct(latitude, longitude): data attributes, else JSON-LD."""
    basics = first(
        F.filter(
            all_nodes(),
            lambda n: (attr(n, "id") == "js-basics") & F.map_contains_key(n["attrs"], "data-lat")
            & F.map_contains_key(n["attrs"], "data-lng"),
        )
    )
    lat, lng = to_double(attr(basics, "data-lat")), to_double(attr(basics, "data-lng"))
    entity = linked_entity()
    given = lat.isNotNull() & lng.isNotNull()
    return F.struct(
        F.when(given, lat).otherwise(entity["latitude"]).alias("latitude"),
        F.when(given, lng).otherwise(entity["longitude"]).alias("longitude"),
    )


def info_map() -> Column:
    """Label to value of the information table; the first row of a label wins."""

    def cell(row, tag):
        return first(F.filter(inside(row), lambda n: n["tag"] == tag))

    rows = F.filter(all_nodes(), lambda n: n["tag"] == "tr")
    entries = F.transform(
        rows,
        lambda r: F.struct(
            F.regexp_replace(node_text(cell(r, "th")), f"[{WHITE}]+", "").alias("key"),
            squeeze(node_text(cell(r, "td"))).alias("value"),
        ),
    )
    filled = F.filter(
        entries,
        lambda e: (F.coalesce(e["key"], F.lit("")) != "") & (F.coalesce(e["value"], F.lit("")) != ""),
    )
    return F.map_from_entries(first_by(filled, "key"))


def award_history(nodes: DataFrame, key: str) -> DataFrame:
    """(key, pos, label, category, area, year, url) of the award badges of a page, once per link."""

    def badge(n):
        around = F.filter(
            all_nodes(),
            lambda d: (d["tag"] == "div") & (d["pos"] < n["pos"])
            & (n["pos"] <= d["pos"] + d["size"])
            & attr(d, "class").rlike("rdheader-badge-award|rstinfo-table-badge-hyakumeiten"),
        )
        wrapper = F.get(around, F.size(around) - 1)
        tips = F.filter(inside(wrapper), lambda t: attr(t, "class").contains("tooltip"))
        tip = first(
            F.flatten(F.transform(tips, lambda t: F.filter(inside(t), lambda x: x["tag"] == "p")))
        )
        return F.coalesce(node_text(tip), node_text(n))

    anchors = F.filter(
        all_nodes(), lambda n: (n["tag"] == "a") & attr(n, "href").rlike(fixed.AWARD_LINK_PATTERN)
    )
    rows = F.transform(
        anchors,
        lambda n: F.struct(n["pos"].alias("pos"), attr(n, "href").alias("url"),
                           badge(n).alias("text")),
    )
    found = nodes.select(key, F.explode(first_by(rows, "url")).alias("row")).select(key, "row.*")
    return found.select(key, "pos", award_entry(F.col("text"), F.col("url")).alias("entry"), "url") \
        .select(key, "pos", "entry.*", "url")


def relocation() -> Column:
    """struct(is_relocated, to_name, to_url) from an explicit notice only."""
    notice = first(F.filter(all_nodes(), lambda n: has_class(n, "rst-status-alert")))
    moved = F.coalesce(node_text(notice).contains(fixed.RELOCATION_NOTICE), F.lit(False))
    target = first(F.filter(inside(notice), is_link))
    return F.struct(
        moved.alias("is_relocated"),
        F.when(moved, F.coalesce(node_text(target), F.lit(""))).otherwise("").alias("to_name"),
        F.when(moved, F.coalesce(listing_url(attr(target, "href")), F.lit(""))).otherwise("")
        .alias("to_url"),
    )


def map_targets(nodes: DataFrame, key: str) -> DataFrame:
    """(key, address, latitude, longitude) of map frames; without an address there is no row."""
    label = first(
        F.filter(all_nodes(), lambda n: (n["tag"] == "strong") & node_text(n).contains("住所"))
    )
    start = label["pos"] + label["size"] + 2
    parent = F.get(all_nodes(), F.greatest(label["parent"], F.lit(0)))
    end = F.when(label["parent"] < 0, F.size(all_nodes())).otherwise(parent["pos"] + parent["size"] + 1)
    after = F.slice(all_nodes(), start, F.greatest(end - start + 1, F.lit(0)))
    breaks = F.filter(
        after, lambda n: (n["tag"] == "br") & (n["parent"] == label["parent"])
    )
    stop = F.coalesce(first(breaks)["pos"], F.size(all_nodes()))
    texts = F.transform(
        F.filter(after, lambda n: (n["tag"] == "#text") & (n["pos"] < stop)),
        lambda n: strip(n["text"]),
    )
    address = squeeze(F.array_join(F.filter(texts, lambda t: t != ""), " "))
    literal = (
        "new\\s+google\\.maps\\.LatLng\\(\\s*(-?\\d+(?:\\.\\d+)?)\\s*,\\s*(-?\\d+(?:\\.\\d+)?)\\s*\\)"
    )
    read = nodes.select(key, "html", address.alias("address"), page_point().alias("point"))
    return read.select(
        key, "address",
        *[
            F.coalesce(
                F.col(f"point.{name}"), none_if_empty(F.regexp_extract("html", literal, g)).cast("double")
            ).alias(name)
            for g, name in ((1, "latitude"), (2, "longitude"))
        ],
    ).filter(F.col("address") != "")


def review_texts(nodes: DataFrame, key: str) -> DataFrame:
    """(key, pos, text): anonymous review bodies; author, picture and link nodes never count."""

    def items(tag, name):
        return F.filter(all_nodes(), lambda n: (n["tag"] == tag) & has_class(n, name))

    choices = [items("div", "rvw-item"), items("li", "rvw-item"), items("div", "js-rvw-item")]
    chosen = F.coalesce(*[F.when(F.size(c) > 0, c) for c in choices], F.filter(all_nodes(), lambda n: F.lit(False)))

    def hidden(n):
        authors = ["rvw-item__rvwr-name", "rvw-item__name", "rvw-item__photo", "rvw-item__img"]
        flagged = n["tag"].isin("a", "script", "style", "img", "noscript", "picture")
        for name in authors:
            flagged = flagged | has_class(n, name)
        return flagged

    def clean(node):
        return squeeze(node_text(node, drop=hidden))

    def best(item, names):
        """First non-empty text among the first node of each (tag, class), in that order."""
        def matching(tag, name):
            def test(n):
                return has_class(n, name) if tag is None else has_class(n, name) & (n["tag"] == tag)

            return test

        hits = [first(F.filter(inside(item), matching(tag, name))) for tag, name in names]
        options = [none_if_empty(clean(hit)) for hit in hits]
        return F.coalesce(*options, F.lit(""))

    def fallback(item):
        plain = F.filter(
            inside(item),
            lambda n: n["tag"].isin("div", "p")
            & ~attr(n, "class").rlike("rvwr|name|date|useful|photo|img"),
        )
        long = F.filter(F.transform(plain, clean), lambda t: F.length(t) >= 20)
        return F.coalesce(F.get(long, 0), F.lit(""))

    def body(item):
        title = best(item, [("p", "rvw-item__rvw-title"), (None, "rvw-item__rvw-title")])
        comment = best(
            item,
            [("div", "rvw-item__rvw-comment"), ("div", "rvw-item__comment"),
             ("p", "rvw-item__rvw-comment"), (None, "rvw-item__rvw-comment")],
        )
        comment = F.coalesce(none_if_empty(comment), fallback(item))
        both = (title != "") & (comment != "")
        whole = F.when(both, F.concat(title, F.lit("。"), comment)).otherwise(
            F.coalesce(none_if_empty(comment), title)
        )
        return F.struct(item["pos"].alias("pos"), squeeze(whole).alias("text"))

    bodies = F.filter(F.transform(chosen, body), lambda b: F.length(b["text"]) >= 12)
    return nodes.select(key, F.explode(bodies).alias("review")).select(key, "review.*")


def listing_pages(nodes: DataFrame, key: str) -> DataFrame:
    """Everything a listing page adds to its listing, read from one node array."""
    return nodes.select(
        key, page_point().alias("point"), info_map().alias("info"), relocation().alias("moved")
    )
