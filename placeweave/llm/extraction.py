"""Main text of web pages: parser events, text-to-tag ratio per block, smoothing and threshold clustering."""

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from placeweave.llm.buffers import slices
from placeweave.llm.native import fresh, read

# Elements of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are opened and closed as regions; others never end a region.
REGIONS = set(
    "article aside body details dialog div fieldset footer form head header html main menu nav section "
    "table ul ol dl figure".split()
)
DROPPED = set(
    "script style noscript template iframe object svg canvas math button select textarea datalist input "
    "head title nav menu aside footer form dialog".split()
)
#: Words in class, id or role that mark what is not the article; ``Blocks.marked`` says which names count.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "sidebar menu nav navigation navbar breadcrumb breadcrumbs header footer masthead comment comments "
    "disqus replies respond cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup share sharing social related recommended widget toolbar pagination "
    "pager search login complementary contentinfo dialog teaser skip".split()
)
WORD = re.compile(r"[a-z]+")
#: A compound name that begins so tells of the page ("has-sidebar"), not of the element.
STATES = set("has no not with without is".split())
#: Gaussian weights of the neighbours at distance 0, 1 and 2 (one block of deviation).
WEIGHTS = [math.exp(-d * d / 2) for d in range(3)]
#: Evidence of an article or main element: what its smoothed ratios count against the threshold.
LIFT = 4.0


class Blocks(HTMLParser):
    """Collects [text pieces, tags, region, article, dropped, pieces in links, links] of every block.

    region is the number of the nearest container, article that of the nearest article or main element, or 0.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []  # (element, dropped, region, article) of open regions
        self.count = Counter()  # open regions of each element
        self.headers = set()  # regions that are header elements
        self.link = False
        self.blocks = []
        self.regions = 0
        self.silent = None  # a dropped element that is no region, while it is open
        self.fresh_block()

    def state(self):
        return self.open[-1] if self.open else ("", False, 0, 0)

    def fresh_block(self):
        _, dropped, region, article = self.state()
        self.now = [[], 0, region, article, dropped, [], 0]
        self.link = False  # an unclosed link ends with its block
        self.blocks.append(self.now)

    def handle_starttag(self, tag, attrs):
        if self.silent:
            return
        if tag in VOID:
            if tag in BLOCKS:
                self.fresh_block()
            self.now[1] += 1
            return
        _, dropped, region, article = self.state()
        if tag in REGIONS:
            main = tag in ("article", "main") and not self.marked(attrs, "whole")
            if main and dropped in ("nav", "header", "menu", "mark"):
                dropped = False  # an element before it was never closed
            if not dropped:
                if tag in DROPPED:
                    dropped = tag
                elif tag == "header" and not article:
                    dropped = tag
                elif tag not in ("html", "body") and not main and self.marked(attrs, "head" if article else "any"):
                    dropped = "mark"
            self.regions += 1
            self.open.append((tag, dropped, self.regions, self.regions if main else article))
            self.count[tag] += 1
            if tag == "header":
                self.headers.add(self.regions)
        elif tag in DROPPED or (tag in BLOCKS and self.marked(attrs, "whole" if article else "any")):
            self.silent = tag
        if tag in BLOCKS:
            self.fresh_block()
        self.now[1] += 1
        if tag == "a":
            self.link = True
            self.now[6] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent or tag in REGIONS:
                self.silent = None
            if tag not in REGIONS:
                return
        self.now[1] += 1
        if tag == "a":
            self.link = False
        while self.count[tag]:  # a stray tag ends nothing
            closed = self.open.pop()[0]
            self.count[closed] -= 1
            if closed == tag:
                break
        if tag in BLOCKS:
            self.fresh_block()

    def handle_data(self, data):
        if not self.silent and not self.now[4]:
            self.now[0].append(data)
            if self.link:
                self.now[5].append(data)

    @staticmethod
    def marked(attrs, part):
        """Whether an element is hidden or its names hold a mark: as a whole, as the head (last word) or any word.

        An article or main element and the paragraphs and headings of an article are marked by whole names only
        ("comment", not "comments-open"), other regions of an article by heads ("post-comments", not
        "social-history"), all else by any word of a name.
        """
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for token in value.lower().split():
                    found = WORD.findall(token)
                    if len(found) > 1 and (part == "whole" or found[0] in STATES):
                        continue
                    if not MARKS.isdisjoint(found if part == "any" else found[-1:]):
                        return True
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False


def smoothed(values, groups):
    """Gaussian means over the neighbours of the same group."""
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - 2), min(len(values), i + 3)):
            w = WEIGHTS[abs(i - j)] if groups[i] == groups[j] else 0.0
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def threshold(values):
    """Border between the two clusters of values (two means, from the least and the largest)."""
    low, high = min(values), max(values)
    for _ in range(20):
        border = (low + high) / 2
        a = [v for v in values if v < border] or [low]
        b = [v for v in values if v >= border] or [high]
        now = (sum(a) / len(a), sum(b) / len(b))
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def main_text(html):
    """The article of a page, blocks joined by one space; empty for a null or empty page.

    Blocks in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are
    left out as they are parsed. Of the others the ratios of text outside links to tags are smoothed, not
    across the border of an article or main element, and cut in two clusters. Regions (the nearest article
    or main element, else the nearest container) that hold a block of the upper cluster are taken whole,
    short blocks too; in an article or main element a block counts as upper from a quarter of the border
    (``LIFT``). Blocks that are half links or more never choose a region, and containers of several links
    and little else are left out of their article, unless nothing else is in the regions taken.
    """
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    blocks, shares = [], {}
    for pieces, tags, region, article, dropped, linked, links in parser.blocks:
        text = " ".join("".join(pieces).split())
        if text and not dropped:
            n = min(len(" ".join("".join(linked).split())), len(text))
            blocks.append((text, len(text), n, tags, region, article))
            share = shares.setdefault(region, [0, 0, 0])
            for i, v in enumerate((len(text), n, links)):
                share[i] += v
    if not blocks:
        return ""
    ratio = smoothed([(length - n) / (1 + tags) for _, length, n, tags, _, _ in blocks], [b[5] for b in blocks])
    ratio = [0.0 if 2 * b[2] >= b[1] else r for b, r in zip(blocks, ratio)]
    border = threshold(ratio)
    chosen = {b[5] or b[4] for b, r in zip(blocks, ratio) if r * (LIFT if b[5] else 1.0) >= border}
    taken = [b for b in blocks if (b[5] or b[4]) in chosen]

    def in_list(region, article):
        length, n, links = shares[region]
        return region != article and region not in parser.headers and links > 1 and 2 * n >= length

    return " ".join(b[0] for b in [b for b in taken if not in_list(b[4], b[5])] or taken)


def extracted(batches):
    for batch in slices(batches, "html"):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["key", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, key="page_id", url="url", html="html") -> DataFrame:
    """key, url, text and n_chars of every page; rows, repeated ones too, and order of texts as they were.

    Null and empty pages and pages without text give an empty text; null keys and urls stay null. Unclosed
    and stray tags are read as far as they make sense. Other columns are ignored.
    """
    fresh(pages, key, url, html)
    rows = pages.select(*[pages[c].alias(n) for c, n in ((key, "key"), (url, "url"), (html, "html"))])
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(extracted, f"key {kind}, url string, text string, n_chars bigint").withColumnRenamed("key", key)


def run(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages"))
