"""Links of search pages with the elements around them.

A page is parsed once into its texts and elements, an element being an interval of texts; what
lies in an element is then a lookup of places in its interval. A link's card, the first element from it
outwards with a price or with all words looked for, is given by number, and each card's text once, so
a page takes memory in proportion to its own length, however many links share a card.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.functions.text import clean, norm_text
from offerlane.sources.page import AMOUNT, Page, absolute

#: Elements around a link that are looked at, unless the pages say how many.
CLIMB = 10
LINKS = "kind string, position int, href string, label string, alt string, matched string, card int, text string"
_FIELDS = [f.split()[0] for f in LINKS.split(", ")]


def _places(page: Page, words: list[str]) -> list[list[int]]:
    """For each word the texts that have it."""
    found = {w: [] for w in words}
    for k, text in enumerate(page.words):
        for w in found.keys() & set(norm_text(text).split()):
            found[w].append(k)
    return list(found.values())


def _inside(places: list[int], node: dict, n: int) -> bool:
    k = bisect_left(places, node["from"])
    return k < len(places) and places[k] < (n if node["to"] is None else node["to"])


def _alt(page: Page, k: int) -> str | None:
    """The words of the first image within the k-th element."""
    end = page.nodes[k]["last"]
    for n in page.nodes[k + 1 : end + 1]:
        if n["tag"] == "img":
            return " ".join(filter(None, (n["a"].get("alt"), n["a"].get("title")))) or None
    return None


def page_links(html: str | None, words: list[str], climb: int, priced: bool, embedded: str | None) -> list[tuple]:
    """Rows of LINKS for one page: its links, then the cards that they name. With words, a link matches by its
    label, or by its card: the first element with all words and, if priced, an amount. Of a link that
    matches by its label, and without words, the card is the first element with an amount.
    embedded: a pattern of URLs that count as links wherever they stand in the source."""
    page = Page()
    page.feed(html or "")
    page.close()
    page.extend()
    amounts = [k for k, w in enumerate(page.words) if AMOUNT.search(w)]
    places = _places(page, words)
    out, cards, seen = [], {}, 0
    for k, node in enumerate(page.nodes):
        a = node["a"]
        if node["tag"] != "a" or not a.get("href"):
            continue
        label = a.get("title") or a.get("aria-label") or page.text(node)
        own = set(norm_text(label).split())
        matched, card = ("label" if words and all(w in own for w in words) else None), None
        at, need = k, ([] if matched else places) + ([amounts] if priced or not words else [])
        for _ in range(climb + 1 if need else 0):
            if all(_inside(x, page.nodes[at], len(page.words)) for x in need):
                card = at
                break
            if page.nodes[at]["up"] is None:
                break
            at = page.nodes[at]["up"]
        if card is not None:
            cards[card] = page.nodes[card]
            matched = matched or ("card" if words else None)
        out.append(("link", seen, a["href"], label, _alt(page, k), matched, card, None))
        seen += 1
    for url in dict.fromkeys(re.findall(embedded, (html or "").replace("\\/", "/").replace("\\u002F", "/"), re.I) if embedded else []):
        out.append(("link", seen, url, "", None, None, None, None))
        seen += 1
    return out + [("card", None, None, None, None, None, k, page.text(node)) for k, node in cards.items()]


def listing(pages: DataFrame, *keys: str) -> DataFrame:
    """keys, url and LINKS of search pages (keys, url, html and, if they have them, words: array<string>, climb, priced, embedded).
    kind is link or card; a link's card has its number and the same keys and url."""
    given = {"words": "array<string>", "climb": "int", "priced": "boolean", "embedded": "string"}
    columns = [F.col(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in given.items()]

    def parse(batches):
        for pdf in batches:
            out, at = [], []
            for k, row in enumerate(pdf[["html", *given]].itertuples(index=False)):
                words = [] if row.words is None else list(row.words)
                out += page_links(row.html, words, CLIMB if pd.isna(row.climb) else int(row.climb), row.priced is True, row.embedded)
                at += [k] * (len(out) - len(at))
            found = pd.DataFrame(out, columns=_FIELDS).astype({"position": "Int32", "card": "Int32"})
            yield pd.concat((pdf[[*keys, "url"]].iloc[at].reset_index(drop=True), found), axis=1)

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (*keys, "url"))
    return pages.select(*keys, "url", "html", *columns).mapInPandas(parse, f"{schema}, {LINKS}")


def with_cards(links: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """links (with page, the URL of their page, and card) with the text of their cards in place of its number; rows: the listing()."""
    cards = rows.filter("kind = 'card'").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("url").alias("_page"), F.col("card").alias("_card"), F.col("text").alias("_text"))
    same = (F.col("page") == F.col("_page")) & (F.col("card") == F.col("_card"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return links.join(cards, same, "left").withColumn("card", F.col("_text")).drop(*(f"_{k}" for k in keys), "_page", "_card", "_text")


def link_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, page, url (absolute, without query and fragment, each once per page), position, label (with
    the words of its image), matched, card (a number) of a listing()."""
    url = F.substring_index(F.substring_index(absolute(F.col("href"), F.col("url")), "#", 1), "?", 1)
    links = rows.filter("kind = 'link'").select(*keys, F.col("url").alias("page"), url.alias("url"), "position", clean(F.concat_ws(" ", "label", "alt")).alias("label"), "matched", "card")
    links = links.filter(F.col("url").rlike("^https?://"))
    best = F.min_by(F.struct("label", "matched", "card"), F.struct(F.col("matched").isNull().alias("unmatched"), (F.col("label") == "").alias("unnamed"), "position")).alias("x")
    return links.groupBy(*keys, "page", "url").agg(best, F.min("position").alias("position")).select(*keys, "page", "url", "position", "x.*")
