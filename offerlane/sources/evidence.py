"""Product pages: what a page holds, as columns, and rules over it that give a raw offer.

One pass of the standard HTML parser, on Arrow batches, lists what pages hold:
metadata, JSON-LD, priced elements, controls; links and their cards are listed by listing.py. All rules
that choose among it are column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.functions.classify import concentration, gender
from offerlane.functions.measures import gtin, index_size_ml, money
from offerlane.functions.text import filled, let, norm, url_key
from offerlane.sources.extract import candidate_price, card_name, card_stock, page_price
from offerlane.sources.listing import link_rows, listing, with_cards
from offerlane.sources.page import Page, absolute
from offerlane.vocabulary import OLD_PRICE, PRICE_LABELS, PURCHASE_MARKERS, PURCHASE_WORDS, SAYS_IN_STOCK, SAYS_OUT_OF_STOCK, SIZE_LABELS

#: What a page holds.
EVIDENCE = (
    "title string, h1 string, meta map<string,string>, products array<string>, text string, prices array<struct<marks:string,value:string>>, sizes array<string>, stock array<string>, "
    "controls array<struct<label:string,off:boolean>>, images array<string>"
)
FIELDS = [f.split()[0] for f in EVIDENCE.replace("<struct<", "<").split(", ")]
#: Length of a context before an amount.
BEFORE = 60
def evidence(html: str | None) -> dict:
    """What one page holds; nothing for a null page."""
    page = Page()
    page.feed(html or "")
    page.close()
    out = {"title": None, "h1": None, "meta": {}, "products": [], "text": " ".join(page.words), "prices": [], "sizes": [], "stock": [], "controls": [], "images": []}
    for n in page.nodes:
        tag, a, prop = n["tag"], n["a"], n["a"].get("itemprop", "").lower()
        if tag in ("title", "h1") and out[tag] is None:
            out[tag] = page.text(n) or None
        elif tag == "meta" and "content" in a:
            out["meta"].setdefault((a.get("property") or a.get("name") or prop).lower(), a["content"])
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            out["products"] += product_nodes(n.get("raw", ""))
        elif tag == "img" and (a.get("src") or a.get("data-src")):
            out["images"].append(a.get("src") or a["data-src"])
        if tag in ("script", "style", "html", "body"):
            continue
        marks = " ".join((a.get("class", ""), a.get("id", ""), prop))
        if prop == "price" or "price" in a.get("class", "").lower() or "data-price" in a:
            out["prices"].append({"marks": marks, "value": a.get("content") or a.get("data-price") or a.get("value") or page.text(n)})
        if prop in ("size", "volume") or "data-size" in a or "data-product-size" in a or tag == "option" and "selected" in a or tag == "input" and "size" in a.get("name", "").lower() and "checked" in a:
            out["sizes"].append(a.get("content") or a.get("value") or a.get("data-product-size") or a.get("data-size") or page.text(n))
        said = [a.get(k, "") for k in ("data-availability", "data-stock-status", "data-product-availability")]
        if prop == "availability" or any(said):
            out["stock"].append(" ".join((a.get("content", ""), a.get("href", ""), *said, page.text(n))).strip().lower())
        if tag in ("button", "a") or tag == "input" and a.get("type", "").lower() in ("submit", "button") or "data-action" in a or "data-button-action" in a:
            label = " ".join((page.text(n), *(a.get(k, "") for k in ("value", "aria-label", "title", "class", "data-button-action", "data-action", "name", "id"))))
            off = "disabled" in a or a.get("aria-disabled", "").lower() == "true" or "disabled" in a.get("class", "").split()
            out["controls"].append({"label": " ".join(label.lower().split()), "off": off})
    return out


def product_nodes(block: str) -> list[str]:
    """The product nodes of a JSON-LD block as JSON, wherever they are nested, in order. Bad JSON gives nothing."""
    try:
        stack = [json.loads(block)]
    except (ValueError, RecursionError):
        return []
    found = []
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            kinds = node.get("@type")
            if kinds == "Product" or isinstance(kinds, list) and "Product" in kinds:
                found.append(json.dumps(node))
        inner = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        stack += [x for x in reversed(list(inner)) if isinstance(x, (dict, list))]
    return found


def with_evidence(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages, without their HTML, with the columns of EVIDENCE."""
    kept = [c for c in pages.columns if c != html and c not in FIELDS]

    def parse(batches):
        for pdf in batches:
            found = pd.DataFrame([evidence(x) for x in pdf["_html"]], columns=FIELDS)
            yield pd.concat((pdf[kept].reset_index(drop=True), found), axis=1)

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(*kept, F.col(html).alias("_html")).mapInPandas(parse, f"{schema}, {EVIDENCE}")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _text_of(node: Column, *paths: str) -> Column:
    """The first filled of some paths into a variant."""
    return filled(*(F.try_variant_get(node, p, "string") for p in paths))


def offers_of(product: Column) -> Column:
    """The offers of a product node as variants, whether it has one or a list."""
    one = F.array(F.try_variant_get(product, "$.offers", "variant"))
    inner = F.try_variant_get(product, "$.offers.offers", "array<variant>")
    return F.filter(F.coalesce(F.try_variant_get(product, "$.offers", "array<variant>"), inner, one), lambda x: x.isNotNull())


def chosen_offer(offers: Column) -> Column:
    """The first priced offer that is not out of stock, else the first priced, else the first."""
    priced = F.filter(offers, lambda o: _text_of(o, "$.price", "$.lowPrice").isNotNull())
    there = lambda p: F.filter(p, lambda o: ~_any(F.lower(F.coalesce(_text_of(o, "$.availability"), F.lit(""))), SAYS_OUT_OF_STOCK))
    return let(priced, lambda p: F.coalesce(F.get(there(p), F.lit(0)), F.get(p, F.lit(0)), F.get(offers, F.lit(0))))


def offer_of_page(offers: Column, url: Column, name: Column) -> Column:
    """chosen_offer() among those of the page's own URL, if there are some; if the name has a size, among
    those that name this size too: an offer of another size is never taken, one without a size can be."""
    own = F.filter(offers, lambda o: F.regexp_replace(url_key(absolute(_text_of(o, "$.url"), url)), "/+$", "") == F.regexp_replace(url_key(url), "/+$", ""))
    some = let(own, lambda x: F.when(F.size(x) > 0, x).otherwise(offers))
    size = index_size_ml(name)
    size_of = lambda o: index_size_ml(F.concat_ws(" ", *(_text_of(o, f"$.{k}") for k in ("name", "description", "sku", "url"))))
    sized = lambda x: F.filter(x, lambda o: F.abs(size_of(o) - size) < 0.01)
    fits = let(some, lambda x: F.when(size.isNull() | ~F.exists(x, lambda o: size_of(o).isNotNull()), x).otherwise(sized(x)))
    return let(fits, lambda x: F.when(F.size(x) > 0, chosen_offer(x)))


def html_price(text: Column, meta: Column, prices: Column) -> Column:
    """The price that a page shows: after a label, in its metadata, of a priced element
    that isn't marked as a former one, or the first amount of its text that isn't."""
    number, sign = r"([0-9][0-9 .,]*)", r"(?:€|eur|\$|usd|£|gbp)"
    labelled = money(F.regexp_extract(text, rf"(?iu)\b(?:{'|'.join(PRICE_LABELS)})\s*[:\-]\s*(?:{sign}\s*)?{number}", 1))
    in_meta = money(F.coalesce(F.element_at(meta, "price"), F.element_at(meta, "product:price:amount"), F.element_at(meta, "og:price:amount")))
    current = F.filter(prices, lambda p: ~_any(norm(F.concat_ws(" ", p["marks"], p["value"])), OLD_PRICE))
    shown = _first(F.transform(current, lambda p: money(p["value"])))
    amounts = F.regexp_extract_all(text, F.lit(rf"(?iu).{{0,{BEFORE}}}?(?:{sign}\s*[0-9][0-9 .,]*|[0-9][0-9 .,]*\s*{sign})"), F.lit(0))
    in_text = _first(F.transform(F.filter(amounts, lambda x: ~_any(norm(x), OLD_PRICE)), lambda x: money(F.regexp_extract(x, rf"(?iu)(?:{sign}\s*([0-9][0-9 .,]*)|([0-9][0-9 .,]*)\s*{sign})$", 0))))
    return candidate_price(F.filter(F.array(labelled, in_meta, shown, in_text), lambda x: x.isNotNull()))


def html_size(text: Column, sizes: Column, title: Column) -> Column:
    """struct<value, origin>: the size in ml after a label, of a size element, in the text, or in the title."""
    labelled = index_size_ml(F.regexp_extract(text, rf"(?iu)\b(?:{'|'.join(SIZE_LABELS)})\s*[:\-]?\s*([0-9]+(?:[.,][0-9]+)?\s*(?:ml|cl))\b", 1))
    on_page = F.coalesce(labelled, _first(F.transform(sizes, index_size_ml)), index_size_ml(text))
    in_title = index_size_ml(title)
    return F.struct(F.coalesce(on_page, in_title).alias("value"), F.when(on_page.isNotNull(), "product_page").when(in_title.isNotNull(), "product_text").alias("origin"))


def html_availability(controls: Column, stock: Column, said: Column) -> Column:
    """struct<value, origin>: a control to buy that works proves stock, then data that
    says so, then a control that is off, then data against it, then a preorder."""
    buys = F.filter(controls, lambda c: _any(c["label"], PURCHASE_WORDS + PURCHASE_MARKERS))
    works, off = F.exists(buys, lambda c: ~c["off"]), F.exists(buys, lambda c: c["off"])
    says = F.lower(F.coalesce(said, F.lit("")))
    yes = _any(says, SAYS_IN_STOCK) | F.exists(stock, lambda s: _any(s, SAYS_IN_STOCK))
    no = (_any(says, SAYS_OUT_OF_STOCK) & ~_any(says, SAYS_IN_STOCK)) | F.exists(stock, lambda s: _any(s, SAYS_OUT_OF_STOCK))

    def found(value: str, origin: str) -> Column:
        return F.struct(F.lit(value).alias("value"), F.lit(origin).alias("origin"))

    return (
        F.when(works, found("in_stock", "purchase_control")).when(yes, found("in_stock", "html_availability")).when(off, found("out_of_stock", "purchase_control"))
        .when(no, found("out_of_stock", "html_availability")).when(says.contains("preorder"), found("preorder", "jsonld")).otherwise(found("unknown", "html_availability"))
    )


def raw_offers(pages: DataFrame) -> DataFrame:
    """A raw offer per page (url, html) that names a product with a price: name, brand,
    price, currency, availability, size_ml, concentration, url, image, identifiers, and
    where price, size and availability come from. normalized() takes these rows."""
    return page_rows(pages).filter("_told").drop("_told")


def page_rows(pages: DataFrame) -> DataFrame:
    """raw_offers() of all pages, with _told: whether the page names a product with a price. Where these rows are
    written, a filter on it afterwards isn't pushed below the rules, which would run them twice."""
    p = with_evidence(pages).withColumn("_product", F.try_parse_json(F.get("products", F.lit(0))))
    title = F.coalesce(_text_of(F.col("_product"), "$.name"), F.col("h1"), F.col("title"))
    p = p.withColumn("_offers", offers_of(F.col("_product")))
    p = p.withColumn("_offer", offer_of_page(F.col("_offers"), F.col("url"), title))
    product, offer, meta = F.col("_product"), F.col("_offer"), F.col("meta")
    name = F.coalesce(_text_of(product, "$.name"), filled(F.col("h1"), F.element_at(meta, "og:title"), F.col("title")))
    brand = F.coalesce(_text_of(product, "$.brand.name", "$.brand"), filled(F.element_at(meta, "product:brand"), F.element_at(meta, "brand"), F.element_at(meta, "og:brand")))
    image = F.coalesce(_text_of(product, "$.image.url", "$.image[0].url", "$.image[0]", "$.image"), filled(F.element_at(meta, "og:image")), F.get("images", F.lit(0)))
    said = _text_of(offer, "$.availability")
    p = p.withColumns({"_name": name, "_ld_price": money(_text_of(offer, "$.price", "$.lowPrice", "$.priceSpecification.price"))})
    p = p.withColumns({"_html_price": F.when(F.col("_ld_price").isNull(), html_price(F.col("text"), meta, F.col("prices"))), "_size": html_size(F.col("text"), F.col("sizes"), F.col("_name")), "_stock": html_availability(F.col("controls"), F.col("stock"), said)})
    price = F.coalesce(F.col("_ld_price"), F.col("_html_price"))
    origin = F.map_from_arrays(
        F.array(F.lit("price"), F.lit("size_ml"), F.lit("availability")),
        F.array(F.when(F.col("_ld_price").isNotNull(), "jsonld").otherwise("html"), F.col("_size.origin"), F.col("_stock.origin")),
    )
    told = F.coalesce(filled(F.col("_name")).isNotNull() & (price > 0), F.lit(False))
    return p.select(
        *(c for c in pages.columns if c not in ("html", "url", *FIELDS)), F.col("_name").alias("name"), brand.alias("brand"), price.cast("string").alias("price"),
        F.coalesce(_text_of(offer, "$.priceCurrency"), filled(F.element_at(meta, "product:price:currency")), F.lit("EUR")).alias("currency"),
        F.col("_stock.value").alias("availability"), F.col("_size.value").cast("string").alias("size_ml"), F.lower(concentration(F.col("_name"))).alias("concentration"), gender(F.col("_name")).alias("gender"),
        "url", absolute(image, F.col("url")).alias("image"), gtin(_text_of(product, "$.gtin13", "$.gtin", "$.gtin14", "$.gtin12", "$.gtin8")).alias("gtin"),
        _text_of(product, "$.mpn").alias("mpn"), _text_of(product, "$.sku", "$.productID").alias("sku"), origin.alias("provenance"), told.alias("_told"),
    )


def link_candidates(pages: DataFrame) -> DataFrame:
    """Links of search pages as candidates: the page's columns, url (absolute, without query and
    fragment, each once per page), position, label and card (the text of the first element around the link with a price)."""
    kept = [c for c in pages.columns if c not in ("html", "url", *FIELDS)]
    rows = listing(pages.select(*kept, "url", "html"), *kept)
    return with_cards(link_rows(rows, *kept), rows, *kept).select(*kept, "page", "url", "position", "label", "card")


def card_offers(candidates: DataFrame) -> DataFrame:
    """Raw offers made of search cards, for candidates (url, label, card) whose pages
    can't be had: the name, price and stock that the card shows. Without a price none."""
    c = F.col("card")
    rows = candidates.withColumns({"name": F.coalesce(F.nullif(card_name(F.col("label")), F.lit("")), card_name(c)), "price_cents": page_price(c), "availability": card_stock(c)})
    return rows.filter(F.col("price_cents").isNotNull() & (F.col("name") != "")).withColumn("price", (F.col("price_cents") / 100).cast("string")).drop("price_cents")
