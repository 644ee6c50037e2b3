"""Prices, sizes and identifiers as column expressions. Money is in whole cents
where rows are compared, as binary rounding differs between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlane.functions.text import clean


def _number(text: Column) -> Column:
    return F.nullif(F.replace(text, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def price_num(text: Column) -> Column:
    """The first number of up to five digits; thousands separators are not known."""
    return _number(F.regexp_extract(F.coalesce(text.cast("string"), F.lit("")), r"([0-9]{1,5}(?:[.,][0-9]{1,2})?)", 1))


def parse_price(text: Column) -> Column:
    """The first number in a price text."""
    return _number(F.regexp_extract(clean(text), r"([0-9]+(?:[.,][0-9]{1,2})?)", 1))


def money(text: Column) -> Column:
    """An amount whose last separator is the decimal one."""
    kept = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^0-9,.\-]", "")

    def plain(x: Column) -> Column:
        comma, dot = F.instr(F.reverse(x), ","), F.instr(F.reverse(x), ".")
        both = (comma > 0) & (dot > 0)
        dots_off = F.replace(F.replace(x, F.lit(".")), F.lit(","), F.lit("."))
        return F.when(both & (comma < dot), dots_off).when(both, F.replace(x, F.lit(","))).otherwise(F.replace(x, F.lit(","), F.lit(".")))

    # bound once, as it is used many times
    return F.nullif(F.get(F.transform(F.array(kept), plain), F.lit(0)), F.lit("")).try_cast("double")


def cents(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5).cast("bigint")


def euro_text(cents_: Column) -> Column:
    """Cents as a text with decimal comma and sign."""
    return F.concat((cents_.cast("bigint") - cents_ % 100).__truediv__(100).cast("bigint").cast("string"), F.lit(","), F.lpad((cents_ % 100).cast("string"), 2, "0"), F.lit(" €"))


def actual_price(price: Column, size_ml: Column) -> Column:
    """The price of the whole product where the text is a price per 100 ml, else null."""
    unit = price_num(F.regexp_extract(price, r"(?iu)^(.*?)(?:/|per\s*)100\s*ml", 1))
    return F.when(price.rlike(r"(?iu)(?:/|per\s*)100\s*ml") & (size_ml > 0), F.floor(unit * size_ml + 0.5) / 100)


def _unit(number: Column, unit: Column, factors: dict[str, float]) -> Column:
    factor = F.coalesce(*(F.when(unit == u, F.lit(f)) for u, f in factors.items()))
    return _number(number) * factor


def size_ml(text: Column) -> Column:
    """Size in ml by the search rule: ml or cl after a number at a word start."""
    pattern = r"(?i)\b([0-9]{1,4}(?:[.,][0-9]+)?)\s*(ml|cl)\b"
    t = F.coalesce(text, F.lit(""))
    return _unit(F.regexp_extract(t, pattern, 1), F.lower(F.regexp_extract(t, pattern, 2)), {"ml": 1.0, "cl": 10.0})


def index_size_ml(text: Column) -> Column:
    """Size in ml by the index rule: ml, cl or l after a number."""
    pattern = r"(?i)(?<![0-9])([0-9]+(?:[.,][0-9]+)?)\s*(ml|cl|l)\b"
    t = clean(text)
    return _unit(F.regexp_extract(t, pattern, 1), F.lower(F.regexp_extract(t, pattern, 2)), {"ml": 1.0, "cl": 10.0, "l": 1000.0})


def offer_size(explicit: Column, text: Column) -> Column:
    """An explicit size where there is one, else that in the text."""
    return F.coalesce(_number(explicit.cast("string")), size_ml(text))


def small_size(size: Column, search_text: Column) -> Column:
    """Whether the size, or without one any ml number in the text, is that of a sample."""
    found = F.regexp_extract_all(search_text, F.lit(r"(?<![0-9])([0-9]+(?:[.,][0-9]+)?)\s*ml\b"), F.lit(1))
    return F.when(size.isNotNull(), size <= 10).otherwise(F.exists(found, lambda x: F.coalesce(_number(x) <= 10, F.lit(False))))


def gtin(x: Column) -> Column:
    """The digits of an article number; null without any."""
    return F.nullif(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), "[^0-9]", ""), F.lit(""))
