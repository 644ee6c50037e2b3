"""Text functions as column expressions; none needs Python on executors but norm_strict()."""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlane.vocabulary import IGNORED_WORDS, LINE_CONCENTRATIONS, LINE_WORDS


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Characters whose compatibility form is one ASCII letter or digit, with that
    form; then combining marks, which go."""
    source, target, dropped = [], [], []
    for point in range(0x80, 0x10000):
        c = chr(point)
        if unicodedata.combining(c):
            dropped.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base.isalnum() and base.lower() == base:
            source.append(c)
            target.append(base)
    return "".join(source + dropped), "".join(target)


def _text(x: Column | str) -> Column:
    return F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(x: Column | str) -> Column:
    """Lower case, accents off, digits and letters parted, only a-z and 0-9, single blanks."""
    folded = F.translate(F.lower(_text(x)), *_folding())
    parted = F.regexp_replace(folded, "(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])", " ")
    return F.trim(F.regexp_replace(parted, "[^a-z0-9]+", " "))


def search_words(x: Column | str) -> Column:
    """Words as the search index has them: lower case, accents off, parted only where
    there is neither letter nor digit."""
    folded = F.translate(F.lower(_text(x)), *_folding())
    return F.filter(F.split(F.regexp_replace(folded, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def norm_text(x: str | None) -> str:
    """norm() of a driver-side string, such as a query."""
    folded = (x or "").strip().lower()
    if not folded.isascii():
        folded = "".join(c for c in unicodedata.normalize("NFKD", folded) if not unicodedata.combining(c))
    return " ".join(re.sub("[^a-z0-9]+", " ", re.sub("(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])", " ", folded)).split())


def norm_strict(x: Column | str) -> Column:
    """norm() with the full Unicode tables, for text with ligatures, fractions and the like."""

    @F.pandas_udf("string")
    def strict(s: pd.Series) -> pd.Series:
        return s.map(norm_text)

    return strict(_text(x))


def norm_ascii(x: Column | str) -> Column:
    """Lower case and only a-z and 0-9; an accented letter is a gap."""
    return F.trim(F.regexp_replace(F.lower(_text(x)), "[^a-z0-9]+", " "))


def compact(x: Column | str) -> Column:
    return F.replace(norm(x), F.lit(" "))


def clean(x: Column | str) -> Column:
    """Single blanks, none at the ends, whatever white space there was."""
    return F.trim(F.regexp_replace(_text(x), r"(?U)\s+", " "))


def filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns))


def stable_id(prefix: str, *parts: Column, size: int = 16) -> Column:
    """prefix-, then hex digits of the SHA-1 of the normalised parts."""
    key = F.concat_ws("::", *(norm(p) for p in parts))
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(key), 1, size))


def auto_id(brand: Column, name: Column) -> Column:
    """The id that the matcher makes of a brand and a name: 12 digits, where the index has 16."""
    return stable_id("SH-AUTO", brand, name, size=12)


def number_text(x: Column) -> Column:
    """A number without a trailing .0, as it stands in keys."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def tokens(x: Column, least: int = 1, without: tuple[str, ...] = ()) -> Column:
    """Words of normalised text, in order, of a least length and not in a list."""
    return F.filter(F.split(norm(x), " "), lambda t: (F.length(t) >= least) & ~t.isin(*without) if without else F.length(t) >= least)


def query_tokens(query: str) -> list[str]:
    """Words of a query that tell products apart: no descriptive words, no numbers."""
    return [t for t in norm_text(query).split() if t not in IGNORED_WORDS and not t.isdigit()]


def search_attempts(x: Column) -> Column:
    """What to search for, most exact first: the text, and its words without descriptive
    ones if that differs; nothing for text without letters and digits."""
    raw = F.trim(_text(x))
    full = norm(x)
    rest = F.array_join(F.filter(F.split(full, " "), lambda t: (t != "") & ~t.isin(*IGNORED_WORDS)), " ")
    return F.when(full == "", F.array().cast("array<string>")).when((rest == "") | (rest == full), F.array(raw)).otherwise(F.array(raw, rest))


def product_line(name: Column, vendor: Column) -> Column:
    """The line that a product name stands for: without its vendor, concentration,
    size and words for whom it is; the plain name if nothing is left."""
    plain, maker = norm_ascii(name), norm_ascii(vendor)
    line = F.when(maker == "", plain).otherwise(F.regexp_replace(plain, F.concat(F.lit(r"\b"), maker, F.lit(r"\b")), F.lit(" ")))
    line = F.regexp_replace(line, rf"\b(?:{'|'.join(LINE_CONCENTRATIONS)})\b", " ")
    line = F.regexp_replace(line, r"\b\d+(?:[.,]\d+)?\s*(?:ml|milliliters?|cl)\b", " ")
    line = F.regexp_replace(line, rf"\b(?:{'|'.join(LINE_WORDS)})\b", " ")
    line = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(line == "", plain).otherwise(line)


def url_key(url: Column) -> Column:
    """A URL without query and fragment, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(F.substring_index(_text(url), "#", 1), "?", 1)))


def url_name(url: Column) -> Column:
    """Words of the last path part of a URL."""
    path = F.regexp_replace(url_key(url), "^[a-z]+://[^/]*|/+$", "")
    return F.trim(F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^a-z0-9]+", " "))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(brand, product) that a product's URL names: the words of its first path part, and of its last one
    that isn't a number like p-123, without long numbers at its end; empty where there is one part only."""
    path = F.try_url_decode(F.regexp_replace(F.substring_index(F.substring_index(_text(url), "#", 1), "?", 1), "^[A-Za-z]+://[^/]*", ""))
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")
    last = F.element_at(parts, -1)
    slug = F.when(last.startswith("p-"), F.get(parts, F.size(parts) - 2)).otherwise(last)
    words = lambda x: F.trim(F.regexp_replace(x, "[-_ ]+", " "))
    many = F.size(parts) >= 2
    return F.when(many, words(F.get(parts, F.lit(0)))).otherwise(""), F.when(many, words(F.regexp_replace(slug, r"-\d{5,}$", ""))).otherwise("")


def same_host(url: Column, host: str) -> Column:
    """Whether a URL is on a host or below it."""
    own = F.regexp_replace(F.lower(F.regexp_extract(_text(url), "^[A-Za-z]+://([^/?#:]+)", 1)), r"^www\.", "")
    return (own == host) | own.endswith(f".{host}")


def encode_query(x: Column) -> Column:
    """URL-safe base 64 of a query, without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(x, "UTF-8")), "+/", "-_"), F.lit("="))


def decode_query(x: Column) -> Column:
    """The query in a job id: what follows the last dot."""
    code = F.translate(F.element_at(F.split(x, r"\."), -1), "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    return F.decode(F.unbase64(padded), "UTF-8")


def job_id(query: str, unique: str) -> str:
    return f"{unique}.{base64.urlsafe_b64encode(query.encode()).decode().rstrip('=')}"


