"""Classes of offers: concentration, availability, audience, and the reason to reject."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlane.functions.measures import small_size
from offerlane.functions.text import norm, norm_text, query_tokens
from offerlane.vocabulary import AUDIENCES, AVAILABILITY_RANK, CONCENTRATIONS, GENERIC_WORDS, NAME_CONCENTRATIONS, NON_PERFUME


def concentration(text: Column) -> Column:
    """The first concentration that the text names, in a fixed order, or null."""
    t = norm(text)
    return F.coalesce(*(F.when(t.rlike(pattern), F.lit(label)) for label, pattern in CONCENTRATIONS))


def gender(text: Column) -> Column:
    """For whom a product is by the words of a text, or unknown."""
    t = norm(text)
    return F.coalesce(*(F.when(t.rlike(rf"\b(?:{'|'.join(words)})\b"), F.lit(label)) for label, words in AUDIENCES), F.lit("unknown"))


def availability(text: Column, available: Column | None = None) -> Column:
    """Normalised availability; without text the flag decides; unknown without either."""
    own = F.nullif(norm(text), F.lit(""))
    flag = F.when(available, "in stock").when(~available, "out of stock") if available is not None else F.lit(None).cast("string")
    return F.coalesce(own, flag, F.lit("unknown"))


def availability_rank(value: Column) -> Column:
    return F.coalesce(*(F.when(value == k, F.lit(r)) for k, r in AVAILABILITY_RANK.items()), F.lit(3))


def challenge(html: Column, markers: tuple[str, ...] = ("captcha", "cf-chl", "access denied", "just a moment", "verify you are human")) -> Column:
    """Whether a page is a check for robots."""
    return F.exists(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(F.lower(html), m))


def without_generic(name: Column) -> Column:
    """A normalised name without sizes, concentrations and generic words."""
    t = F.regexp_replace(name, r"\b[0-9]+(?:[.,][0-9]+)?\s*(?:ml|cl)\b", " ")
    t = F.regexp_replace(t, rf"\b(?:{'|'.join(NAME_CONCENTRATIONS)})\b".replace(" ", r"\s+"), " ")
    return F.array_join(F.filter(F.split(t, " +"), lambda w: (w != "") & ~w.isin(*GENERIC_WORDS)), " ")


def reject_reason(query: str, name: Column, size: Column, search_text: Column) -> Column:
    """Why an offer does not answer a query, or null if it does. name and
    search_text are normalised; the gates apply in this order."""
    q = norm_text(query)
    words = query_tokens(query)
    family = [w for w in words if w not in GENERIC_WORDS] or words
    phrases = sorted({norm_text(p) for p in NON_PERFUME})
    barred = [p for p in phrases if p not in q]
    has_size = bool(re.search(r"(?<![0-9])[0-9]+(?:[.,][0-9]+)?\s*(?:ml|cl)\b", q))
    own = without_generic(name)
    gates = F.when(F.lit(not q), "empty_query").when(name == "", "empty_product_name")
    if not has_size:
        gates = gates.when(F.coalesce(small_size(size, search_text), F.lit(False)), "small_size_without_query_size")
    gates = gates.when(F.exists(F.array(*(F.lit(p) for p in barred)), lambda p: F.contains(name, p)), "non_perfume_phrase")
    if not family:
        return gates.otherwise("empty_family_tokens")
    gates = gates.when(own == "", "empty_matching_phrase")
    return gates.when(~F.concat(F.lit(" "), own, F.lit(" ")).contains(f" {' '.join(family)} "), "family_phrase_not_in_name_phrase")
