"""Offers to catalog products: by identifiers first, then by names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.functions.text import compact, norm, number_text
from offerlane.operators.dedup import keep_last
from offerlane.sources.storage import kept, shared_folder, until_exit

#: Score from which names match; from which they count as exact; share of a score that the brand gives.
MATCH, EXACT, BRAND, OTHER, CONTAINED = 0.86, 0.94, 0.45, 0.95, 0.92
#: Names listed under a word that one task compares with an offer.
LISTED = 1024
#: Scores of the identifier tiers, in order.
TIERS = (("gtin", 1.0), ("mpn", 0.99), ("catalog_id", 0.98))


def by_identifier(offers: DataFrame, catalog: DataFrame, key: str, offer_col: str, catalog_col: str, catalog_key: str = "product_id", last: list | None = None) -> DataFrame:
    """The product of each offer whose identifier is equal in compact form: key and product_id. An identifier of several products
    finds none of them, or, if an order is given, the last. The catalog's column can
    be an array of identifiers."""
    tier = "catalog_id" if last else "gtin"
    return by_tiers(offers, catalog, key, {tier: (offer_col, catalog_col)}, last, catalog_key).select(key, "product_id")


def by_tiers(offers: DataFrame, catalog: DataFrame, key: str, tiers: dict[str, tuple[str, str]], last: list | None = None, catalog_key: str = "product_id") -> DataFrame:
    """The first tier in TIERS that finds a product: key, product_id, method, score.

    Identifiers of all tiers, each with its tier, meet in one join; the columns of either side can be arrays of identifiers. An identifier of several
    products finds none of them, but of equal catalog ids the last counts, if its order is given (last)."""

    def tagged(df: DataFrame, column: str, tier: int) -> Column:
        many = df.schema[column].dataType.typeName() == "array"
        values = F.col(column) if many else F.array(column)
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(tier).alias("tier"), compact(x.cast("string")).alias("identifier")))

    used = [(rank, *tiers[method]) for rank, (method, _) in enumerate(TIERS) if method in tiers]
    order = F.struct(*last) if last else F.lit(None)
    known = catalog.select(F.col(catalog_key).alias("product_id"), order.alias("_order"), F.explode(F.concat(*(tagged(catalog, c, rank) for rank, _, c in used))).alias("x"))
    known = known.filter("x.identifier <> ''").groupBy("x.tier", "x.identifier").agg(F.min("product_id").alias("low"), F.max("product_id").alias("high"), F.max_by("product_id", "_order").alias("latest"))
    by_order = (F.col("tier") == [m for m, _ in TIERS].index("catalog_id")) & F.lit(bool(last))
    known = known.filter((F.col("low") == F.col("high")) | by_order).select("tier", "identifier", F.when(by_order, F.col("latest")).otherwise(F.col("low")).alias("product_id"))
    asked = offers.select(key, F.explode(F.array_distinct(F.concat(*(tagged(offers, c, rank) for rank, c, _ in used)))).alias("x")).filter("x.identifier <> ''").select(key, "x.tier", "x.identifier")
    best = asked.join(known, ["tier", "identifier"]).groupBy(key).agg(F.min(F.struct("tier", "product_id")).alias("x"))
    named = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(score).alias("score")) for m, score in TIERS))
    return best.select(key, "x.product_id", F.get(named, F.col("x.tier")).alias("t")).select(key, "product_id", "t.method", "t.score")


def name_score(name, brand, candidate, candidate_brand):
    """Likeness of two names and brands (normalised) from 0 to 1."""
    a, b = F.array_distinct(F.split(name, " ")), F.array_distinct(F.split(candidate, " "))
    common = F.size(F.array_intersect(a, b))
    f = 2.0 * common / (F.size(a) + F.size(b))
    inside = F.concat(F.lit(" "), name, F.lit(" ")).contains(F.concat(F.lit(" "), candidate, F.lit(" ")))
    best = F.when(name == candidate, 1.0).when(inside, F.greatest(f, F.lit(CONTAINED))).otherwise(f)
    return F.when((brand == candidate_brand) & (brand != ""), BRAND + (1 - BRAND) * best).otherwise(OTHER * best)


#: Words in an n-word name that can be missing on either side of a pair, and the share of the words of both sides that it must have in common.
_LEAST = {"same": (MATCH - BRAND) / (1 - BRAND), "other": MATCH / OTHER}


def _ordered(names: DataFrame, frequency: DataFrame) -> DataFrame:
    """name, words: the distinct words of each name, rarest first, in one order of all words."""
    words = names.select("name").distinct().select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    ranked = words.join(frequency, "word", "left").groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("ranked"))
    return ranked.select("name", F.col("ranked.word").alias("words"))


def with_words(asked: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with words, the distinct words of their names, rarest among the known names first. Names are distinct by brand."""
    words = known.select("name").distinct().select(F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    frequency = words.groupBy("word").agg(F.count("*").alias("n"))
    return asked.join(_ordered(asked, frequency), "name"), known.join(_ordered(known, frequency), "name")


def name_pairs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of names and brands that can score MATCH: o_name, o_brand, c_name, c_brand.

    asked, known: name, brand, words, as with_words() gives them. A pair scores MATCH if the known name is contained in the other, or if
    2 * common / (sizes) is at least t: about 0.745 with one brand, 0.905 with two.

    Contained names are found by equality: each run of words of an asked name, of the lengths that
    known names have, is looked up. The others share a word among their first n - ceil(n * t / (2 - t)) + 1
    words in order of rarity, on both sides; sizes must be within t / (2 - t) of each other, and
    the words from the shared one on must be enough (length and position filters). With one brand the brand is part of the key. A word with more than
    LISTED known names is parted into salted blocks."""
    o = asked.select(F.col("name").alias("o_name"), F.col("brand").alias("o_brand"), F.col("words").alias("o_words"))
    c = known.select(F.col("name").alias("c_name"), F.col("brand").alias("c_brand"), F.col("words").alias("c_words"))

    def listed(rows: DataFrame, side: str, t: float) -> DataFrame:
        n = F.size(f"{side}_words")
        prefix = F.slice(f"{side}_words", F.lit(1), n - F.ceil(n * (t / (2 - t)) - 1e-9).cast("int") + 1)
        return rows.select(f"{side}_name", f"{side}_brand", n.alias(f"{side}_n"), F.posexplode(prefix).alias(f"{side}_at", "word"))

    found = None
    for kind, t in _LEAST.items():
        left, right, keys = listed(o, "o", t), listed(c, "c", t), ["word"]
        if kind == "same":
            left, right, keys = left.filter("o_brand <> ''").withColumn("own_brand", F.col("o_brand")), right.withColumn("own_brand", F.col("c_brand")), ["word", "own_brand"]
        salts = right.groupBy(*keys).agg(F.ceil(F.count("*") / LISTED).cast("int").alias("salts"))
        right = right.join(salts, keys).withColumn("salt", F.pmod(F.xxhash64("c_name", "c_brand"), F.col("salts")).cast("int")).drop("salts")
        left = left.join(salts, keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        near = (F.col("o_n") * (t / (2 - t)) <= F.col("c_n") + 1e-9) & (F.col("c_n") * (t / (2 - t)) <= F.col("o_n") + 1e-9)
        enough = 1 + F.least(F.col("o_n") - F.col("o_at"), F.col("c_n") - F.col("c_at")) - 1 >= (F.col("o_n") + F.col("c_n")) * (t / 2) - 1e-9
        own = left.join(right, [*keys, "salt"]).filter(near & enough)
        own = own.filter("o_brand <> c_brand or o_brand = ''") if kind == "other" else own
        own = own.select("o_name", "o_brand", "c_name", "c_brand")
        found = own if found is None else found.unionByName(own)

    sizes = [r.k for r in known.select(F.size(F.split("name", " ")).alias("k")).distinct().orderBy("k").collect()]  # lengths of names in words, few
    lengths = F.explode(F.array(*(F.lit(k) for k in sizes)).cast("array<int>"))
    runs = asked.select("name", F.split("name", " ").alias("w")).distinct().withColumn("k", lengths).filter(F.size("w") >= F.col("k"))
    runs = runs.select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " ")))).alias("c_name"))
    inside = runs.join(c.select("c_name", "c_brand"), "c_name").join(o.select(F.col("o_name").alias("name"), "o_brand"), "name").select(F.col("name").alias("o_name"), "o_brand", "c_name", "c_brand")
    return found.unionByName(inside).distinct()


def by_name(offers: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """The best product for each offer by name_score, ties to the smallest id.

    offers: key, name, brand; catalog: product_id, name, brand, a row per name or
    alias of a product (all normalised). Names and brands are compared once, however many
    offers and products have them; name_pairs() tells which."""
    folder = until_exit(offers.sparkSession, f"{shared_folder(offers.sparkSession)}/names-{uuid.uuid4().hex}")
    o = kept(offers.select(F.col(key).alias("key"), "name", F.coalesce("brand", F.lit("")).alias("brand")).filter(F.col("name") != ""), f"{folder}/offers")
    c = catalog.select("product_id", "name", F.coalesce("brand", F.lit("")).alias("brand")).filter(F.col("name") != "")
    known = kept(c.groupBy("name", "brand").agg(F.min("product_id").alias("product_id")), f"{folder}/catalog")
    asked, words = (kept(rows, f"{folder}/words-{k}") for k, rows in enumerate(with_words(o.select("name", "brand").distinct(), known)))
    score = name_score(F.col("o_name"), F.col("o_brand"), F.col("c_name"), F.col("c_brand"))
    pairs = name_pairs(asked, words).withColumn("score", score).filter(F.col("score") >= MATCH)
    pairs = pairs.join(known.select(F.col("name").alias("c_name"), F.col("brand").alias("c_brand"), "product_id"), ["c_name", "c_brand"])
    best = pairs.groupBy("o_name", "o_brand").agg(F.min(F.struct((-F.col("score")).alias("less"), "product_id")).alias("x"))
    found = o.join(best, (F.col("name") == F.col("o_name")) & (F.col("brand") == F.col("o_brand"))).select("key", F.col("x.product_id").alias("product_id"), (-F.col("x.less")).alias("score"))
    return found.select(F.col("key").alias(key), "product_id", F.when(F.col("score") >= EXACT, "exact_name").otherwise("token_score").alias("method"), "score")


def best_match(offers: DataFrame, catalog: DataFrame, key: str, last: list | None = None) -> DataFrame:
    """The product of each offer: by identifiers, and by name for offers that these
    don't resolve. offers: key, gtin, mpn, catalog_id, name, brand. catalog:
    product_id, catalog_id, gtins, mpns (arrays), name, brand, aliases (array). Names
    are normalised. Gives key, product_id, method, score of the offers that match."""
    found = by_tiers(offers, catalog, key, {"gtin": ("gtin", "gtins"), "mpn": ("mpn", "mpns"), "catalog_id": ("catalog_id", "catalog_id")}, last)
    found = kept(found, f"{until_exit(offers.sparkSession, f'{shared_folder(offers.sparkSession)}/matches-{uuid.uuid4().hex}')}/by-identifier")
    rest = offers.join(found.select(key), key, "left_anti")
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return found.unionByName(by_name(rest, catalog.select("product_id", F.explode(names).alias("name"), "brand"), key))


def offers_for_matching(offers: DataFrame, key: str) -> DataFrame:
    """Normalised offers with the columns that best_match() reads: name and brand in their
    normalised forms. All their columns stay; shown names go to shown_name and shown_brand."""
    return offers.withColumns({"shown_name": F.col("name"), "shown_brand": F.col("brand"), "name": F.col("name_n"), "brand": F.coalesce("brand_n", F.lit(""))}).filter(F.col(key).isNotNull())


def catalog_for_matching(catalog: DataFrame) -> DataFrame:
    """A loaded catalog (product_id, brand_name, family_name, aliases; gtins, mpns, formats_ml if it has them) as
    best_match() and attach_matches() read it."""
    strings = F.array().cast("array<string>")
    own = lambda c: F.coalesce(F.col(c), strings) if c in catalog.columns else strings
    forms = F.filter(F.transform(own("aliases"), norm), lambda x: x != "")
    return catalog.select(
        "product_id", F.col("product_id").alias("catalog_id"), own("gtins").alias("gtins"), own("mpns").alias("mpns"), norm("family_name").alias("name"),
        norm("brand_name").alias("brand"), forms.alias("aliases"), F.col("brand_name").alias("canonical_brand"), F.col("family_name").alias("canonical_name"),
    )


def attach_matches(offers: DataFrame, catalog: DataFrame, key: str, last: list | None = None) -> DataFrame:
    """The offers that match a product, as they are, with catalog_id, canonical_brand,
    canonical_name, match_method, match_score, product_identity and variant_id (of
    product and size). catalog: as for best_match(), with the names to show in
    canonical_brand and canonical_name."""
    found = best_match(offers, catalog, key, last)
    shown = keep_last(catalog, ["product_id"], last or ["canonical_brand", "canonical_name"]).select("product_id", F.col("catalog_id").alias("_catalog_id"), "canonical_brand", "canonical_name")
    rows = offers.join(found, key).join(shown, "product_id").drop("product_id")
    made = {"catalog_id": F.col("_catalog_id"), "product_identity": F.col("_catalog_id"), "match_method": F.col("method"), "match_score": F.round("score", 4)}
    size = F.when(F.col("size_ml").isNotNull(), F.concat(F.lit(":"), number_text(F.col("size_ml")))).otherwise("")
    return rows.withColumns(made).withColumn("variant_id", F.concat("catalog_id", size)).drop("_catalog_id", "method", "score")
