"""Rows of one key: keep the first or the last by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlane.functions import text
from offerlane.functions.text import number_text, url_key


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str], per: int = 1) -> DataFrame:
    """The first rows of each key. order must be total for a defined result. Rows
    beyond the first are cut before the shuffle (window group limit)."""
    rank = "_rank"
    while rank in df.columns:
        rank += "_"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= per).drop(rank)


def keep_last(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The last row of each key, as an upsert in order would leave it."""
    return keep_first(df, keys, [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order])


def identity_key(store: Column, name: Column, variant_id: Column, product_id: Column, gtin: Column, sku: Column, size: Column, concentration: Column, plain: bool = False) -> Column:
    """What tells offers of a store apart: the best identifier there is, tagged with its kind.
    plain: store, name and identifiers are in their normalised forms already, as where they were
    normalised once per store or product; a missing one is null."""
    as_is = lambda x: x
    norm, filled = (as_is, as_is) if plain else (text.norm, text.filled)
    variant, product, code, stock = (filled(c) for c in (variant_id, product_id, gtin, sku))
    s, n, none = norm(store), norm(name), F.lit("")

    def key(kind: str, *rest: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), s.alias("store"), *(c.alias(x) for x, c in zip("abc", [*rest, none, none])))

    return (
        F.when(variant.isNotNull(), key("variant", norm(variant)))
        .when(product.isNotNull(), key("product", norm(product), n))
        .when(code.isNotNull(), key("gtin", norm(code)))
        .when(stock.isNotNull(), key("sku", norm(stock)))
        .otherwise(key("fallback", n, F.coalesce(size.cast("string"), none), F.coalesce(concentration, none)))
    )


def offer_key(store: Column, identity: Column, size: Column, url: Column, plain: bool = False) -> Column:
    """What tells matched offers apart: store, product, size and the URL without query. plain: as for identity_key()."""
    own = [x if plain else text.norm(x) for x in (store, identity)]
    return F.struct(own[0].alias("store"), own[1].alias("identity"), F.coalesce(number_text(size), F.lit("")).alias("size"), url_key(url).alias("url"))


def position_in(df: DataFrame, keys: list[str], coarse: Column, order: list[Column | str], out: str) -> DataFrame:
    """df with the place of each row among those of its keys (from 0) by an order. coarse
    is any monotone step function of the order: rows are counted per step and sorted
    within it, so one key with very many rows is sorted in many tasks."""
    rows = df.withColumn("_step", coarse)
    before = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.groupBy(*keys, "_step").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    steps = steps.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_step").alias("_s"), "_before")
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_step").orderBy(*order)))
    same = F.col("_step").eqNullSafe(F.col("_s"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(steps, same).withColumn(out, (F.col("_before") + F.col("_in") - 1).cast("int")).drop("_step", "_s", "_before", "_in", *(f"_k{i}" for i in range(len(keys))))


def changes(df: DataFrame, keys: list[str], order: list[str], values: list[str], most: int | None = None) -> DataFrame:
    """Rows whose values differ from those of the row before them of the same key,
    the latest of them per key if most is given. Rows with a null first value are
    ignored."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.filter(F.col(values[0]).isNotNull())
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    rows = rows.withColumn("_changed", (F.row_number().over(w) == 1) | ~same).filter("_changed").drop("_changed")
    return keep_first(rows, keys, [F.col(o).desc() for o in order], most) if most else rows
