"""Command line: python -m offerlane build-index | search | offers | diagnose ..."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from offerlane.operators.store import ProductIndex, build_index
from offerlane.plans import diagnostics
from offerlane.plans.engine import Engine, refresh
from offerlane.sources.offers import RAW_SCHEMA, load_catalog, normalized


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="offerlane")
    parser.add_argument("--connectors", help="a module that registers connectors")
    parser.add_argument("--stores", type=lambda x: x.split(","), help="stores to ask, by commas (all registered ones without it)")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-index", help="an index of a catalog file and raw offers")
    build.add_argument("catalog"), build.add_argument("index"), build.add_argument("--offers", help="raw offers as JSON lines")
    again = commands.add_parser("refresh", help="offers of all stores for the products of a catalog")
    again.add_argument("catalog"), again.add_argument("index"), again.add_argument("--offset", type=int, default=0), again.add_argument("--limit", type=int)
    find = commands.add_parser("search", help="products of an index, or with --live offers of the stores")
    find.add_argument("query"), find.add_argument("--index"), find.add_argument("--live", action="store_true"), find.add_argument("--limit", type=int, default=20)
    offers = commands.add_parser("offers", help="offers of a product")
    offers.add_argument("index"), offers.add_argument("product_id"), offers.add_argument("--size", type=float)
    check = commands.add_parser("diagnose", help="what each store gives for a query")
    check.add_argument("query"), check.add_argument("path")
    return parser.parse_args(argv)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.connectors:
        importlib.import_module(a.connectors)
    if a.command == "build-index":
        offers = normalized(spark.read.schema(RAW_SCHEMA).json(a.offers)) if a.offers else None
        build_index(spark, a.catalog, offers, a.index).show()
    elif a.command == "refresh":
        print(refresh(Engine(spark, a.stores), ProductIndex(spark, a.index), load_catalog(spark, a.catalog, strict=True), a.offset, a.limit))
    elif a.command == "search":
        found = Engine(spark, a.stores).search_validated(a.query).drop("raw_json", "search_text") if a.live else ProductIndex(spark, a.index).search(a.query, a.limit)
        found.limit(max(1, a.limit)).show(truncate=False)
    elif a.command == "offers":
        ProductIndex(spark, a.index).get_offers(a.product_id, a.size).show(truncate=False)
    else:
        diagnostics.report(spark, a.query, a.path, a.stores).show(truncate=False)


if __name__ == "__main__":
    run(SparkSession.builder.appName("offerlane").getOrCreate(), arguments())
