"""Connectors: what gives raw offers of a store for a query.

There are three kinds. A connector makes a DataFrame for one query. A bulk connector makes
one for a table of attempts. A row connector is a function of one attempt that gives
rows; Spark runs it in tasks, so a table of queries of any size is one plan. Connectors read what
was fetched before (pages, JSON, tables)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from offerlane.functions.text import norm_text, search_attempts
from offerlane.sources.offers import RAW_SCHEMA
from offerlane.vocabulary import IGNORED_WORDS

Connector = Callable[[SparkSession, str], DataFrame]
_CONNECTORS: dict[str, Connector] = {}
_BULK: dict[str, Callable[[SparkSession, DataFrame], DataFrame]] = {}
_ROWS: dict[str, tuple[Callable[[str], Iterable[dict]], str]] = {}

#: Flat columns that a row connector can give.
ROW_FIELDS = [f.split()[0] for f in RAW_SCHEMA.split(", ") if f.endswith(" string") and "<" not in f] + ["available"]
ROW_SCHEMA = "ingest_ord bigint, " + ", ".join(f"{c} {'boolean' if c == 'available' else 'string'}" for c in ROW_FIELDS)


def connector(store: str):
    """Registers a function (spark, query) -> raw offers for a store."""

    def register(f: Connector) -> Connector:
        _CONNECTORS[store.strip().lower()] = f
        return f

    return register


def bulk_connector(store: str):
    """Registers a function (spark, attempts) -> raw offers for a store that answers a
    table of attempts (column attempt) at once; its rows carry the attempt they answer."""

    def register(f):
        name = store.strip().lower()
        _BULK[name] = f
        _CONNECTORS.setdefault(name, lambda spark, query: f(spark, spark.createDataFrame([(query,)], "attempt string")).drop("attempt"))
        return f

    return register


def row_connector(store: str):
    """Registers a function attempt -> dicts of ROW_FIELDS in order of arrival, to run in tasks. It
    must be of a module that tasks can import, or of the driver's own program."""

    def register(f):
        name = store.strip().lower()
        _ROWS[name] = (f, f.__module__)
        return bulk_connector(name)(lambda spark, attempts: _answered(attempts, f)) and f

    return register


def _raw_row(row: dict, at: int) -> tuple:
    """A row connector's row as a tuple of ROW_SCHEMA."""
    text = lambda x: None if x is None else str(x)
    return (at, *(row.get(c) if c == "available" else text(row.get(c)) for c in ROW_FIELDS))


def _answered(tried: DataFrame, f) -> DataFrame:
    """The rows that a row connector gives for a table of attempts, asked in tasks."""
    import pandas as pd

    names = ["attempt", "ingest_ord", *ROW_FIELDS]

    def ask(batches):
        for pdf in batches:
            found = [(attempt, *_raw_row(row, at)) for attempt in pdf["attempt"] for at, row in enumerate(f(attempt))]
            out = pd.DataFrame(found, columns=names, dtype=object)
            out["ingest_ord"] = out["ingest_ord"].astype("int64")
            yield out

    return tried.select("attempt").repartition("attempt").mapInPandas(ask, f"attempt string, {ROW_SCHEMA}")


def stores() -> list[str]:
    return list(_CONNECTORS)


def chosen(names: list[str] | None = None) -> list[str]:
    """Stores by their registered names, each once, in order."""
    return list(dict.fromkeys(s.strip().lower() for s in (names or stores())))


def load(store: str) -> Connector:
    found = _CONNECTORS.get(store.strip().lower())
    if found is None:
        raise LookupError(f"no connector for store {store!r}")
    return found


def attempts(query: str) -> list[str]:
    """What to search for, most exact first: the query, then its words without descriptive ones."""
    raw, full = (query or "").strip(), norm_text(query)
    if not full:
        return []
    rest = " ".join(w for w in full.split() if w not in IGNORED_WORDS)
    return [raw] + ([rest] if rest and rest != full else [])


def _of_store(rows: DataFrame, store: str, rank: int) -> DataFrame:
    """Rows with their store and its rank. A row that doesn't say in which order it came is an error."""
    missing = F.raise_error(F.lit(f"offers of {store!r} have no ingest_ord")).cast("bigint")
    rows = rows.withColumn("ingest_ord", F.coalesce(F.col("ingest_ord").cast("bigint"), missing) if "ingest_ord" in rows.columns else missing)
    return rows.withColumns({"store": F.coalesce("store", F.lit(store)) if "store" in rows.columns else F.lit(store), "store_rank": F.lit(rank)})


def gather(spark: SparkSession, query: str, store: str, rank: int = 0) -> DataFrame | None:
    """Raw offers of a store for all attempts of a query. Missing columns are null."""
    out = None
    for no, attempt in enumerate(attempts(query)):
        rows = _of_store(load(store)(spark, attempt), store, rank).withColumn("attempt_no", F.lit(no))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def gather_many(spark: SparkSession, jobs: DataFrame, store: str, rank: int = 0) -> DataFrame | None:
    """gather() for all queries of a table (column query): raw offers with the query
    that they answer. Bulk and row connectors answer in one plan; others are asked
    query by query, from a list of queries on the driver."""
    if store in _BULK:
        tried = jobs.select("query").distinct().select("query", F.posexplode(search_attempts(F.col("query"))).alias("attempt_no", "attempt"))
        return _of_store(_BULK[store](spark, tried.select("attempt").distinct()), store, rank).join(tried, "attempt").drop("attempt")
    f, out = load(store), None
    for (query,) in jobs.select("query").distinct().collect():
        for no, attempt in enumerate(attempts(query)):
            own = _of_store(f(spark, attempt), store, rank).withColumns({"query": F.lit(query), "attempt_no": F.lit(no)})
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


class _Attempt(InputPartition):
    def __init__(self, store: str, module: str, store_rank: int, attempt_no: int, attempt: str):
        self.store, self.module, self.store_rank, self.attempt_no, self.attempt = store, module, store_rank, attempt_no, attempt


class OfferSource(DataSource):
    """Raw offers of row connectors as a Spark data source: a partition per store and attempt.

    spark.dataSource.register(OfferSource); spark.read.format("store_offers")
    .option("query", ...).option("connectors", "module,module").option("stores", "a,b").load()

    connectors: modules that register the row connectors; stores: all of them without it.
    Filters store = ... and store in (...) are pushed down: other stores aren't asked."""

    @classmethod
    def name(cls) -> str:
        return "store_offers"

    def schema(self) -> str:
        return f"store_rank int, attempt_no int, attempt string, {ROW_SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return OfferReader(self.options)


class OfferReader(DataSourceReader):
    def __init__(self, options):
        for module in filter(None, (options.get("connectors") or "").split(",")):
            import_module(module.strip())
        self.query = options.get("query") or ""
        asked = options.get("stores")
        self.stores = chosen(asked.split(",")) if asked else list(_ROWS)
        self.ranks = {s: k for k, s in enumerate(self.stores)}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("store",):
                self.stores = [s for s in self.stores if s == f.value]
            elif isinstance(f, In) and f.attribute == ("store",):
                self.stores = [s for s in self.stores if s in f.value]
            else:
                yield f

    def partitions(self):
        unknown = [s for s in self.stores if s not in _ROWS]
        if unknown:
            raise LookupError(f"no row connector for {', '.join(unknown)}")
        return [_Attempt(s, _ROWS[s][1], self.ranks[s], no, attempt) for s in self.stores for no, attempt in enumerate(attempts(self.query))]

    def read(self, partition):
        if partition is None:
            return
        if partition.store not in _ROWS:
            import_module(partition.module)
        f, _ = _ROWS[partition.store]
        at_store = ROW_FIELDS.index("store") + 1
        for at, row in enumerate(f(partition.attempt)):
            raw = list(_raw_row(row, at))
            raw[at_store] = partition.store  # what filters on the store are pushed down for
            yield (partition.store_rank, partition.attempt_no, partition.attempt, *raw)
