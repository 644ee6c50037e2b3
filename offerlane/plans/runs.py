"""A search at all stores at once, each on its own.

Every store has a thread, a job group and a table of its own. It reads its offers and
writes them below the folder of the run; what fails there, while the plan is made or
while it runs, is that store's error, and the other stores go on. At the deadline the
jobs of stores that aren't done are cancelled. A store counts as done by its row in the
table of states, which is written after its offers, so a reader at any time
sees the whole offers of the stores that are done, and nothing of the others.

Defined cases: a store without offers is done with none; a store that is not known
fails; offers without an order of arrival (ingest_ord) fail, as "first wins" would
depend on chance; what a store still writes after its deadline is not read.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.sources.storage import remove, shared_folder, until_exit

#: Seconds that a search takes at most.
SECONDS = 120.0
STATES = "store string, store_rank int, state string, error string, seconds double, path string"
DONE, FAILED, LATE, RUNNING = "done", "failed", "late", "running"


class StoreRun:
    """Reads stores side by side. readers: a function per store, in order of the stores,
    that gives its rows; each row's columns are those of schema."""

    def __init__(self, spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], schema, seconds: float = SECONDS, folder: str | None = None):
        self.spark, self.readers, self.schema, self.seconds = spark, readers, schema, seconds
        self.folder = folder or f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self.ranks = {store: k for k, store in enumerate(readers)}
        self.done: dict[str, tuple] = {}
        self.lock, self.all_done = threading.Lock(), threading.Event()
        self.began: float | None = None

    def start(self) -> StoreRun:
        """Starts all stores; what they write goes when the application ends."""
        self.began = time.monotonic()
        until_exit(self.spark, self.folder)
        if not self.readers:
            self.all_done.set()
        self.timer = threading.Timer(self.seconds, self.cancel)
        self.timer.daemon = True
        self.timer.start()
        for store in self.readers:
            InheritableThread(target=self._read, args=(store,), daemon=True).start()
        return self

    def _group(self, store: str) -> str:
        return f"{self.folder}#{self.ranks[store]}"

    def _read(self, store: str) -> None:
        path = f"{self.folder}/offers-{self.ranks[store]}"
        # no interrupts: they can reach what the same executor thread does next; Spark ends Python workers of cancelled tasks by itself
        self.spark.sparkContext.setJobGroup(self._group(store), f"offers of {store}")
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", self._group(store))  # stores share the cluster where the scheduler is fair
        try:
            rows = self.readers[store]()
            rows.write.mode("overwrite").parquet(path)
        except Exception as e:
            self._settle(store, FAILED, _short(e))
        else:
            self._settle(store, DONE, path=path)

    def _settle(self, store: str, state: str, error: str | None = None, path: str | None = None) -> None:
        """Says once how a store ended."""
        with self.lock:
            if store in self.done:
                return
            row = (store, self.ranks[store], state, error, round(time.monotonic() - self.began, 3), path)
            self.spark.createDataFrame([row], STATES).coalesce(1).write.mode("append").json(f"{self.folder}/states")
            self.done[store] = row
            if len(self.done) == len(self.readers):
                self.timer.cancel()
                self.all_done.set()

    def cancel(self) -> None:
        """Ends the run, at its deadline or before: the jobs of stores that aren't done are cancelled."""
        for store in self.readers:
            if store not in self.done:
                self._settle(store, LATE, f"not done in {round(time.monotonic() - self.began, 1):g} seconds")
                self.spark.sparkContext.cancelJobGroup(self._group(store))

    def wait(self, seconds: float | None = None) -> bool:
        """Waits until all stores are done, have failed or are late; whether they are."""
        return self.all_done.wait(seconds)

    @property
    def completed(self) -> bool:
        return self.all_done.is_set()

    def states(self) -> DataFrame:
        """A row per store: store, store_rank, state, error, seconds."""
        now = round(time.monotonic() - self.began, 3)
        rows = [self.done.get(s, (s, k, RUNNING, None, now, None)) for s, k in self.ranks.items()]
        return self.spark.createDataFrame(rows, STATES).drop("path")

    def errors(self) -> dict[str, str]:
        """The errors of stores that failed or were late."""
        return {s: row[3] for s, row in sorted(self.done.items(), key=lambda x: x[1][1]) if row[2] != DONE}

    def rows(self) -> DataFrame:
        """The rows of the stores that are done now."""
        return read_rows(self.spark, [row[5] for row in self.done.values() if row[2] == DONE], self.schema)

    def remove(self) -> None:
        """Ends the run and removes what it wrote."""
        self.cancel()
        remove(self.spark, self.folder)


def read_rows(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*sorted(paths)) if paths else spark.createDataFrame([], schema)


def written_run(spark: SparkSession, folder: str, schema) -> tuple[DataFrame, DataFrame] | None:
    """(rows, states) that a run at folder has written so far, also for another driver; None if there is none."""
    try:
        states = spark.read.schema(STATES).json(f"{folder}/states")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    paths = [r.path for r in states.filter(F.col("state") == DONE).select("path").collect()]  # a row per store
    return read_rows(spark, paths, schema), states.drop("path")


def _short(e: Exception) -> str:
    """The first line of an error, of Java's if it comes from there."""
    text = str(e.java_exception) if hasattr(e, "java_exception") else str(e)
    return next((x.strip() for x in text.splitlines() if x.strip()), type(e).__name__)[:500]
