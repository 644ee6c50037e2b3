"""Price history that is kept: a table with the last points of each key, updated batch by batch.

A key is a row with its points in order of time, at most MOST of them. An update compares new points
with the last one that is kept, and with each other; sorting is Spark's, so a key with very many
points in a batch spills and is never held in memory. Buckets that have new points are rewritten, each kept row
being moved once and written once, with the number of the batch in the same commit, so a batch that is run
again changes nothing.

Defined cases: points without a value are ignored; a point older than the last kept one of its key is late
and left out; points of one time are taken in order of value and store; a null key is a key of its own; an
empty batch changes nothing but the number of the batch. One writer updates a history at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlane.operators.versions import BUCKETS, VersionedTable

#: Points kept per key.
MOST = 100
_LIST = "array<struct<ts:timestamp,value:double,store:string>>"
POINTS = f"key string, points {_LIST}"


class PriceHistory:
    def __init__(self, spark: SparkSession, path: str, most: int = MOST, buckets: int = BUCKETS):
        self.spark, self.most = spark, most
        self.table = VersionedTable(spark, path, POINTS, "key", buckets)

    def load(self) -> DataFrame:
        """key, ts, value, store of all points that are kept."""
        return self.table.read().select("key", F.inline("points"))

    def update(self, points: DataFrame, batch: int | None = None, source: str = "") -> int:
        """Takes points (key string, ts timestamp, value double, store string) in; gives how many keys changed.
        batch: the number of the batch within its source; one that was taken in before is left out."""
        done = self.table.manifest()["notes"]
        name = f"batch {source}"
        if batch is not None and batch <= done.get(name, -1):
            return 0
        notes = {name: batch} if batch is not None else None
        base = self.table.manifest()
        bucket = self.table.bucket(base)
        new = points.filter("value IS NOT NULL").select(bucket.alias("_bucket"), "key", "ts", "value", "store", F.lit(False).alias("_kept"), F.lit(None).cast(_LIST).alias("_old"))
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # as many as there are buckets
        # what is kept of a key is one row, which stands before its new points as its last one
        kept = self.table.read(touched, base).select(bucket.alias("_bucket"), "key", F.inline(F.array(F.element_at("points", -1))), F.lit(True).alias("_kept"), F.col("points").alias("_old"))
        rows = kept.unionByName(new).repartition("_bucket")  # the only shuffle: all that follows is by bucket and key
        by_time = Window.partitionBy("_bucket", "key").orderBy(F.desc("_kept"), "ts", "value", "store")
        last = F.max(F.when(F.col("_kept"), F.col("ts"))).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_last", last).filter(F.col("_kept") | F.col("_last").isNull() | (F.col("ts") >= F.col("_last")))
        same = F.col("value").eqNullSafe(F.lag("value").over(by_time)) & F.col("store").eqNullSafe(F.lag("store").over(by_time))
        rows = rows.withColumn("_same", same).filter(F.col("_kept") | ~F.col("_same"))
        latest = Window.partitionBy("_bucket", "key", "_kept").orderBy(F.desc("ts"), F.desc("value"), F.desc_nulls_last("store"))
        rows = rows.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= self.most)
        found = F.collect_list(F.when(~F.col("_kept"), F.struct((-F.col("_rank")).alias("o"), F.struct("ts", "value", "store").alias("p"))))  # MOST at most
        rows = rows.groupBy("_bucket", "key").agg(F.first("_old", ignorenulls=True).alias("_old"), found.alias("_found"))
        both = F.concat(F.coalesce("_old", F.array().cast(_LIST)), F.transform(F.sort_array("_found"), lambda x: x["p"]))
        rows = rows.withColumn("points", both).withColumn("points", F.slice("points", F.greatest(F.size("points") - self.most + 1, F.lit(1)), self.most))
        return self.table.rewrite(rows, touched, F.size("_found") > 0, base, notes)

    def follow(self, points: DataFrame, checkpoint: str, source: str = "stream"):
        """Starts a stream that takes points in batch by batch."""
        return points.writeStream.foreachBatch(lambda df, batch: self.update(df, batch, source) and None).option("checkpointLocation", checkpoint).start()
