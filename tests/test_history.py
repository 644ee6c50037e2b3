"""The kept price history: batches, restarts, late points and keys with very many points."""

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from offerlane.operators.versions import VersionedTable
from offerlane.streaming.kept_history import PriceHistory

POINTS = "key string, ts timestamp, value double, store string"
START = datetime(2024, 1, 1)


def brute(batches, most):
    """What a loop over the points keeps."""
    kept = {}
    for rows in batches:
        last = {k: v[-1][0] for k, v in kept.items()}
        for key, ts, value, store in sorted((r for r in rows if r[2] is not None), key=lambda r: (str(r[0]), r[1], r[2], r[3])):
            own = kept.setdefault(key, [])
            if key in last and ts < last[key]:
                continue
            if not own or own[-1][1:] != (value, store):
                own.append((ts, value, store))
    return {k: v[-most:] for k, v in kept.items() if v}


def loaded(history):
    found = {}
    for r in history.load().collect():
        found.setdefault(r.key, []).append((r.ts, r.value, r.store))
    return found


def test_batches_equal_a_loop(spark, tmp_path):
    r = Random(6)
    make = lambda day: [(r.choice(["a", "b", "c", None]), START + timedelta(days=day, minutes=r.randint(0, 500)), r.choice([1.0, 2.0, None]), r.choice(["s", "t"])) for _ in range(60)]
    batches = [make(0), make(1), [], make(3), make(2), make(4)]  # the third is late for keys that the fourth has
    history = PriceHistory(spark, str(tmp_path / "h"), most=20, buckets=3)
    for k, rows in enumerate(batches):
        history.update(spark.createDataFrame(rows, POINTS).repartition(3), k)
        assert history.update(spark.createDataFrame(rows, POINTS), k) == 0  # run again: nothing
        assert loaded(history) == brute(batches[: k + 1], 20)
    again = PriceHistory(spark, str(tmp_path / "h"), most=20)  # another driver
    assert loaded(again) == brute(batches, 20)
    assert again.update(spark.createDataFrame(batches[0], POINTS), 0) == 0


def test_stream_restarts_where_it_was(spark, tmp_path):
    src = str(tmp_path / "in")
    history = PriceHistory(spark, str(tmp_path / "h"), buckets=2)

    def feed(rows):
        spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(src)

    def drain(h):
        query = h.follow(spark.readStream.schema(POINTS).parquet(src), str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()

    feed([("k", START, 10.0, "A"), ("k", START + timedelta(hours=1), 10.0, "A"), ("k", START + timedelta(hours=2), 9.0, "A")])
    drain(history)
    feed([("k", START + timedelta(hours=3), 9.0, "A"), ("k", START + timedelta(hours=4), 9.0, "B"), ("m", START, 1.0, "A")])
    drain(PriceHistory(spark, str(tmp_path / "h")))  # a new run
    assert [(x[1], x[2]) for x in loaded(history)["k"]] == [(10.0, "A"), (9.0, "A"), (9.0, "B")] and len(loaded(history)["m"]) == 1


def test_a_key_with_many_points(spark, tmp_path):
    """300,000 points of one key in one batch: the last hundred changes stay, and only its bucket is rewritten."""
    history = PriceHistory(spark, str(tmp_path / "h"), buckets=4)
    history.update(spark.createDataFrame([(f"k{i}", START, 1.0, "A") for i in range(40)], POINTS))
    before = history.table.manifest()["folders"]
    many = spark.range(300_000).select(F.lit("k7").alias("key"), F.timestamp_seconds(F.col("id") + 1_800_000_000).alias("ts"), (F.floor(F.col("id") / 3) % 7).cast("double").alias("value"), F.lit("A").alias("store"))
    assert history.update(many) == 1
    own = loaded(history)
    assert len(own) == 40 and len(own["k7"]) == 100 and [x[1] for x in own["k7"]] == [float(k % 7) for k in range(100_000 - 100, 100_000)]
    after = history.table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_an_update_moves_rows_once(spark, tmp_path, monkeypatch):
    """Kept rows and new points meet in one shuffle; late points leave the buckets as they are; a second writer is an error."""
    plans, rewrite = [], VersionedTable.rewrite
    monkeypatch.setattr(VersionedTable, "rewrite", lambda self, rows, *rest: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or rewrite(self, rows, *rest))
    history = PriceHistory(spark, str(tmp_path / "h"), buckets=3)
    first = spark.createDataFrame([(f"k{i}", START + timedelta(days=d), float(d), None) for i in range(20) for d in range(5)], POINTS)
    assert history.update(first, 0) == 20
    later = spark.createDataFrame([("k3", START + timedelta(days=9), 7.0, "A"), (None, START, 1.0, "A"), ("k4", START, 9.0, "A")], POINTS)
    assert history.update(later, 1) == 2
    assert all(p.count("Exchange") == 1 for p in plans) and len(plans) == 2
    before = history.table.manifest()
    assert history.update(spark.createDataFrame([("k5", START, 3.0, "B")], POINTS), 2) == 0
    assert history.table.manifest()["folders"] == before["folders"] and history.table.manifest()["notes"] == {"batch ": 2}
    rows = history.table.read().withColumn("_bucket", history.table.bucket(before))
    with pytest.raises(RuntimeError, match="by others"):
        history.table.rewrite(rows, sorted(before["folders"]), F.lit(True), before | {"folders": {}})
    assert len(loaded(history)) == 21 and len(loaded(history)["k3"]) == 6
