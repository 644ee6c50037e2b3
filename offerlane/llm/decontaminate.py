"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of WINDOW consecutive words (a shorter item is one window). A
window is held to be in a document only if all its shingles of SHINGLE words are, so one of
them is prefix enough. Shingles are ordered by their count over all documents, and each
window is listed under its rarest one only.

1. Documents count the shingles of the items; counts are summed over all documents.
2. Each distinct window takes its rarest shingle.
3. Documents emit their places of such shingles, with the words around. Both readings
   test a shingle first by a bitmap of BITS bits, which has that size however large the benchmark
   is; what passes wrongly costs a row and finds nothing in the join.
4. Places and windows are joined by the shingle; a window must begin and end within the
   document (position and length), and then all its words are compared.

The table of windows is written, so Spark knows its size: it is broadcast below
Spark's threshold, else both sides are shuffled and skewed keys split by Spark.

Defined cases: null and empty texts have no words, items of that kind no windows;
equal rows of documents are judged each; equal items, and equal windows, are
found together; an item without id hits words but isn't listed or counted; empty tables give
no hits, or no rows; other columns don't matter; ids of documents have any type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlane.llm.bytewords import byte_class, lowered, shingle_hashes, slices, word_hashes, word_places
from offerlane.llm.common import written

#: Words in a window and in a shingle; bits of the bitmap, a power of two.
WINDOW, SHINGLE, BITS = 10, 3, 1 << 26

INSIDE = byte_class(set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100)))


class _Words:
    """The words of some texts: hashes, the first of each text, and their bytes with a blank after each."""

    def __init__(self, texts: pa.Array):
        data, at = lowered(texts)
        inside = INSIDE[data]
        starts, stops, self.first = word_places(inside, at)
        self.hashes = word_hashes(data, starts, stops)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.ends = np.cumsum(stops - starts + 1)
        self.data = np.full(int(self.ends[-1]) if len(starts) else 0, 32, np.uint8)
        letters = np.ones(len(self.data), bool)
        letters[self.ends - 1] = False
        self.data[letters] = data[inside]
        self.data = self.data.tobytes()

    def text(self, first: int, end: int) -> str:
        """The words first to end (exclusive), joined by blanks."""
        if end <= first:
            return ""
        return self.data[self.ends[first - 1] if first else 0 : self.ends[end - 1] - 1].decode()

    def shingles(self, width: int) -> np.ndarray:
        """Shingle at each word; those over the end of a text are 0."""
        found = np.zeros(len(self.hashes), np.uint64)
        own = shingle_hashes(self.hashes, width)
        same = self.doc[: len(own)] == self.doc[width - 1 :][: len(own)]
        found[: len(own)] = np.where(same, own, np.uint64(0))
        return found


def _item_windows(batches, window: int, shingle: int):
    """(item_id, window, size, width, shingles) rows."""
    for batch in batches:
        for some in slices(batch):
            words, ids = _Words(some.column("text")), some.column("item_id")
            item, text, size, width, shingles = [], [], [], [], []
            by_width = {k: words.shingles(k).view(np.int64) for k in range(1, shingle + 1)}
            for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                n = min(window, b - a)
                w = min(shingle, n)
                for at in range(a, b - n + 1) if n else ():
                    item.append(k)
                    text.append(words.text(at, at + n))
                    size.append(n)
                    width.append(w)
                    shingles.append(by_width[w][at : at + n - w + 1])
            item = pa.array(item, pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(item), pa.array(text, pa.string()), pa.array(size, pa.int32()), pa.array(width, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))], ["item_id", "window", "size", "width", "shingles"])


def _bitmap(shingles: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of bits bits with those of all shingles set."""
    at = F.pmod(F.col("shingle"), F.lit(bits)) + 1
    rows = shingles.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    found = np.zeros(bits // 8, np.uint8)
    for bucket, own in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit")).collect():  # bits // 32768 rows at most
        own = np.frombuffer(own, np.uint8)[: len(found)]
        found[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(own)] = own
    return found


def _known(shingles: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places of the shingles that the bitmap has."""
    at = shingles & np.uint64(len(bitmap) * 8 - 1)
    return np.flatnonzero(((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) & (shingles != 0))


def _counts(batches, widths: list[int], bitmap: np.ndarray):
    """(shingle, n) rows: shingles of the bitmap, counted by slices of documents."""
    for batch in batches:
        for some in slices(batch):
            words = _Words(some.column("text"))
            for width in widths:
                own = words.shingles(width)
                found, n = np.unique(own[_known(own, bitmap)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])


PLACE = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.string()), ("after", pa.string())])


def _places(batches, widths: list[int], bitmap: np.ndarray, window: int):
    """(doc_id, n_words, places) rows: the places of the bitmap's shingles in each document,
    with the words before, as many as a window can have there, and from the place on."""
    for batch in batches:
        for some in slices(batch):
            words = _Words(some.column("text"))
            hits = [(int(at), int(own[at])) for own in map(words.shingles, widths) for at in _known(own, bitmap)]
            hits.sort()
            rows, per_doc = [], np.zeros(some.num_rows, np.int64)
            for at, shingle in hits:
                doc = words.doc[at]
                first, end = int(words.first[doc]), int(words.first[doc + 1])
                per_doc[doc] += 1
                shingle -= (shingle >> 63) << 64
                rows.append({"shingle": shingle, "at": at - first, "before": words.text(max(first, at - window + 1), at), "after": words.text(at, min(end, at + window))})
            ends = np.concatenate(([0], np.cumsum(per_doc))).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows, PLACE))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)), places], ["doc_id", "n_words", "places"])


def _covered(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        own = acc["last"]
        joined = own["end"] >= x["start"]
        return F.struct(
            F.when(joined, acc["out"]).otherwise(F.concat(acc["out"], F.array(own))).alias("out"),
            F.when(joined, F.struct(own["start"].alias("start"), F.greatest(own["end"], x["end"]).alias("end"))).otherwise(x).alias("last"),
        )

    start = F.struct(none.alias("out"), F.get(spans, F.lit(0)).alias("last"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.array(acc["last"])))


def benchmark_hits(df: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (the words that lie in windows of items, as
    runs start .. end, exclusive, by number of the word) and items (ids of the items found, as sorted strings)."""

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`"), F.lit("")).alias("text")

    bench = items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), text_of(item_text))
    bench = bench.mapInArrow(lambda batches: _item_windows(batches, window, shingle), "item_id string, window string, size int, width int, shingles array<long>")
    bench = written(bench, "windows")
    distinct = bench.groupBy("window").agg(F.first("size").alias("size"), F.first("width").alias("width"), F.first("shingles").alias("shingles"))
    distinct = written(distinct.withColumn("window_id", F.monotonically_increasing_id()), "windows")
    widths = sorted(r.width for r in distinct.select("width").distinct().collect())  # shingle numbers at most

    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text))
    shingles = distinct.select("window_id", F.posexplode("shingles").alias("at", "shingle"))
    asked = _bitmap(shingles, bits)
    counts = docs.select("text").mapInArrow(lambda batches: _counts(batches, widths, asked), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")
    rarest = shingles.join(counts, "shingle", "left").groupBy("window_id").agg(F.min(rarity).alias("own"))
    head = F.expr("substring_index(window, ' ', own.at)")
    rarest = distinct.join(rarest.select("window_id", F.col("own")), "window_id").select(
        "window_id", "size", F.col("own.shingle").alias("shingle"), F.col("own.at").alias("offset"), head.alias("head"),
        F.when(F.col("own.at") == 0, F.col("window")).otherwise(F.substring(F.col("window"), F.char_length(head) + 2, F.char_length("window"))).alias("tail"),
    )
    rarest = written(rarest, "prefixes")

    listed = _bitmap(rarest, bits)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, places array<struct<shingle:long,at:int,before:string,after:string>>"
    base = docs.mapInArrow(lambda batches: _places(batches, widths, listed, window), schema)
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "places")

    places = base.filter(F.size("places") > 0).select("row", "n_words", F.inline("places"))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    whole = (F.col("offset") == 0) | F.concat(F.lit(" "), F.col("before")).endswith(F.concat(F.lit(" "), F.col("head")))
    whole = whole & F.concat(F.col("after"), F.lit(" ")).startswith(F.concat(F.col("tail"), F.lit(" ")))
    hits = places.join(rarest, "shingle").filter(fits & whole).select("row", "window_id", start.alias("start"), (start + F.col("size")).alias("end"))
    hits = written(hits, "hits")
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    names = bench.join(distinct.select("window", "window_id"), "window").select("window_id", "item_id").distinct()
    found = hits.select("row", "window_id").distinct().join(names, "window_id").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    judged = base.select("row", "doc_id", "n_words").join(spans.select("row", _covered(F.col("spans")).alias("spans")).join(found, "row"), "row", "left")
    none = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    return judged.select("doc_id", "n_words", none.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the items of benchmark_hits()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
