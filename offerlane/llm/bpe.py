"""BPE encoding and decoding over a table of distinct words.

The vocabulary never joins across white space, so the ids of a text are those of
its words (runs without ASCII blanks) in order. The work is:

1. Spark splits texts into words. Each scan partition is cut into parts of about
   PART_BYTES of words. A part numbers its distinct words in order of occurrence,
   its documents become places in that numbering, and the words are dealt by hash
   into buckets: one request (bucket, part, words) each, compressed.
2. Buckets are the shards of the distinct-word table. A bucket meets the requests
   of all parts, encodes each distinct word once, and answers with the ids in the
   order of the request.
3. Parts meet their answers, joined by position: the n-th ids of an answer are
   those of the n-th word that the part has in that bucket, and a document's ids
   are those of its places.

Decoding joins ids with the id-to-piece table. It has a row per id, at most MOST_PIECES, in
order; put in one row, it is joined to each part (or, for ids that come from elsewhere, to each
row), and each id takes the piece at its position.

A frequent word travels once per part, not once per occurrence, and no task holds
more than one part or one bucket; buckets grow in number with the input. Requests
get shorter with that, down to rows of a word each. The documents are read twice and both
readings must be cut alike: inputs whose order can change between readings, as
after a shuffle, are written first, and parts are named by a hash of their words,
so that a difference stops the job instead of giving wrong ids.

Defined cases: null and empty texts have no ids and decode to the empty text; a
very long text is at most a part of its own; repeated rows are encoded each; an
empty table gives an empty table; ids of documents have any type and pass as they
are, nulls too; other columns don't matter. Vocabularies have at most 65,536 pieces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.llm.common import fresh, reread, words_of

#: Bytes of words in a part; bytes of input for each bucket, and the least buckets.
PART_BYTES, BUCKET_BYTES, BUCKETS = 12 << 20, 4 << 20, 32
#: Words of documents that are joined at once, and words encoded at once.
STEP, WORDS = 1 << 20, 4096
#: Pieces that a vocabulary can have, as ids travel in 16 bits.
MOST_PIECES = 1 << 16
#: Compression of what is shuffled.
LEVEL = 6
OTHER_ORDER = "the rows of the input came in another order when they were read again"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    if found.get_vocab_size(with_added_tokens=True) > MOST_PIECES:
        raise ValueError(f"a vocabulary of more than {MOST_PIECES} pieces")
    return found


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The id-to-piece table: id, piece."""
    found = _tokenizer(path)
    return spark.createDataFrame([(i, found.id_to_token(i) or "") for i in range(found.get_vocab_size(with_added_tokens=True))], "id int, piece string")


def _encode(words: list[bytes], path: str) -> list[bytes]:
    """The ids of each word as 16-bit numbers in a row."""
    got = []
    for k in range(0, len(words), WORDS):
        some = [w.decode() for w in words[k : k + WORDS]]
        got += [np.array(e.ids, dtype="<u2").tobytes() for e in _tokenizer(path).encode_batch(some, add_special_tokens=False)]
    return got


def _packed(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress(blob)


def _unpacked(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte of their size: high bytes are mostly zero and compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _ends(words: pa.ListArray) -> np.ndarray:
    """Running bytes of words at the end of each document."""
    running = np.concatenate(([0], np.cumsum(pc.binary_length(words.values).to_numpy(zero_copy_only=False), dtype=np.int64)))
    at = words.offsets.to_numpy()
    return running[at[1:]] - running[at[0]]


def _parts(batches):
    """(name, batches, places, words) of each part: its documents, of all their words
    in order the number of the word, and the distinct words by number."""
    import xxhash
    from pyspark import TaskContext

    task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def part():
        words = pa.concat_arrays([b.column("words").flatten() for b in held]).dictionary_encode()
        name = xxhash.xxh64_intdigest(b"%d %d\n" % (task, n) + "\n".join(words.dictionary.to_pylist()).encode())
        return np.uint64(name).astype(np.int64), held, words.indices.to_numpy(), words.dictionary

    for batch in batches:
        ends, at = _ends(batch.column("words")), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = min(batch.num_rows, int(np.searchsorted(ends, base + PART_BYTES - size)) + 1)
            held.append(batch.slice(at, end - at))
            size, at = size + int(ends[end - 1] - base), end
            if size >= PART_BYTES:
                yield part()
                n, held, size = n + 1, [], 0
    if held:
        yield part()


def _bucketed(words: pa.Array, buckets: int) -> tuple[list[bytes], np.ndarray]:
    """The words, and the bucket of each."""
    import xxhash

    own = words.cast(pa.binary()).to_pylist()
    return own, np.array([xxhash.xxh64_intdigest(w) for w in own], np.uint64) % np.uint64(buckets)


def _requests(batches, buckets: int):
    """(bucket, part, words) rows."""
    for name, _, _, words in _parts(batches):
        own, at = _bucketed(words, buckets)
        order = np.argsort(at, kind="stable")
        found, starts = np.unique(at[order], return_index=True)
        blobs = [_packed(b" ".join(own[k] for k in some.tolist())) for some in np.split(order, starts[1:])] if len(own) else []
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.full(len(found), name)), pa.array(blobs, pa.binary())], ["bucket", "part", "words"])


def _answers(batches, path: str):
    """(part, bucket, ids) rows for requests that come bucket by bucket."""
    bucket, ids_of = None, {}
    for batch in batches:
        blobs = []
        for own, blob in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
            if own != bucket:
                bucket, ids_of = own, {}
            words = _unpacked(blob).split(b" ")
            new = [w for w in words if w not in ids_of]
            ids_of.update(zip(new, _encode(new, path)))
            ids = [ids_of[w] for w in words]
            blobs.append(_packed(_planes(np.array([len(x) // 2 for x in ids])) + b"".join(ids)))
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("bucket"), pa.array(blobs, pa.binary())], ["part", "bucket", "ids"])


def _documents(batches, buckets: int):
    """(part, docs, buckets, places) rows, one per part."""
    for name, held, places, words in _parts(batches):
        docs = pa.Table.from_batches([pa.RecordBatch.from_arrays([b.column("doc_id"), pc.list_value_length(b.column("words"))], ["doc_id", "n"]) for b in held])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as out:
            out.write_table(docs.combine_chunks())
        blobs = [sink.getvalue().to_pybytes(), _planes(_bucketed(words, buckets)[1]), _planes(places)]
        yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([_packed(x)], pa.binary()) for x in blobs)], ["part", "docs", "buckets", "places"])


def _joined(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values of all places in order; place p has sizes[p] values from starts[p]."""
    own = sizes[places]
    return values[np.repeat(starts[places] - np.cumsum(own) + own, own) + np.arange(own.sum())]


def _with_ids(parts: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one part with the ids of their places and, if the part has pieces, the text of these."""
    if parts.num_rows != 1:
        raise RuntimeError(OTHER_ORDER)
    docs, buckets, places = (_unpacked(parts.column(c)[0].as_py()) for c in ("docs", "buckets", "places"))
    docs, buckets, places = pa.ipc.open_stream(docs).read_all(), _numbers(buckets), _numbers(places)
    asked = dict(zip(*(x.tolist() for x in np.unique(buckets, return_counts=True))))
    got = dict(zip(answers.column("bucket").to_pylist(), answers.column("ids").to_pylist()))
    if asked.keys() != got.keys():
        raise RuntimeError(OTHER_ORDER)
    order = np.argsort(buckets, kind="stable")  # the words in the order in which they were asked for
    sizes, values = np.zeros(len(buckets), np.int64), []
    at = 0
    for bucket, n in sorted(asked.items()):
        blob = _unpacked(got.pop(bucket))
        sizes[order[at : at + n]] = _numbers(blob[: 4 * n])
        values.append(np.frombuffer(blob, "<u2", offset=4 * n))
        at += n
    starts = np.zeros(len(buckets), np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    values = np.concatenate(values) if values else np.zeros(0, "<u2")

    pieces = parts.column("pieces").combine_chunks().flatten() if "pieces" in parts.column_names else None
    ends = np.concatenate(([0], np.cumsum(docs.column("n").to_numpy(), dtype=np.int64)))
    out, at = [], 0
    while at < docs.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, side="right")) - 1)
        own = places[ends[at] : ends[end]]
        upto = np.concatenate(([0], np.cumsum(sizes[own])))[ends[at : end + 1] - ends[at]]
        found = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(_joined(values, starts, sizes, own).astype(np.int32)))
        rows = {"doc_id": docs.column("doc_id").slice(at, end - at), "ids": found}
        if pieces is not None:
            rows["decoded"] = pc.binary_join(pa.ListArray.from_arrays(found.offsets, pieces.take(found.values)), " ")
        out.append(pa.table(rows))
        at = end
    pa.default_memory_pool().release_unused()  # workers are used again and would keep it
    return pa.concat_tables(out)


def encoded(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", decode: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of each document; decode: and decoded, the text of the ids."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    docs = reread(docs, "texts")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    docs = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    requests = docs.mapInArrow(lambda batches: _requests(batches, buckets), "bucket long, part long, words binary")
    requests = requests.repartition("bucket").sortWithinPartitions("bucket")
    answers = requests.mapInArrow(lambda batches: _answers(batches, path), "part long, bucket long, ids binary")
    parts = docs.mapInArrow(lambda batches: _documents(batches, buckets), "part long, docs binary, buckets binary, places binary")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    if decode:
        parts, schema = parts.crossJoin(F.broadcast(_pieces_row(df.sparkSession, path))), f"{schema}, decoded string"
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_with_ids, schema)


def _pieces_row(spark: SparkSession, path: str, name: str = "pieces") -> DataFrame:
    """The id-to-piece table as one row: an array of MOST_PIECES at most."""
    return pieces(spark, path).agg(F.sort_array(F.collect_list(F.struct("id", "piece")))["piece"].alias(name))


def decoded(found: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """found with the text of an array of ids: each id joined with its piece, in order, by blanks; null for null."""
    (whole,) = fresh(found, "pieces")
    joined = found.crossJoin(F.broadcast(_pieces_row(found.sparkSession, path, whole)))
    return joined.withColumn(out, F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: F.get(F.col(whole), i)), " ")).drop(whole)


def digests(found: DataFrame, path: str) -> DataFrame:
    """n_tokens and SHA-256 of the ids as text and of the decoded text, of what encoded() gives."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    found = found if "decoded" in found.columns else decoded(found, path)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
