"""Phrase collocation mining by hierarchical pair naming.

A text is a sequence of names. At the first level names are words; at each further
level two adjacent names that are both frequent make a pair, each frequent pair
gets a name, and the sequence of names is replaced by that of its pairs. A name of
level k is so a phrase of k words, and its two parents (left, right) are the
phrases without its last and without its first word. Names are global ids: equal
pairs of all parts of the corpus meet by their parents' ids.

The work is done in parts of about PART_BYTES of words of one language. A part keeps its
sequence as numbers and deals its distinct names by hash into buckets: one compressed
request (bucket, part, names with counts) each. A bucket meets the requests of all parts,
sums the counts, names the frequent ones, and answers each part in the order of its
request. So the most frequent pair travels once per part, not once per occurrence,
and buckets grow in number with the input. All ids are of a language.
A phrase is at most as frequent as its parents, so pairs of frequent names are enough.

Counts of a phrase's beginnings come from its left parent, those of its ends from its
right parent, so every cut is known without another count. A phrase lies in a
longer one only if it is a parent of one word more that is at least as frequent, so the most
frequent child of a phrase decides whether it is dropped.

Defined cases: a null or empty text has no words; a null language is `und`, a
language of its own together with rows that say so; repeated rows count again; ties in
score and count go by the phrase's bytes; an empty table gives an empty table; other
columns don't matter; a text is looked at whole, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlane.llm.bytewords import byte_class, lowered, numbers, packed, planes, shingle_hashes, slices, unpacked, word_places, word_strings
from offerlane.llm.common import written

#: Words in a phrase, least count, percentage of a phrase's count from which a longer phrase stands for it, phrases per language.
MAX_WORDS, MIN_COUNT, COVERED_PERCENT, TOP = 3, 10, 50, 2000
#: Bytes of words in a part; bytes of input for each bucket of names, and the least buckets.
PART_BYTES, BUCKET_BYTES, BUCKETS = 8 << 20, 4 << 20, 32
#: Parts of a language that rank their phrases before all of it is ranked.
SALTS = 64

ENDS = byte_class(b".,;:!?\n\x0b\x0c\r")
APART = ENDS | byte_class(b" \t")


def _sequence(codes: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The codes with -1 where a piece ends."""
    found = np.full(len(codes) + int(gap.sum()), -1, np.int32)
    found[np.arange(len(codes)) + np.cumsum(gap)] = codes
    return found


LEVEL = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("seq", pa.binary()), ("sizes", pa.binary()), ("n_words", pa.int64()), ("bucket", pa.int64()), ("names", pa.binary())])
NAMED = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary()), ("id", pa.int64()), ("word", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _level(part: int, lang: str, codes: np.ndarray | None, n_words: int, bucket: np.ndarray, keys: list[np.ndarray], request) -> pa.Table:
    """A row with the sequence of a part and how many names it has per bucket, and its requests.

    Names are numbered anew in order of bucket and then of their keys; request(names) is the blob of some."""
    by = np.lexsort((*keys[::-1], bucket))
    place = np.empty(len(by) + 1, np.int64)
    place[by], place[-1] = np.arange(len(by)), -1  # the last one is for places without a name
    found, first = np.unique(bucket[by], return_index=True)
    sizes = np.diff(np.append(first, len(by)))
    requests = [request(names) for names in np.split(by, first[1:])] if len(by) else []
    k = len(requests)
    seq = packed(planes(place[codes]) if codes is not None else b"")
    rows = {"part": [part] * (k + 1), "lang": [lang] * (k + 1), "seq": [seq] + [None] * k, "sizes": [packed(planes(found), planes(sizes))] + [None] * k}
    rows |= {"n_words": [n_words] + [None] * k, "bucket": [None, *found.tolist()], "names": [None, *requests]}
    return pa.table(rows, schema=LEVEL)


def _word_parts(batches, part_bytes: int, buckets: int):
    """The first level: parts of words."""
    import xxhash
    from pyspark import TaskContext

    part, held, size = TaskContext.get().partitionId() << 24, {}, 0

    def flush():
        nonlocal part
        for lang, some in held.items():
            words = pa.concat_arrays([w for w, _ in some]).dictionary_encode()
            codes, own = words.indices.to_numpy(zero_copy_only=False), words.dictionary.cast(pa.large_binary()).to_pylist()
            bucket = np.array([xxhash.xxh64_intdigest(w) for w in own], np.uint64) % np.uint64(buckets)
            rank = np.empty(len(own), np.int64)
            rank[pc.array_sort_indices(words.dictionary).to_numpy()] = np.arange(len(own))
            counts = np.bincount(codes, minlength=len(own))
            seq = _sequence(codes, np.concatenate([g for _, g in some]))
            yield from _level(part, lang, seq, len(codes), bucket.astype(np.int64), [rank], lambda names: packed(planes(counts[names]), b" ".join(own[k] for k in names.tolist()))).to_batches()
            part += 1

    for batch in batches:
        for some in slices(batch):
            data, at = lowered(some.column("text"))
            ends, inside = ENDS[data], ~APART[data]
            starts, stops, first = word_places(inside, at)
            words = word_strings(data, inside, starts, stops)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
            seen = np.cumsum(ends, dtype=np.int32)[starts] if len(starts) else starts
            gap = np.ones(len(starts), bool)
            gap[1:] = (seen[1:] != seen[:-1]) | (doc[1:] != doc[:-1])
            langs = some.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)[doc]
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = code == k
                if own.any():
                    held.setdefault(lang, []).append((words.filter(pa.array(own)), gap[own]))
            size += int(inside.sum())
            if size >= part_bytes:
                yield from flush()
                held, size = {}, 0
                pa.default_memory_pool().release_unused()  # workers are used again and would keep it
    yield from flush()


def _answers(requests: pa.Table, sizes: list[int], code: np.ndarray, counts: np.ndarray, least: int, buckets: int):
    """What a bucket answers, given the code of each name of each request and its count there: (answers; ids,
    codes and counts of the frequent names). An answer has, for a request's names in order, the ids of frequent names, and -1."""
    lang, bucket = requests.column("lang")[0].as_py(), requests.column("bucket")[0].as_py()
    total = np.bincount(code, counts).astype(np.int64) if len(code) else np.zeros(0, np.int64)
    frequent = np.flatnonzero(total >= least)
    ids = np.full(len(total), -1, np.int64)
    ids[frequent] = np.arange(len(frequent)) * buckets + bucket
    blobs = [packed(planes(ids[own])) for own in np.split(code, np.cumsum(sizes)[:-1])]
    rows = {"lang": [lang] * len(blobs), "part": requests.column("part"), "bucket": [bucket] * len(blobs), "answer": blobs}
    rows |= {c: pa.nulls(len(blobs), NAMED.field(c).type) for c in ("id", "word", "left", "right", "n")}
    return pa.table(rows, schema=NAMED), ids[frequent], frequent, total[frequent]


def _names(lang: str, ids: np.ndarray, n: np.ndarray, **keys) -> pa.Table:
    rows = {"lang": [lang] * len(ids), "id": ids, "n": n} | keys
    rows |= {c: pa.nulls(len(ids), NAMED.field(c).type) for c in NAMED.names if c not in rows}
    return pa.table({c: rows[c] for c in NAMED.names}, schema=NAMED)


def _word_names(least: int, buckets: int):
    """The frequent words of a bucket, and its answers."""

    def name(requests: pa.Table) -> pa.Table:
        asked = [unpacked(x) for x in requests.column("names").to_pylist()]
        counts = [numbers(n) for n, _ in asked]
        words = pa.array([w for _, blob in asked for w in blob.split(b" ")], pa.binary()).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        answers, ids, frequent, n = _answers(requests, [len(c) for c in counts], code, np.concatenate(counts), least, buckets)
        own = words.dictionary.take(pa.array(frequent)).cast(pa.string())
        return pa.concat_tables([answers, _names(requests.column("lang")[0].as_py(), ids, n, word=own)])

    return name


def _pair_names(least: int, buckets: int):
    """The frequent pairs of a bucket, and its answers."""

    def name(requests: pa.Table) -> pa.Table:
        asked = [[numbers(x) for x in unpacked(blob)] for blob in requests.column("names").to_pylist()]
        left, right = np.concatenate([np.cumsum(x[0]) for x in asked]), np.concatenate([x[1] for x in asked])  # a request has the lefts' differences
        (lefts, l), (rights, r) = (np.unique(x, return_inverse=True) for x in (left, right))
        key, code = np.unique(l * len(rights) + r, return_inverse=True)
        answers, ids, frequent, n = _answers(requests, [len(x[0]) for x in asked], code, np.concatenate([x[2] for x in asked]), least, buckets)
        l, r = np.divmod(key[frequent], len(rights))
        return pa.concat_tables([answers, _names(requests.column("lang")[0].as_py(), ids, n, left=lefts[l], right=rights[r])])

    return name


def _pairs_of(last: bool, buckets: int):
    """The next level of a part: from its sequence and the answers, its pairs."""

    def pairs(sequence: pa.Table, answers: pa.Table) -> pa.Table:
        part, lang, n_words = (sequence.column(c)[0].as_py() for c in ("part", "lang", "n_words"))
        seq = numbers(unpacked(sequence.column("seq")[0].as_py())[0])
        asked, sizes = map(numbers, unpacked(sequence.column("sizes")[0].as_py()))
        got = {b: numbers(unpacked(x)[0]) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist())}
        ids = np.concatenate([np.zeros(0, np.int64), *(got[b] for b in asked.tolist())])
        if len(ids) != sizes.sum():
            raise RuntimeError("answers that don't fit the part's names")
        known = np.flatnonzero(ids >= 0)
        dense = np.full(len(ids) + 1, -1, np.int64)
        dense[known] = np.arange(len(known))
        own = dense[seq]  # -1 is the last one
        ok = (own[:-1] >= 0) & (own[1:] >= 0)
        key, code, counts = np.unique(own[:-1][ok] * max(len(known), 1) + own[1:][ok], return_inverse=True, return_counts=True)
        codes = np.full(max(len(seq) - 1, 0), -1, np.int64)
        codes[ok] = code
        left, right = (ids[known][k] if len(key) else key for k in np.divmod(key, max(len(known), 1)))
        pa.default_memory_pool().release_unused()
        bucket = (shingle_hashes(np.stack([left, right], 1).ravel().view(np.uint64), 2)[::2] % np.uint64(buckets)).astype(np.int64)
        return _level(part, lang, None if last else codes, n_words, bucket, [left, right], lambda names: packed(planes(np.diff(left[names], prepend=0)), planes(right[names]), planes(counts[names])))

    return pairs


def phrases(df: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, part_bytes: int = PART_BYTES):
    """The frequent phrases of 2 to max_words words, a table per length, and the number of
    words of each language. A phrase has lang, id, left, right (its parents), phrase, last
    (its last word), a (its count), heads and tails: the counts of its first and last 1, 2, ... words."""
    texts = df.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    buckets = max(BUCKETS, int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // BUCKET_BYTES)
    level = written(texts.mapInArrow(lambda batches: _word_parts(batches, part_bytes, buckets), _ddl(LEVEL)), "words")
    totals = level.filter("seq IS NOT NULL").groupBy("lang").agg(F.sum("n_words").alias("n"))

    def named(name) -> DataFrame:
        requests = level.filter("names IS NOT NULL").select("lang", "bucket", "part", "names")
        return written(requests.groupBy("lang", "bucket").applyInArrow(name(min_count, buckets), _ddl(NAMED)), "names")

    names = named(_word_names)
    known = names.filter("id IS NOT NULL").select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("n").alias("heads"), F.array("n").alias("tails"))
    found = []
    for k in range(2, max_words + 1):
        sequences = level.filter("seq IS NOT NULL").select("part", "lang", "seq", "sizes", "n_words")
        answers = names.filter("answer IS NOT NULL").select("part", "bucket", "answer")
        level = written(sequences.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_pairs_of(k == max_words, buckets), _ddl(LEVEL)), "pairs")
        names = named(_pair_names)
        left = known.select("lang", F.col("id").alias("left"), "phrase", "heads")
        right = known.select("lang", F.col("id").alias("right"), "last", "tails")
        known = names.filter("id IS NOT NULL").select("lang", "id", "left", "right", "n").join(left, ["lang", "left"]).join(right, ["lang", "right"])
        known = known.select(
            "lang", "id", "left", "right", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.col("n").alias("a"),
            F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails"),
        )
        known = written(known, "phrases")
        found.append(known)
    return found, totals


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: products have up to 38 digits."""
    wide = [x.cast("decimal(15,0)") for x in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2])


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT, top: int = TOP) -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    levels, totals = phrases(df, text, lang, max_words, min_count)
    rows = None
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            parents = levels[k + 1].select("lang", F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("longer"))
            covered = parents.groupBy("lang", "id").agg(F.max("longer").alias("longer"))
            level = level.join(covered, ["lang", "id"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
        cuts = []
        for j in range(1, k + 2):
            first, rest = F.get("heads", F.lit(j - 1)), F.get("tails", F.lit(k + 1 - j))
            cuts.append(F.struct(_score(F.col("a"), first, rest).alias("score"), F.lit(j).alias("k"), first.alias("l"), rest.alias("r")))
        level = level.select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        rows = level if rows is None else rows.unionByName(level)
    order = F.desc("score"), F.desc("a"), "phrase"
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    first = rows
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
