"""Mixing sources to target weights by packed blocks.

Words of each source are packed, documents in a pseudorandom order, into blocks
of a fixed length. A mix is a number of output shards of a fixed number of blocks. The
blocks that a source should give are those that come nearest to its target by their
real lengths (its last block can be short), but one at least if it has a target at
all; each place of a shard draws its source by these numbers, so the counts of a
shard are multinomial. What a source gives in all is what was drawn: where that is off
its number by more than half a percent, the last shards are corrected to that bound, so small
sources give their number exactly. The k-th block that a source gives, shard by shard, is its block perm(k mod n)
in pass k div n, where perm is a pseudorandom permutation of its n block indexes.
Slots and blocks meet in a join by source and index.

Everything is keyed hashing of ids, so reruns agree. Running sums over a source
are taken in two steps, over buckets and within buckets, so that a source with a
third of all documents is never sorted in one task.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null
source is a source of its own, last in order; equal rows are documents of their
own, each with its words and its share; very long texts are in many blocks; an
empty table gives an empty table; columns of the input are not touched by helper
columns, as they are renamed at the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlane.llm.common import fresh, let, numbered, reread, rows_by_number, words_of, written

#: Weights by order of source, repeating; most times that a source is repeated.
WEIGHTS, MAX_PASSES = (1, 2, 3), 3
#: Words in a block, blocks in an output shard, rounds of the permutation, seed.
BLOCK, SHARD, ROUNDS, SEED = 64, 4096, 24, 20240
BLANK = " \t\n\x0b\f\r"
AFTER_SPACE = "(?<=[ \\t-\\r])(?=[^ \\t-\\r])"
#: Share of its blocks by which what a source draws can be off its target, in either direction.
TOLERANCE = 0.005
#: Least buckets of a running sum; slots that one task makes; runs of tickets that sources are listed by; shards in a run of a running sum.
BUCKETS, TASK, RUNS, RUN = 64, 1 << 17, 1 << 16, 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """sizes: source, source_size (one row per source). Adds sid (order of the
    source by code point, null last), weight and target.

    Targets share the whole size by weight, but none is above max_passes times
    its source. With sources in order of limit / weight, a source is at its limit
    exactly if the level of the sources from it on is above its own quotient; the
    first source that isn't gives the level of all the rest."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    base = sizes.withColumn("sid", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", w)
    base = base.withColumn("most", F.col("source_size") * float(max_passes))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    everyone = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(onward)
    base = base.withColumn("own_level", level).withColumn("free", F.col("most") / F.col("weight") >= F.col("own_level"))
    base = base.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), "sid", "own_level"))).over(everyone)["own_level"])
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return base.select("source", "source_size", "sid", "weight", target.alias("target"))


def permuted(k: Column, n: Column, key: Column, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. n-1 that depends on key, at k.

    Swap or not: in each round k has one partner, and a hash of the pair decides
    whether the two change places. inverse: where k is in the permutation, by the
    same rounds backwards."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x + n, n)
        swap = F.pmod(F.xxhash64(key, r, F.greatest(x, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(rounds), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(rounds)), k.cast("long"), step)


def with_slots(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """targets with n_blocks and n_slots: the blocks of a source, and how many the mix should take."""
    t = targets.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    n, size = F.greatest(F.col("n_blocks"), F.lit(1)), F.greatest(F.col("source_size").cast("long"), F.lit(1))
    words = F.round("target").cast("long")
    t = t.withColumns({"passes": F.floor(words / size), "rest": words % size, "short": n * block - size, "last_at": permuted(n - 1, n, F.xxhash64(F.lit(SEED), "sid"), inverse=True)})
    # the first k blocks of a pass, and how far their words are from the rest
    at = F.floor(F.col("rest") / block)
    off = lambda k: F.struct(F.abs(k * block - F.when(k > F.col("last_at"), F.col("short")).otherwise(0) - F.col("rest")).alias("off"), k.alias("k"))
    nearest = F.array_min(F.array(*(off(F.least(at + i, n)) for i in range(3))))["k"]
    slots = F.when(words > 0, F.greatest(F.col("passes") * n + nearest, F.lit(1))).otherwise(0)
    return t.withColumn("n_slots", F.least(slots, MAX_PASSES * F.col("n_blocks")).cast("long")).drop("passes", "rest", "short", "last_at")


def _sized(df: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """row, doc_id, source, size, and the order in which documents are packed."""
    size = F.size(words_of(F.col(f"`{text}`"))).cast("long")
    (row,) = fresh(df, "row")
    picked = numbered(df, row).select(F.col(row).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    return picked.withColumn("place", F.xxhash64(F.lit(SEED), "doc_id", "tie"))


def mixed(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packed, slots, targets).

    df is read in the same order each time, as by reread().

    packed: row, doc_id, tie, sid, size, start (of the document in its source's words).
    slots: sid, shard, k, index, pass_no: the blocks that the mix takes.
    targets: as source_targets(), with n_blocks and n_slots."""
    sized = written(_sized(df, text, source, doc_id), "mix-sizes")
    # buckets by hash: (bucket, place) is the packing order of a source
    n_buckets = max(BUCKETS, sized.count() // 4096)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(n_buckets)))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = written(with_slots(targets, block), "mix-targets")

    ids = targets.select(F.col("source").alias("named"), "sid")
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias("bucket_start"))
    sums = sums.join(ids, F.col("source").eqNullSafe(F.col("named"))).select("sid", "bucket", "bucket_start", F.col("named"))
    within = Window.partitionBy("named", "bucket").orderBy("place", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    s, b = sized.alias("s"), sums.alias("b")
    packed = s.join(b, (F.col("s.bucket") == F.col("b.bucket")) & F.col("source").eqNullSafe(F.col("named")))
    packed = packed.select("row", "doc_id", "tie", "place", "sid", "size", "named", F.col("s.bucket").alias("bucket"), "bucket_start")
    packed = packed.withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return packed.select("row", "doc_id", "tie", "sid", "size", "start"), _slots(targets), targets


def shard_counts(targets: DataFrame, total: int, shard: int = SHARD) -> DataFrame:
    """sid, shard, n: how many blocks each source gives to each output shard.

    A shard has as many places as blocks fit (shard; the last one fewer), and each place
    draws a source by the sources' n_slots, so the counts of a shard are multinomial. A place draws one
    of total tickets; a source has the tickets first .. last, listed by runs of tickets so that
    places and sources meet in a join."""
    spark, width = targets.sparkSession, max(1, total // RUNS)
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per source
    held = targets.filter("n_slots > 0").select("sid", F.sum("n_slots").over(upto).alias("end"), (F.sum("n_slots").over(upto) - F.col("n_slots")).alias("first"))
    held = held.withColumn("run", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("end") - 1) / width))))
    places = spark.range(0, total, 1, max(1, -(-total // TASK))).select(F.floor(F.col("id") / shard).alias("shard"), F.pmod(F.xxhash64(F.lit(SEED), F.lit("draw"), "id"), F.lit(total)).alias("ticket"))
    drawn = places.withColumn("run", F.floor(F.col("ticket") / width)).join(held, "run").filter((F.col("first") <= F.col("ticket")) & (F.col("ticket") < F.col("end")))
    return drawn.groupBy("sid", "shard").agg(F.count("*").alias("n"))


def _slots(targets: DataFrame, shard: int = SHARD) -> DataFrame:
    """The slots of the mix: the blocks that each shard draws of each source, numbered on within the
    source and mapped to block indexes.

    What a source gives in all is what was drawn, if that is within TOLERANCE of its n_slots and within its
    passes; else its last shards give fewer, or more."""
    total = int(targets.agg(F.sum("n_slots")).first()[0] or 0)
    n_shards, tasks = max(1, -(-total // shard)), max(1, -(-total // TASK))
    counts = written(shard_counts(targets, total, shard), "mix-draws") if total else targets.sparkSession.createDataFrame([], "sid long, shard long, n long")
    drawn = counts.groupBy("sid").agg(F.sum("n").alias("drawn"))
    off = F.floor(F.col("n_slots") * TOLERANCE)
    least, most = F.col("n_slots") - off, F.least(F.col("n_slots") + off, MAX_PASSES * F.col("n_blocks"))
    given = targets.filter("n_slots > 0").join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    given = given.select("sid", "n_blocks", "drawn", F.greatest(least, F.least("drawn", most)).alias("given"))
    # what is missing, a full shard at a time from the last one on
    more = given.filter("given > drawn").withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("given") - F.col("drawn") - 1) / shard))))
    more = more.select("sid", F.greatest(F.lit(n_shards - 1) - F.col("j"), F.lit(0)).alias("shard"), F.least(F.lit(shard), F.col("given") - F.col("drawn") - F.col("j") * shard).alias("n"))
    counts = counts.unionByName(more).groupBy("sid", "shard").agg(F.sum("n").alias("n")).withColumn("run", F.floor(F.col("shard") / RUN))
    # running sums in two steps, over runs of shards and within a run, so that no source is sorted in one task
    up_to = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("sid", "run").agg(F.sum("n").alias("run_n"))
    runs = runs.select("sid", "run", F.coalesce(F.sum("run_n").over(up_to("sid").orderBy("run")), F.lit(0)).alias("run_first"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(up_to("sid", "run").orderBy("shard")), F.lit(0)))
    counts = counts.join(runs, ["sid", "run"]).withColumn("first", F.col("first") + F.col("run_first"))
    counts = counts.join(given.select("sid", "n_blocks", "given"), "sid").withColumn("last", F.least(F.col("first") + F.col("n"), "given") - 1).filter("first <= last")
    slots = counts.repartition(tasks, "sid", "shard").select("sid", "n_blocks", "shard", F.explode(F.sequence("first", "last")).alias("k"))
    return slots.select("sid", "shard", "k", permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.xxhash64(F.lit(SEED), "sid")).alias("index"), F.floor(F.col("k") / F.col("n_blocks")).alias("pass_no"))


def taken_blocks(packed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, tie, size, sid, and per block of the document that the mix takes: index,
    times, shard (the first that has it), and the words first .. last (from 0, end exclusive) that it covers."""
    times = slots.groupBy("sid", "index").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    filled = packed.filter(F.col("size") > 0)
    parts = filled.withColumn("index", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    first = F.greatest(F.lit(0), F.col("index") * block - F.col("start"))
    last = F.least(F.col("size"), (F.col("index") + 1) * block - F.col("start"))
    return parts.join(times.hint("merge"), ["sid", "index"]).select("row", "tie", "sid", "size", "index", "times", "shard", first.alias("first"), last.alias("last"))


def mix_digest(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and first_shard, the first output
    shard that has words of it (null: none)."""
    packed, slots, targets = mixed(reread(df, "mix-docs"), text, source, doc_id, block)
    packed = written(packed, "mix-packed")
    taken = taken_blocks(packed, slots, block).groupBy("row").agg(F.sum(F.col("times") * (F.col("last") - F.col("first"))).alias("taken"), F.min("shard").alias("first_shard"))
    joined = packed.join(taken, "row", "left").join(targets.select("sid", "source_size", "target"), "sid")
    return joined.select("doc_id", "size", F.col("source_size").cast("long"), "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), F.col("first_shard").cast("long").alias("first_shard"))


def mix_documents(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, n_chars: str | None = None) -> DataFrame:
    """The mix as documents: a row of df for each document that gives words, its
    text made of the taken stretches, pass by pass, with their own white space.
    Columns of df are kept; n_chars names one to set to the new length."""
    df = reread(df, "mix-docs")
    packed, slots, targets = mixed(df, text, source, doc_id, block)
    piece = F.struct("first", "last", "times")
    pieces = taken_blocks(packed, slots, block).groupBy("row", "tie").agg(F.sort_array(F.collect_list(piece)).alias("p"))

    (new,) = fresh(df, "mixed_text")
    joined, guarded = rows_by_number(pieces, df, text)
    body = let(
        F.split(F.btrim(F.col(f"d.`{text}`"), F.lit(BLANK)), AFTER_SPACE),
        lambda words: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1)), lambda p: _stretches(words, p)), "\n"),
    )
    joined = joined.withColumn(new, guarded(F.btrim(body, F.lit(BLANK))))
    out = {text: F.col(new)} | ({n_chars: F.char_length(new).cast("long")} if n_chars else {})
    return joined.select(*(out.get(c, F.col(f"d.`{c}`")).alias(c) for c in df.columns))


def _stretches(words: Column, pass_no: Column) -> Column:
    """The words that the mix takes in one pass, each with the white space after it."""
    parts = F.filter(F.col("m.p"), lambda x: x["times"] > pass_no)
    return F.array_join(F.transform(parts, lambda x: F.array_join(F.slice(words, (x["first"] + 1).cast("int"), (x["last"] - x["first"]).cast("int")), "")), "")
