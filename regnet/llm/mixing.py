"""Mixing sources to target weights, in DataFrame operations only.

The words of each source are one stream, packed into blocks of a fixed length. A source's slots (passes over all of
its blocks, then a partial pass) are dealt to output shards by independent seeded draws, so each shard's source
counts are multinomial given the totals; a pseudorandom permutation of the source's block numbers gives each block
its slot in each pass. Blocks are written to the shards of their slots, and what the mix takes of a document is read
from the shards as written.

Offsets come from two levels of sums (chunks of a source, then rows of a chunk), so a source with a third of all
rows is spread over many tasks. The only global order is over one row per source. Texts are shuffled once, by chunk: a
task cuts its chunks at the blocks' borders, packs the blocks and writes them to their shards. Only the pieces of blocks
that reach over a chunk's border are shuffled again to meet, two for each chunk. A task writes a file to each shard; for
large inputs tasks are made large enough that files hold about WORDS_PER_FILE words.

Defined cases: null text has size 0; null source is a source of its own, last in order; rows of size 0 are taken
0 times; repeated rows are rows of their own; no rows give no rows; extra columns are ignored; a source's last block
holds the words that are left. Equal input gives equal output: all draws are hashes of a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_SPACE, bounded, let, row_key, scratch, stored

#: Weights of the sources in order, repeating.
WEIGHTS = [5, 2, 1]
#: Primes below 2**21, multipliers of the index permutations.
PRIMES = [2097143, 2097133, 2097131, 2097097, 2097091]
BLOCK = 64
CAP = 3
ROWS_PER_CHUNK = 4000
SHARDS = 64
#: Words in a file of a shard, about, where the input is large.
WORDS_PER_FILE = 4_000_000
MAX_BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """sizes: source, size. Per source: sid (order), source_size, n_rows, weight, target (capped, excess reshared)."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    everyone = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everyone.orderBy(F.asc_nulls_last("source"))) - 1
    s = s.withColumn("sid", rank)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    before = everyone.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(everyone), F.sum("weight").over(everyone)
    # with the sources before this one at their caps, what a unit of weight gets
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (weights - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everyone)["level"])
    return s.select("source", "sid", "source_size", "n_rows", "weight", F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")).alias("target"))


def _in_chunks(docs: DataFrame, sources: DataFrame, seed: int, tasks: int | None = None) -> DataFrame:
    """docs with their source's columns, chunk, row (number in the chunk) and start (offset in the chunk). tasks: how many, if not as the session has it."""
    docs = docs.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    docs = docs.withColumn("chunk", F.pmod(F.hash(F.lit(seed), "doc_id", "_k1"), "n_chunks"))
    docs = docs.repartition(tasks, "sid", "chunk") if tasks else docs
    own = Window.partitionBy("sid", "chunk").orderBy("doc_id", "_k1", "_k2")
    return docs.withColumn("row", F.row_number().over(own)).withColumn("start", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))


def _from_bases(docs: DataFrame, bases: DataFrame) -> DataFrame:
    """start counts from the begin of the source's stream."""
    return docs.join(bases, ["sid", "chunk"]).withColumn("start", F.col("start") + F.col("base")).drop("base", "chunk_size")


def _streams(documents: DataFrame, block: int, cap: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = documents.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(NON_SPACE)), F.lit(0)).cast("long").alias("size"),
        *row_key(F.col("doc_id"), F.col("text")),
    )
    docs = stored(docs, "sizes")  # a few numbers a row
    sources = source_targets(docs.select("source", "size"), cap)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0)
    sources = sources.withColumn("passes", whole.cast("long"))
    rest = F.when(F.col("passes") < cap, F.round((F.col("target") - F.col("passes") * F.col("source_size")) / block)).otherwise(0)
    sources = sources.withColumn("rest", F.least(rest.cast("long"), F.col("n_blocks")))
    sources = stored(sources.withColumn("n_chunks", F.ceil(F.col("n_rows") / ROWS_PER_CHUNK)), "sources")
    small = F.broadcast(sources) if bounded(sources, MAX_BROADCAST_SOURCES) else sources
    rows = _in_chunks(docs, small, seed)
    chunks = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("chunk_size"))
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(chunks.select("sid", "chunk", "chunk_size", F.coalesce(F.sum("chunk_size").over(ahead), F.lit(0)).alias("base")), "chunks")
    return _from_bases(rows, bases), small, bases


def streams(documents: DataFrame, block: int = BLOCK, cap: float = CAP, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows of documents in their source's stream with start offsets, sources with their slot numbers)."""
    rows, small, _ = _streams(documents, block, cap, seed)
    return rows, small


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document and block that it reaches into: block, words of it there, whether it begins the block."""
    last = F.col("start") + F.col("size") - 1
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor(last / block)))
    p = rows.withColumn("block", F.explode_outer(spans))
    lo, hi = F.greatest("start", F.col("block") * block), F.least(last, (F.col("block") + 1) * block - 1)
    return p.withColumn("words", F.coalesce(hi - lo + 1, F.lit(0))).withColumn("begins", F.col("start") <= F.col("block") * block)


def _slotted(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """A row for each pass that takes a block: pass, slot, shard. Slots are the blocks' numbers, permuted."""
    s = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), "passes")))
    fit = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: F.col("n_blocks") % p != 0)
    draw = lambda *x: F.xxhash64(F.lit(seed), "sid", "pass", *x)
    factor = F.element_at(fit, (F.pmod(draw(F.lit("factor")), F.size(fit)) + 1).cast("int"))
    s = s.withColumn("slot", (factor * F.col("block") + F.pmod(draw(F.lit("shift")), "n_blocks")) % F.col("n_blocks"))
    s = s.filter((F.col("pass") < F.col("passes")) | (F.col("slot") < F.col("rest")))
    return s.withColumn("shard", F.pmod(draw("slot"), F.lit(shards)))


def slots(parts: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """One row per output slot: sid, pass, slot, shard, block. Made from the blocks themselves, so as distributed as they are."""
    return _slotted(parts.filter("begins"), shards, seed).select("sid", "pass", "slot", "shard", "block")


def shard_counts(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The multinomial draw: slots of each source in each output shard."""
    rows, _ = streams(documents)
    return slots(pieces(rows), shards).groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n_slots"))


def _cut(words: Column, start: Column, size: Column, block: int) -> Column:
    """The words (parted by spaces) that a document of the stream puts into each block: block, first (word of the document), words."""

    def piece(w: Column, b: Column) -> Column:
        lo, hi = F.greatest(start, b * block), F.least(start + size, (b + 1) * block)
        first, n = lo - start, hi - lo
        return F.struct(b.alias("block"), first.alias("first"), F.array_join(F.slice(w, (first + 1).cast("int"), n.cast("int")), " ").alias("words"))

    reached = F.sequence(F.floor(start / block), F.floor((start + size - 1) / block))
    return let(F.split(words, " "), lambda w: F.transform(reached, lambda b: piece(w, b)))


def _write_shards(documents: DataFrame, sources: DataFrame, bases: DataFrame, shards: int, block: int, seed: int) -> DataFrame:
    spark = documents.sparkSession
    said = let(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(NON_SPACE), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("size"), F.array_join(w, " ").alias("words")))
    docs = documents.select("doc_id", "source", *row_key(F.col("doc_id"), F.col("text")), said.alias("said")).select("doc_id", "source", "_k1", "_k2", "said.size", "said.words")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    tasks = words // (shards * WORDS_PER_FILE)
    of_source = ["sid", "n_blocks", "passes", "rest"]
    docs = _in_chunks(docs, sources.select("source", "source_size", *of_source, "n_chunks"), seed, tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None)
    docs = docs.join(bases, ["sid", "chunk"]).withColumn("start", F.col("start") + F.col("base")).filter("size > 0")
    docs = docs.withColumn("beyond", F.col("base") + F.col("chunk_size"))

    def shared(first: Column, last: Column) -> Column:
        """Whether the first of these blocks begins before the chunk, or the last ends after it."""
        return (first * block < F.col("base")) | (F.least((last + 1) * block, F.col("source_size")) > F.col("beyond"))

    def packed(docs: DataFrame, whole: bool, *by: str) -> DataFrame:
        cut = docs.select("doc_id", *of_source, "source_size", "chunk", "row", "base", "beyond", F.inline(_cut(F.col("words"), F.col("start"), F.col("size"), block)))
        cut = cut.filter(shared(F.col("block"), F.col("block")) != F.lit(whole))
        piece = F.struct("chunk", "row", "doc_id", "first", "words")
        return cut.groupBy(*of_source, *by, "block").agg(F.sort_array(F.collect_list(piece)).alias("p")).drop(*by)  # at most a block's words

    at_border = shared(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    blocks = packed(docs, True, "chunk").unionByName(packed(docs.filter(at_border), False))  # one exchange of the texts serves both
    n = lambda x: F.size(F.split(x["words"], " ")).cast("long").alias("n")
    blocks = _slotted(blocks, shards, seed).select(
        F.col("shard").cast("int").alias("shard"), "sid", "pass", "slot", "block", F.array_join("p.words", " ").alias("words"),
        F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in ("chunk", "row", "doc_id", "first")], n(x))).alias("pieces"),
    )
    path = scratch(spark, "shards")
    blocks.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def mixed_blocks(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix as written, a row per block of a shard: shard, sid, pass, slot, block, words (parted by spaces), pieces
    (of documents, in order: chunk, row, doc_id, first word of the document, n words)."""
    _, sources, bases = _streams(documents, BLOCK, CAP, 17)
    return _write_shards(documents, sources, bases, shards, BLOCK, 17)


def mix(documents: DataFrame) -> DataFrame:
    """Writes the shards. Per row of documents: doc_id, source, size, source_size, target, taken (words of it in the shards)."""
    rows, sources, bases = _streams(documents, BLOCK, CAP, 17)
    shards = _write_shards(documents, sources, bases, SHARDS, BLOCK, 17)
    held = shards.select("sid", F.explode("pieces").alias("p")).groupBy("sid", "p.chunk", "p.row").agg(F.sum("p.n").alias("taken"))
    got = rows.join(held, ["sid", "chunk", "row"], "left")
    return got.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
