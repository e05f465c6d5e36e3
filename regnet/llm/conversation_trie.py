"""Prefix trie of conversations: nodes by digests, counts rolled up to all ancestors by pointer jumping.

A node is a distinct sequence of first turns (role, text). Its key is a SHA-256 chain over the turns' digests, so that a
turn's edge to its parent is known where its conversation is, without a search. The chain runs over blocks of BLOCK turns:
a block starts from the chain over the digests of the blocks before it, found the same way one level up. So no
conversation is held as a whole, and conversations that begin alike share keys.

The rollup doubles: after round k a node holds the sums over its descendants nearer than 2**k and points to its ancestor at
distance 2**k. In the next round each node sends its sums to where it points, combined before the shuffle, and takes over
the pointer that it finds there. Rounds are as many as the depth has binary digits, whatever the number of turns. Nodes
that can neither send nor be sent to any more leave the rounds.

Defined cases: null role or text counts as empty; turns come in order of turn, null first, equal ones by the digest of role
and text; repeated rows are turns of their own; rows without a conv_id take no part; c % 100 has the sign of c; a
conversation that is rebuilt without turns is a member of the root alone; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns whose chain one task follows at once; turn numbers that are ordered together; ids that travel in one string.
BLOCK, SPAN, IDS = 256, 1024, 4096
#: Conversations in a family, and heads 0 to HEADS - 1 that its members share with the first one.
FAMILY, HEADS = 100, 6
ROOT = hashlib.sha256(b"").digest()


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, chars: each turn by its place in its conversation. Turn numbers are ordered in spans
    that are counted up, so that a long conversation spreads over tasks."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**62))).alias("_span"),
        _sha(F.concat(F.length(role), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("chars"),
    )
    near = Window.partitionBy("conv_id", "_span")
    rows = rows.withColumn("_at", F.row_number().over(near.orderBy(F.asc_nulls_first("_turn"), "digest"))).withColumn("_n", F.count(F.lit(1)).over(near))
    before = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.filter("_at = 1").select("conv_id", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(spans, ["conv_id", "_span"]).select("conv_id", (F.col("_before") + F.col("_at")).alias("pos"), "digest", "chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From turns(): the turns of the rebuilt conversations, and conv_id, n: how many each has. A conversation takes its
    first h turns from the first of its family, h by the checksum of its id, and goes on with its own after its first h."""
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own")).withColumn("_first", first).withColumn("_h", F.when(F.col("conv_id") == F.col("_first"), 0).otherwise(h))
    heads = own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv_id").alias("_first")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("_head"))
    convs = sizes.join(heads, "_first", "left").withColumn("_head", F.slice(F.coalesce("_head", F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("_h").cast("int")))
    convs = convs.withColumn("_k", F.size("_head").cast("long"))
    counts = convs.select("conv_id", "_h", "_k", (F.col("_k") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("n"))
    tail = own.join(counts, "conv_id").filter("pos > _h").select("conv_id", (F.col("pos") - F.col("_h") + F.col("_k")).alias("pos"), "digest", "chars")
    return convs.select("conv_id", F.inline("_head")).union(tail), counts.select("conv_id", "n")


def chained(rows: DataFrame, longest: int) -> DataFrame:
    """conv_id, pos (from 1 without gaps, up to longest), digest, chars -> also parent and key: the chains up to the turn before and up to the turn."""
    block = F.floor((F.col("pos") - 1) / BLOCK)
    blocks = rows.groupBy("conv_id", block.alias("_b")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("_x"))
    if longest < BLOCK:
        blocks = blocks.withColumns({"_start": F.lit(ROOT), "_end": F.lit(None).cast("binary")})
    else:  # the chain over whole blocks is where the next block starts, and so the key of a full block's last turn
        whole = blocks.select("conv_id", (F.col("_b") + 1).alias("pos"), _sha(F.aggregate("_x.digest", F.lit(b""), lambda a, x: _sha(F.concat(a, x)))).alias("digest"), F.lit(0).cast("long").alias("chars"))
        ends = chained(whole, -(-longest // BLOCK)).select("conv_id", (F.col("pos") - 1).alias("_b"), F.col("parent").alias("_start"), F.col("key").alias("_end"))
        blocks = blocks.join(ends, ["conv_id", "_b"])
    chain = F.aggregate("_x", F.array("_start"), lambda a, x: F.concat(a, F.array(_sha(F.concat(F.element_at(a, -1), x["digest"])))))
    chain = F.when(F.size("_x") == BLOCK, F.concat(F.slice(chain, 1, BLOCK), F.array("_end"))).otherwise(chain)
    steps = blocks.select("conv_id", "_x", chain.alias("_c")).select(
        "conv_id", F.inline(F.transform("_x", lambda x, i: F.struct(x["pos"].alias("pos"), x["digest"].alias("digest"), x["chars"].alias("chars"), F.get("_c", i).alias("parent"), F.get("_c", i + 1).alias("key"))))
    )
    return steps


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and conv_id: the ids of a key as strings of up to IDS ids."""
    names = ["key", "first", "ids"]
    key, held, out = None, [], []

    def close() -> None:
        if held:
            out.append((key, held[0], ",".join(map(str, held)).encode()))

    for b in batches:
        for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if k != key or len(held) >= IDS:
                close()
                key, held = k, []
            held.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by key and first id: one digest for each key, without holding its ids."""
    key, sha, keys, digests = None, None, [], []
    for b in batches:
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    digests.append(sha.hexdigest())
                key, sha = k, hashlib.sha256(ids)
            else:
                sha.update(b",")
                sha.update(ids)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
            keys, digests = [], []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["key", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """key, conv_id -> key, ends_sha256: the digest of a key's ids, ascending, joined by commas. A digest is made in one
    pass by its nature: ids are put in order and packed by ranges first, so that this pass gets few rows, which it streams."""
    packed = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_packed, "key binary, first long, ids binary")
    return packed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def rollup(nodes: DataFrame, deepest: int, values: tuple[str, ...]) -> DataFrame:
    """nodes: key, parent (null at the root), depth, values -> key and the values summed over each node's subtree."""
    state = nodes.select("key", F.col("parent").alias("_to"), "depth", *values)
    done, reach = [], 1
    while reach <= deepest:
        sent = state.filter("_to IS NOT NULL").groupBy(F.col("_to").alias("key")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        # pointers of nodes that are deep enough; what they point to is never the root
        ahead = state.filter(f"depth >= {2 * reach}").select("key", "_to").join(state.select(F.col("key").alias("_to"), F.col("_to").alias("_next")), "_to").select("key", "_next")
        step = state.drop("_to").join(sent, "key", "left").join(ahead, "key", "left")
        over = (F.col("depth") < 2 * reach) & F.col(f"_{values[0]}").isNull()
        step = step.select("key", F.col("_next").alias("_to"), "depth", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values], over.alias("_over"))
        step = stored(step, "trie-round")
        done.append(step.filter("_over"))
        state, reach = step.filter("NOT _over").drop("_over"), 2 * reach
    out = state.select("key", *values)
    for d in done:
        out = out.union(d.select("key", *values))
    return out


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, counts = rebuilt(stored(turns(conversations), "turns"))
    rows, counts = stored(rows, "rebuilt"), stored(counts, "conversations")
    deepest = counts.agg(F.max("n")).first()[0]
    deepest = 0 if deepest is None else deepest
    steps = chained(rows, deepest).select("conv_id", F.col("pos").alias("depth"), "parent", "key", "chars")
    steps = stored(steps.unionByName(counts.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("chars"))), "steps")
    nodes = steps.groupBy("key", "parent", "depth", "chars").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = stored(nodes, "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = stored(known.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")
    sums = rollup(known, deepest, ("n_leaves", "saved_tokens"))
    ends = ends_digest(steps.join(counts, (steps.conv_id == counts.conv_id) & (steps.depth == counts.n), "left_semi").select("key", "conv_id"))
    up = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = known.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends, "key", "left").join(up, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
