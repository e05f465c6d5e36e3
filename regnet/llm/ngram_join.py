"""Similarity join of documents on word shingles with adaptive multi-match prefixes.

A document's tokens (hashes of its distinct shingles) are ordered rare first, by a sketch of document counts of
fixed size. If two sets reach the threshold, their l-prefixes (n - ceil(t n) + l tokens) share l tokens. Each
document picks its own l: a longer prefix costs more postings, and more shared tokens rule out more candidates;
l minimises postings plus estimated candidates per shared token. A pair becomes a candidate with min(l, l') shared
prefix tokens.

Equal sets are one node. Prefix tokens are shuffled once, packed, and those of one set only go there; tokens that
the sketch calls frequent need no such test and are dealt with their sets, so that no list meets in one task. No
group is expanded into all pairs: first each node is verified against one node that shares most of its lists (the
list's most typical one); then only candidates in different components are enumerated and verified, so
no link that could join two components is lost. Lists of more than HOT sets don't bring pairs together by
themselves: a pair that shares c tokens of shorter lists has an overlap of c and the rest of the set whose prefix
ends first at most, so members of a large group that differ in rarer tokens are ruled out before a row is made. So
are those whose sets' parity bitmaps differ in too many bits: no fewer tokens than bits are in one of the two sets only.
Verification compares whole sets.

Defined cases: null or empty text has no shingles and links with nothing; fewer words than a shingle are one
shingle; ties have no effect, as a pair at exactly the threshold links; null ids link like others, but the
component's id is the smallest that isn't null; repeated rows share a node; no rows give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps
from .common import KEY, NON_SPACE, TEXT_ROWS, lean, row_key, stored
from .components import components

SHINGLE, PERCENT = 5, 80
#: Counters of the sketch (16 MB): the bound of what is broadcast. Beyond its capacity more tokens look alike, which
#: costs time but changes no result.
COUNTERS = 1 << 22
#: Tokens that a task packs at once, tokens of a part, and estimated count from which a token is frequent.
PACK, PART_TOKENS, HOT_DF = 1 << 20, 1 << 19, 200
#: Bits of the map of the sets that are wanted (4 MB).
ID_BITS = 1 << 25
SKETCH_PARTS = 64
#: Lists of more sets than this are met only by sets that can reach the threshold without a token of a shorter list.
HOT = 48
#: Work of verifying a candidate, in postings read; accidental candidates expected of a posting.
VERIFY_COST, ACCIDENTS = 20.0, 0.05
#: Tokens below this share of the hash range are compared first.
FIRST_SHARE = 3 / 16
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Pairs whose sets are compared at once.
PAIR_ROWS = 1024
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = pow(int(_M), -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of the hash's base and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, PIECE + 1)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(m - 1, x, np.uint64)]) for x in (_M, np.uint64(_INVERSE)))
        return self.up, self.down


def _rolled(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words."""
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * _M + w[i : i + n]
    return mixed(h)


def token_sets(texts: pa.Array, powers: Powers, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles. Texts are hashed as bytes, many at a time: only A-Z are
    lower-cased, and words are what the six white-space bytes part."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE, "right")) - 1)
        d, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        up, down = powers.of(len(d) + 1)
        char = ~_SPACE[d]
        before, after = np.r_[False, char[:-1]], np.r_[char[1:], False]
        before[at[:-1][at[:-1] < len(d)]] = False
        after[at[1:][at[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(char & ~before[: len(d)]), np.flatnonzero(char & ~after[: len(d)]) + 1
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum((_LOW[d] + np.uint64(1)) * up[: len(d)], out=sums[1:])
        w = mixed((sums[ends] - sums[starts]) * down[starts])
        h = _rolled(w, size) if len(w) >= size else w[:0]
        bounds = np.searchsorted(starts, at).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield np.unique(h[a : b - size + 1]) if b - a >= size else _rolled(w[a:b], b - a) if b > a else w[:0]
        i = j


def set_id(tokens: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(tokens.tobytes()), np.int64)[0])


def need(n: int, percent: int = PERCENT) -> int:
    """The least overlap with any set that reaches the threshold."""
    return -(-percent * n // 100)


def _describe(size: int):
    """Per document: its id, set size, set id; per task: the sketch's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts = Powers(), np.zeros(COUNTERS, np.uint8)
        names = ["doc_id", *KEY, "n", "sid", "part", "counts"]
        for b in batches:
            n, sid = [], []
            for t in token_sets(b.column("text"), powers, size):
                n.append(len(t))
                sid.append(set_id(t))
                at = (t & np.uint64(COUNTERS - 1)).astype(np.int64)
                counts[at] += counts[at] < 255  # per task; tokens of one document that meet in a counter count once
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int32()), pa.array(sid, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        parts = counts.reshape(SKETCH_PARTS, -1)
        full = [k for k in range(SKETCH_PARTS) if parts[k].any()]
        none = pa.nulls(len(full))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(full, pa.int32()), pa.array([parts[k].tobytes() for k in full], pa.binary())], names)

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for part, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[part] = held.get(part, 0) + np.frombuffer(c, np.uint8).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in held.values()], pa.binary())], ["part", "counts"])


def sketch(described: DataFrame) -> tuple[np.ndarray, int]:
    """Estimated document counts, one per counter, less the load that any counter has, at least 1; and that load."""
    rows = described.filter("part IS NOT NULL").select("part", "counts").repartition(SKETCH_PARTS, "part").mapInArrow(lean(_sum), "part int, counts binary")
    out = np.zeros((SKETCH_PARTS, COUNTERS // SKETCH_PARTS), np.int32)
    for r in rows.collect():  # SKETCH_PARTS rows, 8 MB
        out[r[0]] = np.frombuffer(r[1], np.int32)
    out = out.reshape(-1)
    load = int(np.median(out))
    return np.maximum(out - 2 * load, 1), load


def prefix(tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, float]:
    """(prefix tokens, l, how typical the set is: its mean log count)."""
    df = place(tokens, counts) >> 40
    order = np.argsort(df, kind="stable")
    n, least = len(tokens), need(len(tokens), percent)
    cost = np.cumsum(df[order])
    base = n - least
    ls = np.arange(1, least + 1)
    read = cost[base + ls - 1]
    candidates = (read - (base + ls) + ACCIDENTS * (base + ls)) / ls
    best = int(ls[np.argmin(read + VERIFY_COST * candidates)])
    return tokens[order[: base + best]], best, float(np.log2(df).mean())


def place(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The place of tokens in the common order, as numbers that compare like it."""
    df = np.minimum(counts[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)], (1 << 22) - 1).astype(np.int64)
    return (df << 40) | (tokens >> np.uint64(24)).astype(np.int64)


def marks(tokens: np.ndarray) -> list[int]:
    """The set's parity bitmap: bit k tells whether an odd number of its tokens fall on k."""
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % (64 * len(_MARKS)), minlength=64 * len(_MARKS)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _places(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions of each token."""
    mask = np.uint64(bits - 1)
    return np.stack([(tokens >> np.uint64(s)) & mask for s in (2, 35)], 1).astype(np.int64)


def _sets_once(b: pa.RecordBatch, powers: Powers, seen: set, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sets of a batch, each once per task as far as memory allows."""
    for t in token_sets(b.column("text"), powers, size):
        sid = set_id(t)
        if len(t) and sid not in seen:
            if len(seen) >= 1_000_000:
                seen.clear()
            seen.add(sid)
            yield sid, t


_PACKED = pa.schema([("part", pa.int32()), ("hot", pa.bool_()), ("tokens", pa.binary()), ("sids", pa.binary()), ("runs", pa.binary()), ("sets", pa.binary())])
_PACKED_DDL = "part int, hot boolean, tokens binary, sids binary, runs binary, sets binary"
#: Numbers of a set, end to end: its id, size, tokens outside the prefix, l, how typical it is, place of the prefix's last token.
_SET = ["sid", "n", "free", "l", "typical", "last"]
#: Parity bitmap of a whole set (256 bits): sets of up to some 500 shingles that differ too much are told apart by it.
_MARKS = ["m0", "m1", "m2", "m3"]


def _dealt(tokens: np.ndarray, sids: np.ndarray, hot: np.ndarray, sets: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part that has any: tokens, and the sets they are of as runs. Tokens that the sketch calls frequent are
    dealt with their set, all others by themselves, so that those of one token meet; sets by their id."""
    h = mixed(tokens ^ np.where(hot, mixed(sids.view(np.uint64)), np.uint64(0)))
    part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64) * 2 + hot
    order = np.argsort(part, kind="stable")  # in a part tokens stay in order of their sets
    part, tokens, sids = part[order], tokens[order], sids[order]
    home = (mixed(sets[:, 0].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    rows = []
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    for i, j in zip(first, np.r_[first[1:], len(part)], strict=True):
        s = sids[i:j]
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        rows.append((int(part[i]) // 2, bool(part[i] & 1), tokens[i:j].tobytes(), s[at].tobytes(), np.diff(np.r_[at, j - i]).astype(np.int32).tobytes(), None))
    for k in np.unique(home):
        rows.append((int(k), False, None, None, None, sets[home == k].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _prefixes(counts: object, hot_from: int, size: int, percent: int, parts: int):
    """The prefixes of the sets, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        tokens: list[np.ndarray] = []
        sets: list[tuple] = []
        held = 0

        def packed() -> pa.RecordBatch:
            t = np.concatenate(tokens)
            sids = np.repeat(np.array([x[0] for x in sets], np.int64), [len(x) for x in tokens])
            return _dealt(t, sids, place(t, counts.value) >> 40 >= hot_from, np.array(sets, np.int64), parts)

        for b in batches:
            for sid, t in _sets_once(b, powers, seen, size):
                p, best, typical = prefix(t, counts.value, percent)
                tokens.append(p)
                sets.append((sid, len(t), len(t) - len(p), best, round(typical * 1000), int(place(p[-1:], counts.value)[0]), *marks(t)))
                held += len(p)
                if held >= PACK:
                    yield packed()
                    tokens, sets, held = [], [], 0
        if sets:
            yield packed()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of more than one set, with the sets, each once; and a row (token null) for each set."""
    tokens, sids, hot, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros((0, len(_SET) + len(_MARKS)), np.int64)]
    for b in batches:
        for row in b.to_pylist():
            if row["sets"] is not None:
                sets.append(np.frombuffer(row["sets"], np.int64).reshape(-1, len(_SET) + len(_MARKS)))
            else:
                tokens.append(np.frombuffer(row["tokens"], np.uint64))
                sids.append(np.repeat(np.frombuffer(row["sids"], np.int64), np.frombuffer(row["runs"], np.int32)))
                hot.append(np.full(len(tokens[-1]), row["hot"]))
    t, s, h, every = (np.concatenate(x) for x in (tokens, sids, hot, sets))
    order = np.lexsort((s, t))
    t, s, h = t[order], s[order], h[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])][: len(t)]
    t, s, h = t[new], s[new], h[new]
    same = t[1:] == t[:-1]
    keep = h | np.r_[False, same][: len(t)] | np.r_[same, False][: len(t)]
    t, s = t[keep].view(np.int64), s[keep]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.int64() for _ in _MARKS]]
    for i in range(0, len(t), 100_000):
        n = len(t[i : i + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(t[i : i + n]), pa.array(s[i : i + n]), *[pa.nulls(n, k) for k in kinds[2:]]], ["token", *_SET, *_MARKS])
    every = every[np.unique(every[:, 0], return_index=True)[1]]
    for i in range(0, len(every), 100_000):
        x = every[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(x), kinds[0]), *[pa.array(np.ascontiguousarray(c)).cast(k) for c, k in zip(x.T, kinds[1:], strict=True)]], ["token", *_SET, *_MARKS])


def _wanted(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield _places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), ID_BITS)


def _sets(bits: object, size: int, share: float):
    """The wanted sets: all their tokens, or those in the first share of the hash range."""
    end = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for b in batches:
            rows: list[tuple] = []
            for sid, t in _sets_once(b, powers, seen, size):
                if bitmaps.known(bits.value, _places(np.array([sid], np.int64).view(np.uint64), ID_BITS))[0]:
                    rows.append((sid, len(t), (t[: np.searchsorted(t, end, "right")] if share < 1 else t).tobytes()))
            sid, n, tokens = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(tokens, pa.binary())], ["sid", "n", "tokens"])

    return run


def _linked(percent: int):
    """Pairs whose overlap reaches the threshold, counting tokens that weren't sent as shared where they can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y, m, n in zip(b.column("x"), b.column("y"), b.column("m").to_pylist(), b.column("n").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) + min(m - len(x), n - len(y))
                ok.append(100 * both >= percent * (m + n - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _reaching(pairs: DataFrame, documents: DataFrame, size: int, percent: int, share: float) -> DataFrame:
    sc = documents.sparkSession.sparkContext
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b"))
    bits = sc.broadcast(bitmaps.filled(ids, _wanted, ID_BITS, "once"))
    sets = documents.select("text").mapInArrow(lean(_sets(bits, size, share), TEXT_ROWS), "sid long, n int, tokens binary").dropDuplicates(["sid"])
    sets = stored(sets, "sets")
    x = sets.select(F.col("sid").alias("a"), F.col("n").alias("m"), F.col("tokens").alias("x"))
    y = sets.select(F.col("sid").alias("b"), "n", F.col("tokens").alias("y"))
    return stored(pairs.select("a", "b").join(y, "b").join(x, "a").mapInArrow(lean(_linked(percent), PAIR_ROWS), "a long, b long"), "reaching")


def verified(pairs: DataFrame, documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b: set ids) whose whole sets reach the threshold. A part of each set is compared first: of sets
    with little in common it rules out the threshold for certain, and only the others are moved whole."""
    return _reaching(_reaching(pairs, documents, size, percent, FIRST_SHARE), documents, size, percent, 1.0)


def grouped(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, the row's key (_k1, _k2), n (size of its set), sid (the set) and label (the same in a component) for each row."""
    sc = documents.sparkSession.sparkContext
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    told = stored(keyed.mapInArrow(lean(_describe(size), TEXT_ROWS), "doc_id long, _k1 long, _k2 int, n int, sid long, part int, counts binary"), "shingle-sets")
    base = told.filter("part IS NULL").select("doc_id", *KEY, "n", "sid")
    estimates, counts_load = sketch(told)
    counts = sc.broadcast(estimates)
    text = docs.select("text")
    parts = max(1, (base.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100 // PART_TOKENS)
    hot_from = HOT_DF + 8 * math.isqrt(counts_load)  # over what chance adds to a counter
    packed = text.mapInArrow(lean(_prefixes(counts, hot_from, size, percent, parts), TEXT_ROWS), _PACKED_DDL)
    shared = stored(packed.repartition(parts, "part").mapInArrow(lean(_shared), "token long, sid long, n int, free int, l int, typical int, last long, m0 long, m1 long, m2 long, m3 long"), "shared")
    post = shared.filter("token IS NOT NULL").select("token", "sid")
    # what a set can share with one whose prefix doesn't end before its own: all outside its prefix, and of that the tokens of
    # other prefixes. A partner with a shorter prefix may hold more of it, so this is a bound for pairs and not for sets
    sets = shared.filter("token IS NULL").select(*_SET).join(post.groupBy("sid").agg(F.count(F.lit(1)).alias("own")), "sid")
    sets = sets.withColumn("most", (F.col("free") + F.col("own")).cast("int")).drop("own")
    postings = stored(post.join(sets, "sid"), "postings")

    def bound(m_most: Column, m_last: Column, n_most: Column, n_last: Column) -> Column:
        """Of two prefixes the one that ends first holds all that the other set shares with it, so what it can share bounds the overlap."""
        return F.when(m_last <= n_last, m_most).otherwise(n_most)

    def alike(most: Column, m: Column, n: Column) -> Column:
        """Whether an overlap of most reaches the threshold; sizes may not differ too much."""
        return (most * (100 + percent) >= (m + n) * percent) & (F.least(m, n) * 100 >= F.greatest(m, n) * percent)

    col, other_col = F.col, lambda c: F.col(f"b{c}")
    cols = ("n", "most", "last", "l")
    pivots = postings.groupBy("token").agg(F.max(F.struct("typical", "sid", *cols)).alias("p"), F.count(F.lit(1)).alias("lists"))
    pivots = stored(pivots.select("token", "lists", F.col("p.sid").alias("p"), *[F.col(f"p.{c}").alias(f"b{c}") for c in cols]), "pivots")
    star = postings.join(pivots, "token").filter((F.col("sid") != F.col("p")) & alike(bound(col("most"), col("last"), col("bmost"), col("blast")), col("n"), col("bn")))
    star = star.groupBy("sid", "p").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("l", "bl")).alias("least")).filter("2 * shared >= least")
    star = star.groupBy("sid").agg(F.max(F.struct("shared", "p"))["p"].alias("b")).withColumnRenamed("sid", "a")
    star = stored(star, "star")
    links = verified(star, docs, size, percent)

    labels = components(links)
    named = labels.withColumnRenamed("node", "sid")
    met = postings.select("token", "sid").join(named, "sid", "left").groupBy("token").agg(*[f(F.coalesce("label", "sid")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))], F.count(F.lit(1)).alias("lists"))
    met = met.select("token", (F.col("lists") > HOT).alias("hot"), (F.col("lo") < F.col("hi")).alias("split")).filter("hot OR split")
    # tokens go to their sets alone; what is told of a set meets them there
    each = postings.select("sid", "free", *cols).dropDuplicates(["sid"]).join(shared.filter("token IS NULL").select("sid", F.array(*_MARKS).alias("marks")), "sid")
    at = postings.select("token", "sid").join(met, "token").join(each.join(named, "sid", "left"), "sid")
    own = F.sum(F.col("hot").cast("int")).over(Window.partitionBy("sid"))  # of a set's prefix
    at = at.select("token", "sid", *cols, "hot", "split", (F.col("free") + own).alias("warm"), F.coalesce("label", "sid").alias("label"), F.when(F.col("hot"), F.col("marks")).alias("marks"))
    at = stored(at.filter("split").drop("split"), "split-lists")
    carried = (*cols, "warm", "label", "marks")
    rest = at.withColumnRenamed("sid", "a").join(at.select("token", F.col("sid").alias("b"), *[F.col(c).alias(f"b{c}") for c in carried]), "token")
    warm = bound(col("warm"), col("last"), other_col("warm"), other_col("last"))  # at most so many shared tokens that aren't in shorter lists
    most = F.when(F.col("hot"), warm).otherwise(bound(col("most"), col("last"), other_col("most"), other_col("last")))
    rest = rest.filter((F.col("label") < F.col("blabel")) & alike(most, col("n"), other_col("n")))
    apart = sum((F.bit_count(F.col("marks")[i].bitwiseXOR(F.col("bmarks")[i])) for i in range(len(_MARKS))), F.lit(0))  # at least so many tokens are in one set only
    both = F.col("n") + F.col("bn")
    rest = rest.filter(~F.col("hot") | ((both - apart) * (100 + percent) >= 2 * percent * both))
    rest = rest.select("a", "b", "hot", F.least("l", "bl").alias("l"), warm.alias("warm"), (F.col("n") + F.col("bn")).alias("both"))
    rest = rest.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.count_if(~F.col("hot")).alias("cold"), *[F.min(c).alias(c) for c in ("l", "warm", "both")])
    reach = lambda overlap: overlap * (100 + percent) >= F.col("both") * percent
    rest = rest.filter(reach(F.col("cold") + F.col("warm")) & (~reach(F.col("warm")) | (F.col("shared") >= F.col("l")))).select("a", "b")
    tried = star.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    rest = rest.join(tried, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")
    more = verified(stored(rest, "rest"), docs, size, percent)
    labels = components(links.union(more))

    named = labels.withColumnRenamed("node", "sid")
    # rows of one set may be many; labels are few a set
    return base.join(named, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def near_groups(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents."""
    rows = stored(grouped(documents, size, percent).select("doc_id", "n", "label"), "grouped")
    smallest = stored(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")), "smallest")  # so that a large group's rows can be dealt over tasks
    out = rows.join(smallest, "label")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """documents with one row of each group of near copies. Columns stay as they are.

    The row with the smallest doc_id stays (nulls last); of texts that share it, the one first by hash. Rows are chosen,
    not ids: of repeated rows one stays, and rows that share an id but not a text are told apart. Rows without words
    are no copies of anything and all stay."""
    rows = grouped(documents, size, percent).filter("n > 0")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("p"))
    names = [f"_regnet{k}" for k in KEY]
    first = first.select(*[F.col(f"p.{k}").alias(x) for k, x in zip(KEY, names, strict=True)])
    worded = F.coalesce(F.col("text").rlike(NON_SPACE), F.lit(False))
    # repeated rows are reduced in the tasks that read them, so that many of them don't meet in one place
    own = documents.filter(worded).withColumns(dict(zip(names, row_key(F.col("doc_id").cast("long"), F.col("text")), strict=True))).dropDuplicates(names)
    own = own.join(first, names, "left_semi").select(*documents.columns)
    return own.unionAll(documents.filter(~worded))
