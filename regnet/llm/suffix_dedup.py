"""Substring dedup with a logarithmic family of sampled suffix arrays.

Bytes covered by a LENGTH-byte string that also starts in a document with a smaller id are removed. Suffixes are
sampled at the minima of a gram hash over windows of LENGTH - GRAM + 1 grams, so any LENGTH bytes hold a sampled
suffix, the same one wherever they occur. A suffix array orders them by a hash of the gram (its range, and 32 bits more)
and then by 96 bits of all bytes that strings of LENGTH through it can touch (its surroundings).

Documents are packed into chunks of some MB, with the places of their sampled suffixes, a table bucketed by chunk, so
that later joins don't move texts. Each chunk sends its distinct suffixes to the tasks of their gram's range. There
they arrive in batches, in order of document ids: a batch is sorted, merge-scanned against the levels that hold all
smaller ids, and what it has of its own becomes a level; levels of one size merge geometrically. An entry whose whole
surroundings a smaller document has is settled. Where the gram is shared but the surroundings differ, the entry is open,
and so are those that it meets in the levels: in a second round each chunk sends the distinct 128-bit hashes of all
strings of LENGTH through its open grams, with its smallest ids, dealt by the string's hash, so that a hot gram's
contexts spread over all ranges. A gram with more than MIXED surroundings in a chunk is open there without being
asked about, and is told to the others once. Answers come back as bits in the order of the request.

Defined cases: null or empty text has no bytes; texts shorter than LENGTH lose nothing; rows that share a doc_id
don't remove from each other; null ids count as larger than all others and don't remove from each other; overlaps
count; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

LENGTH, GRAM = 50, 24
#: Bytes of text in a chunk, in a partition of chunks, and for each range of hashes.
CHUNK_BYTES, PARTITION_BYTES, RANGE_BYTES = 4 << 20, 16 << 20, 12 << 20
PIECE = 1 << 18
#: Entries of a batch; surroundings of a gram in a chunk beyond which all of them are open.
BATCH, MIXED = 1 << 17, 6
BACK = LENGTH - GRAM
SPAN = LENGTH + BACK
NULL_ID = 2**63 - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
TABLE = "regnet_chunks_"
U = np.uint64


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    out[1:] = U(base)
    return np.cumprod(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


class Hashes:
    """64-bit hashes of any range of bytes of some data (PIECE and a SPAN at most), by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        self.down = _powers(pow(base, -1, 1 << 64), PIECE + 2 * SPAN + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _powers(base, PIECE + 2 * SPAN + 1)[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self) -> np.ndarray:
        n = len(self.sums) - GRAM
        return _mix((self.sums[GRAM:] - self.sums[:n]) * self.down[:n])


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    size, m = 1, v
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def sampled(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Places of the sampled suffixes."""
    found = []
    ends = offs[1:-1, None] - np.arange(1, LENGTH)  # windows from here would reach into the next document
    inside = np.ones(max(len(data) - LENGTH + 1, 0), bool)
    inside[ends[(ends >= 0) & (ends < len(inside))]] = False
    for s in range(0, len(inside), PIECE):
        part = data[s : s + PIECE + LENGTH - 1]
        g = Hashes(part, BASES[0]).grams()
        # the hash's upper bits, then places with later ones smaller: the minimum is the rightmost
        v = (g & ~U(0xFFFFFF)) | (U(0xFFFFFF) - np.arange(len(g), dtype=U))
        low = (U(0xFFFFFF) - (_sliding_min(v, BACK + 1) & U(0xFFFFFF))).astype(np.int64)
        low = low[inside[s : s + len(low)]]
        found.append(low[np.r_[True, low[1:] != low[:-1]][: len(low)]] + s)  # places never go back
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class Row:
    """A row of the table of chunks; its numbers aren't copied."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        self.at = lambda name: batch.column(name)[i]
        self.chunk = self.at("chunk").as_py()

    def numbers(self, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(self.at(name).as_buffer(), kind)

    def answers(self, name: str) -> list[dict]:
        return self.at(name).as_py() or []


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for b in batches:
        for i in range(b.num_rows):
            yield Row(b, i)


def _strings(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts 128-bit hashes, where a new one begins). Equal first halves with other second ones hardly occur, so these are only sorted by then."""
    order = np.argsort(x)
    new = _runs(x[order])
    if (_runs(x[order], y[order]) != new).any():
        order = np.lexsort((y, x))
        new = _runs(x[order], y[order])
    return order, new


class Chunk:
    """A chunk's documents, their sampled suffixes, and the distinct ones among these in order of range and key."""

    def __init__(self, row: Row, ranges: int) -> None:
        self.chunk = row.chunk
        self.ids, self.offs, self.data = row.numbers("ids", np.int64), row.numbers("offs", np.int64), row.numbers("data", np.uint8)
        self.pos = np.cumsum(row.numbers("steps", np.int32), dtype=np.int64)
        self.doc = np.searchsorted(self.offs, self.pos, "right") - 1
        # the bytes that strings of LENGTH through the gram can touch, within the document
        self.lo = np.maximum(self.offs[self.doc], self.pos - BACK)
        self.hi = np.minimum(self.offs[self.doc + 1], self.pos + LENGTH)
        gram, a, c = np.zeros(len(self.pos), U), np.zeros(len(self.pos), U), np.zeros(len(self.pos), np.uint32)
        for inside, first, h1, h2 in self.pieces(self.pos):
            p, lo, hi = self.pos[inside] - first, self.lo[inside] - first, self.hi[inside] - first
            where = (p - lo).astype(U) * U(131) + (hi - p).astype(U)
            gram[inside], a[inside], c[inside] = h1.of(p, p + GRAM), h1.of(lo, hi) + where, (h2.of(lo, hi) + where) >> U(32)
        gram = _mix(gram)  # minima of windows are small
        gram = ((gram >> U(32)) * U(ranges) & ~U(0xFFFFFFFF)) | (gram & U(0xFFFFFFFF))  # the range, and 32 other bits
        doc_ids = self.ids[self.doc]
        order = np.lexsort((doc_ids, c, a, gram))
        gram, a, c = gram[order], a[order], c[order]
        new = _runs(gram, a, c)
        self.of = np.empty(len(order), np.int64)  # the distinct suffix of each
        self.of[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.gram, self.a, self.c, self.at = gram[first], a[first], c[first], order[first]
        self.least = doc_ids[self.at]
        run = _runs(self.gram)
        begin = np.flatnonzero(run)
        self.mixed = np.repeat(np.diff(np.r_[begin, len(run)]) > MIXED, np.diff(np.r_[begin, len(run)]))
        self.asked = np.flatnonzero(~self.mixed | run)
        bounds = np.searchsorted(self.gram[self.asked] >> U(32), np.arange(ranges + 1))
        self.parts = [(r, bounds[r], bounds[r + 1]) for r in np.flatnonzero(np.diff(bounds))]

    def pieces(self, pos: np.ndarray) -> Iterator[tuple[np.ndarray, int, Hashes, Hashes]]:
        for s in range(0, len(self.data), PIECE):
            inside = np.flatnonzero((pos >= s) & (pos < s + PIECE))
            if len(inside):
                first = max(s - BACK, 0)
                part = self.data[first : s + PIECE + LENGTH]
                yield inside, first, Hashes(part, BASES[0]), Hashes(part, BASES[1])

    def requests(self) -> pa.RecordBatch:
        """For each range the distinct suffixes and the smallest id of each in this chunk; of a mixed gram one, with surroundings of no other."""
        i = self.asked
        own = _mix(self.gram[i] + U(self.chunk))
        a, c = np.where(self.mixed[i], own, self.a[i]), np.where(self.mixed[i], own.astype(np.uint32), self.c[i])
        return _messages(self.chunk, self.parts, (self.gram[i].astype(np.uint32), a, c), self.least[i])

    def answered(self, said: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(whether a smaller document, here or elsewhere, has all around a suffix; whether a distinct suffix is open)."""
        settled, open_ = np.zeros(len(self.gram), bool), self.mixed.copy()
        said = {x["range"]: x for x in said}
        for r, i, j in self.parts:
            if r in said:
                at = self.asked[i:j]
                settled[at], open_[at] = (_bits(said[r][k], j - i) for k in ("a", "b"))
        return (settled & ~self.mixed)[self.of] | (self.least[self.of] < self.ids[self.doc]), open_ | self.mixed


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))[:n].astype(bool)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, seq = TaskContext.get().partitionId() << 32, 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def packed() -> pa.RecordBatch:
        offs, data = np.cumsum([0, *map(len, texts)]).astype(np.int64), b"".join(texts)
        steps = np.diff(sampled(offs, np.frombuffer(data, np.uint8)), prepend=0).astype(np.int32)
        row = [np.array(ids, np.int64).tobytes(), offs.tobytes(), data, steps.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), *[pa.array([x], pa.binary()) for x in row]], ["chunk", "ids", "offs", "data", "steps"])

    for b in batches:
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            ids.append(NULL_ID if i is None else i)
            texts.append(text.as_py().encode("utf-8", "surrogatepass") if text.is_valid else b"")
            size += len(texts[-1])
            if size >= CHUNK_BYTES or len(ids) >= 60_000:
                yield packed()
                ids, texts, size, seq = [], [], 0, seq + 1
    if ids:
        yield packed()


_MESSAGE = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary())])
_MESSAGE_DDL = "range int, chunk long, keys binary, docs binary, ids binary"


def _messages(chunk: int, parts: list[tuple[int, int, int]], keys: tuple[np.ndarray, ...], ids: np.ndarray) -> pa.RecordBatch:
    """A row for each range that has any keys: the words of its keys one after the other, and their ids (at most 60,000 different ones)."""
    rows = []
    for r, i, j in parts:
        few, at = np.unique(ids[i:j], return_inverse=True)
        rows.append((r, chunk, b"".join(k[i:j].tobytes() for k in keys), at.astype(np.uint16).tobytes(), few.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_MESSAGE), _MESSAGE, strict=True)], schema=_MESSAGE)


#: The words of a suffix's key, and of a string's.
_SUFFIX, _STRING = (np.uint32, U, np.uint32), (U, U)


def _received(table: pa.Table, words: tuple) -> tuple[list[tuple[int, int, int]], list[np.ndarray], np.ndarray]:
    """The messages as (chunk, range, number of keys), their keys' words, and ids, end to end."""
    told, keys, ids = [], [[np.zeros(0, w)] for w in words], [np.zeros(0, np.int64)]
    for chunk, r, k, docs, few in zip(*(table.column(c).to_pylist() for c in ("chunk", "range", "keys", "docs", "ids")), strict=True):
        n, at = len(docs) // 2, 0
        for w, out in zip(words, keys, strict=True):
            out.append(np.frombuffer(k, w, n, at))
            at += n * np.dtype(w).itemsize
        told.append((chunk, r, n))
        ids.append(np.frombuffer(few, np.int64)[np.frombuffer(docs, np.uint16)])
    return told, [np.concatenate(x) for x in keys], np.concatenate(ids)


def _ask(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield Chunk(row, ranges).requests()

    return run


def _bisect(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted of each q in its own part lo:hi of a."""
    lo, hi = lo.copy(), hi.copy()
    while (act := lo < hi).any():
        mid = (lo + hi) >> 1
        x = a[np.minimum(mid, len(a) - 1)]
        up = act & ((x <= q) if right else (x < q))
        lo, hi = np.where(up, mid + 1, lo), np.where(act & ~up, mid, hi)
    return lo


class Levels:
    """A logarithmic family of suffix arrays: (gram, a, c, id, number of the entry), sorted. Arrays of one size class merge."""

    def __init__(self, entries: int) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.open = np.zeros(entries, bool)

    def add(self, *batch: np.ndarray) -> None:
        """A sorted batch of unsettled entries."""
        while self.levels and len(self.levels[-1][0]) < 2 * len(batch[0]):
            batch = tuple(np.concatenate(x) for x in zip(self.levels.pop(), batch, strict=True))
            order = np.lexsort((batch[3], batch[1], batch[0]))
            batch = tuple(x[order] for x in batch)
        self.levels.append(batch)

    def scan(self, gram: np.ndarray, a: np.ndarray, c: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a smaller id in the levels has the same surroundings, for each entry of a sorted batch. Entries that meet
        their gram with other surroundings are open, on both sides."""
        settled = np.zeros(len(gram), bool)
        for g, la, lc, li, lat in self.levels:
            lo = np.searchsorted(g, gram)
            some = np.flatnonzero(g[np.minimum(lo, len(g) - 1)] == gram)
            lo, hi = lo[some], np.searchsorted(g, gram[some], "right")
            same, end = _bisect(la, lo, hi, a[some], False), _bisect(la, lo, hi, a[some], True)
            there = np.minimum(same, len(g) - 1)
            equal = (end > same) & (lc[there] == c[some])
            settled[some] |= equal & (li[there] < ids[some])
            other = hi - lo > np.where(equal, end - same, 0)
            self.open[at[some[other]]] = True
            edge = np.zeros(len(g) + 1, np.int64)
            np.add.at(edge, lo[other], 1)
            np.add.at(edge, hi[other], -1)
            self.open[lat[np.cumsum(edge[:-1]) > 0]] = True
        return settled


_ANSWER = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_ANSWER_DDL = "chunk long, range int, a binary, b binary"


def _answers(told: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray | None = None) -> pa.Table:
    """Bits for the messages that any bit is set for."""
    rows, at = [], 0
    for chunk, r, n in told:
        x, y = a[at : at + n], None if b is None else b[at : at + n]
        if x.any() or (y is not None and y.any()):
            rows.append((chunk, r, np.packbits(x).tobytes(), None if y is None else np.packbits(y).tobytes()))
        at += n
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_ANSWER), _ANSWER, strict=True)], schema=_ANSWER)


def _settle(table: pa.Table) -> pa.Table:
    told, (gram, a, c), ids = _received(table, _SUFFIX)
    settled, index = np.zeros(len(ids), bool), Levels(len(ids))
    arrival = np.argsort(ids, kind="stable")
    for i in range(0, len(ids), BATCH):
        at = arrival[i : i + BATCH]
        at = at[np.lexsort((ids[at], c[at], a[at], gram[at]))]
        batch = (gram[at], a[at], c[at], ids[at], at)
        done = index.scan(*batch)
        # the same inside the batch
        first = np.flatnonzero(same := _runs(*batch[:3]))
        done |= batch[3][first][np.cumsum(same) - 1] < batch[3]
        begin = np.flatnonzero(run := _runs(batch[0]))
        several = np.add.reduceat(same.astype(np.int64), begin) > 1 if len(begin) else np.zeros(0, bool)
        index.open[at[several[np.cumsum(run) - 1]]] = True
        settled[at] = done
        index.add(*[x[~done] for x in batch])
    return _answers(told, settled, index.open & ~settled)


class Open:
    """The distinct strings of LENGTH through a chunk's open grams: 128-bit hashes in order, and so in order of their ranges,
    with the chunk's smallest ids. Strings inside the surroundings that a smaller document has (whole) are known from there."""

    def __init__(self, c: Chunk, whole: np.ndarray, open_: np.ndarray, ranges: int) -> None:
        edge = np.zeros(len(c.data) + 1, np.int32)
        long = whole & (c.hi - c.lo >= LENGTH)
        np.add.at(edge, c.lo[long], 1)
        np.add.at(edge, c.hi[long] - LENGTH + 1, -1)
        known = np.cumsum(edge) > 0
        self.which = np.flatnonzero(open_)
        self.known = np.zeros(len(self.which), np.uint32)
        at = c.at[self.which]
        pos, found = c.pos[at], [(np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, U), np.zeros(0, U))]
        for inside, first, h1, h2 in c.pieces(pos):
            for j in range(BACK + 1):
                start = pos[inside] - BACK + j
                ok = (start >= c.lo[at[inside]]) & (start + LENGTH <= c.hi[at[inside]])
                told = ok & known[np.maximum(start, 0)]
                self.known[inside[told]] |= np.uint32(1 << j)
                ok &= ~told
                start = start[ok] - first
                found.append((inside[ok].astype(np.int32), np.full(len(start), j, np.uint8), h1.of(start, start + LENGTH), h2.of(start, start + LENGTH)))
        entry, j, x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        ids = c.least[self.which][entry]
        order, new = _strings(x, y)
        self.entry, self.j, ids = entry[order], j[order], ids[order]
        first = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.keys, self.least = (x[order[first]], y[order[first]]), np.minimum.reduceat(ids, first) if len(first) else ids
        self.later = ids > self.least[self.of]  # a smaller id of this chunk has the string
        bounds = np.searchsorted((self.keys[0] >> U(32)) * U(ranges) >> U(32), np.arange(ranges + 1))
        self.parts = [(r, bounds[r], bounds[r + 1]) for r in np.flatnonzero(np.diff(bounds))]

    def masks(self, said: list[dict]) -> np.ndarray:
        """A bit for each string of LENGTH through the open grams that a smaller id has."""
        said = {x["range"]: x for x in said}
        elsewhere = np.zeros(len(self.least), bool)
        for r, i, j in self.parts:
            if r in said:
                elsewhere[i:j] = _bits(said[r]["a"], j - i)
        hit = self.later | elsewhere[self.of]
        m = self.known.copy()
        np.bitwise_or.at(m, self.entry[hit], np.uint32(1) << self.j[hit].astype(np.uint32))
        return m


def _ask_again(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row, ranges)
            o = Open(c, *c.answered(row.answers("first")), ranges)
            yield _messages(c.chunk, o.parts, o.keys, o.least)

    return run


def _compare(table: pa.Table) -> pa.Table:
    """For each string of a chunk a bit: another chunk has it with a smaller id."""
    told, (x, y), ids = _received(table, _STRING)
    order, new = _strings(x, y)
    hit = np.zeros(len(ids), bool)
    if len(ids):
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
        hit[order] = least[np.cumsum(new) - 1] < ids[order]
    return _answers(told, hit)


def _remove(ranges: int, digest: bool):
    def cover(c: Chunk, row: Row) -> np.ndarray:
        whole, open_ = c.answered(row.answers("first"))
        edge = np.zeros(len(c.data) + 1, np.int32)

        def add(lo: np.ndarray, hi: np.ndarray) -> None:
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)

        o = Open(c, whole, open_, ranges)
        masks = np.zeros(len(c.gram), np.uint32)
        masks[o.which] = o.masks(row.answers("second"))
        long = whole & (c.hi - c.lo >= LENGTH)
        add(c.lo[long], c.hi[long])
        masks = np.where(whole, np.uint32(0), masks[c.of])
        for j in range(BACK + 1):
            start = c.pos[((masks >> np.uint32(j)) & 1).astype(bool)] - BACK + j
            add(start, start + LENGTH)
        return np.cumsum(edge[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row, ranges)
            gone = cover(c, row)
            cols: list[list] = [[], [], [], [], []]
            for i, id_ in enumerate(c.ids.tolist()):
                a, e = int(c.offs[i]), int(c.offs[i + 1])
                g = gone[a:e]
                kept = c.data[a:e][~g].tobytes()
                runs = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()) if e > a else 0
                values = (None if id_ == NULL_ID else id_, e - a, int(g.sum()), runs, hashlib.sha256(kept).hexdigest() if digest else kept)
                for col, v in zip(cols, values, strict=True):
                    col.append(v)
            kind = [pa.int64()] * 4 + [pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c_, k) for c_, k in zip(cols, kind, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


def dedup_substrings(documents: DataFrame, digest: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or kept, the bytes that stay) for each row of documents. The
    result reads a table of chunks, kept in the shared folder until clear()."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, ranges = max(1, -(-total // PARTITION_BYTES)), max(1, -(-total // RANGE_BYTES))
    name = f"{TABLE}{uuid.uuid4().hex}"
    chunks = docs.mapInArrow(_pack, "chunk long, ids binary, offs binary, data binary, steps binary")
    chunks.write.bucketBy(parts, "chunk").option("path", scratch(spark, "chunks")).saveAsTable(name)
    chunks = spark.table(name)

    def gathered(answers: DataFrame, col: str) -> DataFrame:
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "a", "b")).alias(col))  # one answer per range, bits of the chunk's entries

    first = chunks.mapInArrow(_ask(ranges), _MESSAGE_DDL).groupBy("range").applyInArrow(_settle, _ANSWER_DDL)
    first = gathered(stored(first, "suffix-first"), "first")
    asked = chunks.join(first, "chunk", "left")
    second = asked.mapInArrow(_ask_again(ranges), _MESSAGE_DDL).groupBy("range").applyInArrow(_compare, _ANSWER_DDL)
    second = gathered(stored(second, "suffix-second"), "second")
    both = chunks.join(first, "chunk", "left").join(second, "chunk", "left")
    last = "kept_sha256 string" if digest else "kept binary"
    return both.mapInArrow(_remove(ranges, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def clear(spark: SparkSession) -> None:
    """Drops the tables of chunks that earlier calls left; their results can't be read any more."""
    for t in spark.catalog.listTables(pattern=f"{TABLE}*"):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")
