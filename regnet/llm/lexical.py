"""Ranked lexical search over a block-max index.

The index has a row for each range of documents (a block): the block's terms with the highest impact that each has in it and
the number of documents that hold it, and the documents' own terms and counts (forward index), as packed arrays. A term's
impact in a document depends on the document's length against the mean, so lengths are summed up before.

A search gets the terms' document counts from the blocks, then each block's bound for each query: the sum of the query's
weights times the block's highest impacts. The FIRST blocks of each query by bound are scored, which gives it a threshold:
the score of its k-th document. Then each task goes through its blocks by falling bound and scores those that reach the
threshold of some query, which rises as documents are found. A block below is passed over; it can't hold a result.
Scores are whole numbers, so the result is exact.

Defined cases: null texts, texts without a term and empty tables give nothing; repeated documents rank one by one, null ids
last among equal scores; each row of queries gets its own result; extra columns are ignored. A block's rows are a run of
rows as the table is read; where that is done anew, a whole block comes again.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents and entries after which a block ends; blocks scored first for each query; terms of the queries that are sent to tasks at once.
DOCS, ENTRIES, FIRST, TERMS = 64, 16384, 4, 200_000
K = 10
#: Rows of a batch that are unpacked at once.
ROWS = 128
NULL_ID = 2**63 - 1
_KEPT = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())
#: Separators become spaces, A-Z a-z; bytes of characters beyond ASCII stay.
_LOWER = bytes(ord(chr(c).lower()) if c in _KEPT and c < 128 else c if c in _KEPT else 32 for c in range(256))
_WORD = np.array([c in _KEPT for c in range(256)])
#: Arrays of a block, packed as the narrowest unsigned numbers: by document, and by document and term of it. What bounds need.
_BY_DOC, _BY_ENTRY = ("length", "entries"), ("term", "count")
_BOUNDS = ("block", "terms", "n_terms", "size", "top")
_INDEX = "block long, terms binary, n_terms int, size binary, top binary, docs binary, doc_ids binary, length binary, entries binary, n_entries int, term binary, count binary"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def impacts(count: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's part of a document's score before its weight."""
    return (1_000_000_000 * count) // (1000 * count + 8 * (25 + (75 * length * n_docs) // n_terms))


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def _counted(text: pa.LargeBinaryArray) -> np.ndarray:
    """Terms of each text: the places where one begins."""
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    word = _WORD[np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = word[first]
    return np.diff(np.searchsorted(np.flatnonzero(begins), at))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and all terms."""
    docs = total = 0
    for b in batches:
        for a in range(0, len(b), ROWS):
            n = _counted(pc.fill_null(b.column("text").slice(a, ROWS), "").cast(pa.large_binary()))
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_pydict({"n_docs": [docs], "n_terms": [total]})


def _packed(a: np.ndarray) -> bytes:
    top = int(a.max(initial=0))
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else np.uint8).astype(np.int64)


def _block(block: int, held: list[tuple[int, int, Counter]], n_docs: int, n_terms: int) -> tuple:
    of = [c for *_, c in held]
    words = pa.array([t for c in of for t in c], pa.binary()).dictionary_encode()
    at = words.indices.to_numpy().astype(np.int64)
    count = np.array([n for c in of for n in c.values()], np.int64)
    entries = np.array([len(c) for c in of])
    length = np.array([n for _, n, _ in held], np.int64)
    top = np.zeros(len(words.dictionary), np.int64)
    np.maximum.at(top, at, impacts(count, np.repeat(length, entries), n_docs, n_terms))
    distinct = words.dictionary.to_pylist()
    by_term = map(_packed, (np.array([len(t) for t in distinct]), top, np.bincount(at, minlength=len(top))))
    return block, b"".join(distinct), len(distinct), *by_term, np.array([d for d, *_ in held], np.int64).tobytes(), _packed(length), _packed(entries), len(at), _packed(at), _packed(count)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _rows(found: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in _INDEX.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], list(names))


def _indexed(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, block, found = [], 0, None, []
        for b in batches:
            block = b.column("part")[0].as_py() << 32 if block is None and len(b) else block
            for doc_id, text in ((d, x) for a in range(0, len(b), ROWS) for d, x in zip(b.column("doc_id").slice(a, ROWS).to_pylist(), b.column("text").slice(a, ROWS).to_pylist(), strict=True)):
                words = terms(text)
                if words:
                    held.append((NULL_ID if doc_id is None else doc_id, len(words), Counter(words)))
                    entries += len(held[-1][2])
                    if len(held) >= DOCS or entries >= ENTRIES:
                        found.append(_block(block, held, n_docs, n_terms))
                        held, entries, block = [], 0, block + 1
                        if len(found) >= 32:
                            yield _rows(found)
                            found = []
        if held:
            found.append(_block(block, held, n_docs, n_terms))
        if found:
            yield _rows(found)

    return run


class Index:
    """Blocks as a table in the shared folder, with the number of documents that have a term and of all their terms."""

    def __init__(self, blocks: DataFrame, n_docs: int, n_terms: int) -> None:
        self.blocks, self.n_docs, self.n_terms = blocks, n_docs, n_terms


def build(documents: DataFrame) -> Index:
    """The index of documents (doc_id, text)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs, n_terms = rows.select("text").mapInArrow(_totals, "n_docs long, n_terms long").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    blocks = rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_indexed(n_docs, max(n_terms, 1)), _INDEX)
    return Index(stored(blocks, "lexical"), n_docs, n_terms)


class Queries:
    """A batch of queries as flat arrays, sorted by query: which query, which of the batch's terms, and how much it weighs."""

    def __init__(self, texts: list[str]) -> None:
        counts = [Counter(terms(t)) for t in texts]
        self.n = len(texts)
        self.words = sorted({t for c in counts for t in c})
        place = {t: i for i, t in enumerate(self.words)}
        self.query = np.array([i for i, c in enumerate(counts) for _ in c], np.int64)
        self.term = np.array([place[t] for c in counts for t in c], np.int64)
        self.weight = np.array([n for c in counts for n in c.values()], np.int64)
        self.has, self.first = np.unique(self.query, return_index=True)  # queries with terms, and where they begin

    def weigh(self, n_docs: int, holding: dict[int, int]) -> None:
        self.weight *= np.array([weight(n_docs, holding[t]) if t in holding else 0 for t in range(len(self.words))], np.int64)[self.term]

    def known(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """For the terms of all rows: their numbers here or -1, and where rows begin and end."""
        at = np.concatenate([[0], np.cumsum(b.column("n_terms").to_numpy())])
        ends = np.concatenate([[0], np.cumsum(_flat(b, "size", "n_terms"))]).astype(np.int64)
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(b.column("terms").to_pylist()))])
        return pc.fill_null(pc.index_in(text, value_set=pa.array(self.words, pa.large_binary())), -1).to_numpy().astype(np.int64), at

    def bounds(self, of_term: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        out[self.has] = np.add.reduceat(self.weight * of_term[self.term], self.first)
        return out

    def scores(self, block: dict[str, np.ndarray], ids: np.ndarray, wanted: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries of wanted (a mask) that meet the block, and their scores by document."""
        size = block["entries"]
        doc = np.repeat(np.arange(len(size)), size)
        term = ids[block["term"]]
        mine = np.flatnonzero(term >= 0)
        row_of = np.full(len(self.words), -1, np.int64)
        there = np.unique(term[mine])
        row_of[there] = np.arange(len(there))
        table = np.zeros((len(there), len(size)), np.int64)
        table[row_of[term[mine]], doc[mine]] = impacts(block["count"][mine], block["length"][doc[mine]], n_docs, n_terms)
        pick = np.flatnonzero(wanted[self.query] & (row_of[self.term] >= 0))
        if not len(pick):
            return np.zeros(0, np.int64), np.zeros((0, len(size)), np.int64)
        query, first = np.unique(self.query[pick], return_index=True)
        return query, np.add.reduceat(self.weight[pick, None] * table[row_of[self.term[pick]]], first)


def _flat(b: pa.RecordBatch, name: str, sizes: str) -> np.ndarray:
    """A packed column of all rows, end to end."""
    rows = [_unpacked(x, n) for x, n in zip(b.column(name).to_pylist(), b.column(sizes).to_pylist(), strict=True)]
    return np.concatenate(rows) if rows else np.zeros(0, np.int64)


def _opened(b: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    """A block's documents."""
    row = {n: b.column(n)[i].as_py() for n in ("doc_ids", "n_entries", *_BY_DOC, *_BY_ENTRY)}
    ids = np.frombuffer(row["doc_ids"], np.int64)
    return {"doc_ids": ids} | {n: _unpacked(row[n], len(ids)) for n in _BY_DOC} | {n: _unpacked(row[n], row["n_entries"]) for n in _BY_ENTRY}


def _holding(asked: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.words), np.int64)
        for b in batches:
            ids, _ = asked.known(b)
            docs = _flat(b, "docs", "n_terms")
            np.add.at(total, ids[ids >= 0], docs[ids >= 0])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])

    return run


def _block_bounds(asked: Queries, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds by block and query; the numbers of the terms, and where blocks begin."""
    ids, at = asked.known(b)
    top = _flat(b, "top", "n_terms")
    out = np.zeros((len(b), asked.n), np.int64)
    of_term = np.zeros(len(asked.words), np.int64)
    for i in range(len(b)):
        here = ids[at[i] : at[i + 1]]
        mine = here >= 0
        of_term[here[mine]] = top[at[i] : at[i + 1]][mine]
        out[i] = asked.bounds(of_term)
        of_term[here[mine]] = 0
    return out, ids, at


def _highest(asked: Queries, n: int):
    """Each task's n blocks of highest bound for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, of = np.zeros((0, asked.n), np.int64), np.zeros((0, asked.n), np.int64)
        for b in batches:
            bound, _, _ = _block_bounds(asked, b)
            block = np.broadcast_to(b.column("block").to_numpy()[:, None], bound.shape)
            best, of = np.concatenate([best, bound]), np.concatenate([of, block])
            keep = np.argsort(-best, 0, kind="stable")[:n]
            best, of = np.take_along_axis(best, keep, 0), np.take_along_axis(of, keep, 0)
        r, q = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, of[r, q], best[r, q])], ["query", "block", "bound"])

    return run


def _scored(asked: Queries, least: np.ndarray, k: int, n_docs: int, n_terms: int):
    """Each task's k documents of highest score for each query, from blocks whose bound reaches the query's threshold (least, then what the task has found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.maximum(least, 1)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * asked.n
        for b in batches:
            bound, ids, at = _block_bounds(asked, b)
            for i in np.argsort(-(bound - floor).max(1), kind="stable"):
                wanted = bound[i] >= floor
                if not wanted.any():
                    continue
                block = _opened(b, int(i))
                query, score = asked.scores(block, ids[at[i] : at[i + 1]], wanted, n_docs, n_terms)
                for j in np.flatnonzero(score.max(1, initial=0) >= floor[query]):
                    q = query[j]
                    good = score[j] >= floor[q]
                    s, d = np.concatenate([found[q][0], score[j][good]]), np.concatenate([found[q][1], block["doc_ids"][good]])
                    first = np.lexsort((d, -s))[:k]
                    found[q] = s[first], d[first]
                    if len(first) == k:
                        floor[q] = max(floor[q], s[first[-1]])
        query = np.repeat(np.arange(asked.n), [len(s) for s, _ in found])
        cols = [query, np.concatenate([d for _, d in found]) if len(found) else query, np.concatenate([s for s, _ in found]) if len(found) else query]
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols]], ["query", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _batch(index: Index, texts: list[str], k: int) -> DataFrame:
    """query (a place in texts), doc_id, score, rank."""
    asked = Queries(texts)
    n_docs, n_terms = index.n_docs, max(index.n_terms, 1)
    counts = index.blocks.select("terms", "n_terms", "size", "docs").mapInArrow(_holding(asked), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    asked.weigh(n_docs, {r.term: r.n for r in counts.collect()})  # as many as the batch has terms, at most
    high = index.blocks.select(*_BOUNDS).mapInArrow(_highest(asked, FIRST), "query long, block long, bound long")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = high.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= FIRST).select("block").distinct()
    first = stored(first, "first-blocks")  # FIRST blocks for each query of the batch, at most
    schema = "query long, doc_id long, score long"
    some = index.blocks.join(F.broadcast(first), "block", "left_semi").mapInArrow(_scored(asked, np.zeros(asked.n, np.int64), k, n_docs, n_terms), schema)
    least = np.zeros(asked.n, np.int64)
    for r in _best(some, k).filter(F.col("rank") == k).select("query", "score").collect():  # one for each query of the batch
        least[r.query] = r.score
    return _best(index.blocks.mapInArrow(_scored(asked, least, k, n_docs, n_terms), schema), k)


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for each row of queries (item_id, text)."""
    spark = queries.sparkSession
    asked = queries.select("item_id", F.coalesce("text", F.lit("")).alias("text")).groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    kind = dict(queries.dtypes)["item_id"]
    asked = stored(asked.withColumn("_at", F.xxhash64("item_id", "text")), "queries")
    size = asked.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x80-\\x{10FFFF}]+")))).first()[0] or 0
    batches = -(-size // TERMS)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for i in range(batches):
        rows = asked.filter(F.pmod("_at", F.lit(batches)) == i).orderBy("_at").collect()  # about TERMS terms
        if rows:
            names = spark.createDataFrame([(q, r["item_id"], r["copies"]) for q, r in enumerate(rows)], f"query long, item_id {kind}, copies long")
            found = _batch(index, [r["text"] for r in rows], k).join(F.broadcast(names), "query")
            found = found.select("item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
            out = out.union(found)
    return out
