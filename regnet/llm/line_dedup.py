"""Line dedup by two Bloom filters: hashes seen once and seen twice.

Each task fills two bitmaps over the distinct line keys of its documents: a key whose bits are all in "once"
goes to "twice". Bitmaps merge by once = a | b and twice = a2 | b2 | (a & b), which keeps every key that two
documents hold in "twice" (no false negatives). Only lines that pass "twice" are shuffled, as 128-bit hashes,
for the exact count and the choice of the kept document; false positives are dropped there. The bitmaps are sized to
the data, up to MOST_BITS; past that more lines are suspected, and the result stays the same. Texts aren't shuffled:
up to MAX_BROADCAST_KEYS common keys, counted first, go to the tasks that rewrite the documents. Beyond, the keys that
a row loses are joined to it.

Defined cases: null or empty text is one empty line; keys shorter than min_chars never count; a key counts once
per row of documents; ties of the largest doc_id (repeated rows) all keep their lines; null ids count as the
smallest; no rows give no rows; extra columns stay untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .common import TEXT_ROWS, bounded, lean, row_key, stored

MIN_CHARS, MIN_DOCS = 40, 5
#: Most bits of each filter (64 MB); bytes of text for each key that the filter is made for; probes of a key.
MOST_BITS, BYTES_A_KEY, PROBES = 1 << 29, 160, 3
#: Common keys that are broadcast at most (24 bytes each).
MAX_BROADCAST_KEYS = 500_000
STRIP = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    """Of a line in UTF-8. bytes.lower touches A-Z alone."""
    return line.strip(STRIP).lower()


def long_keys(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 128-bit hash of the key) of the lines whose keys have enough code points; text in UTF-8."""
    out = []
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars and len(k := key_of(line)) >= min_chars and (k.isascii() or len(k.decode("utf-8", "replace")) >= min_chars):
            out.append((i, xxhash.xxh3_128_digest(k)))
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def _places(digests: list[bytes], bits: int) -> np.ndarray:
    """One row of bit positions for each digest."""
    h = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        return np.stack([(h[:, 0] + np.uint64(i) * h[:, 1]) & np.uint64(bits - 1) for i in range(PROBES)], 1).astype(np.int64)


def twice_seen(documents: DataFrame, min_chars: int = MIN_CHARS) -> bytes:
    """The "twice" bitmap of all documents."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bitmaps.size_for(size // BYTES_A_KEY, MOST_BITS)

    def places(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in _texts(b.column(0)):
            if own := list({d for _, d in long_keys(text, min_chars)}):
                yield _places(own, bits)

    return bitmaps.filled(documents.select("text"), places, bits, "twice", True)


def _suspects(twice: object, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for i, text in enumerate(_texts(b.column("text"))):
                own = {d for _, d in long_keys(text, min_chars)}
                keys += own
                rows += [i] * len(own)
            if keys:
                hit = np.flatnonzero(bitmaps.known(twice.value, _places(keys, 8 * len(twice.value))))
                keys, rows = [keys[i] for i in hit], [rows[i] for i in hit]
            got = b.select(["doc_id", "_k1", "_k2"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(keys, pa.binary())], ["doc_id", "_k1", "_k2", "key"])

    return run


def common_keys(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(suspected lines: doc_id, row of documents, key; common keys: key, keeper). Keys are 16-byte hashes."""
    sc = documents.sparkSession.sparkContext
    bits = sc.broadcast(twice_seen(documents, min_chars))
    keyed = documents.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    kinds = dict(documents.dtypes)
    seen = stored(keyed.mapInArrow(lean(_suspects(bits, min_chars), TEXT_ROWS), f"doc_id {kinds['doc_id']}, _k1 long, _k2 int, key binary"), "line-suspects")
    common = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    return seen, stored(common.select("key", "keeper"), "common-lines")


class Common:
    """Common keys as sorted arrays, with the document that keeps each."""

    def __init__(self, table: pa.Table) -> None:
        keys = np.frombuffer(b"".join(table.column("key").to_pylist()), "<u8").reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        self.high, self.low = keys[order, 0].copy(), keys[order, 1].copy()
        self.keeper = table.column("keeper").combine_chunks().take(pa.array(order))

    def find(self, digests: list[bytes]) -> np.ndarray:
        """The number of each key, -1 where it isn't common."""
        if not digests or not len(self.high):
            return np.full(len(digests), -1)
        h = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        at = np.searchsorted(self.high, h[:, 0])
        end = np.searchsorted(self.high, h[:, 0], "right")
        while (go := (at < end) & (self.low[np.minimum(at, len(self.low) - 1)] < h[:, 1])).any():  # equal first halves
            at = at + go
        return np.where((at < end) & (self.low[np.minimum(at, len(self.low) - 1)] == h[:, 1]), at, -1)


def _lost(b: pa.RecordBatch, common: Common, min_chars: int) -> list[set[int]]:
    """For each row of a batch the lines that it loses."""
    rows, lines, digests = [], [], []
    for i, text in enumerate(_texts(b.column("text"))):
        for line, d in long_keys(text, min_chars):
            rows.append(i)
            lines.append(line)
            digests.append(d)
    found = common.find(digests)
    hit = np.flatnonzero(found >= 0)
    keeper, own = common.keeper.take(pa.array(found[hit])), b.column("doc_id").take(pa.array(np.array(rows, np.int64)[hit]))
    out: list[set[int]] = [set() for _ in range(b.num_rows)]
    for k, keeps, doc_id in zip(hit.tolist(), keeper.to_pylist(), own.to_pylist(), strict=True):
        if keeps != doc_id:
            out[rows[k]].add(lines[k])
    return out


def _rewrite(min_chars: int, digest: bool, common: object | None):
    """The documents without the lines they lose: by the broadcast keys, or else by the column _regnet_drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if common is not None:
                lost = _lost(b, common.value, min_chars)
            else:
                drops = [set(x or ()) for x in b.column("_regnet_drop").to_pylist()]
                lost = [{i for i, d in long_keys(t, min_chars) if d in bad} if bad else set() for t, bad in zip(_texts(b.column("text")), drops, strict=True)]
                b = b.select(b.schema.names[:-1])
            texts, n = [], []
            held = b.column("text").cast(pa.binary())
            for text, out in zip(held.to_pylist(), lost, strict=True):
                n.append((text or b"").count(b"\n") + 1)
                kept = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in out) if out else text
                texts.append(hashlib.sha256(kept or b"").hexdigest() if digest else kept)
            if digest:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(x) for x in lost], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                at = b.schema.get_field_index("text")
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(b.column(at).type, safe=False) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return run


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digest: bool = False) -> DataFrame:
    """documents with the repeated lines gone; with digest, doc_id, n_lines, n_dropped and kept_sha256 instead."""
    if digest:
        documents = documents.select("doc_id", "text")
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, n_lines long, n_dropped long, kept_sha256 string" if digest else documents.schema
    seen, common = common_keys(documents.select("doc_id", "text"), min_chars, min_docs)
    if bounded(common, MAX_BROADCAST_KEYS):
        few = documents.sparkSession.sparkContext.broadcast(Common(common.toArrow()))
        return documents.mapInArrow(lean(_rewrite(min_chars, digest, few), TEXT_ROWS), schema)
    lose = seen.join(common, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lose = lose.groupBy(F.col("_k1").alias("_regnet_b1"), F.col("_k2").alias("_regnet_b2")).agg(F.collect_set("key").alias("_regnet_drop"))
    k1, k2 = row_key(documents["doc_id"], documents["text"])
    joined = documents.join(lose, (k1 == F.col("_regnet_b1")) & (k2 == F.col("_regnet_b2")), "left").select(*[documents[c] for c in documents.columns], "_regnet_drop")
    return joined.mapInArrow(lean(_rewrite(min_chars, digest, None), TEXT_ROWS), schema)


def with_n_chars(documents: DataFrame) -> DataFrame:
    """documents with n_chars, where there is one, counted anew from the text."""
    if "n_chars" not in documents.columns:
        return documents
    n = F.coalesce(F.length("text"), F.lit(0)).cast(dict(documents.dtypes)["n_chars"])
    return documents.withColumn("n_chars", n)
