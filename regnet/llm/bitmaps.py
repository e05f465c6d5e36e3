"""Bitmaps filled by tasks and merged in parts. A task sends the bits that it has set: a part with few of them as places."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TEXT_ROWS, lean

PARTS = 64
DDL = "part int, once binary, twice binary"


def _coded(part: np.ndarray) -> bytes:
    """The bytes of a part, or, where that is shorter, the places of the bits that are set; a first byte tells which."""
    if 4 * int(np.bitwise_count(part).sum()) < len(part):
        return b"p" + np.flatnonzero(np.unpackbits(part)).astype(np.uint32).tobytes()
    return b"b" + part.tobytes()


def _decoded(data: bytes, n: int) -> np.ndarray:
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1)
    out = np.zeros(n, np.uint8)
    _set(out, np.frombuffer(data[1:], np.uint32).astype(np.int64))
    return out


def _rows(once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    a, b = once.reshape(PARTS, -1), twice.reshape(PARTS, -1)
    full = [k for k in range(PARTS) if a[k].any()]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_coded(a[k]) for k in full], pa.binary()), pa.array([_coded(b[k]) for k in full], pa.binary())], ["part", "once", "twice"])


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))


def _merge(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for part, o, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                o, t = _decoded(o, n), _decoded(t, n)
                if part in held:
                    o0, t0 = held[part]
                    o, t = o0 | o, t0 | t | (o0 & o)
                held[part] = (o, t)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([o.tobytes() for o, _ in held.values()], pa.binary()), pa.array([t.tobytes() for _, t in held.values()], pa.binary())], ["part", "once", "twice"])

    return run


def filled(rows: DataFrame, places: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, which: str, texts: bool = False) -> bytes:
    """places gives, for each document, a row of bit positions per distinct key. which: "once" or "twice". texts: whether rows are texts.

    A key all of whose bits another document (or key) has set before counts as seen twice; merging two tasks' maps
    by twice | twice | (once & once) can't miss one."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in places(b):
                again = known(once, at)
                _set(twice, at[again].ravel())
                _set(once, at.ravel())
        yield _rows(once, twice)

    merged = rows.mapInArrow(lean(fill, TEXT_ROWS if texts else None), DDL).repartition(PARTS, "part").mapInArrow(lean(_merge(bits // 8 // PARTS)), DDL)
    out = np.zeros((PARTS, bits // 8 // PARTS), np.uint8)
    for r in merged.select("part", which).collect():  # PARTS rows, bits / 8 bytes
        out[r[0]] = np.frombuffer(r[1], np.uint8)
    return out.tobytes()


def known(packed: bytes | np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all bits of each row of positions are set."""
    packed = np.frombuffer(packed, np.uint8) if isinstance(packed, bytes) else packed
    return ((packed[at >> 3] << (at & 7).astype(np.uint8)) & 128).astype(bool).all(1)


def size_for(keys: int, most: int) -> int:
    """Bits for so many keys at 4 a key: a power of two, 2**16 at least and most at most."""
    return min(most, 1 << max(16, (4 * keys - 1).bit_length()))
