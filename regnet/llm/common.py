"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]+"
#: Texts that a task turns into Python objects at once.
TEXT_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local run has one of its own; a cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or f"file://{tempfile.gettempdir()}/regnet-shared"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table written to the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _give_back() -> None:
    """Memory that was freed goes back to the system, where the system's allocator can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over slices of at most so many rows. Workers serve one stage after the other: what one has freed doesn't burden the next."""

    def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)

    def leaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        try:
            yield from run(sliced(batches, rows) if rows else batches)
        finally:
            _give_back()

    return leaned


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once and gives it to body; the optimizer can't inline it into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched. Pure ASCII texts take the fast built-in."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with working names."""
    return df.select(*[df[n] for n in names])


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes that name a row by its id and text; never null. Equal rows share them and get equal results."""
    return [F.xxhash64(doc_id, text).alias("_k1"), F.hash(text, doc_id).alias("_k2")]


KEY = ["_k1", "_k2"]


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows: the check before a broadcast. Reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
