"""FASTA files by byte ranges. Plain files are read in ranges, compressed ones as a stream; rows are pieces of a sequence that
lie within one tile, so that no row holds a chromosome, however its lines are broken.

A range doesn't know which sequence it begins in, nor how far in. So files are read twice: first each range tells its last
header, and the bases before its first header and after its last one. That is a row for each range; what is carried over the
borders comes from it, and with it the second reading names and places every base."""

from __future__ import annotations

import bz2
import gzip
import json
import re
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range and the most of a header or comment line; bases of a tile.
RANGE, LINE, TILE = 16 << 20, 1 << 16, 65536
_SPACE = b" \t\r\n\x0b\x0c"
_MARK = re.compile(rb"^[>#][^\n]*", re.M)
_OPENERS = {".gz": gzip.open, ".bz2": bz2.open}
_SUMMARY = "file string, start bigint, headers bigint, name string, lead bigint, trail bigint"
_PIECE = "file string, record bigint, seqname string, place bigint, tile_start bigint, seq string"


def files(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """Files under a path or paths, with their sizes, by any file system that Spark knows."""
    found = []
    for p in [path] if isinstance(path, str) else path:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        matches = system.globStatus(at)
        if not matches:
            raise FileNotFoundError(p)
        for m in matches:
            of = system.listStatus(m.getPath()) if m.isDirectory() else [m]
            found += [(f.getPath().toString(), f.getLen()) for f in of if not f.isDirectory() and f.getPath().getName()[0] not in "_."]
    return sorted(found)


def opened(file: str) -> BinaryIO:
    kind = next((f for end, f in _OPENERS.items() if file.endswith(end)), None)
    parts = urlsplit(file)
    if parts.scheme in ("", "file"):
        local = unquote(parts.path)
        return kind(local, "rb") if kind else open(local, "rb")
    from pyarrow.fs import FileSystem

    system, at = FileSystem.from_uri(file)
    return system.open_input_stream(at, compression="detect") if kind else system.open_input_file(at)


def _range(f: BinaryIO, start: int, end: int) -> bytes:
    """The bytes of a range as whole header and comment lines: one that began before goes, one that goes on is ended."""
    back = max(0, start - LINE)
    f.seek(back)
    data = f.read(end - back + LINE)
    own, stop = start - back, end - back
    line = data.rfind(b"\n", 0, own) + 1
    if (line or back == 0) and line < own and data[line : line + 1] in (b">", b"#"):
        own = data.find(b"\n", own)
        own = len(data) if own < 0 else own
    line = max(data.rfind(b"\n", 0, stop) + 1, own)
    if data[line : line + 1] in (b">", b"#") and line < stop and (line == 0 or data[line - 1 : line] == b"\n"):
        stop = data.find(b"\n", stop - 1)
        stop = len(data) if stop < 0 else stop
    # a range whose first byte begins no line mustn't take it for one
    head = b"" if own == 0 or data[own - 1 : own] == b"\n" else b" "
    return head + data[own:stop]


def _chunks(file: str, start: int, end: int) -> Iterator[bytes]:
    with opened(file) as f:
        if end >= 0:
            yield _range(f, start, end)
            return
        held = b""
        while data := f.read(RANGE):
            held += data
            line = held.rfind(b"\n") + 1
            cut = line if held[line : line + 1] in (b">", b"#", b"") else len(held)
            yield held[:cut]
            # a line that was begun is gone on with
            held = held[cut:] if cut == line else b" "
        yield held


def _parts(chunks: Iterator[bytes]) -> Iterator[tuple[str | None, bytes]]:
    """(name of a header or None, bases that follow)."""
    for data in chunks:
        name, at = None, 0
        for m in _MARK.finditer(data):
            yield name, data[at : m.start()].translate(None, _SPACE)
            name = None
            if m[0][:1] == b">":
                words = m[0][1:].split(None, 1)
                name = words[0].decode("utf-8", "replace") if words and m[0][1:2] not in (b" ", b"\t") else ""
            at = m.end()
        yield name, data[at:].translate(None, _SPACE)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ranges, self.tile, self.summary = json.loads(options["ranges"]), int(options["tile"]), options["summary"] == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.ranges]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file, start, end, record, name, place = partition.value
        if self.summary:
            headers, lead, trail, last = 0, 0, 0, None
            for new, bases in _parts(_chunks(file, start, end)):
                if new is not None:
                    headers, last, trail = headers + 1, new, 0
                trail += len(bases)
                lead += len(bases) if not headers else 0
            yield file, start, headers, last, lead, trail
            return
        for new, bases in _parts(_chunks(file, start, end)):
            if new is not None:
                record, name, place = record + 1, new, 0
                yield file, record, name, 0, 0, ""
            at = 0
            while at < len(bases):
                n = min(len(bases) - at, self.tile - place % self.tile)
                yield file, record, name, place, place - place % self.tile, bases[at : at + n].decode("ascii", "replace")
                at, place = at + n, place + n


class FastaSource(DataSource):
    """Byte ranges of FASTA files: what they carry on (summary), or their pieces."""

    @classmethod
    def name(cls) -> str:
        return "regnet_fasta"

    def schema(self) -> str:
        return _SUMMARY if self.options["summary"] == "true" else _PIECE

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def carried(ranges: list[tuple], summary: list[tuple]) -> list[tuple]:
    """ranges (file, start, end, ...) with the record, the name and the place in it that each begins with."""
    told = {(r[0], r[1]): r[2:] for r in summary}
    out, before = [], None
    for file, start, end, *_ in ranges:
        if before is None or before[0] != file:
            before = (file, -1, None, 0)
        _, record, name, place = before
        headers, last, lead, trail = told[(file, start)]
        if name is None and lead:
            raise ValueError(f"text before the first header in {file}")
        out.append((file, start, end, record, name, place))
        before = (file, record + headers, last, trail) if headers else (file, record, name, place + lead)
    return out


def read_pieces(spark: SparkSession, path: str | list[str], tile: int = TILE, size: int | None = None) -> DataFrame:
    """file, record (its number in the file), seqname, place, tile_start, seq: each record as an empty piece and pieces of at
    most a tile. Text before the first header of a file is an error; lines with # are comments."""
    spark.dataSource.register(FastaSource)
    size = size or RANGE
    ranges = []
    for file, length in files(spark, path):
        packed = any(file.endswith(e) for e in _OPENERS)
        ranges += [(file, 0, -1, -1, None, 0)] if packed else [(file, a, min(a + size, length), -1, None, 0) for a in range(0, length, size)]
    load = lambda r, summary: spark.read.format("regnet_fasta").option("ranges", json.dumps(r)).option("tile", tile).option("summary", summary).load()
    if not ranges:
        return spark.createDataFrame([], _PIECE)
    return load(carried(ranges, load(ranges, "true").collect()), "false")  # a row for each range


def read_tiles(spark: SparkSession, path: str | list[str], tile: int = TILE) -> DataFrame:
    """seqname, tile_start, seq: sequences in tiles that don't overlap; an empty sequence has one empty tile."""
    pieces = read_pieces(spark, path, tile).groupBy("file", "record", "seqname", "tile_start").agg(F.sort_array(F.collect_list(F.struct("place", "seq"))).alias("p"))
    return pieces.select("seqname", "tile_start", F.array_join("p.seq", "").alias("seq"))


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seqname, seq per record; for sequences that fit in a row."""
    pieces = read_pieces(spark, path).groupBy("file", "record", "seqname").agg(F.sort_array(F.collect_list(F.struct("place", "seq"))).alias("p"))
    return pieces.select("seqname", F.array_join("p.seq", "").alias("seq"))


def tile_lengths(tiles: DataFrame) -> DataFrame:
    """seqname, length of sequences in tiles."""
    return tiles.groupBy("seqname").agg(F.max(F.col("tile_start") + F.length("seq")).cast("bigint").alias("length"))
