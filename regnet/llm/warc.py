"""WARC archives: writing with segmentation and revisits, reading back with segment reassembly.

Writing is one DataFrame projection: a record is header + block, blocks longer than segment_bytes are cut into a
first record and continuation records, and Spark's text writer puts the record end between them. Payloads are
framed as HTTP chunks. Files hold at most RECORDS_PER_FILE records of at most segment_bytes, so that a reader's
memory is bounded.

Reading takes whole archive files as rows and follows Content-Length. Only records in segments are shuffled, by
origin id; a group is one page's segments. They are ordered by segment number; missing or repeated numbers or a
wrong total length make the record incomplete (payload null), and so does an end of the file inside a record. Chunked
framing is decoded last, and the payload compared with its declared digest. What isn't a record is passed over up to the next
line that begins one, a gzip member that can't be read up to the next one; either leaves a record of type "unreadable",
which is incomplete. A record without a valid length is incomplete. No bad byte fails a job.

Defined cases: null payload counts as empty; payloads under min_bytes are never revisits; rows that share the
smallest page_id of a payload are all responses; null page_ids come after all others and never are referred to;
null urls write an empty one; no rows give an empty archive and no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

MIN_BYTES = 100
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
#: What stands where a gzip member couldn't be read: no record begins there.
BROKEN = b"\r\n\r\nunreadable\r\n"
_RECORD, _HEAD_END = re.compile(rb"\nWARC/"), re.compile(rb"\r?\n\r?\n")
_HEX, _DIGITS, _NUMBER = re.compile(rb"[0-9A-Fa-f]{1,15}"), re.compile(r"[0-9]{1,18}", re.A), re.compile(r"-?[0-9]{1,19}", re.A)
_CODINGS = re.compile(rb"(?im)^transfer-encoding[ \t]*:([^\r\n]*)")


def _bytes(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), F.lit(b""))


def _cut(data: Column, size: int) -> Column:
    """Pieces of binary data of at most size bytes."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(data, (i - 1) * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, digest, original, original_url of the rows whose payload an earlier page has. Holds no payloads."""
    ids = pages.select("page_id", "url", F.sha2(_bytes(F.col("html")), 256).alias("digest"), F.octet_length(_bytes(F.col("html"))).alias("n")).filter(F.col("n") >= min_bytes)
    first = ids.groupBy("digest").agg(F.min("page_id").alias("original"), F.min_by("url", "page_id").alias("original_url"), F.count(F.lit(1)).alias("copies"))
    later = ids.select("page_id", "digest").join(first.filter("copies > 1 AND original IS NOT NULL"), "digest")
    return later.filter(~F.col("page_id").eqNullSafe(F.col("original"))).drop("copies").distinct()


def records(pages: DataFrame, min_bytes: int = MIN_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row per WARC record: column value, its bytes without the record end."""
    page = pages.select("page_id", "url", _bytes(F.col("html")).alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256))
    again = revisits(pages, min_bytes).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "original", "original_url")
    page = page.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    is_again = F.col("original").isNotNull()

    chunks = F.transform(_cut(F.col("payload"), CHUNK_BYTES), lambda c: F.concat(F.lower(F.hex(F.octet_length(c).cast("bigint"))), F.lit(END), c.cast("string"), F.lit(END)))
    head = F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Transfer-Encoding: chunked{END}{END}")
    block = F.when(is_again, F.lit(f"HTTP/1.1 200 OK{END}{END}")).otherwise(F.concat(head, F.array_join(chunks, ""), F.lit(f"0{END}{END}"))).cast("binary")
    page = page.select("page_id", "url", "digest", "original", "original_url", F.expr("uuid()").alias("id"), block.alias("block"))
    page = page.select("*", F.octet_length("block").alias("total"), F.posexplode(_cut(F.col("block"), segment_bytes)).alias("k", "part"))

    one_line = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    many, first, last = F.col("total") > segment_bytes, F.col("k") == 0, (F.col("k") + 1) * segment_bytes >= F.col("total")
    again = F.col("original").isNotNull()
    kind = F.when(~first, "continuation").when(again, "revisit").otherwise("response")
    header = F.concat_ws(
        "",
        F.lit(f"WARC/1.1{END}"), field("WARC-Type", kind),
        field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "id", F.when(first, "").otherwise(F.concat(F.lit(":"), (F.col("k") + 1).cast("string"))), F.lit(">"))),
        field("WARC-Date", F.lit(DATE)), field("WARC-Target-URI", one_line(F.col("url"))),
        F.when(F.col("page_id").isNotNull(), field("X-Page-Id", F.col("page_id").cast("string"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again & first, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To-Target-URI", one_line(F.col("original_url"))), field("X-Refers-To-Page", F.col("original").cast("string")))),
        F.when(many, field("WARC-Segment-Number", (F.col("k") + 1).cast("string"))),
        F.when(many & ~first, field("WARC-Segment-Origin-ID", F.concat(F.lit("<urn:uuid:"), "id", F.lit(">")))),
        F.when(many & last, field("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length("part").cast("string")), F.lit(END),
    )
    return page.select(F.concat(header, F.col("part").cast("string")).alias("value"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    records(pages, min_bytes, segment_bytes).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def unzipped(data: bytes) -> bytes:
    """Archives are often gzip files with a member for each record; all members are read. A cut last member gives what it holds."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
            data = member.unused_data.lstrip(b"\0") if member.eof else b""  # members may be padded
        except zlib.error:
            out.append(BROKEN)
            data = data[1:]
        at = data.find(b"\x1f\x8b\x08")
        data = data[at:] if at >= 0 else b""
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(header fields by lower-case name, block, whether all of it is there) of the records in an archive."""
    at, some = 0, False
    while at < len(data):
        if data[at : at + 1] in b"\r\n":  # record ends
            at += 1
            continue
        if not data.startswith(b"WARC/", at):  # on to the next record
            again = _RECORD.search(data, at)
            if again is None and not some:
                raise ValueError("no WARC record in the file")
            yield {"warc-type": "unreadable"}, b"", False
            if again is None:
                return
            at = again.end() - 5
        some = True
        end = _HEAD_END.search(data, at)
        lines = data[at : end.start() if end else len(data)].decode("utf-8", "surrogateescape").replace(END, "\n").split("\n")
        fields: dict[str, str] = {}
        name = ""
        for x in lines[1:]:
            if x[:1] in " \t" and name:  # folded
                fields[name] += " " + x.strip()
            else:
                name, _, value = x.partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        if end is None:
            yield fields, b"", False
            return
        size = fields.get("content-length", "")
        if not _DIGITS.fullmatch(size):
            yield fields, b"", False
            at = end.end()
            continue
        at = end.end() + int(size)
        yield fields, data[end.end() : at], at <= len(data)


def readable(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """As parse; of a file without any record, one that is unreadable."""
    try:
        yield from parse(data)
    except ValueError:
        yield {"warc-type": "unreadable"}, b"", False


def dechunk(body: bytes) -> bytes | None:
    """The payload of chunked framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip(b" \t") if end >= 0 else b""
        if not _HEX.fullmatch(size):
            return None
        n = int(size, 16)
        if end + 2 + n > len(body):
            return None
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(block: bytes | None) -> bytes | None:
    """The body of an HTTP response, its transfer codings (chunked, gzip, deflate) undone; any other block whole. None where a coding is broken or unknown."""
    if block is None or not block.startswith(b"HTTP/"):
        return block
    end = _HEAD_END.search(block)
    head, body = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    codings = [c.strip().lower() for value in _CODINGS.findall(head) for c in value.split(b",")]
    for coding in reversed([c for c in codings if c not in (b"", b"identity")]):
        try:
            if coding == b"chunked":
                body = dechunk(body)
            elif coding in (b"gzip", b"x-gzip", b"deflate"):
                body = zlib.decompress(body, 47)
            else:
                return None
        except zlib.error:
            return None
        if body is None:
            return None
    return body


_PARSED = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("whole", pa.bool_()), ("block", pa.binary())])
_PARSED_DDL = "record_type string, page_id long, url string, digest string, refers_to long, origin string, segment int, total long, whole boolean, block binary"
BATCH_BYTES = 8 << 20


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    number = lambda x: int(x) if x and _NUMBER.fullmatch(x) and -(2**63) <= int(x) < 2**63 else None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PARSED, strict=True)], schema=_PARSED)

    for b in batches:
        for content in b.column(0):
            for f, block, whole in readable(unzipped(content.as_py())):
                rows.append((
                    f.get("warc-type"), number(f.get("x-page-id")), f.get("warc-target-uri"), f.get("warc-payload-digest"), number(f.get("x-refers-to-page")),
                    f.get("warc-segment-origin-id", f.get("warc-record-id")), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), whole, block,
                ))
                held += len(block)
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
    if rows:
        yield batch()


def declared(payload: bytes, digest: str | None) -> bool | None:
    """Whether the payload has its declared digest (sha1, sha256 or md5, in hex or base 32); None where none can be compared."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return None
    own = hashlib.new(kind.lower(), payload, usedforsecurity=False).digest()
    return value.lower() == own.hex() or value.rstrip("=").upper() == base64.b32encode(own).decode().rstrip("=")


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("block")
        found = [payload_of(x.as_py()) for x in b.column(at)]
        kinds, digests = b.column("record_type").to_pylist(), b.column("digest").to_pylist()
        # a revisit declares the digest of the payload that it refers to
        intact = [None if x is None or k == "revisit" else declared(x, d) for x, k, d in zip(found, kinds, digests, strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(intact, pa.bool_()), pa.array(found, pa.binary())], [*b.schema.names[:at], "intact", "payload"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """record_type, page_id, url, digest (as declared), refers_to, complete, intact (the payload has its declared digest; null if
    none can be compared), payload of each record. Revisits have an empty payload; records that are cut or lack segments, and
    those with broken framing, have a null one. Field names count in any case."""
    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, _PARSED_DDL)
    block = F.when(F.col("whole"), F.col("block")).alias("block")
    single = raw.filter("segment IS NULL").select("record_type", "page_id", "url", "digest", "refers_to", F.col("whole").alias("complete"), block)
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    many = raw.filter("segment IS NOT NULL").groupBy("origin").agg(
        *[first(c) for c in ("record_type", "page_id", "url", "digest", "refers_to")], F.min("whole").alias("whole"),
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    whole = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    in_order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    many = many.withColumn("block", whole).withColumn("complete", F.coalesce(in_order & F.col("whole") & (F.octet_length("block") == F.col("total")), F.lit(False)))
    many = many.withColumn("block", F.when(F.col("complete"), F.col("block")))
    both = single.unionByName(many.select(*single.columns))
    return both.mapInArrow(_payloads, "record_type string, page_id long, url string, digest string, refers_to long, complete boolean, intact boolean, payload binary")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archive, reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to per page."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archive(pages, path)
    got = read_archive(spark, path).select("page_id", "record_type", "refers_to", F.regexp_replace("digest", "^sha256:", "").alias("declared"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    got = stored(got, "warc-index")
    full = got.filter("record_type = 'response'")
    known = full.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = got.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("declared").alias("payload_digest")).join(known, "payload_digest", "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return full.select(*cols).unionByName(again.select(*cols))
