"""WARC archives compressed record by record with a dictionary of their own records.

A page becomes one record: a response with its payload, or a revisit that names the response with
the same payload. Tasks fill archives of about ``ARCHIVE_BYTES``. A finished archive builds a
Zstandard dictionary from a sample spread over its own records, embeds it (compressed) in a leading
skippable frame, and compresses each record as a frame of its own, so that any record can be read
with the dictionary alone. An archive of too few bytes to build a dictionary from has none.

Spark's text writer puts each archive into a file of the target folder, through its commit protocol
and into any store it can reach: a value's bytes are written as they are, and the separator that ends
a line is an empty skippable frame, which readers of Zstandard pass over. Spark reads files back whole,
so a task holds one archive, not more.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termbridge.llm import arrays
from termbridge.session import cut_lineage

col = F.col
ARCHIVE_BYTES = 32 << 20  # of records before compression; an archive ends with the record that reaches it
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 8 << 20  # of an archive's records, evenly spread, that its dictionary is built from
SAMPLE_RECORD = 128 << 10  # of one record in the sample
LEAST_REVISIT = 100  # bytes of a payload that a revisit can stand for
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ROLES = ["number", "page_id", "url", "digest", "size"]
SCHEMA = (
    "record_id string, record_type string, page_id long, url string, date string, refers_to long, refers_to_id string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _header_value(text: str) -> str:
    """Control characters and spaces would end or blur a header field; they are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _record_id(number: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{number}:{digest}'.encode()).digest()[:16], version=5)}>"


def record(row: dict, date: str) -> bytes:
    """The bytes of one record. ``payload`` None makes a revisit of row ``to_number``."""
    revisit = row["payload"] is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    block = http if revisit else http + row["payload"]
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(row["number"], row["digest"]))]
    fields += [("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{row['digest']}")]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _header_value(row["url"])))
    if row["page_id"] is not None:
        fields.append(("Page-ID", row["page_id"]))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(row["to_number"], row["digest"]))]
        fields.append(("WARC-Refers-To-Date", date))
        if row["to_url"] is not None:
            fields.append(("WARC-Refers-To-Target-URI", _header_value(row["to_url"])))
        if row["to_page"] is not None:
            fields.append(("Refers-To-Page-ID", row["to_page"]))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields).encode()
    return b"".join([VERSION, b"\r\n", head, b"\r\n", block, b"\r\n\r\n"])


def dictionary(records: list[bytes], size: int, sample: int) -> zstandard.ZstdCompressionDict | None:
    """Built from every n-th of the records, ``sample`` bytes or so of them; None if that is too little."""
    total = sum(min(len(r), SAMPLE_RECORD) for r in records)
    chosen = [r[:SAMPLE_RECORD] for r in records[:: max(1, -(-total // sample))]]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, chosen)) // 8)), chosen, k=1024, d=8)
    except (zstandard.ZstdError, ValueError):
        return None


def archive(records: list[bytes], dictionary_bytes: int, sample_bytes: int, level: int) -> bytes:
    built = dictionary(records, dictionary_bytes, sample_bytes)
    parts = []
    if built is not None:
        held = zstandard.ZstdCompressor(level=19).compress(built.as_bytes())
        parts += [struct.pack("<II", DICTIONARY_MAGIC, len(held)), held]
        built.precompute_compress(level=level)
    press = zstandard.ZstdCompressor(level=level, dict_data=built, write_checksum=True, write_content_size=True)
    parts += [press.compress(r) for r in records]
    return b"".join(parts)


def _archives(date: str, archive_bytes: int, dictionary_bytes: int, sample_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([archive(held, dictionary_bytes, sample_bytes, level)], pa.binary())], ["value"])

        for batch in batches:
            for part in arrays.pieces(batch, "payload"):
                for row in part.to_pylist():
                    held.append(record(row, date))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield done()
                        held, size = [], 0
        if held:
            yield done()

    return run


def _roles(given: DataFrame, least: int) -> DataFrame:
    """Rows of ``ROLES`` with payload (null for revisits) and, for revisits, to_number, to_page, to_url.

    Payloads meet under their digest. Only the first of a task's equal payloads is shuffled, the
    copies travel without theirs; the join to the responses has one row a digest on its other side.
    """
    order = [col("page_id").isNull().alias("no_id"), "page_id", "number", "url"]  # numbers never tie
    marks = cut_lineage(given.select(*ROLES))
    heads = marks.where(col("size") >= least).groupBy("digest").agg(F.min(F.struct(*order)).alias("to"), F.count("*").alias("n"))
    heads = heads.where("n > 1").select(
        "digest", col("to.number").alias("to_number"), col("to.page_id").alias("to_page"), col("to.url").alias("to_url")
    )
    revisits = marks.join(heads, "digest").where("number != to_number")
    revisits = revisits.select(*ROLES, F.lit(None).cast("binary").alias("payload"), "to_number", "to_page", "to_url")

    nothing = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in ("to_number", "to_page", "to_url")]
    large = given.where(col("size") >= least).groupBy("digest").agg(F.min(F.struct(*order, "size", "payload")).alias("row"))
    large = large.select("row.number", "row.page_id", "row.url", "digest", "row.size", "row.payload", *nothing)
    small = given.where(col("size") < least).select(*ROLES, "payload", *nothing)
    return large.unionAll(small).unionAll(revisits)


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    date: str = DATE,
    least_revisit: int = LEAST_REVISIT,
    archive_bytes: int = ARCHIVE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
    sample_bytes: int = SAMPLE_BYTES,
    level: int = LEVEL,
) -> None:
    """Write a record per row into archives below ``path``, a folder that is not there yet.

    Of rows with equal payloads of at least ``least_revisit`` bytes, the one with the smallest page_id is
    the response and the others revisit it; smaller payloads are all responses. A null payload counts as
    empty. Rows without page_id come after all others of their group; where a group has no page_id at all,
    one row is the response and the others revisit it by its record ID. Of repeated rows, one is the
    response and the rest revisit it. A null url has no field. ``pages`` must be a plain scan or another plan that numbers its
    rows alike when it runs again. Other columns are not read; an empty table writes no archive.
    """
    body = F.coalesce(col(payload).cast("binary"), F.lit("").cast("binary"))
    given = pages.select(
        F.monotonically_increasing_id().alias("number"),
        col(page_id).cast("long").alias("page_id"),
        col(url).cast("string").alias("url"),
        body.alias("payload"),
    )
    given = given.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("long")})
    made = _roles(given, least_revisit).mapInArrow(_archives(date, archive_bytes, dictionary_bytes, sample_bytes, level), "value binary")
    lines = made.select(col("value").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", 1).text(path)


def frame_end(data: memoryview, start: int) -> int:
    """Where the Zstandard frame at ``start`` ends: its header, its blocks, its checksum."""
    at = start + zstandard.frame_header_size(data[start : start + 18])
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + (4 if data[start + 4] & 4 else 0)


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of one archive."""
    view, at = memoryview(data), 0
    plain = zstandard.ZstdDecompressor()
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic in SKIPPABLE:
            end = at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC and at == 0:
                plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(view[8:end])))
        else:
            end = frame_end(view, at)
            yield plain.decompressobj().decompress(view[at:end])
        at = end


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def parse(data: bytes) -> dict:
    """The columns of ``SCHEMA`` of one record. A payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    field = _fields(head)
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = field["warc-type"], field["warc-payload-digest"].removeprefix("sha256:")
    size = int(_fields(http).get("content-length", len(payload)))
    if kind != "revisit":
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"payload of {field['warc-record-id']} has digest {found}, its record says {digest}")
    number = lambda name: int(field[name]) if name in field else None
    return {
        "record_id": field["warc-record-id"],
        "record_type": kind,
        "page_id": number("page-id"),
        "url": field.get("warc-target-uri"),
        "date": field.get("warc-date"),
        "refers_to": number("refers-to-page-id"),
        "refers_to_id": field.get("warc-refers-to"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if kind == "revisit" else payload,
    }


def _read(with_payload: bool, out: pa.Schema, limit: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for data in records_of(batch.column("content")[k].as_buffer()):
                    row = parse(data)
                    if not with_payload:
                        del row["payload"]
                    rows.append(row)
                    size += len(data)
                    if size >= limit:
                        yield pa.RecordBatch.from_pylist(rows, out)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, out)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives below ``path``: the columns of ``SCHEMA``.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, of revisits too; the payload of
    a revisit is null. Every payload is hashed again; one that differs from its record's digest raises.
    Control characters and spaces of a url come back percent-encoded. A folder without archives gives
    no rows.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = [c.strip().split(" ") for c in SCHEMA.split(",")]
    columns = [c for c in columns if with_payload or c[0] != "payload"]
    out = pa.schema([(name, kinds[kind]) for name, kind in columns])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read(with_payload, out), ", ".join(" ".join(c) for c in columns))
