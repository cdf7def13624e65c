"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer makes one gzip member per record and rolls archives at a bounded size.
The reader checks every member (CRC and length), record (version line, length,
closing blank lines) and payload digest. After a failed check it searches for the
next valid member or version line, goes on from there, and logs the bytes between
as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.session import stage

# Smaller payloads are always written whole.
MIN_REVISIT_BYTES = 100
# Bytes of members that are written as one piece, and pieces of one archive.
PIECE_BYTES = 4 << 20
PIECES = 16
# Bytes of blocks in one Arrow batch of the reader.
BATCH_BYTES = 8 << 20

# Bytes that the reader unpacks at a time, and bytes of a record's headers at most.
FEED_BYTES = 8 << 10
MOST_HEADER_BYTES = 1 << 20
# A list of payloads that occur several times is broadcast up to so many rows of fixed width.
BROADCAST_ROWS = 200_000

# Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

RECORDS = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("gap", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def resolve_revisits(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html"
) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of each row.

    Of rows with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, that with
    the smallest id is the response and the others revisit it; smaller ones are all
    responses. A null payload is empty. Rows that repeat the smallest id with the
    same payload are responses too; a null id is never the smallest, and where all
    ids of a payload are null, all are responses. Only digests are shuffled, to find the
    first holders of payloads that occur several times; their list is broadcast where it
    is short, so that payloads stay where they lie. A longer one is joined by digest;
    there Spark's skew join splits a payload held by very many rows.
    """
    payload = F.encode(F.coalesce(F.col(payload_column), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload")
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    first = (
        large.groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    first = stage(first, "first-holders")
    short = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = large.join(F.broadcast(first) if short else first, "payload_digest", "left")
    small = rows.where(F.col("payload_bytes") < MIN_REVISIT_BYTES).withColumn("first", F.lit(None).cast("long"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.unionByName(small).select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(row: dict, date: str) -> bytes:
    """One record, uncompressed. ``row`` as ``resolve_revisits`` gives it."""
    revisit = row["record_type"] == "revisit"
    block = HTTP_HEAD if revisit else HTTP_HEAD + (row["payload"] or b"")
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": record_id(row["page_id"]),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
        "X-Payload-Length": row["payload_bytes"],
    }
    if row["page_id"] is not None:
        headers["X-Page-ID"] = row["page_id"]
    if row["url"] is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
    if revisit:
        headers["WARC-Profile"] = REVISIT_PROFILE
        headers["WARC-Refers-To"] = record_id(row["refers_to"])
        headers["X-Refers-To-Page-ID"] = row["refers_to"]
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the rows of ``resolve_revisits`` as archives below ``path``.

    Files are written and committed by Spark's text sink: a piece of several
    members is a "line" and its last byte is the separator. The last byte of a gzip
    member is the top byte of its length, 0 below 16 MiB; a longer record gets a 0
    behind it, which readers of several members skip. An archive holds ``PIECES``
    pieces of about ``PIECE_BYTES`` bytes, or of one record where that is longer.
    No rows give no archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece = bytearray()
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                piece += member(record(row, date))
                if len(piece) >= PIECE_BYTES or i == batch.num_rows - 1 or piece[-1]:
                    whole = bytes(piece).removesuffix(b"\0")
                    yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["value"])
                    piece = bytearray()

    pieces = records.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    pieces.write.option("lineSep", "\0").option("maxRecordsPerFile", PIECES).text(path)


class Damaged(Exception):
    """A check failed; the text says which."""


def parse_record(data: bytes, start: int) -> tuple[int, dict[str, str], bytes]:
    """End, headers and payload of the record at ``start``; ``Damaged`` if a check fails."""
    version = VERSION_LINE.match(data, start)
    if not version:
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", version.end() - 2, version.end() + MOST_HEADER_BYTES)
    if stop < 0:
        raise Damaged("headers have no end")
    headers = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    lower = {name.lower(): value for name, value in headers.items()}
    if not re.fullmatch("[0-9]{1,18}", lower.get("content-length", "")):
        raise Damaged("bad content length")
    begin = stop + 4
    end = begin + int(lower["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("content length does not fit")
    payload = data[begin:end]
    if lower.get("content-type", "").startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    kind, _, digest = lower.get("warc-payload-digest", "").partition(":")
    if kind == "sha256" and lower.get("warc-type") != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
        raise Damaged("payload digest differs")
    return end + 4, headers, payload


def unpack(data: bytes, start: int) -> tuple[bytes, int, str | None]:
    """Unpacked bytes of the gzip member at ``start``, its end, and the first failed check if there is one.

    The member is fed in pieces, so that nothing behind it is touched. What was
    unpacked before a fault is kept, to the byte: the failing piece is fed again bytewise.
    """
    opener, inside, place = zlib.decompressobj(31), [], start
    while not opener.eof and place < len(data):
        piece = data[place : place + FEED_BYTES]
        try:
            inside.append(opener.decompress(piece))
        except zlib.error as broken:
            opener, inside = zlib.decompressobj(31), []
            for at in range(start, place, FEED_BYTES):
                inside.append(opener.decompress(data[at : at + FEED_BYTES]))
            for byte in piece:
                try:
                    inside.append(opener.decompress(bytes([byte])))
                except zlib.error:
                    break
            return b"".join(inside), place, f"bad member: {broken}"
        place += len(piece)
    whole = b"".join(inside)
    return whole, place - len(opener.unused_data), None if opener.eof else "member is cut off"


def parse_records(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str] | None, bytes | None]]:
    """Start, end, gap reason, headers and payload of each record in plain bytes, and of each gap between them."""
    place, bad_from, reason = 0, -1, ""
    while place < len(data):
        try:
            end, headers, payload = parse_record(data, place)
        except Damaged as why:
            if bad_from < 0:
                bad_from, reason = place, str(why)
            ahead = VERSION_LINE.search(data, place + 1)
            place = ahead.start() if ahead else len(data)
            continue
        if bad_from >= 0:
            yield bad_from, place, reason, None, None
            bad_from = -1
        yield place, end, None, headers, payload
        place = end
    if bad_from >= 0:
        yield bad_from, len(data), reason, None, None


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str] | None, bytes | None]]:
    """Offset, length, gap reason, headers and payload: of each record, and of each gap (no headers there).

    Zero bytes between members are padding and no gap. The records of one member
    share its offset and length. A member is searched inside: a bad record there is a
    gap that names its unpacked bytes, and the records around it are kept. Of a member
    that breaks off or fails its own checks the records before the fault are kept, and
    its bytes are a gap as well; the search goes on right behind its first byte. An
    empty file gives nothing.
    """
    place, bad_from, reason = 0, -1, ""
    padding = re.compile(rb"\0+")
    starts = re.compile(re.escape(MEMBER) + rb"|WARC/1\.[01]\r\n")
    while place < len(data):
        if bad_from < 0 and data[place] == 0:
            place = padding.match(data, place).end()
            continue
        end, fault, found = place, None, []
        if data.startswith(MEMBER, place):
            inside, end, fault = unpack(data, place)
            found = list(parse_records(inside))
            if fault is not None:
                # The record that the fault cuts off, or may have cut off, is not trusted.
                found = [row for row in found if row[1] < len(inside)]
            if fault is None and not any(headers for *_, headers, _ in found):
                fault = found[0][2] if found else None
        else:
            try:
                end, headers, payload = parse_record(data, place)
                found = [(place, end, None, headers, payload)]
            except Damaged as why:
                fault = str(why)
        broken = fault is not None
        if broken:
            found = [row for row in found if row[3] is not None]
            if bad_from < 0:
                bad_from, reason = place, fault
        elif bad_from >= 0:
            yield bad_from, place - bad_from, reason, None, None
            bad_from = -1
        for first, last, gap, headers, payload in found:
            inner = None if gap is None else f"unpacked bytes {first} to {last} of the member: {gap}"
            yield place, end - place, inner, headers, payload
        if not broken:
            place = end
            continue
        ahead = starts.search(data, place + 1)
        place = ahead.start() if ahead else len(data)
    if bad_from >= 0:
        yield bad_from, len(data) - bad_from, reason, None, None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive, offset, length, gap, headers, payload``: every record found, and every quarantined gap.

    ``gap`` is null for records; for gaps it names the first failed check, and the
    headers and payload are null. Takes gzip members, plain records and mixtures. An
    archive is read whole by one task, so archives should be rolled at a size that
    fits it, as ``write_archives`` does (1 GB is usual). Empty files give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("archive", pa.string()),
                ("offset", pa.int64()),
                ("length", pa.int64()),
                ("gap", pa.string()),
                ("headers", pa.map_(pa.string(), pa.string())),
                ("payload", pa.binary()),
            ]
        )
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for offset, length, gap, headers, payload in salvage(content.as_py() or b""):
                    rows.append((name.as_py(), offset, length, gap, headers and list(headers.items()), payload))
                    held += len(payload or b"")
                    if held >= BATCH_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def header(name: str) -> Column:
    return F.col("headers").getItem(name)
