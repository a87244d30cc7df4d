"""WARC archives: writing, reading, and revisit resolution.

Archives are written by Spark's text writer, whose record separator is the blank line pair
that ends a WARC record, so they go to any file system Spark can reach, gzip-compressed, one
member an archive. They are read with the binaryFile source: each archive is inflated as a
stream and cut by its records' Content-Length, never by looking for separators in payloads.
An archive holds about ARCHIVE_BYTES of records, or one record that is larger.

Deduplication moves no payload by itself: headers are shuffled by payload digest, the first
record of each digest is the original, and what each archive has to rewrite is joined to that
archive, still compressed, by its path, over about one partition an archive, so that a task
reads a few archives however many there are. All records written then have headers of their own:
a new id, which follows from the old one, so that revisits can name it, a new date and digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of records in an archive, before compression.
ARCHIVE_BYTES = 32 << 20
#: Partitions at most over which archives are dealt when they are rewritten, else one an archive.
REWRITE_PARTITIONS = 20_000
#: Effort of gzip, in Hadoop's names; its default takes most of the CPU time of a rewrite.
LEVEL = "THREE"
_STEP = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = "record_id string, page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to_id string"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: 5 hex digits make 4 base32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _dealt(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Records with the number of their archive among those of a task."""
    part, size = 0, 0
    for batch in batches:
        numbers = []
        for n in pc.binary_length(batch.column(0)).to_pylist():
            if size and size + n > most:
                part, size = part + 1, 0
            size += n
            numbers.append(part)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32())], names=["record", "part"])


def _write(dealt: DataFrame, path: str) -> None:
    dealt.write.partitionBy("part").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", LEVEL).text(path)


def write_warc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a column `record` (a WARC record without its closing blank lines) as archives.

    Every row becomes a record, repeated rows too; a null record is an error. Other columns
    are ignored, and an empty table makes a folder without archives.
    """
    _write(records.select("record").mapInArrow(lambda batches: _dealt(batches, archive_bytes), "record string, part int"), path)


def _one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """A response record per row, with the payload as the body of an HTTP message.

    A null payload is empty, a null url or id leaves its header out. Repeated rows give
    records of their own; other columns are ignored. date: WARC-Date of all records.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, payload)
    fields = [
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        ("WARC-Date", F.lit(date or now())),
        ("WARC-Target-URI", _one_line(F.col(url_col).cast("string"))),
        ("X-Page-ID", F.col(id_col).cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(payload.cast("binary")))),
        ("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block.cast("binary")))),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields])
    return pages.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("record"))


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip-compressed archive, of any number of members."""
    box, left, buf = zlib.decompressobj(31), memoryview(data), bytearray()

    def more() -> bool:
        nonlocal box, left
        while len(left) or box.unconsumed_tail:
            if box.eof:
                left, box = memoryview(box.unused_data + bytes(left)), zlib.decompressobj(31)
            piece, left = (box.unconsumed_tail, left) if box.unconsumed_tail else (left[:_STEP], left[_STEP:])
            got = box.decompress(piece, _STEP)
            if got:
                buf.extend(got)
                return True
        return False

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("the archive ends inside a record's headers")
                return
        lines = bytes(buf[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        while len(buf) < stop + 4:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(buf[end + 4 : stop])
        del buf[: stop + 4]


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _payload(head: dict[str, str], block: bytes) -> bytes:
    """A block without the HTTP headers before the body."""
    return block.partition(b"\r\n\r\n")[2] if head.get("Content-Type", "").startswith("application/http") else block


def _plain(head: dict[str, str], block: bytes) -> tuple:
    """One row of HEAD. A response's digest and size come from the payload that was read."""
    if head["WARC-Type"] == "response":
        payload = _payload(head, block)
        digest, size = _digest(payload), len(payload)
        if head["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
    else:
        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
    return head["WARC-Record-ID"], head.get("X-Page-ID"), head.get("WARC-Target-URI"), head["WARC-Type"], digest, size, head.get("WARC-Refers-To")


def _fresh_id(record_id: str) -> str:
    """The id of a record's deduplicated successor."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id)}>"


def _fresh(head: dict[str, str], block: bytes, first: tuple | None, date: str) -> bytes:
    """A record with headers of its own; first: id and address of the response that it revisits."""
    own = {"WARC-Type": head["WARC-Type"], "WARC-Record-ID": _fresh_id(head["WARC-Record-ID"]), "WARC-Date": date}
    if first is not None:
        own |= {"WARC-Type": "revisit", "WARC-Profile": _PROFILE, "WARC-Refers-To": _fresh_id(first[0])}
        if first[1] is not None:
            own["WARC-Refers-To-Target-URI"] = first[1]
        block = b""
    elif "WARC-Refers-To" in head:  # a revisit that was one before
        own["WARC-Refers-To"] = _fresh_id(head["WARC-Refers-To"])
    own = {**own, **{k: v for k, v in head.items() if k not in own}, "WARC-Block-Digest": f"sha1:{_digest(block)}", "Content-Length": str(len(block))}
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in own.items())]).encode() + b"\r\n\r\n" + block


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string()]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """HEAD and the archive's path for each record of the archives in a folder.

    Missing headers are null; a folder without archives has no records. A damaged payload,
    a record that ends too soon and a file that holds no WARC records are errors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in HEAD.split(", ")]
        for batch in batches:
            for at, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = [_plain(*r) for r in records_of(data.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()] * len(rows), pa.string()), *_arrays(rows)], names=["archive", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"archive string, {HEAD}")


def dedup_warc(spark: SparkSession, source: str, target: str, min_bytes: int = 0, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Rewrites archives with fresh headers: of response records with equal payloads of at least
    min_bytes bytes, the one with the smallest page id (then record id; records without a page
    id last) stays a response, the others become revisit records without payload that refer
    to it. Smaller payloads stay responses. Records from repeated rows are revisits like any other.
    """
    date = date or now()
    heads = read_headers(spark, source).select("archive", "record_id", "payload_digest", "payload_bytes", "url", F.col("page_id").cast("long").alias("page"))
    heads = heads.filter(F.col("payload_bytes") >= min_bytes)
    order = F.struct(F.col("page").isNull().alias("none"), "page", "record_id", "url")
    originals = heads.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = heads.join(originals, ["payload_digest", "payload_bytes"]).filter("record_id <> first.record_id")
    rewrite = revisits.groupBy("archive").agg(F.collect_list(F.struct("record_id", F.col("first.record_id").alias("to"), F.col("first.url").alias("uri"))).alias("revisits"))
    files = spark.read.format("binaryFile").load(source)
    parts = min(max(files.select("path").count(), 1), REWRITE_PARTITIONS)
    archives = files.select("path", "content").repartition(parts, "path").join(rewrite.repartition(parts, "archive"), F.col("path") == F.col("archive"), "left").select("content", "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found in zip(batch.column(0), batch.column(1), strict=True):
                to = {x["record_id"]: (x["to"], x["uri"]) for x in found.as_py() or ()}
                out, size = [], 0
                for head, block in records_of(data.as_py()):
                    out.append(_fresh(head, block, to.get(head["WARC-Record-ID"]), date))
                    size += len(out[-1])
                    if size > _STEP:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["record"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["record"])

    _write(archives.mapInArrow(lambda batches: _dealt(run(batches), archive_bytes), "record string, part int"), target)


def resolve_revisits(heads: DataFrame) -> DataFrame:
    """Joins each revisit record to the response it refers to and takes its payload's size from it.

    A revisit whose response is not among the headers keeps its row, with null in their place.
    """
    originals = heads.filter("record_type = 'response'").select(F.col("record_id").alias("to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"))
    revisits = heads.filter("record_type = 'revisit'").join(originals, F.col("refers_to_id") == F.col("to"), "left")
    columns = ["page_id", "url", "payload_digest", "record_type"]
    return heads.filter("record_type = 'response'").select(*columns, "payload_bytes", F.lit(None).cast("string").alias("refers_to")).unionByName(
        revisits.select(*columns, F.col("to_bytes").alias("payload_bytes"), F.col("to_page").alias("refers_to"))
    )
