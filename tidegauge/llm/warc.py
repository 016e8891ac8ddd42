"""A content-addressed archive of WARC records: payloads once by digest, exact record headers apart.

``payloads`` holds the bytes of each distinct payload, packed, under its SHA-256 digest; ``headers`` holds the header block of each
record as it would stand in a WARC file. A record is read back by joining the two, responses and revisits alike: its payload must have the
SHA-256 digest that it is kept under and the SHA-1 digest and length that the header names, or reading is an error.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import scratch_dir

LEAST_BYTES = 0  # payloads of at least so many bytes are kept once
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
PACKING = 1  # level of compression
SHARE = 4096  # records of one payload that are read in one share; the payload is read once for each share


def _digests(pages: DataFrame, with_payload: bool) -> DataFrame:
    """``page_id, url, key, payload_digest, payload_bytes`` of every page, on demand ``packed``: its payload and both digests."""
    names = ["page_id", "url", "key", "payload_digest", "payload_bytes"] + ["packed"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [(html.as_py() or "").encode() for html in batch.column("html")]
            columns = [
                pa.array([hashlib.sha256(x).digest() for x in payloads], pa.binary()),
                pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in payloads], pa.string()),
                pa.array(list(map(len, payloads)), pa.int64()),
            ]
            if with_payload:
                columns.append(pa.array([zlib.compress(x, PACKING) for x in payloads], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names)

    schema = "page_id long, url string, key binary, payload_digest string, payload_bytes long" + ", packed binary" * with_payload
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, schema)


def _record_id(page_id: Column, place: Column) -> Column:
    """An address from page, payload and the place among rows that agree in both (from 0)."""
    name = F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("none")), F.lower(F.hex("key")), place.cast("string"))
    return F.concat(F.lit("<urn:page:"), name, F.lit(">"))


def _header() -> Column:
    """The header block of a record, up to and with its empty line."""
    revisit = F.col("record_type") == "revisit"
    http = F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: ")
    http = F.concat(http, F.col("payload_bytes").cast("string"), F.lit(LINE * 2))
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Date", F.lit(DATE)),
        # line ends in an address would end the field
        ("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Refers-To", F.when(revisit, F.col("refers_to_id"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))).cast("string")),
    ]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(LINE)) for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1{LINE}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(LINE), http)


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> str:
    """Writes the records of all ``pages`` (``page_id, url, html``) and gives the archive's folder.

    Of equal payloads of ``least_bytes`` or more the page with the largest id answers and the others revisit it; smaller payloads
    all answer. Null html is an empty payload; a null id comes below every id; of rows that repeat the answering id one answers and
    the others revisit it. An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    path = scratch_dir(spark, "archive")
    # equal payloads meet here once for each task, so a payload on most pages stays one row for each
    once = _digests(pages, True).groupBy("key").agg(
        F.first("packed").alias("packed"), F.max("page_id").alias("answers"), F.count("*").alias("records")
    )
    once.write.parquet(f"{path}/payloads")
    answers = spark.read.parquet(f"{path}/payloads").select("key", "answers", "records")
    columns = ["key", "page_id", "url", "payload_digest", "payload_bytes"]
    counted = _digests(pages, False).groupBy(*columns).agg(F.count("*").alias("times"))
    before = Window.partitionBy("key", "page_id").orderBy("url").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("times").over(before), F.lit(0))
    places = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1))
    rows = counted.withColumn("first", first).select(*columns, places.alias("place")).join(answers, "key")
    answering = F.col("page_id").eqNullSafe(F.col("answers")) & (F.col("place") == 0)
    typed = rows.withColumns(
        {
            "record_type": F.when((F.col("payload_bytes") < least_bytes) | answering, "response").otherwise("revisit"),
            "record_id": _record_id(F.col("page_id"), F.col("place")),
            "refers_to_id": _record_id(F.col("answers"), F.lit(0)),
        }
    )
    share = F.pmod(F.xxhash64("record_id"), _shares()).cast("int")
    typed.select("key", share.alias("share"), "record_type", _header().alias("header")).write.parquet(f"{path}/headers")
    return path


def _shares() -> Column:
    """Into how many shares the records of a payload are dealt."""
    return F.ceil(F.col("records") / F.lit(SHARE))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``header, key, packed`` of every record of an archive: its header block, its payload as it is kept, and the digest it is kept under.

    A revisit has the payload that it refers to. A header whose payload is gone has a null payload. Records of one payload
    are dealt into shares, so that one on most pages does not meet in one task.
    """
    headers = spark.read.parquet(f"{path}/headers")
    kept = spark.read.parquet(f"{path}/payloads")
    dealt = kept.select("key", "packed", F.explode(F.sequence(F.lit(0), _shares().cast("int") - 1)).alias("share"))
    return headers.join(dealt, ["key", "share"], "left").select("header", "key", "packed")


def warc_bytes(header: str, packed: bytes | None) -> bytes:
    """A record as it stands in a WARC file."""
    return header.encode() + (zlib.decompress(packed) if packed is not None else b"") + 2 * LINE.encode()


def parsed(record: bytes) -> dict[str, str | bytes]:
    """The named fields of a record, its ``http`` fields and its ``payload``; wrong lengths or bytes that don't have the named
    digest are an error."""
    head, _, rest = record.partition(2 * LINE.encode())
    lines = head.decode().split(LINE)
    fields: dict = dict(line.split(": ", 1) for line in lines[1:])
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if lines[0] != "WARC/1.1" or end != 2 * LINE.encode():
        raise ValueError(f"{fields.get('WARC-Record-ID')} has another length than it says")
    http, _, payload = block.partition(2 * LINE.encode())
    fields["http"] = dict(line.split(": ", 1) for line in http.decode().split(LINE)[1:])
    fields["payload"] = payload
    if fields["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}" or len(payload) != int(fields["http"]["Content-Length"]):
            raise ValueError(f"{fields['WARC-Record-ID']} has other bytes than its digest says")
    return fields


def record(header: str, packed: bytes | None) -> dict:
    """The fields of a record, and as ``payload`` the bytes that it stands for: a revisit's come from what it refers to."""
    revisit = "WARC-Type: revisit" in header.split(LINE)
    fields = parsed(warc_bytes(header, None if revisit else packed))
    if packed is None:
        return {**fields, "payload": None}
    return {**fields, "payload": zlib.decompress(packed)} if revisit else fields


def verified(fields: dict, key: bytes, payload: bytes | None) -> bytes:
    """The payload of a record, also of a revisit; one that is gone, or that any digest or length denies, is an error."""
    name = fields["WARC-Record-ID"]
    if payload is None:
        raise ValueError(f"{name} has no payload in the archive")
    if hashlib.sha256(payload).digest() != key:
        raise ValueError(f"{name} has a payload under a false SHA-256 digest")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if fields["WARC-Payload-Digest"] != f"sha1:{digest}" or len(payload) != int(fields["http"]["Content-Length"]):
        raise ValueError(f"{name} names another payload than it has")
    return payload


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` of every record of an archive, each with its whole payload
    at hand, so size and digest are those of its bytes."""

    def page(address: str) -> int | None:
        name = address.split(":")[2]
        return None if name == "none" else int(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for header, key, packed in zip(*(batch.column(c) for c in ("header", "key", "packed")), strict=True):
                fields = record(header.as_py(), packed.as_py())
                payload = verified(fields, key.as_py(), fields["payload"])
                values = (
                    page(fields["WARC-Record-ID"]),
                    len(payload),
                    fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                    fields["WARC-Type"],
                    page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
                    fields["WARC-Target-URI"],
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out, kinds)), [x.split()[0] for x in READ.split(", ")])

    return records(spark, path).mapInArrow(run, READ)
