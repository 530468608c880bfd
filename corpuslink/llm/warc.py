"""Operator 4: WARC archives, written by Spark and read back by a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, workspace

END = "\r\n\r\n"
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
PIECE = 1 << 16
CHECKED = ("warc-type", "warc-record-id", "content-length")
#: Bytes that an archive should hold, and records at the most.
ARCHIVE, RECORDS = 128 << 20, 5000


# -- writing -----------------------------------------------------------------------------------------------------


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data, by built-in functions: five hexadecimal digits make four of base 32."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    hex_ = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hex_, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """A WARC record per page in the column record.

    Of pages with equal payloads of at least `least` bytes, those with the smallest page_id are responses and the others
    revisit records that refer to it; smaller ones are all responses. A null html is an empty payload; a page without
    page_id is a response; rows that repeat the smallest page_id are responses too; bytes that a header can't hold are
    replaced in the URL.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", sha1_base32(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    # Its size on disk tells Spark whether it can be broadcast; else both sides are shuffled by digest.
    repeated = materialize(
        p.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("digest", "first")
    )
    p = p.join(repeated, "digest", "left")
    revisit = F.coalesce((F.col("page_id") > F.col("first")) & (F.col("n") >= least), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return p.select(F.concat(header, block).alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = 0, size: int = ARCHIVE) -> int:
    """Archives of about `size` bytes, by the mean record, and at most RECORDS records; returns the number of records.

    Spark's committer leaves only files of tasks that ended well.
    """
    n, total = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    rows = max(1, min(RECORDS, size // (1024 + (total or 0) // max(n, 1))))
    records(pages, least).write.option("lineSep", END).option("maxRecordsPerFile", rows).text(path)
    return n


# -- reading -----------------------------------------------------------------------------------------------------


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    payload_bytes: int
    payload: bytes | None = field(repr=False, default=None)


class Broken(ValueError):
    pass


def parse_record(data: bytes, at: int = 0) -> Record:
    """The record that starts at a place, if it passes all checks: version, headers, length, end and payload digest.

    Names of headers are read without regard to case, as the standard has them.
    """
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 16]):
        raise Broken("no version line")
    body = data.find(b"\r\n\r\n", at)
    if body < 0:
        raise Broken("headers don't end")
    headers = {}
    for line in data[at:body].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("no header")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if any(h not in headers for h in CHECKED) or not headers["content-length"].isdigit():
        raise Broken("a header is missing")
    body += 4
    end = body + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Broken("the block doesn't end where it should")
    kind, payload, n = headers["warc-type"], None, end - body
    split = data.find(b"\r\n\r\n", body, end)
    if kind in ("response", "revisit") and split >= 0:
        said = re.search(rb"(?im)^content-length: *(\d+)\r?$", data[body : split + 2])
        payload = data[split + 4 : end]
        n = int(said[1]) if said and kind == "revisit" else len(payload)
        if kind == "response":
            if said and int(said[1]) != n:
                raise Broken("the payload has another length")
            digest = headers.get("warc-payload-digest", "")
            if digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                raise Broken("the payload has another digest")
    return Record(at, end + 4, headers, n, payload)


def salvage(data: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """(records, gaps) of an archive of plain records or gzip members, or both.

    Where a check fails, the bytes up to the next version line or member from which a whole record can be read are a gap
    (start, end, reason), and reading goes on there. A member counts as a whole: if it can't be unpacked to its checked
    end, or what it holds isn't a sequence of records, it becomes a gap. Nothing tells where a broken record ends, so that
    whole records within its payload are read as records.
    """
    found: list[Record] = []
    gaps: list[tuple[int, int, str]] = []
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            here, end = _at(data, at)
        except Broken as error:
            if bad is None:
                bad, why = at, str(error)
            nxt = NEXT.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if bad is not None:
            gaps.append((bad, at, why))
            bad = None
        found += here
        at = end
    if bad is not None:
        gaps.append((bad, len(data), why))
    return found, gaps


def _at(data: bytes, at: int) -> tuple[list[Record], int]:
    if data.startswith(VERSION, at):
        r = parse_record(data, at)
        return [r], r.end
    if not data.startswith(MEMBER, at):
        raise Broken("neither a record nor a member")
    unpacker, inner, k = zlib.decompressobj(31), [], at
    try:
        while k < len(data) and not unpacker.eof:  # piece by piece: a file isn't copied for each of its members
            inner.append(unpacker.decompress(data[k : k + PIECE]))
            k = min(len(data), k + PIECE)
    except zlib.error as error:
        raise Broken(f"member: {error}") from error
    if not unpacker.eof:
        raise Broken("the member is cut off")
    inner, end = b"".join(inner), k - len(unpacker.unused_data)
    here, k = [], 0
    while k < len(inner):
        r = parse_record(inner, k)
        k = r.end
        here.append(Record(at, end, r.headers, r.payload_bytes, r.payload))
    return here, end


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record (gap false) and per gap of all archives below a path.

    Columns path, first_byte, end_byte, gap, reason, record_type, record_id, refers_to, payload_digest, payload_bytes and,
    if asked for, payload. Gaps are what the salvage left out; nothing else is lost.
    """
    names = ["path", "first_byte", "end_byte", "gap", "reason", "record_type", "record_id", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names, types = (names, types) if payloads else (names[:-1], types[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, gaps = salvage(content.as_py())
                rows = [
                    (
                        name, r.start, r.end, False, None, r.headers["warc-type"], r.headers["warc-record-id"], r.headers.get("warc-refers-to"),
                        r.headers.get("warc-payload-digest", "").removeprefix("sha1:"), r.payload_bytes, r.payload,
                    )
                    for r in found
                ] + [(name, a, b, True, why, *[None] * 6) for a, b, why in gaps]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    ddl = "path string, first_byte long, end_byte long, gap boolean, reason string, record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, ddl + ", payload binary" * payloads)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from archives written and read back.

    What was read is written to the shared folder with the gaps, which stay there as the log. A gap, or another number of
    records than was written, is an error that names the log.
    """
    spark, path, log = pages.sparkSession, workspace(pages.sparkSession), workspace(pages.sparkSession)
    written = write_archives(pages, path, least)
    read_archives(spark, path).write.parquet(log)
    found = spark.read.parquet(log)
    records_, gaps, lost = found.agg(F.count_if(~F.col("gap")), F.count_if("gap"), F.sum(F.when(F.col("gap"), F.col("end_byte") - F.col("first_byte")))).first()
    if gaps or records_ != written:
        raise RuntimeError(f"{records_} of {written} records could be read back; {gaps} gaps of {lost or 0} bytes are logged in {log}")
    number = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit(r"<urn:page:(-?\d+)>"), 1), F.lit(1)).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
