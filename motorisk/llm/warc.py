"""Operator 11: WARC archives without repeated payloads.

``write_archives`` writes records as WARC 1.1 files, ``read_archives`` reads them
back, and ``deduplicate`` resolves revisits: it reads the headers of archives
(record id, payload digest and length, page id), shuffles these alone by payload
digest, names the response with the largest page id the original of its digest,
joins every other record to it, and writes new archives in which the others are
revisit records with fresh headers (type, lengths, digests, refers-to) and no
payload. A revisit that came in resolved differently is joined anew; one whose
original is nowhere in the archives stays as it was.

An archive is one row of text to Spark's text sink, which ends it with the two
line ends that close a WARC record; a file holds at most ``ARCHIVE_BYTES`` and
one record more, so the readers' memory is bounded by that and the longest
payload. Files are compressed as a whole (``compression=None``: plain). Records
are made and read inside tasks, files pass through Spark's own sinks and
sources, so any store that Spark reaches will do. To write anew, a file's bytes
(compressed) meet the list of decisions about its records in a join on the file
name, so payloads are never shuffled by themselves. A digest that a third of all
records share is one row after partial aggregation, and its join is one that
adaptive execution splits.

Defined cases: null html is an empty payload; null page ids and urls leave their
header out and are read back as null, the null id counting as the smallest;
repeated rows are records of their own, and of equal page ids the greatest record
id is the response; control characters and blanks in a url are percent-encoded;
very long payloads make an archive of their own; an empty table gives no records;
other columns are ignored, whatever their names."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch_dir
from .common import Stages

ARCHIVE_BYTES = 16 << 20
# Fixed values of the format.
VERSION, LINE = b"WARC/1.1\r\n", b"\r\n"
BETWEEN = "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PAGE_ID = "X-Page-ID"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the two line ends behind it; headers without value are left out."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + LINE + block


def response(record_id: str, page_id: int | None, url: str | None, date: str, payload: bytes) -> bytes:
    return record("response", [
        ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", safe_url(url)),
        (PAGE_ID, None if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload))], (HTTP_HEAD % len(payload)).encode() + payload)


def revisit(record_id: str, page_id: int | None, url: str | None, date: str, digest: str | None,
            original: tuple[str, str | None, str | None]) -> bytes:
    """A record that refers to ``original`` (record id, url, date)."""
    ref, ref_url, ref_date = original
    return record("revisit", [
        ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", safe_url(url)),
        (PAGE_ID, None if page_id is None else str(page_id)), ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{ref}>"),
        ("WARC-Refers-To-Target-URI", ref_url), ("WARC-Refers-To-Date", ref_date),
        ("WARC-Payload-Digest", None if digest is None else "sha1:" + digest)], b"")


def safe_url(url: str | None) -> str | None:
    return None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, headers by lower-case name; ends where the bytes do."""
    at = 0
    while at < len(archive):
        if not archive.startswith(VERSION, at):
            raise ValueError(f"no record at byte {at}")
        head_end = archive.index(b"\r\n\r\n", at)
        head = archive[at + len(VERSION):head_end].decode()
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in head.split("\r\n"))}
        start = head_end + 4
        end = start + int(headers["content-length"])
        if archive[end:end + 4] != BETWEEN.encode():
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield headers, archive[start:end]
        at = end + 4


def unpacked(content: bytes, name: str) -> bytes:
    """A file's archive; plain or compressed as a whole or record by record."""
    if not name.endswith(".gz"):
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data
    return b"".join(out)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a response: what follows the HTTP head."""
    return block[block.index(b"\r\n\r\n") + 4:] if headers.get("content-type", "").startswith("application/http") else block


class Archives:
    """Records gathered into archives of at most ``ARCHIVE_BYTES`` and one record more."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, rec: bytes) -> Iterator[pa.RecordBatch]:
        self.parts.append(rec)
        self.size += len(rec)
        if self.size >= ARCHIVE_BYTES:
            yield from self.seal()

    def seal(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            text = pa.array([BETWEEN.encode().join(self.parts)], pa.binary()).view(pa.string())
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_arrays([text], names=["archive"])


def _save(archives: DataFrame, path: str, compression: str | None) -> None:
    archives.write.option("maxRecordsPerFile", 1).option("zlib.compress.level", "BEST_SPEED").option("lineSep", BETWEEN).text(path, compression=compression or "none")


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   date: str | None = None, compression: str | None = "gzip") -> None:
    """A response record for every row, in archives under ``path``. A record's id
    is a hash of its page, payload and place in the table, so a task that runs
    again writes the same."""
    crawled = date or now()
    rows = df.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary"))

    def run(batches):
        out, n, part = Archives(), 0, TaskContext.get().partitionId()
        for b in batches:
            for page, u, payload in zip(*b.columns):
                page, payload = page.as_py(), payload.as_py()
                rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{page}/{part}/{n}/{len(payload)}").urn
                n += 1
                yield from out.add(response(rid, page, u.as_py(), crawled, payload))
        yield from out.seal()

    _save(rows.toDF("page_id", "url", "payload").mapInArrow(run, "archive string"), path, compression)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


HEADERS = ("path string, place int, record_id string, record_type string, page_id long, url string, date string, "
           "payload_digest string, payload_bytes long, refers_to_record string")


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives under ``path``: file and place in it, record
    id, type, page id, url, date, payload digest (of a response computed from its
    bytes and compared with its header; of a revisit what its header says), payload
    length (null for revisits), the record a revisit refers to, and with
    ``payload`` the payload."""
    schema = HEADERS + (", payload binary" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for b in batches:
            for name, content in zip(*b.columns):
                name, out, size = name.as_py(), [], 0
                for place, (h, block) in enumerate(parse(unpacked(content.as_py(), name))):
                    out.append(_row(name, place, h, block) + ((payload_of(h, block),) if payload else ()))
                    size += len(block)
                    if len(out) >= 10_000 or payload and size >= ARCHIVE_BYTES // 4:
                        yield batch(out)
                        out, size = [], 0
                if out:
                    yield batch(out)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return _files(spark, path).mapInArrow(run, schema)


def _row(name: str, place: int, h: dict[str, str], block: bytes) -> tuple:
    kind, told = h["warc-type"], h.get("warc-payload-digest")
    digest, size = told and told.removeprefix("sha1:"), None
    if kind == "response":
        payload = payload_of(h, block)
        digest, size = sha1_base32(payload), len(payload)
        if told and told != "sha1:" + digest:
            raise ValueError(f"{name}: payload of record {place} is not that of its header")
    page, ref = h.get(PAGE_ID.lower()), h.get("warc-refers-to")
    return (name, place, h["warc-record-id"].strip("<>"), kind, None if page is None else int(page), h.get("warc-target-uri"),
            h.get("warc-date"), digest, size, ref and ref.strip("<>"))


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``headers`` with ``original`` (record id, url, date): the response that a
    record has to refer to; null for responses that stay and for revisits without
    an original. Payloads shorter than ``min_bytes`` stay."""
    rank = F.struct("page_id", F.col("record_id").alias("id"), "url", "date", "payload_bytes")
    first = (headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
             .groupBy("payload_digest").agg(F.max(rank).alias("r"))
             .select(F.col("payload_digest").alias("of"), F.struct("r.id", "r.url", "r.date").alias("original")))
    long_enough = F.coalesce(F.col("payload_bytes") >= min_bytes, F.lit(True))
    joined = headers.join(first, (F.col("payload_digest") == F.col("of")) & long_enough, "left").drop("of")
    return joined.withColumn("original", F.when(F.col("original.id") != F.col("record_id"), F.col("original")))


def deduplicate(spark: SparkSession, source: str, path: str, min_bytes: int = 0, date: str | None = None,
                compression: str | None = "gzip") -> None:
    """New archives under ``path`` with the records of those under ``source``, equal payloads held once."""
    st, written = Stages(spark), date or now()
    plan = st.write(resolve(read_archives(spark, source), min_bytes)
                    .where("original is not null").select("path", "place", "original", "payload_digest"), "warc_plan")
    # at most one entry for every record of a file, whose size is bounded
    told = plan.groupBy("path").agg(F.collect_list(F.struct("place", "original", "payload_digest")).alias("turned"))
    both = _files(spark, source).join(told, "path", "left").select("path", "content", "turned")

    def run(batches):
        out = Archives()
        for b in batches:
            for name, content, turned in zip(*b.columns):
                turned = {t["place"]: t for t in turned.as_py() or ()}
                for place, (h, block) in enumerate(parse(unpacked(content.as_py(), name.as_py()))):
                    page, rid = h.get(PAGE_ID.lower()), h["warc-record-id"].strip("<>")
                    page, url = None if page is None else int(page), h.get("warc-target-uri")
                    if place in turned:
                        o = turned[place]["original"]
                        rec = revisit(rid, page, url, h.get("warc-date", written), turned[place]["payload_digest"], (o["id"], o["url"], o["date"]))
                    elif h["warc-type"] == "response":
                        rec = response(rid, page, url, h.get("warc-date", written), payload_of(h, block))
                    else:
                        rec = record(h["warc-type"], [(k, v) for k, v in h.items() if k not in ("warc-type", "content-length", "warc-block-digest")], block)
                    yield from out.add(rec)
        yield from out.seal()

    _save(both.mapInArrow(run, "archive string"), path, compression)
    st.drop(plan)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records
    read back, revisits joined to the response they refer to."""
    known = (records.where("record_type = 'response'")
             .select(F.col("record_id").alias("of"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes")))
    return records.join(known, F.col("refers_to_record") == F.col("of"), "left").select(
        "page_id", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("of_page").alias("refers_to"))


def archived_pages(df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written as responses, deduplicated, and read back from the new archives."""
    spark = df.sparkSession
    raw, kept = scratch_dir(spark, "warc"), scratch_dir(spark, "warc_unique")
    st = Stages(spark)
    write_archives(df, raw)
    deduplicate(spark, raw, kept, min_bytes)
    st.remove(raw)
    records = st.write(read_archives(spark, kept), "warc_headers")
    st.remove(kept)
    return pages_of(records)
