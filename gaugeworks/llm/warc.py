"""WARC archives of pages, and a reader that salvages what damage left whole.

Writing: equal payloads are stored once; later copies are revisit records. Every record is a gzip
member of its own, so a file can be entered at any member. Spark's text writer puts the members
into files, with its own commit, in any store Spark can write: a member ends in the high byte of
its length, which is zero below 16 MB, so that byte is the writer's line separator.

Reading: a record counts only after all checks (inflated whole and to its checksum, version line,
header, length, end of record, digests). After a failed check the reader searches for the next gzip
member or version line that passes them, goes on from there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import batches_of
from gaugeworks.session import materialize, remove_at_end, shared_folder

# Format names, header names, and the profile of revisits of equal payloads.
VERSION = "WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
GZIP_START = b"\x1f\x8b\x08"
VERSION_START = b"WARC/1."
HEADER_END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
PAGE_ID = "X-Page-Id"
WARC_DATE = "1970-01-01T00:00:00Z"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)

# A file holds no more than this, before compression, unless a single record is larger.
FILE_BYTES = 64 << 20
WRITE_ROWS = 256
FILES_AT_ONCE = 1
RECORDS_OUT = 256
CHUNK = 1 << 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------------- writing


def record_urn(page_id: str | None, digest: str) -> str:
    """The same name for the same page and payload in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def one_line(value: str) -> str:
    """A header value without control characters or blanks, which are written as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record_bytes(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = WARC_DATE) -> bytes:
    """One record: a response with its payload, or, if ``refers_to`` names a page, a revisit of that page's response."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_urn(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else one_line(url)),
        ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE),
        ("WARC-Refers-To", None if refers_to is None else record_urn(refers_to, digest)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        (PAGE_ID, page_id),
        ("Content-Type", HTTP_TYPE),
        ("Content-Length", str(len(block))),
    ]
    lines = [VERSION, *[f"{name}: {value}" for name, value in headers if value is not None]]
    return "\r\n".join(lines).encode() + HEADER_END + block + HEADER_END


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte; above 16 MB an empty member is put behind."""
    packer = zlib.compressobj(wbits=31)
    packed = packer.compress(record) + packer.flush()
    return packed if packed.endswith(b"\0") else packed + EMPTY_MEMBER


def planned(pages: DataFrame, least_payload: int = 0) -> tuple[DataFrame, int]:
    """(page_id, url, payload, refers_to) and the size of the largest payload.

    Of rows with equal payloads (by SHA-256) of at least ``least_payload`` bytes, those with the
    largest page_id are responses, the others refer to it. Groups are counted on digests alone;
    the payload is joined only to groups of two or more.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", payload.alias("payload"))
    key = F.unhex(F.sha2("payload", 256))
    groups = materialize(
        pages.select("page_id", payload.alias("payload"))
        .select("page_id", key.alias("key"), F.octet_length("payload").alias("bytes"))
        .groupBy("key")
        .agg(F.max("page_id").cast("string").alias("last"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    )
    largest = groups.agg(F.max("bytes")).first()[0] or 0
    copies = groups.filter((F.col("n") > 1) & (F.col("bytes") >= least_payload)).select("key", "last")
    told = rows.withColumn("key", key).join(copies, "key", "left")
    return told.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")), largest


def write_archives(pages: DataFrame, path: str, least_payload: int = 0, date: str = WARC_DATE) -> None:
    """One record per row of ``pages`` (page_id, url, html; other columns are not read) into ``path``.

    A NULL html is an empty payload, a NULL url or page_id a header less. Repeated rows are records
    of their own: of equal payloads all rows with the largest page_id are responses; a row without
    an id revisits it, and where no row of a group has an id, all are responses. An empty table
    makes no records.
    """
    plan, largest = planned(pages, least_payload)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = (batch[c] for c in ("page_id", "url", "payload", "refers_to"))
            yield pd.DataFrame({"value": [member(record_bytes(*row, date))[:-1] for row in zip(*columns)]})

    with batches_of(pages.sparkSession, WRITE_ROWS):
        (
            plan.mapInPandas(members, "value binary")
            .select(F.col("value").cast("string"))
            .write.option("lineSep", "\0")
            .option("compression", "none")
            .option("maxRecordsPerFile", max(1, FILE_BYTES // (largest + 1024)))
            .text(path)
        )


# ---------------------------------------------------------------------- reading


class Damaged(Exception):
    """A check that a record or member did not pass."""


@dataclass(frozen=True)
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The body behind an HTTP header, or the whole block of other content."""
        if not self.headers.get("content-type", "").lower().startswith("application/http"):
            return self.block
        head, _, body = self.block.partition(HEADER_END)
        return body

    @property
    def payload_bytes(self) -> int | None:
        """The size of the payload; for a revisit what its HTTP header states, or NULL."""
        if self.headers.get("warc-type") != "revisit":
            return len(self.payload)
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)\r?$", self.block.partition(HEADER_END)[0])
        return int(stated.group(1)) if stated else None


@dataclass(frozen=True)
class Gap:
    start: int
    end: int
    reason: str


def _checked_digest(stated: str | None, content: bytes, what: str) -> None:
    algorithm, _, value = (stated or "").partition(":")
    if algorithm.lower() not in ("sha1", "sha256", "md5"):
        return
    digest = hashlib.new(algorithm.lower(), content)
    if value.strip().upper() not in (base64.b32encode(digest.digest()).decode(), digest.hexdigest().upper()):
        raise Damaged(f"{what} digest")


def record_at(data: bytes, at: int) -> Record:
    """The record that starts at ``at``, after all its checks."""
    if not VERSION_LINE.match(data, at):
        raise Damaged("version line")
    head_end = data.find(HEADER_END, at)
    if head_end < 0:
        raise Damaged("header end")
    headers: dict[str, str] = {}
    name = ""
    for line in data[at:head_end].split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Damaged("header line")
        name = name.strip().lower()
        headers[name] = value.strip()
    if not re.fullmatch(r"[0-9]+", headers.get("content-length", "")):
        raise Damaged("content length")
    start = head_end + len(HEADER_END)
    end = start + int(headers["content-length"])
    if data[end : end + len(HEADER_END)] != HEADER_END:
        raise Damaged("end of record")
    record = Record(at, end + len(HEADER_END), headers, data[start:end])
    _checked_digest(headers.get("warc-block-digest"), record.block, "block")
    if headers.get("warc-type") != "revisit":
        _checked_digest(headers.get("warc-payload-digest"), record.payload, "payload")
    return record


def inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and where the member ends.

    Given up at the first error, or as soon as the content does not begin like a record.
    """
    unpacker = zlib.decompressobj(wbits=31)
    view = memoryview(data)
    out: list[bytes] = []
    fed = at
    checked = False
    while not unpacker.eof:
        if fed >= len(data):
            raise Damaged("member cut short")
        try:
            piece = unpacker.decompress(view[fed : fed + CHUNK])
        except zlib.error:
            raise Damaged("member data") from None
        fed += CHUNK
        if piece:
            out.append(piece)
            if not checked and not piece.startswith(VERSION_START[: len(piece)]):
                raise Damaged("member content")
            checked = True
    return b"".join(out), min(fed, len(data)) - len(unpacker.unused_data)


class _Starts:
    """The next place where a member or a record may begin; each byte is searched once per sign."""

    def __init__(self, data: bytes):
        self.data = data
        self.known = {GZIP_START: -1, VERSION_START: -1}

    def after(self, at: int) -> int:
        for sign, place in self.known.items():
            if place < at:
                found = self.data.find(sign, at)
                self.known[sign] = len(self.data) if found < 0 else found
        return min(self.known.values())


def scan(data: bytes) -> Iterator[Record | Gap]:
    """The records of an archive in order, and the gaps between them, which cover all other bytes.

    A record inside a member carries the member's range. Damage inside a member that inflates to
    its checksum quarantines only that part of its content: the gap has the member's range, and
    its reason says which bytes of the content it is about.
    """
    starts = _Starts(data)
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            if data.startswith(GZIP_START, at):
                content, end = inflated(data, at)
                found: list[Record | Gap] = []
                for item in scan(content):
                    if isinstance(item, Record):
                        found.append(Record(at, end, item.headers, item.block))
                    else:
                        found.append(Gap(at, end, f"{item.reason}, bytes {item.start} to {item.end} of the content"))
            else:
                found = [record_at(data, at)]
                end = found[0].end
        except Damaged as failed:
            if gap is None:
                gap, reason = at, str(failed)
            at = starts.after(at + 1)
            continue
        if gap is not None:
            yield Gap(gap, at, reason)
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield Gap(gap, len(data), reason)


FOUND_SCHEMA = (
    "path string, start long, end long, gap_reason string, record_type string, record_id string, refers_to string, "
    "target_uri string, page_id string, payload_digest string, payload_bytes long, payload binary"
)


def _row(path: str, item: Record | Gap) -> tuple:
    if isinstance(item, Gap):
        return (path, item.start, item.end, item.reason, *[None] * 8)
    h = item.headers
    digest = h.get("warc-payload-digest")
    return (
        path,
        item.start,
        item.end,
        None,
        h.get("warc-type"),
        h.get("warc-record-id"),
        h.get("warc-refers-to"),
        h.get("warc-target-uri"),
        h.get(PAGE_ID.lower()),
        digest.partition(":")[2] if digest else None,
        item.payload_bytes,
        None if h.get("warc-type") == "revisit" else item.payload,
    )


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``, plain or gzipped by the record or as a whole.

    A row with ``gap_reason`` is a quarantined range of bytes, any other a record that passed all
    checks. Files are dealt over the tasks, and a task holds one file at a time; a file of 2 GB or
    more cannot be read. An empty folder gives no rows. ``payloads=False`` leaves the payload out.
    The result is written to the shared folder, so archives are parsed once.
    """
    names = [part.split()[0] for part in FOUND_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                for item in scan(bytes(content)):
                    row = _row(file, item)
                    rows.append(row if payloads else (*row[:-1], None))
                    if len(rows) == RECORDS_OUT:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    with batches_of(spark, FILES_AT_ONCE):
        return materialize(files.mapInPandas(parse, FOUND_SCHEMA))


def gaps(found: DataFrame) -> DataFrame:
    """(path, start, end, gap_reason): the quarantined bytes."""
    return found.filter("gap_reason is not null").select("path", "start", "end", "gap_reason")


def page_records(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row per record.

    ``refers_to`` is the page of the response that a revisit names; NULL where that response was
    not recovered. Only record names are joined; equal responses of one page are one target.
    """
    records = found.filter("gap_reason is null")
    targets = (
        records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("target"))
    )
    revisits = records.filter("record_type = 'revisit'").join(targets, "refers_to", "left")
    others = records.filter("record_type <> 'revisit' or record_type is null").withColumn("target", F.lit(None).cast("string"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "target"]
    rows = revisits.select(columns).unionByName(others.select(columns))
    return rows.withColumnRenamed("target", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back as ``page_records`` with the pages' type of id."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/gaugeworks-warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    remove_at_end(spark, path)
    kind = pages.schema["page_id"].dataType
    back = page_records(read_archives(spark, path, payloads=False))
    return back.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
