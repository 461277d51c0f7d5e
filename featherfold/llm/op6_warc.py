"""WARC archives in Zstandard: a writer, and a reader that validates what it reads.

An archive begins with a skippable frame that holds the dictionary (plain or itself compressed).  One
Zstandard frame per record follows, so any record can be read by itself.  The reader loads the
dictionary, decodes frame after frame, and checks version, header grammar, lengths, block end and
payload digest.

Archives are bounded in size; each is one row (archive, content) of a table, which is what Spark's
``binaryFile`` source gives for files, so archives can lie in any store that Spark reads.  Writing is
a task's output through Spark's commit protocol, and a lost task leaves nothing half written.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"  # of all records: rows carry no date of their own

LEAST_REVISIT = 1000  # bytes of the shortest payload that is stored once
ARCHIVE_BYTES = 8 << 20  # of records before compression, beyond which a new archive begins
SAMPLE_PAGES, DICTIONARY_BYTES = 400, 32 << 10
SAMPLE_BYTES = 16 << 10  # of each sampled page


class WarcError(ValueError):
    """An archive that breaks the format."""


def _printable(value: str) -> str:
    """Header value: control characters, blanks and non-ASCII percent-encoded."""
    return "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page ``refers_to``, which leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": _printable(url or ""),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    return VERSION + f"{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record after validation.  WarcError says what is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not data.startswith(VERSION) or not gap:
        raise WarcError("no version or no end of headers")
    fields: dict[str, str] = {}
    for line in head[len(VERSION) :].decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in fields:
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise WarcError("bad content-length")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, {length} declared")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1."):
        raise WarcError("no HTTP headers")
    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    size = int(inner.get(b"content-length", b"-1"))
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    kind, refers = fields["warc-type"], fields.get("warc-refers-to")
    if kind == "response":
        if size != len(payload):
            raise WarcError(f"payload of {len(payload)} bytes, {size} declared")
        if algorithm != "sha1" or hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("payload digest differs")
    elif kind == "revisit":
        if payload or not refers or fields.get("warc-profile") != PROFILE:
            raise WarcError("bad revisit")
    else:
        raise WarcError(f"unknown type {kind}")

    def page(value: str | None) -> int | None:
        if value is None:
            return None
        if not value.startswith("<urn:page:") or value[-1] != ">":
            raise WarcError(f"bad record id {value[:80]}")
        return int(value[10:-1]) if value[10:-1] else None

    return {
        "page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": page(refers), "payload_bytes": size, "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of an archive in order, each from one frame."""
    view, at, context = memoryview(content), 0, zstd.ZstdDecompressor()
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            raise WarcError("the dictionary frame is cut")
        raw = bytes(view[8 : 8 + size])
        if size >= 4 and struct.unpack_from("<I", raw)[0] == FRAME:
            raw = context.decompressobj().decompress(raw)
        context, at = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw)), 8 + size
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError("a frame is cut")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            at += 8 + size
            continue
        if magic != FRAME:
            raise WarcError(f"no frame at {at}")
        frame, parts = context.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + (64 << 10)]
            if not len(piece):
                raise WarcError("a frame is cut")
            try:
                parts.append(frame.decompress(piece))
            except zstd.ZstdError as e:
                raise WarcError(str(e)) from e
            at += len(piece) - len(frame.unused_data)
        yield parse_record(b"".join(parts))


class Archive:
    """An archive in the making."""

    def __init__(self, dictionary: bytes | None):
        self.parts, self.size = [], 0
        data = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        self.context = zstd.ZstdCompressor(level=3, dict_data=data, write_checksum=True, write_content_size=True)
        if dictionary:
            self.parts.append(dictionary_frame(dictionary))

    def add(self, record: bytes) -> None:
        self.parts.append(self.context.compress(record))
        self.size += len(record)


def train_dictionary(pages: DataFrame) -> bytes | None:
    """A dictionary from a bounded sample: at most ``SAMPLE_PAGES`` payloads, each once, least digests first.

    A bound on the digest, set by a sketch of how many there are, lets about twice that many pass, so
    what reaches the driver does not grow with the number of tasks.
    """
    full = pages.where(F.length("payload") > 0)
    kinds = full.agg(F.approx_count_distinct("digest")).first()[0]
    if kinds > 2 * SAMPLE_PAGES:
        full = full.where(F.col("digest") < f"{2 * SAMPLE_PAGES * 16**10 // kinds:010x}")
    starts = full.groupBy("digest").agg(F.min(F.substring("payload", 1, SAMPLE_BYTES)).alias("start"))
    samples = [bytes(r["start"]) for r in starts.orderBy("digest").limit(SAMPLE_PAGES).collect()]
    if len(samples) < 8 or sum(map(len, samples)) < 10 * 1024:
        return None
    try:
        size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:  # too much alike to learn from
        return None


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which records revisit which page.

    Of pages with equal payloads of ``LEAST_REVISIT`` bytes or more, that with the largest page_id is
    the response.  Repeated rows of that page are responses too; so are all pages of a payload whose pages have no id.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    base = base.select("*", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("strong"))
    large = base.where(F.octet_length("payload") >= LEAST_REVISIT)
    twins = large.groupBy("digest", "strong").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    twins = twins.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("d"), F.col("strong").alias("s"), "first")
    joined = base.join(twins, (base["digest"] == twins["d"]) & (base["strong"] == twins["s"]), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): a record per row of ``pages`` (page_id, url, html), in archives of bounded size.

    The payload is the html in UTF-8, empty where missing.  A missing page_id or url is left out of
    the headers; other columns are ignored.  No rows make no archives.
    """
    records = plan_records(pages)
    dictionary = train_dictionary(records.select("page_id", "payload", "digest"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(dictionary)

        def closed(a: Archive) -> pa.RecordBatch:
            content = b"".join(a.parts)
            name = f"{hashlib.sha1(content).hexdigest()}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, digest, refers = (c[k].as_py() for c in batch.columns)
                archive.add(build_record(page_id, url, payload, digest, refers))
                if archive.size >= archive_bytes:
                    yield closed(archive)
                    archive = Archive(dictionary)
        if archive.size:
            yield closed(archive)

    return records.mapInArrow(run, "archive string, content binary")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(archives: DataFrame, content_col: str = "content", payloads: bool = True) -> DataFrame:
    """A row per record of archives (one per row of ``content_col``), validated; WarcError ends the job.

    ``payloads=False`` leaves the payloads out after they were checked.  A missing or empty archive has no records.
    """
    schema = RECORD if payloads else RECORD.rpartition(",")[0]
    names = [p.split()[0] for p in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in read_archive(content.as_py() or b""):
                    rows.append([record[n] for n in names])
                    size += len(record["payload"] or b"") if payloads else 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    return archives.select(content_col).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, then read the records back from there."""
    return read_archives(materialize(write_archives(pages), "warc"), payloads=False)
