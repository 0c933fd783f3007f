"""WARC archives: a writer of gzip members, one a record, and a reader that salvages.

The writer goes through Spark's own text writer and so through its commits: a member's
last byte is zero (the top of its length field), which is the writer's line separator.

The reader checks every record: the member's checksum, the version line, the headers,
the content length, the closing blank lines, the block digest. After a failed check it
searches for the next gzip member or version line that passes all checks, goes on from
there, and logs the bytes between as a quarantined gap with the reason.
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

from railweave.functions.runtime import materialise, scratch_path

#: Payloads of fewer bytes are always stored in full.
MIN_REVISIT = 1000
#: Bytes of pages that go to one archive, by their mean; a file is read as one value.
ARCHIVE_BYTES = 32 << 20
#: Records beyond this many bytes, packed or unpacked, count as damage.
RECORD_BYTES = 1 << 30
#: Longer headers count as damage.
HEADER_BYTES = 16 << 20
#: Bytes of payload in one batch of records read.
BATCH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/"
_EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
RECORD_SCHEMA = "file string, start long, length long, kind string, reason string, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:x-page:none:{digest.hex()}>"


def _uri(url: str) -> str:
    """``url`` with what a header line cannot hold in percent form."""
    return re.sub(r"[\x00-\x20<>\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response record, or a revisit record that holds the HTTP headers only."""
    sha1 = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha1)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1)}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"WARC-Block-Digest: {sha1_base32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member whose last byte is zero; longer data get an empty member behind."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = packer.compress(data) + packer.flush()
    return packed if packed[-1] == 0 else packed + _EMPTY_MEMBER


def owners(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(key, owner): of each payload that repeats, its SHA-256 and the largest page_id that has it."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    known = pages.select(F.col(page_id).alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("key"), F.octet_length(payload).alias("n")).filter(F.col("n") >= min_bytes)
    return known.groupBy("key").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("pages")).filter("pages > 1 AND owner IS NOT NULL").select("key", "owner")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record for each row, in gzip members, under ``path``.

    Of rows with equal payloads of ``min_bytes`` and more those with the largest page_id
    are responses (all of them, where rows repeat it), the others revisit them. Null html
    is an empty payload; a null url leaves the header out; a null page_id is below all
    others, and payloads that only such rows hold are all responses. Other columns are
    ignored; an empty table makes no record.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    # short payloads have keys of their own and are spread
    key = F.when(F.octet_length(payload) >= min_bytes, F.unhex(F.sha2(payload, 256))).otherwise(F.xxhash64(page_id, url).cast("string").cast("binary"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("binary").alias("url"), payload.alias("html"), key.alias("key"))
    repeated = materialise(owners(pages, page_id, html, min_bytes), "owners")
    mean = pages.agg(F.avg(F.octet_length(payload))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for i in range(len(batch)):
                own, link, body, owner = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "owner"))
                link = None if link is None else link.decode("utf-8", "replace")
                out.append(member(record(own, link, body, owner, owner is not None and owner != own, date))[:-1])
                held += len(out[-1])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = rows.join(repeated, "key", "left").select("page_id", "url", "html", "owner").mapInArrow(pack, "member binary")
    (members.select(F.col("member").cast("string").alias("value")).write
     .option("lineSep", "\x00").option("maxRecordsPerFile", max(1, int(archive_bytes // (mean + 1)))).text(path))


class Damage(Exception):
    """A check that failed; ``end`` is where the next record should begin, if that is known."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers with small-letter names, block, end) of the record at ``start``; Damage where a check fails."""
    line = _VERSION_LINE.match(data, start)
    if not line:
        raise Damage("version line")
    stop = data.find(b"\r\n\r\n", line.end() - 2, start + HEADER_BYTES)
    if stop < 0:
        raise Damage("headers without an end")
    headers: dict[str, str] = {}
    name = ""
    for text in data[line.end():stop].decode("utf-8", "replace").split("\r\n"):
        if text[:1] in (" ", "\t") and name:
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Damage("header line")
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or int(length) > RECORD_BYTES:
        raise Damage("content length")
    if not headers.get("warc-type") or not headers.get("warc-record-id"):
        raise Damage("mandatory header")
    block_at = stop + 4
    end = block_at + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damage("record end")
    block = data[block_at:end]
    digest = headers.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:") and digest[5:].upper() != sha1_base32(block)[5:]:
        raise Damage("block digest", end + 4)
    return headers, block, end + 4


def unpacked(data: bytes, start: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at ``start``; its checksum and length are checked."""
    opener = zlib.decompressobj(31)
    parts, size, at = [], 0, start
    try:
        while not opener.eof and at < len(data):
            piece = data[at:at + (1 << 16)]
            at += len(piece)
            while piece and not opener.eof:
                parts.append(opener.decompress(piece, 1 << 20))
                size += len(parts[-1])
                if size > RECORD_BYTES:
                    raise Damage("member too long")
                piece = opener.unconsumed_tail
    except zlib.error as error:
        raise Damage("gzip checksum" if "check" in str(error) else "gzip data") from None
    if not opener.eof:
        raise Damage("gzip member cut short")
    return b"".join(parts), at - len(opener.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str] | None, bytes]]:
    """(start, length, reason, headers, block) of every record and every gap, in order of place.

    Gaps have a reason and no headers. A member may hold several records, or none when
    it is empty; if one of its records fails, the good ones are kept and the member's
    bytes are logged as a gap besides.
    """
    at, gap, reason = 0, -1, ""

    def tried(start: int):
        if data.startswith(GZIP, start):
            content, end = unpacked(data, start)
            return end, content
        return None, None

    while at < len(data):
        try:
            end, content = tried(at)
            if content is None:
                headers, block, end = parse(data, at)
                good, bad = [(headers, block)], None
            else:
                good, bad, inner = [], None, 0
                while inner < len(content):
                    try:
                        headers, block, inner = parse(content, inner)
                        good.append((headers, block))
                    except Damage as damage:
                        bad = bad or damage.reason
                        mark = re.compile(VERSION + rb"1\.[01]\r\n").search(content, inner + 1) if damage.end is None else None
                        inner = damage.end if damage.end is not None else mark.start() if mark else len(content)
                if gap >= 0 and not good:
                    raise Damage(bad or "empty member in a gap")
        except Damage as damage:
            if gap < 0:
                gap, reason = at, damage.reason
            follows = damage.end if damage.end is not None and (damage.end == len(data) or _MARK.match(data, damage.end)) else None
            if follows is None:
                mark = _MARK.search(data, at + 1)
                follows = mark.start() if mark else len(data)
            at = follows
            continue
        if gap >= 0:
            yield gap, at - gap, reason, None, b""
            gap = -1
        if bad:
            yield at, end - at, bad, None, b""
        for headers, block in good:
            yield at, end - at, None, headers, block
        at = end
    if gap >= 0:
        yield gap, len(data) - gap, reason, None, b""


def _hex_digest(text: str | None) -> str | None:
    """Bare small-letter hex of a ``sha1:`` digest in base 32 or hex."""
    if not text or not text.lower().startswith("sha1:"):
        return None
    value = text[5:]
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else bytes.fromhex(value).hex()
    except ValueError:
        return None


def row_of(headers: dict[str, str], block: bytes) -> tuple:
    """(record_type, record_id, uri, refers_to, payload_digest, payload_bytes, payload) of a record.

    An HTTP block's payload is its body. A revisit holds no body, so its digest and
    length are those that its headers name.
    """
    kind, payload, size = headers["warc-type"].lower(), block, len(block)
    digest = _hex_digest(headers.get("warc-payload-digest"))
    if headers.get("content-type", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        named = re.search(rb"(?mi)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", head)
        size = int(named[1]) if kind == "revisit" and named else len(payload)
    if kind != "revisit":
        digest = hashlib.sha1(payload).hexdigest()
    return kind, headers["warc-record-id"], headers.get("warc-target-uri"), headers.get("warc-refers-to"), digest, size, payload


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap of the archives under ``path``.

    ``kind`` is record or gap. Records: start and length of their bytes in the file (of
    the member, if packed), type, id, uri, refers_to, digest (hex) and length of the full
    payload, the payload unless ``payloads`` is false. Gaps: start, length, reason. Plain
    and gzip archives are read alike; empty files give no row. A file is one value, so
    archives of up to 2 GB can be read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in ("kind", "reason", "record_type", "record_id", "uri", "refers_to", "payload_digest")),
                            ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        out, held = [], 0
        for batch in batches:
            for i in range(len(batch)):
                name = batch.column("path")[i].as_py()
                for start, length, reason, headers, block in salvage(batch.column("content")[i].as_py()):
                    if headers is None:
                        row = (name, start, length, "gap", reason, *(None,) * 7)
                    else:
                        *values, payload = row_of(headers, block)
                        row = (name, start, length, "record", None, *values, payload if payloads else None)
                    out.append(row)
                    held += len(block) * payloads + 300
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def page_of(uri: Column) -> Column:
    """The page_id in a record id of the writer, null where there is none."""
    return F.regexp_extract(uri, r"^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")


def write_and_read(pages: DataFrame, **options) -> DataFrame:
    """Per row: page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives in the shared folder."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    found = read_archives(pages.sparkSession, path, payloads=False).filter("kind = 'record'")
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
