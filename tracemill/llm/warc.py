"""WARC archives compressed with zstandard: one frame per record, the dictionary in the leading skippable frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed or not; every record is
one frame compressed with that dictionary.  ``read_archives`` takes rows (path, content), as Spark's ``binaryFile`` source gives
them, and checks every record: frame bounds, version line, required headers, header syntax, Content-Length against
the block, the closing line ends, the HTTP length of a response against its payload and the payload digest.  A record that fails is
reported in ``problem``; a broken frame ends its archive with one such row.

``write_archives`` turns pages into such archives.  Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
smallest page_id becomes a response and the others revisits that refer to it and carry no payload.  Pages meet the first page of their payload by
its digest; a payload on more than one in HOT_SHARE pages is dealt by rows over as many salts as its share asks for, so that no payload gathers in
one task.

Defined cases: a null html is an empty payload.  Repeated rows of the first page are responses each.  Where all pages of a payload lack an
id they are responses; other pages without an id are revisits with an empty id.  Extra columns are not read.  No pages give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Run, byte_slices, smallest

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
TYPES = frozenset("warcinfo response resource request metadata revisit conversion continuation".split())
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of their own
LEVEL = 3
ARCHIVE_BYTES = 8 << 20  # of records before compression
LEAST_BYTES = 0
HOT_SHARE = 1024  # fewer than so many payloads are hot, whatever the number of pages
#: The dictionary is trained from at most DICTIONARY_PAGES pages, SAMPLE_BYTES of each.
DICTIONARY_PAGES = 400
SAMPLE_BYTES = 4096
DICTIONARY_BYTES = 64 << 10
RECORD = (
    "path string, number int, record_type string, record_id string, target_uri string, page_id long, refers_to long, "
    "payload binary, payload_bytes long, payload_digest string, problem string"
)
_HEADER = re.compile(r"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*?)[ \t]*\Z", re.S)
_PAGE_URN = re.compile(r"<urn:page:(-?\d*)>\Z")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstandard frame that begins at ``at`` ends, from its header and block sizes (RFC 8878)."""
    descriptor = data[at + 4]
    single, checksum, dictionary, size = descriptor >> 5 & 1, descriptor >> 2 & 1, descriptor & 3, descriptor >> 6
    at += 5 + (1 - single) + (0, 1, 2, 4)[dictionary] + ((single, 2, 4, 8)[size])
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("a frame ends inside a block header")
        kind, length = block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("a block has the reserved type")
        at += 3 + (1 if kind == 1 else length)
        if block & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def _skippable(data: memoryview, at: int) -> int:
    """End of a skippable frame at ``at``, 0 if none begins there."""
    if at + 8 > len(data):
        return 0
    magic, length = struct.unpack_from("<II", data, at)
    if not 0x184D2A50 <= magic <= 0x184D2A5F:
        return 0
    if at + 8 + length > len(data):
        raise ValueError("a skippable frame is cut off")
    return at + 8 + length


def archive_records(content: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, in order."""
    data, at, dictionary = memoryview(content), 0, None
    end = _skippable(data, 0)
    if end:
        if struct.unpack_from("<I", data, 0)[0] == SKIPPABLE:
            raw = bytes(data[8:end])
            if len(raw) >= 4 and struct.unpack_from("<I", raw)[0] == FRAME:
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
            dictionary = zstandard.ZstdCompressionDict(raw)
        at = end
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        end = _skippable(data, at)
        if not end:
            if at + 6 > len(data) or struct.unpack_from("<I", data, at)[0] != FRAME:
                raise ValueError(f"no frame begins at byte {at}")
            end = frame_end(data, at)
            yield decoder.decompressobj().decompress(bytes(data[at:end]))
        at = end


def parse_record(record: bytes) -> dict:
    """Headers and block of a record; raises ValueError with what is wrong."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("the headers do not end")
    lines = head.decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        raise ValueError("no version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        if line[:1] in " \t" and headers:
            name = next(reversed(headers))
            headers[name] += " " + line.strip()
            continue
        found = _HEADER.match(line)
        if not found:
            raise ValueError(f"a header line has no name: {line[:40]}")
        name = found[1].lower()
        if name in headers and name != "warc-concurrent-to":
            raise ValueError(f"{name} occurs twice")
        headers[name] = found[2]
    absent = [n for n in REQUIRED if n not in headers]
    if absent:
        raise ValueError(f"{absent[0]} is missing")
    if headers["warc-type"] not in TYPES:
        raise ValueError(f"unknown type {headers['warc-type'][:40]}")
    if not headers["content-length"].isdigit():
        raise ValueError("Content-Length is not a number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the block has {max(0, len(rest) - 4)}")
    return {"headers": headers, "block": rest[:length]}


def _page(urn: str | None) -> int | None:
    found = _PAGE_URN.match(urn or "")
    return int(found[1]) if found and found[1] else None


def describe(record: bytes) -> dict:
    """The columns of RECORD after ``number`` for one record."""
    parsed = parse_record(record)
    headers, block = parsed["headers"], parsed["block"]
    kind = headers["warc-type"]
    payload: bytes | None = block
    size = len(block)
    if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        http, gap, body = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise ValueError("the block is no HTTP message")
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
        size = int(stated[1]) if stated else len(body)
        payload = body
        if kind == "response" and size != len(body):
            raise ValueError(f"the HTTP length is {size}, the payload has {len(body)}")
    stated_digest = headers.get("warc-payload-digest", "")
    algorithm, _, value = stated_digest.partition(":")
    if kind == "revisit":
        if "warc-profile" not in headers:
            raise ValueError("a revisit has no profile")
        payload = None
    elif algorithm.lower() == "sha1" and value != digest(payload):
        raise ValueError("the payload does not have the stated digest")
    return {
        "record_type": kind,
        "record_id": headers["warc-record-id"],
        "target_uri": headers.get("warc-target-uri"),
        "page_id": _page(headers["warc-record-id"]),
        "refers_to": _page(headers.get("warc-refers-to")),
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": value or None,
        "problem": None,
    }


def make_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """A response with the payload, or a revisit that refers to page ``first``."""
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    headers = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        headers += [f"WARC-Refers-To: {urn(first)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(headers).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Collects records and hands out an archive whenever enough are there."""

    def __init__(self, dictionary: bytes):
        self.dictionary = dictionary
        content = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=True) if content else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self._begin()

    def _begin(self) -> None:
        self.parts, self.size = [], 0
        if self.dictionary:
            held = zstandard.ZstdCompressor(level=LEVEL).compress(self.dictionary)
            self.parts.append(struct.pack("<II", SKIPPABLE, len(held)) + held)

    def add(self, record: bytes) -> bytes | None:
        self.parts.append(self.coder.compress(record))
        self.size += len(record)
        return self.finish() if self.size >= ARCHIVE_BYTES else None

    def finish(self) -> bytes | None:
        if not self.size:
            return None
        content = b"".join(self.parts)
        self._begin()
        return content


def train_dictionary(pages: DataFrame) -> bytes:
    """From the beginnings of a bounded sample of pages; empty if the sample is too small to train."""
    rows = smallest(pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull()).select("page_id"), "page_id", DICTIONARY_PAGES)
    sample = pages.join(F.broadcast(rows.distinct()), "page_id").select("page_id", F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    samples = [make_record(r["page_id"], None, r["html"].encode("utf-8", "surrogatepass"), None, False) for r in smallest(sample, "page_id", DICTIONARY_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archives (path, content) with a record of every page (page_id, url, html)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(rows))  # DICTIONARY_BYTES at most
    rows = rows.withColumn("__digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    firsts = rows.groupBy("__digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("__n"))
    firsts = Run(pages.sparkSession, "warc").land(firsts, "firsts")
    total = firsts.agg(F.sum("__n")).first()[0] or 0
    salts = F.when((F.col("__n") > 1) & (F.col("__n") * HOT_SHARE > total), F.ceil(F.col("__n") * HOT_SHARE / F.lit(max(total, 1)))).otherwise(1)
    firsts = firsts.select("__digest", "first", salts.cast("int").alias("__salts"))
    hot = firsts.where(F.col("__salts") > 1).select("__digest", "__salts")
    rows = rows.join(F.broadcast(hot), "__digest", "left")
    rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    rows = rows.join(firsts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))), ["__digest", "__salt"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, number, task = ArchiveWriter(dictionary.value), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part, texts in byte_slices(batch, "html"):
                for page_id, url, html, first in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), texts, part.column("first").to_pylist(), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    revisit = len(payload) >= least_bytes and first is not None and page_id != first
                    content = writer.add(make_record(page_id, url, payload, first, revisit))
                    if content:
                        yield _archive(task, number, content)
                        number += 1
        content = writer.finish()
        if content:
            yield _archive(task, number, content)

    return rows.select("page_id", "url", "html", "first").mapInArrow(write, "path string, content binary")


def _archive(task: int, number: int, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:05d}-{number:05d}.warc.zst"]), pa.array([content], pa.binary())], ["path", "content"])


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Columns of RECORD for every record of every archive; without ``payloads`` they are checked and left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path, content = batch.column("path")[row].as_py(), batch.column("content")[row].as_py()
                held, size = [], 0
                for record in _records(path, content or b""):
                    size += len(record["payload"] or b"")
                    held.append(record if payloads else record | {"payload": None})
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    return archives.select("path", "content").mapInArrow(read, RECORD)


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in RECORD.split(", "))])


def _records(path: str, content: bytes) -> Iterator[dict]:
    empty = dict.fromkeys(_SCHEMA.names) | {"path": path}
    number = 0
    try:
        for record in archive_records(content):
            try:
                yield {"path": path, "number": number} | describe(record)
            except (ValueError, UnicodeDecodeError) as wrong:
                yield empty | {"number": number, "problem": str(wrong)}
            number += 1
    except (ValueError, IndexError, struct.error, zstandard.ZstdError) as wrong:
        yield empty | {"number": number, "problem": f"archive: {wrong}"}
