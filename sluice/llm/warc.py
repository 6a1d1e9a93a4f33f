"""WARC archives: a writer with one gzip member per record, and a sequential reader.

An archive is a row: its name and its bytes, the contents of one .warc.gz file of about ``roll`` bytes. ``write`` puts
archives in a table in the shared folder, so a lost task is written again as a whole; ``read`` reads such rows, or those
of Spark's ``binaryFile`` source over real .warc.gz files. The reader takes an archive's bytes in blocks, inflates them
member by member and a bounded piece at a time, frames each record by its Content-Length and checks its digests, of any
algorithm and spelling that it knows. What is not wanted of a record is not kept.

Records of ``write`` are named ``urn:x-row:<id>:<digest>``, so a revisit's WARC-Refers-To has its response's id, and the
HTTP header that a revisit holds has the payload's length. There are no headers of our own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow, pieces, written

#: Compressed bytes after which an archive ends, and bytes that the reader inflates at a time.
ROLL, BLOCK = 4 << 20, 1 << 16
#: Bytes that come out of inflation at a time, and those of a record's headers at most.
INFLATED, MOST_HEAD = 1 << 20, 1 << 20
#: Payloads below this many bytes are never replaced by a reference to an equal one.
LEAST_REVISIT = 100
#: Fixed values of the format.
VERSION, GZIP = b"WARC/1.1", 31
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Digests that are checked, by the names that archives give them; others are passed over.
DIGESTS = {"md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha384": "sha384", "sha-384": "sha384", "sha512": "sha512", "sha-512": "sha512"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """Bytes that are not a sequence of WARC records, or whose digests differ."""


@dataclass
class Record:
    """``http``: the header of the HTTP message in the block, if it has one. ``payload``: its body, else the block; empty
    where it was not to be kept. ``payload_bytes`` is its length either way, that of what a revisit stands for."""

    headers: dict[str, str]
    http: bytes = b""
    payload: bytes = b""
    payload_bytes: int | None = None
    payload_sha256: str = ""

    def row(self, urn: str) -> int | None:
        found = re.fullmatch(r"<?urn:x-row:(-?\d+):[0-9a-f]+>?", urn)
        return int(found[1]) if found else None


class Digest:
    """A digest as archives write it, in hex or base 32, to be fed. ``ok`` is true where the algorithm is not known."""

    def __init__(self, written: str | None) -> None:
        name, colon, self.value = (written or "").partition(":")
        known = DIGESTS.get(name.strip().lower()) if colon else None
        self.hash = hashlib.new(known) if known else None

    def feed(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    @property
    def ok(self) -> bool:
        if not self.hash:
            return True
        value = self.value.strip()
        return value.lower() == self.hash.hexdigest() or value.upper().rstrip("=") == base64.b32encode(self.hash.digest()).decode().rstrip("=")


def record_bytes(kind: str, record_id: str, url: str, payload: bytes, digest: str, extra: dict[str, str]) -> bytes:
    """A record as one gzip member. A revisit has the HTTP header alone."""
    block = HTTP % len(payload) + (payload if kind == "response" else b"")
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    } | extra
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    packer = zlib.compressobj(4, zlib.DEFLATED, GZIP)
    return packer.compress(VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def urn(row: int | None, digest: str) -> str:
    """The name of a row's record; rows without an id have one by their payload."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}" if row is None else f"urn:x-row:{row}:{digest[:32]}"


def one_line(x: str | None) -> str:
    """A header's value: controls, which would end it, become percent escapes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in (x or ""))


def write(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll: int = ROLL) -> DataFrame:
    """A table of archives, (archive, data), with a record for each row.

    Null payloads count as empty, null urls too. Of equal payloads of at least LEAST_REVISIT bytes, the rows with the
    smallest id are responses (several, if such a row is repeated), the others revisits that refer to that id; a row with
    a null id is a revisit if another has an id. Other columns are not read. Shuffles: (id, digest) once summed by digest,
    and the rows by digest to meet their first id.
    """
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    digest = F.sha2(F.encode("payload", "UTF-8"), 256)
    same = d.filter(F.octet_length("payload") >= LEAST_REVISIT).select("id", digest.alias("digest"))
    same = same.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null").drop("n")
    d = d.withColumn("digest", digest).join(same, "digest", "left")
    d = d.select("id", "url", "payload", "digest", F.when(F.col("id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            data = b"".join(parts)
            name = f"{hashlib.sha256(data).hexdigest()[:16]}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["archive", "data"])

        for batch in batches:
            for piece in pieces(batch, 1 << 20):
                for i, url, payload, digest, refers in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    body = payload.encode()
                    extra = {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{urn(refers, digest)}>"} if refers is not None else {}
                    data = record_bytes("response" if refers is None else "revisit", urn(i, digest), one_line(url), body, digest, extra)
                    parts.append(data)
                    size += len(data)
                    if size >= roll:
                        yield flushed()
                        parts.clear()
                        size = 0
        if parts:
            yield flushed()

    return written(arrow(d, run, "archive string, data binary"), "archives")


def records(data: bytes | memoryview, block: int = BLOCK, keep_payload: bool = True) -> Iterator[Record]:
    """The records of an archive, from ``block`` bytes of it at a time. Without ``keep_payload`` payloads are only measured
    and digested, so memory is bounded whatever a record's length."""
    view = memoryview(data)
    at, n = 0, len(view)
    while at < n:
        inflate, frame = zlib.decompressobj(GZIP), Frame(keep_payload)
        while not inflate.eof:
            if at >= n and not inflate.unconsumed_tail:
                raise BadArchive("the last member is cut off")
            chunk = inflate.unconsumed_tail or view[at : at + block]
            if not inflate.unconsumed_tail:
                at += len(chunk)
            try:
                frame.feed(inflate.decompress(chunk, INFLATED))
            except zlib.error as e:
                raise BadArchive(f"not a gzip member: {e}") from None
        at -= len(inflate.unused_data)
        yield frame.end()


@dataclass
class Frame:
    """One record that comes in pieces: headers, Content-Length bytes of block, and a blank line."""

    keep_payload: bool
    got: bytearray = field(default_factory=bytearray)
    record: Record | None = None
    left: int = 0
    in_http: bool = False

    def feed(self, data: bytes) -> None:
        self.got += data
        if self.record is None:
            end = self.got.find(b"\r\n\r\n")
            if end < 0:
                if len(self.got) > MOST_HEAD:
                    raise BadArchive("a record without an end of its headers")
                return
            self._begin(_headers(bytes(self.got[:end])))
            del self.got[: end + 4]
        if self.left:
            part = bytes(self.got[: self.left])
            del self.got[: self.left]
            self.left -= len(part)
            self.block_digest.feed(part)
            self._block(part)
        if not self.left and len(self.got) > 4:
            raise BadArchive("a record is longer than its Content-Length")

    def _begin(self, headers: dict[str, str]) -> None:
        self.record, self.left = Record(headers), int(headers["content-length"])
        self.in_http = headers.get("content-type", "").startswith("application/http")
        self.revisit = headers["warc-type"] == "revisit"
        self.block_digest, self.payload_digest = Digest(headers.get("warc-block-digest")), Digest(None if self.revisit else headers.get("warc-payload-digest"))
        self.sha256, self.size, self.parts, self.http = hashlib.sha256(), 0, [], b""

    def _block(self, part: bytes) -> None:
        if self.in_http:
            self.http += part
            head, blank, part = self.http.partition(b"\r\n\r\n")
            if not blank:
                return
            self.http, self.in_http = head, False
        self.size += len(part)
        self.payload_digest.feed(part)
        self.sha256.update(part)
        if self.keep_payload:
            self.parts.append(part)

    def end(self) -> Record:
        r = self.record
        if r is None or self.left or self.got != b"\r\n\r\n":
            raise BadArchive("a record and its Content-Length differ")
        if not self.block_digest.ok:
            raise BadArchive("a block's digest differs")
        if not self.payload_digest.ok:
            raise BadArchive("a payload's digest differs")
        r.http, r.payload, r.payload_sha256 = self.http, b"".join(self.parts), self.sha256.hexdigest()
        r.payload_bytes = self.size
        if self.revisit and not self.size:  # the length is that of the message it stands for
            told = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", r.http)
            r.payload_bytes = int(told[1]) if told else None
        return r


def _headers(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with a blank goes on with the one before."""
    first, *lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise BadArchive("a record does not begin with WARC/")
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise BadArchive("a header without a colon")
        out[name.strip().lower()] = value.strip()
    if not out.get("content-length", "").isdigit() or "warc-type" not in out:
        raise BadArchive("a record without Content-Length or WARC-Type")
    return out


def read(archives: DataFrame, *, data_col: str = "data", name_col: str = "archive", keep_payload: bool = True) -> DataFrame:
    """A row for each record: archive, record_type, id and refers_to (of rows that ``write`` has written, else null),
    record_id and refers_to_record (as written there), url, payload_bytes, payload_digest (bare hexadecimal SHA-256 of the
    full payload; of a revisit that its header has, if it is one), and, if asked for, the payload itself (empty for
    revisits). Null and empty archives have no records; a bad one stops the job. A task holds one archive at a time, as
    Spark's binary cells are whole, and a record's payload only if it is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for r in records(memoryview(data.as_buffer()), keep_payload=keep_payload) if data.is_valid else ():
                    rows.append(described(name.as_py(), r))
                    size += len(r.payload)
                    if size > 1 << 22 or len(rows) == 4096:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    def described(name: str, r: Record) -> tuple:
        h = r.headers
        digest = r.payload_sha256
        if h["warc-type"] == "revisit":
            told = re.fullmatch(r"(?i)sha-?256:([0-9a-f]{64})", h.get("warc-payload-digest", ""))
            digest = told[1].lower() if told else None
        own, refers = h.get("warc-record-id", ""), h.get("warc-refers-to")
        text = [r.payload.decode("utf-8", "replace")] if keep_payload else []
        return name, h["warc-type"], r.row(own), h.get("warc-target-uri"), r.payload_bytes, digest, r.row(refers or ""), own.strip("<>"), refers.strip("<>") if refers else None, *text

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=NAMES[: len(rows[0])])

    schema = "archive string, record_type string, id long, url string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_record string" + ", payload string" * keep_payload
    return arrow(archives.select(F.col(name_col).alias("archive"), F.col(data_col).alias("data")), run, schema)


NAMES = ["archive", "record_type", "id", "url", "payload_bytes", "payload_digest", "refers_to", "record_id", "refers_to_record", "payload"]


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read(archives, keep_payload=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
q as (select page_id, strlen(payload) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from q where payload_bytes >= 100 group by 1)
select q.page_id, cast(q.payload_bytes as bigint) as payload_bytes, q.payload_digest,
  case when f.first_id is null or f.first_id = q.page_id then 'response' else 'revisit' end as record_type,
  case when f.first_id <> q.page_id then f.first_id end as refers_to
from q left join f using (payload_digest)
"""
