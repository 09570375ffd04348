"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing. Payloads are digested (SHA-256) in one scan of the pages; of equal payloads of at
least ``REVISIT_BYTES`` bytes the one with the smallest id is a response record and the
others revisit it. Each record is its own gzip member, so any record can be read alone.

Reading. A record is checked: gzip's own checksum and length, the version line, the header
lines, Content-Length and the payload's digest (sha256 or md5 in hex, sha1 in base 32 or
hex). After a failed check the reader looks for the next place where a valid member begins
(gzip's magic, a member that decompresses to a version line), or the next version line in a
file that isn't compressed, goes on from there and reports the bytes it left out as a gap,
with the reason. Later records are never lost to earlier damage, and a file is searched once
however many damages it has. Records and the log of gaps come from one pass.

Memory: a file is held whole by the task that reads it, so ``FILE_BYTES`` bounds what is written.

Only ids, digests and lengths are shuffled for the choice of revisits; payloads move once, to
join the choice, and are then written where they are. A group of equal payloads is joined to
its first one by a sort merge between freshly dealt tables, which Spark may split.

Defined results: a null payload is empty; a null id is written without an id and read as null,
and it loses to any id as the first of its payload; repeated rows are records like any other
(the later of two rows with the same id and payload is a revisit of it); a very long payload is
one record, and its file ends after it; an empty table writes no file; other columns, of any
name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, discard, new_folder, staged

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# ---------------------------------------------------------------- records


def record_id(page_id: int | None, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{nth}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit has no payload but its length and digest."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    lines = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]", "", url) if url else None,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "WARC-Profile": PROFILE if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "Page-ID": page_id,
        "Page-Refers-To": refers_to,
        "Page-Payload-Length": len(payload),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


class Damaged(ValueError):
    """A check failed."""


def parsed(raw: bytes, at: int, offset: int) -> tuple[Record, int]:
    """The record that begins at ``at`` of ``raw`` and where it ends; raises Damaged."""
    version = VERSION.match(raw, at)
    if not version:
        raise Damaged("no version line")
    end = raw.find(b"\r\n\r\n", version.end())
    if end < 0:
        raise Damaged("headers don't end")
    headers = {}
    for line in raw[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        raise Damaged("a required header is missing")
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no Content-Length")
    stop = end + 4 + int(headers["content-length"])
    if stop + 4 > len(raw) or raw[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the block doesn't end where Content-Length says")
    found = Record(offset, headers, raw[end + 4 : stop])
    if headers["warc-type"] != "revisit" and not digest_fits(headers.get("warc-payload-digest", ""), found.payload):
        raise Damaged("the payload's digest differs")
    return found, stop + 4


def digest_fits(told: str, payload: bytes) -> bool:
    """Whether a digest header's value is the payload's; kinds that aren't known fit."""
    kind, _, digest = told.partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("sha256", "sha1", "md5"):
        return True
    own = hashlib.new(kind, payload).digest()
    return digest.lower() == own.hex() or digest.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def unzipped(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at`` and where it ends; raises Damaged."""
    unpack, out, place = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            piece = data[place : place + (1 << 20)]
            if not piece:
                raise Damaged("a member is cut off")
            out.append(unpack.decompress(piece))
            place += len(piece)
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from e
    return b"".join(out), place - len(unpack.unused_data)


def begins_record(data: bytes, at: int) -> bool:
    """Whether a gzip member at ``at`` decompresses to a version line."""
    try:
        return bool(VERSION.match(zlib.decompressobj(31).decompress(data[at : at + 4096], 64)))
    except zlib.error:
        return False


def salvaged(data: bytes) -> Iterator[Record | Gap]:
    """All sound records of an archive in order, and the byte gaps between them."""
    at, bad, why = 0, None, ""
    zipped = plain = -1  # the next places of each kind found so far
    while at < len(data):
        try:
            if data[at : at + 3] == MAGIC:
                raw, end = unzipped(data, at)
                found, stop = parsed(raw, 0, at)
                if stop != len(raw):
                    raise Damaged("more than one record in a member")
            else:
                found, end = parsed(data, at, at)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            if zipped <= at:
                zipped = next_member(data, at + 1)
            if plain <= at:
                line = VERSION.search(data, at + 1)
                plain = line.start() if line else len(data)
            at = min(zipped, plain)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield found
        at = end
    if bad is not None:
        yield Gap(bad, len(data), why)


def next_member(data: bytes, at: int) -> int:
    """Where the next gzip member that holds a record begins, or the end."""
    while (at := data.find(MAGIC, at)) >= 0:
        if begins_record(data, at):
            return at
        at += 1
    return len(data)


# ---------------------------------------------------------------- tables


FILES = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"
FOUND = f"{RECORDS}, gap_end long, reason string"


def record_plan(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(row, refers_to) for the rows that are revisits, from ``pages`` with a fixed ``row`` column."""
    raw = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    digests = staged(pages.select(F.col("row"), F.col(id_col).alias("id"), F.octet_length(raw).alias("size"), F.sha2(raw, 256).alias("digest")), "digests")
    long_ones = digests.where(F.col("size") >= least)
    first = staged(long_ones.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    joined = long_ones.join(first, "digest").where(F.col("row") != F.col("first.row"))
    return staged(joined.select("row", F.col("first.id").alias("refers_to")), "revisits")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages as gzip-compressed WARC files; returns the table of files, staged."""
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    own = staged(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), url.alias("url"), F.col(payload_col).alias("html")), "pages")
    revisits = record_plan(own, "id", "html", least)
    ready = own.join(revisits, "row", "left").select("id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pyarrow.fs.FileSystem.from_uri(folder)
        out, path, n, size, done = None, "", 0, 0, []
        part = TaskContext.get().partitionId()
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    store.create_dir(top, recursive=True)
                    path, n, size = f"{top}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                payload = (html.as_py() or "").encode()
                raw = member(record(page_id.as_py(), url.as_py(), payload, hashlib.sha256(payload).hexdigest(), refers_to.as_py()))
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= file_bytes:
                    out.close()
                    out = done.append((path, n, size))
        if out is not None:
            out.close()
            done.append((path, n, size))
        for f in done:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in f], names=["path", "n_records", "n_bytes"])

    files = staged(ready.mapInArrow(run, FILES), "warc-files")
    discard(pages.sparkSession, own, revisits)
    return files


def salvage(files: DataFrame, folder: str) -> DataFrame:
    """Records and gaps of the files that ``files.path`` names, in one pass; a gap is a row with a reason, from ``offset`` to ``gap_end``."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FOUND.split(", ")])

    def row(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return None, None, None, None, None, path, x.start, x.end, x.reason
        number = lambda k: int(x.headers[k]) if x.headers.get(k, "").lstrip("-").isdigit() else None
        revisit = x.headers.get("warc-type") == "revisit"
        payload = x.payload
        digest = x.headers.get("warc-payload-digest", "").partition(":")[2] if revisit else hashlib.sha256(payload).hexdigest()
        size = number("page-payload-length") if revisit else len(payload)
        return number("page-id"), size, digest, x.headers.get("warc-type"), number("page-refers-to"), path, x.offset, None, None

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as source:
                    data, held = source.read(), []
                for x in salvaged(data):
                    held.append(row(path, x))
                    if len(held) >= 4096:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    n = max(1, min(files.count(), 10_000))
    return files.select("path").repartition(n, "path").mapInArrow(run, FOUND)


def records_of(found: DataFrame) -> DataFrame:
    return found.where("reason is null").drop("gap_end", "reason")


def gaps_of(found: DataFrame) -> DataFrame:
    """(path, start, end, reason): the quarantined byte ranges."""
    return found.where("reason is not null").select("path", F.col("offset").alias("start"), F.col("gap_end").alias("end"), "reason")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Write all pages, read them back, and raise where the archives lack a record or have a gap."""
    folder = new_folder(pages.sparkSession, "warc")
    files = write_archives(pages, folder, id_col, "url", payload_col)
    found = staged(salvage(files, folder), "warc-found")
    written = files.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    read, gaps = found.agg(F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())).first()
    if gaps or read != written:
        raise ValueError(f"{written} records written, {read} read, {gaps} gaps below {folder}")
    delete(pages.sparkSession, folder)
    return records_of(found).withColumnRenamed("page_id", id_col)
