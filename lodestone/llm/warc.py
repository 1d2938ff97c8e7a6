"""WARC archives: deduplicated writing, and a salvage reader for damaged ones.

``write_archives`` writes one record a row, a gzip member each (or plain), into files of about ``target_bytes``. Equal
payloads are stored once: the row of the least id is the response, the others are revisits that name it. What a task
has written counts only if its line is in the manifest, which Spark commits; so files of lost or repeated tasks are
never read.

``read_archives`` reads each file from its beginning, a block at a time, and checks every record: the gzip checksum, the
version line, the length and the blank line behind it, block and payload digests. After a failed check it searches for the next
member or version line that passes all of them, goes on there, and gives a row for the bytes between: their place, number and
the check that failed. A record that lies inside a damaged one's payload can't be told from a later one. A record is
held whole, so a task's memory is one block, one batch and its largest record; a file is one task.

Nulls and ties: a null payload is empty. Rows of the least id and one payload are all responses, alike. A null id is
never the least if the payload has another; rows with null ids only are responses. A null url is left out.
Payloads under ``least`` bytes are responses always. Equal means equal SHA-256. An empty table gives no archives and
no rows. Other columns, whatever their names, aren't read. Very long texts make long records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import shared_path, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
RECORDS = "file string, offset long, length long, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, problem string"
#: Bytes read at once, searched at once, of a batch's payloads, of a plain record's header.
BLOCK, STEP, BATCH, HEADER = 1 << 20, 1 << 16, 4 << 20, 1 << 24
#: Larger records don't fit into a column.
MOST = (1 << 31) - 1
END = b"\r\n\r\n"


class Damaged(Exception):
    """A record failed a check."""


# writing


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(key: object, digest: str) -> str:
    return f"<urn:x-page:{'' if key is None else quote(str(key), safe='')}:{digest}>"


def record(kind: str, record_id: str, date: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    """A WARC/1.1 record."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *more, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + END


def page_record(key: object, url: str | None, payload: bytes, first: object, revisit: bool, date: str) -> bytes:
    """A page as a response, or as a revisit of the page first, which has its payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        more.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if revisit:
        more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_urn(first, digest))]
    return record("revisit" if revisit else "response", record_urn(key, digest), date, http if revisit else http + payload, more)


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_firsts(pages: DataFrame, key: str, url: str, payload: str, least: int) -> DataFrame:
    """(key, url, payload, first, revisit): first is the least id of the rows with the payload.

    Ids are aggregated by digest before they are joined back, and only ids and digests are; the pages stream by
    the hash table of their partition's digests, which is a small part of their own size.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    own = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    firsts = own.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("key").alias("first")).where("first is not null")
    joined = own.join(firsts.hint("shuffle_hash"), "digest", "left")
    return joined.select("key", "url", "payload", "first", F.coalesce(F.col("key").isNull() & F.col("first").isNotNull() | (F.col("key") > F.col("first")), F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, target_bytes: int = 32 << 20, level: int = 4, folder: str | None = None) -> DataFrame:
    """Writes the pages below folder (a new shared one by default) and gives the manifest (path, bytes, records). level 0: plain files."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        pack = (lambda data: gzip_member(data, level)) if level else (lambda data: data)
        attempt, out, held, rows, done = uuid.uuid4().hex, None, 0, 0, []

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}", held, rows))

        for batch in batches:
            for x in batch.to_pylist() if batch.nbytes < BATCH else (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                if out is None:
                    name = f"pages-{attempt}-{len(done):05d}.warc" + ".gz" * bool(level)
                    out, held, rows = files.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    info = pack(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", date, b"format: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields"), ("WARC-Filename", name)]))
                    held += out.write(info)
                held += out.write(pack(page_record(x["key"], x["url"], x["payload"], x["first"], x["revisit"], date)))
                rows += 1
                if held >= target_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), d)) for d in done], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return stored(with_firsts(pages, key, url, payload, least).mapInArrow(write, MANIFEST), "manifest")


# reading


class Source:
    """A file's bytes by their places, read a block at a time."""

    def __init__(self, handle: pa.NativeFile):
        self.handle, self.size, self.at, self.held = handle, handle.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes from at on, fewer at the end."""
        low = at - self.at
        if not 0 <= low <= low + n <= len(self.held):
            if at >= self.size:
                return b""
            self.at, self.held, low = at, self.handle.read_at(max(n, BLOCK), at), 0
        return self.held[low : low + n]

    def find(self, patterns: re.Pattern, at: int) -> int:
        """The first match at or after at, -1 without one. Patterns are of at most 16 bytes."""
        while at < self.size:
            piece = self.read(at, STEP)
            if m := patterns.search(piece):
                return at + m.start()
            at += len(piece) - 15 if len(piece) == STEP else len(piece)
        return -1


def _fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's header, in lower case."""
    first, *lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d+", first):
        raise Damaged("version line")
    out: dict[str, str] = {}
    last = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:  # a folded line
            out[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Damaged("header line")
        last = name.strip().lower()
        if last in out and last != "warc-concurrent-to":  # no other field may repeat: two headers have run together
            raise Damaged("repeated field")
        out[last] = value.strip()
    return out


def _length(fields: dict[str, str]) -> int:
    n = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", n):
        raise Damaged("content length")
    return int(n)


def _verify(data: bytes | memoryview, told: str | None, what: str) -> str | None:
    """The SHA-1 of data in base32 if it was told; other algorithms that hashlib has are checked, too."""
    if not told:
        return None
    name, _, value = told.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    found = hashlib.new(name, data).digest()
    if value.upper() not in (base64.b32encode(found).decode(), base64.b32encode(found).decode().rstrip("="), found.hex().upper()):
        raise Damaged(f"{what} digest")
    return base64.b32encode(found).decode() if name == "sha1" else None


def _checked(fields: dict[str, str], block: memoryview) -> dict:
    """The record as a row without its place, all digests verified."""
    _verify(block, fields.get("warc-block-digest"), "block")
    kind, payload, size, digest = fields.get("warc-type", ""), block, len(block), None
    if fields.get("content-type", "").startswith("application/http"):
        data = bytes(block)
        cut = data.find(END)
        if cut < 0:
            raise Damaged("http header")
        payload = memoryview(data)[cut + 4 :]
        size = len(payload)
        if kind == "revisit":  # its payload is elsewhere, its header tells the length
            m = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r$", data[: cut + 2])
            size = int(m[1]) if m else None
    told = fields.get("warc-payload-digest")
    if kind == "revisit":
        digest = (told or "").partition(":")[2] or None
    else:
        digest = _verify(payload, told, "payload")
    return {"type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": None if kind == "revisit" else bytes(payload)}


def _in_member(data: bytes) -> list[dict]:
    """All records of a member, which must fill it."""
    out, at, whole = [], 0, memoryview(data)
    while at < len(data):
        head = data.find(END, at)
        if head < 0:
            raise Damaged("header without an end")
        fields = _fields(data[at:head])
        end = head + 4 + _length(fields)
        if data[end : end + 4] != END:
            raise Damaged("record length")
        out.append(_checked(fields, whole[head + 4 : end]))
        at = end + 4
    if not out:
        raise Damaged("empty member")
    return out


def member_at(src: Source, at: int) -> tuple[list[dict], int]:
    """The records of the gzip member at a place, and the place behind it."""
    z, out, held, pos, n = zlib.decompressobj(31), [], 0, at, 1 << 12
    while not z.eof:
        piece = src.read(pos, n)
        if not piece:
            raise Damaged("member without an end")
        try:
            out.append(z.decompress(piece, MOST + 1 - held))
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        held += len(out[-1])
        if held > MOST:
            raise Damaged("member over 2 GB")
        if len(out) == 1 and out[0][:5] != b"WARC/"[: len(out[0])]:  # most false beginnings end here
            raise Damaged("version line")
        pos, n = pos + len(piece), min(2 * n, BLOCK)
    return _in_member(b"".join(out)), pos - len(z.unused_data)


def plain_at(src: Source, at: int) -> tuple[list[dict], int]:
    """The uncompressed record at a place, and the place behind it. The cheap checks come before the block is read."""
    n, head, cut = 1 << 12, b"", -1
    while cut < 0:
        head = src.read(at, n)
        cut = head.find(END)
        if cut < 0 and (len(head) < n or n >= HEADER):
            raise Damaged("header without an end")
        n *= 4
    fields = _fields(head[:cut])
    size, start = _length(fields), at + cut + 4
    if size > MOST:
        raise Damaged("record over 2 GB")
    if src.read(start + size, 4) != END:
        raise Damaged("record length")
    return [_checked(fields, memoryview(src.read(start, size)))], start + size + 4


#: Beginnings of records by the kind of file.
KINDS = {"member": (re.compile(rb"\x1f\x8b\x08"), member_at), "plain": (re.compile(rb"WARC/1\."), plain_at)}
EITHER = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def unit_at(src: Source, at: int, kind: str | None) -> tuple[list[dict], int, str]:
    own = "member" if src.read(at, 3) == b"\x1f\x8b\x08" else "plain"
    if kind is not None and own != kind:
        raise Damaged(f"no {kind} record")
    return *KINDS[own][1](src, at), own


def salvage(src: Source) -> Iterator[tuple[int, int, list[dict], str | None]]:
    """(place, length, records, None) of each valid unit in order, and (place, length, [], failed check) of each gap between them.

    After the first valid unit only its kind counts, so compressed bytes that look like a version line are no record.
    """
    at, kind = 0, None
    while at < src.size:
        try:
            rows, end, kind = unit_at(src, at, kind)
        except Damaged as e:
            since, why, found = at, str(e), None
            while found is None and 0 <= (at := src.find(KINDS[kind][0] if kind else EITHER, at + 1)):
                try:
                    found = unit_at(src, at, kind)
                except Damaged:
                    pass
            if found is None:
                yield since, src.size - since, [], why
                return
            yield since, at - since, [], why
            rows, end, kind = found
        yield at, end - at, rows, None
        at = end


def read_archives(files: DataFrame, payloads: bool = True, path: str = "path") -> DataFrame:
    """RECORDS, with payload if asked for, of the archives in the column path: a row a record, and one a gap, which has problem set."""
    schema = RECORDS.replace(", problem", ", payload binary, problem") if payloads else RECORDS
    names = [x.split()[0] for x in schema.split(", ")]
    types = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            system, base = pafs.FileSystem.from_uri(name)
            with system.open_input_file(base) as handle:
                for at, length, rows, why in salvage(Source(handle)):
                    for x in rows or [{"problem": why}]:
                        held.append({n: x.get(n) for n in names} | {"file": name, "offset": at, "length": length})
                        size += 200 + (len(x.get("payload") or b"") if payloads else 0)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_pylist(held, types)
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, types)

    own = files.where(F.col(f"`{path}`").isNotNull()).select(F.col(f"`{path}`").cast("string").alias("path"))
    return own.repartition(max(1, min(own.count(), 100_000))).mapInArrow(read, schema)


def archive_files(spark, folder: str) -> DataFrame:
    """(path) of the archives below a folder; their contents aren't read here."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(folder).select("path")


def quarantined(records: DataFrame) -> DataFrame:
    """(file, offset, length, problem) of the gaps."""
    return records.where("problem is not null").select("file", "offset", "length", "problem")


def page_digest(records: DataFrame, kind: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the page records; ids as kind."""
    part = lambda c: F.split(F.col(c), ":")[2]
    page = lambda c: F.when(part(c) != "", F.url_decode(part(c))).try_cast(kind)
    own = records.where(F.col("type").isin("response", "revisit") & F.startswith("record_id", F.lit("<urn:x-page:")))
    return own.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """page_digest of the pages, written to archives and read back."""
    files = write_archives(pages, key, url, payload, least)
    return page_digest(read_archives(files.select("path"), payloads=False), pages.schema[key].dataType.simpleString())
