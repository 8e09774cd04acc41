"""WARC archives: a writer with digests and revisits, and a reader that salvages damaged files.

Writer. Each record is a gzip member of its own. Of the rows with equal payloads the one with the
largest id is a response and the others revisit it; rows with payloads under `least_bytes` are all
responses. A task writes files of about `roll_bytes` under names of its own attempt and reports them as
rows; what a lost or repeated attempt leaves behind is in no manifest and is never read.

Reader. A file is read as a stream. Each member is inflated and its record checked: version line,
header fields, Content-Length, block digest. Where a check fails, the reader searches for the next
place with a member's magic bytes, or a version line in plain files, that opens a valid record, goes on
there, and logs the bytes between as a quarantined gap (path, start, end, reason). Good records before
and after a gap are recovered. A plain record's length is checked by the four bytes that must end it
before the record is read, and headers have a greatest length, so that a damaged length costs one seek
and not the rest of the file. Where a pattern comes next is remembered until it is passed, a header ends at
the next version line, and a member must give its first bytes within OPENING: what a failed check has
searched is not searched again, and the work is linear in the file. Only a place whose whole record can be
read and then has a false digest costs the length of that record. The memory is that of one record.

`read` gives records and gaps; `whole` fails on the first gap, for archives that must have none. Reading
tasks are counted from the manifest's files and bytes.

Files are opened by pyarrow's file systems from the URI of the shared folder.

Defined results: a null payload is empty; a null id is written as an empty name and reads as null;
payloads of any length; repeated rows are records each; other columns are not read; an empty table
writes no file and reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.scratch import new_folder

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
#: Bytes read at once.
CHUNK = 1 << 20
#: Bytes inflated or searched at once, and the greatest length of a plain record's header.
PIECE, HEADER_MOST = 1 << 16, 1 << 20
#: Bytes of a member, its own header included, after which its first bytes must have come out.
OPENING = 1 << 10
#: What lies between members where a writer is asked for it: false openings of both kinds, and other bytes.
JUNK = b"\x1f\x8b\x08\x00" + b"WARC/1.1\r\nX: 1\r\n\r\n" + b"\x1f\x8b\x08\x1f" + b"noise " * 20 + b"WARC/1.0\r\nContent-Length: 7\r\n\r\n"
#: Bytes of archives that a reading task takes.
TASK_BYTES = 256 << 20
ROLL_BYTES = 64 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

RECORD = "page_id bigint, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, path string, start bigint, end bigint, gap string"
_ARROW = pa.schema([(c, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for c, t in map(str.split, RECORD.split(", "))])
MANIFEST = "path string, records bigint, bytes bigint"


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, payload_digest: str, refers_to) -> bytes:
    """One record. A revisit holds no payload; its size and digest are in the header."""
    response = refers_to is None
    block = HTTP_HEAD % len(payload) + (payload if response else b"")
    name = "" if page_id is None else page_id
    fields = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if not response:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"Content-Length: %d\r\n\r\n" % len(block)
    return head + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Damaged(Exception):
    pass


def header(raw: bytes) -> tuple[dict[str, str], int]:
    """The fields, names in lower case, of a header without its empty line, and the length of the block."""
    fields, at = {}, raw.find(b"\r\n")
    while at >= 0:
        end = raw.find(b"\r\n", at + 2)
        line = raw[at + 2 : end if end >= 0 else len(raw)]
        name, colon, value = line.partition(b":")
        if not colon or line.startswith(VERSION[:5]):
            raise Damaged("bad header field")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        at = end
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or len(size) > 15:
        raise Damaged("bad Content-Length")
    return fields, int(size)


def record(fields: dict[str, str], block: bytes) -> dict:
    """A record's columns, its digests checked."""
    if fields.get("warc-block-digest", "") not in ("", f"sha1:{digest(block)}"):
        raise Damaged("block digest differs")

    def number(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text.isascii() and text.lstrip("-").isdigit() and len(text) < 19 else None

    kind = fields.get("warc-type")
    body = block.partition(b"\r\n\r\n")[2]
    found = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and found and found != digest(body):
        raise Damaged("payload digest differs")
    size = number("x-payload-length")
    return {
        "page_id": number("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "payload_bytes": len(body) if kind == "response" or size is None else size,
        "payload_digest": found or digest(body), "refers_to": number("warc-refers-to"), "payload": body if kind == "response" else None,
    }


class _Window:
    """A seekable file from `start` on: `data[at:]` are its next bytes; what lies before is let go by and by."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.ended, self.origin = stream, b"", 0, False, 0
        self.known: dict[bytes, tuple[int, int]] = {}  # of a pattern: a place of it, and up to where there is no earlier one

    @property
    def start(self) -> int:
        return self.origin + self.at

    def left(self) -> int:
        return len(self.data) - self.at

    def want(self, n: int) -> bool:
        """Whether there are n next bytes; reads what they need."""
        while not self.ended and self.left() < n:
            got = self.stream.read(max(CHUNK, n - self.left()))
            self.ended = not got
            self.origin, self.data, self.at = self.origin + self.at, self.data[self.at :] + got, 0
        return self.left() >= n

    def peek(self, place: int, n: int) -> bytes:
        """n bytes, or fewer at the end, at a place of the file."""
        if self.origin <= place and place + n <= self.origin + len(self.data):
            return self.data[place - self.origin : place - self.origin + n]
        here = self.stream.tell()
        self.stream.seek(place)
        found = self.stream.read(n)
        self.stream.seek(here)
        return found

    def find(self, what: bytes, within: int) -> int:
        """How far ahead `what` begins, if that is less than `within` bytes; -1 if not. Nothing is searched twice."""
        place, seen = self.known.get(what, (-1, 0))
        size = PIECE
        while place < self.start:
            full = self.want(min(size, within))
            place = self.data.find(what, max(self.at, seen - self.origin))
            if place >= 0:
                place += self.origin
                break
            seen = self.origin + max(0, len(self.data) - len(what) + 1)
            if not full or size >= within:
                break
            size *= 4
        self.known[what] = place, seen
        ahead = place - self.start
        return ahead if 0 <= ahead < within else -1


def _member(window: _Window) -> tuple[dict, int]:
    """The record of the gzip member that is next, and the member's length."""
    inflater, out, used, made = zlib.decompressobj(31), [], 0, 0
    while not inflater.eof:
        if not window.want(used + 1):
            raise Damaged("gzip member is cut off")
        piece = window.data[window.at + used : window.at + used + (PIECE if made else OPENING - used)]
        try:
            out.append(inflater.decompress(piece))
        except zlib.error as error:
            raise Damaged(f"bad gzip member: {error}") from None
        used += len(piece) - len(inflater.unused_data)
        if made < 7 <= made + len(out[-1]) and not b"".join(out).startswith(VERSION[:7]):
            raise Damaged("no version line in the member")
        made += len(out[-1])
        if not made and used >= OPENING:
            raise Damaged("nothing comes out of the member")
    raw = b"".join(out)
    if not raw.startswith(VERSION[:7]):
        raise Damaged("no version line in the member")
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        raise Damaged("header is cut off")
    fields, size = header(raw[:cut])
    if raw[cut + 4 + size :] != b"\r\n\r\n":
        raise Damaged("Content-Length does not fit the member")
    return record(fields, raw[cut + 4 : cut + 4 + size]), used


def _plain(window: _Window) -> tuple[dict, int]:
    """The record that is next without compression, and its length."""
    cut = window.find(b"\r\n\r\n", HEADER_MOST)
    if cut < 0:
        raise Damaged("header is cut off")
    fields, size = header(window.data[window.at : window.at + cut])
    end = cut + 4 + size
    if window.peek(window.start + end, 4) != b"\r\n\r\n":
        raise Damaged("Content-Length does not fit")
    window.want(end + 4)
    return record(fields, window.data[window.at + cut + 4 : window.at + end]), end + 4


def _next(window: _Window) -> tuple[dict, int]:
    window.want(len(VERSION))
    if window.data.startswith(MAGIC, window.at):
        return _member(window)
    if window.data.startswith(VERSION[:7], window.at):
        return _plain(window)
    raise Damaged("neither a gzip member nor a version line")


def salvage(stream, path: str) -> Iterator[dict]:
    """Records and gaps of a seekable stream, in order."""
    window = _Window(stream)
    while window.want(1):
        try:
            found, size = _next(window)
        except Damaged as error:
            start, reason = window.start, str(error)
            window.at += 1
            while window.want(1):  # to the next place that opens a valid record
                window.want(PIECE)
                places = [d for d in (window.find(MAGIC, window.left()), window.find(VERSION[:7], window.left())) if d >= 0]
                if not places:
                    window.at = len(window.data) if window.ended else max(window.at + 1, len(window.data) - len(VERSION))
                    continue
                window.at += min(places)
                try:
                    _next(window)
                    break
                except Damaged:
                    window.at += 1
            yield {"path": path, "start": start, "end": window.start, "gap": reason}
            continue
        yield found | {"path": path, "start": window.start, "end": window.start + size}
        window.at += size


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def plan(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to of each row.

    The largest id of a digest is found with map-side combining and joined back, so a digest that a third
    of the rows share is split by AQE; the payload is moved once.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload")).withColumn("_hex", F.sha1("payload"))
    last = rows.groupBy("_hex").agg(F.max("page_id").alias("_last"))
    revisits = (F.col("page_id") != F.col("_last")) & (F.length("payload") >= least_bytes)
    return rows.join(last, "_hex").withColumn("refers_to", F.when(revisits, F.col("_last"))).select("page_id", "url", "payload", "refers_to")


def write(planned: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES, junk: bytes = b"") -> DataFrame:
    """Writes the archives below a shared folder; gives the manifest (path, records, bytes), itself written there.

    junk goes before each member, for archives that have to be salvaged.
    """

    def files(it):
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        out, path, size, n, made = None, "", 0, 0, []

        def close():
            nonlocal out
            if out:
                out.close()
                made.append({"path": f"{folder}/{path}", "records": n, "bytes": size})
                out = None

        for part in it:
            for row in part.to_pylist():
                if out is None:
                    path = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = system.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                raw = junk + member(record_bytes(row["page_id"], row["url"], row["payload"], digest(row["payload"]), row["refers_to"]))
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    planned.mapInArrow(files, MANIFEST).write.parquet(f"{folder}/manifest")
    return planned.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(manifest: DataFrame, *, payloads: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Records and gaps (gap is not null) of the files in a table with `path` and `bytes`. A file is a task's least work."""

    def records(it):
        for part in it:
            for path in part.column(0).to_pylist():
                system, name = _open(path)
                with system.open_input_file(name) as stream:
                    held, size = [], 0
                    for found in salvage(stream, path):
                        size += 200 + (len(found.get("payload") or b"") if payloads else 0)
                        if not payloads:
                            found["payload"] = None
                        held.append(found)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    files, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path").repartition(max(1, min(files, max(2 * cores, -(-size // task_bytes))))).mapInArrow(records, RECORD)


def whole(records: DataFrame) -> DataFrame:
    """The records, or an error that names the first gap met."""
    gap = F.concat(F.lit("gap in "), "path", F.lit(" at "), F.col("start").cast("string"), F.lit(": "), "gap")
    return records.filter(F.when(F.col("gap").isNotNull(), F.raise_error(gap).cast("boolean")).otherwise(F.lit(True)))


def archive_folder(spark: SparkSession) -> str:
    return new_folder(spark, "warc")
