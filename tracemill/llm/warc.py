"""WARC 1.1: one gzip member per record; a writer, and a sequential reader that decompresses incrementally."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_dir, written

READ_BYTES = 1 << 18
FILE_BYTES = 64 << 20
SCHEMA = "path string, offset bigint, record_type string, record_id string, target_uri string, content_type string, content_length bigint, payload binary, digest string, digest_ok boolean, error string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(payload: bytes, *, uri: str | None, record_id: str, record_type: str = "resource", content_type: str = "text/html; charset=utf-8", level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = [("WARC-Type", record_type), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if uri is not None:
        # a URI holds no white space or control character, so these are escaped
        head.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)))
    head += [("WARC-Block-Digest", digest(payload)), ("Content-Type", content_type), ("Content-Length", str(len(payload)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(text.encode()) + z.compress(payload) + z.compress(b"\r\n\r\n") + z.flush()


class _Members:
    """The file's members one after the other, each decompressed as it is read."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.raw, self.offset = f, b"", 0

    def _fill(self) -> bool:
        more = self.f.read(READ_BYTES)
        self.raw += more
        return bool(more)

    def parts(self) -> Iterator[bytes]:
        """The next member's content in pieces; ValueError if it is damaged or cut off."""
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.raw and not self._fill():
                raise ValueError("the gzip member is cut off")
            given = self.raw
            try:
                out = z.decompress(given, READ_BYTES * 8)
            except zlib.error as e:
                raise ValueError(f"bad gzip data: {e}") from e
            self.raw = z.unused_data if z.eof else z.unconsumed_tail
            self.offset += len(given) - len(self.raw)
            if out:
                yield out

    def more(self) -> bool:
        return bool(self.raw) or self._fill()

    def resync(self) -> bool:
        """Skip to what looks like the next member's head."""
        self.raw, self.offset = self.raw[1:], self.offset + min(1, len(self.raw))
        while True:
            at = self.raw.find(b"\x1f\x8b\x08")
            if at >= 0:
                self.raw, self.offset = self.raw[at:], self.offset + at
                return True
            cut = max(0, len(self.raw) - 2)
            self.raw, self.offset = self.raw[cut:], self.offset + cut
            if not self._fill():
                return False


def _parse(content: Iterator[bytes]) -> dict:
    """A record from its member's pieces, framed by its content length."""
    held, stop = bytearray(), -1
    while stop < 0:
        piece = next(content, None)
        if piece is None:
            raise ValueError("the header doesn't end")
        seen = max(0, len(held) - 3)
        held += piece
        stop = held.find(b"\r\n\r\n", seen)
    head, rest = bytes(held[:stop]), bytes(held[stop + 4 :])
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        else:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError("a header line has no colon")
            last = name.strip().lower()
            fields[last] = value.strip()
    if not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    length = int(fields["content-length"])
    # the content length tells how much is kept; what follows it is only counted
    pieces, have = [rest], len(rest)
    while have < length + 4 and (piece := next(content, None)) is not None:
        pieces.append(piece)
        have += len(piece)
    more = sum(len(piece) for piece in content)
    block = b"".join(pieces)
    out = {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "content_type": fields.get("content-type"), "content_length": length, "payload": block[:length], "digest": fields.get("warc-block-digest")}
    if have < length:
        out["error"] = "the block is shorter than its content length"
    elif more or block[length:] != b"\r\n\r\n":
        out["error"] = "the block isn't followed by two line ends"
    kind, _, want = (out["digest"] or "").partition(":")
    kind = kind.lower().replace("-", "")
    if kind in ("sha1", "sha256", "sha512", "md5"):
        h = hashlib.new(kind, out["payload"], usedforsecurity=False)
        out["digest_ok"] = want.lower() == h.hexdigest() or want.upper() == base64.b32encode(h.digest()).decode()
    return out


def records(f: BinaryIO) -> Iterator[dict]:
    """Every member's record in order; a damaged one has `error`, and reading goes on at the next member's head."""
    m = _Members(f)
    while m.more():
        offset = m.offset
        content = m.parts()
        try:
            out = _parse(content)
            for _ in content:
                pass
        except ValueError as e:
            out = {"error": str(e)}
        yield out | {"offset": offset}
        if "error" in out and "record_type" not in out and not m.resync():
            return


def write_warc(pages: DataFrame, path: str | None = None, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows as .warc.gz files of about file_bytes under path (a new shared folder if none is given); returns (path) of the files.

    A row is a `resource` record; its record id is derived from its id and its
    place.  A null body is written as an empty one of content type
    `application/x-null`, and a null id or URL is left out, so that reading
    tells them apart.  White space and control characters of a URL are escaped
    (`%20`), as no header line can hold them.  Repeated rows are records each;
    texts of any length are one record; no rows make no files; other columns
    aren't written.  Only files in the result count: those of attempts that
    failed aren't in it.
    """
    path = path or shared_dir(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(path)
        where.create_dir(base, recursive=True)
        name, f, size = "", None, 0
        for b in batches:
            for i, url, body in zip(*(b.column(k).to_pylist() for k in range(3))):
                if f is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    f = where.open_output_stream(f"{base}/.{name}", compression=None)
                raw = record((body or "").encode(), uri=url, record_id=_record_id(i), content_type="application/x-null" if body is None else "text/html; charset=utf-8")
                f.write(raw)
                size += len(raw)
                if size >= file_bytes:
                    f.close()
                    where.move(f"{base}/.{name}", f"{base}/{name}")
                    yield pa.RecordBatch.from_pylist([{"path": f"{path.rstrip('/')}/{name}"}])
                    f, size = None, 0
        if f is not None:
            f.close()
            where.move(f"{base}/.{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_pylist([{"path": f"{path.rstrip('/')}/{name}"}])

    rows = pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(body_col).cast("string"))
    return written(rows.mapInArrow(run, "path string"), "files")


def _record_id(i: int | None) -> str:
    """A UUID whose last 64 bits are the id; the variant 0 tells a null."""
    return str(uuid.UUID(int=0 if i is None else (1 << 64) | (i & (1 << 64) - 1)))


def id_of(record_id):
    """The row id in a record id that write_warc made (a Column); null for others."""
    tail = F.regexp_replace(F.substring(record_id, 30, 17), "-", "")
    high, low = F.conv(F.substring(tail, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(tail, 9, 8), 16, 10).cast("bigint")
    return F.when(record_id.rlike("^<urn:uuid:00000000-0000-0001-[0-9a-f]{4}-[0-9a-f]{12}>$"), F.shiftleft(high, 32).bitwiseOR(low))


def read_warc(files: DataFrame, *, path_col: str = "path") -> DataFrame:
    """Every record of the files named in a column, in the columns of SCHEMA.

    A file is read by one task from its beginning, a piece at a time; only one
    record is held, whatever the size of its header and block.  digest_ok is null without a digest that is known.  Damaged
    records are rows with an `error`; a missing file is an error of the job; an
    empty file and a table without rows have no records.  Null paths are left
    out, a path that is there twice is read twice.
    """
    names = files.select(F.col(path_col).cast("string").alias("path")).where("path is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("payload", pa.binary()), ("digest", pa.string()), ("digest_ok", pa.bool_()), ("error", pa.string())])
        for b in batches:
            for path in b.column(0).to_pylist():
                where, base = fs.FileSystem.from_uri(path)
                with where.open_input_stream(base, compression=None) as f:
                    rows, size = [], 0
                    for r in records(f):
                        rows.append(dict.fromkeys(_NAMES) | r | {"path": path})
                        size += len(r.get("payload", b"")) + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kinds)

    return names.repartition(max(1, names.count()), "path").mapInArrow(run, SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest_ok) of pages as read back from the WARC files that they are written to."""
    got = read_warc(write_warc(pages))
    html = F.when(F.col("content_type") != "application/x-null", F.decode("payload", "UTF-8"))
    return got.select(id_of(F.col("record_id")).alias("page_id"), F.col("target_uri").alias("url"), html.alias("html"), (F.col("digest_ok") & F.col("error").isNull()).alias("digest_ok"))
