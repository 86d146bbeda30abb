"""WARC archives: one gzip member per record, written by the tasks and read back sequentially.

A task appends its pages to an archive file in a shared folder and reports the files it finished; a table of these
reports is what is read back, so files of lost or repeated tasks are ignored. The reader takes an archive in small
pieces: it inflates one member at a time, frames the record by its Content-Length, and checks the digests on the way.
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
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import bit_map, spread_join, with_maybe, written
from creditmill.session import new_table_path

#: Payloads from this size on are written once; others that equal them revisit it.
LEAST = 1000
#: A task starts another file beyond this size.
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PIECE = 1 << 16
#: A record's head may not be longer.
HEAD = 1 << 20

# --- fixed values -----------------------------------------------------------------------------
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
# ----------------------------------------------------------------------------------------------
URN = "urn:x-page:"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f<>]")


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _sha1(hexed: str) -> str:
    """The usual form of a digest in a record's head."""
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _hex(labelled: str) -> str | None:
    kind, _, value = labelled.partition(":")
    try:
        return base64.b32decode(value.upper()).hex() if kind.lower() == "sha1" else None
    except ValueError:
        return None


def record_name(page_id: int | None, digest: str) -> str:
    return f"<{URN}{'' if page_id is None else page_id}:{digest}>"


def page_of(name: str) -> int | None:
    """The page_id in a record name of ``record_name``."""
    found = re.fullmatch(rf"<{URN}(-?\d+):[0-9a-f]*>", name or "")
    return int(found[1]) if found else None


def member(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, revisit: bool,
           refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member. A revisit holds the response's head only; ``payload`` is then not looked at."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    if not revisit:
        block += payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(page_id, digest)),
            ("WARC-Date", date)]
    if url is not None:
        safe = _UNSAFE.sub(lambda c: b"%%%02X" % c[0][0], url.encode("utf-8", "surrogatepass"))
        head.append(("WARC-Target-URI", safe.decode("utf-8", "replace")))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(refers_to, digest))]
    head += [("WARC-Payload-Digest", _sha1(digest)), ("WARC-Block-Digest", _sha1(hashlib.sha1(block).hexdigest())),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(lines) + packed.compress(block) + packed.compress(END) + packed.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str] = field(default_factory=dict)
    payload_bytes: int | None = None
    payload_digest: str | None = None
    payload: bytes | None = None
    error: str | None = None


class Members:
    """The members of a stream, one after the other; ``pieces`` yields the inflated bytes of the next one."""

    def __init__(self, stream, piece: int = PIECE):
        self.stream, self.piece, self.raw, self.offset = stream, piece, b"", 0

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(self.piece)
        return bool(self.raw)

    def pieces(self) -> Iterator[bytes]:
        inflate, first = zlib.decompressobj(31), 1
        while not inflate.eof:
            if not self.more():
                raise ValueError("the archive ends within a member")
            fed, self.raw = self.raw, b""
            took, self.offset = fed, self.offset + len(fed)
            try:
                while took and not inflate.eof:
                    out = inflate.decompress(took, self.piece)
                    took = inflate.unconsumed_tail
                    if out:
                        yield out
                while not inflate.eof and (out := inflate.decompress(b"", self.piece)):
                    yield out
            except zlib.error:  # the next member may begin in this piece, behind the first byte of this one
                self.raw, self.offset = fed[first:], self.offset - len(fed) + first
                raise
            self.raw, first = inflate.unused_data, 0
            self.offset -= len(self.raw)

    def skip(self) -> None:
        """To the next start of a member behind a fault."""
        while self.more():
            at = self.raw.find(GZIP)
            if at >= 0:
                self.raw, self.offset = self.raw[at:], self.offset + at
                return
            keep, read = self.raw[-2:], self.stream.read(self.piece)
            self.offset += len(self.raw) - len(keep)
            if not read:
                self.raw, self.offset = b"", self.offset + len(keep)
                return
            self.raw = keep + read


def _parse(head: bytes) -> dict[str, str]:
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no version line")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a head line without a colon")
        out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _read_member(pieces: Iterator[bytes], record: Record, with_payload: bool) -> None:
    held = b""
    while END not in held:
        if len(held) > HEAD:
            raise ValueError("the head does not end")
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("the head does not end")
        held += piece
    head, _, held = held.partition(END)
    record.headers = _parse(head)
    length = record.headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise ValueError("no Content-Length")
    left, whole, of_payload = int(length), hashlib.sha1(), hashlib.sha1()
    is_http = record.headers.get("content-type", "").lower().startswith("application/http")
    http, kept, size = (b"" if is_http else None), [], 0
    tail = b""
    while True:
        body, after = held[:left], held[left:]
        left -= len(body)
        whole.update(body)
        if http is not None:
            http += body
            if END in http:
                named, _, body = http.partition(END)
                http, record.headers = None, record.headers | {
                    f"http:{k.strip().decode('latin-1').lower()}": v.strip().decode("latin-1")
                    for k, _, v in (line.partition(b":") for line in named.split(b"\r\n")[1:])}
            else:
                body = b""
                if len(http) > HEAD:
                    raise ValueError("the response's head does not end")
        of_payload.update(body)
        size += len(body)
        if with_payload:
            kept.append(body)
        tail += after
        if len(tail) > len(END):
            raise ValueError("more bytes than Content-Length")
        piece = next(pieces, None)
        if piece is None:
            break
        held = piece
    if left or tail != END:
        raise ValueError("fewer bytes than Content-Length")
    stated = record.headers.get("warc-block-digest")
    if stated and _hex(stated) not in (None, whole.hexdigest()):
        raise ValueError("the block differs from its digest")
    stated = record.headers.get("warc-payload-digest", "")
    if record.headers.get("warc-type") == "revisit":  # the payload is elsewhere
        record.payload_digest = _hex(stated)
        named = record.headers.get("http:content-length", "")
        record.payload_bytes = int(named) if named.isascii() and named.isdigit() else None
        return
    record.payload_bytes, record.payload_digest = size, of_payload.hexdigest()
    record.payload = b"".join(kept) if with_payload else None
    if stated and _hex(stated) not in (None, record.payload_digest):
        raise ValueError("the payload differs from its digest")


def records(stream, with_payload: bool = False, piece: int = PIECE) -> Iterator[Record]:
    """The records of an archive. A faulty one has ``error`` set, and the reader goes on with the next member."""
    members = Members(stream, piece)
    while members.more():
        record, pieces = Record(members.offset), members.pieces()
        try:
            try:
                _read_member(pieces, record, with_payload)
            except ValueError as fault:
                record.error = str(fault)
                for _ in pieces:  # to the end of this member
                    pass
        except (ValueError, zlib.error) as fault:
            record.error = record.error or str(fault)
            members.skip()
        if record.error:
            record.payload = record.payload_bytes = record.payload_digest = None
        yield record


def classified(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (binary), payload_bytes, digest, revisit, refers_to for each row of ``pages``.

    Payloads are told apart by SHA-256. The groups are counted on narrow rows; a bit map of the revisiting (page_id,
    digest) then keeps all other pages out of the one shuffle that carries html.
    """
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("html")) \
        .select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1("html").alias("digest"),
                F.unhex(F.sha2("html", 256)).alias("sha"))
    large = rows.where(F.col("payload_bytes") >= least).groupBy("sha", "page_id").agg(F.count("*").alias("n"))
    large = written(large, "payloads")
    shared = written(large.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "shared")
    revisits = written(spread_join(large.select("sha", "page_id"), shared, ["sha"], "n", ["page_id"])
                       .where(~F.col("page_id").eqNullSafe(F.col("refers_to"))), "revisits")
    marked = with_maybe(rows, ["sha", "page_id"], bit_map(revisits, ["sha", "page_id"]), "maybe")
    found = revisits.select(F.col("sha").alias("s"), F.col("page_id").alias("p"), "refers_to", F.lit(True).alias("revisit"))
    joined = marked.where("maybe").join(found, (F.col("sha") == F.col("s")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    columns = ["page_id", "url", "payload_bytes", "digest"]
    return joined.select(*columns, F.when(F.col("revisit").isNull(), F.col("html")).alias("html"),
                         F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to").unionByName(
        marked.where(~F.col("maybe")).select(*columns, "html", F.lit(False).alias("revisit"),
                                             F.lit(None).cast("long").alias("refers_to")))


def write(pages: DataFrame, folder: str, least: int = LEAST, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all rows of ``pages`` below ``folder``, which executors share; (path, records, bytes) of the files written.

    A missing html is an empty payload, a missing url leaves out the target, a missing page_id an empty place in the
    record's name. Of equal payloads of ``least`` bytes and more the rows with the largest page_id are responses (each
    of them, if the page_id repeats), the others revisits of them; a missing page_id is smaller than any. No rows, no
    files. Column names beside page_id, url and html do not matter.
    """
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _folder(folder)
        store.create_dir(root, recursive=True)
        out, path, count, size, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            done.append((path, count, size))

        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if out is None:
                    path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(path, compression=None), 0, 0
                data = member(row["page_id"], row["url"], row["html"], row["payload_bytes"], row["digest"], row["revisit"],
                              row["refers_to"], date)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        paths, counts, sizes = list(zip(*done)) or ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p.rsplit('/', 1)[1]}" for p in paths], pa.string()),
                                          pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                                         names=["path", "records", "bytes"])

    return written(classified(pages, least).mapInArrow(per_partition, "path string, records long, bytes long"), "archives")


RECORD = ("path string, offset long, headers map<string,string>, payload_bytes long, payload_digest string,"
          " payload binary, error string")


def read(files: DataFrame, with_payload: bool = False, batch_rows: int = 256) -> DataFrame:
    """One row per record of the archives named in ``files.path``, each read by one task.

    path, offset (of its member), headers (lower-case names; those of the response begin with ``http:``),
    payload_bytes, payload_digest (hex SHA-1; both of the full payload, for a revisit as stated), payload where asked
    for, error. A faulty record has ``error`` and no payload columns.
    """
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = ["path", "offset", "headers", "payload_bytes", "payload_digest", "payload", "error"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _folder(path)
                with store.open_input_stream(at, compression=None) as stream:
                    for r in records(stream, with_payload):
                        rows.append((path, r.offset, list(r.headers.items()), r.payload_bytes, r.payload_digest, r.payload, r.error))
                        if len(rows) >= batch_rows:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(per_partition, RECORD)


def digest(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder, reads them back and reports what the records say."""
    back = read(write(pages, new_table_path(pages.sparkSession, "warc")))
    name = lambda header: F.nullif(F.regexp_extract(F.col("headers")[header], rf"^<{URN}(-?\d+):", 1), F.lit("")).cast("long")
    checked = back.where(F.assert_true(F.col("error").isNull(), F.concat_ws(" ", "path", "offset", "error")).isNull())
    return checked.select(name("warc-record-id").alias("page_id"), "payload_bytes", "payload_digest",
                          F.col("headers")["warc-type"].alias("record_type"), name("warc-refers-to").alias("refers_to"))


SQL = f"""
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to
FROM (SELECT page_id, h, last, strlen(h) >= {LEAST} AND page_id <> last AS again
      FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS last FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)))
"""
