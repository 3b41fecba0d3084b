"""WARC archives as a chunked record table.

Payloads travel as rows (record id, chunk number, bytes) of at most CHUNK bytes, cut in the JVM; the
writer streams them into gzip members and never holds a whole record, and the reader streams a
member's payload back in chunks with a running digest. A payload of at least SMALLEST bytes is stored
once: the record with the smallest page id is the response and the others are revisit records that
name it by id and digest. The full payload's length and digest are in every record's header, and for
responses what is read back is held against both.

Defined results: a null html counts as empty; pages that repeat the smallest page id of a payload are
all responses; a null page id never is the one referred to unless all of the payload's are null, and
is then a response; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, spread_join, stored
from .shared_files import new_file, opened

CHUNK, SMALLEST, ARCHIVE_BYTES = 64 << 10, 100, 512 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to); refers_to is null for responses.

    Which payloads occur more than once is counted over digests alone. Of a payload that very many pages
    have, all but the response lose their bytes before anything is shuffled; the other payloads are
    shuffled once, by digest.
    """
    payload = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    large = F.col("payload_bytes") >= SMALLEST
    every = stored(rows.groupBy(F.when(large, F.col("digest")).alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payloads")
    total = every.agg(F.sum("n")).first()[0] or 0
    # small payloads stand alone; a key of their own deals them out
    keyed = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.xxhash64("page_id").cast("string"))))
    known = F.col("_hot").isNotNull() & ~F.col("_hot.first").eqNullSafe(F.col("page_id"))
    bare = {"payload": F.when(known, F.lit(b"")).otherwise(F.col("payload"))}
    named = spread_join(keyed, every.where("n > 1 and key is not null"), ["key"], ["page_id"], total, bare)
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return named.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def chunked(plan: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table: a row for each ``size`` bytes of a payload that is stored, one row at least."""
    kept = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.floor((kept - 1) / size)).cast("int")
    cut = plan.select("page_id", "url", "payload", "payload_bytes", "digest", "refers_to", kept.alias("stored_bytes"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    data = F.when(F.col("stored_bytes") > 0, F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size))).otherwise(F.lit(b""))
    return cut.select("page_id", "url", "payload_bytes", "digest", "refers_to", "stored_bytes", "chunk_no", data.alias("data"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _header(r: dict) -> bytes:
    revisit = r["refers_to"] is not None
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in r["url"] or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(r['page_id'], r['digest'])}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{r['digest']}",
        f"X-Payload-Length: {r['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {r['stored_bytes']}",
    ]
    if r["page_id"] is not None:
        lines.append(f"X-Page-Id: {r['page_id']}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(r['refers_to'], r['digest'])}", f"X-Refers-To-Page-Id: {r['refers_to']}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n"


class ArchiveWriter:
    """Streams records into .warc.gz files, one gzip member a record."""

    def __init__(self, folder: str):
        self.folder, self.context, self.stream, self.uri, self.at, self.records = folder, None, None, None, 0, 0
        self.gzip = None

    def begin(self, head: bytes) -> Iterator[tuple[str, int, int]]:
        if self.stream is not None and self.at > ARCHIVE_BYTES:
            yield self.close()
        if self.stream is None:
            self.context = new_file(self.folder, ".warc.gz")
            self.uri, self.stream = self.context.__enter__()
            self.at, self.records = 0, 0
        self.gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.put(self.gzip.compress(head))

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, data: bytes) -> None:
        self.put(self.gzip.compress(data))

    def end(self) -> None:
        self.put(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.context.__exit__(None, None, None)
        self.stream = None
        return self.uri, self.records, self.at


def write(chunks: DataFrame) -> DataFrame:
    """Write the archives; returns (archive, records, bytes). A record's chunks follow one another."""
    folder = fresh_path(chunks.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, left = ArchiveWriter(folder), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if r["chunk_no"] == 0:
                    done += out.begin(_header(r))
                    left = r["stored_bytes"]
                out.add(r["data"])
                left -= len(r["data"])
                if left == 0:
                    out.end()
        if out.stream is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return stored(chunks.mapInArrow(run, "archive string, records long, bytes long"), "archives")


class ArchiveReader:
    """Reads a .warc.gz stream: header lines, then the payload in pieces of at most CHUNK bytes."""

    def __init__(self, stream):
        self.stream, self.buffer, self.inflate, self.rest = stream, b"", zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data or self.rest, zlib.decompressobj(31)
            raw = self.rest or self.stream.read(CHUNK)
            self.rest = b""
            if not raw:
                return False
            data = self.inflate.decompress(raw, CHUNK)
            if not self.inflate.eof:
                self.rest = self.inflate.unconsumed_tail
            if data:
                self.buffer += data
                return True
            if self.inflate.eof and not self.inflate.unused_data:
                self.rest = b""

    def header(self) -> dict[str, str] | None:
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        lines = self.buffer[:end].decode("utf-8").split("\r\n")
        self.buffer = self.buffer[end + 4 :]
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        return dict(line.split(": ", 1) for line in lines[1:])

    def payload(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            piece, self.buffer = self.buffer[: min(size, CHUNK)], self.buffer[min(size, CHUNK, len(self.buffer)) :]
            size -= len(piece)
            yield piece
        while len(self.buffer) < 4 and self._more():
            pass
        if self.buffer[:4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        self.buffer = self.buffer[4:]


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, chunks long"
CHUNKS = "record_id string, chunk_no long, data binary, digest_so_far string"


def _archives(archives: DataFrame) -> DataFrame:
    session = archives.sparkSession
    return archives.select("archive").repartition(max(1, session.sparkContext.defaultParallelism), F.xxhash64("archive"))


def _checked(head: dict[str, str], reader: ArchiveReader) -> tuple:
    """Run through one record; a response's payload must have the length and digest of its header."""
    digest, size, chunks = hashlib.sha256(), 0, 0
    for piece in reader.payload(int(head["Content-Length"])):
        digest.update(piece)
        size, chunks = size + len(piece), chunks + 1
    kind, said = head["WARC-Type"], (int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"))
    if kind == "response":
        if (size, digest.hexdigest()) != said:
            raise ValueError(f"{head['WARC-Record-ID']} was not read back as written")
    page, other = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
    return (int(page) if page is not None else None, *said, kind, int(other) if other is not None else None, chunks)


def read(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives, with length and digest of the full payload."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = opened(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    reader, rows = ArchiveReader(stream), []
                    while (head := reader.header()) is not None:
                        rows.append(_checked(head, reader))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)
                            rows = []
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return _archives(archives).mapInArrow(run, RECORDS)


def read_chunks(archives: DataFrame) -> DataFrame:
    """The chunk table of the archives: (record_id, chunk_no, data, digest_so_far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = opened(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    reader = ArchiveReader(stream)
                    while (head := reader.header()) is not None:
                        digest = hashlib.sha256()
                        for k, piece in enumerate(reader.payload(int(head["Content-Length"]))):
                            digest.update(piece)
                            yield pa.RecordBatch.from_pydict({"record_id": [head["WARC-Record-ID"]], "chunk_no": [k], "data": [piece], "digest_so_far": [digest.hexdigest()]})

    return _archives(archives).mapInArrow(run, CHUNKS)
